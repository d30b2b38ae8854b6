"""Column names and types of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Header names accepted in post files, and the names used here.
POST_HEADERS = {
    "ID": "post_id",
    "TweetID": "post_id",
    "Username": "username",
    "CreateDate": "create_date",
    "Biased": "truth",
    "Keyword": "keyword",
    "Text": "text",
    "Model": "model",
}

POST_TYPES = {
    "post_id": "bigint",
    "username": "string",
    "create_date": "string",
    "truth": "int",
    "keyword": "string",
    "text": "string",
}

POST_COLUMNS = list(POST_TYPES)


def declare_posts(raw: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rename known headers and cast to the declared types.

    Numbers written as ``1.0`` are accepted for the label; text that is not a
    number becomes null. Other columns pass through; ``*_Binary`` become integers.
    """
    types = {**POST_TYPES, "post_id": id_type}
    columns = []
    for header in raw.columns:
        name = POST_HEADERS.get(header, header)
        column = F.col(f"`{header}`")
        if types.get(name) == "int" or header.endswith("_Binary"):
            column = column.try_cast("double").try_cast("int")
        elif types.get(name, "string") != "string":
            column = column.try_cast(types[name])
        columns.append(column.alias(name))
    return raw.select(*columns)
