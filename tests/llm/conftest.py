import datetime

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


# Names an operator might use inside, as columns of the caller.
CLASHES = "hash rows row h key kept keep_id group_size ids band bucket n n_chars position score pieces component"


@pytest.fixture(scope="session")
def with_clashes():
    def add(df):
        names = [n for n in CLASHES.split() if n not in df.columns]
        return df.withColumns({n: F.lit(datetime.date(2020, 1, 1)) for n in names})

    return add
