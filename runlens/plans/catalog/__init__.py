"""Every operator as a query over the test tables, with SQL where SQL can say it."""

from runlens.plans.catalog import metrics, retrieval, scoring, shape, sources, text, topics  # noqa: F401
from runlens.plans.catalog.registry import CATALOG

__all__ = ["CATALOG"]
