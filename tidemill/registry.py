"""All core queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import timestamps
from tidemill.plans import captures, jobs, library, pages, relational, upkeep  # noqa: F401 - importing enters their queries
from tidemill.plans.book import QUERIES, SQL, Query
from tidemill.streaming import jobs as _streams  # noqa: F401 - after the plans, whose SQL they share


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.captures_by_host(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {**QUERIES, "p4_found": timestamps.found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
