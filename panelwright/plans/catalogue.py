"""All queries of the panel engine with the SQL that they are checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors
from ..sources import panels
from . import oracle_sql as sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(func):
        _QUERIES[name] = func
        if oracle is not None:
            _ORACLE[name] = oracle
        return func

    return put


def rounded(x, digits: int):
    """Rounded for comparison, off the ties that exact prices produce; no negative zero."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(sql.off_ties(digits)), digits) + F.lit(0.0)


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with company figures and money flow."""
    return panels.figures(panels.bars(spark, sf_dir), spark, sf_dir).join(panels.flows(spark, sf_dir), ["date", "code"])


def _panel_for(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = set(factors.get_spec(name).needs) - set(factors.BARS)
    if not needs:
        return panels.bars(spark, sf_dir)
    return full_panel(spark, sf_dir) if any(n.endswith("_amount") for n in needs) else panels.figures(panels.bars(spark, sf_dir), spark, sf_dir)


def _factor_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = factors.with_factors(_panel_for(name, spark, sf_dir), [name])
        return out.select("date", "code", rounded(name, sql.factor_digits(name)).alias("value"))

    return run


for _name in sql.FACTORS:
    query(f"factor_{_name.removeprefix('calc_')}", sql.factor(_name))(_factor_query(_name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_evaluation, queries_portfolio  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)
