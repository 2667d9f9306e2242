"""Query registry and the conventions shared by both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, integers to BIGINT, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(roles) -> DataFrame`` under ``name`` with its oracle."""

    def register(fn):
        from geopanel.plans.roles import Roles

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Roles(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0e0)"


def with_ctes(*blocks: str, body: str) -> str:
    """``WITH`` the named blocks of :data:`geopanel.plans.sql_roles.BLOCKS` and :data:`geopanel.plans.sql_run.BLOCKS` (dependencies included)."""
    from geopanel.plans import sql_roles

    texts, needs, raw, once = sql_roles.BLOCKS, sql_roles.NEEDS, set(), set()
    if not set(blocks) <= set(texts):  # the published run is built from other families' SQL
        from geopanel.plans import sql_run

        texts, needs, raw, once = texts | sql_run.BLOCKS, needs | sql_run.NEEDS, sql_run.RAW, sql_run.ONCE
    order: list[str] = []

    def visit(b: str) -> None:
        for d in needs.get(b, ()):
            visit(d)
        if b not in order:
            order.append(b)

    for b in blocks:
        visit(b)
    head = "WITH RECURSIVE " if raw & set(order) else "WITH "
    return head + ",\n".join(texts[b] if b in raw else f"{b} AS {'MATERIALIZED ' if b in once else ''}({texts[b]})" for b in order) + "\n" + body


def class_sql(value: str, n: int, src: str, keys: str = "'x'") -> str:
    """Cut rule by row number; emits every column of ``src`` plus ``cls``."""
    cuts = ", ".join(f"max(CASE WHEN rn = floor({i / n!r}e0 * len) + 1 THEN v END) AS c{i}" for i in range(1, n))
    cases = " ".join(f"WHEN {value} <= c{i} THEN {i}" for i in range(1, n))
    return f"""SELECT s.*, CASE WHEN {value} IS NULL THEN NULL {cases} ELSE {n} END AS cls FROM ({src}) s LEFT JOIN (
        SELECT k, {cuts} FROM (SELECT {keys} AS k, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS rn,
            count(*) OVER (PARTITION BY {keys}) AS len FROM ({src}) WHERE {value} IS NOT NULL) GROUP BY k) c ON c.k = {keys if keys == "'x'" else 's.' + keys}"""
