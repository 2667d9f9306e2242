"""Sinks: ordered parquet, per-unit JSON documents, block upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_parquet(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Files hold consecutive key ranges and are sorted inside, so readers skip row groups by key."""
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def documents(rows: DataFrame, path: str, level: str = "level") -> None:
    """``level, unit, doc`` -> one text line ``{"<unit>": doc}`` per unit, a folder per level."""
    # Document keys are already sorted: same rows, same bytes.
    key = F.concat(F.lit('{"'), F.col("unit").cast("string"), F.lit('":'))
    out = rows.select(level, "unit", F.concat(key, F.col("doc"), F.lit("}")).alias("value"))
    (
        out.repartitionByRange(F.col(level), F.col("unit"))
        .sortWithinPartitions(level, "unit")
        .select(level, "value")
        .write.mode("overwrite")
        .partitionBy(level)
        .text(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def upsert_blocks(df: DataFrame, path: str, block: str = "block") -> None:
    """Replace the blocks present in ``df``; other blocks of the table stay as they are."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(block)
        .parquet(path)
    )


def lookup(matches: DataFrame, path: str, key: str, fields: Sequence[str]) -> None:
    """Parquet table plus one JSON line per key; unmatched keys map to null."""
    matches.write.mode("overwrite").parquet(f"{path}/table")
    lookup_lines(matches, key, fields).write.mode("overwrite").text(f"{path}/json")


def lookup_lines(matches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    hit = F.col(fields[0]).isNotNull()
    body = F.when(hit, F.to_json(F.struct(*fields))).otherwise("null")
    return matches.select(F.concat(F.lit('{"'), F.col(key).cast("string"), F.lit('":'), body, F.lit("}")).alias("value"))
