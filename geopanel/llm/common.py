"""Helpers shared by the text operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words everywhere in this package: space and 0x09-0x0D.
SPACE = b" \t\n\x0b\x0c\r"
#: The same set as a regular expression of the SQL engine.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a few numbers each that may be sent to every task; a larger side of a join is shuffled.
SMALL = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier and text only, null text as empty; further columns, whatever their names, stay behind."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A key with more than one in so many rows counts as frequent; there are at most so many of them.
FREQUENT = 1000


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``n`` how many of all ``total`` rows hold it.
    Frequent keys, ``FREQUENT`` at most, go to every task, so their rows stay where they are; the others are shuffled."""
    frequent = F.col("n") * FREQUENT > total
    hot, cold = F.broadcast(table.where(frequent).drop("n")), table.where(~frequent).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(*[key] if isinstance(key, str) else key), key, "left_anti").join(cold, key))


class Memo(dict):
    """A dictionary that computes missing entries and starts anew at ``limit`` of them, so that it never outgrows a worker."""

    def __init__(self, compute, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


@functools.lru_cache(maxsize=4)
def once_per_worker(factory, source):
    """``factory(source)``, built once in each Python worker and kept for its later tasks."""
    return factory(source)
