"""Corpus pipeline: toxic documents go, one of each group of near copies stays, repeated passages are cut, secrets are replaced,
and what is left is packed into training sequences. Every stage takes and returns whole tables of documents; the last
returns the packed pieces. A cluster's shared folder is named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopanel.llm import packing, paragraphs, secrets, simhash_gray, toxicity
from geopanel.llm.common import fresh, table
from geopanel.session import materialised, scratch_path

CAPACITY, END = 1024, 2


def _counted(before: list[str], docs: DataFrame) -> DataFrame:
    """The columns as before, ``n_chars`` (where there is one) following the changed text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in before])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rejected documents go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=True)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each component the row with the least identifier stays (of rows with the same one, that with the least hash
    of the text), once; rows without an identifier all stay. Rows are told apart by their texts, not by identifiers alone."""
    owner, own, row = fresh(docs, "kept", "own", "row")
    kept = simhash_gray.least_rows(docs.select("doc_id", "text")).select(F.col("doc_id").alias(owner), F.col("key").alias(own))
    rows = docs.where("doc_id IS NOT NULL").withColumn(row, F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = rows.join(kept, (F.col("doc_id").cast("long") == F.col(owner)) & (F.col(row) == F.col(own)), "left_semi").dropDuplicates(["doc_id", row]).drop(row)
    return rows.unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages that an earlier document holds are cut out; a document of which nothing is left goes. Texts that only share an
    identifier are documents of their own; repeated rows are one document. Rows without an identifier stay as they are."""
    (key,) = fresh(docs, "key")
    keyed = materialised(paragraphs.row_keys(docs, key))
    return _counted(docs.columns, paragraphs.without_repeats(keyed, paragraphs.repeated(keyed, id_col=key), id_col=key))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: confirmed secrets are replaced."""
    words = secrets.dictionary(docs)
    forest = secrets.train(secrets.labelled(docs), words)
    return _counted(docs.columns, secrets.redact(docs, forest, words))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of every document and their places in the sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("secret_scans", hide_secrets),
    ("packing", pack),
]
#: Scores of a trained machine, tokenizers and components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
