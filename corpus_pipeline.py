"""The corpus pipeline: five stages, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``docs``.

Defined cases: null and empty texts have no letters, so the language stage rejects them if
the quality stage has not; rows that repeat a doc_id and its text are copies of one
document, and the near-duplicate stage keeps one; different texts of one doc_id are judged
each by itself; empty tables pass through; extra columns are carried along.
"""

from __future__ import annotations

import os
import sys
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from sensorlake.llm import chunk_dedup, language_id, minhash_dedup, packing, quality_gam  # noqa: E402
from sensorlake.llm.columns import unused  # noqa: E402
from sensorlake.llm.queries import byte_bpe, table  # noqa: E402
from sensorlake.session import add_to_python_path, scratch_path  # noqa: E402

#: A document whose language is less certain than this is rejected.
LEAST_CERTAIN = 0.5


def on_workers(stage):
    """``stage`` with this folder on the Python path of Spark's workers."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        add_to_python_path(spark, ROOT)
        return stage(spark, docs, sf_dir)

    return run


@on_workers
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_gam.train(docs, labels)
    return quality_gam.rate(docs.select("text", own(docs)), model).where("predicted = 1").select("_own.*")


@on_workers
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    model = language_id.train(docs, F.lit(True))
    found = language_id.identify(docs.select("text", own(docs)), model)
    return found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_CERTAIN)).select("_own.*")


@on_workers
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    groups = minhash_dedup.link_groups(docs.select("doc_id", "text"), n=5, percent=80, by_text=True)
    one = ["doc_id", "text_key"]
    rows = groups.where("doc_id is not null").groupBy(*one, "component", "kept").count()
    # Of the least doc_id's texts in a group one stays; texts without words are no group.
    group = F.coalesce("component", "text_key")
    stays = rows.where("kept").groupBy("doc_id", group.alias("group")).agg(F.min("text_key").alias("text_key"))
    stays = stays.select(*one, F.lit(True).alias("stays"))
    # Kept once, as a small table: the plan of the groups would stand in each of the joins below.
    judged = rows.join(stays, one, "left").groupBy(*one).agg(F.max("stays").isNull().alias("gone"), F.max("count").alias("count"))
    judged = judged.where("gone or count > 1").checkpoint()
    key, digest, place = (unused(docs, c) for c in ("_id", "_text_key", "_place"))
    keyed = docs.withColumns({key: F.col("doc_id").cast("long"), digest: F.xxhash64(F.col("text").cast("string"))})
    named = [F.col(a).alias(b) for a, b in zip(one, (key, digest), strict=True)]
    left = keyed.join(judged.where("gone").select(*named), [key, digest], "left_anti")
    copied = judged.where("count > 1 and not gone").select(*named)
    order = Window.partitionBy(key, digest).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = left.join(copied, [key, digest], "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    kept = left.join(copied, [key, digest], "left_anti").unionByName(once.drop(place))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@on_workers
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that another one has."""
    cut = chunk_dedup.remove_repeats(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    changed = cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


@on_workers
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024: one row for each piece."""
    pieces = packing.token_pieces(docs, byte_bpe())
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def own(docs: DataFrame):
    """All columns of the documents as one, so that added columns can't replace them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", pack),
]

#: Trained models and rolling hashes are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
