"""Repeated lines, by counting the documents of every line's digest.

1. Every text is split at line feeds; each line is normalised to its key (ASCII white space
   stripped at both ends, A-Z lower-cased). Keys of fewer than ``min_chars`` code points are
   never dropped and go no further.
2. The others become 128-bit digests, with their document and position. From here on no text
   is moved but once, at the end.
3. Documents are counted for each digest and part of the documents, then the parts are
   summed: a line that a third of all documents have is counted by as many tasks as there are
   parts, and a digest's parts are at most ``spark.sql.shuffle.partitions`` rows.
4. Lines whose digest has ``min_docs`` documents or more go from all but the largest doc_id;
   their positions are gathered for each document, and the text is put together without them.

Defined cases: a null or empty text is one empty line, and stays or becomes an empty text;
rows without a doc_id are not counted and lose nothing; rows that repeat a doc_id are one
document with all their lines, and each is cut by itself; a line that stands several times in
one document counts once; every one of its places goes, or stays in the largest doc_id; if
all lines go, the text is empty; other columns are carried along, whatever their names; an
empty table gives an empty result. Two different lines are confused with a probability of
n^2 / 2^129 among n lines.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.columns import unused
from sensorlake.session import checkpoint_dir

#: ASCII white space, as a set of characters for trim.
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), ascii_uppercase, ascii_lowercase)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int, parts: int) -> DataFrame:
    """doc_id, text_key, place, the two halves of the key's digest (h, g), and the document's
    part, for each line of ``min_chars`` or more."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    exploded = rows.where("doc_id is not null").select("doc_id", "text_key", F.posexplode(text_lines(F.col("text"))).alias("place", "line"))
    keyed = exploded.select("doc_id", "text_key", "place", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc_id",
        "text_key",
        "place",
        F.xxhash64("key").alias("h"),
        F.xxhash64(F.lit(min_chars), "key").alias("g"),
        F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"),
    )


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h, g, part, last): digests of at least ``min_docs`` documents, a row for each part in
    which they occur, with their largest doc_id."""
    parts = lines.groupBy("h", "g", "part").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
    whole = parts.groupBy("h", "g").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.collect_list("part").alias("parts")
    )
    return whole.where(F.col("n") >= min_docs).select("h", "g", F.explode("parts").alias("part"), "last")


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, and any others) without the lines that at least ``min_docs``
    documents have; adds n_lines (before) and n_dropped."""
    checkpoint_dir(docs.sparkSession)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = long_lines(docs, min_chars, parts).checkpoint()
    found = lines.join(frequent_lines(lines, min_docs), ["h", "g", "part"]).where(F.col("doc_id") != F.col("last"))
    gone = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("gone"))

    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
    )
    split = whole.join(gone, ["doc_id", "text_key"], "left").select("row", "gone", text_lines(F.col("row.text")).alias("lines"))
    n_lines = F.size("lines").cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    whole_text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    cut = split.select(
        "row", F.when(F.col("gone").isNull(), whole_text).otherwise(text).alias("kept"), n_lines.alias("n_lines"), "gone"
    )
    columns = [F.col("kept").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return cut.select(
        *columns,
        F.col("n_lines").alias(unused(docs, "n_lines")),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(unused(docs, "n_dropped")),
    )
