"""Removal of repeated passages by content-defined chunks, cut by a gear rolling hash.

A passage is a repeat where ``min_words`` consecutive words stand in a document of smaller
doc_id, or further up in the same document; the smallest doc_id keeps it. All words of such
runs are removed, and no others: passages go up to their exact borders, and any shared
passage of ``min_words`` words or more is found, whatever its words.

1. A gear hash rolls over the words and forgets those older than ``gear`` words. A text is cut
   where the hash is the least of any ``reach`` consecutive places (the last of equal ones), so
   insertions move no cut but those beside them, and a chunk is what lies between two cuts, both
   gear windows included. With ``gear - 1 + 2 * reach <= min_words`` every run of ``min_words``
   words holds a whole chunk, and its chunks depend on its words only. Of a run's chunks the one
   with the least digest stands for it: about one chunk in four, one for seven words. These
   digests are counted over all documents, after a first count in each task.
2. In documents with a chunk that several documents have, the digests of all runs of
   ``min_words`` words that such a chunk stands for are compared in the same way; runs that are
   also in a document of smaller doc_id are marked. So a shared chunk is extended to the
   passage's exact borders.
3. Marked runs, and runs that stood further up in the same document, are cut. Occurrences
   that overlap (a run in a phrase of under ``min_words`` words said over and over) are one
   occurrence, so a text that is such a phrase and nothing else is left alone.

Words are compared as they are, white space between them is not.

Defined cases: null texts stay null and empty texts empty; texts of fewer than ``min_words``
words stay as they are; rows without a doc_id stay as they are; rows
that repeat a doc_id with the same text count as one document and are treated alike;
different texts of one doc_id are parts of one document in no order, so what only they share
stays in all of them, and what a smaller doc_id has goes from all; an empty table gives an
empty result. Added columns replace columns of their own name only;
all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sensorlake.llm.columns import unused
from sensorlake.session import checkpoint_dir, release

#: Odd base of the digests' polynomial, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Digests held in a task before they go back to the JVM, about.
BATCH_ROWS = 1 << 18
#: Words whose chunks are sought at once, about.
BATCH_WORDS = 1 << 16

_WORD = re.compile(r"\S+")


def digests(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of the words of each span, as signed 64-bit numbers."""
    powers, back = (np.cumprod(np.full(len(h) + 1, x, dtype="u8")) for x in (BASE, INVERSE))
    sums = np.zeros(len(h) + 1, dtype="u8")
    np.cumsum(h * powers[:-1], out=sums[1:])
    d = (sums[end] - sums[begin]) * back[begin] + (end - begin).astype("u8")
    d = (d ^ (d >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (d ^ (d >> np.uint64(32))).view("i8")


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype="u8", count=len(words))


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A digest of every ``n`` consecutive words."""
    at = np.arange(max(0, len(h) - n + 1))
    return digests(h, at, at + n)


def gear_hashes(h: np.ndarray, gear: int) -> np.ndarray:
    """The gear hash at the end of every ``gear`` consecutive words: each word shifts the older
    ones, until they leave the 64 bits."""
    n, shift = max(0, len(h) - gear + 1), -(-64 // gear)
    g = np.zeros(n, dtype="u8")
    for k in range(gear):
        g = (g << np.uint64(shift)) + h[k : k + n]
    return g


def cuts(h: np.ndarray, gear: int, reach: int) -> np.ndarray:
    """For every ``reach`` consecutive places of the gear hash, the last of its least ones."""
    g = gear_hashes(h, gear)
    n = max(0, len(g) - reach + 1)
    least, at = g[:n].copy(), np.zeros(n, dtype="i8")
    for j in range(1, reach):
        at[g[j : j + n] <= least] = j
        np.minimum(least, g[j : j + n], out=least)
    return at + np.arange(n)


def standing(h: np.ndarray, min_words: int, gear: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest and first word of every chunk; for every run of ``min_words`` words, the chunk
    that stands for it: of its chunks, the last with the least digest."""
    at = cuts(h, gear, reach)
    n = max(0, len(h) - min_words + 1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]  # cuts never move back
    ends, nth = at[new], np.cumsum(new) - 1
    d = digests(h, ends[:-1], ends[1:] + gear)
    first, last = nth[:n], nth[min_words - gear + 1 - reach :][:n]  # cuts at the run's borders
    u, best = d.view("u8"), first.copy()
    for j in range(1, int((last - first).max(initial=1))):
        more = np.flatnonzero(first + j < last)
        more = more[u[first[more] + j] <= u[best[more]]]
        best[more] = first[more] + j
    return d, ends[:-1], best


def texts_of(docs: DataFrame) -> DataFrame:
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.where("doc_id is not null and text is not null")


def all_chunks(docs: DataFrame, min_words: int, gear: int, reach: int) -> DataFrame:
    """doc_id, digest (each of a document's standing chunks once), again (whether it also stands
    ``min_words`` words or more further down)."""
    names = ["doc_id", "digest", "again"]

    def batch(ids: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
        h, of = np.concatenate(hashes), np.repeat(np.arange(len(ids)), [len(x) for x in hashes])
        d, starts, best = standing(h, min_words, gear, reach)
        best = best[of[: len(best)] == of[min_words - 1 :]]  # runs within one text
        kept = np.zeros(len(d), dtype=bool)
        kept[best] = True
        at, d = starts[kept], d[kept]
        order = np.lexsort((at, d, of[at]))
        at, d = at[order], d[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (of[at[1:]] != of[at[:-1]]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        again = at[last] - at[first] >= min_words
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype="i8")[of[at[first]]]), pa.array(d[first]), pa.array(again)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, words = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = word_hashes(text.as_py().split())
                if len(h) >= min_words:
                    ids.append(doc_id)
                    hashes.append(h)
                    words += len(h)
                if words >= BATCH_WORDS:
                    yield batch(ids, hashes)
                    ids, hashes, words = [], [], 0
        if words:
            yield batch(ids, hashes)

    return texts_of(docs).mapInArrow(run, "doc_id long, digest long, again boolean")


def repeated_chunks(docs: DataFrame, min_words: int, gear: int, reach: int) -> DataFrame:
    """doc_id, _chunks (its chunks that several documents have), _again (whether the document
    may repeat itself)."""
    found = all_chunks(docs, min_words, gear, reach)
    counted = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("again").alias("any"))
    counted = counted.where("first < last or any").select("digest", (F.col("first") < F.col("last")).alias("shared"))
    marked = found.join(counted, "digest").where("shared or again")
    shared = F.collect_list(F.when(F.col("shared"), F.col("digest")))
    return marked.groupBy("doc_id").agg(shared.alias("_chunks"), F.max("again").alias("_again"))


def shared_runs(docs: DataFrame, marks: DataFrame, min_words: int, gear: int, reach: int) -> DataFrame:
    """doc_id, digest of each of its runs of ``min_words`` words that a shared chunk stands for."""
    names = ["doc_id", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, rows = [], [], 0

        def batch() -> pa.RecordBatch:
            of = np.repeat(np.array(ids, dtype="i8"), [len(x) for x in found])
            return pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(found))], names)

        for b in batches:
            for doc_id, text, shared in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                h = word_hashes(text.as_py().split())
                d, _, best = standing(h, min_words, gear, reach)
                near = np.isin(d, shared.values.to_numpy())[best]
                if near.any():
                    ids.append(doc_id)
                    found.append(np.unique(runs_of(h, min_words)[near]))
                    rows += len(found[-1])
                if rows >= BATCH_ROWS:
                    yield batch()
                    ids, found, rows = [], [], 0
        if rows:
            yield batch()

    shared = marks.where(F.size("_chunks") > 0).select(F.col("doc_id").alias("_id"), "_chunks")
    joined = texts_of(docs).join(shared, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_chunks")
    return joined.mapInArrow(run, "doc_id long, digest long")


def repeats(docs: DataFrame, min_words: int, gear: int, reach: int) -> DataFrame:
    """doc_id and _repeats, the digests of its runs that a document of smaller doc_id has;
    an empty array for documents that may only repeat themselves."""
    marks = repeated_chunks(docs, min_words, gear, reach).checkpoint()
    release(docs.sparkSession)
    runs = shared_runs(docs, marks, min_words, gear, reach).checkpoint()
    release(docs.sparkSession)
    originals = (
        runs.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("digest", "first")
    )
    later = runs.join(originals, "digest").where("doc_id > first").select("doc_id", "digest")
    own = marks.where("_again").select("doc_id", F.lit(None).cast("long").alias("digest"))
    return later.unionByName(own).groupBy("doc_id").agg(F.collect_set("digest").alias("_repeats"))


def stood_before(g: np.ndarray, min_words: int) -> np.ndarray:
    """Whether each run has an earlier occurrence in its own text; occurrences of a run that
    overlap count as one."""
    order = np.argsort(g, kind="stable")
    same = np.zeros(len(g), dtype=bool)
    same[1:] = g[order[1:]] == g[order[:-1]]
    apart = same.copy()
    apart[1:] &= np.diff(order) >= min_words
    count = np.cumsum(apart)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
    out = np.zeros(len(g), dtype=bool)
    out[order] = count > count[start]
    return out


def passages(text: str, repeated: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """The (start, end) in characters of the passages of ``text`` to be removed."""
    at = [m.span() for m in _WORD.finditer(text)]
    g = runs_of(word_hashes([text[a:b] for a, b in at]), min_words)
    gone = np.flatnonzero(np.isin(g, repeated) | stood_before(g, min_words))
    step = np.zeros(len(at) + 1, dtype="i8")
    np.add.at(step, gone, 1)
    np.add.at(step, gone + min_words, -1)
    covered = np.cumsum(step) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype("i1")])))
    return [(at[a][0], at[b][0] if b < len(at) else len(text)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def remove_repeats(docs: DataFrame, min_words: int = 20, gear: int = 6, reach: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated passages cut from the text, and two more
    columns: spans (start and end of each cut in the text as it was) and n_removed
    (characters)."""
    if gear - 1 + 2 * reach > min_words:
        raise ValueError("a run of min_words words must hold two cuts: gear - 1 + 2 * reach <= min_words")
    checkpoint_dir(docs.sparkSession)
    marks = repeats(docs.select("doc_id", "text"), min_words, gear, reach).checkpoint()
    release(docs.sparkSession)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(text: pd.Series, repeated: pd.Series) -> pd.Series:
        def one(t: str | None, r) -> list | None:
            if t is None or r is None:
                return None
            cut = passages(t, np.asarray(r, dtype="i8"), min_words)
            return [{"start": a, "end": b} for a, b in cut]

        return pd.Series([one(t, r) for t, r in zip(text, repeated, strict=True)], dtype=object)

    repeated, key, cut = (unused(docs, c) for c in ("_repeats", "_id", "_cut"))
    marks = marks.select(F.col("doc_id").alias(key), F.col("_repeats").alias(repeated))
    joined = docs.join(marks, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    text = F.col("text").cast("string")
    # Only texts with a repeated window go to Python.
    found = joined.withColumn(cut, spans.asNondeterministic()(F.when(F.col(repeated).isNotNull(), text), repeated))
    found = found.withColumn(cut, F.coalesce(cut, F.array().cast("array<struct<start:int,end:int>>")))
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["end"]))
    ends = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.length(text)))
    parts = F.zip_with(begins, ends, lambda a, b: text.substr(a + 1, b - a))
    left = F.when(F.size(cut) > 0, F.array_join(parts, "")).otherwise(text)
    kept = [c for c in docs.columns if c.lower() not in ("spans", "n_removed")]
    return found.select(
        *[left.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
        F.col(cut).alias("spans"),
        F.aggregate(cut, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
    )
