"""Near-duplicate groups by circulant MinHash and exact verification.

1. Each text becomes the set of its word shingles (64-bit hashes). Texts with equal sets
   form a class; from here on a class counts once.
2. Two random permutations of the hash range give the whole signature: one is applied to
   the shingles, the other, shifted by one place for each coordinate, gives the coordinate's
   order (C-MinHash). Bands of coordinates put classes that may be alike in buckets.
3. Links are confirmed on the full sets. First the least member of each bucket is compared
   with the others, and the linked ones form groups.
4. Where a bucket still holds members of different groups, its members go through an exact
   prefix filter: two sets at the threshold share one of their first shingles in any common
   order, and the order is by frequency, so these are the rare ones, not those of a large
   group of near copies. In each list of members with such a shingle the members of the
   smaller groups are compared with all members of other groups, until no list holds two
   groups. Before a pair becomes a row, an exact bitmap filter looks at it: every member carries
   the parities of its shingles in ``BITS`` classes, and two sets differ in at least as many
   shingles as their parities differ in. So no link between bucket members is lost, no pair
   within a group is emitted, hardly any pair that is no link, and a group of very many copies
   costs in proportion to its size.
5. Groups are connected components of the links.

Sets are told apart by 64-bit digests; among n different sets two are confused with a
probability of n^2 / 2^65.

With 32 bands of 4 rows a pair at the threshold 0.8 shares a bucket with a probability of
1 - 5e-8.

Defined cases: null texts and texts without words have no shingles and are linked with
nothing; a text of fewer words than a shingle has its whole sequence as one; rows without a
doc_id take no part and are kept, with a null component; repeated rows are copies of each
other; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sensorlake.llm.components import connected_components, tasks_for
from sensorlake.session import checkpoint_dir, release

#: Shingles worked on at once, for bounded memory with very long texts.
CHUNK = 4096
#: Members of smaller groups that are compared in each list at a time; doubled in every round.
CENTRES = 256
#: Parities that a member carries, a multiple of 64. Any number is right.
BITS = 256
#: Counters of shingle frequencies. They order the prefix filter; any order is right.
COUNTERS = 1 << 18


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted different hashes of the text's shingles of ``n`` words. A-Z is lower-cased;
    words are what stands between ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype="u8", count=len(words))
    if len(h) < n:
        whole = xxh3_64_intdigest(h.tobytes(), seed=len(h))
        return np.array([whole] if len(h) else [], dtype="u8")
    out = np.full(len(h) - n + 1, n, dtype="u8")
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the unsigned 32-bit numbers: every step can be undone."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least place that the second permutation,
    shifted by k, gives to the permuted shingles."""
    first = permuted((s >> np.uint64(32)).astype("u4"), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(coordinates, dtype="u4")[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, dtype="u4")
    for at in range(0, len(first), CHUNK):
        out = np.minimum(out, permuted(first[None, at : at + CHUNK] - shift, 0x85EBCA6B, 0xC2B2AE35).min(axis=1))
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` coordinates."""
    bands = sig.reshape(-1, rows).astype("u8")
    key = np.arange(len(bands), dtype="u8") + np.uint64(1)
    for i in range(rows):
        key = (key ^ bands[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view("i8")


def digest(s: np.ndarray) -> int | None:
    """A signed 64-bit digest of a set; None if it is empty."""
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).view("i8")) if len(s) else None


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), keys (one for each band), text_key
    (digest of the text)."""
    names = ["doc_id", "n_shingles", "node", "keys", "text_key"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, nodes, keys = [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                nodes.append(digest(s))
                keys.append(band_keys(signature(s, bands * rows), rows) if len(s) else None)
            columns = [b.column(0), *(pa.array(c, t) for c, t in zip((sizes, nodes, keys), types[1:], strict=True)), b.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names)

    text = F.col("text").cast("string")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return columns.mapInArrow(sign, "doc_id long, n_shingles long, node long, keys array<long>, text_key long")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """node and the full set of its text. Rows whose text has
    another digest (a repeated doc_id with another text) are left out, copies count once."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets = [], []
            for node, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), n)
                if digest(s) == node:
                    nodes.append(node)
                    sets.append(s.view("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    found = docs.select("node", "text").mapInArrow(to_sets, "node long, set array<long>")
    return found.dropDuplicates(["node"])


def links_among(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets reach the threshold."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    sizes = joined.select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), common.alias("common"))
    return sizes.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b")


def parities(s: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` classes of hashes one bit, whether the set holds an odd number of
    them, as signed 64-bit numbers."""
    odd = np.bincount((s >> np.uint64(20)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view("i8")


def parity_columns(prefix: str = "") -> list[str]:
    return [f"{prefix}bits{i}" for i in range(BITS // 64)]


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n (size of its set), and its first shingles (bucket) with their place from 0, in
    the order of their frequency among ``sets``, and the set's parities. The frequencies are
    counted by hash, in a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype="i8")
        for b in batches:
            values = b.column(0).flatten().to_numpy().view("u8")
            total += np.bincount((values >> np.uint64(40)) % np.uint64(COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    counted = sets.select("set").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(COUNTERS, dtype="i8")
    frequency[counted["k"].to_numpy(dtype="i8")] = counted["n"].to_numpy(dtype="i8")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for node, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = values.values.to_numpy().view("u8")
                # Beyond this place no set of a linked size can have its first common shingle.
                n, most = len(s), len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, frequency[(s >> np.uint64(40)) % np.uint64(COUNTERS)]))[:most]
                found = s[order].view("i8"), np.full(most, node), np.full(most, n), np.arange(most)
                found += tuple(np.full(most, x) for x in parities(s))
                for c, v in zip(columns, found, strict=True):
                    c.append(v)
            arrays = [pa.array(np.concatenate(c).astype("i8")) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["bucket", "node", "n", "place", *parity_columns()]
    return sets.select("node", "set").mapInArrow(first, ", ".join(f"{c} long" for c in names))


def link_groups(
    docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, by_text: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text); texts
    with 100 * intersection >= ``percent`` * union are linked. ``by_text``: also text_key and
    component (null without shingles), which tell apart different texts of one doc_id."""
    checkpoint_dir(docs.sparkSession)
    signed = signatures(docs, n, bands, rows).checkpoint()
    real = signed.where("node is not null and doc_id is not null")
    classes = real.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n")).checkpoint()
    filed = real.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    members = filed.join(shared.select("bucket", "centre"), "bucket").distinct().checkpoint()

    # The texts of one document of each class that shares a bucket, as sets.
    needed = members.select("node").distinct().join(classes, "node").select("node", "least")
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string").alias("text"))
    sets = full_sets(texts.join(needed, "least"), n).checkpoint()

    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    alike = 100 * small >= percent * large
    first = members.where("node <> centre").select("node", "centre", "n").distinct()
    sizes = classes.select(F.col("node").alias("centre"), F.col("n").alias("other_n"))
    pairs = first.join(sizes, "centre").where(alike).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = links_among(pairs, sets, percent).checkpoint()
    release(docs.sparkSession)
    groups = connected_components(links, "a", "b").checkpoint()
    release(docs.sparkSession)

    def open_ones(listed: DataFrame, tasks: int) -> DataFrame:
        """Members of the lists that hold several groups, with their group."""
        grouped = listed.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).coalesce(tasks)
        several = grouped.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        return grouped.join(several.select("bucket"), "bucket", "left_semi")

    listed = members.where("node <> centre").select("bucket", "node")
    tasks = tasks_for(members.count())
    unclear = open_ones(listed, tasks).select("node").distinct().coalesce(tasks).checkpoint()
    members = prefixes(sets.join(unclear, "node", "left_semi"), percent).checkpoint()
    release(docs.sparkSession)
    chosen = None
    # With at least this much in common, the first common shingle stands before either set's rest.
    least_common = F.ceil((F.col("n") + F.col("other_n")) * percent / (100 + percent) - 1e-9)
    near = (F.col("place") <= F.col("n") - least_common) & (F.col("other_place") <= F.col("other_n") - least_common)
    differing = [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(parity_columns(), parity_columns("other_"), strict=True)]
    near = near & (reduce(add, differing) <= F.col("n") + F.col("other_n") - 2 * least_common)
    centres = CENTRES
    tasks = tasks_for(members.count())
    while True:
        members = open_ones(members.select("bucket", "node", "n", "place", *parity_columns()), tasks)
        if chosen is not None:  # they have met all others of their lists
            met = chosen.select("bucket", F.col("other").alias("node"))
            members = members.join(met, ["bucket", "node"], "left_anti")
        members = members.checkpoint()
        left = members.count()
        if not left:
            break
        tasks = tasks_for(left)
        parts = members.groupBy("bucket", "component").agg(F.count("*").alias("part"))
        sized = members.join(parts, ["bucket", "component"]).coalesce(tasks)
        order = ["part", "component", "node"]
        ranked = sized.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
        chosen = ranked.where(F.col("r") <= centres).select(
            "bucket",
            F.col("node").alias("other"),
            F.col("n").alias("other_n"),
            F.col("place").alias("other_place"),
            F.col("component").alias("other_component"),
            F.col("part").alias("other_part"),
            *[F.col(c).alias("other_" + c) for c in parity_columns()],
        )
        chosen = chosen.coalesce(tasks).checkpoint()
        # A member that stands before the chosen one is chosen too and meets it from its side.
        behind = F.struct(*order) > F.struct("other_part", "other_component", "other")
        pairs = (
            sized.join(chosen, "bucket")
            .where((F.col("component") != F.col("other_component")) & behind & alike & near)
            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
            .coalesce(tasks)
            .distinct()
        )
        links = links.unionByName(links_among(pairs, sets, percent)).checkpoint()
        release(docs.sparkSession)
        groups = connected_components(links, "a", "b").checkpoint()
        release(docs.sparkSession)
        centres *= 2

    named = classes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(ids, "component").select("node", "component", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.join(of_node, "node", "left").select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
        *(["text_key", "component"] if by_text else []),
    )
