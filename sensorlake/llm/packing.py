"""Packing documents into sequences of a fixed length by cutting-stock column generation.

1. Each text is tokenised and cut into full pieces and a rest; a full piece is a sequence
   of its own. The rest is cut at its last multiple of ``grain`` tokens, so that few lengths
   occur and the linear program stays small; with grain 1 rests stay whole.
2. The pieces' lengths are counted over all documents. Their histogram, one number for each
   length up to the capacity, is all that reaches the driver.
3. A linear program over patterns (multisets of lengths that fit a sequence) minimises the
   number of sequences. Patterns are priced by a knapsack dynamic program over the duals
   until no pattern, or the bound on the gap, allows a better solution.
4. The solution is rounded down, patterns that still fit the open demand are used once
   more, and what is left (a few pieces for each length) is packed first-fit decreasing.
5. Documents are ranked within their length; the rank says which slot of which pattern a
   piece takes. Ranks are counted in hash buckets, so no length gathers in one task.

Defined cases: a null or empty text is the closing id alone; null and repeated doc_ids are
packed like any other row; an empty table gives an empty result; other columns are ignored,
whatever their names; ties of rank go by doc_id, start and payload, and equal rows are
interchangeable. Rows with the same values always get the same pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.session import checkpoint_dir

#: Words whose ids are remembered in a task, at most.
REMEMBERED = 400_000
#: Bytes of ids in one batch that goes back to the JVM, about.
BATCH_BYTES = 8 << 20
#: Rows in a hash bucket within which pieces of one length are ranked, about.
BUCKET_ROWS = 10_000


class ByteTokenizer:
    """Ids of texts under a byte-level BPE vocabulary, as little-endian unsigned 32-bit
    bytes. A text is split at single spaces between other characters: a space belongs to
    the word behind it, so the words' ids do not depend on each other, and are remembered."""

    def __init__(self, ranks_path: str, pattern: str, special: str, special_id: int) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special, self.special_id = special, np.uint32(special_id).tobytes()
        self.known: dict[str, bytes] = {}

    def slow(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.slow(word)
        return found

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        out, open_, known = [], first, self.known.get
        for piece in rest:
            # Another kind of white space, or none, at the seam: the split there is not safe.
            if not piece or piece[0].isspace() or not open_ or open_[-1].isspace():
                open_ += " " + piece
                continue
            out.append(known(open_) or self.word(open_) if len(open_) < 64 else self.slow(open_))
            open_ = " " + piece
        out.append(self.slow(open_))
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        """The ids; the special token's own string counts as that token."""
        return self.special_id.join(self.plain(part) if part else b"" for part in (text or "").split(self.special))


@lru_cache(maxsize=4)
def byte_tokenizer(ranks_path: str, pattern: str, special: str, special_id: int) -> ByteTokenizer:
    return ByteTokenizer(ranks_path, pattern, special, special_id)


def cuts(n: int, capacity: int, grain: int) -> list[int]:
    """Where a document of ``n`` ids is cut, with 0 and ``n``: after each full piece, and at
    the last multiple of ``grain`` of the rest."""
    at = [*range(0, n + 1, capacity)]
    rest = (n - at[-1]) // grain * grain
    return [*at, *([at[-1] + rest] if rest else []), *([n] if at[-1] + rest < n else [])]


def token_pieces(
    docs: DataFrame, tokenizer: tuple, capacity: int = 1024, end_id: int = 0, grain: int = 16
) -> DataFrame:
    """Each document's ids (its tokens, then ``end_id``) in pieces: doc_id, doc_tokens, start, length, ids (binary, unsigned 32-bit little-endian).
    ``tokenizer``: the arguments of ``ByteTokenizer``."""
    end = np.uint32(end_id).tobytes()
    names = ["doc_id", "doc_tokens", "start", "length", "ids"]
    types = [pa.int64()] * 4 + [pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(*tokenizer).ids
        out: list[list] = [[] for _ in names]
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                at = cuts(len(ids) // 4, capacity, grain)
                for begin, end_at in zip(at, at[1:], strict=False):
                    row = (doc_id, len(ids) // 4, begin, end_at - begin, ids[4 * begin : 4 * end_at])
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                    out, held = [[] for _ in names], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(cut, "doc_id long, doc_tokens long, start long, length long, ids binary")


def best_pattern(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest value, by dynamic programming over the room used."""
    total, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        total[room] = total[room - 1]
        if fits[room]:
            got = value[: fits[room]] + total[room - lengths[: fits[room]]]
            i = got.argmax()
            if got[i] > total[room] + 1e-12:
                total[room], last[room] = got[i], i
    pattern, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= lengths[last[room]]
    return total[capacity], pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in a solution of the linear program whose
    number of sequences is within ``gap`` of the least. Revised simplex, one priced column
    a step."""
    m = len(lengths)
    fill = capacity // lengths
    patterns, inverse = np.diag(fill.astype(float)), np.diag(1.0 / fill)
    used = demand / fill
    while True:
        dual = inverse.sum(axis=0)
        value, column = best_pattern(lengths, dual, capacity)
        if value <= 1 + 1e-9 or used.sum() * (1 - 1 / value) <= gap * used.sum():
            return patterns, used
        step = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(used, step, out=ratio, where=step > 1e-10)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return patterns, used
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        row = inverse[out] / step[out]
        step[out] = 0
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[out] = column


def cutting_stock(histogram: dict[int, int], capacity: int, gap: float = 0.001) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)...]) whose pieces are exactly those of ``histogram``."""
    lengths = np.array(sorted(x for x in histogram if 0 < x < capacity), dtype=int)
    demand = np.array([histogram[x] for x in lengths], dtype=float)
    out = [(histogram[capacity], [(capacity, 1)])] if histogram.get(capacity) else []
    if not len(lengths):
        return out
    patterns, used = column_generation(lengths, demand, capacity, gap)
    patterns = patterns.round().astype(int)
    left, times = demand.astype(int), np.floor(used + 1e-7).astype(int)
    for i in [*np.argsort(-times, kind="stable"), *np.argsort(np.floor(used) - used, kind="stable")]:
        some = patterns[i] > 0
        n = min(times[i], (left[some] // patterns[i][some]).min()) if times[i] else 0
        if n == 0 and (left >= patterns[i]).all():
            n = 1
        if n > 0:
            left -= n * patterns[i]
            times[i] = 0
            out.append((int(n), [(int(lengths[j]), int(patterns[i][j])) for j in np.flatnonzero(some)]))
    room, bins = np.zeros(0, dtype=int), []
    for j in reversed(range(len(lengths))):  # the open demand, largest first into the fullest bin it fits
        for _ in range(left[j]):
            fits = np.flatnonzero(room >= lengths[j])
            if fits.size:
                at = fits[room[fits].argmin()]
            else:
                room, at = np.append(room, capacity), len(room)
                bins.append({})
            room[at] -= lengths[j]
            bins[at][int(lengths[j])] = bins[at].get(int(lengths[j]), 0) + 1
    return out + [(1, sorted(b.items(), reverse=True)) for b in bins]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length its slots, as rows (first rank, copies in a sequence, first sequence,
    offset in the sequence), by first rank. Their number depends on the capacity alone."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for length, copies in pattern:
            out.setdefault(length, []).append((ranks.get(length, 0), copies, sequence, offset))
            ranks[length] = ranks.get(length, 0) + times * copies
            offset += copies * length
        sequence += times
    return {x: np.array(v, dtype="int64") for x, v in out.items()}


def pack(pieces: DataFrame, capacity: int = 1024, gap: float = 0.001) -> DataFrame:
    """Assigns pieces (doc_id, start, length and any payload) to sequences: adds
    sequence_id and offset. The pieces are written to the shared checkpoint folder first, as
    they are counted and then ranked."""
    spark = pieces.sparkSession
    checkpoint_dir(spark)
    payload = [c for c in pieces.columns if c not in ("doc_id", "start", "length")]
    pieces = pieces.checkpoint()
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = slots(cutting_stock(histogram, capacity, gap))
    buckets = -(-max(1, sum(histogram.values())) // BUCKET_ROWS)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", *payload)
    ranked = (
        bucketed.withColumn("rank", F.row_number().over(within) - 1)
        .join(first, ["length", "bucket"])
        .select("doc_id", "start", "length", *payload, (F.col("first") + F.col("rank")).alias("rank"))
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, offset = np.zeros(len(f), dtype="int64"), np.zeros(len(f), dtype="int64")
            lengths, ranks = f["length"].to_numpy(), f["rank"].to_numpy()
            for x in np.unique(lengths):
                rows = np.flatnonzero(lengths == x)
                s = where[int(x)]
                s = s[np.searchsorted(s[:, 0], ranks[rows], side="right") - 1]
                nth = ranks[rows] - s[:, 0]
                sequence[rows] = s[:, 2] + nth // s[:, 1]
                offset[rows] = s[:, 3] + nth % s[:, 1] * x
            yield f.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["doc_id", "start", "length", *payload])
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")

