"""Alignment of two tokenizers' tokens over the same texts, by galloping intersection.

1. Each text, with a space before it, becomes two lists of byte offsets at which tokens end:
   that of a byte-level BPE vocabulary (A, whose words ``pattern`` splits) and that of a
   sentencepiece model (B, which adds the space itself).
2. The shorter list drives: each of its ends starts from its proportional place in the longer
   list, doubles its step until the place lies between two probes, and halves the rest. All
   ends of a batch of texts gallop at once in numpy.
3. Ends that occur in both lists cut the tokens into groups. The places found for two
   successive ends of the shorter list bound the tokens of the longer one that overlap the
   token between them, so the links follow from differences of ranks.
4. Every text's different id pairs are written once with their number of times. Spark counts
   for each pair the texts that hold it, marks the pairs whose count is their A id's highest,
   and looks the pairs up again to score the links. The ``MAX_BROADCAST_ROWS`` most frequent
   pairs, at most, are broadcast; if there are more, the rest is joined by a shuffle, in which
   no pair is frequent.

Defined cases: null and empty texts, and texts whose tokens of either kind do not join to the
text's own bytes (the sign U+2581, which B takes for a space), have no tokens: zeros, an empty
digest, no pairs. Every row is a document of its own, also where doc_ids repeat or are null.
Special tokens' strings are plain text. Texts of over ``SEGMENT`` characters are worked on
piece by piece, cut at a single space between other characters, where both tokenizers start a
new token, so memory is bounded but for a single word's. An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.session import scratch_path

#: Texts of these characters alone (Latin letters and punctuation) are split into words alike by
#: all libraries, whatever their version of Unicode.
COMMON = re.compile("[\\0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: A space between other characters; neither tokenizer's tokens reach over its left side.
SEAM = re.compile(r"[^\s▁] (?=[^\s▁])")
#: Characters of text that are aligned at once, about.
SEGMENT = 1 << 19
#: Rows of the pair table that are broadcast, at most (two longs each).
MAX_BROADCAST_ROWS = 1_500_000
#: Bits of an id in a pair.
ID_BITS = 20

NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
TYPES = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    ones for themselves, the others by characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Both tokenizers and the bytes of their tokens. ``tiktoken`` reads the byte-level
    vocabulary (an id is its token's merge rank) several times faster than ``tokenizers``; texts
    with other characters than ``COMMON`` go to the latter, whose tables of letters count."""

    def __init__(self, bpe_path: str, piece_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(bpe_path)
        self.library.encode_special_tokens = True
        with open(bpe_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        code = byte_alphabet()
        ranks = {bytes(code[c] for c in t): i for t, i in vocabulary.items() if all(c in code for c in t)}
        special = {t for t in self.library.get_added_tokens_decoder()}
        ranks = {t: i for t, i in ranks.items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.a_bytes = np.full(max(vocabulary.values()) + 1, b"", dtype=object)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = np.full(size, b"", dtype=object)
        for i, piece in enumerate(pieces):
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # Texts can be cut at spaces if no piece reaches over one.
        identity = b"\x0a\x08identity" in self.b.serialized_model_proto()
        self.by_word = identity and not any("▁" in p.lstrip("▁") for p in pieces)
        self.labels = np.array([f"{i}{end}" for i in range(max(size, len(self.a_bytes))) for end in ",|;"], dtype=object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both kinds; None if they don't join to the text with a space before it."""
        spaced = " " + text
        if COMMON.fullmatch(spaced):
            a = self.a.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64)
        else:
            a = np.array(self.library.encode(spaced, add_special_tokens=False).ids, dtype=np.int64)
        b, raw = np.array(self.b.encode(text), dtype=np.int64), spaced.encode()
        same = b"".join(self.a_bytes[a].tolist()) == raw == b"".join(self.b_bytes[b].tolist())
        return (a, b) if same else None

    def segments(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """``ids`` of the text in pieces of ``SEGMENT`` characters or more, cut before a single
        space between other characters."""
        begin = 0
        while self.by_word and len(text) - begin > SEGMENT and (seam := SEAM.search(text, begin + SEGMENT)):
            yield self.ids(text[begin : seam.start() + 1])
            begin = seam.start() + 2
        yield self.ids(text[begin:])


@lru_cache(maxsize=2)
def tokenizer_pair(bpe_path: str, piece_path: str, pattern: str) -> Pair:
    return Pair(bpe_path, piece_path, pattern)


def gallop(targets: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of the ascending ``targets`` the first place in the ascending ``ends`` that is
    not below it: exponential steps from ``start``, then binary search."""
    top = len(ends) - 1
    below = ends[start] < targets
    lo, hi = np.where(below, start + 1, 0), np.where(below, top, start)
    going, step = np.flatnonzero(below), 1
    while going.size:  # up, while the probe is below the target
        probe = np.minimum(start[going] + step, top)
        on = ends[probe] < targets[going]
        hi[going[~on]] = probe[~on]
        lo[going[on]] = probe[on] + 1
        going, step = going[on], 2 * step
    going, step = np.flatnonzero(~below), 1
    while going.size:  # down, while the probe is not below the target
        probe = start[going] - step
        going, probe = going[probe >= 0], probe[probe >= 0]
        on = ends[probe] >= targets[going]
        lo[going[~on]] = probe[~on] + 1
        hi[going[on]] = probe[on]
        going, step = going[on], 2 * step
    going = np.flatnonzero(lo < hi)
    while going.size:
        middle = (lo[going] + hi[going]) >> 1
        on = ends[middle] >= targets[going]
        hi[going[on]] = middle[on]
        lo[going[~on]] = middle[~on] + 1
        going = going[lo[going] < hi[going]]
    return lo


def overlaps(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, common, place): for each token of the list of ends ``short`` the first token
    of ``long`` that it overlaps and how many; whether both end there; the place found."""
    place = gallop(short, long, start)
    common = long[place] == short
    first = np.concatenate([[0], (place + common)[:-1]]).astype(np.int64)
    return first, place - first + 1, common, place


def aligned_batch(texts: list[tuple[np.ndarray, np.ndarray]], pair: Pair) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """n_a, n_b, n_groups, n_links, the groups as text, pairs and times for each of the texts
    (ids of both kinds), of which one tokenizer has the shorter list throughout."""
    sizes = np.array([(len(a), len(b)) for a, b in texts], dtype=np.int64)
    ids = [np.concatenate([t[k] for t in texts]) for k in (0, 1)]
    ends = [np.cumsum(pair.a_size[ids[0]]), np.cumsum(pair.b_size[ids[1]])]
    offsets = np.vstack([[0, 0], np.cumsum(sizes, axis=0)])
    s, l = (0, 1) if sizes[:, 0].sum() <= sizes[:, 1].sum() else (1, 0)  # noqa: E741
    text_of = np.repeat(np.arange(len(texts)), sizes[:, s])
    within = np.arange(len(ids[s])) - offsets[text_of, s]
    start = offsets[text_of, l] + within * sizes[text_of, l] // sizes[text_of, s]
    first, n, common, place = overlaps(ends[s], ends[l], start)

    driver = np.repeat(np.arange(len(n)), n)
    other = np.arange(len(driver)) + np.repeat(first - (np.cumsum(n) - n), n)
    linked = (driver, other) if s == 0 else (other, driver)
    code = (ids[0][linked[0]] << ID_BITS) | ids[1][linked[1]]
    text_code, times = np.unique((text_of[driver] << 2 * ID_BITS) | code, return_counts=True)
    cuts = np.searchsorted(text_code >> 2 * ID_BITS, np.arange(len(texts) + 1))
    pairs = text_code & ((1 << 2 * ID_BITS) - 1)

    ending = [common, np.zeros(len(ids[l]), dtype=bool)]
    ending[1][place[common]] = True
    last_a, last_b = (ending[0], ending[1]) if s == 0 else (ending[1], ending[0])
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    # Before an A token stand the B tokens of earlier groups, before a B token the A tokens of
    # its own group too.
    b_before = np.concatenate([[0], np.flatnonzero(last_b) + 1])
    a_before = np.flatnonzero(last_a) + 1
    label = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
    label[np.arange(len(ids[0])) + b_before[group_a]] = 3 * ids[0] + last_a
    label[np.arange(len(ids[1])) + a_before[group_b]] = 3 * ids[1] + 2 * last_b
    written = pair.labels[label].tolist()

    n_groups = np.bincount(text_of[common], minlength=len(texts))
    n_links = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
    both = offsets.sum(axis=1)
    for i in range(len(texts)):
        groups = "".join(written[both[i] : both[i + 1]])[:-1]
        at = slice(cuts[i], cuts[i + 1])
        yield int(sizes[i, 0]), int(sizes[i, 1]), int(n_groups[i]), int(n_links[i]), groups, pairs[at], times[at]


def aligned_text(segments: Iterator[tuple[np.ndarray, np.ndarray] | None], pair: Pair) -> tuple:
    """The result of a long text, segment by segment."""
    total, digest, pairs, times, sep = np.zeros(4, dtype=np.int64), sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), b""
    for ids in segments:
        if ids is None:
            return NOTHING
        *n, groups, p, t = next(aligned_batch([ids], pair))
        total += n
        digest.update(sep + groups.encode())
        sep = b";"
        pairs, where = np.unique(np.concatenate([pairs, p]), return_inverse=True)
        times = np.bincount(where, weights=np.concatenate([times, t]), minlength=len(pairs)).astype(np.int64)
    return (*total.tolist(), digest.hexdigest(), pairs, times)


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(docs: DataFrame, bpe_path: str, piece_path: str, pattern: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the different linked
    (A id << ID_BITS | B id) ``pairs`` with their ``times``, for each row of ``docs``."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(bpe_path, piece_path, pattern)
        out: list[list] = [[] for _ in NAMES]
        waiting: list[list] = [[], []]  # (row, doc_id, ids), by which list is shorter

        def add(row: int, doc_id: int | None, found: tuple) -> None:
            for column, v in zip(out, (row, doc_id, *found), strict=True):
                column.append(v)

        def flush() -> pa.RecordBatch:
            for texts in waiting:
                if texts:
                    found = aligned_batch([t[2] for t in texts], pair)
                    for (row, doc_id, _), (*n, groups, p, t) in zip(texts, found, strict=True):
                        add(row, doc_id, (*n, sha256(groups.encode()).hexdigest(), p, t))
                texts.clear()
            batch = pa.RecordBatch.from_arrays([column_of(c, t) for c, t in zip(out, TYPES, strict=True)], NAMES)
            for c in out:
                c.clear()
            return batch

        held = 0
        for b in batches:
            for row, doc_id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = value.as_py()
                held += len(text or "")
                if not text:
                    add(row, doc_id, NOTHING)
                elif len(text) > SEGMENT:
                    add(row, doc_id, aligned_text(pair.segments(text), pair))
                elif (ids := pair.ids(text)) is None:
                    add(row, doc_id, NOTHING)
                else:
                    waiting[len(ids[0]) > len(ids[1])].append((row, doc_id, ids))
                if held >= SEGMENT:
                    yield flush()
                    held = 0
        yield flush()

    columns = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return columns.mapInArrow(rows_of, SCHEMA)


def column_of(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(values) if values else np.zeros(0, np.int64))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (texts that hold it), best (n is the highest of the pair's A id)."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", ID_BITS))  # at most as many rows as B has ids
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_a))


def link_scores(
    docs: DataFrame, bpe_path: str, piece_path: str, pattern: str, max_broadcast_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is a best one of its A id),
    count_sum (of the pairs' counts over all links), groups_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-alignment")
    align(docs, bpe_path, piece_path, pattern).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    counts = pair_counts(aligned).checkpoint()
    # How often pairs occur, by powers of two: a few dozen rows.
    power = F.length(F.bin("n")) - 1
    histogram = {r["power"]: r["pairs"] for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    least, room = max(histogram, default=0) + 1, max_broadcast_rows
    while least > 0 and histogram.get(least - 1, 0) <= room:
        least -= 1
        room -= histogram.get(least, 0)

    links = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    scored = links.join(F.broadcast(counts.where(F.col("n") >= 2**least)), "pair", "left")
    if any(p < least for p in histogram):
        rare = counts.where(F.col("n") < 2**least)
        rest = scored.where(F.col("n").isNull()).select("row", "pair", "times").join(rare, "pair")
        scored = scored.where(F.col("n").isNotNull()).unionByName(rest.select(*scored.columns))
    times = F.col("times")
    sums = scored.groupBy("row").agg(
        F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
