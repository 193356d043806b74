"""BPE encoding and decoding as streams with constant memory.

Encoding is a transducer with bounded lookahead. Merges are applied in the order of the
merge list, so what follows a symbol can change its token only through a chain of rules of
rising rank, each of whose right parts begins with the left part before it.
``Merges.lookahead`` is the length of the longest such chain: a token that ends that many
symbols before the end of what has been read is final. The transducer reads symbols into a
buffer, applies the merges, and emits the final tokens; the buffer stays bounded however
long a word is. Outputs for short words are remembered in a table of bounded size.

Decoding is a state machine that takes ids, gathers their bytes and gives out text as soon
as its last character is complete.

The vocabulary comes from a ``tokenizer.json`` of the public tokenizers library: BPE with
an end-of-word suffix over byte symbols, text normalised to NFC and lower case, words found
by a pattern, special tokens found in the raw text, no decoder (token strings joined by a
space).

Defined cases: a null or empty text has no ids and decodes to the empty string; null and
repeated doc_ids are encoded like any other row; an empty table gives an empty result;
other columns are ignored, whatever their names; the longest texts are read through the
same bounded buffer.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and runs of characters whose output is remembered in a task, at most; longer ones
#: than SHORT characters are not.
REMEMBERED, SHORT = 400_000, 48
#: Ids that the decoder takes at a time.
IDS_AT_ONCE = 4096
#: Bytes of output in one batch that goes back to the JVM, about.
BATCH_BYTES = 8 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: bytes
    that print in Latin-1 stand for themselves, the others are numbered from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list: ``rank[a, b]`` is the place of the rule that makes a + b. Every token but the single symbols
    must be made by exactly one rule, behind the rules of its parts."""

    def __init__(self, pairs: list[tuple[str, str]], suffix: str = "") -> None:
        self.rank = {p: i for i, p in enumerate(pairs)}
        made: dict[str, int] = {}
        for i, (a, b) in enumerate(pairs):
            if a + b in made or any(p not in made and len(p.removesuffix(suffix)) > 1 for p in (a, b)):
                raise ValueError(f"rule {i} of the merge list stands before its parts or repeats a token")
            made[a + b] = i
        self.suffix = suffix
        self.lookahead = self._lookahead(pairs)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """The most symbols behind which an unknown continuation can still change a token.
        At rank r the last certain token a may merge with an unknown b; then b begins with
        the token that became uncertain before, by a rule of lower rank."""
        longest: dict[str, int] = {"": 0}
        for a, b in pairs:
            b = b.removesuffix(self.suffix) if self.suffix else b
            before = max(longest.get(b[:n], 0) for n in range(len(b) + 1))
            longest[a] = max(longest.get(a, 0), len(a) + before)
        return max(longest.values()) + 1

    def apply(self, symbols: list[str]) -> list[str]:
        """The symbols with all merges applied: lowest rank first, then leftmost."""
        if len(symbols) > 64:
            return self._apply_long(symbols)
        none, rank = len(self.rank), self.rank.get
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
        return symbols

    def _apply_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs and linked neighbours, for long buffers."""
        tokens: list[str | None] = list(symbols)
        n = len(tokens)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else -1
            if j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((tokens[x], tokens[y]))) is not None:
                    heapq.heappush(heap, (r, x, (tokens[x], tokens[y])))
        return [t for t in tokens if t is not None]


class Encoder:
    """The transducer: ``push`` symbols, and a final ``end``; both give the tokens that have
    become final. Between calls it holds one symbol (the last one of a word carries the
    suffix) and at most ``window`` others."""

    def __init__(self, merges: Merges, window: int = 0) -> None:
        self.merges = merges
        #: Symbols held before the buffer is worked through.
        self.window = max(window, 4 * merges.lookahead)
        self.buffer: list[str] = []

    def push(self, symbols: Iterator[str]) -> Iterator[str]:
        for s in symbols:
            self.buffer.append(s)
            if len(self.buffer) > self.window:
                yield from self._settle()

    def _settle(self) -> Iterator[str]:
        held = self.buffer.pop()  # it may be the word's last one
        tokens, left = self.merges.apply(list(self.buffer)), len(self.buffer)
        final = 0
        for t in tokens:
            if left - len(t) < self.merges.lookahead:
                break
            left -= len(t)
            final += 1
            yield t
        self.buffer = [*self.buffer[len(self.buffer) - left :], held]

    def end(self) -> Iterator[str]:
        symbols, self.buffer = self.buffer, []
        if symbols:
            symbols[-1] += self.merges.suffix
            yield from self.merges.apply(symbols)


class Decoder:
    """Ids to text: each id's bytes, with ``between`` from one to the next; text comes out as
    soon as its bytes are complete. Bytes that are no UTF-8 become replacement characters."""

    def __init__(self, pieces: dict[int, bytes], between: bytes = b" ") -> None:
        self.pieces, self.between = pieces, between
        self.machine, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def push(self, ids: list[int]) -> str:
        data = self.between.join(map(self.pieces.__getitem__, ids))
        if self.begun and ids:
            data = self.between + data
        self.begun = self.begun or bool(ids)
        return self.machine.decode(data)

    def end(self) -> str:
        self.begun = False
        return self.machine.decode(b"", final=True)


class WordTokenizer:
    """The whole way from a text to ids, for vocabularies as described above."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        self.merges = Merges(pairs, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}
        strings = {i: t.encode() for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pieces = strings

    def normal(self, text: str) -> str:
        """NFC, then lower case of each character by itself."""
        if text.isascii():
            return text.lower()
        return "".join(map(str.lower, unicodedata.normalize("NFC", text)))

    def word(self, word: str) -> bytes:
        """The ids of one word, as little-endian unsigned 32-bit bytes."""
        symbols, encoder = self.symbols, Encoder(self.merges)
        ids = [self.vocab[t] for t in encoder.push(symbols[b] for b in word.encode("utf-8", "surrogatepass"))]
        ids += [self.vocab[t] for t in encoder.end()]
        return np.array(ids, dtype="<u4").tobytes()

    def run(self, text: str) -> bytes:
        """The ids of a run of text without special tokens."""
        out, known = [], self.known_words
        for m in self.words.finditer(self.normal(text)):
            w = m[0]
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """Words never cross white space, so the runs between spaces are independent."""
        out, known = [], self.known
        for part in text.replace("\n", " ").split(" "):
            ids = known.get(part)
            if ids is None:
                ids = self.run(part)
                if len(part) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        out, at = [], 0
        for m in self.specials.finditer(text or ""):
            out += [self.plain(text[at : m.start()]), np.uint32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain((text or "")[at:])])

    def text(self, ids: np.ndarray) -> str:
        decoder = Decoder(self.pieces)
        parts = [decoder.push(ids[at : at + IDS_AT_ONCE].tolist()) for at in range(0, len(ids), IDS_AT_ONCE)]
        return "".join([*parts, decoder.end()])


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (the text that the ids stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)

        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, ids)]) // 4
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            )
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists, pa.array(texts)], names)

        names = ["doc_id", "ids", "decoded"]
        doc_ids, ids, texts, held = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(tokenizer.ids(text.as_py()))
                texts.append(tokenizer.text(np.frombuffer(ids[-1], dtype="<u4")))
                held += len(ids[-1]) + len(texts[-1])
                if held >= BATCH_BYTES:
                    yield batch()
                    doc_ids, ids, texts, held = [], [], [], 0
        if doc_ids:
            yield batch()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
