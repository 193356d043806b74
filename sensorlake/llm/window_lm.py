"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token of a text from the two tokens before and the two
behind it; the score of a text is the sum of the log-probabilities of its tokens, each given
both sides. The context is tanh of a sum of embeddings, one table for each place of the
window. A token's probability is that of its class times that within its class (classes are
runs of words by frequency), so a prediction costs two small softmaxes and is normalised.

The vocabulary are the most frequent words over all documents, without regard to case; it
grows with the corpus, by the square root of the number of different words. Other words
share a token with those of their shape, and each of a shape's words (counted over all
documents) has an equal part of that token's probability. Training is data-parallel: in each round every task trains in
numpy on its part of the documents, from the common parameters on, and the results are
averaged by Spark, weighted by their tokens. Each document is in one round, so all of the
corpus is learnt from once. Documents may be encoded before, so that training and scoring
share their tokens.

Defined cases: null texts count as empty; a text without words has n_tokens 0, log_prob 0
and a null score; null and repeated ids are scored like any other row (rows without an id
are learnt from in the first round); empty tables give an empty result; texts are worked
through in blocks of bounded size, however long. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.session import checkpoint_dir

#: Classes of words, and words in each, at least. Token 0 stands for what is before and
#: behind a text.
CLASSES = MEMBERS = 32
#: Tokens for each square root of the number of different words.
GROWTH = 4
#: Tokens for words that are not in the vocabulary, by their shape.
SHAPES = 32
#: Places of the window, relative to the predicted token.
WINDOW = (-2, -1, 1, 2)
#: Tokens in a training step, and in a block of texts that is scored at once: they fit a
#: processor's cache.
STEP, BLOCK = 4096, 1 << 14
#: Rows of a softmax that are worked through at once, for the same reason.
TILE = 1024
#: Different words counted in a task before the counts go back to the JVM, and the numbers
#: in a row that carries a part of the parameters.
COUNTED, ROW = 200_000, 64


def classes_for(different: int) -> int:
    """Classes, and words in each, for a corpus of so many different words."""
    return max(CLASSES, math.ceil(math.sqrt(GROWTH * math.sqrt(different))))


def kind(word: str) -> int:
    """How many of a word's characters are no letters: 0, 1, more or all (3)."""
    if word.isalpha():
        return 0
    if word[:-1].isalpha():
        return 1
    marks = len(word) - sum(map(str.isalpha, word))
    return 3 if marks == len(word) else min(marks, 2)


def shape(word: str) -> int:
    """One of ``SHAPES`` shapes of a word, by its marks and digits and its length."""
    return kind(word) * 8 + min(7, (len(word) - 1) // 2)


class Vocabulary(dict):
    """Token of each word; a word that isn't in it gets the token of its shape. ``share`` is
    the log of each token's part that falls to one of its words."""

    def __init__(self, words: list[str], of_shape: dict[int, int], classes: int = CLASSES) -> None:
        super().__init__({w: 1 + SHAPES + i for i, w in enumerate(words)})
        self.classes = classes
        self.share = np.zeros(classes * classes)
        for k, n in of_shape.items():
            self.share[1 + k] = -np.log(max(1, n))

    def tokens(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        found = np.fromiter(map(self.get, words, repeat(0)), dtype="i4", count=len(words))
        at = np.flatnonzero(found == 0)
        other = [words[i] for i in at.tolist()]
        # As ``shape``, for all at once: most words are all letters.
        shapes = np.minimum(7, (np.fromiter(map(len, other), dtype="i4", count=len(other)) - 1) // 2)
        for i in [i for i, w in enumerate(other) if not w.isalpha()]:
            shapes[i] += kind(other[i]) * 8
        found[at] = 1 + shapes
        return found


class Network:
    """Parameters in one flat array: an embedding for each place of the window, side by side for
    each token, the bias of their sum, and the weights of the classes and of the words within
    each class, with their biases as the last row."""

    def __init__(self, hidden: int = 16, flat: np.ndarray | None = None, seed: int = 11, classes: int = CLASSES) -> None:
        n, places = classes, len(WINDOW)
        shapes = [(n * n, places * hidden), (hidden,), (hidden + 1, n), (n, hidden + 1, n)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.zeros(sum(sizes))
            drawn = np.random.default_rng(seed).normal(0, 0.1, (places, n * n, hidden))
            flat[: sizes[0]] = drawn.transpose(1, 0, 2).reshape(-1)
        self.hidden, self.classes, self.flat = hidden, classes, np.array(flat, dtype="f4")
        ends = np.cumsum([0, *sizes])
        parts = [self.flat[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes, strict=False)]
        self.embed, self.bias, self.wc, self.wm = parts
        self.touched: np.ndarray | slice = slice(None)
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """An array to be overwritten; its memory is kept from call to call."""
        if name not in self.rooms or self.rooms[name].size < rows * columns:
            self.rooms[name] = np.empty(rows * columns, dtype="f4")
        return self.rooms[name][: rows * columns].reshape(rows, columns)

    def context(self, t: np.ndarray) -> np.ndarray:
        """Hidden values for every token but the two at either end, and a 1 for the biases. The
        next call overwrites them."""
        rows, width = len(t) - 4, self.hidden
        h = self.room("context", rows, width + 1)
        h[:, width] = 1
        for a in range(0, rows, TILE):
            n = min(TILE, rows - a)
            near, z = self.room("near", n + 4, self.embed.shape[1]), self.room("sum", n, width)
            self.embed.take(t[a : a + n + 4], axis=0, out=near, mode="clip")
            z[:] = self.bias
            for i, at in enumerate(WINDOW):
                z += near[2 + at : 2 + at + n, i * width : (i + 1) * width]
            h[a : a + n, :width] = np.tanh(z, out=z)
        return h

    def by_class(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The order of the rows by class, ``h`` in that order, and where each class begins and ends."""
        order = np.argsort(c.astype("u2"), kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=self.classes))])
        return order, h.take(order, axis=0, out=self.room("sorted", *h.shape), mode="clip"), ends.tolist()

    def bounded(self) -> bool:
        """Whether sums of exponentials fit a float as they are (hidden values are at most 1)."""
        return max(np.abs(self.wc).sum(axis=0).max(), np.abs(self.wm).sum(axis=1).max()) < 80

    def log_probabilities(self, t: np.ndarray) -> np.ndarray:
        """Of every token but the two at either end, given its window."""
        if len(t) <= 4:
            return np.zeros(0, dtype="f4")
        t = t.astype(np.intp)
        h, (c, m), bounded = self.context(t), np.divmod(t[2:-2], self.classes), self.bounded()
        out, within = np.empty(len(h), dtype="f4"), np.empty(len(h), dtype="f4")
        for of, _ in tiles([0, len(h)]):
            z = np.dot(h[of], self.wc, out=self.room("z", of.stop - of.start, self.classes))
            out[of] = log_chosen(z, c[of], bounded)
        order, h, ends = self.by_class(h, c)
        m = m[order]
        for of, classes in tiles(ends):
            x, z = h[of], self.room("z", of.stop - of.start, self.classes)
            for k, rows in classes:
                np.dot(x[rows], self.wm[k], out=z[rows])
            within[of] = log_chosen(z, m[of], bounded)
        out[order] += within
        return out

    def gradient(self, t: np.ndarray, g: Network) -> None:
        """Writes the gradient of the mean log loss over the inner tokens into ``g``, and whose
        embeddings it touches: those of other tokens have none."""
        t = t.astype(np.intp)
        h, (c, m), bounded, width = self.context(t), np.divmod(t[2:-2], self.classes), self.bounded(), self.hidden
        dh, more = self.room("dh", len(h), width), self.room("more", len(h), width)
        d = np.dot(h, self.wc, out=self.room("z", len(h), self.classes))
        scale = less_chosen(d, c, bounded) / np.float32(len(h))
        np.dot(np.multiply(h, scale, out=self.room("sorted", *h.shape)).T, d, out=g.wc)
        np.dot(d, self.wc[:width].T, out=dh)
        dh *= scale
        order, by_class, ends = self.by_class(h, c)
        of = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
        for k, rows in of:
            np.dot(by_class[rows], self.wm[k], out=d[rows])
        scale = less_chosen(d, m[order], bounded) / np.float32(len(h))
        by_class *= scale
        g.wm[:] = 0
        for k, rows in of:
            np.dot(by_class[rows].T, d[rows], out=g.wm[k])
            np.dot(d[rows], self.wm[k, :width].T, out=more[rows])
        more *= scale
        dh[order] += more
        dh *= 1 - np.square(h[:, :width])
        g.bias[:] = dh.sum(axis=0)
        g.embed[g.touched] = 0
        g.touched = np.flatnonzero(np.bincount(t))
        number = np.empty(g.touched[-1] + 1, dtype=np.intp)
        number[g.touched] = np.arange(len(g.touched))
        cell = number[t][:, None] * width + np.arange(width)
        sums, weights = self.room("sums", len(g.touched), g.embed.shape[1]), dh.reshape(-1).astype("f8")
        for i, at in enumerate(WINDOW):
            of = cell[2 + at : 2 + at + len(dh)].reshape(-1)
            sums[:, i * width : (i + 1) * width] = np.bincount(of, weights, len(g.touched) * width).reshape(-1, width)
        g.embed[g.touched] = sums

    def descend(self, g: Network, squares: Network, rate: float) -> None:
        """A step against the gradient ``g``, each number's divided by the root of its
        ``squares`` so far. Embeddings that ``g`` does not touch stay as they are."""
        rest = slice(self.embed.size, None)
        for w, d, s, of in ((self.embed, g.embed, squares.embed, g.touched), (self.flat, g.flat, squares.flat, rest)):
            d, sums = d[of], s[of]
            sums += d * d
            w[of] -= rate * d / np.sqrt(sums)
            s[of] = sums


def tiles(ends: list[int]) -> Iterator[tuple[slice, list[tuple[int, slice]]]]:
    """Runs of at most ``TILE`` rows, each with its classes and their rows within the run, for
    rows ordered by class and the places where classes begin and end."""
    k = 0
    for a in range(0, ends[-1], TILE):
        b, classes = min(a + TILE, ends[-1]), []
        while k < len(ends) - 1 and ends[k] < b:
            if (first := max(a, ends[k])) < ends[k + 1]:
                classes.append((k, slice(first - a, min(b, ends[k + 1]) - a)))
            if ends[k + 1] > b:
                break
            k += 1
        yield slice(a, b), classes


def log_chosen(z: np.ndarray, chosen: np.ndarray, bounded: bool) -> np.ndarray:
    """The log of the softmax of each row at its chosen place; overwrites ``z``."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    of = z[np.arange(len(z)), chosen]
    return of - np.log(np.dot(np.exp(z, out=z), np.ones(z.shape[1], dtype="f4")))


def less_chosen(z: np.ndarray, chosen: np.ndarray, bounded: bool) -> np.ndarray:
    """Turns ``z`` into the softmax of each row, less 1 at its chosen place, but for a factor of
    the row that is returned."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    sums = np.dot(np.exp(z, out=z), np.ones((z.shape[1], 1), dtype="f4"))
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + chosen] -= sums[:, 0]
    return 1 / sums


def stream(texts: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """Runs of about ``size`` tokens of texts with their borders, overlapping by a window."""
    border, held, n = np.zeros(2, dtype="i4"), [np.zeros(2, dtype="i4")], 2
    for tokens in texts:
        held += [tokens, border]
        n += len(tokens) + 2
        if n >= size:
            run = np.concatenate(held)
            while len(run) >= size + 4:
                yield run[: size + 4]
                run = run[size:]
            held, n = [run], len(run)
    run = np.concatenate(held)
    if len(run) > 4:
        yield run


def vocabulary_of(docs: DataFrame) -> Vocabulary:
    """The most frequent words over all documents, ties by the word, and how many other words
    have each shape. Only these words and one row for each frequency reach the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for f in frames:
            for t in f["text"]:
                counts.update((t or "").lower().split())
                if len(counts) > COUNTED:
                    yield pd.DataFrame(counts.items(), columns=["word", "n"])
                    counts = Counter()
        yield pd.DataFrame(counts.items(), columns=["word", "n"]).astype({"word": object, "n": "int64"})

    @F.pandas_udf("int")
    def shape_of(words: pd.Series) -> pd.Series:
        return words.map(shape)

    checkpoint_dir(docs.sparkSession)
    words = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    shapes = dict(map(tuple, words.select(shape_of("word").alias("k")).groupBy("k").count().collect()))
    classes = classes_for(sum(shapes.values()))
    size, more, least = classes * classes - SHAPES - 1, 0, 0
    for n, k in sorted(map(tuple, words.groupBy("n").count().collect()), reverse=True):
        least = n
        if more + k > size:
            break
        more += k
    often = words.where(F.col("n") > least).collect()
    top = [r["word"] for r in sorted(often, key=lambda r: (-r["n"], r["word"]))]
    top += [r["word"] for r in words.where(F.col("n") == least).orderBy("word").limit(size - len(top)).collect()]
    for w in top:
        shapes[shape(w)] -= 1
    return Vocabulary(top, shapes, classes)


@dataclass(frozen=True)
class Encoded:
    """Documents as tokens of a vocabulary: rows of doc_id and tokens, as their bytes."""

    rows: DataFrame
    vocabulary: Vocabulary

    @property
    def type(self) -> str:
        return token_type(self.vocabulary)


def token_type(vocabulary: Vocabulary) -> str:
    return "u2" if vocabulary.classes <= 256 else "i4"


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> Encoded:
    """All of ``docs`` (doc_id, text) by the words' tokens."""
    kept = token_type(vocabulary)

    @F.pandas_udf("binary")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([vocabulary.tokens(t).astype(kept).tobytes() for t in texts], dtype=object)

    return Encoded(docs.select("doc_id", tokens(F.col("text").cast("string")).alias("tokens")), vocabulary)


def encode(docs: DataFrame) -> Encoded:
    """``docs`` (doc_id, text) by the tokens of their own vocabulary, stored: what trains on
    them and scores them splits no text again."""
    checkpoint_dir(docs.sparkSession)
    coded = encoded(docs, vocabulary_of(docs))
    return Encoded(coded.rows.checkpoint(), coded.vocabulary)


def train(docs: DataFrame | Encoded, rounds: int = 2, hidden: int = 16, rate: float = 0.15) -> tuple[Vocabulary, Network]:
    """Vocabulary and network from all of ``docs`` (doc_id, text, or encoded). The driver gets the
    vocabulary and the averaged parameters, whose sizes grow with the square root of the
    number of different words."""
    coded = docs if isinstance(docs, Encoded) else encode(docs)
    docs, vocabulary, kept = coded.rows, coded.vocabulary, coded.type
    classes = vocabulary.classes
    network = Network(hidden, classes=classes)
    size = len(network.flat)
    columns = [f"p{i}" for i in range(ROW)]
    # Every task sends all parameters once: no more tasks than keep the cores busy.
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    turn = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)), F.lit(0))
    for r in range(rounds):
        now = network.flat

        def learn(frames: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            net, g = Network(hidden, now, classes=classes), Network(hidden, classes=classes)
            squares, seen = Network(hidden, np.full(size, 1e-6), classes=classes), 0
            for t in stream((np.frombuffer(x, kept) for f in frames for x in f["tokens"]), STEP):
                net.gradient(t, g)
                net.descend(g, squares, rate)
                seen += len(t)
            if seen:
                rows = np.zeros((-(-size // ROW), ROW))
                rows.reshape(-1)[:size] = net.flat
                yield pd.DataFrame(rows * seen, columns=columns).assign(part=np.arange(len(rows)), seen=float(seen))

        schema = ", ".join(f"{c} double" for c in columns) + ", part long, seen double"
        trained = docs.where(turn == r).select("tokens").coalesce(tasks).mapInPandas(learn, schema)
        sums = trained.groupBy("part").agg(*[(F.sum(c) / F.sum("seen")).alias(c) for c in columns])
        rows = sums.toPandas().sort_values("part")
        if len(rows):
            network = Network(hidden, rows[columns].to_numpy().reshape(-1)[:size], classes=classes)
    return vocabulary, network


def score(docs: DataFrame | Encoded, vocabulary: Vocabulary, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum over the tokens), score (their mean), of ``docs``
    (doc_id, text, or encoded by that vocabulary)."""
    flat, hidden, classes = network.flat, network.hidden, network.classes
    coded = docs if isinstance(docs, Encoded) else encoded(docs, vocabulary)
    share, kept = vocabulary.share, coded.type

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, border = Network(hidden, flat, classes=classes), np.zeros(2, dtype="i4")
        for f in frames:
            n, sums = np.zeros(len(f), dtype="i8"), np.zeros(len(f))
            held: list[np.ndarray] = [border]
            of: list[np.ndarray] = []

            def settle() -> None:
                t, row = np.concatenate(held), np.concatenate(of)
                for at in range(0, len(row), BLOCK):
                    rows = row[at : at + BLOCK]
                    p = net.log_probabilities(t[at : at + len(rows) + 4])
                    real = rows >= 0
                    sums[:] += np.bincount(rows[real], p[real], len(sums))

            size = 0
            for i, t in enumerate(f["tokens"]):
                tokens = np.frombuffer(t, kept)
                n[i], sums[i] = len(tokens), share[tokens].sum()
                if len(tokens):
                    held += [tokens, border]
                    of += [np.full(len(tokens), i), np.full(2, -1)]
                    size += len(tokens)
                if size >= BLOCK:
                    of[-1] = of[-1][:0]
                    settle()
                    held, of, size = [border], [], 0
            if of:
                of[-1] = of[-1][:0]
                settle()
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n_tokens": n, "log_prob": sums})

    columns = coded.rows.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens")
    found = columns.mapInPandas(run, "doc_id long, n_tokens long, log_prob double")
    return found.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
