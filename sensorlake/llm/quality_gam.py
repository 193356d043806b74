"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text's form are cut into quantile bins. Shallow trees are boosted on one
feature after the other, round by round, each adding to that feature's lookup table; then
the pairs of features that explain most of what is left get tables of their own in the same
way. A score is the sum of the table entries of a text's bins, through the logistic function.

The tables are fitted on at most ``n_sample`` labelled rows, chosen by a hash of the id.

Defined cases: a null text counts as empty, and an empty text has defined features, so both
get a score; without any label, or with one kind only, the score is the smoothed share of
label 1. Null and repeated ids are scored like any other row; repeated labels all count;
rows with a null label are not learnt from. Added columns replace columns of their own name
only; all others are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.columns import others, unused

FEATURES = [
    "log_chars", "log_words", "word_length", "long_words", "lower", "upper", "digit", "space", "mark", "symbol",
    "capital_words", "marked_words", "bare_words", "distinct_words", "top_word", "distinct_trigrams",
    "repeated_lines", "line_words",
]

# Kinds of characters: 0 other, 1 lower-case or caseless letter, 2 upper-case letter, 3 digit,
# 4 white space, 5 punctuation of prose, 6 another printable ASCII mark.
_KIND = np.zeros(0x10000, dtype="u1")
for _c in range(0xFFFF):
    _s = chr(_c)
    _KIND[_c] = (
        2 if _s.isupper() else 1 if _s.isalpha() else 3 if _s.isdigit() else 4 if _s.isspace()
        else 5 if _s in ".,;:'\"()-?" else 6 if 32 < _c < 127 else 0
    )


def text_features(text: str | None) -> list[float]:
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_KIND[np.minimum(c, 0xFFFF)], minlength=7) / max(1, len(c))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype="i8", count=len(words))
    counts = Counter(words)
    h = np.fromiter(map(hash, words), dtype="i8", count=len(words))
    grams = len(np.unique(h[:-2] * 3 + h[1:-1] * 5 + h[2:] * 7)) / (len(words) - 2) if len(words) > 2 else 1.0
    ends = Counter(w[-1] for w in words)
    marked = sum(v for k, v in ends.items() if not k.isalnum() and k not in ".,;:?")
    return [
        np.log1p(len(c)),
        np.log1p(len(words)),
        float(sizes.mean()) if len(words) else 0.0,
        float((sizes > 15).sum() / n),
        *kinds[1:7].tolist(),
        sum(map(str.isupper, words)) / n,
        marked / n,
        sum(v for w, v in counts.items() if not any(map(str.isalnum, w))) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        grams,
        1 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
    ]


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Different inner edges of up to ``bins`` quantile bins."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def split_gain(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """The best cut of ordered bins by their gradient and hessian sums: (gain, position)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = -np.inf
    if not len(gain) or not np.isfinite(gain.max()):
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 1.0) -> np.ndarray:
    """The values that a tree of ``depth`` over ordered bins gives to each bin."""
    gain, at = split_gain(g, h, least) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1, least), shallow_tree(g[at:], h[at:], depth - 1, least)])


def pair_tree(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """One cut along an axis, and one along the other on either side: (gain, values)."""
    best, out = 0.0, np.full(g.shape, -g.sum() / (h.sum() + 1))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gl, hl = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for cut in range(1, a.shape[0]):
            parts = [(gl[cut - 1], hl[cut - 1]), (gl[-1] - gl[cut - 1], hl[-1] - hl[cut - 1])]
            gain = sum(split_gain(p, q, least)[0] for p, q in parts)
            if gain > best:
                rows = [shallow_tree(p, q, 1, least) for p, q in parts]
                values = np.vstack([np.tile(rows[0], (cut, 1)), np.tile(rows[1], (a.shape[0] - cut, 1))])
                best, out = gain, values.T if turned else values
    return best, out


class QualityModel:
    """Base score, edges and table of each feature, and tables of pairs of features over
    coarser bins."""

    def __init__(self, base: float, edges: list, tables: list, coarse: list, pairs: dict) -> None:
        self.base, self.edges, self.tables, self.coarse, self.pairs = base, edges, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores (0 to 1) of the rows of ``x``, by additions over their bins."""
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in self.pairs.items():
            at = [np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (i, j)]
            z += t[at[0], at[1]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32, n_pairs: int = 6, coarse_bins: int = 8
) -> QualityModel:
    share = (y.sum() + 1) / (len(y) + 2)
    z, base = np.full(len(y), np.log(share / (1 - share))), float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(base, [], [], [], {})
    edges = [bin_edges(c, bins) for c in x.T]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    for _ in range(rounds):
        for j, rows in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            g = np.bincount(rows, p - y, len(tables[j]))
            h = np.bincount(rows, p * (1 - p), len(tables[j]))
            step = rate * shallow_tree(g, h, 2)
            tables[j] += step
            z += step[rows]
    coarse = [bin_edges(c, coarse_bins) for c in x.T]
    low = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T, strict=True)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell, p = low[i] * shape[1] + low[j], 1 / (1 + np.exp(-z))
        size = shape[0] * shape[1]
        g, h = np.bincount(cell, p - y, size), np.bincount(cell, p * (1 - p), size)
        return cell, g.reshape(shape), h.reshape(shape)

    gains = {ij: pair_tree(*sums(*ij)[1:])[0] for ij in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[:n_pairs]
    pairs = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen}
    for _ in range(rounds // 4):
        for ij in chosen:
            cell, g, h = sums(*ij)
            step = rate * pair_tree(g, h)[1]
            pairs[ij] += step
            z += step.ravel()[cell]
    return QualityModel(base, edges, tables, coarse, pairs)


def feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the features of each text."""

    @F.pandas_udf("array<double>")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts], dtype=object)

    return docs.select(*keep, count(F.col("text").cast("string")).alias("x"))


def train(docs: DataFrame, labels: DataFrame, n_sample: int = 8000) -> QualityModel:
    """A model from the texts of ``docs`` (doc_id, text) that have a row in ``labels``
    (doc_id, label 0 or 1). The sample is bounded twice: by ``n_sample`` rows of ``labels``, by a
    hash of the doc_id, and by ``4 * n_sample`` rows of documents joined with them, those of the
    least doc_ids, should ids be repeated so often."""
    chosen = (
        labels.select("doc_id", F.col("label").cast("double").alias("label"))
        .where("doc_id is not null and label is not null")
        .orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "label")
        .limit(n_sample)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = feature_rows(joined, ["doc_id", "label"]).orderBy("doc_id", "label").limit(4 * n_sample).toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["label"].to_numpy(dtype=float))


def rate(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold)."""

    @F.pandas_udf("double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = np.array([text_features(t) for t in s]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    found = unused(docs, "_found")
    rated = docs.withColumn(found, predict.asNondeterministic()(F.col("text").cast("string")))
    score = F.col(found)
    return rated.select(
        *others(docs, "score", "predicted"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )
