"""Language identification: sparse multinomial logistic regression on TF-IDF weighted
character n-grams, trained with follow-the-regularised-leader and an elastic-net penalty,
then calibrated by a temperature.

Document frequencies are counted over all documents that may be learnt from. The weights
are fitted on a bounded sample of them, equally many of each language (``per_lang``, and
``n_sample`` in all), chosen by a hash of the id.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; so does every
text if there is nothing to learn from. Null and repeated ids are predicted like any other
row; a row with a null id or language is not learnt from. Letters are lower-cased, anything
else counts as a gap between words; the whole text counts, however long. Added columns
replace columns of their own name only; all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.llm.columns import others, unused

#: Hash buckets of character n-grams.
BUCKETS = 1 << 14
UND = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0xFFFF)] + [True])
# Odd constants that mix the characters of an n-gram.
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of the text's letters and gaps, and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(_LETTER[np.minimum(c, 0xFFFF)], c, np.uint32(32)).astype("u4")
    gap = c == 32
    c = np.concatenate([[np.uint32(32)], c[~(gap & np.roll(gap, 1))], [np.uint32(32)]]).astype("u4")
    grams = []
    for n in (1, 2, 3):
        h = np.full(max(0, len(c) - n + 1), n, dtype="u4")
        for i in range(n):
            h = (h ^ c[i : i + len(h)]) * _MIX[i]
            h ^= h >> np.uint32(15)
        grams.append(h & np.uint32(BUCKETS - 1))
    counts = np.bincount(np.concatenate(grams), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = ngrams(text)
    x = (1 + np.log(counts)) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts. Each task sends one
    row a bucket; the driver gets ``BUCKETS`` numbers."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, dtype="int64"), 0
        for f in frames:
            for t in f["t"]:
                total[ngrams(t)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    counted = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(count, "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1, dtype="int64")
    for r in rows:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def balanced_sample(docs: DataFrame, lang: str, key: str, per_lang: int, n_sample: int) -> DataFrame:
    """At most ``per_lang`` rows of each language and ``n_sample`` in all, by a hash of the
    key. A threshold on the hash, from the languages' counts, leaves about four times as
    many rows before the ranking, so a frequent language does not gather in one task."""
    h = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40))
    counts = docs.groupBy(lang).agg(F.count("*").alias("_of"))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.col("_of"))
    near = (
        docs.join(counts, lang)
        .withColumn("_h", h)
        .where((F.col("_of") <= 4 * per_lang) | (F.col("_h") < share * float(1 << 40)))
    )
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(lang).orderBy("_h", key)))
    return ranked.where(F.col("_r") <= per_lang).orderBy("_r", "_h", key).limit(n_sample).drop("_h", "_r", "_of")


class LanguageModel:
    """Weights by bucket and language, and the temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def logits(self, text: str) -> np.ndarray:
        at, x = features(text, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        # [^\W\d_] finds a letter or another numeric character; the latter are checked below.
        if not self.langs or not text or not any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text)):
            return UND, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    seed: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate follow-the-regularised-leader: the weight of a
    coordinate is zero until its summed gradients exceed ``l1``, and shrunk by ``l2``."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weight(at) -> np.ndarray:
        za, na = z[at], n[at]
        w = (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2)
        return np.where(np.abs(za) > l1, w, 0.0)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last coordinate is the bias
            w = weight(at)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g[None]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(slice(None))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its logarithm. One label
    in n + 2 counts as unknown, so that a sample without an error doesn't make a model sure
    of everything."""
    unknown = 1 / (len(y) + 2)

    def loss(log_t: float) -> float:
        log_p = np.log(softmax(logits / np.exp(log_t)) + 1e-12)
        return -((1 - unknown) * log_p[np.arange(len(y)), y] + unknown * log_p.mean(axis=1)).mean()

    lo, hi, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(
    docs: DataFrame, may_learn: Column, per_lang: int = 1000, n_sample: int = 4000, key: str = "doc_id"
) -> LanguageModel:
    """A model from the rows of ``docs`` (text, lang and the key) where ``may_learn`` holds."""
    learn = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key, "text", "lang")
    df, n = document_frequencies(learn, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = balanced_sample(learn, "lang", key, per_lang, n_sample).select("text", "lang").toPandas()
    langs = sorted(sample["lang"].unique().tolist())
    if not langs:
        return LanguageModel([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rows = [(*features(t, idf), langs.index(y)) for t, y in zip(sample["text"], sample["lang"], strict=True)]
    held = rows[::5] if len(rows) >= 50 else rows
    weights, bias = ftrl([r for i, r in enumerate(rows) if i % 5] or rows, len(langs))
    logits = np.stack([x @ weights[at] + bias for at, x, _ in held])
    temperature = fit_temperature(logits, np.array([y for _, _, y in held])) if len(langs) > 1 else 1.0
    return LanguageModel(langs, idf.astype("f4"), weights.astype("f4"), bias, temperature)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang", "score"])

    found = unused(docs, "_found")
    predicted = docs.withColumn(found, predict.asNondeterministic()(F.col(text).cast("string")))
    return predicted.select(
        *others(docs, "lang_pred", "score"), F.col(found)["lang"].alias("lang_pred"), F.col(found)["score"].alias("score")
    )
