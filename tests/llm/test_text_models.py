"""Language, quality and language-model scores: held-out accuracy and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import language_id, quality_gam, window_lm
from sensorlake.llm import queries as Q

from tests.conftest import SMOKE_DIR

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 456 !!"), (None, "the cat"), (5, "a " * 200_000), (5, "a " * 200_000), (6, "Ⅷ²½")]


def odd(spark):
    rows = [(i, t, "x", None, 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, lang_pred string, predicted int")


def test_languages_of_held_out_documents(spark):
    got = Q.op2_language_id(spark, SMOKE_DIR).toPandas()
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (both.lang_pred == both.lang)[both.held_out].mean() > 0.97


def test_held_out_rows_teach_nothing(spark, scratch):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    before = Q.op2_language_id(spark, SMOKE_DIR).orderBy("doc_id").collect()
    changed = docs.withColumn("lang", F.when(Q.remainder(3) == 1, F.lit("xx")).otherwise(F.col("lang")))
    changed.write.parquet(f"{scratch}/documents.parquet")
    after = Q.op2_language_id(spark, scratch).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_pred) for r in before] == [(r.doc_id, r.lang_pred) for r in after]


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    model = language_id.train(docs, F.lit(True))
    got = language_id.identify(odd(spark), model)
    assert got.columns == ["doc_id", "text", "predicted", "lang_pred", "score"]
    und = {r.doc_id for r in got.collect() if r.lang_pred == "und"}
    assert und == {1, 2, 3, 4, 6} and got.count() == len(ODD)
    nothing = language_id.train(docs.where("false"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd(spark), nothing).collect()} == {("und", 0.0)}


def test_language_pieces():
    assert language_id.fit_temperature(np.eye(3)[[0, 1, 2, 0]] * 9, np.array([0, 1, 2, 1])) > 1
    at, n = language_id.ngrams("A-a")
    assert n.sum() == 5 + 4 + 3  # gap a gap a gap
    rows = [(np.array([i % 2]), np.array([1.0]), i % 2) for i in range(40)]
    w, _ = language_id.ftrl(rows, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[2:].any()  # others stay zero


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = Q.op8_quality_gam(spark, d).toPandas()
    both = got.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (both.predicted == both.quality)[both.held_out].mean() > 0.97


def test_quality_edge_cases(spark):
    docs, none = odd(spark), spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(2, 1), (3, 1), (None, 0), (4, None), (2, 1)], "doc_id long, label int")
    for labels, score in ((none, 0.5), (one, 0.8)):
        got = quality_gam.rate(docs, quality_gam.train(docs, labels))
        assert got.columns == ["doc_id", "text", "lang_pred", "score", "predicted"]
        assert {round(r.score, 6) for r in got.collect()} == {score}
    assert quality_gam.rate(docs.where("false"), quality_gam.train(docs, one)).count() == 0
    assert all(np.isfinite(quality_gam.text_features(t)).all() for _, t in ODD)
    assert len(quality_gam.text_features("x y")) == len(quality_gam.FEATURES)


def test_gam_learns_a_step_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    for y in ((x[:, 0] > 0.3), (x[:, 0] > 0) ^ (x[:, 1] > 0)):
        m = quality_gam.fit(x[:3000], y[:3000].astype(float))
        assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93


def test_pseudo_likelihood_is_normalised_and_its_gradient_right():
    rng = np.random.default_rng(0)
    size = window_lm.CLASSES * window_lm.MEMBERS
    t = rng.integers(0, size, 40).astype("i2")
    net, g = window_lm.Network(8), window_lm.Network(8)
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    every = np.tile(t[:5], (size, 1))
    every[:, 2] = np.arange(size)
    assert sum(np.exp(net.log_probabilities(r)[0]) for r in every) == pytest.approx(1, abs=1e-4)
    net.gradient(t, g)
    for k in np.argsort(-abs(g.flat))[:30]:
        old, loss = net.flat[k], []
        for e in (1e-2, -1e-2):
            net.flat[k] = old + e
            loss.append(-net.log_probabilities(t).mean())
        net.flat[k] = old
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g.flat[k], abs=2e-3, rel=0.05)


def test_language_model_scores(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").select("doc_id", "text")
    vocabulary, net = window_lm.train(docs)
    got = {r.doc_id: r for r in window_lm.score(docs, vocabulary, net).collect()}
    for r in docs.limit(30).collect():  # one document by itself
        t = np.concatenate([[0, 0], vocabulary.tokens(r.text), [0, 0]]).astype("i2")
        want = net.log_probabilities(t).astype("f8").sum() + vocabulary.share[t].sum()
        assert got[r.doc_id].n_tokens == len(r.text.split())
        assert got[r.doc_id].log_prob == pytest.approx(want, rel=1e-3)
    plain = [r for r in docs.collect() if len(r.text.split()) > 60]
    mixed = [(r.doc_id, " ".join(np.random.default_rng(1).permutation(r.text.split()))) for r in plain]
    after = {r.doc_id: r.score for r in window_lm.score(spark.createDataFrame(mixed, "doc_id long, text string"), vocabulary, net).collect()}
    assert np.mean([got[r.doc_id].score > after[r.doc_id] for r in plain]) > 0.8


def test_vocabulary_grows_with_the_corpus(spark):
    words = [f"{'abcdefghij'[i % 10]}{i:07d}" for i in range(160_000)]
    often = ["x" + "".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(1300)]
    rows = [(k, " ".join([*words[k::40], *often])) for k in range(40)]
    small, large = (window_lm.vocabulary_of(spark.createDataFrame(r, "doc_id long, text string")) for r in (rows[:1], rows))
    assert len(large.share) > len(small.share) >= 1024
    assert len(set(large.tokens(" ".join(often)).tolist())) == len(often)  # told apart, though all of one shape
    assert set(large.tokens("xzzzz xyyyy").tolist()) == {1 + window_lm.shape("xzzzz")}
    assert window_lm.classes_for(10**8) ** 2 > 5 * window_lm.classes_for(10**6) ** 2


def test_language_model_edge_cases(spark):
    docs = odd(spark)
    got = window_lm.score(docs, *window_lm.train(docs)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.score is None) == (r.n_tokens == 0) and (r.n_tokens > 0 or r.log_prob == 0)
    empty = docs.where("false")
    assert window_lm.score(empty, *window_lm.train(empty)).count() == 0


def test_stored_tokens_score_like_texts_and_no_text_is_split_again(spark):
    docs = odd(spark)
    coded = window_lm.encode(docs)
    vocabulary, net = window_lm.train(coded)
    assert vocabulary is coded.vocabulary
    scored = window_lm.score(coded, vocabulary, net)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "text" not in plan
    assert "ArrowEvalPython" in window_lm.score(docs, vocabulary, net)._jdf.queryExecution().executedPlan().toString()
    assert sorted(scored.collect(), key=str) == sorted(window_lm.score(docs, vocabulary, net).collect(), key=str)
    words = "a b! !! c-d e-f-g 7 77 x7 ß é, \u0301a abcdefghijklmnopqrstuvw a.b. ,abc \u4e2d\u6587 ab123456789012345".split()
    assert [t - 1 for t in window_lm.Vocabulary([], {}).tokens(" ".join(words))] == list(map(window_lm.shape, words))


def test_steps_equal_those_over_all_parameters():
    rng = np.random.default_rng(2)
    size, near = window_lm.CLASSES * window_lm.MEMBERS, window_lm.WINDOW
    net, g = window_lm.Network(8), window_lm.Network(8)
    squares = window_lm.Network(8, np.full(len(net.flat), 1e-6))
    slow, sums = net.flat.astype("f8"), np.full(len(net.flat), 1e-6)
    for _ in range(4):
        t = rng.integers(0, size, 60) // rng.integers(1, 30, 60)
        plain, grad = window_lm.Network(8), np.zeros(len(slow))
        plain.flat[:] = np.arange(len(slow))  # each parameter's number, exact in a float
        at = [x.astype("i8") for x in (plain.embed, plain.bias, plain.wc, plain.wm)]
        for i in range(2, len(t) - 2):  # a token at a time
            cells = [at[0][t[i + b], k * 8 : k * 8 + 8] for k, b in enumerate(near)]
            h = np.append(np.tanh(slow[at[1]] + sum(slow[c] for c in cells)), 1)
            dh = np.zeros(9)
            for w, y in ((at[2], t[i] // 32), (at[3][t[i] // 32], t[i] % 32)):
                e = np.exp(h @ slow[w])
                d = e / e.sum() - (np.arange(32) == y)
                grad[w] += np.outer(h, d) / (len(t) - 4)
                dh += slow[w] @ d / (len(t) - 4)
            for c in [at[1], *cells]:
                grad[c] += dh[:8] * (1 - h[:8] ** 2)
        sums += grad**2
        slow -= 0.15 * grad / np.sqrt(sums)
        before = net.embed.copy()
        net.gradient(t, g)
        net.descend(g, squares, 0.15)
        assert g.flat == pytest.approx(grad, abs=1e-5)
        untouched = np.setdiff1d(np.arange(size), t)
        assert (net.embed[untouched] == before[untouched]).all() and not g.embed[untouched].any()
    assert net.flat == pytest.approx(slow, abs=1e-3)


def test_large_weights_and_runs_longer_than_a_tile():
    rng = np.random.default_rng(3)
    net = window_lm.Network(8)
    net.wm[:] = rng.normal(0, 60, net.wm.shape)
    t = rng.integers(0, 1024, 5)
    every = np.tile(t, (1024, 1))
    every[:, 2] = np.arange(1024)
    assert not net.bounded()
    assert sum(np.exp(net.log_probabilities(r)[0].astype("f8")) for r in every) == pytest.approx(1, abs=1e-4)
    net = window_lm.Network(8)
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    t = rng.integers(0, 1024, 3 * window_lm.TILE + 11) // rng.integers(1, 40, 3 * window_lm.TILE + 11)
    one = [net.log_probabilities(t[i : i + 5])[0] for i in range(len(t) - 4)]
    assert net.bounded() and net.log_probabilities(t) == pytest.approx(np.array(one), abs=1e-4)
