"""Near-duplicate groups and repeated passages against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from sensorlake.llm import chunk_dedup, minhash_dedup
from sensorlake.llm import queries as Q
from sensorlake.llm.components import connected_components

from tests.conftest import SMOKE_DIR

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs, n, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    texts = {i: shingle_set(t, n) for i, t in docs if i is not None}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x, y = texts[a], texts[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and find(a) != find(b):
            if 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(texts[i]), find(i)) for i in texts}


def near_copies(n=300, size=60, seed=0):
    """Families of texts with more and more words changed, so that links chain."""
    rng, docs = np.random.default_rng(seed), []
    vocabulary = [f"w{i}" for i in range(500)]
    for family in range(6):
        base = [vocabulary[i] for i in rng.integers(0, 500, size)]
        for _ in range(n // 6):
            words = list(base)
            for i in rng.integers(0, size, rng.integers(0, 6)):
                words[i] = vocabulary[rng.integers(0, 500)]
            if rng.random() < 0.2:
                base = list(words)
            docs.append((len(docs) * 3, " ".join(words)))
    return docs


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_of_near_copies(spark, seed):
    docs = near_copies(seed=seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = minhash_dedup.link_groups(df, n=4)
    assert as_dict(got) == brute(docs, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_few_comparisons_at_a_time_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CENTRES", 1)
    monkeypatch.setattr(minhash_dedup, "COUNTERS", 2)
    docs = near_copies(n=120, seed=5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert as_dict(minhash_dedup.link_groups(df, n=4)) == brute(docs, 4)


def test_groups_of_the_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()]
    assert as_dict(Q.op6_minhash_dedup(spark, SMOKE_DIR)) == brute(docs, 4)


ODD = [
    (9, "one two THREE"), (4, "One two three"), (5, "one two three four"), (1, None), (2, ""), (3, " \n"), (6, "a b c d"),
    (None, "one two three"), (7, "x " * 100_000), (8, "x " * 90_000), (9, "one two three"), (10, "É é"), (11, "é é"),
]


def test_group_edge_cases(spark):
    schema = "doc_id long, text string, node string, component_id long, kept string"
    df = spark.createDataFrame([(i, t, "n", 1, "k") for i, t in ODD], schema)
    rows = minhash_dedup.link_groups(df, n=4).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got[9] == (1, 4, False) and got[4] == (1, 4, True) and got[5] == (1, 5, True)
    assert got[1] == (0, 1, True) == (got[1]) and got[2][0] == got[3][0] == 0
    assert got[None][1:] == (None, True)
    assert got[7] == (1, 7, True) and got[8] == (1, 7, False)
    assert got[10][1] == 10 and got[11][1] == 11  # only A-Z is lower-cased
    assert minhash_dedup.link_groups(df.where("false")).count() == 0


def test_signatures():
    s = minhash_dedup.shingles("a b c d e f g h", 4)
    assert len(s) == 5 and (np.diff(s.astype(object)) > 0).all()
    assert len(set(minhash_dedup.permuted(np.arange(1 << 16, dtype="u4"), 0x7FEB352D, 0x846CA68B).tolist())) == 1 << 16
    rng = np.random.default_rng(0)
    u = rng.integers(0, 1 << 63, 400).astype("u8")
    a, b = u[:300], u[100:]  # Jaccard 1/2
    agree = (minhash_dedup.signature(a, 1024) == minhash_dedup.signature(b, 1024)).mean()
    assert abs(agree - 0.5) < 0.08


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 300, 5000):
        for changed in (0, 1, 3, 30, size):
            a = np.unique(rng.integers(0, 1 << 63, size).astype("u8"))
            b = np.unique(np.concatenate([a[min(changed, len(a)) :], rng.integers(0, 1 << 63, changed).astype("u8")]))
            x, y = (minhash_dedup.parities(s).view("u8") for s in (a, b))
            differing = sum(int(v).bit_count() for v in x ^ y)
            assert len(x) * 64 == minhash_dedup.BITS and differing <= len(np.setxor1d(a, b))
            assert (differing - len(np.setxor1d(a, b))) % 2 == 0  # two that fall together cancel out


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 10), (5, 5), (2, 1), *[(100 + i, 101 + i) for i in range(60)]]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(61)}}
    assert got == want
    assert connected_components(df.where("false"), "a", "b").count() == 0


# --- repeated passages ----------------------------------------------------------------


def planted(seed=5, copies=3, n=60, words=60):
    rng = np.random.default_rng(seed)

    def some(k):
        return [f"w{i}" for i in rng.integers(0, 4000, k)]

    docs, repeated = [], set()
    for _ in range(n):
        passage = some(words)
        for k in range(copies):
            if k:
                repeated.add(len(docs))
            docs.append((len(docs), " ".join([*some(rng.integers(5, 200)), *passage, *some(rng.integers(5, 100))])))
    clean = [(len(docs) + i, " ".join(some(150))) for i in range(60)]
    return docs + clean, repeated


def test_planted_passages_go_and_clean_documents_stay(spark):
    docs, repeated = planted()
    got = chunk_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    changed = {r.doc_id for r in got if r.n_removed}
    assert not changed - repeated and len(changed) >= 0.99 * len(repeated)
    for r in got:
        at = [0, *[x for s in r.spans for x in s], len(texts[r.doc_id])]
        assert r.text == "".join(texts[r.doc_id][a:b] for a, b in zip(at[::2], at[1::2]))
        assert r.n_removed == len(texts[r.doc_id]) - len(r.text)


def test_chunks_resist_insertions():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 62, 2000).astype("u8")
    more = np.concatenate([rng.integers(0, 1 << 62, 37).astype("u8"), h[:900], h[:1], h[900:]])
    a, b = (set(chunk_dedup.standing(x, 20, 6, 3)[0].tolist()) for x in (h, more))
    assert len(a & b) > 0.98 * len(a)


@pytest.mark.parametrize("variety", [1, 2, 3, 7, 30, 1 << 40])
def test_every_run_holds_the_chunk_that_stands_for_it(variety):
    rng = np.random.default_rng(variety % 1000)
    values = rng.integers(0, 1 << 63, min(variety, 5000)).astype("u8")
    for n, gear, reach in ((20, 6, 3), (20, 5, 8), (21, 6, 8), (51, 8, 20)):
        run = values[rng.integers(0, len(values), n)]
        stands = set()
        for _ in range(30):
            before, after = (values[rng.integers(0, len(values), rng.integers(0, 60))] for _ in range(2))
            h = np.concatenate([before, run, after])
            d, starts, best = chunk_dedup.standing(h, n, gear, reach)
            assert len(best) == len(h) - n + 1
            k = best[len(before)]
            assert len(before) <= starts[k] <= len(before) + n - gear - 1
            stands.add(int(d[k]))
        assert len(stands) == 1  # whatever stands around the run
    assert len(chunk_dedup.standing(values[:0], 20, 6, 3)[2]) == len(chunk_dedup.standing(values[:1].repeat(19), 20, 6, 3)[2]) == 0


def test_texts_of_one_doc_id(spark):
    shared, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "st")
    rows = [(1, other), (2, "a b " + shared + " c"), (2, "d " + shared + " " + other + " e")]
    got = {r.text.strip() for r in chunk_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {other, "a b " + shared + " c", "d " + shared + " e"}


def test_passage_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(300))
    rows = [(5, long), (6, long), (6, long), (None, long), (7, None), (8, ""), (9, "few words"), (10, "no " * 50_000), (11, "😀 " + long)]
    schema = "doc_id long, text string, spans string, digest string, _id int"
    df = spark.createDataFrame([(i, t, "s", "d", 1) for i, t in rows], schema)
    got = chunk_dedup.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "digest", "_id", "spans", "n_removed"]
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    kept = [(5, long), (None, long), (7, None), (8, ""), (9, "few words"), (10, "no " * 50_000)]
    same = {i: t for i, t in texts if i in (6, 11)}
    assert len(texts) == len(rows) and all(x in texts for x in kept)
    assert len(same[6]) < 60 and same[11].startswith("😀") and len(same[11]) < 60
    assert chunk_dedup.remove_repeats(df.where("false")).count() == 0


def exact_cuts(docs, n=20):
    """doc_id -> words left, by comparing all runs of n words."""
    words, first, left = {i: t.split() for i, t in docs}, {}, {}
    for i in sorted(words):
        w, own, gone = words[i], {}, set()
        for s in range(len(w) - n + 1):
            run = tuple(w[s : s + n])
            last, later = own.get(run, (s, False))
            later = later or s - last >= n
            own[run] = (s, later)
            if later or first.setdefault(run, i) < i:
                gone |= set(range(s, s + n))
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    return left


@pytest.mark.parametrize("seed", [0, 1])
def test_passages_of_few_words_are_all_found_to_their_borders(spark, seed):
    rng = np.random.default_rng(seed)
    docs = []

    def some(k, of):
        return [f"w{i}" for i in rng.integers(0, of, k)]

    for variety in (1, 2, 4, 8, 51, 4000):
        for size in (20, 51, 60, 200):
            for _ in range(6):
                cycle = some(variety, 4000)
                passage = [cycle[k % variety] for k in range(size)]
                for _ in range(2):
                    docs.append((len(docs), " ".join([*some(rng.integers(0, 40), 4000), *passage, *some(rng.integers(0, 40), 4000)])))
    docs += [(len(docs) + k, " ".join(some(300, 2))) for k in range(20)]  # two words only
    got = {r.doc_id: r for r in chunk_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = exact_cuts(docs)
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(got[i].n_removed for i in range(1, 288, 2))  # each second copy


def test_a_passage_repeated_in_its_own_document_stays_once(spark):
    rng = np.random.default_rng(3)
    passage, *between = ([f"w{i}" for i in rng.integers(0, 4000, 51)] for _ in range(100))
    text = " ".join(" ".join([*passage, *b]) for b in between)
    got = chunk_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.text.split() == exact_cuts([(1, text)])[1]
    assert " ".join(passage) not in got.text[len(" ".join(passage)) :] and len(got.spans) == 98


def test_release_deletes_the_files_of_a_finished_step(spark):
    """They are gone when it returns, not when the next step has written its own."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    chunk_dedup.release(spark)
    before = disk.getAllBlocks().size()
    kept = spark.range(1000).repartition(4).groupBy("id").count().checkpoint()
    assert disk.getAllBlocks().size() > before
    chunk_dedup.release(spark)
    assert disk.getAllBlocks().size() <= before
    assert kept.count() == 1000
