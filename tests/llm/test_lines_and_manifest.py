"""Line dedup and the Merkle manifest against plain Python."""

from __future__ import annotations

import os
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import line_dedup, merkle_manifest
from sensorlake.llm import queries as Q

from tests.conftest import SMOKE_DIR

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "A line that is long enough to be counted, No. "


def slow_lines(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


LINES = [
    *[(i, f"start {i}\n  {LONG.upper() if i % 2 else LONG}1\t\nmiddle\n\n{LONG}1\nend") for i in range(1, 7)],
    *[(i, f"{LONG}2\n{LONG}3") for i in (11, 12, 13, 14)],  # four documents: below the threshold
    (15, f"{LONG}2"), (15, f"{LONG}2\n{LONG}2\nmore"), (15, f"{LONG}2"), (16, f"\x0b{LONG}2\x0c\r\n"),
    (None, f"{LONG}1\n{LONG}2"), (None, None), (20, None), (21, ""), (22, "\n"), (23, "\n\n"),
    *[(i, "é" * 40 + "\n" + "é" * 39 + "\n " + "é" * 39 + " ") for i in range(30, 36)],
    *[(i, "É" * 40) for i in range(40, 46)],  # É is not lower-cased
    (50, "\n".join([f"{LONG}1", f"line {LONG}"] * 5000)),
    (51, LONG * 5000), (52, f" {LONG}1 "), (53, f"{LONG}1 \x1c"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_lines(spark, min_docs):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    got = line_dedup.drop_lines(df, min_docs=min_docs).collect()
    assert sorted(map(tuple, got), key=repr) == slow_lines(LINES, min_docs=min_docs)


def test_lines_carry_other_columns(spark):
    rows = [(i, t, "x", i, "y") for i, t in LINES]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, N_lines long, gone string")
    got = line_dedup.drop_lines(df)
    assert got.columns == ["doc_id", "text", "line", "N_lines", "gone", "n_lines_", "n_dropped"]
    plain = sorted(((r.doc_id, r.text, r.n_lines_, r.n_dropped) for r in got.collect()), key=repr)
    assert plain == slow_lines(LINES)
    assert all((r.line, r.gone) == ("x", "y") and r.N_lines == r.doc_id for r in got.collect())


def test_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_lines(df).collect() == []


def test_a_line_of_many_documents_is_counted_in_parts(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(LONG + "4").alias("text"))
    parts = line_dedup.frequent_lines(line_dedup.long_lines(df, 40, 16), 5).collect()
    assert len(parts) == 16 and {r["last"] for r in parts} == {399}
    assert [r.doc_id for r in line_dedup.drop_lines(df).where("n_dropped = 0").collect()] == [399]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_tree(leaves, arity):
    """The root of a list of digests, and for each leaf its steps (before, after)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // arity * arity : p // arity * arity + arity]
            steps[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        level = [digest(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], steps


def slow_manifest(docs, arity=2):
    groups = defaultdict(list)
    for doc in docs:
        i, source, lang, n_chars, text = doc
        leaf, less = (digest(*[field(v) for v in (i, source, lang, n, text)]) for n in (n_chars, None if n_chars is None else n_chars + 1))
        tampered = i is not None and crc32(str(i).encode()) % 7 == 0
        groups["" if lang is None else "=" + lang].append((i is not None, i or 0, leaf, less if tampered else leaf, i))
    names = sorted(groups, key=lambda x: x.encode())
    trees = {}
    for x in names:
        groups[x].sort(key=lambda r: r[:3])
        trees[x] = slow_tree([r[2] for r in groups[x]], arity)
    root, over = slow_tree([trees[x][0] for x in names], arity) if names else (None, [])
    out = []
    for x, more in zip(names, over, strict=True):
        for row, path in zip(groups[x], trees[x][1], strict=True):
            folded = row[3]
            for before, after in path + more:
                folded = digest(before, folded, after)
            proof = digest(*[b + a for b, a in path + more])
            out.append((row[4], row[2], trees[x][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(spark, docs, tmp_path, extra=""):
    schema = "doc_id long, source string, lang string, n_chars int, text string" + extra
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def some_documents(n, langs=("en", "de", None)):
    return [(i * 3, f"s{i % 4}" if i % 5 else None, langs[i % i_max(i, len(langs))], i if i % 6 else None, f"text é {i}") for i in range(n)]


def i_max(i, n):
    """One lang holds most rows, so that the trees differ in height."""
    return 1 if i % 4 else n


ROWS = {
    "one": some_documents(1),
    "one of each": [(1, "s", "en", 2, "t"), (2, "s", "de", 2, "t"), (3, "s", None, 2, "t"), (4, "s", "-", None, None)],
    "many": some_documents(75),
    "powers": some_documents(64, ("en",)),
    "odd": [
        (None, None, None, None, None), (None, None, None, None, None), (5, "a", "en", 1, "same"), (5, "a", "en", 1, "same"),
        (5, "b", "en", 1, "other"), (-7, "", "", -1, ""), (2**62, "x", "", 2**31 - 1, "x" * 100_000), (None, "a", "en", 1, "z"),
        *[(14, "r", "en", 1, "repeated")] * 9,
    ],
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_manifest(spark, tmp_path, name):
    assert manifest_of(spark, ROWS[name], tmp_path) == slow_manifest(ROWS[name])


def test_manifest_of_more_columns(spark, tmp_path):
    docs = some_documents(9)
    rows = [(*d, "t", 1, "p") for d in docs]
    assert manifest_of(spark, rows, tmp_path, ", tree string, idx int, payload string") == slow_manifest(docs)


def test_manifest_of_an_empty_table(spark, tmp_path):
    assert manifest_of(spark, [], tmp_path) == []


@pytest.mark.parametrize("arity", [3, 5])
def test_manifest_of_wider_runs(spark, arity, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "SMALL", 5)  # joins by shuffle too
    docs = some_documents(50)
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars int, text string")
    found = merkle_manifest.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", arity=arity)
    got = found.select(
        "doc_id", *[merkle_manifest.hex_text(F.col(c)) for c in ("leaf", "subroot", "root")],
        merkle_manifest.proof_digest(F.col("path")), merkle_manifest.fold(F.col("leaf"), F.col("path")),
    )
    wanted = {r[0]: (r[1], r[2], r[3], r[4], r[3]) for r in slow_manifest(docs, arity)}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == wanted


@pytest.mark.parametrize("name", ["op12_line_dedup", "op13_merkle_manifest"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(SMOKE_DIR, 'documents.parquet')}')")
    df = Q.QUERIES[name](spark, SMOKE_DIR)
    res = con.execute(Q.ORACLE[name])
    assert df.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, df.collect())) == sorted(res.fetchall())
