"""Token alignment against both libraries on whole texts and all pairs of tokens."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from sensorlake.llm import queries as Q
from sensorlake.llm import token_alignment as T

from tests.conftest import SMOKE_DIR

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATHS = (BPE, PIECES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def token_ends(sizes):
    return list(zip(np.cumsum([0, *sizes])[:-1].tolist(), np.cumsum(sizes).tolist(), strict=True))


def slow(text, libraries):
    """(n_a, n_b, groups as text, links as id pairs) by comparing byte ranges one by one."""
    a, b = libraries
    if not text:
        return 0, 0, None, []
    coded = a.encode(" " + text, add_special_tokens=False)
    code = T.byte_alphabet()
    raw_a = [bytes(code[c] for c in t) for t in coded.tokens]
    raw_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        raw_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return 0, 0, None, []
    ids_a, ids_b = coded.ids, b.encode(text)
    at_a, at_b = token_ends([len(x) for x in raw_a]), token_ends([len(x) for x in raw_b])
    common = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups, links, begin = [], [], 0
    for end in common:
        in_a = [k for k, (s, e) in enumerate(at_a) if begin <= s and e <= end]
        in_b = [k for k, (s, e) in enumerate(at_b) if begin <= s and e <= end]
        groups.append(",".join(str(ids_a[k]) for k in in_a) + "|" + ",".join(str(ids_b[k]) for k in in_b))
        links += [(ids_a[i], ids_b[j]) for i in in_a for j in in_b if at_a[i][0] < at_b[j][1] and at_b[j][0] < at_a[i][1]]
        begin = end
    return len(ids_a), len(ids_b), groups, links


def expected(docs, libraries):
    done = [slow(t, libraries) for _, t in docs]
    count = Counter(p for _, _, _, links in done for p in set(links))
    best: dict[int, int] = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), (n_a, n_b, groups, links) in zip(docs, done, strict=True):
        digest = sha256(";".join(groups).encode()).hexdigest() if groups is not None else ""
        n_best = sum(count[p] == best[p[0]] for p in links)
        out.append((i, n_a, n_b, len(groups or []), len(links), n_best, sum(count[p] for p in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\ta\n\nb  \r\n", "The <s> and </s> and <unk> <0x41> <|endoftext|> end",
    "▁", "one ▁two", "nul\x00 byte \x1c\x1d x", "café café   　 ​ end", "你好 世界",
    "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 x", "don't we'll I'VE 'tis", "1234567890 3.14159 1,000,000", "ﬁne ①",
    "العربية עברית", " ́combining", "x" * 500, "a b " * 300, "=" * 77 + " " * 40 + "z",
]


def test_odd_texts(spark, libraries):
    docs = [(i if i % 7 else None, t) for i, t in enumerate([*ODD, *ODD])]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, ROW int, pairs string")
    assert rows(T.link_scores(df, *PATHS)) == expected(docs, libraries)


def test_given_documents(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()]
    docs = sorted(docs, key=lambda d: len(d[1] or ""))[:120]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(T.link_scores(df, *PATHS)) == expected(docs, libraries)


def test_query_covers_the_table(spark):
    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    got = Q.op11_token_alignment(spark, SMOKE_DIR)
    assert got.columns == COLUMNS
    assert got.count() == docs.count() == got.where("n_links = n_a + n_b - n_groups and n_links > 0").count()


def test_rare_pairs_are_joined_when_the_table_is_large(spark, libraries):
    docs = [(i, t) for i, t in enumerate(ODD * 2 + ["one two three four", "one two", "one"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (0, 1, 40):
        assert rows(T.link_scores(df, *PATHS, max_broadcast_rows=most)) == expected(docs, libraries)


def test_long_texts_are_cut_into_segments(spark, libraries, monkeypatch):
    pair = T.tokenizer_pair(*PATHS)
    text = " ".join(f"word{i} naïve  你好, don't" for i in range(300))
    whole = list(T.aligned_batch([pair.ids(text)], pair))[0]
    monkeypatch.setattr(T, "SEGMENT", 500)
    parts = T.aligned_text(pair.segments(text), pair)
    assert parts[:4] == whole[:4] and parts[4] == sha256(whole[4].encode()).hexdigest()
    assert parts[5].tolist() == whole[5].tolist() and parts[6].tolist() == whole[6].tolist()
    assert T.aligned_text(pair.segments(text + " ▁"), pair) == T.NOTHING


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.link_scores(df, *PATHS).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 400), min_size=1), st.sets(st.integers(1, 400), min_size=1), st.randoms())
def test_gallop_finds_the_first_end_from_any_start(x, y, rng):
    top = max(*x, *y)
    short, long = np.array(sorted({*x, top})), np.array(sorted({*y, top}))
    start = np.array([rng.randrange(len(long)) for _ in short])
    assert T.gallop(short, long, start).tolist() == np.searchsorted(long, short).tolist()


def test_byte_alphabet_is_the_libraries():
    decoder = ByteLevel()
    assert all(decoder.decode([c]) == chr(b) for c, b in T.byte_alphabet().items() if b < 128)
    assert sorted(T.byte_alphabet().values()) == list(range(256))


def test_ids_are_the_libraries(spark, libraries):
    """On all given texts of sf0.01, and on every white space and sample of letters."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    spaces = [chr(c) for c in range(0x11000) if chr(c).isspace() or c % 97 == 0 and not 0xD800 <= c < 0xE000]
    texts += [f"a{x}b {x}c{x} d{x}{x}1" for x in spaces if x != "▁"]
    pair = T.tokenizer_pair(*PATHS)
    for text in filter(None, texts):
        a, b = pair.ids(text)
        assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == libraries[1].encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .\t\n'é你 ▁́s"), max_size=60))
def test_segments_are_the_whole_text(text):
    pair, old = T.tokenizer_pair(*PATHS), T.SEGMENT
    try:
        T.SEGMENT = 3
        found = list(pair.segments(text))
    finally:
        T.SEGMENT = old
    whole = pair.ids(text)
    assert (None in [f and 1 for f in found]) == (whole is None)
    if whole is not None:
        assert [np.concatenate(x).tolist() for x in zip(*found, strict=True)] == [x.tolist() for x in whole]
