"""One query for each operator, over its whole table and with production parameters, and
the SQL twin of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm import (
    bpe_stream,
    chunk_dedup,
    language_id,
    line_dedup,
    main_text,
    merkle_manifest,
    minhash_dedup,
    quality_gam,
    token_alignment,
    window_lm,
)
from sensorlake.llm.packing import pack, token_pieces
from sensorlake.llm.srs_ann import srs_neighbours
from sensorlake.llm.vectors import usable
from sensorlake.llm.voronoi_knn import voronoi_knn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 rows of largest integer inner product; queries: ids divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding"))
    ints = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    return voronoi_knn(rows.select("vec_id", ints.alias("v")), F.col("vec_id") % 50 == 0, k=5)


def op5_srs_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 nearest rows by inner product; queries: ids divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding"))
    doubles = F.col("embedding").cast("array<double>")
    return srs_neighbours(rows.select("vec_id", doubles.alias("v")), F.col("vec_id") % 20 == 0, k=20)


def op3_window_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudo-log-likelihood of every document under a network trained on all of them."""
    docs = window_lm.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return window_lm.score(docs, *window_lm.train(docs))


def byte_bpe() -> tuple:
    """The byte-level vocabulary: ranks, word pattern, and the one special token."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "<|endoftext|>", 50256


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens: one row for each piece."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), byte_bpe())
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(digests)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of the ids is never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, remainder(3) != 1)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text", held_out), model).drop("text")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a similarity of 0.8 on shingles of four words."""
    return minhash_dedup.link_groups(table(spark, sf_dir, "documents"), n=4, percent=80)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", "n_chars")


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels of a quarter of the ids are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(4) != 2)
    model = quality_gam.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    return quality_gam.rate(docs.select("doc_id", "text", held_out), model).drop("text")


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    import public_tokenizers

    coded = bpe_stream.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has, and what was cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.remove_repeats(docs).select("doc_id", "text", "spans", "n_removed")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens that two tokenizers make of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.link_scores(docs, *paths, public_tokenizers.PATTERN)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long lines that at least five documents have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs, min_chars=40, min_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf and proof in the manifest of the table, by language; a seventh of
    the documents is tampered with, and no longer leads to the root."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    found = merkle_manifest.manifest(
        docs,
        fields,
        group="lang",
        order="doc_id",
        carry={"tampered": F.when(remainder(7) == 0, merkle_manifest.record_digest(*[more.get(f, F.col(f)) for f in fields]))},
    )
    text = merkle_manifest.hex_text
    start = F.coalesce("tampered", "leaf")
    return found.select(
        "doc_id",
        text(F.col("leaf")).alias("leaf"),
        text(F.col("subroot")).alias("subroot"),
        text(F.col("root")).alias("root"),
        merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle_manifest.fold(start, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_language_id": op2_language_id,
    "op3_window_lm": op3_window_lm,
    "op4_packing": op4_packing,
    "op5_srs_neighbours": op5_srs_neighbours,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_main_text": op7_main_text,
    "op8_quality_gam": op8_quality_gam,
    "op9_bpe_stream": op9_bpe_stream,
    "op10_chunk_dedup": op10_chunk_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op1_voronoi_knn": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op12_line_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (
            SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (
            SELECT k.*, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN f USING (key))
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r""",
    "op13_merkle_manifest": """
        WITH RECURSIVE t AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree,
                   concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                             CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                             CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
                   n_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
                   -- crc32 bit by bit: each byte is added, then shifted out by eight steps.
                   list_reduce(
                       flatten([[4294967295]::BIGINT[]] || list_transform(
                           string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
            FROM documents),
        h AS (
            SELECT r, doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed,
                   coalesce(xor(crc, 4294967295) % 7 = 0, false) AS tampered
            FROM t),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
        nodes AS (
            SELECT 0 AS level, tree, i, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL
            SELECT any_value(level) + 1, tree, i // 2, sha256(string_agg(digest, '' ORDER BY i)), any_value(n + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY tree, i // 2),
        subroots AS (
            SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE n = 1),
        tops AS (
            SELECT 0 AS level, place AS i, subroot AS digest, count(*) OVER () AS n FROM subroots
            UNION ALL
            SELECT any_value(level) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), any_value(n + 1) // 2
            FROM tops WHERE n > 1 GROUP BY i // 2),
        -- Every step of every leaf: its level, the side of the sibling and the sibling, if any.
        steps AS (
            SELECT l.r, s.level, (l.i >> s.level) % 2 AS side, o.digest AS other
            FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) s USING (tree)
            LEFT JOIN nodes o ON o.tree = l.tree AND o.level = s.level AND o.i = xor(l.i >> s.level, 1)
            UNION ALL
            SELECT l.r, 1000 + s.level, (b.place >> s.level) % 2, o.digest
            FROM leaves l JOIN subroots b USING (tree) CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) s
            LEFT JOIN tops o ON o.level = s.level AND o.i = xor(b.place >> s.level, 1)),
        listed AS (
            SELECT r, list({'side': side, 'other': coalesce(other, '')} ORDER BY level) AS path,
                   string_agg(coalesce(other, ''), '' ORDER BY level) AS siblings
            FROM steps GROUP BY r),
        walk AS (
            SELECT r, 0 AS pos, CASE WHEN tampered THEN changed ELSE leaf END AS digest, coalesce(path, []) AS path
            FROM leaves LEFT JOIN listed USING (r)
            UNION ALL
            SELECT r, pos + 1, sha256(CASE WHEN path[pos + 1].side = 1 THEN path[pos + 1].other || digest
                                          ELSE digest || path[pos + 1].other END), path
            FROM walk WHERE pos < len(path))
        SELECT l.doc_id, l.leaf, b.subroot, t.digest AS root, sha256(coalesce(s.siblings, '')) AS proof_sha256,
               w.digest AS folded_root, w.digest = t.digest AS verified
        FROM leaves l JOIN subroots b USING (tree) LEFT JOIN listed s USING (r)
        JOIN walk w ON w.r = l.r AND w.pos = len(w.path) CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t""",
}
