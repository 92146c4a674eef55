"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack

    path = public_tokenizers.path
    return pack(documents(spark, sf_dir), path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.line_dedup import keep_bitmaps, kept_text, with_bitmaps

    docs = documents(spark, sf_dir)
    kept = with_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.media import digests

    return digests(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language import held_out, identify, train

    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs, held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lm import score

    return score(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import encode_digests

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(documents(spark, sf_dir), labels).withColumn("failed_rules", F.array_join("failed_rules", ","))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import pseudonymize, session_key

    df = pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_pii", lambda x: x["kind"]))), ",")
    return df.select("doc_id", "text", F.size("_pii").cast("long").alias("n_pii"), kinds.alias("kinds"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.credentials import digests

    return digests(documents(spark, sf_dir))


def _op11_sql() -> str:
    """Finds by splitting texts at every pattern; the sweep as windows."""
    from lodestone.llm import credentials as c

    quoted = lambda p: p.replace("'", "''")
    patterns = ", ".join(f"({c.RANK[k]}, '{quoted(p)}')" for k, p in zip(c.KINDS, (c.ASSIGN, c.ACCESS, c.HEX, c.IDENT, c.KEYED, c.BARE, c.ENDPOINT, c.BREAK)))
    kinds = ", ".join(f"'{k}'" for k in c.KINDS)
    before = "rows BETWEEN unbounded preceding AND 1 preceding"
    near = lambda ranks: f"coalesce(start - max(finish) FILTER (WHERE rank IN ({ranks})) OVER ahead <= {c.REACH}, false) OR coalesce(min(start) FILTER (WHERE rank IN ({ranks})) OVER back - finish <= {c.REACH}, false)"
    over = lambda ranks: f"coalesce(max(finish) FILTER (WHERE rank IN ({ranks})) OVER ahead > start, false) OR coalesce(min(start) FILTER (WHERE rank IN ({ranks})) OVER back < finish, false)"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
patterns(rank, p) AS (VALUES {patterns}),
pieces AS (
  SELECT rid, rank, p, unnest(list_zip(string_split_regex(t, p), regexp_extract_all(t, p))) AS x, unnest(range(len(string_split_regex(t, p)))) AS i
  FROM texts, patterns WHERE regexp_matches(t, p)
), placed AS (
  SELECT rid, rank, p, x[2] AS m, sum(length(x[1]) + coalesce(length(x[2]), 0)) OVER (PARTITION BY rid, rank ORDER BY i) AS finish FROM pieces
), finds AS (
  SELECT rid, rank, finish - length(m) AS start, finish FROM placed
  WHERE m IS NOT NULL AND (rank <> 0 OR length(regexp_extract(m, p, 2)) >= 6)
    AND (rank <> 5 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')))
), marked AS (
  SELECT *, {over("0, 1, 2")} AS strong, {over("0, 1, 2, 3, 4, 6")} AS other, count(*) FILTER (WHERE rank = 7) OVER ahead AS scope FROM finds
  WINDOW ahead AS (PARTITION BY rid ORDER BY start, rank, finish {before}), back AS (PARTITION BY rid ORDER BY start DESC, rank DESC, finish DESC {before})
), parts AS (
  SELECT * FROM marked WHERE rank <> 7 AND NOT (rank IN (3, 4, 6) AND strong) AND NOT (rank = 5 AND other)
), close AS (
  SELECT *, {near("1, 3")} AS by_id, {near("0, 2, 4, 5")} AS by_secret, {near("6")} AS by_end FROM parts
  WINDOW ahead AS (PARTITION BY rid, scope ORDER BY start, rank, finish {before}), back AS (PARTITION BY rid, scope ORDER BY start DESC, rank DESC, finish DESC {before})
), told AS (
  SELECT rid, rank, start, finish, [{kinds}][rank + 1] || ':' || start || ':' || finish AS said FROM close
  WHERE rank < 3 OR (rank = 3 AND by_secret) OR (rank = 4 AND (by_id OR by_end)) OR (rank = 5 AND by_id) OR (rank = 6 AND by_id AND by_secret)
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(said, ',' ORDER BY start, rank), '') AS spans, count(*) FILTER (WHERE rank > 2) AS n_linked
FROM texts LEFT JOIN told USING (rid) GROUP BY rid
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.negatives import registered

    return registered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH held AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
  SELECT vec_id AS anchor_id, label AS own, v AS q FROM held WHERE vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1
), scores AS (
  SELECT anchor_id, own, vec_id, label, CAST(list_inner_product(q, v) AS BIGINT) AS score
  FROM anchors JOIN held ON vec_id IS DISTINCT FROM anchor_id
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS base, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT DISTINCT c, base, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda s, k: xor(s >> 1, 3988292384::UBIGINT * (s & 1::UBIGINT)))), 4294967295::UBIGINT) % 4 AS h
  FROM turns
), rebuilt AS (
  SELECT heads.c, digest, words, 0 AS part, i FROM heads JOIN turns ON turns.c = heads.base AND i <= h
  UNION ALL
  SELECT heads.c, digest, words, 1 AS part, i FROM heads JOIN turns ON turns.c = heads.c AND i > h
), paths AS (
  SELECT c, row_number() OVER w AS depth, md5(string_agg(digest, ',') OVER w) AS node, words FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, i)
  UNION ALL
  SELECT c, 0, '', 0 FROM heads
), nodes AS (
  SELECT node, min(depth) AS depth, min(c) AS owner, count(*) AS n_convs, min(words) AS words FROM paths GROUP BY node
), lengths AS (
  SELECT c, max(depth) AS last FROM paths GROUP BY c
), parents AS (
  SELECT nodes.*, paths.node AS parent FROM nodes LEFT JOIN paths ON paths.c = owner AND paths.depth = nodes.depth - 1
), children AS (
  SELECT parent AS node, count(*) AS n FROM parents WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT p.node, sum((v.n_convs - 1) * v.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes v LEFT JOIN children k USING (node) JOIN paths p ON p.c = v.owner AND p.depth <= v.depth GROUP BY p.node
), ends AS (
  SELECT node, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS said FROM paths p JOIN lengths l ON l.c = p.c AND depth = last GROUP BY node
)
SELECT v.owner AS conv_id, CAST(v.depth AS BIGINT) AS depth, u.owner AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(said, '')) AS ends_sha256
FROM parents v LEFT JOIN nodes u ON u.node = v.parent LEFT JOIN children k ON k.node = v.node JOIN below b ON b.node = v.node LEFT JOIN ends e ON e.node = v.node
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.prefix_trie import trie

    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_media": op3_media,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_lm": op6_lm,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_html": op9_html,
    "op10_pii": op10_pii,
    "op11_secrets": op11_secrets,
    "op12_negatives": op12_negatives,
    "op13_trie": op13_trie,
}
ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op11_secrets": _op11_sql(), "op12_negatives": OP12_SQL, "op13_trie": OP13_SQL}
