"""Queries of scalar functions (X)."""

from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.operators import relations as R
from lodestone.registry import query


@query("SELECT doc_id, 'file_' || substr(sha256('p' || '::' || filepath), 1, 16) AS id FROM {registry}")
def x01_hash_id(t):
    return t.registry.select("doc_id", X.hash_id("file_", F.lit("p"), F.col("filepath")).alias("id"))


@query("SELECT doc_id, filepath AS path, birth FROM {registry}")
def x02_fingerprint_parse(t):
    fp = X.fingerprint(F.col("filepath"), F.col("birth"))
    return t.registry.select("doc_id", X.fingerprint_path(fp).alias("path"), X.fingerprint_birth(fp).alias("birth"))


@query("SELECT doc_id, filename AS base, regexp_replace(filepath, '/[^/]*$', '') AS parent, '.js' AS ext FROM {registry}")
def x03_path_parts(t):
    p = F.col("filepath")
    return t.registry.select("doc_id", X.basename(p).alias("base"), R.dirname(p).alias("parent"), X.extname(p).alias("ext"))


@query("SELECT doc_id, 'src/' || filename AS path FROM {registry}")
def x04_normalise(t):
    return t.registry.select("doc_id", R.normalised(F.concat(F.lit("./src/a/b/./../../"), "filename")).alias("path"))


@query("SELECT doc_id, epoch(CAST(replace(replace(birth, 'T', ' '), 'Z', '') AS TIMESTAMP))::BIGINT AS seconds FROM {registry}")
def x05_timestamps(t):
    return t.registry.select("doc_id", F.unix_seconds(X.iso_timestamp(F.col("birth"))).alias("seconds"))


@query("SELECT doc_id, 'Hello ' || filename || ' in ' || dir AS text FROM {registry}")
def x18_fill_template(t):
    values = F.create_map(F.lit("name"), F.col("filename"), F.lit("dir"), F.col("dir"))
    return t.registry.select("doc_id", X.fill_template(F.lit("Hello {{name}} in {{dir}}"), values).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM {links}")
def x19_escape(t):
    return t.links.select("page_id", X.escape_html(F.col("url")).alias("safe"))


@query("SELECT doc_id, CASE WHEN starts_with(filepath, 'src/src1') THEN 'lib/one' || substr(filepath, 9) ELSE filepath END AS path FROM {registry}")
def x20_rewrite_path(t):
    return t.registry.select("doc_id", X.rewrite_path(F.col("filepath"), "src/src1", "lib/one").alias("path"))


@query("SELECT doc_id, substr(filename || ' ' || dir || ' ' || text, 1, 500) AS text FROM {registry} JOIN (SELECT doc_id, text FROM {documents}) d USING (doc_id)")
def x21_search_text(t):
    both = t.registry.select("doc_id", "filename", "dir").join(t.documents.select("doc_id", "text"), "doc_id")
    return both.select("doc_id", X.search_text(F.col("filename"), F.col("dir"), F.col("text")).alias("text"))


@query("SELECT node_id, TRY_CAST(string_split('g1:node:' || CASE WHEN node_type = 'type' THEN 'x' ELSE CAST(node_id AS STRING) END, ':')[-1] AS BIGINT) AS id FROM {nodes}")
def x22_trailing_id(t):
    key = F.concat(F.lit("g1:node:"), F.when(F.col("node_type") == "type", "x").otherwise(F.col("node_id").cast("string")))
    return t.nodes.select("node_id", X.trailing_id(key).alias("id"))


@query("SELECT name, coalesce(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.k'), value) AS value FROM {settings}")
def x23_json_or_raw(t):
    return t.settings.select("name", X.json_or_raw(F.col("value"), "$.k").alias("value"))


@query("SELECT doc_id, CASE WHEN impact < 5 THEN 'low' WHEN impact <= 15 THEN 'medium' ELSE 'high' END AS band FROM {registry}")
def x25_complexity_band(t):
    return t.registry.select("doc_id", X.band(F.col("impact"), 5, 15).alias("band"))


@query("SELECT a.p_partkey AS id, CAST(CASE WHEN a.p_brand <> b.p_brand THEN 1 ELSE 0 END + CASE WHEN a.p_type <> b.p_type THEN 1 ELSE 0 END AS DOUBLE) / 2 AS distance FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1")
def x16_metadata_distance(t):
    meta = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    a = t.part.select(F.col("p_partkey").alias("id"), meta.alias("a"))
    b = t.part.select((F.col("p_partkey") - 1).alias("id"), meta.alias("b"))
    return a.join(b, "id").select("id", X.metadata_distance(F.col("a"), F.col("b")).alias("distance"))
