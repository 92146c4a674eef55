"""The analytics tables, derived from the parquet tables, for Spark and for DuckDB.

One SELECT in the SQL that both share defines each view, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

VIEWS = {
    "registry": """
        SELECT d.doc_id, 'src/' || d.source || '/' || d.lang || '/f' || CAST(d.doc_id AS STRING) || '.js' AS filepath,
          'f' || CAST(d.doc_id AS STRING) || '.js' AS filename,
          'src/' || d.source || '/' || d.lang || '/f' || CAST(d.doc_id AS STRING) || '.js||2026-01-' ||
            lpad(CAST(d.doc_id % 28 + 1 AS STRING), 2, '0') || 'T00:00:00.000Z' AS fingerprint,
          '2026-01-' || lpad(CAST(d.doc_id % 28 + 1 AS STRING), 2, '0') || 'T00:00:00.000Z' AS birth,
          d.n_chars AS bytes, d.source AS dir,
          CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'GREEN' WHEN l.quality = 1 THEN 'YELLOW' ELSE 'RED' END AS status,
          CASE WHEN l.quality = 1 AND l.toxic = 0 THEN CASE WHEN d.n_chars > 400 THEN 0.95 ELSE 0.1 END WHEN l.quality = 1 THEN 0.1 ELSE 0.0 END AS reach,
          CAST((d.doc_id * 7) % 30 AS BIGINT) AS impact,
          CASE d.doc_id % 4 WHEN 0 THEN 'CONCEPT' WHEN 1 THEN 'DEVELOPMENT' WHEN 2 THEN 'LOCKED' ELSE 'PRODUCTION' END AS phase,
          CAST(d.doc_id % 12 AS BIGINT) AS sessions,
          CASE d.doc_id % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'flagged' ELSE 'active' END AS lifecycle,
          l.quality IS NULL AS needs_review, l.quality AS quality, l.toxic AS toxic
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "connections": """
        SELECT a.fingerprint AS source, coalesce(b.fingerprint, 'ghost/g' || CAST(a.doc_id AS STRING) || '.js||x') AS target,
          CASE WHEN a.doc_id % 2 = 0 THEN 'IMPORT' ELSE 'REQUIRE' END AS kind, coalesce('../../' || replace(substr(b.filepath, 5), '.js', ''), './missing' || CAST(a.doc_id AS STRING)) AS specifier,
          b.doc_id IS NOT NULL AS resolved, a.doc_id AS source_id, b.doc_id AS target_id
        FROM {registry} a LEFT JOIN {registry} b ON b.doc_id = a.doc_id * 3 + 1
        UNION ALL
        SELECT a.fingerprint, b.fingerprint, 'IMPORT', '../' || b.filename, true, a.doc_id, b.doc_id
        FROM {registry} a JOIN {registry} b ON b.doc_id = CAST(floor(a.doc_id / 2) AS BIGINT)""",
    "nodes": """
        SELECT o_orderkey * 8 + 1 AS node_id, 'g1' AS graph_id, 'file' AS node_type, 'order' || CAST(o_orderkey AS STRING) AS name, 'g/order/' || o_orderstatus || '/' || CAST(o_orderkey AS STRING) AS path FROM {orders}
        UNION ALL SELECT c_custkey * 8 + 2, 'g1', 'store', c_name, 'g/customer/' || c_mktsegment || '/' || CAST(c_custkey AS STRING) FROM {customer}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 3, 'g1', 'route', n_name, 'g/nation/' || n_name FROM {nation}
        UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 8 + 4, 'g1', 'type', r_name, 'g/region/' || r_name FROM {region}
        UNION ALL SELECT s_suppkey * 8 + 5, 'g2', 'component', s_name, 'g/supplier/' || s_name FROM {supplier}""",
    "edges": """
        SELECT o_orderkey * 8 + 1 AS edge_id, 'g1' AS graph_id, o_orderkey * 8 + 1 AS src, o_custkey * 8 + 2 AS dst, 'imports' AS edge_type, CASE o_orderstatus WHEN 'O' THEN 'SAFE' WHEN 'F' THEN 'CONFLICT' END AS status, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 0.5 END AS confidence FROM {orders}
        UNION ALL SELECT c_custkey * 8 + 2, 'g1', c_custkey * 8 + 2, CAST(c_nationkey AS BIGINT) * 8 + 3, 'contains', 'SAFE', 1.0 FROM {customer}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 3, 'g1', CAST(n_nationkey AS BIGINT) * 8 + 3, CAST(n_regionkey AS BIGINT) * 8 + 4, 'contains', 'SAFE', 1.0 FROM {nation}
        UNION ALL SELECT s_suppkey * 8 + 5, 'g2', s_suppkey * 8 + 5, CAST(s_nationkey AS BIGINT) * 8 + 3, 'invokes', 'MISSING', 0.25 FROM {supplier}""",
    "ring": """
        SELECT p.p_partkey AS src, (7 * p.p_partkey + 3) % n.n AS dst FROM {part} p CROSS JOIN (SELECT count(*) AS n FROM {part}) n
        UNION ALL SELECT -1 - s.s_suppkey, s.s_suppkey FROM {supplier} s""",
    "mutations": """
        SELECT event_id AS id, 'u' || CAST(user_id AS STRING) AS fingerprint, upper(event_type) AS kind, ts, value,
          CASE event_type WHEN 'error' THEN 'SYSTEM' WHEN 'purchase' THEN 'AI' ELSE 'USER' END AS actor FROM {events}""",
    "tickets": """
        SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS created, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS resolved,
          CASE WHEN o_totalprice > 200000 THEN 'Supplier#' || CAST(o_custkey AS STRING) END AS claimed_by, 'c' || CAST(o_custkey AS STRING) AS fingerprint FROM {orders}""",
    "insights": """
        SELECT event_id AS id, 'p' || CAST(user_id % 5 AS STRING) AS project_id, 'f' || CAST(user_id AS STRING) AS file_id, event_type AS category,
          CASE WHEN value < 5 THEN 'info' WHEN value < 20 THEN 'warning' ELSE 'error' END AS severity, event_id % 3 AS pass_number, ts, props AS context FROM {events}""",
    "settings": """
        SELECT 'r' || CAST(n_regionkey AS STRING) AS category, n_name AS name,
          CASE WHEN n_nationkey % 3 = 0 THEN 'plain ' || n_name ELSE '{{"k": ' || CAST(n_nationkey AS STRING) || '}}' END AS value FROM {nation}""",
    "providers": """
        SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey < 8 THEN 'openai' WHEN s_nationkey < 16 THEN 'local' ELSE 'custom' END AS kind, s_acctbal > 0 AS active, s_acctbal AS balance FROM {supplier}""",
    "intents": """
        SELECT r.fingerprint, CASE WHEN r.quality = 0 THEN '(not set)' WHEN r.toxic = 1 THEN ' ' ELSE 'Purpose of ' || r.filename END AS purpose,
          CASE WHEN r.quality = 0 THEN NULL ELSE 'value ' || r.status END AS worth FROM {registry} r WHERE r.quality IS NOT NULL""",
    "versions": """
        SELECT 'conv/' || CAST(conv_id AS STRING) || '.md' AS filepath, turn AS birth, 'conv/' || CAST(conv_id AS STRING) || '.md||' || CAST(turn AS STRING) AS fingerprint, role, text FROM {conversations}""",
    "code": """
        SELECT doc_id, filepath AS path, status, dir, 'import {{ f' || CAST(doc_id AS STRING) || ', g }} from "./f' || CAST(doc_id + 1 AS STRING) || '";' || chr(10) ||
          'const x = require("pkg' || CAST(doc_id % 9 AS STRING) || '");' || chr(10) || '// @@@ ' || status || chr(10) ||
          CASE WHEN status = 'RED' THEN 'export default function main' || CAST(doc_id AS STRING) || '() {{ if (a && b) {{ return fetch(u); }} }}'
               ELSE 'export const f' || CAST(doc_id AS STRING) || ' = 1;' || chr(10) || 'exports.h = invoke("cmd' || CAST(doc_id % 5 AS STRING) || '");' END AS text
        FROM {registry}""",
    "mods": """
        SELECT doc_id * 8 AS node_id, 'file' AS node_type, filename AS name, filepath AS path FROM {registry}
        UNION ALL SELECT doc_id * 8 + 1, 'import', 'pkg' || CAST(doc_id % 40 AS STRING), NULL FROM {registry} WHERE doc_id % 2 = 0
        UNION ALL SELECT doc_id * 8 + 2, 'store', 'store' || CAST(doc_id AS STRING), NULL FROM {registry} WHERE doc_id % 5 = 0""",
    "mod_edges": """
        SELECT a.doc_id * 8 AS src, b.doc_id * 8 AS dst, 'depends' AS edge_type FROM {registry} a JOIN {registry} b ON b.doc_id = a.doc_id + 7
          WHERE a.doc_id % 4 = 1 AND a.doc_id % 11 <> 0 AND b.doc_id % 11 <> 0
        UNION ALL SELECT CASE WHEN w.back = 1 THEN b.doc_id ELSE a.doc_id END * 8, CASE WHEN w.back = 1 THEN a.doc_id ELSE b.doc_id END * 8, 'mutual'
          FROM {registry} a JOIN {registry} b ON b.doc_id = a.doc_id + 1 CROSS JOIN (SELECT 0 AS back UNION ALL SELECT 1) w
          WHERE a.doc_id % 10 = 3 AND a.doc_id % 11 <> 0 AND b.doc_id % 11 <> 0
        UNION ALL SELECT doc_id * 8, doc_id * 8, 'self' FROM {registry} WHERE doc_id % 17 = 5
        UNION ALL SELECT doc_id * 8, doc_id * 8 + 1, 'holds' FROM {registry} WHERE doc_id % 2 = 0 AND doc_id % 11 <> 0
        UNION ALL SELECT a.doc_id * 8 + 1, b.doc_id * 8, 'imports' FROM {registry} a JOIN {registry} b ON b.doc_id = a.doc_id + 14 WHERE a.doc_id % 2 = 0 AND a.doc_id % 40 <> 6 AND a.doc_id % 16 = 2
        UNION ALL SELECT doc_id * 8 + 2, doc_id * 8, 'uses' FROM {registry} WHERE doc_id % 10 = 0 AND doc_id % 11 <> 0
        UNION ALL SELECT doc_id * 8, doc_id * 8 + 2, 'uses' FROM {registry} WHERE doc_id % 15 = 0 AND doc_id % 11 <> 0""",
    "links": """
        SELECT page_id, url, html FROM {pages}""",
}


def _needed(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


class Tables:
    """Tables and views of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(VIEWS[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: getattr(self, name) for name in _needed(text)})


def duck(sql: str) -> str:
    """sql with {view} names as WITH clauses, for DuckDB."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needed(text):
            if name not in BASE and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", text).replace("{{", "{").replace("}}", "}")
    body = plain(sql).strip()
    if not order:
        return body
    made = ",\n".join(f"{name} AS ({plain(VIEWS[name])})" for name in order)
    recursive = body.upper().startswith("WITH RECURSIVE")
    if recursive:
        return f"WITH RECURSIVE {made},\n{body[len('WITH RECURSIVE') :]}"
    if body.upper().startswith("WITH "):
        return f"WITH {made},\n{body[5:]}"
    return f"WITH {made}\n{body}"
