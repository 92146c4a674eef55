"""Queries of snapshot changes (M) and of search (H)."""

from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.operators import snapshots as M
from lodestone.registry import query


def _files(t):
    return t.registry.select("doc_id", "filepath", "fingerprint", "status", "phase", "sessions", "lifecycle")


@query("SELECT doc_id, CASE WHEN status = 'RED' THEN 'YELLOW' ELSE status END AS status, sessions FROM {registry}")
def m01_upsert_files(t):
    old = t.registry.select("doc_id", "status", "sessions")
    new = old.where("status = 'RED'").withColumns({"status": F.lit("YELLOW"), "sessions": F.lit(0).cast("long")})
    return M.upsert(old, new, ["doc_id"], preserve=["sessions"])


@query("SELECT source, target, kind, max(specifier) AS specifier FROM {connections} GROUP BY source, target, kind")
def m02_unique_connections(t):
    return t.connections.groupBy("source", "target", "kind").agg(F.max("specifier").alias("specifier"))


@query("SELECT category, name, CASE WHEN category = 'r1' THEN 'new' ELSE value END AS value FROM {settings}")
def m03_upsert_settings(t):
    new = t.settings.where("category = 'r1'").withColumn("value", F.lit("new"))
    return M.upsert(t.settings, new, ["category", "name"])


@query("SELECT id, name, CASE WHEN balance < 0 THEN 'blocked' ELSE kind END AS kind, active FROM {providers}")
def m04_merge_providers(t):
    new = t.providers.where("balance < 0").select("id", F.lit("blocked").alias("kind"), F.lit(None).cast("string").alias("name"))
    return M.merge(t.providers.select("id", "name", "kind", "active"), new, "id")


@query("SELECT id, name FROM {providers} UNION ALL SELECT -1, 'seed'")
def m05_seed_providers(t):
    seeds = t.spark.createDataFrame([(-1, "seed"), (1, "other")], "id long, name string")
    return M.insert_missing(t.providers.select("id", "name"), seeds, ["id"])


GONE = "SELECT fingerprint FROM {registry} WHERE status = 'YELLOW'"


@query(f"SELECT 'registry' AS name, count(*) AS n FROM {{registry}} WHERE fingerprint NOT IN ({GONE}) UNION ALL SELECT 'connections', count(*) FROM {{connections}} WHERE source NOT IN ({GONE}) AND target NOT IN ({GONE}) UNION ALL SELECT 'intents', count(*) FROM {{intents}} WHERE fingerprint NOT IN ({GONE})")
def m06_cascading_delete(t):
    gone = t.registry.where("status = 'YELLOW'").select("fingerprint")
    left = M.cascade({"registry": t.registry, "connections": t.connections, "intents": t.intents}, gone, {"registry": ["fingerprint"], "connections": ["source", "target"], "intents": ["fingerprint"]})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"SELECT source, target FROM {{connections}} WHERE source NOT IN ({GONE}) AND target NOT IN ({GONE})")
def m07_delete_connections(t):
    gone = t.registry.where("status = 'YELLOW'").select("fingerprint")
    return M.delete(t.connections.select("source", "target"), gone, "source", "target")


@query("SELECT m.id, CASE WHEN m.claimed_by IS NULL AND m.resolved IS NULL AND p.active THEN p.name ELSE m.claimed_by END AS claimed_by FROM {tickets} m LEFT JOIN {providers} p ON p.id = m.id")
def m09_claim_tickets(t):
    claims = t.providers.select("id", F.col("name").alias("claimant"))
    return M.claim(t.tickets, t.providers, claims).select("id", "claimed_by")


@query("SELECT kind, count(*) AS n FROM (SELECT kind FROM {mutations} UNION ALL SELECT 'CONCEPT' FROM {registry} WHERE phase = 'CONCEPT') GROUP BY kind")
def m10_append_log(t):
    concept = t.registry.where("phase = 'CONCEPT'").select(F.lit("CONCEPT").alias("kind"))
    return t.mutations.select("kind").unionByName(concept).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT fingerprint, CASE kind WHEN 'PURCHASE' THEN 'PRODUCTION' WHEN 'ERROR' THEN 'PURGE' ELSE kind END AS kind, CAST(substr(fingerprint, 2) AS BIGINT) % 3 = 0 AS wanted FROM {mutations})
SELECT fingerprint, kind, CAST(NULL AS STRING) AS changed, 'DEVELOPMENT' AS phase, count(*) AS n FROM l WHERE NOT wanted GROUP BY ALL
UNION ALL SELECT fingerprint, kind, NULL, 'PRODUCTION', count(*) FROM l WHERE wanted AND kind IN ('PRODUCTION', 'PURGE') GROUP BY ALL
UNION ALL SELECT fingerprint, 'PURGE', '{{"purgedMutations":' || CAST(count(CASE WHEN kind NOT IN ('PRODUCTION', 'PURGE') THEN 1 END) AS STRING) || '}}', 'PRODUCTION', 1 FROM l WHERE wanted GROUP BY fingerprint""")
def m12_purge_development(t):
    kind = F.when(F.col("kind") == "PURCHASE", "PRODUCTION").when(F.col("kind") == "ERROR", "PURGE").otherwise(F.col("kind"))
    log = t.mutations.select("fingerprint", kind.alias("kind"), F.lit(None).cast("string").alias("changed"), "actor")
    files = t.mutations.select("fingerprint", F.lit("DEVELOPMENT").alias("phase")).distinct()
    after, kept = M.purge_development(files, log, files.where(F.substring("fingerprint", 2, 20).cast("long") % 3 == 0))
    return kept.join(after, "fingerprint").groupBy("fingerprint", "kind", "changed", "phase").agg(F.count("*").alias("n"))


@query("SELECT id FROM {mutations} WHERE kind IN ('SIGNUP', 'ERROR') OR ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM {mutations})")
def m13_retention(t):
    newest = t.mutations.agg(F.max("ts").alias("_last"))
    log = t.mutations.join(F.broadcast(newest))  # one row
    return M.retention(log, F.col("_last") - F.expr("INTERVAL 7 DAYS"), ("SIGNUP", "ERROR")).select("id")


@query("SELECT doc_id, CASE WHEN lifecycle = 'archived' THEN sessions ELSE sessions + 1 END AS sessions FROM {registry}")
def m14_session_counters(t):
    return M.update(_files(t), F.col("lifecycle") != "archived", sessions=F.col("sessions") + 1).select("doc_id", "sessions")


@query("SELECT doc_id, CASE WHEN status = 'GREEN' THEN false ELSE needs_review END AS needs_review FROM {registry}")
def m15_review_flags(t):
    return M.update(t.registry, F.col("status") == "GREEN", needs_review=False).select("doc_id", "needs_review")


@query("SELECT CASE WHEN phase IN ('CONCEPT', 'DEVELOPMENT') THEN 'LOCKED' ELSE phase END AS phase, count(*) AS n FROM {registry} GROUP BY 1 UNION ALL SELECT 'log', count(*) FROM {registry} WHERE phase IN ('CONCEPT', 'DEVELOPMENT')")
def m16_lock(t):
    files, log = M.lock(_files(t))
    return files.groupBy("phase").agg(F.count("*").alias("n")).unionByName(log.agg(F.count("*").alias("n")).select(F.lit("log").alias("phase"), "n"))


@query("SELECT doc_id, CASE WHEN lifecycle = 'active' AND sessions >= 5 THEN 'flagged' ELSE lifecycle END AS lifecycle FROM {registry}")
def m18_flag_stale(t):
    return M.flag_stale(_files(t)).select("doc_id", "lifecycle")


@query("SELECT doc_id, CASE WHEN lifecycle = 'flagged' THEN 'archived' ELSE lifecycle END AS lifecycle, CASE WHEN lifecycle = 'flagged' THEN '2026-02-08' END AS expires FROM {registry}")
def m19_archive_flagged(t):
    return M.archive_flagged(_files(t), F.lit("2026-02-01").cast("date")).select("doc_id", "lifecycle", F.col("expires").cast("string").alias("expires"))


@query("SELECT r.doc_id, CASE WHEN r.lifecycle = 'archived' AND u.fingerprint IS NOT NULL THEN 'active' ELSE r.lifecycle END AS lifecycle FROM {registry} r LEFT JOIN (SELECT DISTINCT target AS fingerprint FROM {connections}) u USING (fingerprint)")
def m20_unarchive(t):
    woken = t.connections.select(F.col("target").alias("fingerprint"), F.lit(True).alias("_woken")).distinct()
    both = t.registry.join(woken, "fingerprint", "left")
    return M.update(both, (F.col("lifecycle") == "archived") & F.col("_woken"), lifecycle="active").select("doc_id", "lifecycle")


@query("SELECT id FROM {insights} WHERE project_id <> 'p2'")
def m22_clear_project(t):
    return M.delete(t.insights, t.spark.createDataFrame([("p2",)], "project_id string"), "project_id").select("id")


@query("SELECT id, CASE WHEN kind = 'custom' THEN false ELSE active END AS active FROM {providers}")
def m24_deactivate(t):
    return M.update(t.providers, F.col("kind") == "custom", active=False).select("id", "active")


WORDS = "(SELECT DISTINCT item_id AS object, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {benchmark})"


def _index(t):
    return S.build_index(t.benchmark, "item_id", "text", "bench")


@query(f"SELECT object, CAST(2 AS BIGINT) AS hits FROM {WORDS} WHERE term IN ('of', 'the') GROUP BY object HAVING count(DISTINCT term) = 2")
def h01_search(t):
    return S.search(_index(t), ["of", "The"])


ASKED = [(1, "teh"), (2, "Thee"), (2, "oof"), (3, "thatxx"), (4, "zzzzzzzz"), (5, "i"), (6, "abcdefghijklmnop")]
_asked = "(VALUES " + ", ".join(f"({q}, '{w.lower()}')" for q, w in ASKED) + ") q(query, word)"


# DuckDB's distance counts bytes: a letter beyond ASCII stands as one sign that no word has
@query(rf"""WITH w AS {WORDS}, q AS (SELECT * FROM {_asked}), n AS (SELECT DISTINCT word, term, levenshtein(word, regexp_replace(term, '[^\x00-\x7F]', '#', 'g')) AS d FROM (SELECT DISTINCT term FROM w WHERE term <> ''), (SELECT DISTINCT word FROM q) WHERE d <= 2),
 f AS (SELECT object, word, min(d) AS d FROM w JOIN n USING (term) GROUP BY object, word)
SELECT q.query, f.object, CAST(sum(d) AS BIGINT) AS distance FROM f JOIN q USING (word) GROUP BY q.query, f.object HAVING count(*) = (SELECT count(*) FROM q r WHERE r.query = q.query)""")
def h01_typo_search(t):
    index = _index(t)
    return S.typo_search(index, S.typo_index(index, 2), t.spark.createDataFrame(ASKED, "query int, word string"), 2)


@query(f"""WITH w AS {WORDS}, c AS (SELECT term, count(DISTINCT object) AS objects FROM w WHERE term <> '' GROUP BY term), p(asked) AS (VALUES ('t'), ('TH'), ('onedth'), ('thanontion'))
SELECT asked, CAST(row_number() OVER (PARTITION BY asked ORDER BY objects DESC, term) AS INT) AS place, term, objects FROM p JOIN c ON starts_with(term, lower(asked)) QUALIFY place <= 7""")
def h02_completions(t):
    asked = t.spark.createDataFrame([("t",), ("TH",), ("onedth",), ("thanontion",)], "asked string")
    return S.completions(S.prefix_table(_index(t)), asked, 7)


@query(f"SELECT term, count(DISTINCT object) AS objects FROM {WORDS} WHERE starts_with(term, 'th') GROUP BY term ORDER BY 2 DESC, 1 LIMIT 10")
def h02_suggest(t):
    return S.suggest(_index(t), "th")


@query(f"SELECT object, term FROM {WORDS} WHERE term <> '' AND object > 5 UNION ALL SELECT item_id, 'changed' FROM {{benchmark}} WHERE item_id <= 5")
def h03_push_pop(t):
    new = t.benchmark.where("item_id <= 5").select(F.lit("bench").alias("collection"), F.col("item_id").alias("object"), F.lit("changed").alias("term"))
    return S.push(_index(t), new).select("object", "term")


@query("SELECT term, count(*) AS n FROM (SELECT DISTINCT node_id, unnest(string_split_regex(lower(name || ' ' || path), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {nodes}) WHERE term <> '' GROUP BY term")
def h04_index_nodes(t):
    index = S.build_index(t.nodes.withColumn("text", F.concat_ws(" ", "name", "path")), "node_id", "text", "nodes")
    return index.groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT node_id, 'scan' AS source FROM {nodes} WHERE contains(lower(name), 'tion_1')")
def h07_hybrid(t):
    return S.hybrid(S.build_index(t.nodes, "node_id", "name", "nodes"), t.nodes, ["tion_1"])
