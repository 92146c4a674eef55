"""Queries of filters (F), rankings (W) and sorts and sets (O)."""

from pyspark.sql import functions as F

from lodestone.operators import lookups as L
from lodestone.registry import query

ROOT = "src/src0/en/f0.js"


@query("SELECT filepath, fingerprint, reach FROM {registry} WHERE status = 'GREEN' ORDER BY filepath")
def f01_files_by_status(t):
    return L.by_value(t.registry, "status", "GREEN").select("filepath", "fingerprint", "reach").orderBy("filepath")


@query("SELECT filepath, fingerprint, birth FROM (SELECT *, row_number() OVER (ORDER BY birth DESC, fingerprint DESC) AS k FROM {versions} WHERE filepath = 'conv/0.md') WHERE k = 1")
def f02_file_by_path(t):
    return L.by_value(t.versions, "filepath", "conv/0.md").orderBy(F.desc("birth"), F.desc("fingerprint")).limit(1).select("filepath", "fingerprint", "birth")


@query("SELECT filepath, fingerprint, birth FROM {versions} WHERE filepath = 'conv/0.md' ORDER BY birth DESC")
def f03_all_files_by_path(t):
    return L.by_value(t.versions, "filepath", "conv/0.md").select("filepath", "fingerprint", "birth").orderBy(F.desc("birth"))


@query("SELECT c.source, c.target, c.kind FROM {connections} c WHERE c.source_id = 1 OR c.target_id = 1")
def f04_connections_for_file(t):
    return L.touching(t.connections, 1, "source_id", "target_id").select("source", "target", "kind")


@query("SELECT id, title, fingerprint FROM {tickets} WHERE resolved IS NULL ORDER BY created DESC, id DESC LIMIT 200")
def f05_open_tickets(t):
    return L.page(t.tickets.where(F.col("resolved").isNull()), [F.desc("created"), F.desc("id")], 200).select("id", "title", "fingerprint")


@query("SELECT filepath, sessions FROM {registry} WHERE sessions >= 5 AND lifecycle = 'active'")
def f06_stale_files(t):
    return t.registry.where((F.col("sessions") >= 5) & (F.col("lifecycle") == "active")).select("filepath", "sessions")


@query("SELECT filepath, status FROM {registry} WHERE needs_review ORDER BY filepath")
def f07_needs_ai_review(t):
    return t.registry.where("needs_review").select("filepath", "status").orderBy("filepath")


@query("SELECT fingerprint, coalesce(purpose, '') AS purpose, coalesce(worth, '') AS worth FROM {intents}")
def f08_all_intents(t):
    return t.intents.na.fill("", ["purpose", "worth"])


@query("SELECT filepath, birth, role, length(text) AS chars FROM {versions} WHERE filepath = 'conv/1.md' ORDER BY birth DESC")
def f09_ai_content(t):
    return L.by_value(t.versions, "filepath", "conv/1.md").select("filepath", "birth", "role", F.length("text").cast("long").alias("chars")).orderBy(F.desc("birth"))


@query("SELECT id, name, kind FROM {providers} WHERE active ORDER BY name")
def f10_active_providers(t):
    return t.providers.where("active").select("id", "name", "kind").orderBy("name")


@query("SELECT id, kind, actor FROM {mutations} WHERE fingerprint = 'u8' ORDER BY ts DESC, id DESC LIMIT 50")
def f11_mutation_log(t):
    return L.page(L.by_value(t.mutations, "fingerprint", "u8"), [F.desc("ts"), F.desc("id")], 50).select("id", "kind", "actor")


@query("SELECT id, fingerprint, kind FROM {mutations} ORDER BY ts DESC, id DESC LIMIT 100")
def f12_recent_activity(t):
    return L.page(t.mutations, [F.desc("ts"), F.desc("id")], 100).select("id", "fingerprint", "kind")


@query("SELECT category, count(*) AS n, count(TRY_CAST(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.k') AS BIGINT)) AS parsed, string_agg(name, ',' ORDER BY name) AS names FROM {settings} GROUP BY category")
def f13_settings_by_category(t):
    k = F.get_json_object("value", "$.k").try_cast("long")
    return t.settings.groupBy("category").agg(F.count("*").alias("n"), F.count(k).alias("parsed"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("SELECT fingerprint, purpose IS NULL OR trim(purpose) = '' OR worth IS NULL OR worth = '' AS unfilled FROM {intents}")
def f14_template_unfilled(t):
    values = F.map_values(F.create_map(F.lit("purpose"), F.trim("purpose"), F.lit("worth"), F.col("worth")))
    return t.intents.select("fingerprint", F.exists(values, lambda x: x.isNull() | (x == "")).alias("unfilled"))


@query("SELECT id, name, balance FROM {providers} ORDER BY balance DESC, id")
def f15_prd_projects(t):
    return t.providers.select("id", "name", "balance").orderBy(F.desc("balance"), "id")


@query("SELECT id, file_id, severity FROM {insights} WHERE category = 'error' AND project_id = 'p3' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 20")
def f16_query_insights(t):
    found = L.matching(t.insights, category="error", project_id="p3", severity=None, file_id=None)
    return L.page(found, [F.desc("ts"), F.desc("id")], 50, 20).select("id", "file_id", "severity")


@query("SELECT id, pass_number, severity FROM {insights} WHERE file_id = 'f7' ORDER BY pass_number, ts, id")
def f17_insights_for_file(t):
    return L.matching(t.insights, file_id="f7").select("id", "pass_number", "severity", "ts").orderBy("pass_number", "ts", "id").drop("ts")


@query("SELECT id, project_id, file_id FROM {insights} WHERE category = 'click' ORDER BY ts DESC, id DESC")
def f18_insights_by_category(t):
    return L.matching(t.insights, category="click", project_id=None).orderBy(F.desc("ts"), F.desc("id")).select("id", "project_id", "file_id")


@query("SELECT project_id, file_id, count(*) AS total, max(pass_number) AS last_pass FROM {insights} WHERE project_id = 'p1' GROUP BY project_id, file_id")
def f19_file_slots(t):
    return L.matching(t.insights, project_id="p1").groupBy("project_id", "file_id").agg(F.count("*").alias("total"), F.max("pass_number").alias("last_pass"))


@query("SELECT node_id, name FROM {nodes} WHERE graph_id = 'g1' AND name ILIKE '%er_1%' ORDER BY name, node_id LIMIT 20")
def f20_search_symbols(t):
    return L.page(t.nodes.where((F.col("graph_id") == "g1") & L.like(F.col("name"), "er_1")), [F.asc("name"), F.asc("node_id")], 20).select("node_id", "name")


@query("SELECT DISTINCT name FROM {nodes} WHERE name ILIKE 'customer#%' ORDER BY name LIMIT 15")
def f21_suggest_prefix(t):
    return t.nodes.where(F.col("name").ilike("customer#%")).select("name").distinct().orderBy("name").limit(15)


@query("SELECT node_id, name, node_type FROM {nodes} WHERE node_id IN (SELECT dst FROM {edges} WHERE edge_type = 'contains')")
def f22_symbol_details(t):
    ids = t.edges.where("edge_type = 'contains'").select(F.col("dst").alias("node_id")).distinct()
    return t.nodes.join(ids, "node_id", "left_semi").select("node_id", "name", "node_type")


@query("SELECT node_id, path FROM {nodes} WHERE path = 'g/order/O' OR starts_with(path, 'g/order/O/')")
def f23_paths_in_directory(t):
    return t.nodes.where(L.in_directory(F.col("path"), "g/order/O")).select("node_id", "path")


@query("SELECT node_id FROM {nodes} WHERE lower(path) = lower('G/Region/ASIA') OR ends_with(lower(path), lower('/Asia'))")
def f24_path_equality(t):
    p = F.lower("path")
    return t.nodes.where((p == "g/region/asia") | p.endswith("/asia")).select("node_id")


@query("SELECT filepath, status FROM {registry} WHERE status IN ('RED', 'YELLOW')")
def f25_isolation_filter(t):
    return t.registry.where(F.col("status").isin("RED", "YELLOW")).select("filepath", "status")


@query("SELECT graph_id, EXISTS (SELECT 1 FROM {nodes} n WHERE n.graph_id = g.graph_id) AS known FROM (SELECT unnest(['g1', 'g2', 'g9']) AS graph_id) g")
def f26_validate_graph(t):
    asked = t.spark.createDataFrame([("g1",), ("g2",), ("g9",)], "graph_id string")
    known = t.nodes.select("graph_id").distinct().withColumn("known", F.lit(True))
    return asked.join(known, "graph_id", "left").select("graph_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT specifier, count(*) AS n, starts_with(specifier, '.') AS relative FROM {connections} GROUP BY specifier")
def f27_specifier_kinds(t):
    return t.connections.groupBy("specifier").agg(F.count("*").alias("n")).withColumn("relative", F.col("specifier").startswith("."))


@query("SELECT dir, count(*) AS files, coalesce(CAST(sum(CASE WHEN status = 'GREEN' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1.0) AS health, sum(CASE status WHEN 'GREEN' THEN 1.0 WHEN 'YELLOW' THEN 0.5 ELSE 0.0 END)::DOUBLE AS points FROM {registry} GROUP BY dir")
def f28_project_health(t):
    points = F.when(F.col("status") == "GREEN", 1.0).when(F.col("status") == "YELLOW", 0.5).otherwise(0.0)
    return t.registry.groupBy("dir").agg(F.count("*").alias("files"), (F.count_if(F.col("status") == "GREEN") / F.count("*")).alias("health"), F.sum(points).alias("points"))


@query("SELECT node_id, name FROM (SELECT *, row_number() OVER (ORDER BY node_id) AS k FROM {nodes} WHERE name = 'ASIA' OR contains(path, 'ASIA')) WHERE k = 1")
def f31_node_lookup(t):
    return t.nodes.where((F.col("name") == "ASIA") | F.col("path").contains("ASIA")).orderBy("node_id").limit(1).select("node_id", "name")


@query("SELECT doc_id FROM {documents} WHERE contains(text, 'token')")
def f32_content_filter(t):
    return t.documents.where(F.col("text").contains("token")).select("doc_id")


@query("SELECT filepath, fingerprint, birth FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY birth DESC, fingerprint DESC) AS k FROM {versions}) WHERE k = 1")
def w01_newest_identity(t):
    return L.newest(t.versions.select("filepath", "fingerprint", "birth"), ["filepath"], F.col("birth"), F.col("fingerprint"))


@query("SELECT count(*) AS files, sum(birth) AS births FROM (SELECT filepath, max(birth) AS birth FROM {versions} GROUP BY filepath)")
def w02_newest_identity_totals(t):
    return L.newest(t.versions.select("filepath", "birth"), ["filepath"], F.col("birth")).agg(F.count("*").alias("files"), F.sum("birth").alias("births"))


@query("SELECT fingerprint, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, id DESC) AS k FROM {mutations}) WHERE k = 1")
def w03_latest_mutation(t):
    return L.newest(t.mutations, ["fingerprint"], F.col("ts"), F.col("id")).select("fingerprint", "id", "kind")


@query("SELECT filepath, birth FROM (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY birth DESC) AS k FROM {versions}) WHERE k <= 3")
def w04_keep_newest_n(t):
    return L.first_n(t.versions.select("filepath", "birth"), ["filepath"], [F.desc("birth")], 3)


@query("SELECT dir, filepath FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY doc_id) AS k FROM {registry}) WHERE k = 1")
def w05_first_match(t):
    first = t.registry.groupBy("dir").agg(F.min_by("filepath", "doc_id").alias("filepath"))
    return first


@query("SELECT filepath, CASE WHEN filename LIKE 'f1%' THEN 'entry' WHEN filename LIKE '%0.js' THEN 'round' WHEN dir = 'src0' THEN 'root' ELSE 'other' END AS intent FROM {registry}")
def w06_first_rule_wins(t):
    rules = [(F.col("filename").like("f1%"), "entry"), (F.col("filename").like("%0.js"), "round"), (F.col("dir") == "src0", "root")]
    chain = F
    for when, name in rules:
        chain = chain.when(when, name)
    return t.registry.select("filepath", chain.otherwise("other").alias("intent"))


@query("SELECT phase, filepath, row_number() OVER (PARTITION BY phase ORDER BY impact DESC, filepath) AS step FROM {registry}")
def w07_step_numbers(t):
    from pyspark.sql import Window

    return t.registry.select("phase", "filepath", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("impact"), "filepath")).cast("long").alias("step"))


@query("SELECT dir, string_agg(filename, ',' ORDER BY impact, filename) AS breaks FROM {registry} WHERE status = 'YELLOW' GROUP BY dir")
def w08_break_points_by_cost(t):
    costs = F.array_sort(F.collect_list(F.struct("impact", "filename")))
    return t.registry.where("status = 'YELLOW'").groupBy("dir").agg(F.array_join(F.transform(costs, lambda x: x["filename"]), ",").alias("breaks"))


@query("SELECT id, title FROM {tickets} ORDER BY created DESC, id DESC LIMIT 50")
def o01_top_k(t):
    return L.page(t.tickets, [F.desc("created"), F.desc("id")], 50).select("id", "title")


@query("SELECT id FROM {insights} ORDER BY id OFFSET 9000")
def o02_offset_alone(t):
    return L.page(t.insights, [F.asc("id")], None, 9000).select("id")


@query("SELECT dir, count(*) AS n, array_to_string(list_slice(list(filename ORDER BY filename), 1, 5), ',') AS shown, greatest(count(*) - 5, 0) AS more FROM {registry} GROUP BY dir")
def o03_display_truncation(t):
    names = t.registry.groupBy("dir").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("filename")).alias("_names"))
    return names.select("dir", "n", F.array_join(F.slice("_names", 1, 5), ",").alias("shown"), F.greatest(F.col("n") - 5, F.lit(0)).alias("more"))


@query("SELECT name, row_number() OVER (ORDER BY lower(name), name) AS place FROM {nodes} WHERE node_type <> 'file' ORDER BY 2")
def o04_name_order(t):
    from pyspark.sql import Window

    # one ordered report of names: the rank of a row needs all rows before it
    named = t.nodes.where("node_type <> 'file'").select("name")
    return named.select("name", F.row_number().over(Window.orderBy(F.lower("name"), "name")).cast("long").alias("place"))


@query("SELECT r.fingerprint FROM {registry} r WHERE NOT EXISTS (SELECT 1 FROM {intents} i WHERE i.fingerprint = r.fingerprint)")
def o05_prune_not_in(t):
    return L.difference(t.registry, t.intents, "fingerprint").select("fingerprint")


SNAPSHOTS = """
  SELECT coalesce(a.k, b.k) AS filepath, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN array_to_string([x for x in [CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.impact IS DISTINCT FROM b.impact THEN 'impact' END] if x IS NOT NULL], ',') END AS fields
  FROM (SELECT filepath AS k, status, impact FROM {registry} WHERE sessions < 10) a
  FULL JOIN (SELECT filepath AS k, CASE WHEN phase = 'LOCKED' THEN 'GREEN' ELSE status END AS status, CASE WHEN dir = 'src3' THEN impact + 1 ELSE impact END AS impact FROM {registry} WHERE sessions > 0) b ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.status IS DISTINCT FROM b.status OR a.impact IS DISTINCT FROM b.impact"""


@query(SNAPSHOTS)
def o06_manifest_diff(t):
    old = t.registry.where("sessions < 10")
    new = t.registry.where("sessions > 0").withColumns({"status": F.when(F.col("phase") == "LOCKED", "GREEN").otherwise(F.col("status")), "impact": F.when(F.col("dir") == "src3", F.col("impact") + 1).otherwise(F.col("impact"))})
    return L.snapshot_diff(old, new, "filepath", ["status", "impact"])


@query("SELECT r.fingerprint, array_to_string([x for x in [CASE WHEN r.status IS DISTINCT FROM 'GREEN' THEN 'status' END, CASE WHEN i.worth IS DISTINCT FROM ('value ' || r.status) THEN 'worth' END] if x IS NOT NULL], ',') AS drift FROM {registry} r JOIN {intents} i USING (fingerprint)")
def o07_card_drift(t):
    both = t.registry.join(t.intents, "fingerprint").select("fingerprint", F.struct("status", "worth").alias("card"), F.struct(F.lit("GREEN").alias("status"), F.concat(F.lit("value "), "status").alias("worth")).alias("want"))
    return both.select("fingerprint", F.array_join(L.changed_fields("card", "want", ["status", "worth"]), ",").alias("drift"))


@query("SELECT kind, specifier, min(source_id) AS source_id FROM {connections} GROUP BY kind, specifier")
def o09_import_dedup(t):
    return t.connections.groupBy("kind", "specifier").agg(F.min("source_id").alias("source_id"))


@query("SELECT concat(source, ':', kind) AS key, count(*) AS n FROM {connections} GROUP BY 1")
def o10_dedup_key(t):
    return t.connections.groupBy(F.concat_ws(":", "source", "kind").alias("key")).agg(F.count("*").alias("n"))


@query("SELECT node_id, min(origin) AS origin FROM (SELECT node_id, 1 AS origin FROM {nodes} UNION ALL SELECT dst, 2 FROM {edges} UNION ALL SELECT src, 3 FROM {edges}) GROUP BY node_id")
def o11_union_distinct(t):
    every = t.nodes.select("node_id", F.lit(1).alias("origin")).unionByName(t.edges.select(F.col("dst").alias("node_id"), F.lit(2).alias("origin"))).unionByName(t.edges.select(F.col("src").alias("node_id"), F.lit(3).alias("origin")))
    return every.groupBy("node_id").agg(F.min("origin").alias("origin"))


@query("SELECT 'missing' AS issue, r.fingerprint FROM {registry} r WHERE r.fingerprint NOT IN (SELECT fingerprint FROM {intents}) UNION ALL SELECT 'orphan', c.target FROM (SELECT DISTINCT target FROM {connections}) c WHERE c.target NOT IN (SELECT fingerprint FROM {registry})")
def o12_containment_checks(t):
    missing = L.difference(t.registry, t.intents, "fingerprint").select(F.lit("missing").alias("issue"), "fingerprint")
    targets = t.connections.select(F.col("target").alias("fingerprint")).distinct()
    return missing.unionByName(L.difference(targets, t.registry, "fingerprint").select(F.lit("orphan").alias("issue"), "fingerprint"))


@query("SELECT DISTINCT ref FROM (SELECT unnest(regexp_extract_all(html, 'href=\"(/[^\"]+)\"', 1)) AS ref FROM {links}) WHERE NOT starts_with(ref, '/api/')")
def o13_report_refs(t):
    refs = t.links.select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))).alias("ref")).distinct()
    return refs.where(~F.col("ref").startswith("/api/"))


@query("SELECT c.source, c.target, 'target missing' AS problem FROM {connections} c WHERE c.target NOT IN (SELECT fingerprint FROM {registry}) UNION ALL SELECT c.source, c.target, 'source missing' FROM {connections} c WHERE c.source NOT IN (SELECT fingerprint FROM {registry})")
def o14_dangling_edges(t):
    known = t.registry.select("fingerprint")
    found = []
    for end in ("target", "source"):
        found.append(t.connections.join(known.withColumnRenamed("fingerprint", end), end, "left_anti").select("source", "target", F.lit(f"{end} missing").alias("problem")))
    return found[0].unionByName(found[1])


@query("SELECT target AS fingerprint FROM {connections} WHERE NOT regexp_matches(target, '^[^|]+\\|\\|.+2026') GROUP BY target")
def o15_fingerprint_format(t):
    return t.connections.select(F.col("target").alias("fingerprint")).distinct().where(~F.col("fingerprint").rlike(r"^[^|]+\|\|.+2026"))


@query("SELECT dir, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT phase), list(DISTINCT lifecycle)))), ',') AS tags FROM {registry} GROUP BY dir")
def o16_array_union(t):
    sets = t.registry.groupBy("dir").agg(F.collect_set("phase").alias("a"), F.collect_set("lifecycle").alias("b"))
    return sets.select("dir", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("tags"))


@query("SELECT filepath, count(DISTINCT fingerprint) AS identities FROM {versions} GROUP BY filepath HAVING count(DISTINCT fingerprint) > 1")
def o18_stale_accumulation(t):
    return t.versions.groupBy("filepath").agg(F.count_distinct("fingerprint").alias("identities")).where("identities > 1")
