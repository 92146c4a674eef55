"""Queries of joins (J)."""

from pyspark.sql import functions as F

from lodestone.operators import relations as R
from lodestone.registry import query


@query("SELECT e.edge_id, n.name FROM {edges} e JOIN {nodes} n ON n.node_id = e.dst AND n.graph_id = e.graph_id WHERE e.edge_type = 'imports'")
def j01_edges_with_targets(t):
    n = t.nodes.select(F.col("node_id").alias("dst"), "graph_id", "name")
    return t.edges.where("edge_type = 'imports'").join(n, ["dst", "graph_id"]).select("edge_id", "name")


@query("SELECT DISTINCT n.node_id, n.name FROM {nodes} n JOIN {edges} e ON e.src = n.node_id JOIN {nodes} m ON m.node_id = e.dst WHERE ends_with(m.path, 'NATION_3') AND NOT ends_with(n.path, 'NATION_3')")
def j02_consumers_of(t):
    return R.consumers(t.edges, t.nodes, "NATION_3").select("node_id", "name")


@query("""SELECT path, direction, edge_type FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, edge_id) AS k FROM (
  SELECT n.path, 'outbound' AS direction, 0 AS rank, e.edge_type, e.edge_id FROM {edges} e JOIN {nodes} n ON n.node_id = e.dst WHERE e.src = 11 AND e.dst <> 11
  UNION ALL SELECT n.path, 'inbound', 1, e.edge_type, e.edge_id FROM {edges} e JOIN {nodes} n ON n.node_id = e.src WHERE e.dst = 11 AND e.src <> 11)) WHERE k = 1""")
def j03_related_files(t):
    return R.related(t.edges, t.nodes, 11)


@query("SELECT e.edge_id FROM {edges} e JOIN {nodes} a ON a.node_id = e.src JOIN {nodes} b ON b.node_id = e.dst WHERE (starts_with(a.path, 'g/nation') OR starts_with(a.path, 'g/region')) AND (starts_with(b.path, 'g/nation') OR starts_with(b.path, 'g/region'))")
def j04_directory_subgraph(t):
    ids = t.nodes.where(F.col("path").startswith("g/nation") | F.col("path").startswith("g/region"))
    return R.induced(t.edges, ids).select("edge_id")


@query("SELECT edge_id, src FROM {edges} WHERE src IN (SELECT c_custkey * 8 + 2 FROM {customer} WHERE c_acctbal < 0)")
def j05_edges_in_list(t):
    ids = t.customer.where("c_acctbal < 0").select((F.col("c_custkey") * 8 + 2).alias("src"))
    return t.edges.join(ids, "src", "left_semi").select("edge_id", "src")


PROBE = """SELECT c.source AS importer, c.specifier, r.filepath AS target FROM {connections} c
  LEFT JOIN {registry} r ON r.filepath = 'src/' || substr(c.specifier, 7) || '.js' AND starts_with(c.specifier, '../../')"""


@query(f"SELECT importer, specifier, target FROM ({PROBE})")
def j06_resolve_imports(t):
    # specifiers of this table that start with ../ name files one directory up, where none lie
    asked = t.connections.select(F.substring_index("source", "||", 1).alias("importer"), "specifier", "source")
    return R.resolve_imports(asked, t.registry).select(F.col("source").alias("importer"), "specifier", "target")


@query(f"SELECT importer, target, count(*) AS n, max(specifier) AS specifier FROM ({PROBE}) WHERE target IS NOT NULL GROUP BY importer, target")
def j07_wire_connections(t):
    asked = t.connections.select(F.substring_index("source", "||", 1).alias("importer"), "specifier", "source")
    found = R.resolve_imports(asked, t.registry).where("target is not null")
    return found.groupBy(F.col("source").alias("importer"), "target").agg(F.count("*").alias("n"), F.max("specifier").alias("specifier"))


@query("SELECT c.target, array_to_string(list_sort(list_distinct(list(coalesce(r.filepath, c.source)))), ',') AS importers FROM {connections} c LEFT JOIN {registry} r ON r.fingerprint = c.source GROUP BY c.target")
def j08_imported_by(t):
    return R.imported_by(t.connections, t.registry).withColumn("importers", F.array_join("importers", ","))


@query("SELECT c.source, c.specifier, max(r.filepath) AS target_path FROM {connections} c LEFT JOIN {registry} r ON r.fingerprint = c.target GROUP BY c.source, c.specifier")
def j09_target_paths(t):
    names = t.registry.select(F.col("fingerprint").alias("target"), "filepath")
    return t.connections.join(names, "target", "left").groupBy("source", "specifier").agg(F.max("filepath").alias("target_path"))


@query("SELECT r.filepath, coalesce(l.quality, -1) AS quality, coalesce(i.purpose, 'RED') AS purpose FROM {registry} r LEFT JOIN {labels} l ON l.doc_id = r.doc_id LEFT JOIN {intents} i USING (fingerprint)")
def j10_classification_merge(t):
    both = t.registry.select("doc_id", "filepath", "fingerprint").join(t.labels, "doc_id", "left").join(t.intents, "fingerprint", "left")
    return both.select("filepath", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("purpose", F.lit("RED")).alias("purpose"))


@query("""SELECT name, path, export_path FROM (SELECT w.name, w.path, x.path AS export_path, row_number() OVER (PARTITION BY w.name, w.path ORDER BY CASE WHEN x.path = w.path THEN 0 ELSE 1 END, x.ordinal) AS k
  FROM (SELECT p_name AS name, min(p_brand) AS path FROM {part} GROUP BY p_name) w LEFT JOIN (SELECT p_name AS name, p_brand AS path, p_partkey AS ordinal FROM {part} WHERE p_size > 10) x ON x.name = w.name) WHERE k = 1""")
def j11_export_match(t):
    wanted = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("path"))
    exports = t.part.where("p_size > 10").select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("ordinal"))
    return R.best_export(wanted, exports).select("name", "path", "export_path")


@query("""SELECT 'contains' AS kind, a.node_id AS src, b.node_id AS dst FROM {nodes} a JOIN {nodes} b ON a.node_type = 'type' AND b.node_type = 'route' JOIN {nation} n ON n.n_name = b.name JOIN {region} r ON r.r_regionkey = n.n_regionkey AND r.r_name = a.name
  UNION ALL SELECT 'invokes', s.s_suppkey * 8 + 5, CAST(s.s_nationkey AS BIGINT) * 8 + 3 FROM {supplier} s""")
def j12_edge_building(t):
    regions, routes = (t.nodes.where(F.col("node_type") == k).select("node_id", "name") for k in ("type", "route"))
    pairs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    contains = pairs.join(regions.select(F.col("node_id").alias("src"), F.col("name").alias("r_name")), "r_name").join(routes.select(F.col("node_id").alias("dst"), F.col("name").alias("n_name")), "n_name")
    invokes = t.supplier.select(F.lit("invokes").alias("kind"), (F.col("s_suppkey") * 8 + 5).alias("src"), (F.col("s_nationkey").cast("long") * 8 + 3).alias("dst"))
    return contains.select(F.lit("contains").alias("kind"), "src", "dst").unionByName(invokes)


@query("SELECT r.filepath, coalesce(i.purpose, '(not set)') AS purpose, coalesce(i.worth, '') AS worth FROM {registry} r LEFT JOIN {intents} i USING (fingerprint)")
def j13_intent_join(t):
    both = t.registry.select("filepath", "fingerprint").join(t.intents, "fingerprint", "left")
    return both.select("filepath", F.coalesce("purpose", F.lit("(not set)")).alias("purpose"), F.coalesce("worth", F.lit("")).alias("worth"))


@query("SELECT edge_id, src FROM {edges} WHERE edge_type = 'contains' AND dst IN (SELECT node_id FROM {nodes} WHERE name = 'ASIA')")
def j14_imports_by_symbol(t):
    ids = t.nodes.where("name = 'ASIA'").select(F.col("node_id").alias("dst"))
    return t.edges.where("edge_type = 'contains'").join(ids, "dst", "left_semi").select("edge_id", "src")


@query("SELECT DISTINCT e.src AS node_id FROM {edges} e JOIN {nodes} n ON n.node_id = e.dst WHERE ends_with(n.path, 'NATION_5') AND e.src <> e.dst")
def j15_consumers_in_memory(t):
    return R.consumers(t.edges, t.nodes, "NATION_5").select("node_id")


@query("""SELECT e.edge_id, 'out' AS direction, n.path AS other_path, coalesce(e.status, 'SAFE') AS status, CAST(coalesce(e.confidence, 1.0) AS DOUBLE) AS confidence FROM {edges} e LEFT JOIN {nodes} n ON n.node_id = e.dst WHERE e.src = 10
  UNION ALL SELECT e.edge_id, 'in', n.path, coalesce(e.status, 'SAFE'), CAST(coalesce(e.confidence, 1.0) AS DOUBLE) FROM {edges} e LEFT JOIN {nodes} n ON n.node_id = e.src WHERE e.dst = 10""")
def j16_file_flows(t):
    return R.file_flows(t.edges, t.nodes, 10)


@query("""SELECT e.edge_id, a.path AS src_path, b.path AS dst_path, CASE WHEN starts_with(a.path, 'g/nation/') AND starts_with(b.path, 'g/nation/') THEN 'INTERNAL' WHEN starts_with(a.path, 'g/nation/') THEN 'OUT' ELSE 'IN' END AS flow
  FROM {edges} e LEFT JOIN {nodes} a ON a.node_id = e.src LEFT JOIN {nodes} b ON b.node_id = e.dst WHERE starts_with(a.path, 'g/nation/') OR starts_with(b.path, 'g/nation/')""")
def j17_boundary_flows(t):
    return R.boundary(t.edges, t.nodes, F.col("path").startswith("g/nation/")).select("edge_id", "src_path", "dst_path", "flow")


@query("SELECT DISTINCT w.name FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM {part}) w WHERE w.name NOT IN (SELECT split_part(p_name, ' ', 1) FROM {part})")
def j18_named_imports_missing(t):
    names = t.part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    exports = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).distinct()
    return names.join(exports, "name", "left_anti")


@query("SELECT 'undeclared' AS issue, p_brand AS name FROM {part} WHERE p_size > 45 AND p_brand NOT IN (SELECT p_brand FROM {part} WHERE p_size < 3) GROUP BY p_brand UNION ALL SELECT 'unused', p_brand FROM {part} WHERE p_size < 3 AND p_brand NOT IN (SELECT p_brand FROM {part} WHERE p_size > 45) GROUP BY p_brand UNION ALL SELECT 'total', CAST(count(DISTINCT p_brand) AS STRING) FROM {part}")
def j19_command_cross_reference(t):
    a, b = (t.part.where(w).select(F.col("p_brand").alias("name")).distinct() for w in ("p_size > 45", "p_size < 3"))
    total = t.part.agg(F.count_distinct("p_brand").cast("string").alias("name")).select(F.lit("total").alias("issue"), "name")
    return a.join(b, "name", "left_anti").select(F.lit("undeclared").alias("issue"), "name").unionByName(b.join(a, "name", "left_anti").select(F.lit("unused").alias("issue"), "name")).unionByName(total)


@query("SELECT source, target FROM {connections} WHERE target NOT IN (SELECT fingerprint FROM {intents})")
def j20_orphan_imports(t):
    cards = t.intents.select(F.col("fingerprint").alias("target"))
    return t.connections.join(cards, "target", "left_anti").select("source", "target")


@query("SELECT m.module, count(n.node_id) AS found FROM (SELECT unnest(['file', 'store', 'route', 'type', 'component', 'command']) AS module) m LEFT JOIN {nodes} n ON n.node_type = m.module GROUP BY m.module")
def j21_endpoint_presence(t):
    wanted = t.spark.createDataFrame([(x,) for x in ("file", "store", "route", "type", "component", "command")], "module string")
    counts = t.nodes.groupBy(F.col("node_type").alias("module")).agg(F.count("*").alias("found"))
    return wanted.join(counts, "module", "left").select("module", F.coalesce("found", F.lit(0)).alias("found"))


@query("SELECT m.id, p.id AS provider_id FROM {tickets} m LEFT JOIN {providers} p ON p.name = m.claimed_by WHERE m.claimed_by IS NOT NULL")
def j22_fk_lookup(t):
    p = t.providers.select(F.col("id").alias("provider_id"), F.col("name").alias("claimed_by"))
    return t.tickets.where("claimed_by is not null").join(p, "claimed_by", "left").select("id", "provider_id")


@query("SELECT c.source_id, min(r.doc_id) AS target_id FROM {connections} c JOIN {registry} r ON c.specifier = '../' || r.filename OR c.specifier = r.filepath GROUP BY c.source_id")
def j23_viewer_links(t):
    # the disjunction as two equi-joins; the first match of a source is its smallest
    by_name = t.connections.join(t.registry.select("doc_id", F.concat(F.lit("../"), "filename").alias("specifier")), "specifier")
    by_path = t.connections.join(t.registry.select("doc_id", F.col("filepath").alias("specifier")), "specifier")
    return by_name.select("source_id", "doc_id").unionByName(by_path.select("source_id", "doc_id")).groupBy("source_id").agg(F.min("doc_id").alias("target_id"))


@query("""SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN a.name IS NULL THEN 'new' ELSE 'changed' END AS change
  FROM (SELECT p_name || p_brand AS name, max(p_type) AS signature FROM {part} WHERE p_size < 30 GROUP BY 1) a FULL JOIN (SELECT p_name || p_brand AS name, max(p_type) AS signature FROM {part} WHERE p_size > 20 GROUP BY 1) b ON a.name = b.name
  WHERE a.name IS NULL OR b.name IS NULL OR a.signature <> b.signature""")
def j24_breaking_changes(t):
    old, new = (t.part.where(w).groupBy(F.concat("p_name", "p_brand").alias("name")).agg(F.max("p_type").alias("signature")) for w in ("p_size < 30", "p_size > 20"))
    return R.breaking_changes(old, new)


@query("SELECT a.filepath, count(c.source) AS imports, count(b.fingerprint) AS known FROM {registry} a LEFT JOIN {connections} c ON c.source = a.fingerprint LEFT JOIN {registry} b ON b.fingerprint = c.target GROUP BY a.filepath")
def j25_relationships(t):
    out = t.connections.join(t.registry.select(F.col("fingerprint").alias("target"), F.lit(1).alias("hit")), "target", "left").groupBy("source").agg(F.count("*").alias("imports"), F.count("hit").alias("known"))
    both = t.registry.select("filepath", F.col("fingerprint").alias("source")).join(out, "source", "left")
    return both.select("filepath", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("known", F.lit(0)).alias("known"))


@query(f"SELECT importer, specifier FROM ({PROBE}) WHERE target IS NULL")
def j26_missing_imports(t):
    asked = t.connections.select(F.substring_index("source", "||", 1).alias("importer"), "specifier", "source")
    return R.resolve_imports(asked, t.registry).where("target is null").select(F.col("source").alias("importer"), "specifier")
