"""Graph operators over nodes (node_id, ...) and edges (src, dst).

Closures with depths are frontier loops: a round joins the frontier with the edges, drops what was seen, and cuts the lineage; the
number of rounds is the depth of the graph, the size of a round that of its frontier. Where depths do not count (scopes, levels, critical paths, sizes of
impact) nodes are eliminated instead, in few rounds (flow.py). Strongly connected components are found
per weak component, by Tarjan's algorithm where a component has at most LOCAL_EDGES edges (checked), else around a pivot, in the
cluster. Every frame that a loop joins again is written and read back, so that its estimated size is its real one.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.operators.flow import CYCLIC, LOCAL_EDGES, flow, reached
from lodestone.operators.lineage import settled



def simple_edges(edges: DataFrame) -> DataFrame:
    """Without self-loops; parallel edges stay."""
    return edges.where(F.col("src") != F.col("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with indegree and outdegree (self-loops do not count)."""
    e = simple_edges(edges)
    into = e.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("indegree"))
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("outdegree"))
    return nodes.join(into, "node_id", "left").join(out, "node_id", "left").na.fill(0, ["indegree", "outdegree"])


def dead_imports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, name of the import nodes without an edge out."""
    return nodes.where(F.col("node_type") == "import").join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id", "name")


def on_cycles(edges: DataFrame) -> DataFrame:
    """node_id of the nodes on a cycle; a self-loop is one."""
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node_id"))
    return strong_components(edges).select("node_id").unionByName(loops).distinct()


def health(nodes: DataFrame, edges: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """nodes with degrees and health: broken (listed in broken, or an import of the name of one that leads nowhere), unused (a file without
    edges), partial (not a file, and without consumers), else healthy."""
    d = degrees(nodes, edges)
    listed = F.lit(False)
    if broken is not None:
        d = d.join(broken.select("node_id", F.lit(True).alias("_broken")), "node_id", "left")
        listed = F.coalesce("_broken", F.lit(False))
    dead = dead_imports(nodes, edges).select("name", F.lit(True).alias("_dead")).distinct()
    d = d.join(dead, "name", "left")
    gone = (F.col("node_type") == "import") & F.coalesce("_dead", F.lit(False))
    file = F.col("node_type") == "file"
    state = F.when(listed | gone, "broken").when(file & (F.col("indegree") + F.col("outdegree") == 0), "unused").when(~file & (F.col("indegree") == 0), "partial").otherwise("healthy")
    return d.withColumn("health", state).drop("_broken", "_dead")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at neither end of any edge; a self-loop counts as an edge."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "node_id", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame, outbound: bool = True, depth: int | None = None) -> DataFrame:
    """origin, node_id, depth of all nodes reachable from seeds (origin, node_id), the seeds at depth 0."""
    a, b = ("src", "dst") if outbound else ("dst", "src")
    steps = settled(simple_edges(edges).select(F.col(a).alias("node_id"), F.col(b).alias("next")).distinct())
    seen = frontier = settled(seeds.select("origin", "node_id").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while depth is None or level < depth:
        level += 1
        found = frontier.join(steps, "node_id").select("origin", F.col("next").alias("node_id")).distinct()
        frontier = settled(found.join(seen, ["origin", "node_id"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = settled(seen)
    return seen


def impact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, impact: how many other nodes reach it. The result of the closure is as large as the sum of all impacts."""
    closure = reach(edges, nodes.select(F.col("node_id").alias("origin"), "node_id"), outbound=True)
    counts = closure.where("depth > 0 and origin <> node_id").groupBy("node_id").agg(F.count("*").alias("impact"))
    return nodes.select("node_id").join(counts, "node_id", "left").na.fill(0, ["impact"])


def impact_estimate(edges: DataFrame, nodes: DataFrame, lg: int = 9) -> DataFrame:
    """node_id, impact: as impact(), a row a node at every step: exact up to 2^lg, beyond with a standard error of 2^(-lg / 2).

    Each strong component has the theta sketch of its members, and gets the union with those of all that reach it; the sketch of a set that is smaller
    than its bound is the set. Sketches flow along the condensation by elimination (flow()).
    """
    labels = settled(strong_components(edges).select("node_id", "scc"))
    members = settled(nodes.select("node_id").distinct().join(labels, "node_id", "left").select("node_id", F.coalesce("scc", "node_id").alias("scc")))
    own = members.groupBy(F.col("scc").alias("node_id")).agg(F.theta_sketch_agg("node_id", lg).alias("value"))
    e = condensation(edges, labels).select(F.col("to_scc").alias("src"), F.col("from_scc").alias("dst"), F.lit(0.0).alias("w"))
    sets = flow(e, own, lambda v: F.theta_union_agg(v, lg), lambda w, v: v, local_edges=0)
    sizes = sets.select(F.col("node_id").alias("scc"), (F.theta_sketch_estimate("value") - 1).alias("impact"))
    return members.join(sizes, "scc").select("node_id", "impact")


def impact_chain(edges: DataFrame, node_id: int, total: int) -> DataFrame:
    """direct (parallel edges count), cascading, ratio and severity of what depends on a node."""
    direct = simple_edges(edges).where(F.col("dst") == node_id).agg(F.count("*").alias("direct"))
    seed = edges.sparkSession.createDataFrame([(node_id, node_id)], "origin long, node_id long")
    further = reach(edges, seed, outbound=False).where("depth > 1").agg(F.count("*").alias("cascading"))
    both = direct.join(further).withColumn("ratio", (F.col("direct") + F.col("cascading")) / F.lit(max(1, total)))  # one row each
    n = F.col("direct") + F.col("cascading")
    return both.withColumn("severity", F.when((F.col("ratio") > 0.3) | (n > 10), "high").when((F.col("ratio") > 0.1) | (n > 3), "medium").otherwise("low"))


def _all_paths(steps: DataFrame, start: int, end: int, max_depth: int, most: int) -> DataFrame | None:
    """path of all simple paths, by steps (at, next, left: from next to the end), or None if a step makes more beginnings than most."""
    now = steps.sparkSession.createDataFrame([([start], start)], "path array<long>, at long")
    found = now.where(F.col("at") == end)
    for done in range(1, max_depth + 1):
        free = ~F.array_contains("path", F.col("next")) & (F.col("left") <= max_depth - done)
        now = settled(now.where(F.col("at") != end).join(steps, "at").where(free).select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")))
        n = now.count()
        if not n:
            break
        if n > most:
            return None
        found = found.unionByName(now.where(F.col("at") == end))
    return found


def find_paths(edges: DataFrame, start: int, end: int, max_depth: int = 10, max_results: int = 1000) -> DataFrame:
    """path (array), length of the first max_results simple paths from start to end, shortest first, then in order.

    Paths are sought length by length. A beginning of a path is followed only if the end is as near as the length leaves (distances to the end are
    found first), and of all beginnings only the first max_results: each may be a path. The others wait, and are taken up, the longest first, if those
    before them ended in nodes they had been at, and too few paths came of them. So no more than max_results beginnings are held at a time. Where beginnings
    are few at every step (at most ten times max_results), all are followed at once, with the same result.
    """
    spark = edges.sparkSession
    near = reach(edges, spark.createDataFrame([(end, end)], "origin long, node_id long"), outbound=False, depth=max_depth)
    near = near.groupBy("node_id").agg(F.min("depth").alias("left"))
    steps = settled(simple_edges(edges).select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct().join(near.withColumnRenamed("node_id", "next"), "next"))
    few = _all_paths(steps, start, end, max_depth, 10 * max_results)
    if few is not None:
        return few.select("path", (F.size("path") - 1).cast("long").alias("length")).orderBy("length", "path").limit(max_results)
    first = near.where(F.col("node_id") == start).select("left").collect()  # a row or none
    parts: list[DataFrame] = []
    n = 0
    for length in range(first[0][0] if first else max_depth + 1, max_depth + 1):
        waiting = [(0, spark.createDataFrame([([start], start)], "path array<long>, at long"))]
        while waiting and n < max_results:
            done, now = waiting.pop()
            while done < length:
                done += 1
                free = ~F.array_contains("path", F.col("next")) & (F.col("left") <= length - done) & ((F.col("next") != end) | F.lit(done == length))
                longer = settled(now.join(steps, "at").where(free).select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")))
                now = settled(longer.orderBy("path").limit(max_results))
                if longer.count() > max_results:
                    waiting.append((done, longer.join(now.select("path"), "path", "left_anti")))
                if now.isEmpty():
                    break
            else:
                parts.append(now)
                n += now.count()
    none = spark.createDataFrame([], "path array<long>, at long")
    found = functools.reduce(DataFrame.unionByName, parts, none)
    return found.select("path", (F.size("path") - 1).cast("long").alias("length")).orderBy("length", "path").limit(max_results)


def weak_components(edges: DataFrame) -> DataFrame:
    """node_id, root: the smallest node connected to it, in either direction."""
    return components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).toDF("node_id", "root")


def trimmed(edges: DataFrame, rounds: int = 4) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out: others are on no cycle."""
    e = settled(simple_edges(edges).select("src", "dst").distinct())
    n = e.count()
    for _ in range(rounds):
        kept = settled(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = kept.count()
        if m == n:
            return kept
        e, n = kept, m
    return e


def _tarjan(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest member of the component of each node."""
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    root: dict[int, int] = {}
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        on.discard(members[-1])
                        if members[-1] == node:
                            break
                    root.update(dict.fromkeys(members, min(members)))
    return root


def _pivoted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node_id, scc of the component of one node in each weak component, and the edges on which other components can be.

    edges: src, dst, root. The pivot of a weak component is the node with the most pairs of edges in and out, which is in the
    giant component if there is one. What it reaches and what reaches it is its component; an edge on another cycle has
    both ends on the same side of both.
    """
    out = edges.groupBy("root", F.col("src").alias("node_id")).agg(F.count("*").alias("o"))
    into = edges.groupBy("root", F.col("dst").alias("node_id")).agg(F.count("*").alias("i"))
    pivots = out.join(into, ["root", "node_id"]).groupBy("root").agg(F.max_by("node_id", F.struct(F.col("o") * F.col("i"), "node_id")).alias("node_id"))
    seeds = settled(pivots.select(F.col("root").alias("origin"), "node_id"))
    ahead, behind = (reach(edges, seeds, outbound=way).select("node_id", F.lit(True).alias(name)) for way, name in ((True, "ahead"), (False, "behind")))
    side = settled(ahead.join(behind, "node_id", "full_outer").na.fill(False))
    both = edges.select("src", "dst", "root").distinct()
    for end in ("src", "dst"):
        both = both.join(side.select(F.col("node_id").alias(end), F.struct("ahead", "behind").alias(f"{end}_side")), end, "left")
    none = F.struct(F.lit(False).alias("ahead"), F.lit(False).alias("behind"))
    sides = [F.coalesce(f"{end}_side", none) for end in ("src", "dst")]
    rest = both.where((sides[0] == sides[1]) & ~(sides[0]["ahead"] & sides[0]["behind"])).select("src", "dst")
    members = side.where("ahead and behind").select("node_id")
    named = edges.select(F.col("src").alias("node_id"), "root").distinct().join(members, "node_id")
    return settled(named.join(named.groupBy("root").agg(F.min("node_id").alias("scc")), "root").select("node_id", "scc")), settled(rest)


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node_id, scc (its smallest member), size of all nodes in a component of two or more.

    A weak component of at most local_edges edges is searched by one task; of larger ones the pivot's component is taken out, and
    the rest, in its new weak components, goes round again.
    """

    def group(df: pd.DataFrame) -> pd.DataFrame:
        found = _tarjan(list(zip(df["src"], df["dst"])))
        return pd.DataFrame({"node_id": list(found), "scc": list(found.values())}, dtype="int64")

    left, parts = edges, []
    while True:
        e = trimmed(left)
        grouped = settled(e.join(weak_components(e).withColumnRenamed("node_id", "src"), "src"))
        large = grouped.groupBy("root").count().where(F.col("count") > local_edges).select("root")
        parts.append(settled(grouped.join(large, "root", "left_anti").groupBy("root").applyInPandas(group, "node_id long, scc long")))
        over = settled(grouped.join(large, "root", "left_semi"))
        if over.isEmpty():
            break
        found, left = _pivoted(over)
        parts.append(found)
    labels = functools.reduce(DataFrame.unionByName, parts)
    big = labels.groupBy("scc").agg(F.count("*").alias("size")).where("size > 1")
    return labels.join(big, "scc").select("node_id", "scc", "size")


def back_edge_cycles(edges: DataFrame) -> DataFrame:
    """cycle (array of nodes): one for each edge back to the path of a depth-first search, as that path from where the edge leads.

    The search starts at the smallest node left and takes neighbours in ascending order, in each weak component of what trimmed() leaves,
    by one task each (as in strong_components(), but without another way: a component beyond LOCAL_EDGES is held by its task). Not all cycles
    of a graph are found so, and which are depends on the order: strong_components() tells which nodes are on cycles.
    """
    loops = edges.where(F.col("src") == F.col("dst")).select(F.array("src").alias("cycle")).distinct()
    e = trimmed(edges)
    grouped = e.join(weak_components(e).withColumnRenamed("node_id", "src"), "src")

    def group(df: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for a, b in sorted(zip(df["src"], df["dst"])):
            out.setdefault(int(a), []).append(int(b))
        seen, cycles = set(), []
        for start in sorted(out):
            if start in seen:
                continue
            seen.add(start)
            path, place, work = [start], {start: 0}, [iter(out[start])]
            while work:
                for nxt in work[-1]:
                    if nxt in place:
                        cycles.append(path[place[nxt] :])
                    elif nxt not in seen:
                        seen.add(nxt)
                        place[nxt] = len(path)
                        path.append(nxt)
                        work.append(iter(out.get(nxt, ())))
                        break
                else:
                    work.pop()
                    del place[path.pop()]
        return pd.DataFrame({"cycle": cycles})

    return grouped.groupBy("root").applyInPandas(group, "cycle array<long>").unionByName(loops)


def condensation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """from_scc, to_scc, edges between different components; a node on no cycle is a component of its own."""
    a = labels.select(F.col("node_id").alias("src"), F.col("scc").alias("_a"))
    b = labels.select(F.col("node_id").alias("dst"), F.col("scc").alias("_b"))
    both = simple_edges(edges).select("src", "dst").join(a, "src", "left").join(b, "dst", "left")
    named = both.select(F.coalesce("_a", "src").alias("from_scc"), F.coalesce("_b", "dst").alias("to_scc"))
    return named.where("from_scc <> to_scc").groupBy("from_scc", "to_scc").agg(F.count("*").alias("edges"))


def _inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """src, dst of the edges between different nodes of ids, each once."""
    ends = ids.select("node_id")
    both = simple_edges(edges).select("src", "dst").distinct().join(ends.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return both.join(ends.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def _longest(edges: DataFrame, own: DataFrame, local_edges: int | None) -> DataFrame:
    """flow() of weighted edges; nodes on or behind cycles have CYCLIC or more.

    What one task solves shows its cycles by itself. Elsewhere nodes on cycles are found first, get the value CYCLIC, and lose their edges out.
    """
    bound = LOCAL_EDGES if local_edges is None else local_edges
    if edges.limit(bound + 1).count() > bound:
        cyclic = settled(strong_components(edges).select("node_id"))
        edges = edges.join(cyclic.withColumnRenamed("node_id", "src"), "src", "left_anti").select("src", "dst", "w")
        own = own.join(cyclic.withColumn("_on", F.lit(True)), "node_id", "left").select("node_id", F.when(F.col("_on"), F.lit(CYCLIC)).otherwise(F.col("value")).alias("value"))
    return flow(edges, own, local_edges=local_edges)


def levels(edges: DataFrame, nodes: DataFrame, local_edges: int | None = None) -> DataFrame:
    """node_id, level: 0 without dependencies, else one more than the highest dependency (edges go from a node to what it depends on);
    nodes on or behind cycles get the highest level plus one."""
    ids = settled(nodes.select("node_id").distinct())
    e = settled(_inside(edges, ids).withColumn("w", F.lit(1.0)))
    found = settled(_longest(e, ids.withColumn("value", F.lit(0.0)), local_edges))
    top = found.where(F.col("value") < CYCLIC).agg(F.coalesce(F.max("value") + 1, F.lit(0.0)).alias("_top"))  # one row
    return found.join(F.broadcast(top)).select("node_id", F.when(F.col("value") < CYCLIC, F.col("value")).otherwise(F.col("_top")).cast("int").alias("level"))


def critical_path(edges: DataFrame, costs: DataFrame, local_edges: int | None = None) -> DataFrame:
    """node_id, duration: its cost and that of the longest chain of dependencies below it; null on or behind a cycle."""
    own = settled(costs.groupBy("node_id").agg(F.max("cost").cast("double").alias("value")))
    e = settled(_inside(edges, own).join(own.select(F.col("node_id").alias("src"), F.col("value").alias("w")), "src"))
    found = _longest(e, own, local_edges)
    return found.select("node_id", F.when(F.col("value") < CYCLIC / 2, F.col("value")).alias("duration"))


def _named_order(ids: np.ndarray, rank: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids in the order in which they get ready (dst before src), of those ready the smallest rank next; and of those that never
    are, with the number of edges among themselves at each."""
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    waits = np.bincount(a, minlength=len(ids))
    users = a[np.argsort(b, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=len(ids)))])
    heap = [(int(rank[n]), int(n)) for n in np.flatnonzero(waits == 0)]
    heapq.heapify(heap)
    out = np.empty(len(ids), np.int64)
    done = 0
    while heap:
        n = heapq.heappop(heap)[1]
        out[done] = n
        done += 1
        for u in users[first[n] : first[n + 1]]:
            waits[u] -= 1
            if not waits[u]:
                heapq.heappush(heap, (int(rank[u]), int(u)))
    left = waits > 0
    among = left[a] & left[b]
    busy = np.bincount(a[among], minlength=len(ids)) + np.bincount(b[among], minlength=len(ids))
    return out[:done], np.where(left, busy, -1)


def named_order(scope: DataFrame, edges: DataFrame) -> DataFrame:
    """position, node_id of scope (node_id, name), dependencies first, of those that are ready the smallest (name, node_id); nodes on or
    behind cycles last, by their number of edges among themselves, then by name. edges: between different nodes of scope, each once.

    The order is made in each weak component by itself, by one task, in arrays of some 60 bytes an edge. One order over all is their merge, in which the
    component whose next node is the smallest goes on: whoever follows a node that is greater than it goes on at once, so a node's place is that of the
    greatest so far in its component, a running maximum, and a sort by ranges does the rest, with the same result at every size.
    """
    roots = weak_components(edges)
    tied = settled(scope.select("node_id", "name").join(roots, "node_id", "left"))
    inner = settled(edges.join(roots.withColumnRenamed("node_id", "src"), "src").select("root", F.col("src").alias("node_id"), "dst"))

    def order(df: pd.DataFrame) -> pd.DataFrame:
        own, pairs = df[df["dst"].isna()], df[df["dst"].notna()]
        own = own.sort_values("node_id")
        ids = own["node_id"].to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, own["name"].to_numpy().astype(str)))] = np.arange(len(ids))
        placed, busy = _named_order(ids, rank, pairs["node_id"].to_numpy(), pairs["dst"].to_numpy().astype(np.int64))
        last = np.flatnonzero(busy >= 0)
        names = own["name"].to_numpy()
        both = np.concatenate([placed, last])
        return pd.DataFrame({"root": df["root"].iloc[0], "place": np.arange(len(both)), "node_id": ids[both], "name": names[both], "busy": np.concatenate([np.full(len(placed), -1), busy[last]])})

    every = tied.where("root is not null").select("root", "node_id", "name", F.lit(None).cast("long").alias("dst")).unionByName(inner.select("root", "node_id", F.lit(None).cast("string").alias("name"), "dst"))
    placed = every.groupBy("root").applyInPandas(order, "root long, place long, node_id long, name string, busy long")
    alone = tied.where("root is null").select(F.col("node_id").alias("root"), F.lit(0).cast("long").alias("place"), "node_id", "name", F.lit(-1).cast("long").alias("busy"))
    rows = settled(placed.unionByName(alone))
    sofar = Window.partitionBy("root").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    free = rows.where("busy < 0").withColumn("_by", F.max(F.struct("name", "node_id")).over(sofar))
    stuck = rows.where("busy >= 0").withColumn("_by", F.struct("name", "node_id"))
    return numbered(free.unionByName(stuck), ["busy", "_by", "place"], "position").select("position", "node_id")


def topological_files(nodes: DataFrame, edges: DataFrame, pages: list[str]) -> DataFrame:
    """position, node_id of the files that a request for pages needs, in the order of named_order().

    Targets are files whose name or path contains a page; with them come all they depend on, and all that depends on any of these.
    """
    files = nodes.where(F.col("node_type") == "file").select("node_id", "name", "path")
    wanted = F.lit(False)
    for p in pages:
        wanted = wanted | F.col("name").contains(p) | F.coalesce(F.col("path").contains(p), F.lit(False))
    e = settled(_inside(edges, files))
    ahead = reached(e, files.where(wanted).select("node_id"), outbound=True)
    scope = settled(reached(e, ahead, outbound=False).join(files.select("node_id", "name"), "node_id"))
    return named_order(scope, settled(_inside(e, scope)))


def suggestions(steps: DataFrame, bottleneck: DataFrame) -> DataFrame:
    """kind, node_id (null: of the whole plan), n, saving of a plan's steps (node_id, node_type, level, ms, risk, score) and of the last step of
    the critical path (node_id, duration)."""
    alone = steps.groupBy("level").agg(F.count("*").alias("k"), F.first("node_id").alias("node_id"), F.first("ms").alias("ms")).where("k = 1 and ms > 200")
    parallel = alone.select(F.lit("parallelize").alias("kind"), "node_id", F.lit(1).cast("long").alias("n"), (F.col("ms") * 0.3).alias("saving"))
    files = steps.where("node_type = 'file'").agg(F.count("*").alias("n")).where("n > 5")
    batch = files.select(F.lit("batch").alias("kind"), F.lit(None).cast("long").alias("node_id"), "n", (F.col("n") * 20.0).alias("saving"))
    trivial = steps.where("risk < 0.1 and score < 1").agg(F.count("*").alias("n"), F.sum("ms").alias("saving")).where("n > 3")
    skip = trivial.select(F.lit("skip").alias("kind"), F.lit(None).cast("long").alias("node_id"), "n", F.col("saving").cast("double").alias("saving"))
    risky = steps.where("risk > 0.5").select("node_id").join(bottleneck, "node_id")
    reorder = risky.select(F.lit("reorder").alias("kind"), "node_id", F.lit(1).cast("long").alias("n"), (F.col("duration") * 0.1).alias("saving"))
    return parallel.unionByName(batch).unionByName(skip).unionByName(reorder)


def plan_summary(nodes: DataFrame, edges: DataFrame, costs: DataFrame) -> DataFrame:
    """steps, groups (levels), widest (steps of the largest group), total and critical duration, and their ratio, of a plan: one row."""
    level = levels(edges, nodes)
    wide = level.groupBy("level").agg(F.count("*").alias("k")).agg(F.count("*").alias("groups"), F.max("k").alias("widest"), F.sum("k").alias("steps"))
    total = costs.agg(F.sum("cost").alias("total"))
    longest = critical_path(edges, costs).agg(F.max("duration").alias("critical"))
    return wide.join(total).join(longest).select("steps", "groups", "widest", "total", "critical", (F.col("total") / F.col("critical")).alias("speed_up"))  # one row each


def signal_path(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """position, node_id, side (focal, upstream: what it depends on, downstream: what depends on it) of a node's scope.

    Dependencies come first: by level (levels()), within a level by name and id; nodes on or behind cycles come last. Positions are
    numbered by ranges: the rows of the ranges before, summed up, and the place in its own range, so no task holds the scope.
    """
    spark = edges.sparkSession
    seed = spark.createDataFrame([(node_id,)], "node_id long")
    e = settled(simple_edges(edges).select("src", "dst").distinct())
    up = reached(e, seed, outbound=True).select("node_id", F.when(F.col("node_id") == node_id, "focal").otherwise("upstream").alias("side"), F.lit(0).alias("_r"))
    down = reached(e, seed, outbound=False).select("node_id", F.lit("downstream").alias("side"), F.lit(1).alias("_r"))
    scope = settled(up.unionByName(down).groupBy("node_id").agg(F.min_by("side", "_r").alias("side")).join(nodes.select("node_id", "name"), "node_id"))
    return numbered(scope.join(levels(e, scope), "node_id"), ["level", "name", "node_id"], "position").select("position", "node_id", "side")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows numbered from 0 in an order that has no ties, without a window over all rows."""
    ranged = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + within).cast("long")).drop("_range", "_before")


def outcome(reachability: Column, fragility: Column, conflicts: Column, ambiguous: Column, redirect: Column) -> Column:
    """The outcome ladder of a path."""
    return (
        F.when(redirect, "REDIRECT").when(reachability < 0.5, "FAILURE").when(ambiguous > 2, "AMBIGUOUS").when((reachability > 0.95) & (fragility < 0.05) & (conflicts == 0), "SUCCESS").when(reachability >= 0.5, "PARTIAL").otherwise("FAILURE")
    )


def step_costs(loc: Column, complexity: Column, degree: Column) -> dict[str, Column]:
    """Estimated bytes, score, milliseconds and risk of a step."""
    score = F.least(F.lit(10.0), loc / 100 + complexity / 5)
    return {"est_bytes": loc * 50, "score": score, "ms": 50 + loc + 10 * complexity, "risk": F.least(F.lit(1.0), degree * 0.1 + score * 0.05)}
