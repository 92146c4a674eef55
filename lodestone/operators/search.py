"""Full-text search over an inverted index (collection, object, term).

Words with typos are found by deletion neighbourhoods (typo_index()), completions by a table of prefixes (prefix_table()): both meet what is asked by equi-joins,
so a query reads the rows of its own keys, not all terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a word that variants are made of, and the longest prefix in the table of prefixes.
HEAD, LONGEST = 10, 8


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def build_index(df: DataFrame, object_col: str, text_col: str, collection: str) -> DataFrame:
    """collection, object, term: a row for each distinct term of an object."""
    return df.select(F.lit(collection).alias("collection"), F.col(object_col).alias("object"), F.explode(terms(F.col(text_col))).alias("term"))


def search(index: DataFrame, words: list[str], fuzzy: int = 0) -> DataFrame:
    """object, hits of the objects with all words; fuzzy: edits allowed in a word (typo_search() over a kept typo_index() is the way for many queries).

    Index rows are filtered to the words before they are counted, so only matching rows are shuffled.
    """
    wanted = [w.lower() for w in words]
    if fuzzy:
        asked = index.sparkSession.createDataFrame([(0, w) for w in wanted], "query int, word string")
        return typo_search(index, typo_index(index, fuzzy), asked, fuzzy).select("object", F.lit(len(set(wanted))).cast("long").alias("hits"))
    hits = index.where(F.col("term").isin(*wanted))
    return hits.groupBy("object").agg(F.count_distinct("term").alias("hits")).where(F.col("hits") == len(set(wanted)))


def variants(word: Column, edits: int) -> Column:
    """The deletion neighbourhood of a word: what is left of its first HEAD characters without up to so many of them. Words within so many edits of each other
    have a variant in common: what an alignment of the two matches within both heads is all but at most so many characters of each."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    found = F.array(F.substring(word, 1, HEAD))
    for _ in range(edits):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(F.filter(found, lambda w: F.length(w) > 0), without))))
    return found


def typo_index(index: DataFrame, edits: int = 1) -> DataFrame:
    """variant, term: of each distinct term, the variants; for edits up to so many. To be kept beside the index, by variant."""
    return index.select("term").distinct().select(F.explode(variants(F.col("term"), edits)).alias("variant"), "term")


def near_terms(typos: DataFrame, words: DataFrame, edits: int = 1) -> DataFrame:
    """word, term, distance of the terms within so many edits of words (word): an equi-join by variant, then the exact distance of what met."""
    asked = words.select(F.lower("word").alias("word")).distinct()
    met = asked.select("word", F.explode(variants(F.col("word"), edits)).alias("variant")).join(typos, "variant").select("word", "term").distinct()
    return met.withColumn("distance", F.levenshtein("word", "term", edits)).where("distance >= 0")


def typo_search(index: DataFrame, typos: DataFrame, queries: DataFrame, edits: int = 1) -> DataFrame:
    """query, object, distance of the objects that have, for each word of a query (query, word), a term within so many edits; distance: of the
    nearest terms, summed up. Any number of queries at once."""
    asked = queries.select("query", F.lower("word").alias("word")).distinct()
    found = index.join(near_terms(typos, queries, edits), "term").groupBy("object", "word").agg(F.min("distance").alias("distance"))
    sizes = asked.groupBy("query").agg(F.count("*").alias("_n"))
    hits = found.join(asked, "word").groupBy("query", "object").agg(F.count("*").alias("_hits"), F.sum("distance").alias("distance"))
    return hits.join(sizes, "query").where("_hits = _n").select("query", "object", "distance")


def prefix_table(index: DataFrame, longest: int = LONGEST) -> DataFrame:
    """prefix, term, objects: a row for each prefix of a term, up to a length. To be kept beside the index, by prefix."""
    counts = index.groupBy("term").agg(F.count_distinct("object").alias("objects"))
    return counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest))), lambda i: F.substring("term", F.lit(1), i))).alias("prefix"), "term", "objects")


def completions(table: DataFrame, asked: DataFrame, limit: int = 10, longest: int = LONGEST) -> DataFrame:
    """asked, place (from 1), term, objects: for each prefix (asked), the most widespread terms with it: an equi-join by prefix."""
    keys = asked.select("asked", F.lower("asked").alias("_p")).distinct().withColumn("prefix", F.substring("_p", 1, longest))
    found = keys.join(table, "prefix").where(F.col("term").startswith(F.col("_p")))
    order = Window.partitionBy("asked").orderBy(F.desc("objects"), "term")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("asked", "place", "term", "objects")


def suggest(index: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The most widespread terms with a prefix."""
    found = index.where(F.col("term").startswith(prefix.lower())).groupBy("term").agg(F.count_distinct("object").alias("objects"))
    return found.orderBy(F.desc("objects"), "term").limit(limit)


def push(index: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces the rows of the objects that new holds."""
    return index.join(new.select("collection", "object").distinct(), ["collection", "object"], "left_anti").unionByName(new.select(*index.columns))


def pop(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the (object, term) rows of gone."""
    return index.join(gone.select("object", "term").distinct(), ["object", "term"], "left_anti").select(*index.columns)


def flush(index: DataFrame, collection: str) -> DataFrame:
    return index.where(F.col("collection") != collection)


def hybrid(index: DataFrame, nodes: DataFrame, words: list[str], text_col: str = "name") -> DataFrame:
    """node_id, source: by the index, and by substring where the index has nothing for a query."""
    exact = search(index, words).select(F.col("object").alias("node_id"), F.lit("index").alias("source"))
    found = F.lit(True)
    for w in words:
        found = found & F.lower(text_col).contains(w.lower())
    plain = nodes.where(found).select("node_id", F.lit("scan").alias("source"))
    none = exact.agg(F.count("*").alias("_n"))
    return exact.unionByName(plain.join(none.where("_n = 0")).select("node_id", "source"))  # one row or none


def reindex(index: DataFrame, new: DataFrame, collection: str) -> DataFrame:
    """The index with all of a collection replaced."""
    return flush(index, collection).unionByName(new.where(F.col("collection") == collection).select(*index.columns))


def incremental(index: DataFrame, had: DataFrame, have: DataFrame, collection: str) -> DataFrame:
    """The index after the objects of a collection changed: had and have (object, sha, text). Only new and changed ones are read again; those gone go."""
    same = have.join(had.select("object", "sha"), ["object", "sha"], "left_semi").select("object")
    fresh = build_index(have.join(same, "object", "left_anti"), "object", "text", collection)
    kept = index.where(F.col("collection") == collection).join(same, "object", "left_semi").select(*index.columns)
    return flush(index, collection).unionByName(kept).unionByName(fresh.select(*index.columns))


def enrichment(nodes: DataFrame, project: str) -> DataFrame:
    """object (project:node_id), text of the nodes (node_id, node_type, name, path) of a project, as the index takes them."""
    return nodes.select(F.concat(F.lit(f"{project}:"), F.col("node_id").cast("string")).alias("object"), F.concat_ws(" ", "name", "node_type", "path").alias("text"))
