"""Typos and completions against plain Python."""

import random

from pyspark.sql import functions as F

from lodestone.operators import search


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_near_word_is_missed(spark):
    """Words longer than the head, edits anywhere, empty and single letters."""
    rng = random.Random(7)
    stems = ["abcabcabcabcabcabc", "bacbacbacbac", "cabab", "ab", "a", "çüñabç"]
    words = set(stems)
    for stem in stems * 12:
        w = list(stem)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(("", "a", "b", "x"))
        words.add("".join(w))
    words = sorted(words - {""})
    index = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "object long, term string").withColumn("collection", F.lit("c"))
    asked = spark.createDataFrame([(w,) for w in stems], "word string")
    for edits in (1, 2):
        got = {(r.word, r.term, r.distance) for r in search.near_terms(search.typo_index(index, edits), asked, edits).collect()}
        assert got == {(a, b, distance(a, b)) for a in stems for b in words if distance(a, b) <= edits}


def test_typo_search_takes_all_words(spark):
    index = search.build_index(spark.createDataFrame([(1, "Quick brown fox"), (2, "quick red fox"), (3, None), (4, "")], "id int, text string"), "id", "text", "c")
    queries = spark.createDataFrame([("a", "quikc"), ("a", "fxo"), ("b", "QUICK"), ("b", "brwn"), ("c", "nothing")], "query string, word string")
    got = sorted(tuple(r) for r in search.typo_search(index, search.typo_index(index, 2), queries, 2).collect())
    assert got == [("a", 1, 4), ("a", 2, 4), ("b", 1, 1)]


def test_a_query_joins_by_keys(spark):
    index = search.build_index(spark.range(50).selectExpr("id", "concat('word', id) as text"), "id", "text", "c")
    plan = search.near_terms(search.typo_index(index), spark.createDataFrame([("wrd7",)], "word string"))._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
