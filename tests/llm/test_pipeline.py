"""The pipeline's stages, each judged on its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_minhash import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, seen = docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name != "packing":
            assert sorted(after.columns) == sorted(docs.columns)
        seen[name] = (before, after)
        before = after
    a, b = seen["language_id"]
    assert b.count() == a.join(b.select("doc_id"), "doc_id", "left_semi").count() and b.count() >= 0.97 * a.count()
    a, b = seen["line_dedup"]
    common = a.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).groupBy(F.lower(F.trim("l")).alias("l")).agg(F.count_distinct("doc_id").alias("n")).where("n >= 10 and l <> ''")
    assert b.count() == a.count()
    left = b.select(F.explode(F.split("text", "\n")).alias("l")).select(F.lower(F.trim("l")).alias("l"))
    assert left.join(common, "l", "left_semi").count() == 0
    a, b = seen["near_dedup"]
    groups = brute([(r.doc_id, r.text) for r in a.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r.doc_id for r in b.select("doc_id").collect()) == sorted(i for i, (_, _, kept) in groups.items() if kept)
    assert b.count() < a.count()
    a, b = seen["pii"]
    assert b.count() == a.count()
    card = re.compile(r"[\w.]+@mail\d|token = \"?\w{20}|\+1 \(\d{3}\)", re.I)
    old = {r.doc_id: r.text for r in a.collect()}
    changed = [r for r in b.collect() if r.text != old[r.doc_id]]
    assert changed and all(len(card.findall(r.text)) == len(card.findall(old[r.doc_id])) for r in changed)
    a, b = seen["packing"]
    assert {r.doc_id for r in b.select("doc_id").collect()} == {r.doc_id for r in a.select("doc_id").collect()}
    assert b.agg(F.sum("length")).first()[0] == b.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text), (2, text.replace("w30", "zz")), (9, "other words altogether, not like the first at all"), (None, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 9, None}


def test_run_gives_windows(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    sizes = [r.n for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()]
    assert set(sizes[:-1]) == {2048} and 0 < sizes[-1] <= 2048


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def at_every_stage(spark, docs):
    """The rows after every stage, each stage given what the last returned."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append((name, rows, docs))
    return out


def test_empty_table(spark):
    seen = at_every_stage(spark, spark.createDataFrame([], DOCUMENTS))
    assert [len(rows) for _, rows, _ in seen] == [0] * 5
    assert all(docs.columns == DOCUMENTS.replace(" long", "").replace(" string", "").split(", ") for _, _, docs in seen[:-1])


def test_nulls_repeated_rows_and_further_columns(spark):
    english = [" ".join(f"the {w} of the house and the {w} in the garden" for w in words.split()) for words in ("cat dog bird", "king queen page", "tree leaf root", "boat sail wind")]
    german = [" ".join(f"der {w} und die {w} im haus von der {w}" for w in words.split()) for words in ("hund katze vogel", "baum blatt ast")]
    rows = [(i, x, "en", "a", 1) for i, x in enumerate(english * 2)] + [(10 + i, x, "de", None, 1) for i, x in enumerate(german * 2)]
    rows += [(20, None, "en", "a", None), (20, None, "en", "a", None), (21, "", None, None, 0), (None, english[0] + " once more", None, "b", 3), (30, english[1] + " pay 4111 1111 1111 1111", "en", "a", 5), (30, english[1] + " pay 4111 1111 1111 1111", "en", "a", 5)]
    odd = [(*r, "x", "y", [1], {"k": 1}) for r in rows]
    docs = spark.createDataFrame(odd, DOCUMENTS + ", _queue string, _pii string, v array<int>, keep map<string,int>")
    seen = dict((name, rows) for name, rows, _ in at_every_stage(spark, docs))
    assert {r.doc_id for r in seen["language_id"]} == {*range(8), 10, 11, 12, 13, None, 30} and all(r.lang in ("en", "de") for r in seen["language_id"])
    assert len(seen["line_dedup"]) == len(seen["language_id"]) == 15
    kept = [r.doc_id for r in seen["near_dedup"]]
    assert sorted(kept, key=str) == sorted({*kept}, key=str) and {1, 2, 3, 10, 11} <= {*kept} and not {4, 5, 6, 7, 12, 13} & {*kept}
    assert all("4111" not in r.text for r in seen["pii"])
    assert {r.doc_id for r in seen["packing"]} == {*kept} and all(len(r.ids) == r.length for r in seen["packing"])
