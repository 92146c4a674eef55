"""Near-duplicates against brute force over all pairs."""

import itertools
import random
import re

import pytest

from lodestone.llm import minhash

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Chains and clouds of edited copies, shared passages, exact copies, and odd rows."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice((30, 120, 200)))]
        rows += [" ".join(base)] * rng.randrange(3)
        rows += [edited(base, rng.randrange(1, 9), rng) for _ in range(rng.randrange(1, 14))]
        now = base
        for _ in range(rng.randrange(8)):  # each copied from the last
            now = edited(now, 4, rng).split()
            rows.append(" ".join(now).upper() if rng.random() < 0.2 else " ".join(now))
    rows += [" ".join(passage + [word() for _ in range(rng.choice((5, 10, 40)))]) for _ in range(25)]
    rows += [None, "", " \n ", "One", "one ", "one two", "ONE TWO", "a b c", "é B c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent", "bucket"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 4), (5, 80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    rows = corpus(width + bucket)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keys string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words are here now"), (None, "a b c d e f g"), (-5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect()), key=repr)
    assert got == sorted([(1, 5, None, False), (1, 5, None, False), (1, 3, 1, True), (None, 5, None, True), (-5, 0, -5, True)], key=repr)
    assert minhash.near_duplicates(docs.limit(0), 3, 85).collect() == []


def test_signature_estimates_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 850).astype(np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 75).astype(np.uint64)])) for _ in range(2))
    s = minhash.signatures(minhash.minima([a, b])).view(np.int64).tolist()
    df = spark.createDataFrame([(s[0], s[1])], "a array<long>, b array<long>")
    from pyspark.sql import functions as F

    assert abs(df.select(minhash.likeness(F.col("a"), F.col("b"))).first()[0] - 0.85) < 0.12


def test_long_chain_of_edited_copies(spark):
    """2,000 documents, each linked with the one before and the one after only, their ids in no order."""
    rng = random.Random(5)
    now, texts = [f"w{i}" for i in range(60)], []
    for k in range(2000):
        now = list(now)
        now[(7 * k) % 60] = f"n{k}"
        texts.append(" ".join(now))
    ids = rng.sample(range(1, 10_000), len(texts))
    got = minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), 3, 85).collect()
    assert len(got) == 2000 and {r.component_id for r in got} == {min(ids)}
    assert [r.doc_id for r in got if r.leader] == [min(ids)]


def test_pairs_in_buckets_beyond_one_task(spark, monkeypatch):
    """Documents that share most of a passage fill buckets that are refined and dealt out in blocks; no pair is lost."""
    monkeypatch.setattr(minhash, "BUCKET", 16)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for k in range(150):
        own = [f"o{k}_{i}" for i in range(24)]
        rows.append((2 * k, " ".join(passage + own)))
        if k % 3 == 0:
            rows.append((2 * k + 1, edited(passage + own, rng.randrange(1, 3), rng)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_bands_leave_little_unfound(percent):
    rows = minhash.rows_per_band(percent / 100)
    p, n = (percent / 100) ** rows, minhash.HASHES // rows
    assert (1 - p) ** n + n * p * (1 - p) ** (n - 1) <= minhash.MISS


def test_one_leader_of_rows_that_share_an_id(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(5, same), (5, same), (5, same + " x"), (7, same.upper()), (None, None), (None, None), (9, "alone")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    leaders = [(r.doc_id, r.text_hash) for r in got if r.leader]
    assert len({x for x in leaders if x[0] == 5}) == 1 and 7 not in dict(leaders) and leaders.count((9, dict(leaders)[9])) == 1


def test_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(40_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, edited(long, 900, rng)), (3, edited(long, 9000, rng)), (4, "x" * 300_000), (5, "short one"), (6, "x" * 300_000)]
    names = ["v", "n", "s", "k", "d", "t", "root", "h", "keys", "items"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"doc_id long, text string, {', '.join(f'{c} int' for c in names)}")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows, 5, 80) and got[2][1] == 1 and got[6][1] == 4
