"""Credential linking, hard negatives and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import credentials, negatives, prefix_trie
from lodestone.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


# ---- credentials


def base_finds(text):
    out = []
    for m in re.finditer(credentials.ASSIGN, text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text or ""):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text or ""):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def all_finds(text):
    """Every pair of parts is looked at."""
    text, base = text or "", base_finds(text)
    weak = []
    for k, p in (("ident", credentials.IDENT), ("keyed", credentials.KEYED), ("bare", credentials.BARE), ("endpoint", credentials.ENDPOINT)):
        for m in re.finditer(p, text):
            if k != "bare" or all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")):
                weak.append((m.start(), credentials.RANK[k], m.end()))
    breaks = [m.start() for m in re.finditer(credentials.BREAK, text)]
    over = lambda a, b: a[0] < b[2] and b[0] < a[2]
    parts = list(base)
    for w in weak:
        rivals = base + ([x for x in weak if x[1] != 5] if w[1] == 5 else [])
        if not any(over(w, x) for x in rivals):
            parts.append(w)
    scope = lambda x: sum(b < x[0] for b in breaks)
    near = lambda x, kinds: any(y is not x and y[1] in kinds and scope(x) == scope(y) and max(x[0], y[0]) - min(x[2], y[2]) <= credentials.REACH for y in parts)
    ids, secrets, ends = (1, 3), (0, 2, 4, 5), (6,)
    told = list(base)
    for x in parts:
        if x[1] == 3 and near(x, secrets) or x[1] == 4 and (near(x, ids) or near(x, ends)) or x[1] == 5 and near(x, ids) or x[1] == 6 and near(x, ids) and near(x, secrets):
            told.append(x)
    return sorted(told)


def spelled(found):
    return ",".join(f"{credentials.KINDS[r]}:{s}:{e}" for s, r, e in found)


def expected(text):
    base = base_finds(text)
    return (*(sum(r == k for _, r, _ in base) for k in range(3)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(all_finds(text)))


PIECES = [
    "password=hunter22", "PassWord: 'abc", "token = token:abcdefgh", 'api_key":"AbC12345', "apikey==zzzzzz", "secret=", "AKIA" + "A1B2" * 4, "AKIA123", "deadbeef" * 3, "0123456789abcdef" * 2 + "g", "user: root_admin",
    "account_id=1234567", "client_secret: Zx81Zx81", "aws_secret_access_key = wJalrXUtnFEMIK7MDENGbPxRfiCYKEY12345", "Zm9vYmFyYmF6cXV4QUJDREVGMTIz", "https://db.example.com:5432/x", "host=10.0.0.1", "\n\n", "\n", "x" * 450,
    "Éé 𝒳𝒴 words of prose", "jdbc:mysql://h/d", "\n \t\n", "login=bob", "=", "pwd:correcthorse",
]


def scanned(spark, rows, schema="doc_id long, text string"):
    return [tuple(r)[:6] for r in credentials.digests(spark.createDataFrame(rows, schema)).collect()]


def test_credentials_against_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", *PIECES, *(" ".join(rng.choice(PIECES) for _ in range(rng.randrange(2, 25))) for _ in range(250)), *("".join(rng.choice(PIECES) for _ in range(rng.randrange(2, 12))) for _ in range(150))]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert sorted(scanned(spark, rows)) == sorted((i, *expected(t)) for i, t in rows)
    assert sum(expected(t)[4] != spelled(base_finds(t)) for t in texts) > 50


def test_credentials_link_only_complements(spark):
    alone = "\n\n".join(["user: root_admin", "Zm9vYmFyYmF6cXV4QUJDREVGMTIz", "pwd:correcthorse"])
    far = "AKIA" + "A1B2" * 4 + " " + "x " * 300 + "Zm9vYmFyYmF6cXV4QUJDREVGMTIz"
    together = "host=db1.example\nuser: root_admin\npwd:correcthorse"
    got = {i: s for i, *_, s in scanned(spark, [(1, alone), (2, far), (3, together)])}
    assert got[1] == "" and got[2] == "access:0:20"
    assert got[3] == "endpoint:0:16,ident:17:33,keyed:34:50"


def test_credentials_odd_rows(spark):
    docs = [(1, "password=hunter22", "a", 3), (1, "password=hunter22", "b", 4), (None, "user=bobby pwd=abcdef12", "c", 5), (2, None, None, None)]
    got = credentials.digests(spark.createDataFrame(docs, "doc_id long, text string, base string, row long")).collect()
    assert len(got) == 4 and sum(r.n_assign for r in got) == 2 and {r.spans for r in got} == {"assign:0:17", "", "ident:0:10,keyed:11:23"}
    assert credentials.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_credentials_many_parts_in_one_text(spark):
    text = "\n".join(f"user=name{i} Zm9vYmFyYmF6cXV4QUJDREVG{i:06d} password=secret{i} deadbeefdeadbeefdeadbeef" for i in range(3000))
    (row,) = scanned(spark, [(1, text)])
    assert row[1:4] == (3000, 0, 3000) and row[4] == expected(text[:0] + text)[3] and row[5].count(",") == 4 * 3000 - 1


def test_prefix_sums(spark):
    for n in (1, 2, 3, 10, 17, 100):
        x = [i * i % 7 for i in range(n)]
        got = spark.createDataFrame([(x,)], "x array<long>").select(credentials.prefix_sums(F.col("x")).alias("s")).first()["s"]
        assert got == list(np.cumsum(x))


def test_credentials_registered(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:6] for r in llm_queries.op11_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: expected(t) for i, t in rows} and any(x[0] for x in got.values())


# ---- hard negatives


def mined(rows):
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        held.append((i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    anchors = {}
    for i, label, v in held:
        if i is not None and i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    last = 1 << 62
    for a, (label, v) in anchors.items():
        score = [(-sum(x * y for x, y in zip(v, w)), last if i is None else i, l) for i, l, w in held if i != a]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:5]:
            fit = sorted(x for x in score if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a, None if p == last else p, k + 1, None if n == last else n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out, key=str)


def vectors(rng, n, labels=4, copies=0):
    base = rng.normal(size=(n, 6)).astype("float32")
    rows = [(i, [float(x) for x in v], int(rng.integers(labels))) for i, v in enumerate(base)]
    return rows + [(n + i, rows[17][1], int(rng.integers(labels))) for i in range(copies)]


def run_mine(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return sorted((tuple(r) for r in negatives.registered(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=str)


@pytest.mark.parametrize("chunk", [2, 16384])
def test_negatives_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rows = vectors(np.random.default_rng(3), 700, copies=60)
    assert run_mine(spark, rows) == mined(rows)


def test_negatives_odd_rows(spark):
    rows = vectors(np.random.default_rng(4), 210)
    nan = float("nan")
    rows += [(300, [nan] * 6, 1), (400, None, 1), (401, [1.0] * 6, None), (402, [None, 1.0], 1), (403, [], 2), (404, [0.5], 2), (None, [0.4] * 6, 1), (None, [0.4] * 6, 2), (405, [float("inf")] * 6, 1)]
    rows += [(100, [0.1] * 6, 9), rows[100], rows[5], (0, [0.0] * 6, 0)]
    assert run_mine(spark, rows) == mined(rows)
    assert run_mine(spark, []) == [] and run_mine(spark, [(100, [1.0], 1)]) == []
    extra = negatives.registered(spark.createDataFrame([(i, v, l, 1.0, 2) for i, v, l in rows[:210]], "vec_id long, embedding array<float>, label int, d double, query long"))
    assert sorted(map(tuple, extra.collect()), key=str) == mined(rows[:210])


def test_pivot_brackets_hold():
    rng = np.random.default_rng(5)
    x, q = np.floor(256 * rng.normal(size=(400, 8))), np.floor(256 * rng.normal(size=(30, 8)))
    pivots = negatives.Pivots(x[:50], float((x**2).sum(1).max()))
    a, d, exact = pivots.of_anchors(q), pivots.of_rows(x), q @ x.T
    near = np.abs(a[:, None] - d[None]).max(2)
    far = (a[:, None] + d[None]).min(2)
    low, high = pivots.scores((q**2).sum(1), near, far)
    assert (low <= exact).all() and (exact <= high).all() and (high < np.sqrt((q**2).sum(1))[:, None] * np.sqrt(pivots.most)).mean() > 0.5


def test_negatives_registered(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in llm_queries.op12_negatives(spark, "/root/testdata/sf0.01").collect()), key=str) == mined(rows)


# ---- conversation trie


def tries(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0), key, role, text))
    original = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in convs.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = original.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    words = lambda n: len([w for w in re.split("[\x20\x09-\x0d]+", n[-1][1]) if w]) if n else 0
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = (len(members[n]) - 1) * words(n) + sum(saved[k] for k in children[n])
    end = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(rebuilt[c]) == len(n)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], end(n)) for n, m in members.items()), key=str)


def run_trie(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, schema).repartition(3)).collect()), key=str)


@pytest.mark.parametrize("flush", [20, 50_000])
def test_trie_against_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(prefix_trie, "FLUSH", flush)
    monkeypatch.setattr(prefix_trie, "PIECE", 3 if flush == 20 else 10_000)
    rng = random.Random(13)
    rows = []
    for c in range(-25, 170):
        if rng.random() < 0.9:
            for t in range(rng.choice((1, 1, 2, 3, 5, 9))):
                rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("a", "a b", "", "a\tb  c", "é x"))))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(6)]
    rows += [(300, t, "user", f"long {t % 3}") for t in range(400)]
    assert run_trie(spark, rows) == tries(rows)


def test_trie_odd_rows(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "tie"), (0, 1, "user", "tie"), (None, 1, "user", "lost"), (3, 0, "user", "x" * 100_000), (20, 5, "", ""), (41, 1, "user", "only"), (45, 1, "user", "only")]
    assert run_trie(spark, rows) == tries(rows)
    assert run_trie(spark, []) == []
    wide = prefix_trie.trie(spark.createDataFrame([(*r, 1, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, node binary"))
    assert sorted(map(tuple, wide.collect()), key=str) == tries(rows)


def test_trie_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in llm_queries.op13_trie(spark, SF).collect()), key=str) == tries(rows)


@pytest.mark.parametrize("name", ["op11_secrets", "op12_negatives", "op13_trie"])
def test_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    for t in ("documents", "embeddings", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = llm_queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    theirs = duckdb.sql(llm_queries.ORACLE_SQL[name])
    assert sorted(theirs.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(theirs.project(", ".join(columns)).fetchall(), key=str)
