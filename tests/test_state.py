"""Keyed streaming state and bucketed snapshots: replays, restarts, order and odd rows."""

import json
import pathlib
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodestone.operators import snapshots
from lodestone.streaming import changes, state

SCHEMA = "path string, type string, ts timestamp, sha string, seq long"


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(state.STORE[0])
    state.with_store(spark)
    yield
    spark.conf.set(state.STORE[0], before)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def event(path, kind, second, sha=None, seq=0):
    return {"path": path, "type": kind, "ts": f"2026-01-01T00:{second // 60:02d}:{second % 60:02d}.000Z", "sha": sha, "seq": seq}


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def forget(checkpoint, batches):
    """As if the driver had stopped before the commit of the last batches."""
    for b in batches:
        for f in (pathlib.Path(checkpoint) / "commits").glob(f"*{b}*"):
            if f.name.strip(".").split(".")[0] == str(b):
                f.unlink()


def test_mutations_survive_a_replayed_batch(spark, tmp_path):
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    write(folder, "a.json", [event("known", "change", 1, "2"), event("new", "add", 2, "x"), event("ghost", "change", 3, "y"), event("ghost", "unlink", 4)])
    registry = spark.createDataFrame([("known", "1"), ("idle", "1")], "path string, sha string")
    run = lambda: state.run_all(state.mutations(source(spark, folder), registry), out, ck)
    run()
    write(folder, "b.json", [event("known", "change", 12, "3", 1), event("known", "change", 11, "2"), event("new", "unlink", 13), event("new", "change", 14, "z"), event("new", "add", 15, "w")])
    run()
    expected = [("known", "EDIT", "1", "2"), ("known", "EDIT", "2", "3"), ("new", "CREATE", None, "w"), ("new", "CREATE", None, "x"), ("new", "DELETE", "x", None)]
    got = lambda: sorted((tuple(r)[:4] for r in spark.read.parquet(out).collect()), key=str)
    assert got() == sorted(expected, key=str)
    forget(ck, [1])
    run()  # the second batch runs again, from the state before it
    assert got() == sorted(expected, key=str)
    write(folder, "c.json", [event("known", "change", 30, "3"), event("idle", "unlink", 31)])
    run()
    assert got() == sorted([*expected, ("idle", "DELETE", "1", None)], key=str)


def test_stale_paths_by_timer(spark, tmp_path):
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    registry = spark.createDataFrame([], "path string, sha string")
    for name, rows in (("a.json", [event("a", "add", 0, "1"), event("b", "add", 0, "1")]), ("b.json", [event("b", "change", 50, "1")]), ("c.json", [event("c", "add", 100, "1")]), ("d.json", [event("c", "change", 110, "1")])):
        write(folder, name, rows)
        state.run_all(state.mutations(source(spark, folder), registry, stale_ms=60_000), out, ck)
    got = sorted((r.path, r.kind) for r in spark.read.parquet(out).collect())
    assert got == [("a", "CREATE"), ("a", "STALE"), ("b", "CREATE"), ("c", "CREATE")]


def flushed(events, gap):
    """One timer over all events."""
    out, pending, start, last = [], set(), None, None
    for s, path, kind in sorted(events):
        if last is not None and s - last > gap:
            out += [(start, last, *p) for p in pending]
            pending, start = set(), None
        start = s if start is None else start
        last = s
        pending.add((path, kind))
    return sorted(out + [(start, last, *p) for p in pending])


@pytest.mark.parametrize("files", [1, 4])
def test_bursts_equal_one_timer(spark, tmp_path, files):
    rng = random.Random(files)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    events, now = [], 0
    for _ in range(150):
        now += rng.choice((0, 1, 2, 4, 5, 6, 9, 30))
        events.append((now, f"p{rng.randrange(12)}", rng.choice(("add", "change"))))
    size = -(-len(events) // files)
    parts = [(f"{k}.json", [event(p, kind, s) for s, p, kind in events[k * size : (k + 1) * size]]) for k in range(files)]
    parts += [("y.json", [event("", state.HEARTBEAT, now + 3)]), ("z.json", [event("", state.HEARTBEAT, now + 600), event("", state.HEARTBEAT, now + 1200)])]
    for name, rows in parts:
        write(folder, name, rows)
        state.run_all(state.bursts(source(spark, folder), 5000, buckets=3), out, str(tmp_path / "ck"))
    got = spark.read.parquet(out)
    seconds = sorted((r.s, r.e, r.path, r.type) for r in got.selectExpr("unix_timestamp(started) - unix_timestamp(timestamp'2026-01-01 00:00:00') as s", "unix_timestamp(ended) - unix_timestamp(timestamp'2026-01-01 00:00:00') as e", "path", "type").collect())
    assert seconds == flushed(events, 5)


def test_bursts_keep_paths_that_are_null(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    write(folder, "a.json", [event(None, "add", 1), event("p", "add", 2), event(None, "add", 900), event("", state.HEARTBEAT, 2000), event("", state.HEARTBEAT, 3000)])
    state.run_all(state.bursts(source(spark, folder), 5000, buckets=3), out, str(tmp_path / "ck"))
    got = sorted(((r.ended - r.started).seconds, r.path, r.type) for r in spark.read.parquet(out).where("minute(started) < 5").collect() if r.path)
    assert got == [(1, "p", "add")]
    assert spark.read.parquet(out).where("path is null").count() == 2


class _Held:
    """The states of one key, in memory."""

    def __init__(self):
        self.maps = {}

    def getValueState(self, name, schema):
        held = self.maps.setdefault(name, {})
        return SimpleNamespace(get=lambda: held.get(0), exists=lambda: 0 in held, update=lambda v: held.update({0: v}), clear=held.clear)

    def getMapState(self, name, user, schema):
        held = self.maps.setdefault(name, {})
        return SimpleNamespace(getValue=held.get, containsKey=held.__contains__, removeKey=lambda k: held.pop(k, None), updateValue=held.__setitem__, keys=lambda: iter(list(held)), clear=held.clear)


def test_a_bucket_of_bursts_is_not_held_whole():
    gap, chunk, bins = 5_000_000, 10_000, 300  # three bursts of 100 bins, and one heartbeat; each chunk has rows of all bins
    rows = np.arange(chunk)
    at = lambda b: b * gap + b // 100 * 10 * gap
    heads = pd.DataFrame([(-1, at(b), None, None, at(b), at(b) + gap - 1, at(b) + gap - 1) for b in range(bins)], columns=["part", "bin", "path", "type", "first", "last", "now"])
    beat = pd.DataFrame([(-1, at(400), None, None, state.NEVER, state.NEVER, at(400))], columns=heads.columns)

    def chunks(n):
        for k in range(n):
            path = (rows + k * 37) % 3000
            yield pd.DataFrame({"part": path % state.PARTS, "bin": at((rows * 7 + k) % bins), "path": [f"p{x}" for x in path], "type": "add", "first": 0, "last": 0, "now": 0})
        yield heads

    timer = state._Timer(5000)
    timer.init(_Held())
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    most, got = 0, []
    for batch in (chunks(60), iter([beat])):
        for found in timer.handleInputRows((0,), batch, None):
            most = max(most, pa.total_allocated_bytes() - before)
            got.append(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pd.concat(got)
    expected = {(int((rows * 7 + k)[i] % bins) // 100, (i + k * 37) % 3000) for k in range(60) for i in range(chunk)}
    first = {pd.Timestamp(at(100 * b), unit="us", tz="UTC"): b for b in range(3)}
    assert len(got) == len(expected) and {(first[s], int(p[1:])) for s, p in zip(got["started"], got["path"])} == expected
    assert set(zip(got["started"].map(first), got["ended"])) == {(b, pd.Timestamp(at(100 * b + 99) + gap - 1, unit="us", tz="UTC")) for b in range(3)}
    assert peak + most < 40e6, (peak, most)  # 600,000 rows in one frame are over 100 MB
    assert not timer.span.exists() and not list(timer.pending.keys())


def test_a_batch_that_stops_after_publishing_runs_again(spark, tmp_path):
    folder, root, ck = tmp_path / "in", str(tmp_path / "root"), str(tmp_path / "ck")
    empty = spark.createDataFrame([], "path string, kind string")
    snapshots.publish(spark, root, {"registry": spark.createDataFrame([("a", "1")], "path string, sha string"), "mutations": empty}, 0)
    write(folder, "1.json", [event("a", "change", 1, "2"), event("b", "add", 2, "1")])
    seen = []

    def stops_once(rows, version):
        seen.append(sorted((r.path, r.kind) for r in rows.collect()))
        if len(seen) == 1:
            raise RuntimeError("stopped")

    start = lambda: changes.run_batches(changes.events(spark, str(folder)), root, stops_once, ck).start().awaitTermination()
    with pytest.raises(Exception):  # noqa: B017
        start()
    start()
    assert seen == [[("a", "UPDATE"), ("b", "CREATE")]] * 2
    assert sorted(tuple(r) for r in snapshots.current(spark, root, "registry").collect()) == [("a", "2"), ("b", "1")]


def test_a_published_version_is_never_written_again(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.publish(spark, root, {"t": spark.range(3)}, 1)
    reader = snapshots.current(spark, root, "t")
    assert not snapshots.publish(spark, root, {"t": spark.range(9)}, 1)
    assert snapshots.publish(spark, root, {"t": snapshots.current(spark, root, "t").where("id > 0"), "u": spark.range(1)}, 2)
    assert snapshots.publish(spark, root, {"u": spark.range(2)}, 3)
    assert reader.count() == 3 and snapshots.current(spark, root, "t").count() == 2 and snapshots.current(spark, root, "u").count() == 2


def test_a_change_writes_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("part-*.parquet")}
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    snapshots.publish_bucketed(spark, root, "t", spark.range(1000).selectExpr("id", "'old' as v"), ["id"], 1, n=32)
    before = files()
    assert snapshots.change(spark, root, "t", rows((5, "new"), (2000, "new"), (None, "null key")), 2)
    assert not snapshots.change(spark, root, "t", rows((6, "never")), 2)
    after = files()
    assert {f: m for f, m in after.items() if f in before} == before and 1 <= len(after) - len(before) <= 3
    got = {r.id: r.v for r in snapshots.current(spark, root, "t").collect()}
    assert len(got) == 1002 and got[5] == got[2000] == "new" and got[6] == "old" and got[None] == "null key"
    gone = lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*old.columns)
    assert snapshots.change(spark, root, "t", rows((5, ""), (7, "")), 3, gone) and snapshots.current(spark, root, "t").count() == 1000
    assert snapshots.change(spark, root, "t", rows(), 4) and snapshots.current(spark, root, "t").count() == 1000
    snapshots.publish_bucketed(spark, root, "none", rows(), ["id"], 5)
    assert snapshots.current(spark, root, "none").count() == 0 and snapshots.current(spark, root, "t").count() == 1000
