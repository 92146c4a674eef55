"""Keyed state of file streams: what is known of every path, sessions since it was touched, and bursts under one timer.

State lies with its key in the state store, so a micro-batch costs what it brings, not what is known. A stream writes to a file sink: state and output
of a micro-batch become valid together, and one that is run again after a stop gives the same output under the same number, which counts once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed state with timers needs, and its class.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: All stores of an executor share one bound of native memory (maxMemoryUsageMB), however many partitions there are.
BOUNDED = ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
MUTATION = "path string, kind string, old string, new string, ts timestamp"


class _Registry(StatefulProcessor):
    """sha by path, and the last event's time; a timer for paths that stay untouched."""

    def __init__(self, stale_ms: int | None = None):
        self.stale_ms = stale_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sha = handle.getValueState("sha", "sha string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.sha.update((initialState.at[0, "sha"],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        known = self.sha.get()
        had = known[0] if known is not None else None
        there = known is not None
        out = []
        for kind, sha, ts in zip(events["type"], events["sha"], events["ts"]):
            if kind == "unlink":
                if there:
                    out.append((key[0], "DELETE", had, None, ts))
                there, had = False, None
            elif kind == "add":
                out.append((key[0], "CREATE", None, sha, ts))
                there, had = True, sha
            elif there and sha != had:
                out.append((key[0], "EDIT", had, sha, ts))
                had = sha
        if there:
            self.sha.update((had,))
        elif known is not None:
            self.sha.clear()
        if self.stale_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if there:
                self.handle.registerTimer(int(events["ts"].iloc[-1].timestamp() * 1000) + self.stale_ms)
        yield pd.DataFrame(out, columns=["path", "kind", "old", "new", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.sha.get()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], "STALE", known[0], known[0], at)] if known is not None else [], columns=["path", "kind", "old", "new", "ts"])

    def close(self) -> None:
        pass


def mutations(changes: DataFrame, registry: DataFrame, stale_ms: int | None = None, late: str = "10 seconds") -> DataFrame:
    """path, kind (CREATE, EDIT, DELETE, STALE), old, new (sha), ts of a stream of changes (path, type, ts, sha, seq), in the order of (ts, seq) within a
    micro-batch.

    registry: path, sha of what is known when the stream starts first. An unlink of a path that is not known, a change of one, and a change to the same sha
    are none; an add always is. stale_ms: a known path without an event for so long is STALE once, by a timer in event time.
    """
    df = changes.withWatermark("ts", late) if stale_ms is not None else changes
    return df.groupBy("path").transformWithStateInPandas(_Registry(stale_ms), MUTATION, "append", "EventTime" if stale_ms is not None else "None", initialState=registry.select("path", "sha").groupBy("path"))


class _Sessions(StatefulProcessor):
    """Sessions since the last that touched a path."""

    def init(self, handle) -> None:
        self.since = handle.getValueState("since", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "touched"], kind="stable")
        held = self.since.get()
        n = held[0] if held is not None else 0
        touched = events["touched"].to_numpy()
        last = touched.nonzero()[0]
        n = len(touched) - 1 - int(last[-1]) if len(last) else n + len(touched)
        self.since.update((n,))
        yield pd.DataFrame({"path": [key[0]], "since": [n], "at": [events["at"].iloc[-1]]})

    def close(self) -> None:
        pass


def sessions_since(sessions: DataFrame) -> DataFrame:
    """path, since, at: for each micro-batch with sessions (path, at, touched) of a path, how many there were after the last that touched it."""
    return sessions.groupBy("path").transformWithStateInPandas(_Sessions(), "path string, since long, at timestamp", "append", "None")


BURST = "started timestamp, ended timestamp, path string, type string"
HEARTBEAT = "heartbeat"


#: Parts of a bucket's paths, of which one at a time is in memory; rows that are set aside or handed out at once.
PARTS, ROWS = 32, 50_000
#: First event of a bin of heartbeats.
NEVER = -(1 << 63)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def _distinct(rows: pa.Table) -> pa.Table:
    return rows.group_by(rows.column_names).aggregate([])


class _Aside:
    """Rows (part, bin, path, type) of one micro-batch, in a temporary file of the task, until they are read part by part."""

    SCHEMA = pa.schema([("part", pa.int32()), ("bin", pa.int64()), ("path", pa.string()), ("type", pa.string())])

    def __init__(self):
        self.file, self.pieces, self.held, self.n = tempfile.TemporaryFile(), [[] for _ in range(PARTS)], [], 0

    def add(self, rows: pd.DataFrame) -> None:
        self.held.append(pa.Table.from_pandas(rows, self.SCHEMA, preserve_index=False))
        self.n += len(rows)
        if self.n >= ROWS:
            self.spill()

    def spill(self) -> None:
        if self.n:
            rows = pa.concat_tables(self.held).sort_by("part")
            ends = np.searchsorted(rows["part"].to_numpy(), np.arange(PARTS + 1))
            for part in range(PARTS):
                if ends[part] < ends[part + 1]:
                    data = _packed(rows.slice(ends[part], ends[part + 1] - ends[part]).drop_columns("part"))
                    self.pieces[part].append((self.file.tell(), len(data)))
                    self.file.write(data)
        self.held, self.n = [], 0

    def read(self, part: int) -> Iterator[pa.Table]:
        for at, size in self.pieces[part]:
            self.file.seek(at)
            yield _unpacked(self.file.read(size))


class _Timer(StatefulProcessor):
    """What one bucket of paths has pending in the burst that goes on, and when that began and was last added to.

    Bins come in any order, and to which burst one belongs is known when all of a micro-batch are there. Until then changes are set aside; after it they are
    made distinct and handed out, or put to the pending ones, one part of the bucket's paths at a time. Pending changes lie in pieces; one is put to
    the piece before once it is as large.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle) -> None:
        self.span = handle.getValueState("span", "started long, ended long")
        self.sizes = handle.getMapState("sizes", "part int", "rows array<long>")
        self.pending = handle.getMapState("pending", "part int, n int", "pairs binary")

    def _sizes(self, part: int) -> list[int]:
        held = self.sizes.getValue((part,)) if self.sizes.containsKey((part,)) else None
        return list(held[0]) if held is not None else []

    def _take(self, part: int, n: int) -> pa.Table:
        rows = _unpacked(self.pending.getValue((part, n))[0])
        self.pending.removeKey((part, n))
        return rows

    def _put(self, part: int, rows: pa.Table) -> None:
        sizes = self._sizes(part)
        while sizes and sizes[-1] <= rows.num_rows:
            rows = _distinct(pa.concat_tables([self._take(part, len(sizes) - 1), rows]))
            sizes.pop()
        self.pending.updateValue((part, len(sizes)), (_packed(rows),))
        self.sizes.updateValue((part,), ([*sizes, rows.num_rows],))

    def _bursts(self, bins: np.ndarray) -> tuple[np.ndarray, list[list[int]], int | None]:
        """The burst of each bin (bin, first, last, now), begin and end of the bursts, and which goes on; the first is the one in the state, if one is."""
        held = self.span.get()
        spans, on, of = ([list(held)], 0, []) if held is not None else ([], None, [])
        for _, first, last, now in bins.tolist():
            quiet = first == NEVER  # heartbeats only
            if on is not None and (now if quiet else first) - spans[on][1] > self.gap:
                on = None
            if not quiet and on is None:
                spans.append([first, last])
                on = len(spans) - 1
            elif not quiet:
                spans[on][1] = last
            of.append(-1 if on is None else on)
        return np.array(of, dtype="int64"), spans, on

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        bins, aside = [], _Aside()
        for chunk in rows:
            whole = chunk["part"] < 0
            bins.append(chunk.loc[whole, ["bin", "first", "last", "now"]].to_numpy(dtype="int64"))
            aside.add(chunk.loc[~whole, ["part", "bin", "path", "type"]])
        aside.spill()
        bins = np.concatenate(bins)
        bins = bins[np.argsort(bins[:, 0])]
        was = self.span.exists()
        of, spans, on = self._bursts(bins)
        begins, ends = (np.array([s[k] for s in spans], dtype="int64") for k in (0, 1))
        for part in range(PARTS):
            found, least = [], ROWS
            for piece in aside.read(part):
                burst = of[np.searchsorted(bins[:, 0], piece["bin"].to_numpy())]
                found.append(_distinct(piece.set_column(0, "burst", pa.array(burst))))
                if sum(x.num_rows for x in found) > least:
                    found = [_distinct(pa.concat_tables(found))]
                    least = max(ROWS, 2 * found[0].num_rows)
            if was and on != 0:
                old = [self._take(part, n) for n in range(len(self._sizes(part)))]
                self.sizes.removeKey((part,))
                found += [x.add_column(0, "burst", pa.array(np.zeros(x.num_rows, dtype="int64"))) for x in old]
            if not found:
                continue
            found = _distinct(pa.concat_tables(found))
            burst = found["burst"].to_numpy()
            if on is not None and (burst == on).any():
                self._put(part, found.filter(pa.array(burst == on)).drop_columns("burst"))
            done = found.filter(pa.array(burst != on)) if on is not None else found
            for at in range(0, done.num_rows, ROWS):
                some = done.slice(at, ROWS)
                nth = some["burst"].to_numpy()
                when = lambda x: pd.to_datetime(x[nth], unit="us", utc=True)  # noqa: B023, E731
                yield pd.DataFrame({"started": when(begins), "ended": when(ends), "path": some["path"].to_pandas(), "type": some["type"].to_pandas()})
        aside.file.close()
        if on is None:
            self.span.clear()
        else:
            self.span.update(tuple(spans[on]))

    def close(self) -> None:
        pass


def bursts(changes: DataFrame, gap_ms: int = 500, buckets: int = 8, late: str = "10 seconds") -> DataFrame:
    """started, ended, path, type: a row for each (path, type) of a burst of a stream of changes, a burst being what one timer over all paths, which every event
    resets to gap_ms, would flush at once.

    Events are reduced to bins of the gap before they are shuffled: events of one bin belong to one burst, so of all paths together the timer needs
    only the first and the last event of a bin, a row. That row goes to every bucket of paths; a bucket keeps its own pending changes, in the state
    store, and hands them out when a bin shows that the timer ran out. So neither pending changes nor bursts meet in one task. Of a bucket's changes a
    task holds one of PARTS parts at a time, and the bins of a micro-batch. The burst that goes on is
    pending until an event or a heartbeat (type HEARTBEAT, which keeps no timer waiting and is no change) comes later than the gap; events later
    than the watermark are left out.
    """
    wide = f"{gap_ms} milliseconds"
    each = changes.withWatermark("ts", late)
    real = ~F.col("type").eqNullSafe(HEARTBEAT)
    own = each.where(real).groupBy(F.window("ts", wide).alias("w"), "path", "type").agg(F.count("*").alias("n"))
    bucket, part = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64("path", F.lit(0)), F.lit(PARTS)).cast("int")
    nothing = F.lit(0).cast("long")
    own = own.select(bucket.alias("bucket"), part.alias("part"), F.unix_micros("w.start").alias("bin"), F.window_time("w").alias("at"), "path", "type", nothing.alias("first"), nothing.alias("last"), nothing.alias("now"))
    none = F.lit(None).cast("string")
    at = lambda of, when: F.coalesce(F.unix_micros(of(when)), F.lit(NEVER))
    whole = each.groupBy(F.window("ts", wide).alias("w")).agg(at(F.min, F.when(real, F.col("ts"))).alias("first"), at(F.max, F.when(real, F.col("ts"))).alias("last"), at(F.max, F.col("ts")).alias("now"))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    whole = whole.select(every.alias("bucket"), F.lit(-1).alias("part"), F.unix_micros("w.start").alias("bin"), F.window_time("w").alias("at"), none.alias("path"), none.alias("type"), "first", "last", "now")
    return own.unionByName(whole).groupBy("bucket").transformWithStateInPandas(_Timer(gap_ms), BURST, "append", "None")


def run_all(df: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, to parquet files in out."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def with_store(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, for the streams that this session starts."""
    if "RocksDB" not in spark.conf.get(STORE[0], ""):
        spark.conf.set(*STORE)
    if spark.conf.get(BOUNDED[0], None) is None:
        spark.conf.set(*BOUNDED)
