"""Keyed state over event streams: cache hits by TTL, growth between the last two points, session roll-ups.

State is kept per key by ``transformWithStateInPandas`` in the RocksDB store, so a query that is stopped and
started from its checkpoint goes on where it was. Rows are held until the watermark has passed them and
then taken in the order of their times, so late rows within the watermark give the same result as
the batch operators; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strata.operators.sessions import cache_key

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HITS = "k string, id long, t timestamp, hit boolean"
GROWTH = "k string, from_ts timestamp, to_ts timestamp, delta double, per_hour double, trend string"
ROLLUP = "k string, started timestamp, ended timestamp, calls long, tokens long, cache_hits long, closed_by string"


def stamp(us: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(us, unit="us"))


def after(us: int) -> int:
    """The first millisecond that is not before a microsecond."""
    return -(-us // 1000)


#: Rows as they are held: time, id, number, mark; whole parts of many rows are values of the state.
HELD = pa.schema([("t", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("mark", pa.string())])
#: Rows of one part.
PART = 100_000


def packed(rows: pa.Table) -> list[tuple]:
    """(least time, part) of parts of at most PART rows, as the state holds them."""
    out = []
    for s in range(0, rows.num_rows, PART):
        part, sink = rows.slice(s, PART), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, HELD) as w:
            w.write_table(part)
        out.append((pc.min(part["t"]).as_py(), sink.getvalue().to_pybytes()))
    return out


def unpacked(parts: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts]) if parts else HELD.empty_table()


def timed(some: list[pd.DataFrame]) -> pa.Table:
    """Rows that have a time, as they are held."""
    x = pd.concat(some)
    x = x[x["t"].notna()]
    t = x["t"].astype("datetime64[us]").astype("int64").to_numpy()
    return pa.table([pa.array(t), pa.array(x["id"].astype("int64").to_numpy()), pa.array(x["n"].astype("int64").to_numpy()), pa.array(x["mark"], pa.string(), from_pandas=True)], schema=HELD)


class InOrder(StatefulProcessor):
    """Holds rows (t, id, number, mark) until the watermark has passed them, then hands them on in order.

    A key has one timer, at its earliest held row; when it fires, all rows that the watermark has passed are
    taken at once, so a row is read twice however many its key holds. Rows go to and from the state in
    parts, as each value costs a message.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "first long, rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, ms: int) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def hold(self, some: list[pd.DataFrame]) -> int | None:
        """The least time of rows that are now held."""
        rows = timed(some)
        if not rows.num_rows:
            return None
        self.held.appendList(packed(rows))
        return pc.min(rows["t"]).as_py()

    def most(self) -> int:
        """Rows that are taken in before they are held."""
        return PART

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, some, n = [], [], 0
        for x in rows:
            some.append(x)
            n += len(x)
            if n >= self.most():
                first.append(self.hold(some))
                some, n = [], 0
        if some:
            first.append(self.hold(some))
        first = [t for t in first if t is not None]
        if first:
            self.wake(after(min(first)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.timer.exists() or self.timer.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [(f, bytes(p)) for f, p in self.held.get()]
        rest = [p for p in parts if p[0] > passed]
        held = unpacked([p for f, p in parts if f <= passed])
        late = held.filter(pc.greater(held["t"], passed))
        rest += packed(late)
        if rest:
            self.held.put(rest)
            self.wake(after(min(f for f, _ in rest)))
        else:
            self.held.clear()
        due = held.filter(pc.less_equal(held["t"], passed)).sort_by([(c, "ascending") for c in HELD.names])
        out = self.due(key[0], due) if due.num_rows else []
        return iter([out]) if len(out) else iter(())

    def due(self, key: str, rows: pa.Table) -> pd.DataFrame:
        """The result of rows in their order, a table or the tuples of ``taken``."""
        return self.taken(key, list(zip(*(rows[c].to_pylist() for c in HELD.names), strict=True)))

    def taken(self, key: str, due: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class CacheHits(InOrder):
    """Hit or miss of each call: the state is the time of the key's last miss."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.miss = handle.getValueState("miss", "t long")

    def due(self, key: str, rows: pa.Table) -> pd.DataFrame:
        last = self.miss.get()[0] if self.miss.exists() else None
        t = rows["t"].to_numpy()
        hits = np.ones(len(t), np.bool_)
        at = 0 if last is None else int(np.searchsorted(t, last + self.ttl))
        while at < len(t):  # a step per miss
            hits[at], last = False, int(t[at])
            at = max(at + 1, int(np.searchsorted(t, last + self.ttl)))
        self.miss.update((last,))
        return pd.DataFrame({"k": key, "id": rows["id"].to_numpy(), "t": t.astype("datetime64[us]"), "hit": hits})


#: Rows of a sorted run, and of a piece of one.
RUN, PIECE = 500_000, 5_000


class InRuns(InOrder):
    """As ``InOrder``, for keys of so many rows that no task can hold them at once.

    Held rows are sorted runs, cut into pieces that are values of their own. They are merged piece by piece: a task
    holds about PART rows and a piece of each run, and hands on rows of one time together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "piece long", "rows binary")
        self.heads = handle.getListState("heads", "first long, piece long")
        self.next = handle.getValueState("next", "piece long")
        self.timer = handle.getValueState("timer", "ms long")

    def most(self) -> int:
        return RUN

    def cut(self, run: pa.Table) -> list[tuple]:
        """(least time, piece) of the pieces of a sorted run, which are now values of the state."""
        n, heads = self.next.get()[0] if self.next.exists() else 0, []
        for s in range(0, run.num_rows, PIECE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, HELD) as w:
                w.write_table(run.slice(s, PIECE))
            self.held.updateValue((n,), (sink.getvalue().to_pybytes(),))
            heads.append((run["t"][s].as_py(), n))
            n += 1
        self.next.update((n,))
        return heads

    def hold(self, some: list[pd.DataFrame]) -> int | None:
        rows = timed(some).sort_by([(c, "ascending") for c in HELD.names])
        if not rows.num_rows:
            return None
        heads = self.cut(rows)
        self.heads.appendList(heads)
        return heads[0][0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.timer.exists() or self.timer.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        heads = sorted(tuple(h) for h in self.heads.get())
        rest, pool, new = [h for h in heads if h[0] > passed], HELD.empty_table(), []
        heads = [h for h in heads if h[0] <= passed]
        for i, (_, n) in enumerate(heads):
            new.append(unpacked([bytes(self.held.getValue((n,))[0])]))
            self.held.removeKey((n,))
            end = i + 1 == len(heads)
            if end or sum(x.num_rows for x in new) >= PART:
                pool, new = pa.concat_tables([pool, *new]).sort_by([(c, "ascending") for c in HELD.names]), []
                k = int(np.searchsorted(pool["t"].to_numpy(), passed + 1 if end else heads[i + 1][0]))
                out = self.due(key[0], pool.slice(0, k)) if k else ()
                pool = pool.slice(k)
                if len(out):
                    yield out
        if pool.num_rows:
            rest += self.cut(pool)
        if rest:
            self.heads.put(rest)
            self.wake(after(min(f for f, _ in rest)))
        else:
            self.heads.clear()


class LatestGrowth(InRuns):
    """Difference between the last two points of a key, a row for each new point.

    alone: points that share their time with another one of the key are left out, as none of them is the value of that time.
    """

    def __init__(self, alone: bool = False):
        self.alone = alone

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "t long, n long")

    def taken(self, key: str, due: list[tuple]) -> pd.DataFrame:
        return self.due(key, pa.table([pa.array(c) for c in zip(*due, strict=True)], schema=HELD))

    def due(self, key: str, rows: pa.Table) -> pd.DataFrame:
        t, n = rows["t"].to_numpy(), rows["n"].to_numpy()
        if self.alone:  # rows of one time come together
            one, as_next = np.ones(len(t), np.bool_), t[1:] == t[:-1]
            one[1:] &= ~as_next
            one[:-1] &= ~as_next
            t, n = t[one], n[one]
        if self.last.exists():
            before = self.last.get()
            t, n = np.concatenate(([before[0]], t)), np.concatenate(([before[1]], n))
        if len(t):
            self.last.update((int(t[-1]), int(n[-1])))
        delta, hours, at = np.diff(n).astype(float), np.diff(t) / 3.6e9, t.astype("datetime64[us]")
        per_hour = np.divide(delta, hours, out=np.full(len(delta), np.nan), where=hours > 0)
        trend = np.select([hours <= 0, delta > 0, delta < 0], ["insufficient_data", "increasing", "decreasing"], "stable")
        return pd.DataFrame({"k": key, "from_ts": at[:-1], "to_ts": at[1:], "delta": delta, "per_hour": per_hour, "trend": trend.astype(object)})


class SessionRollup(InOrder):
    """One row per session when it ends: at a row marked 'close', or ``idle`` microseconds after its last one."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "started long, ended long, calls long, tokens long, hits long")

    def taken(self, key: str, due: list[tuple]) -> pd.DataFrame:
        rows = []
        now = list(self.open.get()) if self.open.exists() else None
        for t, hit, n, mark in due:
            if now is not None and t - now[1] >= self.idle:
                rows.append((key, *now, "idle"))
                now = None
            now = [t, t, 0, 0, 0] if now is None else now
            now[1] = t
            if mark == "close":
                rows.append((key, *now, "close"))
                now = None
            else:
                now[2:] = [now[2] + 1, now[3] + n, now[4] + hit]
        if now is None:
            self.open.clear()
        else:
            self.open.update(tuple(now))
        return self.table(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = list(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))
        if self.open.exists():
            now, passed = self.open.get(), timerValues.getCurrentWatermarkInMs()
            end = now[1] + self.idle
            if after(end) > passed:  # a timer behind the watermark would not fire
                self.handle.registerTimer(after(end))
            else:  # all rows before the watermark were taken
                out.append(self.table([(key[0], *now, "idle")]))
                self.open.clear()
        return iter(out)

    @staticmethod
    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["k", "started", "ended", "calls", "tokens", "cache_hits", "closed_by"])
        return out.assign(started=stamp(out["started"].tolist()), ended=stamp(out["ended"].tolist())) if rows else out


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def keyed(stream: DataFrame, processor: StatefulProcessor, out: str, ts: str, late: str, key: list[str], **columns) -> DataFrame:
    with_state_store(stream.sparkSession)
    x = stream.select(cache_key(*key).alias("k"), F.col(ts).cast("timestamp").alias("t"), columns["id"].cast("long").alias("id"), F.coalesce(columns["n"].cast("long"), F.lit(0)).alias("n"), columns["mark"].cast("string").alias("mark"))
    return x.withWatermark("t", late).groupBy("k").transformWithStateInPandas(processor, out, "append", "eventTime")


def cache_hit_stream(stream: DataFrame, key: list[str], ts: str = "ts", id_col: str = "event_id", ttl_seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """(k, id, t, hit) of each call, as ``sessions.cache_hits`` gives it for the same rows."""
    return keyed(stream, CacheHits(ttl_seconds * 1_000_000), HITS, ts, late, key, id=F.col(id_col), n=F.lit(0), mark=F.lit(""))


def growth_stream(stream: DataFrame, key: list[str], ts: str, value: str, late: str = "1 minute", alone: bool = False) -> DataFrame:
    """(k, from_ts, to_ts, delta, per_hour, trend) of each point and the one before; alone: without points of one key and time."""
    return keyed(stream, LatestGrowth(alone), GROWTH, ts, late, key, id=F.lit(0), n=F.col(value), mark=F.lit(""))


def session_stream(stream: DataFrame, key: list[str], ts: str, tokens: str, hit: str, mark: str, idle_seconds: int, late: str = "1 minute") -> DataFrame:
    """One row per ended session of a key."""
    return keyed(stream, SessionRollup(idle_seconds * 1_000_000), ROLLUP, ts, late, key, id=F.coalesce(F.col(hit).cast("long"), F.lit(0)), n=F.col(tokens), mark=F.col(mark))
