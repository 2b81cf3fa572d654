"""Cache hits by TTL, growth and session roll-ups: batch against row-by-row walks, streams against the batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.operators import reports as R
from strata.operators import sessions as S
from strata.streaming import keyed as K

START = datetime(2024, 1, 1)
KIND = "event_id long, tool string, args string, ts timestamp, n long"


def calls(seed, n=400):
    """Dense and sparse keys, equal times, exact multiples of the TTL, null parts of keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tool = rng.choice(["a", "a", "a", "b", None])
        at = rng.choice([rng.randrange(0, 400 * 10**6), rng.randrange(0, 40) * 10**7, rng.randrange(0, 4000) * 10**6, 3_000_000_000])
        rows.append((i, tool, rng.choice(["x", "", None]) if tool != "a" else "x", START + timedelta(microseconds=at), rng.randrange(9)))
    return rows


def walked(rows, ttl=30):
    last, out = {}, {}
    for i, tool, args, ts, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        hit = (tool, args) in last and ts - last[tool, args] < timedelta(seconds=ttl)
        if not hit:
            last[tool, args] = ts
        out[i] = hit
    return out


@pytest.mark.parametrize("seed,span", [(1, 4096), (2, 2), (3, 1)])
def test_hits_equal_a_walk(spark, monkeypatch, seed, span):
    monkeypatch.setattr(S, "SPAN", span)
    rows = calls(seed)
    got = S.cache_hits(spark.createDataFrame(rows, KIND), ["tool", "args"], "ts", "event_id")
    assert got.columns == ["event_id", "tool", "args", "ts", "n", "hit"]
    assert {r["event_id"]: r["hit"] for r in got.collect()} == walked(rows)


def test_calls_at_twenty_second_steps(spark):
    rows = [(i, "a", "x", START + timedelta(seconds=20 * i), 0) for i in range(7)] + [(9, "a", "x", None, 0)]
    got = S.cache_hits(spark.createDataFrame(rows, KIND), ["tool", "args"], "ts", "event_id").orderBy("event_id").collect()
    assert [r["hit"] for r in got] == [False, True, False, True, False, True, False, None]
    assert S.cache_hits(spark.createDataFrame([], KIND), ["tool"], "ts", "event_id").count() == 0


def files_of(spark, df, path, parts):
    for k, cut in enumerate(parts):
        df.filter(cut).coalesce(1).write.mode("append").parquet(str(path))


def streamed(spark, make, source, out, checkpoint, kind=KIND):
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = make(s).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.fixture(scope="module")
def streams(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_of_hits_equals_batch(spark, streams, tmp_path):
    rows = sorted(calls(5, 200), key=lambda r: r[3])
    late = [r for k, r in enumerate(rows) if k % 9 == 0]
    first = [r for r in rows if r not in late and r[3] < START + timedelta(seconds=500)]
    rest = [r for r in rows if r not in late and r not in first] + [(10**6, "end", "", START + timedelta(days=1), 0)]
    make = lambda s: K.cache_hit_stream(s, ["tool", "args"], late="2 hours")
    for part in (first, late):  # late rows come after all others of their time, and rows repeat
        spark.createDataFrame(part + part[:5], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streamed(spark, make, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    spark.createDataFrame(rest, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streamed(spark, make, tmp_path / "in", tmp_path / "out", tmp_path / "cp")
    got = sorted((r["id"], r["t"], r["hit"]) for r in spark.read.schema(K.HITS).parquet(str(tmp_path / "out")).collect())
    batch = S.cache_hits(spark.read.schema(KIND).parquet(str(tmp_path / "in")), ["tool", "args"], "ts", "event_id").filter("tool is null or tool <> 'end'")
    assert got == sorted((r["event_id"], r["ts"], r["hit"]) for r in batch.collect())


def test_stream_of_growth_equals_batch(spark, streams, tmp_path):
    rows = [(i, f"k{i % 3}", "", START + timedelta(hours=i), i * i % 7) for i in range(12)]
    make = lambda s: K.growth_stream(s, ["tool"], "ts", "n")
    for part in (rows[:7], rows[7:] + [(99, "end", "", START + timedelta(days=9), 0)]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streamed(spark, make, tmp_path / "in", tmp_path / "out", tmp_path / "cp")  # the second run goes on from the checkpoint
    got = spark.read.schema(K.GROWTH).parquet(str(tmp_path / "out")).collect()
    batch = R.growth(spark.createDataFrame(rows, KIND), "tool", "ts", "n").filter("delta is not null").collect()
    assert sorted((r["to_ts"], r["delta"], r["per_hour"], r["trend"]) for r in got) == sorted((r["ts"], float(r["delta"]), r["per_hour"], r["trend"]) for r in batch)


def test_sessions_end_by_close_or_idleness(spark, streams, tmp_path):
    kind = "session string, ts timestamp, tokens long, hit boolean, mark string"
    at = lambda s: START + timedelta(seconds=s)
    one = [("a", at(0), 10, False, ""), ("a", at(5), 20, True, ""), ("b", at(1), 1, False, ""), ("b", at(2), 0, False, "close")]
    two = [("a", at(9), 5, True, ""), ("b", at(4), 7, False, ""), ("a", at(200), 1, False, "")]
    make = lambda s: K.session_stream(s, ["session"], "ts", "tokens", "hit", "mark", 60, "10 seconds")
    for part in (one, two, [("end", at(9000), 0, False, "")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streamed(spark, make, tmp_path / "in", tmp_path / "out", tmp_path / "cp", kind)
    got = sorted((r["k"], r["started"], r["ended"], r["calls"], r["tokens"], r["cache_hits"], r["closed_by"]) for r in spark.read.schema(K.ROLLUP).parquet(str(tmp_path / "out")).collect())
    a, b = '["=a"]', '["=b"]'
    assert got == [(a, at(0), at(9), 3, 35, 2, "idle"), (a, at(200), at(200), 1, 1, 0, "idle"), (b, at(1), at(2), 1, 1, 0, "close"), (b, at(4), at(4), 1, 7, 0, "idle")]


def test_session_metrics(spark):
    x = spark.createDataFrame([(1, 100, True), (2, 900, False)], "id long, n long, hit boolean")
    assert S.session_metrics(x, F.col("n"), F.col("hit")).first().asDict() == {"calls": 2, "tokens": 1000, "saved": 0, "ratio": "0%", "cache_hits": 1}
    assert S.session_metrics(x.filter("id > 5"), F.col("n"), F.col("hit")).first().asDict() == {"calls": 0, "tokens": 0, "saved": 0, "ratio": "n/a", "cache_hits": 0}


class Kept:
    """A value state in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("alone", [False, True])
def test_growth_of_points_of_one_time(alone):
    p = K.LatestGrowth(*[alone] * alone)
    p.last = Kept()
    assert len(p.taken("a", [(0, 0, 5, ""), (0, 0, 9, "")])) == (0 if alone else 1)
    out = p.taken("a", [(10, 0, 1, ""), (20, 0, 2, ""), (20, 0, 3, ""), (30, 0, 7, "")])
    assert out["delta"].tolist() == ([6.0] if alone else [-8.0, 1.0, 1.0, 4.0])
