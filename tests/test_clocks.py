"""Streams with timers, against plain versions and against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators import coverage
from tomewright.storage import Snapshots
from tomewright.streaming import clocks

T0 = dt.datetime(2024, 1, 1)
EVENTS = "token string, seq long, kind string, payload string, at timestamp"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def streamed(spark, tmp_path, batches, schema, operator, name="s"):
    """What a stream gives that takes one file after the other, stopped and started again in between."""
    source, out, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        clocks.run_once(operator(stream), out, check)
    return spark.read.parquet(out)


def plain_claims(events, life, watermark):
    pending, out = {}, []
    for token, seq, kind, payload, t in sorted(events, key=lambda e: (e[4], e[1])):
        if token in pending and pending[token][2] <= t:
            p, s, until = pending.pop(token)
            out.append((token, s, until, "expired", p))
        if kind == "issue":
            pending[token] = (payload, seq, t + dt.timedelta(seconds=life))
        else:
            p = pending.pop(token, None)
            out.append((token, seq, t, "claimed" if p else "refused", p and p[0]))
    return sorted(out + [(k, s, until, "expired", p) for k, (p, s, until) in pending.items() if until <= watermark], key=repr)


def test_claims_expire_by_timer(spark, tmp_path):
    rng = random.Random(7)
    events = [(f"t{rng.randrange(12)}", k, rng.choice(["issue", "claim"]), f"p{k}", at(k * 40 + rng.randrange(30))) for k in range(120)]
    events += [("gone", 200, "issue", "x", at(10)), ("kept", 201, "issue", None, at(4800))]
    events.sort(key=lambda e: e[4])
    got = streamed(spark, tmp_path, [events[:50], events[50:90], events[90:]], EVENTS, lambda s: clocks.expiring_claims(s, 600))
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == plain_claims(events, 600, events[-1][4])
    assert ("gone", 200, at(610), "expired", "x") in rows and {"claimed", "refused", "expired"} == {r[3] for r in rows}


def test_a_claim_after_its_time_gets_nothing(spark, tmp_path):
    events = [("a", 1, "issue", "p", at(0)), ("a", 2, "claim", None, at(600)), ("b", 3, "issue", "q", at(0)), ("b", 4, "claim", None, at(599)), ("c", 5, "claim", None, at(1))]
    got = streamed(spark, tmp_path, [events], EVENTS, lambda s: clocks.expiring_claims(s, 600))
    assert sorted(((r["token"], r["seq"], r["outcome"], r["payload"]) for r in got.collect()), key=repr) == [("a", 1, "expired", "p"), ("a", 2, "refused", None), ("b", 4, "claimed", "q"), ("c", 5, "refused", None)]


COVERAGE = "series_id string, coverage struct<status:string,current:boolean,assessedAt:string,validUntil:string>, at timestamp"


def test_freshness_equals_the_batch_form_at_every_tick(spark, tmp_path):
    rng = random.Random(3)
    text = lambda s: None if s is None else at(s).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = []
    for k in range(90):
        s = k * 20
        start = rng.choice([s - 50, s, s + rng.randrange(1, 300)])
        end = rng.choice([None, start + rng.randrange(-20, 500)])
        rows.append((f"s{rng.randrange(9)}", (rng.choice(["verified"] * 4 + ["unknown"]), rng.random() < 0.9, text(start) if rng.random() < 0.95 else "2024-01-01", text(end)), at(s)))
    changes = streamed(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]], COVERAGE, clocks.freshness).cache()
    table = spark.createDataFrame(rows, COVERAGE)
    for s in [0, 1, 19, 20, 250, 333, 700, 1111, 1500, 1779, 1780]:
        last = table.where(F.col("at") <= F.lit(at(s))).groupBy("series_id").agg(F.max_by("coverage", "at").alias("coverage"))
        want = {tuple(r) for r in last.select("series_id", coverage.coverage_current(F.col("coverage"), at(s).strftime("%Y-%m-%dT%H:%M:%SZ"))).collect()}
        assert {tuple(r) for r in clocks.state_at(changes, "series_id", "current", F.lit(at(s))).collect()} == want, s


def test_no_events(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]], EVENTS, lambda s: clocks.expiring_claims(s, 600)).count() == 0


def test_a_killed_sync_goes_on_without_loss_or_repeat(spark, tmp_path, monkeypatch):
    schema = "user_id long, seq long, document string"
    table = Snapshots(spark, str(tmp_path / "table"), ["user_id"], ["seq"])
    source, check = str(tmp_path / "in"), str(tmp_path / "check")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        clocks.sync(spark.readStream.schema(schema).parquet(source), table, "edits", check)

    add([(1, 1, "a"), (2, 1, "b")])
    run()
    assert table.version().batches == {"edits": 0}
    add([(1, 2, "c")])
    merge = Snapshots.merge
    with monkeypatch.context() as m:  # killed before the merge: nothing has happened

        def killed(self, *a, **b):
            raise RuntimeError("killed")

        m.setattr(Snapshots, "merge", killed)
        with pytest.raises(Exception, match="killed"):
            run()
    assert table.numbers() == [1]
    with monkeypatch.context() as m:  # killed after it: the batch is there, but not in the checkpoint

        def late(self, *a, **b):
            merge(self, *a, **b)
            raise RuntimeError("killed")

        m.setattr(Snapshots, "merge", late)
        with pytest.raises(Exception, match="killed"):
            run()
    assert table.numbers() == [1, 2]
    add([(2, 2, "d"), (3, 1, "e")])
    run()
    run()
    assert sorted(tuple(r) for r in table.read(schema).collect()) == [(1, 2, "c"), (2, 2, "d"), (3, 1, "e")]
    assert table.numbers() == [1, 2, 3] and table.version().batches == {"edits": 2}
