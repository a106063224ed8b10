import json

import pandas as pd
import pytest
from factories import book, rows, serie, work
from pyspark.sql import functions as F

from tomewright.sources import catalog as src
from tomewright.streaming import states


def test_catalog_files(spark, tmp_path):
    strip = lambda r: {k: v for k, v in r.items() if k != "ordinal"}
    (tmp_path / "c.json").write_text(json.dumps({"version": 2, "stats": {}, "books": [strip(book("a")), strip(book("b", rating=4))], "series": [strip(serie("s", [work("w")]))]}, indent=1))
    b, s = src.read_catalog(spark, str(tmp_path / "c.json"))
    assert rows(b, "ordinal", "id", "rating") == [(0, "a", 4.8), (1, "b", 4.0)] and s.first()["works"][0]["id"] == "w"
    (tmp_path / "bad.json").write_text(json.dumps({"version": 3, "books": []}))
    assert src.read_catalog(spark, str(tmp_path / "bad.json"))[0].count() == 0 and rows(src.catalog_problem(spark, str(tmp_path / "bad.json"))) == [("version",)]


def test_yearly_files(spark, tmp_path):
    for year in (2020, 2021):
        (tmp_path / f"{year}.json").write_text(json.dumps({"books": [{"id": f"b{year}", "releaseDate": f"{year}-01-01"}]}))
    b = src.read_years(spark, str(tmp_path))
    assert rows(b, "year", "id") == [(2020, "b2020"), (2021, "b2021")]
    src.write_by_year(b.drop("year"), str(tmp_path / "out"))
    plan = spark.read.parquet(str(tmp_path / "out")).where("year = 2021")
    assert rows(plan, "id") == [("b2021",)] and "PartitionFilters: [isnotnull(year" in plan._jdf.queryExecution().toString()


def test_health_and_logs(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"schemaVersion": 1, "generatedAt": "2026-01-01", "series": [{"id": "s"}], "works": [{"id": "w", "seriesId": "s"}]}))
    head, s, w = src.read_health(spark, str(tmp_path / "h.json"))
    assert head.count() == 1 and rows(s, "id") == [("s",)] and rows(w, "seriesId") == [("s",)]
    (tmp_path / "x.log").write_text("a" * 9000 + "\nlast")
    tail = src.log_tail(spark, str(tmp_path / "x.log")).first()["tail"]
    assert len(tail) == 8192 and tail.endswith("\nlast")
    df = spark.createDataFrame([("{}", "application/json; x"), ("{}", "text/plain"), ("{", "application/json")], "b string, t string")
    assert [r[0] for r in df.select(src.body_fits(F.col("b"), F.col("t"))).collect()] == [True, False, False]


def _run(spark, stream, name, mode="update"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_compare_and_set_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    path = str(tmp_path / "in")
    spark.createDataFrame([("u", 1, 0, "a"), ("u", 2, 0, "b"), ("u", 3, 1, "c"), ("v", 1, 1, "z")], "user_id string, seq long, base long, document string").coalesce(1).write.json(path)
    stream = spark.readStream.schema("user_id string, seq long, base long, document string").json(path)
    got = rows(_run(spark, states.compare_and_set(stream), "cas"))
    assert got == [("u", 1, True, 1, "a"), ("u", 2, False, 1, "a"), ("u", 3, True, 2, "c"), ("v", 1, False, 0, "")]


def test_one_time_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    path, schema = str(tmp_path / "in"), "token string, seq long, kind string, payload string"
    spark.createDataFrame([("t", 1, "issue", "p"), ("t", 2, "claim", None), ("t", 3, "claim", None), ("x", 1, "claim", None)], schema).coalesce(1).write.json(path)
    got = rows(_run(spark, states.one_time(spark.readStream.schema(schema).json(path), 600), "once"))
    assert got == [("t", 2, "p"), ("t", 3, None), ("x", 1, None)]


def test_one_time_takes_many_tokens_in_a_call():
    class Pending(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

        def removeKey(self, k):
            self.pop(k, None)

    one = states.OneTime(600)
    one.state = Pending()
    batch = lambda *rows: iter([pd.DataFrame(rows[:2], columns=["token", "seq", "kind", "payload"]), pd.DataFrame(rows[2:], columns=["token", "seq", "kind", "payload"])])
    told = lambda *rows: sorted(tuple(r) for out in one.handleInputRows((0,), batch(*rows), None) for r in out.itertuples(index=False))
    many = [(f"m{i}", j, k, p) for i in range(500) for j, k, p in ((1, "claim", None), (0, "issue", f"p{i}"))]
    assert told(*many) == sorted((f"m{i}", 1, f"p{i}") for i in range(500)) and one.state.calls == 0 and not one.state
    assert told(("t", 2, "claim", None), ("t", 1, "issue", "p"), ("u", 1, "issue", "q"), ("x", 1, "claim", None), ("t", 3, "claim", None)) == [("t", 2, "p"), ("t", 3, None), ("x", 1, None)]
    assert one.state == {("u",): ("q",)}
    assert told(("u", 2, "claim", None), ("x", 2, "claim", None), ("u", 3, "claim", None), ("v", 1, "issue", "r")) == [("u", 2, "q"), ("u", 3, None), ("x", 2, None)] and one.state == {("v",): ("r",)}


def test_windows_and_upserts(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id long, ts timestamp_ntz, k string"
    spark.createDataFrame([(1, "2026-01-01 01:00:00", "a"), (2, "2026-01-01 02:00:00", "a"), (3, "2026-01-02 02:00:00", "b")], "id long, ts string, k string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    got = _run(spark, states.windowed_counts(stream, by=("k",)), "win", "complete")
    assert rows(got, "k", "n") == [("a", 2), ("b", 1)]
    out = str(tmp_path / "out")
    q = spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(states.upsert_sink(out, ["k"], ["ts", "id"], [])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(out), "k", "id") == [("a", 2), ("b", 3)]


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    import glob

    out, sink = str(tmp_path / "t"), states.upsert_sink(str(tmp_path / "t"), ["k"], ["n"], ["v"], 8)
    batch = lambda *r: spark.createDataFrame(list(r), "k string, n int, v string")
    sink(batch(*[(f"k{i}", 1, "old") for i in range(40)]), 0)
    before = set(glob.glob(f"{out}/bucket=*/*.parquet"))
    for number in (1, 1):  # a batch may come again
        sink(batch(("k3", 2, "new"), ("k3", 1, "late"), ("k99", 1, "more")), number)
        got = {r["k"]: (r["n"], r["v"]) for r in spark.read.parquet(out).collect()}
        assert got == {**{f"k{i}": (1, "old") for i in range(40)}, "k3": (2, "new"), "k99": (1, "more")}
    kept = before & set(glob.glob(f"{out}/bucket=*/*.parquet"))
    assert len({p.split("/")[-2] for p in before} - {p.split("/")[-2] for p in kept}) <= 2 and kept
    sink(batch(), 2)
    assert spark.read.parquet(out).count() == 41


def test_every_runs_batches(spark, tmp_path):
    path, schema, seen = str(tmp_path / "in"), "id long", []
    spark.range(3).write.parquet(path)
    q = states.every(spark.readStream.schema(schema).parquet(path), lambda batch, n: seen.append(batch.count()), states.SETTLE, str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(seen) == 3


def test_json_is_parsed_once(spark):
    """However many fields are asked for; a library of version 1 is a second form of it."""
    from tomewright.operators import library

    docs = ['{"version":2,"library":{"version":2,"series":{"s":{"followedAt":"1998-01-01"},"x y":{"followedAt":"1998-01-01"}},"books":{}}}', '{"version":2,"library":{"series":{}}}', '{"version":2,"series":{"t":{"followedAt":"1998-01-02"}},"books":{}}',
            '{"version":1,"library":{"version":{"status":"read"},"b":{"status":"want"}}}', '{"version":1,"library":null}', '{"version":3,"library":{"series":{}}}', "{not", None]
    raw = spark.createDataFrame(list(enumerate(docs)), "k int, json string").select("k", src.parse_library(F.col("json")).alias("l"))
    assert [(r["k"], r["l"] and r["l"]["version"], r["l"] and r["l"]["books"] and sorted(r["l"]["books"])) for r in raw.orderBy("k").collect()] == [(0, 2, {}), (1, None, None), (2, 2, {}), (3, 1, ["b", "version"]), (4, None, None), (5, None, None), (6, None, None), (7, None, None)]
    follows = library.parse_follows(raw.select("k", F.col("l.series").alias("series")))
    assert rows(follows, "k", "series_id") == [(0, "s"), (2, "t")]
    times = lambda df: df._jdf.queryExecution().executedPlan().toString().count("from_json(")
    assert times(follows) == 2
    health = spark.createDataFrame([('{"schemaVersion":1,"generatedAt":"x","works":[{"id":"a"},null]}',), ('{"schemaVersion":2,"generatedAt":"x","works":[{"id":"b"}]}',), ('{"schemaVersion":1,"works":[{"id":"c"}]}',), ('{"schemaVersion":1,"generatedAt":"x","works":[]}',)], "json string")
    head, series, works = src.parse_health(health, "json")
    assert head.count() == 2 and series.count() == 0 and [(r["ordinal"], r["id"]) for r in works.orderBy("ordinal").collect()] == [(0, "a"), (1, None)] and times(works.select("id", "seriesId")) == 1
