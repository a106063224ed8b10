"""Versioned tables, the search index, ranged tails and pruned years."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tomewright.sources import catalog as sources
from tomewright.sources import search_index, tails
from tomewright.storage import Conflict, Snapshots, scratch, snapshot_sink

ROW = "id long, seq long, value string"


def table(spark, tmp_path, **more):
    return Snapshots(spark, str(tmp_path / "t"), ["id"], ["seq"], **more)


def shown(t, number=None):
    return sorted(tuple(r) for r in t.read(ROW, number).collect())


def test_latest_rows_by_version(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    assert shown(t) == [] and t.version().number == 0
    assert t.merge(spark.createDataFrame([], ROW)) == 0
    assert t.merge(spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (1, 3, "c"), (3, 1, None)], ROW)) == 1
    first = [(1, 3, "c"), (2, 5, "b"), (3, 1, None)]
    assert shown(t) == first
    before = t.version().folders
    assert t.merge(spark.createDataFrame([(2, 4, "late"), (2, 6, "new")], ROW)) == 2
    assert shown(t) == [(1, 3, "c"), (2, 6, "new"), (3, 1, None)] and shown(t, 1) == first
    assert sum(v != before[k] for k, v in t.version().folders.items()) == 1  # only the bucket of id 2
    t.merge(spark.createDataFrame([(2, 6, "tie"), (2, 6, "atie")], ROW))
    assert (2, 6, "tie") in shown(t)
    t.vacuum(keep=1)
    assert t.numbers() == [3] and (2, 6, "tie") in shown(t) and len(os.listdir(tmp_path / "t" / "data")) <= 3


def test_a_failing_write_leaves_the_table(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, 1, "a")], ROW))
    reader = t.read(ROW)
    bad = spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], ROW).withColumn("value", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        t.merge(bad)
    assert shown(t) == [(1, 1, "a")] and t.numbers() == [1]
    t.merge(spark.createDataFrame([(1, 9, "z")], ROW))
    assert [tuple(r) for r in reader.collect()] == [(1, 1, "a")]  # a reader keeps the version it has planned for


def test_of_two_writers_one_starts_again(spark, tmp_path):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    seen = a.version()
    b.merge(spark.createDataFrame([(1, 1, "b")], ROW))
    with pytest.raises(Conflict):
        a.merge(spark.createDataFrame([(2, 1, "a")], ROW), base=seen)
    assert shown(a) == [(1, 1, "b")]
    assert a.merge_again(spark.createDataFrame([(2, 1, "a")], ROW)) == 2
    assert shown(b) == [(1, 1, "b"), (2, 1, "a")]
    assert not [f for f in os.listdir(tmp_path / "t" / "manifests") if f.endswith(".tmp")]


def test_batches_of_a_stream_count_once(spark, tmp_path):
    t = table(spark, tmp_path)
    write = snapshot_sink(t, "s", ["id", "seq", "value"])
    write(spark.createDataFrame([(1, 1, "a")], ROW), 0)
    write(spark.createDataFrame([(1, 2, "b")], ROW), 1)
    write(spark.createDataFrame([(1, 3, "again")], ROW), 1)
    assert shown(t) == [(1, 2, "b")] and t.version().batches == {"s": 1}


def test_scratch_needs_a_shared_folder(spark):
    assert scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


TEXTS = [(1, "The Dungeon of Ash"), (2, "dungeons & dragons"), (3, None), (4, ""), (5, "aé日本 ash"), (6, "x" * 5000 + " ash dungeon"), (7, "ab")]


def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "CHARS", 40)  # lists of several slices
    path = str(tmp_path / "index")
    rows = spark.createDataFrame(TEXTS, "id long, text string").selectExpr("*", "'n' as n", "1 as gram", "2 as folder", "3 as home")
    search_index.build_index(rows, path)
    asked = ["ash", "ASH dungeon", "dungeon ash", "a", "é日", "日本", "b", "zzz", "dungeons dragons &", " ", "ab", "x" * 5000, "xyz ash", "n  of"]
    for q in asked:
        want = {i for i, t in TEXTS if all(w in (t or "").lower() for w in q.lower().split())}
        assert {r[0] for r in search_index.search_index(spark, path, q).collect()} == want, q
    many = spark.createDataFrame(list(enumerate(asked)) + [(99, None)], "query_id long, query string")
    got = {tuple(r) for r in search_index.search_many(spark, path, many).collect()}
    assert got == {(k, i) for k, q in enumerate(asked) if q.split() for i, t in TEXTS if all(w in (t or "").lower() for w in q.lower().split())}


def test_index_reads_lists_and_few_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "CHARS", 400)
    path = str(tmp_path / "index")
    rows = spark.range(3000).select("id", F.concat(F.lit("record number "), F.col("id").cast("string"), F.when(F.col("id") == 77, " quixotic").otherwise("")).alias("text"))
    search_index.build_index(rows, path)
    found = search_index.search_index(spark, path, "quixotic record")
    assert [r[0] for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("PushedFilters")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any("folder#" in x for x in filters) and any("home#" in x for x in filters) and "PushedFilters: [In(gram" in plan


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    search_index.build_index(spark.createDataFrame([], "id long, text string"), path)
    assert search_index.search_many(spark, path, spark.createDataFrame([(1, "a")], "query_id long, query string")).count() == 0


def test_search_of_the_library_through_the_index(spark, tmp_path):
    """Searches over editions and over series give the same through the index as by scanning."""
    from factories import SF

    from tomewright.operators import catalog, series
    from tomewright.plans import adapted, adapted_queries

    books = adapted.books(spark, SF)
    catalog.index_books(books, str(tmp_path / "books"))
    for q in (" Dungeons  BRAND#1 1", "academy", "author 3 ned", ""):
        assert sorted(r[0] for r in search_index.search_index(spark, str(tmp_path / "books"), q).collect()) == sorted(r[0] for r in catalog.search_books(books, q).select("id").collect())
    shelves = adapted_queries._shelves(books)
    series.index_series(shelves, books, str(tmp_path / "series"))
    for q in ("alias LitRPG", "ned brand#2", "credit 5"):
        assert sorted(r[0] for r in search_index.search_index(spark, str(tmp_path / "series"), q).collect()) == sorted(r[0] for r in series.search_series(shelves, books, q).select("id").collect())


def test_tail_of_a_sparse_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "a.log", "wb") as f:
        f.truncate(3 << 30)
        f.seek(0, 2)
        f.write("…end\n".encode())
    (tmp_path / "b.log").write_text("short")
    (tmp_path / "c.log").touch()
    (tmp_path / ".hidden").write_text("no")
    read = 0
    for r in tails.TailReader(str(tmp_path), 4).read(tails.TailReader(str(tmp_path), 4).partitions()[0]):
        read += len(r[2])
    assert read == 8
    got = {r["file"].rpartition("/")[2]: r["tail"] for r in sources.log_tail(spark, str(tmp_path), 6).collect()}
    assert got == {"a.log": "��end\n", "b.log": "short", "c.log": ""}
    assert [r["file"] for r in sources.log_tail(spark, f"file://{tmp_path}/b.*").collect()] == [f"{tmp_path}/b.log"]


def test_years_are_pruned_by_name(spark, tmp_path):
    for year in (1998, 1999, 2000, 2001):
        (tmp_path / f"{year}.json").write_text(json.dumps({"books": [{"id": f"b{year}", "title": "t"}, {"id": f"c{year}", "title": "u"}]}))
    (tmp_path / "notes.json").write_text("{}")
    all_ = sources.read_years(spark, str(tmp_path))
    assert all_.count() == 8
    one = all_.where("year = 1999").select("year", "ordinal", "id")
    assert sorted(tuple(r) for r in one.collect()) == [(1999, 0, "b1999"), (1999, 1, "c1999")]
    plan = one._jdf.queryExecution()
    scans = []  # files that the scan has read

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            scans.append(metrics.apply("numFiles").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan.executedPlan())
    assert scans == [1]
