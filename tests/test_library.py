import random

import pytest
from factories import all_series, book, books, entries, entry, follows, rows, serie, work
from pyspark.sql import functions as F

from tomewright.operators import library, series
from tomewright.sources.catalog import parse_library


def test_merge(spark):
    a = (follows(spark, ("u", "s", "2026-01-02"), ("u", "only", "2026-01-01")), entries(spark, entry("u", "w", "read", "2026-01-02T00:00:00Z"), entry("u", "t", "want", "2026-01-01T00:00:00Z")))
    b = (follows(spark, ("u", "s", "2026-01-01")), entries(spark, entry("u", "w", "want", "2026-01-01T00:00:00Z"), entry("u", "t", "paused", "2026-01-01T00:00:00Z")))
    f, e = library.merge_libraries(a, b)
    assert rows(f) == [("u", "only", "2026-01-01"), ("u", "s", "2026-01-01")]
    assert rows(e, "id", "status") == [("t", "paused"), ("w", "read")]


@pytest.mark.parametrize("seed", range(3))
def test_rebase_matches_a_plain_model(spark, seed):
    rng = random.Random(seed)
    made = lambda: {k: rng.choice([None, 1, 2]) for k in "abcdefghijklmnop" if rng.random() < 0.6}
    base, local, remote = made(), made(), made()
    want = dict(remote)
    for k in {*base, *local}:
        if (k in base, base.get(k)) != (k in local, local.get(k)):
            want.pop(k, None)
            if k in local:
                want[k] = local[k]
    df = lambda d: spark.createDataFrame(sorted(d.items()), "id string, v int")
    assert dict(rows(library.rebase(df(base), df(local), df(remote), ["id"], ["v"]))) == want


def _works(spark, *s):
    df = all_series(spark, *s)
    return df, series.explode_works(df)


def test_latest_entry_over_aliases(spark):
    _, w = _works(spark, serie("s", [work("w1", bookId="b1", editionIds=["b1", "b2"])]))
    e = entries(spark, entry("u", "w1", "want", "2026-01-01T00:00:00Z"), entry("u", "b2", "read", "2026-01-01T00:00:00Z"), entry("v", "b1", "paused", "2026-01-02T00:00:00Z"), entry("v", "w1", "want", "2026-01-01T00:00:00Z"), entry("u", "zz"))
    assert rows(library.work_entries(e, w), "user_id", "work_id", "id", "status") == [("u", "w1", "w1", "want"), ("v", "w1", "b1", "paused")]


def test_edits(spark):
    _, w = _works(spark, serie("s", [work("w1", bookId="b1", editionIds=["b1", "b2"]), work("w2", 2.0, bookId="b3", editionIds=["b3"]), work("w3", 3.0)]))
    e = entries(spark, entry("u", "b2", "reading", rating=4), entry("u", "w2", "read"), entry("u", "b3", "read"), entry("u", "other", "want"))
    edits = spark.createDataFrame([("u", "s", "w1", "read", None, "2026-02-01"), ("u", "s", "w2", None, None, "2026-02-01"), ("u", "s", "w3", None, 4.6, "2026-02-01")], "user_id string, series_id string, work_id string, status string, rating double, at string")
    got = rows(library.apply_edits(e, edits, w), "id", "status", "rating", "updated_at", "hint_number")
    assert got == [("b2", "reading", 4, "2026-01-01T00:00:00Z", None), ("other", "want", None, "2026-01-01T00:00:00Z", None), ("w1", "read", 4, "2026-02-01", 1.0), ("w3", "read", 5, "2026-02-01", 3.0)]


EDIT = "user_id string, series_id string, follow boolean, at string"


def test_follow_and_unfollow(spark):
    have = follows(spark, ("u", "kept", "2026-01-01"), ("u", "gone", "2026-01-01"), ("u", "again", "2026-01-01"), ("u", "idle", "2026-01-01"))
    edits = [
        ("u", "kept", True, "2026-03-01"), ("u", "gone", False, "2026-03-01"), ("u", "again", True, "2026-03-05"), ("u", "again", False, "2026-03-02"), ("u", "again", True, "2026-03-01"), ("u", "again", True, "2026-03-04"),
        ("u", "new", True, "2026-03-02"), ("u", "new", True, "2026-03-01"), ("u", "tie", True, "2026-03-01"), ("u", "tie", False, "2026-03-01"), ("u", "never", False, "2026-03-01"),
        ("u", "idle", False, "not a date"), ("u", "idle", False, None), ("u", "idle", None, "2026-03-01"), (None, "x", True, "2026-03-01"), ("u", None, True, "2026-03-01"),
    ]
    got = rows(library.change_follows(have, spark.createDataFrame(edits + edits[:4], EDIT)))
    assert got == [("u", "again", "2026-03-04"), ("u", "idle", "2026-01-01"), ("u", "kept", "2026-01-01"), ("u", "new", "2026-03-01"), ("u", "tie", "2026-03-01")]
    assert library.change_follows(have.limit(0), spark.createDataFrame([], EDIT)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_follow_edits_match_a_plain_model(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"2026-01-{rng.randint(1, 28):02d}"
    state = {(u, s): day() for u in "uvw" for s in "abcdef" if rng.random() < 0.4}
    have = follows(spark, *[(*k, at) for k, at in state.items()])
    edits = [(rng.choice("uvw"), rng.choice("abcdef"), rng.random() < 0.6, day()) for _ in range(120)]
    for u, s, follow, at in sorted(edits, key=lambda e: (e[3], e[2])):
        if follow:
            state.setdefault((u, s), at)
        else:
            state.pop((u, s), None)
    assert rows(library.change_follows(have, spark.createDataFrame(edits, EDIT))) == sorted((*k, at) for k, at in state.items())


def test_work_edits_follow(spark):
    edits = spark.createDataFrame([("u", "s", "w", "read", None, "2026-01-02"), ("u", "t", "w", None, 4, "2026-01-03"), ("u", "z", "w", None, None, "2026-01-04")], "user_id string, series_id string, work_id string, status string, rating int, at string")
    assert rows(library.edit_follows(edits)) == [("u", "s", True, "2026-01-02"), ("u", "t", True, "2026-01-03")]


def test_read_through(spark):
    _, w = _works(spark, serie("s", [work("w1"), work("w2", 2.0), work("w3", 3.0), work("w4", 4.0)]))
    main = library.reading_rank(series.mainline(w)).withColumn("state", F.when(F.col("number") == 2, "scheduled").otherwise("released"))
    upto = spark.createDataFrame([("u", "s", "w3")], "user_id string, series_id string, work_id string")
    assert rows(library.read_through_edits(entries(spark, entry("u", "w1")), main, upto, "now"), "work_id", "status") == [("w3", "read")]


def test_rehome(spark):
    s, w = _works(spark, serie("new", [work("w1", title="One", bookId="b1", editionIds=["b1"]), work("w2", 2.0, title="Two Renamed", bookId="b2", editionIds=["b2"])], aliases=["old"]))
    b = books(spark, book("b2", title="Two: x", seriesNumber=2.0), book("stray", seriesKey="old", seriesNumber=1.0))
    e = entries(
        spark, entry("hint", "gone", series="old", number=2.0), entry("made", "work-legacy-old-1-one"), entry("edition", "work-legacy-old-2-two"), entry("cat", "stray"), entry("no", "zzz"), entry("here", "b1"),
        entry("newer", "gone", at="2026-03-01T00:00:00Z", series="new", number=1.0), entry("newer", "w1", "want", "2026-01-01T00:00:00Z"), entry("older", "gone", at="2025-01-01T00:00:00Z", series="new", number=1.0), entry("older", "w1", "want"),
    )
    got = rows(library.rehome(e, w, s, b), "user_id", "id", "status", "hint_series", "hint_number")
    assert got == sorted(
        [
            ("hint", "gone", "read", "old", 2.0), ("hint", "w2", "read", "new", 2.0), ("made", "w1", "read", "new", 1.0), ("edition", "w2", "read", "new", 2.0), ("cat", "stray", "read", None, None),
            ("cat", "w1", "read", "new", 1.0), ("no", "zzz", "read", None, None), ("here", "b1", "read", None, None), ("newer", "gone", "read", "new", 1.0), ("newer", "w1", "read", "new", 1.0),
            ("older", "gone", "read", "new", 1.0), ("older", "w1", "want", None, None),
        ], key=repr,
    )


def test_follows_migrate(spark):
    s, w = _works(spark, serie("new", [work("w1")], aliases=["old"]))
    f = follows(spark, ("u", "old", "2026-01-01"), ("u", "new", "2026-02-01"), ("v", "old", "2026-03-01"), ("v", "gone", "2026-01-01"))
    assert rows(library.migrate_follows(f, s)) == [("u", "new", "2026-01-01"), ("v", "gone", "2026-01-01"), ("v", "new", "2026-03-01")]
    assert rows(library.implied_follows(entries(spark, entry("u", "b-w1", at="2026-02-02"), entry("u", "w1", at="2026-01-01")), w)) == [("u", "new", "2026-01-01")]


def test_progress(spark):
    s, w = _works(
        spark, serie("done", [work("a1"), work("a2", 2.0)]), serie("part", [work("p1"), work("p3", 3.0), work("p4", 4.0, audioReleaseDate="2030-01-01"), work("p5", 5.0, audioReleaseDate=None), work("px", None)]),
        serie("sure", [work("c1")]), serie("new", [work("n1")]),
    )
    main = library.reading_rank(series.mainline(w)).select("series_id", "work_id", "rank", F.lit(True).alias("is_main"))
    from tomewright.operators.coverage import row_release

    works = w.join(main, ["series_id", "work_id"], "left").withColumn("is_main", F.coalesce("is_main", F.lit(False))).withColumn("state", row_release(F.col("audio_release_date"), "2026-09-18"))
    cov = spark.createDataFrame([("sure", True, ["c1"]), ("done", False, [])], "series_id string, current boolean, released_ids array<string>")
    e = entries(spark, entry("u", "a1"), entry("u", "a2"), entry("u", "p1"), entry("u", "c1"))
    f = follows(spark, *[("u", x, "2026-01-01") for x in ("done", "part", "sure", "new")])
    got = {r["series_id"]: r for r in library.progress(f, works, e, series.gaps(w), cov).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"done": "caught-up-partial", "part": "in-progress", "sure": "caught-up", "new": "not-started"}
    p = got["part"]
    assert (p["read"], p["total"], p["remaining"], p["undated"], p["upcoming"], p["gaps"], p["next_unread"], p["side_total"]) == (1, 2, 1, 1, 1, [2], "p3", 1)
    assert p["unresolved"] == ["Book 2 is missing from this list", "1 audiobook has no confirmed release date", "1 side entry is unread", "This list may be incomplete"]
    assert got["sure"]["caught_up"] and got["sure"]["unresolved"] == [] and got["done"]["unresolved"] == ["This list may be incomplete"]
    queue = library.up_next(library.progress(f, works, e, series.gaps(w), cov), works.withColumn("date", F.col("audio_release_date")), s.select(F.col("id").alias("series_id"), "title"))
    assert [r["next_unread"] for r in queue.collect()] == ["n1", "p3"]


def test_parse_and_export(spark):
    doc = '{"version":2,"library":{"version":2,"series":{"s":{"followedAt":"2026-01-01"},"bad id":{"followedAt":"2026-01-01"},"t":{"followedAt":"soon"}},"books":{"w":{"status":"read","rating":4.5,"updatedAt":"x","work":{"series":"s","number":0.5}},"constructor":{"status":"read"},"y":{"status":"lost"},"z":{"status":"want","rating":3}}}}'
    v1 = '{"version":1,"library":{"w":{"status":"want","updatedAt":"2026-01-01"}}}'
    raw = spark.createDataFrame([("u", doc), ("v", v1), ("x", "[]"), ("y", '{"version":3}')], "user_id string, json string").select("user_id", parse_library(F.col("json")).alias("l"))
    assert rows(raw.where("l is null"), "user_id") == [("x",), ("y",)]
    e = library.parse_entries(raw.where("l is not null").select("user_id", F.col("l.books").alias("books")), as_of="NOW")
    assert rows(e) == [("u", "w", "read", None, "NOW", "s", 0.5), ("u", "z", "want", 3, "NOW", None, None), ("v", "w", "want", None, "2026-01-01", None, None)]
    f = library.parse_follows(raw.where("l is not null").select("user_id", F.col("l.series").alias("series")))
    assert rows(f) == [("u", "s", "2026-01-01")]
    again = library.export_library(f, e, "2026-09-18").select("user_id", parse_library(F.col("json")).alias("l")).where("user_id = 'u'").first()["l"]
    assert again["series"]["s"]["followedAt"] == "2026-01-01" and again["books"]["w"]["work"]["number"] == 0.5
    assert spark.createDataFrame([(doc,)], "j string").select(parse_library(F.col("j"), 10)).first()[0] is None


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_are_not_shuffled_and_edits_look_them_up_once(spark):
    _, w = _works(spark, serie("s", [work("w1", bookId="b1", editionIds=["b1", "w1", "b2"]), work("w2", 2.0, bookId=None, editionIds=None)]))
    ids = library.alias_ids(w)
    assert "Exchange" not in _plan(ids)
    assert [r[:2] for r in rows(ids.select("work_id", "id", "place").orderBy("place"))] == [("w1", "b1"), ("w1", "b2"), ("w1", "w1"), ("w2", "w2")]
    edits = spark.createDataFrame([("u", "s", "w1", None, None, "2026-02-01"), ("u", "s", "w2", "read", None, "2026-02-01")], "user_id string, series_id string, work_id string, status string, rating double, at string")
    found = library.apply_edits(entries(spark, entry("u", "b2"), entry("v", "b2", "paused"), entry(None, "w2", "want"), entry("u", "w2", rating=3)), edits, w)
    assert _plan(found).count("Generate posexplode(array_distinct(") == 1
    assert sorted((r["user_id"] or "", r["id"], r["status"], r["rating"]) for r in found.collect()) == [("", "w2", "want", None), ("u", "w2", "read", 3), ("v", "b2", "paused", None)]


def test_places_are_those_of_mainline_and_rank(spark):
    s = [serie("s", [work("w2", 2.0), work("w1"), work("w1b", editionIds=["x", "y"]), work("extra", None)]), serie("t", [work("z", None, title="Z"), work("a", None, title="A")], ordinal=1)]
    _, w = _works(spark, *s)
    main = library.reading_rank(series.mainline(w))
    placed = library.place_works(w, series.mainline_order())
    assert placed.count() == w.count() and rows(placed.where("is_main"), "work_id", "rank") == rows(main, "work_id", "rank")
    assert rows(placed.where("not is_main"), "work_id", "rank") == [("extra", None), ("w1", None)]


@pytest.mark.parametrize("name", ["q79_apply_edits", "q28_progress_counts", "q29_next_unread", "q30_read_through_prefix", "q108_implied_follows", "q27_rehome_precedence"])
def test_lines_are_gathered_once(spark, name):
    from factories import SF

    from tomewright.plans.queries import QUERIES

    assert "lineitem" not in _plan(QUERIES[name](spark, SF))
