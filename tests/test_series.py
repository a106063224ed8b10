from factories import all_series, book, books, rows, serie, signal, work
from pyspark.sql import functions as F

from tomewright.operators import catalog, series


def test_placeholders_give_way_to_richer_editions(spark):
    thin = dict(sources=[], runtimeMinutes=None, ratingCount=0)
    b = books(spark, book("a"), book("p", title="Title a", **thin), book("q", title="Alone", **thin))
    assert rows(catalog.collapse_placeholder_duplicates(b), "id") == [("a",), ("q",)]


def test_starters(spark):
    b = books(
        spark, book("e1", edition="ebook", ratingCount=99999), book("a2", seriesNumber=2.0), book("a1", ratingCount=10), book("a1b", ratingCount=5000), book("solo", series="", seriesKey="x"), book("n", seriesKey="s2", seriesNumber=None)
    )
    assert rows(catalog.series_starters(b), "id") == [("a1b",), ("n",), ("solo",)]


def test_popularity_uses_the_prior(spark):
    df = spark.createDataFrame([(None, 0), (5.0, 50)], "r double, v int").select(catalog.popularity(F.col("r"), F.col("v")).alias("p"))
    assert [round(r[0], 3) for r in df.collect()] == [4.2, round(4.6 * 5.70044, 3)]


def test_search(spark):
    b = books(spark, book("a", title="Dark Tower", subgenres=["base-building"]), book("b", title="Light", narrator="Dark Ned"), book("c", title="None", edition="ebook"))
    assert rows(catalog.search_books(b, " dark  BUILDING"), "id") == [("a",)]
    assert catalog.search_books(b, "").count() == 3
    assert rows(catalog.matching_audiobooks(b, "dark"), "id") == [("a",), ("b",)]
    assert catalog.matching_audiobooks(b, " ").count() == 0
    assert rows(catalog.matching_audiobooks(b, "dark", genre="litrpg"), "id") == [("b",)]


def test_group_series(spark):
    thin = dict(sources=[], runtimeMinutes=None, ratingCount=0)
    b = books(
        spark, book("v2", seriesNumber=2.0, title="Two", releaseDate="2021-01-01"), book("v1", title="One: a tale", releaseDate="2020-05-01", ratingCount=10, subgenres=["isekai"]),
        book("v1b", title="One", releaseDate="2020-03-01", ratingCount=500), book("v1p", title="One", releaseDate="2020-03-01", **thin), book("pod", contentType="Podcast", seriesNumber=3.0), book("eb", edition="ebook", seriesNumber=4.0),
        book("lone", series=None, seriesKey="", seriesNumber=None, title="Lone"),
    )
    got = {r["id"]: r for r in series.group_series(b).collect()}
    assert set(got) == {"s1", "lone"}
    works = got["s1"]["works"]
    assert [(w["work_id"], w["number"], w["book_id"], w["edition_ids"], w["audio_release_date"]) for w in works] == [
        ("work-legacy-s1-1-one", 1.0, "v1b", ["v1", "v1b", "v1p"], "2020-03-01"), ("work-legacy-s1-2-two", 2.0, "v2", ["v2"], "2021-01-01"),
    ]
    assert (got["s1"]["title"], got["s1"]["genres"], got["s1"]["cover_book_id"]) == ("Series", ["litrpg", "isekai"], "v1b")
    assert (got["lone"]["title"], got["lone"]["works"][0]["work_id"]) == ("Lone", "work-legacy-lone-lone-lone")
    over = spark.createDataFrame([("s1", "", "New Author", None, "complete")], "id string, title string, author string, genres array<string>, status string")
    r = series.group_series(b, over).where("id = 's1'").first()
    assert (r["title"], r["author"], r["status"]) == ("Series", "New Author", "complete")


def test_mainline_side_and_gaps(spark):
    s = all_series(
        spark,
        serie("s", [work("w1", 1.0, title="Complete Series Omnibus"), work("w1b", 1.0, title="One"), work("w3", 3.0), work("side", None), work("half", 0.5)], title="S"),
        serie("t", [work("t1", None), work("t2", None)]),
        serie("u", [work("u1", 1.0, title="U Saga", editionIds=["a", "b", "c"]), work("u2", 1.0, title="Real")], title="U Saga"),
        serie("v", [work("v1", 1.0, title="First"), work("v2", 1.0, title="Omnibus", verified=True)]),
    )
    works = series.explode_works(s)
    main = series.mainline(works)
    assert rows(main, "series_id", "work_id") == [("s", "half"), ("s", "w1b"), ("s", "w3"), ("t", "t1"), ("t", "t2"), ("u", "u2"), ("v", "v2")]
    assert rows(series.side_works(works, main, ["series_id", "work_id"]), "work_id") == [("side",), ("u1",), ("v1",), ("w1",)]
    assert rows(series.gaps(works).where("size(gaps) > 0")) == [("s", [2])]


def test_work_index(spark):
    s = all_series(spark, serie("s", [work("w1", bookId="b1", editionIds=["b1", "x"])]), serie("t", [work("w2", 2.0, bookId="x", editionIds=[])]))
    works = series.explode_works(s).join(s.select(F.col("id").alias("series_id"), F.col("ordinal").alias("series_ordinal")), "series_id")
    b = books(spark, book("new", seriesKey="t", seriesNumber=2.0), book("no", seriesKey="t", seriesNumber=9.0), book("eb", seriesKey="t", seriesNumber=2.0, edition="ebook"))
    assert rows(series.work_index(works, b)) == [("b1", "s", "w1"), ("new", "t", "w2"), ("w1", "s", "w1"), ("w2", "t", "w2"), ("x", "t", "w2")]


def test_resolve_refs(spark):
    names = spark.createDataFrame([("a", ["old", "b", "two"]), ("b", ["two", " spaced "]), ("c", None)], "id string, aliases array<string>")
    refs = spark.createDataFrame([(x,) for x in ("a", "b", "old", "two", "spaced", "zzz", "")], "ref string")
    assert dict(rows(series.resolve_refs(refs, names))) == {"a": "a", "b": "b", "old": "a", "two": None, "spaced": "b", "zzz": None, "": None}


def test_content_index(spark):
    s = all_series(spark, serie("s", [work("w1", bookId="b1", editionIds=["b1", "both"]), work("w2", 2.0, bookId="b2", editionIds=["b2", "both"])]), serie("t", [work("w9", bookId="b9", editionIds=[])]))
    told = {"harem": signal()}
    b = books(spark, book("b1", content=told), book("b2"), book("both", content=told), book("b9", content={"harem": signal(source="vision")}), book("unlisted", seriesKey="s"), book("else", seriesKey="zz", content=told))
    got = rows(series.content_index(s, b))
    assert [g[0] for g in got] == ["b1", "b2", "unlisted"] and got[0][2:] == (["b1"], ["w1"])


def test_titles_popularity_and_search(spark):
    s = all_series(spark, serie("s", [work("w2", 2.0, bookId="b2"), work("w1", bookId="b1")], title=" "), serie("t", [work("t1", bookId="gone")], title="", coverBookId="b2"), serie("u", [work("u1", bookId="gone")], title=None))
    b = books(spark, book("b1", title="First", narrator="Zed"), book("b2", title="Second", ratingCount=1))
    assert rows(series.display_titles(s, b)) == [("s", "First", "b1"), ("t", "Second", "b2"), ("u", "Untitled", None)]
    pop = dict(rows(series.series_popularity(series.explode_works(s), b)))
    assert pop["s"] > 50 and pop["u"] == 0.0
    assert rows(series.search_series(s, b, "zed author"), "id") == [("s",)]


def test_calendar_and_pages(spark):
    b = books(spark, book("a", releaseDate="2026-03-02"), book("b", releaseDate="2026-03-01"), book("c", releaseDate=None), book("d", releaseDate="2025-03-01"))
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(catalog.release_calendar(b, "releaseDate", "year", "2026-01-01", "2026", "03")) == ["b", "a"]
    assert ids(catalog.release_calendar(b, "releaseDate", "unknown", "2026-01-01")) == ["c"]
    assert ids(catalog.release_calendar(b, "releaseDate", "upcoming", "2026-03-02T10:00:00Z")) == ["a"]
    assert ids(catalog.keyset_page(b, ["id"], ("b",), 1)) == ["c"]
    assert rows(catalog.distinct_names(spark.createDataFrame([("A, B",), ("B ,",)], "n string"), "n")) == [("A",), ("B",)]


def test_members_of_one_series_go_to_many_tasks(spark):
    """Each gets the whole lists of its series, so one task must not make all of them."""
    b = books(spark, *[book(f"b{i}") for i in range(200)])
    s = all_series(spark, serie("s", [work("w", bookId="b0", editionIds=[f"b{i}" for i in range(200)])]))
    b = b.withColumn("content", F.col("content").withField("harem", F.struct(F.lit("present").alias("verdict"), F.lit(0.95).alias("confidence"), F.lit("publisher").alias("source"), F.lit(None).cast("string").alias("note"))))
    found = series.content_index(s, b).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 200 and {len(r["supporting_edition_ids"]) for r in found} == {200} and len({r["task"] for r in found}) > 20
