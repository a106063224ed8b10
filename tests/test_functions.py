import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomewright.functions import dates, signals, text, urls


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"x{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "title, want",
    [
        ("Dungeon Lord, Book 2", [2.0]), ("Vol. IV of the Saga", [4.0]), ("Story: Volume #7", [7.0]), ("Parts 1 and 2", [1.0]), ("Novella 0.5", [0.5]), ("book: 12", [12.0]), ("Book XIX", [19.0]),
        ("Book IIV", []), ("12 Miles Below", []), ("Notebook 3", []), ("Book 3rd", []), ("Handbook", []), ("Volume one", []), ("", []),
    ],
)
def test_volume_numbers(spark, title, want):
    assert one(spark, lambda t: text.volume_numbers(t), title) == want


def test_later_volume_of_subtitle(spark):
    assert one(spark, lambda t, s: text.later_volume(t, s), "A Tale", "Book 3")
    assert not one(spark, lambda t, s: text.later_volume(t, s), "A Tale, Book 1", None)


@pytest.mark.parametrize(
    "title, want",
    [
        ("The Box Set", "collection"), ("Books 1-3", "collection"), ("The Complete Space Trilogy", "collection"), ("Big Bundle (Unabridged)", "collection"), ("Space Podcast", "podcast"),
        ("Tale (Dramatized Adaptation)", "dramatized"), ("GraphicAudio Tale", "dramatized"), ("Radio", None), ("Completely Collected", None), ("Trilogy", None), ("Parts 1 and 2", None), ("Anthology Podcast", "podcast"),
    ],
)
def test_edition_kind(spark, title, want):
    assert one(spark, lambda t: text.edition_kind(t), title) == want


def test_podcast_by_type(spark):
    assert one(spark, lambda t, c: text.edition_kind(t, None, c), "Plain", " PodcastEpisode ") == "podcast"


@pytest.mark.parametrize("title, want", [("The Hobbit", "Hobbit"), ("  an Apple", "Apple"), ("A", "A"), ("The ", "The"), ("Another", "Another"), (" A B", "A B"), ("a\tTree", "Tree")])
def test_filing_key(spark, title, want):
    assert one(spark, text.filing_key, title) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=20), min_size=20, max_size=20))
def test_identity_is_compatibility_decomposition(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    want = ["".join(c for c in unicodedata.normalize("NFKD", v).lower() if c.isascii() and c.isalnum()) for v in values]
    assert [r[0] for r in df.select(text.normalize_identity(F.col("x"))).collect()] == want


def test_identity_of_known_names(spark):
    assert one(spark, text.normalize_identity, "Él ﬁn ½ Ⅳ-№") == "elfin12ivno"
    assert one(spark, lambda s, a: text.series_identity(s, a), "My Série", "Zoë (Z. Q.) Vale, Publisher") == "myserie--zoevale"
    assert one(spark, lambda s, a: text.series_identity(s, a), "X", "(anon)") == "x--unknown"


def test_numbers_in_ids(spark):
    df = spark.createDataFrame([(1.0,), (0.5,), (10.5,), (None,)], "n double")
    assert [r[0] for r in df.select(text.number_text(F.col("n"))).collect()] == ["1", "0.5", "10.5", ""]
    got = df.select(text.legacy_work_id(F.lit("s-1"), F.col("n"), F.lit("Ünder: a tale"))).collect()
    assert got[1][0] == "work-legacy-s-1-0.5-under"


@pytest.mark.parametrize("x, want", [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-02-29\n", None), ("2024-2-1", None), ("", None)])
def test_exact_date(spark, x, want):
    assert one(spark, dates.exact_date, x) == want


@pytest.mark.parametrize(
    "x, ok", [("2026-01-01T00:00:00Z", True), ("2026-01-01T00:00:00.123Z", True), ("2026-01-01T24:00:00Z", False), ("2026-02-30T00:00:00Z", False), ("2026-01-01", False), ("2026-01-01T00:00:00+00:00", False)]
)
def test_instant(spark, x, ok):
    assert (one(spark, dates.instant, x) is not None) is ok


def test_release_dates(spark):
    f = lambda x: dates.release_date(x, "2026-09-18T00:00:00Z")
    assert [one(spark, f, x) for x in ("2029-12-31", "2030-01-01", "1899-12-31", "2020-01-01T10:00", "2020-01-01x")] == ["2029-12-31", None, None, "2020-01-01", None]


def test_ages(spark):
    f = lambda x: dates.is_adult(x, "2026-09-18T12:00:00Z")
    assert [one(spark, f, x) for x in ("2008-09-18", "2008-09-19", "1906-01-01", "1905-12-31", "2027-01-01", "2008-02-30")] == [True, False, True, False, False, False]
    assert one(spark, lambda x: dates.is_adult(x, "2026-02-28T00:00:00Z"), "2008-02-29") is False
    assert one(spark, lambda x: dates.is_adult(x, "2026-03-01T00:00:00Z"), "2008-02-29") is True


def test_signal_thresholds(spark):
    df = spark.createDataFrame([("present", 0.85, "vision"), ("present", 0.85, "publisher"), ("present", 0.9, "publisher"), ("unknown", 1.0, "vision"), (None, None, None)], "v string, c double, s string")
    assert [r[0] for r in df.select(signals.signal_present(F.col("v"), F.col("c"), F.col("s"))).collect()] == [True, False, True, False, False]


def test_filters_and_gate(spark):
    json = F.lit('{"hideHarem": false, "hideExplicit": "no", "hideUnknown": true, "other": 1}')
    got = spark.range(1).select(*[c.alias(k) for k, c in signals.parse_filters(json).items()]).first().asDict()
    assert got == {"hideSexualized": True, "hideExplicit": True, "hideHarem": False, "hideAiNarration": True, "hideAiWriting": True, "hideQualityFlags": False, "hideUnknown": True}
    gated = signals.adult_gate({"hideExplicit": False, "hideHarem": False}, False)
    assert spark.range(1).select(*[c.alias(k) for k, c in gated.items()]).first().asDict() == {"hideExplicit": True, "hideHarem": False}
    c = spark.range(1).select(signals.consent(F.lit("2010-01-01"), F.lit("2026-01-01"), F.lit(True), "2026-09-18T00:00:00Z").alias("c")).first()["c"]
    assert tuple(c) == ("2010-01-01", "2026-01-01", False)


def test_urls(spark):
    assert [one(spark, lambda u: urls.safe_url(u, False), u) for u in ("https://a.org/x", "http://u:p@a.org", "javascript:alert(1)", "nonsense", "ftp://a.org")] == [True, False, False, False, False]
    state = one(spark, lambda u: F.to_json(urls.view_state(u)), "https://a.org/?view=shelf&q=a%20b&book=7")
    assert state == '{"view":"library","query":"a b","book":"7","like":"","series":""}'
    again = one(spark, lambda u: urls.view_query(urls.view_state(u)), "https://a.org/?view=series&series=s%2F1&q=x")
    assert again == "view=series&series=s%2F1&q=x"
    assert [one(spark, lambda u: urls.safe_return(u, "https://a.org", "/app/"), u) for u in ("/app/?x=1", "//evil.org/app/", "/other", None)] == ["https://a.org/app/?x=1", *["https://a.org/app/"] * 3]
    assert one(spark, lambda u: urls.session_token(u, "sid"), "a=1; sid=" + "x" * 43) == "x" * 43


def test_small_texts(spark):
    assert one(spark, text.sentence_label, "powerCreep") == "Power creep"
    assert one(spark, dates.display_date, "2024-02-09T00:00:00Z") == "Feb 9, 2024"
    assert one(spark, dates.display_date, None) == "Date to be announced"
    df = spark.createDataFrame([(0,), (60,), (125,), (None,)], "m int")
    assert [r[0] for r in df.select(text.runtime_text(F.col("m"))).collect()] == ["Length unavailable", "1h", "2h 5m", "Length unavailable"]
