"""Records with defaults, as catalogs have them."""

from tomewright import schemas

SF = "/root/testdata/sf0.001"
UNKNOWN = {"verdict": "unknown", "confidence": 0.0, "source": "unknown", "note": None}
NAMES = ("sexualized", "explicit", "harem", "aiNarration", "aiWriting", "quality")


def signal(verdict="present", confidence=0.95, source="publisher"):
    return {"verdict": verdict, "confidence": confidence, "source": source, "note": None}


def book(id, **more):
    base = dict(
        ordinal=0, id=id, workId=None, title=f"Title {id}", subtitle=None, series="Series", seriesKey="s1", seriesNumber=1.0, author="Ann Author", narrator="Ned", releaseDate="2020-01-01",
        coverUrl="c.png", runtimeMinutes=900, subgenres=["litrpg"], description=None, url=None, rating=4.8, ratingCount=5000, edition="audiobook", scope="indexed", contentType=None,
        contentDeliveryType=None, content={n: UNKNOWN for n in NAMES}, assessment=None, features=None, featureEvidence=None, sources=[{"name": "shop", "fetchedAt": None, "url": None}], issues=[],
    )
    assert set(more) <= set(base), set(more) - set(base)
    content = more.pop("content", {})
    return {**base, **more, "content": {**base["content"], **content}}


def books(spark, *rows):
    return spark.createDataFrame([{**b, "ordinal": i} for i, b in enumerate(rows)], schemas.BOOK)


def work(id, number=1.0, **more):
    return {**dict(id=id, title=f"Work {id}", number=number, bookId=f"b-{id}", editionIds=[f"b-{id}"], audioReleaseDate="2020-01-01", verified=False, hasAudio=None), **more}


def serie(id, works, **more):
    base = dict(
        ordinal=0, id=id, title=f"Series {id}", author="Ann Author", aliases=[], description="", features=None, featureEvidence=None, genres=["litrpg"], coverBookId=None, works=works, curated=False,
        status="ongoing", audioCoverage=None, sourceUrls=[], updatedAt=None,
    )
    return {**base, **more}


def all_series(spark, *rows):
    return spark.createDataFrame([{**s, "ordinal": i} for i, s in enumerate(rows)], schemas.SERIES)


def entry(user, id, status="read", at="2026-01-01T00:00:00Z", rating=None, series=None, number=None):
    return (user, id, status, rating, at, series, number)


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id string, id string, status string, rating int, updated_at string, hint_series string, hint_number double")


def follows(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id string, series_id string, followed_at string")


def rows(df, *cols):
    """Plain tuples, sorted."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
