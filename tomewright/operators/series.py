"""Series and works: grouping editions, mainline and side works, gaps, references, membership, disclosure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MODEL_SOURCES, UNNUMBERED
from ..functions.signals import signal_present
from ..functions.text import COLLECTION_TITLE, blank_to_null, legacy_work_id, matches_all, normalize_identity, trim
from ..sources.search_index import build_index
from .catalog import book_popularity, collapse_placeholder_duplicates, first_of_group, full_audio, kind_of_book


def group_works(books: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """(series_id, work_id, title, number, book_id, edition_ids, audio_release_date, verified, has_audio) from editions.

    Only audiobooks that are no podcasts count. A placeholder that a richer edition stands for adds its id, and facts only
    if a work has nothing else. ``canonical`` (work_id, title, number, edition_ids, verified) overrides what is known.
    """
    audio = full_audio(books, any_kind=True)
    real = collapse_placeholder_duplicates(audio).select("id", F.lit(True).alias("real"))
    keyed = audio.join(real, "id", "left").withColumn("series_id", F.coalesce(F.nullif("seriesKey", F.lit("")), F.col("id")))
    number = F.when(F.col("seriesNumber").isNull(), F.col("id"))
    legacy = F.when(number.isNull(), legacy_work_id(F.col("series_id"), F.col("seriesNumber"), F.col("title"))).otherwise(
        F.concat(F.lit("work-legacy-"), "series_id", F.lit("-"), "id", F.lit("-"), F.substring(normalize_identity(F.element_at(F.split("title", ":"), 1)), 1, 70))
    )
    keyed = keyed.withColumn("work_id", F.coalesce("workId", legacy)).withColumn("thin", F.col("real").isNull())
    best = F.min_by(F.struct("id", "title", "seriesNumber"), F.struct("thin", -book_popularity(), F.col("coverUrl").isNull() | (F.col("coverUrl") == ""), "id"))
    dated = F.nullif("releaseDate", F.lit(""))
    works = keyed.groupBy("series_id", "work_id").agg(
        best.alias("best"), F.min(F.when(~F.col("thin"), dated)).alias("real_date"), F.min(dated).alias("any_date"), F.min("thin").alias("all_thin"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"])).alias("ids"), F.min("ordinal").alias("ordinal"),
    )
    if canonical is not None:
        works = works.join(canonical.select("work_id", *[F.col(c).alias(f"known_{c}") for c in ("title", "number", "edition_ids", "verified")]), "work_id", "left")
    else:
        works = works.select("*", *[F.lit(None).cast(t).alias(f"known_{c}") for c, t in (("title", "string"), ("number", "double"), ("edition_ids", "array<string>"), ("verified", "boolean"))])
    return works.select(
        "series_id", "work_id", F.coalesce("known_title", "best.title").alias("title"), F.coalesce("known_number", "best.seriesNumber").alias("number"), F.col("best.id").alias("book_id"),
        F.array_distinct(F.concat(F.coalesce("known_edition_ids", F.array().cast("array<string>")), "ids")).alias("edition_ids"),
        F.when(F.col("all_thin"), F.col("any_date")).otherwise(F.col("real_date")).alias("audio_release_date"), F.coalesce("known_verified", F.lit(False)).alias("verified"),
        F.lit(True).alias("has_audio"), "ordinal",
    )


def work_order() -> list[Column]:
    return [F.coalesce("number", F.lit(float(UNNUMBERED))), F.coalesce("audio_release_date", F.lit("")), F.collate("title", "UNICODE"), F.col("ordinal")]


def group_series(books: DataFrame, overrides: DataFrame | None = None, canonical: DataFrame | None = None) -> DataFrame:
    """One row per series with its works in order: first by number, then date, then title.

    ``overrides`` (id, title, author, genres, status ...) supply reviewed facts; a blank title counts as missing, a blank
    author does not.
    """
    works = group_works(books, canonical)
    order = F.struct(F.coalesce("number", F.lit(float(UNNUMBERED))).alias("n"), F.coalesce("audio_release_date", F.lit("")).alias("d"), F.collate("title", "UNICODE").alias("t"), "ordinal")
    work = F.struct(*[F.col(c) for c in ("work_id", "title", "number", "book_id", "edition_ids", "audio_release_date", "verified", "has_audio")])
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("k"), work.alias("w")))), lambda x: x["w"])
    series = works.groupBy("series_id").agg(listed.alias("works"))
    audio = full_audio(books, any_kind=True).withColumn("series_id", F.coalesce(F.nullif("seriesKey", F.lit("")), F.col("id")))
    genres = audio.groupBy("series_id").agg(
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("subgenres", F.array().cast("array<string>")).alias("g")))), lambda x: x["g"]))).alias("own_genres"),
        F.min("ordinal").alias("ordinal"),
    )
    series = series.join(genres, "series_id").withColumn("cover", F.col("works")[0]["book_id"])
    first = audio.select(F.col("id").alias("cover"), F.col("series").alias("first_series"), F.col("title").alias("first_title"), F.col("author").alias("first_author"))
    series = series.join(first, "cover")
    known = ("title", "author", "genres", "status")
    if overrides is not None:
        series = series.join(overrides.select(F.col("id").alias("series_id"), *[F.col(c).alias(f"o_{c}") for c in known]), "series_id", "left")
    else:
        series = series.select("*", *[F.lit(None).cast("array<string>" if c == "genres" else "string").alias(f"o_{c}") for c in known])
    return series.select(
        F.col("series_id").alias("id"), F.coalesce(F.nullif("o_title", F.lit("")), F.nullif("first_series", F.lit("")), "first_title").alias("title"), F.coalesce("o_author", "first_author").alias("author"),
        F.coalesce("o_genres", "own_genres").alias("genres"), F.coalesce("o_status", F.lit("unknown")).alias("status"), F.col("cover").alias("cover_book_id"), "works", "ordinal",
    )


def explode_works(series: DataFrame) -> DataFrame:
    """(series_id, series_title, position, the fields of the work) from series with nested works."""
    one = series.select(F.col("id").alias("series_id"), F.col("title").alias("series_title"), F.posexplode("works").alias("position", "w"))
    names = {"id": "work_id", "bookId": "book_id", "editionIds": "edition_ids", "audioReleaseDate": "audio_release_date", "hasAudio": "has_audio"}
    fields = [f.name for f in one.schema["w"].dataType.fields]
    return one.select("series_id", "series_title", "position", *[F.col(f"w.{f}").alias(names.get(f, f)) for f in fields])


def mainline_order(series_title: str | None = "series_title") -> list[Column]:
    """Which of several works of one number stands for it: verified, no collection, not just the series' name, more editions."""
    restates = F.lit(False) if series_title is None else (normalize_identity(F.col(series_title)) != "") & (normalize_identity(F.col("title")) == normalize_identity(F.col(series_title)))
    return [
        F.col("verified").desc(), F.col("title").rlike(COLLECTION_TITLE), F.coalesce(restates, F.lit(False)), F.size(F.coalesce("edition_ids", F.array().cast("array<string>"))).desc(),
        F.length("title"), F.collate("work_id", "UNICODE"),
    ]


def mainline(works: DataFrame, series: str = "series_id", number: str = "number", order: list[Column] | None = None) -> DataFrame:
    """The best work of each volume number; of a series without any number all works."""
    numbered = first_of_group(works.where(F.col(number).isNotNull()), [series, number], order or mainline_order())
    with_numbers = works.where(F.col(number).isNotNull()).select(series).distinct()
    return numbered.unionByName(works.where(F.col(number).isNull()).join(with_numbers, series, "left_anti").select(*numbered.columns))


def side_works(works: DataFrame, main: DataFrame, key: list[str]) -> DataFrame:
    """Works that are not mainline."""
    return works.join(main.select(*key).distinct(), key, "left_anti")


def gaps(works: DataFrame, series: str = "series_id", number: str = "number", within: tuple[str, ...] = ()) -> DataFrame:
    """(series, gaps): whole numbers below the highest that no work has; only 1 to 199 count."""
    whole = works.where((F.col(number) == F.floor(number)) & (F.col(number) > 0) & (F.col(number) < 200))
    have = whole.groupBy(*within, series).agg(F.collect_set(F.col(number).cast("int")).alias("have"))
    return have.select(*within, series, F.array_except(F.sequence(F.lit(1), F.array_max("have")), "have").alias("gaps"))


def work_index(works: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(id, series_id, work_id): every id that leads to a work; of several claims the last in series and work order wins.

    ``works`` carry series_ordinal and position. ``books`` adopts audiobooks that no work lists, by series and volume number.
    """
    ids = F.concat(F.array("work_id", "book_id"), F.coalesce("edition_ids", F.array().cast("array<string>")))
    claims = works.select("series_id", "work_id", "number", "series_ordinal", "position", F.posexplode(ids).alias("k", "id")).where("id is not null")
    index = claims.groupBy("id").agg(F.max_by(F.struct("series_id", "work_id"), F.struct("series_ordinal", "position", "k")).alias("w")).select("id", "w.*")
    if books is None:
        return index
    orphans = books.where((F.col("edition") == "audiobook") & F.col("seriesNumber").isNotNull()).join(index, "id", "left_anti")
    first = works.where("number is not null").groupBy("series_id", "number").agg(F.min_by("work_id", "position").alias("work_id"))
    adopted = orphans.select("id", F.col("seriesKey").alias("series_id"), F.col("seriesNumber").alias("number")).join(first, ["series_id", "number"])
    return index.unionByName(adopted.select("id", "series_id", "work_id"))


def resolve_refs(refs: DataFrame, names: DataFrame, ref: str = "ref", id: str = "id", aliases: str = "aliases") -> DataFrame:
    """(ref, id): an id itself, else the only series that has it as an alias; ambiguous or unknown ones get null.

    An alias that is some series' own id never shadows it.
    """
    ids = names.select(F.col(id).alias("own")).distinct()
    alias = names.select(F.col(id).alias("to"), F.explode(aliases).alias("alias")).select("to", trim(F.col("alias")).alias("alias"))
    unique = alias.join(ids, F.col("alias") == F.col("own"), "left_anti").groupBy("alias").agg(F.min("to").alias("to"), F.max("to").alias("other")).where("to = other").select("alias", "to")
    found = refs.join(ids, F.col(ref) == F.col("own"), "left").join(unique, F.col(ref) == F.col("alias"), "left")
    return found.select(ref, F.coalesce("own", "to").alias(id))


def membership(claims: DataFrame, id: str, series: str, work: str) -> DataFrame:
    """(id, series, work) for ids that all claims put into the same work; the others are no evidence for any."""
    seen = claims.groupBy(id).agg(F.min(F.struct(series, work)).alias("a"), F.max(F.struct(series, work)).alias("b"))
    return seen.where("a = b").select(id, f"a.{series}", f"a.{work}")


#: Shares of a series' members, and tasks, of the join that gives each member the lists of its series.
SHARES, TASKS = 64, 128


def content_index(series: DataFrame, books: DataFrame, signal: str = "harem", models: tuple[str, ...] = MODEL_SOURCES) -> DataFrame:
    """(id, series_id, supporting_edition_ids, supporting_work_ids): books of a series of which a publisher says so.

    Only a publisher's sure statement about a full audiobook with one undisputed work counts, and it then holds for all
    books of the series.
    """
    works = explode_works(series)
    claims = works.select("series_id", "work_id", F.explode(F.array_distinct(F.concat(F.array("book_id"), F.coalesce("edition_ids", F.array().cast("array<string>"))))).alias("id"))
    sure = membership(claims, "id", "series_id", "work_id")
    listed = claims.select("id").distinct()
    own = books.join(listed, "id", "left_anti").join(series.select(F.col("id").alias("series_id")), F.col("seriesKey") == F.col("series_id")).select("id", "series_id")
    members = sure.select("id", "series_id").unionByName(own)
    s = F.col(f"content.{signal}")
    told = books.where((F.col("edition") == "audiobook") & kind_of_book().isNull() & (s["source"] == "publisher") & signal_present(s["verdict"], s["confidence"], s["source"], models))
    facts = told.join(sure, "id").groupBy("series_id").agg(F.sort_array(F.collect_list("id")).alias("supporting_edition_ids"), F.sort_array(F.collect_set("work_id")).alias("supporting_work_ids"))
    # each member's row is as long as its series' lists, so the members of one series go to many tasks
    members = members.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")).repartition(TASKS, "series_id", "share")
    facts = facts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(TASKS, "series_id", "share")
    return members.join(facts, ["series_id", "share"]).select("id", "series_id", "supporting_edition_ids", "supporting_work_ids")


def display_titles(series: DataFrame, books: DataFrame) -> DataFrame:
    """(id, title, starter_id): the series' title, else that of its first mainline book, else "Untitled"."""
    main = mainline(explode_works(series))
    first = first_of_group(main, ["series_id"], [F.coalesce("number", F.lit(float(UNNUMBERED))), F.col("position")]).select(F.col("series_id").alias("id"), F.col("book_id").alias("first_id"))
    known = books.select(F.col("id").alias("book"), F.col("title").alias("book_title"))
    a, b = known.toDF("first_id", "first_title"), known.toDF("coverBookId", "cover_title")
    met = series.select("id", "title", "coverBookId").join(first, "id", "left").join(a, "first_id", "left").join(b, "coverBookId", "left")
    starter = F.when(F.col("first_title").isNotNull(), F.col("first_id")).when(F.col("cover_title").isNotNull(), F.col("coverBookId"))
    return met.select("id", F.coalesce(blank_to_null(F.col("title")), blank_to_null(F.coalesce("first_title", "cover_title")), F.lit("Untitled")).alias("title"), starter.alias("starter_id"))


def series_popularity(works: DataFrame, books: DataFrame) -> DataFrame:
    """(series_id, popularity): the highest of a series' representative books, 0 without any."""
    pop = books.select(F.col("id").alias("book_id"), book_popularity().alias("p"))
    return works.select("series_id", "book_id").join(pop, "book_id", "left").groupBy("series_id").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("p"), F.lit(0.0))).alias("popularity"))


def series_text(series: DataFrame, books: DataFrame) -> DataFrame:
    """``series`` with ``__text``, what a search looks through: title, author, aliases, genres, works and their narrators."""
    works = explode_works(series).join(books.select(F.col("id").alias("book_id"), "narrator"), "book_id", "left")
    text = works.groupBy(F.col("series_id").alias("id")).agg(F.array_join(F.collect_list(F.concat_ws(" ", "title", "narrator")), " ").alias("__works"))
    return series.join(text, "id", "left").withColumn("__text", F.concat_ws(" ", "title", "author", "aliases", "genres", "__works"))


def search_series(series: DataFrame, books: DataFrame, query: str) -> DataFrame:
    """Series of which every term is somewhere in their text; a scan of all."""
    return series_text(series, books).where(matches_all(F.col("__text"), query)).select(*series.columns)


def index_series(series: DataFrame, books: DataFrame, path: str) -> None:
    """An index with which ``search_index`` finds the ids that ``search_series`` finds, without scanning all texts."""
    build_index(series_text(series, books).select("id", F.col("__text").alias("text")), path)


def sorted_series(series: DataFrame, by: str, tie: str = "ordinal") -> DataFrame:
    """``series`` (title, n_works, popularity, latest_release, ordinal) by title, volumes, new or popularity."""
    from ..functions.text import filing_key

    keys = {
        "title": [F.collate(filing_key(F.col("title")), "UNICODE_CI_AI")], "volumes": [F.desc("n_works"), F.desc("popularity")],
        "new": [F.coalesce("latest_release", F.lit("")).desc()], "popular": [F.desc("popularity")],
    }
    return series.orderBy(*keys[by], tie)


def sibling_works(book_id: str, index: DataFrame, works: DataFrame, books: DataFrame, entries: DataFrame, now: str, series: DataFrame) -> DataFrame:
    """(work_id, title, number, state, date, status, cover): the works of a book's series with what a reader did with them.

    ``index`` is a work index, ``entries`` (series_id, work_id, status) one reader's latest entries; a chain of left joins.
    """
    from .coverage import work_release

    home = index.where(F.col("id") == book_id).select("series_id").distinct()
    met = works.join(home, "series_id", "left_semi").join(series.select(F.col("id").alias("series_id"), "audioCoverage"), "series_id", "left")
    met = met.withColumn("release", work_release(F.col("work_id"), F.col("audio_release_date"), F.col("has_audio"), F.col("audioCoverage"), now))
    met = met.join(entries.select("series_id", "work_id", "status"), ["series_id", "work_id"], "left").join(books.select(F.col("id").alias("book_id"), F.col("coverUrl").alias("cover")), "book_id", "left")
    return met.select("work_id", "title", "number", F.col("release.state").alias("state"), F.col("release.date").alias("date"), "status", "cover", "position").orderBy("position").drop("position")
