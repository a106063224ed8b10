"""Operators over edition records: popularity, duplicates, starters, search, filters, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GENRES, PRIOR_RATING, PRIOR_VOTES, SEARCH_LIMIT, UNNUMBERED
from ..functions.signals import book_signals, passes_filters
from ..functions.text import edition_kind, matches_all, normalize_identity, number_text
from ..sources.search_index import build_index


def popularity(rating: Column, votes: Column) -> Column:
    """A rating drawn to the prior by its votes, times the logarithm of the votes; rounded, so that engines agree."""
    mean = (F.coalesce(rating, F.lit(PRIOR_RATING)) * votes + PRIOR_RATING * PRIOR_VOTES) / (votes + PRIOR_VOTES)
    return F.round(mean * F.log2(2 + votes), 6)


def book_popularity() -> Column:
    return popularity(F.col("rating"), F.col("ratingCount"))


def first_of_group(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. A rank filter: rows beyond the first go before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def capped_ranking(rows: DataFrame, group: Column, order: list[Column], per_group: int, limit: int) -> DataFrame:
    """The first ``limit`` rows of a ranking in which each group may hold ``per_group`` places; the cap comes first."""
    return top_per_group(rows.withColumn("__group", group), ["__group"], order, per_group).drop("__group").orderBy(*order).limit(limit)


def collapse_placeholders(rows: DataFrame, key: Column, placeholder: Column) -> DataFrame:
    """Rows without those placeholders that share their key with a richer row. Richer rows are never dropped."""
    marked = rows.withColumn("__key", key).withColumn("__thin", F.coalesce(placeholder, F.lit(False)))
    rich = marked.where(~F.col("__thin")).select("__key").distinct()
    thin = marked.where("__thin").join(rich, "__key", "left_anti")
    return marked.where(~F.col("__thin")).unionByName(thin.select(*marked.columns)).drop("__key", "__thin")


def book_key() -> Column:
    """What makes two editions the same listing."""
    first = F.element_at(F.split(F.coalesce("narrator", F.lit("")), ","), 1)
    return F.concat_ws("|", F.coalesce("seriesKey", F.lit("")), number_text(F.col("seriesNumber")), normalize_identity(F.col("title")), F.coalesce("edition", F.lit("")), F.coalesce("releaseDate", F.lit("")), normalize_identity(first))


def book_placeholder() -> Column:
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return (F.size(F.coalesce("sources", F.array())) == 0) & none("runtimeMinutes") & none("ratingCount")


def collapse_placeholder_duplicates(books: DataFrame) -> DataFrame:
    return collapse_placeholders(books, book_key(), book_placeholder())


def starter_order() -> list[Column]:
    return [(F.col("edition") != "audiobook").cast("int"), F.coalesce("seriesNumber", F.lit(float(UNNUMBERED))), book_popularity().desc(), F.col("id")]


def series_starters(books: DataFrame) -> DataFrame:
    """The entry point of each series, a book without a series being its own."""
    keyed = books.withColumn("__series", F.when(F.coalesce(F.col("series") != "", F.lit(False)), F.col("seriesKey")).otherwise(F.col("id")))
    return first_of_group(keyed, ["__series"], starter_order()).drop("__series")


def genre_labels(genres: Column) -> Column:
    labels = F.create_map(*[F.lit(v) for item in GENRES.items() for v in item])
    return F.transform(F.coalesce(genres, F.array()), lambda g: F.coalesce(labels[g], g))


def book_text() -> Column:
    """What a search of books looks through: title, series, credits, subtitle and genre labels."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "series", "author", "narrator", "subtitle")]
    return F.concat_ws(" ", *parts, F.array_join(genre_labels(F.col("subgenres")), " "))


def search_books(books: DataFrame, query: str) -> DataFrame:
    """Books of which every term of the query is somewhere in the text of the book; a scan of all."""
    return books.where(matches_all(book_text(), query))


def index_books(books: DataFrame, path: str) -> None:
    """An index with which ``search_index`` finds the ids that ``search_books`` finds, without scanning all texts."""
    build_index(books.select("id", book_text().alias("text")), path)


def matching_audiobooks(books: DataFrame, query: str, genre: str = "all", limit: int = SEARCH_LIMIT) -> DataFrame:
    """Editions that match when no series does, the most popular first; an empty query has none."""
    if not query.strip():
        return books.limit(0)
    pool = full_audio(books, any_kind=True)
    if genre != "all":
        pool = pool.where(F.array_contains("subgenres", genre))
    return search_books(pool, query).orderBy(book_popularity().desc(), "id").limit(limit)


def kind_of_book() -> Column:
    return edition_kind(F.col("title"), F.col("subtitle"), F.col("contentType"), F.col("contentDeliveryType"))


def full_audio(books: DataFrame, any_kind: bool = False) -> DataFrame:
    """Audiobook editions that are no podcasts, and unless ``any_kind`` neither collections nor adaptations."""
    kind = kind_of_book()
    return books.where((F.col("edition") == "audiobook") & (F.coalesce(kind != "podcast", F.lit(True)) if any_kind else kind.isNull()))


def filter_books(books: DataFrame, filters: dict, include_unclassified: bool = False) -> DataFrame:
    scope = F.lit(True) if include_unclassified else F.col("scope") == "indexed"
    return books.where(scope & passes_filters(book_signals(), filters))


def release_calendar(rows: DataFrame, date: str, mode: str, as_of: str, year: str | None = None, month: str = "all", tie: list[Column] | None = None, followed: DataFrame | None = None, series: str = "seriesKey") -> DataFrame:
    """Releases without a date, from today on, or of a year and perhaps a month, by date.

    With ``followed`` (series_id) only those of series that a reader follows.
    """
    d = F.col(date)
    if followed is not None:
        rows = rows.join(followed.select(F.col("series_id").alias(series)).distinct(), series, "left_semi")
    if mode == "unknown":
        kept = rows.where(d.isNull())
    elif mode == "upcoming":
        kept = rows.where(d >= as_of[:10])
    else:
        kept = rows.where(d.startswith(year) & ((F.substring(d, 6, 2) == month) if month != "all" else F.lit(True)))
    return kept.orderBy(F.coalesce(d, F.lit("")), *(tie or []))


def preference_count(filters: dict[str, Column | bool]) -> Column:
    """How many of the filters are on."""
    on = [F.coalesce(f if isinstance(f, Column) else F.lit(f), F.lit(False)).cast("int") for f in filters.values()]
    return sum(on[1:], on[0]) if on else F.lit(0)


def distinct_years(rows: DataFrame, date: str) -> DataFrame:
    return rows.where(F.col(date).isNotNull()).select(F.substring(date, 1, 4).alias("year")).distinct().orderBy(F.desc("year"))


def distinct_names(rows: DataFrame, names: str) -> DataFrame:
    """The different names of comma-separated credits."""
    return rows.select(F.explode(F.split(names, ",")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()


def counts_by(rows: DataFrame, state: str, known: list[str]) -> DataFrame:
    """One row with a count for each known state."""
    return rows.agg(*[F.count_if(F.col(state) == s).alias(s.replace("-", "_")) for s in known])


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows of an ascending order after the last row seen."""
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after)]))
    return rows.orderBy(*order).limit(size)


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; one at least below the line."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def ordered_union(rows: DataFrame, key: list[str], values: str, ordinal: str, name: str) -> DataFrame:
    """Per key the different members of its arrays, in the order in which rows and arrays have them."""
    gathered = F.transform(F.sort_array(F.collect_list(F.struct(ordinal, values))), lambda x: x[values])
    return rows.groupBy(*key).agg(F.array_distinct(F.flatten(gathered)).alias(name))
