"""Catalog records made from the driver's tables, in Spark and in SQL: what the operators on whole records are run on.

``part`` gives editions: p_brand is the series, p_size the volume. Every 13th is a placeholder that repeats the edition before
it. ``lineitem`` gives works: l_orderkey is the series, l_linenumber the volume, and each line an edition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..storage import scratch
from .registry import read, tasks

TASTE_KEYS = ("stats", "action", "humor", "cozy", "worldbuilding", "crafting", "politics", "teamwork")

#: The editions, column by column, as expressions that Spark and DuckDB read alike; k is the number of the edition.
FIELDS = {
    "title": "concat(p_name, ' ', cast(k % 50 as string))",
    "series": "case when k % 10 = 9 then '' else p_brand end",
    "seriesKey": "case when k % 10 = 9 then cast(null as string) else p_brand end",
    "seriesNumber": "case when k % 6 = 5 then cast(null as double) else cast(1 + p_size % 6 as double) end",
    "author": "concat('Author ', cast(k % 40 as string))",
    "narrator": "concat('Ned ', cast(k % 7 as string), ', Ann')",
    "releaseDate": "case when k % 9 = 0 then cast(null as string) else concat(cast(1990 + k % 12 as string), '-0', cast(1 + k % 9 as string), '-1', cast(k % 10 as string)) end",
    "coverUrl": "case when k % 4 = 0 then '' else concat('c', cast(k as string)) end",
    "rating": "case when k % 17 = 0 then cast(null as double) else p_retailprice / 500.0 end",
    "edition": "case when k % 7 = 3 then 'ebook' else 'audiobook' end",
    "scope": "case when k % 5 = 4 then 'pending' else 'indexed' end",
    "votes": "case when thin then 0 else p_size * 10 end",
    "taxonomy": "case when k % 3 = 2 then '0' else '1' end",
}
#: Tag, and when an edition has it, in the order of the list.
SUBGENRES = (("litrpg", "k % 2 = 0"), ("dungeon", "k % 3 = 0"), ("academy", "k % 5 = 0"))
FEATURES = (("isekai", "k % 4 = 1"), ("dungeon", "k % 3 = 1"), ("academy", "k % 5 < 2"))
#: Signal, and its verdict, confidence and source.
SIGNALS = {
    "harem": ("case when k % 12 < 3 then 'present' else 'absent' end", "case when k % 12 = 2 then 0.7 else 0.95 end", "case when k % 12 = 1 then 'model' else 'publisher' end"),
    "sexualized": ("case when k % 11 = 0 then 'present' else 'absent' end", "case when k % 22 = 0 then 0.85 else 0.95 end", "case when k % 2 = 0 then 'vision' else 'publisher' end"),
    "explicit": ("case when k % 19 = 0 then 'present' else 'unknown' end", "0.95", "'publisher'"),
}
TASTES = {t: (f"(k % {7 + i}) / cast({6 + i} as double)", f"(k % {5 + i}) / cast({4 + i} as double)") for i, t in enumerate(TASTE_KEYS)}
BASE = "(p.p_partkey % 13 = 0 and p.p_partkey > 0)"


#: Records of one partition of ``books``.
RECORDS = 20_000


def _sql(expression: str) -> str:
    return expression.replace("as string", "as varchar")


def _lists(tags) -> str:
    parts = [f"case when {c} then ['{t}'] else cast([] as varchar[]) end" for t, c in tags]
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


#: ``b``: the editions with the columns of FIELDS, id, k, thin, lists of tags, and each signal's and taste's parts.
BOOKS_SQL = (
    f"b0 as (select p.p_partkey pk, {BASE} thin, q.p_partkey k, q.p_name, q.p_brand, q.p_size, q.p_retailprice from part p join part q on q.p_partkey = p.p_partkey - case when {BASE} then 1 else 0 end),\n"
    "b as (select 'p' || pk id, pk ordinal, k, thin, "
    + ", ".join(f'{_sql(e)} "{c}"' for c, e in FIELDS.items())
    + f", {_lists(SUBGENRES)} subgenres, case when k % 8 = 7 then null else {_lists(FEATURES)} end features, "
    + ", ".join(f"{v} {s}_verdict, cast({c} as double) {s}_confidence, {o} {s}_source" for s, (v, c, o) in SIGNALS.items())
    + ", "
    + ", ".join(f"cast({a} as double) {t}_value, cast({c} as double) {t}_confidence" for t, (a, c) in TASTES.items())
    + " from b0)"
)
POPULARITY_SQL = "round((coalesce({rating}, 4.2) * {votes} + 4.2 * 50) / ({votes} + 50) * log2(2.0 + {votes}), 6)"
IDENTITY_SQL = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]', '', 'g')"
#: ``kept``: the editions without placeholders that stand beside a richer one of the same listing.
KEPT_SQL = f"""keyed as (select *, concat_ws('|', coalesce("seriesKey", ''), coalesce(cast(cast("seriesNumber" as int) as varchar), ''), {IDENTITY_SQL.format('title')}, edition, coalesce("releaseDate", ''), {IDENTITY_SQL.format("split_part(narrator, ',', 1)")}) listing, {POPULARITY_SQL.format(rating='rating', votes='votes')} popularity from b),
kept as (select * from keyed where not (thin or votes = 0) or listing not in (select listing from keyed where not (thin or votes = 0)))"""
PRESENT_SQL = "({s}_verdict = 'present' and {s}_confidence >= case when {s}_source in ('model', 'vision') then 0.8 else 0.9 end)"


def _tags(tags) -> Column:
    return F.concat(*[F.when(F.expr(c), F.array(F.lit(t))).otherwise(F.array().cast("array<string>")) for t, c in tags])


def books(spark, d) -> DataFrame:
    """Editions of ``part`` with all columns of a record.

    A file of few columns makes records of many: parts of a fixed number of rows keep what one task holds bounded.
    """
    p = read(spark, d, "part")
    parts = p.count() // RECORDS + 1
    thin = (F.col("p_partkey") % 13 == 0) & (F.col("p_partkey") > 0)
    p = p.select(F.col("p_partkey").alias("pk"), thin.alias("thin"), (F.col("p_partkey") - thin.cast("int")).alias("k")).repartition(parts, "k").join(p.withColumnRenamed("p_partkey", "k").repartition(parts, "k"), "k")
    made = {c: F.expr(e) for c, e in FIELDS.items() if c not in ("votes", "taxonomy")}
    votes = F.expr(FIELDS["votes"]).cast("int")
    signal = lambda s: F.struct(*[(F.expr(SIGNALS[s][i]) if s in SIGNALS else F.lit(("unknown", 0.0, "unknown")[i])).cast(t).alias(n) for i, (n, t) in enumerate((("verdict", "string"), ("confidence", "double"), ("source", "string")))], F.lit(None).cast("string").alias("note"))
    taste = F.create_map(*[x for t, (a, c) in TASTES.items() for x in (F.lit(t), F.struct(F.expr(a).cast("double").alias("value"), F.expr(c).cast("double").alias("confidence")))])
    made |= {
        "ordinal": F.col("pk"), "id": F.concat(F.lit("p"), F.col("pk").cast("string")), "ratingCount": votes, "subgenres": _tags(SUBGENRES), "features": F.when(F.expr("k % 8 <> 7"), _tags(FEATURES)),
        "content": F.struct(*[signal(s).alias(s) for s in ("sexualized", "explicit", "harem", "aiNarration", "aiWriting", "quality")]), "runtimeMinutes": F.when(votes > 0, 600).otherwise(0),
        "sources": F.when(votes > 0, F.array(F.struct(F.lit("shop").alias("name"), F.lit(None).cast("string").alias("fetchedAt"), F.lit(None).cast("string").alias("url")))).otherwise(F.array()),
        "featureEvidence": F.struct(F.lit("https://example.org/review").alias("sourceUrl"), F.array().cast("array<string>").alias("additionalSourceUrls"), F.lit("1997-01-01").alias("reviewedAt"), F.expr(FIELDS["taxonomy"]).alias("taxonomyVersion")),
        "assessment": F.struct(F.lit("m").alias("model"), F.lit(None).cast("string").alias("evaluatedAt"), F.lit(None).cast("string").alias("inputHash"), taste.alias("taste")),
    }
    schema = T.StructType.fromDDL(schemas.BOOK)
    return p.select(*[_as(made.get(f.name), f.dataType).alias(f.name) for f in schema])


def _as(column: Column | None, kind: T.DataType) -> Column:
    if column is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType) and "taste" in kind.names:  # an assessment of which only some parts are known
        return F.struct(*[(column[n] if n in ("model", "evaluatedAt", "inputHash", "taste") else F.lit(None).cast(kind[n].dataType)).alias(n) for n in kind.names])
    return column.cast(kind)


#: ``w``: the works of ``lineitem``, one for each series, volume and part; ``rn`` = 1 marks the mainline one of a volume.
WORKS_SQL = """w0 as (select 'o' || l_orderkey series_id, l_orderkey, l_linenumber, l_partkey, 'o' || l_orderkey || '-' || l_linenumber || '-' || l_partkey work_id, 'Part ' || l_partkey title, cast(l_linenumber as double) number, 'p' || l_partkey book_id,
list_sort(list(distinct 's' || l_suppkey || '-' || l_partkey)) edition_ids, min(strftime(l_shipdate, '%Y-%m-%d')) date, max(l_returnflag) flag, max(l_linestatus) linestatus, l_linenumber * 1000000000::bigint + l_partkey as "position"
from lineitem group by l_orderkey, l_linenumber, l_partkey),
w as (select *, row_number() over (partition by l_orderkey, l_linenumber order by len(edition_ids) desc, length(title), l_partkey) rn from w0)"""


#: ``sh``: the numbered works of each p_brand; an even one also lists edition p7, so that several works claim it.
SHELF_SQL = """sh as (select "seriesKey" series_id, "seriesKey" || '#' || cast("seriesNumber" as int) work_id, "seriesNumber" number, arg_min(title, ordinal) title, arg_min(id, case when edition = 'audiobook' then ordinal else ordinal + 1000000000 end) book_id,
list_sort(list_distinct(list_concat(list(id), case when "seriesNumber" % 2 = 0 then ['p7'] else cast([] as varchar[]) end))) edition_ids, min("releaseDate") filter (where edition = 'audiobook') date, bool_or(edition = 'audiobook') has_audio
from b where "seriesKey" is not null and "seriesNumber" is not null group by "seriesKey", "seriesNumber")"""


def shelf(rows: DataFrame) -> DataFrame:
    """The works of p_brand series, from their editions."""
    audio, n = F.col("edition") == "audiobook", F.col("seriesNumber")
    ids = F.array_union(F.collect_list("id"), F.when(F.first(n) % 2 == 0, F.array(F.lit("p7"))).otherwise(F.array().cast("array<string>")))
    per = rows.where("seriesKey is not null and seriesNumber is not null").groupBy("seriesKey", "seriesNumber").agg(
        F.min_by("title", "ordinal").alias("title"), F.min_by("id", F.when(audio, F.col("ordinal")).otherwise(F.col("ordinal") + 1000000000)).alias("book_id"), F.sort_array(ids).alias("edition_ids"),
        F.min(F.when(audio, F.col("releaseDate"))).alias("audio_release_date"), F.bool_or(audio).alias("has_audio"),
    )
    return per.select(
        F.col("seriesKey").alias("series_id"), F.col("seriesKey").alias("series_title"), n.cast("long").alias("position"), F.regexp_extract("seriesKey", r"(\d+)", 1).cast("long").alias("series_ordinal"),
        F.concat("seriesKey", F.lit("#"), n.cast("int").cast("string")).alias("work_id"), "title", n.alias("number"), "book_id", "edition_ids", "audio_release_date", F.lit(False).alias("verified"), "has_audio",
    )


def _gathered(li: DataFrame) -> DataFrame:
    """One row per order, line number and part of ``lineitem``."""
    return li.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.collect_set("l_suppkey").alias("supps"), F.min(F.to_date("l_shipdate")).alias("day"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("linestatus"),
    )


def _named(li: DataFrame, *more: str) -> DataFrame:
    sid, part = F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.col("l_partkey").cast("string")
    return li.select(
        sid.alias("series_id"), F.lit("").alias("series_title"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("position"), F.col("l_orderkey").alias("series_ordinal"),
        F.concat_ws("-", sid, F.col("l_linenumber").cast("string"), part).alias("work_id"), F.concat(F.lit("Part "), part).alias("title"), F.col("l_linenumber").cast("double").alias("number"),
        F.concat(F.lit("p"), part).alias("book_id"), F.sort_array(F.array_compact(F.transform("supps", lambda x: F.concat(F.lit("s"), x.cast("string"), F.lit("-"), part)))).alias("edition_ids"),
        F.date_format("day", "yyyy-MM-dd").alias("audio_release_date"), F.lit(False).alias("verified"), F.lit(None).cast("boolean").alias("has_audio"), "flag", "linestatus", *more,
    )


def works(spark, d) -> DataFrame:
    """Works of ``lineitem`` as exploded works are, with what the tables say of them besides; dealt out once, by order."""
    li = read(spark, d, "lineitem")
    return _named(_gathered(li.repartition(tasks(li), "l_orderkey")))


def placed_orders(spark, d) -> tuple[DataFrame, DataFrame, int]:
    """``works`` and (series_ordinal, k, user_id), the customers who read them, both dealt out by series_ordinal, the order, and into how many parts.

    All that these queries join, count and rank lies within an order: operators that are told so (``within``) then shuffle
    nothing more, however often the works are used. ``lineitem`` is shuffled once, gathered and written as a table in buckets of orders, so
    that Spark knows where the rows of an order are; a work is named when it is read. The table is the session's, its files lie in a
    scratch folder. ``k`` is series_ordinal too; of ``orders`` a condition on it does not reach the shuffle, which so serves all uses.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # rows of an order are together, whatever else a join compares
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    parts, name = tasks(li, o), f"works_{uuid.uuid4().hex}"
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus").where("l_orderkey is not null")
    _gathered(lines.repartition(parts, "l_orderkey")).write.format("parquet").bucketBy(parts, "l_orderkey").option("path", scratch(spark, "works")).saveAsTable(name)
    rows = spark.table(name).withColumn("k", F.col("l_orderkey"))
    o = o.select(F.col("o_orderkey").alias("series_ordinal"), "o_custkey").where("series_ordinal is not null").repartition(parts, "series_ordinal")
    o = o.select("series_ordinal", F.inline(F.array(F.struct(F.col("series_ordinal").alias("k"), "o_custkey"))))
    return _named(rows, "k"), o.select("series_ordinal", F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"), "k"), parts


def series_of(rows: DataFrame, **columns: Column) -> DataFrame:
    """Series with nested works from flat ones; further columns of a record as given, null otherwise."""
    names = {"id": "work_id", "bookId": "book_id", "editionIds": "edition_ids", "audioReleaseDate": "audio_release_date", "hasAudio": "has_audio"}
    schema = T.StructType.fromDDL(schemas.SERIES)
    kind = schema["works"].dataType.elementType
    work = F.struct(*[F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in kind])
    one = rows.groupBy(F.col("series_id").alias("id"), "series_ordinal").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", work.alias("w")))), lambda x: x["w"]).alias("works"))
    have = {"id": F.col("id"), "ordinal": F.col("series_ordinal"), "works": F.col("works"), **columns}
    return one.select(*[(have[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
