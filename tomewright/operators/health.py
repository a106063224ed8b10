"""Catalog health: worst status per group of checks, coverage of groups, attention per series, snapshot validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHECK_GROUPS, SERIES_METADATA, SEVERITY
from ..functions.text import filing_key, matches_all


def severity(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for item in SEVERITY.items() for v in item])
    return F.coalesce(ranks[status], F.lit(SEVERITY["unknown"]))


def status_of(rank: Column) -> Column:
    names = F.create_map(*[F.lit(v) for item in SEVERITY.items() for v in (item[1], item[0])])
    return names[rank]


def _check(checks: Column, id: str) -> Column:
    return F.get(F.filter(checks, lambda c: c["id"] == id), F.lit(0))


def grouped_check(checks: Column, ids: tuple[str, ...]) -> Column:
    """(status, available) of a group: the worst of its checks; one that is missing counts as unknown and unavailable."""
    found = [_check(checks, i) for i in ids]
    worst = F.greatest(*[severity(c["status"]) for c in found]) if len(found) > 1 else severity(found[0]["status"])
    available = reduce(lambda a, b: a & b, [F.coalesce(c["available"], F.lit(False)) for c in found])
    return F.struct(status_of(worst).alias("status"), available.alias("available"))


def grouped_checks(rows: DataFrame, checks: str = "checks", series: bool = False, groups: dict[str, tuple[str, ...]] = CHECK_GROUPS) -> DataFrame:
    """``rows`` with one struct column per group of checks; series have further metadata checks."""
    return rows.withColumns({f"group_{g}": grouped_check(F.col(checks), ids + (SERIES_METADATA if series and g == "metadata" else ())) for g, ids in groups.items()})


def group_coverage(works: DataFrame, group: str, key: list[str] | None = None) -> DataFrame:
    """Works whose group is present, and all works."""
    marked = works.withColumn("__g", grouped_check(F.col("checks"), CHECK_GROUPS[group])["status"])
    return marked.groupBy(*(key or [])).agg(F.count_if(F.col("__g") == "present").alias("current"), F.count("*").alias("total"))


def worst_status(rows: DataFrame, key: list[str], status: Column) -> DataFrame:
    """Per key the worst status of its rows."""
    return rows.groupBy(*key).agg(F.max(severity(status)).alias("rank")).select(*key, status_of(F.col("rank")).alias("status"))


def series_rows(series: DataFrame, works: DataFrame) -> DataFrame:
    """Per series: is anything missing or in need of review, works with missing checks, attention, its oldest source.

    Series without works count too. A source that was never checked makes the oldest one unknown.
    """
    status = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["status"])
    has = lambda a, *v: F.exists(a, lambda s: s.isin(*v))
    per = works.select("seriesId", "checks", "title", "author").withColumn("st", F.transform("checks", lambda c: c["status"]))
    agg = per.groupBy(F.col("seriesId").alias("id")).agg(
        F.bool_or(has(F.col("st"), "missing")).alias("w_missing"), F.bool_or(has(F.col("st"), "unknown", "stale")).alias("w_review"), F.count_if(has(F.col("st"), "missing")).alias("missing_works"),
        F.sum(F.size(F.filter("st", lambda s: s != "present"))).alias("w_attention"), F.array_join(F.collect_list(F.concat_ws(" ", "title", "author")), " ").alias("w_text"),
    )
    own = F.concat(status(F.col("checks")), status(F.col("issues")), status(F.col("missingVolumes")))
    rows = series.withColumn("own", own).join(agg, "id", "left")
    dates = F.transform("sources", lambda s: F.nullif(s["checkedAt"], F.lit("")))
    return rows.select(
        "id", "title", "author", "completeness", "evidenceQuality", (has(F.col("own"), "missing") | F.coalesce("w_missing", F.lit(False))).alias("missing"),
        (has(F.col("own"), "unknown", "stale") | F.coalesce("w_review", F.lit(False))).alias("review"), F.coalesce("missing_works", F.lit(0)).alias("missing_works"),
        (F.coalesce("w_attention", F.lit(0)) + F.size("issues") + F.size("missingVolumes")).alias("attention"),
        F.when(~F.exists(dates, lambda d: d.isNull()), F.array_min(dates)).alias("oldest_source"), F.concat_ws(" ", "title", "author", "w_text").alias("search_text"),
    )


def visible_series(rows: DataFrame, which: str = "all", query: str = "", sort: str = "attention") -> DataFrame:
    """Series rows that a filter and a query leave, in one of five orders, then by title and id."""
    if which in ("missing", "review"):
        rows = rows.where(which)
    first = {"attention": [F.desc("attention")], "completeness": [F.col("completeness.percent")], "evidence": [F.col("evidenceQuality.percent")], "freshness": [F.coalesce("oldest_source", F.lit(""))]}.get(sort, [])
    return rows.where(matches_all(F.col("search_text"), query)).orderBy(*first, F.collate(filing_key(F.col("title")), "UNICODE_CI_AI"), "id")


def filter_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("all"), F.count_if("missing").alias("missing"), F.count_if("review").alias("review"))


def _dealt(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """``rows`` in a number of parts by key; Spark would choose it by compressed bytes, of which keys take few."""
    return rows.repartition(parts, key) if parts else rows


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, parts: int | None = None) -> DataFrame:
    """Child rows whose key no parent has; a null key is one of them."""
    known = _dealt(parent.select(F.col(parent_key).alias("__p")), "__p", parts).distinct()
    return _dealt(child, child_key, parts).join(known, F.col(child_key) == F.col("__p"), "left_anti")


def duplicates(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    return _dealt(rows.select(key), key, parts).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def violations(series: DataFrame, works: DataFrame, parts: int | None = None) -> DataFrame:
    """(subject, id, reason) for everything that makes a snapshot unusable; a valid one has none. Ids are dealt out in ``parts``."""
    statuses = list(SEVERITY)
    bad = lambda x: F.coalesce(~x, F.lit(True))
    score = lambda s: s["percent"].between(0, 100) & s["earned"].isNotNull() & s["possible"].isNotNull() & s["explanation"].isNotNull()
    checks = F.forall("checks", lambda c: F.coalesce(c["id"].isNotNull() & c["label"].isNotNull() & c["status"].isin(*statuses) & c["available"].isNotNull() & c["explanation"].isNotNull(), F.lit(False)))
    problems = F.forall("issues", lambda i: F.coalesce(i["code"].isNotNull() & i["message"].isNotNull() & i["status"].isin(*[s for s in statuses if s != "present"]), F.lit(False)))
    sources = F.forall("sources", lambda s: F.coalesce(s["url"].isNotNull() & s["status"].isin(*statuses), F.lit(False)))
    common = {
        "identity": F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("author").isNotNull(), "score": score(F.col("completeness")) & score(F.col("evidenceQuality")),
        "check": checks, "issue": problems, "source": sources,
    }
    gap = F.forall("missingVolumes", lambda g: F.coalesce(g["number"].isNotNull() & g["evidence"].isin("reviewed-bibliography", "observed-numbering") & g["status"].isin("missing", "unknown", "stale") & g["explanation"].isNotNull(), F.lit(False)))
    found = []
    for name, df, more in (("series", series, {"gap": gap, "counts": F.col("knownWorks").isNotNull() & F.col("confirmedAudioWorks").isNotNull() & F.col("workIds").isNotNull()}), ("work", works, {"audio": F.col("audio.state").isin("released", "scheduled", "undated", "unverified", "none"), "formats": F.col("formats").isNotNull()})):
        reasons = F.array_compact(F.array(*[F.when(bad(ok), reason) for reason, ok in {**common, **more}.items()]))
        found.append(df.select(F.lit(name).alias("subject"), "id", F.explode(reasons).alias("reason")))
        found.append(duplicates(df, "id", parts).select(F.lit(name).alias("subject"), "id", F.lit("duplicate").alias("reason")))
    found.append(orphans(works.select("id", "seriesId"), series, "seriesId", "id", parts).select(F.lit("work").alias("subject"), "id", F.lit("series").alias("reason")))
    return reduce(lambda a, b: a.unionByName(b), found)


def percent(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(score["percent"]).cast("int")))


def audio_label(state: Column) -> Column:
    labels = {"released": "Released", "scheduled": "Scheduled", "undated": "Date unknown", "unverified": "Unverified", "none": "No audio retained"}
    return F.create_map(*[F.lit(v) for item in labels.items() for v in item])[state]
