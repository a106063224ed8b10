"""The registered queries: each operator on the driver's tables, with the SQL it must agree with.

Correspondence: part ~ editions (p_brand ~ series, p_type ~ genre), orders ~ series, lineitem ~ works and their editions,
events ~ library edits by user, embeddings ~ taste profiles, documents and labels ~ listings with signals, pages ~ source
addresses, conversations ~ ordered actions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import PER_AUTHOR, RECOMMEND_LIMIT
from ..functions import dates, signals, text, urls
from ..operators import accounts, catalog, coverage, health, library, reader, recommend, series
from ..streaming import states
from .registry import ORACLES, QUERIES, query
from .registry import read as _read
from .registry import tasks

AS_OF = "1998-07-01"


# --- popularity, ranking, starters ------------------------------------------------------------------------------------
POPULARITY = "round(((p_retailprice/500.0)*p_size + 4.2*50)/(p_size+50) * log2(2.0+p_size), 6)"


def _parts(spark, d):
    return _read(spark, d, "part").withColumn("popularity", catalog.popularity(F.col("p_retailprice") / 500.0, F.col("p_size")))


@query(f"""select p_partkey, p_brand, popularity from (select *, row_number() over (partition by p_brand order by popularity desc, p_partkey) rn
from (select *, {POPULARITY} popularity from part)) where rn <= {PER_AUTHOR} order by popularity desc, p_partkey limit {RECOMMEND_LIMIT}""")
def q01_capped_popular(spark, d):
    rows = _parts(spark, d).select("p_partkey", "p_brand", "popularity")
    return catalog.capped_ranking(rows, F.col("p_brand"), [F.desc("popularity"), F.col("p_partkey")], PER_AUTHOR, RECOMMEND_LIMIT)


@query(f"select p_partkey, {POPULARITY} popularity from part")
def q02_popularity(spark, d):
    return _parts(spark, d).select("p_partkey", "popularity")


@query(f"""select p_brand, p_partkey, popularity from (select *, row_number() over (partition by p_brand order by p_size, popularity desc, p_partkey) rn
from (select *, {POPULARITY} popularity from part)) where rn = 1""")
def q06_starters(spark, d):
    return catalog.first_of_group(_parts(spark, d), ["p_brand"], [F.col("p_size"), F.desc("popularity"), F.col("p_partkey")]).select("p_brand", "p_partkey", "popularity")


# --- signals and filters ----------------------------------------------------------------------------------------------
SIGNALS = """(select d.doc_id, d.source,
case when quality is null then 'unknown' when quality = 0 then 'present' else 'absent' end verdict,
case when quality is null then 0.0 else 0.75 + (d.doc_id % 5) * 0.05 end confidence,
case when d.doc_id % 3 = 0 then 'vision' else 'publisher' end origin,
case when toxic is null then 'unknown' when toxic = 1 then 'present' else 'absent' end t_verdict,
case when toxic is null then 0.0 else 0.85 + (d.doc_id % 3) * 0.05 end t_confidence
from documents d left join labels l on d.doc_id = l.doc_id)"""
PRESENT = "({v} = 'present' and {c} >= case when origin = 'vision' then 0.8 else 0.9 end)"


def _signals(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", "source").join(_read(spark, d, "labels"), "doc_id", "left")
    verdict = lambda c, bad: F.when(F.col(c).isNull(), "unknown").when(F.col(c) == bad, "present").otherwise("absent")
    step = lambda c, base, n: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.expr(f"cast({base} + (doc_id % {n}) * 0.05 as double)"))
    return rows.select(
        "doc_id", "source", verdict("quality", 0).alias("verdict"), step("quality", 0.75, 5).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, "vision").otherwise("publisher").alias("origin"),
        verdict("toxic", 1).alias("t_verdict"), step("toxic", 0.85, 3).alias("t_confidence"),
    )


@query(f"select doc_id, {PRESENT.format(v='verdict', c='confidence')} is_present from {SIGNALS}")
def q03_signal_present(spark, d):
    return _signals(spark, d).select("doc_id", signals.signal_present(F.col("verdict"), F.col("confidence"), F.col("origin"), ("vision",)).alias("is_present"))


@query(f"""select doc_id from {SIGNALS} where not {PRESENT.format(v='verdict', c='confidence')} and verdict = 'absent' and confidence >= 0.8
and not {PRESENT.format(v='t_verdict', c='t_confidence')} and t_verdict = 'absent' and t_confidence >= 0.8""")
def q04_passes_filters(spark, d):
    rows = _signals(spark, d)
    found = {"quality": (F.col("verdict"), F.col("confidence"), F.col("origin")), "explicit": (F.col("t_verdict"), F.col("t_confidence"), F.col("origin"))}
    return rows.where(signals.passes_filters(found, {"hideQualityFlags": True, "hideUnknown": True}, ("vision",))).select("doc_id")


@query("""with k as (select doc_id, concat_ws('|', lang, source, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) as key, n_chars < 1000 as thin from documents)
select doc_id from k where not thin or not exists (select 1 from k r where not r.thin and r.key = k.key)""")
def q05_placeholder_collapse(spark, d):
    rows = _read(spark, d, "documents")
    key = F.concat_ws("|", "lang", "source", text.normalize_identity(F.col("text")))
    return catalog.collapse_placeholders(rows.select("doc_id", "n_chars", key.alias("k")), F.col("k"), F.col("n_chars") < 1000).select("doc_id")


# --- search and text --------------------------------------------------------------------------------------------------
@query("select doc_id from documents where contains(lower(concat_ws(' ', source, lang, text)), 'the') and contains(lower(concat_ws(' ', source, lang, text)), 'er') and contains(lower(concat_ws(' ', source, lang, text)), 'src1')")
def q07_search_all_terms(spark, d):
    return _read(spark, d, "documents").where(text.matches_all(F.concat_ws(" ", "source", "lang", "text"), "The  er SRC1")).select("doc_id")


@query("select doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') identity from documents")
def q08_normalize_identity(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.normalize_identity(F.col("text")).alias("identity"))


@query("""select p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '--' || coalesce(nullif(regexp_replace(lower(regexp_replace(split_part(p_name || ' (ed. ' || p_size || '), ' || p_type, ',', 1), '\\([^)]*\\)', '', 'g')), '[^a-z0-9]', '', 'g'), ''), 'unknown') identity from part""")
def q09_series_identity(spark, d):
    author = F.concat("p_name", F.lit(" (ed. "), F.col("p_size").cast("string"), F.lit("), "), "p_type")
    return _read(spark, d, "part").select("p_partkey", text.series_identity(F.col("p_brand"), author).alias("identity"))


@query("""select doc_id, regexp_replace(trim(split_part(text, chr(10), 1)), '^(a|an|the)\\s+(\\S)', '\\2', 'i') filing_key from documents""")
def q10_title_filing_key(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.filing_key(F.element_at(F.split("text", "\n"), 1)).alias("filing_key"))


@query("""with t as (select p_partkey, p_size, case p_partkey % 4 when 0 then ': Book ' || p_size when 1 then ', Vol. ' || ['I','II','III','IV','V','VI','VII','VIII','IX','X','IIV'][1 + p_partkey % 11] when 2 then ' ' || p_size || ' Miles' else ' Part ' || p_size || '.5' end label from part)
select p_partkey, case p_partkey % 4 when 0 then [cast(p_size as double)] when 1 then case when p_partkey % 11 = 10 then cast([] as double[]) else [cast(1 + p_partkey % 11 as double)] end when 2 then cast([] as double[]) else [p_size + cast(0.5 as double)] end numbers,
case p_partkey % 4 when 0 then p_size > 1 when 1 then p_partkey % 11 between 1 and 9 when 2 then false else p_size + 0.5 > 1 end later from t""")
def q11_volume_labels(spark, d):
    k = F.col("p_partkey")
    roman = F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "IIV")])
    size = F.col("p_size").cast("string")
    label = F.when(k % 4 == 0, F.concat(F.lit(": Book "), size)).when(k % 4 == 1, F.concat(F.lit(", Vol. "), F.get(roman, (k % 11).cast("int")))).when(k % 4 == 2, F.concat(F.lit(" "), size, F.lit(" Miles"))).otherwise(F.concat(F.lit(" Part "), size, F.lit(".5")))
    title = F.concat("p_name", label)
    return _read(spark, d, "part").select("p_partkey", text.volume_numbers(title).alias("numbers"), text.later_volume(title).alias("later"))


@query("""select p_partkey, case p_partkey % 7 when 0 then 'collection' when 1 then 'podcast' when 2 then 'dramatized' when 3 then 'collection' when 4 then 'collection' else null end kind from part""")
def q11b_edition_kind(spark, d):
    k = F.col("p_partkey") % 7
    label = F.when(k == 0, " Omnibus").when(k == 1, " Podcast").when(k == 2, " (Full Cast)").when(k == 3, ": Books 1-3").when(k == 4, " The Complete Space Saga").when(k == 5, " Book 2").otherwise(" Radio Collection")
    return _read(spark, d, "part").select("p_partkey", text.edition_kind(F.concat("p_name", label)).alias("kind"))


# --- works of series --------------------------------------------------------------------------------------------------
LINES = "(select *, row_number() over (partition by l_orderkey, l_linenumber order by l_quantity desc, l_partkey, l_suppkey, l_extendedprice) rn from lineitem)"


def _lines(spark, d):
    return _read(spark, d, "lineitem")


def _mainline(spark, d):
    order = [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return series.mainline(_lines(spark, d), "l_orderkey", "l_linenumber", order)


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from {LINES} where rn = 1")
def q12_mainline_pick(spark, d):
    return _mainline(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""with m as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from {LINES} where rn = 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem l where not exists (select 1 from m where m.l_orderkey = l.l_orderkey and m.l_linenumber = l.l_linenumber and m.l_partkey = l.l_partkey and m.l_suppkey = l.l_suppkey)""")
def q13_side_works(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return series.side_works(_lines(spark, d).select(*key, "l_quantity"), _mainline(spark, d), key)


@query("""with n as (select distinct l_orderkey, l_linenumber from lineitem), m as (select l_orderkey, max(l_linenumber) mx from n group by 1), g as (select l_orderkey, unnest(range(1, mx+1)) x from m)
select l_orderkey, cast(x as int) gap from g where not exists (select 1 from n where n.l_orderkey = g.l_orderkey and n.l_linenumber = g.x)""")
def q14_numbering_gaps(spark, d):
    return series.gaps(_lines(spark, d), "l_orderkey", "l_linenumber").select("l_orderkey", F.explode("gaps").alias("gap"))


@query(f"""select l_orderkey, max(d) filter (where d <= '{AS_OF}') latest, min(d) filter (where d > '{AS_OF}') next_date, arg_min(line, struct_pack(d := d, w := line)) filter (where d > '{AS_OF}') next_work
from (select l_orderkey, strftime(l_shipdate, '%Y-%m-%d') d, cast(l_linenumber as varchar) line from lineitem) group by 1""")
def q15_earliest_latest_release(spark, d):
    rows = _lines(spark, d).select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.col("l_linenumber").cast("string").alias("line"))
    return coverage.release_bounds(rows.withColumn("state", coverage.row_release(F.col("d"), AS_OF)), "l_orderkey", "state", "d", "line")


@query(f"""select state, count(*) n from (select case when l_shipdate is null then 'unknown' when strftime(l_shipdate, '%Y-%m-%d') <= '{AS_OF}' then 'released' else 'scheduled' end state from lineitem) group by 1""")
def q16_release_state(spark, d):
    rows = _lines(spark, d).select(coverage.row_release(F.date_format("l_shipdate", "yyyy-MM-dd"), AS_OF).alias("state"))
    return rows.groupBy("state").agg(F.count("*").alias("n"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d from orders where strftime(o_orderdate, '%Y-%m') = '1997-03'")
def q17_release_calendar(spark, d):
    rows = _read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return catalog.release_calendar(rows, "d", "year", AS_OF, "1997", "03", [F.col("o_orderkey")])


@query("select distinct strftime(o_orderdate, '%Y') as \"year\" from orders")
def q18_distinct_years(spark, d):
    return catalog.distinct_years(_read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "d")


@query("""select count(*) filter (where o_orderstatus = 'F') "F", count(*) filter (where o_orderstatus = 'O') "O", count(*) filter (where o_orderstatus = 'P') "P" from orders""")
def q19_state_counts(spark, d):
    return catalog.counts_by(_read(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"])


# --- libraries --------------------------------------------------------------------------------------------------------
@query("select user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) event_id, max(ts) ts from events group by 1")
def q20_latest_entry(spark, d):
    return library.latest(_read(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "ts"])


@query("""select user_id, event_type, arg_max(event_id, struct_pack(a := ts, b := side, c := event_id)) event_id from (select *, event_id % 2 side from events) group by 1, 2""")
def q21_merge_latest_wins(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    half = lambda k: library.latest(e.where(F.col("event_id") % 2 == k), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["ts", "event_id"])
    return library.merge(half(0), half(1), ["user_id", "event_type"], F.col("ts"), ["ts", "event_id"]).drop("ts")


SNAP = "select user_id, event_type, max(event_id) v from events where {} group by 1, 2"


@query(f"""with b as ({SNAP.format('event_id % 3 <> 1')}), l as ({SNAP.format('event_id % 3 <> 2 and event_id % 5 <> 0')}), r as ({SNAP.format('event_id % 4 <> 3')}),
k as (select user_id, event_type from b union select user_id, event_type from l union select user_id, event_type from r)
select k.user_id, k.event_type, case when b.v is not distinct from l.v then r.v else l.v end v from k left join b using (user_id, event_type) left join l using (user_id, event_type) left join r using (user_id, event_type)
where case when b.v is not distinct from l.v then r.v else l.v end is not null""")
def q22_rebase_three_way(spark, d):
    e = _read(spark, d, "events")
    snap = lambda cond: e.where(cond).groupBy("user_id", "event_type").agg(F.max("event_id").alias("v"))
    return library.rebase(snap("event_id % 3 <> 1"), snap("event_id % 3 <> 2 and event_id % 5 <> 0"), snap("event_id % 4 <> 3"), ["user_id", "event_type"], ["v"])


@query("""with a as (select 'C' || c_custkey id, 'C' || (c_custkey + c_nationkey) alias from customer), ids as (select distinct id from a),
u as (select alias, min(id) t from a where alias not in (select id from ids) group by 1 having count(distinct id) = 1), refs as (select distinct 'C' || (c_custkey + 3) ref from customer)
select ref, coalesce(ids.id, u.t) id from refs left join ids on ref = ids.id left join u on ref = u.alias""")
def q23_alias_resolution(spark, d):
    c = _read(spark, d, "customer")
    names = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.concat(F.lit("C"), (F.col("c_custkey") + F.col("c_nationkey")).cast("string"))).alias("aliases"))
    return series.resolve_refs(c.select(F.concat(F.lit("C"), (F.col("c_custkey") + 3).cast("string")).alias("ref")).distinct(), names)


@query("select l_orderkey, l_linenumber, min(l_suppkey) l_suppkey, min(l_suppkey) w from lineitem group by 1, 2 having count(distinct l_suppkey) = 1")
def q24_membership_conflict(spark, d):
    rows = _lines(spark, d).withColumn("k", F.struct("l_orderkey", "l_linenumber")).withColumn("w", F.col("l_suppkey"))
    return series.membership(rows, "k", "l_suppkey", "w").select("k.*", "l_suppkey", "w")


# --- similarity -------------------------------------------------------------------------------------------------------
@query("""with g as (select p_brand, list(distinct p_type || '-' || p_size) types from part group by 1)
select a.p_brand brand, b.p_brand other, round(len(list_intersect(a.types, b.types)) / greatest(len(list_distinct(list_concat(a.types, b.types))), 1), 6) jaccard from g a, g b where a.p_brand = 'Brand#11' and b.p_brand <> a.p_brand""")
def q31_genre_jaccard(spark, d):
    g = _read(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.concat_ws("-", "p_type", F.col("p_size").cast("string"))).alias("types"))
    seed = g.where("p_brand = 'Brand#11'").select(F.col("p_brand").alias("brand"), F.col("types").alias("own"))
    met = g.join(F.broadcast(seed), F.col("p_brand") != F.col("brand"))  # one seed row
    return met.select("brand", F.col("p_brand").alias("other"), F.round(catalog.jaccard(F.col("own"), F.col("types")), 6).alias("jaccard"))


TASTE_SQL = "(least(greatest((cast(embedding[{i}] as double) + 0.3) / 0.6, 0.0), 1.0))"
CONF_SQL = "(least(greatest(0.45 + cast(embedding[{j}] as double), 0.0), 1.0))"


def _taste_sql() -> str:
    """The weighted distance over eight dimensions, spelled out."""
    d, w, n, s = [], [], [], []
    for i in range(1, 9):
        a, b = f"a.v{i}", f"b.v{i}"
        weight = f"(1.0 * least(a.c{i}, b.c{i}) * (0.2 + 0.8 * greatest({a}, {b})))"
        ok = f"(a.c{i} >= 0.45 and b.c{i} >= 0.45 and {weight} > 0)"
        d.append(f"case when {ok} then abs({a} - {b}) * {weight} else 0.0 end")
        w.append(f"case when {ok} then {weight} else 0.0 end")
        n.append(f"case when {ok} then 1 else 0 end")
        s.append(f"case when {ok} and {a} >= 0.5 and {b} >= 0.5 then 1 else 0 end")
    cols = ", ".join(f"{TASTE_SQL.format(i=i)} v{i}, {CONF_SQL.format(j=i + 8)} c{i}" for i in range(1, 9))
    add = lambda xs: "(0.0 + " + " + ".join(xs) + ")"
    return f"""with t as (select vec_id, label, {cols} from embeddings),
p as (select b.vec_id, b.label, a.label seed_label, {add(d)} d, {add(w)} w, {' + '.join(n)} n, {' + '.join(s)} s from t b, (select * from t where vec_id = 0) a where b.vec_id <> 0)
"""


@query(_taste_sql() + "select vec_id, cast(n as int) dimensions, round(d / nullif(w, 0), 6) distance from p where n >= 3")
def q32_weighted_similarity(spark, d):
    rows = _pairs(spark, d)
    total = lambda f: F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t[f])
    return rows.where(F.size("terms") >= 3).select("vec_id", F.size("terms").alias("dimensions"), F.round(total("d") / F.nullif(total("w"), F.lit(0.0)), 6).alias("distance"))


def _pairs(spark, d):
    e = F.col("embedding")
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    t = _read(spark, d, "embeddings").select(
        "vec_id", "label", *[clip((e[i].cast("double") + 0.3) / 0.6).alias(f"v{i}") for i in range(8)], *[clip(0.45 + e[i + 8].cast("double")).alias(f"c{i}") for i in range(8)]
    )
    seed = t.where("vec_id = 0").select(*[F.col(c).alias(f"s_{c}") for c in t.columns])
    met = t.where("vec_id <> 0").join(F.broadcast(seed))  # one seed row
    keys = ("stats", "action", "humor", "cozy", "worldbuilding", "crafting", "politics", "teamwork")
    terms = recommend.dimension_terms([(k, F.col(f"s_v{i}"), F.col(f"s_c{i}"), F.col(f"v{i}"), F.col(f"c{i}"), F.lit(True)) for i, k in enumerate(keys)], {})
    return met.withColumn("terms", F.array_compact(F.array(*terms)))


# --- health -----------------------------------------------------------------------------------------------------------
STATUS = "case event_type when 'error' then 'missing' when 'purchase' then 'stale' when 'signup' then 'unknown' else 'present' end"


@query("""select user_id, date_trunc('day', ts)::date as day, case max(case event_type when 'error' then 3 when 'purchase' then 2 when 'signup' then 1 else 0 end) when 3 then 'missing' when 2 then 'stale' when 1 then 'unknown' else 'present' end status from events group by 1, 2""")
def q35_severity_rollup(spark, d):
    e = _read(spark, d, "events").withColumn("day", F.to_date("ts"))
    status = F.when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "purchase", "stale").when(F.col("event_type") == "signup", "unknown").otherwise("present")
    return health.worst_status(e, ["user_id", "day"], status)


@query("""select 'order' subject, cast(o_orderkey as bigint) id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey) union all
select 'line', cast(l_orderkey as bigint) from lineitem where not exists (select 1 from orders where l_orderkey = o_orderkey) union all
select 'customer', cast(o_custkey as bigint) from orders where not exists (select 1 from customer where c_custkey = o_custkey) union all
select 'duplicate', cast(o_orderkey as bigint) from orders group by o_orderkey having count(*) > 1""")
def q37_integrity_violations(spark, d):
    o, li, c = _read(spark, d, "orders").select("o_orderkey", "o_custkey"), _lines(spark, d).select("l_orderkey"), _read(spark, d, "customer")
    parts = tasks(o, li)
    named = lambda df, name, key: df.select(F.lit(name).alias("subject"), F.col(key).cast("long").alias("id"))
    return (
        named(health.orphans(o, li, "o_orderkey", "l_orderkey", parts), "order", "o_orderkey").unionByName(named(health.orphans(li, o, "l_orderkey", "o_orderkey", parts), "line", "l_orderkey"))
        .unionByName(named(health.orphans(o, c, "o_custkey", "c_custkey", parts), "customer", "o_custkey")).unionByName(named(health.duplicates(o, "o_orderkey", parts), "duplicate", "o_orderkey"))
    )


# --- URLs, dates, JSON ------------------------------------------------------------------------------------------------
@query("""select page_id, page_id % 5 not in (1, 2, 3) safe, page_id % 5 not in (1, 3) open_safe,
case when page_id % 5 in (1, 3) then null else regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') end host from pages""")
def q38_safe_urls(spark, d):
    k = F.col("page_id") % 5
    odd = F.when(k == 1, F.concat(F.lit("javascript:"), "url")).when(k == 2, F.regexp_replace("url", "://", "://user:pw@")).when(k == 3, F.lit("not a url")).otherwise(F.col("url"))
    p = _read(spark, d, "pages").withColumn("u", odd)
    return p.select("page_id", urls.safe_url(F.col("u"), False).alias("safe"), urls.safe_url(F.col("u")).alias("open_safe"), F.when(k.isin(1, 3), F.lit(None)).otherwise(urls.source_host(F.col("u"))).alias("host"))


DAYS = "strftime(o_orderdate, '%Y-%m-') || lpad(cast(28 + o_orderkey % 4 as varchar), 2, '0')"


@query(f"select o_orderkey, case when try_cast({DAYS} as date) is not null then {DAYS} end valid from orders")
def q39_valid_dates(spark, d):
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((28 + F.col("o_orderkey") % 4).cast("string"), 2, "0"))
    return _read(spark, d, "orders").select("o_orderkey", dates.release_date(day, AS_OF).alias("valid"))


@query("""with j as (select event_id, user_id, 'w' || (event_id % 40) id, ['want','reading','read','paused','gone'][1 + event_id % 5] status, (event_id % 12) / 2.0 rating, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') seen from events)
select event_id, user_id, id, status, case when rating = floor(rating) and rating between 1 and 5 then cast(rating as int) end rating, case when event_id % 7 = 0 then '1999-01-01' else seen end updated_at from j where status <> 'gone'""")
def q40_json_library_parse(spark, d):
    from ..sources.catalog import parse_library

    e = _read(spark, d, "events")
    k = F.col("event_id")
    names = F.array(*[F.lit(s) for s in ("want", "reading", "read", "paused", "gone")])
    one = F.struct(F.get(names, (k % 5).cast("int")).alias("status"), ((k % 12) / 2.0).alias("rating"), F.when(k % 7 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updatedAt"))
    doc = F.struct(F.lit(2).alias("version"), F.create_map(F.lit("s"), F.struct(F.lit("1999-01-01").alias("followedAt"))).alias("series"), F.create_map(F.concat(F.lit("w"), (k % 40).cast("string")), one).alias("books"))
    raw = e.select("event_id", "user_id", parse_library(F.to_json(F.struct(F.lit(2).alias("version"), doc.alias("library")))).alias("l"))
    return library.parse_entries(raw.select("event_id", "user_id", F.col("l.books").alias("books")), as_of="1999-01-01").drop("hint_series", "hint_number")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') <= '1996-02-29' adult from orders")
def q41_adult_cutoff(spark, d):
    birth = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _read(spark, d, "orders").select("o_orderkey", dates.is_adult(birth, "2014-02-29T00:00:00Z").alias("adult"))


@query("""with t as (select conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') w, min(turn) turn from conversations where regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' group by 1, 2)
select conv_id, list(w order by turn, w)[1:6] bullets from t group by 1""")
def q42_bullets_distinct(spark, d):
    c = _read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("w"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "w"))), lambda x: x["w"])
    found = c.groupBy("conv_id").agg(reader.bullets(listed).alias("bullets"))
    return found.where(F.size("bullets") > 0)


# --- coverage ---------------------------------------------------------------------------------------------------------
NOW = "1998-07-01T12:00:00.000Z"


@query(f"""with o as (select * from orders where o_orderkey % 7 <> 0),
exp as (select distinct o_orderkey, l_linenumber n from o join lineitem on o_orderkey = l_orderkey where o_orderkey % 7 <> 1),
w as (select l_orderkey, l_linenumber n, count(*) c, min(strftime(l_shipdate, '%Y-%m-%d')) d, max(strftime(l_shipdate, '%Y-%m-%d')) dmax from lineitem group by 1, 2),
st as (select e.o_orderkey, e.n, w.d, case when w.d <= '1998-07-01' then 'released' else 'scheduled' end state from exp e join w on w.l_orderkey = e.o_orderkey and w.n = e.n),
agg as (select o_orderkey, count(*) filter (where state = 'released') rel, count(*) filter (where state = 'scheduled') sch, min(d) filter (where state = 'scheduled') nxt from st group by 1)
select cast(orders.o_orderkey as varchar) series_id,
case when orders.o_orderkey % 7 = 0 then 'unknown' when orders.o_orderkey % 7 = 1 or agg.o_orderkey is null then 'unknown' else 'verified' end status,
cast(coalesce(case when orders.o_orderkey % 7 > 1 then rel end, 0) as bigint) n_released, cast(coalesce(case when orders.o_orderkey % 7 > 1 then sch end, 0) as bigint) n_scheduled,
case when orders.o_orderkey % 7 > 1 and agg.o_orderkey is not null then strftime(least(timestamp '1998-07-08 00:00:00', coalesce(cast(nxt as timestamp), timestamp '9999-01-01')), '%Y-%m-%dT%H:%M:%S.000Z') end valid_until,
case when orders.o_orderkey % 7 = 0 then 'missing-manifest' when orders.o_orderkey % 7 = 1 or agg.o_orderkey is null then 'invalid-manifest' end issue
from orders left join agg using (o_orderkey)""")
def q45_coverage_assess(spark, d):
    li, o = _lines(spark, d), _read(spark, d, "orders")
    sid = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 7
    proof = lambda kind: F.struct(F.lit("doc").alias("documentId"), F.lit("https://example.org/list").alias("url"), F.lit("1998-07-01T00:00:00.000Z").alias("observedAt"), F.lit(kind).alias("sourceType"))
    pairs = li.select("l_orderkey", "l_linenumber").distinct()
    numbers = pairs.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("double"))).alias("n"))
    m = o.where(k != 0).join(numbers, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("m"), sid).alias("id"), sid.alias("seriesId"), F.lit("numbered-mainline").alias("scope"), F.lit("en").alias("language"), F.array(F.lit("US")).alias("marketplaces"),
        F.when(k == 1, F.array(F.lit(-1.0))).otherwise(F.coalesce("n", F.array().cast("array<double>"))).alias("expectedNumbers"), F.lit("1998-06-30T00:00:00Z").alias("reviewedAt"), F.lit("ongoing").alias("audioCatalogState"),
        F.array(proof("publisher")).alias("bibliography"), F.lit(None).cast("struct<documentId:string,url:string,observedAt:string,sourceType:string>").alias("finalListEvidence"),
    )
    work_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    works = pairs.select(work_id.alias("id"), F.col("l_orderkey").cast("string").alias("seriesId"), F.col("l_linenumber").cast("double").alias("number"), F.lit("mainline").alias("role"))
    ed = li.groupBy("l_orderkey", "l_linenumber").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("d"))
    seen = proof("retailer").withField("observedAt", F.lit("1998-07-01T00:00:00.000Z"))
    editions = ed.select(
        F.concat(F.lit("e"), work_id).alias("id"), work_id.alias("workId"), F.lit("audiobook").alias("format"),
        F.struct(F.lit("exact-retailer-product").alias("method"), seen.alias("evidence"), work_id.alias("workId"), F.col("l_orderkey").cast("string").alias("seriesId"), F.col("l_linenumber").cast("double").alias("number"), F.lit("EN ").alias("language"), F.lit("us").alias("marketplace"), F.lit("unabridged").alias("format"), F.col("d").alias("audioReleaseDate")).alias("verification"),
    )
    found = coverage.assess_coverage(o.select(sid.alias("series_id")), m, works, editions, NOW)
    c = F.col("coverage")
    return found.select("series_id", c["status"].alias("status"), F.size(c["releasedWorkIds"]).cast("long").alias("n_released"), F.size(c["scheduledWorkIds"]).cast("long").alias("n_scheduled"), c["validUntil"].alias("valid_until"), F.get(c["issues"], F.lit(0))["code"].alias("issue"))


# --- account tables and streams ---------------------------------------------------------------------------------------
@query("""with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 pos, event_id % 4 = 0 stale from events),
a as (select user_id, count(*) filter (where not stale) ok, count(*) n from e group by 1) select user_id, cast(ok as bigint) revision, cast(ok as bigint) accepted, cast(n - ok as bigint) rejected from a""")
def q46_cas_revisions(spark, d):
    from pyspark.sql import Window

    e = _read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 4 == 0).alias("stale"))
    before = F.coalesce(F.sum(F.when(F.col("stale"), 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edits = e.withColumn("base", F.when(F.col("stale"), F.lit(-1).cast("long")).otherwise(before))
    return accounts.fold_revisions(edits, "user_id", ["event_id"], "base")


@query("select event_id from events where epoch(ts) + 30*24*3600 > epoch(timestamp '2024-02-15')")
def q47_expire_sessions(spark, d):
    e = _read(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) + 30 * 24 * 3600 * 1000000).alias("expires_at"))  # a part of a second counts
    return accounts.unexpired(e, 1707955200 * 1000000).select("event_id")


@query("""with u as (select c_custkey + 100 k, c_name || '*' n, c_acctbal + 1 b from customer where c_custkey % 3 = 0)
select c_custkey, coalesce(u.n, c_name) c_name, c_acctbal from customer left join u on c_custkey = u.k union all select k, n, b from u where k not in (select c_custkey from customer)""")
def q48_upsert_insert_ignore(spark, d):
    c = _read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return accounts.upsert(c, new, ["c_custkey"], ["c_name"])


@query("""select c_custkey, c_name from customer where c_custkey % 2 = 0 union all select c_custkey, c_name from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0""")
def q48b_insert_or_ignore(spark, d):
    c = _read(spark, d, "customer").select("c_custkey", "c_name")
    return accounts.insert_or_ignore(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["c_custkey"])


@query("select c_custkey, c_nationkey, o_orderkey from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")
def q48c_live_sessions(spark, d):
    sessions = _read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("token_hash"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("expires_at"))
    users = _read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    found = accounts.live_sessions(sessions, users, 200000)
    return found.select(F.col("id").alias("c_custkey"), "c_nationkey", F.col("token_hash").cast("long").alias("o_orderkey"))


@query("select cast(date_trunc('day', ts) as timestamp) window_start, event_type, count(*) n from events group by 1, 2")
def q49_tumbling_counts(spark, d):
    found = states.windowed_counts(_read(spark, d, "events"), "ts", ("event_type",))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select c_custkey, sha256(c_name) digest, replace(replace(rtrim(to_base64(unhex(sha256(c_name))), '='), '+', '-'), '/', '_') token from customer")
def q50_sha_token(spark, d):
    return _read(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"), text.token_digest(F.col("c_name")).alias("token"))


@query("select p_partkey, case when p_size * 13 = 0 then 'Length unavailable' else cast(p_size * 13 // 60 as varchar) || 'h' || case when (p_size * 13) % 60 <> 0 then ' ' || cast((p_size * 13) % 60 as varchar) || 'm' else '' end end runtime from part")
def q51_runtime_text(spark, d):
    return _read(spark, d, "part").select("p_partkey", text.runtime_text(F.col("p_size") * 13).alias("runtime"))


@query("select o_orderkey, strftime(o_orderdate, '%b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') shown from orders")
def q52_display_date(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", dates.display_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"))


@query(f"""select s_suppkey, greatest(0.0, coalesce(max({POPULARITY}), 0.0)) popularity from supplier left join (select distinct l_suppkey, l_partkey from lineitem) on s_suppkey = l_suppkey left join part on l_partkey = p_partkey group by 1""")
def q54_series_popularity(spark, d):
    li = _lines(spark, d).select("l_suppkey", "l_partkey").distinct()
    works = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("series_id")).join(li, F.col("series_id") == F.col("l_suppkey"), "left").select("series_id", F.col("l_partkey").alias("book_id"))
    books = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 500.0).alias("rating"), F.col("p_size").alias("ratingCount"))
    return series.series_popularity(works, books).withColumnRenamed("series_id", "s_suppkey")


@query("""with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) select l_orderkey, list(p order by k) parts from (select l_orderkey, l_partkey p, min(l_linenumber) k0, min(l_linenumber * 1000000000::bigint + l_partkey) k from t group by 1, 2) group by 1""")
def q55_ordered_union(spark, d):
    li = _lines(spark, d).withColumn("o", F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).withColumn("v", F.array("l_partkey"))
    return catalog.ordered_union(li, ["l_orderkey"], "v", "o", "parts")


@query("select p_partkey, p_name from part where p_partkey > 100 order by p_partkey limit 24")
def q56_keyset_page(spark, d):
    return catalog.keyset_page(_read(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], (100,), 24)


@query("select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_totalprice > 100000)")
def q57_consume_once(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("expires_at"), "o_orderpriority")
    return accounts.consume_once(o, o.where("o_orderpriority = '1-URGENT'"), ["o_orderkey"], 100000)[1].select("o_orderkey")


# --- further operators ------------------------------------------------------------------------------------------------
@query(f"select user_id, cast(count(*) filter (where {STATUS} = 'present') as bigint) \"current\", count(*) total from events group by 1")
def q58_group_coverage(spark, d):
    status = F.when(F.col("event_type") == "error", "missing").when(F.col("event_type") == "purchase", "stale").when(F.col("event_type") == "signup", "unknown").otherwise("present")
    check = F.struct(F.lit("audio-verified").alias("id"), status.alias("status"), F.lit(True).alias("available"))
    return health.group_coverage(_read(spark, d, "events").select("user_id", F.array(check).alias("checks")), "audio", ["user_id"])


@query("select l_orderkey, l_linenumber, l_partkey from lineitem group by all having count(*) = 1")
def q59_edition_multiplicity(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return coverage.singles(_lines(spark, d), key, key).select(*key)


@query("""select c_custkey, case c_custkey % 5 when 0 then false when 1 then false when 2 then true when 3 then false else true end safe from customer""")
def q60_safe_ids(spark, d):
    k = F.col("c_custkey") % 5
    name = F.concat(F.lit("id"), F.col("c_custkey").cast("string"))
    odd = F.when(k == 0, F.concat(name, F.lit(" x"))).when(k == 1, F.lit("constructor")).when(k == 2, F.concat(name, F.lit("._:-"))).when(k == 3, F.concat(F.lpad(name, 140, "a"))).otherwise(name)
    return _read(spark, d, "customer").select("c_custkey", library.safe_id(odd).alias("safe"))


@query("""select o_orderkey, case when b <= '1996-06-01' and cast(substr(b,1,4) as int) >= 1876 then b end born, coalesce(o_orderkey % 2 = 0 and b <= '1978-06-01', false) allowed
from (select o_orderkey, strftime(o_orderdate - interval 16 year, '%Y-%m-%d') b from orders)""")
def q61_consent(spark, d):
    birth = F.date_format(F.col("o_orderdate") - F.expr("interval 16 years"), "yyyy-MM-dd")
    c = signals.consent(birth, F.lit("1996-01-01"), F.col("o_orderkey") % 2 == 0, "1996-06-01T00:00:00Z")
    return _read(spark, d, "orders").select("o_orderkey", c["birthDate"].alias("born"), c["allowAdult"].alias("allowed"))


@query("""select p_partkey, case p_partkey % 3 when 0 then 'q=' || p_size else 'view=' || case p_partkey % 3 when 1 then 'library' else 'releases' end || '&q=' || p_size end view_query from part""")
def q62_view_query(spark, d):
    k = F.col("p_partkey") % 3
    url = F.concat(F.lit("https://a.example/?view="), F.when(k == 0, "nowhere").when(k == 1, "shelf").otherwise("releases"), F.lit("&q="), F.col("p_size").cast("string"))
    return _read(spark, d, "part").select("p_partkey", urls.view_query(urls.view_state(url)).alias("view_query"))


@query("select p_partkey, p_partkey % 4 in (0, 1) public from part")
def q63_public_paths(spark, d):
    k = F.col("p_partkey") % 4
    year = F.concat(F.lit("static/data/"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit(".json"))
    path = F.when(k == 0, "static/data/catalog.json").when(k == 1, year).when(k == 2, "static/data/notes.json").otherwise("src/data/meta.json")
    return _read(spark, d, "part").select("p_partkey", accounts.public_path(path).alias("public"))


@query("""select id, arg_max(s, struct_pack(a := s, b := p)) series_id, arg_max(w, struct_pack(a := s, b := p)) work_id from
(select 'p' || l_partkey id, l_orderkey s, l_linenumber p, l_orderkey || '-' || l_linenumber w from lineitem union all select l_orderkey || '-' || l_linenumber, l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber from lineitem) group by 1""")
def q64_work_index(spark, d):
    works = _lines(spark, d).select(
        F.col("l_orderkey").alias("series_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("work_id"), F.col("l_linenumber").cast("double").alias("number"),
        F.col("l_orderkey").alias("series_ordinal"), F.col("l_linenumber").alias("position"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("book_id"), F.array().cast("array<string>").alias("edition_ids"),
    )
    return series.work_index(works)


@query("select distinct trim(n) as \"name\" from (select unnest(string_split(p_name || ', ' || p_type || ' ,', ',')) n from part) where trim(n) <> ''")
def q65_distinct_names(spark, d):
    return catalog.distinct_names(_read(spark, d, "part").select(F.concat("p_name", F.lit(", "), "p_type", F.lit(" ,")).alias("n")), "n")


@query("select user_id, event_type series_id, min(ts) followed_at from events group by 1, 2")
def q66_earliest_follow(spark, d):
    e = _read(spark, d, "events").select("user_id", F.col("event_type").alias("series_id"), F.col("ts").alias("followed_at"))
    return library.merge(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "series_id"], F.col("followed_at"), ["followed_at"], earliest=True)


@query("""select c_custkey, case c_custkey % 4 when 0 then 'Cover is blue.' when 1 then 'Plain ' || c_custkey || '.' else null end note from customer""")
def q67_reader_note(spark, d):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "Judged by Robo; cover is blue.").when(k == 1, F.concat(F.lit(" Plain "), F.col("c_custkey").cast("string"), F.lit(". "))).when(k == 2, "One. Two by robo").otherwise("Robo.")
    return _read(spark, d, "customer").select("c_custkey", reader.reader_note(raw, ("robo",)).alias("note"))


@query("""select p_partkey, case when p_size % 4 = 0 then null when p_size % 4 = 1 then [] when p_size % 4 = 2 then ['Dungeons'] else ['Dungeons', 'Crafting'] end mechanics from part""")
def q68_shared_mechanics(spark, d):
    k = F.col("p_size") % 4
    tags = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    have = F.when(k == 1, tags("cozy")).when(k == 2, tags("dungeon", "stats")).when(k == 3, tags("base-building", "dungeon", "comedy", "crafting"))
    seed = tags("dungeon", "crafting", "stats", "comedy")
    found = recommend.shared_mechanics(seed, have, {"humor": 0.0}, tags("stats"))
    return _read(spark, d, "part").select("p_partkey", F.when(have.isNotNull(), found).alias("mechanics"))


@query("select o_orderkey, case when n = 0 then 0 else cast(round(100.0 * k / n) as int) end percent from (select o_orderkey, count(l_orderkey) n, count(*) filter (where l_returnflag = 'R') k from orders left join lineitem on o_orderkey = l_orderkey group by 1)")
def q69_percent_read(spark, d):
    met = _read(spark, d, "orders").select("o_orderkey").join(_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    c = met.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return c.select("o_orderkey", library.percent_read(F.col("k"), F.col("n")).alias("percent"))


from . import adapted_queries as _adapted  # noqa: E402  registers its queries too
from . import store_queries as _stores  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "_adapted", "_stores"]
