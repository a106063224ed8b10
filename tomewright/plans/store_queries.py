"""Registered queries of the search index, versioned tables, timers, long histories, ranged tails and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, library, reader
from ..sources import catalog as sources
from ..sources import search_index
from ..storage import Snapshots, scratch
from ..streaming import clocks
from .adapted_queries import _fold_sql, _with_states
from .registry import query, read

#: Words of a benchmark item that are searched for: the two first ones of at least six letters.
WORD = "[A-Za-z]{6,}"


@query(f"""with q as (select item_id, list_transform(w[1:2], lambda x: lower(x)) terms from (select item_id, regexp_extract_all(text, '{WORD}') w from benchmark) where len(w) > 0)
select item_id, conv_id, turn from q join conversations on len(list_filter(terms, lambda t: contains(lower(text), t))) = len(terms)""")
def q111_indexed_search(spark, d):
    """Words of benchmark items, looked up in an index of all turns."""
    turns = read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    path = scratch(spark, "search-index")
    search_index.build_index(turns, path)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, 2)
    asked = read(spark, d, "benchmark").select("item_id", F.array_join(words, " ").alias("query"))
    found = search_index.search_many(spark, path, asked, "item_id")
    return found.select(F.col("query_id").alias("item_id"), "id.conv_id", "id.turn")


@query("select conv_id, role, max(turn) turn, md5(arg_max(coalesce(text, ''), (turn, text))) text_md5 from conversations where conv_id is not null group by 1, 2")
def q112_versioned_upserts(spark, d):
    """Three merges into a versioned table, the last turns not the last to come; what is read is its last version."""
    rows = read(spark, d, "conversations").where("conv_id is not null").select("conv_id", "role", "turn", "text")
    table = Snapshots(spark, scratch(spark, "last-turns"), ["conv_id", "role"], ["turn"])
    for k in (2, 0, 1):
        table.merge(rows.where(F.col("turn") % 3 == k), stream="turns", batch=table.version().number)
    return table.read(rows.schema).select("conv_id", "role", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(_fold_sql())
def q113_fold_long_histories(spark, d):
    """The fold of q44, with histories that are cut into pieces and composed."""
    names = F.array(*[F.lit(a) for a in reader.ACTIONS])
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.get(names, (F.length("text") % 7).cast("int")).alias("action"))
    found = reader.fold_histories(turns, "conv_id", ["turn"], "action")
    return found.withColumn("open", reader.is_open(F.struct(*reader.STATE)))


#: Turns as a stream: a user issues a token, the assistant claims it; a turn comes as many seconds after the one before as its text has characters.
LIFE = 600
TURNS_SQL = """t as (select conv_id, turn, role, n, make_timestamp(cast(1704067200000000 as bigint) + cast(sum(n) over (partition by conv_id order by turn, role, n rows unbounded preceding) as bigint) * 1000000) "at",
row_number() over (partition by conv_id order by turn, role, n) seq from (select conv_id, turn, role, length(text) n from conversations where conv_id is not null and text is not null))"""


def _turns(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "n")
    rows = read(spark, d, "conversations").where("conv_id is not null and text is not null").select("conv_id", "turn", "role", F.char_length("text").alias("n"))
    since = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("conv_id", "role", "n", F.row_number().over(w).alias("seq"), F.timestamp_seconds(since + 1704067200).alias("at"))


def _streamed(spark, rows, operator):
    """What a stream over a table gives that is stopped when all of it is through."""
    _with_states(spark)
    source, out, check = (scratch(spark, f"stream-{x}") for x in ("in", "out", "check"))
    rows.write.parquet(source)
    clocks.run_once(operator(spark.readStream.schema(rows.schema).parquet(source)), out, check)
    return spark.read.parquet(out)


@query(f"""with {TURNS_SQL}, w as (select max("at") mark from t),
e as (select *, lead("at") over (partition by conv_id order by seq) next_at, lead(role) over (partition by conv_id order by seq) next_role, lag(role) over (partition by conv_id order by seq) last_role, lag("at") over (partition by conv_id order by seq) last_at from t)
select cast(conv_id as varchar) token, cast(seq as bigint) seq, epoch_ms("at") + {LIFE} * 1000 millis, 'expired' outcome, cast(n as varchar) payload from e, w where role = 'user' and coalesce(next_at, mark) >= "at" + interval {LIFE} second
union all select cast(conv_id as varchar), cast(seq as bigint), epoch_ms("at"), case when last_role = 'user' and "at" < last_at + interval {LIFE} second then 'claimed' else 'refused' end,
case when last_role = 'user' and "at" < last_at + interval {LIFE} second then (select cast(n as varchar) from t l where l.conv_id = e.conv_id and l.seq = e.seq - 1) end from e where role <> 'user'""")
def q114_expiring_claims(spark, d):
    """A stream of turns: what a user issues is claimed within ten minutes, refused later, or expires by a timer."""
    events = _turns(spark, d).select(F.col("conv_id").cast("string").alias("token"), F.col("seq").cast("long").alias("seq"), F.when(F.col("role") == "user", "issue").otherwise("claim").alias("kind"), F.col("n").cast("string").alias("payload"), "at")
    found = _streamed(spark, events, lambda s: clocks.expiring_claims(s, LIFE))
    return found.select("token", "seq", F.unix_millis("at").alias("millis"), "outcome", "payload")


TICKS = (60, 600, 1800)


@query(f"""with {TURNS_SQL}, c as (select *, "at" + interval 1 second * (n % 120) since, "at" + interval 1 second * n until from t),
k as (select unnest([{', '.join(map(str, TICKS))}]) tick), m as (select tick, to_timestamp(1704067200 + tick)::timestamp now from k),
l as (select conv_id, tick, arg_max(role <> 'user' or n % 2 = 0, "at") good, arg_max(since, "at") since, arg_max(until, "at") until, any_value(now) now from c join m on "at" <= now group by 1, 2)
select cast(conv_id as varchar) series_id, tick::int tick, good and since <= now and now < until as current from l where (select max("at") from t) >= now""")
def q115_freshness_by_timers(spark, d):
    """Coverage that each turn renews, as a stream of changes; its state at some instants."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = lambda n: F.timestamp_seconds(F.unix_seconds("at") + n)
    good = (F.col("role") != "user") | (F.col("n") % 2 == 0)
    rows = _turns(spark, d).where("n > 0").select(
        F.col("conv_id").cast("string").alias("series_id"),
        F.struct(F.when(good, "verified").otherwise("unknown").alias("status"), F.lit(True).alias("current"), stamp(later(F.col("n") % 120)).alias("assessedAt"), stamp(later(F.col("n"))).alias("validUntil")).alias("coverage"), "at",
    )
    changes = _streamed(spark, rows, clocks.freshness)
    mark = rows.agg(F.max(F.unix_seconds("at")).alias("mark"))
    parts = [clocks.state_at(changes, "series_id", "current", F.timestamp_seconds(F.lit(1704067200 + t))).withColumn("tick", F.lit(t)) for t in TICKS]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.join(F.broadcast(mark), F.col("mark") >= F.col("tick") + 1704067200).select("series_id", "tick", "current")  # one row


TAIL = 4096


@query(f"""with l as (select role, string_agg(cast(conv_id as varchar) || ' ' || turn || ' ' || regexp_replace(text, '[^a-z]+', ' ', 'g') || chr(10), '' order by conv_id, turn, text) body from conversations where role is not null and conv_id is not null and turn is not null and text is not null group by 1)
select role, length(body)::bigint length, right(body, {TAIL}) tail from l""")
def q116_log_tails(spark, d):
    """A log file for each role, written by Spark, of which only the end is read."""
    rows = read(spark, d, "conversations").where("role is not null and conv_id is not null and turn is not null and text is not null")
    line = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.regexp_replace("text", "[^a-z]+", " "))
    path = scratch(spark, "logs")
    rows.select("role", "conv_id", "turn", "text", line.alias("value")).repartition("role").sortWithinPartitions("role", "conv_id", "turn", "text").select("role", "value").write.partitionBy("role").text(path)
    ends = sources.log_tail(spark, path, TAIL)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "role=([^/]*)/", 1).alias("role"), "length")
    return ends.select(F.regexp_extract("file", "role=([^/]*)/", 1).alias("role"), "tail").join(sizes, "role").select("role", "length", "tail")


#: Sources name nothing, documents their source, labels and vectors their document.
CORPUS_REFERENCES = (("documents", "source", "sources", "source"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id"))


@query("""with gone as (select doc_id from documents where source in ('src1', 'src2'))
select 'sources' "table", count(distinct source) n, 0::bigint ids from documents where source is not null and source not in ('src1', 'src2')
union all select 'documents', count(*), cast(coalesce(sum(doc_id), 0) as bigint) from documents where source is null or source not in ('src1', 'src2')
union all select 'labels', count(*), cast(coalesce(sum(doc_id), 0) as bigint) from labels where doc_id not in (select doc_id from gone)
union all select 'embeddings', count(*), cast(coalesce(sum(vec_id), 0) as bigint) from embeddings where vec_id not in (select doc_id from gone)""")
def q118_delete_cascade(spark, d):
    """Two sources deleted with their documents, and with those their labels and vectors."""
    documents = read(spark, d, "documents").select("doc_id", "source")
    tables = {"documents": documents, "sources": documents.select("source").where("source is not null").distinct(), "labels": read(spark, d, "labels"), "embeddings": read(spark, d, "embeddings").select("vec_id")}
    left = accounts.delete_cascade(tables, "sources", F.col("source").isin("src1", "src2"), CORPUS_REFERENCES)
    shown = {"sources": F.lit(0), "documents": F.col("doc_id"), "labels": F.col("doc_id"), "embeddings": F.col("vec_id")}
    parts = [left[t].agg(F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("ids")).select(F.lit(t).alias("table"), "n", "ids") for t, c in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""with o as (select cast(o_custkey as varchar) user_id, o_orderpriority series_id, o_orderstatus s, strftime(o_orderdate, '%Y-%m-%d') "at" from orders where o_custkey is not null and o_orderpriority is not null and o_orderdate is not null),
h as (select user_id, series_id, min("at") followed_at from o where s = 'P' group by 1, 2),
u as (select *, max("at") filter (where s = 'F') over (partition by user_id, series_id) un from o where s in ('O', 'F')),
e as (select user_id, series_id, min("at") filter (where s = 'O' and (un is null or "at" >= un)) since, bool_or(s = 'F') dropped from u group by 1, 2)
select user_id, series_id, case when dropped then since else coalesce(followed_at, since) end followed_at from h full join e using (user_id, series_id) where case when dropped then since else coalesce(followed_at, since) end is not null""")
def q119_follow_changes(spark, d):
    """Open orders follow a priority, finished ones unfollow it, pending ones are what was followed before."""
    rows = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("series_id"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    have = rows.where("o_orderstatus = 'P' and user_id is not null and series_id is not null and at is not null").select("user_id", "series_id", F.col("at").alias("followed_at"))
    edits = rows.where("o_orderstatus in ('O', 'F')").select("user_id", "series_id", (F.col("o_orderstatus") == "O").alias("follow"), "at")
    return library.change_follows(have, edits)
