"""A search index: posting lists of character grams, in folders by gram, and the texts, in folders by block."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import matches_all, terms_of

#: Characters of a gram. Terms that are shorter are looked up as they stand, so shorter grams are posted too.
SIZE = 3
#: Folders by a hash of the gram, and of the texts by a hash of the block; characters of text in a block.
GRAM_FOLDERS, TEXT_FOLDERS, CHARS = 32, 64, 1_000_000
#: Posting lists that are intersected for one query: the shortest ones. The texts decide on what is left.
LISTS = 4


def _placed(batches):
    """Rows (id, text) with a block, ``CHARS`` characters at most, and the place in it."""
    block, place, chars = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        blocks, places = [], []
        for n in pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist():
            if place and chars + n > CHARS:
                block, place, chars = block + 1, 0, 0
            blocks.append(block)
            places.append(place)
            place, chars = place + 1, chars + n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], names=["id", "text", "block", "place"])


def _lists(batches):
    """Posting lists (gram, block, places) of rows (block, place, text): places instead of ids, and short lists of many rows, so that little is shuffled."""
    for batch in batches:
        blocks, places, texts = (c.to_pylist() for c in batch.columns)
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            rows: dict[str, list[int]] = defaultdict(list)
            while hi < len(texts) and blocks[hi] == blocks[lo] and (hi == lo or chars + len(texts[hi]) <= CHARS):
                text = texts[hi]
                for gram in {text[k : k + n] for n in range(1, SIZE + 1) for k in range(len(text) - n + 1)}:
                    rows[gram].append(places[hi])
                chars += len(text)
                hi += 1
            ends = np.cumsum([0, *map(len, rows.values())], dtype=np.int32)
            flat = pa.array(list(chain.from_iterable(rows.values())), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([blocks[lo]] * len(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["gram", "block", "places"])
            lo = hi


def term_grams(term: Column) -> Column:
    """The grams that a text has if it has the term: its runs of ``SIZE`` characters, or the whole of a shorter term."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(term) - SIZE + 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(SIZE)))
    return F.array_distinct(runs)


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_FOLDERS)).cast("int")


def _home(block: Column) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(TEXT_FOLDERS)).cast("int")


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The postings, counts or texts of an index."""
    kind = spark.read.parquet(f"{path}/kind").schema["id"].dataType.simpleString()
    schemas = {"postings": "gram string, block long, places array<int>, folder int", "counts": "gram string, n long", "texts": f"id {kind}, text string, block long, place int, home int"}
    return spark.read.schema(schemas[name]).parquet(f"{path}/{name}")


def build_index(rows: DataFrame, path: str, id: str = "id", text: str = "text") -> None:
    """Write the index of ``rows``, whose ids differ, to a folder: lower-case texts by block, postings, and counts of grams.

    A block holds ``CHARS`` characters of text, and each posting list the places of one gram in one block, so that no list
    grows with the table. Postings lie in folders by gram and are sorted by it, so that a lookup opens a few row groups; texts lie in folders by
    block. Null texts are empty: only the empty query finds them.
    """
    low = rows.select(F.col(id).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    low.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")  # tells the type of the ids, even of an empty index
    kind = low.schema["id"].dataType.simpleString()
    texts = low.mapInArrow(_placed, f"id {kind}, text string, block long, place int").withColumn("home", _home(F.col("block")))
    texts.write.mode("overwrite").partitionBy("home").parquet(f"{path}/texts")
    posted = _stored(rows.sparkSession, path, "texts").select("block", "place", "text").mapInArrow(_lists, "gram string, block long, places array<int>").withColumn("folder", _folder(F.col("gram")))
    posted.repartition(GRAM_FOLDERS, "folder").sortWithinPartitions("folder", "gram", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    listed = _stored(rows.sparkSession, path, "postings").groupBy("gram").agg(F.sum(F.size("places")).alias("n"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the records whose text has every term of the query, whatever the case; an empty query finds all.

    The shortest lists among those of the terms' grams are intersected by counting, and the texts of what is left, read from the folders
    that hold any, decide. Nothing else of the texts is read; only grams of the query and numbers of folders come to the driver.
    """
    texts, terms = _stored(spark, path, "texts"), terms_of(query)
    if not terms:
        return texts.select("id")
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.explode(term_grams(F.col("term"))).alias("gram")).distinct()
    known = wanted.join(_stored(spark, path, "counts"), "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"), _folder(F.col("gram")).alias("folder")).orderBy("n", "gram").collect()
    if known[0]["n"] == 0:
        return texts.limit(0).select("id")
    used = known[:LISTS]
    lists = _stored(spark, path, "postings").where(F.col("folder").isin(sorted({r["folder"] for r in used})) & F.col("gram").isin([r["gram"] for r in used]))
    met = lists.select("block", F.explode("places").alias("place")).groupBy("block", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(used)).select("block", "place", _home(F.col("block")).alias("home"))
    if used[0]["n"] < TEXT_FOLDERS:  # too few to be in every folder
        texts = texts.where(F.col("home").isin([r[0] for r in met.select("home").distinct().collect()]))
    found = texts.join(met, ["home", "block", "place"], "left_semi")
    return found.where(matches_all(F.col("text"), query)).select("id")


def search_many(spark: SparkSession, path: str, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, id) for a table of queries, each with terms that are not blank: one join on the lists, one on the texts.

    Each query takes the ``LISTS`` shortest lists among those of its grams; a gram that no text has gives no row. Rows without a
    term are left out, since they would find every record: ask ``search_index`` for those.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.filter(F.split(F.lower(F.col(query)), r"\s+"), lambda t: t != "").alias("terms")).where("size(terms) > 0")
    wanted = asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("terms", term_grams)))).alias("gram"))
    counts = _stored(spark, path, "counts")
    known = wanted.join(counts, "gram", "left").select("query_id", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "gram"))
    used = known.withColumn("rank", rank).where(F.col("rank") <= LISTS).select("query_id", "gram", _folder(F.col("gram")).alias("folder"))
    need = used.groupBy("query_id").agg(F.count("*").alias("need"))
    lists = _stored(spark, path, "postings")
    met = used.join(lists, ["folder", "gram"]).select("query_id", "block", F.explode("places").alias("place")).groupBy("query_id", "block", "place").agg(F.count("*").alias("n")).join(need, "query_id").where("n = need")
    texts = _stored(spark, path, "texts")
    near = met.select("query_id", "block", "place", _home(F.col("block")).alias("home")).join(texts, ["home", "block", "place"]).join(asked, "query_id")
    return near.where(F.forall("terms", lambda t: F.col("text").contains(t))).select("query_id", "id")
