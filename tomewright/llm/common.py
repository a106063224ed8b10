"""Helpers shared by the corpus operators: intermediate tables, Arrow columns and word splitting."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if the session names no shared folder (single-machine use and tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tomewright"

#: Bits that tell which rows may have a partner: 4 MB of them at most, whatever the number of rows.
MARKS = 1 << 25

#: Most characters of text that one output batch of a Python operator is built from.
BATCH_CHARS = 2_000_000
#: Rows and bytes that go to a Python worker at a time, so that neither side holds more of a partition than this.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on one machine a local one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or LOCAL_CHECKPOINTS).rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, not a recomputation, and a table used twice is
    computed once. ``clear_intermediates`` removes these tables.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_intermediates(spark: SparkSession) -> None:
    """Remove what ``materialize`` has written in this application; results that were not stored yet need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def set_aside(rows: DataFrame, key: list[str], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(some, rest) of ``rows``: none of ``rest`` has its key in ``wanted`` (the columns of the key, of equal types).

    ``wanted`` is read once, into a bit for each hash of a key; the bits, ``MARKS`` at most, go to all rows. So where few
    rows have a partner the others need no shuffle, and what decides is still the join of ``some`` that follows. With very
    many keys all bits are set, and all rows are in ``some``.
    """
    group, bits = fresh(rows, "__group", "__bits")
    slot = F.pmod(F.xxhash64(*key), F.lit(MARKS)) + 1
    marks = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(group)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(bits))
    met = rows.withColumn(group, F.bitmap_bucket_number(slot)).join(F.broadcast(marks), group, "left")  # MARKS / 32768 rows of 4 KB at most
    at = F.bitmap_bit_position(slot).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.where(may).drop(group, bits), met.where(~may).drop(group, bits)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded rows and bytes; the bounds are set for the session, lower ones stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = re.fullmatch(r"(-?\d+)([kmg]?)b?", (conf.get(key) or "").lower())
        size = int(now[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[2]] if now else 0
        if size <= 0 or size > most:
            conf.set(key, str(most))
    return df.mapInArrow(function, schema)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def slices(lengths: np.ndarray, most: int = BATCH_CHARS):
    """Consecutive (start, end) row ranges with about ``most`` units in each; a longer row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def text_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
