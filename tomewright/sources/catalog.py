"""Readers and writers: catalog snapshots, yearly files, health snapshots, libraries, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import LOG_TAIL, MAX_BODY, MAX_IMPORT
from ..functions import signals
from .tails import TailSource


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books, series) of a catalog file: one JSON document of version 1 or 2; the scan order becomes ``ordinal``.

    A document of another version, or without a list of books, gives no rows; ``catalog_problem`` tells which.
    """
    return _catalog(_document(spark, path, _catalog_ddl()))


def parse_catalog(rows: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """(books, series) of catalog documents that stand in a column of text."""
    good = rows.select(_once(F.from_json(json, _catalog_ddl()), lambda d: F.when(d["version"].isin(1, 2) & d["books"].isNotNull(), d)).alias("d"))
    return _rows(good, "d.books"), _rows(good, "d.series")


def _catalog_ddl() -> str:
    return f"version int, books array<struct<{_struct(schemas.BOOK)}>>, series array<struct<{_struct(schemas.SERIES)}>>"


def _catalog(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = raw.where("version in (1, 2) and books is not null")
    return _rows(good, "books"), _rows(good, "series")


def catalog_problem(spark: SparkSession, path: str) -> DataFrame:
    raw = _document(spark, path, "version int, books array<struct<id:string>>")
    return raw.select(F.when(F.col("version").isNull() | ~F.col("version").isin(1, 2), "version").when(F.col("books").isNull(), "books").alias("problem")).where("problem is not null")


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def _struct(ddl: str) -> str:
    """The columns of a DDL string as fields of a struct, without the ordinal that reading adds."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(ddl).fields
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields if f.name != "ordinal")


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it names it: Spark would repeat a costly expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rows(raw: DataFrame, name: str) -> DataFrame:
    """The rows of a list; exploded as outer, since otherwise Spark works the list out once more to leave out empty ones."""
    listed = raw.select(F.posexplode_outer(name).alias("ordinal", "r")).where("ordinal is not null")
    return listed.select(F.col("ordinal").cast("long").alias("ordinal"), "r.*")


def read_years(spark: SparkSession, folder: str) -> DataFrame:
    """Books of files named by year, with ``year`` from the name.

    The year comes from the files' metadata, so that a filter on it is decided by names: only files of these years are opened.
    """
    raw = _document(spark, f"{folder}/[0-9][0-9][0-9][0-9].json", f"books array<struct<{_struct(schemas.BOOK)}>>")
    one = raw.select(F.substring("_metadata.file_name", 1, 4).cast("int").alias("year"), F.posexplode("books").alias("ordinal", "r"))
    return one.select("year", F.col("ordinal").cast("long").alias("ordinal"), "r.*")


def write_by_year(books: DataFrame, path: str) -> None:
    """Books as Parquet partitioned by release year, so that a year's query reads that year only."""
    year = F.coalesce(F.substring("releaseDate", 1, 4).try_cast("int"), F.lit(0))
    books.withColumn("year", year).repartition("year").write.partitionBy("year").mode("overwrite").parquet(path)


def read_health(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(head, series, works) of a health snapshot of schema version 1."""
    return _health(_document(spark, path, _health_ddl()))


def parse_health(rows: DataFrame, json: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(head, series, works) of health snapshots that stand in a column of text."""
    good = rows.select(_once(F.from_json(json, _health_ddl()), lambda d: F.when((d["schemaVersion"] == 1) & d["generatedAt"].isNotNull(), d)).alias("d"))
    return good.where("d is not null").select("d.schemaVersion", "d.generatedAt"), _rows(good, "d.series"), _rows(good, "d.works")


def _health_ddl() -> str:
    return f"schemaVersion int, generatedAt string, series array<struct<{_struct(schemas.HEALTH_SERIES)}>>, works array<struct<{_struct(schemas.HEALTH_WORK)}>>"


def _health(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    good = raw.where("schemaVersion = 1 and generatedAt is not null")
    return good.select("schemaVersion", "generatedAt"), _rows(good, "series"), _rows(good, "works")


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, json): one library per row."""
    return spark.read.schema("user_id string, json string").json(path)


def parse_library(json: Column, most: int = MAX_IMPORT) -> Column:
    """A library struct from an export of version 1 or 2, or from a stored record; null beyond the size or if it is neither."""
    books = _books_type()
    empty = F.create_map().cast("map<string,struct<followedAt:string>>")
    made = lambda version, series, books: F.struct(version.alias("version"), series.alias("series"), books.alias("books"))

    def read(text: Column) -> Column:
        # of a version 1 only the second parse reads the library, which is a map of books there
        v1 = _once(F.from_json(text, f"struct<library:{books}>"), lambda d: F.when(d["library"].isNotNull(), made(F.lit(1), empty, d["library"])))
        either = F.from_json(text, f"struct<version:int,library:{schemas.LIBRARY},series:map<string,struct<followedAt:string>>,books:{books}>")
        return _once(either, lambda d: (
            F.when((d["version"] == 2) & d["library"]["series"].isNotNull(), d["library"]).when(d["version"] == 1, v1)
            .when((d["version"] == 2) & d["series"].isNotNull() & d["books"].isNotNull(), made(d["version"], d["series"], d["books"]))
        ))

    return _once(json, lambda text: F.when(F.octet_length(text) <= most, read(text)))


def stored(rows: DataFrame, as_of: str) -> DataFrame:
    """(user_id, library, filters, consent) from a table of stored values (user_id, key, json, seq): the last one of each key.

    A library that does not parse is null, filters keep their defaults where they say nothing, and the unlock of a consent is
    worked out anew from the birth date.
    """
    last = rows.groupBy("user_id").agg(*[F.max_by("json", F.when(F.col("key") == k, F.col("seq"))).alias(k) for k in ("library", "filters", "consent")])
    c = F.from_json("consent", "birthDate string, attestedAt string, allowAdult boolean")
    filters = F.struct(*[v.alias(k) for k, v in signals.parse_filters(F.col("filters")).items()])
    return last.select("user_id", parse_library(F.col("library")).alias("library"), filters.alias("filters"), signals.consent(c["birthDate"], c["attestedAt"], c["allowAdult"], as_of).alias("consent"))


def _books_type() -> str:
    return "map<string,struct<status:string,rating:double,updatedAt:string,work:struct<series:string,number:double>>>"


def body_fits(body: Column, content_type: Column, most: int = MAX_BODY) -> Column:
    """Whether a request body is JSON by its header, not too large, and parses."""
    return F.coalesce(F.lower(content_type).startswith("application/json") & (F.octet_length(body) <= most) & F.try_parse_json(body).isNotNull(), F.lit(False))


def log_tail(spark: SparkSession, path: str, size: int = LOG_TAIL) -> DataFrame:
    """(file, tail): the last bytes of each log, as text. Readers seek, so that no more than that is read of a file of any size.

    ``path`` is a folder, a file or a pattern, in a store that pyarrow can open.
    """
    spark.dataSource.register(TailSource)
    raw = spark.read.format("tails").option("size", str(size)).load(path)
    return raw.select("file", tail_of(F.col("content"), size).alias("tail"))


def tail_of(content: Column, size: int = LOG_TAIL) -> Column:
    """The last bytes of a binary column, as text; of a character that is cut, each byte becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(content, -size, size).cast("string"))


def write_libraries(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
