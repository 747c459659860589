"""Readers and writers of files and tables."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators.retrieval import hash_embed
from slatewise.session import discard, written

log = logging.getLogger(__name__)
RENAMED = {"userid": "user_id", "userId": "user_id", "movieid": "item_id", "movieId": "item_id", "timestamp": "ts", "tmdbId": "tmdb_id", "imdbId": "imdb_id"}
NO_GENRES = "(no genres listed)"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"').withColumnsRenamed(RENAMED)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, rating, ts) from CSV; what isn't a number becomes null."""
    kinds = {"user_id": "long", "item_id": "long", "rating": "double", "ts": "long"}
    return _csv(spark, path).select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV: rows whose id is no number go; popularity 1, vote 5 and a placeholder genre where missing."""
    rows = _csv(spark, path).withColumn("item_id", F.col("item_id").try_cast("long")).filter("item_id is not null")
    for c, default in (("popularity", 1.0), ("vote_average", 5.0)):
        rows = rows.withColumn(c, S.safe_float(F.col(c), default) if c in rows.columns else F.lit(default))
    return rows.withColumn("genres", F.coalesce(F.nullif("genres", F.lit("")), F.lit(NO_GENRES)))


def read_catalogue_jdbc(spark: SparkSession, url: str, table: str, *, properties: dict[str, str] | None = None, column: str = "item_id", bounds: tuple[int, int] = (0, 1_000_000), parts: int = 16, fallback: list[str] = ()) -> DataFrame:
    """Catalogue from a database in ranges of ids, else from the first readable file; refused without genres unless it has just three columns.

    Only an error of the connection or its driver leads to the files, and it is logged; with no file that can be read it is raised.
    """
    try:
        rows = spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties or {})
        rows.schema
    except Py4JJavaError as e:
        log.warning("the catalogue's database can't be read: %s", e.java_exception)
        rows = None
        for path in fallback:
            try:
                rows = read_catalogue(spark, path)
                break
            except AnalysisException as missing:
                log.warning("%s can't be read: %s", path, missing)
        if rows is None:
            raise
    if "genres" not in rows.columns and len(rows.columns) != 3:
        raise ValueError("a catalogue needs genres")
    return rows


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).select(F.col("item_id").try_cast("long").alias("item_id"), F.col("tmdb_id").try_cast("double").cast("long").alias("tmdb_id"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).select(F.col("user_id").try_cast("long").alias("user_id"), F.col("item_id").try_cast("long").alias("item_id"), "tag", F.col("ts").try_cast("long").alias("ts"))


def read_click_log(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path)
    return rows.withColumn("ts", F.unix_timestamp(F.try_to_timestamp("ts"))).withColumn("user_id", F.col("user_id").try_cast("long")).withColumn("item_id", F.col("item_id").try_cast("long"))


def write_split(train: DataFrame, clicks: DataFrame, test: DataFrame, path: str) -> None:
    """Training rows, clicks, the truth per user, and the set of items each user met."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    clicks.write.mode("overwrite").parquet(f"{path}/clicks")
    test.groupBy("user_id").agg(F.collect_list("item_id").alias("truth")).write.mode("overwrite").parquet(f"{path}/truth")
    met = train.select("user_id", "item_id").unionByName(clicks.select("user_id", "item_id"))
    met.groupBy("user_id").agg(F.collect_set("item_id").alias("items")).write.mode("overwrite").parquet(f"{path}/interacted")


def similarity_lists(similar: DataFrame, items: DataFrame, *, snapshot: str, days: int = 7, k: int = 20) -> DataFrame:
    """Item, its top list in order, title and genres, with the snapshot's day and an expiry."""
    lists = similar.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"]).alias("similar"))
    rows = lists.join(items.select(F.col("item_id").alias("query_id"), "title", "genres"), "query_id")
    return rows.select(F.col("query_id").alias("item_id"), "similar", "title", "genres", F.lit(snapshot).alias("snapshot"), F.date_add(F.lit(snapshot).cast("date"), days).alias("expires_at"))


def export_similarities(lists: DataFrame, path: str) -> None:
    lists.write.mode("append").partitionBy("snapshot").parquet(path)


def upsert_vectors(stored: DataFrame, new: DataFrame, *, size: int | None = None) -> DataFrame:
    """Stored vectors with the new ones over them; rows of another length than the stored ones (or than `size`) are an error when the result is computed.

    A null vector is such an error too; of an id's repeated new vectors the greatest stays.
    """
    if size is None:
        checked = new.crossJoin(F.broadcast(stored.agg(F.max(F.size("vec")).alias("_size"))))  # one row
    else:
        checked = new.withColumn("_size", F.lit(size))
    fits = F.col("_size").isNull() | (F.size("vec") == F.col("_size"))
    checked = checked.withColumn("vec", F.when(fits, F.col("vec")).otherwise(F.raise_error(F.lit("vector size differs")).cast("array<double>"))).drop("_size")
    both = stored.withColumn("_new", F.lit(0)).unionByName(checked.withColumn("_new", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("_new"), F.desc("vec")))).filter("_k = 1").drop("_k", "_new")


def backfill_vectors(items: DataFrame, path: str, *, size: int = 384, limit: int | None = None, buckets: int = 64) -> None:
    """Encode the texts of the catalogue (item_id, text), or of its first `limit` ids, and put the vectors over those stored at `path`.

    A text without a word has the zero vector. See `write_vectors` for what is rewritten and what a lost job leaves.
    """
    chosen = items if limit is None else items.orderBy("item_id").limit(limit)
    parts = hash_embed(chosen, size=size).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "x"))).alias("_m"))
    # told to shuffle, and filled with zeros behind the join: by the size of the catalogue's file the planner would broadcast all vectors
    rows = chosen.select("item_id").join(parts.hint("merge"), "item_id", "left")
    new = rows.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0))).alias("vec"))
    write_vectors(new, path, buckets=buckets)


def write_vectors(new: DataFrame, path: str, *, buckets: int = 64) -> int:
    """Put the vectors (item_id, vec) over those stored at `path` and return the version that holds them.

    Ids lie in buckets, whose number the first version fixes. A version is a manifest, `path/manifest=n`, that names for each
    bucket the version whose files hold it: only buckets with new ids are read and written again, under `path/data=n`, the others
    keep their files. The manifest comes last, so readers see whole versions and a job that dies leaves the old one. A vector of
    another size than the stored ones fails the write. No new row, no new version. One job writes at a time.
    """
    spark = new.sparkSession
    held, version = _manifest(spark, path)
    buckets = held[0]["buckets"] if held else buckets
    rows = written(new.select(F.col("item_id").cast("long").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(buckets)).cast("int").alias("bucket")), "new-vectors")
    touched = {r["bucket"]: r["size"] for r in rows.groupBy("bucket").agg(F.max(F.size("vec")).alias("size")).collect()}  # a row a bucket
    if not touched:
        discard(rows)
        return version
    size = held[0]["size"] if held else max(n or 0 for n in touched.values())
    where = {r["bucket"]: r["version"] for r in held}
    old = _bucket_rows(spark, path, {b: where[b] for b in touched if b in where}).withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int"))
    merged = upsert_vectors(old, rows, size=size)
    merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data={version + 1}")
    lines = [(b, v, buckets, size) for b, v in sorted((where | dict.fromkeys(touched, version + 1)).items())]
    spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={version + 1}")
    discard(rows)
    return version + 1


def stored_vectors(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The latest whole version of the vectors at `path` and its number; none and 0 where nothing is stored."""
    held, version = _manifest(spark, path)
    return (_bucket_rows(spark, path, {r["bucket"]: r["version"] for r in held}) if held else None), version


#: Lines of a manifest of stored vectors, at most one a bucket.
MANIFEST = "bucket int, version int, buckets int, size int"


def _manifest(spark: SparkSession, path: str) -> tuple[list[Row], int]:
    version = max((int(f.rsplit("=", 1)[1]) for f in whole_folders(spark, path, "manifest=*")), default=0)
    return (spark.read.schema(MANIFEST).parquet(f"{path}/manifest={version}").collect() if version else []), version


def _bucket_rows(spark: SparkSession, path: str, where: dict[int, int]) -> DataFrame:
    schema = "item_id long, vec array<double>"
    folders = [f"{path}/data={v}/bucket={b}" for b, v in sorted(where.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def whole_folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Folders below `path` that meet the pattern and whose write has ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, f"{pattern}/_SUCCESS")) or []
    return [f.getPath().getParent().toString() for f in marks]


def materialize_features(rows: DataFrame, *, key: str, start: int, end: int, ts: str = "ts") -> DataFrame:
    """The latest row per entity with a time within [start, end)."""
    inside = rows.filter(F.col(ts).between(start, end - 1))
    others = [F.desc(c) for c in rows.columns if c not in (key, ts)]
    return inside.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), *others))).filter("_k = 1").drop("_k")


def lookup_features(asked: DataFrame, features: DataFrame, defaults: dict[str, float], *, key: str, now: int, ttl_days: int = 365, ts: str = "ts") -> DataFrame:
    """Features of the ids asked for, defaults where unknown or older than their time to live."""
    fresh = features.filter(F.col(ts) >= now - ttl_days * 86_400)
    return asked.join(fresh, key, "left").select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(float(v))).alias(c) for c, v in defaults.items()])
