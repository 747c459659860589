"""The standard binding: recommendation tables built from the given star schema, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.session import table


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts): newest order line per user and item; ts in unix seconds."""
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rating = F.least(F.lit(5.0), F.greatest(F.lit(0.5), F.ceil(F.col("l_quantity") / 5) * 0.5)).cast("double")
    newest = Window.partitionBy("o_custkey", "l_partkey").orderBy(*[F.desc(c) for c in ("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")])
    rows = lines.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1")
    return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), rating.alias("rating"), F.unix_timestamp("o_orderdate").alias("ts"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, genres, director, popularity, release_date): the flat catalogue."""
    dates = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("release_date"))
    part = table(spark, sf_dir, "part")
    rows = part.join(dates, part["p_partkey"] == dates["l_partkey"], "left")
    return rows.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.concat_ws("|", "p_type", F.replace("p_name", F.lit(" "), F.lit("|"))).alias("genres"), F.col("p_brand").alias("director"), F.col("p_retailprice").alias("popularity"), "release_date")


def item_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, actor, cast_order): suppliers of a part in key order."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    named = pairs.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    order = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey")) - 1
    return named.select(F.col("l_partkey").alias("item_id"), F.col("s_name").alias("actor"), order.cast("long").alias("cast_order"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, item_id, event_type, ts, value, session_id): the event log; ts in unix seconds."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("item_id"), "event_type", F.unix_timestamp("ts").alias("ts"), "value", F.col("user_id").cast("string").alias("session_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(comment_id, item_id, parent_id, role, content, turn): conversation turns as comment threads."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(key.alias("comment_id"), F.col("conv_id").alias("item_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"), "role", F.col("text").alias("content"), "turn")


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, ts): watch-list toggles."""
    return events(spark, sf_dir).filter("event_type = 'signup'").select("user_id", "item_id", "ts")


#: The same tables as named SQL queries; `sql()` puts those that a query names in front of it.
TABLES = {
    "interactions": """SELECT user_id, item_id, rating, ts FROM (
    SELECT o_custkey AS user_id, l_partkey AS item_id,
      CAST(least(5.0, greatest(0.5, ceil(l_quantity / 5) * 0.5)) AS DOUBLE) AS rating, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
      row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_suppkey DESC) AS rn
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE rn = 1""",
    "items": """SELECT p_partkey AS item_id, p_name AS title, p_type || '|' || replace(p_name, ' ', '|') AS genres, p_brand AS director, p_retailprice AS popularity, d.release_date
    FROM part LEFT JOIN (SELECT l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS release_date FROM lineitem GROUP BY 1) d ON p_partkey = l_partkey""",
    "item_actors": """SELECT l_partkey AS item_id, s_name AS actor, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS cast_order
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey""",
    "log": """SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, CAST(user_id AS VARCHAR) AS session_id FROM events""",
    "users": "SELECT c_custkey AS user_id, c_mktsegment AS segment FROM customer",
    "comments": """SELECT conv_id * 1000 + turn AS comment_id, conv_id AS item_id, CASE WHEN turn > 0 THEN conv_id * 1000 END AS parent_id, role, text AS content, turn FROM conversations""",
    "toggles": """SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE event_type = 'signup'""",
    "genre_rows": """SELECT item_id, unnest(string_split(genres, '|')) AS genre FROM items""",
    "last_one": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn FROM interactions) WHERE rn = 1""",
    "train": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn FROM interactions) WHERE rn > 1""",
}
_NEEDS = {"genre_rows": ["items"], "last_one": ["interactions"], "train": ["interactions"]}


def sql(query: str) -> str:
    """The query with the WITH clause of every table it names."""
    names: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in names and f"{name} " in text.replace("\n", " ").replace(")", " ").replace(",", " ") + " ":
                for n in _NEEDS.get(name, []):
                    if n not in names:
                        need(n)
                names.append(name)

    need(query)
    if not names:
        return query
    head = ", ".join(f"{n} AS ({TABLES[n]})" for n in names)
    body = query.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
