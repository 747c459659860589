"""Catalogue tables, search and ETL: every operator takes frames and returns a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import aggregates as A


def string_agg(name: str) -> Column:
    """Distinct names, sorted and joined by bars."""
    return F.array_join(F.array_sort(F.collect_set(name)), "|")


def wide_catalogue(items: DataFrame, genres: DataFrame, actors: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per item with its three lists as strings, empty where it has none; each junction is aggregated first."""
    out = items
    for junction, column in ((genres, "genre"), (actors, "actor"), (tags, "tag")):
        lists = junction.groupBy("item_id").agg(string_agg(column).alias(f"{column}s"))
        out = out.drop(f"{column}s").join(lists, "item_id", "left").withColumn(f"{column}s", F.coalesce(f"{column}s", F.lit("")))
    return out


def catalogue_by_ids(wide: DataFrame, ids: list[int], *, cap: int = 100) -> DataFrame:
    return wide.filter(F.col("item_id").isin(*list(dict.fromkeys(ids))[:cap]))


def catalogue_summary(items: DataFrame, genres: DataFrame) -> DataFrame:
    lists = genres.groupBy("item_id").agg(string_agg("genre").alias("genre_list"))
    return items.join(lists, "item_id", "left").select("item_id", "title", F.coalesce("genre_list", F.lit("")).alias("genre_list"), "popularity", "release_date")


def search(wide: DataFrame, *, text: str | None = None, genre: str | None = None, year: str | None = None, status: str | None = None, today: str = "2024-01-01", limit: int = 20) -> DataFrame:
    """Items whose title, director or lists contain the text, and that pass the other filters, most popular first."""
    found = wide
    if text:
        hit = F.lit(False)
        for c in ("title", "director", "genres", "actors", "tags"):
            hit = hit | F.coalesce(S.contains_text(F.col(c), text), F.lit(False))
        found = found.filter(hit)
    if genre:
        found = found.filter(F.exists(F.split("genres", r"\|"), lambda g: S.contains_text(g, genre)))
    if year:
        found = found.filter(S.year_bucket(F.col("release_date"), year))
    if status:
        found = found.filter(S.status(F.col("release_date"), status, today))
    return found.orderBy(F.desc("popularity"), "item_id").limit(limit)


def search_ids(items: DataFrame, genres: DataFrame, actors: DataFrame, tags: DataFrame, *, text: str | None = None, genre: str | None = None, year: str | None = None, status: str | None = None, today: str = "2024-01-01", limit: int = 20) -> DataFrame:
    """(item_id, popularity) of what `search` finds, by the narrow tables: no list is put together for an item that isn't shown.

    The text lies within one name, so a bar, which only joined lists have, matches nothing in a list.
    """
    found = items
    if text:
        own = F.coalesce(S.contains_text(F.col("title"), text), F.lit(False)) | F.coalesce(S.contains_text(F.col("director"), text), F.lit(False))
        listed = None
        for junction, column in ((genres, "genre"), (actors, "actor"), (tags, "tag")):
            hits = junction.filter(S.contains_text(F.col(column), text)).select("item_id")
            listed = hits if listed is None else listed.unionByName(hits)
        found = found.join(listed.distinct().withColumn("_listed", F.lit(True)), "item_id", "left").filter(own | F.col("_listed").isNotNull())
    if genre:
        found = found.join(genres.filter(S.contains_text(F.col("genre"), genre)).select("item_id").distinct(), "item_id", "left_semi")
    if year:
        found = found.filter(S.year_bucket(F.col("release_date"), year))
    if status:
        found = found.filter(S.status(F.col("release_date"), status, today))
    return found.select("item_id", "popularity").orderBy(F.desc("popularity"), "item_id").limit(limit)


def shown(wide: DataFrame, ids: DataFrame) -> DataFrame:
    """The wide rows of a page of ids in the page's order; the page goes to the driver, so that its ids are literals in every scan."""
    page = [r["item_id"] for r in ids.select("item_id").collect()]  # at most a page's limit
    return wide.filter(F.col("item_id").isin(*page)).orderBy(F.desc("popularity"), "item_id")


GRAM = 3


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_search_index(items: DataFrame, genres: DataFrame, actors: DataFrame, tags: DataFrame, path: str, *, buckets: int = 32) -> None:
    """An index of all names in lower case: `grams` (gram, name) tells which names hold a run of three characters, `holders` (name, item_id, popularity) whose names they are.

    Both lie in folders by the hash of what they are asked for, and in its order within a file; their number is part of the tables'
    names, so that an index asked with another number isn't found instead of read wrongly. Null names are in no index.
    """
    spark = items.sparkSession
    named = [items.select("item_id", "title"), items.select("item_id", "director"), *(j.select("item_id", c) for j, c in ((genres, "genre"), (actors, "actor"), (tags, "tag")))]
    rows = None
    for n in named:
        n = n.toDF("item_id", "name").select("item_id", F.lower("name").alias("name"))
        rows = n if rows is None else rows.unionByName(n)
    holders = rows.filter("name is not null").distinct().join(items.select("item_id", "popularity"), "item_id").select("name", "item_id", "popularity", _bucket(F.col("name"), buckets).alias("bucket"))
    holders.hint("rebalance", "bucket").sortWithinPartitions("bucket", "name").write.partitionBy("bucket").parquet(f"{path}/holders-{buckets}")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (GRAM - 1)), lambda at: F.substr("name", at, F.lit(GRAM))))
    names = spark.read.parquet(f"{path}/holders-{buckets}").select("name").distinct().filter(F.length("name") >= GRAM)
    grams = names.select(F.explode(runs).alias("gram"), "name").withColumn("bucket", _bucket(F.col("gram"), buckets))
    grams.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams-{buckets}")


def names_with(spark: SparkSession, path: str, text: str, *, buckets: int = 32) -> DataFrame:
    """(name): the indexed names that hold the text. Only the folders of its own runs are read; a text too short for a run reads the names."""
    text = text.lower()
    if len(text) < GRAM:
        names = spark.read.parquet(f"{path}/holders-{buckets}").select("name").distinct()
    else:
        runs = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        asked = F.lit(False)
        for run in runs:
            asked = asked | ((F.col("bucket") == _bucket(F.lit(run), buckets)) & (F.col("gram") == run))
        names = spark.read.parquet(f"{path}/grams-{buckets}").filter(asked).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") == len(runs)).select("name")
    return names.filter(F.contains("name", F.lit(text)))


def search_index(spark: SparkSession, path: str, text: str, *, limit: int = 20, buckets: int = 32) -> DataFrame:
    """(item_id, popularity) as `search_ids` finds them for a text, from the index alone."""
    names = names_with(spark, path, text, buckets=buckets).withColumn("bucket", _bucket(F.col("name"), buckets))
    holders = spark.read.parquet(f"{path}/holders-{buckets}").join(names, ["bucket", "name"])
    return holders.select("item_id", "popularity").distinct().orderBy(F.desc("popularity"), "item_id").limit(limit)


def _some(column: str, needle: str) -> Column:
    return F.exists(F.split(column, r"\|"), lambda x: S.contains_text(x, needle))


def filter_catalogue(wide: DataFrame, *, title: str | None = None, director: str | None = None, actors: list[str] = (), genres: list[str] = (), year: str | None = None, min_rating: float | None = None, keywords: list[str] = (), limit: int = 30) -> DataFrame:
    """Every wanted value must match some element of its list; ordered before the limit."""
    found = wide
    for column, wanted in (("title", title), ("director", director)):
        if wanted:
            found = found.filter(S.contains_text(F.col(column), wanted))
    for column, values in (("actors", actors), ("genres", genres), ("tags", keywords)):
        for v in values:
            found = found.filter(_some(column, v))
    if year:
        found = found.filter(S.year_bucket(F.col("release_date"), year))
    if min_rating is not None:
        found = found.filter(F.col("vote_average") >= min_rating)
    return found.orderBy(F.desc("popularity"), "item_id").limit(limit)


def by_genre(items: DataFrame, pattern: str, *, page: int = 1, limit: int = 20) -> DataFrame:
    """Items with a matching genre, all their genres listed."""
    hit = F.exists(F.split("genres", r"\|"), lambda g: S.contains_text(g, pattern))
    return items.filter(hit).orderBy(F.desc("popularity"), "item_id").offset((page - 1) * limit).limit(limit)


def page_of(items: DataFrame, *, order: str = "popularity", page: int = 1, limit: int = 20) -> DataFrame:
    """One page by a column, largest first."""
    return items.orderBy(F.desc_nulls_last(order), "item_id").offset((page - 1) * limit).limit(limit)


def page_after(items: DataFrame, popularity: float, item_id: int, *, limit: int = 20) -> DataFrame:
    """The rows after a cursor in descending (popularity, item_id), each with the cursor of the page after it."""
    p, i = F.col("popularity"), F.col("item_id")
    rows = items.filter((p < popularity) | ((p == popularity) & (i < item_id))).orderBy(F.desc("popularity"), F.desc("item_id")).limit(limit + 1)
    # at most limit + 1 rows
    whole = Window.orderBy(F.desc("popularity"), F.desc("item_id"))
    rows = rows.withColumn("_rn", F.row_number().over(whole)).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    last = (F.col("_rn") == limit) & (F.col("_n") > limit)
    return rows.withColumn("next_cursor", F.when(last, S.keyset_encode(p, i))).filter(F.col("_rn") <= limit).drop("_rn", "_n")


def explode_genres(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.explode(F.split("genres", r"\|")).alias("genre"))


def build_dimension(values: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed names with ids from 1 by name order, numbered within ranges of names."""
    names = values.select(F.trim(column).alias("name")).filter("name <> ''")
    return A.dense_ids(names, "name").select((F.col("idx") + 1).alias("id"), "name")


def build_items(flat: DataFrame, directors: DataFrame) -> DataFrame:
    """Star-schema items: defaults filled, director by id, first row per id wins."""
    first = Window.partitionBy("item_id").orderBy("title", "director")
    rows = flat.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    named = directors.select(F.col("id").alias("director_id"), F.col("name").alias("_director"))
    rows = rows.join(named, F.trim("director") == F.col("_director"), "left").drop("_director", "director")
    return rows.fillna({"popularity": 0.0, "release_date": "", "title": ""})


def build_junction(flat: DataFrame, dimension: DataFrame, column: str, *, ordered: bool = False) -> DataFrame:
    """(item_id, id[, cast_order]) pairs once each; with an order, the first position of a name counts."""
    places = flat.select("item_id", F.posexplode(F.split(column, r"\|")).alias("pos", "_raw")).select("item_id", "pos", F.trim("_raw").alias("name"))
    pairs = first_occurrence(places.filter("name <> ''"))
    out = pairs.join(dimension, "name").select("item_id", "id", F.col("pos").cast("long").alias("cast_order"))
    return out if ordered else out.select("item_id", "id").dropDuplicates()


def first_occurrence(places: DataFrame) -> DataFrame:
    """The first position of each name in its item."""
    return places.groupBy("item_id", "name").agg(F.min("pos").alias("pos"))


def flatten_catalogue(items: DataFrame, genres: DataFrame, actors: DataFrame) -> DataFrame:
    """Star back to flat: genres by name, cast in cast_order, placeholders where something is missing."""
    g = genres.groupBy("item_id").agg(string_agg("genre").alias("genres"))
    cast = F.transform(F.array_sort(F.collect_list(F.struct("cast_order", "actor"))), lambda s: s["actor"])
    a = actors.groupBy("item_id").agg(F.array_join(cast, "|").alias("cast"))
    rows = items.select("item_id", "title", "director", "release_date").join(g, "item_id", "left").join(a, "item_id", "left")
    return rows.select("item_id", "title", F.coalesce("genres", F.lit("(no genres listed)")).alias("genres"), F.coalesce("director", F.lit("<unknown>")).alias("director"), F.coalesce("release_date", F.lit("")).alias("release_date"), F.coalesce("cast", F.lit("")).alias("cast"))


def latest_wins(log: DataFrame, *, keys: tuple[str, ...] = ("user_id", "item_id"), ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest row per key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ts), *[F.desc(t) for t in tie])
    return log.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def toggle_state(toggles: DataFrame) -> DataFrame:
    """(user_id, item_id, ts) of pairs whose toggles are odd in number; ts of the last one."""
    return toggles.groupBy("user_id", "item_id").agg(F.count("*").alias("_n"), F.max("ts").alias("ts")).filter("_n % 2 = 1").drop("_n")


def preferences(log: DataFrame) -> DataFrame:
    """Newest (genres, item_ids) texts per user as lists."""
    rows = latest_wins(log, keys=("user_id",))
    ids = F.filter(F.transform(F.split("item_ids", ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())
    return rows.select("user_id", F.filter(F.split("genres", r"\|"), lambda x: x != "").alias("genres"), ids.alias("item_ids"))


def thread_view(comments: DataFrame, *, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of top-level comments, newest first, each with its replies, oldest first."""
    tops = comments.filter("parent_id is null").orderBy(F.desc("comment_id")).offset((page - 1) * limit).limit(limit)
    replies = comments.filter("parent_id is not null").select(F.col("parent_id").alias("_p"), F.col("comment_id").alias("reply_id"), F.col("content").alias("reply"))
    lists = replies.join(tops.select(F.col("comment_id").alias("_p")), "_p", "left_semi").groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("reply_id", "reply"))), lambda s: s["reply_id"]).alias("reply_ids"))
    return tops.join(lists, tops["comment_id"] == lists["_p"], "left").drop("_p")


def comments_with_likes(comments: DataFrame, users: DataFrame, likes: DataFrame, *, viewer: int) -> DataFrame:
    """Comments with author, number of likes, and whether the viewer likes them; likes are counted before the join."""
    counts = likes.groupBy("comment_id").agg(F.count("*").alias("like_count"), F.max((F.col("user_id") == viewer).cast("int")).alias("_mine"))
    rows = comments.join(users, "user_id").join(counts, "comment_id", "left")
    return rows.withColumn("like_count", F.coalesce("like_count", F.lit(0)).cast("long")).withColumn("liked_by_viewer", F.coalesce(F.col("_mine") == 1, F.lit(False))).drop("_mine")


def refine_slate(slates: DataFrame, *, exclude: list[str] = (), want: str | None = None, min_rating: float | None = None, newer_than: int | None = None, older_than: int | None = None, limit: int = 10) -> DataFrame:
    """Rows (slate_id, item_id, genres, vote_average, year, rank): unwanted genres go; a wanted genre holds unless no row has it."""
    genre_list = F.split("genres", r"\|")
    rows = slates
    for g in exclude:
        rows = rows.filter(~F.array_contains(F.transform(genre_list, F.lower), g.lower()))
    if want:
        hit = F.exists(genre_list, lambda x: F.lower(x) == want.lower())
        rows = rows.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(Window.partitionBy("slate_id"))).filter("_hit or not _any").drop("_hit", "_any")
    if min_rating is not None:
        rows = rows.filter(F.col("vote_average") >= min_rating)
    if newer_than is not None:
        rows = rows.filter(F.col("year") > newer_than)
    if older_than is not None:
        rows = rows.filter(F.col("year") < older_than)
    order = Window.partitionBy("slate_id").orderBy("rank", "item_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def reflect_rerank(slates: DataFrame, liked: DataFrame, *, genres: list[str], n: int = 10) -> DataFrame:
    """Already liked items go where a slate is longer than n; then score by genre overlap, rating and popularity."""
    mine = liked.select("slate_id", "item_id").distinct().withColumn("_liked", F.lit(1))
    rows = slates.join(mine, ["slate_id", "item_id"], "left").withColumn("_n", F.count("*").over(Window.partitionBy("slate_id")))
    rows = rows.filter("_liked is null or _n <= " + str(n))
    overlap = S.genre_overlap(F.split("genres", r"\|"), F.array(*map(F.lit, genres)))
    rows = rows.withColumn("score", 0.5 * overlap + 0.05 * F.col("vote_average") + 0.001 * F.col("popularity"))
    order = Window.partitionBy("slate_id").orderBy(F.desc("score"), "item_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("slate_id", "item_id", "score", "rank")


def next_batch(slate: DataFrame, *, size: int = 5) -> DataFrame:
    return slate.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("long"))


def unique_in_order(rows: DataFrame, column: str, *, cap: int = 50) -> DataFrame:
    return rows.withColumn(column, F.slice(F.array_distinct(column), 1, cap))


def ensure_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, 0 where missing, null or no number."""
    have = {f.name for f in rows.schema}
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, *[(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns])


def matched_first(items: DataFrame, genres: list[str], *, limit: int = 20) -> DataFrame:
    """Items of a preferred genre first, popularity order kept within both parts."""
    hit = S.genre_overlap(F.split("genres", r"\|"), F.array(*map(F.lit, genres))) > 0
    return items.withColumn("matched", hit).orderBy(F.desc("matched"), F.desc("popularity"), "item_id").limit(limit)


def cold_start(items: DataFrame, genres: list[str], *, limit: int = 20) -> DataFrame:
    """The most popular 3 x limit items, those of a preferred genre first."""
    pool = items.orderBy(F.desc("popularity"), "item_id").limit(3 * limit)
    return matched_first(pool, genres, limit=limit)
