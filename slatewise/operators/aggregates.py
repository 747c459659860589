"""Aggregates, splits, windows and set operations over interactions and events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators.quantiles import exact_quantiles
from slatewise.session import shuffle_partitions, written

#: Pairs that one task of `co_rated` sums.
PAIRS = 1_000_000


def item_stats(train: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Popularity, mean and count from the training rows; items without rows get 1, the global mean and 1."""
    stats = train.groupBy("item_id").agg(F.count("*").alias("popularity"), F.avg("rating").alias("vote_average"), F.count("*").alias("vote_count"))
    if items is None:
        return stats
    mean = train.agg(F.avg("rating").alias("_mean"))  # one row
    rows = items.select("item_id").join(stats, "item_id", "left").crossJoin(F.broadcast(mean))
    one = F.lit(1).cast("long")
    return rows.select("item_id", F.coalesce("popularity", one).alias("popularity"), F.coalesce("vote_average", "_mean").alias("vote_average"), F.coalesce("vote_count", one).alias("vote_count"))


def user_profile(ratings: DataFrame, genres: DataFrame, *, liked: float = 3.0) -> DataFrame:
    """log1p of the count, mean less the global mean, and the genres of liked items."""
    mean = ratings.agg(F.avg("rating").alias("_mean"))  # one row
    base = ratings.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("_own")).crossJoin(F.broadcast(mean))
    liked_genres = liked_rows(ratings, threshold=liked).join(genres, "item_id").groupBy("user_id").agg(F.array_sort(F.collect_set("genre")).alias("genre_set"))
    return base.join(liked_genres, "user_id", "left").select("user_id", F.log1p("n").alias("activity"), (F.col("_own") - F.col("_mean")).alias("bias"), F.coalesce("genre_set", F.array().cast("array<string>")).alias("genre_set"))


def mean_vectors(ratings: DataFrame, vectors: DataFrame, *, liked: float = 3.0) -> DataFrame:
    """Mean vector of each user's liked items, component by component: one row a rating and one partial sum a user, no row a component."""
    known = vectors.select("item_id", "vec").filter("size(vec) > 0")
    longest = known.agg(F.max(F.size("vec"))).first()[0] or 0
    means = [F.avg(F.get("vec", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(longest)]
    rows = liked_rows(ratings, threshold=liked).select("user_id", "item_id").join(known, "item_id").groupBy("user_id").agg(F.max(F.size("vec")).alias("_size"), *means)
    return rows.select("user_id", F.slice(F.array(*[f"_{i}" for i in range(longest)]).cast("array<double>"), F.lit(1), F.col("_size")).alias("vec"))


def user_stats(ratings: DataFrame, *, centre: float = 3.5) -> DataFrame:
    return ratings.filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("rating_count"), (F.avg("rating") - centre).alias("bias"))


def user_features(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of ratings, and means of the items' popularity, vote and year."""
    rows = ratings.join(items, "item_id", "left")
    return rows.groupBy("user_id").agg(F.avg("rating").alias("user_mean"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_std"), F.count("*").alias("user_count"), *[F.avg(c).alias(f"mean_{c}") for c in ("popularity", "vote_average", "year")])


def genre_preference(ratings: DataFrame, items: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per genre the mean of (item has it) x rating over all of a user's ratings, in one aggregate."""
    genres = F.split("genres", r"\|")
    return ratings.join(items.select("item_id", "genres"), "item_id").groupBy("user_id").agg(*[F.avg(F.when(F.array_contains(genres, g), F.col("rating")).otherwise(0.0)).alias(f"pref_{g}") for g in vocabulary])


def interaction_weight(events: DataFrame, ratings: DataFrame, *, liked: float = 3.5) -> DataFrame:
    """Summed event weights per pair and rating weights (5 if liked, else 1.5): the larger counts."""
    seen = events.groupBy("user_id", "item_id").agg(F.sum(S.event_weight(F.col("event_type"))).alias("weight"))
    rated = ratings.select("user_id", "item_id", F.when(F.col("rating") >= liked, 5.0).otherwise(1.5).alias("weight"))
    return seen.unionByName(rated).groupBy("user_id", "item_id").agg(F.max("weight").alias("weight"))


def trending_score(events: DataFrame) -> DataFrame:
    return events.groupBy("item_id").agg(F.sum(S.event_weight(F.col("event_type"))).alias("score"))


def funnel(events: DataFrame, stages: tuple[str, ...] = ("view", "click", "signup", "purchase")) -> DataFrame:
    """(stage, n, conversion): counts per stage and the share of the stage before, 0 where that is empty."""
    counts = events.agg(*[F.count_if(F.col("event_type") == s).alias(s) for s in stages])
    rows = [F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("n"), F.lit(None).cast("double").alias("conversion") if i == 0 else F.when(F.col(stages[i - 1]) == 0, 0.0).otherwise(F.col(s) / F.col(stages[i - 1])).alias("conversion")) for i, s in enumerate(stages)]
    return counts.select(F.inline(F.array(*rows)))


def rating_summary(ratings: DataFrame, column: str = "rating") -> DataFrame:
    """n, mean, std, min, quartiles and max of a column as one row; the quartiles are exact."""
    row = ratings.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    quart = exact_quantiles(ratings, column, [0.25, 0.5, 0.75]).select("q")
    row = row.join(F.broadcast(quart), F.lit(True), "left")  # one row each
    return row.select("n", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(f"q{25 * (i + 1)}") for i in range(3)], "max")


def counts_by(rows: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def item_means(ratings: DataFrame, items: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.avg("rating").alias("mean_rating"), F.count("*").alias("n")).join(items.select("item_id", "title"), "item_id")


def items_per_year(items: DataFrame) -> DataFrame:
    """Items per release year; a null year counts those without one."""
    return items.groupBy(F.substring("release_date", 1, 4).try_cast("int").alias("year")).agg(F.count("*").alias("n"))


def genre_rating_stats(ratings: DataFrame, genres: DataFrame) -> DataFrame:
    return ratings.join(genres, "item_id").groupBy("genre").agg(F.avg("rating").alias("mean_rating"), F.count("*").alias("n"))


def top_counts(rows: DataFrame, key: str, *, n: int = 20) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def ratings_by_year(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(F.year(F.timestamp_seconds("ts")).alias("year")).agg(F.count("*").alias("n"), F.avg("rating").alias("mean_rating"))


def sparsity(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items")).withColumn("sparsity", 1 - F.col("n") / (F.col("n_users") * F.col("n_items")))


def null_rates(rows: DataFrame) -> DataFrame:
    """(column_name, null_rate), a row per column, from one pass."""
    rates = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in rows.columns])
    return rates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in rows.columns])))


def infer_preferences(ratings: DataFrame, items: DataFrame, actors: DataFrame, *, favourite: float = 4.5) -> DataFrame:
    """Genres, the most frequent director (ties to the first name) and actors of a user's favourite items."""
    fav = ratings.filter(F.col("rating") >= favourite).join(items, "item_id")
    genres = fav.select("user_id", F.explode(F.split("genres", r"\|")).alias("g")).filter("g <> '(no genres listed)'").groupBy("user_id").agg(F.array_sort(F.collect_set("g")).alias("genre_set"))
    per = fav.filter("director <> '<unknown>'").groupBy("user_id", "director").agg(F.count("*").alias("_n"))
    director = per.groupBy("user_id").agg(F.min_by("director", F.struct(-F.col("_n"), F.col("director"))).alias("director"))
    cast = fav.select("user_id", "item_id").join(actors, "item_id").groupBy("user_id").agg(F.size(F.collect_set("actor")).cast("long").alias("n_actors"))
    return genres.join(director, "user_id", "left").join(cast, "user_id", "left")


def chat_profile(feedback: DataFrame, genres: DataFrame, *, items: int = 200, top: int = 10) -> DataFrame:
    """Per user the newest liked items and the most liked genres, counted over the whole log."""
    newest = last_n(feedback, items)
    liked = newest.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "item_id"))), lambda s: s["item_id"]).alias("item_ids"))
    per = feedback.join(genres, "item_id").groupBy("user_id", "genre").agg(F.count("*").alias("_n"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("_n"), "genre"))
    best = per.withColumn("_k", order).filter(F.col("_k") <= top).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "genre"))), lambda s: s["genre"]).alias("genres"))
    return liked.join(best, "user_id", "left")


def interacted_pairs(*logs: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs of all logs."""
    out = logs[0].select("user_id", "item_id")
    for log in logs[1:]:
        out = out.unionByName(log.select("user_id", "item_id"))
    return out.distinct()


def liked_rows(ratings: DataFrame, *, threshold: float = 4.0) -> DataFrame:
    return ratings.filter(F.col("rating") >= threshold)


def dwell_filter(events: DataFrame, *, least: float = 1500, low: float = 100, high: float = 3_600_000, column: str = "dwell_ms") -> DataFrame:
    """Events whose dwell is within the accepted range and long enough to count."""
    return events.filter(F.col(column).between(low, high) & (F.col(column) >= least))


# ---- splits and windows


def leave_one_out(ratings: DataFrame) -> DataFrame:
    """Rows with `is_test`: the user's last row, ties to the larger item."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id")))
    return ratings.withColumn("is_test", rn == 1)


def time_split(ratings: DataFrame, *, n_test: int = 1, n_val: int = 1, min_ratings: int = 5) -> DataFrame:
    """Rows with `part`: a user's last n are test, those before validation; users with few rows train only."""
    w = Window.partitionBy("user_id")
    rows = ratings.withColumn("_rn", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("item_id")))).withColumn("_n", F.count("*").over(w))
    part = F.when(F.col("_n") < min_ratings, "train").when(F.col("_rn") <= n_test, "test").when(F.col("_rn") <= n_test + n_val, "val").otherwise("train")
    return rows.withColumn("part", part).drop("_rn", "_n")


def last_n(ratings: DataFrame, n: int = 20) -> DataFrame:
    """The newest n rows per user, with their place in _rn."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id")))
    return ratings.withColumn("_rn", rn).filter(F.col("_rn") <= n)


def recency_weighted_vector(history: DataFrame, vectors: DataFrame, *, slope: float = -0.6, n: int = 20) -> DataFrame:
    """Sum of a user's newest vectors under weights exp(linspace(slope, 0)), normalised; oldest first."""
    rows = last_n(history, n).withColumn("_n", F.count("*").over(Window.partitionBy("user_id")))
    place = F.when(F.col("_n") > 1, slope * (F.col("_rn") - 1) / (F.col("_n") - 1)).otherwise(slope if n > 1 else 0.0)
    rows = rows.select("user_id", "item_id", "_rn", F.exp(place).alias("_w")).join(vectors.select("item_id", "vec").filter("size(vec) > 0"), "item_id")
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_rn", "_w", "vec"))).alias("_l"), F.sum("_w").alias("_all"))  # at most n vectors a user
    zero = F.array().cast("array<double>")
    plus = lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    weighed = F.aggregate("_l", zero, lambda s, r: F.zip_with(s, F.transform(r["vec"], lambda x: r["_w"] / F.col("_all") * x), plus))
    plain = F.aggregate("_l", zero, lambda s, r: F.zip_with(s, F.transform(r["vec"], lambda x: x.cast("double")), plus))
    return lists.select("user_id", S.l2_normalize(S.bound(weighed, lambda v: F.when(S.norm(v) > 1e-9, v).otherwise(plain))).alias("vec"))


def min_max(slates: DataFrame, column: str = "score", *, key: str = "slate_id") -> DataFrame:
    """Scores scaled to 0..1 in their slate; equal scores give 1."""
    w = Window.partitionBy(key)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return slates.withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low)))


def top_k(scored: DataFrame, k: int, *, key: str = "user_id", score: str = "score", item: str = "item_id", min_score: float | None = None) -> DataFrame:
    rows = scored if min_score is None else scored.filter(F.col(score) > min_score)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), item))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def dense_ids(rows: DataFrame, column: str, *, name: str = "idx") -> DataFrame:
    """Distinct values with gapless ids from 0 in value order: values are cut into ranges, written once, and numbered within each."""
    values = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    cut = written(values.repartitionByRange(column).select(column, F.spark_partition_id().alias("_p")), "dense-ids")
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    return cut.join(F.broadcast(starts), "_p").select(column, (F.col("_start") + rank).cast("long").alias(name))


def random_split(rows: DataFrame, *, share: float = 0.2, seed: int = 42, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """Rows with `is_test`, by a hash of the keys: the same however the rows are partitioned."""
    return rows.withColumn("is_test", draw(F.concat_ws("|", *keys, F.lit(str(seed)))) % 1_000_000 < int(share * 1_000_000))


def draw(text: Column) -> Column:
    """A number below 2**48 from the text's md5; other engines compute the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


# ---- joins and sets


def exclude_seen(candidates: DataFrame, history: DataFrame) -> DataFrame:
    return candidates.join(history.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def known_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    return rows.join(items.select("item_id"), "item_id", "left_semi")


def orphans(rows: DataFrame, items: DataFrame) -> DataFrame:
    return rows.join(items.select("item_id"), "item_id", "left_anti")


def paired_scores(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    return a.select("user_id", F.col(metric).alias("a")).join(b.select("user_id", F.col(metric).alias("b")), "user_id")


def clicks_before_holdout(clicks: DataFrame, holdout: DataFrame) -> DataFrame:
    """Clicks strictly earlier than the user's held-out time, and all of users without one."""
    times = holdout.groupBy("user_id").agg(F.max("ts").alias("_held"))
    return clicks.join(times, "user_id", "left").filter("_held is null or ts < _held").drop("_held")


def enrich_links(links: DataFrame, crawled: DataFrame, base: DataFrame) -> DataFrame:
    """Links with the crawled record's genres, else the base's."""
    rows = links.join(crawled.select(F.col("item_id").alias("tmdb_id"), F.col("genres").alias("_crawled")), "tmdb_id", "left")
    return rows.join(base.select("item_id", F.col("genres").alias("_base")), "item_id", "left").select("item_id", "tmdb_id", F.coalesce("_crawled", "_base").alias("genres"))


def rating_features(ratings: DataFrame, item_features: DataFrame, user_features: DataFrame) -> DataFrame:
    return ratings.join(item_features, "item_id", "left").join(user_features, "user_id", "left")


def co_rated(ratings: DataFrame, *, on: str = "item_id", of: str = "user_id", cap: int | None = None, asked: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """Sums over what two users (or items) share: (a, b, n, dot, sum_a, sum_b, sq_a, sq_b), a < b.

    `cap` leaves out keys with more rows than that, whose pairs say little; None keeps all. With `asked` (a column
    named as `of`) only those are `a`, and b is anyone else. Rows of a key are dealt into blocks of about `block` rows and
    each two blocks meet apart, so one task never holds all pairs of a hot key.
    """
    sizes = ratings.groupBy(on).agg(F.count("*").alias("_n"))
    sizes = (sizes if cap is None else sizes.filter(F.col("_n") <= cap)).select(on, F.ceil(F.col("_n") / block).cast("int").alias("_s"))
    rows = ratings.select(on, of, "rating").join(sizes, on).withColumn("_at", F.pmod(F.hash(of), F.col("_s")))
    every = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    left = rows if asked is None else rows.join(asked.select(of).distinct(), of, "left_semi")
    left = left.select(on, F.col("_at").alias("_i"), every.alias("_j"), F.col(of).alias("a"), F.col("rating").alias("x"))
    right = rows.select(on, F.col("_at").alias("_j"), every.alias("_i"), F.col(of).alias("b"), F.col("rating").alias("y"))
    both = left.select(on, "_i", "_j", "a", "x").join(right, [on, "_i", "_j"]).filter("a < b" if asked is None else "a <> b").select("a", "b", "x", "y")
    # pairs hardly come twice in a task, so they aren't summed before they are shuffled, and a task's table of them stays small however many there are
    n = (ratings.groupBy(on) if asked is None else rows.join(asked.select(of).distinct(), of, "left_semi").groupBy(on)).agg(F.count("*").alias("_a"))
    n = n.join(ratings.groupBy(on).agg(F.count("*").alias("_b")), on).agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    both = both.repartition(max(shuffle_partitions(ratings.sparkSession), -(-int(n) // (PAIRS if asked is not None else 2 * PAIRS))), "a", "b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum("x").alias("sum_a"), F.sum("y").alias("sum_b"), F.sum(F.col("x") * F.col("x")).alias("sq_a"), F.sum(F.col("y") * F.col("y")).alias("sq_b"))


def feature_cross(candidates: DataFrame, user_features: DataFrame, item_features: DataFrame) -> DataFrame:
    return candidates.join(user_features, "user_id", "left").join(item_features, "item_id", "left")


def union_channels(*channels: DataFrame) -> DataFrame:
    """Candidate lists (user_id, item_id, score, source) as one: best score per item and its source, ties to the first source name."""
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    # a pair hardly comes twice in a task, so rows aren't sorted for partial lists before they are shuffled
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "user_id", "item_id")
    best = F.min_by(F.struct("score", "source"), F.struct(-F.col("score"), F.col("source"))).alias("_best")
    return rows.groupBy("user_id", "item_id").agg(best).select("user_id", "item_id", "_best.score", "_best.source")


def intersect_items(recommended: DataFrame, items: DataFrame) -> DataFrame:
    return recommended.select("item_id").intersect(items.select("item_id"))


def bucketed_psi_edges(expected: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Distinct quantiles of a column as one row with an array."""
    at = [i / buckets for i in range(buckets + 1)]
    return exact_quantiles(expected, column, at).select(F.array_sort(F.array_distinct("q")).alias("edges"))


def genre_entropy(history: DataFrame, genres: DataFrame, *, vocabulary: int, low: float = 0.4, high: float = 0.9, default: float = 0.7) -> DataFrame:
    """Weight of relevance against diversity: high - (high - low) * min(1, H / log2 G) of a user's genres."""
    per = history.select("user_id", "item_id").join(genres, "item_id").groupBy("user_id", "genre").agg(F.count("*").alias("_c"))
    share = F.col("_c") / F.sum("_c").over(Window.partitionBy("user_id"))
    entropy = per.withColumn("_p", share).groupBy("user_id").agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))
    users = history.select("user_id").distinct()
    weight = high - (high - low) * F.least(F.lit(1.0), F.col("entropy") / math.log2(vocabulary))
    return users.join(entropy, "user_id", "left").select("user_id", F.coalesce(weight, F.lit(default)).alias("lambda"))
