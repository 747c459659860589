"""Queries over interactions and events: aggregates, splits, joins and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import aggregates as A
from slatewise.operators import catalogue as C
from slatewise.plans.registry import query
from slatewise.session import written
from slatewise.sources import binding as B

WORDS = ["ECONOMY", "SMALL", "bolt", "gear", "red", "widget"]


def _split(spark, d):
    rows = A.leave_one_out(B.interactions(spark, d))
    return rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")


def _genres(spark, d):
    return C.explode_genres(B.items(spark, d))


@query("WITH s AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1), g AS (SELECT avg(rating) AS m FROM train ) SELECT i.item_id, coalesce(s.n, 1) AS popularity, coalesce(s.m, g.m) AS vote_average, coalesce(s.n, 1) AS vote_count FROM items i CROSS JOIN g LEFT JOIN s ON s.item_id = i.item_id")
def item_stats(spark, d):
    return A.item_stats(_split(spark, d)[0], B.items(spark, d))


@query("""WITH g AS (SELECT avg(rating) AS m FROM interactions ), b AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY 1),
l AS (SELECT i.user_id, string_agg(DISTINCT genre, '|' ORDER BY genre) AS s FROM interactions i JOIN genre_rows r ON r.item_id = i.item_id WHERE rating >= 3.0 GROUP BY 1)
SELECT b.user_id, round(ln(1 + n), 9) AS activity, round(b.m - g.m, 9) AS bias, coalesce(s, '') AS genre_set FROM b CROSS JOIN g LEFT JOIN l ON l.user_id = b.user_id""")
def user_profile(spark, d):
    p = A.user_profile(B.interactions(spark, d), _genres(spark, d))
    return p.select("user_id", F.round("activity", 9).alias("activity"), F.round("bias", 9).alias("bias"), F.array_join("genre_set", "|").alias("genre_set"))


@query("SELECT user_id, count(*) AS rating_count, avg(rating) - 3.5 AS bias FROM interactions WHERE user_id IS NOT NULL GROUP BY 1")
def user_stats(spark, d):
    return A.user_stats(B.interactions(spark, d))


@query("""WITH v AS (SELECT item_id, avg(rating) AS va FROM interactions GROUP BY 1)
SELECT user_id, avg(rating) AS user_mean, round(coalesce(stddev_samp(rating), 0.0), 9) AS user_std, count(*) AS user_count, round(avg(popularity) * count(popularity), 2) / count(popularity) AS mean_popularity, round(avg(va), 9) AS mean_vote_average, round(avg(TRY_CAST(substr(release_date, 1, 4) AS INTEGER)), 9) AS mean_year
FROM interactions i LEFT JOIN items t ON t.item_id = i.item_id LEFT JOIN v ON v.item_id = i.item_id GROUP BY 1""")
def user_features(spark, d):
    r = B.interactions(spark, d)
    v = r.groupBy("item_id").agg(F.avg("rating").alias("vote_average"))
    items = B.items(spark, d).join(v, "item_id", "left").select("item_id", "popularity", "vote_average", F.substring("release_date", 1, 4).try_cast("int").alias("year"))
    rows = A.user_features(r, items)
    return rows.select("user_id", "user_mean", F.round("user_std", 9).alias("user_std"), "user_count", (F.round(F.col("mean_popularity") * F.col("user_count"), 2) / F.col("user_count")).alias("mean_popularity"), F.round("mean_vote_average", 9).alias("mean_vote_average"), F.round("mean_year", 9).alias("mean_year"))


@query("SELECT user_id, " + ", ".join(f"avg(CASE WHEN list_contains(string_split(genres, '|'), '{g}') THEN rating ELSE 0.0 END) AS pref_{g}" for g in WORDS) + " FROM interactions i JOIN items t ON t.item_id = i.item_id GROUP BY 1")
def genre_preference(spark, d):
    return A.genre_preference(B.interactions(spark, d), B.items(spark, d), WORDS)


WEIGHT = "CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 1.5 WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 0.8 WHEN 'error' THEN 0.5 ELSE 1.0 END"


@query(f"""WITH e AS (SELECT user_id, item_id, CAST(round(sum({WEIGHT}), 6) AS DOUBLE) AS weight FROM log GROUP BY 1, 2 UNION ALL SELECT user_id, item_id, CASE WHEN rating >= 3.5 THEN 5.0 ELSE 1.5 END FROM interactions )
SELECT user_id, item_id, CAST(max(weight) AS DOUBLE) AS weight FROM e GROUP BY 1, 2""")
def interaction_weight(spark, d):
    return A.interaction_weight(B.events(spark, d), B.interactions(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"SELECT item_id, CAST(round(sum({WEIGHT}), 6) AS DOUBLE) AS score FROM log GROUP BY 1")
def trending_score(spark, d):
    return A.trending_score(B.events(spark, d)).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM log )
SELECT 0 AS step, 'view' AS stage, v AS n, NULL::DOUBLE AS conversion FROM c UNION ALL SELECT 1, 'click', c, CASE WHEN v = 0 THEN 0.0 ELSE c / v END FROM c UNION ALL SELECT 2, 'signup', s, CASE WHEN c = 0 THEN 0.0 ELSE s / c END FROM c UNION ALL SELECT 3, 'purchase', p, CASE WHEN s = 0 THEN 0.0 ELSE p / s END FROM c""")
def funnel(spark, d):
    return A.funnel(B.events(spark, d))


@query("SELECT count(rating) AS n, avg(rating) AS mean, round(stddev_samp(rating), 9) AS std, min(rating) AS min, quantile_cont(rating, 0.25) AS q25, quantile_cont(rating, 0.5) AS q50, quantile_cont(rating, 0.75) AS q75, max(rating) AS max FROM interactions ")
def rating_summary(spark, d):
    return A.rating_summary(B.interactions(spark, d)).withColumn("std", F.round("std", 9))


@query("SELECT rating, count(*) AS n FROM interactions GROUP BY 1")
def rating_histogram(spark, d):
    return A.counts_by(B.interactions(spark, d), "rating")


@query("SELECT user_id, count(*) AS n FROM interactions GROUP BY 1")
def ratings_per_user(spark, d):
    return A.counts_by(B.interactions(spark, d), "user_id")


@query("SELECT item_id, count(*) AS n FROM interactions GROUP BY 1")
def ratings_per_item(spark, d):
    return A.counts_by(B.interactions(spark, d), "item_id")


@query("WITH p AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY 1) SELECT count(n) AS n, avg(n) AS mean, round(stddev_samp(n), 9) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM p")
def ratings_per_user_summary(spark, d):
    return A.rating_summary(A.counts_by(B.interactions(spark, d), "user_id", name="k"), "k").withColumn("std", F.round("std", 9))


@query("SELECT i.item_id, avg(rating) AS mean_rating, count(*) AS n, title FROM interactions i JOIN items t ON t.item_id = i.item_id GROUP BY i.item_id, title")
def item_means(spark, d):
    return A.item_means(B.interactions(spark, d), B.items(spark, d))


@query("SELECT TRY_CAST(substr(release_date, 1, 4) AS INTEGER) AS year, count(*) AS n FROM items GROUP BY 1")
def items_per_year(spark, d):
    return A.items_per_year(B.items(spark, d))


@query("SELECT genre, count(*) AS n FROM genre_rows GROUP BY 1")
def genre_counts(spark, d):
    return A.counts_by(_genres(spark, d), "genre")


@query("SELECT genre, avg(rating) AS mean_rating, count(*) AS n FROM interactions i JOIN genre_rows g ON g.item_id = i.item_id GROUP BY 1")
def genre_rating_stats(spark, d):
    return A.genre_rating_stats(B.interactions(spark, d), _genres(spark, d))


@query("SELECT genre, count(*) AS n FROM genre_rows GROUP BY 1 ORDER BY n DESC, genre LIMIT 20")
def tag_counts(spark, d):
    return A.top_counts(_genres(spark, d), "genre")


@query("SELECT item_id, count(*) AS n FROM interactions GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10")
def most_rated(spark, d):
    return A.top_counts(B.interactions(spark, d), "item_id", n=10)


@query("SELECT item_id, count(*) AS n FROM item_actors GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10")
def most_tagged(spark, d):
    return A.top_counts(B.item_actors(spark, d), "item_id", n=10)


@query("SELECT CAST(year(to_timestamp(ts)) AS INTEGER) AS year, count(*) AS n, avg(rating) AS mean_rating FROM interactions GROUP BY 1")
def ratings_by_year(spark, d):
    return A.ratings_by_year(B.interactions(spark, d))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, 1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) AS sparsity FROM interactions ")
def sparsity(spark, d):
    return A.sparsity(B.interactions(spark, d))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM items " for c in ("item_id", "title", "genres", "director", "popularity", "release_date")))
def null_rates(spark, d):
    return A.null_rates(B.items(spark, d))


@query("""WITH f AS (SELECT i.user_id, t.item_id, t.director, t.genres FROM interactions i JOIN items t ON t.item_id = i.item_id WHERE rating >= 4.5),
g AS (SELECT user_id, string_agg(DISTINCT g, '|' ORDER BY g) AS genre_set FROM (SELECT user_id, unnest(string_split(genres, '|')) AS g FROM f) GROUP BY 1),
r AS (SELECT user_id, director FROM (SELECT user_id, director, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, director) AS k FROM f GROUP BY 1, 2) WHERE k = 1),
a AS (SELECT user_id, count(DISTINCT actor) AS n_actors FROM f JOIN item_actors x ON x.item_id = f.item_id GROUP BY 1)
SELECT g.user_id, genre_set, director, n_actors FROM g LEFT JOIN r ON r.user_id = g.user_id LEFT JOIN a ON a.user_id = g.user_id""")
def infer_preferences(spark, d):
    p = A.infer_preferences(B.interactions(spark, d), B.items(spark, d), B.item_actors(spark, d))
    return p.select("user_id", F.array_join("genre_set", "|").alias("genre_set"), "director", "n_actors")


@query("""WITH f AS (SELECT * FROM interactions WHERE rating >= 3.5), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn FROM f),
i AS (SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rn) AS item_ids FROM n WHERE rn <= 200 GROUP BY 1),
g AS (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS k FROM f JOIN genre_rows r ON r.item_id = f.item_id GROUP BY 1, 2)
SELECT i.user_id, item_ids, (SELECT string_agg(genre, '|' ORDER BY k) FROM g WHERE g.user_id = i.user_id AND k <= 10) AS genres FROM i""")
def chat_profile(spark, d):
    p = A.chat_profile(A.liked_rows(B.interactions(spark, d), threshold=3.5), _genres(spark, d))
    return p.select("user_id", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), F.array_join("genres", "|").alias("genres"))


@query("SELECT user_id, item_id FROM interactions UNION SELECT user_id, item_id FROM log ")
def interacted_sets(spark, d):
    return A.interacted_pairs(B.interactions(spark, d), B.events(spark, d))


@query("SELECT rating, count(*) AS n FROM (SELECT CAST(least(4, greatest(0, round_even(rating - 1, 0))) AS INTEGER) AS rating FROM interactions ) GROUP BY 1")
def label_distribution(spark, d):
    return A.counts_by(B.interactions(spark, d).select(S.graded_label(F.col("rating")).alias("rating")), "rating")


@query("SELECT user_id, item_id, rating, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) = 1 AS is_test FROM interactions ")
def leave_one_out(spark, d):
    return A.leave_one_out(B.interactions(spark, d))


@query("""SELECT user_id, item_id, CASE WHEN n < 5 THEN 'train' WHEN rn <= 2 THEN 'test' WHEN rn <= 3 THEN 'val' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM interactions )""")
def time_split(spark, d):
    return A.time_split(B.interactions(spark, d), n_test=2, n_val=1).select("user_id", "item_id", "part")


@query("SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn FROM interactions WHERE rating >= 3.5) WHERE rn <= 20")
def last_liked(spark, d):
    return A.last_n(A.liked_rows(B.interactions(spark, d), threshold=3.5), 20).select("user_id", "item_id")


VECTORS = "SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings"


def vectors(spark, d):
    from slatewise.session import table

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query(f"""WITH v AS ({VECTORS}), h AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn FROM interactions WHERE rating >= 3.0), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM h WHERE rn <= 20),
w AS (SELECT k.user_id, exp(CASE WHEN n > 1 THEN -0.6 * (rn - 1) / (n - 1) ELSE -0.6 END) AS w, vec FROM k JOIN v ON v.item_id = k.item_id), t AS (SELECT user_id, sum(w) AS t FROM w GROUP BY 1),
p AS (SELECT w.user_id, w / t AS w, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM w JOIN t ON t.user_id = w.user_id), s AS (SELECT user_id, pos, sum(w * x) AS x FROM p GROUP BY 1, 2),
q AS (SELECT user_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1)
SELECT s.user_id, pos - 1 AS pos, round(x / n, 6) + 0.0 AS x FROM s JOIN q ON q.user_id = s.user_id""")
def recency_weighted_vector(spark, d):
    rows = A.recency_weighted_vector(A.liked_rows(B.interactions(spark, d), threshold=3.0), vectors(spark, d))
    return rows.select("user_id", F.posexplode("vec").alias("pos", "x")).select("user_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query(f"""WITH v AS ({VECTORS}), r AS (SELECT user_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM interactions i JOIN v ON v.item_id = i.item_id WHERE rating >= 3.0)
SELECT user_id, pos - 1 AS pos, round(avg(x), 6) + 0.0 AS x FROM r GROUP BY 1, 2""")
def mean_vectors(spark, d):
    rows = A.mean_vectors(B.interactions(spark, d), vectors(spark, d))
    return rows.select("user_id", F.posexplode("vec").alias("pos", "x")).select("user_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@query("""SELECT user_id, item_id, CASE WHEN hi = lo THEN 1.0 ELSE (rating - lo) / (hi - lo) END AS scaled FROM (SELECT *, min(rating) OVER (PARTITION BY user_id) AS lo, max(rating) OVER (PARTITION BY user_id) AS hi FROM interactions )""")
def min_max(spark, d):
    return A.min_max(B.interactions(spark, d), "rating", key="user_id").select("user_id", "item_id", "scaled")


@query("SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rank FROM interactions WHERE rating > 2.0) WHERE rank <= 5")
def top_rated_k(spark, d):
    return A.top_k(B.interactions(spark, d), 5, score="rating", min_score=2.0).select("user_id", "item_id", "rank")


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM interactions )")
def dense_ids(spark, d):
    return A.dense_ids(B.interactions(spark, d), "item_id")


HEX = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"


@query(f"SELECT user_id, item_id, {HEX.format("concat_ws('|', user_id, item_id, '42')")} % 1000000 < 200000 AS is_test FROM interactions ")
def random_split(spark, d):
    return A.random_split(B.interactions(spark, d)).select("user_id", "item_id", "is_test")


@query("SELECT user_id, item_id, event_type FROM log l WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = l.user_id AND i.item_id = l.item_id)")
def exclude_seen(spark, d):
    return A.exclude_seen(B.events(spark, d), B.interactions(spark, d)).select("user_id", "item_id", "event_type")


@query("SELECT 'known' AS kind, count(*) AS n FROM log WHERE item_id IN (SELECT item_id FROM items ) UNION ALL SELECT 'orphan', count(*) FROM log WHERE item_id NOT IN (SELECT item_id FROM items )")
def known_and_orphan_items(spark, d):
    e, items = B.events(spark, d), B.items(spark, d)
    count = lambda rows, kind: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(A.known_items(e, items), "known").unionByName(count(A.orphans(e, items), "orphan"))


@query("WITH h AS (SELECT user_id, max(ts) AS t FROM last_one GROUP BY 1) SELECT event_id, l.user_id, l.ts - 800000000 AS ts FROM log l LEFT JOIN h ON h.user_id = l.user_id WHERE t IS NULL OR l.ts - 800000000 < t")
def clicks_before_holdout(spark, d):
    clicks = B.events(spark, d).withColumn("ts", F.col("ts") - 800_000_000)  # the log starts after the orders end
    return A.clicks_before_holdout(clicks, _split(spark, d)[1]).select("event_id", "user_id", "ts")


@query("SELECT i.item_id, i.item_id + 7 AS tmdb_id, coalesce(CASE WHEN (i.item_id + 7) % 3 = 0 THEN c.genres END, i.genres) AS genres FROM items i LEFT JOIN items c ON c.item_id = i.item_id + 7")
def enrich_links(spark, d):
    items = B.items(spark, d)
    links = items.select("item_id", (F.col("item_id") + 7).alias("tmdb_id"))
    return A.enrich_links(links, items.filter("item_id % 3 = 0"), items)


@query("""SELECT a.user_id AS a, b.user_id AS b, count(*) AS n, sum(a.rating * b.rating) AS dot, sum(a.rating) AS sum_a, sum(b.rating) AS sum_b, sum(a.rating * a.rating) AS sq_a, sum(b.rating * b.rating) AS sq_b
FROM interactions a JOIN interactions b ON a.item_id = b.item_id AND a.user_id < b.user_id GROUP BY 1, 2""")
def co_rated_users(spark, d):
    return A.co_rated(written(B.interactions(spark, d), "interactions"))


@query("""WITH u AS (SELECT user_id, item_id, CAST(rating AS DOUBLE) AS score, 'rated' AS source FROM interactions UNION ALL SELECT user_id, item_id, value, event_type FROM log ), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY score DESC, source) AS rn FROM u)
SELECT user_id, item_id, score, source FROM k WHERE rn = 1""")
def union_channels(spark, d):
    a = B.interactions(spark, d).select("user_id", "item_id", F.col("rating").alias("score"), F.lit("rated").alias("source"))
    b = B.events(spark, d).select("user_id", "item_id", F.col("value").alias("score"), F.col("event_type").alias("source"))
    return A.union_channels(a, b)


@query("SELECT item_id FROM log INTERSECT SELECT item_id FROM items ")
def intersect_items(spark, d):
    return A.intersect_items(B.events(spark, d), B.items(spark, d))


@query("""WITH c AS (SELECT i.user_id, genre, count(*) AS c FROM interactions i JOIN genre_rows g ON g.item_id = i.item_id GROUP BY 1, 2), p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c), e AS (SELECT user_id, -sum(p * log2(p)) AS h FROM p GROUP BY 1)
SELECT u.user_id, round(coalesce(0.9 - 0.5 * least(1.0, h / log2(19)), 0.7), 6) AS lambda FROM (SELECT DISTINCT user_id FROM interactions ) u LEFT JOIN e ON e.user_id = u.user_id""")
def entropy_lambda(spark, d):
    return A.genre_entropy(B.interactions(spark, d), _genres(spark, d), vocabulary=19).withColumn("lambda", F.round("lambda", 6))


@query("SELECT i.user_id, i.item_id, rating, popularity, n FROM interactions i LEFT JOIN items t ON t.item_id = i.item_id LEFT JOIN (SELECT user_id, count(*) AS n FROM interactions GROUP BY 1) u ON u.user_id = i.user_id")
def rating_features(spark, d):
    r = B.interactions(spark, d)
    return A.rating_features(r, B.items(spark, d).select("item_id", "popularity"), A.counts_by(r, "user_id")).select("user_id", "item_id", "rating", "popularity", "n")


@query("SELECT user_id, count(*) AS n FROM log WHERE value * 100 BETWEEN 100 AND 3600000 AND value * 100 >= 1500 GROUP BY 1")
def dwell_counts(spark, d):
    e = B.events(spark, d).withColumn("dwell_ms", F.col("value") * 100)
    return A.counts_by(A.dwell_filter(e), "user_id")


@query("""SELECT a.item_id AS a, b.item_id AS b, CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) END AS jaccard, round(f, 9) AS affinity
FROM (SELECT item_id, string_split(genres, '|') AS ga FROM items ) a JOIN (SELECT item_id, string_split(genres, '|') AS gb FROM items ) b ON b.item_id = a.item_id + 1, LATERAL (SELECT len(list_intersect(ga, gb)) / greatest(len(list_distinct(gb)), 1) AS f)""")
def genre_similarity(spark, d):
    items = B.items(spark, d).select("item_id", F.split("genres", r"\|").alias("g"))
    a = items.select(F.col("item_id").alias("a"), F.col("g").alias("ga"))
    b = items.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("g").alias("gb"))
    return a.join(b, "a").select("a", "b", S.jaccard(F.col("ga"), F.col("gb")).alias("jaccard"), F.round(S.genre_affinity(F.col("ga"), F.col("gb")), 9).alias("affinity"))


@query("SELECT item_id, round(CASE WHEN n <= 0 THEN m ELSE (n * m + 25.0 * 5.0) / (n + 25.0) END, 9) AS bayes FROM (SELECT item_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY 1)")
def bayesian_rating(spark, d):
    s = A.item_stats(B.interactions(spark, d))
    return s.select("item_id", F.round(S.bayesian_rating(F.col("vote_count"), F.col("vote_average")), 9).alias("bayes"))
