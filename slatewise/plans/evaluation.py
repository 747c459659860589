"""Queries of ranking features, re-ranking, metrics, gates and data checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.operators import aggregates as A
from slatewise.operators import boosting as T
from slatewise.operators import catalogue as C
from slatewise.operators import evaluation as E
from slatewise.operators import features as X
from slatewise.operators import retrieval as R
from slatewise.operators import sampling as G
from slatewise.plans.interactions import HEX, WORDS, vectors
from slatewise.plans.registry import query
from slatewise.plans.retrieval import DRAWN, SIM, TFIDF, _genre_terms, _index, _train_test
from slatewise.session import table, written
from slatewise.sources import binding as B

#: A prediction that any engine can compute: the rating moved by a hash of the pair.
PRED = "(rating + ((user_id * 31 + item_id * 17) % 100) / 50.0)"
SCORED = f"sc AS (SELECT user_id, item_id, rating, {PRED} AS pred FROM interactions )"


def _scored(spark, d):
    return B.interactions(spark, d).withColumn("pred", F.expr(PRED.replace("50.0", "50.0D")))


def _meta(spark, d, train):
    meta = X.item_meta(B.items(spark, d), A.item_stats(train))
    return meta.join(vectors(spark, d).select("item_id", F.col("vec").alias("als_vec")), "item_id", "left")


def _profiles(spark, d, train):
    taste = A.mean_vectors(train, vectors(spark, d)).select("user_id", F.col("vec").alias("als_vec"))
    return A.user_profile(train, C.explode_genres(B.items(spark, d))).join(taste, "user_id", "left")


META = """st AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1), meta AS (SELECT i.item_id, coalesce(CAST(n AS DOUBLE), 1.0) AS popularity, coalesce(m, 5.0) AS vote_average, coalesce(CAST(n AS DOUBLE), 10.0) AS vote_count, string_split(genres, '|') AS gl, CAST(coalesce(TRY_CAST(substr(release_date, 1, 4) AS INTEGER), 2010) AS DOUBLE) AS year FROM items i LEFT JOIN st ON st.item_id = i.item_id),
gm AS (SELECT avg(rating) AS m FROM train ), ub AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM train GROUP BY 1), ug AS (SELECT user_id, list(DISTINCT genre) AS gs FROM train t JOIN genre_rows g ON g.item_id = t.item_id WHERE rating >= 3.0 GROUP BY 1),
rs AS (SELECT l.user_id, l.item_id, avg(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[]))) AS s FROM last_one l JOIN embeddings e ON e.vec_id = l.item_id JOIN train t ON t.user_id = l.user_id AND t.rating >= 3.0 JOIN embeddings h ON h.vec_id = t.item_id GROUP BY 1, 2),
feat AS (SELECT l.user_id, l.item_id, popularity, vote_average, vote_count, (vote_count * vote_average + 125.0) / (vote_count + 25.0) AS bayes, year, exp(-ln(2) / 15 * greatest(0, 2024 - year)) AS decay, CAST(len(list_intersect(gl, coalesce(gs, []))) AS DOUBLE) AS overlap, len(list_intersect(gl, coalesce(gs, []))) / greatest(len(coalesce(gs, [])), 1) AS affinity, coalesce(ln(1 + ub.n), 1.0) AS activity, coalesce(ub.m - gm.m, 0.0) AS bias, coalesce(rs.s, 0.0) AS retrieval_score, len(list_intersect(gl, coalesce(gs, []))) / greatest(len(coalesce(gs, [])), 1) AS cb_score FROM last_one l JOIN meta ON meta.item_id = l.item_id CROSS JOIN gm LEFT JOIN ub ON ub.user_id = l.user_id LEFT JOIN ug ON ug.user_id = l.user_id LEFT JOIN rs ON rs.user_id = l.user_id AND rs.item_id = l.item_id)"""


@query("WITH " + META + " SELECT user_id, item_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in X.RANKING) + " FROM feat")
def ranking_features(spark, d):
    train, test = _train_test(spark, d)
    rows = X.ranking_features(test.select("user_id", "item_id"), _meta(spark, d, train), _profiles(spark, d, train))
    return rows.select("user_id", "item_id", *[F.round(c, 6).alias(c) for c in X.RANKING])


def _train_set(spark, d, train=None, sides=None):
    train = _train_test(spark, d)[0] if train is None else train
    meta, profiles = sides or (_meta(spark, d, train), _profiles(spark, d, train))
    wanted = train.groupBy("user_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).cast("int").alias("n"))
    negatives = G.sample_negatives(wanted, train, _index(spark, d))
    return X.ranking_train_set(train, negatives, meta, profiles)


@query()
def ranking_train_set(spark, d):
    return _train_set(spark, d)


@query()
def ranker_scores(spark, d):
    train, test = _train_test(spark, d)
    sides = written(_meta(spark, d, train), "ranked-items"), written(_profiles(spark, d, train), "ranked-users")  # training and scoring read them
    model = T.fit_lambda_ranker(_train_set(spark, d, train, sides), columns=X.RANKING, settings=T.Settings(rounds=4, rate=0.2))
    rows = X.ranking_features(test.select("user_id", "item_id"), *sides)
    return model.transform(rows).select("user_id", "item_id", "prediction")


@query()
def pairwise_ranker(spark, d):
    model = X.fit_pairwise(_train_set(spark, d), pairs=4)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(X.RANKING, model.coefficients.toArray(), strict=True)], "feature string, weight double")


@query()
def ranker_importance(spark, d):
    rows = written(_train_set(spark, d), "train-set")  # fitting reads it in several jobs
    return X.feature_importance(X.fit_ranker(rows, iterations=2, depth=3), rows)


_FLAGS = ", ".join(f"CAST(list_contains(string_split(genres, '|'), '{g}') AS INTEGER) AS genre_{g}" for g in WORDS)
#: Items with actors in order, words of the title as keywords, a text, and a flag in words; no actor is known of some.
MOVIES = """ac AS (SELECT item_id, min_by(actor, cast_order) AS actor, count(*) AS n FROM item_actors WHERE item_id % 9 > 0 GROUP BY 1), vs AS (SELECT item_id, avg(rating) AS m, count(*) AS n FROM interactions GROUP BY 1),
mv AS (SELECT i.item_id, popularity, m AS vote_average, CAST(vs.n AS DOUBLE) AS vote_count, CAST(item_id_flag AS INTEGER) AS adult, CAST(coalesce(TRY_CAST(substr(release_date, 1, 4) AS INTEGER), 2010) AS INTEGER) AS year, CAST(coalesce(month(TRY_CAST(release_date AS DATE)), 0) AS INTEGER) AS month, CAST(floor(coalesce(TRY_CAST(substr(release_date, 1, 4) AS INTEGER), 2010) / 10) * 10 AS INTEGER) AS decade,
CAST(len(string_split(genres, '|')) AS INTEGER) AS n_genres, CAST(coalesce(ac.n, 0) AS INTEGER) AS n_cast, CAST(len(string_split(title, ' ')) AS INTEGER) AS n_keywords, CAST(length(title || ' by ' || director) AS INTEGER) AS overview_len, director AS primary_director, coalesce(actor, '<unknown>') AS primary_actor, """ + _FLAGS + """
FROM (SELECT *, item_id % 50 = 0 AS item_id_flag FROM items ) i LEFT JOIN ac ON ac.item_id = i.item_id LEFT JOIN vs ON vs.item_id = i.item_id)"""


def _movies(spark, d):
    actors = B.item_actors(spark, d).filter("item_id % 9 > 0").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cast_order", "actor"))), lambda x: x["actor"]), "|").alias("cast"))
    votes = B.interactions(spark, d).groupBy("item_id").agg(F.avg("rating").alias("vote_average"), F.count("*").alias("vote_count"))
    rows = B.items(spark, d).join(actors, "item_id", "left").join(votes, "item_id", "left")
    adult = F.when(F.col("item_id") % 50 == 0, F.lit(" True")).when(F.col("item_id") % 2 == 0, F.lit("no"))
    return rows.withColumns({"overview": F.concat_ws(" by ", "title", "director"), "keywords": F.replace("title", F.lit(" "), F.lit(";")), "adult": adult})


@query("WITH " + MOVIES + " SELECT * REPLACE (round(vote_average, 6) AS vote_average) FROM mv")
def movie_features(spark, d):
    return X.movie_features(_movies(spark, d), WORDS).withColumn("vote_average", F.round("vote_average", 6))


@query("WITH " + MOVIES + ", us AS (SELECT i.user_id, avg(rating) AS user_mean, coalesce(stddev_samp(rating), 0.0) AS user_std, count(*) AS user_count, avg(popularity) AS mean_popularity, avg(vote_average) AS mean_vote_average, avg(year) AS mean_year, " + ", ".join(f"avg(genre_{g} * rating) AS pref_{g}" for g in WORDS) + " FROM interactions i JOIN mv ON mv.item_id = i.item_id GROUP BY 1)\nSELECT rating, i.item_id, i.user_id, primary_director, primary_actor, popularity, round(vote_average, 5) AS vote_average, vote_count, adult, year, month, decade, n_genres, n_cast, n_keywords, overview_len, round(user_mean, 5) AS user_mean, round(user_std, 5) AS user_std, user_count, round(mean_popularity * user_count, 2) / user_count AS mean_popularity, round(mean_vote_average, 5) AS mean_vote_average, round(mean_year, 5) AS mean_year, round(abs(year - mean_year), 5) AS year_match, round(" + " + ".join(f"genre_{g} * pref_{g}" for g in WORDS) + ", 5) AS genre_match_score, " + ", ".join(f"genre_{g}" for g in WORDS) + " FROM interactions i JOIN mv ON mv.item_id = i.item_id JOIN us ON us.user_id = i.user_id")
def rating_dataset(spark, d):
    r = written(B.interactions(spark, d), "ratings")  # each side and each check of keys reads it
    feats = written(X.movie_features(_movies(spark, d), WORDS), "movie-features")
    users = written(A.user_features(r, feats.select("item_id", "popularity", "vote_average", "year")), "user-features")
    likes = written(A.genre_preference(r, B.items(spark, d), WORDS), "preferences")
    rows = X.rating_dataset(r, feats, users, likes, WORDS)
    fine = {c: F.round(c, 5) for c in ("vote_average", "user_mean", "user_std", "mean_vote_average", "mean_year", "year_match", "genre_match_score")}
    return rows.withColumns({**fine, "mean_popularity": F.round(F.col("mean_popularity") * F.col("user_count"), 2) / F.col("user_count")})


@query()
def frozen_codes(spark, d):
    items = B.items(spark, d)
    return X.freeze_vocabulary(items.filter("item_id % 10 <> 0"), ["director"]).transform(items).select("item_id", "director", "director_idx")


@query("SELECT item_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(0.6 * a + 0.4 * b, 6) ELSE coalesce(a, b, popularity) END AS score FROM (SELECT item_id, popularity, CASE WHEN item_id % 3 > 0 THEN item_id / 7.0 END AS a, CASE WHEN item_id % 5 > 0 THEN item_id / 9.0 END AS b FROM items )")
def blended_scores(spark, d):
    rows = B.items(spark, d).withColumn("score_a", F.when(F.col("item_id") % 3 > 0, F.col("item_id") / 7.0)).withColumn("score_b", F.when(F.col("item_id") % 5 > 0, F.col("item_id") / 9.0))
    both = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    return X.blend(rows).select("item_id", F.when(both, F.round("score", 6)).otherwise(F.col("score")).alias("score"))


@query("WITH " + META + " SELECT user_id, item_id, round(10 * overlap + 5 * retrieval_score + 0.5 * vote_average, 6) AS score FROM feat")
def heuristic_scores(spark, d):
    train, test = _train_test(spark, d)
    rows = X.ranking_features(test.select("user_id", "item_id"), _meta(spark, d, train), _profiles(spark, d, train))
    return X.heuristic_score(rows).select("user_id", "item_id", F.round("score", 6).alias("score"))


@query("WITH " + SCORED + ", k AS (SELECT sc.*, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, popularity DESC, sc.item_id) AS rank FROM sc JOIN items i ON i.item_id = sc.item_id) SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank FROM k")
def rank_candidates(spark, d):
    items = B.items(spark, d)
    rows = _scored(spark, d).join(items.select("item_id", "popularity"), "item_id").withColumnRenamed("pred", "score")
    return X.rank_candidates(rows, items).select("user_id", "item_id", "rank")


@query("""WITH us AS (SELECT user_id, avg(rating) AS b, count(*) AS n FROM interactions GROUP BY 1), it AS (SELECT item_id, avg(rating) AS s FROM interactions GROUP BY 1),
ug AS (SELECT user_id, list(DISTINCT genre) AS gs FROM interactions t JOIN genre_rows g ON g.item_id = t.item_id WHERE rating >= 4.5 GROUP BY 1), al AS (SELECT us.user_id, it.item_id, round(s + b + 0.1 * len(list_intersect(string_split(i.genres, '|'), coalesce(gs, []))), 9) AS score FROM us CROSS JOIN it JOIN items i ON i.item_id = it.item_id LEFT JOIN ug ON ug.user_id = us.user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM al) SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def recommend_all(spark, d):
    r, items = B.interactions(spark, d), B.items(spark, d)
    liked = A.liked_rows(r, threshold=4.5).join(C.explode_genres(items), "item_id").groupBy("user_id").agg(F.collect_set("genre").alias("genre_set"))
    users = r.groupBy("user_id").agg(F.avg("rating").alias("user_bias")).join(liked, "user_id", "left").withColumn("genre_set", F.coalesce("genre_set", F.array().cast("array<string>")))
    rows = r.groupBy("item_id").agg(F.avg("rating").alias("item_score")).join(items.select("item_id", F.split("genres", r"\|").alias("genre_list")), "item_id")
    return X.recommend_all(users, rows)


def _mmr_input(spark, d):
    items = B.items(spark, d).select("item_id", "genres")
    weight = A.genre_entropy(B.interactions(spark, d), C.explode_genres(B.items(spark, d)), vocabulary=19)
    return _scored(spark, d).join(items, "item_id").join(weight, "user_id").select(F.col("user_id").alias("slate_id"), "item_id", "genres", F.col("pred").alias("score"), "lambda")


#: Greedy re-ranking as a recursion over ranks: a slate's state is the list of what it has chosen.
MMR = """, gn AS (SELECT i.user_id, genre, count(*) AS c FROM interactions i JOIN genre_rows g ON g.item_id = i.item_id GROUP BY 1, 2), gp AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM gn),
lm AS (SELECT user_id, 0.9 - 0.5 * least(1.0, -sum(p * log2(p)) / log2(19)) AS lam FROM gp GROUP BY 1),
cd AS (SELECT sc.user_id AS slate_id, sc.item_id, lam, {x} AS x, row_number() OVER (PARTITION BY sc.user_id ORDER BY pred DESC, sc.item_id) AS ord, CASE WHEN max(pred) OVER w = min(pred) OVER w THEN 1.0 ELSE (pred - min(pred) OVER w) / (max(pred) OVER w - min(pred) OVER w + {epsilon}) END AS rel
FROM sc JOIN lm ON lm.user_id = sc.user_id JOIN {source} s ON s.item_id = sc.item_id WINDOW w AS (PARTITION BY sc.user_id))
SELECT slate_id, item_id, CAST(rank AS INTEGER) AS rank FROM (WITH RECURSIVE st AS (SELECT slate_id, 1 AS rank, item_id, [item_id] AS chosen, [x] AS xs FROM cd WHERE ord = 1
UNION ALL SELECT slate_id, rank + 1, w.item_id, list_append(chosen, w.item_id), list_append(xs, w.x) FROM (SELECT st.slate_id, st.rank, st.chosen, st.xs, min({{'v': -round(lam * rel - (1 - lam) * list_max(list_transform(st.xs, lambda y: {like})), 9), 'ord': ord, 'item_id': cd.item_id, 'x': cd.x}}) AS w
FROM st JOIN cd ON cd.slate_id = st.slate_id WHERE st.rank < 10 AND NOT list_contains(st.chosen, cd.item_id) GROUP BY 1, 2, 3, 4)) SELECT * FROM st)"""
_JACCARD = MMR.format(x="string_split(genres, '|')", epsilon="1e-6", source="items", like="len(list_intersect(y, cd.x)) / len(list_distinct(list_concat(y, cd.x)))")
_COSINE = MMR.format(x="v", epsilon="0.0", source="dv", like="list_dot_product(y, cd.x)")
DENSE = ", dv AS (SELECT i.item_id, list(coalesce(weight, 0.0) ORDER BY per.term) AS v FROM items i CROSS JOIN per LEFT JOIN terms ON terms.item_id = i.item_id AND terms.term = per.term GROUP BY 1)"


@query("WITH " + SCORED + _JACCARD)
def mmr_slates(spark, d):
    return X.mmr(_mmr_input(spark, d), limit=10)


@query("WITH " + SCORED + ", " + TFIDF + DENSE + _COSINE)
def mmr_cosine_slates(spark, d):
    return X.mmr(_mmr_input(spark, d), limit=10, epsilon=0.0, terms=_genre_terms(spark, d))


@query()
def recommend_end_to_end(spark, d):
    """Words and factors, 100 each, the best 250 of both ranked by boosted trees, slates of 10 by genre weights."""
    items = written(B.items(spark, d), "items")
    train, _ = _train_test(spark, d)
    tokens = R.term_counts(items, R.genre_tokens(F.col("genres")))
    index = R.bm25_fit(tokens, items.agg(F.count("*").alias("n")))
    users = B.users(spark, d).select("user_id")
    words = R.bm25_candidates(A.liked_rows(train, threshold=3.5), tokens, index, train, users, n=100)
    factors = R.als_candidates(R.fit_als(train, rank=8, iterations=2), train, train, n=100)
    # training and scoring read both sides; unwritten, their plans and broadcasts are held by the driver once for each
    meta, profiles = written(_meta(spark, d, train), "ranked-items"), written(_profiles(spark, d, train), "ranked-users")
    ranker = X.fit_ranker(written(_train_set(spark, d, train, (meta, profiles)), "train-set"), iterations=4, depth=3)

    def score(rows):
        return ranker.transform(X.ranking_features(rows, meta, profiles)).withColumn("score", F.round("prediction", 9))

    weight = written(A.genre_entropy(train, C.explode_genres(items), vocabulary=19), "weights")
    return X.recommend([words, factors], users, train, R.popular(train, 100), items, score, weight, _genre_terms(spark, d))


@query()
def tuned_depth(spark, d):
    r, columns = written(B.interactions(spark, d), "ratings"), ["popularity", "vote_average", "year"]
    rows = A.time_split(r).filter("part <> 'test'").select("item_id", "rating", "part")
    rows = written(rows.join(X.item_meta(B.items(spark, d), A.item_stats(r)).select("item_id", *columns), "item_id").select("rating", *columns, "part"), "rated")  # each fit reads it in several jobs
    return X.tune(rows.filter("part = 'train'"), rows.filter("part = 'val'"), columns=columns)


#: Ratings split by each user's time, with the sides' features. A user's last rating is the test, the one before it the validation.
def _rated(spark, d):
    r, items = B.interactions(spark, d), B.items(spark, d)
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id")))
    rows = r.withColumn("_n", newest).withColumn("part", F.when(F.col("_n") == 1, "test").when(F.col("_n") == 2, "valid").otherwise("train")).drop("_n")
    rows = written(rows, "ratings")  # read by both sides' features and by the rows themselves
    train = rows.filter("part = 'train'")
    sides = X.item_meta(items, A.item_stats(train)).select("item_id", "popularity", "vote_average", "year").join(items.select("item_id", "director"), "item_id", "left")
    users = train.groupBy("user_id").agg(F.avg("rating").alias("user_mean"), F.count("*").alias("user_n"))
    return written(rows.join(sides, "item_id", "left").join(users, "user_id", "left"), "rated")


_RATER = ["popularity", "vote_average", "year", "user_mean", "user_n"]


def _raters(rows):
    train, valid = rows.filter("part = 'train'"), rows.filter("part = 'valid'")
    a = T.fit_rater(train, valid, columns=_RATER, categories=["director", "user_id"], settings=T.Settings(rounds=8, rate=0.4), patience=2)
    b = T.fit_rater(train, valid, columns=_RATER, categories=["director", "user_id"], encoding="ordered", settings=T.Settings(rounds=8, rate=0.4, symmetric=True), patience=2)
    return a, b


@query()
def rating_models(spark, d):
    """Each rater's validation error by round, and whether the round is its last one kept."""
    told = []
    for name, rater in zip(("codes", "ordered"), _raters(_rated(spark, d)), strict=True):
        kept = len(rater.model.trees)
        told += [(name, n, round(e, 6), n == kept) for n, e in enumerate(rater.model.history, 1)]
    return spark.createDataFrame(told, "model string, round int, rmse double, chosen boolean")


@query()
def blended_models(spark, d):
    """Test pairs by both raters, blended; each is without a score where its rater knows the item or the user too little."""
    rows = _rated(spark, d)
    a, b = _raters(rows)
    test = b.predict(a.predict(rows.filter("part = 'test'"), "score_a"), "score_b")
    test = test.withColumn("score_a", F.when(F.col("popularity") >= 2, F.col("score_a"))).withColumn("score_b", F.when(F.col("user_n") >= 2, F.col("score_b")))
    return X.blend(test).select("user_id", "item_id", "rating", *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "score")])


@query(f"""WITH o AS (SELECT t.*, director, {HEX.format("concat_ws('|', user_id, t.item_id, '42')")} AS h FROM train t JOIN items i ON i.item_id = t.item_id)
SELECT user_id, item_id, round((coalesce(sum(rating) OVER w, 0.0) + 3.0 * 2) / (count(*) OVER w + 2), 6) AS director_stat FROM o WINDOW w AS (PARTITION BY director ORDER BY h, user_id, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_statistics(spark, d):
    train, _ = _train_test(spark, d)
    rows = train.join(B.items(spark, d).select("item_id", "director"), "item_id")
    return T.ordered_statistics(rows, "director", label="rating", prior=3.0, weight=2.0).select("user_id", "item_id", F.round("director_stat", 6).alias("director_stat"))


@query()
def tuned_trials(spark, d):
    """Successive halving over 8 seeded draws: 2, 4, 8 and 16 rounds."""
    rows = _rated(spark, d)
    told = T.tune_by_halving(rows.filter("part = 'train'"), rows.filter("part = 'valid'"), columns=_RATER, trials=8, rounds=2)
    return told.withColumn("rmse", F.round("rmse", 6))


@query("SELECT item_id, q FROM (SELECT item_id, quantile_cont(rating, [0.1, 0.5, 0.9]) AS v FROM interactions GROUP BY 1), (SELECT 0 AS z), LATERAL (SELECT array_to_string(list_transform(v, lambda x: CAST(round(x, 6) AS VARCHAR)), '|') AS q)")
def rating_quantiles(spark, d):
    """Exact quantiles of each item's ratings."""
    from slatewise.operators.quantiles import exact_quantiles

    rows = exact_quantiles(B.interactions(spark, d), "rating", [0.1, 0.5, 0.9], ["item_id"])
    return rows.select("item_id", F.array_join(F.transform("q", lambda x: F.round(x, 6).cast("string")), "|").alias("q"))


# ---- metrics


@query("WITH " + SCORED + " SELECT round(sqrt(avg((rating - pred) * (rating - pred))), 6) AS rmse, round(avg(abs(rating - pred)), 6) AS mae, count(*) AS n FROM sc")
def rmse_mae(spark, d):
    return E.rmse_mae(_scored(spark, d)).select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


PER = "WITH " + SCORED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, item_id) AS r, CASE WHEN rating >= 4.0 THEN 1 ELSE 0 END AS rel FROM sc),
pu AS (SELECT user_id, max(CASE WHEN r <= 10 THEN rel ELSE 0 END) AS h, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) ELSE 0.0 END) AS dcg, min(CASE WHEN rel = 1 THEN r END) AS f, sum(rel) AS n FROM rk GROUP BY 1 HAVING sum(rel) > 0),
per AS (SELECT user_id, CAST(h AS DOUBLE) AS hit, dcg / list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, 1 / f AS rr FROM pu)"""


@query(PER + " SELECT user_id, hit, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr FROM per")
def per_user_scores(spark, d):
    return E.per_user_scores(_scored(spark, d)).select("user_id", "hit", F.round("ndcg", 6).alias("ndcg"), F.round("rr", 6).alias("rr"))


@query(PER + " SELECT round(avg(hit), 6) AS hr, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS mrr, count(*) AS n_users, (SELECT count(DISTINCT user_id) FROM sc) - count(*) AS n_skipped FROM per")
def ranking_metrics(spark, d):
    return E.ranking_metrics(_scored(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("hr", "ndcg", "mrr")], "n_users", "n_skipped")


#: A second model of the same pairs, as its own tables of per-user scores.
PER_B = PER.removeprefix("WITH ").replace("sc AS", "scb AS").replace("FROM sc)", "FROM scb)").replace(PRED, PRED + " - item_id % 3").replace("rk AS", "rkb AS").replace("FROM rk", "FROM rkb").replace("pu AS", "pub AS").replace("FROM pu)", "FROM pub)").replace("per AS", "perb AS")
#: The Poisson bootstrap of column m of `base`: a user's weight in a replica is the number of edges its hash passes.
BOOT = "rp AS (SELECT m, rep, len(list_filter(" + str(E.POISSON_EDGES) + ", lambda e: e <= u)) AS w FROM (SELECT m, rep, " + HEX.format("concat_ws('|', user_id, rep, '42')") + " / 281474976710656.0::DOUBLE AS u FROM (SELECT user_id, m, unnest(range(1, 1001)) AS rep FROM base))), bt AS (SELECT sum(w * m) / sum(w) AS v FROM rp GROUP BY rep), ci AS (SELECT (SELECT avg(m) FROM base) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM bt)"
_ROUNDED = "round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high"


def _rounded(row):
    return row.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(PER + ", base AS (SELECT user_id, ndcg AS m FROM per), " + BOOT + f" SELECT {_ROUNDED} FROM ci")
def bootstrap_interval(spark, d):
    return _rounded(E.bootstrap_ci(E.per_user_scores(_scored(spark, d)), "ndcg", n=1000))


@query(PER + ", " + PER_B + ", base AS (SELECT per.user_id, per.ndcg - perb.ndcg AS m FROM per JOIN perb ON perb.user_id = per.user_id), " + BOOT + f" SELECT {_ROUNDED}, low > 0 OR high < 0 AS significant, CASE WHEN NOT (low > 0 OR high < 0) THEN 'tie' WHEN mean > 0 THEN 'a' ELSE 'b' END AS winner FROM ci")
def paired_models(spark, d):
    scored = written(_scored(spark, d), "scored")
    a = E.per_user_scores(scored)
    b = E.per_user_scores(scored.withColumn("pred", F.col("pred") - (F.col("item_id") % 3)))
    return _rounded(E.choose_model(E.paired_delta(a, b, "ndcg", n=1000)))


TOP = "WITH " + SCORED + ", top AS (SELECT t.*, genres FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, item_id) AS r FROM sc) t JOIN items i ON i.item_id = t.item_id WHERE r <= 10)"


def _slates(spark, d):
    return A.top_k(_scored(spark, d), 10, score="pred").join(B.items(spark, d).select("item_id", "genres"), "item_id")


@query(TOP + """, pr AS (SELECT a.user_id, 1 - len(list_intersect(string_split(a.genres, '|'), string_split(b.genres, '|'))) / len(list_distinct(list_concat(string_split(a.genres, '|'), string_split(b.genres, '|')))) AS dd FROM top a JOIN top b ON a.user_id = b.user_id AND a.item_id < b.item_id)
SELECT u.user_id, round(coalesce(v, 0.0), 6) AS ild FROM (SELECT DISTINCT user_id FROM top) u LEFT JOIN (SELECT user_id, avg(dd) AS v FROM pr GROUP BY 1) p ON p.user_id = u.user_id""")
def intra_list_diversity(spark, d):
    return E.intra_list_diversity(_slates(spark, d)).withColumn("ild", F.round("ild", 6))


@query(TOP + ", " + TFIDF + """, sz AS (SELECT user_id, count(*) AS k FROM top GROUP BY 1 HAVING count(*) > 1), dt AS (SELECT a.user_id, sum(x.weight * y.weight) AS s FROM top a JOIN top b ON a.user_id = b.user_id AND a.item_id < b.item_id JOIN terms x ON x.item_id = a.item_id JOIN terms y ON y.item_id = b.item_id AND y.term = x.term GROUP BY 1),
pc AS (SELECT item_id, count(*) AS n FROM interactions GROUP BY 1)
SELECT (SELECT round(avg(1 - coalesce(s, 0.0) / (k * (k - 1) / 2)), 6) FROM sz LEFT JOIN dt ON dt.user_id = sz.user_id) AS diversity, (SELECT round(avg(-log2(coalesce(n, 1) / (SELECT sum(n) FROM pc))), 6) FROM top LEFT JOIN pc ON pc.item_id = top.item_id) AS novelty, (SELECT count(DISTINCT item_id) FROM top) / (SELECT count(*) FROM items ) AS coverage""")
def beyond_accuracy(spark, d):
    pop = A.counts_by(B.interactions(spark, d), "item_id")
    row = E.beyond_accuracy(_slates(spark, d), pop, B.items(spark, d), _genre_terms(spark, d))
    return row.select(F.round("diversity", 6).alias("diversity"), F.round("novelty", 6).alias("novelty"), "coverage")


@query("WITH " + DRAWN.format(n="99", users="last_one ", seen="last_one") + """, pl AS (SELECT user_id, item_id, true AS is_truth FROM last_one UNION ALL SELECT user_id, item_id, false FROM ng), pr AS (SELECT item_id, avg(rating) AS pred FROM train GROUP BY 1), rk AS (SELECT user_id, pl.item_id, is_truth, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(pred, 0.0) DESC, pl.item_id) AS r FROM pl LEFT JOIN pr ON pr.item_id = pl.item_id),
tp AS (SELECT rk.user_id, rk.item_id, string_split(genres, '|') AS g FROM rk JOIN items i ON i.item_id = rk.item_id WHERE r <= 10), pd AS (SELECT a.user_id, avg(1 - len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))) AS v FROM tp a JOIN tp b ON b.user_id = a.user_id AND b.item_id > a.item_id GROUP BY 1), il AS (SELECT u.user_id, coalesce(v, 0.0) AS ild FROM (SELECT DISTINCT user_id FROM tp) u LEFT JOIN pd ON pd.user_id = u.user_id),
base AS (SELECT user_id, CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0.0 END AS m FROM rk WHERE is_truth), """ + BOOT + """
SELECT round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hr, round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0.0 END), 6) AS ndcg, round(avg(CASE WHEN r <= 10 THEN 1 / r ELSE 0.0 END), 6) AS mrr, count(*) AS n_users, (SELECT round(avg(ild), 6) FROM il) AS ild, (SELECT count(DISTINCT item_id) FROM tp) / (SELECT count(*) FROM items ) AS coverage,
(SELECT round(low, 6) FROM ci) AS ndcg_low, (SELECT round(high, 6) FROM ci) AS ndcg_high, (SELECT round(avg(value), 6) FROM log ) AS wait_mean, (SELECT round(quantile_cont(value, 0.95), 6) FROM log ) AS wait_p95 FROM rk WHERE is_truth""")
def evaluate_99(spark, d):
    """The true item among 99 drawn ones, by the items' mean ratings; the log's values stand for waits."""
    train, test = _train_test(spark, d)
    pools = G.negative_pools(test, train, _index(spark, d), exclude="truth")
    scored = pools.join(train.groupBy("item_id").agg(F.avg("rating").alias("pred")), "item_id", "left").fillna({"pred": 0.0})
    row = E.evaluate_pools(scored, B.items(spark, d), waits=B.events(spark, d).select(F.col("value").alias("ms")))
    return row.withColumns({c: F.round(c, 6) for c in row.columns if c not in ("n_users", "coverage")})


@query("WITH " + SIM + """, cf AS (SELECT t.user_id, sim.item_id, round(sum(score), 9) AS score FROM train t JOIN sim ON sim.query_id = t.item_id ANTI JOIN train h ON h.user_id = t.user_id AND h.item_id = sim.item_id GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM cf),
ev AS (SELECT l.user_id, rk.r FROM last_one l JOIN (SELECT DISTINCT user_id FROM cf) c ON c.user_id = l.user_id LEFT JOIN rk ON rk.user_id = l.user_id AND rk.item_id = l.item_id AND r <= 10)
SELECT round(coalesce(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 0.0), 6) AS hr, round(coalesce(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1 / log2(r + 1) END), 0.0), 6) AS ndcg, count(*) AS n_users FROM ev""")
def evaluate_item_cf(spark, d):
    train, test = _train_test(spark, d)
    v = vectors(spark, d)
    row = E.evaluate_item_cf(train, test, R.neighbours(v, v, k=5, normalise=True))
    return row.select(F.round("hr", 6).alias("hr"), F.round("ndcg", 6).alias("ndcg"), "n_users")


#: What a cold user's features come to; the other features are the item's alone.
_COLD = {"overlap": "0.0", "affinity": "0.0", "activity": "1.0", "bias": "0.0", "cb_score": "0.0"}


@query("WITH " + META + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({f'user_id % 5 = 0 AND abs({c} - {_COLD[c]}) > 1e-6' if c in _COLD else 'NOT isfinite(retrieval_score)' if c == 'retrieval_score' else 'false'}) AS n_breaches, count(*) FILTER ({f'user_id % 5 = 0 AND abs({c} - {_COLD[c]}) > 1e-6' if c in _COLD else 'false'}) = 0 AS ok FROM feat" for c in X.RANKING))
def train_serve_parity(spark, d):
    """Serving reads stored tables, one user in five isn't in its profiles yet: those rows are the breaches."""
    train, test = _train_test(spark, d)
    pairs, meta, profiles = test.select("user_id", "item_id"), _meta(spark, d, train), _profiles(spark, d, train)
    trained = X.ranking_features(pairs, meta, profiles)
    served = X.ranking_features(pairs.withColumn("retrieval_score", F.lit(0.5)), written(meta, "serving-items"), written(profiles.filter("user_id % 5 <> 0"), "serving-users"))
    return E.train_serve_parity(trained, served, ["user_id", "item_id"], X.RANKING)


@query("WITH p AS (SELECT item_id, count(*) AS pred FROM train GROUP BY 1), u AS (SELECT DISTINCT user_id FROM last_one) SELECT l.user_id, 1 + count(*) FILTER (s.item_id <> l.item_id AND (s.pred > coalesce(q.pred, 0) OR (s.pred = coalesce(q.pred, 0) AND s.item_id < l.item_id))) AS rank FROM last_one l JOIN u ON u.user_id = l.user_id LEFT JOIN p q ON q.item_id = l.item_id CROSS JOIN p s GROUP BY l.user_id")
def evaluate_full(spark, d):
    train, test = _train_test(spark, d)
    pred = train.groupBy("item_id").agg(F.count("*").alias("pred"))
    return E.shared_ranks(test, pred)


@query("WITH " + SCORED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, item_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS i, CASE WHEN rating >= 4.0 THEN 1 ELSE 0 END AS rel, pow(2.0, rating) - 1 AS g FROM sc), pu AS (SELECT user_id, sum(CASE WHEN r <= 10 THEN rel ELSE 0 END) AS h, sum(rel) AS n, sum(CASE WHEN r <= 10 THEN g / log2(r + 1) ELSE 0.0 END) AS dcg, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0.0 END) AS o FROM rk GROUP BY 1)
SELECT user_id, h / 10 AS precision, CASE WHEN n = 0 THEN 0.0 ELSE round(h / n, 6) END AS recall, CASE WHEN o = 0 THEN 0.0 ELSE round(dcg / o, 6) END AS ndcg FROM pu""")
def precision_recall(spark, d):
    return E.precision_recall(_scored(spark, d)).select("user_id", "precision", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


@query("SELECT event_type, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM log GROUP BY 1")
def latency_stats(spark, d):
    return E.latency_stats(B.events(spark, d), "value", "event_type").select("event_type", F.round("mean", 6).alias("mean"), "p50", F.round("p95", 6).alias("p95"))


GATE = """m AS (SELECT user_id % 7 AS run_id, 'HR@10' AS metric, avg(hit) AS value FROM per GROUP BY 1 UNION ALL SELECT user_id % 7, 'NDCG@10', avg(ndcg) FROM per GROUP BY 1 UNION ALL SELECT user_id % 7, 'n_users', count(*) FROM per GROUP BY 1
UNION ALL SELECT user_id % 7, 'RMSE', sqrt(avg((rating - pred) * (rating - pred))) FROM sc GROUP BY 1 UNION ALL SELECT user_id % 7, 'p95', quantile_cont(value, 0.95) FROM log WHERE user_id % 7 > 0 GROUP BY 1),
ru AS (SELECT unnest(['HR@10', 'NDCG@10', 'n_users', 'RMSE', 'p95']) AS metric, unnest(['min', 'min', 'min', 'max', 'max']) AS kind, unnest([{bounds}]) AS bound)"""
_BOUNDS = [0.15, 0.7, 10.0, 1.16, 160.0]


@query(PER + ", " + GATE.format(bounds=", ".join(map(str, _BOUNDS))) + """, bad AS (SELECT r.run_id, CASE WHEN m.value IS NULL OR (kind = 'min' AND m.value < bound) OR (kind = 'max' AND m.value > bound) THEN ru.metric END AS f FROM (SELECT DISTINCT run_id FROM m) r CROSS JOIN ru LEFT JOIN m ON m.run_id = r.run_id AND m.metric = ru.metric)
SELECT run_id, count(f) = 0 AS passed, coalesce(string_agg(f, ',' ORDER BY f), '') AS failures FROM bad GROUP BY 1""")
def quality_gate(spark, d):
    """Seven runs by users; run 0 has no latency, which is asked for."""
    scored = _scored(spark, d).withColumn("run_id", F.col("user_id") % 7)
    per = E.per_user_scores(scored).withColumn("run_id", F.col("user_id") % 7)
    waits = E.latency_stats(B.events(spark, d).withColumn("run_id", F.col("user_id") % 7).filter("run_id > 0"), "value", "run_id")
    rows = [per.groupBy("run_id").agg(F.avg(c).alias("value")).withColumn("metric", F.lit(name)) for name, c in (("Hit Ratio@10", "hit"), ("NDCG@10", "ndcg"))]
    rows += [per.groupBy("run_id").agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit("n_users"))]
    rows += [scored.groupBy("run_id").agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("pred"), 2))).alias("value")).withColumn("metric", F.lit("RMSE"))]
    rows += [waits.select("run_id", F.col("p95").alias("value"), F.lit("p95").alias("metric"))]
    metrics = rows[0]
    for more in rows[1:]:
        metrics = metrics.unionByName(more)
    rules = spark.createDataFrame(list(zip(("HR@10", "NDCG@10", "n_users", "RMSE", "p95"), ("min", "min", "min", "max", "max"), _BOUNDS, [True] * 5, strict=True)), "metric string, kind string, bound double, required boolean")
    return E.quality_gate(metrics, rules)


#: A third model, half as far off as the first.
CLOSER = PRED.replace("/ 50.0", "/ 100.0")
PER_C = PER_B.replace("scb AS", "scc AS").replace("FROM scb)", "FROM scc)").replace(PRED + " - item_id % 3", CLOSER).replace("rkb AS", "rkc AS").replace("FROM rkb", "FROM rkc").replace("pub AS", "puc AS").replace("FROM pub)", "FROM puc)").replace("perb AS", "perc AS")
_PAIRS = {"a": ("a", "b"), "b": ("b", "a"), "same": ("a", "a"), "c": ("c", "a")}


@query(PER + ", " + PER_B + ", " + PER_C + ", ms AS (" + " UNION ALL ".join(f"SELECT '{n}' AS m, (SELECT sqrt(avg((rating - pred) * (rating - pred))) FROM sc{t}) AS r, (SELECT avg(ndcg) FROM per{t}) AS n" for n, t in (("a", ""), ("b", "b"), ("c", "c"))) + ") " + " UNION ALL ".join(f"SELECT '{name}' AS candidate, x.r <= y.r * 0.995 AND x.n >= y.n * 0.997 AS passed FROM ms x, ms y WHERE x.m = '{one}' AND y.m = '{other}'" for name, (one, other) in _PAIRS.items()))
def gate_vs_incumbent(spark, d):
    """Models against each other: two that fail, one against itself, and one that is better."""
    scored = _scored(spark, d)
    made = {"a": scored, "b": scored.withColumn("pred", F.col("pred") - (F.col("item_id") % 3)), "c": scored.withColumn("pred", F.expr(CLOSER.replace("100.0", "100.0D")))}
    told = {n: written(E.rmse_mae(x).crossJoin(E.ranking_metrics(x)), "metrics") for n, x in made.items()}  # one row each
    out = None
    for name, (one, other) in _PAIRS.items():
        row = E.gate_vs_incumbent(told[one], told[other]).select(F.lit(name).alias("candidate"), "passed")
        out = row if out is None else out.unionByName(row)
    return out


# ---- checks


@query("SELECT count(*) AS n, count(*) FILTER (item_id IS NULL) AS null_ids, count(item_id) - count(DISTINCT item_id) AS repeated_ids, count(*) > 0 AND count(*) FILTER (item_id IS NULL) = 0 AND count(item_id) = count(DISTINCT item_id) AS ok FROM items ")
def check_items(spark, d):
    return E.check_items(B.items(spark, d))


@query("""WITH bad AS (SELECT CASE WHEN user_id % 13 > 0 THEN user_id END AS user_id, item_id, CASE WHEN item_id % 11 = 0 THEN rating + 5 WHEN item_id % 11 > 1 THEN rating END AS rating, CASE WHEN user_id % 7 > 0 THEN ts END AS ts FROM interactions UNION ALL SELECT user_id, item_id, rating, ts FROM interactions WHERE user_id % 17 = 0)
SELECT count(*) AS n, count(*) FILTER (rating IS NULL OR rating < 0.5 OR rating > 5.0) AS out_of_bounds, count(*) FILTER (user_id IS NULL OR item_id IS NULL) AS null_ids, count(ts) AS with_ts, (SELECT count(*) FROM (SELECT 1 FROM bad GROUP BY user_id, item_id HAVING count(*) > 1)) AS repeated_pairs, false AS ok FROM bad""")
def check_ratings(spark, d):
    """Over ratings that have every fault: values beyond the bounds or missing, no user, no time, repeated pairs."""
    r = B.interactions(spark, d)
    bad = r.select(F.when(F.col("user_id") % 13 > 0, F.col("user_id")).alias("user_id"), "item_id", F.when(F.col("item_id") % 11 == 0, F.col("rating") + 5).when(F.col("item_id") % 11 > 1, F.col("rating")).alias("rating"), F.when(F.col("user_id") % 7 > 0, F.col("ts")).alias("ts"))
    return E.check_ratings(bad.unionByName(r.filter("user_id % 17 = 0")))


@query("SELECT count(*) AS n_orphans, (SELECT string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FROM (SELECT DISTINCT item_id FROM log WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_id % 9 > 0) ORDER BY 1 LIMIT 5)) AS examples FROM log WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_id % 9 > 0)")
def check_references(spark, d):
    rows = E.check_references(B.events(spark, d), B.items(spark, d).filter("item_id % 9 > 0"))
    return rows.select("n_orphans", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


#: What becomes of the rating on the side that is watched: itself, moved a little, doubled, and missing for one item in ten.
_DRIFT = {"rating": "rating", "moved": "CASE WHEN user_id % 2 = 0 THEN least(rating + 1.0, 5.0) ELSE rating END", "doubled": "2.0 * rating", "sparse": "CASE WHEN item_id % 10 > 0 THEN rating END"}


def _sql_drift(name, said):
    edges = "(SELECT list_sort(list_distinct(quantile_cont(rating, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM train )"
    place = "CASE WHEN x < e[1] OR x > e[len(e)] THEN NULL WHEN x = e[len(e)] THEN len(e) - 1 ELSE len(list_filter(e, lambda y: y <= x)) END"
    share = lambda rows: f"(SELECT {place} AS bin, count(*) AS c, sum(count(*)) OVER () AS t FROM {rows}, {edges} WHERE x IS NOT NULL GROUP BY 1)"
    psi = f"""SELECT sum((aa - ee) * ln(aa / ee)) AS psi FROM (SELECT greatest(coalesce(fe.c / fe.t, 0), 1e-4) AS ee, greatest(coalesce(fa.c / fa.t, 0), 1e-4) AS aa FROM (SELECT unnest(range(1, len(e))) AS bin FROM {edges}) b
LEFT JOIN {share("(SELECT rating AS x FROM train )")} fe ON fe.bin = b.bin LEFT JOIN {share(f"(SELECT {said} AS x FROM last_one )")} fa ON fa.bin = b.bin)"""
    return f"""SELECT '{name}' AS column_name, round(psi, 6) AS psi, round(nr, 6) AS null_rate, CASE WHEN psi > 0.25 THEN 'DRIFT_ALERT' WHEN psi >= 0.1 THEN 'MODERATE' ELSE 'PASS' END AS status, nr > 0.05 AS null_alert
FROM ({psi}), (SELECT avg(CASE WHEN {said} IS NULL THEN 1.0 ELSE 0.0 END) AS nr FROM last_one )"""


@query(" UNION ALL ".join(_sql_drift(n, e) for n, e in _DRIFT.items()))
def drift_report(spark, d):
    train, test = _train_test(spark, d)
    train, test = (written(x, "drift") for x in (train.select(*[F.col("rating").alias(n) for n in _DRIFT]), test.select(*[F.expr(e).alias(n) for n, e in _DRIFT.items()])))
    return E.drift_report(train, test, list(_DRIFT)).withColumns({"psi": F.round("psi", 6), "null_rate": F.round("null_rate", 6)})


@query("""WITH a AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, avg(rating) AS m FROM interactions GROUP BY 1), b AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, avg(rating) AS m FROM train GROUP BY 1), j AS (SELECT a.n AS an, b.n AS bn, a.m AS am, b.m AS bm FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT 'n' AS column_name, avg(CASE WHEN abs(an - bn) <= 1e-3 * greatest(1.0, abs(an)) THEN 0.0 ELSE 1.0 END) AS mismatch, false AS ok FROM j UNION ALL SELECT 'm', avg(CASE WHEN abs(am - bm) <= 1e-3 * greatest(1.0, abs(am)) THEN 0.0 ELSE 1.0 END), false FROM j""")
def table_parity(spark, d):
    r = B.interactions(spark, d)
    stats = lambda x: x.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("rating").alias("m"))
    return E.table_parity(stats(r), stats(_train_test(spark, d)[0]), "user_id", ["n", "m"])


@query("""WITH bad AS (SELECT comment_id, CASE WHEN comment_id % 19 = 0 THEN item_id + 1 ELSE item_id END AS item_id, CASE WHEN comment_id % 23 = 0 THEN parent_id + 999 ELSE parent_id END AS parent_id, CASE WHEN comment_id % 29 = 0 THEN '  ' WHEN comment_id % 31 = 0 THEN NULL ELSE content END AS content FROM comments )
SELECT count(*) FILTER (trim(coalesce(content, '')) = '') AS blank, count(*) FILTER (c.parent_id IS NOT NULL AND p.comment_id IS NULL) AS orphans, count(*) FILTER (p.item_id <> c.item_id) AS other_item FROM bad c LEFT JOIN (SELECT comment_id, item_id FROM bad) p ON p.comment_id = c.parent_id""")
def check_threads(spark, d):
    """Over comments that have every fault: no text, a parent that isn't there, a parent under another item."""
    c, key = B.comments(spark, d), F.col("comment_id")
    bad = c.withColumns({"item_id": F.when(key % 19 == 0, F.col("item_id") + 1).otherwise(F.col("item_id")), "parent_id": F.when(key % 23 == 0, F.col("parent_id") + 999).otherwise(F.col("parent_id")), "content": F.when(key % 29 == 0, F.lit("  ")).when(key % 31 != 0, F.col("content"))})
    return E.check_threads(bad)


@query("SELECT 'director' AS column_name, count(DISTINCT director) AS n, true AS ok FROM items UNION ALL SELECT 'genres', count(DISTINCT genres), true FROM items UNION ALL SELECT 'tagline', count(DISTINCT CASE WHEN item_id < 0 THEN title END), count(CASE WHEN item_id < 0 THEN title END) > 0 FROM items ")
def check_vocabulary(spark, d):
    rows = B.items(spark, d).withColumn("tagline", F.when(F.col("item_id") < 0, F.col("title")))
    return E.check_vocabulary(rows, ["director", "genres", "tagline"])


@query("SELECT 'reloaded' AS model, 0.0 AS mismatch, true AS ok UNION ALL SELECT 'changed', round(avg(CASE WHEN item_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 6), false FROM items ")
def prediction_parity(spark, d):
    """A saved model's scores, row by row, against those of the model read back, and of one that has changed for one item in four."""
    import uuid

    from pyspark.ml import PipelineModel

    from slatewise.session import scratch_dir

    items = B.items(spark, d)
    train = items.select("item_id", F.col("popularity").alias("label"), (F.col("item_id") % 97).cast("double").alias("x"))
    model = X.fit_ranker(train, columns=["x"], iterations=2, depth=2)
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    model.save(path)
    back = PipelineModel.load(path)
    name = lambda m: m.transform(train).select("item_id", F.col("prediction").alias("score"))
    changed = name(back).withColumn("score", F.when(F.col("item_id") % 4 == 0, F.col("score") + 1).otherwise(F.col("score")))
    told = [E.table_parity(name(model), x, "item_id", ["score"], tolerance=1e-6, allowed=0.0).select(F.lit(n).alias("model"), F.round("mismatch", 6).alias("mismatch"), "ok") for n, x in (("reloaded", name(back)), ("changed", changed))]
    return told[0].unionByName(told[1])


@query("SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1")
def group_sizes(spark, d):
    return A.counts_by(table(spark, d, "labels").withColumnRenamed("quality", "label"), "label")


@query("WITH " + SCORED + " SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pred DESC, item_id) AS INTEGER) AS rank FROM sc")
def slate_ranks(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("pred"), "item_id")
    return _scored(spark, d).select("user_id", "item_id", F.row_number().over(order).alias("rank"))
