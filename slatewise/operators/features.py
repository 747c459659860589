"""Ranking features, rankers, scoring and re-ranking of slates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import aggregates as A
from slatewise.operators import retrieval as R
from slatewise.session import written

RANKING = ["popularity", "vote_average", "bayes", "overlap", "affinity", "year", "decay", "activity", "bias", "retrieval_score", "cb_score"]


def item_meta(items: DataFrame, stats: DataFrame, *, ref_year: int = 2024) -> DataFrame:
    """One row per item: popularity, votes, Bayesian rating, year, decay, genre list."""
    year = S.release_year(F.col("release_date"), F.col("title"))
    rows = items.drop("popularity").join(stats, "item_id", "left")
    pop = F.coalesce(F.col("popularity").cast("double"), F.lit(1.0))
    votes = F.coalesce(F.col("vote_count").cast("double"), F.col("popularity").cast("double"), F.lit(10.0))
    mean = F.coalesce("vote_average", F.lit(5.0))
    return rows.select("item_id", pop.alias("popularity"), mean.alias("vote_average"), votes.alias("vote_count"), S.bayesian_rating(votes, mean).alias("bayes"), year.cast("double").alias("year"), S.recency_decay(year, ref_year=ref_year).alias("decay"), F.split("genres", r"\|").alias("genre_list"))


def _with_vector(rows: DataFrame, name: str) -> DataFrame:
    """`als_vec` under another name; null where there is none."""
    if "als_vec" in rows.columns:
        return rows.withColumnRenamed("als_vec", name)
    return rows.withColumn(name, F.lit(None).cast("array<double>"))


def ranking_features(pairs: DataFrame, meta: DataFrame, profiles: DataFrame, *, ref_year: int = 2024) -> DataFrame:
    """The 11 features of each (user_id, item_id[, retrieval_score]) pair; one function for training and scoring.

    retrieval_score is the pair's own; where that is absent, the product of the two sides' `als_vec`, if both have one; else 0.
    cb_score is the genre affinity. An unknown item has popularity 1, vote 5 and year 2010, an unknown user activity 1 and bias 0.
    """
    keep = [c for c in pairs.columns if c != "retrieval_score"]
    meta, profiles = _with_vector(meta, "_item_vec"), _with_vector(profiles, "_user_vec")
    rows = pairs if "retrieval_score" in pairs.columns else pairs.withColumn("retrieval_score", F.lit(None).cast("double"))
    # both sides grow with the catalogue and the users; what their lists and vectors come to isn't in the planner's sizes, which would broadcast them
    rows = rows.join(meta.hint("merge"), "item_id", "left").join(profiles.hint("merge"), "user_id", "left")
    empty = F.array().cast("array<string>")
    mine, its = F.coalesce("genre_set", empty), F.coalesce("genre_list", empty)
    product = S.dot(F.col("_item_vec").cast("array<double>"), F.col("_user_vec").cast("array<double>"))
    year = F.coalesce(F.col("year").cast("double"), F.lit(2010.0))
    made = {
        "popularity": F.coalesce(F.col("popularity").cast("double"), F.lit(1.0)),
        "vote_average": F.coalesce(F.col("vote_average").cast("double"), F.lit(5.0)),
        "bayes": F.coalesce(F.col("bayes").cast("double"), F.col("vote_average").cast("double"), F.lit(5.0)),
        "overlap": S.genre_overlap(its, mine).cast("double"),
        "affinity": S.genre_affinity(its, mine),
        "year": year,
        "decay": F.coalesce(F.col("decay").cast("double"), S.recency_decay(year, ref_year=ref_year)),
        "activity": F.coalesce(F.col("activity").cast("double"), F.lit(1.0)),
        "bias": F.coalesce(F.col("bias").cast("double"), F.lit(0.0)),
        "retrieval_score": F.coalesce(F.col("retrieval_score").cast("double"), product, F.lit(0.0)),
        "cb_score": S.genre_affinity(its, mine),
    }
    return rows.select(*keep, *[made[c].cast("double").alias(c) for c in RANKING])


def ranking_train_set(positives: DataFrame, negatives: DataFrame, meta: DataFrame, profiles: DataFrame, *, least: int = 2) -> DataFrame:
    """Positives by graded label and negatives by 0, users with `least` or more positives, with features."""
    enough = positives.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("user_id")
    rows = positives.select("user_id", "item_id", S.graded_label(F.col("rating")).alias("label")).unionByName(negatives.select("user_id", "item_id", F.lit(0).alias("label")))
    return ranking_features(rows.join(enough, "user_id", "left_semi"), meta, profiles)


def fit_ranker(train: DataFrame, *, columns: list[str] | None = None, iterations: int = 10, depth: int = 4, label: str = "label", seed: int = 42, validation: str | None = None) -> PipelineModel:
    """Boosted trees on the label; with a validation column fitting stops early."""
    gbt = GBTRegressor(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=columns or RANKING, outputCol="features", handleInvalid="keep"), gbt]).fit(train)


def fit_pairwise(train: DataFrame, *, columns: list[str] | None = None, pairs: int = 10) -> LogisticRegressionModel:
    """Pairwise ranking: differences of features within a user, weighed by how much their swap moves NDCG.

    Each row meets the `pairs` rows that follow it in hashed order in its group, so a group of n rows gives n x pairs pairs.
    """
    columns = columns or RANKING
    order = Window.partitionBy("user_id").orderBy(F.hash("item_id"), "item_id")
    best = Window.partitionBy("user_id").orderBy(F.desc("label"), "item_id")
    rows = train.withColumn("_ideal", F.row_number().over(best))
    after = F.collect_list(F.struct("label", "_ideal", *columns)).over(order.rowsBetween(1, pairs))  # at most `pairs` rows, so no join of the set with itself
    both = rows.select(F.col("label").alias("_l"), F.col("_ideal").alias("_i"), *[F.col(c).alias(f"_{c}") for c in columns], after.alias("_after"))
    both = both.withColumn("_after", F.explode("_after")).select(*[c for c in both.columns if c != "_after"], "_after.*").filter("label <> _l")
    gain = F.abs(F.pow(F.lit(2.0), "label") - F.pow(F.lit(2.0), "_l")) * F.abs(1 / F.log2(F.col("_ideal") + 1) - 1 / F.log2(F.col("_i") + 1))
    diffs = both.select((F.col("label") > F.col("_l")).cast("double").alias("win"), F.greatest(gain, F.lit(1e-6)).alias("w"), *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in columns])
    diffs = written(diffs, "pairs")  # fitting reads them twice
    ready = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(diffs)
    return LogisticRegression(labelCol="win", weightCol="w", fitIntercept=False, maxIter=20, regParam=0.01).fit(ready)


#: The columns of a rating data set beside its genre flags, first those that are categories.
CATEGORIES = ["item_id", "user_id", "primary_director", "primary_actor"]
NUMBERS = ["popularity", "vote_average", "vote_count", "adult", "year", "month", "decade", "n_genres", "n_cast", "n_keywords", "overview_len", "user_mean", "user_std", "user_count", "mean_popularity", "mean_vote_average", "mean_year", "year_match", "genre_match_score"]


def movie_features(items: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Year, month, decade, list sizes, text length, primary names, counts and genre flags of flat items.

    `overview`, `cast`, `keywords`, `adult`, `popularity`, `vote_average` and `vote_count` may be absent: an absent list is
    empty, an absent overview is the title, absent numbers are null, and what isn't said to be for adults isn't.
    """
    has = lambda c, otherwise: F.col(c) if c in items.columns else otherwise
    none = F.lit(None).cast("string")
    genres, cast, keywords = S.parse_list(F.col("genres")), S.parse_list(has("cast", none)), S.parse_list(has("keywords", none))
    year = S.release_year(F.col("release_date"), F.col("title"))
    numbers = [has(c, none).try_cast("double").alias(c) for c in ("popularity", "vote_average", "vote_count")]
    sizes = [F.size(genres).alias("n_genres"), F.size(cast).alias("n_cast"), F.size(keywords).alias("n_keywords"), F.length(F.coalesce(has("overview", F.col("title")), F.lit(""))).alias("overview_len")]
    names = [S.first_or_unknown(S.parse_list(F.col("director"))).alias("primary_director"), S.first_or_unknown(cast).alias("primary_actor")]
    return items.select("item_id", *numbers, S.parse_bool(has("adult", none)).cast("int").alias("adult"), year.alias("year"), F.coalesce(S.release_month(F.col("release_date")), F.lit(0)).alias("month"), S.release_decade(year).alias("decade"), *sizes, *names, *S.multi_hot(genres, vocabulary))


def _once(rows: DataFrame, *key: str) -> None:
    """Refuse rows whose key comes twice."""
    twice = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key).first()
    if twice is not None:
        raise ValueError(f"{', '.join(key)} {tuple(twice)} comes more than once")


def rating_dataset(ratings: DataFrame, item_features: DataFrame, user_features: DataFrame, preferences: DataFrame, vocabulary: list[str]) -> DataFrame:
    """`rating` with CATEGORIES, NUMBERS and genre flags: both sides' features, the year's distance and the preference-weighted genre match.

    A pair, an item or a user that comes more than once would multiply rows, and a column that two sides have would be
    ambiguous: both raise ValueError. An item or user without features has nulls, and 0 as genre match.
    """
    sides = [item_features.drop("item_id"), user_features.drop("user_id"), preferences.drop("user_id"), ratings.select("rating")]
    names = [c for side in sides for c in side.columns]
    clashing = sorted({c for c in names if names.count(c) > 1})
    if clashing:
        raise ValueError(f"columns of more than one side: {clashing}")
    for rows, key in ((ratings, ["user_id", "item_id"]), (item_features, ["item_id"]), (user_features, ["user_id"]), (preferences, ["user_id"])):
        _once(rows, *key)
    rows = ratings.select("user_id", "item_id", "rating").join(item_features, "item_id", "left").join(user_features, "user_id", "left").join(preferences, "user_id", "left")
    flags, prefs = (F.array(*[F.coalesce(F.col(f"{p}_{g}").cast("double"), F.lit(0.0)) for g in vocabulary]) for p in ("genre", "pref"))
    rows = rows.withColumn("year_match", S.year_match(F.col("year"), F.col("mean_year"))).withColumn("genre_match_score", S.genre_match(flags, prefs))
    return rows.select("rating", *CATEGORIES, *NUMBERS, *[f"genre_{g}" for g in vocabulary])


def freeze_vocabulary(train: DataFrame, columns: list[str]) -> PipelineModel:
    """Category codes learned from training rows; an unseen value gets a code of its own."""
    return Pipeline(stages=[StringIndexer(inputCols=columns, outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep")]).fit(train)


def blend(scores: DataFrame, *, weights: tuple[float, float] = (0.6, 0.4), fallback: str = "popularity") -> DataFrame:
    """Weighted scores of two models; one alone where the other is missing; the fallback where both are."""
    a, b = F.col("score_a"), F.col("score_b")
    both = (weights[0] * a + weights[1] * b) / sum(weights)
    return scores.withColumn("score", F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b, F.col(fallback).cast("double"))))


def heuristic_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", 10 * F.col("overlap") + 5 * F.col("retrieval_score") + 0.5 * F.col("vote_average"))


def rank_candidates(scored: DataFrame, items: DataFrame) -> DataFrame:
    """Known items only, by score then popularity; the source tag stays."""
    rows = scored.join(items.select("item_id"), "item_id", "left_semi")
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("popularity"), "item_id")
    return rows.withColumn("rank", F.row_number().over(order))


def recommend_all(users: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """Top k of the whole catalogue per user by `user_bias` and `item_score`, exact, without scoring every pair.

    The k-th best `item_score` is a floor: overlap only adds, 0.1 a genre, so an item below it needs so many shared genres
    to come among a user's k. One that needs r of its m genres shares one of any m - r + 1 of them, so it is found by its
    rarest ones. Items without a shared genre are the same for all users: the best k, and their equals to 9 digits.
    """
    best = items.select("item_score").orderBy(F.desc("item_score")).limit(k)  # k rows
    floor = F.broadcast(best.agg(F.when(F.count("*") == k, F.min("item_score") - 2e-9).alias("_floor")))
    own = items.select("item_id", "item_score", "genre_list", F.array_distinct(F.coalesce("genre_list", F.array().cast("array<string>"))).alias("_g")).crossJoin(floor)
    equals = Window.partitionBy("_s").orderBy("item_id")
    top = own.filter(F.col("_floor").isNull() | (F.col("item_score") >= F.col("_floor"))).withColumn("_s", F.round("item_score", 9)).withColumn("_k", F.row_number().over(equals)).filter(F.col("_k") <= k)
    overlap = S.genre_overlap(F.col("genre_list"), F.col("genre_set"))
    alike = users.select("user_id", "user_bias", "genre_set").crossJoin(F.broadcast(top.select("item_id", "item_score", "genre_list"))).withColumn("_o", overlap).filter("_o <= 0")

    wanted = users.select("user_id", "user_bias", "genre_set", F.explode(F.array_distinct("genre_set")).alias("_genre"))
    asked = wanted.groupBy("_genre").agg(F.count("*").alias("_n"))
    need = F.greatest(F.lit(1), F.coalesce(F.ceil((F.col("_floor") - F.col("item_score")) / 0.1 - 1e-6), F.lit(1)))
    keyed = own.withColumn("_most", F.size("_g") - need + 1).filter("_most > 0").select("item_id", "item_score", "genre_list", "_floor", "_most", F.explode("_g").alias("_genre")).join(asked, "_genre", "left")
    rare = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("_n", F.lit(0)), "_genre"))
    keyed = keyed.withColumn("_r", rare).filter("_r <= _most").withColumn("_keys", F.collect_list("_genre").over(Window.partitionBy("item_id"))).filter("_n is not null")
    # a pair is taken at the first of the item's keys that the user has
    pairs = wanted.join(keyed, "_genre").filter(F.element_at(F.array_intersect("_keys", "genre_set"), 1) == F.col("_genre")).withColumn("_o", overlap)
    pairs = pairs.filter(F.col("_floor").isNull() | (F.col("item_score") + 0.1 * F.col("_o") >= F.col("_floor") - 1e-9))

    columns = ["user_id", "item_id", F.round(F.col("item_score") + F.col("user_bias") + 0.1 * F.col("_o"), 9).alias("score")]
    rank = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return alike.select(*columns).unionByName(pairs.select(*columns)).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def mmr(slates: DataFrame, *, limit: int = 10, pool: int | None = None, epsilon: float = 1e-6, terms: DataFrame | None = None) -> DataFrame:
    """(slate_id, item_id, rank): greedy trade of relevance against likeness to what is chosen.

    slates: (slate_id, item_id, genres, score, lambda), one short list each; `pool` keeps its best rows only, None takes
    them all. Likeness is the Jaccard of genres, or with `terms` (item_id, term, weight; rows of length 1, few terms an
    item) their cosine, which is 0 for items without terms. Values count to 9 digits; the first of equals in
    (score, item) order wins.
    """
    none = F.array().cast("array<string>")
    rows = slates.select("slate_id", "item_id", "genres", "score", "lambda")
    if terms is None:
        rows = rows.withColumn("_t", F.coalesce(F.array_distinct(F.split("genres", r"\|")), none)).withColumn("_w", F.transform("_t", lambda x: F.lit(1.0)))
    else:
        lists = terms.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_l"))
        rows = rows.join(lists.hint("merge"), "item_id", "left").withColumns({"_t": F.coalesce(F.col("_l.term"), none), "_w": F.coalesce(F.col("_l.weight"), F.array().cast("array<double>"))})
    order = Window.partitionBy("slate_id").orderBy(F.desc("score"), "item_id")
    rows = rows.withColumn("_r", F.row_number().over(order))
    rows = rows if pool is None else rows.filter(F.col("_r") <= pool)
    whole = rows.groupBy("slate_id").agg(F.first("lambda").cast("double").alias("lambda"), F.array_sort(F.collect_list(F.struct("_r", F.col("item_id").cast("long").alias("item_id"), F.col("score").cast("double").alias("score"), "_t", F.col("_w").cast("array<double>").alias("_w")))).alias("_l"))
    jaccard = terms is None  # a frame can't go to the tasks

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, lam = batch.column("slate_id").to_numpy(), batch.column("lambda").to_numpy()
                slate, item, rank = _picked(batch.column("_l"), lam, limit, epsilon, jaccard)
                yield pa.RecordBatch.from_arrays([pa.array(ids[slate]), pa.array(item), pa.array(rank)], names=["slate_id", "item_id", "rank"])

    return whole.select(F.col("slate_id").cast("long").alias("slate_id"), "lambda", "_l").mapInArrow(pick, "slate_id long, item_id long, rank int")


#: Numbers of one array of slates that are re-ranked at once.
SLATE_CELLS = 1 << 21


def _picked(lists: pa.ListArray, lam: np.ndarray, limit: int, epsilon: float, jaccard: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slate, item, rank) of many slates: those of like length are padded to one and chosen from step by step together."""
    sizes, rows = lists.value_lengths().to_numpy(), lists.flatten()
    item, score, words = rows.field("item_id").to_numpy(), rows.field("score").to_numpy(), rows.field("_t")
    per, codes, weight = words.value_lengths().to_numpy(), words.flatten().dictionary_encode().indices.to_numpy(), rows.field("_w").flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    slate_of = np.repeat(np.arange(len(sizes)), sizes)
    row_of = np.repeat(np.arange(len(item)), per)
    # a slate's terms are numbered within it
    keys, place = np.unique(slate_of[row_of] * (codes.max(initial=0) + 1) + codes, return_inverse=True)
    owner = keys // (codes.max(initial=0) + 1)
    term = place - np.searchsorted(owner, slate_of[row_of])
    n_terms = np.bincount(owner, minlength=len(sizes))
    entries = np.bincount(slate_of[row_of], minlength=len(sizes))
    firsts = np.cumsum(entries) - entries
    spread = lambda first, count: np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    out, order, at = [], np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        few = order[at:]
        cells = np.arange(1, len(few) + 1) * sizes[few] * np.maximum(1, np.maximum.accumulate(n_terms[few]))
        few = few[: max(1, int(np.searchsorted(cells, SLATE_CELLS)))]
        at += len(few)
        length, b = int(sizes[few].max()), np.arange(len(few))
        r, e = spread(starts[few], sizes[few]), spread(firsts[few], entries[few])
        own, column = np.repeat(b, sizes[few]), r - np.repeat(starts[few], sizes[few])
        m = np.zeros((len(few), length, max(1, int(n_terms[few].max()))))
        m[np.repeat(b, entries[few]), row_of[e] - np.repeat(starts[few], entries[few]), term[e]] = weight[e]
        free = np.zeros((len(few), length), dtype=bool)
        free[own, column] = True
        value = np.full((len(few), length), np.nan)
        value[own, column] = score[r]
        low, high = np.nanmin(value, axis=1)[:, None], np.nanmax(value, axis=1)[:, None]
        rel = np.where(high == low, 1.0, (value - low) / np.where(high == low, 1.0, high - low + epsilon))
        share, size, like = lam[few][:, None], m.sum(axis=2), np.zeros((len(few), length))
        for step in range(min(limit, length)):
            value = np.round(share * rel - (1 - share) * like, 9) if step else rel
            best, open_ = np.argmax(np.where(free, value, -np.inf), axis=1), free.any(axis=1)
            free[b, best] = False
            out.append((few[open_], item[starts[few[open_]] + best[open_]], np.full(int(open_.sum()), step + 1, dtype=np.int32)))
            common = (m @ m[b, best][:, :, None])[:, :, 0]
            if jaccard:
                either = size + size[b, best][:, None] - common
                common = common / np.where(either == 0, 1, either)
            like = np.maximum(like, common)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def recommend(channels: list[DataFrame], users: DataFrame, history: DataFrame, popular_items: DataFrame, items: DataFrame, score: Callable[[DataFrame], DataFrame], weights: DataFrame, terms: DataFrame, *, pool: int = 250, limit: int = 10, default_weight: float = 0.7) -> DataFrame:
    """(user_id, item_id, rank, source): retrieval channels fused, ranked and re-ranked into a slate for every user.

    channels: (user_id, item_id, score) each, fused by reciprocal ranks, of which the best `pool` stay. A user whom no
    channel serves has `popular_items` (item_id, a short list), without what is in their history; one who has seen all of
    those has no slate. `score` adds a `score` column to (user_id, item_id, source) rows, so that any ranker fits.
    Items that the catalogue lacks are left out. weights: (user_id, lambda).
    """
    fused = A.top_k(R.rank_fusion(*channels), pool).select("user_id", "item_id", F.lit("retrieved").alias("source"))
    # no side that grows is broadcast: what a file holds says little of what it takes in the driver's memory
    fused = written(fused.join(items.select("item_id").hint("merge"), "item_id", "left_semi").select("user_id", "item_id", "source"), "fused")
    bare = users.select("user_id").distinct().join(fused.select("user_id").distinct(), "user_id", "left_anti")
    fall_back = A.exclude_seen(bare.crossJoin(F.broadcast(popular_items.select("item_id"))), history).select("user_id", "item_id", F.lit("popular").alias("source"))
    candidates = written(score(fused.unionByName(fall_back)).select("user_id", "item_id", "source", F.col("score").cast("double").alias("score")), "candidates")
    slates = candidates.join(items.select("item_id", "genres").hint("merge"), "item_id").join(weights.hint("merge"), "user_id", "left")
    slates = slates.select(F.col("user_id").alias("slate_id"), "item_id", F.coalesce("genres", F.lit("")).alias("genres"), "score", F.coalesce("lambda", F.lit(default_weight)).alias("lambda"))
    best = mmr(slates, limit=limit, epsilon=0.0, terms=terms).withColumnRenamed("slate_id", "user_id")
    return best.join(candidates.select("user_id", "item_id", "source").hint("merge"), ["user_id", "item_id"])


def tune(train: DataFrame, valid: DataFrame, *, columns: list[str], depths: tuple[int, ...] = (2, 4), label: str = "rating") -> DataFrame:
    """(depth, rmse) of boosted trees over a grid on fixed frames, best first."""
    spark = train.sparkSession
    found = []
    for depth in depths:
        model = fit_ranker(train, columns=columns, iterations=4, depth=depth, label=label)
        rmse = model.transform(valid).agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)))).first()[0]
        found.append((depth, float(rmse)))
    return spark.createDataFrame(sorted(found, key=lambda x: x[1]), "depth int, rmse double")


def feature_importance(model: PipelineModel, train: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted ranker."""
    assembler, gbt = model.stages
    assert isinstance(gbt, GBTRegressionModel)
    pairs = [(n, float(v)) for n, v in zip(assembler.getInputCols(), gbt.featureImportances.toArray(), strict=True)]
    return train.sparkSession.createDataFrame(pairs, "feature string, importance double")
