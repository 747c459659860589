"""Rating and ranking metrics, intervals, gates, and data checks."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators.aggregates import dense_ids, paired_scores
from slatewise.operators.retrieval import item_cf_scores
from slatewise.operators.quantiles import exact_quantiles
from slatewise.session import written

MAX_DOUBLE = sys.float_info.max


def rmse_mae(scored: DataFrame, *, label: str = "rating", pred: str = "pred") -> DataFrame:
    e = F.col(label) - F.col(pred)
    return scored.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def per_user_scores(scored: DataFrame, *, k: int = 10, relevant: float = 4.0) -> DataFrame:
    """(user_id, hit, ndcg, rr): binary gains, the ideal from the same pool, reciprocal rank over the full list; users without a relevant item are absent."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pred"), "item_id"))
    rows = scored.withColumn("_r", rank).withColumn("_rel", (F.col("rating") >= relevant).cast("int"))
    gain = F.when(F.col("_r") <= k, F.col("_rel") / F.log2(F.col("_r") + 1)).otherwise(0.0)
    per = rows.groupBy("user_id").agg(F.max(F.when(F.col("_r") <= k, F.col("_rel")).otherwise(0)).alias("_hit"), F.sum(gain).alias("_dcg"), F.min(F.when(F.col("_rel") == 1, F.col("_r"))).alias("_first"), F.sum("_rel").alias("_n")).filter("_n > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select("user_id", F.col("_hit").cast("double").alias("hit"), (F.col("_dcg") / ideal).alias("ndcg"), (1 / F.col("_first")).alias("rr"))


def ranking_metrics(scored: DataFrame, *, k: int = 10, relevant: float = 4.0) -> DataFrame:
    """Means over users with a relevant item, and how many were evaluated and skipped."""
    per = per_user_scores(scored, k=k, relevant=relevant)
    users = scored.agg(F.countDistinct("user_id").alias("_all"))
    row = per.agg(F.avg("hit").alias("hr"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.count("*").alias("n_users"))
    return row.crossJoin(users).select("hr", "ndcg", "mrr", "n_users", (F.col("_all") - F.col("n_users")).alias("n_skipped"))  # one row each


#: The distribution of Poisson(1) at 0, 1, ..., 6.
POISSON_EDGES = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]


def _poisson(digits: Column) -> Column:
    """Poisson(1) draw from the number whose hexadecimal digits behind the point these are: how many edges it passes, told by 12 digits as in `draw`."""
    return sum(((digits >= f"{math.ceil(e * (1 << 48)):012x}").cast("int") for e in POISSON_EDGES), F.lit(0))


def bootstrap_ci(per_user: DataFrame, metric: str, *, n: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(mean, low, high) over users by a Poisson bootstrap with hashed weights."""
    rows = per_user.select("user_id", F.col(metric).alias("_m"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rep"))
    digits = F.md5(F.concat_ws("|", "user_id", "rep", F.lit(str(seed))).cast("binary"))
    sums = rows.withColumn("_w", _poisson(digits)).groupBy("rep").agg((F.sum(F.col("_w") * F.col("_m")) / F.sum("_w")).alias("_v"))
    return per_user.agg(F.avg(metric).alias("mean")).crossJoin(sums.agg(F.percentile("_v", F.lit(alpha / 2)).alias("low"), F.percentile("_v", F.lit(1 - alpha / 2)).alias("high")))


def paired_delta(a: DataFrame, b: DataFrame, metric: str, *, n: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Interval of the mean difference a - b over common users; significant if 0 is outside."""
    both = paired_scores(a, b, metric).select("user_id", (F.col("a") - F.col("b")).alias("delta"))
    return bootstrap_ci(both, "delta", n=n, alpha=alpha, seed=seed).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def choose_model(delta: DataFrame, *, first: str = "a", second: str = "b") -> DataFrame:
    return delta.withColumn("winner", F.when(~F.col("significant"), "tie").when(F.col("mean") > 0, first).otherwise(second))


def slate_pairs(slates: DataFrame) -> DataFrame:
    a = slates.select("user_id", F.col("item_id").alias("a"), F.col("genres").alias("ga"))
    b = slates.select("user_id", F.col("item_id").alias("b"), F.col("genres").alias("gb"))
    return a.join(b, "user_id").filter("a < b")


def intra_list_diversity(slates: DataFrame) -> DataFrame:
    """(user_id, ild): mean of 1 - Jaccard of genres over a slate's pairs (at most k x k / 2); one item gives 0."""
    pairs = slate_pairs(slates).select("user_id", (1 - S.jaccard(F.split("ga", r"\|"), F.split("gb", r"\|"))).alias("_d"))
    per = pairs.groupBy("user_id").agg(F.avg("_d").alias("ild"))
    return slates.select("user_id").distinct().join(per, "user_id", "left").select("user_id", F.coalesce("ild", F.lit(0.0)).alias("ild"))


def beyond_accuracy(slates: DataFrame, popularity: DataFrame, items: DataFrame, terms: DataFrame) -> DataFrame:
    """Diversity (1 - cosine of genre weights), novelty (-log2 of popularity share, unseen items 1 / n) and coverage within the catalogue."""
    t = terms.select("item_id", "term", "weight")
    a = slates.select("user_id", "item_id").join(t, "item_id").select("user_id", F.col("item_id").alias("a"), "term", F.col("weight").alias("wa"))
    b = slates.select("user_id", "item_id").join(t, "item_id").select("user_id", F.col("item_id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = a.join(b, ["user_id", "term"]).filter("a < b").groupBy("user_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("_dot"))
    sizes = slates.groupBy("user_id").agg(F.count("*").alias("_k")).filter("_k > 1")
    sims = dots.groupBy("user_id").agg(F.sum("_dot").alias("_s"))
    diversity = sizes.join(sims, "user_id", "left").agg(F.avg(1 - F.coalesce("_s", F.lit(0.0)) / (F.col("_k") * (F.col("_k") - 1) / 2)).alias("diversity"))
    total = popularity.agg(F.sum("n").alias("_all"))
    share = F.coalesce(F.col("n"), F.lit(1)) / F.col("_all")
    novelty = slates.select("item_id").join(popularity, "item_id", "left").crossJoin(F.broadcast(total)).agg(F.avg(-F.log2(share)).alias("novelty"))
    known = slates.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_semi").agg(F.count("*").alias("_c"))
    coverage = known.crossJoin(items.agg(F.count("*").alias("_n"))).select((F.col("_c") / F.col("_n")).alias("coverage"))
    return diversity.crossJoin(novelty).crossJoin(coverage)  # one row each


def evaluate_loo(pools: DataFrame, *, k: int = 10) -> DataFrame:
    """HR, NDCG and MRR at k from the rank of the one true item in each pool (user_id, item_id, is_truth, pred)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pred"), "item_id"))
    r = pools.withColumn("_r", rank).filter("is_truth")
    inside = F.col("_r") <= k
    return r.agg(F.avg(inside.cast("double")).alias("hr"), F.avg(F.when(inside, 1 / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias("ndcg"), F.avg(F.when(inside, 1 / F.col("_r")).otherwise(0.0)).alias("mrr"), F.count("*").alias("n_users"))


def evaluate_pools(pools: DataFrame, items: DataFrame, *, k: int = 10, n: int = 1000, waits: DataFrame | None = None) -> DataFrame:
    """One row on pools (user_id, item_id, is_truth, pred), of one true item a user: hr, ndcg, mrr and n_users as `evaluate_loo`
    has them, ild (mean of the users' lists of k), coverage (share of the catalogue that some list holds), ndcg_low and ndcg_high
    (a bootstrap over users with n replicas), and with `waits` (one column ms) wait_mean and wait_p95.

    items: (item_id, genres). Items outside the catalogue count for neither diversity nor coverage; without pools all but n_users are null or 0.
    """
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pred"), "item_id"))
    ranked = written(pools.select("user_id", "item_id", "is_truth", rank.alias("_r")).filter((F.col("_r") <= k) | F.col("is_truth")), "ranked-pools")
    truth = ranked.filter("is_truth")
    inside = F.col("_r") <= k
    per = truth.select("user_id", inside.cast("double").alias("hit"), F.when(inside, 1 / F.log2(F.col("_r") + 1)).otherwise(0.0).alias("ndcg"), F.when(inside, 1 / F.col("_r")).otherwise(0.0).alias("rr"))
    row = per.agg(F.avg("hit").alias("hr"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.count("*").alias("n_users"))
    slates = ranked.filter(inside).join(items.select("item_id", F.coalesce("genres", F.lit("")).alias("genres")), "item_id")
    spread = intra_list_diversity(slates).agg(F.avg("ild").alias("ild"))
    covered = slates.agg(F.countDistinct("item_id").alias("_c")).crossJoin(items.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))).select((F.col("_c") / F.col("_n")).alias("coverage"))
    interval = bootstrap_ci(per, "ndcg", n=n).select(F.col("low").alias("ndcg_low"), F.col("high").alias("ndcg_high"))
    row = row.crossJoin(spread).crossJoin(covered).crossJoin(interval)  # one row each
    if waits is not None:
        row = row.crossJoin(latency_stats(waits, "ms").select(F.col("mean").alias("wait_mean"), F.col("p95").alias("wait_p95")))
    return row


def evaluate_item_cf(train: DataFrame, truth: DataFrame, similar: DataFrame, *, k: int = 10) -> DataFrame:
    """HR and NDCG at k of each user's hidden item (user_id, item_id) in the list of summed similarities to the rest of their items.

    Users without other items or without candidates aren't evaluated; with none at all both are 0. Equal sums (to 9 digits) go to the
    smaller id. `similar` is (query_id, item_id, score), short lists.
    """
    scores = item_cf_scores(train, similar).withColumn("score", F.round("score", 9))
    best = scores.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))).filter(F.col("_r") <= k)
    found = best.groupBy("user_id").agg(F.collect_list(F.struct("item_id", "_r")).alias("_top"))
    rank = F.try_element_at(F.map_from_entries("_top"), F.col("item_id"))
    gain = truth.select("user_id", "item_id").join(found, "user_id").select(rank.isNotNull().cast("double").alias("_hit"), F.coalesce(1 / F.log2(rank + 1), F.lit(0.0)).alias("_g"))
    return gain.agg(F.coalesce(F.avg("_hit"), F.lit(0.0)).alias("hr"), F.coalesce(F.avg("_g"), F.lit(0.0)).alias("ndcg"), F.count("*").alias("n_users"))


def truth_ranks(truth: DataFrame, scored: DataFrame) -> DataFrame:
    """(user_id, rank): 1 + how many rows of `scored` beat the truth (user_id, item_id, pred), without storing or sorting them."""
    t = truth.select("user_id", F.col("item_id").alias("_t"), F.col("pred").alias("_p"))
    beats = (F.col("pred") > F.col("_p")) | ((F.col("pred") == F.col("_p")) & (F.col("item_id") < F.col("_t")))
    return scored.join(t, "user_id").groupBy("user_id").agg((1 + F.count_if(beats & (F.col("item_id") != F.col("_t")))).alias("rank"))


def shared_ranks(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(user_id, rank) of the truth (user_id, item_id) where `pred` (item_id, pred) is one for all users: items are ranked once.

    An item that `pred` lacks comes after all that it has.
    """
    key = F.struct((-F.col("pred")).alias("_p"), F.col("item_id").alias("_i"))
    places = dense_ids(pred.select(key.alias("_key")), "_key").select(F.col("_key._i").alias("item_id"), (F.col("idx") + 1).alias("_at"))
    size = pred.agg(F.count("*").alias("_n")).filter("_n > 0")  # one row, or none
    rows = truth.select("user_id", "item_id").join(places, "item_id", "left").crossJoin(F.broadcast(size))
    return rows.select("user_id", F.coalesce("_at", F.col("_n") + 1).alias("rank"))


def precision_recall(scored: DataFrame, *, k: int = 10, relevant: float = 4.0) -> DataFrame:
    """Per user precision, recall and graded NDCG at k."""
    w = Window.partitionBy("user_id")
    rows = scored.withColumn("_r", F.row_number().over(w.orderBy(F.desc("pred"), "item_id"))).withColumn("_i", F.row_number().over(w.orderBy(F.desc("rating"), "item_id")))
    rel = (F.col("rating") >= relevant).cast("int")
    gain = F.pow(F.lit(2.0), "rating") - 1
    per = rows.groupBy("user_id").agg(F.sum(F.when(F.col("_r") <= k, rel).otherwise(0)).alias("_h"), F.sum(rel).alias("_n"), F.sum(F.when(F.col("_r") <= k, gain / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias("_d"), F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("_o"))
    return per.select("user_id", (F.col("_h") / k).alias("precision"), F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_h") / F.col("_n")).alias("recall"), F.when(F.col("_o") == 0, 0.0).otherwise(F.col("_d") / F.col("_o")).alias("ndcg"))


def latency_stats(rows: DataFrame, column: str = "ms", *keys: str) -> DataFrame:
    """Mean, median and 95th percentile, exact, by `keys`, which hold no nulls."""
    stats = exact_quantiles(rows, column, [0.5, 0.95], list(keys)).select(*keys, F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))
    means = rows.groupBy(*keys).agg(F.avg(column).alias("mean"))
    return (means.join(stats, list(keys), "left") if keys else means.join(F.broadcast(stats), F.lit(True), "left")).select(*keys, "mean", "p50", "p95")


def quality_gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(run_id, passed, failures) of (run_id, metric, value) rows against (metric, kind min|max, bound, required); every failure is listed."""
    named = metrics.withColumn("metric", F.regexp_replace("metric", "^Hit Ratio@", "HR@"))
    runs = named.select("run_id").distinct().crossJoin(F.broadcast(rules))  # a handful of rules
    rows = runs.join(named, ["run_id", "metric"], "left")
    bad = F.when(F.col("value").isNull(), F.col("required")).when(F.col("kind") == "min", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return rows.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("metric")))), ",").alias("failures")).withColumn("passed", F.col("failures") == "").select("run_id", "passed", "failures")


def gate_vs_incumbent(candidate: DataFrame, incumbent: DataFrame, *, rmse_gain: float = 0.005, ndcg_loss: float = 0.003) -> DataFrame:
    """Wide metrics (rmse, ndcg) of both: RMSE better by a share, NDCG not down by more than a share."""
    both = candidate.select(F.col("rmse").alias("c_rmse"), F.col("ndcg").alias("c_ndcg")).crossJoin(incumbent.select(F.col("rmse").alias("i_rmse"), F.col("ndcg").alias("i_ndcg")))
    return both.select("*", ((F.col("c_rmse") <= F.col("i_rmse") * (1 - rmse_gain)) & (F.col("c_ndcg") >= F.col("i_ndcg") * (1 - ndcg_loss))).alias("passed"))


# ---- data checks


def check_items(items: DataFrame) -> DataFrame:
    row = items.agg(F.count("*").alias("n"), F.count_if(F.col("item_id").isNull()).alias("null_ids"), (F.count("item_id") - F.countDistinct("item_id")).alias("repeated_ids"))
    return row.withColumn("ok", (F.col("n") > 0) & (F.col("null_ids") == 0) & (F.col("repeated_ids") == 0))


def check_ratings(ratings: DataFrame, *, low: float = 0.5, high: float = 5.0) -> DataFrame:
    pairs = ratings.groupBy("user_id", "item_id").agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated_pairs"))
    row = ratings.agg(F.count("*").alias("n"), F.count_if(~F.col("rating").between(low, high) | F.col("rating").isNull()).alias("out_of_bounds"), F.count_if(F.col("user_id").isNull() | F.col("item_id").isNull()).alias("null_ids"), F.count_if(F.col("ts").isNotNull()).alias("with_ts")).crossJoin(pairs)
    return row.withColumn("ok", (F.col("n") > 0) & (F.col("out_of_bounds") == 0) & (F.col("null_ids") == 0) & (F.col("with_ts") > 0) & (F.col("repeated_pairs") == 0))


def check_references(rows: DataFrame, items: DataFrame, *, examples: int = 5) -> DataFrame:
    """How many rows name an unknown item, and the first few such items."""
    bad = rows.join(items.select("item_id"), "item_id", "left_anti")
    few = bad.select("item_id").distinct().orderBy("item_id").limit(examples).agg(F.array_sort(F.collect_list("item_id")).alias("examples"))
    return bad.agg(F.count("*").alias("n_orphans")).crossJoin(few)


def psi(expected: DataFrame, actual: DataFrame, columns: list[str], *, buckets: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """(column_name, psi): population stability over distinct quantile bins of the expected side; values outside count in the denominator only.

    All columns go in one pass of each side. A column without expected values, or with one alone, has 0.
    """
    melt = lambda rows: rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("_x")) for c in columns])))
    at = [i / buckets for i in range(buckets + 1)]
    named = actual.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    edges = exact_quantiles(melt(expected), "_x", at, ["column_name"]).select("column_name", F.array_sort(F.array_distinct("q")).alias("edges"))
    edges = written(named.join(edges, "column_name", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>"))), "drift-edges")  # a row a column

    def shares(rows: DataFrame, name: str) -> DataFrame:
        binned = melt(rows).filter("_x is not null").join(F.broadcast(edges), "column_name")
        last = F.size("edges") - 1
        place = F.when(F.col("_x") == F.try_element_at("edges", F.lit(-1)), last).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("_x"))))
        inside = (F.col("_x") >= F.try_element_at("edges", F.lit(1))) & (F.col("_x") <= F.try_element_at("edges", F.lit(-1)))
        counts = binned.select("column_name", F.when(inside, place).alias("bin")).groupBy("column_name", "bin").agg(F.count("*").alias("_c"))
        total = F.sum("_c").over(Window.partitionBy("column_name"))
        return counts.select("column_name", "bin", (F.col("_c") / total).alias(name)).filter("bin is not null")

    bins = edges.select("column_name", F.explode_outer(F.when(F.size("edges") > 1, F.sequence(F.lit(1), F.size("edges") - 1))).alias("bin"))
    rows = bins.join(shares(expected, "e"), ["column_name", "bin"], "left").join(shares(actual, "a"), ["column_name", "bin"], "left")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(epsilon)) for c in ("e", "a"))
    return rows.groupBy("column_name").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def drift_report(expected: DataFrame, actual: DataFrame, columns: list[str], *, alert: float = 0.25, moderate: float = 0.1) -> DataFrame:
    """(column_name, psi, null_rate, status, null_alert) of each column."""
    rates = actual.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    rates = rates.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in columns])))
    status = F.when(F.col("psi") > alert, "DRIFT_ALERT").when(F.col("psi") >= moderate, "MODERATE").otherwise("PASS")
    out = psi(expected, actual, columns).join(F.broadcast(rates), "column_name")  # a row a column
    return out.withColumn("status", status).withColumn("null_alert", F.col("null_rate") > 0.05)


def table_parity(a: DataFrame, b: DataFrame, key: str, columns: list[str], *, tolerance: float = 1e-3, allowed: float = 0.01) -> DataFrame:
    """Per column the share of keys whose values differ by more than tolerance x max(1, |x|); a missing row differs."""
    left = a.select(key, *[F.col(c).cast("double").alias(f"_a_{c}") for c in columns])
    right = b.select(key, *[F.col(c).cast("double").alias(f"_b_{c}") for c in columns])
    both = left.join(right, key, "full_outer")
    bad = {c: ~F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"_a_{c}"))), F.lit(False)) for c in columns}
    row = both.agg(*[F.avg(x.cast("double")).alias(c) for c, x in bad.items()])
    rows = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("mismatch")) for c in columns])))
    return rows.withColumn("ok", F.col("mismatch") <= allowed)


def train_serve_parity(trained: DataFrame, served: DataFrame, keys: list[str], columns: list[str], *, finite: tuple[str, ...] = ("retrieval_score",), tolerance: float = 1e-6) -> DataFrame:
    """(column_name, n_rows, n_breaches, ok): feature rows of the training path against those of the serving path.

    Every row served is compared with the training row of its keys: a value further off than `tolerance`, a null on one side or a
    missing training row is a breach. Columns in `finite` come by other channels on each side, so they must only be finite on both.
    """
    left = trained.select(*keys, *[F.col(c).cast("double").alias(f"_t_{c}") for c in columns], F.lit(True).alias("_known"))
    both = served.select(*keys, *[F.col(c).cast("double").alias(f"_s_{c}") for c in columns]).join(left, keys, "left")

    def fine(c: str) -> Column:
        a, b = F.col(f"_t_{c}"), F.col(f"_s_{c}")
        if c in finite:
            return F.abs(a).between(0, MAX_DOUBLE) & F.abs(b).between(0, MAX_DOUBLE)
        return (F.abs(a - b) <= tolerance) | (a.isNull() & b.isNull() & F.col("_known").isNotNull())

    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (~F.coalesce(fine(c), F.lit(False))).alias("bad")) for c in columns]))
    return both.select(told.alias("_x")).groupBy("_x.column_name").agg(F.count("*").alias("n_rows"), F.count_if("_x.bad").alias("n_breaches")).withColumn("ok", F.col("n_breaches") == 0)


def check_threads(comments: DataFrame) -> DataFrame:
    """Comments without text, with an unknown parent, or under a parent of another item."""
    parents = comments.select(F.col("comment_id").alias("parent_id"), F.col("item_id").alias("_item"))
    rows = comments.join(parents, "parent_id", "left")
    orphan = F.col("parent_id").isNotNull() & F.col("_item").isNull()
    return rows.agg(F.count_if(F.coalesce(F.trim("content"), F.lit("")) == "").alias("blank"), F.count_if(orphan).alias("orphans"), F.count_if(F.col("_item") != F.col("item_id")).alias("other_item"))


def check_vocabulary(rows: DataFrame, columns: list[str]) -> DataFrame:
    row = rows.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n"), (F.col(c) > 0).alias("ok")) for c in columns])))
