"""What keeps queries whole on larger tables: no broadcast of what grows, no lists of pairs that are merged later."""

import numpy as np
from pyspark.sql import functions as F

from slatewise.operators import features as X
from slatewise.operators import retrieval as R


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_ranking_features_broadcast_no_side(spark):
    pairs = spark.createDataFrame([(1, 2)], "user_id long, item_id long")
    meta = spark.createDataFrame([(2, 1.0, 4.0, 4.0, 2000.0, 0.5, ["a"])], "item_id long, popularity double, vote_average double, bayes double, year double, decay double, genre_list array<string>")
    profiles = spark.createDataFrame([(1, 1.0, 0.0, ["a"])], "user_id long, activity double, bias double, genre_set array<string>")
    rows = X.ranking_features(pairs, meta, profiles)
    assert "Broadcast" not in _plan(rows)
    assert rows.first()["overlap"] == 1.0


def test_pairwise_pairs_need_no_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "written", lambda df, name: seen.append(df) or df)
    rows = [(u, i, (u * i) % 3, float(i % 5)) for u in range(4) for i in range(9)]
    train = spark.createDataFrame(rows, "user_id long, item_id long, label int, x double")
    X.fit_pairwise(train, columns=["x"], pairs=3)
    assert "Join" not in _plan(seen[0])
    at = train.withColumn("h", F.hash("item_id")).collect()
    expected = 0
    for u in range(4):
        mine = sorted((r for r in at if r["user_id"] == u), key=lambda r: (r["h"], r["item_id"]))
        expected += sum(a["label"] != b["label"] for n, a in enumerate(mine) for b in mine[n + 1 : n + 4])
    assert seen[0].count() == expected > 0


def test_products_are_exact_with_ties_and_a_k_of_each_query(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.standard_normal((40, 4)), 1)[rng.integers(0, 40, 5000)]  # many are equal, more than one matrix holds
    asked = [(q, [float(x) for x in vectors[q]], 1 + q % 9) for q in range(0, 5000, 97)]
    items = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "item_id long, vec array<double>")
    found = R.best_products(spark.createDataFrame(asked, "query_id long, vec array<double>, k int"), items, min_score=0.5)
    told = {(r["query_id"], r["item_id"]) for r in found.collect()}
    expected = set()
    for q, v, k in asked:
        scores = np.round(vectors @ np.array(v), 9)
        order = [int(n) for n in np.lexsort((np.arange(5000), -scores))[:k] if scores[n] > 0.5]
        expected |= {(q, n) for n in order}
    assert told == expected


def test_equal_vectors_are_multiplied_once(spark, monkeypatch):
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    items = spark.createDataFrame([(n, vectors[n % 3]) for n in range(60)], "item_id long, vec array<double>")
    sizes, real = [], R.best_products
    monkeypatch.setattr(R, "best_products", lambda q, v, **how: sizes.append((q.count(), v.count())) or real(q, v, **how))
    rows = {r["query_id"]: [] for r in items.select(F.col("item_id").alias("query_id")).collect()}
    for r in sorted(R.neighbours(items, items, k=25).collect(), key=lambda r: r["rank"]):
        rows[r["query_id"]].append(r["item_id"])
    assert sizes == [(3, 3)]
    for q, got in rows.items():
        score = lambda n: round(sum(a * b for a, b in zip(vectors[q % 3], vectors[n % 3], strict=True)), 9)  # noqa: B023, E731
        assert got == sorted((n for n in range(60) if n != q), key=lambda n: (-score(n), n))[:25]


def test_detect_intent_reads_whole_messages(spark, tmp_path):
    from slatewise.plans.streams import detect_intent

    text = "Well, then. " * 300 + "directed by nolan"  # told by its last words
    spark.createDataFrame([(7, 0, "user", text), (7, 1, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    told = {r["message_id"]: r for r in detect_intent(spark, str(tmp_path)).filter("not made").collect()}
    assert set(told) == {7000, 7001}
    assert (told[7000]["intent"], told[7000]["director"], told[7001]["intent"]) == ("director", "nolan", "fallback")


def test_slates_are_picked_together_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = [(s, int(i), "|".join(rng.choice(list("abcdef"), rng.integers(1, 4))), float(rng.integers(0, 6)), 0.6) for s in range(40) for i in range(int(rng.integers(1, 14)))]
    slates = spark.createDataFrame(rows, "slate_id long, item_id long, genres string, score double, lambda double")
    made = X.mmr(slates, limit=5)
    assert "FlatMapGroupsInPandas" not in _plan(made)
    told = {}
    for r in sorted(made.collect(), key=lambda r: (r["slate_id"], r["rank"])):
        told.setdefault(r["slate_id"], []).append(r["item_id"])
    for s in range(40):
        mine = sorted(((r[1], set(r[2].split("|")), r[3]) for r in rows if r[0] == s), key=lambda r: (-r[2], r[0]))
        low, high = min(r[2] for r in mine), max(r[2] for r in mine)
        rel = [1.0 if high == low else (r[2] - low) / (high - low + 1e-6) for r in mine]
        chosen = [0]
        while len(chosen) < min(5, len(mine)):
            like = lambda n: max(len(mine[n][1] & mine[c][1]) / len(mine[n][1] | mine[c][1]) for c in chosen)  # noqa: B023, E731
            chosen.append(min((n for n in range(len(mine)) if n not in chosen), key=lambda n: (-round(0.6 * rel[n] - 0.4 * like(n), 9), n)))  # noqa: B023
        assert told[s] == [mine[n][0] for n in chosen]


def test_equal_rows_of_a_rater_are_one_row(spark):
    from slatewise.operators import boosting as T

    rows = spark.createDataFrame([(1.0, False, [1, 2])] * 50 + [(2.0, False, [2, 1])], "label double, is_valid boolean, bins array<tinyint>")
    assert sorted(r["n"] for r in T._counted(rows).collect()) == [1, 50]


def test_histograms_are_whole_sums(spark):
    from slatewise.operators import boosting as T

    big = (1 << 53) + 1  # more than a double tells
    rows = spark.createDataFrame([(0, [1, 2], big, 1, 1), (0, [1, 0], -3, 2, 4), (2, [0, 2], 5, 1, 1)], "node int, bins array<tinyint>, g long, h long, n long")
    got = rows.coalesce(1).mapInArrow(T._histograms([2, 0], 2, 3), "node int, feature int, bin int, g long, h long, n long").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 1, big - 3, 3, 5), (0, 1, 0, -3, 2, 4), (0, 1, 2, big, 1, 1), (2, 0, 0, 5, 1, 1), (2, 1, 2, 5, 1, 1)]


def test_quantiles_write_each_value_once(spark, monkeypatch):
    from slatewise.operators import quantiles as Q

    seen, real = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    rows = spark.range(5000).select((F.col("id") % 3).cast("double").alias("x"))
    assert Q.exact_quantiles(rows, "x", [0.0, 0.5, 1.0]).first()["q"] == [0.0, 1.0, 2.0]
    assert [x.count() for x in seen] == [3]


def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from slatewise.operators import aggregates as A

    monkeypatch.setattr(A, "PAIRS", 10)
    rows = spark.createDataFrame([(u, 1, 1.0) for u in range(20)], "user_id long, item_id long, rating double")
    made = A.co_rated(rows)
    assert ", 20)" in _plan(made)  # 400 ordered pairs, 190 of which are kept
    assert made.count() == 190


def test_bootstrap_draws_need_no_numbers_of_digits(spark):
    from slatewise.operators import evaluation as E

    digits = [f"{int(e * (1 << 48)) + k:012x}" for e in E.POISSON_EDGES for k in (-1, 0, 1)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in digits], "x string").select(E._poisson(F.col("x"))).collect()]
    assert got == [sum(int(x, 16) / float(1 << 48) >= e for e in E.POISSON_EDGES) for x in digits]
    assert "conv(" not in _plan(E.bootstrap_ci(spark.createDataFrame([(1, 0.5)], "user_id long, m double"), "m", n=2))


def test_stored_lists_meet_by_bands_of_ids(spark, tmp_path):
    from slatewise.plans.retrieval import _stored

    ids = [-650, -301, -300, -1, 0, 1, 300, 301, 302, 601, 900, None]
    spark.createDataFrame([(i, "a b", brand, "T", float(n)) for n, i in enumerate(ids) for brand in ("x", "y")], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([], "l_partkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = _stored(spark, str(tmp_path))
    assert sorted((r["query_id"], r["item_id"]) for r in got.collect()) == sorted(2 * [(a, b) for a in ids[:-1] for b in ids[:-1] if a != b and abs(a - b) <= 300])
    assert "_band" in _plan(got).split("Join ")[1].split("\n")[0]


def test_bm25_lists_carry_numbers_of_classes(spark, monkeypatch):
    seen = {}
    keep = R.written
    monkeypatch.setattr(R, "written", lambda df, name: seen.setdefault(name, df) and keep(df, name))
    r = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 5.0, 2), (2, 1, 5.0, 1), (3, 9, 1.0, 1)], "user_id long, item_id long, rating double, ts long")
    tokens = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "a", 1), (4, "b", 1), (5, "c", 1)], "item_id long, term string, tf long")
    index = tokens.select("item_id", "term", F.when(F.col("term") == "a", 2.0).otherwise(1.0).alias("weight"))
    users = spark.createDataFrame([(u,) for u in (1, 2, 3)], "user_id long")
    got = R.bm25_candidates(r.filter("rating >= 4"), tokens, index, r, users, n=2)
    assert sorted(tuple(x) for x in got.collect()) == [(1, 3, 2.0), (1, 4, 1.0), (2, 3, 2.0), (3, 1, 2.0), (3, 2, 1.0)]
    assert seen["bm25-lists"].columns == ["_q", "_list"]


def test_als_blocks_grow_with_ratings(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_RATINGS", 3)
    rows = spark.range(100)
    assert (R.als_blocks(rows), R.als_blocks(rows.limit(5))) == (34, 10)


def test_a_channel_pair_is_sorted_once(spark):
    from slatewise.operators import aggregates as A

    rows = spark.createDataFrame([(1, 2, 0.5, "b"), (1, 2, 0.5, "a"), (1, 3, 0.1, "b")], "user_id long, item_id long, score double, source string")
    best = A.union_channels(rows, rows)
    assert _plan(best).split("== Physical Plan ==")[1].count("Sort [") == 1
    assert sorted(tuple(x) for x in best.collect()) == [(1, 2, 0.5, "a"), (1, 3, 0.1, "b")]
