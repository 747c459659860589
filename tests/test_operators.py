"""Hand-made cases of metrics, fusion, sampling and text functions."""

import math

import pytest
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import aggregates as A
from slatewise.operators import catalogue as C
from slatewise.operators import conversation as V
from slatewise.operators import evaluation as E
from slatewise.operators import features as X
from slatewise.operators import retrieval as R
from slatewise.operators import sampling as G


def test_perfect_and_second_rank(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, 0.95), (1, 2, 4.0, 0.85), (1, 3, 2.0, 0.1), (2, 1, 1.0, 0.9), (2, 2, 5.0, 0.8)], "user_id long, item_id long, rating double, pred double")
    got = {r["user_id"]: r for r in E.per_user_scores(rows, k=2).collect()}
    assert (got[1]["hit"], round(got[1]["ndcg"], 9), got[1]["rr"]) == (1.0, 1.0, 1.0)
    assert got[2]["rr"] == 0.5 and math.isclose(got[2]["ndcg"], 1 / math.log2(3))


def test_rank_fusion_order(spark):
    one = spark.createDataFrame([(1, 10, 2.0), (1, 20, 1.0)], "user_id long, item_id long, score double")
    two = spark.createDataFrame([(1, 20, 2.0), (1, 30, 1.0)], "user_id long, item_id long, score double")
    assert [r["item_id"] for r in R.rank_fusion(one, two).orderBy(F.desc("score")).collect()] == [20, 10, 30]


def test_negative_pool_of_a_tiny_catalogue(spark):
    index = spark.createDataFrame([(i, 10 + i) for i in range(5)], "idx long, item_id long")
    truth = spark.createDataFrame([(1, 10)], "user_id long, item_id long")
    seen = spark.createDataFrame([(1, 10), (1, 11)], "user_id long, item_id long")
    got = {(r["item_id"], r["is_truth"]) for r in G.negative_pools(truth, seen, index, n=99).collect()}
    assert got == {(10, True), (12, False), (13, False), (14, False)}


def test_lists_bools_and_ratings(spark):
    texts = ["a|b; c", "['x', 'y']", "nan", None, "", '["p","q"]']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_list(F.col("t"))).collect()]
    assert got == [["a", "b", "c"], ["x", "y"], [], [], [], ["p", "q"]]
    row = spark.range(1).select(S.bayesian_rating(F.lit(0), F.lit(7.0)), S.graded_label(F.lit(3.5)), S.graded_label(F.lit(9.0)), S.parse_bool(F.lit("Yes"))).first()
    assert tuple(row) == (7.0, 2, 4, True)


def test_greedy_rerank_prefers_other_genres(spark):
    rows = spark.createDataFrame([(1, 1, "a|b", 1.0, 0.3), (1, 2, "a|b", 0.9, 0.3), (1, 3, "c", 0.5, 0.3)], "slate_id long, item_id long, genres string, score double, `lambda` double")
    assert [r["item_id"] for r in X.mmr(rows, limit=3).orderBy("rank").collect()] == [1, 3, 2]


def test_misspelt_title_links(spark):
    mentions = spark.createDataFrame([(1, "Inceptoin")], "message_id long, mention string")
    titles = spark.createDataFrame([(1, "Inception"), (2, "Interstellar")], "item_id long, title string")
    assert [r["item_id"] for r in V.link_titles(mentions, titles, cutoff=0.5).collect()] == [1]


def test_critiques_and_intents(spark):
    rows = [(1, "funnier please"), (2, "không thích kinh dị"), (3, "newer and over 7.5"), (4, "more"), (5, "hello there"), (6, "tell me about Heat"), (7, "movies like 'Alien'"), (8, "phim hành động năm 2015"), (9, "the book and the cover"), (10, None), (11, "suggest something"), (12, "directed by Nolan"), (13, "how many movies are there"), (14, "show me more"), (15, "another before 1999"), (16, "the second one")]
    m = spark.createDataFrame(rows, "message_id long, text string")
    c = {r["message_id"]: r for r in V.parse_critique(m).collect()}
    assert (c[1]["genre"], c[1]["diverse"]) == ("Comedy", False)
    assert c[2]["exclude_genres"] == ["Horror"] and c[2]["genre"] is None
    assert (c[3]["min_rating"], c[3]["newer_than"]) == (7.5, 2015)
    assert c[4]["diverse"] and c[15]["newer_than"] == 1999 and not c[9]["is_critique"] and c[9]["genre"] is None and not c[10]["is_critique"]
    i = {r["message_id"]: r for r in V.detect_intent(m).collect()}
    assert [i[n]["intent"] for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16)] == ["general_qa", "movie_detail", "similar", "search_filter", "fallback", "fallback", "personalized", "director", "sql_query", "more_recommendations", "followup"]
    assert (i[6]["target_title"], i[7]["target_title"], i[12]["director"], i[8]["year"], i[8]["genres"]) == ("heat", "alien", "nolan", "2015", ["Action"])
    assert i[8]["language"] == i[2]["language"] == "vi" and i[9]["language"] == "en"


def test_ranking_features_of_known_and_unknown_sides(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 99), (9, 10)], "user_id long, item_id long")
    meta = spark.createDataFrame([(10, 7.0, 4.0, 4.5, 2009.0, 0.5, ["A", "B"], [1.0, 2.0])], "item_id long, popularity double, vote_average double, bayes double, year double, decay double, genre_list array<string>, als_vec array<double>")
    profiles = spark.createDataFrame([(1, 2.0, 0.25, ["A", "C"], [0.5, 0.25])], "user_id long, activity double, bias double, genre_set array<string>, als_vec array<double>")
    got = {(r["user_id"], r["item_id"]): r for r in X.ranking_features(pairs, meta, profiles).collect()}
    r = got[1, 10]
    assert (r["overlap"], r["affinity"], r["cb_score"], r["retrieval_score"], r["activity"], r["bias"]) == (1.0, 0.5, 0.5, 1.0, 2.0, 0.25)
    r = got[1, 99]
    assert (r["popularity"], r["vote_average"], r["bayes"], r["year"], r["retrieval_score"]) == (1.0, 5.0, 5.0, 2010.0, 0.0) and math.isclose(r["decay"], 2 ** (-14 / 15))
    assert (got[9, 10]["activity"], got[9, 10]["bias"], got[9, 10]["cb_score"]) == (1.0, 0.0, 0.0)
    asked = pairs.selectExpr("*", "if(item_id = 10, 0.75D, null) as retrieval_score")
    assert {(x["user_id"], x["item_id"]): x["retrieval_score"] for x in X.ranking_features(asked, meta.drop("als_vec"), profiles).collect()}[1, 10] == 0.75


def test_popularity_draws_follow_the_counts(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ITEMS", 3)
    counts = [900, 1, 1, 50, 7, 0, 41]
    popularity = spark.createDataFrame([(n, 10 + n, c) for n, c in enumerate(counts)], "idx long, item_id long, n long")
    ranges = {r["item_id"]: (r["lo"], r["hi"]) for r in G.popularity_ranges(popularity)[0].collect()}
    assert ranges == {10: (0, 900), 11: (900, 901), 12: (901, 902), 13: (902, 952), 14: (952, 959), 16: (959, 1000)}
    users = spark.createDataFrame([(u, 100) for u in range(20)], "user_id long, n_draws int")
    drawn = G.weighted_draws(users, popularity, seed=1)
    got = {r["item_id"]: r["count"] for r in drawn.groupBy("item_id").count().collect()}
    assert sum(got.values()) == 2000 and 15 not in got and 1700 < got[10] < 1900
    assert G.weighted_draws(users, popularity.limit(0), seed=1).count() == 0


def test_negatives_of_users_who_have_seen_nearly_all(spark):
    index = spark.createDataFrame([(n, n) for n in range(200)], "idx long, item_id long")
    seen = spark.createDataFrame([(1, n) for n in range(198)] + [(2, n) for n in range(5)] + [(3, n) for n in range(200)], "user_id long, item_id long")
    wanted = spark.createDataFrame([(1, 5), (2, 8), (3, 4)], "user_id long, n int")
    got = {}
    for r in G.sample_negatives(wanted, seen, index).collect():
        got.setdefault(r["user_id"], []).append(r["item_id"])
    assert sorted(got[1]) == [198, 199] and len(set(got[2])) == len(got[2]) == 8 and min(got[2]) >= 5 and 3 not in got


def test_train_serve_parity_counts_breaches(spark):
    schema = "user_id long, item_id long, a double, b double, retrieval_score double"
    trained = spark.createDataFrame([(1, 1, 1.0, 2.0, 0.5), (1, 2, 1.0, None, 0.5), (2, 1, 1.0, 2.0, 0.5)], schema)
    served = spark.createDataFrame([(1, 1, 1.0 + 1e-8, 2.1, 9.0), (1, 2, 1.0, None, float("nan")), (2, 1, None, 2.0, float("inf")), (9, 9, 1.0, 2.0, 0.5)], schema)
    told = {r["column_name"]: (r["n_rows"], r["n_breaches"], r["ok"]) for r in E.train_serve_parity(trained, served, ["user_id", "item_id"], ["a", "b", "retrieval_score"]).collect()}
    assert told == {"a": (4, 2, False), "b": (4, 2, False), "retrieval_score": (4, 3, False)}
    assert all(r["ok"] for r in E.train_serve_parity(trained, trained, ["user_id", "item_id"], ["a", "b", "retrieval_score"]).collect())


def test_item_cf_is_evaluated_for_users_with_candidates(spark):
    similar = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (4, 3, 0.5), (1, 4, 0.1)], "query_id long, item_id long, score double")
    train = spark.createDataFrame([(7, 1), (7, 4), (8, 1), (9, 5)], "user_id long, item_id long")
    truth = spark.createDataFrame([(7, 2), (8, 6), (9, 1), (10, 1)], "user_id long, item_id long")
    r = E.evaluate_item_cf(train, truth, similar).first()
    assert (r["hr"], r["n_users"]) == (0.5, 2) and math.isclose(r["ndcg"], 0.5 / math.log2(3))
    r = E.evaluate_item_cf(train, truth, similar.limit(0)).first()
    assert (r["hr"], r["ndcg"], r["n_users"]) == (0.0, 0.0, 0)


def test_vectors_are_backfilled_in_versions(spark, tmp_path):
    from slatewise.sources import files as S

    path = f"file://{tmp_path}/vectors"
    assert S.stored_vectors(spark, path) == (None, 0)
    items = spark.createDataFrame([(1, "one two"), (2, ""), (3, None)], "item_id long, text string")
    S.backfill_vectors(items, path, size=8)
    S.backfill_vectors(items.withColumn("text", F.lit("three")), path, size=8, limit=1)
    rows, version = S.stored_vectors(spark, path)
    got = {r["item_id"]: r["vec"] for r in rows.collect()}
    assert version == 2 and all(len(v) == 8 for v in got.values()) and sum(got[1]) == 1.0 and sum(got[2]) == sum(got[3]) == 0.0


def test_mentions_of_quotes_accents_and_short_words(spark):
    rows = [(1, "Have you seen “Amélie” or 'Up'? I liked Élite Squad 2, The Lord Of The Rings Again and X"), (2, None), (3, ""), (4, " ".join(f"Film{i}," for i in range(12)))]
    got = {r["message_id"]: r["mentions"] for r in V.extract_mentions(spark.createDataFrame(rows, "message_id long, text string")).collect()}
    assert got[1] == ["Amélie", "Up", "Have", "Élite Squad 2", "The Lord Of The Rings", "Again"]
    assert got[2] == got[3] == [] and got[4] == [f"Film{i}" for i in range(10)]


def test_title_links_against_brute_force(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(5)
    word = lambda: "".join(r.choice("aeéBt") for _ in range(r.randint(3, 7)))
    titles = [(i, word()) for i in range(60)]
    mentions = [(i % 20, word()) for i in range(80)] + [(1, titles[0][1].upper())]
    want = {}
    for message, mention in mentions:
        m = mention.lower()
        exact = [i for i, t in titles if t.lower() == m]
        if exact:
            best = (-1.0, min(exact))
        else:
            near = [(edits(m, t.lower()) / max(len(m), len(t)) - 1, i) for i, t in titles]
            best = min([x for x in near if -x[0] >= 0.6], default=None)
        if best:
            key = (message, best[1])
            want[key] = min(want.get(key, (1, "")), (round(best[0], 4), mention))
    ms, ts = spark.createDataFrame([*mentions, (3, None), (4, "")], "message_id long, mention string"), spark.createDataFrame([*titles, (99, None)], "item_id long, title string")
    for firm in (0.6, 0.85):
        got = V.link_titles(ms, ts, firm=firm).collect()
        assert {(x["message_id"], x["item_id"]): (-x["score"], x["mention"]) for x in got} == want and len(got) == len(want)


def test_title_candidates_hold_every_near_pair_and_few_others(spark):
    import random

    r = random.Random(8)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(r.randint(1, 24))) for _ in range(150)]
    texts += ["".join(c if r.random() < 0.8 else r.choice(["", "x", c + "y"]) for c in t) for t in texts[:100]]
    m = spark.createDataFrame([(t,) for t in set(texts)], "m string")
    t = m.select(F.col("m").alias("t"), F.lit(1).alias("item_id"))
    for cutoff in (0.5, 0.7, 0.9):
        near = {tuple(x) for x in m.crossJoin(t).filter(V.similarity(F.col("m"), F.col("t")) >= cutoff).select("m", "t").collect()}
        met = {tuple(x) for x in V.title_candidates(m, t, cutoff=cutoff).select("m", "t").distinct().collect()}
        assert near <= met
    assert len(met) < len(set(texts)) ** 2 / 50


def test_co_ratings_in_blocks(spark):
    import random

    r = random.Random(6)
    rows = [(u, i, r.randint(1, 10) / 2) for u in range(30) for i in range(4) if i == 0 or r.random() < 0.5]
    want = {}
    for u, i, x in rows:
        for v, j, y in rows:
            if i == j and u < v:
                n, dot = want.get((u, v), (0, 0.0))
                want[u, v] = (n + 1, dot + x * y)
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    asked = spark.createDataFrame([(3,), (9,), (9,), (99,)], "user_id long")
    for block in (2, 4096):
        assert {(x["a"], x["b"]): (x["n"], x["dot"]) for x in A.co_rated(ratings, block=block).collect()} == want
        some = {(x["a"], x["b"]): (x["n"], x["dot"]) for x in A.co_rated(ratings, asked=asked, block=block).collect()}
        assert some == {(a, b): want[min(a, b), max(a, b)] for a in (3, 9) for b in range(30) if (min(a, b), max(a, b)) in want}


def test_dense_ids_of_many_ranges(spark):
    rows = spark.range(500).selectExpr("concat('k', lpad(id * 7919 % 211, 4, '0')) AS k").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    got = [(x["k"], x["idx"]) for x in A.dense_ids(rows, "k").orderBy("idx").collect()]
    assert got == [(f"k{i:04}", i) for i in range(211)]
    assert A.dense_ids(rows.filter("k < 'a'"), "k").count() == 0


def test_search_index_reads_what_it_is_asked_for(spark, tmp_path):
    items = spark.createDataFrame([(1, "Red Heat", "Hill", 3.0), (2, "Heat", None, None), (3, None, "Mann", 9.0), (4, "ab", "Ré", 9.0), (5, "x", "y", 1.0)], "item_id long, title string, director string, popularity double")
    genres = spark.createDataFrame([(1, "Action"), (3, "Crime|Action"), (5, None)], "item_id long, genre string")
    actors = spark.createDataFrame([(2, "Al Pacino"), (3, "Red Buttons"), (9, "Red Nobody")], "item_id long, actor string")
    tags = spark.createDataFrame([(5, "HEATED red heat")], "item_id long, tag string")
    path = f"file://{tmp_path}/index"
    C.write_search_index(items, genres, actors, tags, path, buckets=64)
    for text, want in (("heat", [1, 5, 2]), ("RED", [3, 1, 5]), ("red heat", [1, 5]), ("ré", [4]), ("x", [5]), ("acti", [3, 1]), ("heart", []), ("a|b", []), ("pacino", [2])):
        assert [r["item_id"] for r in C.search_index(spark, path, text, buckets=64).collect()] == want, text
        assert [r["item_id"] for r in C.search_ids(items, genres, actors, tags, text=text).collect()] == want, text
    assert [r["item_id"] for r in C.search_index(spark, path, "e", limit=2, buckets=64).collect()] == [3, 1]
    plan = C.names_with(spark, path, "pacino", buckets=64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_candidate_channels_of_requests(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id long")
    stored = spark.createDataFrame([(1, 2, None, 1), (1, 3, 0.9, 2), (1, 1, 0.8, 3), (5, 6, None, 21)], "query_id long, item_id long, score double, rank int")
    near = spark.createDataFrame([(1, 2, 0.7), (1, 3, 0.1)], "query_id long, item_id long, score double")
    asked = spark.createDataFrame([(100, 1), (200, 5), (300, 77)], "user_id long, asked_id long")
    got = {(r["user_id"], r["item_id"]): (r["score"], r["source"]) for r in R.candidates_similar(asked, stored, near, ids(3, 9, 5), ids(1, 5, 8, 9), least=4, fill=3).collect()}
    assert {i: v for (u, i), v in got.items() if u == 100} == {2: (0.7, "vector"), 3: (0.9, "list"), 9: (0.3, "trending"), 5: (0.3, "trending")}
    assert {i: v for (u, i), v in got.items() if u == 200} == {6: (0.5, "list"), 3: (0.3, "trending"), 9: (0.3, "trending"), 1: (0.2, "popular"), 8: (0.2, "popular")}
    assert {i for (u, i) in got if u == 300} == {3, 9, 5, 1, 8}
    liked = spark.createDataFrame([(100, 1, 1), (100, 9, 2), (200, 5, 1)], "user_id long, item_id long, place int")
    vector = spark.createDataFrame([(100, 9, 0.99), (100, 2, 0.2)], "user_id long, item_id long, score double")
    users = spark.createDataFrame([(100,), (200,), (300,)], "user_id long")
    got = {(r["user_id"], r["item_id"]): (r["score"], r["source"]) for r in R.candidates_personalised(users, liked, vector, stored, ids(3, 9), ids(5, 7), least=3).collect()}
    assert {i: v for (u, i), v in got.items() if u == 100} == {2: (0.4, "list"), 3: (0.9, "list"), 5: (0.2, "popular"), 7: (0.2, "popular")}
    assert {i: v for (u, i), v in got.items() if u == 200} == {3: (0.3, "trending"), 9: (0.3, "trending"), 7: (0.2, "popular")}
    assert {i for (u, i) in got if u == 300} == {3, 9, 5, 7}


def test_rerank_by_term_weights_equals_plain_search(spark):
    import random

    import numpy as np

    r = random.Random(7)
    terms, slates, want = {}, [], []
    for i in range(12):
        w = {t: r.random() for t in r.sample("abcdef", r.randint(0, 4))}
        n = sum(x * x for x in w.values()) ** 0.5
        terms[i] = {t: x / n for t, x in w.items()}
    for s in range(6):
        lam = [0.4, 0.7, 0.9][s % 3]
        rows = sorted(((i, r.choice([1.0, 2.0, 2.5, 4.0])) for i in r.sample(range(12), r.choice([1, 3, 12]))), key=lambda p: (-p[1], p[0]))
        slates += [(s, i, "", v, lam) for i, v in rows]
        low, high = rows[-1][1], rows[0][1]
        rel = {i: (v - low) / (high - low) if high > low else 1.0 for i, v in rows}
        like = lambda i, j: sum(x * terms[j].get(t, 0.0) for t, x in terms[i].items())
        chosen = [rows[0][0]]
        while len(chosen) < min(5, len(rows)):
            left = [i for i, _ in rows if i not in chosen]
            chosen.append(left[int(np.argmax([round(lam * rel[i] - (1 - lam) * max(like(i, j) for j in chosen), 9) for i in left]))])
        want += [(s, i, n) for n, i in enumerate(chosen, 1)]
    weights = spark.createDataFrame([(i, t, x) for i, w in terms.items() for t, x in w.items()], "item_id long, term string, weight double")
    frame = spark.createDataFrame(slates, "slate_id long, item_id long, genres string, score double, `lambda` double")
    assert sorted(tuple(x) for x in X.mmr(frame, limit=5, epsilon=0.0, terms=weights).collect()) == sorted(want)


def test_recommend_serves_users_without_channels(spark):

    pairs = "user_id long, item_id long, score double"
    a = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 99, 1.0)], pairs)
    b = spark.createDataFrame([(1, 12, 3.0)], pairs)
    items = spark.createDataFrame([(i, "x|y") for i in (10, 11, 12, 13)], "item_id long, genres string")
    history = spark.createDataFrame([(2, 13), (3, 13), (3, 12)], "user_id long, item_id long")
    users, best = spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), spark.createDataFrame([(13,), (12,)], "item_id long")
    terms = spark.createDataFrame([(10, "x", 1.0)], "item_id long, term string, weight double")
    weights = spark.createDataFrame([(1, 0.5)], "user_id long, `lambda` double")
    got = X.recommend([a, b], users, history, best, items, lambda rows: rows.withColumn("score", F.col("item_id").cast("double")), weights, terms, limit=2)
    # item 99 isn't in the catalogue; user 2 has seen 13, user 3 all that is popular
    assert sorted(tuple(x) for x in got.select("user_id", "item_id", "rank", "source").collect()) == [(1, 11, 2, "retrieved"), (1, 12, 1, "retrieved"), (2, 12, 1, "popular")]


def test_towers_of_users_and_items(spark):
    import numpy as np

    content = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 9, 1.0)], "item_id long, pos long, x double")
    genres = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "zz"), (4, "a")], "item_id long, genre string")
    scalars = spark.createDataFrame([(1, 3.0, 8.0), (2, None, None)], "item_id long, popularity double, vote_average double")
    inputs = R.item_tower_inputs(content, genres, scalars, ["a", "b"], size=4)
    got = {(x["item_id"], x["pos"]): round(x["x"], 9) for x in inputs.collect()}
    assert got == {(1, 0): 1.0, (1, 4): 1.0, (1, 6): round(np.log(4), 9), (1, 7): 0.8, (2, 1): 1.0, (2, 5): 1.0, (2, 7): 0.5, (4, 4): 1.0}
    vec = {x["item_id"]: np.array(x["vec"]) for x in R.two_tower_encode(inputs, width=8, out=3, seed=5).collect()}
    for i in (1, 2, 4):
        dense = np.array([got.get((i, p), 0.0) for p in range(8)])
        y = np.maximum(dense @ R.tower_weights(8, 3, 5), 0)
        assert np.allclose(vec[i], y / (np.linalg.norm(y) or 1), atol=1e-8)
    liked = spark.createDataFrame([(7, 1, 10), (7, 2, 20), (7, 4, 30)], "user_id long, item_id long, ts long")
    users = spark.createDataFrame([(7, 3.0, -0.5), (8, None, None)], "user_id long, activity double, bias double")
    got = {(x["user_id"], x["pos"]): round(x["x"], 6) for x in R.user_tower_inputs(liked, content, genres, users, ["a", "b"], size=4).collect()}
    old = np.exp(-0.5) / (1 + np.exp(-0.5))
    assert got == {(7, 0): round(old, 6), (7, 1): round(1 - old, 6), (7, 4): round(2 / 3, 6), (7, 5): round(1 / 3, 6), (7, 6): round(np.log(4), 6), (7, 7): -0.5, (8, 6): round(np.log(2), 6)}


def test_rating_dataset_refuses_repeats_and_clashes(spark):
    items = spark.createDataFrame([(1, "A (1999)", "a|b", "D", None, "x"), (2, None, None, None, "2001-05-06", None)], "item_id long, title string, genres string, director string, release_date string, cast string")
    feats = X.movie_features(items, ["a", "c"])
    got = {r["item_id"]: r for r in feats.collect()}
    assert (got[1]["year"], got[1]["decade"], got[1]["n_genres"], got[1]["n_cast"], got[1]["n_keywords"], got[1]["adult"], got[1]["primary_actor"], got[1]["genre_a"], got[1]["genre_c"]) == (1999, 1990, 2, 1, 0, 0, "x", 1, 0)
    assert (got[2]["year"], got[2]["month"], got[2]["overview_len"], got[2]["primary_director"], got[2]["popularity"]) == (2001, 5, 0, "<unknown>", None)
    pairs = spark.createDataFrame([(7, 1, 4.0), (7, 2, 3.0), (8, 3, 2.0)], "user_id long, item_id long, rating double")
    users = A.user_features(pairs, feats.select("item_id", "popularity", "vote_average", "year"))
    prefs = spark.createDataFrame([(7, 2.0, 1.0)], "user_id long, pref_a double, pref_c double")
    rows = X.rating_dataset(pairs, feats, users, prefs, ["a", "c"])
    assert rows.columns == ["rating", *X.CATEGORIES, *X.NUMBERS, "genre_a", "genre_c"]
    told = {(r["user_id"], r["item_id"]): (r["year_match"], r["genre_match_score"]) for r in rows.collect()}
    assert told == {(7, 1): (1.0, 2.0), (7, 2): (1.0, 0.0), (8, 3): (None, 0.0)}
    for bad in ((pairs.union(pairs.limit(1)), feats, users), (pairs, feats.union(feats), users), (pairs, feats, users.union(users)), (pairs, feats, users.withColumn("year", F.lit(1)))):
        with pytest.raises(ValueError):
            X.rating_dataset(*bad, prefs, ["a", "c"])


def test_negative_draws_are_not_exploded(spark, monkeypatch):
    plans, write = [], G.written

    def told(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, *rest)

    monkeypatch.setattr(G, "written", told)
    index = spark.createDataFrame([(i, i + 100) for i in range(40)], "idx long, item_id long")
    wanted = spark.createDataFrame([(u, n) for u, n in enumerate((0, 3, 20, 39, 40, 60))], "user_id long, n int")
    seen = spark.createDataFrame([(u, 100 + i) for u in range(6) for i in range(0, 40, 7)] + [(1, 999)], "user_id long, item_id long")
    got = [tuple(r) for r in G.sample_negatives(wanted, seen, index).collect()]
    assert len(set(got)) == len(got) and not {i % 7 for u, i in got if (i - 100) % 7 == 0}
    assert [sum(u == x for x, _ in got) for u in range(6)] == [0, 3, 20, 34, 34, 34]
    assert "negatives" in [n for n, _ in plans]
    assert not [n for n, p in plans if n == "negatives" and "Generate explode(sequence" in p]


def test_user_vectors_have_no_row_a_component(spark):
    import math

    v = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [3.0, 4.0, 0.0]), (3, [-1.0, 0.0, -2.0]), (4, None)], "item_id long, vec array<double>")
    r = spark.createDataFrame([(7, 1, 5.0, 1), (7, 2, 3.0, 2), (7, 3, 1.0, 3), (8, 4, 5.0, 1), (9, 1, 4.0, 5), (9, 3, 4.0, 5), (9, 9, 5.0, 9)], "user_id long, item_id long, rating double, ts long")
    mean, recent = A.mean_vectors(r, v), A.recency_weighted_vector(A.liked_rows(r, threshold=3.0), v)
    for x in (mean, recent):
        assert "explode" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert {x["user_id"]: x["vec"] for x in mean.collect()} == {7: [2.0, 2.0, 1.0], 9: [0.0, 0.0, 0.0]}
    got = {x["user_id"]: x["vec"] for x in recent.collect()}
    w = [math.exp(-0.6), 1.0]  # rank 2 of 2, rank 1
    raw = [w[0] * a + w[1] * b for a, b in zip([1, 0, 2], [3, 4, 0], strict=True)]
    size = math.sqrt(sum(x * x for x in raw))
    assert all(abs(a - b / size) < 1e-9 for a, b in zip(got[7], raw, strict=True))
    assert sorted(got) == [7, 9]


def test_bm25_score_of_blocks_repeats_and_nulls(spark, monkeypatch):
    import random

    r = random.Random(7)
    weights = {(i, t): r.random() for i in range(60) for t in r.sample("abcdefghij", r.randint(1, 6))}
    index = spark.createDataFrame([(i, t, w) for (i, t), w in weights.items()], "item_id long, term string, weight double")
    asked = [(q, r.choices("abcdefghijxyz", k=r.randint(0, 7))) for q in range(150)] + [(5, ["a"]), (None, ["b"]), (200, None), (201, ["zz"])]
    sets = {}
    for q, terms in asked:
        sets.setdefault(q, set()).update(terms or [])
    want = {}
    for q, terms in sets.items():
        for (i, t), w in weights.items():
            if t in terms:
                want[q, i] = want.get((q, i), 0) + w
    monkeypatch.setattr(R, "SCORE_QUERIES", 40)  # several blocks, and products of a few documents
    monkeypatch.setattr(R, "SCORE_CELLS", 100)
    out = R.bm25_score(index, spark.createDataFrame(asked, "query_id long, terms array<string>"))
    got = {(x.query_id, x.item_id): x.score for x in out.collect()}
    assert got.keys() == want.keys() and out.count() == len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # no row is made of a query, a term and a document: the terms aren't exploded and joined with the index
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bm25_candidates_of_alike_items(spark):
    import random

    r = random.Random(8)
    post = [(i, t, c) for i in range(40) for t, c in {"abcdef"[(i // 3 + k) % 6]: 1 + k % 2 for k in range(1 + i % 3)}.items()]
    liked = [(u, i, 5.0, r.randint(0, 9)) for u in range(12) for i in r.sample(range(40), 2 + u % 4)]
    tokens = spark.createDataFrame(post, "item_id long, term string, tf long")
    index = R.bm25_fit(tokens, spark.createDataFrame([(40,)], "n long"))
    rows = spark.createDataFrame(liked, "user_id long, item_id long, rating double, ts long")
    users = spark.createDataFrame([(u,) for u in range(13)], "user_id long")
    out = R.bm25_candidates(rows, tokens, index, rows, users, last=3, n=7, digits=6)
    got = {u: [] for u in range(13)}
    for x in out.collect():
        got[x["user_id"]].append((-x["score"], x["item_id"]))
    weight = {}
    for x in index.collect():
        weight.setdefault(x["item_id"], {})[x["term"]] = x["weight"]
    for u in range(12):
        mine = sorted(((t, i) for v, i, _, t in liked if v == u), reverse=True)
        words = {t for _, i in mine[:3] for j, t, _ in post if i == j}
        want = sorted((-round(sum(w for t, w in ts.items() if t in words), 6), i) for i, ts in weight.items() if words & set(ts) and i not in {i for _, i in mine})[:7]
        assert [(round(s, 6), i) for s, i in sorted(got[u])] == want
    assert len(got[12]) == 7


def test_titles_in_quotation_marks_are_no_critique(spark):
    texts = ['funnier than "No", please', 'moreover "No" is fine', "hài hơn “No Drama”", 'no "horror', 'without drama, "more"']
    rows = V.parse_critique(spark.createDataFrame(list(enumerate(texts)), "n int, text string")).orderBy("n").collect()
    assert [x["is_critique"] for x in rows] == [True, False, True, True, True]
    assert [x["genre"] for x in rows] == ["Comedy", None, "Comedy", None, None]
    assert [x["exclude_genres"] for x in rows] == [[], None, [], [], ["Drama"]]


def test_unseen_totals_without_pairs(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 9)], "item_id long")
    seen = spark.createDataFrame([(1, 2), (1, 2), (1, 99), (2, 8)] + [(3, i) for i in range(1, 9)], "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "user_id long")
    want = {(r["user_id"], r["n"], r["s"]) for r in G.full_unseen_pool(users, seen, ids).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("item_id").alias("s")).collect()}
    assert {tuple(r) for r in G.unseen_totals(users, seen, ids).collect()} == want == {(1, 7, 34), (2, 7, 28), (4, 8, 36)}


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_asked_pairs_are_those_of_the_item(spark, block):
    import random

    r = random.Random(5)
    rows = [(u, i, r.randint(1, 10) / 2) for u in range(14) for i in r.sample(range(9), r.randint(1, 6))]
    asked = [(u, r.randrange(11)) for u in range(16)]
    by = {}
    for u, i, x in rows:
        by.setdefault(u, {})[i] = x
    want = set()
    for u, i in asked:
        for v in by:
            both = [(by[u][k], by[v][k]) for k in by.get(u, {}) if k in by[v]]
            if v != u and i in by[v] and both:
                want.add((u, i, v, len(both), sum(x * y for x, y in both), sum(x for x, _ in both), sum(y for _, y in both)))
    out = R.asked_pairs(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), spark.createDataFrame(asked, "user_id long, item_id long"), block=block)
    assert {(x["a"], x["item_id"], x["b"], x["n"], x["dot"], x["sum_a"], x["sum_b"]) for x in out.collect()} == want
