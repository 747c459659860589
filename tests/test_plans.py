"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from slatewise.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A spread over the modules; bench.py and the driver run the rest.
CHECKED = "mmr_cosine_slates item_tower_inputs user_tower_inputs evaluate_99 wide_catalogue search_text search_by_index search_genre_year_status trending_after flatten_catalogue refine_slates watchlist_state comment_likes item_stats user_profile funnel rating_summary leave_one_out time_split dense_ids random_split min_max union_channels tfidf_genres rank_fusion hash_embed pointwise_negatives per_user_scores ranking_metrics intra_list_diversity drift_report table_parity check_threads fallback_rate detect_intent parse_critique ranking_features ratings_round_trip weighted_negatives pool_99 evaluate_item_cf train_serve_parity backfilled_vectors clicks_of_requests committed_events links_round_trip tags_round_trip click_log_round_trip written_events paired_models check_ratings gate_vs_incumbent trending_stream session_items_stream parse_list_forms extract_names title_year extract_mentions knn_pearson knn_items_cosine candidates_similar candidates_personalised candidates_with_floor".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype != object and str(frame[c].dtype) != "str":
            frame[c] = frame[c].astype(float).round(6)
    return sorted(tuple("~" if v is None or v != v else str(float(v)) if isinstance(v, bool) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    assert _rows(QUERIES[name](spark, DIR).toPandas()) == _rows(duck.sql(ORACLES[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_complete():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recommend_all_serves_every_user(spark, duck):
    got = QUERIES["recommend_all"](spark, DIR).toPandas()
    assert _rows(got) == _rows(duck.sql(ORACLES["recommend_all"]).df())
    assert got["user_id"].nunique() == duck.sql("select count(distinct o_custkey) from orders").fetchall()[0][0]


def test_recommend_all_of_ties_and_few_items(spark):
    import random

    from slatewise.operators import features as X

    r = random.Random(4)
    for n, genres in ((4, "ab"), (60, "abcdefgh"), (200, "abcdefghijklmnop")):
        users = [(u, r.choice([0.5, 3.25]), r.sample(genres, min(len(genres), r.randint(0, 5)))) for u in range(12)]
        items = [(i, r.choice([1.0, 2.0, 2.1, 2.5, 2.7, 3.0]), [r.choice(genres) for _ in range(r.randint(1, 6))]) for i in range(n)]
        got = X.recommend_all(spark.createDataFrame(users, "user_id long, user_bias double, genre_set array<string>"), spark.createDataFrame(items, "item_id long, item_score double, genre_list array<string>"))
        want = [(u, i, s, k + 1) for u, b, g in users for k, (s, i) in enumerate(sorted(((round(s + b + 0.1 * len(set(x) & set(g)), 9), i) for i, s, x in items), key=lambda p: (-p[0], p[1]))[:10])]
        assert sorted(tuple(x) for x in got.select("user_id", "item_id", "score", "rank").collect()) == sorted(want)


def test_evaluate_full_ranks_every_held_out_user(spark, duck):
    got = QUERIES["evaluate_full"](spark, DIR).toPandas()
    assert _rows(got) == _rows(duck.sql(ORACLES["evaluate_full"]).df())


def test_unscored_items_come_last(spark):
    from slatewise.operators import evaluation as E

    pred = spark.createDataFrame([(1, 5), (2, 7), (3, 5)], "item_id long, pred long")
    truth = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 9)], "user_id long, item_id long")
    assert sorted(tuple(r) for r in E.shared_ranks(truth, pred).collect()) == [(10, 2), (11, 1), (12, 3), (13, 4)]
    assert E.shared_ranks(truth, pred.filter("false")).count() == 0


def test_similarity_export_lists_every_item(spark, duck, monkeypatch):
    import numpy as np

    from slatewise.operators import retrieval as R
    from slatewise.plans.interactions import vectors

    monkeypatch.setattr(R, "BLOCK_ROWS", 200)
    got = QUERIES["similarity_export"](spark, DIR).toPandas()
    assert sorted(got["item_id"]) == [i for (i,) in duck.sql("select vec_id from embeddings join part on p_partkey = vec_id order by 1").fetchall()]
    assert set(got["n"]) == {20}
    ids, vecs = zip(*duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall(), strict=True)
    m = np.array(vecs, float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    lists = {}
    v = vectors(spark, DIR)
    for r in R.neighbours(v, v, k=20, normalise=True).orderBy("query_id", "rank").collect():
        lists.setdefault(r["query_id"], []).append(r["score"])
    scores = m @ m.T
    np.fill_diagonal(scores, -9)
    assert sorted(lists) == list(ids)
    assert all(np.allclose(lists[i], -np.sort(-scores[n])[:20], atol=1e-4) for n, i in enumerate(ids))
