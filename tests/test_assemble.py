"""Contexts on a small graph, their checks, and what reads them; repairs of seeds, means, scores and nearest vectors."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import assemble as A
from chronofold.operators import context as C
from chronofold.operators import evaluate as V
from chronofold.operators import graph as G
from chronofold.operators import predict as P
from chronofold.operators import similarity

NODES = [(1, "user", "db", None), (2, "user", "db", None), (10, "buy", "db", 5), (11, "buy", "db", 15), (12, "buy", "db", 25), (20, "left", "train", 10), (21, "left", "train", 20), (22, "left", "test", 30), (23, "left", "train", 20), (30, "other", "train", 8)]
EDGES = [(10, 1, "buy", "db", 5), (11, 1, "buy", "db", 15), (12, 1, "buy", "db", 25), (20, 1, "left", "train", 10), (21, 1, "left", "train", 20), (22, 1, "left", "test", 30), (23, 2, "left", "train", 20), (30, 1, "other", "train", 8)]
CELLS = [(1, "user", "name", 0, "text", None, "u1"), (2, "user", "name", 0, "text", None, "u2"), *[(i, "buy", "price", 1, "number", float(i), None) for i in (10, 11, 12)], *[(i, "left", "y", 2, "number", v, None) for i, v in ((20, 1.0), (21, 0.0), (23, 1.0))], (22, "left", "y", 2, "number", 1.0, None), (30, "other", "z", 3, "number", 7.0, None)]


@pytest.fixture(scope="module")
def graph(spark):
    return (
        spark.createDataFrame(NODES, "node_id long, table string, split string, ts long"),
        spark.createDataFrame(EDGES, "child long, parent long, child_table string, child_split string, child_ts long"),
        spark.createDataFrame(CELLS, "node_id long, table string, col string, col_id int, sem string, num double, text string"),
    )


def test_contexts_show_the_past_of_their_own_table(spark, graph):
    nodes, edges, cells = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(21,), (22,)], "node_id long"))
    found = A.contexts(nodes, edges, cells, targets, "y", length=20)
    got = {t: [(r.node, r.depth) for r in sorted(found.where(f"target = {t}").collect(), key=lambda r: r.pos)] for t in (21, 22)}
    # Its own value first, then the user, its buys and labels no later; never another task's label rows.
    assert got[21] == [(21, 0), (1, 1), (10, 2), (11, 2), (20, 2)]
    assert got[22] == [(22, 0), (1, 1), (10, 2), (11, 2), (12, 2), (20, 2), (21, 2)]
    assert A.contexts(nodes, edges, cells, targets, "y", length=3).groupBy("target").count().where("count > 3").count() == 0
    bare = A.contexts(nodes, edges, cells, targets, "y", length=20, skip_text=True, local=4)
    assert {(r.target, r.node) for r in bare.collect()} == {(21, 21), (21, 10), (22, 22), (22, 10)}
    assert A.contexts(nodes, edges, cells.where("node_id <> 22"), targets, "y", length=20).select("target").distinct().count() == 1


def test_leaking_columns_of_the_same_time_go(spark, graph):
    nodes, edges, cells = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(21,)], "node_id long"))
    other = spark.createDataFrame([(21, 23, 1)], "target long, seed long, rank int")
    shown = lambda **kw: {r.node for r in A.contexts(nodes, edges, cells, targets, "y", length=20, similar=other, **kw).collect()}
    assert 23 in shown() and 23 not in shown(leakage=["y"]) and 21 in shown(leakage=["y"])


def test_tiers_take_a_seed_once_and_share_visited_depths(spark, graph):
    nodes, *_ = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(22,)], "node_id long"))
    similar = spark.createDataFrame([(22, 21, 1), (22, 20, 2), (22, 22, 3)], "target long, seed long, rank int")
    fallback = spark.createDataFrame([(22, 20, 1), (22, 23, 2), (22, 99, 3)], "target long, seed long, rank int")
    labelled = spark.createDataFrame([(20,), (21,), (23,)], "seed long")
    tiers = A.seed_tiers(targets, similar, fallback, labelled)
    assert [(r.seed, r.tier) for r in sorted(tiers.collect(), key=lambda r: r.place)] == [(22, 0), (21, 1), (20, 1), (23, 2)]
    reached = spark.createDataFrame([(22, 22, 0), (22, 1, 1), (22, 5, 2), (21, 5, 1), (21, 1, 1), (20, 5, 1), (23, 5, 0)], "seed long, node long, depth int")
    got = sorted((r.place, r.node, r.depth, r.first) for r in A.collected(tiers, reached).collect())
    assert got == [(0, 1, 1, True), (0, 5, 2, True), (0, 22, 0, True), (1, 5, 1, False), (3, 5, 0, False)]


def test_visible_sets_and_means(spark, graph):
    nodes, edges, cells = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(20,), (22,), (23,), (30,)], "node_id long"))
    context = A.contexts(nodes, edges, cells, targets, "y", length=20, similar=spark.createDataFrame([(23, 21, 1)], "target long, seed long, rank int"))
    sets = A.visible_sets(context, "left", "y", [6, 20])
    assert sorted((r.target, r.ctx_size, r.node, r.label) for r in sets.collect()) == [(22, 6, 20, 1.0), (22, 20, 20, 1.0), (22, 20, 21, 0.0), (23, 6, 21, 0.0), (23, 20, 20, 1.0), (23, 20, 21, 0.0)]
    parents = spark.createDataFrame([(20, [1]), (21, [1]), (22, [1]), (23, [2]), (30, [1])], "node long, parents array<long>")
    assert A.matching(sets, parents, targets).count() == sets.count()  # no label of user 2: all are taken
    means = {(r.target, r.ctx_size): (r.labels, r.prediction) for r in A.context_means(targets, context, sets, [6, 20], "clf").collect()}
    assert means == {(20, 6): (0, 0.5), (20, 20): (0, 0.5), (22, 6): (1, 1.0), (22, 20): (2, 0.5), (23, 6): (1, 0.0), (23, 20): (2, 0.5), (30, 6): (0, 0.5), (30, 20): (0, 0.5)}


def test_checks_find_each_fault(spark, graph):
    nodes, *_ = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(20,), (21,)], "node_id long"))
    bad = spark.createDataFrame([(20, 99), (20, 1), (20, 1), (20, 12), (77, 1)], "target long, node long")
    assert {r.check: r.found for r in A.check_contexts(bad, nodes, targets).collect()} == {"unknown node": 1, "double node": 1, "later node": 1, "unknown target": 1, "missing target": 1}
    orders = spark.createDataFrame([(21, 1, 20), (21, 1, 23), (21, 2, 20), (21, 3, 10), (20, 1, 98), (77, 1, 20)], "target long, rank int, node long")
    assert {r.check: r.found for r in A.check_seed_orders(orders, nodes, targets, complete=True).collect()} == {"unknown node": 1, "double node": 1, "double rank": 1, "other table": 1, "not earlier": 1, "unknown target": 1, "missing target": 0}


def test_viewer_frames(spark, graph):
    nodes, edges, cells = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(21,)], "node_id long"))
    context = A.contexts(nodes, edges, cells, targets, "y", length=20)
    assert {(r.table, r.cells) for r in A.summary(context, "table").collect()} == {("left", 2), ("user", 1), ("buy", 2)}
    assert {(r.table, r.col, r.nodes) for r in A.summary(context, "col").collect()} == {("left", "y", 2), ("user", "name", 1), ("buy", "price", 2)}
    assert {(r.child, r.parent) for r in A.context_edges(context, edges).collect()} == {(10, 1), (11, 1), (20, 1), (21, 1)}
    placed = A.runs(A.by_column(context), "col_id").orderBy("place").collect()
    assert [(r.col_id, r.starts) for r in placed] == [(0, True), (1, True), (1, False), (2, True), (2, False)]
    shown = spark.createDataFrame([("text", None, "x" * 50), ("number", 1.23456, None)], "sem string, num double, text string")
    assert [r[0] for r in shown.select(A.shown_cell(F.col("sem"), F.col("num"), F.col("text"), 5)).collect()] == ["xxxx…", "1.235"]


def test_items_and_configs(spark):
    targets = spark.range(300).select(F.col("id").alias("target"), F.pmod("id", F.lit(3)).alias("task"))
    capped = A.item_cap(targets, ["task"], 7, 1)
    assert capped.groupBy("task").count().where("count <> 7").count() == 0 and A.item_cap(targets, ["task"], None).count() == 300
    drawn = A.draw_config(targets, [5, 6], "width", 1)
    assert {r.width for r in drawn.collect()} == {5, 6} and drawn.count() == 300


@pytest.mark.parametrize("seed", range(5))
def test_fallback_fills_up(spark, seed):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i // 3)) for i in range(12)], "node long, time timestamp_ntz")
    got = C.fallback(rows.select(F.col("node").alias("target")), rows, 2, seed).collect()
    for t in range(12):
        mine = [r.node for r in got if r.target == t]
        fitting = {i for i in range(12) if i // 3 <= t // 3 and i != t}
        assert len(mine) == len(set(mine)) == min(2, len(fitting)) and set(mine) <= fitting
    assert sorted((r.node, r.place, r.upto) for r in C.by_time(rows, "time", "node").collect()) == [(i, i, 3 * (i // 3) + 3) for i in range(12)]


def test_global_means_between_label_times(spark):
    at = lambda m, d=1: dt.datetime(2024, m, d)
    labels = spark.createDataFrame([(1, at(1), 1.0), (2, at(2), 0.0), (2, at(2), None), (1, at(4), 1.0)], "entity long, time timestamp_ntz, label double")
    targets = spark.createDataFrame([(0, 1, at(1)), (1, 1, at(3)), (2, 9, at(2)), (3, 2, at(5))], "target long, entity long, cutoff timestamp_ntz")
    got = {r.target: (r.global_mean, r.entity_mean) for r in P.label_features(targets, labels).collect()}
    assert got == {0: (None, None), 1: (0.5, 1.0), 2: (1.0, None), 3: (pytest.approx(2 / 3), 0.0)}


def test_a_hub_shows_its_width(spark):
    edges = spark.range(100_000).select(F.col("id").alias("child"), F.lit(-1).cast("long").alias("parent"), F.when(F.col("id") % 2 == 0, F.col("id") * 3600).alias("child_ts"))
    seeds = spark.createDataFrame([(-1, -1, 3600 * 500), (-2, -1, None), (-3, -1, 3600 * 99_999)], "seed long, node long, ts long")
    got = G.bfs(seeds, edges, 1, width=4, seed=3).where("depth = 1").collect()
    from hashlib import md5

    rank = lambda c: (md5(f"3|-1|{c}".encode()).hexdigest(), c)
    for seed, fits in ((-1, lambda c: c % 2 or c <= 500), (-2, lambda c: c % 2), (-3, lambda c: True)):
        assert sorted(r.node for r in got if r.seed == seed) == sorted(sorted(filter(fits, range(100_000)), key=rank)[:4])


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_auroc_in_bins(spark, monkeypatch, bins):
    monkeypatch.setattr(V, "BINS", bins)
    rng = np.random.default_rng(0)
    rows = [(int(g), int(y), float(np.round(s, 1))) for g, y, s in zip(rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.normal(size=400), strict=True)] + [(7, 1, 0.2), (7, 1, 0.5)]
    df = spark.createDataFrame(rows, "g int, label int, prediction double")

    def brute(own):
        pos, neg = [s for _, y, s in own if y], [s for _, y, s in own if not y]
        return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) if pos and neg else None

    got = {r.g: r.auroc for r in V.auroc(df, ["g"]).collect()}
    assert got == {g: pytest.approx(brute([r for r in rows if r[0] == g])) if g < 7 else None for g in (0, 1, 2, 7)}
    assert V.auroc(df).first().auroc == pytest.approx(brute(rows))


def test_nearest_in_blocks_and_before_a_time(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 200)
    monkeypatch.setattr(similarity, "ROWS", 7)
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(60, 4)), rng.integers(0, 9, 60)
    rows = [(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(x, t, strict=True))] + [(60, [0.0] * 4, 1), (61, None, 1), (62, [1.0], 1), (63, [1.0, None, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, t long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for time in (None, "t"):
        got: dict = {}
        for r in similarity.nearest(df.where("id < 25"), df, 3, "id", "v", time).collect():
            got.setdefault(r.query, []).append((r["rank"], r.id))
        for q in range(25):
            cos = u @ u[q]
            able = [i for i in range(60) if i != q and (time is None or t[i] <= t[q])]
            assert [i for _, i in sorted(got.get(q, []))] == sorted(able, key=lambda i: (-round(cos[i], 9), i))[:3]


def test_submissions_align_by_node(spark, tmp_path):
    truth = spark.createDataFrame([(i, i, dt.datetime(2020, 1, 1), i % 2) for i in range(4)], "row long, driverId long, date timestamp_ntz, label int")
    given = lambda rows: spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(rows)], "node long, prediction double, place int")
    score = lambda rows: V.score_submission(given(rows), truth, "clf", "rel", "top3", ["driverId", "date"], str(tmp_path), offset=100)
    part = score([(103, 2.0), (100, -2.0)])
    assert (part["metric"], part["value"], part["n"]) == ("subset_roc_auc", 1.0, 2) and part["path"].endswith("rel__top3.partial.csv")
    lines = (tmp_path / "rel__top3.partial.csv").read_text().splitlines()
    assert lines[0] == "driverId,date,prediction" and [x.split(",")[0] for x in lines[1:]] == ["3", "0"] and lines[1].split(",")[1] == "2020-01-01 00:00:00"
    whole = score([(103, 2.0), (100, -2.0), (101, 2.0), (102, -2.0)])
    assert (whole["metric"], whole["value"], whole["n"]) == ("roc_auc", 1.0, 4) and whole["path"].endswith("rel__top3.csv")
    with pytest.raises(ValueError, match="duplicate"):
        score([(100, 0.0), (100, 0.0)])
    with pytest.raises(ValueError, match="no row"):
        score([(99, 0.0)])
    assert score([(101, 0.2), (103, 0.5)])["value"] is None
    out = V.write_predictions(spark.createDataFrame([(1, 0.5), (2, 0.25)], "who long, prediction double"), f"{tmp_path}/p", ["who"])
    assert out.count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        V.write_predictions(out.union(out), f"{tmp_path}/q", ["who"])


def test_task_audit_counts_faults(spark):
    labels = spark.createDataFrame([(0, 5, dt.datetime(2020, 1, 1)), (1, None, dt.datetime(2020, 1, 2)), (2, 6, dt.datetime(2020, 1, 3)), (3, 7, dt.datetime(2020, 1, 4))], "row long, who long, at timestamp_ntz")
    day = 1577836800
    nodes = spark.createDataFrame([(100, day), (101, day + 86400), (102, day), (104, day)], "node_id long, ts long")
    parents = spark.createDataFrame([(100, 5), (102, 9)], "child long, parent_row long")
    got = {r.check: r.found for r in V.task_audit(labels, nodes, parents, "who", "at", "row", 100).collect()}
    assert got == {"null entity or time": 1, "label without node": 1, "node without label": 1, "other time": 1, "other parent": 2}


def test_linear_and_logistic_predictions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = 1 + x @ [2.0, -3.0]
    rows = [(1, False, float(v), *map(float, r)) for r, v in zip(x, y, strict=True)] + [(1, True, None, 0.5, 0.25), (2, False, 4.0, 1.0, 1.0), (2, True, None, 1.0, 1.0), (3, False, 4.0, 1.0, 1.0), (3, False, 4.0, 2.0, 1.0), (3, True, None, 9.0, float("nan"))]
    sets = spark.createDataFrame(rows, "target long, is_target boolean, label double, a double, b double")
    assert {r.target: r.prediction for r in P.regression_prediction(sets, ["a", "b"], "reg").collect()} == {1: pytest.approx(1.25), 2: 0.0, 3: 4.0}
    labels = (rng.random(40) < 1 / (1 + np.exp(-x @ [1.0, 1.0]))).astype(float)
    guess = P.linear_solution(x, labels, np.array([1.0, 1.0]), True)
    full = np.column_stack([np.ones(40), x])
    w = np.zeros(3)
    for _ in range(20_000):  # plain gradient descent on the same penalised loss
        w -= 0.01 * (full.T @ (1 / (1 + np.exp(-full @ w)) - labels) + np.array([0, 1, 1]) * w)
    assert guess == pytest.approx(1 / (1 + np.exp(-(w @ [1, 1, 1]))), abs=1e-4)
    filled, row = P.imputed(np.array([[1.0, np.nan], [3.0, np.inf]]), np.array([np.nan, 5.0]))
    assert filled.tolist() == [[1, 0], [3, 0]] and row.tolist() == [2, 5]


def test_boosted_settings_and_early_stop(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"clf": {"maxIter": 3}}))
    assert P.tuned_settings("reg")["maxIter"] == 200 and P.tuned_settings("clf", f"{tmp_path}/t.json")["maxIter"] == 3
    rows = spark.range(200).select(F.col("id").alias("target"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    got = P.boosted_prediction(rows, rows, ["x"], "clf", stop_share=0.3, **{**P.tuned_settings("clf", f"{tmp_path}/t.json"), "minInstancesPerNode": 1})
    assert V.auroc(got.join(rows, "target")).first().auroc == 1.0
    same = P.identity_prediction(rows, "x").first()
    assert same.prediction == float(same.target % 10)


def test_a_whole_run_with_every_predictor(spark, graph):
    from chronofold.plans import evaluation as EV
    from chronofold.plans.tasks import RunLog

    nodes, edges, cells = graph
    targets = A.explicit_targets(nodes, spark.createDataFrame([(20,), (21,), (22,), (23,)], "node_id long"))
    truth = spark.createDataFrame([(20, 1.0), (21, 0.0), (22, 1.0), (23, 0.0)], "target long, label double")
    setting = EV.Setting("left", "y", "clf", (6, 20))
    features = lambda asked: asked.withColumns({"a": F.col("node_id").cast("double"), "b": F.lit(1.0)})
    want = {"mean": {20: 0.5, 21: 1.0, 22: 0.5, 23: 0.5}, "identity": {20: 20.0, 21: 21.0, 22: 22.0, 23: 23.0}}
    for name, predictor in EV.PREDICTORS.items():
        got = EV.predictions(nodes, edges, cells, targets, setting, predictor, featurizer=features).where("ctx_size = 20").collect()
        assert {r.target for r in got} == {20, 21, 22, 23} and all(0 <= r.prediction <= 23 for r in got)
        if name in want:
            assert {r.target: r.prediction for r in got} == want[name]
    log = RunLog()
    lines = EV.run(nodes, edges, cells, targets, truth, setting, EV.mean_predictor, log)
    assert [x["ctx_size"] for x in lines] == [6, 20] and log.metrics == lines and lines[1]["value"] == pytest.approx((0 + 0.5 + 0 + 0.5) / 4)
    both = EV.ensemble(nodes, edges, cells, targets, setting, EV.mean_predictor, [1, 2], lambda s: spark.createDataFrame([(20, 23, s)], "target long, seed long, rank int"))
    assert {(r.target, r.ctx_size): r.members for r in both.collect()} == {(t, s): 2 for t in (20, 21, 22, 23) for s in (6, 20)}
    scored = spark.createDataFrame([("t", 1, 0.5), ("t", 2, 0.9), ("u", 1, None)], "task string, config int, value double")
    assert [(r.task, r.config) for r in EV.tuned(scored, "clf").collect()] == [("t", 2)]
    vectors = spark.createDataFrame([(20, 1, [1.0, 0.0]), (21, 5, [1.0, 0.1]), (22, 9, [0.9, 0.1])], "node_id long, ts long, vector array<double>")
    near = EV.knn_seeds(vectors, targets, 2)
    assert {(r.target, r.seed, r["rank"]) for r in near.collect()} == {(21, 20, 1), (22, 21, 1), (22, 20, 2)}
    again = EV.latest_first(near, vectors.select(F.col("node_id").alias("seed"), "ts"))
    assert {(r.target, r.seed, r["rank"]) for r in again.collect()} == {(21, 20, 1), (22, 21, 1), (22, 20, 2)}


def test_sampled_walks_agree_with_expected_visits(spark):
    edges = spark.createDataFrame([(10, 1, 5), (11, 1, 15), (12, 1, 25), (13, 1, None), (10, 2, 5), (14, 2, 7), (1, 100, None), (2, 100, None)], "child long, parent long, child_ts long")
    sources = spark.createDataFrame([(10, 20), (14, 6), (13, None)], "source long, ts long")
    exact = {(r.source, r.node): r.visits for r in G.visits(sources, edges, 6, same_table=1000, least=0).collect()}
    drawn = {(r.source, r.node): r.visits for r in G.walk_sample(sources, edges, 3000, 6, same_table=1000).collect()}
    assert set(drawn) == set(exact) and not [k for k in exact if k[0] == 10 and k[1] == 12]
    assert max(abs(drawn[k] - v) for k, v in exact.items()) < 0.06
