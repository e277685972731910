"""Operators on small tables whose results are known."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalars as S
from chronofold.operators import context as C
from chronofold.operators import encode as E
from chronofold.operators import evaluate as V
from chronofold.operators import graph as G
from chronofold.operators import history as H
from chronofold.operators import predict as P
from chronofold.operators import similarity
from chronofold.sources import manifest as M

day = lambda text: dt.datetime.fromisoformat(text)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_scalars(spark):
    null = F.lit(None).cast("double")
    assert one(spark, S.log_scaled(null, 10)) == 0 and one(spark, S.log_scaled(F.lit(1e9), 10)) == 1 and one(spark, S.log_scaled(F.lit(-1.0), 10)) == 0
    assert one(spark, S.log_scaled(F.lit(3.0), 10)) == pytest.approx(math.log(4) / math.log(11))
    assert one(spark, S.decay(null, 100)) == pytest.approx(math.exp(-99.99)) and one(spark, S.decay(F.lit(9999), 87)) == pytest.approx(math.exp(-9999 / 87), rel=1e-12)
    assert one(spark, S.capped(null, 20, 13)) == 0.65 and one(spark, S.centred(F.lit(-99.0), 2)) == 0 and one(spark, S.ratio(F.lit(1), F.lit(0), 0.5)) == 0.5
    assert one(spark, S.finite(F.lit(float("nan")))) == 0 and one(spark, S.finite(F.lit(float("inf")))) == 0
    cross = S.days_between(F.lit("2020-01-02 01:00:00").cast("timestamp_ntz"), F.lit("2020-01-01 23:00:00").cast("timestamp_ntz"))
    assert one(spark, cross) == 1
    assert [one(spark, S.next_power_of_two(F.lit(n))) for n in (0, 1, 2, 3, 4, 5, 1024, 1025)] == [1, 1, 2, 4, 4, 8, 1024, 2048]
    assert one(spark, S.seconds(F.lit("1969-12-31 23:59:58.5").cast("timestamp_ntz"))) == -1
    assert one(spark, S.seconds(F.lit("2150-01-01").cast("timestamp_ntz"))) == 2**31 - 1
    assert one(spark, S.soft_clip(F.lit(5.0), -1, 1)) == pytest.approx(1 + math.log1p(5)) and one(spark, S.sigmoid(F.lit(0))) == 0.5


def racing(spark, drop=False):
    kinds = "entity long, node long, time timestamp_ntz, race long, team long"
    rows = [(42, 0, day("2020-01-01"), 12, 8), (42, 1, day("2020-01-03"), 13, 8), (7, 2, day("2020-01-01"), 12, 8), (42, 3, day("2020-01-02"), 14, 8)]
    race = {12: 300, 13: 301, 14: 302}

    def source(base, team):
        out = spark.createDataFrame([(e, base + n, t, r, c) for e, n, t, r, c in (rows[1:] if drop and base == 700 else rows)], kinds)
        at = F.create_map(*[F.lit(x) for kv in race.items() for x in kv])[F.col("race")]
        parents = [F.struct(at.cast("long").alias("node"), F.lit(3).alias("depth")), *([F.struct(F.lit(400).cast("long").alias("node"), F.lit(3).alias("depth"))] if team else []), F.struct(F.lit(450).cast("long").alias("node"), F.lit(4).alias("depth"))]
        return out.select("entity", "node", "time", F.array(*parents).alias("parents"))

    entities = spark.createDataFrame([(42, 100), (7, 101)], "entity long, node long")
    labels = spark.createDataFrame([(42, 501, day("2019-01-01")), (42, 502, day("2020-01-02")), (42, 503, day("2020-01-03")), (7, 504, day("2019-01-01"))], "entity long, node long, time timestamp_ntz")
    return entities, labels, [source(600, True), source(700, False), source(200, True)]


@pytest.mark.parametrize("time, width, drop, want", [
    ("2020-01-02", 1, False, [(100, 1), (501, 2), (603, 2), (302, 3), (400, 3), (450, 4), (703, 2), (203, 2)]),
    ("2018-01-01", 1, False, [(100, 1)]),
    ("2020-01-02", 2, False, [603, 703, 203, 600, 700, 200]),
    ("2020-01-02", 2, True, [603, 703, 203, 600, 200]),
])
def test_neighbourhood_order(spark, time, width, drop, want):
    entities, labels, sources = racing(spark, drop)
    targets = spark.createDataFrame([(1, 42, day(time))], "target long, entity long, cutoff timestamp_ntz")
    rows = C.neighborhood(targets, entities, labels, sources, width).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    if isinstance(want[0], tuple):
        assert [(r.node, r.depth) for r in rows] == want
    else:
        assert [(r.node, r.depth) for r in rows][:2] == [(100, 1), (501, 2)]
        assert [r.node for r in rows if r.depth == 2 and not 500 <= r.node < 600] == want


def test_neighbourhood_width_is_positive(spark):
    entities, labels, sources = racing(spark)
    with pytest.raises(ValueError, match="positive"):
        C.neighborhood(entities, entities, labels, sources, 0)


def test_as_of_ties_and_strictness(spark):
    facts = spark.createDataFrame([(1, day("2020-01-01"), 5, 1), (1, day("2020-01-01"), 6, 2), (1, day("2020-01-03"), 7, 3), (2, None, 8, 4)], "k long, t timestamp_ntz, v long, tie long")
    spine = spark.createDataFrame([(1, day("2020-01-01")), (1, day("2020-01-02")), (1, day("2020-01-03")), (2, day("2020-01-03"))], "e long, cutoff timestamp_ntz")
    got = {(r.e, r.cutoff.day): r.v for r in H.as_of(spine, facts, ("e", "k"), "t", ["v"], "tie").collect()}
    assert got == {(1, 1): None, (1, 2): 6, (1, 3): 6, (2, 3): None}
    loose = {(r.e, r.cutoff.day): r.v for r in H.as_of(spine, facts, ("e", "k"), "t", ["v"], "tie", strict=False).collect()}
    assert loose == {(1, 1): 6, (1, 2): 6, (1, 3): 7, (2, 3): None}


def users_and_events(spark):
    users = spark.createDataFrame([(i, f"user {i}", "pro" if i % 3 == 0 else "free", 1.5 * i, i % 4 != 0) for i in range(10)], "user_id long, name string, plan string, credit double, active boolean")
    events = spark.createDataFrame([(i, i % 10, "view" if i % 2 else "click", float(i % 7), day("2024-01-01") + dt.timedelta(days=i)) for i in range(18)], "event_id long, user_id long, kind string, amount double, timestamp timestamp_ntz")
    spec = M.Manifest.of({"users": {"pkey": "user_id", "unknown": 1}, "events": {"pkey": "event_id", "time_col": "timestamp", "fkeys": {"user_id": "users"}}})
    return users, events, spec


def test_encoding_round_trip(spark):
    users, events, spec = users_and_events(spark)
    stats = E.column_stats(users, spec.table("users"))
    times = E.datetime_stats({"events": events}, spec)
    cell = E.cells(users, spec.table("users"), F.col("user_id"), stats, times).collect()
    assert len(cell) == 40 and {(r.col, r.sem) for r in cell} == {("name", "text"), ("plan", "text"), ("credit", "number"), ("active", "boolean")}
    s = {r.col: r for r in stats.collect()}
    assert {r.row_idx: round(r.num * s["credit"]["std"] + s["credit"]["mean"], 9) for r in cell if r.col == "credit"} == {i: 1.5 * i for i in range(10)}
    assert times.first()["std"] == pytest.approx(np.std(np.arange(18)))
    edges = E.edges({"users": users, "events": events}, spec)
    assert {(r.child, r.parent) for r in edges.collect()} == {(i, i % 10) for i in range(18)}
    ids = E.with_text_ids(E.vocabulary([users.select("name"), users.select("plan")])).collect()
    assert sorted(r.txt_id for r in ids) == list(range(12)) and [r.text for r in sorted(ids, key=lambda r: r.txt_id)] == sorted(r.text for r in ids)


def test_constant_and_missing_values_make_no_wrong_cells(spark):
    df = spark.createDataFrame([(1, 2.0, True, float("nan")), (2, 2.0, True, None), (3, None, True, 4.0)], "k long, a double, b boolean, c double")
    t = M.Table("t", "k")
    stats = E.column_stats(df, t)
    assert {r.col: (r.n, r.std) for r in stats.collect()} == {"a": (2, 1.0), "b": (3, 1.0), "c": (1, 1.0)}
    none = spark.createDataFrame([(0, None, None)], "n long, mean double, std double")
    assert {(r.row_idx, r.col, r.num) for r in E.cells(df, t, F.col("k"), stats, none).collect()} == {(1, "a", 0.0), (2, "a", 0.0), (1, "b", 0.0), (2, "b", 0.0), (3, "b", 0.0), (3, "c", 0.0)}
    with pytest.raises(TypeError):
        E.value_columns(spark.sql("SELECT map(1, 2) AS m"), t)


def test_list_foreign_keys_and_embeddings(spark):
    posts = spark.createDataFrame([(1, [2, None, 3]), (2, None)], "p long, tags array<long>")
    tags = spark.createDataFrame([(2,), (3,)], "t long")
    spec = M.Manifest.of({"tags": {"pkey": "t"}, "posts": {"pkey": "p", "fkeys": {"tags": "tags"}}})
    assert {(r.child, r.parent) for r in E.edges({"posts": posts, "tags": tags}, spec).collect()} == {(1, 2), (1, 3)}
    vectors = {r.t: np.array(r.embedding) for r in E.hashed_embedding(spark.createDataFrame([("red apple",), ("red apples",), ("zzz",)], "t string"), "t").collect()}
    assert np.linalg.norm(vectors["zzz"]) == pytest.approx(1) and vectors["red apple"] @ vectors["red apples"] > 0.7


def test_expansion_rules(spark):
    edges = spark.createDataFrame([(10, 1, 5), (11, 1, 9), (12, 1, None), (1, 0, None)], "child long, parent long, child_ts long")
    seeds = spark.createDataFrame([(10, 10, 5), (12, 12, None)], "seed long, node long, ts long")
    got = {(r.seed, r.node): r.depth for r in G.bfs(seeds, edges, 3).collect()}
    assert got == {(10, 10): 0, (10, 1): 1, (10, 0): 2, (10, 12): 2, (12, 12): 0, (12, 1): 1, (12, 0): 2}
    sizes = spark.createDataFrame([(i, 2) for i in (0, 1, 10, 12)], "node long, cells long")
    assert {r.node for r in G.bounded(G.bfs(seeds.where("seed = 10"), edges, 3), sizes, 5).collect()} == {10, 1}
    timeless = spark.createDataFrame([(12, None)], "source long, ts long")
    visits = {r.node: r.visits for r in G.visits(timeless, edges, 3, same_table=1000).collect()}
    assert visits == pytest.approx({1: 1.0, 0: 0.25, 10: 0.25, 11: 0.25})


def test_seeds(spark):
    seeds = spark.createDataFrame([(1, i, i, i in (2, 5)) for i in range(1, 7)], "s long, node long, r long, positive boolean")
    rows = C.balanced(seeds, "s", "r", "positive", 0).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 7)) and all(rows[i].positive != rows[i + 1].positive for i in (0, 2)) and not any(r.positive for r in rows[4:])
    facts = spark.createDataFrame([(i, day("2020-01-01") + dt.timedelta(hours=7 * i)) for i in range(40)], "node long, time timestamp_ntz")
    drawn = C.fallback(facts.select(F.col("node").alias("target")), facts, 3, 1).collect()
    assert drawn and all(r.node < r.target for r in drawn) and max(sum(r.target == t for r in drawn) for t in range(40)) == 3
    cells = spark.createDataFrame([(day("2020-01-01"), None, "a"), (day("2020-01-01"), day("2020-01-01"), "a"), (None, None, "a"), (None, None, "b")], "tt timestamp_ntz, t timestamp_ntz, c string")
    assert C.label_leak(cells, "tt", "t", "c", ["a"]).count() == 2


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None), (61, [0.0] * 8), (62, [1.0])], "i long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in similarity.nearest(rows.where("i < 5"), rows, 3, "i", "v").collect():
        order = [j for j in np.argsort(-(unit @ unit[r["query"]])) if j != r["query"]]
        assert order[r["rank"] - 1] == r["i"]


def test_predictors():
    x = np.array([[1.0, 3], [2, 3], [3, 3]])
    assert P.ridge_solution(x, np.array([1.0, 2, 3]), np.array([4.0, 3]), 1e-9, False) == pytest.approx(4)
    assert P.ridge_solution(x, np.array([0.0, 1, 1]), np.array([3.0, 3]), 1.0, True) > 0.6


def test_ridge_rules_and_boosting(spark):
    rows = [(1, False, 2.0, 1.0), (1, True, None, 5.0), (2, True, None, 1.0), (3, False, 4.0, 0.0), (3, False, 4.0, 1.0), (3, True, None, 9.0)]
    sets = spark.createDataFrame(rows, "target long, is_target boolean, label double, f double")
    assert {r.target: r.prediction for r in P.ridge_prediction(sets, ["f"], "clf").collect()} == {1: 0.5, 2: 0.5, 3: 4.0}
    data = spark.createDataFrame([(i, float(i % 2), float(i % 2) + i / 1000) for i in range(60)], "target long, label double, f double")
    guess = P.boosted_prediction(data, data, ["f"], "clf", maxIter=3).join(data, "target").collect()
    assert all((r.prediction > 0.5) == (r.label == 1) for r in guess)


def test_scores(spark):
    rows = [(103, 1, 0.9), (100, 0, 0.1), (101, 1, 0.8), (102, 0, 0.2)]
    scored = spark.createDataFrame(rows, "node long, label int, prediction double")
    assert V.auroc(scored).first().auroc == 1.0 and V.auroc(scored.where("label = 1")).first().auroc is None
    tied = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.5), (3, 1, 0.7)], "node long, label int, prediction double")
    assert V.auroc(tied).first().auroc == 0.75
    assert V.partial_scores(scored.limit(2), scored, "node", "roc_auc").first().metric == "subset_roc_auc"
    assert V.partial_scores(scored, scored, "node", "roc_auc").first().metric == "roc_auc"
    labels = scored.select("node", "label")
    assert V.submission(scored.drop("label"), labels, "clf", []).count() == 4
    with pytest.raises(Exception, match="predicted twice"):
        V.submission(scored.drop("label").union(scored.drop("label")), labels, "clf", []).collect()


@pytest.mark.parametrize("name", ["", "../x", "a/b", ".", "a b"])
def test_names_are_plain(name):
    with pytest.raises(ValueError):
        M.safe_name(name)


def test_database_round_trip(spark, tmp_path):
    users, events, spec = users_and_events(spark)
    task = M.Task("spend", "users", "user_id", "amount", "reg", "timestamp")
    root = f"file://{tmp_path}/shop"
    M.write_database({"users": users.coalesce(1), "events": events}, spec, root, {"spend": (task, {"train": events.limit(5), "test": events.limit(2)})})
    base = M.Database.load(spark, root)
    assert base.manifest == spec and base.names == ["events", "users"] and base.tasks["spend"].fkeys == {"user_id": "users"}
    assert {r.split for r in base.labels("spend").collect()} == {"train", "test"} and base.table("users", "row").where("row <> user_id").count() == 0
    assert base.register("t_") == ["t_events", "t_users"] and spark.table("t_users").count() == 10
    M.write_meta(spark, root, rows=10)
    assert M.read_meta(spark, root) == {"format": 1, "rows": 10} and M.discover(spark, f"file://{tmp_path}") == ["shop"]
    assert M.resolve(spark, "shop", [f"file://{tmp_path}/none", f"file://{tmp_path}"]) == root
    assert M.share_of(["c", "a", "b", "d"], 1, 2, {"d"}) == ["b"]
    with pytest.raises(FileNotFoundError):
        base.labels("none")


def test_import_is_all_or_nothing(spark, tmp_path):
    users, events, _ = users_and_events(spark)
    for n, df in (("one", users), ("two", events)):
        df.write.parquet(f"{tmp_path}/in/{n}.parquet")
    spark.sql("DROP DATABASE IF EXISTS chronofold_test CASCADE")
    spark.sql(f"CREATE DATABASE chronofold_test LOCATION 'file://{tmp_path}/db'")
    assert M.import_tables(spark, f"file://{tmp_path}/in", "chronofold_test") == [("one", 10), ("two", 18)]
    with pytest.raises(ValueError, match="exist already"):
        M.import_tables(spark, f"file://{tmp_path}/in", "chronofold_test")
    spark.sql("DROP DATABASE chronofold_test CASCADE")
