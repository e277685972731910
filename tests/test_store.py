"""A dataset folder through the encoder, its sinks and readers; the shared folder; imports and exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.operators import encode as E
from chronofold.operators import store as ST
from chronofold.sources import manifest as M
from chronofold.sources import shared

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture()
def dataset(spark, tmp_path):
    """Ten users and eighteen events of every kind of column, with a task of two splits."""
    users = spark.createDataFrame([(i, f"user {i}", "pro" if i % 3 == 0 else "free", 1.5 * i, i % 4 != 0) for i in range(10)], "user_id long, name string, plan string, credit double, active boolean")
    events = spark.createDataFrame([(i, i % 10, ["view", "click"][i % 2], float(i % 7), DAY + dt.timedelta(days=i)) for i in range(18)], "event_id long, user_id long, kind string, amount double, timestamp timestamp_ntz")
    labels = spark.createDataFrame([(i, DAY + dt.timedelta(days=9 + i), i % 2 == 0) for i in range(4)], "user_id long, timestamp timestamp_ntz, left boolean")
    manifest = M.Manifest.of({"users": {"pkey": "user_id"}, "events": {"pkey": "event_id", "time_col": "timestamp", "fkeys": {"user_id": "users"}}})
    task = M.Task("leaves", "users", "user_id", "left", "clf", "timestamp")
    M.write_database({"users": users.coalesce(1), "events": events.coalesce(1)}, manifest, f"{tmp_path}/d", {"leaves": (task, {"train": labels.limit(3).coalesce(1), "test": labels.where("user_id = 3").coalesce(1)})})
    return f"{tmp_path}/d"


def test_prepare_round_trip(spark, dataset, tmp_path):
    facts = ST.prepare(spark, dataset, f"{tmp_path}/out")
    assert facts["files"] == ["adjacency", "cells", "columns", "edges", "nodes", "tables", "vocab"]
    beside = sorted((r.place, r.child, r.upto) for r in ST.read(spark, f"{tmp_path}/out", "adjacency").where("parent = 18").collect())
    assert beside == [(0, 0, 1), (1, 29, 2), (2, 10, 3)]  # events on days 0 and 10, a label on day 9
    assert [(t["table"], t["split"], t["n"], t["node_offset"]) for t in facts["tables"]] == [("events", "db", 18, 0), ("users", "db", 10, 18), ("leaves", "test", 1, 28), ("leaves", "train", 3, 29)]
    out = f"{tmp_path}/out"
    assert facts["nodes"] == 32 == ST.read(spark, out, "nodes").count()
    edges = ST.read(spark, out, "edges").collect()
    assert {(r.child, r.parent) for r in edges if r.child_table == "events"} == {(i, 18 + i % 10) for i in range(18)}
    assert {(r.child, r.parent, r.child_split) for r in edges if r.child_table == "leaves"} == {(28, 21, "test"), (29, 18, "train"), (30, 19, "train"), (31, 20, "train")}
    assert all(r.child_ts == 1704067200 + 86400 * r.child for r in edges if r.child_table == "events")
    cells = ST.read(spark, out, "cells").collect()
    assert facts["cells"] == len(cells) == 18 * 3 + 10 * 4 + 4 * 2
    kinds = {(r.table, r.col): r.sem for r in cells}
    assert kinds == {("users", "name"): "text", ("users", "plan"): "text", ("users", "credit"): "number", ("users", "active"): "boolean", ("events", "kind"): "text", ("events", "amount"): "number", ("events", "timestamp"): "datetime", ("leaves", "timestamp"): "datetime", ("leaves", "left"): "boolean"}
    credit = sorted(r.num for r in cells if r.col == "credit")
    assert sum(credit) == pytest.approx(0, abs=1e-9) and sum(c * c for c in credit) / 9 == pytest.approx(1)
    # The test split is scored with the training split's mean 2/3 and deviation.
    assert [r.num for r in cells if r.col == "left" and r.split == "test"] == [pytest.approx((0 - 2 / 3) / (1 / 3) ** 0.5)]
    vocab = {r.text: r.txt_id for r in ST.read(spark, out, "vocab").collect()}
    assert {"users", "leaves", "credit of users", "pro", "user 7", "view"} <= set(vocab) and sorted(vocab.values()) == list(range(len(vocab)))
    names = {r.name: r.col_id for r in ST.read(spark, out, "columns").collect()}
    assert {(f"{r.col} of {r.table}", r.col_id) for r in cells} == set(names.items())
    assert ST.column_id(spark, out, "left", "leaves") == names["left of leaves"]
    with pytest.raises(KeyError):
        ST.column_id(spark, out, "left", "users")
    asked = spark.createDataFrame([(2,), (20,)], "node_id long")
    assert {r.node_id: r.ts for r in ST.times_of(spark, out, asked).collect()} == {2: 1704067200 + 2 * 86400, 20: None}
    assert M.read_meta(spark, out)["source"] == dataset and M.discover(spark, str(tmp_path)) == ["out"]


def test_prepare_options_and_batches(spark, dataset, tmp_path):
    facts = ST.prepare(spark, dataset, f"{tmp_path}/a", skip_tasks=True, skip_graph=True, source="here")
    assert facts["source"] == "here" and not facts["tasks"] and "edges" not in facts["files"] and facts["nodes"] == 28
    report = ST.prepare_many(spark, {"x": dataset, "y": f"{tmp_path}/none", "z": dataset}, f"{tmp_path}/many", skip_graph=True)
    assert report["x"] == report["z"] == "done" and report["y"] not in ("done", "skipped")
    assert ST.prepare_many(spark, {"x": dataset, "z": dataset}, f"{tmp_path}/many", index=0, of=2)["x"] == "skipped"


def test_keys_that_name_no_row_are_an_error(spark):
    t = M.Table("a", "id", None, {"up": "a"})
    bad = ST.sources_of([(t, "db", spark.createDataFrame([(0, 5, 0), (1, None, 1)], f"id long, up long, {ST.ROW} long"))])
    with pytest.raises(Exception, match="names no row"):
        ST.edges(bad).collect()
    with pytest.raises(ValueError):
        ST.edges(bad, fk="name")
    keyed = ST.sources_of([(t, "db", spark.createDataFrame([(42, 7, 0), (7, None, 1)], f"id long, up long, {ST.ROW} long"))])
    assert [(r.child, r.parent) for r in ST.edges(keyed, fk="key").collect()] == [(0, 1)]


def test_lists_of_keys_are_unfolded(spark):
    tables = [(M.Table("p", "id"), "db", spark.createDataFrame([(0, 0), (1, 1)], f"id long, {ST.ROW} long")), (M.Table("q", None, None, {"ps": "p"}), "db", spark.createDataFrame([([0, 1, None], 0), (None, 1)], f"ps array<long>, {ST.ROW} long"))]
    assert sorted((r.child, r.parent) for r in ST.edges(ST.sources_of(tables)).collect()) == [(2, 0), (2, 1)]


@pytest.mark.parametrize("partitions", [1, 3, 4, 8, 64])
def test_text_ids_are_dense_and_in_order(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        vocab = spark.range(15_000).select(F.concat(F.lit("t"), F.md5(F.col("id").cast("string"))).alias("text"), F.lit(1).alias("n"))
        got = sorted((r.text, r.txt_id) for r in E.with_text_ids(vocab).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [i for _, i in got] == list(range(15_000))


def test_positions_over_several_files(spark, tmp_path):
    for i, n in enumerate((3, 2, 4)):
        spark.range(10 * i, 10 * i + n).coalesce(1).write.parquet(f"{tmp_path}/t/part={i}")
    rows = M.with_row_key(spark.read.parquet(f"{tmp_path}/t"), "at").collect()
    assert sorted(r["at"] for r in rows) == list(range(9)) and [r.id for r in sorted(rows, key=lambda r: r["at"])] == [0, 1, 2, 10, 11, 20, 21, 22, 23]


def test_normalised_kinds(spark):
    df = spark.sql("SELECT DATE'2024-01-02' AS d, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, CAST('é' AS BINARY) AS b, array(1, 2) AS l, CAST(1.5 AS DECIMAL(5, 2)) AS m, INTERVAL '1 02:03:04.5' DAY TO SECOND AS i")
    row = E.normalised(df).first()
    assert row.d == dt.datetime(2024, 1, 2) and row.t == dt.datetime(2024, 1, 2, 3, 4, 5) and row.b == "é" and row.l == "[1,2]" and row.m == 1.5
    assert row.i == (86400 + 2 * 3600 + 3 * 60 + 4) * 10**6 + 500_000
    cell = spark.createDataFrame([("boolean",), ("text",)], "sem string")
    assert [r.sem for r in E.boolean_as_number(cell).collect()] == ["number", "text"]


def test_export_with_bound_parameters(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("numbers")
    assert M.export(spark, "SELECT id FROM numbers WHERE id >= ? AND id < ?", f"{tmp_path}/p", [3, 6]).count() == 3
    assert M.export(spark, "SELECT id FROM numbers WHERE id = :x", f"{tmp_path}/q", {"x": 4}).first().id == 4


def test_label_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("who,date,y\n1,2024-01-02,0.5\n")
    row = M.read_labels(spark, f"{tmp_path}/l.csv", "date").first()
    assert (row.who, row.date, row.y) == (1, dt.datetime(2024, 1, 2), 0.5)
    M.read_labels(spark, f"{tmp_path}/l.csv", "date").write.parquet(f"{tmp_path}/l.parquet")
    assert M.read_labels(spark, f"{tmp_path}/l.parquet", "date").first() == row


def test_a_shared_folder_is_asked_for_off_one_machine(spark):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default=None):
                return default

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Far)
    assert shared.shared_dir(spark)


def test_names_of_columns_and_pluggable_embeddings(spark):
    from chronofold.functions import scalars as S

    row = spark.createDataFrame([("day of week of shop",)], "n string").select(S.column_of("n"), S.table_of("n"), S.column_name(F.lit("a"), F.lit("b"))).first()
    assert tuple(row) == ("day of week", "shop", "a of b")
    texts = spark.createDataFrame([("ab",), ("ab",), ("c",), (None,)], "t string")
    assert {(r.t, tuple(r.embedding)) for r in E.embedded(texts, "t", lambda ts: [[len(t), 1] for t in ts], batch=1).collect()} == {("ab", (2.0, 1.0)), ("c", (1.0, 1.0)), (None, (0.0, 1.0))}
    assert {len(r.embedding) for r in E.embedded(texts, "t").collect()} == {64}
