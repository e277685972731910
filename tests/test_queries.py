"""Every query that SQL can state gives DuckDB's rows, names and kinds of columns."""

import duckdb
import pytest

from chronofold.plans import registry
from chronofold.plans.tables import rounded

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = plain(map(tuple, got.select(*columns).collect()))
    assert rows
    if name in registry.ORACLES:
        names = ", ".join(f'"{c}"' for c in columns)
        assert sorted(oracle.sql(registry.ORACLES[name]).columns) == columns
        assert rows == plain(oracle.sql(f"SELECT {names} FROM ({registry.ORACLES[name].strip()})").fetchall())


def test_halves_are_rounded_as_in_the_sql(spark, tmp_path):
    """160 ratings whose mean is 3.01875: the feature, 0.5046875, stands just under the half as a double."""
    at = "TIMESTAMP '1996-05-01'"
    made = {
        "supplier": "SELECT 1::BIGINT AS s_suppkey",
        "part": "SELECT 1::BIGINT AS p_partkey, 'a' AS p_brand, 9.5::DOUBLE AS p_retailprice",
        "lineitem": f"SELECT (CASE WHEN i < 3 THEN 3 ELSE 2 END)::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 9::DOUBLE AS l_quantity, {at} AS l_shipdate FROM range(160) r(i)",
    }
    con = duckdb.connect()
    for t, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    name = "program_reviews_customer"
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert {r.rating for r in got.collect()} == {0.504687}
    assert plain(map(tuple, got.collect())) == plain(want)


def test_rounded_is_the_round_of_the_sql(spark, tmp_path):
    numbers = [0.5046875, -0.5046875, 5e-7, -5e-7, 0.49999999999999994, 123456789012.3456785, 1e305, -1e305, float("inf"), float("-inf"), float("nan"), None]
    numbers += [k / 640 for k in range(-640, 640)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i long, x double")
    df.coalesce(1).write.parquet(f"{tmp_path}/x")
    for digits in (2, 3, 4, 5, 6, 9):
        want = duckdb.sql(f"SELECT i, round(x, {digits}) FROM '{tmp_path}/x/*.parquet'").fetchall()
        show = lambda rows: sorted((i, repr(x + 0.0) if x is not None else "") for i, x in rows)
        assert show(map(tuple, rounded(df, digits).collect())) == show(want)


@pytest.mark.parametrize("name", ["column_runs", "context_tiers", "explicit_contexts", "visible_labels"])
def test_no_table_that_grows_goes_through_the_driver(spark, name):
    """Labels unfold to many times the rows that Spark guesses from the files, so a guessed broadcast gathers millions of them."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


@pytest.mark.parametrize("name", ["program_reviews_product", "program_reviews_customer"])
def test_reviews_are_dealt_once(spark, name):
    """Distinct counts neither multiply the reviews nor deal them anew, and products are not sent through the driver."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "BroadcastExchange" not in plan


def test_nearest_holds_few_cosines_at_once(spark):
    """6000 queries against 2000 rows: numpy's peak in a task, and the vectors found."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from chronofold.operators import similarity

    vectors = np.random.default_rng(1).normal(size=(6000, 8))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    class Shared:
        def broadcast(self, value):
            self.value = value
            return self

    class Rows:
        sparkSession = type("Session", (), {"sparkContext": Shared()})

        def mapInArrow(self, run, schema):
            return run

    run = similarity._against(Rows(), list(range(6000)), [None] * 6000, vectors, 3, "id")
    batch = pa.RecordBatch.from_arrays([pa.array(list(vectors[:2000])), pa.array(range(2000)), pa.nulls(2000, pa.int64())], ["v", "id", "t"])
    tracemalloc.start()
    found = next(iter(run([batch]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cos = unit @ unit[:2000].T
    cos[range(2000), range(2000)] = -2
    assert found["id"] == np.argsort(-cos, axis=1)[:, :3].ravel().tolist()
    assert peak < 120e6
