import json

import pytest

from chronofold.plans import tasks as K
from chronofold.sources.manifest import Files, Table


def test_selection():
    every = [K.TaskSpec("a", "x", "y", "clf"), K.TaskSpec("a", "z", "y", "reg", "val"), K.TaskSpec("b", "x", "y", "reg")]
    assert K.include_list("# all\na\n b/x # one\n\n") == ["a", "b/x"]
    assert K.select(every, ["a"], "reg") == [every[1]] and K.select(every, ["b/x"]) == [every[2]] and K.select(every, split="val") == [every[1]]
    with pytest.raises(ValueError, match="no such"):
        K.select(every, ["c"])


def test_stored_features_and_logs(spark, tmp_path):
    root = f"file://{tmp_path}"
    K.store_features(spark.createDataFrame([(1, 0.5), (2, 0.25)], "node long, f double"), f"{root}/f")
    got = K.stored_features(spark, f"{root}/f", spark.createDataFrame([(2,), (9,)], "node long"))
    assert {(r.node, r.f) for r in got.collect()} == {(2, 0.25), (9, None)}
    log = K.RunLog()
    with log.stage("one"):
        log.metric(name="auroc", value=0.5)
    log.write(spark, f"{root}/run")
    assert json.loads(Files(spark).read(f"{root}/run/runtime.json"))["stages"].keys() == {"one"}
    df = spark.createDataFrame([(1, True, 2.0, "x")], "k long, b boolean, n double, t string")
    assert [(t.target, t.task_type) for t in K.autocomplete_tasks("d", df, Table("t", "k"))] == [("b", "clf"), ("n", "reg")]
    context = spark.createDataFrame([(1, 5, "orders", 0, 0), (1, 5, "orders", 0, 1)], "target long, node long, table string, depth long, pos long")
    assert K.context_summary(context).first().cells == 2
