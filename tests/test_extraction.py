import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation as E
from plumbline.operators import records as RC
from plumbline.sources import pages as P


@pytest.fixture()
def leaves(spark):
    text = r"""{"Top": {"a": {"title": "deep"}, "TITLE": "near", "list": [{"year": "1999"}], "year": " "}, "rows": [{"row": {"n": 1}}, {"row": {"n": null}}, {"row": {"n": 3, "it's": "q"}}]}"""
    return P.json_leaves(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "{}", "z")], "id long, payload string, kind string"), "id", "payload")


def test_path_segments(spark):
    df = spark.createDataFrame([("$['a'][2]['it\\'s']",), ("$",), (None,)], "path string")
    assert [r[0] for r in df.select(RC.path_segments(F.col("path"))).collect()] == [["a", "2", "it's"], [], None]


def test_gather_takes_the_nearest_leaf_and_no_empty_ones(leaves):
    found = RC.gather(leaves, "id", {"row": "rows.*", "top": "Top", "never": "rows.row"}, {"title": ["name", "title"], "year": ["year"], "n": ["n"], "quoted": ["it's"]})
    rows = sorted((r["kind"], r["prefix"], r["title"], r["year"], r["n"], r["quoted"]) for r in found.collect())
    assert rows == [("row", "$['rows'][0]['row']", None, None, "1", None), ("row", "$['rows'][2]['row']", None, None, "3", "q"), ("top", "$['Top']", "near", None, None, None)]


def test_families_by_steps(spark):
    """Keys that are numbers are keys, quotes and backslashes count, indices stand anywhere, and a path that doesn't begin with steps has no family."""
    said = ["$['a'][1]['7']['x']", "$[0]['a']['it\\'s'][2][3]", "$['a']['b\\\\']['c'][0]['d']", "$['a']", "$.more['a']['k']", "$['z']['k']", None]
    df = spark.createDataFrame([(1, i, p, "v") for i, p in enumerate(said)] + [(1, 99, "$['a']['k']", " ")], "id long, ordinal long, path string, text string")
    got = {r.ordinal: (r.family, r.prefix, r.wildcard, r.rest, r.name, r.below) for r in RC.placed(df, "id", [("two", "a.*"), ("one", "a")]).collect()}
    assert got == {
        0: ("two", "$['a'][1]['7']", "7", "['x']", "x", 1),
        1: ("two", "$[0]['a']['it\\'s'][2][3]", "it's", "", None, 0),
        2: ("two", "$['a']['b\\\\']", "b\\", "['c'][0]['d']", "d", 2),
        3: ("one", "$['a']", "", "", "a", 0),
    }


def test_gather_of_nothing(leaves):
    assert RC.gather(leaves.where("id > 3"), "id", {"row": "rows.row"}, {"n": ["n"]}).count() == 0


def test_npmi(spark):
    presence = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (4, "z")], "doc long, term string")
    topics = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "c")], "topic string, term string")
    found = {r["topic"]: r["npmi"] for r in E.npmi_coherence(presence, "doc", topics, "topic", 4).collect()}
    assert found == {"x": pytest.approx(math.log(2 * 4 / 4) / -math.log(0.5)), "y": -1.0}


def test_distances_and_stress(spark):
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [3.0, 0.0]), ("q", [0.0, 2.0]), ("r", [-1.0, 0.0]), ("zero", [0.0, 0.0]), ("null", None)], "g string, v array<double>")
    found = {(r["a"], r["b"]): r["distance"] for r in E.group_distances(v, "g", "v").collect()}
    assert found == {("p", "q"): pytest.approx(1), ("p", "r"): pytest.approx(2), ("q", "r"): pytest.approx(1)}
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (0.5, 1.0)], "w double, s double")
    assert E.stress(pairs, "w", "s").first()["stress"] == pytest.approx(0, abs=1e-7)
    assert E.stress(pairs.withColumn("s", F.lit(0.0)), "w", "s").first()["stress"] == 1.0


def test_battery_against_brute_force(spark):
    rows = [("c", q, i, float((i * 7 + q) % 5), (i + q) % 4 == 0 and q != 3) for q in range(4) for i in range(30)]
    found = E.battery(spark.createDataFrame(rows, "channel string, query long, item long, score double, relevant boolean"), 10).first()
    mrr, ndcg = [], []
    for q in range(3):
        ranked = [r[4] for r in sorted((r for r in rows if r[1] == q), key=lambda r: (-r[3], r[2]))]
        mrr.append(1 / (ranked.index(True) + 1))
        ndcg.append(sum(x / math.log2(i + 2) for i, x in enumerate(ranked[:10])) / sum(1 / math.log2(i + 2) for i in range(min(10, sum(ranked)))))
    assert (found["cases"], found["mrr"], found["ndcg"]) == (3, pytest.approx(sum(mrr) / 3), pytest.approx(sum(ndcg) / 3))
