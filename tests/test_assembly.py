import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import choices as C
from plumbline.operators import frontier as FR
from plumbline.operators import iterative as IT
from plumbline.operators import nested as NE
from plumbline.sources import pages as P


def some_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 5 else 5)
    if kind >= 5:
        keys = ["a", "b'", "c\\", "d\"'\\'", "", "[0]", "']['", "é\n"]
        return {k: some_value(rng, depth + 1) for k in rng.sample(keys, rng.randrange(4))} if kind < 7 else [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return (None, True, rng.randrange(100), 1.5, rng.choice(["", "x\"y\\z", "é\t", "{}"]))[kind]


def deep(n):
    return '{"a":[' * n + "1" + "]}" * n


def test_rebuilt_objects(spark):
    rng = random.Random(3)
    given = [(i, json.dumps(some_value(rng))) for i in range(200)] + [(900, '"only"'), (901, "{}"), (902, "[]"), (903, "null"), (904, "broken"), (None, '{"n": [1, {"m": 2}]}'), (905, deep(60))]
    df = spark.createDataFrame(given, "id long, j string")
    leaves = P.json_leaves(df, "id", "j").checkpoint()
    for given_leaves in (leaves, leaves.orderBy(F.xxhash64("id", "ordinal")).union(leaves)):
        got = {r.id: r.json for r in NE.rebuilt(given_leaves, "id").collect()}
        for i, text in given:
            assert json.loads(got[i]) == (None if text == "broken" else json.loads(text)), text
    again = P.json_leaves(spark.createDataFrame(list(got.items()), "id long, j string"), "id", "j").where("id <> 904")
    assert sorted(map(str, again.collect())) == sorted(map(str, leaves.where("id <> 904").collect()))


def test_rebuilt_from_odd_leaves(spark):
    leaves = [(1, 5, "$['a'][2]", "number", "3"), (1, 1, "$['b']", "number", "1"), (1, 2, "$['a'][10]", "number", "11"), (1, 3, "$['a'][2]", "string", "first"), (1, 4, "$['c']", "number", "0"), (1, 6, "$['c']['d']", "null", None)]
    df = spark.createDataFrame(leaves, "id long, ordinal long, path string, type string, text string").withColumn("steps", F.lit(1))
    assert NE.rebuilt(df, "id").first().json == '{"b":1,"a":["first",11],"c":{"d":null}}'
    assert NE.rebuilt(df.where("false"), "id").count() == 0


def test_deep_json_is_no_crash(spark):
    df = spark.createDataFrame([(n, deep(n)) for n in (100, 400, 3000, 200_000)], "id long, j string")
    got = {r.id: (r.type, r.n) for r in P.json_leaves(df, "id", "j").select("id", "type", F.length("path").alias("n")).collect()}
    assert got[100] == ("number", 1 + 100 * 8) and got[400] == ("number", 1 + 400 * 8) and got[200_000][0] == "error" and len(got) == 4


def slow_frontier(seeds, links, depth, pages):
    queue, seen, out = [(u, 0) for u, _ in sorted(seeds, key=lambda s: s[1])], {u for u, _ in seeds}, []
    while queue:
        u, d = queue.pop(0)
        for a, _, b in sorted((x for x in links if x[0] == u), key=lambda x: (x[1], x[2] or "")):
            if b is not None and b not in seen and d < depth and len(out) < pages:
                seen.add(b)
                out.append((b, d + 1, len(out) + 1, u))
                queue.append((b, d + 1))
    return out


@pytest.mark.parametrize("depth,pages", [(1, 100), (3, 7), (4, 12), (6, 1000), (0, 5), (3, 0)])
def test_frontier_equals_a_queue(spark, depth, pages):
    rng = random.Random(depth * 100 + pages)
    links = [(f"u{rng.randrange(30)}", i, rng.choice([None, *(f"u{j}" for j in range(40))])) for i in range(90)] + [("u0", 500 + i, f"hub{i:03}") for i in range(60)]
    seeds = [("u0", 2), ("u1", 1), ("nowhere", 3)]
    got = FR.frontier(spark.createDataFrame(seeds, "url string, place long"), spark.createDataFrame(links, "url string, ordinal long, target string"), depth, pages)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == slow_frontier(seeds, links, depth, pages)


def slow_communities(edges, rounds=40):
    near = {}
    for a, b, w in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {}).setdefault(y, 0)
                near[x][y] += w
    label = {n: n for n in near}
    for _ in range(rounds):
        moved = False
        for n in sorted(near, key=lambda n: (-len(near[n]), n)):
            votes = {}
            for m, w in near[n].items():
                votes[label[m]] = votes.get(label[m], 0) + w
            best = min(votes, key=lambda k: (-round(votes[k], 9), k))
            moved |= best != label[n]
            label[n] = best
        if not moved:
            break
    return label


def test_communities_in_order(spark):
    for seed in range(6):
        rng = random.Random(seed)
        n, m = rng.choice([(12, 18), (30, 45), (40, 200), (25, 24)])
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([1.0, 2.0, 0.5])) for _ in range(m)]
        edges += [(i, i + 1, 1.0) for i in range(0, 12)] if seed % 2 else []  # a chain, through which labels travel in one round
        got = {r.node: r.label for r in IT.label_propagation(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
        assert got == slow_communities(edges)


FORM = """<form action="/go" id=f><input type=hidden name=t value="a&amp;b"><input name=q><input type=checkbox name=c checked><input type=radio name=r value=1>
<select id=s><option>One  two<option value=2 selected>Two<option value=3 selected>Three</select><select name=m multiple><option value=x selected>X</option><option value=y>Y</option></select>
<textarea name=n> keep
 this </textarea><button name=b value=go>Go <b>on</b></button></form><input type=hidden name=out><form method=POST><select name=z><option value=''>none</option><option value=1>1"""


def test_controls(spark):
    df = spark.createDataFrame([(1, "http://x.y/d/", FORM), (2, None, None), (3, "http://x.y", "<p>no form <select><option>a</select>")], "id long, url string, html string")
    rows = [tuple(r)[1:] for r in P.page_controls(df, "id", "url", "html").orderBy("ordinal").collect()]
    assert [r[:4] for r in rows] == [(0, "f", "http://x.y/go", "get")] * 11 + [(1, None, "http://x.y/d/", "post")] * 2 and [r[4] for r in rows] == list(range(13))
    assert [r[5:] for r in rows] == [
        ("hidden", "t", "a&b", "", None), ("text", "q", "", "", None), ("checkbox", "c", "on", "", True), ("radio", "r", "1", "", False),
        ("option", "s", "One two", "One two", False), ("option", "s", "2", "Two", False), ("option", "s", "3", "Three", True),
        ("option", "m", "x", "X", True), ("option", "m", "y", "Y", False), ("textarea", "n", " keep\n this ", "keep this", None), ("button", "b", "go", "Go on", None),
        ("option", "z", "", "none", True), ("option", "z", "1", "1", False),
    ]


def test_result_rows(spark):
    html = """<table><tr><td><img src=p.png><span class="nome big">Ana  <b>Lima</b></span><span class=dep>Bio<tr><td><span class=nome>x</span></tr><tr><td><a href="/portal.jsf?v=1&amp;siape= 7 ">see</a><span class=nome>Eva</span>
    <a href="portal.jsf?siape=7">again</a><a href=portal.jsf?siape=>none</a></tr></table><a href="/portal.jsf?siape=9">Rui <i>Sá</i></a><a href="/other?siape=1">no</a>"""
    df = spark.createDataFrame([(1, "http://x.y/d/l", html), (2, "u", None)], "id long, url string, html string")
    rows = [tuple(r)[1:] for r in P.result_rows(df.withColumn("name", F.lit(1)), "id", "url", "html", "portal.jsf", "siape", "nome", "dep").collect()]
    assert rows == [(0, "7", "Eva", "", "http://x.y/portal.jsf?v=1&siape= 7 ", ""), (1, "9", "Rui Sá", "", "http://x.y/portal.jsf?siape=9", "")]


def test_contributions_and_annexes(spark):
    skills = spark.createDataFrame([(1, "a", 9, False), (1, "b", 9, False), (1, "c", 5, False), (1, "g", 99, True), (2, None, 4, False), (3, "c", 1, None), (3, "a", 2, False)], "plan long, skill string, mentions long, generic boolean")
    offers = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("g", "never")], "skill string, key string")
    defaults = spark.createDataFrame([("y", 1), ("z", 2), ("w", 3), ("v", 4)], "key string, place long")
    texts = spark.createDataFrame([(k,) for k in ("x", "y", "w", "v", "never")], "key string")
    assert sorted(map(tuple, C.contributions(skills, offers, defaults, texts).collect())) == [(1, 1, "x"), (1, 2, "y"), (2, 1, "y"), (2, 3, "w"), (3, 1, "x"), (3, 2, "y")]
    annexes = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("q", "g"), ("r", None)], "annex string, skill string")
    got = {(r.plan, r.annex): (r.overlap, r.emphasised) for r in C.emphasised(skills, annexes).collect()}
    assert got == {(1, "p"): (2, True), (1, "q"): (1, False), (1, "r"): (0, False), (2, "p"): (0, False), (2, "q"): (0, False), (2, "r"): (0, False), (3, "p"): (1, False), (3, "q"): (1, False), (3, "r"): (0, False)}


def test_looks(spark):
    nodes = spark.createDataFrame([(1, 0, 4.0, 50.0), (2, 6, None, None), (3, None, 1.0, float("nan"))], "id long, place int, v double, fit double")
    got = C.node_size(nodes, "v").select("id", C.community_facet(F.col("place")).alias("f"), "size", C.fit_opacity(F.col("fit")).alias("o")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "cluster 0", 17.0, 0.57), (2, "smaller clusters", 5.0, 0.8), (3, "not measured", 11.0, 0.8)]
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (3, 4, 0.0)], "src long, dst long, weight double")
    got = C.reach_style(edges, spark.createDataFrame([(1,), (2,), (2,)], "node long")).orderBy("src").collect()
    assert [(r.stroke, r.opacity, round(r.width, 6)) for r in got] == [("good", 0.75, 3.0), ("accent", 0.95, 2.9), ("border-strong", 0.22, 0.6)]
