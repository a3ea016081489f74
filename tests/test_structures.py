import math

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.axes import leading_axes, sparse_gram_times
from plumbline.operators import graph as G
from plumbline.operators import identity as ID
from plumbline.operators import iterative as IT
from plumbline.sources import pages as P


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "src long, dst long, weight double")


def brute_betweenness(pairs):
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        order, dist, paths = [s], {s: 0}, {s: 1.0}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        gain = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    gain[v] += paths[v] / paths[w] * (1 + gain[w])
            if w != s:
                total[w] += gain[w]
    n = len(near)
    return {v: t / 2 / ((n - 1) * (n - 2) / 2) for v, t in total.items()}


def test_betweenness(spark):
    bow_tie = [(1, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 1), (3, 5, 1), (4, 5, 1)]
    star = [(0, i, 1) for i in range(1, 6)]
    wild = [(a, b, 1) for a in range(14) for b in range(a + 1, 14) if (a * 7 + b * 5) % 6 == 0]
    for pairs in (bow_tie, star, wild):
        got = {r.node: r.betweenness for r in IT.betweenness(graph(spark, pairs)).collect()}
        want = brute_betweenness(pairs)
        assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-9) for v in want)
    assert [r.betweenness for r in IT.betweenness(graph(spark, [(1, 2, 1)])).collect()] == [0.0, 0.0]
    assert IT.betweenness(graph(spark, []).where("false")).count() == 0


def test_communities(spark):
    two = [(1, 2, 1), (1, 3, 1), (2, 3, 1), (4, 5, 1), (4, 6, 1), (5, 6, 1), (3, 4, 0.1)]
    labels = {r.node: r.label for r in IT.label_propagation(graph(spark, two)).collect()}
    assert len({labels[i] for i in (1, 2, 3)}) == len({labels[i] for i in (4, 5, 6)}) == 1 and labels[1] != labels[4]
    sized = spark.createDataFrame([(1, 9), (2, 9), (3, 4)], "node long, label long")
    assert [(r.label, r.name) for r in G.compact_labels(sized).orderBy("name").collect()] == [(9, "c0"), (4, "c1")]


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "node long, needs long")
    assert sorted(map(tuple, G.transitive_closure(e).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]


def test_topics(spark):
    rows = [(d, f"{'ab'[d % 2]}{j}", 1.0 + (d + j) % 3) for d in range(12) for j in range(5)]
    x = spark.createDataFrame(rows, "doc long, term string, value double")
    w, h = IT.topics(x, 2, rounds=12)
    left, right = {r.doc: np.array(r.f) for r in w.collect()}, {r.term: np.array(r.f) for r in h.collect()}
    wrong = sum((v - left[d] @ right[t]) ** 2 for d, t, v in rows) / sum(v * v for *_, v in rows)
    assert wrong < 0.15 and min(v.min() for v in left.values()) >= 0
    shares = IT.topic_shares(w)
    top = {r.doc: r.topic for r in shares.where("dominant").collect()}
    assert len({top[d] for d in range(0, 12, 2)}) == 1 and len({top[d] for d in range(1, 12, 2)}) == 1 and top[0] != top[1]
    assert shares.groupBy("doc").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    labels = {r.topic: r.label for r in IT.topic_labels(h, 2).collect()}
    assert labels[top[0]].count("a") == 3 and labels[top[1]].count("b") == 3


def test_latent_vectors(spark):
    texts = [(1, "red blue green"), (2, "red blue green blue"), (3, "one two three"), (4, "two three one one"), (5, ""), (6, None)]
    v = {r.doc: np.array(r.vector) for r in IT.latent_vectors(spark.createDataFrame(texts, "id long, text string"), "id", T.words(F.col("text")), 2).collect()}
    assert v[1] @ v[2] > 0.9 and v[3] @ v[4] > 0.9 and abs(v[1] @ v[3]) < 0.1 and not v[5].any() and not v[6].any()


def test_latent_axes_equal_svd(spark):
    """The axes of the sparse rows are those of the dense matrix."""
    rng = np.random.default_rng(2)
    m = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    m[3] = 0
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for r in m]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>")
    got = leading_axes(lambda block: sparse_gram_times(df, block), 40, 3)
    want = np.linalg.svd(m)[2][:3].T
    assert np.allclose(np.abs(got.T @ want), np.eye(3), atol=1e-8)


def test_names(spark):
    names = ["LADLE, Richard J.", "R. Ladle", "Richard James Ladle", "Ricardo Ladle", "Ladle", "Ana Maria Souza", "Ana Souza", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    person = {r.name: r.person for r in ID.merge_names(df, "name").collect()}
    assert person["LADLE, Richard J."] == person["Richard James Ladle"] and person["Ricardo Ladle"] != person["Richard James Ladle"]
    assert person["Ladle"] == "Ladle" and person["Ana Souza"] == "Ana Maria Souza" and None not in person
    people = spark.createDataFrame([(1, "Richard James Ladle"), (2, "Ricardo Ladle"), (3, "Ana de Souza")], "person_id long, person string")
    got = {r.name: (r.person_id, r.tier) for r in ID.resolve(spark.createDataFrame([(n,) for n in ("Richard Ladle", "R. Ladle", "SOUZA, Ana", "Ladle", "Eva Melo")], "name string"), "name", people).collect()}
    assert got == {"Richard Ladle": (1, "inferred"), "R. Ladle": (None, None), "SOUZA, Ana": (3, "exact"), "Ladle": (None, None), "Eva Melo": (None, None)}


def greedy(spellings):
    """The rule of merged names over all spellings of a block, one by one: against every member of every group."""
    groups = []
    for name in sorted(spellings, key=lambda n: (-len(n.split()), -len(n), n)):
        home = next((g for g in groups if all(ID.compatible(name.split(), other.split()) for other in g)), None)
        groups.append([name]) if home is None else home.append(name)
    return {name: g[0] for g in groups for name in g}


def hot_block(n, seed):
    """n spellings of one initial and family name: words of up to three inner names, whole or as letters."""
    rng = random.Random(seed)
    inner, found = ["JO", "JA", "KIM", "KAY", "LU"], set()
    while len(found) < n:
        words = [rng.choice(["R", "RICHARD", "ROBERT", "RUTH"])] + [w[: rng.choice([1, 9])] for w in rng.choices(inner, k=rng.randrange(0, 4))]
        found.add(" " * rng.randrange(3) + " ".join(words) + " " * rng.randrange(1, 12) + "LADLE")
    return sorted(found)


def test_names_of_a_hot_block_equal_greedy(spark):
    spellings = hot_block(20_000, 5)
    df = spark.createDataFrame([(n,) for n in spellings] * 2, "name string")
    got = {r.name: r.person for r in ID.merge_names(df, "name").collect()}
    assert got == greedy(spellings)
    assert ID.merge_names(df.where("false"), "name").count() == 0


def test_groups_of_many_lists_equal_greedy():
    """Random word lists, with many words that occur once and words of one letter."""
    for seed in range(40):
        rng = random.Random(seed)
        words = ["A", "B", "C", *(c + str(i) for c in "ABC" for i in range(rng.choice([1, 3, 400])))]
        lists = sorted({tuple(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(200)}, key=lambda t: (-len(t), t))
        homes = []
        for tokens in lists:
            groups = dict.fromkeys(homes)
            fit = (g for g in groups if all(ID.compatible(list(tokens), list(lists[i])) for i, h in enumerate(homes) if h == g))
            homes.append(next(fit, len(homes)))
        assert ID.grouped([list(t) for t in lists]) == homes


def test_only_person_equals_all_pairs():
    for seed in range(40):
        rng = random.Random(seed)
        words = ["A", "B", "C", *(c + str(i) for c in "ABC" for i in range(rng.choice([1, 3, 60])))]
        some = lambda n: [rng.choices(words, k=rng.randrange(2, 6)) for _ in range(n)]
        asked, known = some(80), some(rng.choice([0, 5, 60]))
        fits = [[i for i, k in enumerate(known) if ID.compatible(a, k)] for a in asked]
        assert ID.only_fits(asked, known) == [f[0] if len(f) == 1 else None for f in fits]


def test_large_person_ids(spark):
    """Ids beyond 2^53, beside a null one, come back as they are."""
    people = spark.createDataFrame([(2**62 + 1, "Richard James Ladle"), (None, "Robert Ladle")], "person_id long, person string")
    said = spark.createDataFrame([("Richard Ladle",), ("R. Ladle",)], "name string")
    assert {r.name: r.person_id for r in ID.resolve(said, "name", people).collect()} == {"Richard Ladle": 2**62 + 1, "R. Ladle": None}


def test_pages(spark):
    html = "<title>A &amp; b</title><style>x{}</style><h1>Top <b>one</b></h1><a href='/p?q=1'>go</a><table><tr><th>k<td>v</table><dl><dt>n<dd>m</dl><img src=i.png alt=pic><script>no</script><form action=f></form>tail"
    df = spark.createDataFrame([(1, "http://x.y/d/", html), (2, None, None), (3, "http://x.y", "<a href='#t'><p>open")], "id long, url string, html string")
    parts = P.page_parts(df, "id", "url", "html").collect()
    one = [(r.kind, r.text, r.target) for r in parts if r.id == 1 and r.kind != "text"]
    assert one == [
        ("title", "A & b", None), ("heading", "Top one", None), ("link", "go", "http://x.y/p?q=1"), ("cell", "k", None), ("cell", "v", None), ("dt", "n", None), ("dd", "m", None),
        ("image", "pic", "http://x.y/d/i.png"), ("form", "get", "http://x.y/d/f"),
    ]
    assert not [r for r in parts if r.id == 2 or "no" == r.text] and [r.text for r in parts if r.id == 3 and r.kind == "link"] == ["open"]


def test_references_without_semicolon(spark):
    """A reference that a cut text ends in stays as it is written, and so do bullets in a title."""
    html = "<title>a &amp;&amp;&amp</title><title>b • &lt;c&gt; &am</title><title>&copy 2 &#65; &#66 &</title><a href='/p?a=1&copy=2&amp;b=3'>x</a>"
    parts = P.page_parts(spark.createDataFrame([(1, "http://x.y/", html)], "id long, url string, html string"), "id", "url", "html").collect()
    assert [r.text for r in parts if r.kind == "title"] == ["a &&&amp", "b • <c> &am", "&copy 2 A &#66 &"]
    assert [r.target for r in parts if r.kind == "link"] == ["http://x.y/p?a=1&copy=2&b=3"]


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b\'": [1, true, null, {}]}, "c": "x"}'), (2, "broken"), (3, None)], "id long, j string")
    got = {i: [(r.path, r.type, r.text) for r in P.json_leaves(df, "id", "j").where(F.col("id") == i).orderBy("ordinal").collect()] for i in (1, 2, 3)}
    assert got[1] == [("$['a']['b\\''][0]", "number", "1"), ("$['a']['b\\''][1]", "boolean", "true"), ("$['a']['b\\''][2]", "null", None), ("$['a']['b\\''][3]", "object", None), ("$['c']", "string", "x")]
    assert got[2] == got[3] == [("$", "error", None)]
