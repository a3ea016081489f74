from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import graph as G
from plumbline.operators import ranking as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, " Análise  DE\tÇa ", T.fold) == "analise de ca"
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, "Íslândia, Nova!", T.slug) == "islandia-nova"
    assert one(spark, "LADLE, Richard J.", T.given_first) == "Richard J. LADLE"
    assert one(spark, "a, b, c", T.given_first) == "a, b, c"
    assert one(spark, "ANA DE SOUZA", T.display_person_name) == "Ana de Souza"
    for cited in ("(2019)", "(see Lima, 2020a; Reis 1999)", "www.x.org/a", "doi: 10.1234/ab.c", "10.1590/x-y", "SILVA COSTA, 2011", "[3; 4,5]", f"({'x' * 139} 2001)"):
        assert one(spark, f"so {cited} it is", T.scrub_citations) == "so it is", cited
    for kept in ("(no year)", "(12019)", "in 2019", "[a, 1]", f"({'x ' * 100}2001)", "10.5 or 2"):
        assert one(spark, f"so {kept} it is", T.scrub_citations) == f"so {kept} it is", kept
    assert one(spark, "as Silva et al. 2019 said (Lima, 2020) [1, 2] http://x.y z", T.scrub_citations) == "said z"
    assert one(spark, "2 of 30", T.first_int) == 2
    parts = spark.createDataFrame([(["a", "", "A", None, "b"],)], "p array<string>")
    assert parts.select(T.join_unique(F.col("p")).alias("y")).first().y == "a b"
    grams = spark.createDataFrame([(["ab"],)], "p array<string>").select(T.char_ngrams(F.col("p"), 3, 5).alias("y")).first().y
    assert grams == [" ab", "ab ", " ab "]


def bow_tie(spark):
    return spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0)], "src long, dst long, weight double")


def test_graph(spark):
    e = bow_tie(spark)
    assert {r.node: r.degree for r in G.degrees(e).collect()} == {1: 2, 2: 2, 3: 4, 4: 2, 5: 2}
    assert {r.node: r.triangles for r in G.triangles(e).collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "node long, community string")
    assert {r.node: r.bridging for r in G.bridging(e, labels).collect()} == {1: 0.0, 2: 0.0, 3: 0.5, 4: 0.5, 5: 0.5}
    far = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 0.1), (8, 9, 1.0)], "src long, dst long, weight double")
    assert {r.node: (round(r.cost, 6), r.hops) for r in G.cheapest_paths(far, 1, 3).collect()} == {1: (0.0, 0), 2: (1.0, 1), 3: (2.0, 2)}
    assert {r.node: r.component for r in G.min_labels(far).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert G.canonical(spark.createDataFrame([(2, 1, 1.0), (1, 2, 2.0), (3, 3, 1.0)], "src long, dst long, weight double")).collect() == [(1, 2, 3.0)]


def test_rankings(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([5, 1, 5, 3])], "g string, id long, v double")
    p = {r.id: r.p for r in df.select("id", R.percentile_rank(["g"], "v").alias("p")).collect()}
    assert p == {0: 87.5, 1: 25.0, 2: 87.5, 3: 50.0}
    c = R.concentration(df, ["g"], "v", 1).first()
    assert abs(c.gini - 0.25) < 1e-9 and abs(c.top_share - 5 / 14) < 1e-9
