"""Vectors, topics and maps against numpy, names and files against plain Python."""

import json
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import identity as ID
from plumbline.operators import matching as MT
from plumbline.operators import records as RC
from plumbline.operators import ranking as R
from plumbline.operators import semantics as S
from plumbline.operators import typed_graph as TG
from plumbline.sources import files as FS


def unit_rows(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0)


def test_term_vectors_equal_svd(spark):
    rng = np.random.default_rng(1)
    m = rng.random((12, 12)) * (rng.random((12, 12)) < 0.6)
    m = m @ np.diag(np.linspace(4, 0.1, 12))
    pairs = spark.createDataFrame([(f"t{i:02}", f"t{j:02}", float(m[i, j])) for i in range(12) for j in range(12) if m[i, j] > 0], "a string, b string, pmi double")
    got = {r.term: r.vector for r in S.term_vectors(pairs, 3, rounds=25).collect()}
    u, s, _ = np.linalg.svd(m)
    want = unit_rows(u[:, :3] * np.sqrt(s[:3]))
    mine = np.array([got[f"t{i:02}"] for i in range(12)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-4)
    near = S.nearest_terms(S.term_vectors(pairs, 3, rounds=25), "t00", 3).collect()
    order = sorted(range(1, 12), key=lambda i: -(want @ want.T)[0, i])[:3]
    assert [r.term for r in near] == [f"t{i:02}" for i in order]
    assert S.nearest_terms(S.term_vectors(pairs, 3), "unknown", 3).count() == 0


def test_document_vectors(spark):
    rng = np.random.default_rng(2)
    v = unit_rows(rng.standard_normal((6, 4)))
    tf = rng.integers(0, 4, (9, 6))
    terms = spark.createDataFrame([(d, f"t{i}", int(tf[d, i])) for d in range(9) for i in range(6) if tf[d, i]], "doc int, term string, tf long")
    vectors = spark.createDataFrame([(f"t{i}", v[i].tolist()) for i in range(6)], "term string, vector array<double>")
    w = 1e-3 / (1e-3 + tf.sum(0) / tf.sum())
    mean = (tf * w) @ v / tf.sum(1, keepdims=True)
    common = np.linalg.eigh(mean.T @ mean)[1][:, -1:]
    want = unit_rows(mean - mean @ common @ common.T)
    got = {r.doc: r.vector for r in S.document_vectors(terms, vectors, 4).collect()}
    assert np.allclose([got[d] for d in range(9)], want, atol=1e-9)


def test_maps(spark):
    points = np.array([[0, 0], [3, 0], [0, 4], [3, 4], [1, 1]], float)
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    x = S.principal_coordinates(d)
    assert np.allclose(np.linalg.norm(x[:, None] - x[None], axis=2), d) and S.stress_of(d, x) < 1e-6
    bent = d + np.abs(np.subtract.outer(range(5), range(5))) * 0.7
    flat = S.principal_coordinates(bent)
    assert S.stress_of(bent, S.smoothed(bent, flat)) <= S.stress_of(bent, flat)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(5) for j in range(i + 1, 5)], "a int, b int, distance double")
    rows = S.group_map(pairs).orderBy("point").collect()
    got = np.array([(r.x, r.y) for r in rows])
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), d, atol=1e-6)
    assert S.group_map(pairs.where("false")).count() == 0
    assert S.principal_coordinates(np.zeros((1, 1))).shape == (1, 2)


def test_axes_of_wide_vectors(spark):
    """2,560 columns, with a flat end of the spectrum; no row and rows without a vector are no crash."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 2560)) @ np.diag(np.r_[[9, 7, 6, 5], np.ones(2556)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)] + [(900, None)], "id int, vector array<double>").checkpoint()
    got = {r.id: np.array(r.vector) for r in S.projected(df, "id", 2560, 4).collect()}
    axes = np.linalg.svd(m, full_matrices=False)[2][:4].T
    want = unit_rows(m @ (axes * np.where(axes.max(0) >= -axes.min(0), 1.0, -1.0)))
    assert sorted(got) == list(range(300)) and np.allclose([got[i] for i in range(300)], want, atol=1e-6)
    assert S.projected(df.where("false"), "id", 0, 4).count() == 0


def test_projected_and_placed(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((20, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(20)], "id int, vector array<double>")
    got = np.array([r.vector for r in S.projected(df, "id", 5, 2).orderBy("id").collect()])
    want = unit_rows(m @ np.linalg.svd(m)[2][:2].T)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9)
    h = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "term string, f array<double>")
    x = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "b", 2.0), (3, "zz", 1.0)], "doc int, term string, value double")
    shares = {r.doc: r.f for r in S.placed_on_topics(x, h, 2).collect()}
    assert set(shares) == {1, 2} and np.allclose(shares[1], [0.75, 0.25]) and np.allclose(shares[2], [0, 1], atol=1e-6)


def test_matching(spark):
    asked = spark.createDataFrame([(1, "José &amp; Silva", "Física"), (2, "Ana Maria Costa", ""), (3, "Zed Zed", "x"), (4, "Ana Marta Costa", "y")], "id long, name string, unit string")
    known = spark.createDataFrame([(10, "JOSE SILVA", "Dep de Fisica"), (11, "Ana Maria Costa", "x"), (12, "Ana Maria Costa", "z"), (13, "Ana Mario Costas", "y")], "known_id long, name string, unit string")
    scored = MT.candidates(asked, known, "name", "unit")
    for r in scored.join(asked.select("id", MT.match_key(F.col("name")).alias("x")), "id").join(known.select("known_id", MT.match_key(F.col("name")).alias("y")), "known_id").collect():
        ratio = 1.0 if r.x == r.y else SequenceMatcher(None, r.x, r.y).ratio()
        assert 0.9 * ratio <= r.score + 1e-9 <= 0.9 * ratio + 0.1 + 2e-9
    got = {r.id: (r.known_id, r.verdict) for r in MT.decided(scored).collect()}
    assert got[1] == (10, "exact") and got[2] == (None, "ambiguous_exact") and 3 not in got and got[4][1] in ("fuzzy", "ambiguous_or_low_score")
    options = spark.createDataFrame([("Instituto de Física - Maceió",), ("Letras",)], "option string")
    found = {r.asked: r.option for r in MT.best_option(spark.createDataFrame([("fisica",), ("letra",), ("zzz",), ("",)], "asked string"), options).collect()}
    assert found == {"fisica": "Instituto de Física - Maceió", "letra": "Letras"}


LEAVES = [
    ("$['cv']['works'][0]['item']['title']", "First"), ("$['cv']['works'][0]['item']['YEAR']", "2001"), ("$['cv']['works'][0]['year']", "1999"), ("$['cv']['works'][0]['authors'][0]['name']", "B"),
    ("$['cv']['works'][0]['authors'][0]['order']", "2"), ("$['cv']['works'][0]['authors'][1]['name']", "A"), ("$['cv']['works'][0]['authors'][1]['lead']", "sim"), ("$['cv']['works'][0]['authors'][2]['order']", "9"),
    ("$['cv']['works'][1]['year']", "2005"), ("$['cv']['other']['some']['title']", "It's"), ("$['cv']['works'][0]['area9']['general']", "G"), ("$['cv']['works'][0]['area9']['special']", "S"), ("$['cv']['works'][0]['area8']['general']", "G"),
]


def test_records(spark):
    df = spark.createDataFrame([(1, i, p, x) for i, (p, x) in enumerate(LEAVES)], "k long, ordinal long, path string, text string")
    fields = {"title": ["title"], "year": ["year"]}
    families = [RC.Family("other", "cv.*.some", fields), RC.Family("work", "cv.works", fields, form="work")]
    rows = {(r.family, r.form): (r.title, r.year) for r in RC.shape(df, "k", families, "s").collect()}
    assert rows == {("work", "work"): ("First", "1999"), ("other", "other"): ("It's", None)}  # the untitled one is dropped, the nearest year wins
    people = RC.people(df, "k", families, {"authors": "author"}, ["name"], ["order"], "lead").orderBy("ordinal", "name").collect()
    assert [(p.ordinal, p.name, p.role) for p in people] == [(2, "A", "responsible"), (2, "B", "author")]
    assert [r.areas for r in RC.areas(df, "k", families, "area", ["special", "general"]).collect()] == [["S", "G"]]
    assert [r.texts for r in RC.matching_leaves(df, "k", families, "^name$").collect()] == [["B", "A"]]
    ids = [r.record_id for r in RC.shape(df, "k", families, "s").collect()]
    assert len(set(ids)) == 2 and all(len(i) == 16 for i in ids)


def test_career(spark):
    ties = [(1, "a", "r1", 1990, 1995, 0), (1, "b", "r2", 1996, None, 1), (1, "c", "r3", 1992, None, 2), (2, "", "", 1990, 1991, 0), (3, "x", "y", None, None, 0)]
    df = spark.createDataFrame(ties, "k int, kind string, role string, start int, end int, ordinal int")
    got = {r.k: tuple(r)[1:] for r in RC.career(df, ["k"]).collect()}
    assert got == {1: (1990, None, "current", "b", "r2"), 2: (1990, 1991, "past", "appointment", ""), 3: (None, None, "", "x", "y")}


def test_table_rows(spark):
    rows = [(0, ["Disciplina", "Nome", "CH"]), (1, ["2020.1"]), (2, ["C1", "Calculus", "60h", "seg"]), (3, ["2021.2"]), (4, ["C2", "", "60h"]), (5, ["C3", "Algebra", "x"])]
    df = spark.createDataFrame([("u", i, c) for i, c in rows], "url string, nth int, cells array<string>")
    got = [tuple(r)[1:] for r in RC.course_rows(df, ["url"], "nth").orderBy("code").collect()]
    assert got == [("C1", "Calculus", 2020, "past", "60h"), ("C3", "Algebra", 2021, "current", "")]
    projects = spark.createDataFrame([("u", 0, ["Código", "Título"]), ("u", 1, ["PIB12-2019", "Name", "Detalhes"]), ("u", 2, ["2020.1"]), ("u", 3, ["X", "Y", "Bio"])], "url string, nth int, cells array<string>")
    assert [tuple(r)[1:] for r in RC.project_rows(projects, ["url"], "nth").orderBy("code").collect()] == [("PIB12-2019", "Name", 2019, None), ("X", "Y", 2020, "Bio")]


def test_invalid_edges_raise(spark):
    entities = spark.createDataFrame([("p:1", "p"), ("w:1", "w")], "entity_id string, kind string")
    edges = lambda *rows: spark.createDataFrame(rows, "source string, relation string, target string")
    allowed = {"wrote": [("p", "w")]}
    assert TG.validated(edges(("p:1", "wrote", "w:1")), entities, allowed).count() == 1
    for bad in (("p:1", "wrote", "w:2"), ("w:1", "wrote", "p:1"), ("p:1", "read", "w:1"), ("p:1", "wrote", "p:1")):
        with pytest.raises(ValueError, match="invalid edges"):
            TG.validated(edges(bad), entities, allowed)


def test_percentile_equals_window(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), None if x < -1.8 else float(np.round(x, 1))) for g, x in zip(rng.integers(0, 3, 500), rng.standard_normal(500), strict=True)] + [(None, 1.0), (None, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = sorted(map(str, R.with_percentile(df, ["g"], "v", "p").select("g", "v", F.round("p", 9)).collect()))
    assert got == sorted(map(str, df.select("g", "v", F.round(R.percentile_rank(["g"], "v"), 9)).toDF("g", "v", "round(p, 9)").collect()))
    tied = df.withColumn("id", F.monotonically_increasing_id())
    placed = sorted(map(str, R.with_place(tied, ["g"], "v", "id", "p").select("id", "p").collect()))
    assert placed == sorted(map(str, tied.select("id", R.ordinal_rank(["g"], "v", "id").alias("p")).collect()))
    assert R.with_percentile(df.where("false"), ["g"], "v", "p").count() == 0


def test_concentration_and_lorenz_equal_sorted_rows(spark):
    """Counts per value give what sorting each group gives: ties, nulls, a group of one value, zeros, and one without a key."""
    rng = np.random.default_rng(6)
    rows = [(int(g), None if x > 2.2 else float(np.round(abs(x), 1)), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 600), rng.standard_normal(600), strict=True))]
    rows += [(7, 2.0, 1000 + i) for i in range(50)] + [(8, 0.0, 2000), (8, 0.0, 2001), (None, 3.0, 3000), (None, 1.0, 3001), (9, None, 4000)]
    df = spark.createDataFrame(rows, "g int, v double, id long")
    got = {r.g: r for r in R.concentration(df, ["g"], "v", 3).collect()}
    curve = {r.id: (r.population, r.share) for r in R.lorenz(df, ["g"], "v", "id").collect()}
    assert set(got) == {g for g, _, _ in rows} and set(curve) == {i for _, _, i in rows}
    for g in got:
        mine = sorted(((v, i) for h, v, i in rows if h == g), key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
        x = np.array([v or 0.0 for v, _ in mine])
        n, total = len(x), x.sum()
        want = ((2 * (np.arange(1, n + 1) * x).sum() - (n + 1) * total) / (n * total), (x * x).sum() / total**2, np.sort(x)[::-1][:3].sum() / total) if total else (0.0, 0.0, 0.0)
        assert np.allclose([got[g].gini, got[g].hhi, got[g].top_share], np.maximum(want, 0.0))
        for k, (v, i) in enumerate(mine):
            share = x[: k + 1].sum() / total if total else (k + 1) / n
            assert abs(curve[i][0] - (k + 1) / n) < 1e-12 and ((curve[i][1] is None) if v is None else abs(curve[i][1] - share) < 1e-9)
    assert R.concentration(df.where("false"), ["g"], "v", 3).count() == R.lorenz(df.where("false"), ["g"], "v", "id").count() == 0
    assert R.lorenz(df.where("g = 7"), [], "v", "id").count() == 50


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Name;AGE \nJosé;3\n\"x;y\";\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿age\tname\n5\tÁé\n".encode())
    (tmp_path / "c.csv").write_bytes(b"")
    got = sorted((r.name or "", r.age or "") for r in FS.robust_csv(spark, str(tmp_path), ["name", "age"]).collect())
    assert got == [("José", "3"), ("x;y", ""), ("Áé", "5")]
    pages = [("x var curriculo = {\"a\": \"}\", \"b\": {\"c\": 1}}; {}", json.dumps({"a": "}", "b": {"c": 1}}), None), ("var curriculo = {'a'", None, "unterminated"), ("var curriculo = 5", None, "no brace"), ("nothing", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pages)], "id int, html string")
    assert [(r.object, r.error) for r in FS.script_objects(df, "id", "html", "curriculo").orderBy("id").collect()] == [p[1:] for p in pages]
    latin = spark.createDataFrame([(bytearray('<meta charset="iso-8859-1">é'.encode("latin-1")),), (bytearray("<meta>é".encode()),)], "b binary")
    assert {r[0][-1] for r in latin.select(FS.decoded_page(F.col("b"))).collect()} == {"é"}


def test_resolved_by_alias(spark):
    people = spark.createDataFrame([(1, "Ana Lima Costa"), (2, "Rui Reis")], "person_id long, person string")
    aliases = spark.createDataFrame([(1, "Nana Souza"), (2, "R. R. X"), (1, "R. R. X")], "person_id long, alias string")
    said = spark.createDataFrame([("ANA LIMA COSTA",), ("Nana de Souza",), ("A. Costa",), ("R. R. X",), ("Nobody Here",), (None,)], "name string")
    got = {r.name: (r.person_id, r.tier) for r in ID.resolve(said, "name", people, aliases).collect()}
    assert got == {"ANA LIMA COSTA": (1, "exact"), "Nana de Souza": (1, "alias"), "A. Costa": (1, "inferred"), "R. R. X": (None, None), "Nobody Here": (None, None)}
