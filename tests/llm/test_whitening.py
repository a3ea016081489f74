import numpy as np
import pytest
from conftest import DATA

from plumbline.llm import whitening
from plumbline.llm.common import read
from plumbline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def spectrum(d, values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("d,values", [(64, np.linspace(3, 0.1, 64) ** 2), (300, np.linspace(2, 1, 300)), (5, np.arange(1, 6)), (40, np.repeat(np.linspace(3, 1, 20), 2)), (40, [3, 2, 1, *[0] * 37]), (200, [*10.0 ** -np.arange(8), *[1e-9] * 192])])
def test_solver_equals_dense(d, values):
    v = spectrum(d, values)
    e, x = whitening.jacobi_davidson(lambda b: v @ b, d, float(np.trace(v)))
    want = np.sort(np.array(values, float))[::-1][:8]
    want = want[want > 1e-13 * want.sum()]
    assert np.allclose(e, want, rtol=0, atol=1e-12 * want[0]) and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13
    assert np.linalg.norm(v @ x - x * e, axis=0).max() < 1e-12 * want[0]


def test_inner_solver_solves_the_projected_equation():
    rng, d = np.random.default_rng(4), 30
    v = spectrum(d, rng.random(d) + 0.1, 1)
    u = whitening.orthonormal(rng.standard_normal((d, 3)))
    theta = np.diag(u.T @ v @ u)
    r = v @ u - u * theta
    r = r - u @ (u.T @ r)
    t = whitening.corrections(lambda b: v @ b, theta, r, u, steps=200, share=1e-12)
    left = v @ t - t * theta
    assert np.abs(u.T @ t).max() < 1e-12 and np.abs(left - u @ (u.T @ left) + r).max() < 1e-9
    few = whitening.corrections(lambda b: v @ b, theta, r, u, steps=4)
    left = v @ few - few * theta
    assert (np.linalg.norm(left - u @ (u.T @ left) + r, axis=0) < np.linalg.norm(r, axis=0)).all()


def against_numpy(rows, given):
    ids = [i for i, _ in given]
    x = np.floor(1024 * np.array([e for _, e in given], np.float32).astype(float)).astype(int) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    for c in range(1, 9):
        part = {r.vec_id: r for r in rows if r.component == c}
        got, want = np.array([part[i].whitened for i in ids]), y @ axes[:, c - 1] / np.sqrt(values[c - 1])
        got = got if got @ want > 0 else -got
        assert np.abs(got - want).max() < 1e-9 and abs(part[ids[0]].explained - values[c - 1] / values.sum()) < 1e-12
    exact = {i: sum(int(n * a - b) ** 2 for a, b in zip(map(int, v), map(int, s))) for i, v in zip(ids, x, strict=True)}
    assert {r.vec_id: r.deviation for r in rows} == exact and {r.n for r in rows} == {n}
    assert len(rows) == 8 * n and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_query_equals_dense(spark):
    given = [(r.vec_id, r.embedding) for r in read(spark, DATA, "embeddings").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    against_numpy(QUERIES["op13_whitening"](spark, DATA).collect(), given)


def test_unusable_rows_and_offsets(spark):
    rng = np.random.default_rng(8)
    given = [(i, [float(x) for x in (rng.standard_normal(10) * np.arange(1, 11) + 5000).astype(np.float32)]) for i in range(40)]
    odd = [(90, None), (91, []), (92, [None] + [1.0] * 9), (93, [float("nan")] + [1.0] * 9), (94, [float("-inf")] + [1.0] * 9), (95, [3e38] + [1.0] * 9), (96, [1.0] * 9)]
    table = spark.createDataFrame(given + odd, SCHEMA).selectExpr("*", "1 as x", "2 as w")
    against_numpy(whitening.whitened_vectors(table).collect(), given)


def test_few_directions(spark):
    frame = lambda rows: whitening.whitened_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert frame([]) == [] and frame([(1, [0.5, 2.0])]) == [] and frame([(i, [0.5, 2.0]) for i in range(5)]) == []
    two = frame([(None, [0.0, 0.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])])
    assert sorted(str(r.vec_id) for r in two) == ["7", "7", "None"] and {r.component for r in two} == {1} and abs(two[0].explained - 1) < 1e-12
    assert sorted(abs(round(r.whitened, 9)) for r in two) == [0.707106781, 0.707106781, 1.414213562]


def test_deviation_that_does_not_fit(spark):
    rows = whitening.whitened_vectors(spark.createDataFrame([(i, [float(i % 7) * 1e8]) for i in range(3000)], SCHEMA)).collect()
    assert any(r.deviation is None for r in rows) and rows[0].identity_error < 1e-9
