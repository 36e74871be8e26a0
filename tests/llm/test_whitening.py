import numpy as np
import pytest

from evidentia.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)], SCHEMA)


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (7, 7), (24, 24), (24, 5), (64, 64)])
def test_eigen_equals_the_library_form(d, rank):
    rng = np.random.default_rng(d + rank)
    x = rng.standard_normal((200, rank)) @ rng.standard_normal((rank, d)) * np.logspace(0, -3, d)
    a = x.T @ x
    factor, order = whitening.pivoted_cholesky(a)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a[np.ix_(order, order)], rtol=0, atol=1e-9 * a.max())
    assert np.allclose(np.triu(factor, 1), 0) and (np.diff(factor.diagonal()) <= 1e-9).all()
    values, vectors = whitening.eigen(a)
    want = np.linalg.eigvalsh(a)[::-1][:rank]
    assert np.allclose(values, want, rtol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * values[0])


def test_eigen_of_equal_eigenvalues_and_of_nothing():
    assert np.allclose(whitening.eigen(np.eye(5) * 3)[0], 3)
    values, vectors = whitening.eigen(np.zeros((4, 4)))
    assert values.shape == (0,) and vectors.shape == (4, 0)


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))).astype(np.float32)
    vectors = [*x, *x[:150], *[x[0]] * 40, None, [None] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [0.0] * 20, [], [1.0, 2.0]]
    table(spark, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op11_cholesky_whitening(spark, str(tmp_path)).collect()
    fit = np.unique(np.vstack([np.floor(64 * x.astype(float)), np.zeros((1, 20))]).astype(np.int64) + 1_000_000, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1][:16], parts[:, ::-1][:, :16]
    kept = [i for i, v in enumerate(vectors) if i < 490 or i == 494]
    assert len(rows) == 16 * len(kept) and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    got = {(r.vec_id, r.component): r for r in rows}
    for k in range(16):
        sign = None
        for i in kept:
            r, z = got[i, k + 1], n * (np.floor(64 * np.array(vectors[i], float)).astype(np.int64) + 1_000_000) - sums
            want = float(z / n @ parts[:, k] / np.sqrt(values[k]))
            sign = sign or (1 if want * r.whitened > 0 else -1)
            assert abs(sign * r.whitened - want) < 1e-7 and r.deviation == int((z * z).sum())
            assert abs(r.explained / (values[k] / np.trace(centred.T @ centred / n)) - 1) < 1e-9


def test_odd_tables(spark):
    empty = table(spark, [[1.0]]).limit(0)
    assert whitening.fit(empty) is None and whitening.transform(empty, None).count() == 0
    odd = table(spark, [None, [], [None, 1.0]])
    assert whitening.fit(odd) is None
    same = table(spark, [[1.0, 2.0]] * 5)
    model = whitening.fit(same)
    assert model.n == 1 and [(r.deviation, r.whitened) for r in whitening.transform(same, model).collect()] == [(0, [])] * 5
    clash = table(spark, [[1.0, 2.0], [2.0, 1.0], [0.0, 5.0]]).selectExpr("vec_id as whitened", "embedding", "label as x", "vec_id as deviation", "vec_id as keep")
    out = whitening.transform(clash, whitening.fit(clash))
    assert out.columns == ["embedding", "x", "keep", "deviation", "whitened"] and out.count() == 3


def test_wide_numbers_are_exact_or_an_error():
    z = whitening._from_mean(np.array([[1 << 40, 1]]), 1 << 23, (5, 7))
    assert z.tolist() == [[(1 << 63) - 5, (1 << 23) - 7]]
    with pytest.raises(OverflowError):
        whitening._deviations(z)
    assert whitening._deviations(np.array([[1 << 31, 1 << 30]])) == [(1 << 62) + (1 << 60)]
