import numpy as np

from evidentia.llm import ann, capfilters


def table(spark, vectors, labels=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0 if labels is None else labels[i], "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")


def test_neighbours_reach_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 32)).astype(np.float32)
    df = table(spark, x)
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 5).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and q not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        hit += len(set(np.argsort(-s)[:5]) & set(mine.vec_id))
    assert hit / 40 >= 0.9


def test_near_rows_need_few_visits(spark):
    rng = np.random.default_rng(3)
    shares = {}
    for n in (2000, 20_000):
        x = np.repeat(ann.unit(rng.standard_normal((n // 100, 64))), 100, axis=0) + 0.02 * rng.standard_normal((n, 64))
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        queries = df.where("vec_id % 50 = 0")
        clean = lambda d: d.selectExpr("vec_id", "embedding v", "64L dim")
        _, recall, shares[n] = ann.choose(clean(df), clean(queries), 5)
        assert recall >= ann.WANTED
        got = ann.nearest(df, queries, 5).toPandas()
        u, hit = ann.unit(x), 0
        for q, found in got.groupby("query_id"):
            s = u @ u[q]
            s[q] = -9
            hit += len(set(np.argsort(-s)[:5]) & set(found.vec_id))
        assert len(got) == n // 10 and hit / len(got) >= 0.9
    assert shares[20_000] <= 0.1 and shares[20_000] < shares[2000]


def test_weights_of_settings_are_counts():
    rng = np.random.default_rng(4)
    asked, seen = ann.unit(rng.standard_normal((7, 16))), ann.unit(rng.standard_normal((60, 16)))
    near = [ann.unit(asked[i] + 0.3 * rng.standard_normal((i % 3, 16))) if i % 3 else np.zeros((0, 16)) for i in range(7)]
    for setting, (hits, compared, short) in ann.weigh(8, 1.4, asked, near, seen).items():
        look = lambda v: ann.bucket_keys(v, setting, 1)[:, :, 0]
        probes = [[set(p) for p in q] for q in ann.bucket_keys(asked, setting, setting.probes).tolist()]
        held = lambda q, v: [sum(k in p for k, p in zip(row, probes[q], strict=True)) for row in look(v).tolist()] if len(v) else []
        found = [[n > 0 for n in held(q, near[q])] for q in range(7)]
        looks = [sum(held(q, seen)) for q in range(7)]
        assert hits == sum(map(sum, found)) and abs(compared - sum(looks) / 60) < 1e-9
        assert short == sum(not all(f) and n == 0 for f, n in zip(found, looks, strict=True))


def test_neighbours_of_odd_rows(spark):
    df = table(spark, [[1, 0], [1, 0], [2, 0], [0, 0], None, [float("nan"), 1], [None, 1], [0, 1], [1, 2, 3]])
    got = [tuple(r)[:3] for r in ann.nearest(df, df, 5).where("query_id in (0, 3, 4, 8)").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]  # ties by id; odd rows and lone dimensions have none
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_cap_filters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    x = np.concatenate([base, base[:30] + 0.02 * rng.standard_normal((30, 24)), base[:5], base[:3] + 0.01]).astype(np.float32)
    labels = [i % 2 if i < 60 else (i - 60) % 2 for i in range(len(x))]
    labels[7] = None
    got = {r.vec_id: r for r in capfilters.near_vectors(table(spark, x, labels)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & np.array([[a is not None and a == b for b in labels] for a in labels])
    np.fill_diagonal(near, False)
    assert {i: got[i].n_links for i in got} == {i: int(n) for i, n in enumerate(near.sum(1))}
    root = list(range(len(x)))
    for _ in root:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert [got[i].component_id for i in range(len(x))] == root and all(got[i].kept == (root[i] == i) for i in got)


def test_cap_filters_of_odd_rows(spark):
    df = table(spark, [[1, 0], [1, 0], [0, 0], None, [float("inf"), 1], [], [1, 0, 0]])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in capfilters.near_vectors(df).collect()}
    assert got == {0: (1, 0, True), 1: (1, 0, False)} | {i: (0, i, True) for i in range(2, 7)}
    assert capfilters.near_vectors(df.limit(0)).count() == 0


def test_parts_of_heavy_buckets_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.standard_normal((120, 16)), rng.standard_normal((1, 16)) + 0.05 * rng.standard_normal((80, 16)))).astype(np.float32)
    df = table(spark, x)
    find = lambda: sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 2 = 0"), 5).collect())
    whole = find()
    for name, most in (("HEAVY", 7), ("QUERIES", 5)):
        monkeypatch.setattr(ann, name, most)
    assert find() == whole and len(whole) == 500


def test_neighbours_of_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (2, [1.0, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int")
    got = [tuple(r)[:3] for r in ann.nearest(df, df.where("vec_id = 2"), 5).collect()]
    assert got == [(2, 1, 1)]


def by_brute_force(x, labels, cosine=0.98):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & np.array([[a is not None and a == b for b in labels] for a in labels])
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == root:
            return near.sum(1), root
        root = new


def test_chunks_of_a_large_bucket_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "CHUNK", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((30, 8)) + 0.001 * rng.standard_normal((30, 8)), -np.ones((1, 8)), *(np.eye(8)[i] + 0.07 * rng.standard_normal((25, 8)) for i in range(3))]).astype(np.float32)
    want, root = by_brute_force(x, [0] * len(x))
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.near_vectors(table(spark, x)).collect()}
    assert got == {i: (want[i], root[i]) for i in range(len(x))} and want[0] == 29 and want[30] == 0


def test_chains_are_one_component(spark, monkeypatch):
    """Vectors along an arc, each near its neighbours only, over chunks and buckets."""
    monkeypatch.setattr(capfilters, "CHUNK", 4)
    angle = np.concatenate((np.arange(60) * 0.15, [30.0]))
    order = np.random.default_rng(8).permutation(len(angle))
    x = np.stack((np.cos(angle / 4), np.sin(angle / 4), np.zeros(61), np.full(61, 0.01)), axis=1)[order]
    want, root = by_brute_force(x, [1] * 61)
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.near_vectors(table(spark, x, [1] * 61)).collect()}
    u = (x.astype(np.float32)).astype(float)
    want, root = by_brute_force(u, [1] * 61)
    assert got == {i: (want[i], root[i]) for i in range(61)}


def test_repeated_and_missing_ids_of_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (None, [1.0, 0.0], "a"), (2, [1.0, -0.0], "a"), (3, [1.0, 0.0], None), (4, [1.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 AS row", "2 AS rep", "3 AS h1")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in capfilters.near_vectors(df).collect())
    assert got == [(0, 0, None, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_cap_filters_find_pairs_at_the_bound_in_a_large_label(spark):
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((10000, 64)), rng.standard_normal((10000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.choice([0.9801, 0.985, 0.99, 0.999], (10000, 1))
    x = np.concatenate((x, c * x + np.sqrt(1 - c * c) * z)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.concatenate([(u[i : i + 1000] @ u.T >= 0.98).sum(1) - 1 for i in range(0, len(u), 1000)])
    got = capfilters.near_vectors(table(spark, x)).toPandas().set_index("vec_id").n_links.loc[range(len(x))].to_numpy()
    assert near.sum() >= 20000 and (got <= near).all() and got.sum() >= 0.999 * near.sum()


def test_every_vector_has_as_many_filters():
    rng = np.random.default_rng(6)
    for vectors, dim in ((100, 64), (5000, 64), (100000, 64), (5000, 3), (5000, 384)):
        words, listed = capfilters.code_size(vectors, dim, 0.98)
        x = ann.unit(rng.standard_normal((500, dim)))
        got = capfilters.decode(x, words, listed)
        rotation, books = capfilters._code(dim, words)
        a, b, c, d = (t @ w.T for t, w in zip(np.split(x @ rotation, 4, axis=1), books, strict=True))
        every = (a[:, :, None, None, None] + b[:, None, :, None, None] + c[:, None, None, :, None] + d[:, None, None, None, :]).reshape(500, -1)
        if every.shape[1] > listed:
            least = -np.sort(-every, axis=1)[:, listed - 1]
            assert got.shape == (500, listed) and (np.take_along_axis(every, got, 1) >= least[:, None] - 1e-9).all()
            assert (np.diff(got, axis=1) > 0).all() and capfilters.recall(dim, words, listed, 0.98) >= 0.999


def test_cap_filters_in_few_dimensions(spark, monkeypatch):
    for dim, most in ((8, 0.3), (12, 0.01)):
        words, listed = capfilters.code_size(1_000_000, dim, 0.98)
        assert capfilters.recall(dim, words, listed, 0.98) >= capfilters.RECALL
        assert listed**2 / words**capfilters.BLOCKS <= most
    code = capfilters.code_size(1_000_000, 8, 0.98)
    monkeypatch.setattr(capfilters, "code_size", lambda *_: code)
    rng = np.random.default_rng(12)
    x = ann.unit(rng.standard_normal((1500, 8)))
    side = rng.standard_normal((500, 8))
    side = ann.unit(side - (side * x[:500]).sum(axis=1, keepdims=True) * x[:500])
    x = np.concatenate((x, 0.981 * x[:500] + np.sqrt(1 - 0.981**2) * side))
    got = {r.vec_id: r.n_links for r in capfilters.near_vectors(table(spark, x)).collect()}
    u = ann.unit(x.astype(np.float32).astype(float))
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert near[np.arange(500), np.arange(1500, 2000)].all()
    assert sum(got.values()) >= 0.995 * near.sum() and all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
