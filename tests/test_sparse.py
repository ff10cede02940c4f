"""Block Lanczos and the factor analyses on sparse entries against dense matrices."""

import numpy as np
import pytest

from dealscope.operators import factor, sparse


def test_eigenpairs_of_a_sparse_matrix(spark):
    rng = np.random.default_rng(0)
    n = 30
    a = np.where(rng.random((n, n)) < 0.2, rng.normal(size=(n, n)), 0)
    a, c = a + a.T, rng.normal(size=n) * 0.3
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "a long, b long, s double")
    values, u = sparse.lanczos(entries, spark.createDataFrame([(i, float(c[i])) for i in range(n)], "node long, c double"), 3)
    want, vectors = np.linalg.eigh(a - np.outer(c, c))
    got = np.array([r["u"] for r in u.orderBy("node").collect()])
    assert values == pytest.approx(want[::-1][:3], abs=1e-8)
    assert np.abs((got * vectors[:, ::-1][:, :3]).sum(axis=0)) == pytest.approx(1, abs=1e-6)


def test_repeated_values_and_small_matrices(spark):
    entries = spark.createDataFrame([(i, i, float(s)) for i, s in enumerate((2, 2, 2, 1))], "a long, b long, s double")
    values, u = sparse.lanczos(entries, spark.createDataFrame([(i, 0.0) for i in range(4)], "node long, c double"), 3)
    assert values == pytest.approx([2, 2, 2]) and u.count() == 4
    values, u = sparse.lanczos(entries.limit(0), spark.createDataFrame([], "node long, c double"), 2)
    assert len(values) == 0 and u.count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        g = int(rng.integers(0, 3))
        rows.append((i, float(rng.normal(g)), float(rng.normal()), "abc"[g], None if i % 17 == 0 else "uvwxyz"[(g + int(rng.integers(0, 3))) % 6], f"client {int(rng.integers(0, 8)) + 3 * g}"))
    return spark.createDataFrame(rows, "code long, x double, y double, c string, d string, e string")


def close(a, b, by, columns):
    """Equal up to the sign of each axis."""
    a, b = a.orderBy(*by).toPandas(), b.orderBy(*by).toPandas()
    assert a[by].values.tolist() == b[by].values.tolist()
    for c in columns:
        assert np.abs(a[c].to_numpy()) == pytest.approx(np.abs(b[c].to_numpy()), abs=1e-5)


@pytest.mark.parametrize("method", ("mca", "famd", "mfa"))
def test_sparse_equals_dense(table, method):
    made = {
        "mca": lambda dense: factor.mca(table, ["c", "d", "e"], dense=dense),
        "famd": lambda dense: factor.famd(table, ["x", "y"], ["c", "d", "e"], dense=dense),
        "mfa": lambda dense: factor.mfa(table, {"n": ["x", "y"], "l": ["c", "d"], "e": ["e"]}, dense=dense),
    }[method]
    one, other = made(1), made(10_000)
    if method == "mfa":
        close(one[1], other[1], ["grp", "axis"], ["contribution"])
        one, other = one[0], other[0]
    close(one.scores, other.scores, ["code"], ["F1", "F2"])
    close(one.loadings, other.loadings, ["name", "axis"], ["coordinate", "contribution"])
    two = [[r["eigenvalue"], r["pct"], r["cumulative"]] for r in one.inertia.orderBy("axis").limit(2).collect()]
    assert two == [pytest.approx([r["eigenvalue"], r["pct"], r["cumulative"]], rel=1e-6) for r in other.inertia.orderBy("axis").limit(2).collect()]


@pytest.mark.parametrize("scale", ({}, {"x": 0.7, "c": 1.3, "d": 0.9, "e": 0.6}))
@pytest.mark.parametrize("quant", ([], ["x", "y"]))
def test_one_large_variable_needs_no_steps(table, monkeypatch, quant, scale):
    steps = factor.sparse_axes(table, quant, ["c", "d", "e"], 2, "code", scale, small=0)
    monkeypatch.setattr(factor, "lanczos", lambda *_: pytest.fail("steps over entries"))
    made = factor.sparse_axes(table, quant, ["c", "d", "e"], 2, "code", scale)
    assert made.values == pytest.approx(steps.values, rel=1e-8) and made.total == pytest.approx(steps.total)
    flat = lambda t, c, by: np.array([r[c] for r in t.orderBy(by).collect()])
    assert np.abs(flat(made.nodes, "u", "node")) == pytest.approx(np.abs(flat(steps.nodes, "u", "node")), abs=1e-6)
    assert np.abs(flat(made.scores, "f", "code")) == pytest.approx(np.abs(flat(steps.scores, "f", "code")), abs=1e-6)


def test_axes_within_the_large_variable(spark):
    """Unrelated variables: the span of the others has no axis above the rest, which steps must find."""
    df = spark.createDataFrame([(4 * i + j, "ab"[j % 2], f"client {i}") for i in range(6) for j in range(4)], "code long, c string, e string")
    made = factor.sparse_axes(df, [], ["c", "e"], 3, "code")
    assert made.values == pytest.approx([1, 1, 1]) and made.total == pytest.approx(6)


def test_few_levels_take_sums_per_combination(table, monkeypatch):
    """Neither rows of indicators nor a join of the groups' rows by key: the small tables go to the rows."""
    monkeypatch.setattr(factor, "moments", lambda *_: pytest.fail("wide rows"))
    for made in (factor.mca(table, ["c", "d"]), factor.famd(table, ["x", "y"], ["c", "d"]), factor.mfa(table, {"n": ["x", "y"], "l": ["c", "d"]})[0]):
        plan = made.scores._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "SortMergeJoin" not in plan


def test_mixed_and_multiple_analyses_by_hand(table):
    p = table.toPandas()
    p["d"] = p["d"].fillna("Inconnu")
    z = np.stack([(p[c] - p[c].mean()) / p[c].std(ddof=0) for c in ("x", "y")], axis=1)
    levels = [(c, v) for c in ("c", "d") for v in sorted(set(p[c]))]
    share = np.array([(p[c] == v).mean() for c, v in levels])
    w = (np.stack([(p[c] == v).astype(float) for c, v in levels], axis=1) - share) / np.sqrt(share)
    first = lambda x: np.linalg.eigvalsh(x.T @ x / len(x))[-1]
    for made, x in ((factor.famd(table, ["x", "y"], ["c", "d"]), np.hstack([z, w])), (factor.mfa(table, {"n": ["x", "y"], "l": ["c", "d"]})[0], np.hstack([z / np.sqrt(first(z)), w / np.sqrt(first(w))]))):
        values, vectors = np.linalg.eigh(x.T @ x / len(x))
        got = np.array([[r["F1"], r["F2"]] for r in made.scores.orderBy("code").collect()])
        assert np.abs(got) == pytest.approx(np.abs(x @ vectors[:, ::-1][:, :2]), abs=1e-8)
        assert [r["cumulative"] for r in made.inertia.orderBy("axis").limit(2).collect()] == pytest.approx((100 * np.cumsum(values[::-1]) / values.sum())[:2])


def test_spectral_clusters_of_rings(spark):
    """Two rings inside each other, which no centre tells apart, and the coordinates of a dense decomposition."""
    from dealscope.operators import cluster, neighbour_join

    rng = np.random.default_rng(1)
    ring = lambda r, n: r * np.stack([f(np.linspace(0, 2 * np.pi, n, endpoint=False)) for f in (np.cos, np.sin)], axis=1)
    x = np.concatenate([ring(1, 20), ring(6, 40)]) + rng.normal(0, 0.02, (60, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    label = {r["id"]: r["label"] for r in cluster.labels(df, "graph", 2).collect()}
    assert len({label[i] for i in range(20)}) == len({label[i] for i in range(20, 60)}) == 1 and label[0] != label[30]
    d = neighbour_join.exact_distances(x, x)
    a = np.zeros((60, 60))
    for i in range(60):
        a[i, np.argsort(d[i], kind="stable")[1:10]] = 1
    w = (a + a.T) / 2
    root = np.sqrt(w.sum(axis=1))
    values = np.linalg.eigvalsh(w / np.outer(root, root))[::-1]
    u = np.array([r["u"] for r in cluster.spectral_coordinates(df, 3).orderBy("id").collect()]) * root[:, None]
    assert np.diag(u.T @ (w / np.outer(root, root)) @ u) == pytest.approx(values[:3], abs=1e-6)
