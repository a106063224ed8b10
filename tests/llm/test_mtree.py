import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import SCHEMA, make

from tomewright.llm import mtree


def brute(rows, k=10, step=20):
    use = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {(i, v.tobytes()): v for i, v in use if i % step == 0}
    out = []
    for (i, _), q in asked.items():
        found = sorted((-int(q @ v), j) for j, v in use if len(v) == len(q) and j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "'y' as page", "1 as place", "2 as score")
    return sorted(tuple(r) for r in mtree.top_products(df, F.col("vec_id") % 20 == 0, **more).collect())


@pytest.mark.parametrize("dim", [3, 24])
def test_equals_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 64)  # many pages, some levels each
    monkeypatch.setattr(mtree, "LEAF", 4)
    monkeypatch.setattr(mtree, "FANOUT", 3)
    monkeypatch.setattr(mtree, "TOP", 4)
    monkeypatch.setattr(mtree, "SENT_BYTES", 2000)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 7)
    rows = make(400, dim, dim, copies=60)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (20, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (20, [0.0, -1.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (2, [1.0, 0.0], None), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [], 0), (8, None, 0),
        (None, [1.0, 0.0], 0), (40, [1.0, 0.0, 0.0], 0), (9, [-0.0001, 0.9999], 1), (60, [0.0, 0.0], 0), (80, None, 0),
    ]
    assert run(spark, rows) == brute(rows)
    assert mtree.top_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert mtree.top_products(spark.createDataFrame(rows[3:5], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact_or_refused(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=6) * 4e5], 0) for i in range(120)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="2\\^62"):
        run(spark, [(20, [1e30], 0), (1, [1.0], 0)])


def test_bounds_save_products():
    """On clustered vectors a search computes a small part of the products, and what it gives is right."""
    rng = np.random.default_rng(3)
    x = np.floor(1024 * (rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 32)))).astype(np.int64)
    most = float((x * x).sum(1).max())
    order, nodes, parents = mtree.grow(x, mtree.lifted(x, most))
    for at in range(len(nodes)):  # every node covers its rows
        node = nodes[at]
        if node["leaf"]:
            y, up = x[order][node["lo"] : node["hi"]], mtree.lifted(x[order][node["lo"] : node["hi"]], most)
            far = mtree._between(y, up, x[order][node["center"]], mtree.lifted(x[order][[node["center"]]], most)[0])
            assert far.max() <= node["radius"] + 1e-6 and np.allclose(far, parents[node["lo"] : node["hi"]])
    page = mtree.Page({"dim": 32, "data": x[order].tobytes(), "ids": order.tolist(), "nodes": nodes.tobytes(), "parents": parents.tobytes()}, most)
    asked = np.arange(0, 4000, 100)
    for i, (scores, ids) in zip(asked.tolist(), page.best(x[asked], asked, 10, np.full(len(asked), mtree.NONE))):
        s = x @ x[i]
        want = [j for j in np.lexsort((np.arange(4000), -s)).tolist() if j != i][:10]
        assert ids.tolist() == want and scores.tolist() == s[want].tolist()
    assert page.computed < 0.2 * 40 * 4000
