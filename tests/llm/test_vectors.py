import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plain import components
from pyspark.sql import functions as F

from tomewright.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def make(n, dim, seed, copies=0, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    x = base[rng.integers(0, n // 4, n)] + 0.25 * rng.normal(size=(n, dim)) / np.sqrt(dim) * rng.integers(0, 3, (n, 1)) * np.sqrt(dim) / 3
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]
    return rows + [(n + i, rows[0][1], rows[0][2]) for i in range(copies)]


@pytest.mark.parametrize("dim", [3, 24])
def test_links_match_all_pairs(spark, monkeypatch, dim):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "LEAF", 8)
    monkeypatch.setattr(vectors, "FAN", 2)  # several levels of intervals
    rows = make(300, dim, dim, copies=40)
    x = np.array([r[1] for r in rows])
    norm = np.sqrt((x * x).sum(1))
    cos = x @ x.T / norm[:, None] / norm[None]
    lab = np.array([r[2] for r in rows])
    near = (cos >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(rows), dtype=bool)
    assert near.sum() > 100
    want = components(range(len(rows)), lambda a, b: near[a, b])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(rows))}


ODD = [
    (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (10, [None, 1.0], 0),
    (11, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (12, [-1.0, 0.0], 0), (1, [1.0, 0.0], 0),
]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' as rep", "'y' as id", "1 as block", "2 as n_links")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)], (None, 0, None, True)], key=repr)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_are_exact_on_few_and_odd(spark):
    """Zero vectors take no part; repeated rows count each, and ties go to the smaller id."""
    df = spark.createDataFrame([*ODD, (20, [0.0, 3.0], 0)], SCHEMA).selectExpr("*", "'x' as block", "'y' as rank", "1 as query_id", "2 as h")
    got = [tuple(r) for r in vectors.nearest_neighbours(df, F.col("vec_id") == 20, k=4).orderBy("rank", "vec_id").collect()]
    assert [(q, rank, v) for q, rank, v, _ in got] == [(20, 1, 1), (20, 2, 1), (20, 3, 3), (20, 4, 4)] and {s for *_, s in got} == {10**0.5}
    assert vectors.nearest_neighbours(df, F.col("vec_id") == 7).count() == 0
    assert vectors.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_query_leaves_zero_vectors_out(spark, tmp_path):
    from tomewright.llm import queries

    rows = [(k, [float(k), 1.0], 0) for k in range(1, 13)] + [(100, [0.0, 0.0], 0), (200, [0.5, 0.0], 0), (301, [0.0, 0.0], 0), (302, [-0.0, 0.0], 0), (303, None, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r)[:3] for r in queries.op9_nearest_neighbours(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert got == [(200, k, k) for k in range(1, 11)]


def recall(spark, tmp_path, x, **options):
    """The part of the true ten nearest that is found for every 100th vector; ranks and scores are checked on the way."""
    ids = pa.array(np.arange(len(x)))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x.astype(np.float32))), "label": ids}), tmp_path / "x.parquet")
    got = vectors.nearest_neighbours(spark.read.parquet(str(tmp_path / "x.parquet")), F.col("vec_id") % 100 == 0, **options).toPandas()
    x, hit = x.astype(np.float32).astype(float), 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        g = got[got.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id], rtol=0, atol=1e-9) and (np.diff(g.score) >= 0).all()
        hit += len(set(want) & set(g.vec_id))
    return hit / 10 / len(range(0, len(x), 100))


def test_recall_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "INDEX_ROWS", 1500)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 16)
    monkeypatch.setattr(vectors, "SENT_BYTES", 10_000)
    x = np.random.default_rng(5).normal(size=(6000, 32))
    x[3000:3400] = x[0]
    assert recall(spark, tmp_path, x) >= 0.9


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_recall_as_shipped(spark, tmp_path, dim):
    assert recall(spark, tmp_path, np.random.default_rng(dim).normal(size=(9000, dim))) >= 0.9


def test_share_of_one_is_exact(spark, tmp_path):
    assert recall(spark, tmp_path, np.random.default_rng(9).normal(size=(3000, 40)), share=1.0) == 1.0


def test_registered_search_against_brute_force(spark):
    """Every query of sf0.1 with the shipped constants: exact scores, true order, and nine in ten of the true neighbours."""
    from tomewright.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(vectors.usable("embedding", True)).orderBy("vec_id").toPandas()
    x, ids = np.stack(rows.embedding.to_list()).astype(float), rows.vec_id.to_numpy()
    got = queries.op9_nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    hit, asked = 0, np.flatnonzero(ids % 100 == 0)
    assert set(got.query_id) == set(ids[asked].tolist())
    for q in asked:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        g = got[got.query_id == ids[q]].sort_values("rank")
        assert np.allclose(g.score, d[np.searchsorted(ids, g.vec_id)], rtol=0, atol=1e-12) and g["rank"].tolist() == list(range(1, 11))
        want = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hit += len(set(ids[want].tolist()) & set(g.vec_id))
    assert hit / 10 / len(asked) >= 0.9


def test_interval_join_is_complete():
    rng = np.random.default_rng(7)
    for n, m, same in ((13, 13, True), (7, 20, False), (1, 1, True), (1, 9, False)):
        lo = np.sort(rng.uniform(0, 5, (n, 2)), axis=0)
        lo2 = lo if same else rng.uniform(0, 5, (m, 2))
        found = vectors.interval_join(lo, lo + 0.3, lo2, lo2 + 0.3, 0.7, same)
        gap = np.maximum(0, np.maximum(lo[:, None] - lo2[None] - 0.3, lo2[None] - lo[:, None] - 0.3))
        want = {(i, j) for i, j in zip(*np.nonzero((gap**2).sum(2) <= 0.49)) if not same or i <= j}
        assert sorted(found) == sorted(set(found)) and set(found) == want
