"""Vector operators: an epsilon grid order join within labels, and a permutation index for nearest neighbours."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitslice import Forest
from .common import arrow_map, materialize
from .graph import connected_components

#: Vectors from which axes and pivots are fitted: those with the smallest id hashes, this many at most.
SAMPLE = 4096
#: Vectors of a block, and of a leaf that is compared by one matrix product.
BLOCK, LEAF = 2048, 128
#: Leading principal dimensions that order the grid.
AXES = 8
#: Blocks, or intervals, that make up the next larger interval.
FAN = 32


def usable(embedding: str, norm: bool) -> Column:
    """Whether a vector has only finite numbers, and if ``norm`` is not zero either."""
    e = F.col(embedding)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(odd, F.lit(True))
    return F.coalesce(ok & F.exists(e, lambda x: x != 0), F.lit(False)) if norm else F.coalesce(ok, F.lit(False))


def _sample(rows: DataFrame, id: str, vector: str) -> list[np.ndarray]:
    """At most ``SAMPLE`` different vectors, the same ones in every run; the driver holds no more than these."""
    picked = rows.select(id, vector).orderBy(F.xxhash64(id), id).limit(SAMPLE).collect()
    return [np.frombuffer(x) for x in dict.fromkeys(np.asarray(r[1], np.float64).tobytes() for r in picked)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _sequences(axes: dict[int, np.ndarray], eps: float):
    """From rows in grid order to blocks: consecutive vectors of a label with the bounds of their projections."""

    def run(batches):
        number = _numbers()
        for label, dim, table in _by_label(batches):
            for at in range(0, table.num_rows, BLOCK):
                part = table.slice(at, BLOCK)
                x = _matrix(part.column("vector").combine_chunks(), dim)
                p = project(x, axes.get(dim))
                columns = [[label], [dim], [next(number)], [p.min(0).tolist()], [p.max(0).tolist()], [part.column("rep").to_pylist()], [part.column("n").to_pylist()], [x.tobytes()]]
                yield pa.RecordBatch.from_pydict(dict(zip(BLOCK_FIELDS, columns)), schema=BLOCK_ARROW)

    return run


BLOCK_FIELDS = ("label", "dim", "block", "lo", "hi", "reps", "sizes", "data")
BLOCK_ARROW = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("reps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
BLOCK_DDL = "label long, dim int, block long, lo array<double>, hi array<double>, reps array<long>, sizes array<long>, data binary"


def _numbers():
    """Numbers for the blocks of a task that rise with the task's place: range partitions keep their order."""
    return count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)


def _by_label(batches):
    """Tables of at most some blocks of rows with one label and dimension, from rows that come sorted by them."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        held = yield from _runs(held, False)
    if held is not None:
        yield from _runs(held, True)


def _runs(table: pa.Table, last: bool):
    while table.num_rows:
        label, dim = table.column("label").to_numpy(), table.column("dim").to_numpy()
        other = np.flatnonzero((label != label[0]) | (dim != dim[0]))
        if len(other):
            n = int(other[0])
        elif last:
            n = table.num_rows
        else:
            n = table.num_rows // BLOCK * BLOCK
            if not n:
                break
        yield int(label[0]), int(dim[0]), table.slice(0, n)
        table = table.slice(n)
    return table


def project(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit vectors on the leading axes, zero beyond their length, and the length of what is left: no distance grows."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    led = unit[:, :AXES] if axes is None else unit @ axes
    rest = np.sqrt(np.maximum(0, 1 - (led * led).sum(1)))
    return np.c_[led, np.zeros((len(led), AXES - led.shape[1])), rest]


def interval_join(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, eps: float, same: bool) -> list[tuple[int, int]]:
    """Pairs of members of two sequences of boxes that may hold vectors within ``eps``, by halving the intervals.

    Two intervals are dropped as soon as their bounding boxes are farther apart than ``eps``. If both sequences are the
    ``same``, only pairs i <= j come.
    """
    trees = [_boxes(lo, hi), _boxes(lo2, hi2)]
    found, stack = [], [(len(trees[0]) - 1, 0, len(trees[1]) - 1, 0)]
    while stack:
        d, i, e, j = stack.pop()
        a, b = trees[0][d], trees[1][e]
        if i >= len(a[0]) or j >= len(b[0]) or same and i << d >= (j + 1 << e):
            continue
        gap = np.maximum(0, np.maximum(a[0][i] - b[1][j], b[0][j] - a[1][i]))
        if gap @ gap > eps * eps:
            continue
        if d == 0 and e == 0:
            if not same or i <= j:
                found.append((i, j))
        elif d >= e:
            stack += [(d - 1, 2 * i, e, j), (d - 1, 2 * i + 1, e, j)]
        else:
            stack += [(d, i, e - 1, 2 * j), (d, i, e - 1, 2 * j + 1)]
    return found


def _boxes(lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bounds of the single boxes, of each two, of each four and so on."""
    levels = [(lo, hi)]
    while len(lo) > 1:
        at = np.arange(0, len(lo), 2)
        lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        levels.append((lo, hi))
    return levels


def _leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(0, len(p), LEAF)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at), np.r_[at, len(p)]


def _pair_links(axes: dict[int, np.ndarray], cosine: float, eps: float):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, same = row["dim"], row["b_data"] is None
                x, y = (np.frombuffer(row[c], np.float64).reshape(-1, dim) for c in ("a_data", "a_data" if same else "b_data"))
                nx, ny = (np.sqrt((v * v).sum(1)) for v in (x, y))
                reps = np.array(row["a_reps"] + ([] if same else row["b_reps"]), np.int64)
                sizes = np.array(row["a_sizes"] + ([] if same else row["b_sizes"]), np.int64)
                shift = 0 if same else len(x)
                links, forest = np.zeros(len(reps), np.int64), Forest(len(reps))
                lo, hi, at = _leaves(project(x, axes.get(dim)))
                lo2, hi2, at2 = _leaves(project(y, axes.get(dim)))
                for i, j in interval_join(lo, hi, lo2, hi2, eps, same):
                    u, v = slice(at[i], at[i + 1]), slice(at2[j], at2[j + 1])
                    near = x[u] @ y[v].T / (nx[u, None] * ny[None, v]) >= cosine
                    if same and i == j:
                        near &= np.tri(len(near), k=-1, dtype=bool).T
                    k, m = np.nonzero(near)
                    if len(k):
                        k, m = k + at[i], m + at2[j] + shift
                        links += np.bincount(k, sizes[m], len(links)).astype(np.int64) + np.bincount(m, sizes[k], len(links)).astype(np.int64)
                        forest.join(k, m)
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_pydict({"rep": reps[some], "links": links[some], "parent": reps[forest.roots(some)]}, schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())]))

    return run


def _apart(a: str, b: str) -> Column:
    """Squared distance of two boxes, from the bounds ``<a>_lo``, ``<a>_hi`` and so on."""
    over = lambda x, y: F.zip_with(f"{x}_lo", f"{y}_hi", lambda p, q: p - q)
    gaps = F.zip_with(over(a, b), over(b, a), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def block_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b) for the blocks a <= b of a label that may hold vectors within ``eps``, from boxes (label, dim, block, lo, hi).

    The interval recursion as rows: every ``FAN`` blocks that follow each other are an interval with a box around them, and
    so on until ``FAN`` squared intervals or fewer are left of each label. From there down, only intervals that may hold
    such vectors give the pairs of their parts. Each level is a join on the intervals, spread over tasks.
    """
    levels = [boxes.withColumn("up", F.expr(f"block div {FAN}"))]
    while (levels[-1].groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0) > FAN * FAN:
        bound = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(AXES + 1)]).alias(c)
        up = levels[-1].groupBy("label", "dim", F.col("up").alias("block")).agg(bound(F.min, "lo"), bound(F.max, "hi"))
        levels.append(materialize(up.withColumn("up", F.expr(f"block div {FAN}")), "vector-intervals"))
    side = lambda t, s, *more: t.select(F.col("block").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), *more)
    near = (F.col("a") <= F.col("b")) & (_apart("a", "b") <= eps * eps)
    top = levels.pop()
    pairs = side(top, "a", "label", "dim").join(side(top, "b", "label", "dim"), ["label", "dim"]).where(near).select("label", "dim", "a", "b", "a_lo", "a_hi")
    while levels:
        parts = levels.pop()
        pairs = pairs.select("label", "dim", F.col("a").alias("ua"), F.col("b").alias("ub"))
        pairs = pairs.join(side(parts, "a", "label", "dim", F.col("up").alias("ua")), ["label", "dim", "ua"]).join(side(parts, "b", "label", "dim", F.col("up").alias("ub")), ["label", "dim", "ub"])
        pairs = pairs.where(near).select("label", "dim", "a", "b", "a_lo", "a_hi")
    return pairs


def _near_rows(axes: dict[int, np.ndarray], eps: float):
    """Of the blocks b those vectors that may lie within ``eps`` of the box of block a: no others are sent to it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = {"a": [row["a"]], "dim": [row["dim"]], "b_reps": [None], "b_sizes": [None], "b_data": [None]}
                if row["a"] != row["b"]:
                    y = np.frombuffer(row["data"], np.float64).reshape(-1, row["dim"])
                    p = project(y, axes.get(row["dim"]))
                    gap = np.maximum(0, np.maximum(p - np.array(row["a_hi"]), np.array(row["a_lo"]) - p))
                    at = np.flatnonzero((gap * gap).sum(1) <= eps * eps)
                    if not len(at):
                        continue
                    out |= {"b_reps": [np.array(row["reps"], np.int64)[at]], "b_sizes": [np.array(row["sizes"], np.int64)[at]], "b_data": [y[at].tobytes()]}
                yield pa.RecordBatch.from_pydict(out, schema=SENT_ARROW)

    return run


SENT_ARROW = pa.schema([("a", pa.int64()), ("dim", pa.int32()), ("b_reps", pa.list_(pa.int64())), ("b_sizes", pa.list_(pa.int64())), ("b_data", pa.binary())])
SENT_DDL = "a long, dim int, b_reps array<long>, b_sizes array<long>, b_data binary"


def near_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) per vector: links join vectors of one label with at least that cosine.

    Equal vectors of a label are one node with a size. The nodes are sorted by the grid cells, as wide as the distance
    that the cosine allows, of their leading principal dimensions, and cut into blocks; sequences of blocks are joined by
    splitting them again and again, and pairs of intervals that are provably too far apart are skipped. Each surviving pair
    of blocks is a row of its own, so a label with very many vectors spreads over tasks; of one block only the vectors near
    the other's box are sent to it. A pair yields sums and a spanning forest, not its links.

    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label or id link with
    nothing: no links, the own id as component (null for a null id). Vectors of different lengths do not link. Rows that
    repeat an id count as further vectors. The axes are fitted on at most ``SAMPLE`` vectors; they only order the grid,
    so the links are exact. Other columns of ``rows`` are not in the result.
    """
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    base = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("long").alias("label"))
    ok = usable("vector", True) & F.col("label").isNotNull() & F.col("id").isNotNull()
    node = materialize(base.where(ok).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    axes: dict[int, np.ndarray] = {}
    sample = _sample(node, "rep", "vector")
    for dim in {len(x) for x in sample}:
        unit = np.stack([x / np.sqrt(x @ x) for x in sample if len(x) == dim])
        axes[dim] = np.ascontiguousarray(np.linalg.eigh(np.cov(unit.T) if len(unit) > 1 and dim > 1 else np.eye(dim))[1][:, ::-1][:, :AXES])

    def cells(batches):
        for batch in batches:
            size = batch.column("dim").to_numpy()
            out = np.zeros((batch.num_rows, AXES), np.int32)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                p = project(_matrix(batch.column("vector").take(pa.array(at)), int(dim)), axes.get(int(dim)))[:, :-1]
                out[at, : p.shape[1]] = np.floor(p / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(AXES))], names=[*batch.schema.names, *(f"g{k}" for k in range(AXES))])

    grid = [f"g{k}" for k in range(AXES)]
    celled = arrow_map(node.withColumn("dim", F.size("vector")), cells, "label long, vector array<double>, rep long, n long, dim int, " + ", ".join(f"{g} int" for g in grid))
    order = ["label", "dim", *grid, "rep"]
    blocks = arrow_map(celled.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "dim", "rep", "n", "vector"), _sequences(axes, eps), BLOCK_DDL)
    blocks = materialize(blocks, "vector-blocks")
    pairs = block_pairs(blocks.select("label", "dim", "block", "lo", "hi"), eps)
    sent = pairs.join(blocks.select(F.col("block").alias("b"), "reps", "sizes", "data"), "b").select("dim", "a", "b", "a_lo", "a_hi", "reps", "sizes", "data")
    own = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("reps", "sizes", "data")])
    met = arrow_map(sent, _near_rows(axes, eps), SENT_DDL).join(own, "a")
    found = materialize(arrow_map(met, _pair_links(axes, cosine, eps), "rep long, links long, parent long"), "vector-links")
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per = node.join(sums, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    good = base.where(ok).join(per, ["label", "vector"]).select("id", "n_links", "component_id")
    bad = base.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Pivots, which a vector's permutation orders; the nearest and the farthest ones whose files a query reads; the part of
#: its true neighbours in the sample that the share to rerank is chosen for.
PIVOTS, PROBES, RECALL = 256, 32, 0.97
#: Rows and bytes of a block of the index, of a block of queries, and of the query blocks that are broadcast at a time.
INDEX_ROWS, INDEX_BYTES, QUERY_ROWS, QUERY_BYTES, SENT_BYTES = 8192, 16 << 20, 2048, 4 << 20, 64 << 20
#: Sample vectors for which the share is measured.
TRIED = 128


def places_of(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The inverted files of the vectors: a row for each pivot with its place, from 0, in each vector's order of pivots."""
    far = (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    order = np.argsort(far, axis=1, kind="stable")
    out = np.empty((len(pivots), len(x)), np.uint8)
    out[order, np.arange(len(x))[:, None]] = np.arange(len(pivots), dtype=np.uint8)[None, :]
    return out


def footrules(places: np.ndarray, files: np.ndarray) -> np.ndarray:
    """Footrule distance of a query's permutation to each indexed one, over the pivots that stand at its two ends."""
    used = np.flatnonzero((places < PROBES) | (places >= len(places) - PROBES))
    return np.abs(files[used] - places[used].astype(np.int16)[:, None]).sum(axis=0, dtype=np.int32)


def share_for(sample: np.ndarray, pivots: np.ndarray, k: int, recall: float) -> float:
    """The share of all vectors, by footrule, that holds this part of the true neighbours within the sample."""
    files, tried = places_of(sample, pivots).astype(np.int16), min(TRIED, len(sample))
    if len(sample) <= k:
        return 1.0
    found = []
    for i in range(len(sample) - tried, len(sample)):  # the pivots are the first ones
        gap = ((sample - sample[i]) ** 2).sum(1)
        gap[i] = np.inf
        place = np.empty(len(sample), np.int64)
        place[np.argsort(footrules(files[:, i], files), kind="stable")] = np.arange(len(sample))
        found.append(place[np.argpartition(gap, k)[:k]])
    return min(1.0, (float(np.quantile(np.concatenate(found), recall)) + 2) / len(sample))


def _search(pivots: dict[int, np.ndarray], shares: dict[int, float], k: int):
    def run(batches):
        best: dict[int, list[np.ndarray]] = {}  # by query block: query ids, and the nearest found so far with their distances
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                x, q = (np.frombuffer(row[f"{s}_data"], np.float64).reshape(-1, dim) for s in "xq")
                ids, qids = np.array(row["ids"], np.int64), np.array(row["q_ids"], np.int64)
                if row["q_block"] not in best:
                    best[row["q_block"]] = [qids, np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)]
                p, known = pivots.get(dim), best[row["q_block"]]
                c = len(x) if p is None else min(len(x), int(np.ceil(shares[dim] * len(x))) + 2 * k)
                if c < len(x):
                    files, own = np.frombuffer(row["files"], np.uint8).reshape(len(p), -1).astype(np.int16), places_of(q, p)
                for i in range(len(q)):
                    near = np.arange(len(x))
                    if c < len(x):
                        f = footrules(own[:, i], files).astype(np.int64) * len(x) + near  # of equals the smaller ids
                        near = np.argpartition(f, c - 1)[:c]
                    near = near[ids[near] != qids[i]]
                    gap = x[near] - q[i]
                    d = np.r_[known[2][i], np.sqrt((gap * gap).sum(1))]
                    to = np.r_[known[1][i], ids[near]]
                    if len(near) > k:  # only those up to the k-th distance can be among the first
                        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        d, to = d[at], to[at]
                    first = np.lexsort((to, d))[:k]
                    known[1][i], known[2][i] = to[first], d[first]
        for qids, to, d in best.values():
            some = to != np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, some.sum(1))), pa.array(to[some]), pa.array(d[some])], names=["query_id", "id", "score"])

    return run


PACKED = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("files", pa.binary())])


def _packed(rows: DataFrame, most: int, size: int, tag: str, pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Blocks (dim, block, ids, data, files) of at most ``most`` rows and about ``size`` bytes, dealt by a hash of the id.

    So each block is like the whole. With ``pivots`` it carries the inverted files of its vectors, made here once.
    """

    def run(batches):
        number = _numbers()
        for _, dim, table in _by_label(batches):
            step = max(1, min(most, size // (8 * dim + (len(pivots[dim]) if pivots and dim in pivots else 0))))
            for at in range(0, table.num_rows, step):
                part = table.slice(at, step)
                part = part.take(pa.array(np.argsort(part.column("rep").to_numpy(), kind="stable")))
                x = _matrix(part.column("vector").combine_chunks(), dim)
                files = places_of(x, pivots[dim]).tobytes() if pivots and dim in pivots else None
                yield pa.RecordBatch.from_pydict({"dim": [dim], "block": [next(number)], "ids": [part.column("rep").to_pylist()], "data": [x.tobytes()], "files": [files]}, schema=PACKED)

    keyed = rows.select(F.lit(0).cast("long").alias("label"), F.size("vector").alias("dim"), F.col("id").alias("rep"), "vector", F.xxhash64("id").alias("h"))
    return materialize(arrow_map(keyed.repartitionByRange("dim", "h").sortWithinPartitions("dim", "h").drop("h"), run, "dim int, block long, ids array<long>, data binary, files binary"), tag)


def nearest_neighbours(rows: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, share: float | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found by Euclidean distance for each row that ``queries`` selects.

    Pivots are at most ``PIVOTS`` vectors of a bounded sample. Every vector is represented by its order of them and posted
    in the inverted file of each, with the pivot's place; the files are written once, block by block. A query reads those
    of the pivots that stand at the two ends of its own order, adds up the footrule distance over them, and the share of
    each block that ranks first is reranked by exact distance. Blocks are dealt by a hash of the id, so that each is like
    the whole. The share is measured on the sample: as much as holds ``recall`` of the true neighbours there, per length of
    vector. The denser whole is easier than the sample, so the recall is that or better; where footrules tell little, as
    among random vectors of many dimensions, the share rises up to all. ``share`` = 1 is exact search.

    The index stays where it is: queries come to it in blocks, at most ``SENT_BYTES`` of them broadcast at a time, and each
    task keeps the nearest found for each query and gives only those.

    Vectors null, empty, zero or with null or non-finite components, and rows with a null id, take no part; vectors of
    another length are no candidates. Rows with the query's own id are no candidates. Ties go to the smaller id. With fewer
    than ``k`` candidates all are returned.
    """
    base = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked")).where(usable("vector", True) & F.col("id").isNotNull())
    sample = _sample(base, "id", "vector")
    kinds = {dim: np.stack([x for x in sample if len(x) == dim]) for dim in {len(x) for x in sample}} if share is None or share < 1 else {}
    pivots = {dim: x[:PIVOTS] for dim, x in kinds.items()}
    shares = {dim: share_for(x, pivots[dim], k, recall) if share is None else share for dim, x in kinds.items()}
    index = _packed(base.select("id", "vector"), INDEX_ROWS, INDEX_BYTES, "index", pivots)
    asked = _packed(base.where("asked").select("id", "vector"), QUERY_ROWS, QUERY_BYTES, "index-queries")
    parts, sent, total = [], [], 0
    for block, size in [*asked.select("block", F.octet_length("data")).orderBy("block").collect(), (None, SENT_BYTES)]:
        if sent and total + size > SENT_BYTES:
            some = asked.where(F.col("block").isin(sent)).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
            met = index.select("dim", "ids", F.col("data").alias("x_data"), "files").join(F.broadcast(some), "dim")  # SENT_BYTES at most
            parts.append(arrow_map(met, _search(pivots, shares, k), "query_id long, id long, score double"))
            sent, total = [], 0
        sent, total = [*sent, block], total + size
    found = parts[0] if parts else rows.sparkSession.createDataFrame([], "query_id long, id long, score double")
    for part in parts[1:]:
        found = found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
