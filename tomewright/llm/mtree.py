"""Exact top-k by inner product: M-trees over paged metric nodes, searched best first."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .vectors import QUERY_BYTES, QUERY_ROWS, SENT_BYTES, _by_label, _matrix, _numbers, usable

#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Vectors from which the routing objects of the topmost levels are taken: those with the smallest id hashes.
SAMPLE, TOP = 2048, 32
#: Rows and bytes of a page, which is a tree of its own; its fan-out and the most rows of a leaf.
PAGE_ROWS, PAGE_BYTES, FANOUT, LEAF = 8192, 4 << 20, 16, 64
#: Rounding that bounds allow for, as a part of the lengths involved.
SLACK = 1e-7
#: Longest squared length whose products are exact in floating point; a score that every row reaches.
EXACT, NONE = 1 << 53, -(1 << 63)

NODE = np.dtype([("center", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("leaf", "<i4"), ("radius", "<f8"), ("parent", "<f8")])


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """The coordinate that makes the squared length of every vector ``most``: then the nearest by distance have the largest products."""
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(0, most - (x * x).sum(1)))


def _between(x, up, y, up_y) -> np.ndarray:
    """Distances of lifted vectors (rows of ``x``) to one (``y``)."""
    gap = x.astype(np.float64) - y.astype(np.float64)
    return np.sqrt((gap * gap).sum(1) + (up - up_y) ** 2)


def grow(x: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, parents): an M-tree over the lifted vectors, loaded from above.

    ``order`` rearranges the rows so that every node's are consecutive. A node has its routing object ``center`` (a row), its
    covering ``radius``, the distance ``parent`` of its center to that of the node above, and its children or, in a leaf, rows
    ``lo`` to ``hi``. ``parents`` has the distance of each row to the center of its leaf. Nodes with more than ``LEAF`` rows
    promote up to ``FANOUT`` rows that lie far from each other, and each row goes to the nearest; equal rows are cut by count.
    """
    order, parents = np.arange(len(x)), np.zeros(len(x))
    nodes, queue = [[0, 0, len(x), 0, 0.0, 0.0]], [(0, _between(x, up, x[0], up[0]))]
    for k, far in queue:  # in breadth first order, so that children are consecutive
        center, lo, hi = nodes[k][:3]
        rows = order[lo:hi]
        nodes[k][4] = float(far.max())
        if hi - lo <= LEAF:
            parents[lo:hi], nodes[k][3] = far, 1
            continue
        nearest, gap, chosen = np.zeros(len(rows), np.int64), far.copy(), [center]
        gaps = [far]
        while len(chosen) < FANOUT and gap.max() > 0:
            pick = rows[int(gap.argmax())]
            own = _between(x[rows], up[rows], x[pick], up[pick])
            closer = own < gap
            nearest[closer], gap = len(chosen), np.minimum(gap, own)
            chosen.append(int(pick))
            gaps.append(own)
        if len(chosen) == 1:  # nothing but equal rows
            nearest = np.arange(len(rows)) * FANOUT // len(rows)
            chosen, gaps = [center] * FANOUT, gaps * FANOUT
        by = np.argsort(nearest, kind="stable")
        order[lo:hi] = rows[by]
        counts = np.bincount(nearest, minlength=len(chosen))
        nodes[k][1], first = len(nodes), lo
        for c, n in enumerate(counts.tolist()):
            if n:
                members = by[first - lo : first - lo + n]
                to_parent = _between(x[[chosen[c]]], up[[chosen[c]]], x[center], up[center])[0]
                nodes.append([chosen[c], first, first + n, 0, 0.0, float(to_parent)])
                queue.append((len(nodes) - 1, gaps[c][members]))
                first += n
        nodes[k][2] = len(nodes)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    out = np.array([tuple(n) for n in nodes], NODE)
    out["center"] = place[out["center"]]
    return order, out, parents


class Page:
    """A stored tree: ``best`` searches it for a block of queries, nearest node first."""

    def __init__(self, row: dict, most: float):
        self.x = np.frombuffer(row["data"], np.int64).reshape(-1, row["dim"])
        self.ids, self.most = np.array(row["ids"], np.int64), most
        self.nodes, self.parents = np.frombuffer(row["nodes"], NODE), np.frombuffer(row["parents"], np.float64)
        self.exact = self.x.astype(np.float64)
        self.computed = 0

    def _products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact whole products, a row for each query; ``q`` is floating where all of them are exact so."""
        self.computed += len(rows) * len(q)
        return (q @ self.exact[rows].T).astype(np.int64) if q.dtype == np.float64 else q @ self.x[rows].T

    def best(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query scores and ids of the ``k`` largest products, ties to smaller ids, that reach ``least`` (``NONE``: all).

        Rows with id ``own`` don't count. The node comes next that has the smallest possible distance to any of the queries that still
        need it, and is compared with those only. A child or row is passed over, before its own distances are computed, where the
        stored distance to its parent's center proves by the triangle inequality that it is too far for all of them.
        """
        sizes = (q * q).sum(1).astype(np.float64)
        if self.most * float(sizes.max(initial=0)) < EXACT * float(EXACT):
            q = q.astype(np.float64)
        slack = SLACK * (np.sqrt(self.most) + np.sqrt(sizes))
        least = least.copy()
        distance = lambda i, s: np.sqrt(np.maximum(0.0, (sizes[i] + self.most)[:, None] - 2.0 * s))
        far = np.where(least == NONE, np.inf, distance(np.arange(len(q)), least[:, None].astype(np.float64))[:, 0] + slack)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        every = np.arange(len(q))
        d = distance(every, self._products(self.nodes["center"][:1], q))[:, 0]
        heap = [(0.0, 0, every, d)]
        while heap:
            bound, at, who, d = heapq.heappop(heap)
            if bound > far.max():
                break
            near = d - self.nodes["radius"][at] <= far[who]  # the bounds may have fallen since
            who, d = who[near], d[near]
            lo, hi = int(self.nodes["lo"][at]), int(self.nodes["hi"][at])
            leaf = self.nodes["leaf"][at]
            away = self.parents[lo:hi] if leaf else self.nodes["parent"][lo:hi]
            reach = np.abs(d[:, None] - away) - (0 if leaf else self.nodes["radius"][lo:hi]) <= far[who, None]
            some = reach.any(1)
            who, reach = who[some], reach[some]
            at = np.flatnonzero(reach.any(0))
            if not len(at):
                continue
            if leaf:
                rows = lo + at
                got = self._products(rows, q[who])
                good = (got >= least[who, None]) & (self.ids[rows] != own[who, None])
                for i in np.flatnonzero(good.any(1)).tolist():
                    to = np.flatnonzero(good[i])
                    scores, ids = np.r_[found[who[i]][0], got[i, to]], np.r_[found[who[i]][1], self.ids[rows[to]]]
                    first = np.lexsort((ids, -scores))[:k]
                    found[who[i]] = scores[first], ids[first]
                    if len(first) == k:
                        least[who[i]] = scores[first[-1]]
                        far[who[i]] = distance(who[i : i + 1], np.array([[float(least[who[i]])]]))[0, 0] + slack[who[i]]
            else:
                children = lo + at
                to = distance(who, self._products(self.nodes["center"][children], q[who]).astype(np.float64))
                low = np.maximum(0.0, to - self.nodes["radius"][children])
                need = reach[:, at] & (low <= far[who, None])
                for j in np.flatnonzero(need.any(0)).tolist():
                    mine = need[:, j]
                    heapq.heappush(heap, (float(low[mine, j].min()), int(children[j]), who[mine], to[mine, j]))
        return found


PAGES = pa.schema([("dim", pa.int32()), ("page", pa.int64()), ("ids", pa.list_(pa.int64())), ("asked", pa.list_(pa.int32())), ("data", pa.binary()), ("nodes", pa.binary()), ("parents", pa.binary())])
PAGES_DDL = "dim int, page long, ids array<long>, asked array<int>, data binary, nodes binary, parents binary"
FOUND = pa.schema([("query_id", pa.int64()), ("page", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, page long, place int, id long, score long"
ASKED_DDL = "dim int, page long, query_id long, place int, vector binary, least long"


def _cells(routes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], most: float):
    """The nearest routing object of the top level, and the nearest of those below it."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros((batch.num_rows, 2), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if int(dim) not in routes:
                    continue
                objects, ups, home = routes[int(dim)]
                x = _matrix(batch.column("vector").take(pa.array(at)), int(dim))
                near = -2 * (x @ objects.T + lifted(x, most)[:, None] * ups) + most
                top = near[:, :TOP].argmin(1)
                out[at, 0] = top
                out[at, 1] = np.where(home[None, :] == top[:, None], near, np.inf).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], names=[*batch.schema.names, "top", "sub"])

    return run


def _paged(most: float):
    def run(batches):
        number = _numbers()
        for _, dim, table in _by_label(batches):
            step = max(1, min(PAGE_ROWS, PAGE_BYTES // (8 * dim)))
            for at in range(0, table.num_rows, step):
                part = table.slice(at, step)
                x = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                order, nodes, parents = grow(x, lifted(x, most))
                asked = np.flatnonzero(part.column("asked").to_numpy(zero_copy_only=False)[order]).astype(np.int32)
                row = {"dim": [dim], "page": [next(number)], "ids": [part.column("id").to_numpy()[order]], "asked": [asked], "data": [x[order].tobytes()], "nodes": [nodes.tobytes()], "parents": [parents.tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema=PAGES)

    return run


def _at_home(most: float, k: int):
    """Each asked vector against its own page: the first results, which bound the search of all others."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row, most)
                for lo in range(0, len(row["asked"]), QUERY_ROWS):
                    places = np.array(row["asked"][lo : lo + QUERY_ROWS], np.int64)
                    own, out = page.ids[places], {c: [] for c in FOUND.names}
                    for place, (scores, ids) in zip(places.tolist(), page.best(page.x[places], own, k, np.full(len(places), NONE))):
                        n = max(1, len(ids))  # without a result a row tells of the query
                        for name, v in (("query_id", [int(page.ids[place])] * n), ("page", [row["page"]] * n), ("place", [place] * n), ("id", ids.tolist() or [None]), ("score", scores.tolist() or [None])):
                            out[name] += v
                    yield pa.RecordBatch.from_pydict(out, schema=FOUND)

    return run


def _blocks():
    """Rows (dim, page, query_id, place, vector, least) packed into blocks of queries."""

    def run(batches):
        number = _numbers()
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                step = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * int(dim))))
                for at in range(0, len(part), step):
                    some = part.slice(at, step)
                    columns = [[int(dim)], [next(number)], *([some.column(c).to_pylist()] for c in ("page", "query_id", "place", "least")), [b"".join(some.column("vector").to_pylist())]]
                    yield pa.RecordBatch.from_pydict(dict(zip(BLOCKS.names, columns)), schema=BLOCKS)

    return run


BLOCKS = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("q_page", pa.list_(pa.int64())), ("q_ids", pa.list_(pa.int64())), ("q_place", pa.list_(pa.int32())), ("q_least", pa.list_(pa.int64())), ("q_data", pa.binary())])
BLOCKS_DDL = "dim int, block long, q_page array<long>, q_ids array<long>, q_place array<int>, q_least array<long>, q_data binary"


def _elsewhere(most: float, k: int):
    """Queries against every page but their own, with what is known to be reached already as a bound that rises in the task."""

    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                page, block = Page(row, most), row["block"]
                q = np.frombuffer(row["q_data"], np.int64).reshape(-1, row["dim"])
                if block not in best:
                    empty, least = np.empty(0, np.int64), np.array([NONE if v is None else v for v in row["q_least"]], np.int64)
                    best[block] = [np.array(row["q_page"], np.int64), row["q_place"], np.array(row["q_ids"], np.int64), least, [(empty, empty)] * len(q)]
                pages, _, own, least, known = best[block]
                others = np.flatnonzero(pages != row["page"])
                if not len(others):
                    continue
                for i, (scores, ids) in zip(others.tolist(), page.best(q[others], own[others], k, least[others])):
                    if len(ids):
                        scores, ids = np.r_[known[i][0], scores], np.r_[known[i][1], ids]
                        first = np.lexsort((ids, -scores))[:k]
                        known[i] = scores[first], ids[first]
                        if len(first) == k:
                            least[i] = max(least[i], scores[first[-1]])
        for pages, places, own, _, known in best.values():
            sizes = [len(ids) for _, ids in known]
            columns = [np.repeat(np.array(v, np.int64), sizes) for v in (own, pages, places)]
            columns[2] = columns[2].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, np.concatenate([i for _, i in known]), np.concatenate([s for s, _ in known]))], schema=FOUND)

    return run


def _routes(sample: list[np.ndarray], most: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vector the routing objects, the topmost first, their lifted coordinates, and which of the topmost each is below."""
    out = {}
    for dim in {len(x) for x in sample}:
        x = np.stack([v for v in sample if len(v) == dim])
        up = lifted(x, most)
        home = (-2 * (x @ x[:TOP].T + up[:, None] * up[:TOP])).argmin(1)
        home[: min(TOP, len(x))] = np.arange(min(TOP, len(x)))
        out[dim] = x, up, home
    return out


def top_products(rows: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products for each row that ``queries`` selects, exactly.

    Components x count as floor(scale * x). One more coordinate gives all vectors the same length, so that the nearest in this
    metric space have the largest products. Two levels of routing objects from a bounded sample deal the vectors out, so that
    near ones stand together; every run of ``PAGE_ROWS`` is a page with an M-tree of its own, written once. A query first
    searches its own page, without any shuffle, which bounds its results; then all others, where whole trees, nodes and rows
    go by stored covering radii and parent distances. Pages stay where they are: queries come to them in blocks, at most
    ``SENT_BYTES`` of them broadcast at a time. Bounds allow for rounding, scores are exact whole numbers, so nothing is
    lost; where all distances are alike, all are computed.

    Vectors null, empty or with null or non-finite components, and rows with a null id, take no part; zero vectors do. Vectors
    of another length, and rows with the query's own id, are no candidates. Rows that repeat an id are candidates each; a query
    row that is repeated as it stands is one query, and different vectors under one id are queries of their own. Ties go to
    the smaller id. With fewer than ``k`` candidates all are returned. A vector whose squared length reaches 2^62 fails
    the query, since its products might not fit a long.
    """
    base = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries.cast("boolean"), F.lit(False)).alias("asked"))
    base = base.where(usable("vector", False) & F.col("id").isNotNull()).withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale)))
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    base = base.withColumn("size", F.when(squared < 2.0**62, squared).otherwise(F.raise_error(F.lit("a vector's squared length reaches 2^62"))))
    most = base.agg(F.max("size")).first()[0] or 0.0
    picked = base.select("id", "vector").orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).collect()
    routes = _routes([np.frombuffer(x) for x in dict.fromkeys(np.array(r["vector"], np.float64).tobytes() for r in picked)], most)
    dealt = arrow_map(base.select("id", "vector", "asked", F.size("vector").alias("dim")), _cells(routes, most), "id long, vector array<long>, asked boolean, dim int, top int, sub int")
    order = ["dim", "top", "sub", "id"]
    sorted_ = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select(F.lit(0).cast("long").alias("label"), "dim", "id", "asked", "vector")
    pages = materialize(arrow_map(sorted_, _paged(most), PAGES_DDL), "tree-pages")
    home = materialize(arrow_map(pages.where(F.size("asked") > 0), _at_home(most, k), FOUND_DDL), "tree-home")
    kth = home.groupBy("page", "place").agg(F.first("query_id").alias("query_id"), F.when(F.count("id") >= k, F.min("score")).alias("least"))
    whole = pages.where(F.size("asked") > 0).select("dim", "page", "data", F.explode("asked").alias("place"))
    at = [F.lit(8) * F.col("dim") * F.col("place") + 1, F.lit(8) * F.col("dim")]
    asked = whole.select("dim", "page", "place", F.substring("data", *at).alias("vector")).join(kth, ["page", "place"])
    asked = asked.groupBy("query_id", "vector").agg(F.min(F.struct("dim", "page", "place", "least")).alias("one")).select("one.dim", "one.page", "query_id", "one.place", "vector", "one.least")
    blocks = materialize(arrow_map(asked, _blocks(), BLOCKS_DDL), "tree-queries")
    parts, sent, total = [home.where("id is not null").join(asked.select("page", "place"), ["page", "place"], "left_semi").select("query_id", "page", "place", "id", "score")], [], 0
    for block, size in [*blocks.select("block", F.octet_length("q_data")).orderBy("block").collect(), (None, SENT_BYTES)]:
        if sent and total + size > SENT_BYTES:
            met = pages.drop("asked").join(F.broadcast(blocks.where(F.col("block").isin(sent))), "dim")  # SENT_BYTES at most
            parts.append(arrow_map(met, _elsewhere(most, k), FOUND_DDL))
            sent, total = [], 0
        sent, total = [*sent, block], total + size
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id", "page", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
