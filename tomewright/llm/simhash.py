"""SimHash near-duplicates: fingerprints of word shingles, and a bit-sliced Hamming join within blocks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitslice import Forest, linked_pairs
from .common import arrow_map, fresh, materialize, set_aside, slices, text_lengths, texts_of
from .graph import connected_components

SEED = 42
#: Rows of one key that are compared in one piece; a larger group is cut into tiles, every two of which meet.
TILE = 1024
#: Rows that a worker compares at a time.
CHUNK = 1 << 16
#: Shingles of documents that are compared at a time, and of a tile whose sets are compared within a group.
COMPARED, TILE_SHINGLES = 500_000, 1_000_000
#: Hash functions of a band, and bands, for candidates at a similarity of 0.8: one pair in ten thousand shares none.
BAND_ROWS, BANDS = 4, 18
#: Odd multipliers by which one shingle hash gives many: fixed by the seed.
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; fewer words are one shingle, none give none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """64 * ``words`` bits, each set if over half the hashes set it; further words come from multiplied hashes."""
    n = len(hashes)
    if not n:
        return np.zeros(words, np.uint64)
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, n, 4080):  # so many at a time that their bits stay small, whole groups of 255 of which the sums fit a byte
        part = hashes[i : i + 4080]
        wide = part[:, None] if words == 1 else np.concatenate([part[:, None], _mixed(part, words - 1)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(part), 8 * words), axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        counts += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
        if whole:
            counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64 * words), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def _mixed(hashes: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    x = hashes[:, None] * _ODD[None, skip : skip + n]
    x ^= x >> np.uint64(29)
    return x


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band: equal if the least values of its hash functions over the shingles are."""
    if not len(hashes):
        return np.arange(BANDS, dtype=np.int64)
    least = np.full(BANDS * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, _mixed(hashes[i : i + 4096], BANDS * BAND_ROWS, 8).min(axis=0), out=least)
    least = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(BAND_ROWS):
        key = (key ^ least[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, words: int = 1, bands: bool = False) -> DataFrame:
    """One row (id, f0 .. f<words-1>[, keys]) per document: the fingerprint as signed longs, and band keys if asked for.

    With ``bands`` each different shingle counts once (similarity of sets); without, repeats count.
    """
    fields = [T.StructField(f"f{i}", T.LongType()) for i in range(words)]
    schema = T.StructType([docs.schema[id], *fields, *([T.StructField("keys", T.ArrayType(T.LongType()))] if bands else [])])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column(1))):
                part = batch.slice(lo, hi - lo)
                found, keys = [], []
                for t in texts_of(part.column(1)):
                    hashes = shingle_hashes(t, width)
                    if bands:
                        hashes = np.unique(hashes)
                        keys.append(band_keys(hashes))
                    found.append(fingerprint(hashes, words))
                grid = np.array(found, np.uint64).reshape(-1, words).view(np.int64)
                columns = [part.column(0), *(pa.array(np.ascontiguousarray(grid[:, i])) for i in range(words))]
                if bands:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(docs.select(id, text), run, schema)


def pigeonhole_keys(radius: int, spare: int = 2) -> Column:
    """Keys of a 64-bit f0 of which two fingerprints within ``radius`` share at least one.

    The bits are cut into radius + spare blocks; of two fingerprints at most ``radius`` blocks differ, so they agree on
    at least ``spare`` of them: one key for each choice of that many.
    """
    blocks = radius + spare
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), spare)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        keys.append(F.xxhash64(F.lit(n), F.col("f0").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def pairs_of_small(group: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All row pairs (a, b) of the groups of at most ``small`` rows, and which rows are in larger groups."""
    _, kind, many = np.unique(group, return_inverse=True, return_counts=True)
    large = many[kind] > small
    found = [np.flatnonzero((group[d:] == group[:-d]) & ~large[d:]) for d in range(1, min(small, len(group)))]
    return np.concatenate([np.empty(0, np.int64), *found]), np.concatenate([np.empty(0, np.int64), *(a + d for d, a in enumerate(found, 1))]), large


def _linked(words: int, radii: tuple[int, ...], small: int):
    def run(batches):
        held, rows = None, 0

        def cut(table: pa.Table, last: bool):
            """Compare the groups that are complete, and keep the rest."""
            grid = np.stack([table.column(n).to_numpy() for n in ("key", "i", "j")], axis=1)
            new = np.r_[True, (grid[1:] != grid[:-1]).any(axis=1)]
            end = table.num_rows if last else int(np.flatnonzero(new)[-1])
            if end:
                fp = np.stack([table.column(f"f{k}").to_numpy()[:end] for k in range(words)], axis=1).view(np.uint64)
                group, rep = np.cumsum(new)[:end], table.column("rep").to_numpy()
                a, b, large = pairs_of_small(group, small)
                at = np.flatnonzero(large)
                c, d = linked_pairs(group[at], fp[at], radii)
                a, b = np.r_[a, at[c]], np.r_[b, at[d]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])
            return table.slice(end)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            rows = held.num_rows
            if rows >= CHUNK:
                held = yield from cut(held.combine_chunks(), False)
        if held is not None and held.num_rows:
            yield from cut(held.combine_chunks(), True)

    return run


def hamming_links(classes: DataFrame, keys: Column, words: int, radii: tuple[int, ...], small: int = 1) -> DataFrame:
    """Edges (a, b) that span the graph of ``classes`` (rep, f0 ..) at the last radius, among rows that share a key.

    A key with more than ``TILE`` rows is cut by a hash of rep into tiles, and each two tiles are compared in a task of
    their own, so that no group must fit one task. From a group of more than ``small`` rows comes a spanning forest, never
    all of its pairs; with ``small`` over 1 smaller groups give all pairs, at any distance, for a check that follows.
    """
    fp = [f"f{i}" for i in range(words)]
    rows = classes.select(F.explode(F.array_distinct(keys)).alias("key"), "rep", *fp)
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    rows = rows.join(hot, "key", "left").withColumn("t", F.ceil(F.coalesce("n", F.lit(1)) / TILE).cast("int"))
    return arrow_map(_dealt(rows).select("key", "i", "j", "rep", *fp), _linked(words, radii, small), "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (key, rep, t, ..), each once for every two of the ``t`` tiles of its key that hold it, ordered by (key, i, j, rep)."""
    own = F.pmod(F.xxhash64("rep"), F.col("t")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = rows.withColumn("own", own).withColumn("tile", F.explode(tiles)).withColumns({"i": F.col("tile.i"), "j": F.col("tile.j")}).drop("tile", "t")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")


def _set_of(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def shingle_sets(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """(id, set) of the documents (id, text) whose id is in ``need``; an id with several texts gives the smallest text's."""

    def sets(batches):
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column(1))):
                part = batch.slice(lo, hi - lo)
                lists = [_set_of(t, width).view(np.int64) for t in texts_of(part.column(1))]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*lists, np.empty(0, np.int64)])))], names=["id", "set"])

    need = materialize(need, "shingle-ids")
    picked = set_aside(docs, ["id"], need)[0].join(need, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return materialize(arrow_map(picked, sets, "id long, set array<long>"), "shingle-sets")


def verified(edges: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``edges`` (a, b) whose documents (id, text) have shingle sets of at least that Jaccard similarity.

    Only documents with an edge give their sets; an id with several texts gives those of the smallest text.
    """

    def compare(batches):
        for batch in batches:
            both_sizes = sum(np.diff(batch.column(k).offsets.to_numpy()).astype(np.int64) for k in (2, 3))
            for lo, hi in slices(both_sizes, COMPARED):
                part = batch.slice(lo, hi - lo)
                n, sides = part.num_rows, [part.column(k) for k in (2, 3)]
                sizes = [np.diff(c.offsets.to_numpy()) for c in sides]
                own = np.concatenate([np.repeat(np.arange(n), k) for k in sizes])
                values = np.concatenate([c.flatten().to_numpy() for c in sides])
                order = np.lexsort((values, own))
                values, own = values[order], own[order]
                both = np.bincount(own[1:][(values[1:] == values[:-1]) & (own[1:] == own[:-1])], minlength=n)
                good = pa.array(both >= similarity * (sizes[0] + sizes[1] - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    found = shingle_sets(docs, edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    side = lambda s: found.select(F.col("id").alias(s), F.col("set").alias(f"{s}_set"))
    return arrow_map(edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set"), compare, "a long, b long")


def similar_pairs(part: np.ndarray, ask: np.ndarray, sizes: np.ndarray, values: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Row pairs of at least that Jaccard similarity that join what ``part``, a number per row, holds apart.

    Row k has the next ``sizes[k]`` of ``values``, none twice. Rows in ``ask`` meet all others: their overlaps are counted
    over the posting lists of their values, so they are exact, and no pair is left out but those already joined.
    """
    n, forest = len(sizes), Forest(len(sizes))
    order = np.argsort(part, kind="stable")
    alike = part[order[1:]] == part[order[:-1]]
    forest.join(order[:-1][alike], order[1:][alike])
    by = np.argsort(values, kind="stable")
    new = np.flatnonzero(np.r_[True, np.diff(values[by]) != 0]) if len(values) else np.empty(0, np.int64)
    ends, row = np.r_[new[1:], len(values)].tolist(), np.repeat(np.arange(n), sizes)[by]
    code = np.empty(len(values), np.int64)
    code[by] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(values)]))
    starts, cuts, left, right = new.tolist(), np.cumsum(np.r_[0, sizes]), [], []
    for k in ask.tolist():
        mine = code[cuts[k] : cuts[k + 1]].tolist()
        if mine:
            both = np.bincount(np.concatenate([row[starts[c] : ends[c]] for c in mine]), minlength=n)
            near = np.flatnonzero(both >= similarity * (sizes[k] + sizes - both) - 1e-9)
            for j in near[forest.join(np.full(len(near), k), near)].tolist():
                left.append(k)
                right.append(j)
    return left, right


def _crowd(similarity: float):
    def pairs(table: pa.Table):
        rep, part, own = (table.column(c).to_numpy() for c in ("rep", "component", "own"))
        sets = table.column("set").combine_chunks()
        sizes, values = np.diff(sets.offsets.to_numpy()).astype(np.int64), sets.flatten().to_numpy()
        kinds, kind, many = np.unique(part, return_inverse=True, return_counts=True)
        # a pair of two components has a row outside the largest one, and a pair of two tiles has a row in the first
        ask = min(np.flatnonzero(kind != many.argmax()), np.flatnonzero(own == own.min()), key=len)
        if len(kinds) > 1:
            a, b = similar_pairs(part, ask, sizes, values, similarity)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            grid = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((grid[1:] != grid[:-1]).any(axis=1)) + 1).tolist(), len(grid)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and tuple(grid[lo]) != at:
                        yield from pairs(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    at = tuple(grid[lo])
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def crowded_links(classes: DataFrame, keys: Column, edges: DataFrame, docs: DataFrame, width: int, similarity: float, small: int) -> DataFrame | None:
    """Links (a, b) of at least that similarity that the forests of keys with over ``small`` rows left out, None if none can.

    ``edges`` are confirmed links. Where the rows of such a key are not all in one of their components, the shingle sets
    meet within the key, tile by tile, and a link counts if it joins two components. It is the sets that decide, so no
    similar pair of a key stays apart.
    """
    parts = connected_components(edges).select(F.col("node").alias("rep"), "component")
    rows = classes.select(F.explode(F.array_distinct(keys)).alias("key"), "rep").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    crowd = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("n") > small) & (F.col("lo") < F.col("hi")))
    rows = materialize(rows.join(crowd.select("key"), "key", "left_semi"), "crowds")
    if rows.isEmpty():
        return None
    found = shingle_sets(docs, rows.select(F.col("rep").alias("id")).distinct(), width).withColumnRenamed("id", "rep")
    held = rows.join(found.select("rep", F.size("set").alias("size")), "rep").groupBy("key")
    tiles = held.agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_SHINGLES, F.lit(1))).cast("int").alias("t"))
    dealt = _dealt(rows.join(tiles, "key").join(found, "rep"))
    return arrow_map(dealt.select("key", "i", "j", "rep", "component", "own", "set"), _crowd(similarity), "a long, b long")


def simhash_groups(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, words: int = 1, radii: tuple[int, ...] = (3,), bands: bool = False, similarity: float | None = None, small: int = 1
) -> DataFrame:
    """(id, fingerprint, component_id) per document: the smallest id reachable over links of ``radii[-1]`` bits or less.

    ``words`` = 1 and no ``bands``: the join is exact, by pigeonhole keys. With ``bands`` candidates are documents that
    share a band of shingle minima, and the fingerprint decides, or, if ``similarity`` is named, the shingle sets do: up to
    ``small`` documents that share a band all meet each other; of more, those near by fingerprint do first, and all where
    that leaves them in several components. Use it for similarities whose radius is too wide for pigeonhole keys. Equal
    fingerprints are one node, so copies cost nothing in the join.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id get a null component and link
    nothing; repeated ids are one node with all fingerprints of the id. An empty table gives an empty result. The result
    has the id and these two columns only, so other columns of ``docs`` can't clash.
    """
    fp = [f"f{i}" for i in range(words)]
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = materialize(fingerprints(base, "id", "text", width, words, bands), "simhash")
    by = [*fp, "keys"] if bands else fp
    classes = materialize(found.where("id is not null").groupBy(*by).agg(F.min("id").alias("rep")), "simhash-classes")
    keys = F.concat("keys", F.array(F.xxhash64(*fp))) if bands else pigeonhole_keys(radii[-1])
    edges = hamming_links(classes, keys, words, radii, small)
    if similarity is not None:
        edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "simhash-edges")
        edges = materialize(verified(edges, base, width, similarity), "simhash-links")
        more = crowded_links(classes, keys, edges, base, width, similarity, small)
        edges = edges if more is None else edges.union(more)
    # an id with several rows ties their fingerprints together; only ids that repeat have such edges
    again = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    ties = found.join(again, "id").join(classes, by).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(edges.union(ties))
    to = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*by, F.coalesce("component", "rep").alias("component_id"))
    text_of = reduce(lambda a, b: F.concat(a, b), [F.lower(F.lpad(F.hex(c), 16, "0")) for c in reversed(fp)])
    return found.join(to, by, "left").select(F.col("id").alias(id), text_of.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``simhash_groups`` for a similarity of 0.8 of five-word shingle sets.

    The sets decide on every pair that shares a band, or all of the fingerprint; 256 bits, of which 15 in 100 differ on
    average at that similarity, only order large groups. A pair at 0.8 is missed if it shares no band: 0.8 in ten thousand.
    """
    return simhash_groups(docs, id, text, width=5, words=4, radii=(30, 50), bands=True, similarity=0.8, small=32)


def keep_first(docs: DataFrame, groups: DataFrame, id: str = "doc_id") -> DataFrame:
    """Of each group the document with the smallest id, all columns kept; rows with a null id all stay."""
    (key,) = fresh(docs, "__key")
    gone = materialize(groups.where(F.col(id) != F.col("component_id")).select(F.col(id).cast("long").alias(key)).distinct(), "near-copies")
    some, rest = set_aside(docs.withColumn(key, F.col(id).cast("long")), [key], gone)
    return rest.select(*docs.columns).unionByName(some.join(gone, key, "left_anti").select(*docs.columns))
