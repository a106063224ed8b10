import numpy as np
import pytest
from plain import components, shingle_set, simhash

from tomewright.llm import bitslice
from tomewright.llm import simhash as op
from tomewright.llm.graph import connected_components


def test_query_is_exact(spark, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    fp = {i: simhash(t) for i, t in docs.items()}
    want = components(docs, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = op.simhash_groups(documents).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("words, radius", [(1, 3), (1, 0), (4, 50)])
def test_bit_sliced_groups(words, radius):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, (12, words), dtype=np.uint64)
    rows = base[rng.integers(0, 12, 900)]
    for _ in range(3):
        rows[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    group = np.sort(rng.integers(0, 20, 900))
    group[300:650] = group[300]
    group = np.maximum.accumulate(group)
    near = (np.bitwise_count(rows[:, None] ^ rows[None]).sum(2) <= radius) & (group[:, None] == group[None])
    want = components(range(900), lambda a, b: near[a, b])
    for small in (1, 16):
        a, b = bitslice.linked_pairs(group, rows, (radius,), small)
        assert near[a, b].all()
        forest = bitslice.Forest(900)
        forest.join(a, b)
        assert forest.roots(np.arange(900)).tolist() == [want[i] for i in range(900)]


def test_hot_key_is_tiled(spark, monkeypatch):
    """A group larger than a tile: neighbours in a chain of one-bit steps stay linked across tiles."""
    monkeypatch.setattr(op, "TILE", 8)
    gray = [i ^ (i >> 1) for i in range(60)]
    classes = spark.createDataFrame([(100 + i, g) for i, g in enumerate(gray)], "rep long, f0 long")
    edges = op.hamming_links(classes, op.pigeonhole_keys(1), 1, (1,))
    parts = connected_components(edges).collect()
    assert {r["component"] for r in parts} == {100} and len(parts) == 60


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, k) for k in range(1001, 1400)] + [(None, 3), (5, None)]
    links = {frozenset(p) for p in pairs if None not in p}
    nodes = {x for p in links if len(p) == 2 for x in p}
    want = components(nodes, lambda a, b: frozenset((a, b)) in links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


def test_near_duplicates_at_similarity(spark):
    rng = np.random.default_rng(1)
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 240)]
        texts.append(" ".join(words))
        for edits in (1, 3, 5, 8):
            copy = list(words)
            for at in rng.integers(0, 240, edits):
                copy[at] = "edit"
            texts.append(" ".join(copy))
        if k % 10 == 0:
            texts.append(texts[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    want = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = op.near_duplicates(df)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == want
    assert sorted(r["doc_id"] for r in op.keep_first(df, groups).collect()) == sorted({v for v in want.values()})


def test_large_family_against_brute_force(spark):
    """Several hundred differently edited copies: most are similar to the original alone, some to each other."""
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 5000, 240)]
    texts = [" ".join(words)]
    for k in range(400):
        copy = list(words)
        for at in rng.choice(240, 4 + k % 3, replace=False):
            copy[at] = f"edit{rng.integers(0, 1 << 30)}"
        texts.append(" ".join(copy))
    order = rng.permutation(len(texts))  # the original is not the first
    df = spark.createDataFrame([(n, texts[i]) for n, i in enumerate(order.tolist())], "doc_id long, text string")
    sets = [shingle_set(texts[i]) for i in order]
    want = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert max(np.unique(list(want.values()), return_counts=True)[1]) > 250
    assert {r["doc_id"]: r["component_id"] for r in op.near_duplicates(df).collect()} == want


def similar_groups(sets, least=0.8):
    """Components by overlaps counted over the documents of each shingle, all pairs compared."""
    where, n = {}, len(sets)
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    where, sizes, near = {x: np.array(v) for x, v in where.items()}, np.array([len(s) for s in sets]), []
    for i, s in enumerate(sets):
        both = np.bincount(np.concatenate([where[x] for x in s]), minlength=n)
        near.append(np.flatnonzero(both >= least * (sizes[i] + sizes - both)))
    forest = bitslice.Forest(n)
    for i, found in enumerate(near):
        forest.join(np.full(len(found), i), found)
    return forest.roots(np.arange(n)).tolist()


@pytest.mark.parametrize("size", [33, 300, 3000])
def test_families_against_brute_force(spark, size):
    """Families of edited copies, two of them and some strangers: exactly the groups that comparing all pairs gives."""
    rng = np.random.default_rng(size)
    texts = [" ".join(f"s{x}" for x in rng.integers(0, 1 << 30, 100)) for _ in range(20)]
    for family in range(2 if size < 3000 else 1):
        words = [f"f{family}w{x}" for x in rng.integers(0, 5000, 240)]
        texts.append(" ".join(words))
        for k in range(size - 1):
            copy = list(words)
            for at in rng.choice(240, 4 + k % 4, replace=False):
                copy[at] = f"edit{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(copy))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    want = similar_groups([shingle_set(t) for t in texts])
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts) * 0.6


def test_large_family_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 32)
    test_large_family_against_brute_force(spark)


def test_pairs_far_by_fingerprint_are_linked(spark):
    """Pairs just above 0.8 are all found, those over 50 of 256 bits apart included."""
    rng = np.random.default_rng(11)
    texts, far = [], 0
    while len(texts) < 1600 or far < 5:
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 90)]
        copy = list(words)
        copy[45] = "edit"
        pair = [" ".join(words), " ".join([*copy[:-7], "end"])]
        one, two = (np.unique(op.shingle_hashes(t, 5)) for t in pair)
        both = len(np.intersect1d(one, two))
        assert 0.8 <= both / (len(one) + len(two) - both) < 0.81
        far += np.bitwise_count(op.fingerprint(one, 4) ^ op.fingerprint(two, 4)).sum() > 50
        texts += pair
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_odd_rows(spark, odd, none):
    got = op.simhash_groups(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    zero = "0" * 16
    assert by[2] == by[3] == by[4] == {(zero, 2)} and {c for _, c in by[None]} == {None} and {c for _, c in by[6]} == {6} and len(by[6]) == 2
    assert next(iter(by[1]))[1] == 1
    assert op.simhash_groups(none).count() == 0 and op.near_duplicates(none).count() == 0
    left = op.keep_first(odd, op.near_duplicates(odd))
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, None, 5, 6, 7}
