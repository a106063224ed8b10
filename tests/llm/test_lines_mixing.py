import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest
from plain import repeated_lines

from tomewright.llm import linededup, mixing, queries


def dedup(texts):
    gone = repeated_lines(texts)
    return {i: [line.strip() for k, line in enumerate((t or "").split("\n")) if line.split() and k not in gone[n]] for n, (i, t) in enumerate(texts)}


def kept(rows):
    return {r["doc_id"]: [line.strip() for line in (r["text"] or "").split("\n") if line.split()] for r in rows}


def test_whole_documents(spark, documents):
    texts = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert kept(linededup.dedup_lines(documents).collect()) == dedup(texts)


@pytest.mark.parametrize("seed", range(4))
def test_random_lines(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") + str(k) for _ in range(rng.choice([1, 3, 9, 20, 45, 60]))) for k in range(25)]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] for _ in range(8)]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(blocks) if rng.random() < 0.6 else [f"own {i} {rng.random()}"] * rng.randint(0, 2)
            lines += [""] * rng.randint(0, 1)
        texts.append((i, "\n".join(lines)))
    got = kept(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == dedup(texts)


def test_text_that_repeats_itself(spark):
    """Of a run that follows itself the first copy stays whole, and a rest of less than 50 words is no repeat."""
    ten, (three, four) = " ".join(f"t{k}" for k in range(10)), [[" ".join(f"{c}{k}" for k in range(20)) for c in letters] for letters in ("abc", "def")]
    texts = [(1, "\n".join([ten] * 20)), (2, "\n".join([f"u {ten}"] * 6)), (3, "\n".join(three * 3)), (4, "\n".join([*four, four[0], "end"])), (5, "\n".join(["v " + ten] * 11)), (6, "\n".join(["v " + ten] * 3))]
    got = kept(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == dedup(texts)
    assert got[1] == [ten] * 5 and len(got[2]) == 6 and got[3] == three and got[4] == [*four, four[0], "end"] and len(got[5]) == 5


def test_runs_extend_to_any_earlier_place(spark):
    """A run whose opening comes first with another continuation goes as far as it agrees with a later place."""
    a, b, c, x = (" ".join(f"{t}{k}" for k in range(n)) for t, n in (("a", 50), ("b", 40), ("c", 5), ("x", 40)))
    texts = [(1, f"{a}\n{x}"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}"), (4, f"{a}\n{b}\n{c}"), (5, f"{a}\n{b}\n{c}"), (6, f"{a}\n{c}")]
    got = kept(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == dedup(texts) == {1: [a, x], 2: [b], 3: [], 4: [c], 5: [], 6: [c]}


@pytest.mark.parametrize("seed", range(4))
def test_random_openings_match_plain(spark, seed):
    rng = random.Random(100 + seed)
    pool = [" ".join(rng.choice("abcdefgh") + str(k) for _ in range(rng.choice([1, 3, 9, 20, 45, 60]))) for k in range(12)]
    texts = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 3)):
            lines += [pool[k] for k in ((0, 1, 2), (3, 4), (5,))[rng.randint(0, 2)]] + [rng.choice(pool) for _ in range(rng.randint(0, 4))]
        texts.append((i, "\n".join(lines)))
    got = kept(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == dedup(texts)


def test_windows_guarantee_a_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        run = [" ".join(["w"] * rng.randint(1, 30) + [str(rng.random())]) for _ in range(12)]
        if sum(len(x.split()) for x in run) < 50:
            continue
        ends = [{w[0] for w in linededup.anchors("\n".join([f"head {rng.random()}", *run, f"tail {rng.random()}"]), 50)} for _ in range(2)]
        assert ends[0] & ends[1]


def test_odd_rows(spark, odd, none):
    got = linededup.dedup_lines(odd)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count() and got.where("__th = 'clash' and doc = 'clash'").count() == odd.count()
    assert {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] in (2, 3)} == {2: None, 3: ""}
    assert linededup.dedup_lines(none).count() == 0
    line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, line), (1, line), (2, f"x\n{line}\n\n y "), (None, line), (3, line)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in linededup.dedup_lines(df).collect()), key=repr)
    assert rows == sorted([(1, line, 0), (1, line, 0), (2, "x\n\n y ", 1), (None, line, 0), (3, "", 1)], key=repr)
    assert linededup.dedup_lines(df, drop_emptied=True).where("doc_id = 3").count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------------
def pour(leaves, weights, budget, epochs):
    out = {}

    def cap(pre):
        return sum(v for k, v in leaves.items() if k[: len(pre)] == pre) * epochs

    def alloc(pre, b):
        if len(pre) == 3:
            out[pre] = b
            return
        kids = sorted({k[: len(pre) + 1] for k in leaves if k[: len(pre)] == pre})
        w = {k: weights.get("/".join(k), 1) for k in kids}
        full = set()
        while True:
            left, rest = b - sum(map(cap, full)), sum(w[k] for k in kids if k not in full)
            new = {k for k in kids if k not in full and Fraction(left * w[k], rest) >= cap(k)} if rest else set()
            if not new:
                break
            full |= new
        for k in kids:
            alloc(k, cap(k) if k in full else left * w[k] // rest)

    alloc((), min(budget, cap(())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randint(0, 2)}", f"l{rng.randint(0, 2)}", f"s{k}"): rng.choice([5, 50, 500, 5000]) for k in range(14)}
    weights = {"/".join(k[:n]): rng.randint(1, 6) for k in leaves for n in (1, 2, 3) if rng.random() < 0.6}
    budget = rng.choice([100, 3000, 10**6])
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "d string, l string, s string, tokens long")
    got = {(r["d"], r["l"], r["s"]): r["budget"] for r in mixing.leaf_budgets(df, ["d", "l", "s"], weights, budget, 2).collect()}
    assert got == pour(leaves, weights, budget, 2)


def test_shortage_goes_to_siblings_first(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, l string, tokens long")
    got = {(r["d"], r["l"]): r["budget"] for r in mixing.leaf_budgets(df, ["d", "l"], {}, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}


def test_query_takes_the_prefixes(spark, documents):
    q = queries
    rows = [(r["doc_id"], "web" if r["source"][-1] in "01234" else "books", r["lang"], r["source"], -(-len(r["text"].encode()) // 4)) for r in documents.collect() if r["text"]]
    leaves = Counter()
    for r in rows:
        leaves[r[1:4]] += r[4]
    budgets = pour(leaves, q.WEIGHTS, int(sum(leaves.values()) * q.FRACTION), q.EPOCHS)
    want = Counter()
    for leaf, b in budgets.items():
        own = [r for r in rows if r[1:4] == leaf]
        whole, part = divmod(b, leaves[leaf])
        want.update((r[0], e) for e in range(whole) for r in own)
        run = 0
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{q.SEED}:{whole}:{r[0]}".encode()).hexdigest(), r[0])):
            run += r[4]
            if run > part:
                break
            want[r[0], whole] += 1
    got = Counter((r["doc_id"], r["epoch"]) for r in q.op5_mixing(spark, "/root/testdata/sf0.001").collect())
    assert got == want


def test_odd_mixing(spark, odd, none):
    got = mixing.mix(odd, queries.LEVELS, {}, 1.0)
    assert got.columns == ["doc_id", "domain", "lang", "source", "tokens", "epoch"]
    assert Counter(r["doc_id"] for r in got.collect()) == {1: 2, 4: 1, 5: 1, 6: 2, 7: 1}
    assert mixing.mix(none, queries.LEVELS, {}, 1.0).count() == 0 and mixing.mix(odd, queries.LEVELS, {}, 0.0).count() == 0
    assert mixing.mix(odd, queries.LEVELS, {"web": 0, "books": 0}, 1.0).count() == 0


def test_short_lines_come_in_bounded_batches(spark, monkeypatch):
    """A text of very many one-word lines: rows go on in small batches, and the result is that of one large batch."""
    made = linededup._anchor_batch
    rows = list(linededup.anchors("a\n" * 20_000, 50))
    assert len(rows) == 20_000 - 50 + 1 and max(len(r[1]) for r in rows) <= 51
    batches, part = [], []
    for row in rows:
        part.append((1, 1, *row))
        if sum(len(r[3]) for r in part) > linededup.ENTRIES // 50:
            batches.append(made(part))
            part = []
    seen = [b.nbytes for b in batches]
    assert len(seen) > 10 and max(seen) < 1_000_000
    want = sorted(tuple(r) for r in linededup.dedup_lines(spark.createDataFrame([(1, "a\n" * 300), (2, "b c\n" * 60)], "doc_id long, text string")).collect())
    monkeypatch.setattr(linededup, "ENTRIES", 100)
    assert sorted(tuple(r) for r in linededup.dedup_lines(spark.createDataFrame([(1, "a\n" * 300), (2, "b c\n" * 60)], "doc_id long, text string")).collect()) == want
    assert want[0][2] == 250 and want[1][2] == 35
