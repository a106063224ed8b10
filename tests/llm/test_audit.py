import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import audit

DOCS = "doc_id long, text string, source string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    """Filters applied one after the other to lists of documents."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s in docs:
        failed = {k for k, v in {**fails(t or ""), "E": i is not None and i > least[t or ""]}.items() if v}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((s or "", failed, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                of = [r for r in rows if r[0] == part and f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(of) - len(gone), sum(r[1] == {f} for r in of), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] += len(gone)
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items())


def got(spark, docs, labels, **more):
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as part", "'y' as mask", "1 as n", "2 as good", "3 as digest")
    return sorted(tuple(r) for r in audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more).collect())


def test_equals_filters_applied_in_turn(spark):
    rng = np.random.default_rng(1)
    texts = ["", "a b c", "word " * 250, " ".join(f"w{i}" for i in range(250)), "ABC " * 250, " ".join(f"W{i}" for i in range(300)), "a#b " + " ".join(f"x{i}" for i in range(220)), "50% off", "\x0b\x0c\x1c é", " ".join(f"v{i}" for i in range(60_000)), None]
    docs = [(int(i), texts[int(rng.integers(0, len(texts)))], [None, "", "s", "t"][int(rng.integers(0, 4))]) for i in rng.permutation(160)]
    docs += [docs[0], docs[1], (docs[2][0], "another text", "s"), (docs[3][0], docs[3][1], "t"), (None, "a b c", "s"), (None, None, "u"), (None, "a b c", "s")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 160, 2)] + [(4, None, 1), (6, 1, 1), (6, 0, 0), (None, 1, 1), (999, 1, 1), (8, 2, None)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_empty_table_and_own_filters(spark):
    assert got(spark, [], []) == []
    rows = got(spark, [(1, "a", "s"), (2, "a", "s"), (3, "bb", "s")], [], filters={"X": F.length("text") > 1}, duplicate="Y")
    assert rows == [("s", "XY", 1, 2, 1, 0, 1, 0, 0, 2), ("s", "XY", 2, 1, 1, 0, 1, 0, 0, 2), ("s", "YX", 1, 2, 1, 0, 1, 0, 0, 2), ("s", "YX", 2, 1, 1, 0, 1, 0, 0, 2)]
    with pytest.raises(ValueError, match="single letters"):
        got(spark, [], [], duplicate="A")


def test_walk_equals_sums_over_subsets():
    cells = np.random.default_rng(2).integers(0, 9, (3, 32, 3))
    want = np.stack([cells[:, [m for m in range(32) if not m & s]].sum(1) for s in range(32)], 1)
    assert (audit.gray_walk(cells) == want).all()
