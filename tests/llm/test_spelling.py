import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tomewright.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def groups(counts):
    out = []
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def words_of(docs):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def test_forms_of_documents(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdeéßØ"), int(rng.integers(7, 12)))) for _ in range(12)]
    rare = [w[:k] + c + w[k + d :] for w in base for k, c, d in zip(rng.integers(0, 7, 6), "abéxyz", (0, 1, 0, 1, 0, 1))]
    long = "q" * 90
    docs = [(i, " ".join([*rng.choice(base, 60), *rng.choice(rare, 5)]) + f" {base[0].upper()}-{base[1]}2{base[2]} short") for i in range(120)]
    docs += [(200, None), (201, ""), (None, f"{base[0]} {base[1]}"), (None, f"{base[0]} {base[1]}"), (202, f"{long} {long} {long[:-1]} {long[:-1]}x{long} {long}r {long}r {long}r"), (202, f"{long}r {long[:40]}z{long[40:]} {long[:40]}z{long[40:]}")]
    docs += [(300 + i, "mississippi " * 2 + "misissippi " * 30 + "misisippi " * 400) for i in range(3)]
    want = groups(words_of(docs))
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want) and sum(len(r[0]) > 64 for r in want) > 2
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "'y' as own", "2 as key", "'z' as form", "'k' as kind")
    assert sorted((tuple(r) for r in spelling.spelling_variants(df).collect()), key=lambda r: r[0]) == want
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("symbols", [2, 5])
def test_near_words_equal_all_pairs(spark, symbols, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 6)  # both ways of sending words
    monkeypatch.setattr(spelling, "SLICE", 50)
    rng = np.random.default_rng(symbols)
    words = sorted({"".join(rng.choice(list("aàbz"), int(rng.integers(1, 10)))) for _ in range(400)})
    rows = spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), symbols).collect()
    got = [tuple(sorted((r["a"], r["b"]))) for r in rows]
    want = {(v, w) for k, v in enumerate(words) for w in words[k + 1 :] if one_edit(v, w)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_word_of_very_many_letters():
    own, replaced, counts, deleted = spelling.neighbourhoods(["ab" * 60_000])
    assert len(own) == 1 and counts[0] == len(replaced) <= 7 * 120_000 and deleted.shape == (1, 120_000)
