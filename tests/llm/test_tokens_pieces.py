import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tomewright.llm import pieces, queries, tokens

LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OWN = pieces.load(pieces.default_model())


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=60))
def test_encodes_as_the_library(text):
    ids = LIB.encode(text, add_eos=True)
    assert OWN.encode(text) == ids and OWN.decode(ids) == LIB.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(" ▁\n\tabcdethinrs.,<>/é", max_size=50))
def test_encodes_likely_pieces(text):
    assert OWN.encode(text) == LIB.encode(text, add_eos=True)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 262)), max_size=12))
@example([197, 1, 131])
@example([197, 2, 131])
@example([1, 197, 131, 2])
def test_decodes_any_ids(ids):
    assert OWN.decode(ids) == LIB.decode(ids)


def test_whole_documents(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    docs = documents.collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = LIB.encode(r["text"] or "", add_eos=True)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_very_long_stretches():
    rng = random.Random(2)
    text = "".join(rng.choice("aeinrst") for _ in range(20_000)) + " " * 3000 + "x" * 3000
    assert OWN.encode(text) == LIB.encode(text, add_eos=True)


def test_memo_forgets(monkeypatch):
    memo = pieces._Memo(str.upper, 4 * (pieces.ENTRY + 2))
    for k in range(10, 30):
        assert memo[f"a{k}"[1:]] == str(k)
    assert len(memo) <= 4 and memo.held == len(memo) * (pieces.ENTRY + 2)
    assert memo["x" * 500] == "X" * 500 and len(memo) <= 4


def test_odd_rows(spark, odd, none):
    got = pieces.encode_pieces(odd)
    assert set(got.columns) == set(odd.columns) - {"text"} and got.where("id = 'clash'").count() == odd.count()
    rows = got.collect()
    assert len(rows) == odd.count() and [r["ids"] for r in rows if r["doc_id"] in (2, 3)] == [[2], [2]] and all(r["decoded"] == "" for r in rows if r["doc_id"] in (2, 3))
    assert pieces.encode_pieces(none).count() == 0
    back = pieces.decode_pieces(got.select("doc_id", "ids")).where("doc_id = 7").first()
    assert back["decoded"] == "ü Ö ß 日本語 🙂́"


def test_sections_add_up(spark, documents, odd, none):
    encoding, sizes = tokens.load(tokens.default_ranks())
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for rule in tokens.RULES:
        for r in tokens.count_tokens(documents.limit(40), rule=rule).collect():
            text = texts[r["doc_id"]]
            ids = encoding.encode_ordinary(text)
            assert r["n_tokens"] == len(ids) == sum(r["section_tokens"])
            raw, at, want = text.encode(), 0, [0] * len(r["section_tokens"])
            borders = [0, *[i + 1 for i, b in enumerate(raw) if b == 10 and i + 1 < len(raw)], len(raw)]
            for t in ids:
                span = range(at, at + int(sizes[t]))
                at = span.stop
                inside = [sum(lo <= b < hi for b in span) for lo, hi in zip(borders, borders[1:])]
                hit = [k for k, n in enumerate(inside) if n]
                want[hit[0] if rule == "first" else hit[-1] if rule == "last" else int(np.argmax(inside))] += 1
            assert want == r["section_tokens"]
    got = {r["doc_id"]: (r["n_tokens"], r["n_sections"]) for r in tokens.count_tokens(odd).collect()}
    assert got[2] == got[3] == (0, 0) and got[4][1] == 2 and tokens.count_tokens(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(" \t\n  \u0085\x1f'stab1.é", max_size=40))
def test_long_blanks_are_cut_where_the_pattern_cuts(text):
    import re

    encoding, _ = tokens.load(tokens.default_ranks())
    whole, tokens.LONG_BLANK = tokens.LONG_BLANK, re.compile(tokens.LONG_BLANK.pattern.replace("10000", "2"))
    try:
        assert tokens.encode(encoding, text).tolist() == encoding.encode_ordinary(text)
    finally:
        tokens.LONG_BLANK = whole


def test_very_long_blanks(spark):
    texts = [" " * 5_000_000, "a" + "\n" * 3_000_000 + " b", "x" * 2_000_000]
    got = {r["doc_id"]: r for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), separator="\x00").collect()}
    encoding, sizes = tokens.load(tokens.default_ranks())
    for i, t in enumerate(texts):
        assert got[i]["section_tokens"] == [got[i]["n_tokens"]] and int(sizes[tokens.encode(encoding, t)].sum()) == len(t)


def test_fields_share_their_document(spark):
    rows = [(1, "A title", None, "the body, of more words"), (2, None, "", None), (3, "", "only this", None), (4, "x", "y", "z")]
    df = spark.createDataFrame(rows, "id long, title string, note string, body string")
    encoding, sizes = tokens.load(tokens.default_ranks())
    for r in tokens.count_field_tokens(df, ["title", "note", "body"], "id").collect():
        own = rows[r["id"] - 1][1:]
        text = "\n".join(t for t in own if t)
        ids = encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) == sum(r["field_tokens"]) and len(r["field_tokens"]) == 3
        at, want, left = 0, [0, 0, 0], [k for k, t in enumerate(own) if t]
        spans = {k: sum(len(own[j].encode()) + 1 for j in left if j < k) for k in left}
        for t in ids:
            want[max(k for k in left if spans[k] <= at)] += 1
            at += int(sizes[t])
        assert want == r["field_tokens"]
