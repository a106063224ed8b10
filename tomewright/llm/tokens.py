"""Token counts: whole documents are encoded once, and tokens are attributed to sections by their offsets."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, slices, text_lengths, texts_of

#: How a token that crosses a border between sections is allocated: to the section that holds its first byte, its last
#: byte, or most of its bytes (of equals the earlier one).
RULES = ("first", "last", "most")
#: White space of the pattern, in runs so long that the encoder would recurse too deeply over them.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


_LOADED: dict = {}


def load(path: str):
    """The encoding of a ranks file, and the bytes of each of its tokens."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _LOADED[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _LOADED[path]


def encode(encoding, text: str) -> np.ndarray:
    """Token ids of a text, equal to ``encode_ordinary`` but for any length of white space.

    The pattern matches a run of white space whole at the end of a text, and all but its last character before others; no
    match crosses these two places, so a long run is encoded as the match that it is.
    """
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += [*encoding.encode_ordinary(text[at : run.start()]), *encoding._encode_single_piece(text[run.start() : end])]
        at = end
    return np.asarray([*out, *encoding.encode_ordinary(text[at:])] if out else encoding.encode_ordinary(text), np.int64)


def section_spans(text: bytes, separator: bytes) -> np.ndarray:
    """Starts of the sections: a section is what ends with a separator, which belongs to it, or with the text."""
    starts, at = [0], text.find(separator)
    while at >= 0 and at + len(separator) < len(text):
        starts.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    return np.array(starts, np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, from the byte ends of the tokens and the byte starts of the sections."""
    begins = np.r_[0, ends[:-1]]
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    to = first if rule == "first" else last
    if rule == "most":
        to = first.copy()
        for t in np.flatnonzero(first != last).tolist():
            cuts = np.r_[begins[t], starts[first[t] + 1 : last[t] + 1], ends[t]]
            to[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(to, minlength=len(starts))


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", separator: str = "\n", rule: str = "first", ranks: str | None = None) -> DataFrame:
    """(id, n_tokens, n_sections, section_tokens) per document; the counts of the sections sum up to ``n_tokens``.

    The whole text is encoded in one piece, so a section's count is what it adds to its document and not what it would be
    alone. Token spans in bytes are joined with the sections' intervals by binary search; a token across a border goes to
    one section by ``rule``. Null and empty texts have no tokens and no sections. Rows are independent: repeated rows come
    each, other columns are not in the result, and no length or run of characters is too long.
    """
    sep = separator.encode()

    def cut(values):
        for t in texts_of(values[0]):
            yield t, section_spans(t.encode("utf-8", "replace"), sep) if t else np.empty(0, np.int64)

    return _counted(docs.select(id, text), cut, rule, ranks, "section_tokens").select(id, "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "section_tokens")


def count_field_tokens(docs: DataFrame, fields: list[str], id: str = "doc_id", joiner: str = "\n", rule: str = "first", ranks: str | None = None) -> DataFrame:
    """(id, n_tokens, field_tokens) per document: how many of its tokens each of its text ``fields`` takes, in that order.

    The document is its fields that are not null or empty, with ``joiner`` between them, which belongs to the field before
    it. It is encoded once, and its tokens are attributed as those of ``count_tokens``; null and empty fields have none.
    """

    def cut(values):
        for row in zip(*map(texts_of, values)):
            some = [k for k, t in enumerate(row) if t]
            parts = [t + joiner if t and k != some[-1] else t for k, t in enumerate(row)]
            sizes = [len(t.encode("utf-8", "replace")) for t in parts]
            yield "".join(parts), np.cumsum([0, *sizes[:-1]])

    return _counted(docs.select(id, *fields), cut, rule, ranks, "field_tokens")


def _counted(rows: DataFrame, cut, rule: str, ranks: str | None, name: str) -> DataFrame:
    """(id, n_tokens, ``name``) of ``rows`` (id, texts); ``cut`` makes of the texts each document and its sections' starts."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = ranks or default_ranks()
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches):
        encoding, sizes = load(path)
        for batch in batches:
            for lo, hi in slices(sum(text_lengths(c) for c in batch.columns[1:])):
                part = batch.slice(lo, hi - lo)
                totals, counts = [], []
                for t, starts in cut(part.columns[1:]):
                    ids = encode(encoding, t)
                    bounds = np.cumsum(sizes[ids])
                    counts.append(attribute(bounds, starts, rule) if len(ids) else np.zeros(len(starts), np.int64))
                    totals.append(len(ids))
                ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*counts, np.empty(0, np.int64)]).astype(np.int64)))], names=schema.names)

    return arrow_map(rows, run, schema)
