"""Line dedup: winnowing over line hashes, joined positions, matches extended both ways, later repeated runs deleted."""

from __future__ import annotations

from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, materialize, set_aside, slices, text_lengths, texts_of

#: Words from which a repeated run of lines is deleted.
MIN_WORDS = 50
#: Entries of the lists that are sent on at a time, about.
ENTRIES = 250_000

ANCHORS = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("fp", pa.int64()), ("lines", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("shortest", pa.list_(pa.int32())), ("longest", pa.list_(pa.int32()))])
ANCHORS_DDL = "doc long, th long, fp long, lines array<long>, at array<int>, shortest array<int>, longest array<int>"
RUNS_DDL = "doc long, th long, run long, start int, end int"


def anchors(text: str, min_words: int):
    """(fp, lines, at, shortest, longest), as arrays, for each line of a text that winnowing selects, one after the other.

    A window is the shortest run of lines from some line on that has ``min_words`` words, and selects the least line hash in
    it, of equals the last. So any run of that many words that two texts share holds a window, and both select the same line
    in it. ``fp`` is the selected hash, ``lines`` the hashes and ``at`` the numbers of the lines that its matches may reach:
    back to the first window that selects it, and on to where the window after the last one ends. The k-th window that
    selects it starts at ``lines[k]`` and, written as numbers of lines, has ``shortest[k]``; a match that starts there may
    have up to ``longest[k]`` before the next window takes over. Lines without a word are passed over.
    """
    hashes, counts, at = array("q"), array("q"), array("i")
    for i, line in enumerate(text.split("\n")):
        n = len(line.split())
        if n:
            hashes.append(xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - (1 << 63))
            counts.append(n)
            at.append(i)
    hashes, at, ends = np.array(hashes, np.int64), np.array(at, np.int32), np.cumsum(np.array(counts, np.int64))
    if not len(ends) or ends[-1] < min_words:
        return
    last = np.searchsorted(ends, np.r_[0, ends[:-1]] + min_words)  # the line with which each window has enough words
    last = last[last < len(hashes)]
    reach = np.maximum(last + 1, np.r_[last[1:], len(hashes)])
    picks = _window_minima(hashes, last)
    cuts = np.r_[0, np.flatnonzero(np.diff(picks)) + 1, len(picks)]
    for first, end in zip(map(int, cuts[:-1]), map(int, cuts[1:])):
        hi, starts = int(reach[first:end].max()), np.arange(first, end)
        yield int(hashes[picks[first]]), hashes[first:hi], at[first:hi], (last[first:end] + 1 - starts).astype(np.int32), (reach[first:end] - starts).astype(np.int32)


def _window_minima(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each window i to last[i] the place of its least hash, of equals the last; the ends never go back."""
    out, rising, upto, values = np.empty(len(last), np.int64), deque(), 0, memoryview(hashes)
    for i, end in enumerate(memoryview(last)):
        while upto <= end:
            while rising and values[rising[-1]] >= values[upto]:
                rising.pop()
            rising.append(upto)
            upto += 1
        while rising[0] < i:
            rising.popleft()
        out[i] = rising[0]
    return out


def _anchor_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc, th, fp, lines, at, shortest, longest) with arrays in the last four places."""
    columns = list(zip(*rows))
    lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in c])], pa.int32()), pa.array(np.concatenate(c))) for c in columns[3:]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *lists], schema=ANCHORS)


def runs_around(lines: np.ndarray, at: np.ndarray, shortest: np.ndarray, longest: np.ndarray):
    """(run, start, end) for each match that an anchor may have: the hash of its lines, its first and last line number."""
    packed, at = lines.tobytes(), at.tolist()
    for k, (a, b) in enumerate(zip(shortest.tolist(), longest.tolist())):
        for n in range(a, b + 1):
            yield xxhash.xxh64_intdigest(packed[8 * k : 8 * (k + n)], 1) - (1 << 63), at[k], at[k + n - 1]


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, spans): runs of lines, from first to last number, that repeat an earlier run of ``min_words`` words.

    Only the lines that winnowing selects are emitted, and those whose hash is selected twice or more go on. Around each of
    them the match is extended both ways: back to every line from which the anchor is still the least, and from there on
    line by line until the next window takes over. All of these, identified by the hash of their lines, are joined with the
    first position by (id, text hash, line) at which the same lines stand. So each match is taken as far as it agrees with
    any earlier position, whichever that is, and no pair of later positions is ever made: a passage in a third of all
    documents costs a few rows in each.

    A place that overlaps the first position of its own lines is no repeat of it: of a text of equal lines the first
    ``min_words`` words stay.
    """

    def select(batches):
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column(2))):
                part = batch.slice(lo, hi - lo)
                rows, size = [], 0
                for d, th, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2))):
                    for row in anchors(t, min_words):
                        rows.append((d, th, *row))
                        size += len(row[1]) + 8
                        if size > ENTRIES:  # short lines have many anchors with as many lines as a window has words
                            yield _anchor_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _anchor_batch(rows)

    def extend(batches):
        for batch in batches:
            lists = [batch.column(c) for c in ("lines", "at", "shortest", "longest")]
            cuts, flat = [x.offsets.to_numpy().tolist() for x in lists], [x.values.to_numpy() for x in lists]
            docs_, hashes = batch.column("doc").to_pylist(), batch.column("th").to_pylist()
            for lo in range(0, batch.num_rows, 500):
                rows = [(docs_[i], hashes[i], *r) for i in range(lo, min(lo + 500, batch.num_rows)) for r in runs_around(*[v[c[i] : c[i + 1]] for v, c in zip(flat, cuts)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc", "th", "run", "start", "end"])

    source = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.col(text))
    found = materialize(arrow_map(source, select, ANCHORS_DDL), "line-anchors")
    again = found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    runs = materialize(arrow_map(found.join(again, "fp", "left_semi").select("doc", "th", "lines", "at", "shortest", "longest"), extend, RUNS_DDL), "line-runs")
    heads = runs.groupBy("run").agg(F.min(F.struct("doc", "th", "start", "end")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    elsewhere = (F.col("doc") != F.col("head.doc")) | (F.col("th") != F.col("head.th")) | (F.col("start") > F.col("head.end"))
    return runs.join(heads, "run").where(elsewhere).groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "removed_lines", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, and ``removed``, the number of lines that went.

    The earliest copy of a run, by (id, line), always stays whole, in a text that repeats itself its first ``min_words``
    words. Empty lines inside a deleted run go with it; other lines are kept as they are. Null texts stay null, empty ones empty. Rows with a null id stay unchanged and are no sources. Rows
    that repeat an id with the same text are one document and lose the same lines; with other texts they are held apart by
    a hash of the text. With ``drop_emptied`` documents that lost all of their words are dropped. All other columns stay;
    a column of ``docs`` named like ``removed`` is replaced.
    """
    spans = materialize(repeated_lines(docs.select(F.col(id), F.col(text)), id, text, min_words), "line-spans")
    doc, th, found = fresh(docs, "__doc", "__th", "__spans")
    keyed = docs.drop(removed).withColumn(th, F.xxhash64(text)).withColumn(doc, F.col(id).cast("long"))
    keys = spans.select(F.col("doc").alias(doc), F.col("th").alias(th))
    some, clean = set_aside(keyed, [doc, th], keys)  # the others have no repeated run and stay where they are
    clean = clean.withColumn(removed, F.lit(0))
    both = some.join(spans.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("spans").alias(found)), [doc, th], "left")
    lines = F.split(F.col(text), "\n", -1)
    merged = F.aggregate(  # sorted spans become few that do not overlap
        found,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] + 1 >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    both = both.withColumn(found, F.when(F.col(found).isNotNull(), merged))
    left = F.filter(lines, lambda line, i: ~F.exists(found, lambda s: i.between(s["start"], s["end"])))
    gone = F.aggregate(found, F.lit(0), lambda n, s: n + s["end"] - s["start"] + 1)
    cut = both.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).withColumn(removed, F.coalesce(gone, F.lit(0)))
    if drop_emptied:
        cut = cut.where((F.col(removed) == 0) | F.col(text).rlike(r"\S"))
    names = [*[c for c in docs.columns if c != removed], removed]
    return clean.select(*names).unionByName(cut.select(*names))
