"""Quality classifier by co-training: a text view and a metadata view teach each other, and score together."""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize, slices, text_lengths, texts_of

#: Labelled rows that calibrate the views: of those held out, the ones with the smallest id hashes, this many at most.
CHECKED = 6000
#: Tenths of the labelled rows that are held out for it.
HELD = 3
#: Buckets of hashed words, and of hashed values of each metadata column.
WORDS, VALUES = 1 << 13, 64
#: Rounds of exchange, and the share of all rows without a label, the surest ones, that a view passes on for each class in
#: the first round; twice as much in the second, and so on.
ROUNDS, SHARE = 3, 0.05
#: What is added to the variances within classes, as a share of them, for a direction that holds with few labels too.
SHRINK = 0.1
#: Log odds are ranked in steps of this many to one, up to ``MOST``.
STEPS, MOST = 64, 40.0
#: Fraction bits with which sums are carried between tasks: whole numbers add up to the same in any order.
FRACTION_BITS = 24

#: Classes of bytes whose shares describe a text; symbols that mark junk stand alone.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"?", b"|", b"%", b"&", b"$", b"#", b"*", b"@", b"_", b"<>", b"{}[]()", b"=+~^\\/", b"'\"", b":;-", bytes(range(128, 256)))
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c), _k] = 1
DENSE = 2 * len(CLASSES) + 13


class _Buckets(dict):
    """Words and their buckets, as many as fit; a word that is missing is hashed."""

    def __missing__(self, word: bytes) -> int:
        at = xxhash.xxh64_intdigest(word.strip(b".,!?;:\"'"), 3) % WORDS
        if len(self) < 200_000 and len(word) < 40:
            self[word] = at
        return at


_BUCKETS = _Buckets()


def text_view(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers that describe a whole text, and the buckets of its words; None if it has no word."""
    raw = text.encode("utf-8", "replace")
    words = raw.lower().split()
    n = len(words)
    if not n:
        return None
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)
    kinds = set(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = [x for x in raw.split(b".") if x.strip()]
    size = np.log1p(n)
    rest = (
        1.0, size / 5, len(kinds) / n, len(kinds) / n * size / 5, pairs / max(1, n - 1), len(set(lines)) / len(lines), len(set(sentences)) / max(1, len(sentences)),
        min(len(raw) / n, 30) / 10, np.log1p(n / len(lines)) / 5, np.log1p(n / max(1, len(sentences))) / 5, max(map(len, kinds)) > 40, n < 5, min(1.0, 3 * sum(map(eq, words, words[1:])) / n),
    )
    return np.concatenate([share, np.minimum(share * 40, 1), rest]), np.unique(np.fromiter(map(_BUCKETS.__getitem__, kinds), np.int32, len(kinds)))


def meta_view(values: tuple, size: int | None) -> np.ndarray:
    """Buckets of the metadata: one for each column's value, one for the size's order of magnitude."""
    found = [k * VALUES + xxhash.xxh64_intdigest(str(v), 5) % VALUES for k, v in enumerate(values)]
    return np.array([*found, len(values) * VALUES + (0 if size is None else 1 + min(60, int(4 * np.log10(max(size, 0) + 1))))], np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -MOST, MOST)))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """A few numbers to log odds, the last weight being the intercept, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = decay * len(x) * np.diag([*[1.0] * (len(w) - 1), 1e-3])
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Batch:
    """The views of some rows: numbers of the text, buckets of its words and of the metadata, the latter two as (row, bucket)."""

    dense: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    meta: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, dense: np.ndarray, words: list[np.ndarray], meta: list[np.ndarray]) -> Batch:
        flat = lambda lists: (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64))
        return cls(dense.reshape(-1, DENSE).astype(np.float64), flat(words), flat(meta))

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Batch:
        def lists(name, kind):
            texts = batch.column(name).to_pylist()
            return np.repeat(np.arange(len(texts)), [len(t) // 2 for t in texts]), np.frombuffer(b"".join(texts), kind).astype(np.int64)

        return cls(np.frombuffer(b"".join(batch.column("dense").to_pylist()), np.float32).astype(np.float64).reshape(-1, DENSE), lists("words", np.uint16), lists("meta", np.uint16))


def mean_ratio(buckets: tuple[np.ndarray, np.ndarray], ratios: np.ndarray, n: int) -> np.ndarray:
    """Per row the sum of its buckets' log ratios over the root of how many it has."""
    rows, at = buckets
    return np.bincount(rows, ratios[at], n) / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))


class Sums:
    """What both views learn from: weights, sums, products and bucket counts of each class. Sums of parts are those of the whole."""

    def __init__(self, columns: int):
        self.parts = [{"n": np.zeros(1), "x": np.zeros(DENSE), "xx": np.zeros((DENSE, DENSE)), "words": np.zeros(WORDS), "m": np.zeros(1), "meta": np.zeros((columns + 1) * VALUES)} for _ in range(2)]

    def add(self, b: Batch, text: np.ndarray, meta: np.ndarray) -> None:
        """``text`` and ``meta``: the weight of each row for each class in the training set of that view."""
        for c, p in enumerate(self.parts):
            w, v = text[:, c], meta[:, c]
            p["n"] += w.sum()
            p["x"] += w @ b.dense
            p["xx"] += (b.dense * w[:, None]).T @ b.dense
            p["words"] += np.bincount(b.words[1], w[b.words[0]], WORDS)
            p["m"] += v.sum()
            p["meta"] += np.bincount(b.meta[1], v[b.meta[0]], len(p["meta"]))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for p in self.parts for v in p.values()])

    def load(self, flat: np.ndarray) -> Sums:
        at = 0
        for p in self.parts:
            for k, v in p.items():
                p[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
        return self


def bucket_ratios(no: np.ndarray, yes: np.ndarray, n_no: float, n_yes: float, smooth: float = 2.0) -> np.ndarray:
    """Log ratio of the rates at which the classes have each bucket, drawn to the common rate where there is little to see."""
    common = (no + yes) / max(n_no + n_yes, 1e-9)
    rate = lambda count, n: (count + smooth * common) / (n + smooth)
    return np.where(common > 0, np.log((rate(yes, n_yes) + 1e-12) / (rate(no, n_no) + 1e-12)), 0.0)


@dataclass
class CoModel:
    """Both views, the calibration of each to log odds, the weights that join them, and how much they passed on."""

    direction: np.ndarray
    words: np.ndarray
    meta: np.ndarray
    text_odds: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    meta_odds: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    joint: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    #: Per round (text view's rows of class 0 and 1, metadata view's of class 0 and 1).
    passed: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def learn(cls, sums: Sums) -> CoModel:
        """The text view: the direction that separates the class means best for the spread within classes, and the words'
        ratios; the metadata view: the ratios of its buckets."""
        no, yes = sums.parts
        means = [p["x"] / max(p["n"][0], 1e-9) for p in (no, yes)]
        spread = sum(p["xx"] - p["n"][0] * np.outer(m, m) for p, m in zip((no, yes), means)) / max(no["n"][0] + yes["n"][0], 1e-9)
        direction = np.linalg.solve(spread + SHRINK * np.diag(np.diag(spread) + 1e-6) + 1e-7 * np.eye(DENSE), means[1] - means[0])
        return cls(
            np.r_[direction, -direction @ (means[0] + means[1]) / 2], bucket_ratios(no["words"], yes["words"], no["n"][0], yes["n"][0]),
            bucket_ratios(no["meta"], yes["meta"], no["m"][0], yes["m"][0]),
        )

    def raw(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        n = len(b.dense)
        return np.c_[b.dense @ self.direction[:-1] + self.direction[-1], mean_ratio(b.words, self.words, n)], mean_ratio(b.meta, self.meta, n)[:, None]

    def calibrate(self, b: Batch, y: np.ndarray) -> CoModel:
        text, meta = self.raw(b)
        self.text_odds, self.meta_odds = fit_logistic(text, y), fit_logistic(meta, y)
        self.joint = fit_logistic(np.stack(self.odds(b), 1), y)
        return self

    def odds(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of the text view and of the metadata view."""
        text, meta = self.raw(b)
        return np.clip(np.c_[text, np.ones(len(text))] @ self.text_odds, -MOST, MOST), np.clip(np.c_[meta, np.ones(len(meta))] @ self.meta_odds, -MOST, MOST)

    def score(self, texts: list[str], metas: list[tuple], sizes: list) -> np.ndarray:
        """The probability of good quality; 0 for a text without a word."""
        views = [text_view(t) for t in texts]
        none = np.empty(0, np.int32)
        b = Batch.of(np.array([np.zeros(DENSE) if v is None else v[0] for v in views], np.float32), [none if v is None else v[1] for v in views], [meta_view(m, s) for m, s in zip(metas, sizes)])
        return np.where([v is None for v in views], 0.0, _sigmoid(np.c_[np.stack(self.odds(b), 1), np.ones(len(texts))] @ self.joint))


def passes_on(odds: np.ndarray, cuts: tuple[int, int]) -> np.ndarray:
    """Rows whose log odds are among the surest of either class, by the steps that bound them."""
    step = np.floor(odds * STEPS)
    return (step <= cuts[0]) | (step >= cuts[1])


def training_weights(model: CoModel | None, b: Batch, y: np.ndarray, held: np.ndarray, cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of each row for (text view, metadata view), and what was passed on: see ``CoModel.passed``.

    A labelled row that is not held out counts for its own class in both. A row without a label that a view is among the
    surest of counts in the other one, for each class by the probability that the first view gives it.
    """
    text = np.stack([(y == c) & ~held for c in (0, 1)], 1).astype(np.float64)
    meta, passed = text.copy(), np.zeros(4)
    if model is not None:
        for k, (odds, to) in enumerate(zip(model.odds(b), (meta, text))):
            sure = (y < 0) & passes_on(odds, cuts[k])
            p = _sigmoid(odds[sure])
            to[sure] = np.stack([1 - p, p], 1)
            passed[2 * k : 2 * k + 2] = (np.floor(odds[sure] * STEPS) <= cuts[k][0]).sum(), (np.floor(odds[sure] * STEPS) >= cuts[k][1]).sum()
    return text, meta, passed


def cuts_of(steps: dict[int, int], share: float) -> tuple[int, int]:
    """The steps up to which, and from which, at least ``share`` of the rows lie; rows of one step stay together."""
    at = np.array(sorted(steps), np.int64)
    n = np.array([steps[k] for k in at.tolist()], np.int64)
    want, up = share * n.sum(), np.cumsum(n)
    return int(at[np.searchsorted(up, want)]), int(at[len(at) - 1 - np.searchsorted(np.cumsum(n[::-1]), want)])


def _views(docs: DataFrame, labels: DataFrame, id: str, text: str, meta: tuple[str, ...], size: str, label: str) -> DataFrame:
    """The views of each document that has a word, packed as bytes, with its label and whether it is held out.

    Null ids have no label. Labels grow with the documents, so the join is by a shuffle at every size, never a broadcast.
    """
    marked = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).cast("long").alias("id")).agg(F.min(label).cast("int").alias("y"))

    def run(batches):
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column("text"))):
                part = batch.slice(lo, hi - lo)
                found = [text_view(t) for t in texts_of(part.column("text"))]
                metas = [meta_view(m, s) for m, s in zip(zip(*[part.column(f"m{k}").to_pylist() for k in range(len(meta))]), part.column("size").to_pylist())]
                some = [k for k, v in enumerate(found) if v is not None]
                packed = [[x.astype(kind).tobytes() for x in column] for kind, column in ((np.float32, [found[k][0] for k in some]), (np.uint16, [found[k][1] for k in some]), (np.uint16, [metas[k] for k in some]))]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(some, pa.int64())), *(pa.array(column, pa.binary()) for column in packed)], names=["id", "dense", "words", "meta"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *[F.col(m).cast("string").alias(f"m{k}") for k, m in enumerate(meta)], F.col(size).cast("long").alias("size"))
    views = arrow_map(source, run, "id long, dense binary, words binary, meta binary")
    h = F.xxhash64("id", F.lit(8))
    known = views.join(marked.hint("merge"), "id", "left").select(h.alias("h"), F.coalesce("y", F.lit(-1)).alias("y"), (F.col("y").isNotNull() & (F.pmod(h, F.lit(10)) < HELD)).alias("held"), "dense", "words", "meta")
    return materialize(known, "quality-views")


def _sums(views: DataFrame, columns: int, model: CoModel | None, cuts) -> tuple[Sums, tuple[int, ...]]:
    """The sums of both training sets, added up by Spark; the driver gets as many numbers as a model has."""
    size = len(Sums(columns).flat())

    def run(batches):
        sums, passed = Sums(columns), np.zeros(4)
        for batch in batches:
            b = Batch.read(batch)
            text, meta, n = training_weights(model, b, batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), cuts)
            sums.add(b, text, meta)
            passed += n
        whole = np.rint(np.r_[sums.flat(), passed] * (1 << FRACTION_BITS)).astype(np.int64)
        at = np.flatnonzero(whole)
        for lo in range(0, len(at), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 2000].astype(np.int32)), pa.array(whole[at[lo : lo + 2000]])], names=["k", "v"])

    got = arrow_map(views.select("y", "held", "dense", "words", "meta"), run, "k int, v long").groupBy("k").agg((F.sum(F.col("v").cast("decimal(38,0)")).cast("double")).alias("v")).toArrow()
    flat = np.zeros(size + 4)
    flat[got.column("k").to_numpy()] = got.column("v").to_numpy() / (1 << FRACTION_BITS)
    return Sums(columns).load(flat[:size]), tuple(int(x) for x in flat[size:])


def _cuts(views: DataFrame, model: CoModel, share: float):
    """For each view the steps of log odds that bound its surest rows without a label, counted over all of them; None without any."""

    def run(batches):
        for batch in batches:
            for k, odds in enumerate(model.odds(Batch.read(batch))):
                step, n = np.unique(np.floor(odds * STEPS).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(step), k, np.int32)), pa.array(step), pa.array(n.astype(np.int64))], names=["view", "step", "n"])

    got = arrow_map(views.where("y < 0").select("dense", "words", "meta"), run, "view int, step int, n long").groupBy("view", "step").agg(F.sum("n").alias("n")).collect()
    steps = [{r["step"]: r["n"] for r in got if r["view"] == k} for k in (0, 1)]
    return [cuts_of(s, share) for s in steps] if all(steps) else None


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang", "source"), size: str = "n_chars", label: str = "quality", checked: int = CHECKED) -> CoModel | None:
    """Co-train on all documents: every label that is not held out, and in each round the surest rows without one.

    The views of each document are made once, and written. A round is two passes over them: the first counts the log odds of
    all rows without a label, for the cuts; the second adds up, over all rows, the sums that the two views learn from, each
    from the labels and from what the other view passed on. Only numbers in the size of a model, and the views of
    ``checked`` held out rows for the calibration, come to the driver; nothing else is bounded or left out.

    Labels that are null or neither 0 nor 1 do not count; of a label table that repeats an id the smallest counts. If the
    rows held out lack a class, none are held out. None if the documents have no labels of both classes: then there is
    nothing to learn from. Documents without a word are not learned from.
    """
    views = _views(docs, labels, id, text, meta, size, label)
    sample = lambda rows: rows.orderBy("h", "y").limit(checked).toArrow().combine_chunks()
    check = sample(views.where("held"))
    if len(set(check.column("y").to_pylist())) < 2:
        views = views.withColumn("held", F.lit(False))
        check = sample(views.where("y >= 0"))
        if len(set(check.column("y").to_pylist())) < 2:
            return None
    batch = check.to_batches()[0]
    b, y = Batch.read(batch), batch.column("y").to_numpy().astype(np.float64)
    model, cuts, passed = None, None, []
    for round_ in range(ROUNDS + 1):
        sums, n = _sums(views, len(meta), model, cuts)
        passed += [n] if model is not None else []
        model = CoModel.learn(sums).calibrate(b, y)
        cuts = _cuts(views, model, SHARE * (round_ + 1)) if round_ < ROUNDS else None
        if cuts is None:
            break
    model.passed = passed
    return model


def score_quality(docs: DataFrame, model: CoModel | None, text: str = "text", meta: tuple[str, ...] = ("lang", "source"), size: str = "n_chars", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the probability of good quality.

    Every whole text is scored on its own: no shuffle, repeated rows come each with the same score, nulls in metadata are
    a value like others, null and empty texts score 0, other columns pass through, and one named like ``score`` is
    replaced. Without a model all scores are null.
    """
    if model is None:
        return docs.drop(score).withColumn(score, F.lit(None).cast("double"))
    fields = [f for f in docs.schema.fields if f.name != score]
    schema = T.StructType([*fields, T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column(text))):
                part = batch.slice(lo, hi - lo)
                p = model.score(texts_of(part.column(text)), list(zip(*[part.column(m).to_pylist() for m in meta])), part.column(size).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=schema.names)

    return arrow_map(docs.select(*[f.name for f in fields]), run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **columns) -> DataFrame:
    """Fit on ``labels`` and score all of ``docs``: columns score, and keep where the score is ``threshold`` or more.

    Where nothing can be learned, for want of labels of both classes, nothing is rejected. Columns of ``docs`` with these
    two names are replaced.
    """
    model = fit(docs, labels, **columns)
    own = {k: v for k, v in columns.items() if k in ("text", "meta", "size")}
    return score_quality(docs, model, **own).withColumn("keep", F.coalesce(F.col("score") >= threshold, F.lit(True)))
