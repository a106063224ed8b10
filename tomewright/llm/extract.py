"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import dom
from .common import arrow_map, slices, text_lengths, texts_of

#: States of a node: boilerplate, part of the main text, or around both.
BOILER, CONTENT, AROUND = 0, 1, 2
STATES = 3
TAGS = dom.OTHER + 1
HINTS = len(dom.HINTS)
NUMBERS = 16


@dataclass
class Forest:
    """The nodes of a batch of pages: parents come before their children."""

    parent: np.ndarray
    group: np.ndarray
    features: np.ndarray
    levels: list[np.ndarray]  # nodes by depth, from the roots down


def parse(pages: list[str], marks: list[list[str]] | None = None):
    """A ``Forest`` and, per page, its blocks (node in the forest, text)."""
    parent, group, bits, page_of, blocks = [], [], [], [], []
    words, marks_of_text, linked, chars, where = [], [], [], [], []
    for k, html in enumerate(pages):
        page_marks: list[str] | None = [] if marks is not None else None
        up, g, b, found = dom.read(html, page_marks)
        if marks is not None:
            marks.append(["", *page_marks])
        base = len(parent)
        parent.extend(p + base if p >= 0 else -1 for p in up)
        group.extend(g)
        bits.extend(b)
        page_of.extend([k] * len(up))
        mine = []
        for node, text, links in found:
            clean = " ".join(text.split())
            if clean:
                mine.append((node + base, clean))
                where.append(node + base)
                words.append(clean.count(" ") + 1)
                marks_of_text.append(clean.count(".") + clean.count(",") + clean.count("?") + clean.count("!"))
                chars.append(len(text))
                linked.append(links)
        blocks.append(mine)
    up, n = np.array(parent, np.int64), len(parent)
    where = np.array(where, np.int64)
    own = np.stack([np.bincount(where, v, n) for v in (words, marks_of_text, chars, linked, np.ones(len(where)))], axis=1) if len(where) else np.zeros((n, 5))
    depth = np.zeros(n, np.int64)
    for i, p in enumerate(parent):  # parents come first
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    under = own.copy()
    for level in reversed(levels[1:]):
        np.add.at(under, up[level], under[level])
    page = np.array(page_of, np.int64)
    root = np.searchsorted(page, page)
    whole = np.maximum(under[root, 0], 1)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    before = (before - before[root]) / whole
    wide = np.array(bits, np.int64)
    log = lambda x: np.log1p(x) / 4
    numbers = np.stack([
        np.ones(n), log(own[:, 0]), own[:, 0] > 0, own[:, 0] > 10, own[:, 1] / np.maximum(own[:, 0], 1) * 5, own[:, 3] / np.maximum(own[:, 2], 1),
        log(under[:, 0]), under[:, 3] / np.maximum(under[:, 2], 1), under[:, 1] / np.maximum(under[:, 0], 1) * 5, under[:, 0] / whole, under[:, 0] / whole > 0.5,
        before, before + under[:, 0] / whole > 0.95, depth / 10, log(under[:, 4]), under[:, 0] == 0,
    ], axis=1).astype(np.float64)
    groups = np.array(group, np.int64)
    features = np.concatenate([numbers, np.eye(TAGS)[groups], (wide[:, None] >> np.arange(HINTS) & 1).astype(np.float64)], axis=1)
    return Forest(up, groups, features, levels), blocks


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class TreeModel:
    """Log potentials: of a node's state by its features, and of its parent's and its own state by its tag group."""

    unary: np.ndarray  # (features, states)
    pair: np.ndarray  # (tag groups, parent states, states)

    def marginals(self, forest: Forest, edges: bool = False):
        """Sum-product: messages go up from the leaves and down from the roots, one depth of all pages at a time."""
        score = forest.features @ self.unary
        up = score.copy()  # what a node and all below it say of its state
        sent = np.zeros_like(score)  # the message of a node to its parent
        for level in reversed(forest.levels[1:]):
            sent[level] = _lse(self.pair[forest.group[level]] + up[level][:, None, :], 2)
            np.add.at(up, forest.parent[level], sent[level])
        down = np.zeros_like(score)
        joint = np.zeros((len(score), STATES, STATES)) if edges else None
        for level in forest.levels[1:]:
            above = forest.parent[level]
            rest = up[above] + down[above] - sent[level]
            both = self.pair[forest.group[level]] + rest[:, :, None]
            down[level] = _lse(both, 1)
            if edges:
                both = both + up[level][:, None, :]
                both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
                joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        belief = up + down
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
        return (belief, joint) if edges else belief


def states_of(forest: Forest, marks: list[list[str]]) -> np.ndarray:
    """The state of each node from the marked roots of content and boilerplate."""
    flat = [m for page in marks for m in page]
    state = np.full(len(flat), BOILER)
    for i, p in enumerate(forest.parent.tolist()):
        inside = state[p] if p >= 0 else BOILER
        state[i] = {"content": CONTENT, "boiler": BOILER}.get(flat[i], inside)
    for level in reversed(forest.levels[1:]):
        has = level[(state[level] == CONTENT) | (state[level] == AROUND)]
        above = forest.parent[has]
        state[above[state[above] == BOILER]] = AROUND
    return state


def train(pages: list[str], rounds: int = 140, decay: float = 1e-3, rate: float = 0.08) -> TreeModel:
    """Maximum likelihood on labelled pages (``data-mark``), by gradients from exact marginals."""
    marks: list[list[str]] = []
    forest, _ = parse(pages, marks)
    state = states_of(forest, marks)
    n = len(state)
    truth = np.eye(STATES)[state]
    child = forest.parent >= 0
    counts = np.zeros((TAGS, STATES, STATES))
    np.add.at(counts, (forest.group[child], state[forest.parent[child]], state[child]), 1)
    theta = [np.zeros((forest.features.shape[1], STATES)), np.zeros((TAGS, STATES, STATES))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        belief, joint = TreeModel(*theta).marginals(forest, True)
        expected = np.zeros_like(counts)
        np.add.at(expected, forest.group[child], joint[child])
        slopes = [forest.features.T @ (truth - belief) / n - decay * theta[0], (counts - expected) / n - decay * theta[1]]
        for t, g, a, b in zip(theta, slopes, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            t += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return TreeModel(*theta)


def extract_texts(pages: list[str], model: TreeModel, threshold: float = 0.5) -> list[str]:
    """The blocks whose node is more likely content than ``threshold``, in page order, joined by spaces."""
    forest, blocks = parse(pages)
    sure = model.marginals(forest)[:, CONTENT] > threshold if len(forest.parent) else []
    return [" ".join(text for node, text in page if sure[node]) for page in blocks]


_DEFAULT: list[TreeModel] = []


def default_model() -> TreeModel:
    """The model trained on the sample pages, once per process."""
    if not _DEFAULT:
        from .samplepages import sample_pages

        _DEFAULT.append(train(sample_pages()))
    return _DEFAULT[0]


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text", model: TreeModel | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, instead of ``html``.

    Whole pages are read, however long. Null and empty pages, and pages without main text, have the empty text. Rows are
    independent: no shuffle, repeated rows come each, other columns pass through, and one named like ``text`` is replaced.
    """
    model = model or default_model()
    kept = [f for f in pages.schema.fields if f.name not in (html, text)]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(text_lengths(batch.column(len(kept))), 2_000_000):
                part = batch.slice(lo, hi - lo)
                texts = extract_texts([h.encode("utf-8", "replace").decode() for h in texts_of(part.column(len(kept)))], model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return arrow_map(pages.select(*[f.name for f in kept], html), run, schema)
