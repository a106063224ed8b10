"""Filter interaction audit: what each filter removes in every order, from a Gray-code walk over the subsets of filters."""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Parts whose rows are made at a time: each has (filters + 1)! / 2 of them or more.
PARTS = 64
MEASURES = ("n", "good", "toxic")
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT_DDL = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in NUMBERS)


def text_filters(text: str = "text") -> dict[str, Column]:
    """Whether a text (null: empty) fails: A few words, B few distinct words, C many capitals, D marks of markup or code."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.char_length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Sums over what survives each subset of filters, from sums (parts, masks, measures) by the mask of failed filters.

    The subsets are met in Gray-code order, so that one filter is switched on or off at a time. Each mask cell counts the
    active filters that it fails; when the count leaves or comes back to zero, the cell leaves or rejoins the running
    survivors. No subset is summed anew.
    """
    size = cells.shape[1]
    fails, active, alive = np.arange(size), np.zeros(size, np.int64), cells.sum(1)
    states = np.empty_like(cells)
    states[:, 0], state = alive, 0
    for k in range(1, size):
        bit = k & -k
        state ^= bit
        hit = (fails & bit) > 0
        if state & bit:
            alive = alive - cells[:, hit & (active == 0)].sum(1)
            active += hit
        else:
            active -= hit
            alive = alive + cells[:, hit & (active == 0)].sum(1)
        states[:, state] = alive
    return states


def step_table(states: np.ndarray, letters: str) -> tuple[list[str], list[int], np.ndarray]:
    """(orders, steps, numbers) with the ``NUMBERS`` of each part, order and step as differences of stored states."""
    n, full = len(letters), (1 << len(letters)) - 1
    orders = ["".join(p) for p in permutations(letters)]
    at = np.array([[letters.index(c) for c in o] for o in orders])
    after = np.cumsum(1 << at, axis=1).ravel()
    f = at.ravel()
    bit = 1 << f
    before = after - bit
    lost = states[:, before] - states[:, after]
    kept = states[:, :, 0]
    shapley = np.zeros((len(states), n), np.int64)
    for s in range(full + 1):
        size = bin(s).count("1")
        for k in range(n):
            if not s >> k & 1:  # orders in which just the filters of s stand before this one
                shapley[:, k] += math.factorial(size) * math.factorial(n - 1 - size) * (kept[:, s] - kept[:, s | 1 << k])
    failing = kept[:, :1] - kept[:, bit]
    numbers = np.stack([kept[:, after], lost[..., 0], failing - lost[..., 0], kept[:, full ^ bit] - kept[:, [full]], lost[..., 1], lost[..., 2], shapley[:, f]], -1)
    return [o for o in orders for _ in letters], list(range(1, n + 1)) * len(orders), numbers


def failure_cells(docs: DataFrame, filters: dict[str, Column], duplicate: str, labels: DataFrame, part: str, id: str, text: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, bit k for the k-th one.

    Texts stay where they are; what is shuffled of a document is its id, part, mask and the hash of its text. Equal texts of
    a part are combined before they meet, so that a text that very many documents share costs a row a task.
    """
    letters = [*filters, duplicate]
    masks = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())]
    bit = 1 << letters.index(duplicate)
    facts = docs.select(
        F.col(id).cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), reduce(add, masks, F.lit(0)).alias("mask")
    )
    facts = facts.groupBy("doc", "part", "digest", "mask").agg(F.count("*").alias("n")).withColumn("key", F.coalesce("doc", F.xxhash64("digest"))).withColumn("known", F.col("doc").isNotNull())
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    told = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("key")).agg(says("quality").alias("good"), says("toxic").alias("toxic")).withColumn("known", F.lit(True))
    rows = facts.join(told, ["key", "known"], "left")  # a null id has a key by its text, and no label
    weigh = lambda c: F.col("n") * F.coalesce(F.col(c), F.lit(0))
    rows = rows.select("doc", "part", "digest", "mask", "n", weigh("good").alias("good"), weigh("toxic").alias("toxic"))
    texts = rows.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in MEASURES],
        F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", *MEASURES))).alias("first"),
        F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    texts = materialize(texts, "audit-texts")
    shared = texts.groupBy("digest").agg(F.min("first.doc").alias("least"), F.count("*").alias("places")).where("places > 1").drop("places")
    met = texts.join(shared, "digest", "left")
    leads = F.coalesce(F.col("first.doc") == F.coalesce("least", "first.doc"), F.lit(False))
    fresh = {c: F.when(leads, F.col(f"first.{c}")).otherwise(F.lit(0)) for c in MEASURES}
    fresh["n"] = fresh["n"] + F.col("nameless")  # no text of a smaller id: there is none to compare with
    parts = F.array(
        F.struct("mask", *[fresh[c].alias(c) for c in MEASURES]),
        F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - fresh[c]).alias(c) for c in MEASURES]),
    )
    cells = met.select("part", F.explode(parts).alias("cell")).select("part", "cell.*")
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in MEASURES])


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, duplicate: str = "E", part: str = "source", id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order.

    ``filters`` names conditions on the columns of ``docs`` under which a row fails, by default ``text_filters``; null is no
    failure. ``duplicate`` names the last one: the text is identical (by SHA-256) to that of a smaller id anywhere in the
    table, whether that one is removed or not. The failures of a row don't depend on the order, so each part is the sums of
    2^filters cells; ``gray_walk`` stores what survives each subset of filters, and every order is differences of these.

    Parts: the values of ``part``, null and "" being one. Null texts are empty. A row with a null id has no label and is
    neither a duplicate nor the original of one. Rows that repeat an id count each; those of the smallest id of a text all
    pass the duplicate filter. Of several labels of an id any 1 counts; other labels and null ones count as none. An empty
    table gives no rows. Other columns are ignored.
    """
    filters = text_filters(text) if filters is None else filters
    letters = "".join([*filters, duplicate])
    if len(set(letters)) != len(filters) + 1 or len(letters) != len(filters) + 1:
        raise ValueError("filters are named by single letters, each by another one")
    cells = failure_cells(docs, filters, duplicate, labels, part, id, text)
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # at most 2^filters of them

    def walk(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                some = batch.slice(lo, PARTS).to_pylist()
                sums = np.zeros((len(some), 1 << len(letters), len(MEASURES)), np.int64)
                for i, row in enumerate(some):
                    for cell in row["cells"]:
                        sums[i, cell["mask"]] = [cell[c] for c in MEASURES]
                orders, steps, numbers = step_table(gray_walk(sums), letters)
                columns = [[r["part"] for r in some for _ in orders], orders * len(some), pa.array(steps * len(some), pa.int32()), *(pa.array(numbers[..., k].ravel()) for k in range(len(NUMBERS)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=["part", "filter_order", "step", *NUMBERS])

    return arrow_map(listed, walk, AUDIT_DDL)
