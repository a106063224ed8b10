"""What readers are shown: impressions from sampled reviews, cleaned notes, and the fold of a disclosure's actions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..constants import MAX_BULLETS, MAX_TRAITS, TRAIT_CONFIDENCE
from ..functions.dates import display_date
from ..functions.text import blank_to_null, sentence_label, trim
from ..functions.urls import safe_url

# Patterns.
NARRATION = r"(?i)narrat|audio|voice|performance|listen|pacing of the read"
LISTENING = r"(?i)listen|audiobook|audio|narrat"
TO_DO = r"(?i)\b(?:needs review|needs confirmation|awaiting review|to be reviewed)\b"


def bullets(texts: Column, cap: int = MAX_BULLETS) -> Column:
    """Different non-empty texts, trimmed, in the order first seen, ``cap`` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), trim), lambda t: t.isNotNull() & (t != ""))), 1, cap)


def top_traits(traits: Column, cap: int = MAX_TRAITS) -> Column:
    """The surest traits that say something; a claim on narration needs a summary that mentions listening."""
    t = F.filter(
        F.coalesce(traits, F.array().cast("array<struct<trait:string,value:string,confidence:double,summary:string>>")),
        lambda x: F.coalesce(
            (x["confidence"] >= TRAIT_CONFIDENCE) & ~F.isnan(x["confidence"]) & (x["confidence"] < float("inf")) & (trim(x["value"]) != "") & (F.lower(trim(x["value"])) != "unknown")
            & (~x["trait"].rlike(NARRATION) | F.coalesce(x["summary"].rlike(LISTENING), F.lit(False))), F.lit(False),
        ),
    )
    ordered = F.array_sort(t, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["trait"] < b["trait"], -1).when(a["trait"] > b["trait"], 1).otherwise(0))
    return F.transform(F.slice(ordered, 1, cap), lambda x: F.struct(x["trait"].alias("trait"), sentence_label(x["trait"]).alias("label"), trim(x["value"]).alias("value"), F.coalesce(trim(x["summary"]), F.lit("")).alias("summary")))


def impressions(context: Column) -> Column:
    """What may be shown of a reader context, or null: approved bullets, else the observation, else single traits."""
    sampled = F.greatest(F.lit(0), context["substantiveVoices"].cast("int"))
    said = blank_to_null(context["observation"])
    good, bad = bullets(context["impressions"]), bullets(context["critiques"])
    split = (F.size(good) > 0) | (F.size(bad) > 0)
    shown = F.when(said.isNotNull() | split, F.array().cast("array<struct<trait:string,label:string,value:string,summary:string>>")).otherwise(top_traits(context["traits"]))
    span = F.when((F.size(context["span"]) == 2) & ~F.exists(context["span"], lambda d: d.isNull()), F.concat(display_date(context["span"][0], "MMM yyyy"), F.lit(" – "), display_date(context["span"][1], "MMM yyyy")))
    sources = F.transform(F.filter(F.coalesce(context["sources"], F.array().cast("array<struct<name:string,url:string>>")), lambda s: F.coalesce(trim(s["name"]) != "", F.lit(False)) & safe_url(s["url"])), lambda s: F.struct(trim(s["name"]).alias("name"), s["url"].alias("url")))
    consensus = F.when(context["consensus"].isin("consistent", "mixed", "insufficient"), context["consensus"])
    view = F.struct(sampled.alias("sampled"), span.alias("span"), consensus.alias("consensus"), F.when(~split, said).alias("observation"), good.alias("impressions"), bad.alias("critiques"), shown.alias("traits"), sources.alias("sources"))
    return F.when(F.coalesce((sampled >= 1) & (said.isNotNull() | split | (F.size(shown) > 0)), F.lit(False)), view)


def reader_note(note: Column, tools: tuple[str, ...]) -> Column:
    """A note without a leading clause that names internal tooling; null if a tool's name is left or nothing is."""
    named = rf"(?i)\b(?:{'|'.join(map(re.escape, tools))})\b"
    text = trim(note)
    lead = F.regexp_extract(text, r"^[^.!?;]*[.!?;](?:\s+|\z)", 0)
    rest = trim(F.substring(text, F.length(lead) + 1, F.length(text)))
    cut = F.when((lead != "") & lead.rlike(named), F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, 2, 1 << 30))).otherwise(text)
    return F.when((cut != "") & ~cut.rlike(named), cut)


def reader_issues(issues: Column, tools: tuple[str, ...]) -> Column:
    """Different issues that describe the listing; work still to do and tooling are left out."""
    named = rf"(?i)\b(?:{'|'.join(map(re.escape, tools))})\b"
    return F.filter(bullets(issues, 1 << 30), lambda t: ~t.rlike(TO_DO) & ~t.rlike(named))


STATE = ("hovering", "focused", "pinned", "dismissed", "pressed")


def is_open(s: Column) -> Column:
    return ~s["dismissed"] & (s["pinned"] | s["hovering"] | s["focused"])


#: The actions on a disclosure.
ACTIONS = ("hover-in", "hover-out", "focus-in", "focus-out", "press", "click", "escape")


def next_state(s: Column, a: Column) -> Column:
    """The state of a disclosure after one action; an unknown one changes nothing."""

    def made(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, s[k]).alias(k) for k in STATE])

    def settled(s: Column) -> Column:
        stay = s["hovering"] | s["focused"]
        return made(s, pinned=s["pinned"] & stay, dismissed=s["dismissed"] & stay)

    def toggled(s: Column, pressed: Column) -> Column:
        return made(s, pinned=~is_open(s), dismissed=is_open(s), pressed=pressed)

    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(a == "hover-in", made(s, hovering=yes)).when(a == "hover-out", settled(made(s, hovering=no))).when(a == "focus-in", made(s, focused=yes))
        .when(a == "focus-out", settled(made(s, focused=no))).when(a == "press", toggled(s, yes)).when((a == "click") & s["pressed"], made(s, pressed=no))
        .when(a == "click", toggled(s, s["pressed"])).when((a == "escape") & is_open(s), made(s, pinned=no, dismissed=yes)).otherwise(s)
    )


def closed() -> Column:
    return F.struct(*[F.lit(False).alias(k) for k in STATE])


def fold_actions(actions: Column) -> Column:
    """The state of a disclosure after an ordered list of actions, from closed."""
    return F.aggregate(actions, closed(), next_state)


def state_of(number: Column) -> Column:
    """A state from its number: bit k is the k-th name of ``STATE``."""
    return F.struct(*[(F.call_function("shiftright", number, F.lit(k)).bitwiseAND(F.lit(1)) == 1).alias(name) for k, name in enumerate(STATE)])


def moves(spark: SparkSession) -> np.ndarray:
    """For each action and state number the number of the next state, in the order of ``ACTIONS``; the last row stays put."""
    states = spark.range(1 << len(STATE)).select(F.col("id").cast("int").alias("id")).withColumn("s", state_of(F.col("id")))
    number = lambda s: sum(s[name].cast("int") * (1 << k) for k, name in enumerate(STATE))
    rows = states.select("id", *[number(next_state(F.col("s"), F.lit(a))).alias(f"m{k}") for k, a in enumerate(ACTIONS)]).orderBy("id").collect()  # 32 rows
    return np.array([*[[r[f"m{k}"] for r in rows] for k in range(len(ACTIONS))], range(1 << len(STATE))], np.int8)


def fold_histories(rows: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """(key, the fields of the state): what ``fold_actions`` makes of each key's actions in ``order``, however many there are.

    An action is a map of the 32 states to themselves, and maps compose associatively: a history is cut wherever a range
    partition ends, each piece becomes one map, and the pieces of a key, one a task at most, are composed at the end. So a key with
    very many actions spreads over tasks and is never in one row. Of equal orders the action's name decides. A null key is a
    key; null and unknown actions change nothing.
    """
    table = moves(rows.sparkSession)
    code = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col(action)), F.lit(0)).cast("int") - 1

    def pieces(batches):
        task, number, held, at = TaskContext.get().partitionId(), 0, None, None
        out: list[tuple] = []
        for batch in batches:
            keys, codes = batch.column(0), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)) + 1).tolist(), len(keys)] if len(keys) else []
            for lo, hi in zip(cuts, cuts[1:]):
                name = keys[lo].as_py()
                if at is not None and at != (name,):
                    out.append((*at, task, number, held.tobytes()))
                    number, held = number + 1, None
                at = (name,)
                now = table[-1] if held is None else held
                for c in codes[lo:hi].tolist():
                    now = table[c][now]
                held = now
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
                out = []
        if at is not None:
            out.append((*at, task, number, held.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    kind = rows.schema[key].dataType
    kinds = pa.schema([("key", to_arrow_type(kind)), ("task", pa.int32()), ("piece", pa.int64()), ("map", pa.binary())])
    dealt = rows.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(action).alias("name"), code.alias("code"))
    by = ["key", *[f"o{k}" for k in range(len(order))], "name"]
    cut = dealt.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "code").mapInArrow(pieces, f"key {kind.simpleString()}, task int, piece long, map binary")
    maps = cut.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("task", "piece", "map"))), lambda x: x["map"]).alias("maps"))
    at = lambda m, s: F.conv(F.hex(F.substring(m, s + 1, F.lit(1))), 16, 10).cast("int")
    return maps.select(F.col("key").alias(key), state_of(F.aggregate("maps", F.lit(0), lambda s, m: at(m, s))).alias("s")).select(key, "s.*")
