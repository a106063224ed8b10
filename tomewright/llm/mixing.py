"""Mixing sources to target weights: hierarchical budgets, and token prefixes of seeded epochs. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Hexadecimal digits of the order key that make up a bucket; an epoch's prefix is found in sums of buckets first.
BUCKET_DIGITS = 3
WHOLE = "decimal(38,0)"


def estimated_tokens(text: str = "text") -> Column:
    """Four bytes a token, one at least; null and empty texts have none."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, int], budget: Column | int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with ``budget``, the tokens that each leaf is to give.

    A node's weight is ``weights["a/b/c"]`` of its path, 1 if not named; a weight of 0 takes a node out. A node can give
    ``max_epochs`` times its tokens. From the root down, each node's budget is poured over its children by weight: a child
    that its share would exceed gives all it can, and what it lacks is dealt to its siblings by their weights. A parent's
    budget has gone through the same among its own siblings before, so a shortage leaves a family only when the whole
    family is used up. Shares are whole numbers, rounded down.
    """
    pairs = [F.lit(x) for item in sorted(weights.items()) for x in item]
    weight = lambda depth: F.coalesce(F.create_map(*pairs)[F.concat_ws("/", *levels[:depth])], F.lit(1)) if pairs else F.lit(1)
    alive = leaves.where(F.col("tokens") > 0).withColumn("__root", F.lit(0))
    for depth in range(1, len(levels) + 1):
        alive = alive.where(weight(depth) > 0)
    nodes = alive.groupBy("__root").agg(F.least(F.lit(budget) if isinstance(budget, int) else budget, F.sum("tokens") * max_epochs).cast(WHOLE).alias("budget"))
    for depth in range(1, len(levels) + 1):
        up, here = ["__root", *levels[: depth - 1]], ["__root", *levels[:depth]]
        kids = alive.groupBy(*here).agg((F.sum("tokens") * max_epochs).cast(WHOLE).alias("most")).withColumn("w", weight(depth).cast(WHOLE)).join(nodes, up)
        # the fewer tokens for its weight, the sooner a child is used up: those that give all are a prefix of this order
        order = Window.partitionBy(*up).orderBy(F.col("most").cast("double") / F.col("w").cast("double"), *here)
        before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(WHOLE)
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(WHOLE)
        kids = kids.withColumn("full", F.col("most") * rest <= (F.col("budget") - before) * F.col("w"))
        family = Window.partitionBy(*up)
        given = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(family).cast(WHOLE)
        open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family).cast(WHOLE)
        kids = kids.withColumn("left_over", (F.col("budget") - given).cast(WHOLE)).withColumn("open_w", open_w)
        nodes = kids.select(*here, F.when(F.col("full"), F.col("most")).otherwise(F.expr("cast(left_over * w div open_w as decimal(38,0))")).cast(WHOLE).alias("budget"))
    return alive.join(nodes, ["__root", *levels]).select(*levels, "tokens", F.col("budget").cast("long").alias("budget"))


def mix(docs: DataFrame, levels: dict[str, str], weights: dict[str, int], fraction: float, id: str = "doc_id", tokens: Column | None = None, seed: int = 0, max_epochs: int = 1) -> DataFrame:
    """(id, levels, tokens, epoch) for each document and epoch chosen, ``fraction`` of all tokens being asked for.

    ``levels`` name the tree from the root down, e.g. domain, language, source, each with its SQL expression. A leaf whose budget covers its tokens
    several times gives all of its documents in the first epochs and, in the last one, the prefix that fits: documents are
    ordered by the MD5 of seed, epoch and id (then id), and taken while their running sum is within the budget, so a
    prefix never overshoots. Sums of buckets of that order come first, and only the bucket in which the budget ends is
    sorted: a leaf with a third of all rows is never one task.

    Null levels are the level "". Documents without tokens and null ids take no part. Rows that repeat an id count and come
    each. A leaf of weight 0 and an empty table give nothing. The result has only the columns named.
    """
    count = tokens if tokens is not None else estimated_tokens()
    names = list(levels)
    rows = docs.select(F.col(id), *[F.coalesce(F.expr(c).cast("string"), F.lit("")).alias(n) for n, c in levels.items()], count.cast("long").alias("tokens"))
    rows = materialize(rows.where((F.col("tokens") > 0) & F.col(id).isNotNull()), "mix")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, names, weights, F.floor(F.sum("tokens") * F.lit(fraction)), max_epochs).withColumnRenamed("tokens", "leaf_tokens")
    plan = plan.withColumn("whole", F.expr("cast(budget div leaf_tokens as int)")).withColumn("part", F.col("budget") - F.col("whole") * F.col("leaf_tokens"))
    plan = materialize(plan.where("budget > 0"), "mix-plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col(id).cast("string")).cast("binary"))
    keyed = rows.join(plan, names).withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    out = [*[F.col(c) for c in (id, *names, "tokens")]]
    full = keyed.where("whole > 0").select(*out, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    sums = keyed.where("part > 0").groupBy(*names, "bucket", "part").agg(F.sum("tokens").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).where(F.col("before") < F.col("part")).select(*names, "bucket", "before", (F.col("before") + F.col("in_bucket") <= F.col("part")).alias("all_in"))
    met = keyed.where("part > 0").join(sums, [*names, "bucket"])
    inside = met.where("all_in").select(*out, F.col("whole").alias("epoch"))
    running = F.sum("tokens").over(Window.partitionBy(*names, "bucket").orderBy("key", id).rowsBetween(Window.unboundedPreceding, 0))
    edge = met.where("not all_in").withColumn("upto", F.col("before") + running).where("upto <= part").select(*out, F.col("whole").alias("epoch"))
    return full.union(inside).union(edge)
