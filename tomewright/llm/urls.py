"""URL filters: host and path rules, and trust and distrust propagated over host links. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Share of a host's rank that its links pass on, and the most that later rounds may still add for each unit of seed.
DAMPING, TOLERANCE = 0.85, 0.001
#: Rounds after which no more than that is left: what they would add is below DAMPING ** (ROUNDS + 1) / (1 - DAMPING).
ROUNDS = math.ceil(math.log(TOLERANCE * (1 - DAMPING)) / math.log(DAMPING))
#: A host is blocked if its distrust is at least the first and more than the second times its trust. The unit is the
#: restart of a host whose pages are all blocked, or all allowed: what such a host has if nothing else reaches it.
LEAST_DISTRUST, RATIO = 0.5, 2.0
#: A link to another host: an href with a scheme or a double slash; its host is the group.
HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
#: Rounds between two written tables, so that no plan grows with the rounds.
CUT = 5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ranks(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust): personalised PageRank of the trusted seeds, and of the blocked ones on reversed links.

    ``seeds`` (host, trust, distrust) hold what each host starts with, ``edges`` (src, dst, n) how often hosts link. Each
    round a host passes ``DAMPING`` of what it got last to the hosts it links to, in proportion to the links; distrust goes
    to the hosts that link to it. The rank is the sum of all rounds, up to ``TOLERANCE``; it ends as soon as nothing moves.

    Each linked host is one row for trust and one for distrust, with what it got last and its sum so far. A move to itself
    carries the sum over, so a round reads the state once and is one join and one aggregate, on the same key. Both are
    written every ``CUT`` rounds, so no plan is longer than that; hosts without links never enter the rounds. Links are
    summed per pair of hosts before they are joined, and what arrives at a host is combined before the shuffle, so hubs
    stay small.
    """
    both = edges.select(F.lit(True).alias("good"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(edges.select(F.lit(False), "dst", "src", "n"))
    out = both.groupBy("good", "a").agg(F.sum("n").alias("all"))
    stay = both.select("good", "a").union(both.select("good", "b")).distinct().select("good", "a", F.col("a").alias("b"), F.lit(0.0).alias("p"), F.lit(1.0).alias("kept"))
    go = both.join(out, ["good", "a"]).select("good", "a", "b", (F.lit(DAMPING) * F.col("n") / F.col("all")).alias("p"), F.lit(0.0).alias("kept"))
    moves = materialize(go.union(stay), "host-moves")
    if moves.isEmpty():
        return seeds.select("host", "trust", "distrust").where("trust > 0 or distrust > 0")
    start = seeds.select(F.lit(True).alias("good"), F.col("host").alias("a"), F.col("trust").alias("r")).union(seeds.select(F.lit(False), "host", "distrust"))
    now = moves.where("kept > 0").select("good", "a").join(start.where("r > 0"), ["good", "a"]).select("good", "a", "r", F.col("r").alias("total"))
    for k in range(ROUNDS):
        moved = now.join(moves, ["good", "a"]).select("good", F.col("b").alias("a"), (F.col("r") * F.col("p")).alias("r"), (F.col("total") * F.col("kept")).alias("total"))
        now = moved.groupBy("good", "a").agg(F.sum("r").alias("r"), (F.sum("total") + F.sum("r")).alias("total"))
        if k % CUT == CUT - 1:
            now = materialize(now, "host-ranks")
            if now.where("r > 0").isEmpty():
                break
    total = lambda good: F.sum(F.when(F.col("good") == F.lit(good), F.col("total")).otherwise(0.0))
    linked = now.groupBy(F.col("a").alias("host")).agg(total(True).alias("t"), total(False).alias("d"))
    # what a linked host starts with is in its sum already; a linked host without a row in one of the two has nothing there
    found = seeds.join(linked, "host", "full").select("host", F.coalesce("t", "trust").alias("trust"), F.coalesce("d", "distrust").alias("distrust"))
    return found.where("trust > 0 or distrust > 0")


def judge_urls(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) per page: the longest rule's verdict, else the link graph's.

    A host's seeds are the shares of its pages that rules allow and block. Trust follows links, distrust follows them
    backwards; a host without a fitting rule is blocked if its distrust is at least ``LEAST_DISTRUST`` and more than
    ``RATIO`` times its trust, and allowed otherwise, also if nothing reaches it. The empty host is judged like a host.

    Trust and distrust are rounded to six places. Null urls, and urls without "://", have an empty host and path, no rule and verdict allow (unless seeds say
    otherwise); null pages have no links. Repeated rows come each. Hosts are compared after lower-casing A-Z. The html is
    read once, for links to other hosts. ``rules`` is a short list (it becomes part of the plan).
    """
    judged = pages.select(F.col(id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = judged.groupBy("host").agg(
        F.avg(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust")
    )
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    edges = materialize(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "host-edges")
    rank = ranks(seeds, edges)
    found = judged.join(rank, "host", "left").withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("trust", "distrust")})
    method = F.when((F.col("distrust") >= LEAST_DISTRUST) & (F.col("distrust") > RATIO * F.col("trust")), "block").otherwise("allow")
    return found.select(id, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "trust", "distrust")
