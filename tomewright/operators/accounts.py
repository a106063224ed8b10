"""Account tables: point reads, upserts, insert-or-ignore, expiry, consume-once, compare-and-set by revision."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PUBLIC_NAMES


def live_sessions(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Sessions that have not expired, with their user."""
    return sessions.where(F.col("expires_at") > now).join(users, sessions.user_id == users.id).select("token_hash", "expires_at", *[users[c] for c in users.columns])


def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """``table`` with ``rows``: a known key gets the columns ``update``, a new one the whole row. The last row of a key wins."""
    new = rows.groupBy(*key).agg(F.last(F.struct(*[c for c in rows.columns if c not in key])).alias("__n")) if "seq" not in rows.columns else rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*key, "seq")]), "seq").alias("__n"))
    old = table.select(*key, F.struct(*[c for c in table.columns if c not in key]).alias("__o"))
    met = old.join(new, key, "full")
    value = lambda c: F.when(F.col("__o").isNull(), F.col(f"__n.{c}")).when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(f"__o.{c}")) if c in update else F.when(F.col("__o").isNull(), F.col(f"__n.{c}")).otherwise(F.col(f"__o.{c}"))
    return met.select(*[F.col(c) if c in key else value(c).alias(c) for c in table.columns])


def update_columns(table: DataFrame, changes: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``table`` with the ``columns`` of each known key's last change in ``order``; unknown keys add no row."""
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__n"))
    met = table.join(last, key, "left")
    return met.select(*[F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def update_consent(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users (id, .., birth_date, birth_attested_at, allow_adult) after consent changes of the same columns and ``seq``."""
    return update_columns(users, changes, ["id"], ["seq"], ["birth_date", "birth_attested_at", "allow_adult"])


def account_violations(users: DataFrame, sessions: DataFrame, states: DataFrame, libraries: DataFrame) -> DataFrame:
    """(subject, id, reason) for each row that the account tables must not hold: keys that repeat or are null, columns
    without a value, rows of unknown users, and libraries that are no JSON."""
    rules = [
        ("users", users, "id", None, ("username", "display_name", "avatar_url", "created_at", "updated_at")), ("sessions", sessions, "token_hash", "user_id", ("user_id", "expires_at")),
        ("states", states, "state_hash", None, ("verifier", "return_to", "expires_at")), ("libraries", libraries, "user_id", "user_id", ("library_json", "revision", "updated_at")),
    ]
    parts, known = [], users.select(F.col("id").alias("__u")).distinct()
    for subject, table, key, owner, filled in rules:
        told = lambda df, reason, key=key, subject=subject: df.select(F.lit(subject).alias("subject"), F.col(key).alias("id"), F.lit(reason).alias("reason"))
        parts.append(told(table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "key"))
        missing = F.col(key).isNull()
        for c in filled:
            missing = missing | F.col(c).isNull()
        parts.append(told(table.where(missing), "null"))
        if owner is not None:
            parts.append(told(table.where(F.col(owner).isNotNull()).join(known, F.col(owner) == F.col("__u"), "left_anti"), "user"))
    parts.append(libraries.where(F.col("library_json").isNotNull() & F.try_parse_json("library_json").isNull()).select(F.lit("libraries").alias("subject"), F.col("user_id").alias("id"), F.lit("json").alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(key).join(table, key, "left_anti").select(*table.columns))


def unexpired(table: DataFrame, now: int, at: str = "expires_at") -> DataFrame:
    return table.where(F.col(at) > now)


def delete_keys(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def consume_once(table: DataFrame, keys: DataFrame, key: list[str], now: int) -> tuple[DataFrame, DataFrame]:
    """(returned, rest): live rows asked for, each once, and the table without them."""
    live = unexpired(table, now)
    wanted = keys.select(*key).distinct()
    got = live.join(wanted, key, "left_semi")
    return got, table.join(got.select(*key), key, "left_anti")


def fold_revisions(edits: DataFrame, user: str, order: list[str], base: str) -> DataFrame:
    """(user, revision, accepted, rejected) after compare-and-set edits in order, each naming the revision it was based on.

    An edit is accepted if its base is the number accepted before it; the fold runs over each user's own list.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, base))), lambda e: e[base])
    folded = F.aggregate("bases", F.lit(0), lambda revision, b: F.when(b == revision, revision + 1).otherwise(revision))
    one = edits.groupBy(user).agg(listed.alias("bases"))
    return one.select(user, folded.cast("long").alias("revision"), folded.cast("long").alias("accepted"), (F.size("bases") - folded).cast("long").alias("rejected"))


def running_revision(edits: DataFrame, user: str, order: list[Column]) -> DataFrame:
    """Edits with the number of edits of the user so far; a prefix sum, for edits that are all accepted."""
    return edits.withColumn("revision", F.row_number().over(Window.partitionBy(user).orderBy(*order)))


def public_path(path: Column) -> Column:
    """Whether a path is one of the published catalog files."""
    names = "|".join(map(re.escape, PUBLIC_NAMES))
    return F.coalesce(path.rlike(rf"^static/data/(?:{names}|\d{{4}}\.json)\z"), F.lit(False))


def worker_result(tail: Column) -> Column:
    """Whether the last line of a log is a complete receipt, and what it says of a commit; null if it is none."""
    line = F.element_at(F.split(F.regexp_replace(tail, r"\s+\z", ""), "\n"), -1)
    v = F.from_json(line, "ok boolean, privateCheckpoint boolean, publicCommit boolean")
    return F.when(v["ok"] & v["privateCheckpoint"] & v["publicCommit"].isNotNull(), v["publicCommit"])


def publication_valid(state: Column) -> Column:
    """Whether a checkout matches its receipt: nothing published, or one clean commit on the base with public files only."""
    sha = r"^[a-f0-9]{40}\z"
    clean = state["baseSha"].rlike(sha) & state["headSha"].rlike(sha) & (state["workingTree"] == "")
    one = (state["headSha"] != state["baseSha"]) & (F.size(state["parentShas"]) == 1) & (state["parentShas"][0] == state["baseSha"]) & (F.size(state["changedPaths"]) > 0) & F.forall(state["changedPaths"], public_path) & (state["remoteSha"] == state["headSha"])
    return F.coalesce(clean & F.when(state["publicCommit"], one).otherwise(state["headSha"] == state["baseSha"]), F.lit(False))


def deployment_allowed(now: Column, event: Column, override: Column, reserve_minutes: int = 5) -> Column:
    """Whether a run may still deploy: between 02:00 and 22:00 UTC less a reserve, or when started by hand outside of it."""
    minute = F.hour(now) * 60 + F.minute(now) + F.second(now) / 60
    inside = (F.hour(now) >= 2) & (minute + reserve_minutes <= 22 * 60)
    return F.coalesce(event.isin("schedule", "workflow_dispatch") & (inside | ((event == "workflow_dispatch") & override)), F.lit(False))


#: Which column of a table names the key of which other one, and that rows go with what they name: the stores of accounts.
REFERENCES = (("sessions", "user_id", "users", "id"), ("libraries", "user_id", "users", "id"))


def delete_order(root: str, references: tuple[tuple[str, str, str, str], ...]) -> list[str]:
    """Tables that a delete from ``root`` may reach, each after all that it depends on; a circle is refused."""
    reach, todo = {root}, [root]
    while todo:
        parent = todo.pop()
        more = {child for child, _, p, _ in references if p == parent} - reach
        reach |= more
        todo += sorted(more)
    order: list[str] = []
    while len(order) < len(reach):
        free = sorted(t for t in reach if t not in order and all(p in order or p not in reach for c, _, p, _ in references if c == t))
        if not free:
            raise ValueError(f"references in a circle: {sorted(reach - set(order))}")
        order += free
    return order


def delete_cascade(tables: dict[str, DataFrame], root: str, doomed: Column, references: tuple[tuple[str, str, str, str], ...] = REFERENCES) -> dict[str, DataFrame]:
    """``tables`` without the rows of ``root`` that ``doomed`` selects and without all that names them, at any distance.

    Along each (child, column, parent, key) the rows of the child whose column is the key of a row that goes go too, whichever
    of several references leads there. A null column names nothing, and a key that is null or still has a row that stays keeps its
    children. One semi join for each reference, in dependency order; tables that are not reached stay as they are.
    """
    gone: dict[str, DataFrame] = {}
    left = dict(tables)
    for name in delete_order(root, references):
        table, hit = tables[name], "__gone"
        if name == root:
            marked = table.withColumn(hit, F.coalesce(doomed, F.lit(False)))
        else:
            marked = table.withColumn(hit, F.lit(False))
        for k, (child, column, parent, key) in enumerate(references):
            if child == name and parent in gone:
                lost = gone[parent].where(F.col(key).isNotNull()).select(F.col(key).alias(f"__key{k}")).distinct()
                kept = left[parent].select(F.col(key).alias(f"__key{k}")).distinct()
                lost = lost.join(kept, f"__key{k}", "left_anti").withColumn(f"__hit{k}", F.lit(True))
                marked = marked.join(lost, F.col(column) == F.col(f"__key{k}"), "left").withColumn(hit, F.col(hit) | F.coalesce(f"__hit{k}", F.lit(False))).drop(f"__key{k}", f"__hit{k}")
        gone[name] = marked.where(hit).select(*table.columns)
        left[name] = marked.where(~F.col(hit)).select(*table.columns)
    return left
