"""Reading libraries: latest-wins merges, three-way rebase, migration to canonical ids, edits as deltas, progress.

Libraries are two tables: ``follows`` (user_id, series_id, followed_at) and ``entries`` (user_id, id, status, rating,
updated_at, hint_series, hint_number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RESERVED_IDS, SAFE_ID, STATUSES, UNNUMBERED
from ..functions.dates import parses
from ..functions.text import legacy_work_id

ENTRY = ("status", "rating", "updated_at", "hint_series", "hint_number")


def safe_id(x: Column) -> Column:
    return F.coalesce(x.rlike(SAFE_ID) & ~x.isin(*RESERVED_IDS), F.lit(False))


def stamp(x: Column) -> Column:
    return F.try_to_timestamp(x)


def latest(rows: DataFrame, key: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Per key the values of its last row in ``order``. Only the winner so far is kept in each partial aggregate."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last")).select(*key, "__last.*")


def merge(base: DataFrame, incoming: DataFrame, key: list[str], at: Column, values: list[str], earliest: bool = False) -> DataFrame:
    """Both tables with one row per key: the later row, or with ``earliest`` the earlier one; ties take ``incoming``."""
    both = base.select(*key, *values, F.lit(0).alias("__side")).unionByName(incoming.select(*key, *values, F.lit(1).alias("__side")))
    if earliest:
        return both.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(at, -F.col("__side"))).alias("__first")).select(*key, "__first.*")
    return latest(both, key, [at, F.col("__side")], values)


def merge_libraries(base: tuple[DataFrame, DataFrame], incoming: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(follows, entries): a series is followed since the earliest date known, a later edit of an entry wins."""
    follows = merge(base[0], incoming[0], ["user_id", "series_id"], F.col("followed_at"), ["followed_at"], earliest=True)
    return follows, merge(base[1], incoming[1], ["user_id", "id"], stamp(F.col("updated_at")), list(ENTRY))


def rebase(base: DataFrame, local: DataFrame, remote: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``remote`` with the edits from ``base`` to ``local`` applied; a row that ``local`` lacks was deleted.

    Two full outer joins on the key; unchanged keys take the remote row or absence, changed ones the local.
    """
    pack = lambda df, name: df.select(*key, F.struct(*values).alias(name))
    met = pack(base, "__b").join(pack(local, "__l"), key, "full").join(pack(remote, "__r"), key, "full")
    # a key that neither base nor local has is unchanged: absence on both sides is equal
    kept = F.when(F.col("__b").eqNullSafe(F.col("__l")), F.col("__r")).otherwise(F.col("__l"))
    return met.select(*key, kept.alias("__k")).where("__k is not null").select(*key, "__k.*")


def sync(base: DataFrame, local: DataFrame, remotes: DataFrame, met: DataFrame, key: list[str], values: list[str], attempts: int = 4) -> tuple[DataFrame, DataFrame]:
    """(library, outcome): each user's ``local`` library rebased on the remote versions that it met in turn.

    ``key`` begins with the user. ``remotes`` holds the rows of each version with its ``attempt`` from 0, ``met`` (user,
    versions) how many a user met: the last one takes the edits, each before it was a conflict. After each attempt the
    remote version is the new base. A user who met more than ``attempts`` is busy, and keeps the edits for the next time.
    """
    user = key[0]
    for k in range(attempts):
        now = met.where(F.col("versions") > k).select(user)
        of = lambda df, how, now=now: df.select(*key, *values).join(now, user, how).select(*key, *values)
        remote = of(remotes.where(F.col("attempt") == k), "left_semi")
        merged = rebase(of(base, "left_semi"), of(local, "left_semi"), remote, key, values)
        base, local = of(base, "left_anti").unionByName(remote), of(local, "left_anti").unionByName(merged)
    return local, met.select(user, F.when(F.col("versions") > attempts, "busy").otherwise("synced").alias("outcome"))


def parse_entries(raw: DataFrame, books: str = "books", as_of: str = "") -> DataFrame:
    """Valid entries of libraries with a ``books`` map: a known status, a safe id, whole ratings from 1 to 5."""
    one = raw.select(*[c for c in raw.columns if c != books], F.explode_outer(books).alias("id", "e"))  # outer: else Spark parses once more to leave out empty ones
    rating = F.when((F.col("e.rating") == F.floor("e.rating")) & F.col("e.rating").between(1, 5), F.col("e.rating").cast("int"))
    hint = safe_id(F.col("e.work.series"))
    return one.where(safe_id(F.col("id")) & F.col("e.status").isin(*STATUSES)).select(
        *[c for c in raw.columns if c != books], "id", F.col("e.status").alias("status"), rating.alias("rating"),
        F.when(parses(F.col("e.updatedAt")), F.col("e.updatedAt")).otherwise(as_of).alias("updated_at"),
        F.when(hint, F.col("e.work.series")).alias("hint_series"), F.when(hint, F.col("e.work.number")).alias("hint_number"),
    )


def parse_follows(raw: DataFrame, series: str = "series") -> DataFrame:
    one = raw.select(*[c for c in raw.columns if c != series], F.explode_outer(series).alias("series_id", "f"))  # outer as above; a row without an id is not valid
    return one.where(safe_id(F.col("series_id")) & parses(F.col("f.followedAt"))).select(*[c for c in raw.columns if c != series], "series_id", F.col("f.followedAt").alias("followed_at"))


#: ``within`` names columns of all tables of a call whose values are equal wherever ids, series or readers' rows meet. Tables that are
#: dealt out by them already then meet without a shuffle, if the session does not require all keys of a join for that.
Within = tuple[str, ...]


def alias_ids(works: DataFrame, within: Within = ()) -> DataFrame:
    """(series_id, work_id, place, id): all ids of a work, each once and its own first. Each work is one row."""
    ids = F.array_distinct(F.array_compact(F.concat(F.array("work_id", "book_id"), F.coalesce("edition_ids", F.array().cast("array<string>")))))
    return works.select(*within, "series_id", "work_id", F.posexplode(ids).alias("place", "id"))


def work_entries(entries: DataFrame, works: DataFrame, values: tuple[str, ...] = ENTRY, within: Within = ()) -> DataFrame:
    """(user_id, series_id, work_id, id, values): the latest entry over all ids of a work; of equals the work's own id, then the first."""
    met = entries.select(*within, "user_id", "id", *{"updated_at": None, **dict.fromkeys(values)}).join(alias_ids(works, within), [*within, "id"])
    key = [*within, "user_id", "series_id", "work_id"]  # entries of a work are few: combining them before the shuffle would only sort
    return latest(met if within else met.repartition(*key), key, _entry_order(), ["id", *values])


def _entry_order() -> list[Column]:
    return [stamp(F.col("updated_at")), (F.col("id") == F.col("work_id")).cast("int"), -F.col("place")]


def migrate_follows(follows: DataFrame, series: DataFrame) -> DataFrame:
    """Follows of a series' former names move to it; the earliest stamp stays, of equals the one that moved."""
    ids = series.select(F.col("id").alias("own"))
    alias = series.select(F.explode("aliases").alias("alias"), F.col("id").alias("to"), "ordinal").groupBy("alias").agg(F.min_by("to", "ordinal").alias("to"))
    met = follows.join(ids, F.col("series_id") == F.col("own"), "left").join(alias, F.col("series_id") == F.col("alias"), "left")
    moved = met.select("user_id", F.coalesce("own", "to", "series_id").alias("series_id"), "followed_at", (F.col("own").isNull() & F.col("to").isNotNull()).cast("int").alias("moved"))
    return moved.groupBy("user_id", "series_id").agg(F.min_by("followed_at", F.struct("followed_at", -F.col("moved"))).alias("followed_at"))


def implied_follows(entries: DataFrame, works: DataFrame, within: Within = ()) -> DataFrame:
    """A series of which anything is tracked counts as followed since its first entry."""
    return entries.join(alias_ids(works, within), [*within, "id"]).groupBy(*within, "user_id", "series_id").agg(F.min("updated_at").alias("followed_at"))


def _made_once(rows: DataFrame, within: Within, parts: int) -> DataFrame:
    """``rows`` shuffled by ``within``: each use asks for the same columns under no condition, so that one shuffle serves all.

    Columns that a generator gives are new ones: the planner neither sees that the rows lie so already nor pushes anything below.
    """
    if not (within and parts):
        return rows
    again = lambda df, keep, columns: df.select(*keep, F.inline(F.array(F.struct(*columns))))
    return again(again(rows, (), rows.columns).repartition(parts, *within), within, [c for c in rows.columns if c not in within])


def rehome(entries: DataFrame, works: DataFrame, series: DataFrame, books: DataFrame | None = None, within: Within = (), parts: int = 0) -> DataFrame:
    """Entries whose id leads nowhere, moved to the work they were about.

    In this order: the hint on the entry (series or former name, and number), the id that the work would have got under a
    former name, title or number, and the audiobook of that id by its series and number. An entry replaces the one on the
    work if it is not older. Ids that were made up go, real ones stay. Several orphans of one work: the latest, of equals the
    last in id order, is what one after the other would leave. ``parts`` is into how many parts the tables are dealt out ``within``;
    with it the orphans and their places are shuffled once more, so that no task has to make them several times.
    """
    known = alias_ids(works, within).select(*within, "id").distinct()
    lost = _made_once(entries.join(known, [*within, "id"], "left_anti"), within, parts)
    # every name of a series leads to the first series that has it
    names = series.select(*within, F.col("id").alias("series_id"), "ordinal", F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    first_name = names.groupBy(*within, "name").agg(F.min_by("series_id", "ordinal").alias("series_id"))
    numbered = works.where("number is not null").groupBy(*within, "series_id", "number").agg(F.min_by("work_id", "position").alias("work_id"))
    target = lambda df, name, number: df.join(first_name.select(*within, F.col("name").alias(name), F.col("series_id").alias("t_series")), [*within, name]).join(numbered.select(*within, F.col("series_id").alias("t_series"), F.col("number").alias(number), F.col("work_id").alias("t_work")), [*within, "t_series", number])
    by_hint = target(lost.where("hint_series is not null and hint_number is not null").select(*within, "user_id", "id", "hint_series", "hint_number"), "hint_series", "hint_number").select(*within, "user_id", "id", F.lit(0).alias("how"), "t_series", "t_work")
    titles = works.select(*within, "series_id", "work_id", "position", "title", "number")
    if books is not None:
        b = books.select(*within, F.col("id").alias("bid"), F.col("title").alias("btitle"), F.col("seriesNumber").alias("bnumber"))
        own = works.select(*within, "series_id", "work_id", "position", F.col("title").alias("wtitle"), F.col("number").alias("wnumber"), F.explode(F.concat(F.array("book_id"), F.coalesce("edition_ids", F.array().cast("array<string>")))).alias("bid")).join(b, [*within, "bid"])
        spelled = own.select(*within, "series_id", "work_id", "position", F.explode(F.array("wtitle", "btitle")).alias("title"), "wnumber", "bnumber")
        titles = titles.unionByName(spelled.select(*within, "series_id", "work_id", "position", "title", F.explode(F.array("wnumber", "bnumber")).alias("number")))
    made = titles.where("number is not null").distinct().join(names, [*within, "series_id"]).select(*within, legacy_work_id(F.col("name"), F.col("number"), F.col("title")).alias("id"), "series_id", "work_id", "ordinal", "position")
    made = made.groupBy(*within, "id").agg(F.max_by(F.struct(F.col("series_id").alias("t_series"), F.col("work_id").alias("t_work")), F.struct("ordinal", "position")).alias("t")).select(*within, "id", "t.*")
    by_made = lost.select(*within, "user_id", "id").join(made, [*within, "id"]).select(*within, "user_id", "id", F.lit(1).alias("how"), "t_series", "t_work")
    found = by_hint.unionByName(by_made)
    if books is not None:
        audio = books.where((F.col("edition") == "audiobook") & F.col("seriesNumber").isNotNull()).select(*within, "id", "seriesKey", "seriesNumber")
        found = found.unionByName(target(lost.select(*within, "user_id", "id").join(audio, [*within, "id"]), "seriesKey", "seriesNumber").select(*within, "user_id", "id", F.lit(2).alias("how"), "t_series", "t_work"))
    best = found.groupBy(*within, "user_id", "id").agg(F.min_by(F.struct("t_series", "t_work"), "how").alias("t")).select(*within, "user_id", "id", "t.*")
    best = _made_once(best, within, parts)
    numbers = works.select(*within, F.col("series_id").alias("t_series"), F.col("work_id").alias("t_work"), F.col("number").alias("t_number"))
    moved = lost.join(best, [*within, "user_id", "id"]).join(numbers, [*within, "t_series", "t_work"]).select(*within, "user_id", F.col("t_work").alias("id"), "status", "rating", "updated_at", F.col("t_series").alias("hint_series"), F.col("t_number").alias("hint_number"), F.col("id").alias("__from"))
    gone = best.where(F.col("id").startswith("work-legacy-")).select(*within, "user_id", "id")
    stay = entries.join(gone, [*within, "user_id", "id"], "left_anti").select(*within, "user_id", "id", *ENTRY, F.lit("").alias("__from"))
    both = stay.unionByName(moved.select(*stay.columns))
    return latest(both, [*within, "user_id", "id"], [stamp(F.col("updated_at")), (F.col("__from") != "").cast("int"), F.col("__from")], list(ENTRY))


def change_follows(follows: DataFrame, edits: DataFrame) -> DataFrame:
    """(user_id, series_id, followed_at) after ``edits`` (user_id, series_id, follow, at), whatever order they come in.

    Following again keeps the date since when a series is followed; unfollowing drops the row, and nothing but it: entries
    stay. So only what came after a reader's last unfollowing of a series counts, and of that the first. Of edits at one
    instant the unfollowing comes first. Edits with a null user, series or follow, or an ``at`` that is no instant, do nothing.

    The edits of a reader to a series meet in one window, whose last unfollowing is all that it keeps; the aggregate that
    follows and the join have the same key, so edits are shuffled once. Several rows of ``follows`` for a key become the
    earliest.
    """
    key = ["user_id", "series_id"]
    e = edits.select(*key, "follow", "at", stamp(F.col("at")).alias("__at")).where("user_id is not null and series_id is not null and follow is not null and __at is not null")
    e = e.withColumn("__un", F.max(F.when(~F.col("follow"), F.col("__at"))).over(Window.partitionBy(*key)))
    counts = F.col("follow") & (F.col("__un").isNull() | (F.col("__at") >= F.col("__un")))
    told = e.groupBy(*key).agg(F.min_by(F.when(counts, F.col("at")), F.when(counts, F.struct("__at", "at"))).alias("__since"), F.bool_or(~F.col("follow")).alias("__dropped"))
    have = follows.groupBy(*key).agg(F.min("followed_at").alias("followed_at"))
    kept = F.when(F.coalesce("__dropped", F.lit(False)), F.col("__since")).otherwise(F.coalesce("followed_at", "__since"))
    return have.join(told, key, "full").select(*key, kept.alias("followed_at")).where("followed_at is not null")


def edit_follows(edits: DataFrame) -> DataFrame:
    """The follow edits that edits of works (see ``apply_edits``) imply: a status or a rating follows the series, clearing changes nothing."""
    return edits.where("status is not null or rating is not null").select("user_id", "series_id", F.lit(True).alias("follow"), "at")


def apply_edits(entries: DataFrame, edits: DataFrame, works: DataFrame, within: Within = ()) -> DataFrame:
    """``entries`` after ``edits`` (user_id, series_id, work_id, status, rating, at), one per user and work.

    A status writes the work's own entry and keeps the rating; a null status with a rating rates it, as read if there was no
    entry; both null clear the work: all of its ids lose their entries, so that an old one can't come back.
    """
    key = [*within, "user_id", "series_id", "work_id"]
    met = entries.select(*within, "user_id", "id", "status", "rating", "updated_at").join(alias_ids(works, within), [*within, "id"])
    best = F.max_by(F.struct("status", "rating"), F.struct(*_entry_order()))
    have = (met if within else met.repartition(*key)).groupBy(*key).agg(best.alias("old"), F.collect_set("id").alias("ids"))
    asked = edits.join(works.select(*within, "series_id", "work_id", F.col("number").alias("hint_number")), [*within, "series_id", "work_id"]).join(have, key, "left")
    rated = F.when(F.col("rating").between(1, 5), F.round("rating").cast("int"))
    wrote = F.col("status").isNotNull() | F.col("rating").isNotNull()
    fields = {
        "status": F.coalesce("status", "old.status", F.lit("read")), "rating": F.when(F.col("status").isNull(), rated).otherwise(F.col("old.rating")), "updated_at": F.col("at"),
        "hint_series": F.col("series_id"), "hint_number": F.col("hint_number"),
    }
    kinds = {f.name: f.dataType for f in entries.select(*ENTRY).schema}
    made = asked.select(
        *within, "user_id", F.explode_outer(F.when(wrote, F.array("work_id")).otherwise(F.col("ids"))).alias("id"), *[F.when(wrote, fields[c]).cast(kinds[c]).alias(c) for c in ENTRY], F.when(wrote, 1).otherwise(2).alias("__kind"),
    ).where("id is not null")
    # what an edit wrote or cleared takes the place of entries; all meet once, by user and id
    both = entries.select(*within, "user_id", "id", *ENTRY, F.lit(0).alias("__kind")).unionByName(made)
    both = both.withColumn("__most", F.max("__kind").over(Window.partitionBy(*within, "user_id", "id")))
    return both.where("__kind = 1 or (__kind = 0 and (__most = 0 or user_id is null))").select(*within, "user_id", "id", *ENTRY)


def read_through_edits(entries: DataFrame, mainline: DataFrame, upto: DataFrame, at: str, within: Within = ()) -> DataFrame:
    """Edits that mark released mainline works up to and with the chosen one as read, where they are not yet.

    ``mainline`` has series_id, work_id, rank in reading order and state; ``upto`` user_id, series_id, work_id.
    """
    cut = upto.join(mainline.select(*within, "series_id", "work_id", F.col("rank").alias("cut")), [*within, "series_id", "work_id"]).select(*within, "user_id", "series_id", "cut")
    todo = mainline.join(cut, [*within, "series_id"]).where((F.col("rank") <= F.col("cut")) & (F.col("state") == "released"))
    read = work_entries(entries, mainline, ("status",), within).where("status = 'read'").select(*within, "user_id", "series_id", "work_id")
    return todo.join(read, [*within, "user_id", "series_id", "work_id"], "left_anti").select(*within, "user_id", "series_id", "work_id", F.lit("read").alias("status"), F.lit(None).cast("int").alias("rating"), F.lit(at).alias("at"))


def progress(follows: DataFrame, works: DataFrame, entries: DataFrame, gaps: DataFrame, coverage: DataFrame, within: Within = ()) -> DataFrame:
    """Counters and state per user and followed series.

    ``works``: series_id, work_id, book_id, edition_ids, rank, is_main, has_audio, state (of the release). ``gaps``:
    series_id, gaps. ``coverage``: series_id, current, released_ids. With current coverage, releases that no work matches
    and works that nothing vouches for are unresolved; without it gaps, undated works and unread side works are, and the
    list itself is never certain.
    """
    read = work_entries(entries, works, ("status",), within).select(*within, "user_id", "series_id", "work_id", F.col("status").alias("shelf"))
    of = [*within, "series_id"]
    rows = follows.select("user_id", *of).join(works, of).join(read, ["user_id", *of, "work_id"], "left").join(coverage.select(*of, "current"), of, "left")
    current = F.coalesce("current", F.lit(False))
    is_read, released = F.coalesce(F.col("shelf") == "read", F.lit(False)), F.col("state") == "released"
    main = F.col("is_main")
    counts = rows.groupBy("user_id", *of).agg(
        F.max("current").alias("current"),
        F.count_if(main & released & is_read).alias("read"), F.count_if(main & released).alias("total"),
        F.count_if(main & (F.col("state") == "unknown") & ~is_read & ~current).alias("undated"), F.count_if(main & (F.col("state") == "scheduled")).alias("upcoming"),
        F.count_if(main & F.coalesce("has_audio", F.lit(True)) & (F.col("state") == "unknown") & current).alias("unvouched"),
        F.count_if(~main & released & is_read).alias("side_read"), F.count_if(~main & released).alias("side_total"),
        F.min(F.when(main & released & ~is_read, F.struct("rank", "work_id"))).alias("next"), F.bool_or(F.coalesce(F.col("shelf") == "reading", F.lit(False))).alias("listening"),
    )
    known = works.select(*of, "work_id")
    unmatched = coverage.where("current").select(*of, F.explode("released_ids").alias("work_id")).join(known, [*of, "work_id"], "left_anti").groupBy(*of).agg(F.count("*").alias("unmatched"))
    met = counts.join(unmatched, of, "left").join(gaps, of, "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(0)))
    met = met.withColumn("gaps", F.when(current, F.array().cast("array<int>")).otherwise(F.coalesce("gaps", F.array().cast("array<int>"))))
    clean = current & (F.col("unmatched") == 0) & (F.col("unvouched") == 0)
    finished = (F.col("total") > 0) & (F.col("read") == F.col("total"))
    state = F.when(finished & clean, "caught-up").when(finished, "caught-up-partial").when((F.col("read") > 0) | F.col("listening"), "in-progress").otherwise("not-started")
    many = lambda n, one, more: F.concat(n.cast("string"), F.when(n == 1, one).otherwise(more))
    n_gaps, side_left = F.size("gaps"), F.col("side_total") - F.col("side_read")
    said = F.when(
        current,
        F.array(F.when(F.col("unmatched") > 0, many(F.col("unmatched"), " audiobook is missing from this list", " audiobooks are missing from this list")), F.when(F.col("unvouched") > 0, many(F.col("unvouched"), " book here has not been confirmed as an audiobook", " books here have not been confirmed as an audiobook"))),
    ).otherwise(
        F.array(
            F.when(n_gaps > 0, F.concat(F.lit("Book "), F.array_join(F.col("gaps").cast("array<string>"), ", "), F.when(n_gaps == 1, " is").otherwise(" are"), F.lit(" missing from this list"))),
            F.when(F.col("undated") > 0, many(F.col("undated"), " audiobook has no confirmed release date", " audiobooks have no confirmed release date")),
            F.when(side_left > 0, many(side_left, " side entry is unread", " side entries are unread")), F.lit("This list may be incomplete"),
        )
    )
    return met.select(
        *within, "user_id", "series_id", "read", "total", (F.col("total") - F.col("read")).alias("remaining"), "undated", "upcoming", "gaps", (finished & clean).alias("caught_up"),
        F.col("next.work_id").alias("next_unread"), "side_read", "side_total", current.alias("source_complete"), F.array_compact(said).alias("unresolved"), state.alias("state"),
    )


def reading_rank(main: DataFrame) -> DataFrame:
    """Mainline works with their place in reading order."""
    w = Window.partitionBy("series_id").orderBy(F.coalesce("number", F.lit(float(UNNUMBERED))), F.collate("title", "UNICODE"), "work_id")
    return main.withColumn("rank", F.row_number().over(w))


def place_works(works: DataFrame, order: list[Column], series: str = "series_id", dealt: bool = False) -> DataFrame:
    """``works`` with is_main, whether ``series.mainline`` has the work, and its ``reading_rank``, null for other works.

    Rows are shuffled once, by series: both windows are within it. ``dealt`` says that they lie so already.
    """
    numbered = F.max(F.col("number").isNotNull()).over(Window.partitionBy(series))
    first = F.row_number().over(Window.partitionBy(series, "number").orderBy(*order)) == 1
    marked = (works if dealt else works.repartition(series)).withColumn("is_main", F.when(F.col("number").isNotNull(), first).otherwise(~numbered))
    w = Window.partitionBy(series).orderBy(F.desc("is_main"), F.coalesce("number", F.lit(float(UNNUMBERED))), F.collate("title", "UNICODE"), "work_id")
    return marked.withColumn("rank", F.when(F.col("is_main"), F.row_number().over(w)))


def up_next(progress: DataFrame, releases: DataFrame, titles: DataFrame, within: Within = ()) -> DataFrame:
    """The next unread work of each followed series, oldest release first."""
    met = progress.where("next_unread is not null").join(releases.select(*within, "series_id", F.col("work_id").alias("next_unread"), "date"), [*within, "series_id", "next_unread"], "left").join(titles, [*within, "series_id"], "left")
    return met.select("user_id", "series_id", "next_unread", "remaining", F.coalesce("date", F.lit("")).alias("date"), "title").orderBy("date", F.collate("title", "UNICODE"))


def export_library(follows: DataFrame, entries: DataFrame, at: str) -> DataFrame:
    """(user_id, json): version 2 envelopes."""
    f = follows.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("series_id", F.struct(F.col("followed_at").alias("followedAt")))))).alias("series"))
    hint = F.when(F.col("hint_series").isNotNull(), F.struct(F.col("hint_series").alias("series"), F.col("hint_number").alias("number")))
    e = entries.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", F.struct("status", "rating", F.col("updated_at").alias("updatedAt"), hint.alias("work")))))).alias("books"))
    both = f.join(e, "user_id", "full")
    inner = F.struct(F.lit(2).alias("version"), F.coalesce("series", F.create_map().cast("map<string,struct<followedAt:string>>")).alias("series"), "books")
    return both.select("user_id", F.to_json(F.struct(F.lit(2).alias("version"), F.lit(at).alias("exportedAt"), inner.alias("library"))).alias("json"))


def percent_read(read: Column, total: Column) -> Column:
    """Whole percent of released works that are read; 0 without any."""
    return F.when(total > 0, F.round(100 * read / total)).otherwise(0).cast("int")
