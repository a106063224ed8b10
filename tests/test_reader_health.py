import pytest
from factories import rows
from pyspark.sql import functions as F

from tomewright import schemas
from tomewright.operators import accounts, health, reader


def context(**more):
    base = dict(substantiveVoices=5.0, span=["2024-01-05", "2025-03-01"], sources=[{"name": " Shop ", "url": "https://s.example"}, {"name": "Bad", "url": "javascript:x"}], consensus="mixed", observation=None, impressions=None, critiques=None,
                traits=[{"trait": "powerCreep", "value": " high ", "confidence": 0.9, "summary": " grows "}, {"trait": "narration", "value": "warm", "confidence": 0.95, "summary": "reads well"}, {"trait": "a", "value": "Unknown", "confidence": 0.9, "summary": ""}, {"trait": "b", "value": "x", "confidence": 0.6, "summary": ""}])
    return {**base, **more}


def view(spark, c):
    df = spark.createDataFrame([{"c": c}], f"c {schemas.READER_CONTEXT}")
    return df.select(reader.impressions(F.col("c")).alias("v")).first()["v"]


def test_impressions(spark):
    v = view(spark, context())
    assert (v["sampled"], v["span"], v["consensus"], v["observation"]) == (5, "Jan 2024 – Mar 2025", "mixed", None)
    assert [tuple(t) for t in v["traits"]] == [("powerCreep", "Power creep", "high", "grows")] and [tuple(s) for s in v["sources"]] == [("Shop", "https://s.example")]
    v = view(spark, context(observation=" slow start "))
    assert v["observation"] == "slow start" and v["traits"] == []
    v = view(spark, context(observation="x", impressions=["a ", "a", "", "b", *"cdefg"]))
    assert v["observation"] is None and v["impressions"] == ["a", "b", "c", "d", "e", "f"] and v["critiques"] == []
    assert view(spark, context(substantiveVoices=0.4)) is None and view(spark, context(traits=[])) is None and view(spark, None) is None


@pytest.mark.parametrize(
    "note, want",
    [
        ("Judged by Robo from metadata; cover art says nothing.", "Cover art says nothing."), ("Robo said so.", None), ("Plain note.", "Plain note."), ("About robots. Fine", "About robots. Fine"),
        ("First. Then robo again", None), ("  ", None), (None, None),
    ],
)
def test_notes(spark, note, want):
    df = spark.createDataFrame([(note,)], "n string")
    assert df.select(reader.reader_note(F.col("n"), ("robo",))).first()[0] == want


def test_issues(spark):
    df = spark.createDataFrame([(["Narrator not supplied", "Genre needs review", "by Robo", " Narrator not supplied", ""],), (None,)], "i array<string>")
    assert [r[0] for r in df.select(reader.reader_issues(F.col("i"), ("robo",))).collect()] == [["Narrator not supplied"], []]


SCORE = {"percent": 50.0, "earned": 1.0, "possible": 2.0, "explanation": "x"}


def check(id, status="present", available=True):
    return {"id": id, "label": id, "status": status, "available": available, "explanation": "", "sourceUrl": None, "observedAt": None, "dueAt": None}


def hs(id, **more):
    return {**dict(id=id, title=f"The {id}", author="A", workIds=[], knownWorks=1, confirmedAudioWorks=1, completeness=SCORE, evidenceQuality=SCORE, checks=[], issues=[], missingVolumes=[], sources=[]), **more}


def hw(id, sid, **more):
    return {**dict(id=id, seriesId=sid, number=1.0, title=f"W {id}", author="A", formats=[], completeness=SCORE, evidenceQuality=SCORE, checks=[], issues=[], audio={"state": "released", "releaseDate": None}, sources=[]), **more}


def source(at):
    return {"url": "u", "status": "present", "checkedAt": at, "fetchedAt": None, "nextCheckAt": None}


def test_groups(spark):
    df = spark.createDataFrame([hw("a", "s", checks=[check("cover-url"), check("cover-asset", "stale"), check("cover-observation", "unknown", False)]), hw("b", "s", checks=[check("cover-url"), check("cover-asset"), check("cover-observation")])], schemas.HEALTH_WORK)
    got = {r["id"]: r for r in health.grouped_checks(df).collect()}
    assert tuple(got["a"]["group_cover"]) == ("stale", False) and tuple(got["b"]["group_cover"]) == ("present", True) and tuple(got["a"]["group_audio"]) == ("unknown", False)
    assert rows(health.group_coverage(df, "cover")) == [(1, 2)]


def test_rows_and_order(spark):
    gap = {"number": 3.0, "evidence": "observed-numbering", "status": "missing", "explanation": "", "sourceUrls": []}
    s = spark.createDataFrame([hs("b", missingVolumes=[gap], sources=[source("2026-01-02"), source("2026-01-01")]), hs("a", sources=[source(None), source("2020-01-01")]), hs("c")], schemas.HEALTH_SERIES)
    w = spark.createDataFrame([hw("w1", "a", checks=[check("x", "stale"), check("y")]), hw("w2", "a", checks=[check("x", "missing")], title="Special")], schemas.HEALTH_WORK)
    r = health.series_rows(s, w)
    got = {x["id"]: (x["missing"], x["review"], x["missing_works"], x["attention"], x["oldest_source"]) for x in r.collect()}
    assert got == {"b": (True, False, 0, 1, "2026-01-01"), "a": (True, True, 1, 2, None), "c": (False, False, 0, 0, None)}
    ids = lambda df: [x["id"] for x in df.collect()]
    assert ids(health.visible_series(r)) == ["a", "b", "c"] and ids(health.visible_series(r, "review")) == ["a"] and ids(health.visible_series(r, query="special")) == ["a"]
    assert ids(health.visible_series(r, sort="freshness")) == ["a", "c", "b"] and rows(health.filter_counts(r)) == [(3, 2, 1)]


def test_violations(spark):
    s = spark.createDataFrame([hs("s"), hs("dup"), hs("dup"), hs("bad", completeness={**SCORE, "percent": 101.0}, checks=[check("x", "fine")])], schemas.HEALTH_SERIES)
    w = spark.createDataFrame([hw("w", "s"), hw("o", "gone"), hw("z", "s", audio={"state": "lost", "releaseDate": None})], schemas.HEALTH_WORK)
    assert rows(health.violations(s, w)) == [("series", "bad", "check"), ("series", "bad", "score"), ("series", "dup", "duplicate"), ("work", "o", "series"), ("work", "z", "audio")]
    assert health.violations(s.where("id = 's'"), w.where("id = 'w'")).count() == 0


def test_accounts(spark):
    users = spark.createDataFrame([("u1", "old"), ("u2", "two")], "id string, name string")
    assert rows(accounts.upsert(users, spark.createDataFrame([("u1", "new"), ("u3", "three")], users.schema), ["id"], ["name"])) == [("u1", "new"), ("u2", "two"), ("u3", "three")]
    st = spark.createDataFrame([("a", 10), ("b", 1), ("c", 10)], "state_hash string, expires_at long")
    got, rest = accounts.consume_once(st, spark.createDataFrame([("a",), ("b",), ("a",)], "state_hash string"), ["state_hash"], 5)
    assert rows(got) == [("a", 10)] and rows(rest) == [("b", 1), ("c", 10)]
    e = spark.createDataFrame([("u", 1, 0), ("u", 2, 0), ("u", 3, 1), ("v", 1, 5)], "user_id string, seq long, base long")
    assert rows(accounts.fold_revisions(e, "user_id", ["seq"], "base")) == [("u", 2, 2, 1), ("v", 0, 0, 1)]


def test_publication(spark):
    paths = spark.createDataFrame([(p,) for p in ("static/data/catalog.json", "static/data/2024.json", "static/data/x.json", "static/data/2024.json\n", "a/static/data/meta.json")], "p string")
    assert [r[0] for r in paths.select(accounts.public_path(F.col("p"))).collect()] == [True, True, False, False, False]
    tails = spark.createDataFrame([('noise\n{"ok":true,"privateCheckpoint":true,"publicCommit":false}\n',), ('{"ok":true}',), ("x",)], "t string")
    assert [r[0] for r in tails.select(accounts.worker_result(F.col("t"))).collect()] == [False, None, None]
    a, b = "a" * 40, "b" * 40
    schema = "s struct<publicCommit:boolean,baseSha:string,headSha:string,parentShas:array<string>,changedPaths:array<string>,workingTree:string,remoteSha:string>"
    states = [(True, a, b, [a], ["static/data/meta.json"], "", b), (True, a, b, [a], ["src/x"], "", b), (False, a, a, [], [], "", a), (False, a, b, [], [], "", b), (True, a, b, [a], ["static/data/meta.json"], " M", b)]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in states], schema).select(accounts.publication_valid(F.col("s"))).collect()] == [True, False, True, False, False]
    times = spark.createDataFrame([("2026-01-01 21:54:00", "schedule", False), ("2026-01-01 21:56:00", "schedule", True), ("2026-01-01 01:00:00", "workflow_dispatch", True), ("2026-01-01 05:00:00", "push", True)], "t string, e string, o boolean")
    assert [r[0] for r in times.select(accounts.deployment_allowed(F.col("t").cast("timestamp"), F.col("e"), F.col("o"))).collect()] == [True, False, True, False]


def test_keys_are_dealt_out_in_parts_of_bounded_rows(spark):
    """Not by bytes: anti joins, doubles and works get as many tasks as their rows ask for, and no second shuffle."""
    from pyspark.sql import functions as F

    from tomewright.operators import health
    from tomewright.plans import registry

    assert registry.tasks(spark.range(registry.ROWS * 3), spark.range(5)) == 4
    a, b = spark.range(40).withColumnRenamed("id", "a"), spark.range(30).withColumnRenamed("id", "b")
    lost = health.orphans(a.hint("merge"), b.unionByName(b), "a", "b", 7)
    assert sorted(r["a"] for r in lost.collect()) == list(range(30, 40)) and lost.select(F.spark_partition_id()).distinct().count() > 1
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
    twice = health.duplicates(b.unionByName(b), "b", 7)
    assert twice.count() == 30 and "REPARTITION_BY_NUM" in twice._jdf.queryExecution().executedPlan().toString()
