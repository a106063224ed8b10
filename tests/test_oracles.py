import duckdb
import pytest
from factories import SF
from parity import connect, difference

from tomewright.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], SF) == ""


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 12


def test_fold_matches_a_plain_reducer(spark):
    names = ["hover-in", "hover-out", "focus-in", "focus-out", "press", "click", "escape"]

    def is_open(s):
        return not s["dismissed"] and (s["pinned"] or s["hovering"] or s["focused"])

    def toggle(s):
        return {**s, "pinned": not is_open(s), "dismissed": is_open(s)}

    def step(s, a):
        if a in ("hover-in", "focus-in"):
            return {**s, "hovering" if a[0] == "h" else "focused": True}
        if a in ("hover-out", "focus-out"):
            s = {**s, "hovering" if a[0] == "h" else "focused": False}
            return s if s["hovering"] or s["focused"] else {**s, "pinned": False, "dismissed": False}
        if a == "press":
            return {**toggle(s), "pressed": True}
        if a == "click":
            return {**s, "pressed": False} if s["pressed"] else toggle(s)
        return {**s, "pinned": False, "dismissed": True} if is_open(s) else s

    want = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"], names[len(r["text"]) % 7])):
        s = want.get(r["conv_id"], dict.fromkeys(("hovering", "focused", "pinned", "dismissed", "pressed"), False))
        want[r["conv_id"]] = step(s, names[len(r["text"]) % 7])
    got = {r["conv_id"]: r.asDict() for r in QUERIES["q44_fold_actions"](spark, SF).collect()}
    assert {k: {**v, "open": is_open(v)} for k, v in want.items()} == {k: {c: v[c] for c in v if c != "conv_id"} for k, v in got.items()}


def test_sessions_expire_within_a_second(spark, tmp_path):
    table = str(tmp_path / "events.parquet")
    duckdb.sql(f"""copy (select * from (values (1, timestamp '2024-01-16 00:00:00'), (2, timestamp '2024-01-16 00:00:00.000001'), (3, timestamp '2024-01-15 23:59:59.999999'), (4, timestamp '2024-01-16 00:00:01')) t(event_id, ts)) to '{table}' (format parquet)""")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{table}'")
    assert difference(spark, con, QUERIES["q47_expire_sessions"], ORACLES["q47_expire_sessions"], str(tmp_path)) == ""
