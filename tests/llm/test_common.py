import os

from tomewright.llm import common


def test_intermediates_can_be_cleared(spark):
    table = common.materialize(spark.range(5).toDF("x"), "numbers")
    folder = common.shared_folder(spark)
    assert table.count() == 5 and any(n.startswith("numbers-") for n in os.listdir(folder.removeprefix("file:")))
    common.clear_intermediates(spark)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_a_cluster_must_name_its_folder():
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master, applicationId = "yarn", "a"

            @staticmethod
            def getConf():
                return {}

    try:
        common.shared_folder(Session)
    except ValueError:
        return
    raise AssertionError("no folder was named")


def test_rows_without_a_partner_are_set_aside(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id k", "cast(id % 7 as string) t", "'x' as __group", "'y' as __bits").union(spark.sql("select cast(null as bigint), cast(null as string), 'x', 'y'"))
    wanted = rows.where("k % 10 = 3").select("k", "t")
    for marks in (1 << 25, 64):  # with few bits all rows may have a partner
        monkeypatch.setattr(common, "MARKS", marks)
        some, rest = common.set_aside(rows, ["k", "t"], wanted)
        have, left = ([r["k"] for r in df.collect()] for df in (some, rest))
        assert some.columns == rest.columns == rows.columns and len(have) + len(left) == 3001
        assert set(range(3, 3000, 10)) <= set(have) and (len(have) < 310 if marks > 64 else not left)
    monkeypatch.setattr(common, "MARKS", 1 << 25)
    some, rest = common.set_aside(rows, ["k", "t"], wanted.limit(0))
    assert some.count() == 0 and rest.count() == 3001
    assert common.set_aside(rows, ["k", "t"], rows.where("k is null").select("k", "t"))[0].where("k is null").count() == 1
