"""Deletes along references, and folds of histories in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators import accounts, reader


def test_users_go_with_their_sessions_and_libraries(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (3, "a"), (None, "a")], "id long, name string")
    sessions = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", None), ("s4", 9), ("s5", 3)], "token_hash string, user_id long")
    libraries = spark.createDataFrame([(1, "{}"), (2, "{}"), (3, "{}")], "user_id long, json string")
    left = accounts.delete_cascade({"users": users, "sessions": sessions, "libraries": libraries, "states": sessions}, "users", F.col("name") == "a")
    assert sorted(tuple(r) for r in left["users"].collect()) == [(2, "b"), (3, "b")]
    assert sorted(r[0] for r in left["sessions"].collect()) == ["s2", "s3", "s4", "s5"]  # one user 3 stays
    assert sorted(r[0] for r in left["libraries"].collect()) == [2, 3] and left["states"] is sessions


def test_deletes_at_any_distance_by_any_way(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(10, 1), (20, 2)], "id int, a int")
    c = spark.createDataFrame([(100, 10, 2), (200, 20, 1), (300, 20, 2)], "id int, b int, a int")
    d = spark.createDataFrame([(1000, 100), (2000, 200), (3000, 300)], "id int, c int")
    refs = (("d", "c", "c", "id"), ("c", "b", "b", "id"), ("c", "a", "a", "id"), ("b", "a", "a", "id"))
    assert accounts.delete_order("a", refs) == ["a", "b", "c", "d"]
    left = accounts.delete_cascade({"a": a, "b": b, "c": c, "d": d}, "a", F.col("id") == 1, refs)
    assert {t: sorted(r[0] for r in left[t].collect()) for t in "abcd"} == {"a": [2], "b": [20], "c": [300], "d": [3000]}
    with pytest.raises(ValueError, match="circle"):
        accounts.delete_order("a", (("b", "x", "a", "y"), ("a", "x", "b", "y")))


def test_fold_in_pieces_equals_the_fold(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), k // 2, rng.choice([*reader.ACTIONS, "else", None])) for k in range(900)] + [("single", 1, "press")]
    df = spark.createDataFrame(rows, "k string, n int, action string").selectExpr("*", "'x' as key", "1 as code", "2 as task")
    want = df.groupBy("k").agg(reader.fold_actions(F.transform(F.sort_array(F.collect_list(F.struct("n", "action"))), lambda x: x["action"])).alias("s")).select("k", "s.*")
    got = reader.fold_histories(df.repartition(7), "k", ["n"], "action")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert reader.fold_histories(df.limit(0), "k", ["n"], "action").count() == 0


def test_a_history_of_ten_million_actions(spark):
    n = 10_000_000
    names = F.array(*[F.lit(a) for a in reader.ACTIONS])
    one = spark.range(0, n, numPartitions=8).select(F.lit(1).alias("k"), "id", F.get(names, (F.xxhash64("id") % 7 + 7).cast("int") % 7).alias("action"))
    got = reader.fold_histories(one, "k", ["id"], "action").collect()
    last = one.where(F.col("id") >= n - 2000)  # 2,000 actions settle it: an escape and both outs are among them
    want = last.groupBy("k").agg(reader.fold_actions(F.transform(F.sort_array(F.collect_list(F.struct("id", "action"))), lambda x: x["action"])).alias("s")).select("k", "s.*").collect()
    assert got == want
