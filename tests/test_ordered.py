import random

from pyspark.sql import functions as F

from playtrace.operators import ordered


def _data(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.randrange(30), i, rnd.randrange(5)) for i in range(400)]
    rows += [(None, 1, 1000 + i, 1) for i in range(60)]
    return rows, spark.createDataFrame(rows, "k string, o int, id long, v int")


def test_running_sums_in_split_groups_equal_brute_force(spark):
    rows, df = _data(spark)
    for inclusive in (True, False):
        got = ordered.running(df, ["k"], ["o", "id"], {"s": F.col("v").cast("long")}, inclusive, hot_rows=25)
        got = {r["id"]: r["s"] for r in got.collect()}
        assert len(got) == len(rows)
        for k in {r[0] for r in rows}:
            total = 0
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                assert got[r[2]] == total + (r[3] if inclusive else 0)
                total += r[3]


def test_numbering_descending_and_unsplit(spark):
    rows, df = _data(spark)
    split = {r["id"]: r["n"] for r in ordered.numbered(df, ["k"], [F.desc("o"), "id"], "n", hot_rows=20).collect()}
    plain = {r["id"]: r["n"] for r in ordered.numbered(df, ["k"], [F.desc("o"), "id"], "n").collect()}
    assert split == plain and len(split) == len(rows)


def test_top_k_beyond_the_map_side_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("h"), "id")
    got = ordered.top_k(df, ["k"], ["h", "id"], 1500)
    want = sorted((r["h"], r["id"]) for r in df.where("k = 0").collect())[:1500]
    assert sorted((r["h"], r["id"]) for r in got.where("k = 0").collect()) == want
