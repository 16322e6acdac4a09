from pyspark.sql import functions as F

from kinweave.operators import linkage as ln
from kinweave.plans.people import link_probabilities

from .conftest import rows



def test_all_pairs_of_a_block_are_scored(spark):
    data = [(f"{i:02}", None, "배기찬", None, "1999" if i == 0 else "2010", "A" if i == 0 else "B", "x" if i == 0 else "y") for i in range(4)]
    data += [("10", "g1", None, "Ann Lee", "2000", "A", "x"), ("11", "g1", None, "Bo Kim", "2001", "B", "y"), ("12", None, "이안", "ann lee", "2000", "A", "x"), ("13", None, "", "-", None, None, None), ("14", None, "", "?", None, None, None)]
    df = spark.createDataFrame(data, "ledger_id string, gy_id string, name_ko string, name_en string, active_since string, region string, field string")
    got = {(r["src"], r["dst"]): r["probability"] for r in link_probabilities(df).collect()}
    assert sorted(got) == [("00", "01"), ("00", "02"), ("00", "03"), ("01", "02"), ("01", "03"), ("02", "03"), ("10", "11"), ("10", "12")]
    assert got[("02", "03")] == got[("01", "02")] > got[("00", "01")]


def test_a_hot_block_is_whole(spark):
    df = spark.range(1500).select(F.format_string("%05d", "id").alias("r"), F.array(F.lit("hot"), F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"))
    got = ln.block_pairs(df, "r", F.col("k"))
    assert got.count() == got.distinct().count() == 1500 * 1499 // 2
    assert rows(ln.block_pairs(df.limit(0), "r", F.col("k"))) == []
