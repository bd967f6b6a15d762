"""Plans whose cost grows with the tables: what is shuffled, and into how much."""

from plumbline.operators.diff import unmatched
from plumbline.plans import grading

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_stay_where_their_deck_is(spark):
    """Every table is dealt by deck; the items, twenty times the decks, aren't."""
    g = grading.graded(spark, SF)
    for df in (g.results, g.scores, g.flags):
        dealt = [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x]
        assert len(dealt) <= 12 and all("deck_id" in x or "orderkey" in x for x in dealt)


def test_unmatched_keys_keep_their_partitions(spark):
    df = unmatched(spark.range(1000).toDF("k"), spark.range(500, 2000).toDF("k"), ["k"])
    assert plan(df).count("REPARTITION_BY_NUM") >= 2 and df.count() == 1500
