"""How the work of queries grows: what is shuffled, sent through the driver or done for each pair."""

from tracery.operators import match
from tracery.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_refined_pairs_are_not_shuffled(spark):
    matched = spark.createDataFrame([("R1", "B1", "rx_a"), ("R2", "B9", "none"), ("R3", "B4", "ring_d")], "req_id string, block_key string, leaf string")
    names = spark.createDataFrame([("R1", "a"), ("R1", "tx_A"), ("R1", "b"), ("R2", "b"), ("R3", "z")], "req_id string, name string")
    index = spark.createDataFrame([("B1", "A"), ("B1", "b"), ("B2", "a"), ("B2", "b"), ("B2", "rx_b"), ("B3", "b"), ("B4", "ring_d")], "block_key string, leaf string")
    synonyms = spark.createDataFrame([("z", "ring"), ("b", "none")], "name string, alias string")
    out = match.refined(matched, names, index, synonyms)
    assert sorted(map(tuple, out.collect())) == [("R1", "B1", "exact"), ("R1", "B2", "recovered"), ("R1", "B3", "recovered"), ("R2", "B1", "recovered"), ("R2", "B2", "recovered"), ("R2", "B3", "recovered"), ("R3", "B4", "synonym")]
    # the pairs are the last join, and nothing makes them distinct or looks them up afterwards
    top = plan(out, "optimizedPlan").splitlines()
    assert top[0].startswith("Union")
    assert not any("LeftAnti, ((req_id" in x and "block_key" in x for x in top)


def test_layers_do_not_go_through_the_driver(spark):
    for name in ("s3_layer_ranges", "s4_layer_values"):
        assert "Broadcast" not in plan(catalogue.queries()[name](spark, SF))


def test_the_plan_of_candidates_without_bus_is_short(spark):
    """Each broadcast and each text of a plan stays in the driver; there were 107 broadcasts and a megabyte."""
    p = plan(catalogue.queries()["j9_without_bus"](spark, SF))
    assert len(p) < 100_000 and p.count("BroadcastExchange") < 20


def test_pairs_are_made_once_for_the_exempt_ones_too(spark):
    p = plan(catalogue.queries()["r4_top_k"](spark, SF))
    assert p.count("orders.parquet") == 1 and p.count("row_number()") >= 1


def test_cells_of_sheets_are_shuffled_once(spark):
    """To their row; the other exchanges are of the few rows that tell of sheets and their ranges."""
    p = plan(catalogue.queries()["s1_interface_entries"](spark, SF))
    assert p.count("Exchange hashpartitioning") <= 4 and "SortMergeJoin" not in p


def test_cells_of_tables_are_not_shuffled(spark):
    """Rows are read once and made tables before they meet their files; they were joined, and sorted for it, twice."""
    p = plan(catalogue.queries()["s18_tables"](spark, SF), "optimizedPlan")
    assert p.count("Relation [l_orderkey") == 1 and p.count("Relation [o_orderkey") == 1
    assert p.index("Join Inner") < p.index("Aggregate [table_ord") < p.index("Relation [l_orderkey")
