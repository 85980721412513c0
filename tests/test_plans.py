"""Plan properties: pruned scans, top-k operators, limits before the shuffle."""

import __spark_entry__ as entry
from loomgraph.projection import Graph
from tests.harness import plan_of

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def test_column_pruning(spark):
    plan = plan_of(Graph(spark, SF).files.groupBy("language").count())
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_topk_stays_topk(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["h09_topic_overview"](spark, SF))


def test_per_parent_limit_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["g10_hierarchy_sample"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
