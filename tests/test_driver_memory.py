"""What queries over the grid view broadcast: no grid, however small Spark takes it to be."""

import re

import pytest

import __spark_entry__ as entry
from patchlane.plans import fixtures as fx

ITEMS, THRESHOLD = 1800 * 18, "spark.sql.autoBroadcastJoinThreshold"
#: Queries that need set cells only, which makes the view's join an inner one: Spark may then send either side.
ON_MASKS = ["grd10_resize_nearest", "grd12_close", "grd12_dilate", "grd12_dilate_cross", "grd13_components_4", "grd14_components_8", "pol9_peak_in_region", "sta13_region_size_gain", "met6_aupro", "met8_auspro", "met12_region_overlap", "met7_aupro_binned", "met10_aupro_by_condition", "met15_map_variants"]


@pytest.fixture(scope="module")
def thin(spark, tmp_path_factory):
    """1,800 images of 18 items: 990,000 cells, whose images alone are a few kB."""
    folder = str(tmp_path_factory.mktemp("thin"))
    items = spark.range(ITEMS).selectExpr(
        "id % 1800 as l_suppkey", "cast(1 + id * 7919 % 50 as double) as l_quantity", "id * 104729 % 11 / 100 as l_discount", "cast(100 + id * 31 % 977 as double) as l_extendedprice", "if(id % 2 = 0 or id % 5 = 1, 'R', 'N') as l_returnflag"
    )
    items.repartition(4).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def broadcast_rows(spark, run):
    """Rows of the largest broadcast of everything that run executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, ran = 0, store.executionsList()
    for i in range(done, ran.size()):
        execution = ran.apply(i).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = (node.metrics().apply(k) for k in range(node.metrics().size())) if node.name() == "BroadcastExchange" else ()
            for m in metrics:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(re.sub(r"\D", "", values.apply(m.accumulatorId())) or 0))
    return most


@pytest.fixture
def narrow(spark):
    """A threshold above what the images of the table take, below what their items take."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "100k")
    yield spark
    spark.conf.set(THRESHOLD, before)


@pytest.mark.parametrize("name", ON_MASKS)
def test_no_grid_is_broadcast(narrow, thin, name):
    assert 0 < broadcast_rows(narrow, lambda: entry.queries()[name](narrow, thin).collect()) <= ITEMS


def test_every_image_has_every_cell_once(spark, thin):
    cells = fx.cells(spark, thin)
    assert dict(cells.dtypes)["y"] == dict(cells.dtypes)["x"] == "int"
    per_image = cells.groupBy("image_id").agg({"*": "count", "y": "max", "x": "max"}).drop("image_id").distinct().collect()
    assert [sorted(r) for r in per_image] == [[10, 49, 550]] and cells.distinct().count() == 1800 * 550
