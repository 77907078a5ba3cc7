"""Groups that hold most rows: results stay exact, and no join task gets the group whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfex.operators.intake import mark_first
from surfex.operators.ranking import exact_quantiles
from surfex.session import checkpoint_folder, cut_lineage, drop_cut


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(3)] + [(f"g{i % 40}", float(i % 17)) for i in range(2000)] + [("one", 4.0), ("none", None)]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.01, "mid": 0.5, "high": 0.97}).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for k, v in rows if k == g]
        assert np.allclose([got[g].low, got[g].mid, got[g].high], np.quantile(own, [0.01, 0.5, 0.97]))
    assert "none" not in got


def test_first_of_a_hot_key(spark):
    rows = spark.range(4000).select(F.col("id").alias("arrival"), F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("key"))
    marked = mark_first(rows, "key", "arrival", "first", F.col("arrival") >= 10).where("first").collect()
    least = {}
    for i in range(10, 4000):
        least.setdefault("hot" if i % 3 else str(i % 50), i)
    assert {r.key: r.arrival for r in marked} == least and len(marked) == len(least)


def test_first_joins_back_by_the_unique_order(spark):
    rows = spark.range(100).select(F.col("id").alias("arrival"), F.lit("hot").alias("key"))
    plan = mark_first(rows, "key", "arrival", "first")._jdf.queryExecution().optimizedPlan().toString()
    assert "(arrival" in plan.split("Join", 1)[1].split("\n")[0]


def test_cut_tables_can_be_dropped(spark):
    table = cut_lineage(spark.range(5))
    assert table.count() == 5
    drop_cut(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._cut_path).count()


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        checkpoint_folder(Session())
