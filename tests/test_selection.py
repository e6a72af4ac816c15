"""Order statistics of groups of any size against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import inventory, selection


def values(seed):
    r = np.random.default_rng(seed)
    groups = {1: r.normal(0, 5, 900).round(1), 2: np.zeros(300), 3: r.choice([1e-300, 1e300, -1e300, 0.0, 5.0], 400), 4: 10.0 ** r.uniform(-30, 30, 500), 5: [7.0], 6: [-0.0, 0.0], 7: r.uniform(0, 1, 700)}
    odd = {8: [None, None, 1.0], 9: [float("nan"), 2.0, float("inf"), float("-inf")], 10: [None], 11: [-1.7e308, 1.7e308, 0.0, 1.0] * 40}
    return [(k, None if v is None else float(v)) for k, vs in (groups | odd).items() for v in vs]


@pytest.mark.parametrize("share,options", [(0.999, {}), (0.5, {"bins": 4, "most": 3}), (0.0, {"bins": 8, "most": 1, "broadcast_groups": 2}), (1.0, {"bins": 4, "most": 1}), (0.37, {"bins": 16, "most": 20})])
def test_equals_sorting(spark, share, options):
    rows = values(3)
    df = spark.createDataFrame(rows, "key int, v double").repartition(3)
    got = {r.key: r.v for r in selection.at_rank(df, "key", "v", lambda n: F.rint(F.lit(share) * (n - 1)), **options).collect()}
    for key in {k for k, _ in rows}:
        order = sorted((v for k, v in rows if k == key), key=lambda v: (v is not None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v))
        want = order[round(share * (len(order) - 1))]
        assert got[key] == want or (want is not None and math.isnan(want) and math.isnan(got[key])), key
    assert len(got) == 11


def test_a_cloud_that_is_one_tree_is_not_sorted(spark):
    cloud = spark.range(200_000).selectExpr("id AS pid", "0.0D AS x", "1.0D AS y", "(id * 7919 % 200000) / 8.0D AS z")
    top = inventory.single_tree_top(cloud)
    assert "Window" not in top._jdf.queryExecution().executedPlan().toString()
    (row,) = top.collect()
    assert row.z == round(0.999 * 199_999) / 8.0


def test_both_ways_to_meet_groups(spark):
    rows = spark.range(100).selectExpr("id % 5 AS key", "id AS v")
    groups = spark.range(4).selectExpr("id AS _key", "id * 10 AS w")
    few, many = (sorted(map(tuple, selection.with_group(rows, groups, "key", n).collect())) for n in (10, 2))
    assert few == many and len(few) == 80
