"""Places of expansions told by tasks, against those of the expansions' columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.expansions import EXPONENTS, expand
from driftline.operators import places as P


@pytest.mark.parametrize("name", ["QT", "CT", *(n for n in sorted(EXPONENTS) if n[0] in "QC")])
def test_places_are_those_of_the_columns(spark, name, monkeypatch):
    """Rows of several steps, and odd ones: null vectors, components that are null, not finite or missing."""
    monkeypatch.setattr(P, "ROWS", 7)
    x = np.random.default_rng(2).normal(size=(40, 5)).tolist()
    odd = [None, [1.0, None, 2.0, 3.0, 4.0], [float("inf"), 1.0, 2.0, 3.0, 4.0], [0.0] * 5]
    rows = spark.createDataFrame([(v,) for v in x + odd], "features array<double>").repartition(3)
    assert P.told(name)
    got = {r["k"]: r for r in P.place_moments(rows, 5, name).collect()}
    made = rows.select(F.posexplode(expand(F.col("features"), 5, name)).alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    want = {r["k"]: r for r in made.collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert got[k]["n"] == r["n"]
        assert np.allclose([got[k][c] for c in ("mean", "low", "high")], [r[c] for c in ("mean", "low", "high")], equal_nan=True)


def test_no_row_for_each_number(spark):
    """A task of 500 vectors sends a row, not 500 times 45,760."""
    rows = spark.range(500, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(k * F.col("id"))).alias("features"))
    plan = P.place_moments(rows, 64, "CT")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert P.place_moments(rows, 64, "CT").agg(F.count("*"), F.min("n"), F.max("n")).first() == (45760, 500, 500)
