"""Queries of blocks and of places against their SQL on rows that are not as they should be."""

import duckdb
import numpy as np
import pytest

from driftline import queries
from tests.test_queries import SF, sorted_rows


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query equals its SQL on the vectors whose columns are replaced."""

    def run(name, replaced, where="true"):
        con = duckdb.connect()
        con.execute(f"COPY (SELECT * REPLACE ({replaced}) FROM '{SF}/embeddings.parquet' WHERE {where}) TO '{tmp_path}/embeddings.parquet'")
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        a, b = sorted_rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()), sorted_rows(con.execute(queries.ORACLES[name]).df())
        assert a[0] == b[0] and len(a[1]) == len(b[1])
        return np.allclose(np.array(a[1], float), np.array(b[1], float), atol=2e-3 if "moments" in name or "delta" in name else 2e-6, rtol=1e-9, equal_nan=True)

    return run


#: Two gaps: one within a block, one of whole blocks.
GAPS = "(CASE WHEN vec_id < 120 THEN vec_id WHEN vec_id < 330 THEN vec_id + 137 ELSE vec_id + 1000 END)::BIGINT AS vec_id"


@pytest.mark.parametrize("name", ["moments_serial", "typical_delta_of_blocks"])
def test_serial_with_gaps_between_ids(agrees, name):
    assert agrees(name, GAPS)


def test_mixed_with_gaps_between_ids(agrees):
    assert agrees("moments_mixed", GAPS)


def test_serial_regression_without_some_labels(agrees):
    """Those come last."""
    assert agrees("moments_serial_regression", "(CASE WHEN vec_id % 11 = 3 THEN NULL ELSE label END) AS label")


#: A vector that is not there, one of 50 components, one of none, and one with a null among its components.
ODD = "(CASE vec_id WHEN 7 THEN NULL WHEN 8 THEN embedding[1:50] WHEN 9 THEN []::FLOAT[] WHEN 10 THEN embedding[1:5] || [NULL::FLOAT] || embedding[7:64] ELSE embedding END) AS embedding"


@pytest.mark.parametrize("name", ["expand_cubic", "expand_C_N", "expand_C_E_exp", "expand_C_exp", "expand_C_AE_exp", "expand_C_N_exp", "expand_C_AP", "expand_C_AN_exp"])
def test_places_of_odd_vectors(agrees, name):
    assert agrees(name, ODD, "vec_id < 40")
