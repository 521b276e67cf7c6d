"""Queries of blocks against their SQL on tables whose rows are no whole blocks."""

import duckdb
import numpy as np
import pytest

from driftline import queries
from tests.test_queries import SF, sorted_rows


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The vectors less 13 of them: 487, no multiple of 50, 10 or 4."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 487) TO '{folder}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


def agrees(spark, odd, name):
    folder, con = odd
    a, b = sorted_rows(queries.QUERIES[name](spark, folder).toPandas()), sorted_rows(con.execute(queries.ORACLES[name]).df())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    return np.allclose(np.array(a[1]), np.array(b[1]), atol=2e-3, rtol=1e-9)


@pytest.mark.parametrize("name", ["moments_serial", "moments_mixed", "moments_serial_regression", "moments_compact_classes", "typical_delta_of_blocks", "graph_serial", "graph_mixed", "graph_improved", "graph_compact_classes"])
def test_equals_sql_without_whole_blocks(spark, odd, name):
    assert agrees(spark, odd, name)


def test_all_responses_of_a_chain(spark, odd):
    """All 487 of the graph of 48 whole blocks and 7 samples that are tied to none."""
    assert agrees(spark, odd, "graph_responses")
    assert queries.QUERIES["graph_responses"](spark, odd[0]).count() == 487


def test_spectrum_of_a_chain_of_classes(spark):
    """Classes of unlike sizes and weights, one with edges to itself: the dense matrix's eigenvalues."""
    from driftline.operators import graphs as G
    from driftline.operators import spectra as SP

    of, v = [0, 0, 0, 1, 1, 2, 2, 2, 2, 3], [1.0, 2.0, 0.5, 3.0]
    w = {(0, 1): 1.5, (1, 2): 0.25, (2, 3): 2.0, (1, 1): -0.75}
    edges = [(i, j, w[of[i], of[j]]) for i in range(10) for j in range(10) if (of[i], of[j]) in w]
    nodes = spark.createDataFrame([(i, v[c]) for i, c in enumerate(of)], "sample_id long, v double")
    graph = spark.createDataFrame(edges, "src long, dst long, w double")
    want = G.eigenvectors(nodes, graph)[0]
    got = sorted((r["k"], r["value"]) for r in SP.chain_spectrum(nodes, graph).collect())
    assert [k for k, _ in got] == list(range(10)) and np.allclose([x for _, x in got], want, atol=1e-12)
    with pytest.raises(ValueError, match="no chain"):
        SP.chain_spectrum(nodes, graph.union(spark.createDataFrame([(0, 9, 1.0)], "src long, dst long, w double")))
