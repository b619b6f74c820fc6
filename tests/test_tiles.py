"""Searches over many equal vectors, and how their work is spread."""

import duckdb
import pytest

from lodestrata.operators import tiles
from lodestrata.plans import catalog

from comparison import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """15 of each of 40 vectors: neighbours are copies at the same distance, told apart by id alone."""
    folder = tmp_path_factory.mktemp("copies")
    duckdb.connect().execute(f"COPY (SELECT e.* REPLACE (vec_id + i * 40 AS vec_id) FROM '{SF}/embeddings.parquet' e, range(15) r(i) WHERE vec_id < 40) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["nn_topk", "nn_precision", "nn_precision_levels", "mean_rank_map"])
def test_copies(spark, copies, name):
    sql = catalog.ORACLES[name]
    if name == "nn_topk":  # a rounded -2e-16 is no different distance
        sql = f"SELECT * REPLACE (distance + 0.0 AS distance) FROM ({sql})"
    same(catalog.QUERIES[name](spark, copies), duck(copies), sql)


@pytest.mark.parametrize("lost", ["NULL", "embedding"])
def test_precision_over_the_whole_table(spark, tmp_path, lost):
    """Classes of fewer than five, vectors without a label and (NULL) without numbers are searched and found like any others."""
    duckdb.connect().execute(f"COPY (SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN {lost} ELSE embedding END AS embedding, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 1000 + vec_id // 8 ELSE label END AS label FROM '{SF}/embeddings.parquet' WHERE vec_id < 200) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    same(catalog.QUERIES["nn_precision"](spark, str(tmp_path)), duck(str(tmp_path)), catalog.ORACLES["nn_precision"])


def test_each_vector_is_sent_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(tiles, "GROUPS", 3)
    monkeypatch.setattr(tiles, "LEAST", 5)
    for n in (30, 60):
        chunks = tiles.packed(spark.range(n), "id", lambda part: {"id": part.column("id").to_numpy()})
        assert chunks.count() == 3
