"""Queries over images that lack vectors or components, against their SQL."""

import duckdb
import pyarrow.parquet as pq
import pytest

from coordex.plans.registry import ORACLES, QUERIES

from .test_core_queries import DATA, rows

NAMES = ["assign_match", "correct_electrodes", "extract_positions", "greedy_match", "hub_valid", "positions_extracted", "positions_long"]


@pytest.fixture(scope="module", params=[1, 2, 3, "gaps", "nulls"])
def tables(request, tmp_path_factory):
    """The last image has 1, 2 or 3 vectors; any vector may be missing; some are null."""
    d = str(tmp_path_factory.mktemp("partial"))
    where = {"gaps": "hash(vec_id) % 3 > 0", "nulls": "true"}.get(request.param, f"vec_id < 80 + {request.param}")
    vector = "embedding"
    if request.param == "nulls":
        vector = "CASE WHEN vec_id % 11 = 3 THEN NULL WHEN vec_id % 11 = 6 THEN [NULL]::FLOAT[] || embedding[2:] ELSE embedding END"
    con = duckdb.connect()
    con.sql(f"copy (select vec_id, {vector} as embedding, label from '{DATA}/embeddings.parquet' where {where}) to '{d}/embeddings.parquet' (format parquet)")
    con.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert pq.ParquetFile(f"{d}/embeddings.parquet").metadata.num_rows % 4 or request.param == "nulls"
    return d, con


@pytest.mark.parametrize("name", NAMES)
def test_partial_images(spark, tables, name):
    d, con = tables
    assert rows(QUERIES[name](spark, d).toPandas()) == rows(con.sql(ORACLES[name]).df())
