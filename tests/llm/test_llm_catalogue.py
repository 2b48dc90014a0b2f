"""Every query of the training-text problems runs on the smallest tables, and equals its SQL."""

import duckdb
import pytest

from talliflow.llm import catalogue

COLUMNS = {
    "p1_found": ["target_key"],
    "p2_found": ["kept_id", "copy_id"],
    "p3_found": ["pred_id", "defect"],
    "p7_found": ["pred_id", "target_no", "field", "canonical"],
    "p8_found": ["doc_id"],
    "p9_found": ["source"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    rows = sorted(map(tuple, df.collect()), key=repr)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(rows)) == len(rows)
    if name in catalogue.SQL:
        con = duckdb.connect()
        for t in ("golden", "sample_targets"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        assert rows == sorted(con.execute(catalogue.SQL[name]).fetchall(), key=repr)
