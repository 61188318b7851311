"""Registered queries beside their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cdcflow.llm import catalog
from tools.check_oracles import rows_of

FOLDER = "/root/testdata/sf0.001"


def test_each_operator_has_its_query():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = catalog.QUERIES[name](spark, FOLDER)
    result = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
