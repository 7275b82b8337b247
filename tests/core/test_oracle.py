import glob
import math
import os

import duckdb
import pytest

from fieldloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_same_rows(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    result = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == want
