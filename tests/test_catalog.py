"""Every query of the catalog that has SQL against it in DuckDB, on the smallest tables; test_catalog_brute.py holds the others."""

import collections
import glob
import os

import duckdb
import pandas as pd
import pytest

from braggframe import catalog, catalog_edits, catalog_records  # noqa: F401
from braggframe.sources import pdb_records

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(frame):
    cell = lambda x: "null" if pd.isna(x) else f"{float(x):.5g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_query(spark, sql, name):
    assert plain(catalog.queries()[name](spark, SF).toPandas()) == plain(sql.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["pdb_database_references", "pdb_bonds", "pdb_tensors", "pdb_links"])
def test_records_of_numbers_wider_than_their_columns(spark, tmp_path, name):
    """Sequence numbers beyond 9999 and serial numbers beyond 99999 are spelt and read in hybrid-36."""
    keys = [*range(9940, 10010), *range(19930, 20000), *range(99930, 100010)]
    part = pd.DataFrame({"p_partkey": keys, "p_brand": [f"Brand#{k % 25}" for k in keys], "p_type": "LARGE", "p_size": pd.Series([k % 50 + 1 for k in keys], dtype="int32")})
    part.to_parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    assert plain(catalog.queries()[name](spark, str(tmp_path)).toPandas()) == plain(c.sql(catalog.oracle_sql()[name]).df())


def wide_part(folder):
    """Keys beyond what the columns of PDB records hold, up to those of 32 bits; some twice."""
    keys = [0, 1, 99999, *range(99990, 100020), 1199999, *range(9999990, 10000010), *range(39999960, 40000020), 79999990, 87440031, 87440032, *range(119999980, 120000010), 2**31 - 99, 2**31 - 60]
    part = pd.DataFrame({"p_partkey": keys, "p_brand": [f"Brand#{k % 25}" for k in keys], "p_type": "LARGE", "p_size": pd.Series([i % 50 + 1 for i in range(len(keys))], dtype="int32")})
    part.to_parquet(f"{folder}/part.parquet")
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{folder}/part.parquet'")
    return part, c


def test_bonds_of_the_whole_table(spark, tmp_path):
    """Every part has its two bonds, by the SQL too."""
    part, c = wide_part(tmp_path)
    got = catalog.queries()["pdb_bonds"](spark, str(tmp_path))
    want = collections.Counter(tuple(sorted((k, x))) for k, s in zip(part.p_partkey.tolist(), part.p_size.tolist(), strict=True) for x in (k + s, s))
    assert {(r.a, r.b): r.n for r in got.collect()} == want and dict(got.dtypes) == {"a": "int", "b": "int", "n": "bigint"}
    assert plain(got.toPandas()) == plain(c.sql(catalog.oracle_sql()["pdb_bonds"]).df())


def test_database_references_of_the_whole_table(spark, tmp_path):
    """Every part has its row, with accession codes of ten letters too."""
    part, c = wide_part(tmp_path)
    got = catalog.queries()["pdb_database_references"](spark, str(tmp_path))
    want = sorted((f"P{k}", k % 9999, k % 9999 + s, s) for k, s in zip(part.p_partkey.tolist(), part.p_size.tolist(), strict=True))
    assert sorted((r.accession, r.first, r.last, r.db_first) for r in got.collect()) == want
    assert plain(got.toPandas()) == plain(c.sql(catalog.oracle_sql()["pdb_database_references"]).df())


def test_database_references_of_two_lines(spark):
    text = ["DBREF  2JHQ A    1   226  UNP    Q9KPK8   UNG_VIBCH        1    226", "DBREF1 1ABC A   61   322  GB                   AE017221", "DBREF2 1ABC A     46197919                      1534489     1537377", "DBREF1 1ABC B    1    20  GB                   X", "TER"]
    got = pdb_records.database_references(spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "path string, line_no long, line string")).orderBy("line_no").collect()
    assert [(r.line_no, r.chain, r.first, r.last, r.database, r.accession, r.code, r.db_first, r.db_last) for r in got] == [(0, "A", 1, 226, "UNP", "Q9KPK8", "UNG_VIBCH", 1, 226), (1, "A", 61, 322, "GB", "46197919", "AE017221", 1534489, 1537377), (3, "B", 1, 20, "GB", "", "X", None, None)]
