import datetime
import decimal

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same(spark):
    """A query of the contract and its SQL over the same tables: the given frames, or the smallest test tables."""
    import __spark_entry__ as contract

    def plain(value):
        if isinstance(value, float):
            return round(value, 6)
        return str(value) if isinstance(value, (decimal.Decimal, datetime.date, bytearray)) else value

    def compare(name, folder=SF):
        df = contract.queries()[name](spark, folder)
        con = duckdb.connect()
        for table in ("documents", "embeddings", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet(['{folder}/{table}.parquet{'' if folder == SF else '/*.parquet'}'])")
        result = con.execute(contract.oracle_sql()[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in df.columns]
        want = sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())
        assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want
        return len(want)

    return compare
