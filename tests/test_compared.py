"""Counts of equal fields against their SQL where there are no rows."""

import duckdb
from ledgerwright.plans import oracles
from ledgerwright.plans import workload as Q


def test_fields_of_an_empty_table_are_counted_as_their_sql_does(spark, tmp_path):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier"):
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet' LIMIT 0) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(con.execute(oracles.ORACLES["field_extract"]).fetchall())
    assert len(want) == 11 and sorted(map(tuple, Q.q_field_extract(spark, str(tmp_path)).collect())) == want
