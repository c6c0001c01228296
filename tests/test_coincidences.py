"""Rules that hold by chance in generated documents: queries and their SQL say the same of them."""

from datetime import datetime

import duckdb
import pytest

from ledgerproof import queries

#: (customer, order, total): multiples of Each in all rows (1708, 5766), order numbers that are Units times Each (82506), nearly Each over Units (2808, 14436), and plain ones.
ORDERS = [
    (1708, 1763, 130017.72), (1708, 111167, 37567.09), (1708, 129908, 433188.62),
    (82506, 772820, 338112.45), (82506, 780151, 291032.60), (82506, 855625, 447824.13),
    (2808, 63405, 135309.24), (2808, 67500, 379361.01), (2808, 122731, 381871.58),
    (14436, 11946, 316273.94), (14436, 61353, 288710.62), (14436, 147891, 378475.72),
    (7, 11, 500.25), (7, 12, 700.50), (7, 14, 900.75), (9, 21, 100.00), (10, 31, 300.10), (10, 33, 400.20),
]


@pytest.mark.parametrize("name", ["infer_leads", "infer_write", "corpus_report"])
def test_chance_rules(spark, tmp_path, name):
    rows = [(o, c, "O", t, datetime(2024, 1, 1), "1-URGENT") for c, o, t in ORDERS]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
