"""q_interval_lookup gives its SQL's rows on orders with nulls, repeated keys, customers without rows and hot customers."""

import datetime as dt

import duckdb
import numpy as np
import pytest

from sextant.operators import joins
from sextant.plans import catalog


def rows_of_both(spark, where):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{where}/orders.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["q_interval_lookup"]).fetchall()
    return sorted(map(tuple, catalog.QUERIES["q_interval_lookup"](spark, where).collect()), key=str), sorted(want, key=str)


def write(spark, rows, where):
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string").write.parquet(f"{where}/orders.parquet")


def test_customers_without_rows_are_in_range(spark, tmp_path):
    at = dt.datetime(2001, 4, 18)
    write(spark, [(1, 7, at, "P"), (2, 7, None, "P"), (3, None, at, "F"), (4, 8, at, "F")], tmp_path)
    got, want = rows_of_both(spark, str(tmp_path))
    assert got == want and sum(x[3] is None and x[4] for x in got) == 3


@pytest.mark.parametrize("few", [0, 64])
def test_odd_orders(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_INTERVALS", few)
    r = np.random.default_rng(8)
    rows = []
    for key in range(600):
        customer = None if key % 97 == 5 else 9 if key % 3 == 1 else int(r.integers(0, 40))
        at = None if key % 11 == 0 else dt.datetime(1992, 1, 1, 13) + dt.timedelta(int(r.integers(0, 2500)))
        rows.append((key, customer, at, "P" if customer in (3, 4) else str(r.choice(list("FOP"))) if key % 50 else None))
    rows += [(k, 40 + i, dt.datetime(1999, 1, 1) + dt.timedelta(i), s) for i, (k, s) in enumerate([(10, "F"), (10, "O"), (11, "P"), (12, "F"), (None, "F"), (None, "P")])]
    rows += [(None, 9, dt.datetime(1995, 5, 5), "F"), (20, 50, dt.datetime(1, 1, 1), "F"), (700, 50, dt.datetime(1, 1, 2), "P"), (701, 50, dt.datetime(9999, 12, 31), "P")]
    write(spark, rows, tmp_path)
    got, want = rows_of_both(spark, str(tmp_path))
    assert got == want


def test_days_before_the_first_year(spark):
    at = lambda days: f"date_add(date'0001-01-01', {days})"
    left = spark.sql(f"SELECT 1 AS g, 1 AS id, {at(-900000)} AS day UNION ALL SELECT 1, 2, {at(-1000)} UNION ALL SELECT 1, 3, {at(60000000)}")
    right = spark.sql(f"SELECT 1 AS g, {at(-500000)} AS s, {at(-2000)} AS e, 1 AS k UNION ALL SELECT 1, {at(-900000)}, {at(-800000)}, 2 UNION ALL SELECT 1, {at(50000000)}, NULL, 3")
    got = joins.interval_lookup(left, right, ["g"], "day", "s", "e", right.k, ["k"])
    assert sorted(tuple(x) for x in got.select("id", "k", "in_range").collect()) == [(1, 2, True), (2, 1, False), (3, 3, True)]
