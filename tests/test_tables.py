"""Queries of the catalogue beside their SQL on small tables made for what the given ones lack."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinspark.operators import matching
from kinspark.plans import catalogue


def beside(spark, folder, name, **tables):
    """Rows of the query and of its SQL, both in order, over the tables given as columns."""
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for t, columns in tables.items():
        pq.write_table(pa.table({c: list(v) for c, v in columns.items()}), f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    wanted = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(wanted, key=str)


def test_weighted_signal_mean_of_customers_without_orders(spark, tmp_path):
    customer = {"c_custkey": [1, 2, 3, 4], "c_acctbal": [5000.0, -1.0, 5000.0, -1.0]}
    got, wanted = beside(spark, tmp_path, "weighted_signal_mean", customer=customer, orders={"o_custkey": [1, 1, 2]})
    assert got == wanted
    assert dict(got)[3] == 0.7 and dict(got)[4] == 1.0


@pytest.mark.parametrize("name", ["greedy_assignment", "mutual_best_outcomes", "mutual_best_margin"])
def test_near_balances_do_not_make_all_pairs(spark, tmp_path, monkeypatch, name):
    n, made, band = 120, [], matching.within_band

    def counted(*given):
        found = band(*given)
        made.append(found.count())
        return found

    monkeypatch.setattr(matching, "within_band", counted)
    customer = {"c_custkey": range(n), "c_nationkey": [3] * n, "c_acctbal": [i * 37 % n // 2 * 3.5 for i in range(n)]}
    supplier = {"s_suppkey": range(n), "s_nationkey": [3] * n, "s_acctbal": [i * 29 % n * 4.5 for i in range(n)]}
    got, wanted = beside(spark, tmp_path, name, customer=customer, supplier=supplier)
    assert got == wanted and got
    assert sum(made) <= 16 * 2 * n
