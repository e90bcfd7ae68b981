"""Split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake.operators import split as X
from doselake.plans.catalog import query
from doselake.plans.standins import Tables


def _parts(n: str, rn: str = "rn", test: str = "0.2", val: str = "0.1") -> str:
    """Part of a row from its rank among ``n``."""
    a = f"ceil({n} * {test}::DOUBLE)"
    return (f"CASE WHEN {rn} <= {a} THEN 'test' WHEN {rn} <= {a} + ceil(({n} - {a}) * ({val}::DOUBLE / (1 - {test}::DOUBLE))) "
            "THEN 'val' ELSE 'train' END AS split")


@query(f"""
SELECT o_orderkey, {_parts('n')} FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)""")
def split_random(t: Tables) -> DataFrame:
    return X.split_random(t.raw("orders").select("o_orderkey"), "o_orderkey")


@query(f"""
SELECT o_orderkey, split FROM orders JOIN (
  SELECT o_custkey, {_parts('n')} FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey)) AS rn,
    count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))) USING (o_custkey)""")
def split_group(t: Tables) -> DataFrame:
    return X.split_group(t.raw("orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "split")


def _stratified(n: str) -> str:
    a = f"floor({n} * 0.2::DOUBLE + 0.5)"
    return (f"CASE WHEN rn <= {a} THEN 'test' WHEN rn <= {a} + floor(({n} - {a}) * (0.1::DOUBLE / 0.8::DOUBLE) + 0.5) "
            "THEN 'val' ELSE 'train' END AS split")


@query(f"""
SELECT o_orderkey, {_stratified('n')} FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey)) AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def split_stratified(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey", "o_orderpriority")
    return X.split_stratified(o, "o_orderkey", "o_orderpriority").select("o_orderkey", "split")


@query(f"""
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM orders),
b AS (SELECT o_orderkey, greatest(len(list_filter(q, lambda v: v < o_totalprice)) - 1, 0) AS bin FROM orders, e)
SELECT o_orderkey, {_stratified('n')} FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || o_orderkey)) AS rn,
    count(*) OVER (PARTITION BY bin) AS n FROM b)""")
def split_stratified_numeric(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey", "o_totalprice")
    return X.split_stratified(o, "o_orderkey", "o_totalprice").select("o_orderkey", "split")


@query(f"""
SELECT o_orderkey, {_parts('n', test='0.1', val='0.2')} FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)""")
def split_ratio(t: Tables) -> DataFrame:
    return X.split_ratio(t.raw("orders").select("o_orderkey"), "o_orderkey", 0.7, 0.2, 0.1, seed=7)


@query("SELECT o_orderkey, ntile(5) OVER (ORDER BY md5('42:' || o_orderkey)) - 1 AS fold FROM orders", ints=("fold",))
def kfold(t: Tables) -> DataFrame:
    return X.kfold(t.raw("orders").select("o_orderkey"), "o_orderkey", 5)


@query("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey)) - 1 AS fold FROM orders", ints=("fold",))
def kfold_stratified(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey", "o_orderstatus")
    return X.kfold(o, "o_orderkey", 4, stratum="o_orderstatus").select("o_orderkey", "fold")


@query(f"""
SELECT o_orderkey, run, {_parts('n')} FROM (
  SELECT o_orderkey, run, row_number() OVER (PARTITION BY run ORDER BY md5((42 + run) || ':' || o_orderkey)) AS rn,
    count(*) OVER (PARTITION BY run) AS n FROM orders, (SELECT unnest(range(3)) AS run))""", ints=("run",))
def repeated_splits(t: Tables) -> DataFrame:
    return X.repeated_splits(t.raw("orders").select("o_orderkey"), "o_orderkey", 3)


@query(f"""
SELECT sig_id, run, split FROM order_rows JOIN (
  SELECT cell, run, {_parts('n')} FROM (
    SELECT cell, run, row_number() OVER (PARTITION BY run ORDER BY md5((42 + run) || ':' || cell)) AS rn,
      count(*) OVER (PARTITION BY run) AS n FROM (SELECT DISTINCT cell FROM order_rows), (SELECT unnest(range(3)) AS run))) USING (cell)""", ints=("run",))
def repeated_splits_group(t: Tables) -> DataFrame:
    return X.repeated_splits(t.order_rows.select("sig_id", "cell"), "sig_id", 3, group="cell").select("sig_id", "run", "split")


@query(f"""
SELECT sig_id, split FROM siginfo JOIN (
  SELECT cell_mfc_name, {_parts('n')} FROM (SELECT cell_mfc_name, row_number() OVER (ORDER BY md5('42:' || cell_mfc_name)) AS rn,
    count(*) OVER () AS n FROM (SELECT DISTINCT cell_mfc_name FROM siginfo))) USING (cell_mfc_name)""")
def split_with_roles(t: Tables) -> DataFrame:
    s = t.siginfo.select("sig_id", "cell_mfc_name", "pert_dose")
    return X.split_with_roles(s, "sig_id", stratify_by="pert_dose").select("sig_id", "split")


@query("SELECT sig_id, x, y FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || sig_id)) AS rn FROM order_rows) WHERE rn <= 500")
def sample_rows(t: Tables) -> DataFrame:
    from doselake.sources.tables import sample_rows as draw

    return draw(t.order_rows.select("sig_id", "x", "y"), 500, "sig_id")
