"""The driver's star schema as the canonical tables that operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

POOLED_EACH = 97


class Star:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def txn(self, donor: bool = False, filer: bool = False, part: bool = False) -> DataFrame:
        """Line items as transactions. Donor, committee and element names are joined only where asked for."""
        line, orders = self.table("lineitem"), self.table("orders")
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        kind = F.when(flag == "N", "C").when(flag == "R", "OD").otherwise("E")
        sub = F.when(flag == "R", V.REFUND).when(flag == "A", "Cash Expenditure").when(status == "O", "Cash Contribution").otherwise("In-Kind Contribution")
        columns: dict[str, Column] = {
            "tran_id": F.col("l_orderkey") * 8 + F.col("l_linenumber"),
            "order_key": F.col("l_orderkey"),
            "line": F.col("l_linenumber"),
            "part_key": F.col("l_partkey"),
            "quantity": F.col("l_quantity"),
            "filer_id": F.col("l_suppkey"),
            "donor_id": F.col("o_custkey").cast("string"),
            "tran_date": F.col("l_shipdate").cast("date"),
            "filed_date": F.col("o_orderdate").cast("date"),
            "amount": F.col("l_extendedprice").cast("decimal(18,2)"),
            "tran_type": kind,
            "sub_type": sub,
            "priority": F.col("o_orderpriority"),
            "order_status": F.col("o_orderstatus"),
        }
        rows = line.join(orders, line.l_orderkey == orders.o_orderkey)
        if donor:
            rows = rows.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            pooled = F.when(flag == "R", F.lit(V.POOLED_REFUND)).otherwise(F.lit("  miscellaneous cash contributions $100  and under "))
            columns["contributor_payee"] = F.when(F.col("c_custkey") % POOLED_EACH == 0, pooled).otherwise(F.col("c_name"))
            columns["book_type"] = F.col("c_mktsegment")
            columns["donor_nation"] = F.col("c_nationkey")
        if filer:
            rows = rows.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            columns["filer"] = F.col("s_name")
            columns["filer_nation"] = F.col("s_nationkey")
        if donor and filer:
            columns["outside"] = F.col("c_nationkey") != F.col("s_nationkey")
        if part:
            rows = rows.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            columns["part_name"] = F.col("p_name")
            columns["brand"] = F.col("p_brand")
        return rows.select(*[c.alias(n) for n, c in columns.items()])


TXN = f"""txn AS (
  SELECT l_orderkey * 8 + l_linenumber AS tran_id, l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key, l_quantity AS quantity,
         l_suppkey AS filer_id, CAST(o_custkey AS VARCHAR) AS donor_id, CAST(l_shipdate AS DATE) AS tran_date, CAST(o_orderdate AS DATE) AS filed_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CASE l_returnflag WHEN 'N' THEN 'C' WHEN 'R' THEN 'OD' ELSE 'E' END AS tran_type,
         CASE WHEN l_returnflag = 'R' THEN '{V.REFUND}' WHEN l_returnflag = 'A' THEN 'Cash Expenditure'
              WHEN l_linestatus = 'O' THEN 'Cash Contribution' ELSE 'In-Kind Contribution' END AS sub_type,
         o_orderpriority AS priority, o_orderstatus AS order_status,
         CASE WHEN c_custkey % {POOLED_EACH} = 0 THEN '{V.POOLED}' ELSE c_name END AS label, c_name,
         CASE WHEN c_custkey % {POOLED_EACH} = 0 THEN 'label:{V.POOLED}' ELSE CAST(o_custkey AS VARCHAR) END AS donor_key,
         c_custkey % {POOLED_EACH} = 0 AS pooled, c_mktsegment AS book_type, s_name AS filer, c_nationkey <> s_nationkey AS outside,
         c_nationkey, s_nationkey, p_name AS part_name, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
MONEY = "DECIMAL(18,2)"
NETTED = f"""{TXN}, net AS (
  SELECT filer_id, tran_date, donor_key, donor_id, label, pooled,
         CASE WHEN tran_type = 'C' THEN amount ELSE -amount END AS amount, CASE WHEN tran_type = 'C' THEN 1 ELSE 0 END AS gift
  FROM txn WHERE (tran_type = 'C' AND sub_type = 'Cash Contribution') OR tran_type = 'OD')"""
