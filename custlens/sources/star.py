"""Invoice lines derived from the star-schema test tables.

The rules plant every kind of dirt the cleaning steps handle: missing
customers, zero prices and quantities, cancellations, administrative codes,
exact copies, spelling variants and extreme quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def raw_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """All lines with what the rules make of them.

    Lines are shuffled twice: by part with the few numbers that the rules need, then by invoice. Orders meet their customers
    before, once per order, and come under both numbers an invoice may have. The result is thus dealt by ``invoice``, and
    what groups by it needs no further shuffle.
    """
    line, nation = table(spark, folder, "lineitem"), table(spark, folder, "nation")  # 25 nations at every scale
    name, order_key = F.col("p_name"), F.col("l_orderkey")
    # Texts that depend on the part alone are made once per part.
    part = table(spark, folder, "part").select(
        "p_partkey", "p_name",
        F.concat(
            F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 2, "0"),
            F.lpad(F.col("p_partkey").cast("string"), 6, "0"),
        ).alias("code"),
    )
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    qty = F.col("l_quantity")
    numbers = line.select(
        "l_orderkey", "l_partkey", "l_linenumber", (F.col("l_suppkey") % 50).alias("supplier"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("cancelled"),
        F.when(order_key % 1000 == 7, qty * 1000)
        .when((F.col("l_linenumber") == 7) & (order_key % 10 == 1), 0.0)
        .when(returned & (F.col("l_partkey") % 4 != 0), -qty).otherwise(qty).alias("quantity"),
        F.when(F.col("l_partkey") % 97 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("price"),
    )
    supplier, line_no = F.col("supplier"), F.col("l_linenumber")
    lines = numbers.join(part, F.col("l_partkey") == part.p_partkey).select(
        F.concat(F.when(F.col("cancelled"), "C").otherwise(""), order_key.cast("string")).alias("invoice"),
        F.when(supplier == 0, "POST").when(supplier == 1, "BANK CHARGES")
        .when(supplier == 2, "m ").otherwise(F.col("code")).alias("stock_code"),
        F.when(line_no == 5, "").when(line_no == 2, F.concat(name, F.lit(" v2")))
        .when(line_no == 3, F.concat(F.lit("  "), F.upper(name))).otherwise(name).alias("description"),
        "quantity", "price", F.coalesce(line_no == 7, F.lit(False)).alias("at_home"),
    )
    customer = table(spark, folder, "customer").join(
        F.broadcast(nation), F.col("c_nationkey") == nation.n_nationkey
    ).select("c_custkey", F.when(F.col("n_nationkey") == 0, "United Kingdom").otherwise(F.col("n_name")).alias("home"))
    order_no = F.col("o_orderkey").cast("string")
    orders = table(spark, folder, "orders").join(customer, F.col("o_custkey") == customer.c_custkey).select(
        F.explode(F.array(order_no, F.concat(F.lit("C"), order_no))).alias("order_invoice"),
        F.col("o_orderdate").alias("invoice_date"),
        F.when(F.col("o_orderkey") % 20 != 0, F.col("o_custkey")).alias("customer_id"), "home",
        F.when(F.col("o_orderkey") % 25 == 3, 2).otherwise(1).alias("copies"),
    )
    return lines.join(orders, F.col("invoice") == orders.order_invoice).select(
        "invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id",
        F.when(F.col("at_home"), "United Kingdom").otherwise(F.col("home")).alias("country"),
        F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
