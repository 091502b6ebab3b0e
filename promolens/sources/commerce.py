"""Commerce tables (orders, catalogue, loyalty, vouchers, stock) derived from
the warehouse tables, as fixed by FIXTURES.md §3.

Every table is a projection of one warehouse table (plus a dimension join
where a column needs it), so it scales with the data.  Small dimensions whose
size is bounded by definition (the 25 nations, the 5 regions, the market
segments) are left to AQE's runtime broadcast decision like everything else.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.functions.numeric import measure
from promolens.sources.tables import read_table

# Order status texts of the shop (P = awaiting payment,
# O = being shipped, F = completed).
STATUS = {"P": "Menunggu Pembayaran", "O": "Barang Sedang Dikirim", "F": "Transaksi Selesai"}
WAITING, SHIPPING, DONE = STATUS["P"], STATUS["O"], STATUS["F"]
# Garment sizes of every product.
SIZES = ["S", "M", "L", "XL", "XXL"]
# sales_type labels of the report view.
POS, ONLINE = "POS", "online_sales"
# Fixed value: the "today" of the loyalty and voucher fixtures.
TODAY = dt.date(1998, 3, 20)
PROMO_EPOCH = dt.date(1998, 3, 1)


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _status(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATUS.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


# --- catalogue -----------------------------------------------------------------

def products(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        F.concat(F.lit("SKU"), _lpad(k, 6)).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("normal_price"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("is_disabled"),
        F.split(F.col("p_brand"), "#").getItem(1).cast("int").alias("category_id"),
        F.col("p_type").alias("type_id"),
        F.col("p_size").alias("weight"),
        F.col("p_size").alias("point"),
        (F.col("p_size") * 10).alias("extra_fee"),
        # 1994-01-01 00:00 + k hours, built as wall-clock time (no time zone)
        F.expr("TIMESTAMP_NTZ'1994-01-01 00:00:00' + make_dt_interval("
               "cast(p_partkey div 24 as int), cast(p_partkey % 24 as int), 0, 0)").alias("created_at"),
    )


def categories(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_brand"]).distinct()
    return p.select(F.split(F.col("p_brand"), "#").getItem(1).cast("int").alias("id"),
                    F.col("p_brand").alias("name"))


def types(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_type"]).distinct()
    return p.select(F.col("p_type").alias("id"), F.lower(F.col("p_type")).alias("name"))


def product_media(spark: SparkSession, sf: str) -> DataFrame:
    """Two media per product (sorting 1 and 2) for four products in five;
    every seventh product has videos only."""
    p = read_table(spark, sf, "part", ["p_partkey", "p_name"]).where(F.col("p_partkey") % 5 != 0)
    p = p.withColumn("sorting", F.explode(F.array(F.lit(1), F.lit(2))))
    k = F.col("p_partkey")
    return p.select(
        (k * 10 + F.col("sorting")).alias("id"),
        k.alias("product_id"),
        F.col("sorting"),
        F.when(k % 7 == 0, F.lit("video")).otherwise(F.lit("image")).alias("type"),
        F.concat(F.col("p_name"), F.lit("-"), F.col("sorting").cast("string")).alias("path"),
    )


def product_sizes(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey"])
    p = p.select("p_partkey", F.posexplode(F.array(*[F.lit(s) for s in SIZES])).alias("pos", "size"))
    return p.select((F.col("p_partkey") * 10 + F.col("pos")).alias("id"),
                    F.col("p_partkey").alias("product_id"), "size")


def populars(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey"]).where(F.col("p_partkey") % 50 == 0)
    k = F.col("p_partkey")
    return p.select((k / 50).cast("bigint").alias("id"), k.alias("product_id"),
                    F.when(k % 100 == 0, 0).otherwise(1).alias("is_active"))


# --- customers and places ---------------------------------------------------------

def customer_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One class per market segment, numbered in name order, 5 % steps of
    discount.  The window runs over the distinct segments only."""
    seg = read_table(spark, sf, "customer", ["c_mktsegment"]).distinct()
    rank = F.dense_rank().over(Window.orderBy("c_mktsegment"))
    return seg.select(rank.alias("id"), F.col("c_mktsegment").alias("name"),
                      ((rank - 1) * 5).alias("percent_discount"))


def provinces(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    return r.select(F.col("r_regionkey").alias("ro_province_id"), F.col("r_name").alias("ro_province"))


def cities(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return n.select(F.col("n_nationkey").alias("ro_city_id"), F.col("n_regionkey").alias("ro_province_id"),
                    F.lit("Kota").alias("ro_type"), F.col("n_name").alias("ro_city_name"))


LOOKUP_ROWS = 1000


def lookup(master: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """A master of few values (classes, categories, types, rewards, promotions),
    hinted for broadcast after it was counted: a join with it does not shuffle
    the big side by a key of a handful of values.  Beyond ``rows`` it is
    returned as it is and Spark plans the join."""
    return F.broadcast(master) if master.limit(rows + 1).count() <= rows else master


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    cls = customer_classes(spark, sf).select(F.col("id").alias("customer_class_id"),
                                             F.col("name").alias("c_mktsegment"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(lookup(cls), "c_mktsegment")
    k = F.col("c_custkey")
    return j.select(
        k.alias("id"),
        F.concat(F.lit("C"), _lpad(k, 6)).alias("code"),
        F.col("c_name").alias("name"),
        F.right(F.col("c_name"), F.lit(4)).alias("init"),
        "customer_class_id",
        F.col("n_regionkey").alias("province_id"),
        F.col("c_nationkey").alias("city_id"),
        F.concat(F.lit("08"), _lpad(k, 9)).alias("phone1"),
        F.concat(F.lit("Jalan "), k.cast("string")).alias("address"),
        F.concat(F.lit("BANK"), (k % 4).cast("string")).alias("bank_name"),
        _lpad(k, 10).alias("bank_number"),
    )


def dropshipper_childs(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey"]).where(F.col("c_custkey") % 10 == 0)
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select((F.col("c_custkey") / 10).cast("bigint").alias("id"),
                    F.col("c_custkey").alias("customer_id"),
                    F.concat(F.lit("DS "), F.col("c_name")).alias("name"),
                    F.col("n_regionkey").alias("province_id"),
                    F.col("c_nationkey").alias("city_id"))


# --- orders -------------------------------------------------------------------------

def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                            "o_orderdate"])


def online_sales(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf).where(F.col("o_orderkey") % 2 == 1)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("INV"), _lpad(k, 8)).alias("code"),
        c.alias("customer_id"),
        F.col("o_orderdate").alias("created_at"),
        _status(F.col("o_orderstatus")).alias("status_trans"),
        F.when(k % 10 == 1, 1).otherwise(0).alias("is_cart"),
        F.col("o_totalprice").alias("gross_total"),
        (k % 20).alias("shipment_fee"),
        (k % 15).alias("discount_voucer"),
        F.least(k % 20, k % 7).alias("discount_voucer_ongkir"),
        (c % 5).cast("int").alias("province_id"),
        (c % 25).cast("int").alias("city_id"),
        F.concat(F.lit("08"), _lpad(c, 9)).alias("shipment_phone"),
        F.when(k % 3 == 0, F.concat(F.lit("RW"), ((c % 25) + 1).cast("string"))).alias("voucer_code"),
    )


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Point-of-sale orders (even order keys)."""
    o = _orders(spark, sf).where(F.col("o_orderkey") % 2 == 0)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("POS"), _lpad(k, 8)).alias("code"),
        c.alias("customer_id"),
        F.col("o_orderdate").alias("created_at"),
        _status(F.col("o_orderstatus")).alias("status"),
        (k % 20).alias("shipment_fee"),
        (k % 15).alias("discount"),
        F.when(k % 4 == 0, 1).otherwise(0).alias("is_percent"),
        (c % 5).cast("int").alias("shipment_province"),
        (c % 25).cast("int").alias("shipment_city"),
    )


def _lines(spark: SparkSession, sf: str, cogs: bool = False) -> DataFrame:
    """Order lines; with ``cogs`` the article's cost, which takes a join with ``part``."""
    l = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                           "l_extendedprice"])
    if cogs:
        p = read_table(spark, sf, "part", ["p_partkey", "p_retailprice"])
        l = l.join(p, l.l_partkey == p.p_partkey)
    sizes = F.array(*[F.lit(s) for s in SIZES])
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("sell_price"),
        *([F.col("p_retailprice").alias("cogs")] if cogs else []),
        (F.col("l_linenumber") * 10).alias("point"),
        F.element_at(sizes, ((F.col("l_linenumber") - 1) % 5 + 1).cast("int")).alias("size"),
    )


def placed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """POS and non-cart online orders as one set (SET_SALES_TYPES), in one scan."""
    k = F.col("o_orderkey")
    pos = k % 2 == 0
    return _orders(spark, sf).where(pos | (k % 10 != 1)).select(
        k.alias("id"), F.concat(F.when(pos, F.lit("POS")).otherwise(F.lit("INV")), _lpad(k, 8)).alias("code"),
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("created_at"),
        _status(F.col("o_orderstatus")).alias("status"),
        F.when(pos, F.lit(POS)).otherwise(F.lit(ONLINE)).alias("sales_type"))


def order_lines(spark: SparkSession, sf: str, cogs: bool = False) -> DataFrame:
    """Lines of all orders, by ``order_id``."""
    return _lines(spark, sf, cogs)


def online_sales_details(spark: SparkSession, sf: str) -> DataFrame:
    d = _lines(spark, sf).where(F.col("order_id") % 2 == 1)
    return d.withColumnRenamed("order_id", "online_sales_id")


def sales_details(spark: SparkSession, sf: str, cogs: bool = False) -> DataFrame:
    d = _lines(spark, sf, cogs).where(F.col("order_id") % 2 == 0)
    return d.withColumnRenamed("order_id", "sales_id").withColumn("discount", F.lit(0))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    l = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"])
    l = l.where(F.col("l_returnflag") == "R")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                    F.col("l_partkey").alias("product_id"),
                    F.col("l_orderkey").alias("online_sales_id"),
                    (F.lit(1) + F.col("l_linenumber") % 5).alias("rating"),
                    F.concat(F.lit("ulasan "), F.col("l_linenumber").cast("string")).alias("review"))


# --- stock ----------------------------------------------------------------------------

def stock_movements(spark: SparkSession, sf: str) -> DataFrame:
    """LED_STOCK: receipts (returned-as-'A' lines) positive, each point-of-sale
    line negative (``unionByName`` with a sign flip)."""
    l = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                           "l_discount", "l_returnflag", "l_shipdate"])
    p = read_table(spark, sf, "part", ["p_partkey", "p_retailprice"])
    rec = (l.where(F.col("l_returnflag") == "A").join(p, l.l_partkey == p.p_partkey)
           .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"),
                   F.col("l_partkey").alias("product_id"),
                   F.lit("receiving").alias("type"),
                   (F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("price"),
                   F.col("p_retailprice").alias("normal_price"),
                   F.col("l_quantity").alias("qty"),
                   F.col("l_shipdate").alias("created_at")))
    s = sales(spark, sf).select(F.col("id").alias("sales_id"), "created_at")
    d = sales_details(spark, sf, cogs=True)
    out = (d.join(s, "sales_id")
           .select(F.col("id").alias("ref_id"), "product_id", F.lit("sales-in-store").alias("type"),
                   F.col("sell_price").alias("price"), F.col("cogs").alias("normal_price"),
                   (-F.col("qty")).alias("qty"), "created_at"))
    return rec.unionByName(out)


# --- loyalty and vouchers ---------------------------------------------------------------

def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    """Point movements from the event stream: signup +500, click (a review)
    +50, purchase +value, error (a redeem) -value; views carry no points."""
    e = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    e = e.where(F.col("event_type") != "view")
    v = F.floor(F.col("value")).cast("bigint")
    et = F.col("event_type")
    point = (F.when(et == "signup", F.lit(500).cast("bigint")).when(et == "click", F.lit(50).cast("bigint"))
             .when(et == "purchase", v).when(et == "error", -v))
    info = (F.when(et == "signup", F.lit("registrasi")).when(et == "click", F.lit("ulasan"))
            .when(et == "purchase", F.lit("belanja")).when(et == "error", F.lit("redeem")))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("customer_id"),
                    info.alias("info"), point.alias("point"), F.col("ts").alias("created_at"))


def promotions(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders", ["o_orderpriority"]).distinct()
    pid = F.substring(F.col("o_orderpriority"), 1, 1).cast("int")
    start = F.date_add(F.lit(PROMO_EPOCH), (pid - 1) * 5)
    return o.select(pid.alias("id"), F.col("o_orderpriority").alias("name"),
                    start.alias("start_date"), F.date_add(start, 14).alias("end_date"))


def rewards(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "part", ["p_brand"]).distinct()
    rid = F.split(F.col("p_brand"), "#").getItem(1).cast("int")
    return b.select(rid.alias("id"), ((rid % 5) + 1).alias("promotion_id"),
                    F.concat(F.lit("Reward "), F.col("p_brand")).alias("name"),
                    (rid * 100).alias("point"), (rid * 1000).alias("value"),
                    F.when(rid % 2 == 0, F.lit("voucher")).otherwise(F.lit("discount")).alias("type"),
                    F.concat(F.lit("RW"), rid.cast("string")).alias("voucer_code"))


def customer_voucers(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    rid = ((k % 25) + 1).cast("int")
    start = F.date_add(F.lit(PROMO_EPOCH), (k % 30).cast("int"))
    return c.select(k.alias("id"), k.alias("customer_id"), rid.alias("reward_id"),
                    F.concat(F.lit("RW"), rid.cast("string")).alias("voucer_code"),
                    start.alias("start_date"), F.date_add(start, 20).alias("end_date"),
                    F.when(k % 3 != 0, 1).otherwise(0).alias("is_active"),
                    F.when(k % 4 == 0, 1).otherwise(0).alias("is_redeem"))


def voucer_members(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    return c.select(k.alias("id"), k.alias("customer_id"),
                    F.concat(F.lit("VM"), (k % 10).cast("string")).alias("voucer_code"),
                    F.when(k % 2 == 0, 1).otherwise(0).alias("is_active"),
                    ((k % 4) * 5).cast("int").alias("percent_discount"),
                    F.lit(10000).alias("max_amount"))


def line_amount(qty: str = "qty", price: str = "sell_price") -> Column:
    """qty x price of one order line as an exact decimal measure."""
    return measure(F.col(qty) * F.col(price))
