"""Column lists and schemas of the promotion data model.

Suffix convention of the joined facts (kept from the source application):
``_x`` = last year (sales side), ``_y`` = this year (promotion side).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Money and quantities are carried as DECIMAL(18,6): sums are then exact and
# independent of the order in which partitions are combined.
MEASURE_TYPE = T.DecimalType(18, 6)
# Fact measures are sums of row measures: 22 integer digits, never narrowed.
FACT_TYPE = T.DecimalType(28, 6)

# --- raw feeds --------------------------------------------------------------

# The 32 positional column names of the headerless daily sales
# file, in file order.
RAW_SALES_COLUMNS = [
    "KODE_SITE", "NAMA_SITE", "KODE_STORE", "INIT_STORE", "BDATE", "MERDIV",
    "MERDIVDESC", "MERCAT", "MERCATDESC", "MERSCAT", "MERSCATDESC",
    "MERCLASS", "MERCLASSDESC", "MERSCLASS", "MERSCLASSDESC", "TYPE_SKU",
    "STATUS_SKU", "STOCK_UNIT", "SKU", "SKU_DESC", "TILLCODE", "SV", "TAG",
    "BRAND", "PRINCIPLE", "QTY", "SALES", "COGS", "PPN", "NETSALES",
    "PROFIT", "MARGIN",
]
# the 16 of them that are used
RAW_SALES_USED = [
    "NAMA_SITE", "KODE_STORE", "BDATE", "MERDIV", "MERDIVDESC", "MERCAT",
    "MERCATDESC", "SKU", "SKU_DESC", "BRAND", "PRINCIPLE", "QTY", "COGS",
    "NETSALES", "PROFIT", "MARGIN",
]
# columns taken from the (header-carrying) promotion file
RAW_PROMO_USED = [
    "nama_site", "kode_store", "bdate", "merdiv", "merdivdesc", "mercat",
    "mercatdesc", "sku", "sku_desc", "brand", "principle", "rulecode",
    "ruletype", "member", "qty", "cogs", "netsales", "profit", "tqty", "tamt",
    "tag",
]

RAW_SALES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_SALES_COLUMNS])
RAW_PROMO_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_PROMO_USED])

# --- cleaned tables ---------------------------------------------------------

DESCRIPTORS = ["merdiv", "merdivdesc", "mercat", "mercatdesc", "sku_desc", "brand", "principle"]

# last-year article grain (11 keys)
SALES_KEYS = ["nama_site", "kode_store", "bdate", "merdiv", "merdivdesc", "mercat",
              "mercatdesc", "sku", "sku_desc", "brand", "principle"]
SALES_MEASURES = ["qty", "cogs", "netsales", "profit"]

# this-year promotion grain (14 keys)
PROMO_KEYS = SALES_KEYS + ["rulecode", "ruletype", "tag"]
PROMO_MEASURES = ["qty", "cogs", "netsales", "profit", "tqty", "tamt",
                  "tnetsales", "tcogs", "tprofit"]

# promotion measures that need a positive value
PROMO_POSITIVE = ["qty", "cogs", "netsales", "profit", "tqty", "tamt"]

# --- facts ------------------------------------------------------------------

ARTICLE_FACT_KEYS = ["bdate_y", "kode_store", "nama_site", "sku", "sku_desc_y", "merdiv_y",
                     "merdivdesc_y", "mercat_y", "mercatdesc_y", "brand_y", "principle_y",
                     "tag", "rulecode", "ruletype"]
CATEGORY_FACT_KEYS = ["bdate_y", "kode_store", "nama_site", "mercat_y", "mercatdesc_y",
                      "rulecode", "ruletype"]
FACT_MEASURES = ["qty_x", "cogs_x", "netsales_x", "profit_x",
                 "qty_y", "cogs_y", "netsales_y", "profit_y",
                 "tqty", "tnetsales", "tcogs", "tprofit"]

ARTICLE_FACT_COLUMNS = (
    ["bdate_y", "kode_store", "nama_site", "sku", "sku_desc_y", "merdiv_y", "merdivdesc_y",
     "mercat_y", "mercatdesc_y", "brand_y", "principle_y", "tag"]
    + FACT_MEASURES + ["rulecode", "ruletype"]
)
CATEGORY_FACT_COLUMNS = CATEGORY_FACT_KEYS + FACT_MEASURES

# sums of article facts
CATEGORY_FACT_SCHEMA = T.StructType(
    [T.StructField("bdate_y", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in CATEGORY_FACT_KEYS[1:]]
    + [T.StructField(c, T.DecimalType(38, 6)) for c in FACT_MEASURES])

# Schema of the written article facts (SRC_CLEAN re-reads it with types).
ARTICLE_FACT_SCHEMA = T.StructType(
    [T.StructField("bdate_y", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in ARTICLE_FACT_COLUMNS[1:12]]
    + [T.StructField(c, FACT_TYPE) for c in FACT_MEASURES]
    + [T.StructField("rulecode", T.StringType()), T.StructField("ruletype", T.StringType())]
)
