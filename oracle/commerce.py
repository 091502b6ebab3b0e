"""Oracle SQL of the commerce queries."""

from oracle.ctes import r2, ratio, with_

ST = ("CASE o_orderstatus WHEN 'P' THEN 'Menunggu Pembayaran' WHEN 'O' THEN 'Barang Sedang Dikirim' "
      "WHEN 'F' THEN 'Transaksi Selesai' END")
SIZES = "['S', 'M', 'L', 'XL', 'XXL']"

T = {
    "products": """products AS (
  SELECT p_partkey AS id, 'SKU' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS sku, p_name AS name,
    p_retailprice AS normal_price, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS is_disabled,
    CAST(split_part(p_brand, '#', 2) AS INTEGER) AS category_id, p_type AS type_id,
    p_size AS weight, p_size AS point, p_size * 10 AS extra_fee,
    TIMESTAMP '1994-01-01 00:00:00' + to_hours(p_partkey) AS created_at
  FROM part)""",
    "categories": """categories AS (
  SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INTEGER) AS id, p_brand AS name FROM part)""",
    "types": "types AS (SELECT DISTINCT p_type AS id, lower(p_type) AS name FROM part)",
    "product_media": """product_media AS (
  SELECT p_partkey * 10 + s AS id, p_partkey AS product_id, s AS sorting,
    CASE WHEN p_partkey % 7 = 0 THEN 'video' ELSE 'image' END AS type,
    p_name || '-' || CAST(s AS VARCHAR) AS path
  FROM part, (VALUES (1), (2)) v(s) WHERE p_partkey % 5 <> 0)""",
    "product_sizes": f"""product_sizes AS (
  SELECT p_partkey * 10 + (i - 1) AS id, p_partkey AS product_id, {SIZES}[i] AS size
  FROM part, range(1, 6) r(i))""",
    "populars": """populars AS (
  SELECT CAST(p_partkey / 50 AS BIGINT) AS id, p_partkey AS product_id,
    CASE WHEN p_partkey % 100 = 0 THEN 0 ELSE 1 END AS is_active
  FROM part WHERE p_partkey % 50 = 0)""",
    "customer_classes": """customer_classes AS (
  SELECT CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS id, c_mktsegment AS name,
    CAST((dense_rank() OVER (ORDER BY c_mktsegment) - 1) * 5 AS INTEGER) AS percent_discount
  FROM (SELECT DISTINCT c_mktsegment FROM customer) s)""",
    "provinces": "provinces AS (SELECT r_regionkey AS ro_province_id, r_name AS ro_province FROM region)",
    "cities": """cities AS (SELECT n_nationkey AS ro_city_id, n_regionkey AS ro_province_id,
  'Kota' AS ro_type, n_name AS ro_city_name FROM nation)""",
    "customers": """customers AS (
  SELECT c.c_custkey AS id, 'C' || lpad(CAST(c.c_custkey AS VARCHAR), 6, '0') AS code, c.c_name AS name,
    right(c.c_name, 4) AS init, k.id AS customer_class_id, n.n_regionkey AS province_id,
    c.c_nationkey AS city_id, '08' || lpad(CAST(c.c_custkey AS VARCHAR), 9, '0') AS phone1,
    'Jalan ' || CAST(c.c_custkey AS VARCHAR) AS address,
    'BANK' || CAST(c.c_custkey % 4 AS VARCHAR) AS bank_name,
    lpad(CAST(c.c_custkey AS VARCHAR), 10, '0') AS bank_number
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN customer_classes k ON k.name = c.c_mktsegment)""",
    "dropshipper_childs": """dropshipper_childs AS (
  SELECT CAST(c.c_custkey / 10 AS BIGINT) AS id, c.c_custkey AS customer_id, 'DS ' || c.c_name AS name,
    n.n_regionkey AS province_id, c.c_nationkey AS city_id
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey % 10 = 0)""",
    "online_sales": f"""online_sales AS (
  SELECT o_orderkey AS id, 'INV' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code,
    o_custkey AS customer_id, o_orderdate AS created_at, {ST} AS status_trans,
    CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS is_cart, o_totalprice AS gross_total,
    o_orderkey % 20 AS shipment_fee, o_orderkey % 15 AS discount_voucer,
    least(o_orderkey % 20, o_orderkey % 7) AS discount_voucer_ongkir,
    CAST(o_custkey % 5 AS INTEGER) AS province_id, CAST(o_custkey % 25 AS INTEGER) AS city_id,
    '08' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS shipment_phone,
    CASE WHEN o_orderkey % 3 = 0 THEN 'RW' || CAST(o_custkey % 25 + 1 AS VARCHAR) END AS voucer_code
  FROM orders WHERE o_orderkey % 2 = 1)""",
    "sales": f"""sales AS (
  SELECT o_orderkey AS id, 'POS' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS code,
    o_custkey AS customer_id, o_orderdate AS created_at, {ST} AS status,
    o_orderkey % 20 AS shipment_fee, o_orderkey % 15 AS discount,
    CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_percent,
    CAST(o_custkey % 5 AS INTEGER) AS shipment_province, CAST(o_custkey % 25 AS INTEGER) AS shipment_city
  FROM orders WHERE o_orderkey % 2 = 0)""",
    "lines": f"""lines AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS id, l.l_orderkey AS order_id, l.l_partkey AS product_id,
    l.l_quantity AS qty, l.l_extendedprice AS sell_price, p.p_retailprice AS cogs,
    l.l_linenumber * 10 AS point, {SIZES}[(l.l_linenumber - 1) % 5 + 1] AS size
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "online_sales_details": """online_sales_details AS (
  SELECT id, order_id AS online_sales_id, product_id, qty, sell_price, cogs, point, size
  FROM lines WHERE order_id % 2 = 1)""",
    "sales_details": """sales_details AS (
  SELECT id, order_id AS sales_id, product_id, qty, sell_price, cogs, point, size, 0 AS discount
  FROM lines WHERE order_id % 2 = 0)""",
    "reviews": """reviews AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS product_id, l_orderkey AS online_sales_id,
    1 + l_linenumber % 5 AS rating, 'ulasan ' || CAST(l_linenumber AS VARCHAR) AS review
  FROM lineitem WHERE l_returnflag = 'R')""",
    "stock_movements": """stock_movements AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS ref_id, l.l_partkey AS product_id, 'receiving' AS type,
    p.p_retailprice * (1 - l.l_discount) AS price, p.p_retailprice AS normal_price, l.l_quantity AS qty,
    l.l_shipdate AS created_at
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'A'
  UNION ALL
  SELECT d.id AS ref_id, d.product_id, 'sales-in-store' AS type, d.sell_price AS price,
    d.cogs AS normal_price, -d.qty AS qty, s.created_at
  FROM sales_details d JOIN sales s ON s.id = d.sales_id)""",
    "customer_points": """customer_points AS (
  SELECT event_id AS id, user_id AS customer_id,
    CASE event_type WHEN 'signup' THEN 'registrasi' WHEN 'click' THEN 'ulasan'
      WHEN 'purchase' THEN 'belanja' WHEN 'error' THEN 'redeem' END AS info,
    CASE event_type WHEN 'signup' THEN CAST(500 AS BIGINT) WHEN 'click' THEN CAST(50 AS BIGINT)
      WHEN 'purchase' THEN CAST(floor(value) AS BIGINT) WHEN 'error' THEN -CAST(floor(value) AS BIGINT) END AS point,
    ts AS created_at
  FROM events WHERE event_type <> 'view')""",
    "promotions": """promotions AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS id, o_orderpriority AS name,
    DATE '1998-03-01' + (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 5 AS start_date,
    DATE '1998-03-01' + (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 5 + 14 AS end_date
  FROM (SELECT DISTINCT o_orderpriority FROM orders) o)""",
    "rewards": """rewards AS (
  SELECT r AS id, r % 5 + 1 AS promotion_id, 'Reward ' || p_brand AS name, r * 100 AS point,
    r * 1000 AS value, CASE WHEN r % 2 = 0 THEN 'voucher' ELSE 'discount' END AS type,
    'RW' || CAST(r AS VARCHAR) AS voucer_code
  FROM (SELECT DISTINCT p_brand, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS r FROM part) b)""",
    "customer_voucers": """customer_voucers AS (
  SELECT c_custkey AS id, c_custkey AS customer_id, CAST(c_custkey % 25 + 1 AS INTEGER) AS reward_id,
    'RW' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS voucer_code,
    DATE '1998-03-01' + CAST(c_custkey % 30 AS INTEGER) AS start_date,
    DATE '1998-03-01' + CAST(c_custkey % 30 AS INTEGER) + 20 AS end_date,
    CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS is_active,
    CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS is_redeem
  FROM customer)""",
    "voucer_members": """voucer_members AS (
  SELECT c_custkey AS id, c_custkey AS customer_id, 'VM' || CAST(c_custkey % 10 AS VARCHAR) AS voucer_code,
    CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS is_active,
    CAST((c_custkey % 4) * 5 AS INTEGER) AS percent_discount, 10000 AS max_amount
  FROM customer)""",
}

ORDER = ["products", "categories", "types", "product_media", "product_sizes", "populars", "customer_classes",
         "provinces", "cities", "customers", "dropshipper_childs", "online_sales", "sales", "lines",
         "online_sales_details", "sales_details", "reviews", "stock_movements", "customer_points",
         "promotions", "rewards", "customer_voucers", "voucer_members"]


def amt(q: str, p: str) -> str:
    return f"CAST({q} * {p} AS DECIMAL(18,6))"


REPORT_SALES_VIEW = f"""report_sales_view AS (
  SELECT o.id, o.code, o.customer_id, o.created_at, o.status, o.sales_type, o.total, o.total_cogs,
    o.total - o.total_cogs AS total_profit, c.name AS customer_name, k.name AS customer_class_name
  FROM (
    SELECT s.id, s.code, s.customer_id, s.created_at, s.status, 'POS' AS sales_type,
      SUM({amt('d.qty', 'd.sell_price')}) AS total, SUM({amt('d.qty', 'd.cogs')}) AS total_cogs
    FROM sales s JOIN sales_details d ON d.sales_id = s.id
    GROUP BY s.id, s.code, s.customer_id, s.created_at, s.status
    UNION ALL
    SELECT s.id, s.code, s.customer_id, s.created_at, s.status_trans, 'online_sales',
      SUM({amt('d.qty', 'd.sell_price')}), SUM({amt('d.qty', 'd.cogs')})
    FROM online_sales s JOIN online_sales_details d ON d.online_sales_id = s.id
    WHERE s.is_cart = 0
    GROUP BY s.id, s.code, s.customer_id, s.created_at, s.status_trans) o
  JOIN customers c ON c.id = o.customer_id
  JOIN customer_classes k ON k.id = c.customer_class_id)"""

REPORT_PRODUCT_VIEW = """report_product_view AS (
  SELECT o.*, p.name AS product_name FROM (
    SELECT s.id, s.code, s.created_at, d.product_id, 'POS' AS sales_type, SUM(d.qty) AS total_qty
    FROM sales s JOIN sales_details d ON d.sales_id = s.id GROUP BY ALL
    UNION ALL
    SELECT s.id, s.code, s.created_at, d.product_id, 'online_sales', SUM(d.qty)
    FROM online_sales s JOIN online_sales_details d ON d.online_sales_id = s.id WHERE s.is_cart = 0 GROUP BY ALL) o
  JOIN products p ON p.id = o.product_id)"""


def W(*extra: str) -> str:
    return with_(*[T[n] for n in ORDER], *extra)


JAN = "created_at >= TIMESTAMP '1998-01-01 00:00:00' AND created_at < TIMESTAMP '1998-02-01 00:00:00'"


def report_sales_sql(extra: str = "") -> str:
    v = f"(SELECT * FROM report_sales_view WHERE {JAN} {extra})"
    return W(REPORT_SALES_VIEW) + f"""
SELECT 'detail' AS row_type, code, customer_id, customer_name, customer_class_name, created_at, sales_type,
  status, {r2('total')} AS total, {r2('total_cogs')} AS total_cogs, {r2('total_profit')} AS total_profit
FROM {v} v
UNION ALL
SELECT 'total', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  CAST(COALESCE(SUM(CAST(trunc(total) AS BIGINT)), 0) AS DOUBLE),
  CAST(COALESCE(SUM(CAST(trunc(total_cogs) AS BIGINT)), 0) AS DOUBLE),
  CAST(COALESCE(SUM(CAST(trunc(total_profit) AS BIGINT)), 0) AS DOUBLE)
FROM {v} f"""


IMG = "(m.type = 'image' OR m.type IS NULL)"
FIRST = "(m.sorting = 1 OR m.sorting IS NULL)"
PCOLS = ("a.id, a.sku, a.name, a.normal_price, a.is_disabled, a.category_id, a.type_id, a.weight, a.point, "
         "a.extra_fee, a.created_at")


def tx(a: str, b: str) -> str:
    return f"{a} || ' ' || {b}"


SQL = {
    "q_report_sales": report_sales_sql(),
    "q_report_sales_pos": report_sales_sql("AND sales_type = 'POS'"),
    "q_report_product": W(REPORT_PRODUCT_VIEW) + f"""
SELECT 'detail' AS row_type, code, created_at, product_id, product_name, sales_type, {r2('total_qty')} AS total_qty
FROM report_product_view WHERE {JAN}
UNION ALL
SELECT 'total', NULL, NULL, NULL, NULL, NULL, CAST(COALESCE(SUM(CAST(trunc(total_qty) AS BIGINT)), 0) AS DOUBLE)
FROM report_product_view WHERE {JAN}""",
    "q_report_unpaid": W(REPORT_SALES_VIEW) + f"""
SELECT v.code, v.customer_id, v.customer_name, v.created_at, v.sales_type, v.status, {r2('v.total')} AS total,
  c.phone1, c.address
FROM report_sales_view v JOIN customers c ON c.id = v.customer_id WHERE v.status = 'Menunggu Pembayaran'""",
    "q_order_history": W() + f"""
SELECT o.id, o.code, o.customer_id, o.created_at, o.status_trans, {r2(f"SUM({amt('d.qty', 'd.sell_price')})")} AS total
FROM online_sales o JOIN online_sales_details d ON d.online_sales_id = o.id
WHERE o.is_cart = 0 GROUP BY o.id, o.code, o.customer_id, o.created_at, o.status_trans""",
    "q_order_lines": W() + f"""
SELECT b.id, b.online_sales_id, b.product_id, b.qty, b.sell_price, b.point, b.size, c.name AS product_name,
  c.sku, c.weight, a.code, a.created_at AS tanggal, a.status_trans, a.shipment_fee, d.ro_province AS province_name,
  a.customer_id, a.discount_voucer, a.discount_voucer_ongkir, a.voucer_code, {tx('e.ro_type', 'e.ro_city_name')} AS city_name
FROM online_sales a JOIN online_sales_details b ON a.id = b.online_sales_id JOIN products c ON c.id = b.product_id
JOIN provinces d ON d.ro_province_id = a.province_id JOIN cities e ON e.ro_city_id = a.city_id""",
    "q_pos_order_lines": W() + f"""
SELECT b.id, b.sales_id, b.product_id, b.qty, b.sell_price, b.size, c.name AS product_name, c.sku, c.weight,
  a.code, a.created_at AS tanggal, a.status, a.shipment_fee, d.ro_province AS province_name,
  {tx('e.ro_type', 'e.ro_city_name')} AS city_name
FROM sales a JOIN sales_details b ON a.id = b.sales_id JOIN products c ON c.id = b.product_id
LEFT JOIN provinces d ON d.ro_province_id = a.shipment_province LEFT JOIN cities e ON e.ro_city_id = a.shipment_city""",
    "q_order_totals": W() + f"""
SELECT b.online_sales_id AS id, CAST(SUM(a.weight) AS BIGINT) AS weight_total, {r2(f"SUM({amt('b.qty', 'b.sell_price')})")} AS total,
  CAST(SUM(b.point) AS BIGINT) AS point_total
FROM products a JOIN online_sales_details b ON a.id = b.product_id GROUP BY b.online_sales_id""",
    "q_pos_order_totals": W() + f"""
SELECT g.id, g.weight_total, {r2('g.total')} AS total, s.is_percent, s.discount,
  {r2("CASE WHEN s.is_percent = 1 THEN CAST(s.discount AS DOUBLE) / 100.0 * CAST(g.total AS DOUBLE) ELSE CAST(s.discount AS DOUBLE) END")} AS discount_amount
FROM (SELECT b.sales_id AS id, CAST(SUM(a.weight) AS BIGINT) AS weight_total, SUM({amt('b.qty', 'b.sell_price')}) AS total
      FROM products a JOIN sales_details b ON a.id = b.product_id GROUP BY b.sales_id) g
JOIN sales s ON s.id = g.id""",
    "q_online_list": W() + f"""
SELECT a.id, a.created_at, a.code, a.status_trans, {tx('b.bank_name', 'b.bank_number')} AS bank_info,
  a.shipment_phone,
  {r2("CAST(a.gross_total AS DOUBLE) + CAST(a.shipment_fee AS DOUBLE) - CAST(a.discount_voucer_ongkir AS DOUBLE) - CAST(a.discount_voucer AS DOUBLE)")} AS total,
  b.name AS customer_name
FROM online_sales a JOIN customers b ON a.customer_id = b.id WHERE a.is_cart <> 1""",
    "q_pos_list": W() + f"""
SELECT s.id, s.code, s.status, s.created_at, c.name AS customer_name,
  {r2("CAST(g.lines AS DOUBLE) - s.discount + s.shipment_fee")} AS total,
  {r2("CAST(g.lines AS DOUBLE) - (CASE WHEN s.is_percent = 1 THEN CAST(s.discount AS DOUBLE) / 100.0 * CAST(g.lines AS DOUBLE) ELSE CAST(s.discount AS DOUBLE) END) + s.shipment_fee")} AS total_net
FROM sales s JOIN (SELECT sales_id, SUM({amt('qty', 'sell_price')}) AS lines FROM sales_details GROUP BY sales_id) g
  ON g.sales_id = s.id JOIN customers c ON c.id = s.customer_id""",
    "q_cart_lines": W() + f"""
SELECT b.id, b.online_sales_id, b.product_id, b.qty, b.sell_price, a.customer_id, c.name AS product_name, c.sku,
  c.weight, a.code, m.path
FROM online_sales a JOIN online_sales_details b ON a.id = b.online_sales_id JOIN products c ON c.id = b.product_id
JOIN product_media m ON m.product_id = c.id
WHERE a.is_cart = 1 AND {IMG} AND {FIRST}""",
    "q_cart_qty": W() + f"""
SELECT a.customer_id, b.product_id, {r2('SUM(b.qty)')} AS total
FROM online_sales a JOIN online_sales_details b ON a.id = b.online_sales_id WHERE a.is_cart = 1 GROUP BY ALL""",
    "q_cart_weight": W() + """
SELECT c.id, CAST(SUM(a.weight) AS BIGINT) AS weight_total FROM products a JOIN online_sales_details b ON a.id = b.product_id
JOIN online_sales c ON c.id = b.online_sales_id WHERE c.is_cart = 1 GROUP BY c.id""",
    "q_catalog": W() + f"""
SELECT {PCOLS}, m.path FROM products a LEFT JOIN categories b ON a.category_id = b.id
LEFT JOIN product_media m ON m.product_id = a.id WHERE a.is_disabled = 0 AND {IMG} AND {FIRST}""",
    "q_catalog_search": W() + f"""
SELECT {PCOLS}, m.path FROM products a LEFT JOIN product_media m ON m.product_id = a.id
WHERE {IMG} AND {FIRST} AND a.is_disabled = 0 AND a.name LIKE '%ring%'""",
    "q_product_images": W() + f"""
SELECT a.id, a.normal_price, a.type_id, m.path FROM products a LEFT JOIN product_media m ON a.id = m.product_id
WHERE {IMG}""",
    "q_product_first_image": W() + f"""
SELECT a.id, a.normal_price, a.type_id, m.path FROM products a LEFT JOIN product_media m ON a.id = m.product_id
WHERE {IMG} AND {FIRST}""",
    "q_catalog_categories": W() + """
SELECT id, name FROM (
  SELECT b.id, b.name, row_number() OVER (PARTITION BY b.name ORDER BY b.id) AS rn
  FROM categories b WHERE b.id IN (SELECT category_id FROM products WHERE is_disabled = 0)) x WHERE rn = 1""",
    "q_catalog_cost": W() + f"""
SELECT {PCOLS}, g.cogs, m.path FROM products a
JOIN (SELECT product_id, {r2(ratio(f"SUM({amt('qty', 'price')})", 'SUM(qty)'))} AS cogs
      FROM stock_movements WHERE type = 'receiving' GROUP BY product_id) g ON g.product_id = a.id
LEFT JOIN product_media m ON m.product_id = a.id WHERE {IMG} AND {FIRST}""",
    "q_price_list": W() + f"""
SELECT a.id, s.size, k.id AS class_id, a.normal_price, a.extra_fee, a.point,
  {r2("CASE WHEN s.size = 'XXL' THEN (CAST(a.normal_price AS DOUBLE) - CAST(k.percent_discount AS DOUBLE) / 100.0 * CAST(a.normal_price AS DOUBLE)) + CAST(a.extra_fee AS DOUBLE) ELSE CAST(a.normal_price AS DOUBLE) - CAST(k.percent_discount AS DOUBLE) / 100.0 * CAST(a.normal_price AS DOUBLE) END")} AS price
FROM products a JOIN product_sizes s ON s.product_id = a.id JOIN customer_classes k ON k.id = 3""",
    "q_product_list": W() + f"""
SELECT {PCOLS}, b.name AS category_name, c.name AS type_name
FROM products a JOIN categories b ON a.category_id = b.id JOIN types c ON c.id = a.type_id""",
    "q_popular": W() + f"""
SELECT b.name, b.id, b.normal_price, m.path FROM populars a LEFT JOIN products b ON a.product_id = b.id
LEFT JOIN product_media m ON m.product_id = b.id WHERE a.is_active = 1 AND {IMG} AND {FIRST}""",
    "q_popular_plain": W() + """
SELECT b.name, b.id, b.normal_price FROM populars a JOIN products b ON a.product_id = b.id WHERE a.is_active = 1""",
    "q_ratings": W() + """
SELECT p.id AS product_id, COALESCE(printf('%.1f', round(r.avg_rating, 0)), '4.0') AS total_rating
FROM products p LEFT JOIN (SELECT product_id, AVG(rating) AS avg_rating FROM reviews GROUP BY product_id) r
  ON r.product_id = p.id""",
    "q_review_lines": W() + """
SELECT a.id, a.online_sales_id, a.product_id, a.qty, o.customer_id, b.name AS product_name, b.sku, c.path,
  d.review, d.rating
FROM online_sales_details a JOIN online_sales o ON o.id = a.online_sales_id
LEFT JOIN products b ON a.product_id = b.id LEFT JOIN product_media c ON c.product_id = b.id
LEFT JOIN reviews d ON a.online_sales_id = d.online_sales_id
WHERE o.status_trans = 'Transaksi Selesai' AND (c.type = 'image' OR c.type IS NULL)
  AND (c.sorting = 1 OR c.sorting IS NULL)""",
    "q_review_lines_product": W() + """
SELECT a.id, a.online_sales_id, a.product_id, a.qty, o.customer_id, b.name AS product_name, b.sku, c.path,
  d.review, d.rating
FROM online_sales_details a JOIN online_sales o ON o.id = a.online_sales_id
LEFT JOIN products b ON a.product_id = b.id LEFT JOIN product_media c ON c.product_id = b.id
LEFT JOIN reviews d ON a.online_sales_id = d.online_sales_id AND a.product_id = d.product_id
WHERE o.status_trans = 'Transaksi Selesai' AND (c.type = 'image' OR c.type IS NULL)
  AND (c.sorting = 1 OR c.sorting IS NULL)""",
    "q_latest_products": W() + """
SELECT * FROM products WHERE is_disabled = 0 ORDER BY created_at DESC, id LIMIT 3""",
    "q_products_of_type": W() + """
SELECT * FROM products WHERE is_disabled = 0 AND type_id = 'PROMO' ORDER BY id LIMIT 3""",
    "q_points": W() + """
SELECT a.id, a.name AS customer_name, c.name AS customer_class_name, CAST(SUM(b.point) AS BIGINT) AS total_point
FROM customers a JOIN customer_points b ON a.id = b.customer_id JOIN customer_classes c ON c.id = a.customer_class_id
GROUP BY a.id, a.name, c.name""",
    "q_point_history": W() + """
SELECT a.name AS customer_name, b.id, b.customer_id, b.info, b.point, b.created_at,
  CASE WHEN b.point < 0 THEN 'red' ELSE 'green' END AS color
FROM customers a JOIN customer_points b ON a.id = b.customer_id""",
    "q_redeemable": W() + """
SELECT b.id, b.promotion_id, b.name, b.point, b.value, b.type, c.customer_id, c.voucer_code, c.start_date,
  c.end_date, c.id AS customer_voucer_id
FROM promotions a JOIN rewards b ON a.id = b.promotion_id JOIN customer_voucers c ON c.reward_id = b.id
WHERE a.start_date <= DATE '1998-03-20' AND a.end_date >= DATE '1998-03-20'
  AND c.start_date <= DATE '1998-03-20' AND c.end_date >= DATE '1998-03-20' AND c.is_active = 1 AND c.is_redeem = 0""",
    "q_usable_vouchers": W() + """
SELECT a.id, a.customer_id, a.reward_id, a.voucer_code, b.name AS reward_name, b.value, b.type
FROM customer_voucers a JOIN rewards b ON a.reward_id = b.id WHERE a.is_active = 1 AND a.is_redeem = 1""",
    "q_member_vouchers": W() + "SELECT * FROM voucer_members WHERE is_active = 1",
    "q_voucher_list": W() + """
SELECT a.id, a.customer_id, a.reward_id, a.voucer_code, a.is_active, a.is_redeem, b.name AS customer_name,
  c.name AS reward_name
FROM customer_voucers a JOIN customers b ON a.customer_id = b.id JOIN rewards c ON c.id = a.reward_id""",
    "q_member_voucher_list": W() + """
SELECT a.id, a.customer_id, a.voucer_code, a.is_active, b.name AS customer_name
FROM voucer_members a JOIN customers b ON a.customer_id = b.id""",
    "q_reward_list": W() + """
SELECT a.id, a.name, a.point, a.value, a.type, b.name AS promotion_name
FROM rewards a JOIN promotions b ON a.promotion_id = b.id""",
    "q_stock_card": W() + "SELECT a.*, b.name, b.sku FROM stock_movements a JOIN products b ON a.product_id = b.id",
    "q_receipts": W() + """SELECT a.*, b.name, b.sku FROM stock_movements a JOIN products b ON a.product_id = b.id
WHERE a.type = 'receiving'""",
    "q_customer_list": W() + """
SELECT a.id, a.code, a.name, b.name AS customer_class_name, a.phone1, a.bank_number, a.bank_name, b.percent_discount
FROM customers a JOIN customer_classes b ON a.customer_class_id = b.id""",
    "q_customer_places": W() + f"""
SELECT a.id, a.code, a.name, b.ro_province AS province_name, {tx('c.ro_type', 'c.ro_city_name')} AS city_name
FROM customers a JOIN provinces b ON a.province_id = b.ro_province_id JOIN cities c ON a.city_id = c.ro_city_id""",
    "q_dropshippers": W() + f"""
SELECT a.id, a.customer_id, a.name, u.name AS customer_name, b.ro_province AS province_name,
  {tx('c.ro_type', 'c.ro_city_name')} AS city_name
FROM dropshipper_childs a JOIN provinces b ON a.province_id = b.ro_province_id
JOIN cities c ON a.city_id = c.ro_city_id JOIN customers u ON u.id = a.customer_id""",
    "q_customer_page": W() + """
SELECT id, code, init FROM customers
WHERE CAST(id AS VARCHAR) LIKE '%12%' OR code LIKE '%12%' OR init LIKE '%12%'
ORDER BY code, id LIMIT 10 OFFSET 10""",
    "q_customer_counts": W() + """
SELECT COUNT(*) AS i_total,
  COUNT(*) FILTER (WHERE CAST(id AS VARCHAR) LIKE '%12%' OR code LIKE '%12%' OR init LIKE '%12%') AS i_filtered
FROM customers""",
    "led_points": W() + """
SELECT id AS customer_id, 'registrasi' AS info, CAST(500 AS BIGINT) AS point FROM customers
UNION ALL
SELECT o.customer_id, 'ulasan', CAST(50 AS BIGINT) FROM reviews r JOIN online_sales o ON o.id = r.online_sales_id
UNION ALL
SELECT o.customer_id, 'belanja', CAST(SUM(d.point) AS BIGINT) FROM online_sales_details d
  JOIN online_sales o ON o.id = d.online_sales_id
  WHERE o.status_trans = 'Transaksi Selesai' AND o.is_cart = 0 GROUP BY d.online_sales_id, o.customer_id
UNION ALL
SELECT customer_id, info, point FROM customer_points WHERE info = 'redeem'""",
    "led_stock": W() + "SELECT * FROM stock_movements",
    "led_voucher_used": W() + """
SELECT v.id, v.customer_id, v.reward_id, v.voucer_code, v.start_date, v.end_date,
  CASE WHEN u.customer_id IS NOT NULL THEN 0 ELSE v.is_active END AS is_active, v.is_redeem
FROM customer_voucers v LEFT JOIN (
  SELECT DISTINCT customer_id, voucer_code FROM online_sales WHERE is_cart = 0 AND voucer_code IS NOT NULL) u
  ON u.customer_id = v.customer_id AND u.voucer_code = v.voucer_code""",
    "led_member_voucher_used": W() + """
SELECT v.id, v.customer_id, v.voucer_code, CASE WHEN u.customer_id IS NOT NULL THEN 0 ELSE v.is_active END AS is_active,
  v.percent_discount, v.max_amount
FROM voucer_members v LEFT JOIN (
  SELECT DISTINCT customer_id, 'VM' || CAST(customer_id % 10 AS VARCHAR) AS voucer_code
  FROM online_sales WHERE is_cart = 0 AND id % 3 = 1) u
  ON u.customer_id = v.customer_id AND u.voucer_code = v.voucer_code""",
    "q_pos_customers": W() + """
SELECT a.id, a.code, a.name, a.customer_class_id, b.percent_discount
FROM customers a JOIN customer_classes b ON a.customer_class_id = b.id""",
}

# the same results by other access paths
for _name, _other in {"q_order_lines_bucketed": "q_order_lines", "q_order_totals_bucketed": "q_order_totals",
                      "q_catalog_search_index": "q_catalog_search", "q_customer_page_directory": "q_customer_page"}.items():
    SQL[_name] = SQL[_other]
