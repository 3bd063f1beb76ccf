"""Independent DuckDB SQL for every SQL-checkable query.

Each text starts with the derived marketplace views it needs as CTEs over
the driver's raw tables (same fixed rules as ``orderlens.sources.derived``),
written by hand in DuckDB's dialect — not generated from the Spark plans.
"""

from __future__ import annotations

# The derivation rules of the order-shaped fixture tables.
VIEWS = {
    "v_orders": """
SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL
       WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'canceled'
       WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'delivered' END AS order_status,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS order_purchase_timestamp,
  o_orderdate + to_hours(CAST(o_orderkey % 24 + 1 + o_orderkey % 30 AS INTEGER)) AS order_approved_at,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
       ELSE o_orderdate + to_hours(CAST(((o_orderkey * 37) % 45 + 1) * 24 + o_orderkey % 23 AS INTEGER)) END
       AS order_delivered_customer_date,
  o_orderdate + to_hours(CAST((30 + o_orderkey % 11) * 24 AS INTEGER)) AS order_estimated_delivery_date
FROM orders""",
    "v_order_items": """
SELECT l_orderkey AS order_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS order_item_id,
  l_partkey AS product_id, l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
  l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
FROM lineitem""",
    "v_order_reviews": """
SELECT o_orderkey * 2 AS review_id, o_orderkey AS order_id,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL
       WHEN (o_orderkey * 37) % 45 + 1 > 30 + o_orderkey % 11 THEN 1 + (o_orderkey * 7) % 4
       ELSE 5 - ((o_orderkey * 13) % 17) % 3 END AS review_score,
  o_orderdate AS review_creation_date
FROM orders WHERE o_orderkey % 19 <> 0
UNION ALL
SELECT o_orderkey * 2 + 1, o_orderkey, 1 + (o_orderkey // 53) % 5, o_orderdate
FROM orders WHERE o_orderkey % 53 = 0""",
    "v_payments": """
SELECT o_orderkey AS order_id, CAST(1 AS BIGINT) AS payment_sequential,
  CASE o_orderkey % 4 WHEN 0 THEN 'boleto' WHEN 1 THEN 'voucher' ELSE 'credit_card' END AS payment_type,
  1 + o_orderkey % 10 AS payment_installments,
  CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS payment_value
FROM orders WHERE o_orderkey % 307 <> 0
UNION ALL
SELECT o_orderkey, CAST(2 AS BIGINT), 'voucher', CAST(1 AS BIGINT), o_totalprice / 2
FROM orders WHERE o_orderkey % 10 = 0""",
    "v_customers": """
SELECT c_custkey AS customer_id, n_name AS customer_state, c_mktsegment AS customer_city
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_products": """
SELECT p_partkey AS product_id,
  CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_brand END AS product_category_name FROM part""",
    "v_translation": """
SELECT DISTINCT p_brand AS product_category_name, concat('en_', lower(p_brand)) AS product_category_name_english
FROM part WHERE p_brand <> 'Brand#3'""",
    "v_sellers": """
SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_geolocation": """
SELECT n_nationkey AS zip_prefix, n_name AS state, r_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey""",
}

ALL_VIEWS = list(VIEWS)


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views>, <extra ctes> <body>``."""
    ctes = [f"{n} AS ({VIEWS[n]}\n)" for n in names] + [f"{n} AS (\n{q}\n)" for n, q in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def day_diff(end: str, start: str) -> str:
    return f"floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0)"


BASE_CTES = [
    ("o", "SELECT * FROM v_orders WHERE order_status IS DISTINCT FROM 'canceled'"),
    ("ra", """SELECT order_id, avg(CAST(review_score AS DOUBLE)) AS review_score, count(review_id) AS review_count
FROM v_order_reviews WHERE order_id IS NOT NULL GROUP BY order_id"""),
    ("ia", """SELECT order_id, count(order_item_id) AS n_items,
  coalesce(sum(price), 0.0) AS total_items_price, coalesce(sum(freight_value), 0.0) AS total_freight_value,
  arg_min(product_id, order_item_id) FILTER (WHERE product_id IS NOT NULL) AS first_product_id
FROM v_order_items WHERE order_id IS NOT NULL GROUP BY order_id"""),
    ("pa", """SELECT order_id, max(payment_sequential) AS payment_sequential,
  arg_min_null(payment_type, payment_sequential) AS payment_type,
  max(payment_installments) AS payment_installments, coalesce(sum(payment_value), 0.0) AS payment_value
FROM v_payments WHERE order_id IS NOT NULL GROUP BY order_id"""),
    ("base", """SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
  o.order_delivered_customer_date, o.order_estimated_delivery_date,
  ra.review_score, ra.review_count, ia.n_items, ia.total_items_price, ia.total_freight_value,
  pa.payment_sequential, pa.payment_type, pa.payment_installments, pa.payment_value,
  c.customer_state, c.customer_city, p.product_category_name, t.product_category_name_english
FROM o LEFT JOIN ra ON o.order_id = ra.order_id
LEFT JOIN ia ON o.order_id = ia.order_id
LEFT JOIN pa ON o.order_id = pa.order_id
LEFT JOIN v_customers c ON o.customer_id = c.customer_id
LEFT JOIN v_products p ON ia.first_product_id = p.product_id
LEFT JOIN v_translation t ON p.product_category_name = t.product_category_name"""),
]

TIME_COLS = f"""{day_diff('order_delivered_customer_date', 'order_purchase_timestamp')} AS delivery_time_days,
  {day_diff('order_estimated_delivery_date', 'order_purchase_timestamp')} AS estimated_delivery_days,
  {day_diff('order_delivered_customer_date', 'order_estimated_delivery_date')} AS delivery_delay_days,
  CAST(year(order_purchase_timestamp) AS INTEGER) AS purchase_year,
  CAST(month(order_purchase_timestamp) AS INTEGER) AS purchase_month,
  CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS purchase_dayofweek"""

TARGET_COLS = """CAST(coalesce(review_score >= 4, false) AS INTEGER) AS review_positive,
  CAST(coalesce(review_score <= 2, false) AS INTEGER) AS review_negative,
  CASE WHEN review_score >= 4 THEN CAST(1.0 AS DOUBLE) WHEN review_score <= 2 THEN CAST(0.0 AS DOUBLE) END
    AS review_binary"""

MODEL_CTES = BASE_CTES + [
    ("timed", f"SELECT *, {TIME_COLS} FROM base"),
    ("md", f"SELECT *, {TARGET_COLS} FROM timed WHERE review_score IS NOT NULL"),
]

BASE_VIEWS = ("v_orders", "v_order_items", "v_order_reviews", "v_payments", "v_customers", "v_products",
              "v_translation")


def model_sql(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``body`` over the modelling table ``md``."""
    return with_views(body, *BASE_VIEWS, extra=MODEL_CTES + (extra or []))
