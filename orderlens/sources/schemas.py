"""Explicit schemas of the nine marketplace tables.

Only columns the analytics touch are typed; CSV reads never infer schema
(one extra scan and unstable types). Timestamps are TIMESTAMP_NTZ: the
source data are wall-clock times without zone.
"""

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ORDERS = _st(
    ("order_id", S), ("customer_id", S), ("order_status", S),
    ("order_purchase_timestamp", TS), ("order_approved_at", TS),
    ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
    ("order_estimated_delivery_date", TS),
)
ORDER_ITEMS = _st(
    ("order_id", S), ("order_item_id", L), ("product_id", S), ("seller_id", S),
    ("shipping_limit_date", TS), ("price", D), ("freight_value", D),
)
ORDER_REVIEWS = _st(
    ("review_id", S), ("order_id", S), ("review_score", L),
    ("review_comment_title", S), ("review_comment_message", S),
    ("review_creation_date", TS), ("review_answer_timestamp", TS),
)
CUSTOMERS = _st(
    ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
    ("customer_city", S), ("customer_state", S),
)
PRODUCTS = _st(
    ("product_id", S), ("product_category_name", S), ("product_name_lenght", D),
    ("product_description_lenght", D), ("product_photos_qty", D), ("product_weight_g", D),
    ("product_length_cm", D), ("product_height_cm", D), ("product_width_cm", D),
)
PAYMENTS = _st(
    ("order_id", S), ("payment_sequential", L), ("payment_type", S),
    ("payment_installments", L), ("payment_value", D),
)
SELLERS = _st(
    ("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S),
)
GEOLOCATION = _st(
    ("geolocation_zip_code_prefix", S), ("geolocation_lat", D), ("geolocation_lng", D),
    ("geolocation_city", S), ("geolocation_state", S),
)
TRANSLATION = _st(
    ("product_category_name", S), ("product_category_name_english", S),
)

# File names of the public marketplace dataset, per table.
FILES = {
    "orders": ("olist_orders_dataset.csv", ORDERS),
    "order_items": ("olist_order_items_dataset.csv", ORDER_ITEMS),
    "order_reviews": ("olist_order_reviews_dataset.csv", ORDER_REVIEWS),
    "customers": ("olist_customers_dataset.csv", CUSTOMERS),
    "products": ("olist_products_dataset.csv", PRODUCTS),
    "payments": ("olist_order_payments_dataset.csv", PAYMENTS),
    "sellers": ("olist_sellers_dataset.csv", SELLERS),
    "geolocation": ("olist_geolocation_dataset.csv", GEOLOCATION),
}
OPTIONAL_FILES = {
    "product_translation": ("product_category_name_translation.csv", TRANSLATION),
}

# Tables with free text, where quoted fields may hold line breaks.
FREE_TEXT_TABLES = ("order_reviews",)

# Columns that no operator needs; a file may lack them.
OPTIONAL_COLUMNS = (
    "order_delivered_carrier_date", "review_comment_title", "review_comment_message", "review_answer_timestamp",
    "customer_unique_id", "customer_zip_code_prefix", "product_name_lenght", "product_description_lenght",
    "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    "seller_zip_code_prefix", "seller_city", "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
    "geolocation_city", "geolocation_state",
)
