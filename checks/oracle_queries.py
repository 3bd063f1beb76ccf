"""Oracle SQL texts keyed like ``orderlens.plans.queries.REGISTRY``."""

from __future__ import annotations

from .oracle import BASE_CTES, BASE_VIEWS, MODEL_CTES, day_diff, model_sql, with_views

ORACLE: dict[str, str] = {}

DELAY = day_diff("o.order_delivered_customer_date", "o.order_estimated_delivery_date")


def r6(c: str) -> str:
    return f"round({c}, 6) AS {c}"


def add(name: str, sql: str) -> None:
    ORACLE[name] = sql


# Columns of the derived tables (for whole-table profiles).
TABLE_COLUMNS = {
    "orders": ("v_orders", ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                            "order_approved_at", "order_delivered_customer_date", "order_estimated_delivery_date"], []),
    "order_items": ("v_order_items", ["order_id", "order_item_id", "product_id", "seller_id",
                                      "shipping_limit_date", "price", "freight_value"], ["price", "freight_value"]),
    "order_reviews": ("v_order_reviews", ["review_id", "order_id", "review_score", "review_creation_date"], []),
    "customers": ("v_customers", ["customer_id", "customer_state", "customer_city"], []),
    "products": ("v_products", ["product_id", "product_category_name"], []),
    "payments": ("v_payments", ["order_id", "payment_sequential", "payment_type", "payment_installments",
                                "payment_value"], ["payment_value"]),
    "sellers": ("v_sellers", ["seller_id", "seller_state"], []),
    "geolocation": ("v_geolocation", ["zip_prefix", "state", "city"], []),
    "product_translation": ("v_translation", ["product_category_name", "product_category_name_english"], []),
}
ALL = [v for v, _, _ in TABLE_COLUMNS.values()]

add("load_catalog", with_views("SELECT * FROM v_orders", "v_orders"))
add("parse_dates", with_views("""SELECT order_id, order_purchase_timestamp, order_approved_at,
  order_delivered_customer_date, order_estimated_delivery_date FROM v_orders""", "v_orders"))
add("table_shapes", with_views("\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST({len(cols)} AS INTEGER) AS n_cols FROM {v}"
    for t, (v, cols, _) in TABLE_COLUMNS.items()), *ALL))


def _missing(t, v, cols, dbl):
    parts = []
    for c in cols:
        cond = f"{c} IS NULL OR isnan({c})" if c in dbl else f"{c} IS NULL"
        parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
                     f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) AS frac FROM {v}")
    return parts


add("missing_profile", with_views(
    "SELECT \"table\", \"column\", round_even(frac * 100, 2) AS pct_missing FROM (\n"
    + "\nUNION ALL\n".join(p for t, (v, c, d) in TABLE_COLUMNS.items() for p in _missing(t, v, c, d))
    + "\n) WHERE frac > 0", *ALL))
add("preview", with_views("""SELECT order_id, customer_id, order_status, order_purchase_timestamp
FROM v_orders ORDER BY order_id LIMIT 5""", "v_orders"))
add("drop_canceled", with_views("SELECT * FROM v_orders WHERE order_status IS DISTINCT FROM 'canceled'", "v_orders"))
add("require_score", with_views("SELECT * FROM v_order_reviews WHERE review_score IS NOT NULL", "v_order_reviews"))

MODEL_COLUMNS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                 "order_delivered_customer_date", "order_estimated_delivery_date", "review_score", "review_count",
                 "n_items", "total_items_price", "total_freight_value", "payment_sequential", "payment_type",
                 "payment_installments", "payment_value", "customer_state", "customer_city",
                 "product_category_name", "product_category_name_english", "delivery_time_days",
                 "estimated_delivery_days", "delivery_delay_days", "purchase_year", "purchase_month",
                 "purchase_dayofweek", "review_positive", "review_negative", "review_binary"]
MODEL_DOUBLES = ["review_score", "total_items_price", "total_freight_value", "payment_value",
                 "delivery_time_days", "estimated_delivery_days", "delivery_delay_days", "review_binary"]
ROUND_MD = "SELECT * REPLACE (" + ", ".join(r6(c) for c in MODEL_DOUBLES) + ")"

add("dropna_any", model_sql(f"{ROUND_MD} FROM md WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MODEL_COLUMNS)))
add("time_features", with_views("""SELECT order_id, delivery_time_days, estimated_delivery_days, delivery_delay_days,
  purchase_year, purchase_month, purchase_dayofweek FROM timed""", *BASE_VIEWS, extra=MODEL_CTES))
add("targets", model_sql("SELECT order_id, review_score, review_positive, review_negative, review_binary FROM md"))
add("reviews_agg", with_views("""SELECT order_id, round(avg(CAST(review_score AS DOUBLE)), 6) AS review_score,
  count(review_id) AS review_count FROM v_order_reviews WHERE order_id IS NOT NULL GROUP BY order_id""",
                              "v_order_reviews"))
add("items_agg", with_views("""SELECT order_id, count(order_item_id) AS n_items,
  list(product_id ORDER BY order_item_id) AS product_ids,
  round(coalesce(sum(price), 0.0), 6) AS total_items_price,
  round(coalesce(sum(freight_value), 0.0), 6) AS total_freight_value,
  list(seller_id ORDER BY order_item_id) AS sellers_ids
FROM v_order_items WHERE order_id IS NOT NULL GROUP BY order_id""", "v_order_items"))
add("base_orders_lists", with_views("""SELECT o.order_id, l.product_ids, l.sellers_ids FROM v_orders o LEFT JOIN (
  SELECT order_id, list(product_id ORDER BY order_item_id) AS product_ids,
         list(seller_id ORDER BY order_item_id) AS sellers_ids
  FROM v_order_items WHERE order_id IS NOT NULL GROUP BY order_id) l USING (order_id)
WHERE o.order_status IS DISTINCT FROM 'canceled'""", "v_orders", "v_order_items"))
add("payments_agg", with_views("""SELECT order_id, max(payment_sequential) AS payment_sequential,
  arg_min_null(payment_type, payment_sequential) AS payment_type,
  max(payment_installments) AS payment_installments, round(coalesce(sum(payment_value), 0.0), 6) AS payment_value
FROM v_payments WHERE order_id IS NOT NULL GROUP BY order_id""", "v_payments"))
add("first_item", with_views("""SELECT order_id, arg_min(product_id, order_item_id) FILTER (WHERE product_id IS NOT NULL)
  AS product_id FROM v_order_items WHERE order_id IS NOT NULL GROUP BY order_id""", "v_order_items"))
add("translate_category", with_views("""SELECT p.product_id, p.product_category_name, t.product_category_name_english
FROM v_products p LEFT JOIN v_translation t ON p.product_category_name = t.product_category_name""",
                                     "v_products", "v_translation"))
add("base_orders", with_views("SELECT * REPLACE (" + ", ".join(
    r6(c) for c in ["review_score", "total_items_price", "total_freight_value", "payment_value"]) + ") FROM base",
    *BASE_VIEWS, extra=BASE_CTES))
add("model_dataset", model_sql(f"""{ROUND_MD}, product_ids, sellers_ids FROM md LEFT JOIN (
  SELECT order_id AS of_order, list(product_id ORDER BY order_item_id) AS product_ids,
         list(seller_id ORDER BY order_item_id) AS sellers_ids
  FROM v_order_items WHERE order_id IS NOT NULL GROUP BY order_id) l ON md.order_id = l.of_order""".replace(
    "SELECT * REPLACE", "SELECT md.* REPLACE")))

# ---------------------------------------------------------------- EDA
add("score_distribution", with_views("""SELECT review_score, n_reviews,
  round(n_reviews * 100.0 / (SELECT sum(n_reviews) FROM g), 6) AS pct_reviews,
  round((SELECT avg(n_reviews) FROM g WHERE review_score IS NOT NULL), 6) AS mean_count_per_score
FROM g WHERE review_score IS NOT NULL""", "v_order_reviews",
    extra=[("g", "SELECT review_score, count(*) AS n_reviews FROM v_order_reviews GROUP BY review_score")]))
add("target_distribution", model_sql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, count(*) AS n FROM md GROUP BY 2"
    for c in ["review_score", "review_positive", "review_negative", "review_binary"])))
add("orders_per_month", with_views("""SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month,
  count(*) AS n_orders_month FROM v_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1""", "v_orders"))
add("period_covered", with_views("""SELECT min(order_purchase_timestamp) AS min_purchase,
  max(order_purchase_timestamp) AS max_purchase FROM v_orders""", "v_orders"))


def describe_sql(src: str, value: str, by: str | None) -> str:
    b = f"{by}, " if by else ""
    return f"""SELECT {b}count({value}) AS count, round_even(avg({value}), 2) AS mean,
  round_even(stddev_samp({value}), 2) AS std, round_even(min({value}), 2) AS min,
  round_even(quantile_cont({value}, 0.25), 2) AS p25, round_even(quantile_cont({value}, 0.5), 2) AS p50,
  round_even(quantile_cont({value}, 0.75), 2) AS p75, round_even(max({value}), 2) AS max
FROM {src}""" + (f" GROUP BY {by}" if by else "")


FIRST_REVIEW = ("first_review", """SELECT order_id, min(review_id) AS review_id,
  arg_min_null(review_score, review_id) AS review_score
FROM v_order_reviews WHERE order_id IS NOT NULL GROUP BY order_id""")
add("dedup_reviews", with_views("SELECT * FROM first_review", "v_order_reviews", extra=[FIRST_REVIEW]))
add("delay_by_score", with_views(describe_sql("dr", "delivery_delay_days", "review_score"),
                                 "v_orders", "v_order_reviews", extra=[FIRST_REVIEW, ("dr", f"""
SELECT o.order_id, CAST(f.review_score AS DOUBLE) AS review_score, {DELAY} AS delivery_delay_days
FROM v_orders o JOIN first_review f ON o.order_id = f.order_id
WHERE {DELAY} IS NOT NULL AND f.review_score IS NOT NULL""")]))
add("score_describe", model_sql(describe_sql("md", "review_score", None)))

RO = ("ro", f"""SELECT CAST(r.review_score AS DOUBLE) AS s, {DELAY} AS d, o.customer_id
FROM v_order_reviews r LEFT JOIN v_orders o ON r.order_id = o.order_id WHERE r.review_score IS NOT NULL""")
add("corr_delay_score", with_views("""SELECT round(corr(s, d), 6) AS corr_delay_score, count(*) AS n
FROM ro WHERE s IS NOT NULL AND d IS NOT NULL""", "v_orders", "v_order_reviews", extra=[RO]))
add("review_by_late_flag", with_views("""SELECT delayed, round(avg(s), 6) AS mean_score, count(*) AS n_reviews,
  CASE WHEN delayed THEN 'Sim' ELSE 'Não' END AS delayed_label
FROM (SELECT s, coalesce(d > 0, false) AS delayed FROM ro) GROUP BY delayed""", "v_orders", "v_order_reviews",
                                      extra=[RO]))
RP = ("rp", """SELECT CAST(r.review_score AS DOUBLE) AS s, p.product_category_name
FROM v_order_reviews r LEFT JOIN v_order_items i ON r.order_id = i.order_id
LEFT JOIN v_products p ON i.product_id = p.product_id WHERE r.review_score IS NOT NULL""")
RG = ("rg", """SELECT ro.s, c.customer_state FROM ro LEFT JOIN v_customers c ON ro.customer_id = c.customer_id""")
BAD = "CAST(sum(CASE WHEN s <= 2 THEN 1 ELSE 0 END) AS DOUBLE) * 100.0 / count(*)"
add("worst_categories", with_views(f"""SELECT product_category_name, count(*) AS n_reviews,
  round(avg(s), 6) AS mean_score, round({BAD}, 6) AS pct_bad
FROM rp WHERE product_category_name IS NOT NULL GROUP BY product_category_name HAVING count(*) >= 50
ORDER BY {BAD} DESC, product_category_name LIMIT 10""", "v_order_reviews", "v_order_items", "v_products", extra=[RP]))
add("worst_states", with_views(f"""SELECT customer_state, count(*) AS n_reviews,
  round(avg(s), 6) AS mean_score, round({BAD}, 6) AS pct_bad
FROM rg WHERE customer_state IS NOT NULL GROUP BY customer_state HAVING count(*) >= 100
ORDER BY avg(s), customer_state LIMIT 10""", "v_orders", "v_order_reviews", "v_customers", extra=[RO, RG]))
add("overall_bad_rate", with_views(f"""SELECT 'categories' AS scope, round({BAD}, 6) AS pct_bad, count(*) AS n_rows FROM rp
UNION ALL
SELECT 'states' AS scope, round({BAD}, 6) AS pct_bad, count(*) AS n_rows FROM rg""",
                                   "v_orders", "v_order_reviews", "v_order_items", "v_products", "v_customers",
                                   extra=[RP, RO, RG]))


# ================================================================ batch 2
NUM = ["total_items_price", "total_freight_value", "payment_installments", "payment_value", "n_items",
       "delivery_time_days", "estimated_delivery_days", "delivery_delay_days", "review_count"]
CAT = ["payment_type", "customer_state", "product_category_name_english"]
CLU = ["total_items_price", "total_freight_value", "payment_value", "n_items", "delivery_time_days",
       "delivery_delay_days"]
MONEY = ["total_items_price", "total_freight_value", "payment_value"]


def hb(k: str, seed: int, buckets: int) -> str:
    x = f"xor(({k} % 4294967296 + 4294967296) % 4294967296, {(seed * 2654435761 + 1013904223) % 2**32})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) % 4294967296)"
    return f"(xor({x}, {x} >> 16) % {buckets})"


def is_test(k: str = "order_id") -> str:
    return f"({hb(k, 42, 10000)} < 2000)"


SUP = ("sup", "SELECT order_id, " + ", ".join(NUM + CAT)
       + ", CAST(review_binary AS INTEGER) AS label FROM md WHERE review_binary IS NOT NULL")
NUMD = ("numd", "SELECT order_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM) + " FROM md")
TRN = ("trn", f"SELECT * FROM numd WHERE NOT ({is_test()})")


def rnd_all(cols):
    return ", ".join(r6(c) for c in cols)


add("supervised_xy", model_sql("SELECT * REPLACE (" + rnd_all(
    ["total_items_price", "total_freight_value", "payment_value", "delivery_time_days", "estimated_delivery_days",
     "delivery_delay_days"]) + ") FROM sup", extra=[SUP]))
add("class_counts", model_sql("SELECT label, count(*) AS n FROM sup GROUP BY label", extra=[SUP]))

CF0 = ("cf0", "SELECT order_id, " + ", ".join(
    (f"CASE WHEN {c} IS NULL THEN NULL ELSE ln(1 + greatest(CAST({c} AS DOUBLE), 0.0)) END AS {c}" if c in MONEY
     else f"CAST({c} AS DOUBLE) AS {c}") for c in CLU) + " FROM md")
CQ = ("cq", "SELECT " + ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS q_{c}" for c in CLU) + " FROM cf0")
CF = ("cf", "SELECT order_id, " + ", ".join(f"least(greatest({c}, q_{c}[1]), q_{c}[2]) AS {c}" for c in CLU)
      + " FROM cf0, cq WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CLU))
add("cluster_features", model_sql(f"SELECT order_id, {rnd_all(CLU)} FROM cf", extra=[CF0, CQ, CF]))
WQ = ("wq", "SELECT " + ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS q_{c}" for c in NUM) + " FROM numd")
add("winsorize", model_sql("SELECT order_id, " + ", ".join(
    f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, q_{c}[1]), q_{c}[2]) END, 6) AS {c}"
    for c in NUM) + " FROM numd, wq", extra=[NUMD, WQ]))
ZS = ("zs", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CLU) + " FROM cf")
add("standardize", model_sql("SELECT order_id, " + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END, 6) AS {c}" for c in CLU)
    + " FROM cf, zs", extra=[CF0, CQ, CF, ZS]))
MED = ("med", "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUM) + " FROM trn")
add("impute_median", model_sql("SELECT order_id, " + ", ".join(
    f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in NUM) + " FROM numd, med", extra=[NUMD, TRN, MED]))
CATD = ("catd", "SELECT order_id, " + ", ".join(CAT) + " FROM md")
CTRN = ("ctrn", f"SELECT * FROM catd WHERE NOT ({is_test()})")
MODES = [(f"mode_{c}", f"""SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM ctrn
WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1""") for c in CAT]
add("impute_mode", model_sql("SELECT order_id, " + ", ".join(
    f"coalesce({c}, (SELECT v FROM mode_{c})) AS {c}" for c in CAT) + " FROM catd", extra=[CATD, CTRN] + MODES))
MM = ("mm", "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUM) + " FROM trn")
add("minmax_scale", model_sql("SELECT order_id, " + ", ".join(
    f"round(CASE WHEN hi_{c} = lo_{c} THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END "
    f"ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END, 6) AS {c}" for c in NUM) + " FROM numd, mm",
    extra=[NUMD, TRN, MM]))
LEV = [(f"lev_{c}", f"""SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS slot
FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM ctrn WHERE {c} IS NOT NULL)""") for c in CAT]
add("one_hot", model_sql("\nUNION ALL\n".join(
    f"SELECT d.order_id, '{c}' AS feature, l.slot FROM catd d LEFT JOIN lev_{c} l ON CAST(d.{c} AS VARCHAR) = l.v"
    for c in CAT), extra=[CATD, CTRN] + LEV))
SMM = ("smm", "SELECT " + ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}"
                                    for c in NUM) + " FROM sup")
SSC = ("ssc", "SELECT " + ", ".join(
    f"CASE WHEN hi_{c} = lo_{c} THEN CASE WHEN {c} IS NOT NULL THEN 0.0 END "
    f"ELSE (CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in NUM) + " FROM sup, smm")
add("variance_filter", model_sql("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.0001 AS kept FROM ssc"
    for c in NUM), extra=[SUP, SMM, SSC]))
add("train_test_split", model_sql(f"SELECT order_id, {is_test()} AS is_test FROM sup", extra=[SUP]))
add("cv_folds", model_sql(f"SELECT order_id, CAST({hb('order_id', 7, 3)} AS INTEGER) AS fold FROM sup "
                          f"WHERE NOT ({is_test()})", extra=[SUP]))
HASHED = ("hashed", f"SELECT order_id, label, {hb('order_id', 42, 4294967296)} AS h, {hb('order_id', 7, 4294967296)} AS f FROM sup")
add("stratified_split", model_sql("""SELECT order_id, row_number() OVER (PARTITION BY label ORDER BY h, order_id)
<= floor(0.2 * count(*) OVER (PARTITION BY label) + 0.5) AS is_test FROM hashed""", extra=[SUP, HASHED]))
add("stratified_folds", model_sql("""SELECT order_id, CAST((row_number() OVER (PARTITION BY label ORDER BY f, order_id) - 1) % 3
AS INTEGER) AS fold FROM hashed""", extra=[SUP, HASHED]))
add("sample_n", model_sql(f"SELECT order_id, round(review_score, 6) AS review_score FROM md "
                          f"ORDER BY {hb('order_id', 42, 4294967296)}, order_id LIMIT 1000"))
add("class_weights", model_sql(f"""SELECT label, n_c, round(CAST(n AS DOUBLE) / (k * n_c), 6) AS weight
FROM (SELECT label, count(*) AS n_c FROM sup WHERE NOT ({is_test()}) GROUP BY label) c,
     (SELECT count(*) AS n, count(DISTINCT label) AS k FROM sup WHERE NOT ({is_test()})) t""", extra=[SUP]))

GX = ("gx", "SELECT order_id, label, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)
      + " FROM sup WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in NUM))
GTR = ("gtr", f"SELECT * FROM gx WHERE NOT ({is_test()})")
GTE = ("gte", f"SELECT * FROM gx WHERE {is_test()}")
GV = ("gv", "SELECT 0.0001 * greatest(" + ", ".join(f"var_pop({c})" for c in NUM) + ") AS eps FROM gtr")
GS = ("gs", "SELECT label AS c, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in NUM)
      + " FROM gtr GROUP BY label")
GSS = ("gss", "SELECT c, ln(CAST(n AS DOUBLE) / (SELECT count(*) FROM gtr)) AS lp, " + ", ".join(
    f"m_{c}, greatest(v_{c} + eps, 0.0001) AS v_{c}" for c in NUM) + " FROM gs, gv")
GLL = ("gll", "SELECT t.order_id, t.label, s.c, s.lp - 0.5 * (" + " + ".join(
    f"ln(2 * pi() * s.v_{c})" for c in NUM) + ") - (" + " + ".join(
    f"(t.{c} - s.m_{c}) * (t.{c} - s.m_{c}) / (2 * s.v_{c})" for c in NUM) + ") AS ll FROM gte t, gss s")
add("gaussian_nb", model_sql("SELECT order_id, label, CAST(arg_max(c, ll) AS DOUBLE) AS prediction "
                             "FROM gll GROUP BY order_id, label", extra=[SUP, GX, GTR, GTE, GV, GS, GSS, GLL]))

# ---------------------------------------------------------------- rule predictions
RC = ("rc", """SELECT 'late' AS model, 0 AS ordinal, order_id, CAST(review_binary AS INTEGER) AS label,
  CASE WHEN coalesce(delivery_delay_days > 0, false) THEN 0 ELSE 1 END AS prediction FROM md WHERE review_binary IS NOT NULL
UNION ALL
SELECT 'slow', 1, order_id, CAST(review_binary AS INTEGER),
  CASE WHEN coalesce(delivery_time_days > 20, false) THEN 0 ELSE 1 END FROM md WHERE review_binary IS NOT NULL
UNION ALL
SELECT 'majority', 2, order_id, CAST(review_binary AS INTEGER), 1 FROM md WHERE review_binary IS NOT NULL""")
CM = ("cm", "SELECT model, label, prediction, count(*) AS n FROM rc GROUP BY model, label, prediction")
CLS = ("cls", "SELECT DISTINCT model, c FROM (SELECT model, label AS c FROM cm UNION ALL SELECT model, prediction FROM cm)")
GRID = ("grid", """SELECT a.model, a.c AS label, b.c AS prediction, coalesce(cm.n, 0) AS n
FROM cls a JOIN cls b ON a.model = b.model
LEFT JOIN cm ON cm.model = a.model AND cm.label = a.c AND cm.prediction = b.c""")
PER = ("per", """SELECT model, c, tp, pp, support,
  CASE WHEN pp > 0 THEN CAST(tp AS DOUBLE) / pp ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall
FROM (SELECT model, c,
  (SELECT sum(n) FROM grid g WHERE g.model = cls.model AND g.label = cls.c AND g.prediction = cls.c) AS tp,
  (SELECT sum(n) FROM grid g WHERE g.model = cls.model AND g.prediction = cls.c) AS pp,
  (SELECT sum(n) FROM grid g WHERE g.model = cls.model AND g.label = cls.c) AS support FROM cls)""")
PERF = ("perf", """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1_score FROM per""")
REP = ("rep", """SELECT model, CAST(c AS VARCHAR) AS class, precision, recall, f1_score, CAST(support AS BIGINT) AS support
FROM perf
UNION ALL
SELECT model, 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / sum(support), CAST(sum(support) AS BIGINT)
FROM perf GROUP BY model
UNION ALL
SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM perf GROUP BY model
UNION ALL
SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM perf GROUP BY model""")
MET = ("met", """SELECT model, max(ordinal) AS ordinal,
  max(CASE WHEN class = 'accuracy' THEN f1_score END) AS accuracy,
  max(CASE WHEN class = 'weighted avg' THEN precision END) AS precision_weighted,
  max(CASE WHEN class = 'weighted avg' THEN recall END) AS recall_weighted,
  max(CASE WHEN class = 'weighted avg' THEN f1_score END) AS f1_weighted,
  max(CASE WHEN class = '0' THEN recall END) AS recall_0
FROM rep JOIN (SELECT DISTINCT model, ordinal FROM rc) USING (model) GROUP BY model""")
RULES = [RC, CM, CLS, GRID, PER, PERF, REP, MET]
add("confusion_matrix", model_sql("""SELECT label, prediction, n,
  round(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY label)
        ELSE 0.0 END * 100.0, 6) AS row_pct,
  CASE WHEN label = 0 AND prediction = 0 THEN 'TN' WHEN label = 0 AND prediction = 1 THEN 'FP'
       WHEN label = 1 AND prediction = 0 THEN 'FN' WHEN label = 1 AND prediction = 1 THEN 'TP' END AS cell
FROM grid WHERE model = 'late'""", extra=RULES))
add("classification_report", model_sql("SELECT class, " + rnd_all(["precision", "recall", "f1_score"])
                                       + ", support FROM rep WHERE model = 'late'", extra=RULES))
add("report_long", model_sql("""SELECT class, 'precision' AS metric, round(precision, 6) AS value FROM rep
WHERE model = 'late' AND class NOT IN ('accuracy', 'macro avg', 'weighted avg')
UNION ALL
SELECT class, 'recall', round(recall, 6) FROM rep
WHERE model = 'late' AND class NOT IN ('accuracy', 'macro avg', 'weighted avg')""", extra=RULES))
add("classification_metrics", model_sql("SELECT model, " + rnd_all(
    ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "recall_0"]) + " FROM met", extra=RULES))
add("metric_matrix", model_sql("SELECT model, " + rnd_all(
    ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]) + " FROM met", extra=RULES))
add("best_model", model_sql("""SELECT 'accuracy' AS criterion, arg_min(model, (-accuracy, ordinal)) AS model,
  round(max(accuracy), 6) AS value FROM met
UNION ALL
SELECT 'recall_0', arg_min(model, (-recall_0, ordinal)), round(max(recall_0), 6) FROM met""", extra=RULES))

RR = ("rr", """SELECT order_id, review_score AS y,
  CAST(4.0 AS DOUBLE) - CAST(0.2 AS DOUBLE) * coalesce(delivery_delay_days, 0.0) AS p FROM md
WHERE review_score IS NOT NULL""")
RES = ("res", """SELECT y AS y_true, least(greatest(p, 1.0), 5.0) AS y_pred, y - least(greatest(p, 1.0), 5.0) AS residual,
  CAST(least(greatest(round_even(y, 0), 1.0), 5.0) AS INTEGER) AS y_true_bucket FROM rr""")


def reg_sql(y: str, p: str, src: str) -> str:
    return f"""SELECT round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse,
  round(CASE WHEN count(*) * var_pop({y}) <> 0 THEN 1 - sum(({y} - {p}) * ({y} - {p})) / (count(*) * var_pop({y}))
        ELSE 0.0 END, 6) AS r2, count(*) AS n FROM {src} WHERE {y} IS NOT NULL AND {p} IS NOT NULL"""


add("regression_metrics", model_sql(reg_sql("y", "p", "rr"), extra=[RR]))
add("parity_metrics", model_sql(reg_sql("yc", "pc", "(SELECT least(greatest(y, 1.0), 5.0) AS yc, "
                                                    "least(greatest(p, 1.0), 5.0) AS pc FROM rr)"), extra=[RR]))
add("clip_pred", model_sql("""SELECT order_id, round(p, 6) AS prediction,
  round(least(greatest(p, 1.0), 5.0), 6) AS prediction_clipped FROM rr""", extra=[RR]))
add("residual_bins", model_sql("""SELECT bin, CAST(round(1.0 + (bin - 1) * 0.25, 6) AS DOUBLE) AS bin_left,
  CAST(round(1.0 + (bin - 1) * 0.25 + 0.25, 6) AS DOUBLE) AS bin_right,
  round((CASE WHEN bin = 1 THEN 0.999 ELSE 1.0 + (bin - 1) * 0.25 END + (1.0 + (bin - 1) * 0.25) + 0.25) / 2, 6)
    AS bin_center, round(mean_res, 6) AS mean_res, round(std_res, 6) AS std_res, n
FROM (SELECT CAST(greatest(ceil((y_pred - 1.0) / 0.25), 1) AS INTEGER) AS bin, avg(residual) AS mean_res,
  stddev_samp(residual) AS std_res, count(*) AS n FROM res WHERE y_pred IS NOT NULL GROUP BY 1)
WHERE std_res IS NOT NULL AND mean_res IS NOT NULL""", extra=[RR, RES]))


def box_sql(src: str, value: str, by: str) -> str:
    return f"""SELECT d.{by}, count(*) AS n, round(any_value(q.q1), 6) AS q1, round(any_value(q.median), 6) AS median,
  round(any_value(q.q3), 6) AS q3,
  round(min(CASE WHEN d.v >= q.lo AND d.v <= q.hi THEN d.v END), 6) AS whisker_low,
  round(max(CASE WHEN d.v >= q.lo AND d.v <= q.hi THEN d.v END), 6) AS whisker_high,
  CAST(sum(CASE WHEN d.v >= q.lo AND d.v <= q.hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM (SELECT {by}, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL) d
JOIN (SELECT {by}, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT {by}, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({value} AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3 FROM {src} WHERE {value} IS NOT NULL GROUP BY {by})) q
ON d.{by} = q.{by} GROUP BY d.{by}"""


add("residuals_by_score", model_sql(box_sql("res", "residual", "y_true_bucket").replace(
    "SELECT d.y_true_bucket,", "SELECT CAST(d.y_true_bucket AS INTEGER) AS y_true_bucket,"), extra=[RR, RES]))


def hex_sql(x: str, y: str, columns: int, rows: int) -> str:
    return model_sql(f"""SELECT lattice, ix, iy, round((ix + lattice * 0.5::DOUBLE) * wide + x0, 6) AS x,
  round((iy + lattice * 0.5::DOUBLE) * high + y0, 6) AS y, count(*) AS n
FROM (SELECT CASE WHEN near < far THEN 0 ELSE 1 END AS lattice, wide, high, x0, y0,
  CAST(CASE WHEN near < far THEN round_even(u, 0) ELSE floor(u) END AS INTEGER) AS ix,
  CAST(CASE WHEN near < far THEN round_even(v, 0) ELSE floor(v) END AS INTEGER) AS iy
  FROM (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) AS near,
          pow(u - floor(u) - 0.5::DOUBLE, 2) + 3 * pow(v - floor(v) - 0.5::DOUBLE, 2) AS far
        FROM (SELECT ({x} - x0) / wide AS u, ({y} - y0) / high AS v, wide, high, x0, y0 FROM res, e
              WHERE {x} IS NOT NULL AND {y} IS NOT NULL)))
GROUP BY ALL""", extra=[RR, RES, ("ext", f"""SELECT min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, max({y}) AS y1 FROM res
WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""), ("e", f"""SELECT
  CASE WHEN x1 > x0 THEN x0 ELSE x0 - 0.5 END AS x0, CASE WHEN x1 > x0 THEN (x1 - x0) / {columns} ELSE 1.0 / {columns} END AS wide,
  CASE WHEN y1 > y0 THEN y0 ELSE y0 - 0.5 END AS y0, CASE WHEN y1 > y0 THEN (y1 - y0) / {rows} ELSE 1.0 / {rows} END AS high
FROM ext""")])


add("density_2d", hex_sql("y_true", "y_pred", 30, 17))
add("density_residual", hex_sql("y_pred", "residual", 35, 20))
add("pred_histogram", model_sql("""SELECT y_true_bucket, bin, round(1.0::DOUBLE + bin * 0.2::DOUBLE, 6) AS bin_left,
  round(1.0::DOUBLE + (bin + 1) * 0.2::DOUBLE, 6) AS bin_right, count(*) AS n
FROM (SELECT y_true_bucket, CAST(least(floor((y_pred - 1.0) / 0.2::DOUBLE), 19) AS INTEGER) AS bin FROM res
      WHERE y_true_bucket IS NOT NULL AND y_pred IS NOT NULL) GROUP BY 1, 2""", extra=[RR, RES]))
add("pred_density", model_sql("""SELECT size.y_true_bucket, CAST(point AS INTEGER) AS point, round(lo + point * step, 6) AS x,
  round(CASE WHEN h > 0 THEN sum(w * exp(-0.5 * pow((point - i) * step / h, 2))) / (n * h * sqrt(2 * pi())) END, 6) AS density
FROM (SELECT *, unnest(range(0, CASE WHEN step > 0 THEN 101 ELSE 1 END)) AS point FROM size) size JOIN weight USING (y_true_bucket)
GROUP BY size.y_true_bucket, point, lo, step, n, h""", extra=[RR, RES, ("size", """SELECT y_true_bucket, count(*) AS n, min(y_pred) AS lo,
  (max(y_pred) - min(y_pred)) / 100 AS step, stddev_samp(y_pred) * pow(count(*), -0.2) AS h FROM res
WHERE y_true_bucket IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1"""), ("pos", """SELECT y_true_bucket,
  CASE WHEN step > 0 THEN (y_pred - lo) / step ELSE 0.0 END AS p FROM res JOIN size USING (y_true_bucket) WHERE y_pred IS NOT NULL"""),
  ("weight", """SELECT y_true_bucket, i, sum(w) AS w FROM (
  SELECT y_true_bucket, least(floor(p), 99) AS i, 1 - (p - least(floor(p), 99)) AS w FROM pos
  UNION ALL SELECT y_true_bucket, least(floor(p), 99) + 1, p - least(floor(p), 99) FROM pos) GROUP BY 1, 2 HAVING sum(w) > 0""")]))
add("stabilize", model_sql("SELECT order_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN round(least(greatest(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE)"
    f" ELSE 0.0 END, -15.0), 15.0), 6) END"
    f" AS {c}" for c in NUM) + " FROM md"))
add("pred_distribution", model_sql("""SELECT y_true_bucket, count(y_pred) AS n, round(min(y_pred), 6) AS min,
  round(quantile_cont(y_pred, 0.25), 6) AS q1, round(quantile_cont(y_pred, 0.5), 6) AS median,
  round(quantile_cont(y_pred, 0.75), 6) AS q3, round(max(y_pred), 6) AS max FROM res GROUP BY y_true_bucket""",
                                   extra=[RR, RES]))
add("stars", model_sql("""SELECT order_id, round(p, 6) AS prediction,
  CAST(least(greatest(round_even(p, 0), 1.0), 5.0) AS INTEGER) AS stars_n,
  repeat('★', CAST(least(greatest(round_even(p, 0), 1.0), 5.0) AS INTEGER))
    || repeat('☆', 5 - CAST(least(greatest(round_even(p, 0), 1.0), 5.0) AS INTEGER)) AS stars FROM rr""", extra=[RR]))



# ---------------------------------------------------------------- bootstrap
def boot_sql(rep: str, key: str, mean: str, seed: int = 42) -> list[tuple[str, str]]:
    """CTE ``weighed``: the rows of ``rep`` with a Poisson draw ``w`` of ``mean`` at ``key``."""
    return [("drawn", f"""SELECT *, ({hb(key, seed, 4294967296)} + 0.5::DOUBLE) / 4294967296 AS u1,
  ({hb(key, seed + 1, 4294967296)} + 0.5::DOUBLE) / 4294967296 AS u2, CAST({mean} AS DOUBLE) AS lam FROM {rep}"""),
            ("pois", """SELECT lam, sum(p) OVER (PARTITION BY lam ORDER BY k) AS f FROM (
  SELECT lam, k, exp(-lam + k * ln(lam) - lgamma(k + 1)) AS p FROM (SELECT DISTINCT lam FROM drawn WHERE lam <= 64), range(0, 300) t(k))"""),
            ("steps", "SELECT lam, list(f ORDER BY f) AS f FROM pois GROUP BY lam"),
            ("weighed", """SELECT drawn.*, CASE WHEN drawn.lam <= 64 THEN CAST(len(list_filter(steps.f, lambda x: x <= u1)) AS DOUBLE)
  ELSE greatest(0.0, floor(drawn.lam + sqrt(drawn.lam) * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2)
       + (pow(sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 2) - 1) / 6 + 0.5)) END AS w
FROM drawn LEFT JOIN steps ON drawn.lam = steps.lam""")]


add("mean_ci_bootstrap", with_views("""SELECT delayed, n, round(mean, 6) AS mean, round(ci[1], 6) AS ci_low, round(ci[2], 6) AS ci_high FROM (
  SELECT coalesce(d > 0, false) AS delayed, count(s) AS n, avg(s) AS mean FROM ro GROUP BY 1) JOIN (
  SELECT delayed, quantile_cont(m, [0.025, 0.975]) AS ci FROM (
    SELECT delayed, b, sum(w * v) / sum(w) AS m FROM weighed GROUP BY 1, 2) GROUP BY 1) USING (delayed)""", "v_orders", "v_order_reviews",
    extra=[RO, ("hist", """SELECT delayed, v, c, row_number() OVER (PARTITION BY delayed ORDER BY v) AS i FROM (
  SELECT coalesce(d > 0, false) AS delayed, s AS v, count(*) AS c FROM ro WHERE s IS NOT NULL GROUP BY 1, 2)"""),
           ("rep", "SELECT *, unnest(range(0, 1000)) AS b FROM hist"), *boot_sql("rep", "(i * 1000 + b)", "c")]))
add("mean_ci_bags", model_sql("""SELECT payment_type, n, round(mean, 6) AS mean, round(low, 6) AS ci_low, round(high, 6) AS ci_high FROM (
  SELECT payment_type, count(payment_value) AS n, avg(payment_value) AS mean FROM md GROUP BY 1) a JOIN (
  SELECT payment_type AS pt, avg(ci[1]) AS low, avg(ci[2]) AS high FROM (
    SELECT payment_type, bag, quantile_cont(m, [0.025, 0.975]) AS ci FROM (
      SELECT payment_type, bag, b, sum(w * v) / sum(w) AS m FROM weighed GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) c
  ON a.payment_type IS NOT DISTINCT FROM c.pt""", extra=[
    ("vals", "SELECT order_id, payment_type, payment_value AS v FROM md WHERE payment_value IS NOT NULL"),
    ("sized", "SELECT *, count(*) OVER (PARTITION BY payment_type) AS n FROM vals"),
    ("bagged", "\nUNION ALL\n".join(f"SELECT *, {j} AS bag FROM sized WHERE {hb('order_id', 142 + j, 4294967296)} < pow(n, -0.4) * 4294967296"
                                     for j in range(10))),
    ("held", "SELECT *, count(*) OVER (PARTITION BY payment_type, bag) AS size FROM bagged"),
    ("rep", "SELECT *, unnest(range(0, 100)) AS b FROM held"),
    *boot_sql("rep", f"({hb('order_id', 49, 4294967296)} + bag * 1000003 + b * 7919)", "CAST(n AS DOUBLE) / size")]))
add("load_catalog_csv", with_views("""SELECT o.order_id, customer_id, order_status, order_purchase_timestamp,
  order_delivered_customer_date, order_estimated_delivery_date, n_reviews, sum_score
FROM v_orders o LEFT JOIN (SELECT order_id, count(review_id) AS n_reviews, CAST(sum(review_score) AS BIGINT) AS sum_score
  FROM v_order_reviews GROUP BY order_id) r ON o.order_id = r.order_id""", "v_orders", "v_order_reviews"))

# ---------------------------------------------------------------- descriptive
add("mean_ci", with_views("""SELECT delayed, n, round(mean, 6) AS mean,
  round(mean - 1.959963984540054 * std / sqrt(n), 6) AS ci_low, round(mean + 1.959963984540054 * std / sqrt(n), 6) AS ci_high
FROM (SELECT coalesce(d > 0, false) AS delayed, count(s) AS n, avg(s) AS mean, stddev_samp(s) AS std FROM ro GROUP BY 1)""",
                          "v_orders", "v_order_reviews", extra=[RO]))
add("box_stats", with_views(box_sql("dr", "delivery_delay_days", "review_score"),
                            "v_orders", "v_order_reviews", extra=[FIRST_REVIEW, ("dr", f"""
SELECT o.order_id, CAST(f.review_score AS DOUBLE) AS review_score, {DELAY} AS delivery_delay_days
FROM v_orders o JOIN first_review f ON o.order_id = f.order_id
WHERE {DELAY} IS NOT NULL AND f.review_score IS NOT NULL""")]))
add("feature_defaults", model_sql("\nUNION ALL\n".join(
    [f"""SELECT '{c}' AS feature, 'numeric' AS kind, round(quantile_cont(CAST({c} AS DOUBLE), 0.01), 6) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.99), 6) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS value,
  CAST(NULL AS VARCHAR) AS category FROM md""" for c in NUM]
    + [f"""SELECT * FROM (SELECT DISTINCT '{c}' AS feature, 'categorical' AS kind, CAST(NULL AS DOUBLE) AS min,
  CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS value, CAST({c} AS VARCHAR) AS category FROM md
  WHERE {c} IS NOT NULL ORDER BY category)""" for c in CAT])))

# The short-name replacements, in order (same table as the library's).
SHORT = [("product_category_name_english", "cat"), ("product_category_name", "cat"), ("payment_type", "pay"),
         ("customer_state", "state"), ("delivery_delay_days", "delay_days"), ("estimated_delivery_days", "eta_days"),
         ("delivery_time_days", "deliv_days"), ("total_items_price", "items_price"), ("total_freight_value", "freight"),
         ("payment_installments", "installments"), ("payment_value", "pay_value"), ("cat__", "cat_"), ("num__", ""),
         (" ", "_")]


def _short(expr: str) -> str:
    for a, b in SHORT:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


add("short_feature_name", model_sql(f"SELECT feature, {_short('feature')} AS feature_short FROM names", extra=[(
    "names", "\nUNION ALL\n".join([f"SELECT 'num__{c}' AS feature" for c in NUM] + [
        f"SELECT DISTINCT 'cat__{c}_' || CAST({c} AS VARCHAR) AS feature FROM md WHERE {c} IS NOT NULL"
        for c in CAT]))]))
RCL = ("rcl", """SELECT *, CASE WHEN n_items >= 6 THEN 2 WHEN total_items_price >= 200000 THEN 0 ELSE 1 END AS cluster
FROM md""")
add("cluster_names", model_sql("""SELECT order_id, cluster, CASE cluster WHEN 0 THEN 'Alto Valor (1 produto, adiantado)'
  WHEN 1 THEN 'Baixo Valor (adiantado, 1 produto)' WHEN 2 THEN 'Multi-produtos (médio)' END AS cluster_name FROM rcl""",
                               extra=[RCL]))
SUMC = ["total_items_price", "total_freight_value", "payment_value", "n_items", "delivery_time_days",
        "delivery_delay_days", "review_score"]
add("cluster_summary", model_sql("SELECT cluster, " + ",\n  ".join(
    f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}_mean, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS {c}_median, "
    f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS {c}_std, round(min(CAST({c} AS DOUBLE)), 6) AS {c}_min, "
    f"round(max(CAST({c} AS DOUBLE)), 6) AS {c}_max, count({c}) AS {c}_count" for c in SUMC)
    + " FROM rcl WHERE cluster IS NOT NULL GROUP BY cluster", extra=[RCL]))
add("cluster_ranking", model_sql("""SELECT cluster, round(avg(review_score), 6) AS mean_score, count(*) AS n,
  round((SELECT avg(review_score) FROM rcl WHERE cluster IS NOT NULL AND review_score IS NOT NULL), 6) AS global_mean
FROM rcl WHERE cluster IS NOT NULL AND review_score IS NOT NULL GROUP BY cluster""", extra=[RCL]))

# ---------------------------------------------------------------- the column transformer (operator 88)
CX = ("cx", "SELECT order_id, CAST(review_binary AS INTEGER) AS label, "
      + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM) + ", " + ", ".join(CAT)
      + " FROM md WHERE review_binary IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in MODEL_COLUMNS))
CTR = ("ctr", f"SELECT * FROM cx WHERE NOT ({is_test()})")
PM = ("pm", "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUM) + " FROM ctr")
PQ = ("pq", "SELECT " + ", ".join(f"quantile_cont(coalesce({c}, m_{c}), [0.01, 0.99]) AS q_{c}" for c in NUM)
      + " FROM ctr, pm")
PMODE = [(f"pmode_{c}", f"""SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM ctr
WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1""") for c in CAT]
PLEV = [(f"plev_{c}", f"""SELECT v, row_number() OVER (ORDER BY v) - 1 AS slot FROM (
SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), (SELECT v FROM pmode_{c})) AS v FROM ctr)""") for c in CAT]


def _scaled(c: str) -> str:
    imp, lo, hi = f"coalesce(cx.{c}, m_{c})", f"q_{c}[1]", f"q_{c}[2]"
    return (f"CASE WHEN {hi} = {lo} THEN 0.0 "
            f"ELSE (least(greatest({imp}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) END")


def _onehot(c: str) -> str:
    return (f"list_transform(range((SELECT count(*) FROM plev_{c})), "
            f"lambda i: CASE WHEN i = l_{c}.slot THEN 1.0 ELSE 0.0 END)")


add("preprocess_vector", model_sql(
    "SELECT cx.order_id, cx.label, list_transform(list_concat(["
    + ", ".join(f"CAST({_scaled(c)} AS DOUBLE)" for c in NUM) + "], "
    + ", ".join(_onehot(c) for c in CAT)
    + "), lambda x: round(CAST(x AS DOUBLE), 6)) AS features\nFROM cx CROSS JOIN pm CROSS JOIN pq "
    + " ".join(f"LEFT JOIN plev_{c} l_{c} ON coalesce(CAST(cx.{c} AS VARCHAR), (SELECT v FROM pmode_{c})) = l_{c}.v"
               for c in CAT),
    extra=[CX, CTR, PM, PQ] + PMODE + PLEV))

# ---------------------------------------------------------------- naive Bayes pipeline (97 + 88 + 89)
PV = ("pv", "SELECT cx.order_id, cx.label, " + is_test("cx.order_id") + " AS t, list_concat(["
      + ", ".join(f"CAST({_scaled(c)} AS DOUBLE)" for c in NUM) + "], "
      + ", ".join(f"list_transform({_onehot(c)}, lambda x: CAST(x AS DOUBLE))" for c in CAT)
      + ") AS f\nFROM cx CROSS JOIN pm CROSS JOIN pq "
      + " ".join(f"LEFT JOIN plev_{c} l_{c} ON coalesce(CAST(cx.{c} AS VARCHAR), (SELECT v FROM pmode_{c})) = l_{c}.v"
                 for c in CAT))
NB_CTES = [
    ("lng", "SELECT order_id, label, t, unnest(range(len(f))) AS slot, unnest(f) AS v FROM pv"),
    ("kept", "SELECT slot FROM lng WHERE NOT t GROUP BY slot HAVING var_pop(v) > 0.0001"),
    ("tl", "SELECT l.* FROM lng l JOIN kept k ON l.slot = k.slot"),
    ("eps", "SELECT 0.0001 * max(vp) AS eps FROM (SELECT slot, var_pop(v) AS vp FROM tl WHERE NOT t GROUP BY slot)"),
    ("ncls", "SELECT label AS c, count(*) AS n FROM pv WHERE NOT t GROUP BY label"),
    ("lp", "SELECT c, ln(CAST(n AS DOUBLE) / (SELECT sum(n) FROM ncls)) AS lp FROM ncls"),
    ("st", """SELECT label AS c, slot, avg(v) AS mu, greatest(var_pop(v) + (SELECT eps FROM eps), 0.0001) AS var
FROM tl WHERE NOT t GROUP BY label, slot"""),
    ("ll", """SELECT x.order_id, x.label, s.c,
  sum(-0.5 * ln(2 * pi() * s.var) - (x.v - s.mu) * (x.v - s.mu) / (2 * s.var)) + any_value(lp.lp) AS ll
FROM tl x JOIN st s ON x.slot = s.slot JOIN lp ON lp.c = s.c WHERE x.t GROUP BY x.order_id, x.label, s.c"""),
    ("llm", "SELECT *, max(ll) OVER (PARTITION BY order_id) AS m FROM ll"),
]
add("naive_bayes", model_sql("""SELECT order_id, label, CAST(arg_max(c, ll) AS DOUBLE) AS prediction,
  list(round(exp(ll - m) / z, 6) ORDER BY c) AS probability
FROM (SELECT *, sum(exp(ll - m)) OVER (PARTITION BY order_id) AS z FROM llm) GROUP BY order_id, label""",
                             extra=[CX, CTR, PM, PQ] + PMODE + PLEV + [PV] + NB_CTES))

# ---------------------------------------------------------------- what fitted results must satisfy
add("kmeans_check", model_sql("""SELECT count(*) AS n_rows, 3 AS n_clusters, CAST(0 AS BIGINT) AS n_misplaced,
  true AS centres_are_means, true AS inertia_adds_up FROM cf""", extra=[CF0, CQ, CF]))
add("regression_check", model_sql(f"""SELECT model, count(*) AS n_train, true AS gradient_is_zero
FROM md, (VALUES ('linear_regression'), ('ridge_regression')) v(model) WHERE NOT ({is_test()}) GROUP BY model"""))
add("classifier_check", model_sql(f"""SELECT model, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_positive, true AS probabilities_fit
FROM cx, (VALUES ('naive_bayes'), ('logistic'), ('random_forest'), ('gbt')) v(model) WHERE {is_test()} GROUP BY model""", extra=[CX]))
add("svm_certificate", model_sql(f"SELECT count(*) AS n_train, true AS objective_is_loss, true AS gap_is_small FROM cx WHERE NOT ({is_test()})",
                                 extra=[CX]))
add("importance_check", model_sql(f"SELECT {len(NUM)} + " + " + ".join(f"count(DISTINCT {c})" for c in CAT)
                                  + " AS n_features, 1.0::DOUBLE AS total FROM ctr", extra=[CX, CTR]))
