"""The same results in SQL, from the supplied tables, for another engine to run."""

from __future__ import annotations

# Raw tables as ``checks/testdata.py`` derives them.
RAW = """
state_codes AS (
    SELECT ['RO','AC','AM','RR','PA','AP','TO','MA','PI','CE','RN','PB','PE','AL','SE','BA','MG','ES','RJ','SP',
            'PR','SC','RS','MS','MT','GO','DF','XX'] AS codes
),
raw_customers AS (
    SELECT c_custkey AS customer_id,
           c_custkey - c_custkey % 2 AS customer_unique_id,
           CASE WHEN length((c_custkey * 2)::VARCHAR) < 5 THEN lpad((c_custkey * 2)::VARCHAR, 5, '0')
                ELSE (c_custkey * 2)::VARCHAR END AS zip,
           lower(c_mktsegment) || ' ' || (c_custkey % 12)::VARCHAR AS customer_city,
           codes[c_custkey % 28 + 1] AS customer_state
    FROM customer, state_codes
),
raw_sellers AS (
    SELECT s_suppkey, s_name AS seller_id,
           CASE WHEN length((s_suppkey * 2 + 1)::VARCHAR) < 5 THEN lpad((s_suppkey * 2 + 1)::VARCHAR, 5, '0')
                ELSE (s_suppkey * 2 + 1)::VARCHAR END AS zip,
           'porto ' || (s_suppkey % 9)::VARCHAR AS seller_city,
           codes[s_suppkey % 28 + 1] AS seller_state
    FROM supplier, state_codes
),
raw_geolocation AS (
    SELECT zip,
           key * 37 % 304 / 8.0::DOUBLE - 33 + k / 8.0::DOUBLE AS lat,
           key * 53 % 304 / 8.0::DOUBLE - 73 + k / 8.0::DOUBLE AS lng,
           CASE WHEN k < 2 THEN city ELSE 'bairro ' || city END AS city,
           CASE WHEN k < 3 THEN state ELSE 'XX' END AS state
    FROM (
        SELECT customer_id AS key, zip, customer_city AS city, customer_state AS state FROM raw_customers
        UNION ALL
        SELECT s_suppkey, zip, seller_city, seller_state FROM raw_sellers WHERE s_suppkey % 20 <> 0
    ) places, (SELECT unnest([0, 1, 2, 3]) AS k) ks
),
raw_orders_timed AS (
    SELECT *, CASE WHEN o_orderstatus IN ('F', 'O')
                   THEN approved IS NOT NULL ELSE false END AS was_shipped
    FROM (
        SELECT *, CASE WHEN o_orderkey % 97 <> 0
                       THEN purchase + to_hours((o_orderkey % 24 * 3)::BIGINT) END AS approved
        FROM (SELECT *, o_orderdate + to_hours((o_orderkey % 8 * 3)::BIGINT) AS purchase FROM orders) o1
    ) o2
),
raw_orders AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id,
           CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'canceled' ELSE 'processing' END END AS order_status,
           purchase AS order_purchase_timestamp,
           approved AS order_approved_at,
           carrier AS order_delivered_carrier_date,
           CASE WHEN o_orderstatus = 'F'
                THEN carrier + to_hours(((o_orderkey * 13 % 50 + 1) * 24 + o_orderkey % 5 * 3)::BIGINT)
           END AS order_delivered_customer_date,
           o_orderdate + INTERVAL 40 DAY AS order_estimated_delivery_date
    FROM (
        SELECT *, CASE WHEN was_shipped
                       THEN purchase + to_hours((o_orderkey % 24 * 3 + o_orderkey % 7 * 24 - 36)::BIGINT)
                  END AS carrier
        FROM raw_orders_timed
    ) o3
),
raw_reviews AS (
    SELECT o_orderkey AS order_id, o_orderkey * 7 % 5 + 1 AS review_score FROM orders WHERE o_orderkey % 50 <> 0
    UNION ALL
    SELECT o_orderkey, (o_orderkey // 10) * 3 % 5 + 1 FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 10 = 3
),
raw_payments AS (
    SELECT o_orderkey AS order_id,
           CASE WHEN o_orderkey % 29 = 0 THEN 'not_defined'
                WHEN o_orderpriority[1] IN ('1', '2') THEN 'credit_card'
                WHEN o_orderpriority[1] = '3' THEN 'boleto' ELSE 'debit_card' END AS payment_type,
           o_orderkey % 15 AS payment_installments,
           floor(o_totalprice * 0.16::DOUBLE) / 16 AS payment_value
    FROM orders WHERE o_orderpriority[1] <> '4'
    UNION ALL
    SELECT o_orderkey, 'voucher', 1, 1.5
    FROM orders, (SELECT unnest([1, 2]) AS copy) c
    WHERE o_orderpriority[1] <> '4' AND (o_orderkey % 8 = 5 OR (o_orderkey % 8 = 3 AND copy = 1))
),
raw_products AS (
    SELECT p_partkey AS product_id,
           CASE WHEN p_partkey % 25 <> 0 THEN lower(p_type) || '_' || (p_size % 4)::VARCHAR END AS product_category_name,
           p_size * 100.0::DOUBLE AS product_weight_g
    FROM part
),
raw_translation AS (
    SELECT DISTINCT product_category_name, product_category_name || '_en' AS product_category_name_english
    FROM raw_products WHERE product_category_name IS NOT NULL AND product_category_name <> 'small_0'
),
raw_items AS (
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, s_name AS seller_id,
           l_shipdate AS shipping_limit_date,
           CASE WHEN l_partkey % 211 = 0 THEN 0.0::DOUBLE ELSE floor(l_extendedprice * 0.16::DOUBLE) / 16 END AS price,
           floor(l_extendedprice * 0.16::DOUBLE) / 16 * round(l_tax * 100) / 16 AS freight_value
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""

# Ties of a commonest value go to the smallest.
CENTROIDS = """
city_ranks AS (
    SELECT zip, city, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city) AS r
    FROM raw_geolocation WHERE city IS NOT NULL GROUP BY zip, city
),
state_ranks AS (
    SELECT zip, state, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, state) AS r
    FROM raw_geolocation WHERE state IS NOT NULL GROUP BY zip, state
),
centroids AS (
    SELECT g.zip, g.lat, g.lng, c.city, s.state
    FROM (SELECT zip, avg(lat) AS lat, avg(lng) AS lng FROM raw_geolocation GROUP BY zip) g
    LEFT JOIN city_ranks c ON c.zip = g.zip AND c.r = 1
    LEFT JOIN state_ranks s ON s.zip = g.zip AND s.r = 1
)"""

SUMMARIES = """
order_reviews AS (
    SELECT order_id, avg(review_score) AS avg_review_score, min(review_score)::TINYINT AS min_review_score,
           count(*) AS review_count
    FROM raw_reviews GROUP BY order_id
),
type_ranks AS (
    SELECT order_id, payment_type,
           row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, payment_type) AS r
    FROM raw_payments WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type
),
order_payments AS (
    SELECT p.order_id, p.total_payment, p.max_installments, t.payment_type AS primary_payment_type
    FROM (SELECT order_id, sum(payment_value) AS total_payment, max(payment_installments)::INT AS max_installments
          FROM raw_payments GROUP BY order_id) p
    LEFT JOIN type_ranks t ON t.order_id = p.order_id AND t.r = 1
)"""

FACT = """
product_side AS (
    SELECT product_id, product_category_name, product_category_name_english,
           product_weight_g::FLOAT AS product_weight_g
    FROM raw_products LEFT JOIN raw_translation USING (product_category_name)
),
seller_side AS (
    SELECT seller_id, seller_city, seller_state, lat::FLOAT AS seller_lat, lng::FLOAT AS seller_lng
    FROM raw_sellers LEFT JOIN centroids USING (zip)
),
customer_side AS (
    SELECT customer_id, customer_unique_id, customer_city, customer_state,
           lat::FLOAT AS customer_lat, lng::FLOAT AS customer_lng
    FROM raw_customers LEFT JOIN centroids USING (zip)
),
order_side AS (
    SELECT * REPLACE (avg_review_score::FLOAT AS avg_review_score, review_count::INT AS review_count,
                      total_payment::FLOAT AS total_payment, max_installments::INTEGER AS max_installments)
    FROM raw_orders
    JOIN customer_side USING (customer_id)
    LEFT JOIN order_reviews USING (order_id)
    LEFT JOIN order_payments USING (order_id)
),
joined AS (
    SELECT * REPLACE (price::FLOAT AS price, freight_value::FLOAT AS freight_value)
    FROM raw_items
    JOIN product_side USING (product_id)
    JOIN seller_side USING (seller_id)
    JOIN order_side USING (order_id)
),
timed AS (
    SELECT *,
           price + freight_value AS total_item_value,
           (CASE WHEN price > 0 THEN freight_value::DOUBLE / price::DOUBLE END)::FLOAT AS freight_ratio,
           (date_diff('second', order_purchase_timestamp, order_approved_at) / 3600.0::DOUBLE)::FLOAT
               AS approval_wait_hours,
           (date_diff('second', order_approved_at, order_delivered_carrier_date) / 3600.0::DOUBLE)::FLOAT
               AS carrier_wait_hours,
           (date_diff('second', order_delivered_carrier_date, order_delivered_customer_date) / 86400.0::DOUBLE)::FLOAT
               AS transit_days,
           (date_diff('second', order_estimated_delivery_date, order_delivered_customer_date) / 86400.0::DOUBLE)::FLOAT
               AS delay_days,
           date_trunc('month', order_purchase_timestamp)::DATE AS order_year_month,
           sin(radians(customer_lat::DOUBLE - seller_lat::DOUBLE) / 2) AS half_lat,
           sin(radians(customer_lng::DOUBLE - seller_lng::DOUBLE) / 2) AS half_lng,
           cos(radians(seller_lat::DOUBLE)) * cos(radians(customer_lat::DOUBLE)) AS cosines
    FROM joined
),
fact AS (
    SELECT * EXCLUDE (half_lat, half_lng, cosines),
           coalesce(delay_days > 0, false) AS is_late,
           CASE WHEN seller_lat IS NOT NULL AND seller_lng IS NOT NULL
                 AND customer_lat IS NOT NULL AND customer_lng IS NOT NULL
                THEN (2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE,
                      sqrt(half_lat * half_lat + cosines * half_lng * half_lng))))::FLOAT
           END AS seller_customer_distance_km
    FROM timed
)"""


def over_raw(select: str) -> str:
    return f"WITH {RAW}\n{select}"


def over_centroids(select: str) -> str:
    return f"WITH {RAW},{CENTROIDS}\n{select}"


def over_summaries(select: str) -> str:
    return f"WITH {RAW},{SUMMARIES}\n{select}"


def over_fact(select: str, *ctes: str) -> str:
    return "WITH " + ",".join([RAW, CENTROIDS, SUMMARIES, FACT, *ctes]) + "\n" + select


# Columns of the wide forms: every state code of the raw customers, every month from the first purchase to the last.
UFS = "RO AC AM RR PA AP TO MA PI CE RN PB PE AL SE BA MG ES RJ SP PR SC RS MS MT GO DF XX".split()
MONTHS = 80

# Conditions used by the queries.
WINDOW = "order_purchase_timestamp >= DATE '1996-02-10' AND order_purchase_timestamp <= DATE '1999-08-05'"
PICKED = """
    customer_state IN ('SP', 'RJ', 'MG', 'BA', 'AC')
    AND product_category_name_english IN ('economy_1_en', 'large_2_en', 'promo_3_en', 'standard_0_en')
    AND order_status IN ('delivered', 'shipped')"""
MANY = f"{WINDOW} AND total_item_value >= 100.5"
LATE_PCT = "sum(is_late::INT)::DOUBLE * 100.0::DOUBLE / count(*)"
LATE_RATE = "sum(is_late::INT)::DOUBLE / count(*)"
TIER = """CASE WHEN total_item_value < 50 THEN '<50' WHEN total_item_value < 200 THEN '50–200'
    WHEN total_item_value < 500 THEN '200–500' WHEN total_item_value < 1000 THEN '500–1000' ELSE '1000+' END"""
PAY_LABEL = """CASE primary_payment_type WHEN 'credit_card' THEN 'Credit Card' WHEN 'boleto' THEN 'Boleto'
    WHEN 'voucher' THEN 'Voucher' WHEN 'debit_card' THEN 'Debit Card' END"""
REVIEW_FLAG = """CASE WHEN avg_review_score >= 4 THEN 'green' WHEN avg_review_score >= 3 THEN 'yellow'
    WHEN avg_review_score IS NOT NULL THEN 'red' END"""
LATE_FLAG = "CASE WHEN late_pct > 10 THEN 'red' END"
QUADRANT = """CASE WHEN avg_review_score < 4 AND late_pct > 10 THEN 'problem'
    WHEN avg_review_score >= 4 AND late_pct <= 10 THEN 'high quality'
    WHEN avg_review_score >= 4 THEN 'good but late' ELSE 'low review, on time' END"""
SCORE = """CASE WHEN min_review_score <= 2 THEN 'Negative (1–2)' WHEN min_review_score = 3 THEN 'Neutral (3)'
    ELSE 'Positive (4–5)' END"""


def bucket(c: str) -> str:
    return f"""CASE WHEN {c} = 1 THEN '1' WHEN {c} <= 3 THEN '2–3' WHEN {c} <= 6 THEN '4–6'
        WHEN {c} <= 12 THEN '7–12' ELSE '12+' END"""


def title(c: str) -> str:
    return f"""array_to_string(list_transform(string_split({c}, ' '),
        lambda w: upper(w[1]) || lower(w[2:])), ' ')"""


GEO = """avg(customer_lat) AS lat, avg(customer_lng) AS lng, count(DISTINCT order_id) AS order_count,
    count(DISTINCT customer_unique_id) AS unique_customers, sum(total_item_value) AS gmv,
    avg(avg_review_score) AS avg_review_score"""


CITIES = f"""cities AS (SELECT customer_city, customer_state, {GEO} FROM fact
    WHERE customer_state = 'SP' GROUP BY customer_city, customer_state)"""


def routes(min_orders: int, where: str = "true") -> str:
    return f"""routes AS (
        SELECT seller_state, customer_state, avg(seller_lat) AS seller_lat, avg(seller_lng) AS seller_lng,
               avg(customer_lat) AS customer_lat, avg(customer_lng) AS customer_lng,
               count(DISTINCT order_id) AS order_count, sum(total_item_value) AS gmv,
               avg(delay_days) AS avg_delay_days, avg(seller_customer_distance_km) AS avg_distance_km
        FROM fact WHERE {where} GROUP BY seller_state, customer_state
        HAVING count(DISTINCT order_id) >= {min_orders})"""


CROSSES = "coalesce(seller_state <> customer_state, true)"
CATEGORIES = f"""categories AS (
    SELECT coalesce(product_category_name_english, 'Unknown') AS category,
           count(DISTINCT order_id) AS order_count, sum(total_item_value) AS gmv, avg(price) AS avg_price,
           avg(freight_ratio) AS avg_freight_ratio, avg(avg_review_score) AS avg_review_score,
           {LATE_PCT} AS late_pct, avg(transit_days) AS avg_transit_days
    FROM fact GROUP BY 1)"""


def sellers(min_orders: int = 10, where: str = "true") -> str:
    return f"""sellers AS (
        SELECT seller_id, seller_city, seller_state, avg(seller_lat) AS seller_lat, avg(seller_lng) AS seller_lng,
               count(DISTINCT order_id) AS order_count, sum(total_item_value) AS gmv,
               avg(avg_review_score) AS avg_review_score, {LATE_PCT} AS late_pct,
               avg(approval_wait_hours) AS avg_approval_wait_hours,
               count(DISTINCT product_category_name_english) AS category_count
        FROM fact WHERE {where} GROUP BY seller_id, seller_city, seller_state
        HAVING count(DISTINCT order_id) >= {min_orders})"""


DELAYS = f"""delays AS (
    SELECT customer_state, avg(customer_lat) AS lat, avg(customer_lng) AS lng, avg(delay_days) AS avg_delay_days,
           {LATE_PCT} AS late_pct, avg(transit_days) AS avg_transit_days
    FROM fact GROUP BY customer_state)"""
STAGES = """stages AS (
    SELECT customer_state, avg(approval_wait_hours) / 24 AS avg_days_to_approve,
           avg(carrier_wait_hours) / 24 AS avg_days_to_pickup, avg(transit_days) AS avg_transit_days,
           avg(delay_days) AS avg_delay
    FROM fact GROUP BY customer_state)"""


def order_level(where: str) -> str:
    return f"""order_level AS (
        SELECT {bucket('max(max_installments)')} AS installment_bucket, max(avg_review_score) AS avg_review_score
        FROM fact WHERE max_installments > 0 AND avg_review_score IS NOT NULL AND {where} GROUP BY order_id)"""


ORDER_LEVEL = order_level("true")
SCORED = f"""scored AS (SELECT {SCORE} AS score_bucket, * FROM fact WHERE min_review_score IS NOT NULL)"""


def cohorts(founding: str) -> str:
    return f"""first_orders AS (
        SELECT customer_unique_id, date_trunc('month', min(order_purchase_timestamp))::DATE AS cohort_month
        FROM fact WHERE {founding} GROUP BY customer_unique_id),
    tagged AS (
        SELECT f.customer_unique_id, fo.cohort_month,
               date_diff('month', fo.cohort_month, date_trunc('month', f.order_purchase_timestamp)::DATE)::INT
                   AS months_since_first
        FROM fact f JOIN first_orders fo USING (customer_unique_id)),
    sizes AS (SELECT cohort_month, count(*) AS cohort_size FROM first_orders GROUP BY 1)"""


RETENTION = """
    SELECT t.cohort_month, t.months_since_first, count(DISTINCT t.customer_unique_id) AS active_customers,
           s.cohort_size, count(DISTINCT t.customer_unique_id) * 100.0::DOUBLE / s.cohort_size AS retention_pct
    FROM tagged t JOIN sizes s USING (cohort_month) GROUP BY t.cohort_month, t.months_since_first, s.cohort_size"""


def repeat(where: str) -> str:
    return f"""
    SELECT count(*) AS customers, count(*) FILTER (n > 1) AS returning_customers,
           count(*) FILTER (n > 1) * 100.0::DOUBLE / count(*) AS repeat_rate_pct,
           avg(n) FILTER (n > 1) AS avg_orders_returning
    FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM fact WHERE {where} GROUP BY 1) c"""


def box(group: str, source: str, measure: str) -> str:
    return f"""SELECT {group}, '{measure}' AS measure, count({measure}) AS n,
        avg({measure}::DOUBLE) AS mean, min({measure})::DOUBLE AS min, max({measure})::DOUBLE AS max,
        quantile_cont({measure}::DOUBLE, 0.25) AS q1, quantile_cont({measure}::DOUBLE, 0.5) AS median,
        quantile_cont({measure}::DOUBLE, 0.75) AS q3
        FROM {source} WHERE {measure} IS NOT NULL GROUP BY {group}"""


def rescaled(measure: str, floor: str = "1e-9") -> str:
    return f"({measure} - min({measure}) OVER ()) / greatest(max({measure}) OVER () - min({measure}) OVER (), {floor}::DOUBLE)"


LEADERS = """leaders AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY score_bucket, dimension ORDER BY items DESC, value)::INT AS rank
        FROM (
            SELECT score_bucket, 'category' AS dimension, product_category_name_english AS value, count(*) AS items
            FROM scored WHERE product_category_name_english IS NOT NULL GROUP BY ALL
            UNION ALL
            SELECT score_bucket, 'state', customer_state, count(*)
            FROM scored WHERE customer_state IS NOT NULL GROUP BY ALL) counted) ranked
    WHERE rank <= 3)"""
DRIVER_MEDIANS = """
    SELECT score_bucket, count(*) AS n, quantile_cont(delay_days::DOUBLE, 0.5) AS median_delay_days,
           quantile_cont(transit_days::DOUBLE, 0.5) AS median_transit_days,
           quantile_cont(freight_ratio::DOUBLE, 0.5) AS median_freight_ratio,
           round(quantile_cont(seller_customer_distance_km::DOUBLE, 0.5), 3) AS median_seller_customer_distance_km
    FROM scored GROUP BY score_bucket"""
STATE_NAMES = """names(uf, state_name) AS (VALUES
    ('RO','Rondônia'), ('AC','Acre'), ('AM','Amazonas'), ('RR','Roraima'), ('PA','Pará'), ('AP','Amapá'),
    ('TO','Tocantins'), ('MA','Maranhão'), ('PI','Piauí'), ('CE','Ceará'), ('RN','Rio Grande do Norte'),
    ('PB','Paraíba'), ('PE','Pernambuco'), ('AL','Alagoas'), ('SE','Sergipe'), ('BA','Bahia'),
    ('MG','Minas Gerais'), ('ES','Espírito Santo'), ('RJ','Rio de Janeiro'), ('SP','São Paulo'), ('PR','Paraná'),
    ('SC','Santa Catarina'), ('RS','Rio Grande do Sul'), ('MS','Mato Grosso do Sul'), ('MT','Mato Grosso'),
    ('GO','Goiás'), ('DF','Distrito Federal'))"""
FACT_KEYS = "order_id, order_item_id, product_id, seller_id"

ORACLE: dict[str, str] = {
    # Data preparation
    "scan_views": """SELECT n_name, count(*) AS items, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "clean_zip_pad": """SELECT c_custkey,
        CASE WHEN length(c_custkey::VARCHAR) < 5 THEN lpad(c_custkey::VARCHAR, 5, '0') ELSE c_custkey::VARCHAR END AS zip
        FROM customer""",
    "clean_timestamps": """SELECT o_orderkey,
        TRY_CAST(CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)
            AS ts FROM orders""",
    "ingest_orders": """SELECT o_orderkey::VARCHAR AS order_id,
        CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey::VARCHAR END AS customer_id,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS order_status,
        o_orderdate AS order_purchase_timestamp,
        CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS order_approved_at,
        NULL::TIMESTAMP AS order_delivered_carrier_date, NULL::TIMESTAMP AS order_delivered_customer_date,
        o_orderdate AS order_estimated_delivery_date FROM orders""",
    "ingest_customers": """SELECT c_custkey::VARCHAR AS customer_id, (c_custkey // 2)::VARCHAR AS customer_unique_id,
        CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN length((c_custkey * 7)::VARCHAR) < 5
            THEN lpad((c_custkey * 7)::VARCHAR, 5, '0') ELSE (c_custkey * 7)::VARCHAR END AS customer_zip_code_prefix,
        c_mktsegment || ', "' || c_custkey::VARCHAR || '"' AS customer_city,
        CASE WHEN c_custkey % 11 <> 0 THEN 'SP' END AS customer_state FROM customer""",
    "ingest_reviews": """SELECT o_orderkey::VARCHAR AS order_id, (o_orderkey % 5 + 1)::TINYINT AS review_score,
        o_orderdate AS review_creation_date, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS review_answer_timestamp,
        'line ' || o_orderkey::VARCHAR || chr(10) || 'said "so", twice' AS review_comment_message FROM orders""",
    "ingest_parquet": """SELECT c_custkey::VARCHAR AS customer_id, (c_custkey // 2)::VARCHAR AS customer_unique_id,
        CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN length((c_custkey * 7)::VARCHAR) < 5
            THEN lpad((c_custkey * 7)::VARCHAR, 5, '0') ELSE (c_custkey * 7)::VARCHAR END AS customer_zip_code_prefix,
        c_mktsegment || ', "' || c_custkey::VARCHAR || '"' AS customer_city,
        CASE WHEN c_custkey % 11 <> 0 THEN 'SP' END AS customer_state FROM customer""",
    "geo_centroids": over_centroids("SELECT * FROM centroids"),
    "order_review_agg": over_summaries("SELECT * FROM order_reviews"),
    "order_payment_agg": over_summaries("SELECT * FROM order_payments"),
    "enrich_star_join": over_fact(
        f"""SELECT {FACT_KEYS}, customer_id, customer_unique_id, order_status, shipping_limit_date, price, freight_value,
        product_category_name, product_weight_g, seller_city, seller_state, customer_city, customer_state FROM joined"""
    ),
    "enrich_left_joins": over_fact(
        f"""SELECT {FACT_KEYS}, product_category_name_english, seller_lat, seller_lng, customer_lat, customer_lng,
        avg_review_score, min_review_score, review_count, total_payment, max_installments, primary_payment_type
        FROM joined"""
    ),
    "derived_measures": over_fact(f"SELECT {FACT_KEYS}, total_item_value, freight_ratio FROM fact"),
    "lifecycle_durations": over_fact(
        f"""SELECT {FACT_KEYS}, approval_wait_hours, carrier_wait_hours, transit_days, delay_days, is_late,
        order_year_month FROM fact"""
    ),
    "haversine_distance": over_fact(
        f"SELECT {FACT_KEYS}, round(seller_customer_distance_km::DOUBLE, 3) AS distance_km FROM fact"
    ),
    "rollup_state_monthly": over_fact(
        f"""SELECT customer_state, order_year_month, count(DISTINCT order_id) AS order_count,
        count(DISTINCT customer_unique_id) AS unique_customers, sum(total_item_value) AS gmv,
        avg(delay_days) AS avg_delay_days, {LATE_RATE} AS late_rate, avg(avg_review_score) AS avg_review_score
        FROM fact GROUP BY customer_state, order_year_month"""
    ),
    "rollup_category": over_fact(
        f"""SELECT product_category_name_english AS category, count(DISTINCT order_id) AS order_count,
        sum(total_item_value) AS gmv, avg(price) AS avg_price, avg(freight_ratio) AS avg_freight_ratio,
        avg(avg_review_score) AS avg_review_score, {LATE_RATE} AS late_rate, avg(transit_days) AS avg_transit_days
        FROM fact WHERE product_category_name_english IS NOT NULL GROUP BY 1"""
    ),
    "rollup_order": over_fact(
        """SELECT order_id, customer_id, customer_unique_id, customer_city, customer_state, customer_lat, customer_lng,
        order_status, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
        order_delivered_customer_date, order_estimated_delivery_date, avg_review_score, min_review_score, review_count,
        total_payment, max_installments, primary_payment_type, approval_wait_hours, carrier_wait_hours, transit_days,
        delay_days, is_late, order_year_month, count(*) AS items, sum(total_item_value) AS order_value
        FROM fact GROUP BY ALL"""
    ),
    "rollup_seller": over_fact(
        f"""SELECT seller_id, seller_city, seller_state, seller_lat, seller_lng, count(DISTINCT order_id) AS order_count,
        sum(total_item_value) AS gmv, avg(avg_review_score) AS avg_review_score, {LATE_RATE} AS late_rate,
        avg(approval_wait_hours) AS avg_approval_wait_hours,
        count(DISTINCT product_category_name_english) AS category_count
        FROM fact GROUP BY seller_id, seller_city, seller_state, seller_lat, seller_lng"""
    ),
    "quality_checks": over_fact(
        """SELECT 'fact_rows_minus_item_rows' AS "check", (fact_rows - item_rows)::DOUBLE AS observed,
               fact_rows = item_rows AS passed FROM seen
        UNION ALL SELECT 'lost_zips', (zips - zip_rows)::DOUBLE, zip_rows = zips FROM seen
        UNION ALL SELECT 'duplicate_orders', (order_rows - orders)::DOUBLE, order_rows = orders FROM seen
        UNION ALL SELECT 'distance_share', located / fact_rows, located / fact_rows > 0.9 FROM seen
        UNION ALL SELECT 'late_share', late::DOUBLE / fact_rows, true FROM seen
        UNION ALL SELECT 'unknown_statuses', unknown::DOUBLE, unknown = 0 FROM seen
        UNION ALL SELECT 'pickup_before_approval', pickup_first::DOUBLE, true FROM seen""",
        """seen AS (
        SELECT count(*) AS fact_rows, count(seller_customer_distance_km)::DOUBLE AS located,
               count(*) FILTER (delay_days > 0) AS late, count(*) FILTER (carrier_wait_hours < 0) AS pickup_first,
               count(DISTINCT order_status) FILTER (order_status NOT IN ('delivered', 'shipped', 'canceled',
                   'unavailable', 'processing', 'invoiced', 'created', 'approved')) AS unknown,
               count(DISTINCT order_id) AS orders,
               (SELECT count(*) FROM (
                   SELECT DISTINCT order_id, customer_id, customer_unique_id, order_status, order_purchase_timestamp,
                          delay_days, avg_review_score, primary_payment_type FROM fact) o) AS order_rows,
               (SELECT count(*) FROM raw_items) AS item_rows, (SELECT count(*) FROM centroids) AS zip_rows,
               (SELECT count(DISTINCT zip) FROM raw_geolocation) AS zips
        FROM fact)""",
    ),
    "quality_checks_failing": over_fact(
        """SELECT 'distance_share' AS "check", count(seller_customer_distance_km)::DOUBLE / count(*) AS observed,
            count(seller_customer_distance_km)::DOUBLE / count(*) > 0.999 AS passed FROM fact
        UNION ALL SELECT 'late_share', count(*) FILTER (delay_days > 0)::DOUBLE / count(*),
            count(*) FILTER (delay_days > 0)::DOUBLE / count(*) BETWEEN 0.0 AND 0.0001 FROM fact
        UNION ALL SELECT 'unknown_statuses', count(DISTINCT order_status) FILTER (order_status <> 'delivered')::DOUBLE,
            count(DISTINCT order_status) FILTER (order_status <> 'delivered') = 0 FROM fact"""
    ),
    # Filters
    "filter_all": over_fact(
        f"SELECT {FACT_KEYS}, total_item_value FROM fact WHERE {WINDOW} AND {PICKED} AND total_item_value >= 100.5"
    ),
    "filter_date_range": over_fact(f"SELECT {FACT_KEYS}, order_purchase_timestamp FROM fact WHERE {WINDOW}"),
    "filter_in_lists": over_fact(f"SELECT {FACT_KEYS}, customer_state, order_status FROM fact WHERE {PICKED}"),
    "filter_min_value": over_fact(f"SELECT {FACT_KEYS}, total_item_value FROM fact WHERE total_item_value >= 512.25"),
    "filter_seller_state": over_fact(
        f"SELECT {FACT_KEYS}, seller_state FROM fact WHERE seller_state IN ('SP', 'PR', 'RS')"
    ),
    "filter_options": over_fact(
        """SELECT DISTINCT 'customer_state' AS "filter", customer_state AS "option" FROM fact
        UNION SELECT 'product_category_name_english', product_category_name_english FROM fact
              WHERE product_category_name_english IS NOT NULL
        UNION SELECT 'order_status', order_status FROM fact UNION SELECT 'seller_state', seller_state FROM fact"""
    ),
    # Overview and geography
    "overview_kpis": over_fact(
        f"""SELECT count(DISTINCT order_id) AS total_orders, sum(total_item_value) AS total_gmv,
        avg(avg_review_score) AS avg_review_score, {LATE_PCT} AS late_delivery_pct FROM fact"""
    ),
    "overview_kpis_filtered": over_fact(
        f"""SELECT count(DISTINCT order_id) AS total_orders, sum(total_item_value) AS total_gmv,
        avg(avg_review_score) AS avg_review_score, {LATE_PCT} AS late_delivery_pct
        FROM fact WHERE {WINDOW} AND {PICKED} AND total_item_value >= 100.5"""
    ),
    "monthly_orders": over_fact(
        """SELECT date_trunc('month', order_purchase_timestamp)::DATE AS month, count(DISTINCT order_id) AS orders
        FROM fact GROUP BY 1"""
    ),
    "top_states_gmv": over_fact(
        """SELECT customer_state, sum(total_item_value) AS gmv FROM fact GROUP BY 1
        ORDER BY gmv DESC NULLS LAST, customer_state LIMIT 5"""
    ),
    "geo_state_metrics": over_fact(f"SELECT customer_state, {GEO} FROM fact GROUP BY customer_state"),
    "geo_state_metrics_window": over_fact(
        f"SELECT customer_state, {GEO} FROM fact WHERE {WINDOW} GROUP BY customer_state"
    ),
    "geo_state_metrics_filtered": over_fact(
        f"SELECT customer_state, {GEO} FROM fact WHERE {MANY} GROUP BY customer_state"
    ),
    "geo_state_ranked": over_fact(
        """SELECT customer_state, count(DISTINCT customer_unique_id) AS unique_customers FROM fact GROUP BY 1"""
    ),
    "city_drilldown": over_fact("SELECT * FROM cities", CITIES),
    "city_top20": over_fact(
        """SELECT customer_city, avg_review_score FROM cities
        WHERE avg_review_score IS NOT NULL AND customer_city IS NOT NULL
        ORDER BY avg_review_score DESC, customer_city LIMIT 20""",
        CITIES,
    ),
    "city_extent": over_fact(
        """SELECT round(avg(lat), 9) AS center_lat, round(avg(lng), 9) AS center_lng, lat_span, lng_span,
            greatest(lat_span, lng_span, 0.5::DOUBLE) AS span
        FROM (SELECT *, max(lat) OVER () - min(lat) OVER () AS lat_span, max(lng) OVER () - min(lng) OVER () AS lng_span
              FROM cities WHERE lat IS NOT NULL AND lng IS NOT NULL) c GROUP BY lat_span, lng_span""",
        CITIES,
    ),
    "dim_state_lookup": over_fact(
        """SELECT f.customer_state, coalesce(n.state_name, f.customer_state) AS state_name, f.orders
        FROM (SELECT customer_state, count(DISTINCT order_id) AS orders FROM fact GROUP BY 1) f
        LEFT JOIN names n ON n.uf = f.customer_state""",
        STATE_NAMES,
    ),
    "overview_kpis_default": over_fact(
        f"""SELECT count(DISTINCT order_id) AS total_orders, sum(total_item_value) AS total_gmv,
        avg(avg_review_score) AS avg_review_score, CASE WHEN count(*) > 0 THEN {LATE_PCT} END AS late_delivery_pct FROM fact
        WHERE order_purchase_timestamp >= DATE '2016-09-04' AND order_purchase_timestamp <= DATE '2018-09-03'"""
    ),
    "state_boundaries": over_fact(
        f"""SELECT customer_state, order_count, state_name,
            CASE WHEN k IS NOT NULL THEN '{{"type":"Polygon","coordinates":[[['||k||',0],['||k||',1],['||(k + 1)||',1],['||k||',0]]]}}' END
                AS geometry
        FROM (SELECT customer_state, count(DISTINCT order_id) AS order_count FROM fact GROUP BY 1) m
        LEFT JOIN (SELECT n_nationkey AS k, codes[n_nationkey + 1] AS uf FROM nation, state_codes) b ON uf = customer_state
        LEFT JOIN names n ON n.uf = b.uf""",
        STATE_NAMES,
    ),
    # Flows
    "flow_routes": over_fact("SELECT * REPLACE (round(avg_distance_km, 3) AS avg_distance_km) FROM routes", routes(50)),
    "flow_routes_filtered": over_fact(
        "SELECT * REPLACE (round(avg_distance_km, 3) AS avg_distance_km) FROM routes",
        routes(5, f"{WINDOW} AND order_status IN ('delivered') AND seller_state IN ('SP', 'PR', 'RS')"),
    ),
    "flow_kpis": over_fact(
        f"""SELECT count(*) FILTER ({CROSSES}) AS cross_state_routes, sum(gmv) AS total_gmv,
        (SELECT seller_state FROM routes WHERE seller_state IS NOT NULL GROUP BY 1
         ORDER BY sum(order_count) DESC, seller_state LIMIT 1) AS top_seller_state,
        (SELECT customer_state FROM routes WHERE customer_state IS NOT NULL GROUP BY 1
         ORDER BY sum(order_count) DESC, customer_state LIMIT 1) AS top_buyer_state FROM routes""",
        routes(50),
    ),
    "flow_matrix": over_fact(
        """SELECT seller_state, customer_state, count(DISTINCT order_id) AS order_count FROM fact
        WHERE seller_state IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1, 2"""
    ),
    "flow_matrix_wide": over_fact(
        "SELECT seller_state, "
        + ", ".join(f"""count(DISTINCT order_id) FILTER (customer_state = '{uf}') AS "{uf}\"""" for uf in UFS)
        + " FROM fact WHERE seller_state IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1"
    ),
    "flow_top_routes": over_fact(
        f"""SELECT seller_state, customer_state, order_count, gmv, avg_delay_days,
        round(avg_distance_km, 3) AS avg_distance_km FROM routes WHERE {CROSSES}
        ORDER BY order_count DESC, seller_state, customer_state LIMIT 20""",
        routes(50),
    ),
    "flow_route_labels": over_fact(
        f"""SELECT seller_state AS seller, customer_state AS buyer, order_count AS orders,
        'R$ ' || format('{{:,.0f}}', gmv) AS gmv_label, coalesce(format('{{:.1f}}', avg_delay_days), 'N/A') AS avg_delay_label,
        coalesce(format('{{:,.0f}}', avg_distance_km), 'N/A') AS avg_distance_label
        FROM routes WHERE {CROSSES} ORDER BY order_count DESC, seller_state, customer_state LIMIT 20""",
        routes(50),
    ),
    # Delivery
    "delivery_kpis": over_fact(
        f"""SELECT {LATE_PCT} AS late_delivery_pct, avg(delay_days) FILTER (delay_days > 0) AS avg_delay_when_late,
        avg(transit_days) AS avg_transit_days, count(DISTINCT order_id) AS total_orders,
        100.0::DOUBLE - {LATE_PCT} AS on_time_pct FROM fact"""
    ),
    "delay_by_state": over_fact("SELECT * FROM delays", DELAYS),
    "delay_summary": over_fact(
        """SELECT customer_state, avg_delay_days, late_pct, avg_transit_days,
        row_number() OVER (ORDER BY avg_delay_days DESC NULLS LAST, customer_state NULLS LAST) AS position
        FROM delays WHERE avg_delay_days IS NOT NULL""", DELAYS
    ),
    "stage_breakdown": over_fact("SELECT * FROM stages", STAGES),
    "stage_breakdown_long": over_fact(
        """SELECT customer_state, 'Order → Approval' AS stage, avg_days_to_approve AS days FROM stages
        UNION ALL SELECT customer_state, 'Approval → Carrier', avg_days_to_pickup FROM stages
        UNION ALL SELECT customer_state, 'Carrier → Delivery', avg_transit_days FROM stages""",
        STAGES,
    ),
    "delay_histogram": over_fact(
        """SELECT floor(delay_days)::BIGINT AS delay_bin,
        CASE WHEN delay_days > 0 THEN 'Late' ELSE 'Early / On Time' END AS status,
        count(*) AS items FROM fact WHERE delay_days IS NOT NULL GROUP BY 1, 2"""
    ),
    "delay_medians": over_fact(
        """SELECT count(*) FILTER (delay_days > 0) AS n_late, count(*) FILTER (delay_days <= 0) AS n_early,
        quantile_cont(delay_days::DOUBLE, 0.5) FILTER (delay_days > 0) AS median_late,
        quantile_cont(delay_days::DOUBLE, 0.5) FILTER (delay_days <= 0) AS median_early FROM fact"""
    ),
    "delay_medians_filtered": over_fact(
        f"""SELECT count(*) FILTER (delay_days > 0) AS n_late, count(*) FILTER (delay_days <= 0) AS n_early,
        quantile_cont(delay_days::DOUBLE, 0.5) FILTER (delay_days > 0) AS median_late,
        quantile_cont(delay_days::DOUBLE, 0.5) FILTER (delay_days <= 0) AS median_early FROM fact WHERE {MANY}"""
    ),
    # Categories
    "category_scorecard": over_fact(
        "SELECT *, row_number() OVER (ORDER BY gmv DESC NULLS LAST, category NULLS LAST) AS position FROM categories", CATEGORIES
    ),
    "category_kpis": over_fact(
        """SELECT count(*) AS n_categories, sum(gmv) AS total_gmv, round(avg(avg_review_score), 9) AS avg_review_score,
        round(avg(late_pct), 9) AS avg_late_pct FROM categories""",
        CATEGORIES,
    ),
    "category_flags": over_fact(
        f"""SELECT *, {REVIEW_FLAG} AS review_flag, {LATE_FLAG} AS late_flag,
        CASE WHEN avg_freight_ratio > 0.30::DOUBLE THEN 'red' END AS freight_flag FROM categories""",
        CATEGORIES,
    ),
    "category_quadrants": over_fact(
        f"""SELECT *, {QUADRANT} AS quadrant, round(greatest(ln(1 + gmv), 1.0::DOUBLE), 6) AS bubble_size FROM categories
        WHERE avg_review_score IS NOT NULL AND late_pct IS NOT NULL AND gmv IS NOT NULL""",
        CATEGORIES,
    ),
    "category_top5": over_fact(
        "SELECT category, gmv, avg_review_score, late_pct FROM categories ORDER BY gmv DESC NULLS LAST, category LIMIT 5", CATEGORIES
    ),
    "category_worst5": over_fact(
        f"""SELECT category, avg_review_score, late_pct, order_count, {REVIEW_FLAG} AS review_flag FROM categories
        WHERE order_count >= 50 ORDER BY avg_review_score NULLS LAST, gmv DESC NULLS LAST, category LIMIT 5""",
        CATEGORIES,
    ),
    # Sellers
    "seller_leaderboard": over_fact("SELECT * FROM sellers", sellers()),
    "seller_kpis": over_fact(
        """SELECT count(*) AS n_sellers, sum(gmv) AS total_gmv, round(avg(avg_review_score), 9) AS avg_review_score,
        round(avg(late_pct), 9) AS avg_late_pct FROM sellers""",
        sellers(),
    ),
    "seller_quadrants": over_fact(
        f"""SELECT *, {REVIEW_FLAG} AS review_flag, {LATE_FLAG} AS late_flag, {QUADRANT} AS quadrant,
        round(greatest(ln(1 + gmv), 1.0::DOUBLE), 6) AS bubble_size, seller_id[1:12] || '…' AS short_id FROM sellers
        WHERE avg_review_score IS NOT NULL AND late_pct IS NOT NULL AND gmv IS NOT NULL""",
        sellers(),
    ),
    "seller_display": over_fact(
        f"""SELECT seller_id[1:12] || '…' AS seller, {title('seller_city')} AS city, seller_state AS state,
        order_count AS orders, gmv, avg_review_score AS avg_review, late_pct,
        avg_approval_wait_hours AS approval_wait_hours, category_count AS categories, {REVIEW_FLAG} AS review_flag,
        {LATE_FLAG} AS late_flag FROM sellers""",
        sellers(),
    ),
    "seller_spotlight": over_fact(
        f"""SELECT *, {title('seller_city')} || ', ' || seller_state AS location, format('{{:,}}', order_count) AS orders_label,
        'R$ ' || format('{{:,.0f}}', gmv) AS gmv_label, format('{{:.2f}}', avg_review_score) AS review_label,
        format('{{:.1f}}', late_pct) || '%' AS late_label FROM sellers WHERE seller_id = 'Supplier#000000007'""",
        sellers(),
    ),
    "seller_top5": over_fact(
        """SELECT seller_id[1:12] || '…' AS seller, seller_city, seller_state, order_count, gmv, avg_review_score, late_pct
        FROM sellers ORDER BY gmv DESC NULLS LAST, seller_id, seller_city, seller_state LIMIT 5""",
        sellers(),
    ),
    "seller_worst5": over_fact(
        f"""SELECT seller_id[1:12] || '…' AS seller, seller_city, seller_state, order_count, avg_review_score, late_pct,
        {REVIEW_FLAG} AS review_flag FROM sellers WHERE order_count >= 50
        ORDER BY avg_review_score NULLS LAST, gmv DESC NULLS LAST, seller_id, seller_city, seller_state LIMIT 5""",
        sellers(),
    ),
    # Payments
    "payment_kpis": over_fact(
        """SELECT count(DISTINCT order_id) AS total_orders,
        count(*) FILTER (primary_payment_type = 'credit_card') * 100.0::DOUBLE / nullif(count(primary_payment_type), 0) AS cc_pct,
        avg(CASE WHEN max_installments > 0 THEN max_installments END) AS avg_installments,
        count(*) FILTER (primary_payment_type = 'boleto') * 100.0::DOUBLE / nullif(count(primary_payment_type), 0) AS boleto_pct
        FROM fact"""
    ),
    "payment_mix": over_fact(
        f"""SELECT value_tier, primary_payment_type, {PAY_LABEL} AS payment_label, order_count,
        order_count / sum(order_count) OVER (PARTITION BY value_tier)::DOUBLE * 100 AS pct,
        row_number() OVER (ORDER BY list_position(['<50', '50–200', '200–500', '500–1000', '1000+'], value_tier),
            primary_payment_type) AS position
        FROM (SELECT {TIER} AS value_tier, primary_payment_type, count(DISTINCT order_id) AS order_count
              FROM fact WHERE primary_payment_type IS NOT NULL GROUP BY 1, 2) t"""
    ),
    "installments_monthly": over_fact(
        """SELECT date_trunc('month', order_purchase_timestamp)::DATE AS month, avg(max_installments) AS avg_installments,
        count(DISTINCT order_id) AS orders FROM fact
        WHERE max_installments > 0 AND primary_payment_type = 'credit_card' GROUP BY 1"""
    ),
    "installment_order_level": over_fact("SELECT * FROM order_level", ORDER_LEVEL),
    "installment_box": over_fact(
        f"SELECT * EXCLUDE (measure) FROM ({box('installment_bucket', 'order_level', 'avg_review_score')}) b", ORDER_LEVEL
    ),
    "payment_summary": over_fact(
        f"""SELECT primary_payment_type, count(DISTINCT order_id) AS orders, sum(total_item_value) AS gmv,
        avg(CASE WHEN max_installments > 0 THEN max_installments END) AS avg_installments,
        avg(avg_review_score) AS avg_review, {PAY_LABEL} AS payment_label
        FROM fact WHERE primary_payment_type IS NOT NULL GROUP BY primary_payment_type"""
    ),
    "installment_summary": over_fact(
        f"""SELECT *, row_number() OVER (ORDER BY list_position(['1', '2–3', '4–6', '7–12', '12+'], installment_bucket))
            AS position
        FROM (SELECT {bucket('max_installments')} AS installment_bucket, count(DISTINCT order_id) AS orders,
            avg(avg_review_score) AS avg_review, {LATE_PCT} AS late_pct FROM fact WHERE max_installments > 0 GROUP BY 1) b"""
    ),
    "installment_box_filtered": over_fact(
        f"SELECT * EXCLUDE (measure) FROM ({box('installment_bucket', 'order_level', 'avg_review_score')}) b",
        order_level(MANY),
    ),
    # Cohorts, reviews, funnel
    "cohort_retention": over_fact(RETENTION, cohorts("true")),
    "cohort_retention_wide": over_fact(
        "SELECT cohort_month, "
        + ", ".join(f'max(retention_pct) FILTER (months_since_first = {i}) AS "{i}"' for i in range(MONTHS))
        + f" FROM ({RETENTION}) r GROUP BY cohort_month",
        cohorts("true"),
    ),
    "cohort_retention_window": over_fact(RETENTION, cohorts(WINDOW)),
    "repeat_purchase_kpis": over_fact(repeat("true")),
    "repeat_purchase_kpis_window": over_fact(
        repeat("order_purchase_timestamp >= DATE '1997-03-01' AND order_purchase_timestamp <= DATE '1997-05-31'")
    ),
    "review_driver_rows": over_fact(
        """SELECT score_bucket, delay_days, transit_days, freight_ratio,
        round(seller_customer_distance_km::DOUBLE, 3) AS seller_customer_distance_km FROM scored""",
        SCORED,
    ),
    "review_driver_medians": over_fact(DRIVER_MEDIANS, SCORED),
    "review_driver_box": over_fact(
        "SELECT * REPLACE (round(mean, 3) AS mean, round(min, 3) AS min, round(max, 3) AS max, round(q1, 3) AS q1,"
        " round(median, 3) AS median, round(q3, 3) AS q3) FROM ("
        + " UNION ALL ".join(
            box("score_bucket", "scored", c)
            for c in ("delay_days", "transit_days", "freight_ratio", "seller_customer_distance_km")
        )
        + ") b",
        SCORED,
    ),
    "review_driver_top3": over_fact("SELECT score_bucket, dimension, value, items, rank FROM leaders", SCORED, LEADERS),
    "review_driver_summary": over_fact(
        f"""SELECT m.*, t.top_categories, t.top_states FROM ({DRIVER_MEDIANS}) m LEFT JOIN (
            SELECT score_bucket, string_agg(value, ', ' ORDER BY rank) FILTER (dimension = 'category') AS top_categories,
                   string_agg(value, ', ' ORDER BY rank) FILTER (dimension = 'state') AS top_states
            FROM leaders GROUP BY 1) t USING (score_bucket)""",
        SCORED,
        LEADERS,
    ),
    "order_funnel": over_fact(
        """SELECT count(DISTINCT order_id) AS placed,
        count(DISTINCT CASE WHEN order_approved_at IS NOT NULL THEN order_id END) AS approved,
        count(DISTINCT CASE WHEN order_delivered_carrier_date IS NOT NULL THEN order_id END) AS carrier_pickup,
        count(DISTINCT CASE WHEN order_delivered_customer_date IS NOT NULL THEN order_id END) AS delivered FROM fact"""
    ),
    "order_funnel_filtered": over_fact(
        f"""SELECT count(DISTINCT order_id) AS placed,
        count(DISTINCT CASE WHEN order_approved_at IS NOT NULL THEN order_id END) AS approved,
        count(DISTINCT CASE WHEN order_delivered_carrier_date IS NOT NULL THEN order_id END) AS carrier_pickup,
        count(DISTINCT CASE WHEN order_delivered_customer_date IS NOT NULL THEN order_id END) AS delivered
        FROM fact WHERE {WINDOW} AND {PICKED} AND total_item_value >= 100.5"""
    ),
    "status_breakdown": over_fact(
        """SELECT order_status, orders, orders * 100.0::DOUBLE / sum(orders) OVER () AS pct
        FROM (SELECT order_status, count(DISTINCT order_id) AS orders FROM fact GROUP BY 1) s"""
    ),
    "stage_median_by_status": over_fact(
        """SELECT order_status, count(*) AS n, quantile_cont(approval_wait_hours::DOUBLE, 0.5) AS median_approval_hours,
        quantile_cont(carrier_wait_hours::DOUBLE, 0.5) AS median_pickup_hours,
        quantile_cont(transit_days::DOUBLE * 24, 0.5) AS median_transit_hours FROM fact GROUP BY order_status"""
    ),
    # Map marks
    "scaled_marks": over_fact(
        f"""SELECT m.customer_state, lat, lng, gmv, {rescaled('gmv')} AS color_position,
        90000::DOUBLE + {rescaled('gmv')} * 190000::DOUBLE AS radius, 'R$ ' || format('{{:,.0f}}', gmv) AS label,
        coalesce(n.state_name, m.customer_state) AS state_name
        FROM (SELECT customer_state, {GEO} FROM fact GROUP BY customer_state) m LEFT JOIN names n ON n.uf = m.customer_state
        WHERE lat IS NOT NULL AND lng IS NOT NULL AND gmv IS NOT NULL""",
        STATE_NAMES,
    ),
    "scaled_marks_flow": over_fact(
        f"""SELECT seller_state, customer_state, seller_lat, seller_lng, customer_lat, customer_lng,
        2::DOUBLE + {rescaled('order_count', '1')} * 12::DOUBLE AS width, {rescaled('shade')} AS color_position,
        format('{{:,}}', order_count) AS orders_label, 'R$ ' || format('{{:,.0f}}', gmv) AS gmv_label,
        coalesce(format('{{:.1f}}', avg_delay_days) || ' days', 'N/A') AS delay_label,
        coalesce(format('{{:,.0f}}', avg_distance_km) || ' km', 'N/A') AS distance_label
        FROM (SELECT *, coalesce(avg_delay_days, 0) AS shade FROM routes) r WHERE {CROSSES} AND seller_lat IS NOT NULL
        AND seller_lng IS NOT NULL AND customer_lat IS NOT NULL AND customer_lng IS NOT NULL""",
        routes(50),
    ),
    "scaled_marks_seller": over_fact(
        f"""SELECT seller_id, seller_id[1:8] || '…' AS short_id, seller_city, seller_state, seller_lat, seller_lng,
        {rescaled('avg_review_score', '0.01')} AS color_position,
        round(12000::DOUBLE + {rescaled('log_gmv')} * 88000::DOUBLE, 3) AS radius,
        format('{{:.2f}}', avg_review_score) AS review_label, 'R$ ' || format('{{:,.0f}}', gmv) AS gmv_label,
        format('{{:,}}', order_count) AS orders_label, format('{{:.1f}}', late_pct) || '%' AS late_label
        FROM (SELECT *, ln(1 + greatest(gmv, 0)) AS log_gmv FROM sellers) s
        WHERE seller_lat IS NOT NULL AND seller_lng IS NOT NULL AND avg_review_score IS NOT NULL AND gmv IS NOT NULL""",
        sellers(),
    ),
    "delay_divergence": over_fact(
        """SELECT customer_state, lat, lng, avg_delay_days,
        greatest(-1.0::DOUBLE, least(1.0::DOUBLE, avg_delay_days / extreme)) AS color_position,
        80000::DOUBLE + abs(avg_delay_days) / extreme * 160000::DOUBLE AS radius,
        CASE WHEN avg_delay_days > 0 THEN '+' ELSE '' END || format('{:.1f}', avg_delay_days) AS delay_label,
        format('{:.1f}', late_pct) || '%' AS late_label, format('{:.1f}', avg_transit_days) || ' days' AS transit_label
        FROM (SELECT *, greatest(abs(min(avg_delay_days) OVER ()), max(avg_delay_days) OVER (), 1.0::DOUBLE) AS extreme
              FROM delays WHERE lat IS NOT NULL AND lng IS NOT NULL AND avg_delay_days IS NOT NULL) d""",
        DELAYS,
    ),
}
