"""Oracle SQL (DuckDB dialect) for every checked query.

These are plain warehouse SQL statements over the driver's pre-registered
views: an independent statement of each query's meaning. The Spark plans
compute the same results with skew-safe operators. Shared CTEs are composed
from the fragments below. Rounded values use the same integer formulas as
``orderflow.functions.exact``, so both engines give equal decimals.
"""

from __future__ import annotations

# -- fixture adapter (test tables -> scored order rows) ---------------------
RAW = """
e AS (
  SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, value,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events
), base AS (
  SELECT concat('ORD-', CAST(event_id AS VARCHAR)) AS order_id,
         CASE WHEN k = 13 THEN CAST(NULL AS VARCHAR) ELSE concat('user_', CAST(user_id AS VARCHAR)) END AS user_id,
         'PROD-' || CAST(k AS VARCHAR) AS product_id,
         p_name AS product_name, p_type AS category,
         CASE WHEN k = 17 THEN CAST(-value AS DECIMAL(12,2))
              WHEN k % 10 = 0 THEN CAST(CAST(value AS DECIMAL(12,2)) * 25 AS DECIMAL(12,2))
              ELSE CAST(value AS DECIMAL(12,2)) END AS amount,
         CAST(1 + k % 5 AS INT) AS quantity,
         CASE k % 4 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'UPI' WHEN 2 THEN 'PayPal' ELSE 'Debit Card' END AS payment_method,
         concat('10.0.', CAST(k AS VARCHAR), '.', CAST(user_id % 20 AS VARCHAR)) AS ip_address,
         CASE k % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
         CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS location_mismatch,
         CAST((user_id * 37) % 400 AS INT) AS account_age_days,
         'addr_' || CAST(user_id % 40 AS VARCHAR) AS shipping_address, CAST(event_id % 45 AS INT) AS checkout_seconds,
         CASE WHEN k = 19 THEN ts + INTERVAL '3650' DAY ELSE ts END AS timestamp,
         CAST(floor((epoch_us(ts) - 1704067200000000) / 1440) AS BIGINT) AS burst_us
  FROM e LEFT JOIN part ON p_partkey = k
), dup AS (
  SELECT * FROM base
  UNION ALL
  SELECT order_id, user_id, product_id, product_name, category, amount, quantity, payment_method,
         ip_address, device_type, location_mismatch, account_age_days, shipping_address, checkout_seconds,
         timestamp + INTERVAL '1' SECOND AS timestamp, burst_us
  FROM base WHERE CAST(substring(order_id, 5) AS BIGINT) % 50 = 0
), vel AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY user_id ORDER BY burst_us
              RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS INT) AS orders_per_user_1m
  FROM dup
), raw AS (
  SELECT *, CAST(least(CAST(1 AS DECIMAL(6,4)), CAST(
           CAST(0.05 AS DECIMAL(6,4)) + CAST(0.25 AS DECIMAL(6,4)) * location_mismatch
         + CASE WHEN amount > 1000 THEN CAST(0.35 AS DECIMAL(6,4)) ELSE CAST(0 AS DECIMAL(6,4)) END
         + CASE WHEN hour(timestamp) BETWEEN 0 AND 5 THEN CAST(0.10 AS DECIMAL(6,4)) ELSE CAST(0 AS DECIMAL(6,4)) END
         + CAST(0.03 AS DECIMAL(6,4)) * least(orders_per_user_1m, 10) AS DECIMAL(6,4))) AS DECIMAL(6,4)) AS fraud_score
  FROM vel
), clock AS (
  SELECT max(ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL '1' SECOND ELSE INTERVAL '0' SECOND END) AS as_of
  FROM e WHERE coalesce(k <> 19, true)
)"""

REASONING = """coalesce(nullif(concat_ws('; ',
           CASE WHEN orders_per_user_1m > 5 THEN 'High Velocity (' || CAST(orders_per_user_1m AS VARCHAR) || ')' END,
           CASE WHEN location_mismatch = 1 THEN 'Location Mismatch' END,
           CASE WHEN amount > 1000 THEN 'High Ticket Value' END), ''), 'Normal Behavioral Profile')"""

GUARD = """coalesce(amount > 0 AND amount < 100000 AND user_id IS NOT NULL
                    AND timestamp <= (SELECT as_of FROM clock), false)"""

PROCESSED = RAW + f""", processed AS (
  SELECT order_id, sha256('orderflow-' || user_id) AS user_id,
         product_id, product_name, category, amount, amount AS order_amount, quantity, payment_method,
         sha256('orderflow-' || ip_address) AS ip_address, device_type, location_mismatch, account_age_days, shipping_address, checkout_seconds, timestamp,
         burst_us, orders_per_user_1m, fraud_score, fraud_score > 0.5 AS is_fraud,
         CASE WHEN fraud_score > 0.8 THEN 'CRITICAL' WHEN fraud_score > 0.4 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
         {REASONING} AS reasoning
  FROM raw WHERE {GUARD}
)"""


def staging(extra: str = "") -> str:
    extra_sel = "".join(f", {c}" for c in extra.split(",") if c.strip())
    return PROCESSED + f""", dedup AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id
            ORDER BY timestamp DESC, orders_per_user_1m DESC, fraud_score DESC) AS row_num
  FROM processed WHERE order_id IS NOT NULL
), stg AS (
  SELECT order_id, user_id, CAST(coalesce(order_amount, amount) AS DECIMAL(12,2)) AS order_amount,
         product_name, category, device_type,
         timestamp AS order_timestamp, CAST(timestamp AS DATE) AS order_date,
         CAST(hour(timestamp) AS INT) AS order_hour, CAST(dayofweek(timestamp) AS INT) AS day_of_week,
         dayofweek(timestamp) IN (0, 6) AS is_weekend,
         CAST(is_fraud AS BOOLEAN) AS is_fraud, CAST(fraud_score AS DECIMAL(6,4)) AS fraud_score, risk_level,
         CAST(location_mismatch AS BOOLEAN) AS location_mismatch,
         CAST(orders_per_user_1m AS INT) AS orders_per_user_1m, reasoning AS fraud_reasoning,
         coalesce(order_amount, amount) > 1000 AS is_high_value,
         hour(timestamp) BETWEEN 0 AND 5 AS is_late_night_order{extra_sel}
  FROM dedup
  WHERE row_num = 1 AND coalesce(order_amount, amount) > 0 AND coalesce(order_amount, amount) < 100000
)"""


STG = staging()


def rnd(num: str, den: str, scale: int, precision: int = 10) -> str:
    """round(num / den, scale), exact, for integer-valued num and den."""
    k = 10 ** scale
    step = "1" if scale == 0 else "0." + "0" * (scale - 1) + "1"
    mag = f"floor((abs({num}) * {2 * k} + ({den})) / (2 * ({den})))"
    return (f"CASE WHEN ({den}) <> 0 THEN CAST(CAST(CASE WHEN ({num}) < 0 THEN -{mag} ELSE {mag} END "
            f"AS DECIMAL(20,0)) * {step} AS DECIMAL({precision},{scale})) END")


def xr(num: str, den: str, scale: int, precision: int = 18) -> str:
    """Exact round(num / den, scale) half away from zero with HUGEINT division."""
    sgn = f"(CASE WHEN ({den}) < 0 THEN -1 ELSE 1 END)"
    n, d = f"(CAST({num} AS HUGEINT) * {sgn})", f"(CAST({den} AS HUGEINT) * {sgn})"
    q = f"((abs({n}) * {2 * 10 ** scale} + {d}) // (2 * {d}))"
    step = "1" if scale == 0 else "0." + "0" * (scale - 1) + "1"
    return (f"CASE WHEN ({den}) <> 0 THEN CAST(CAST(CASE WHEN {n} < 0 THEN -{q} ELSE {q} END AS DECIMAL(20,0)) "
            f"* {step} AS DECIMAL({precision},{scale})) END")


def mean6(col: str) -> str:
    """Exact mean rounded to six decimals (see functions.exact.mean_fixed)."""
    units = f"CAST(SUM(CAST({col} AS DECIMAL(38,6))) * 1000000 AS HUGEINT)"
    return f"CAST(CAST({xr(units, f'count({col})', 0, 38)} AS DECIMAL(38,0)) * 0.000001 AS DECIMAL(20,6))"


def mean(total: str, count: str) -> str:
    return f"CASE WHEN ({count}) <> 0 THEN CAST({total} AS DOUBLE) / CAST({count} AS DOUBLE) END"


def units(col: str, scale: int) -> str:
    return f"CAST({col} * {10 ** scale} AS BIGINT)"


def cnt_if(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def sum_if(cond: str, val: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN {val} ELSE 0 END) AS DECIMAL(18,2))"


def median(col: str) -> str:
    return f"CAST(round(quantile_cont(CAST({col} AS DOUBLE), 0.5), 3) AS DECIMAL(18,3))"


def mode_smallest(expr: str, group: str, src: str, alias: str) -> str:
    """Per-group most frequent non-NULL value, ties to the smallest."""
    return f"""{alias} AS (
  SELECT {group}, v AS {alias}_v FROM (
    SELECT {group}, v, ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY n DESC, v ASC) AS rn
    FROM (SELECT {group}, {expr} AS v, count(*) AS n FROM {src} WHERE {expr} IS NOT NULL GROUP BY {group}, {expr}) t
  ) s WHERE rn = 1
)"""


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


FRAUD_DAILY_CTE = STG + f""", daily AS (
  SELECT order_date, count(*) AS total_orders, count(DISTINCT user_id) AS unique_users,
         CAST(SUM(order_amount) AS DECIMAL(18,2)) AS total_revenue_usd,
         {cnt_if('is_fraud')} AS fraud_orders,
         {cnt_if("risk_level = 'CRITICAL'")} AS critical_orders,
         {cnt_if("risk_level = 'HIGH'")} AS high_risk_orders,
         {sum_if('is_fraud', 'order_amount')} AS fraud_revenue_at_risk_usd,
         SUM({units('fraud_score', 4)}) AS score_units,
         SUM(CASE WHEN is_fraud THEN {units('fraud_score', 4)} END) AS fraud_score_units,
         {cnt_if('location_mismatch')} AS location_mismatch_count,
         {cnt_if('is_late_night_order AND is_fraud')} AS late_night_fraud_count,
         {cnt_if('is_high_value AND is_fraud')} AS high_value_fraud_count
  FROM stg GROUP BY order_date
), {mode_smallest("CASE WHEN is_fraud THEN category END", "order_date", "stg", "topcat")}, daily2 AS (
  SELECT d.*, t.topcat_v AS top_fraud_category,
         {rnd('fraud_orders * 100', 'total_orders', 3)} AS fraud_rate_pct,
         {rnd('score_units', 'total_orders * 10000', 4)} AS avg_fraud_score,
         {rnd('fraud_score_units', 'fraud_orders * 10000', 4)} AS avg_fraud_score_on_positives
  FROM daily d LEFT JOIN topcat t USING (order_date)
)"""

FRAUD_DAILY = with_ctes(FRAUD_DAILY_CTE, f"""
SELECT order_date, total_orders, unique_users, total_revenue_usd, fraud_orders, critical_orders,
       high_risk_orders, fraud_revenue_at_risk_usd, fraud_rate_pct, avg_fraud_score,
       avg_fraud_score_on_positives, location_mismatch_count, late_night_fraud_count,
       high_value_fraud_count, top_fraud_category,
       {rnd(f"SUM({units('fraud_rate_pct', 3)}) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
            "COUNT(*) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 1000", 3)} AS fraud_rate_7d_avg,
       fraud_orders - LAG(fraud_orders, 1) OVER (ORDER BY order_date) AS fraud_orders_dod_change,
       total_orders - LAG(total_orders, 1) OVER (ORDER BY order_date) AS total_orders_dod_change,
       CAST(fraud_rate_pct - LAG(fraud_rate_pct, 7) OVER (ORDER BY order_date) AS DECIMAL(10,3)) AS fraud_rate_wow_change,
       (SELECT as_of FROM clock) AS dbt_updated_at
FROM daily2""")


DIM_PRODUCTS_CTE = STG + f""", pstats AS (
  SELECT product_name, category, count(*) AS total_orders, count(DISTINCT user_id) AS unique_buyers,
         CAST(SUM(order_amount) AS DECIMAL(18,2)) AS total_revenue_usd,
         {mean('SUM(order_amount)', 'count(*)')} AS avg_order_value_usd,
         MIN(order_amount) AS min_order_value_usd, MAX(order_amount) AS max_order_value_usd,
         {median('order_amount')} AS median_order_value_usd,
         {cnt_if('is_fraud')} AS fraud_order_count,
         {sum_if('is_fraud', 'order_amount')} AS total_fraud_exposure_usd,
         MIN(order_timestamp) AS first_order_at, MAX(order_timestamp) AS last_order_at,
         SUM(orders_per_user_1m) AS vel_sum,
         {cnt_if('is_late_night_order')} AS late_night_order_count,
         {cnt_if('is_high_value')} AS high_value_order_count
  FROM stg GROUP BY product_name, category
), dim_products AS (
  SELECT product_name, category, total_orders, unique_buyers, total_revenue_usd, avg_order_value_usd,
         min_order_value_usd, max_order_value_usd, median_order_value_usd, fraud_order_count,
         total_fraud_exposure_usd, first_order_at, last_order_at, late_night_order_count,
         high_value_order_count,
         {rnd('fraud_order_count * 100', 'total_orders', 2)} AS fraud_rate_pct,
         {rnd('vel_sum', 'total_orders', 2)} AS avg_velocity_per_user,
         CASE WHEN {rnd('fraud_order_count * 100', 'total_orders', 2)} > 20 THEN 'HIGH_RISK_PRODUCT'
              WHEN {rnd('fraud_order_count * 100', 'total_orders', 2)} > 10 THEN 'MEDIUM_RISK_PRODUCT'
              ELSE 'LOW_RISK_PRODUCT' END AS product_risk_tier,
         CAST(RANK() OVER (PARTITION BY category ORDER BY total_orders DESC) AS INT) AS rank_in_category,
         CAST(RANK() OVER (ORDER BY total_revenue_usd DESC) AS INT) AS revenue_rank_overall,
         (SELECT as_of FROM clock) AS dbt_updated_at
  FROM pstats
)"""

DIM_PRODUCTS = with_ctes(DIM_PRODUCTS_CTE, "SELECT * FROM dim_products")


DIM_USERS_CTE = STG + f""", ustats AS (
  SELECT user_id, count(*) AS total_orders, MIN(order_timestamp) AS first_order_at,
         MAX(order_timestamp) AS last_order_at,
         CAST(SUM(order_amount) AS DECIMAL(18,2)) AS total_spend_usd,
         {mean('SUM(order_amount)', 'count(*)')} AS avg_order_value_usd,
         MAX(order_amount) AS max_single_order_usd,
         {median('order_amount')} AS median_order_value_usd,
         {cnt_if('is_fraud')} AS fraud_order_count,
         {mean('SUM(fraud_score)', 'count(fraud_score)')} AS avg_fraud_score,
         MAX(fraud_score) AS max_fraud_score,
         {cnt_if('location_mismatch')} AS location_mismatch_count,
         {cnt_if('is_late_night_order')} AS late_night_order_count,
         {cnt_if('is_high_value')} AS high_value_order_count,
         {mean('SUM(orders_per_user_1m)', 'count(orders_per_user_1m)')} AS avg_velocity,
         MAX(orders_per_user_1m) AS peak_velocity,
         {cnt_if("order_timestamp > (SELECT as_of FROM clock) - INTERVAL '30' DAY")} AS orders_last_30d,
         {sum_if("order_timestamp > (SELECT as_of FROM clock) - INTERVAL '30' DAY", 'order_amount')} AS spend_last_30d_usd
  FROM stg GROUP BY user_id
), {mode_smallest('device_type', 'user_id', 'stg', 'pdev')}, {mode_smallest('category', 'user_id', 'stg', 'pcat')},
ustats2 AS (
  SELECT u.*, CAST(floor((epoch_us(last_order_at) - epoch_us(first_order_at)) / 86400000000) AS INT) AS days_as_customer,
         {rnd('fraud_order_count * 100', 'total_orders', 2)} AS fraud_rate_pct,
         d.pdev_v AS preferred_device, c.pcat_v AS preferred_category
  FROM ustats u LEFT JOIN pdev d USING (user_id) LEFT JOIN pcat c USING (user_id)
), dim_users AS (
  SELECT user_id, total_orders, first_order_at, last_order_at, days_as_customer, total_spend_usd,
         avg_order_value_usd, max_single_order_usd, median_order_value_usd, fraud_order_count,
         fraud_rate_pct, avg_fraud_score, max_fraud_score, location_mismatch_count,
         late_night_order_count, high_value_order_count, avg_velocity, peak_velocity,
         preferred_device, preferred_category, orders_last_30d, spend_last_30d_usd,
         CAST(greatest(0, least(100, 100 - fraud_order_count * 20 - location_mismatch_count * 5
              - CASE WHEN peak_velocity > 10 THEN 15 ELSE 0 END
              + CASE WHEN days_as_customer > 365 THEN 10 ELSE 0 END
              + CASE WHEN total_orders > 20 THEN 5 ELSE 0 END)) AS INT) AS reputation_score,
         CASE WHEN fraud_order_count > 2 THEN 'BANNED'
              WHEN fraud_order_count > 0 OR avg_fraud_score > 0.6 THEN 'HIGH_RISK'
              WHEN avg_fraud_score > 0.3 OR location_mismatch_count > 2 THEN 'MEDIUM_RISK'
              WHEN total_orders > 20 AND fraud_order_count = 0 THEN 'TRUSTED'
              ELSE 'STANDARD' END AS user_segment,
         CASE WHEN total_spend_usd > 10000 THEN 'PLATINUM' WHEN total_spend_usd > 5000 THEN 'GOLD'
              WHEN total_spend_usd > 1000 THEN 'SILVER' ELSE 'BRONZE' END AS customer_value_tier,
         (SELECT as_of FROM clock) AS dbt_updated_at
  FROM ustats2
)"""

DIM_USERS = with_ctes(DIM_USERS_CTE, "SELECT * FROM dim_users")

FRAUD_PATTERN = """CASE WHEN location_mismatch AND orders_per_user_1m > 5 THEN 'COORDINATED_ATTACK'
              WHEN location_mismatch AND is_high_value THEN 'STOLEN_CARD'
              WHEN orders_per_user_1m > 10 THEN 'BOT_ACTIVITY'
              WHEN is_high_value AND is_late_night_order THEN 'ACCOUNT_TAKEOVER'
              WHEN location_mismatch THEN 'LOCATION_FRAUD'
              ELSE 'ANOMALY' END"""

FCT_FRAUD_ORDERS_SELECT = f"""
SELECT order_id, user_id, order_amount, category, product_name, device_type, order_timestamp,
       order_date, order_hour, day_of_week, is_weekend, is_late_night_order, fraud_score, risk_level,
       fraud_reasoning, location_mismatch, orders_per_user_1m, is_high_value,
       CASE risk_level WHEN 'CRITICAL' THEN '🔴 CRITICAL' WHEN 'HIGH' THEN '🟠 HIGH' ELSE '🟡 FLAGGED' END AS risk_display,
       {FRAUD_PATTERN} AS fraud_pattern,
       order_amount AS potential_loss_usd,
       CAST(CASE risk_level WHEN 'CRITICAL' THEN order_amount * 0.95 WHEN 'HIGH' THEN order_amount * 0.70
            ELSE order_amount * 0.30 END AS DECIMAL(16,4)) AS estimated_loss_usd,
       (SELECT as_of FROM clock) AS dbt_updated_at
FROM stg WHERE is_fraud = TRUE"""

FCT_FRAUD_ORDERS = with_ctes(STG, FCT_FRAUD_ORDERS_SELECT)

DIM_TIME_CTE = STG + """, tb AS (
  SELECT date_trunc('hour', MIN(order_timestamp)) AS lo, date_trunc('hour', MAX(order_timestamp)) AS hi FROM stg
), spine AS (
  SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS full_timestamp FROM tb
), dim_time AS (
  SELECT CAST(epoch_us(full_timestamp) // 3600000000 AS BIGINT) AS time_id,
         full_timestamp, CAST(hour(full_timestamp) AS INT) AS hour,
         CAST(dayofweek(full_timestamp) AS INT) AS day_of_week, dayname(full_timestamp) AS day_name,
         CAST(dayofmonth(full_timestamp) AS INT) AS day_of_month, CAST(weekofyear(full_timestamp) AS INT) AS week_of_year,
         CAST(month(full_timestamp) AS INT) AS month, monthname(full_timestamp) AS month_name,
         CAST(quarter(full_timestamp) AS INT) AS quarter, CAST(year(full_timestamp) AS INT) AS year,
         dayofweek(full_timestamp) IN (0, 6) AS is_weekend,
         hour(full_timestamp) BETWEEN 0 AND 5 AS is_late_night,
         hour(full_timestamp) BETWEEN 9 AND 17 AND dayofweek(full_timestamp) BETWEEN 1 AND 5 AS is_business_hours
  FROM spine
)"""

DIM_TIME = with_ctes(DIM_TIME_CTE, "SELECT * FROM dim_time")

STG_PLUS = staging("product_id, quantity, payment_method")

FACT_ORDERS_CTE = STG_PLUS + f""", fact AS (
  SELECT order_id, user_id, product_id, product_name, category,
         CAST(epoch_us(order_timestamp) // 3600000000 AS BIGINT) AS time_id,
         order_amount, quantity, fraud_score, is_fraud, risk_level, {FRAUD_PATTERN} AS fraud_pattern,
         payment_method, device_type, location_mismatch
  FROM stg
)"""

FACT_ORDERS = with_ctes(FACT_ORDERS_CTE, "SELECT * FROM fact")

STAGING_ORDERS = with_ctes(STG, "SELECT * FROM stg")


def newton_sql(table: str, cols: "Sequence[str]", steps: int, ridge: float, name: str = "nw") -> str:
    """The same steps as CTEs for the oracle: ``table`` (fit, y, cols) -> ``<name>`` (fit, b0, b1, ...)."""
    d = len(cols) + 1
    linear = lambda b: " + ".join([f"{b}.b0", *[f"{b}.b{i + 1} * t.{c}" for i, c in enumerate(cols)]])
    xs = ["1.0", *[f"t.{c}" for c in cols]]
    out = [f"{name}_size AS (SELECT fit, sum(y) AS pos, count(*) AS n FROM {table} GROUP BY fit HAVING sum(y) > 0 AND sum(y) < count(*))",
           f"{name}_0 AS (SELECT fit, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(d))} FROM {name}_size)"]
    for s in range(1, steps + 1):
        was = f"{name}_{s - 1}"
        grad = [f"sum(w * (y - p) * x{i}) AS g{i}" for i in range(d)]
        hess = [f"sum(w * p * (1 - p) * x{i} * x{j}) AS h{i}_{j}" for i in range(d) for j in range(i, d)]
        out.append(f"""{name}_s{s} AS (SELECT fit, {', '.join(grad + hess)} FROM (
  SELECT t.fit, t.y, CASE WHEN t.y = 1 THEN z.n / (2.0 * z.pos) ELSE z.n / (2.0 * (z.n - z.pos)) END AS w,
         1.0 / (1.0 + exp(-({linear('b')}))) AS p, {', '.join(f'{c} AS x{i}' for i, c in enumerate(xs))}
  FROM {table} t JOIN {name}_size z USING (fit) JOIN {was} b USING (fit)) q GROUP BY fit)""")
        # elimination, a CTE a column; m{i}_{j} with column d as the right side
        start = [f"h{min(i, j)}_{max(i, j)}" + (f" + {ridge}" if i == j and i else "") + f" AS m{i}_{j}" for i in range(d) for j in range(d)]
        start += [f"g{i}" + (f" - {ridge} * b{i}" if i else "") + f" AS m{i}_{d}" for i in range(d)]
        out.append(f"{name}_e{s}_0 AS (SELECT fit, {', '.join(start)} FROM {name}_s{s} JOIN {was} USING (fit))")
        for i in range(d):
            cells = [f"m{r}_{c}" + (f" - m{r}_{i} / m{i}_{i} * m{i}_{c}" if r > i else "") + f" AS m{r}_{c}" for r in range(d) for c in range(d + 1)]
            out.append(f"{name}_e{s}_{i + 1} AS (SELECT fit, {', '.join(cells)} FROM {name}_e{s}_{i})")
        last = f"{name}_e{s}_{d}"
        for i in reversed(range(d)):
            known = "".join(f" - m{i}_{j} * v{j}" for j in range(i + 1, d))
            out.append(f"{name}_v{s}_{i} AS (SELECT *, (m{i}_{d}{known}) / m{i}_{i} AS v{i} FROM {last})")
            last = f"{name}_v{s}_{i}"
        out.append(f"{name}_{s} AS MATERIALIZED (SELECT fit, {', '.join(f'b{i} + v{i} AS b{i}' for i in range(d))} FROM {last} JOIN {was} USING (fit))")
    out.append(f"{name} AS (SELECT * FROM {name}_{steps})")
    return ", ".join(out)
