"""DuckDB statements of the driver queries (the correctness oracle).

Each statement reads the pre-registered parquet views and restates the query
independently in SQL. Doubles that come from averages or logs are rounded to
6 places on both sides; sums of BIGINT are cast back to BIGINT (DuckDB widens
them to HUGEINT).
"""

from __future__ import annotations


def _r(x: str) -> str:
    """Half-even rounding to tens, as BIGINT."""
    return f"CAST(round_even(({x}) / 10, 0) * 10 AS BIGINT)"


# Transactions view T: lineitem x orders x part with price cleaning applied.
T = f"""
t AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS txn_id,
         CAST(o.o_orderdate AS DATE) AS sale_date,
         o.o_orderdate AS sold_at,
         CAST(l.l_partkey AS VARCHAR) AS product_id,
         p.p_name AS product_name,
         p.p_type AS category,
         {_r("l.l_extendedprice / l.l_quantity")} AS unit_price,
         {_r("p.p_retailprice")} AS buying_price,
         {_r("l.l_extendedprice * (1 - l.l_discount) / l.l_quantity")} AS selling_price,
         CAST(trunc(l.l_quantity) AS BIGINT) AS quantity,
         {_r("l.l_extendedprice * (1 - l.l_discount)")} AS total_amount,
         o.o_orderpriority AS payment_method
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

# Hourly view H over events.
H = """
h AS (
  SELECT CAST(user_id AS VARCHAR) AS txn_id,
         ts AS sold_at,
         CAST(ts AS DATE) AS sale_date,
         CAST(round_even(value, 0) AS BIGINT) AS quantity
  FROM events
)"""

WEEK = "CAST(date_trunc('week', sale_date) AS DATE) + 6"
MONTH = "CAST(date_trunc('month', sale_date) AS DATE)"

GRAINS = {
    "weekly": dict(period="week_ending", expr=WEEK, lag1="lag_1_week", lag2="lag_2_weeks",
                   roll="rolling_mean_4_weeks", width=4, payday=True),
    "monthly": dict(period="month_start", expr=MONTH, lag1="lag_1_month", lag2="lag_2_months",
                    roll="rolling_mean_3_months", width=3, payday=False),
}


def rollup_cte(grain: str, name: str = "ru", source: str = "t") -> str:
    g = GRAINS[grain]
    return f"""
{name} AS (
  SELECT product_id, product_name, category, {g['expr']} AS {g['period']},
         CAST(sum(quantity) AS BIGINT) AS quantity,
         avg(unit_price) AS unit_price,
         avg(buying_price) AS buying_price,
         avg(selling_price) AS selling_price,
         CAST(sum(total_amount) AS BIGINT) AS total_amount
  FROM {source}
  GROUP BY product_id, product_name, category, {g['expr']}
)"""


def history_cte(grain: str, name: str = "hist", source: str = "ru") -> str:
    g = GRAINS[grain]
    order = f"PARTITION BY product_id ORDER BY {g['period']}, product_name, category"
    frame = f"{order} ROWS BETWEEN {g['width']} PRECEDING AND 1 PRECEDING"
    return f"""
{name} AS (
  SELECT *,
         CAST(lag(quantity, 1) OVER (w) AS DOUBLE) AS {g['lag1']},
         CAST(lag(quantity, 2) OVER (w) AS DOUBLE) AS {g['lag2']},
         CASE WHEN count(quantity) OVER ({frame}) = {g['width']} THEN avg(quantity) OVER ({frame}) END AS {g['roll']}
  FROM {source}
  WINDOW w AS ({order})
)"""


def features_select(grain: str, source: str = "hist", filled: bool = False, where_complete: bool = True) -> str:
    g = GRAINS[grain]
    p = g["period"]
    payday = (
        f",\n       CAST(day({p}) >= day(last_day({p})) - 6 AS TINYINT) AS is_payday_week" if g["payday"] else ""
    )
    filled_col = ",\n       is_filled" if filled else ""
    where = (
        f"WHERE {g['lag1']} IS NOT NULL AND {g['lag2']} IS NOT NULL AND {g['roll']} IS NOT NULL"
        if where_complete
        else ""
    )
    return f"""
SELECT product_id, product_name, category, {p}, quantity,
       round(unit_price, 6) AS unit_price,
       round(buying_price, 6) AS buying_price,
       round(selling_price, 6) AS selling_price,
       total_amount,
       {g['lag1']}, {g['lag2']},
       round({g['roll']}, 6) AS {g['roll']},
       round(selling_price - buying_price, 6) AS price_difference,
       CAST(month({p}) = 4 AS TINYINT) AS is_avurudu_month,
       CAST(month({p}) = 5 AS TINYINT) AS is_vesak_month,
       CAST(month({p}) = 12 AS TINYINT) AS is_christmas_month{payday}{filled_col},
       round(ln(1 + greatest(quantity, 0)), 6) AS log_quantity
FROM {source}
{where}"""


def features_ctes(grain: str, name: str = "feat") -> str:
    """CTEs ending in ``name``: the full feature table of ``grain`` (unrounded doubles)."""
    g = GRAINS[grain]
    p = g["period"]
    payday = f", CAST(day({p}) >= day(last_day({p})) - 6 AS TINYINT) AS is_payday_week" if g["payday"] else ""
    return f"""{rollup_cte(grain, 'ru_' + grain)},{history_cte(grain, 'hist_' + grain, 'ru_' + grain)},
{name} AS (
  SELECT *, selling_price - buying_price AS price_difference,
         CAST(month({p}) = 4 AS TINYINT) AS is_avurudu_month,
         CAST(month({p}) = 5 AS TINYINT) AS is_vesak_month,
         CAST(month({p}) = 12 AS TINYINT) AS is_christmas_month{payday},
         ln(1 + greatest(quantity, 0)) AS log_quantity
  FROM hist_{grain}
  WHERE {g['lag1']} IS NOT NULL AND {g['lag2']} IS NOT NULL AND {g['roll']} IS NOT NULL
)"""


def _features(grain: str) -> str:
    return f"WITH {T},{rollup_cte(grain)},{history_cte(grain)}{features_select(grain)}"


ORACLE: dict[str, str] = {}
ORACLE["weekly_features"] = _features("weekly")
ORACLE["monthly_features"] = _features("monthly")


# --- ingest ----------------------------------------------------------------------------

NULL_TOKENS_SQL = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)


def _num(c: str) -> str:
    # The rule: a number is what reads as one, is finite and fits BIGINT.
    v = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"CASE WHEN isfinite({v}) AND abs({v}) < 9223372036854775808.0 THEN {v} END"


def _txt(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ({NULL_TOKENS_SQL}) THEN NULL ELSE {c} END"


INGEST_PARSED = f"""raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS txn_id,
         CASE WHEN l_linenumber = 2 THEN 'bad'
              WHEN l_linenumber = 1 AND l_orderkey % 5 = 3 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T10:30:00.250'
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d,
         CASE WHEN l_linenumber = 5 THEN 'bad' WHEN l_linenumber = 6 THEN '9:05 PM' ELSE '10:30:00' END AS tm,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CASE WHEN l_linenumber = 7 THEN 'N/A' ELSE 'part ' || CAST(l_partkey AS VARCHAR) END AS product_name,
         l_returnflag AS category,
         CASE WHEN l_linenumber = 3 THEN '1.5d' ELSE CAST(l_extendedprice / l_quantity AS VARCHAR) END AS up,
         CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN '1e100'
              WHEN l_linenumber = 1 AND l_orderkey % 5 = 1 THEN repeat('9', 400)
              WHEN l_linenumber = 1 AND l_orderkey % 5 = 2 THEN '1e-100'
              ELSE CAST(l_extendedprice AS VARCHAR) END AS bp,
         CASE WHEN l_linenumber = 6 THEN ' 1e3 '
              ELSE CAST(l_extendedprice * (1 - l_discount) / l_quantity AS VARCHAR) END AS sp,
         CASE WHEN l_linenumber = 4 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS q,
         CAST(l_extendedprice * (1 - l_discount) AS VARCHAR) AS ta,
         l_linenumber AS line, l_linenumber = 1 AND l_orderkey % 15 IN (4, 9, 14) AS malformed
  FROM lineitem
),
parsed AS (
  SELECT malformed, {_txt('txn_id')} AS txn_id, CAST(line AS INTEGER) AS line,
         CAST(TRY_STRPTIME(left(trim(d), 10), '%Y-%m-%d') AS DATE) AS sale_date,
         coalesce(TRY_STRPTIME(trim(tm), '%H:%M:%S'), TRY_STRPTIME(trim(tm), '%I:%M %p')) AS t,
         {_txt('product_id')} AS product_id, {_txt('product_name')} AS product_name,
         {_txt('category')} AS category,
         {_num('up')} AS unit_price, {_num('bp')} AS buying_price, {_num('sp')} AS selling_price,
         {_num('q')} AS quantity, {_num('ta')} AS total_amount
  FROM raw
)"""

ORACLE["ingest_coercion"] = f"""
WITH {INGEST_PARSED}
SELECT txn_id, line, sale_date,
       CAST(sale_date AS TIMESTAMP) + (t - date_trunc('day', t)) AS sold_at,
       product_id, product_name, category, unit_price, buying_price, selling_price, quantity, total_amount
FROM parsed
WHERE NOT malformed AND txn_id IS NOT NULL AND sale_date IS NOT NULL AND t IS NOT NULL AND product_id IS NOT NULL
  AND product_name IS NOT NULL AND category IS NOT NULL AND unit_price IS NOT NULL
  AND buying_price IS NOT NULL AND selling_price IS NOT NULL AND quantity IS NOT NULL
  AND total_amount IS NOT NULL"""

_REQUIRED_PARSED = ("txn_id", "product_id", "product_name", "category", "sale_date", "t", "unit_price",
                    "buying_price", "selling_price", "quantity", "total_amount")
_reject_cols = ",\n       ".join(
    f"CAST(count_if({c} IS NULL AND NOT malformed) AS BIGINT) AS null_{'sale_seconds' if c == 't' else c}" for c in _REQUIRED_PARSED
)
ORACLE["ingest_rejects"] = f"""
WITH {INGEST_PARSED}
SELECT count(*) AS rows, CAST(count_if(malformed) AS BIGINT) AS malformed,
       {_reject_cols}
FROM parsed"""

ORACLE["price_rounding"] = f"""
WITH {T}
SELECT txn_id, product_id, sale_date, unit_price, buying_price, selling_price, quantity, total_amount,
       selling_price - buying_price AS unit_margin, payment_method
FROM t"""

# --- features --------------------------------------------------------------------------

for _g in ("weekly", "monthly"):
    _p = GRAINS[_g]["period"]
    ORACLE[f"{_g}_rollup"] = f"""
WITH {T},{rollup_cte(_g)}
SELECT product_id, product_name, category, {_p}, quantity,
       round(unit_price, 6) AS unit_price, round(buying_price, 6) AS buying_price,
       round(selling_price, 6) AS selling_price, total_amount
FROM ru"""
    ORACLE[f"{_g}_lags"] = f"""
WITH {T},{rollup_cte(_g)},{history_cte(_g)}
SELECT product_id, product_name, category, {_p}, quantity,
       {GRAINS[_g]['lag1']}, {GRAINS[_g]['lag2']}, round({GRAINS[_g]['roll']}, 6) AS {GRAINS[_g]['roll']}
FROM hist"""

def _gap_filled(grain: str) -> str:
    g = GRAINS[grain]
    p = g["period"]
    back = f"next_p - 7" if grain == "weekly" else "CAST(next_p - INTERVAL 1 MONTH AS DATE)"
    step = "INTERVAL 7 DAY" if grain == "weekly" else "INTERVAL 1 MONTH"
    return f"""
WITH {T},{rollup_cte(grain)},
nxt AS (
  SELECT *,
         lead({p}) OVER w AS next_p,
         lead(product_name) OVER w AS next_name,
         lead(category) OVER w AS next_cat
  FROM ru
  WINDOW w AS (PARTITION BY product_id ORDER BY product_name, category, {p})
),
spread AS (
  SELECT product_id, product_name, category, quantity, unit_price, buying_price, selling_price, total_amount,
         {p} AS first_p,
         CASE WHEN next_name = product_name AND next_cat = category THEN {back} ELSE {p} END AS last_p
  FROM nxt
),
filled AS (
  SELECT product_id, product_name, category,
         CAST(s.gp AS DATE) AS {p},
         CASE WHEN CAST(s.gp AS DATE) = first_p THEN quantity ELSE 0 END AS quantity,
         unit_price, buying_price, selling_price,
         CASE WHEN CAST(s.gp AS DATE) = first_p THEN total_amount ELSE 0 END AS total_amount,
         CAST(CAST(s.gp AS DATE) <> first_p AS TINYINT) AS is_filled
  FROM spread, LATERAL unnest(generate_series(CAST(first_p AS TIMESTAMP), CAST(last_p AS TIMESTAMP),
                                              {step})) AS s(gp)
),{history_cte(grain, 'hist', 'filled')}{features_select(grain, 'hist', filled=True)}"""


ORACLE["gap_filled_weekly"] = _gap_filled("weekly")
ORACLE["gap_filled_monthly"] = _gap_filled("monthly")

def _daily_lag(days: int) -> str:
    """Quantity sold ``days`` earlier: 0 without a sale once the product was on sale,
    NULL before its first sale."""
    on_day = (f"sum(quantity) OVER (PARTITION BY product_id ORDER BY date_diff('day', DATE '1970-01-01', sale_date) "
              f"RANGE BETWEEN {days} PRECEDING AND {days} PRECEDING)")
    first = "min(sale_date) OVER (PARTITION BY product_id)"
    return (f"CAST(CASE WHEN {first} <= sale_date - {days} THEN coalesce({on_day}, 0) END AS DOUBLE)")


ORACLE["daily_lags"] = f"""
WITH {T},
daily AS (
  SELECT product_id, sale_date, CAST(sum(quantity) AS BIGINT) AS quantity, avg(selling_price) AS selling_price
  FROM t GROUP BY product_id, sale_date
)
SELECT product_id, sale_date, quantity, round(selling_price, 6) AS selling_price,
       {_daily_lag(7)} AS lag_7,
       {_daily_lag(14)} AS lag_14,
       CAST(isodow(sale_date) - 1 AS INTEGER) AS day_of_week,
       isodow(sale_date) >= 6 AS is_weekend,
       CAST(month(sale_date) AS INTEGER) AS month
FROM daily"""

# --- exploration -----------------------------------------------------------------------

ORACLE["monthly_price_trend"] = f"""
WITH {T}
SELECT {MONTH} AS month, round(avg(selling_price), 6) AS avg_selling_price FROM t GROUP BY 1"""

ORACLE["daily_quantity"] = f"""
WITH {T}
SELECT sale_date, CAST(sum(quantity) AS BIGINT) AS quantity FROM t GROUP BY sale_date"""

ORACLE["basket_sizes"] = f"""
WITH {T}
SELECT txn_id, count(*) AS items FROM t GROUP BY txn_id"""

ORACLE["basket_histogram"] = f"""
WITH {T},
sizes AS (SELECT txn_id, count(*) AS items FROM t GROUP BY txn_id),
counts AS (SELECT items, count(*) AS transactions FROM sizes GROUP BY items),
bins AS (SELECT CAST(unnest(generate_series(1, (SELECT max(items) FROM counts))) AS BIGINT) AS items)
SELECT bins.items, CAST(coalesce(counts.transactions, 0) AS BIGINT) AS transactions
FROM bins LEFT JOIN counts ON bins.items = counts.items"""

ORACLE["top_products"] = f"""
WITH {T}
SELECT product_name, CAST(sum(total_amount) AS BIGINT) AS total_amount
FROM t GROUP BY product_name
ORDER BY total_amount DESC, product_name ASC
LIMIT 20"""

ORACLE["monthly_revenue"] = f"""
WITH {T}
SELECT {MONTH} AS month, CAST(sum(total_amount) AS BIGINT) AS revenue FROM t GROUP BY 1"""

ORACLE["category_revenue"] = f"""
WITH {T}
SELECT category, CAST(sum(total_amount) AS BIGINT) AS revenue FROM t GROUP BY category"""

ORACLE["margin_histogram"] = f"""
WITH {T},
m AS (SELECT CAST(selling_price - buying_price AS DOUBLE) AS v FROM t),
b0 AS (SELECT min(v) AS lo0, max(v) AS hi0 FROM m),
b AS (
  SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
         CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
  FROM b0
),
g AS (
  SELECT v, lo, hi, least(CAST(floor((v - lo) / (hi - lo) * CAST(40 AS DOUBLE)) AS INTEGER), 39) AS guess
  FROM m, b
),
e AS (
  SELECT v, guess,
         CASE WHEN guess >= 40 THEN hi ELSE CAST(guess AS DOUBLE) * ((hi - lo) / CAST(40 AS DOUBLE)) + lo END AS lower_e,
         CASE WHEN guess + 1 >= 40 THEN hi
              ELSE CAST(guess + 1 AS DOUBLE) * ((hi - lo) / CAST(40 AS DOUBLE)) + lo END AS upper_e
  FROM g
),
idx AS (
  SELECT CASE WHEN v < lower_e THEN guess - 1 WHEN v >= upper_e AND guess <> 39 THEN guess + 1 ELSE guess END AS bin
  FROM e
),
counts AS (SELECT bin, count(*) AS n FROM idx GROUP BY bin),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(40))
SELECT bins.bin,
       round(CASE WHEN bins.bin >= 40 THEN hi ELSE CAST(bins.bin AS DOUBLE) * ((hi - lo) / CAST(40 AS DOUBLE)) + lo END, 6)
         AS bin_start,
       round(CASE WHEN bins.bin + 1 >= 40 THEN hi
                  ELSE CAST(bins.bin + 1 AS DOUBLE) * ((hi - lo) / CAST(40 AS DOUBLE)) + lo END, 6) AS bin_end,
       CAST(coalesce(counts.n, 0) AS BIGINT) AS count
FROM bins CROSS JOIN b LEFT JOIN counts ON bins.bin = counts.bin"""

ORACLE["hourly_transactions"] = f"""
WITH {H}
SELECT CAST(hour(sold_at) AS INTEGER) AS hour, count(DISTINCT txn_id) AS transactions FROM h GROUP BY 1"""

ORACLE["weekday_hour_quantity"] = f"""
WITH {H}
SELECT CAST(isodow(sold_at) - 1 AS INTEGER) AS weekday_index, dayname(sold_at) AS weekday,
       CAST(hour(sold_at) AS INTEGER) AS hour, CAST(sum(quantity) AS BIGINT) AS quantity
FROM h GROUP BY 1, 2, 3"""

_hours = ",\n       ".join(
    f"CAST(coalesce(sum(quantity) FILTER (WHERE hour = {i}), 0) AS BIGINT) AS h{i:02d}" for i in range(24)
)
ORACLE["weekday_hour_matrix"] = f"""
WITH {H},
days AS (
  SELECT CAST(range AS INTEGER) AS weekday_index, dayname(DATE '2024-01-01' + CAST(range AS INTEGER)) AS weekday
  FROM range(7)
),
cells AS (SELECT CAST(isodow(sold_at) - 1 AS INTEGER) AS weekday_index, hour(sold_at) AS hour, quantity FROM h)
SELECT days.weekday_index, days.weekday,
       {_hours}
FROM days LEFT JOIN cells ON days.weekday_index = cells.weekday_index
GROUP BY days.weekday_index, days.weekday"""

# --- dataset and evaluation ------------------------------------------------------------

TRAIN_START, TEST_START, TEST_END = "1996-01-01", "2001-01-01", "2002-01-01"

ORACLE["time_split"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},
sides AS (
  SELECT 'train' AS split, quantity, week_ending FROM fw
  WHERE week_ending >= DATE '{TRAIN_START}' AND week_ending < DATE '{TEST_START}'
  UNION ALL
  SELECT 'test' AS split, quantity, week_ending FROM fw
  WHERE week_ending >= DATE '{TEST_START}' AND week_ending < DATE '{TEST_END}'
)
SELECT split, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity,
       min(week_ending) AS first_period, max(week_ending) AS last_period
FROM sides GROUP BY split"""

N = f"""{T},{features_ctes('weekly', 'fw')},{features_ctes('monthly', 'fm')},
n AS (
  SELECT week_ending AS date, product_id, product_name, category,
         CAST(quantity AS DOUBLE) AS actual_quantity,
         CAST(round_even(rolling_mean_4_weeks, 0) AS INTEGER) AS predicted_quantity, 'Weekly' AS horizon
  FROM fw WHERE week_ending >= DATE '{TEST_START}' AND week_ending < DATE '{TEST_END}'
  UNION ALL
  SELECT month_start, product_id, product_name, category,
         CAST(quantity AS DOUBLE),
         CAST(round_even(rolling_mean_3_months, 0) AS INTEGER), 'Monthly'
  FROM fm WHERE month_start >= DATE '{TEST_START}' AND month_start < DATE '{TEST_END}'
)"""


def _metrics(group: str) -> str:
    y, p = "actual_quantity", "CAST(predicted_quantity AS DOUBLE)"
    sse = f"sum(({y} - {p}) * ({y} - {p}))"
    sst = f"(var_pop({y}) * count(*))"
    return f"""
WITH {N}
SELECT {group},
       round(CASE WHEN count(*) < 2 THEN NULL
                  WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END
                  ELSE 1.0 - {sse} / {sst} END, 6) AS r2,
       round(avg(abs({y} - {p})), 6) AS mae,
       round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse,
       round(coalesce(avg(CASE WHEN {y} <> 0 THEN abs({y} - {p}) / abs({y}) END) * 100.0, 0.0), 6) AS mape,
       count(*) AS rows
FROM n GROUP BY {group}"""


ORACLE["forecast_metrics"] = _metrics("horizon, category")
ORACLE["accuracy_table"] = _metrics("horizon")

ORACLE["actual_vs_predicted"] = f"""
WITH {N}
SELECT horizon, date, round(sum(actual_quantity), 6) AS actual_quantity,
       CAST(sum(predicted_quantity) AS BIGINT) AS predicted_quantity
FROM n GROUP BY horizon, date"""

_TOP = """
top AS (
  SELECT product_id, product_name, sum(actual_quantity) AS actual_quantity
  FROM n GROUP BY product_id, product_name
  ORDER BY actual_quantity DESC, product_id ASC, product_name ASC
  LIMIT 1
)"""

ORACLE["top_forecast_product"] = f"""
WITH {N},{_TOP}
SELECT product_id, product_name, round(actual_quantity, 6) AS actual_quantity FROM top"""

ORACLE["top_product_series"] = f"""
WITH {N},{_TOP}
SELECT horizon, date, product_id, product_name, round(actual_quantity, 6) AS actual_quantity, predicted_quantity
FROM n WHERE product_id = (SELECT product_id FROM top)"""

# --- blending and scoring --------------------------------------------------------------

SCORES = f"""{T},{features_ctes('weekly', 'fw')},
s AS (
  SELECT product_id, product_name, category, week_ending,
         CAST(lag_1_week > 20 AS INTEGER) AS demand_class,
         CAST(lag_1_week AS DOUBLE) AS score_a,
         CAST(lag_2_weeks AS DOUBLE) AS score_b,
         CASE WHEN lag_2_weeks > 40 THEN CAST('NaN' AS DOUBLE) ELSE rolling_mean_4_weeks END AS score_c
  FROM fw
)"""

_BLEND = "score_a * CAST(0.45 AS DOUBLE) + score_b * CAST(0.45 AS DOUBLE) + score_c * CAST(0.1 AS DOUBLE)"
ORACLE["gated_blend"] = f"""
WITH {SCORES},
b AS (SELECT *, {_BLEND} AS blend FROM s)
SELECT product_id, product_name, category, week_ending, demand_class,
       CAST(CASE WHEN demand_class = 1 AND isfinite(blend)
                 THEN round_even(CASE WHEN blend < 0 THEN 0.0 ELSE blend END, 0) ELSE 0 END AS INTEGER)
         AS predicted_quantity
FROM b"""


def _weighted_sql() -> str:
    # Weighted mean over finite scores: 0.45 for the two boosted models, 0.10 for the forest.
    cols, weights = ("score_a", "score_b", "score_c"), ("0.45", "0.45", "0.10")
    lits = [f"CAST({w} AS DOUBLE)" for w in weights]
    num = " + ".join(f"CASE WHEN isfinite({c}) THEN {c} * {w} ELSE 0.0 END" for c, w in zip(cols, lits))
    den = " + ".join(f"CASE WHEN isfinite({c}) THEN {w} ELSE 0.0 END" for c, w in zip(cols, lits))
    return f"CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) ELSE score_a END"


def _demand(v: str) -> str:
    fin = f"CASE WHEN isfinite({v}) THEN {v} ELSE 0.0 END"
    return f"CAST(round_even(CASE WHEN {fin} < 0 THEN 0.0 ELSE {fin} END, 0) AS BIGINT)"


ORACLE["weighted_ensemble"] = f"""
WITH {SCORES},
e AS (SELECT *, {_weighted_sql()} AS ensemble_score FROM s)
SELECT product_id, product_name, category, week_ending, round(ensemble_score, 6) AS ensemble_score,
       {_demand('ensemble_score')} AS predicted_demand
FROM e"""

ORACLE["log_target_inverse"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},
s AS (
  SELECT product_id, product_name, category, week_ending,
         CASE WHEN lag_1_week > lag_2_weeks THEN CAST(lag_1_week AS DOUBLE) ELSE log_quantity END AS score
  FROM fw
),
x AS (SELECT *, CASE WHEN score > 709 THEN CAST('inf' AS DOUBLE) ELSE exp(score) - 1 END AS t FROM s),
v AS (SELECT *, CASE WHEN isfinite(t) AND t <= 1000000.0 THEN t ELSE score END AS demand_value FROM x)
SELECT product_id, product_name, category, week_ending, round(score, 6) AS score,
       round(demand_value, 6) AS demand_value, {_demand('demand_value')} AS predicted_demand
FROM v"""

_LATEST_COLS = (
    "product_id, product_name, category, week_ending, quantity, round(unit_price, 6) AS unit_price, "
    "round(buying_price, 6) AS buying_price, round(selling_price, 6) AS selling_price, total_amount, "
    "lag_1_week, lag_2_weeks, round(rolling_mean_4_weeks, 6) AS rolling_mean_4_weeks, "
    "round(price_difference, 6) AS price_difference, is_avurudu_month, is_vesak_month, is_christmas_month, "
    "is_payday_week, round(log_quantity, 6) AS log_quantity"
)
ORACLE["latest_features"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id
                               ORDER BY week_ending DESC NULLS LAST, product_name DESC, category DESC) AS rn
  FROM fw
)
SELECT {_LATEST_COLS} FROM ranked WHERE rn = 1"""

ORACLE["score_requests"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},{features_ctes('monthly', 'fm')},
latest AS (
  SELECT product_id, 'weekly' AS timeframe, week_ending AS period, quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id
                                 ORDER BY week_ending DESC NULLS LAST, product_name DESC, category DESC) AS rn
    FROM fw) WHERE rn = 1
  UNION ALL
  SELECT product_id, 'monthly', month_start, quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id
                                 ORDER BY month_start DESC NULLS LAST, product_name DESC, category DESC) AS rn
    FROM fm) WHERE rn = 1
),
req AS (
  SELECT p_partkey AS request_id,
         trim(CASE WHEN p_size >= 47 THEN 'X' || CAST(p_partkey AS VARCHAR)
                   ELSE '  ' || CAST(p_partkey AS VARCHAR) || ' ' END) AS product_id,
         lower(trim(CASE WHEN p_size BETWEEN 41 AND 43 THEN 'Daily' WHEN p_size <= 20 THEN ' Weekly'
                         WHEN p_size <= 30 THEN 'MONTHLY ' ELSE 'weekly' END)) AS timeframe
  FROM part
),
st AS (
  SELECT *, CASE WHEN product_id IS NULL OR product_id = '' THEN 'bad_product'
                 WHEN timeframe NOT IN ('weekly', 'monthly') OR timeframe IS NULL THEN 'bad_timeframe'
                 ELSE 'ok' END AS status0
  FROM req
)
SELECT st.request_id, st.product_id, st.timeframe,
       CASE WHEN status0 = 'ok' AND latest.period IS NULL THEN 'not_found' ELSE status0 END AS status,
       latest.period, CAST(latest.quantity AS DOUBLE) AS quantity
FROM st LEFT JOIN latest ON st.product_id = latest.product_id AND st.timeframe = latest.timeframe"""

ORACLE["validate_requests"] = f"""
WITH {T},
daily AS (
  SELECT product_id, sale_date, CAST(sum(quantity) AS BIGINT) AS quantity, avg(selling_price) AS selling_price
  FROM t GROUP BY product_id, sale_date
),
feat AS (
  SELECT product_id, sale_date, selling_price,
         {_daily_lag(7)} AS lag_7,
         {_daily_lag(14)} AS lag_14,
         CAST(isodow(sale_date) - 1 AS INTEGER) AS day_of_week,
         isodow(sale_date) >= 6 AS is_weekend,
         CAST(month(sale_date) AS INTEGER) AS month
  FROM daily
),
req AS (
  SELECT CASE WHEN day(sale_date) <> 12 THEN product_id END AS item_id, sale_date, lag_7, lag_14,
         CASE WHEN day(sale_date) <> 18 THEN is_weekend END AS is_weekend,
         CASE WHEN day(sale_date) = 5 THEN 0.0 WHEN day(sale_date) = 8 THEN CAST('nan' AS DOUBLE) ELSE selling_price END AS selling_price,
         CAST(CASE WHEN day(sale_date) = 10 THEN 7 WHEN day(sale_date) = 20 THEN -1 ELSE day_of_week END AS INTEGER)
           AS day_of_week,
         CAST(CASE WHEN day(sale_date) = 15 THEN 13 WHEN day(sale_date) = 25 THEN 0 ELSE month END AS INTEGER)
           AS month
  FROM feat
),
chk AS (
  SELECT *, concat_ws(',',
      CASE WHEN NOT (selling_price > 0) OR selling_price IS NULL OR isnan(selling_price) THEN 'selling_price' END,
      CASE WHEN NOT (day_of_week BETWEEN 0 AND 6) OR day_of_week IS NULL THEN 'day_of_week' END,
      CASE WHEN NOT (month BETWEEN 1 AND 12) OR month IS NULL THEN 'month' END,
      CASE WHEN item_id IS NULL THEN 'missing_item_id' END,
      CASE WHEN lag_7 IS NULL THEN 'missing_lag_7' END,
      CASE WHEN lag_14 IS NULL THEN 'missing_lag_14' END,
      CASE WHEN is_weekend IS NULL THEN 'missing_is_weekend' END) AS reasons
  FROM req
)
SELECT item_id, sale_date, lag_7, lag_14, is_weekend, round(selling_price, 6) AS selling_price,
       day_of_week, month, reasons, reasons = '' AS is_valid
FROM chk"""

ORACLE["latest_naive_forecast"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id
                               ORDER BY week_ending DESC NULLS LAST, product_name DESC, category DESC) AS rn
  FROM fw
),
s AS (
  SELECT product_id, week_ending,
         coalesce(TRY_CAST(lag_1_week AS DOUBLE), 0.0) AS score_a,
         coalesce(TRY_CAST(lag_2_weeks AS DOUBLE), 0.0) AS score_b,
         coalesce(TRY_CAST(rolling_mean_4_weeks AS DOUBLE), 0.0) AS score_c
  FROM ranked WHERE rn = 1
),
e AS (SELECT *, {_weighted_sql()} AS ensemble_score FROM s)
SELECT product_id, 'weekly' AS timeframe, week_ending AS period,
       CASE WHEN score_a > 20 THEN {_demand('ensemble_score')} ELSE CAST(0 AS BIGINT) END AS predicted_demand
FROM e"""

ORACLE["next_period_naive_forecast"] = f"""
WITH {T},{rollup_cte('weekly')},
nxt AS (
  SELECT product_id, product_name, category, week_ending + 7 AS period,
         CAST(quantity AS DOUBLE) AS lag_1_week,
         CAST(lag(quantity, 1) OVER (w) AS DOUBLE) AS lag_2_weeks,
         CASE WHEN count(quantity) OVER (PARTITION BY product_id ORDER BY week_ending, product_name, category
                                         ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4
              THEN avg(quantity) OVER (PARTITION BY product_id ORDER BY week_ending, product_name, category
                                       ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS rolling_mean_4_weeks
  FROM ru
  WINDOW w AS (PARTITION BY product_id ORDER BY week_ending, product_name, category)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id
                               ORDER BY period DESC NULLS LAST, product_name DESC, category DESC) AS rn
  FROM nxt
),
s AS (
  SELECT product_id, period,
         CAST(month(period) = 12 AS TINYINT) AS is_christmas_month,
         CAST(day(period) >= day(last_day(period)) - 6 AS TINYINT) AS is_payday_week,
         coalesce(lag_1_week, 0.0) AS score_a,
         coalesce(lag_2_weeks, 0.0) AS score_b,
         coalesce(rolling_mean_4_weeks, 0.0) AS score_c
  FROM ranked WHERE rn = 1
),
e AS (SELECT *, {_weighted_sql()} AS ensemble_score FROM s)
SELECT product_id, period, is_christmas_month, is_payday_week,
       score_a AS lag_1_week, score_b AS lag_2_weeks, round(score_c, 6) AS rolling_mean_4_weeks,
       CASE WHEN score_a > 20 THEN {_demand('ensemble_score')} ELSE CAST(0 AS BIGINT) END AS predicted_demand
FROM e"""


# --- fit inputs, prediction keys, request answers ---------------------------------------

_MODEL_FEATURES = {
    "weekly": "unit_price, buying_price, selling_price, lag_1_week, lag_2_weeks, rolling_mean_4_weeks, price_difference, "
              "is_avurudu_month, is_vesak_month, is_christmas_month, is_payday_week",
    "monthly": "unit_price, buying_price, selling_price, lag_1_month, lag_2_months, rolling_mean_3_months, price_difference, "
               "is_avurudu_month, is_vesak_month, is_christmas_month",
}
for _g in ("weekly", "monthly"):
    _p = GRAINS[_g]["period"]
    ORACLE[f"model_inputs_{_g}"] = f"""
SELECT product_id, product_name, category, {_p}, {_MODEL_FEATURES[_g]},
       CAST(quantity AS DOUBLE) AS label, CASE WHEN quantity > 0 THEN 1.0 ELSE 0.0 END AS demand, quantity > 0 AS for_regressors
FROM ({_gap_filled(_g)}) g
WHERE {_p} >= DATE '1996-01-01' AND {_p} < DATE '2001-01-01'"""

ORACLE["prediction_keys"] = " UNION ALL ".join(f"""
SELECT {GRAINS[g]["period"]} AS date, product_id, product_name, category, CAST(quantity AS DOUBLE) AS actual_quantity, '{g}' AS horizon
FROM ({_gap_filled(g)}) {g}_rows
WHERE {GRAINS[g]["period"]} >= DATE '2001-01-01' AND {GRAINS[g]["period"]} < DATE '2002-01-01'""" for g in ("weekly", "monthly"))


def _latest_scores(grain: str, source: str) -> str:
    g = GRAINS[grain]
    return f"""
SELECT product_id, '{grain}' AS timeframe, {g['period']} AS period,
       CAST({g['lag1']} AS DOUBLE) AS score_a, CAST({g['lag2']} AS DOUBLE) AS score_b, CAST({g['roll']} AS DOUBLE) AS score_c
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {g['period']} DESC NULLS LAST, product_name DESC, category DESC) AS rn
      FROM {source}) WHERE rn = 1"""


ORACLE["forecast_requests"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},{features_ctes('monthly', 'fm')},
s AS ({_latest_scores('weekly', 'fw')} UNION ALL {_latest_scores('monthly', 'fm')}),
e AS (SELECT *, {_weighted_sql()} AS ensemble_score FROM s),
f AS (SELECT product_id, timeframe, period,
             CASE WHEN score_a > 20 THEN {_demand('ensemble_score')} ELSE CAST(0 AS BIGINT) END AS predicted_demand FROM e),
req AS (
  SELECT p_partkey AS request_id,
         CASE WHEN p_size >= 47 THEN 'X' ELSE '' END || CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_size BETWEEN 41 AND 43 THEN 'daily' WHEN p_size BETWEEN 21 AND 30 THEN 'monthly' ELSE 'weekly' END AS timeframe
  FROM part
)
SELECT request_id, req.product_id, req.timeframe,
       CASE WHEN req.timeframe = 'daily' THEN 'bad_timeframe' WHEN f.product_id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       f.period, f.predicted_demand
FROM req LEFT JOIN f ON req.product_id = f.product_id AND req.timeframe = f.timeframe"""

ORACLE["inference_frame"] = f"""
WITH {T},{features_ctes('weekly', 'fw')},
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
        ORDER BY week_ending DESC NULLS LAST, product_name DESC, category DESC) AS rn FROM fw) WHERE rn = 1)
SELECT product_id, week_ending, CAST(lag_1_week AS DOUBLE) AS lag_1_week,
       CASE WHEN lag_2_weeks > 30 THEN 0.0 ELSE CAST(lag_2_weeks AS DOUBLE) END AS lag_2_weeks,
       CAST(0 AS DOUBLE) AS product_name, CAST(0 AS DOUBLE) AS not_there,
       CASE WHEN starts_with(category, 'SMALL ') OR category = 'SMALL' THEN 1.0 ELSE 0.0 END AS "size_SMALL",
       CASE WHEN starts_with(category, 'PROMO ') OR category = 'PROMO' THEN 1.0 ELSE 0.0 END AS "size_PROMO"
FROM l"""
