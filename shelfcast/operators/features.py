"""Weekly / monthly product features and daily lag inputs.

Plan shape (see ``tests/test_plans.py``):

* the rollup is a partial + final hash aggregate on (product, name, category,
  period). The map-side partial aggregate collapses each product's line items
  before the shuffle, and the shuffle spreads one hot product over reducers by
  period, so a product holding a third of all rows does not land in one task;
* lags and the rolling mean run in one ``Window`` node partitioned by product
  only. Its input is already aggregated, so a partition holds one product's
  periods (about 52 rows per year of history), whatever the line-item count;
* gap filling (optional) adds a second window over the same product
  partitioning and an ``explode``: no join and no extra shuffle. The lags of filled rows are
  taken from the observed rows before the ``explode`` (:func:`filled_history`), so that only products
  under several names or categories have their filled rows sorted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import in_last_week_of_month, month_flags, month_start, week_ending_sunday

PRODUCT_KEYS = ("product_id", "product_name", "category")
PRICE_MEANS = ("unit_price", "buying_price", "selling_price")


@dataclass(frozen=True)
class Grain:
    """Everything that differs between the weekly and the monthly feature tables."""

    name: str
    period_col: str
    lag1_col: str
    lag2_col: str
    rolling_col: str
    rolling_width: int
    payday_flag: bool
    step: str  # SQL interval between consecutive periods

    def period_of(self, d: Column) -> Column:
        return week_ending_sunday(d) if self.name == "weekly" else month_start(d)

    def previous_period(self, p: Column) -> Column:
        return F.date_sub(p, 7) if self.name == "weekly" else F.add_months(p, -1)

    def next_period(self, p: Column) -> Column:
        return F.date_add(p, 7) if self.name == "weekly" else F.add_months(p, 1)

    def number_of(self, p: Column) -> Column:
        """Whole number of a period; the next period's is one more."""
        return F.floor(F.unix_date(p) / 7).cast("int") if self.name == "weekly" else F.year(p) * 12 + F.month(p)

    @property
    def history_cols(self) -> tuple[str, str, str]:
        return (self.lag1_col, self.lag2_col, self.rolling_col)


WEEKLY = Grain(
    name="weekly",
    period_col="week_ending",
    lag1_col="lag_1_week",
    lag2_col="lag_2_weeks",
    rolling_col="rolling_mean_4_weeks",
    rolling_width=4,
    payday_flag=True,
    step="INTERVAL 7 DAYS",
)
MONTHLY = Grain(
    name="monthly",
    period_col="month_start",
    lag1_col="lag_1_month",
    lag2_col="lag_2_months",
    rolling_col="rolling_mean_3_months",
    rolling_width=3,
    payday_flag=False,
    step="INTERVAL 1 MONTH",
)
GRAINS = {"weekly": WEEKLY, "monthly": MONTHLY}


def product_day_rollup(tx: DataFrame) -> DataFrame:
    """Per product key and sale day: quantity and amount sums, and sum and count of
    each price, so later means stay exact. One pass over the line items from which
    both feature grains and the per-day/month/category/product tables follow."""
    return tx.groupBy(*PRODUCT_KEYS, "sale_date").agg(
        F.sum("quantity").alias("quantity"),
        *[agg for c in PRICE_MEANS for agg in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))],
        F.sum("total_amount").alias("total_amount"),
    )


def mean_of(c: str, rolled: bool) -> Column:
    """Mean of price ``c`` over line items; ``rolled``: from their product-day rollup."""
    return F.sum(f"{c}_sum").cast("double") / F.sum(f"{c}_n") if rolled else F.avg(c)


def rollup(tx: DataFrame, grain: Grain, rolled: bool = False) -> DataFrame:
    """Sum quantity and amount, average the three prices, per product and period.

    ``tx`` holds line items or, with ``rolled``, their :func:`product_day_rollup`. Only
    periods with at least one sale appear (no zero rows).
    """
    return tx.groupBy(*PRODUCT_KEYS, grain.period_of(F.col("sale_date")).alias(grain.period_col)).agg(
        F.sum("quantity").alias("quantity"),
        *[mean_of(c, rolled).alias(c) for c in PRICE_MEANS],
        F.sum("total_amount").alias("total_amount"),
    )


def history_window(grain: Grain) -> Window:
    """Per product id, in period order; a product sold under two names in one period
    has two rows there, ordered by name then category."""
    return Window.partitionBy("product_id").orderBy(grain.period_col, "product_name", "category")


def add_history(df: DataFrame, grain: Grain) -> DataFrame:
    """Lag 1, lag 2 and the mean of the previous ``rolling_width`` observed periods.

    Lags count observed rows, not calendar periods, and are DOUBLE (NULL before a
    product's second / third period). The rolling mean exists only for a complete
    window (exactly ``rolling_width`` earlier rows).
    """
    w = history_window(grain)
    frame = w.rowsBetween(-grain.rolling_width, -1)
    q = F.col("quantity")
    return df.withColumns(
        {
            grain.lag1_col: F.lag(q, 1).over(w).cast("double"),
            grain.lag2_col: F.lag(q, 2).over(w).cast("double"),
            grain.rolling_col: F.when(F.count(q).over(frame) == grain.rolling_width, F.avg(q).over(frame)),
        }
    )


def next_period_features(tx: DataFrame, grain: Grain, flags: dict[str, int] | None = None) -> DataFrame:
    """Inputs for forecasting the period *after* each observed one: lag 1 is this
    period's quantity, lag 2 the previous one, the rolling mean covers the window
    ending at this period (complete windows only), the period moves one step and
    its calendar flags follow; prices are the last observed means. One window
    pass over the rollup, same partitioning as :func:`add_history`."""
    w = history_window(grain)
    frame = w.rowsBetween(-(grain.rolling_width - 1), 0)
    q = F.col("quantity")
    rolled = rollup(tx, grain)
    shifted = rolled.withColumns(
        {
            grain.lag1_col: q.cast("double"),
            grain.lag2_col: F.lag(q, 1).over(w).cast("double"),
            grain.rolling_col: F.when(F.count(q).over(frame) == grain.rolling_width, F.avg(q).over(frame)),
            "observed_period": F.col(grain.period_col),
        }
    ).withColumn(grain.period_col, grain.next_period(F.col(grain.period_col)))
    return add_calendar(shifted, grain, flags).drop("quantity", "total_amount")


def add_calendar(df: DataFrame, grain: Grain, flags: dict[str, int] | None = None) -> DataFrame:
    """Price gap, month flags of the period (the week's closing Sunday for weekly) and,
    weekly only, the payday flag (closing Sunday in the last seven days of its month)."""
    p = F.col(grain.period_col)
    cols: dict[str, Column] = {"price_difference": F.col("selling_price") - F.col("buying_price")}
    cols.update(month_flags(p, flags))
    if grain.payday_flag:
        cols["is_payday_week"] = in_last_week_of_month(p)
    return df.withColumns(cols)


def fill_gaps(rolled: DataFrame, grain: Grain) -> DataFrame:
    """Insert zero-sale rows for the periods a product key skipped between two sales.

    Runs per product (same partitioning as the lags): each observed row is
    followed by the skipped periods up to the key's next observed one. Filled
    rows carry quantity 0, amount 0, the last observed mean prices and
    ``is_filled = 1``. Nothing is added before the first or after the last sale.
    """
    p = F.col(grain.period_col)
    w = Window.partitionBy("product_id").orderBy("product_name", "category", grain.period_col)
    next_p = F.lead(p).over(w)
    same_key = (F.lead("product_name").over(w) == F.col("product_name")) & (
        F.lead("category").over(w) == F.col("category")
    )
    last = F.when(same_key, grain.previous_period(next_p)).otherwise(p)
    return _spread(rolled.withColumn("_last", last), grain).drop("_pos")


def _spread(rows: DataFrame, grain: Grain) -> DataFrame:
    """Each row, then its filled rows up to the period ``_last``; ``_pos`` counts them from the row's own 0."""
    exploded = rows.withColumn("_periods", F.sequence(F.col(grain.period_col), F.col("_last"), F.expr(grain.step))).select(
        *[c for c in rows.columns if c not in (grain.period_col, "_last")],
        F.posexplode("_periods").alias("_pos", grain.period_col),
    )
    filled = F.col("_pos") > 0
    return exploded.withColumns(
        {
            "quantity": F.when(filled, F.lit(0).cast("bigint")).otherwise(F.col("quantity")),
            "total_amount": F.when(filled, F.lit(0).cast("bigint")).otherwise(F.col("total_amount")),
            "is_filled": filled.cast("tinyint"),
        }
    )


def filled_history(rolled: DataFrame, grain: Grain) -> DataFrame:
    """:func:`fill_gaps`, then :func:`add_history`, without sorting the filled rows of most products.

    A product under one name and category has a row in each period between its first and last, so
    what lies k periods back is known from its observed rows, before the filled ones are made. Products under
    several keys, whose rows interleave, and those with a null key or period take the two steps.
    """
    whole, w = Window.partitionBy("product_id"), history_window(grain)
    p, q, at = F.col(grain.period_col), F.col("quantity"), F.col("_at")
    key = F.struct(*PRODUCT_KEYS[1:])
    known = F.lit(True)
    for c in (*PRODUCT_KEYS[1:], grain.period_col):
        known = known & F.col(c).isNotNull()
    one_key = (F.min(key).over(whole) == F.max(key).over(whole)) & F.min(known).over(whole)

    def back(k: int) -> Column:
        """Quantity k periods before an observed row: NULL before the first, 0 between two."""
        value = F.when(at - F.min(at).over(w) >= k, F.lit(0).cast("bigint"))
        for r in range(k, 0, -1):
            value = F.when(F.lag(at, r).over(w) == at - k, F.lag(q, r).over(w)).otherwise(value)
        return value

    steps = rolled.withColumn("_at", grain.number_of(p)).withColumns({
        "_back": F.array(q, *[back(k) for k in range(1, grain.rolling_width + 1)]),
        "_last": F.coalesce(grain.previous_period(F.lead(p).over(w)), p),
    })
    # The windows in this order have one sort: the second asks for less than the first.
    filled = _spread(steps.withColumn("_one_key", one_key).where("_one_key"), grain)
    pos = F.col("_pos")
    lags = [F.when(pos > k, F.lit(0.0)).otherwise(F.get("_back", k - pos).cast("double")) for k in range(1, grain.rolling_width + 1)]
    oldest_first = reduce(add, reversed(lags))
    simple = filled.withColumns({grain.lag1_col: lags[0], grain.lag2_col: lags[1], grain.rolling_col: oldest_first / grain.rolling_width})
    rest = add_history(fill_gaps(rolled.withColumn("_one_key", one_key).where("NOT _one_key").drop("_one_key"), grain), grain)
    return simple.select(*rest.columns).unionByName(rest)


def narrow_types(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """DOUBLE -> FLOAT and BIGINT -> INT (raises on overflow under ANSI), last step only."""
    casts = {}
    for name, dtype in df.dtypes:
        if name in keep:
            continue
        if dtype == "double":
            casts[name] = F.col(name).cast("float")
        elif dtype == "bigint":
            casts[name] = F.col(name).cast("int")
    return df.withColumns(casts) if casts else df


def feature_columns_order(grain: Grain, flags: dict[str, int] | None, filled: bool) -> list[str]:
    from shelfcast.functions.temporal import DEFAULT_MONTH_FLAGS

    cols = [
        *PRODUCT_KEYS,
        grain.period_col,
        "quantity",
        *PRICE_MEANS,
        "total_amount",
        *grain.history_cols,
        "price_difference",
        *(DEFAULT_MONTH_FLAGS if flags is None else flags),
    ]
    if grain.payday_flag:
        cols.append("is_payday_week")
    if filled:
        cols.append("is_filled")
    cols.append("log_quantity")
    return cols


def build_features(
    tx: DataFrame,
    grain: Grain,
    *,
    narrow: bool = True,
    fill: bool = False,
    rolled: bool = False,
    drop_incomplete: bool = True,
    flags: dict[str, int] | None = None,
) -> DataFrame:
    """Cleaned transactions (``rolled``: their product-day rollup) -> weekly or monthly feature table (T2 / T3).

    rollup -> [gap fill] -> lags + rolling mean -> calendar columns -> drop rows
    without complete history -> log quantity -> [FLOAT/INT narrowing].
    """
    periods = rollup(tx, grain, rolled)
    history = filled_history(periods, grain) if fill else add_history(periods, grain)
    out = add_calendar(history, grain, flags)
    if drop_incomplete:
        out = out.dropna(subset=list(grain.history_cols))
    out = out.withColumn("log_quantity", F.log1p(F.greatest(F.col("quantity"), F.lit(0))))
    out = out.select(*feature_columns_order(grain, flags, fill))
    if narrow:
        measures = ("quantity", *PRICE_MEANS, "total_amount", *grain.history_cols, "price_difference", "log_quantity")
        out = out.withColumns({c: F.col(c).cast("float") for c in measures})
    return out


def daily_features(tx: DataFrame) -> DataFrame:
    """Per product and sale day: quantity, mean selling price, quantity sold 7 and 14
    days earlier, weekend flag, weekday (Monday 0) and month: the inputs of a
    single-row demand request.

    A lag day without a sale counts 0 once the product was on sale (its first
    sale is on or before that day) and NULL before it. All windows share the
    product partitioning of the daily rollup: no extra shuffle.
    """
    daily = tx.groupBy("product_id", "sale_date").agg(
        F.sum("quantity").alias("quantity"),
        F.avg("selling_price").alias("selling_price"),
    )
    w = Window.partitionBy("product_id").orderBy(F.unix_date("sale_date"))
    first_sale = F.min("sale_date").over(Window.partitionBy("product_id"))

    def sold_days_before(days: int) -> Column:
        on_day = F.sum("quantity").over(w.rangeBetween(-days, -days))
        return F.when(first_sale <= F.date_sub("sale_date", days), F.coalesce(on_day, F.lit(0))).cast("double")

    dow = F.weekday("sale_date")
    return daily.withColumns(
        {
            "lag_7": sold_days_before(7),
            "lag_14": sold_days_before(14),
            "day_of_week": dow,
            "is_weekend": dow >= 5,
            "month": F.month("sale_date"),
        }
    )
