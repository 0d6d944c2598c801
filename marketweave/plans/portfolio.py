"""Portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio as p
from .registry import register, view

ALIGNED = """w AS (SELECT portfolio_id, asset_pos, upper(trim(code)) AS code, weight / sum(weight) OVER (PARTITION BY portfolio_id) AS weight, count(*) OVER (PARTITION BY portfolio_id) AS assets FROM fx_portfolios WHERE weight > 0 AND trim(code) <> ''),
a AS (SELECT portfolio_id, trade_date, asset_pos, code, weight, close AS price FROM (SELECT w.*, b.trade_date, b.close, count(*) OVER (PARTITION BY portfolio_id, trade_date) AS there FROM w JOIN fx_price_bars b ON upper(b.stock_code) = w.code AND b.close > 0) AS t WHERE there = assets)"""
HELD = """e AS (SELECT portfolio_id, trade_date, sum(10000.0 * weight / entry * price) AS equity FROM (SELECT *, first_value(price) OVER (PARTITION BY portfolio_id, asset_pos ORDER BY trade_date) AS entry FROM a) AS t GROUP BY portfolio_id, trade_date)"""
DAILY = """d AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY trade_date) - 1 AS n, coalesce(equity / lag(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date) - 1, 0.0) AS daily_return,
equity / max(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM e)"""
METRICS = """SELECT portfolio_id, days, round(growth - 1, 6) AS cumulative_return, round(pow(growth, 252.0 / (days - 1)) - 1, 6) AS cagr, round(mdd, 6) AS mdd, round(sd * sqrt(252.0), 6) AS volatility, round(mean / sd * sqrt(252.0), 6) AS sharpe
FROM (SELECT portfolio_id, count(*) AS days, product(1 + daily_return) FILTER (WHERE n > 0) AS growth, min(drawdown) AS mdd, stddev_samp(daily_return) FILTER (WHERE n > 0) AS sd, avg(daily_return) FILTER (WHERE n > 0) AS mean FROM d GROUP BY portfolio_id) AS m"""
FREE = """c AS (SELECT portfolio_id, trade_date, sum(CASE WHEN date_trunc('month', trade_date) <> date_trunc('month', before) THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS segment FROM (
  SELECT portfolio_id, trade_date, lag(trade_date) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS before FROM (SELECT DISTINCT portfolio_id, trade_date FROM a) AS x) AS y),
s AS (SELECT a.*, segment, first_value(price) OVER (PARTITION BY portfolio_id, asset_pos, segment ORDER BY trade_date) AS entry FROM a JOIN c USING (portfolio_id, trade_date)),
o AS (SELECT portfolio_id, asset_pos, weight, segment, min(entry) AS entry FROM s GROUP BY ALL),
g AS (SELECT n.portfolio_id, n.segment, sum(n.weight * n.entry / b.entry) AS period FROM o n JOIN o b ON b.portfolio_id = n.portfolio_id AND b.asset_pos = n.asset_pos AND b.segment = n.segment - 1 GROUP BY ALL),
l AS (SELECT portfolio_id, segment, product(period) OVER (PARTITION BY portfolio_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS level FROM g),
e AS (SELECT s.portfolio_id, s.trade_date, 10000.0 * coalesce(min(level), 1.0) * sum(weight * price / entry) AS equity FROM s LEFT JOIN l ON l.portfolio_id = s.portfolio_id AND l.segment = s.segment GROUP BY s.portfolio_id, s.trade_date)"""


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return p.align(view(spark, d, "fx_portfolios"), view(spark, d, "fx_price_bars"))


def _log(df: DataFrame, column: str, shift: float = 0.0) -> DataFrame:
    """Values over many magnitudes compare by their logarithm."""
    return df.withColumn(column, F.log(F.col(column) + shift))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("b1_normalised_weights", "SELECT portfolio_id, asset_pos, upper(trim(code)) AS code, round(weight / sum(weight) OVER (PARTITION BY portfolio_id), 6) AS weight FROM fx_portfolios WHERE weight > 0 AND trim(code) <> ''")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(p.normalise_weights(view(spark, d, "fx_portfolios")))


@register("b2_missing_prices", """SELECT portfolio_id, upper(code) AS code FROM (SELECT portfolio_id, code, weight FROM fx_portfolios UNION ALL SELECT 'unknown', p_name, 1.0 FROM part) AS t
  WHERE weight > 0 AND upper(code) NOT IN (SELECT upper(stock_code) FROM fx_price_bars WHERE close > 0)""")  # fmt: skip
def b2(spark: SparkSession, d: str) -> DataFrame:
    other = view(spark, d, "part").select(F.lit("unknown").alias("portfolio_id"), F.col("p_partkey").alias("asset_pos"), F.col("p_name").alias("code"), F.lit(1.0).alias("weight"))
    return p.missing_codes(view(spark, d, "fx_portfolios").unionByName(other), view(spark, d, "fx_price_bars"))


@register("b3_aligned_prices", f"WITH {ALIGNED} SELECT portfolio_id, trade_date, asset_pos, code, round(weight, 6) AS weight, round(price, 9) AS price FROM a")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).withColumn("weight", F.round("weight", 6)).withColumn("price", F.round("price", 9))


@register("b4_calendar", f"""WITH {ALIGNED} SELECT portfolio_id, trade_date, n, rebalances, contributes, sum(CASE WHEN rebalances OR contributes THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS segment
  FROM (SELECT portfolio_id, trade_date, n, coalesce(date_trunc('quarter', trade_date) <> date_trunc('quarter', before), FALSE) AS rebalances, coalesce(date_trunc('month', trade_date) <> date_trunc('month', before), FALSE) AS contributes
  FROM (SELECT portfolio_id, trade_date, row_number() OVER (PARTITION BY portfolio_id ORDER BY trade_date) - 1 AS n, lag(trade_date) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS before FROM (SELECT DISTINCT portfolio_id, trade_date FROM a) AS x) AS y) AS z""")  # fmt: skip
def b4(spark: SparkSession, d: str) -> DataFrame:
    return p.calendar(_aligned(spark, d), "quarterly", "monthly")


@register("b5_buy_and_hold", f"WITH {ALIGNED}, {HELD} SELECT portfolio_id, trade_date, round(equity + 1e-7, 3) AS equity FROM e")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(p.buy_and_hold(_aligned(spark, d)).withColumn("equity", F.col("equity") + 1e-7), 3)


@register("b6_rebalanced_monthly", f"WITH {ALIGNED}, {FREE} SELECT portfolio_id, trade_date, round(ln(equity), 6) AS equity FROM e")
def b6(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_log(p.rebalanced_free(_aligned(spark, d), "monthly"), "equity"))


@register("b6_rebalanced_by_fold", f"WITH {ALIGNED}, {FREE} SELECT portfolio_id, trade_date, round(ln(equity), 6) AS equity, CAST(0 AS DOUBLE) AS flow FROM e")
def b6_fold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_log(p.rebalanced(_aligned(spark, d), "monthly"), "equity"))


#: Rebalancing by quarter, 500 paid in by month and spent in the order of assets while there is cash; a trade costs 0.0015.
PAID = """c AS (SELECT *, CAST(sum(CASE WHEN reb OR con THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS k FROM (
  SELECT portfolio_id, trade_date, coalesce(date_trunc('quarter', trade_date) <> date_trunc('quarter', before), FALSE) AS reb, coalesce(date_trunc('month', trade_date) <> date_trunc('month', before), FALSE) AS con
  FROM (SELECT portfolio_id, trade_date, lag(trade_date) OVER (PARTITION BY portfolio_id ORDER BY trade_date) AS before FROM (SELECT DISTINCT portfolio_id, trade_date FROM a) AS q) AS q) AS q),
b AS (SELECT portfolio_id, k, min(trade_date) AS trade_date, arg_min(reb, trade_date) AS reb, arg_min(con, trade_date) AS con FROM c GROUP BY portfolio_id, k),
v AS (SELECT portfolio_id, k, any_value(reb) AS reb, any_value(con) AS con, list(price ORDER BY asset_pos) AS px, list(weight ORDER BY asset_pos) AS wt FROM b JOIN a USING (portfolio_id, trade_date) GROUP BY portfolio_id, k),
t AS (SELECT portfolio_id, k, 10000.0 - 10000.0 * list_sum(wt) AS cash, list_transform(range(1, len(px) + 1), lambda i: 10000.0 * wt[i] / (px[i] * 1.0015)) AS held FROM v WHERE k = 0
  UNION ALL SELECT portfolio_id, k, cash - list_sum(list_transform(gap, lambda y: CASE WHEN abs(y) < 1e-8 THEN 0.0 WHEN y > 0 THEN y ELSE y * 0.9985 END)),
    list_transform(range(1, len(px) + 1), lambda i: CASE WHEN abs(gap[i]) < 1e-8 THEN held[i] WHEN gap[i] > 0 THEN held[i] + gap[i] / (px[i] * 1.0015) ELSE held[i] + gap[i] / px[i] END)
  FROM (SELECT *, list_transform(range(1, len(px) + 1), lambda i: CASE WHEN reb THEN (cash + list_sum(list_transform(range(1, len(px) + 1), lambda j: held[j] * px[j]))) * wt[i] - held[i] * px[i] ELSE 0.0 END) AS gap
    FROM (SELECT portfolio_id, k, reb, px, wt, cash - list_sum(paid) AS cash, list_transform(range(1, len(px) + 1), lambda i: held[i] + paid[i] / (px[i] * 1.0015)) AS held
      FROM (SELECT *, list_transform(range(1, len(px) + 1), lambda i: CASE WHEN con THEN greatest(0.0, least(500.0 * wt[i], cash - 500.0 * (list_sum(wt[1:i]) - wt[i]))) ELSE 0.0 END) AS paid
        FROM (SELECT v.portfolio_id, v.k, v.reb, v.con, v.px, v.wt, t.held, t.cash + CASE WHEN v.con THEN 500.0 ELSE 0.0 END AS cash FROM t JOIN v ON v.portfolio_id = t.portfolio_id AND v.k = t.k + 1) AS q) AS q) AS q) AS q)"""


@register("b7_contributions_with_costs", f"""WITH RECURSIVE {ALIGNED}, {PAID}, p AS (SELECT portfolio_id, trade_date, k, con, list(price ORDER BY asset_pos) AS px FROM a JOIN c USING (portfolio_id, trade_date) GROUP BY ALL)
  SELECT portfolio_id, trade_date, round(ln(cash + list_sum(list_transform(range(1, len(px) + 1), lambda i: held[i] * px[i]))), 6) AS equity, CAST(CASE WHEN con THEN 500 ELSE 0 END AS DOUBLE) AS flow FROM p JOIN t USING (portfolio_id, k)""")  # fmt: skip
def b7(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_log(p.rebalanced(_aligned(spark, d), "quarterly", "monthly", 500.0, cost=0.0015), "equity"))


@register("b8_daily_points", f"WITH {ALIGNED}, {HELD}, {DAILY} SELECT portfolio_id, trade_date, round(equity + 1e-7, 3) AS equity, n, round(daily_return, 6) AS daily_return, round(drawdown, 6) AS drawdown FROM d")
def b8(spark: SparkSession, d: str) -> DataFrame:
    days = p.daily(p.buy_and_hold(_aligned(spark, d)))
    return days.select("portfolio_id", "trade_date", F.round(F.col("equity") + 1e-7, 3).alias("equity"), "n", F.round("daily_return", 6).alias("daily_return"), F.round("drawdown", 6).alias("drawdown"))


@register("b9_metrics", f"WITH {ALIGNED}, {HELD}, {DAILY} {METRICS}")
def b9(spark: SparkSession, d: str) -> DataFrame:
    """Return, drawdown, volatility and Sharpe ratio of buy-and-hold portfolios: the flagship query."""
    return _rounded(p.metrics(p.daily(p.buy_and_hold(_aligned(spark, d)))))


@register("b9_metrics_rebalanced", f"WITH {ALIGNED}, {FREE}, {DAILY} {METRICS.replace('round(growth - 1, 6)', 'round(ln(growth), 6)')}")
def b9_rebalanced(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_log(p.metrics(p.daily(p.rebalanced_free(_aligned(spark, d), "monthly"))), "cumulative_return", 1.0))


@register("b10_index_series", f"WITH {ALIGNED}, {HELD} SELECT portfolio_id, trade_date, round(equity / first_value(equity) OVER (PARTITION BY portfolio_id ORDER BY trade_date) * 100, 5) AS index FROM e")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(p.indexed(p.buy_and_hold(_aligned(spark, d))).drop("equity"), 5)


@register("b10_benchmark", f"""WITH {ALIGNED}, {HELD},
  k AS (SELECT e.portfolio_id, e.trade_date, b.close / first_value(b.close) OVER (PARTITION BY e.portfolio_id ORDER BY e.trade_date) AS share FROM e JOIN fx_price_bars b ON b.trade_date = e.trade_date AND b.close > 0 AND b.stock_code = (SELECT min(code) FROM fx_codes))
  SELECT portfolio_id, round(arg_max(share, trade_date) - 1, 6) AS benchmark_return, round(pow(arg_max(share, trade_date), 252.0 / (count(*) - 1)) - 1, 6) AS benchmark_cagr FROM k GROUP BY portfolio_id""")  # fmt: skip
def b10_benchmark(spark: SparkSession, d: str) -> DataFrame:
    code = view(spark, d, "fx_codes").agg(F.min("code")).first()[0]
    return _rounded(p.benchmark_metrics(p.benchmark(p.buy_and_hold(_aligned(spark, d)), view(spark, d, "fx_price_bars"), code)))


#: The gap of each asset to its weight on every event day, and what is held and paid behind it, when a trade costs a thousandth.
TRADED = """v AS (SELECT portfolio_id, CAST(segment AS BIGINT) AS k, list(entry ORDER BY asset_pos) AS px, list(weight ORDER BY asset_pos) AS wt FROM o GROUP BY portfolio_id, segment),
t AS (SELECT portfolio_id, k, 10000.0 - 10000.0 * list_sum(wt) AS cash, list_transform(range(1, len(px) + 1), lambda i: 10000.0 * wt[i] / (px[i] * 1.001)) AS held, list_transform(wt, lambda y: 10000.0 * y) AS gap FROM v WHERE k = 0
  UNION ALL SELECT portfolio_id, k, cash - list_sum(list_transform(gap, lambda y: CASE WHEN abs(y) < 1e-8 THEN 0.0 WHEN y > 0 THEN y ELSE y * 0.999 END)),
    list_transform(range(1, len(px) + 1), lambda i: CASE WHEN abs(gap[i]) < 1e-8 THEN held[i] WHEN gap[i] > 0 THEN held[i] + gap[i] / (px[i] * 1.001) ELSE held[i] - least(held[i], -gap[i] / px[i]) END), gap
  FROM (SELECT portfolio_id, k, px, cash, held, list_transform(range(1, len(px) + 1), lambda i: equity * wt[i] - held[i] * px[i]) AS gap
    FROM (SELECT v.portfolio_id, v.k, v.px, v.wt, t.cash, t.held, t.cash + list_sum(list_transform(range(1, len(v.px) + 1), lambda i: t.held[i] * v.px[i])) AS equity FROM t JOIN v ON v.portfolio_id = t.portfolio_id AND v.k = t.k + 1) AS q) AS r),
z AS (SELECT * FROM (SELECT portfolio_id, k, unnest(gap) AS gap FROM t) AS q WHERE abs(gap) >= 1e-8)"""


@register("b11_turnover", f"""WITH RECURSIVE {ALIGNED}, {FREE}, {TRADED}, n AS (SELECT portfolio_id, max(k) AS events FROM t GROUP BY portfolio_id)
  SELECT portfolio_id, count(*) AS trades, round(ln(sum(CASE WHEN gap > 0 THEN gap / 1.001 ELSE -gap END)), 6) AS traded, min(events) AS events, CAST(0 AS DOUBLE) AS paid_in, round(ln(sum(CASE WHEN gap > 0 THEN gap / 1.001 ELSE -gap END) / 10000), 6) AS turnover_ratio
  FROM z JOIN n USING (portfolio_id) GROUP BY portfolio_id""")  # fmt: skip
def b11_turnover(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_log(_log(p.turnover(p.states(_aligned(spark, d), "monthly", cost=0.001)), "traded"), "turnover_ratio"))


@register("b11_ledger", f"""WITH RECURSIVE {ALIGNED}, {FREE}, {TRADED}, days AS (SELECT portfolio_id, segment AS k, min(trade_date) AS trade_date FROM c GROUP BY portfolio_id, segment),
  codes AS (SELECT portfolio_id, code, row_number() OVER (PARTITION BY portfolio_id ORDER BY asset_pos) AS i FROM w), u AS (SELECT portfolio_id, k, unnest(gap) AS gap, generate_subscripts(gap, 1) AS i FROM t),
  f AS (SELECT portfolio_id, trade_date, CAST(row_number() OVER (PARTITION BY portfolio_id, u.k ORDER BY i) - 1 AS INT) AS n, code, gap, px[i] AS price FROM u JOIN v USING (portfolio_id, k) JOIN days USING (portfolio_id, k) JOIN codes USING (portfolio_id, i) WHERE abs(gap) >= 1e-8)
  SELECT portfolio_id, trade_date, n, code, CASE WHEN gap > 0 THEN 'buy' ELSE 'sell' END AS side, round(ln(gross / price), 6) AS quantity, round(price, 6) AS price, round(ln(gross), 6) AS gross, round(ln(gross * 0.001), 6) AS cost
  FROM (SELECT *, CASE WHEN gap > 0 THEN gap / 1.001 ELSE -gap END AS gross FROM f) AS q""")  # fmt: skip
def b11(spark: SparkSession, d: str) -> DataFrame:
    made = p.ledger(p.states(_aligned(spark, d), "monthly", cost=0.001))
    return _rounded(_log(_log(_log(made, "quantity"), "gross"), "cost"))


@register("b12_comparison", f"""WITH {ALIGNED}, {HELD}, f AS (SELECT portfolio_id, trade_date, equity FROM e), h AS (WITH {FREE} SELECT portfolio_id, trade_date, equity FROM e)
  SELECT series, portfolio_id, trade_date, round(ln(equity / first_value(equity) OVER (PARTITION BY series, portfolio_id ORDER BY trade_date) * 100), 6) AS index FROM (SELECT 'held' AS series, * FROM f UNION ALL SELECT 'monthly', * FROM h) AS t""")  # fmt: skip
def b12(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d)
    return _rounded(p.compare({"held": p.indexed(p.buy_and_hold(a)), "monthly": p.indexed(p.rebalanced_free(a, "monthly"))}).withColumn("index", F.log("index")))
