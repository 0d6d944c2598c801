"""Weighted portfolios over price bars: many portfolios in one job.

portfolios: portfolio_id, asset_pos, code, weight. bars: stock_code, trade_date, close and perhaps adj_close.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trading days of a year, and the smallest difference that is traded.
YEAR_DAYS, LEAST_TRADE = 252.0, 1e-8


def normalise_weights(portfolios: DataFrame) -> DataFrame:
    """Drops blank codes and weights that aren't positive, upper-cases codes and makes the weights of a portfolio add up to one."""
    code = F.upper(F.trim("code"))
    kept = portfolios.where((code != "") & (F.col("weight") > 0)).withColumn("code", code)
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("portfolio_id")))


def usable_prices(bars: DataFrame) -> DataFrame:
    """code, trade_date, price: the adjusted close where there is one, else the close; only positive prices."""
    price = F.coalesce("adj_close", "close") if "adj_close" in bars.columns else F.col("close")
    return bars.select(F.upper("stock_code").alias("code"), "trade_date", price.alias("price")).where("price > 0")


def missing_codes(portfolios: DataFrame, bars: DataFrame) -> DataFrame:
    """portfolio_id and code of assets without a usable price."""
    return normalise_weights(portfolios).select("portfolio_id", "code").join(usable_prices(bars).select("code").distinct(), "code", "left_anti").select("portfolio_id", "code")


def align(portfolios: DataFrame, bars: DataFrame) -> DataFrame:
    """portfolio_id, trade_date, asset_pos, code, weight, price on the days on which all assets of the portfolio have a price."""
    weights = normalise_weights(portfolios).withColumn("assets", F.count("*").over(Window.partitionBy("portfolio_id")))
    priced = weights.join(usable_prices(bars), "code")
    there = F.count("*").over(Window.partitionBy("portfolio_id", "trade_date"))
    return priced.withColumn("there", there).where("there = assets").select("portfolio_id", "trade_date", "asset_pos", "code", "weight", "price")


def period_changed(frequency: str, before: Column, now: Column) -> Column:
    """Whether a calendar period starts between two days; frequency is none, monthly, quarterly or yearly."""
    unit = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}.get(frequency)
    return F.lit(False) if unit is None else F.coalesce(F.trunc(before, unit) != F.trunc(now, unit), F.lit(False))


def calendar(aligned: DataFrame, rebalance: str = "none", contribution: str = "none") -> DataFrame:
    """portfolio_id, trade_date, n (day number from 0), rebalances, contributes, segment (number of events before and on the day)."""
    by = Window.partitionBy("portfolio_id").orderBy("trade_date")
    days = aligned.select("portfolio_id", "trade_date").distinct().withColumn("before", F.lag("trade_date").over(by)).withColumn("n", F.row_number().over(by) - 1)
    flagged = days.withColumn("rebalances", period_changed(rebalance, F.col("before"), F.col("trade_date"))).withColumn("contributes", period_changed(contribution, F.col("before"), F.col("trade_date")))
    event = (F.col("rebalances") | F.col("contributes")).cast("int")
    return flagged.withColumn("segment", F.sum(event).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def buy_and_hold(aligned: DataFrame, capital: float = 10_000.0, cost: float = 0.0) -> DataFrame:
    """portfolio_id, trade_date, equity: everything is bought on the first common day and kept."""
    first = aligned.groupBy("portfolio_id", "asset_pos").agg(F.min_by("price", "trade_date").alias("entry"))
    held = aligned.join(first, ["portfolio_id", "asset_pos"])
    value = F.lit(capital) * F.col("weight") / (F.col("entry") * (1 + cost)) * F.col("price")
    return held.groupBy("portfolio_id", "trade_date").agg(F.sum(value).alias("equity"))


def _trade(days: pd.DataFrame, capital: float, cost: float, amount: float) -> Iterator[dict]:
    """The state after each event of one portfolio and the trades that led to it. days: event days by asset, in order."""
    cash, held = capital, {}
    for n, (day, rows) in enumerate(days.groupby("trade_date", sort=True)):
        rows = rows.sort_values("asset_pos")
        assets = list(zip(rows["asset_pos"], rows["code"], rows["weight"], rows["price"]))
        trades, flow = [], 0.0

        def buy(pos, code, price, budget):
            nonlocal cash
            quantity = budget / (price * (1 + cost))
            gross = quantity * price
            cash -= gross * (1 + cost)
            held[pos] = held.get(pos, 0.0) + quantity
            trades.append({"code": code, "side": "buy", "quantity": quantity, "price": price, "gross": gross, "cost": gross * cost})

        if n == 0:
            for pos, code, weight, price in assets:
                buy(pos, code, price, capital * weight)
        else:
            if amount > 0 and bool(rows["contributes"].iloc[0]):
                flow = amount
                cash += amount
                for pos, code, weight, price in assets:  # no more than there is in cash
                    budget = min(amount * weight, cash)
                    if budget > 0:
                        buy(pos, code, price, budget)
            if bool(rows["rebalances"].iloc[0]):
                equity = cash + sum(held[pos] * price for pos, _, _, price in assets)
                for pos, code, weight, price in assets:
                    gap = equity * weight - held[pos] * price
                    if abs(gap) < LEAST_TRADE:
                        continue
                    if gap > 0:
                        buy(pos, code, price, gap)
                    elif (quantity := min(held[pos], -gap / price)) > 0:
                        gross = quantity * price
                        cash += gross * (1 - cost)
                        held[pos] -= quantity
                        trades.append({"code": code, "side": "sell", "quantity": quantity, "price": price, "gross": gross, "cost": gross * cost})
        yield {"trade_date": day, "segment": n, "cash": cash, "flow": flow, "holdings": [{"asset_pos": p, "quantity": q} for p, q in sorted(held.items())], "trades": trades}


def states(aligned: DataFrame, rebalance: str, contribution: str = "none", amount: float = 0.0, capital: float = 10_000.0, cost: float = 0.0) -> DataFrame:
    """portfolio_id, trade_date, segment, cash, flow, holdings and trades after each event: the first day, contributions, rebalancing.

    A portfolio's group holds its event days only, a row per month and asset at most.
    """
    days = calendar(aligned, rebalance, contribution if amount > 0 else "none").where("n = 0 OR rebalances OR contributes")
    events = aligned.join(days, ["portfolio_id", "trade_date"])
    schema = """portfolio_id string, trade_date date, segment int, cash double, flow double, holdings array<struct<asset_pos:long,quantity:double>>,
        trades array<struct<code:string,side:string,quantity:double,price:double,gross:double,cost:double>>"""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"portfolio_id": key[0], **e} for e in _trade(rows, capital, cost, amount)])

    return events.groupBy("portfolio_id").applyInPandas(fold, schema)


def rebalanced(aligned: DataFrame, rebalance: str, contribution: str = "none", amount: float = 0.0, capital: float = 10_000.0, cost: float = 0.0) -> DataFrame:
    """portfolio_id, trade_date, equity, flow (paid in on the day) with rebalancing, contributions and costs."""
    at = states(aligned, rebalance, contribution, amount, capital, cost)
    held = at.select("portfolio_id", "segment", "cash", F.inline("holdings"))
    days = calendar(aligned, rebalance, contribution if amount > 0 else "none").select("portfolio_id", "trade_date", "segment")
    priced = aligned.join(days, ["portfolio_id", "trade_date"]).join(held, ["portfolio_id", "segment", "asset_pos"])
    equity = priced.groupBy("portfolio_id", "trade_date").agg((F.sum(F.col("quantity") * F.col("price")) + F.max("cash")).alias("equity"))
    return equity.join(at.select("portfolio_id", "trade_date", "flow"), ["portfolio_id", "trade_date"], "left").withColumn("flow", F.coalesce("flow", F.lit(0.0)))


def rebalanced_free(aligned: DataFrame, rebalance: str, capital: float = 10_000.0) -> DataFrame:
    """portfolio_id, trade_date, equity with rebalancing at no cost: the growth of each period from its first day, multiplied."""
    days = calendar(aligned, rebalance).select("portfolio_id", "trade_date", "segment")
    priced = aligned.join(days, ["portfolio_id", "trade_date"])
    # A day that starts a period ends the one before: the old holdings are sold at its prices.
    start = priced.groupBy("portfolio_id", "segment", "asset_pos").agg(F.min_by("price", "trade_date").alias("entry"))
    held = priced.join(start, ["portfolio_id", "segment", "asset_pos"]).groupBy("portfolio_id", "segment", "trade_date").agg(F.sum(F.col("weight") * F.col("price") / F.col("entry")).alias("growth"))
    opening = start.join(start.select("portfolio_id", (F.col("segment") + 1).alias("segment"), "asset_pos", F.col("entry").alias("before")), ["portfolio_id", "segment", "asset_pos"])
    weights = aligned.select("portfolio_id", "asset_pos", "weight").distinct()
    whole = opening.join(weights, ["portfolio_id", "asset_pos"]).groupBy("portfolio_id", "segment").agg(F.sum(F.col("weight") * F.col("entry") / F.col("before")).alias("period"))
    by = Window.partitionBy("portfolio_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    level = whole.withColumn("level", F.product("period").over(by)).select("portfolio_id", "segment", "level")
    joined = held.join(level, ["portfolio_id", "segment"], "left")
    return joined.select("portfolio_id", "trade_date", (F.lit(capital) * F.coalesce("level", F.lit(1.0)) * F.col("growth")).alias("equity"))


def daily(equity: DataFrame) -> DataFrame:
    """Adds n, daily_return (net of a column flow, 0 on the first day) and drawdown from the highest equity so far."""
    by = Window.partitionBy("portfolio_id").orderBy("trade_date")
    flow = F.col("flow") if "flow" in equity.columns else F.lit(0.0)
    before, peak = F.lag("equity").over(by), F.max("equity").over(by.rowsBetween(Window.unboundedPreceding, 0))
    change = F.when(before > 0, (F.col("equity") - flow) / before - 1).otherwise(0.0)
    return equity.withColumn("n", F.row_number().over(by) - 1).withColumn("daily_return", F.coalesce(change, F.lit(0.0))).withColumn("drawdown", F.when(peak > 0, F.col("equity") / peak - 1).otherwise(0.0))


def metrics(days: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Per portfolio: days, cumulative_return, cagr, mdd, volatility, sharpe; null where there are too few returns or none varies."""
    later = F.when(F.col("n") > 0, F.col("daily_return"))
    a = days.groupBy("portfolio_id").agg(
        F.count("*").alias("days"), F.coalesce(F.product(1 + later), F.lit(1.0)).alias("growth"), F.min("drawdown").alias("mdd"), F.count(later).alias("k"), F.stddev_samp(later).alias("sd"), F.avg(later).alias("mean")
    )
    root = math.sqrt(YEAR_DAYS)
    enough = F.col("k") >= 2
    return a.select(
        "portfolio_id", "days", (F.col("growth") - 1).alias("cumulative_return"), F.when(F.col("days") >= 2, F.pow("growth", YEAR_DAYS / (F.col("days") - 1)) - 1).alias("cagr"), "mdd",
        F.when(enough, F.col("sd") * root).alias("volatility"), F.when(enough & (F.col("sd") > 0), (F.col("mean") - risk_free / YEAR_DAYS) / F.col("sd") * root).alias("sharpe"),
    )


def indexed(equity: DataFrame) -> DataFrame:
    """Adds index: equity as a share of its first day, times 100."""
    first = F.first("equity").over(Window.partitionBy("portfolio_id").orderBy("trade_date"))
    return equity.withColumn("index", F.col("equity") / F.when(first > 0, first).otherwise(1.0) * 100)


def benchmark(equity: DataFrame, bars: DataFrame, code: str, capital: float = 10_000.0) -> DataFrame:
    """portfolio_id, trade_date, equity, index of holding code instead, on the days of equity on which it has a price; two days at least."""
    px = usable_prices(bars).where(F.col("code") == code.upper()).select("trade_date", "price")
    on = equity.select("portfolio_id", "trade_date").join(px, "trade_date")
    by = Window.partitionBy("portfolio_id")
    share = F.col("price") / F.first("price").over(by.orderBy("trade_date"))
    return on.withColumn("share", share).withColumn("k", F.count("*").over(by)).where("k >= 2").select("portfolio_id", "trade_date", (F.col("share") * capital).alias("equity"), (F.col("share") * 100).alias("index"))


def benchmark_metrics(series: DataFrame) -> DataFrame:
    """Per portfolio: benchmark_return and benchmark_cagr of a benchmark series."""
    a = series.groupBy("portfolio_id").agg(F.min_by("index", "trade_date").alias("a"), F.max_by("index", "trade_date").alias("b"), F.count("*").alias("k"))
    ratio = F.col("b") / F.col("a")
    return a.select("portfolio_id", (ratio - 1).alias("benchmark_return"), (F.pow(ratio, YEAR_DAYS / (F.col("k") - 1)) - 1).alias("benchmark_cagr"))


def ledger(at: DataFrame) -> DataFrame:
    """A row per trade of states()."""
    return at.select("portfolio_id", "trade_date", F.posexplode("trades").alias("n", "t")).select("portfolio_id", "trade_date", "n", "t.*")


def turnover(at: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Per portfolio: trades, traded, turnover_ratio, events after the first day, paid_in."""
    each = at.select("portfolio_id", "segment", "flow", F.size("trades").alias("k"), F.aggregate("trades", F.lit(0.0), lambda a, t: a + F.abs(t["gross"])).alias("g"))
    a = each.groupBy("portfolio_id").agg(F.sum("k").alias("trades"), F.sum("g").alias("traded"), F.count_if(F.col("segment") > 0).alias("events"), F.sum("flow").alias("paid_in"))
    return a.withColumn("turnover_ratio", F.col("traded") / capital)


def compare(series: dict[str, DataFrame]) -> DataFrame:
    """Several indexed series in long form: series, portfolio_id, trade_date, index."""
    parts = [df.select(F.lit(name).alias("series"), "portfolio_id", "trade_date", "index") for name, df in series.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
