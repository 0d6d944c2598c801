import datetime as dt
import math
import random

import pytest

from marketweave.operators import portfolio as p


def frames(spark, seed=1, days=90, assets=3):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 25)
    bars = [(f"A{a}", start + dt.timedelta(days=d), rng.uniform(5, 20)) for a in range(assets) for d in range(days)]
    weights = [("x", a, f"a{a}", float(a + 1)) for a in range(assets)] + [("x", 9, "ZERO", 0.0)]
    return spark.createDataFrame(weights, "portfolio_id string, asset_pos long, code string, weight double"), spark.createDataFrame(bars, "stock_code string, trade_date date, close double")


def loop(bars, weights, monthly, amount, cost, capital=10_000.0):
    """Day by day, asset by asset."""
    days = sorted({d for _, d, _ in bars})
    px = {(c, d): v for c, d, v in bars}
    total = sum(w for *_, w in weights if w > 0)
    assets = [(c.upper(), w / total) for _, _, c, w in weights if w > 0]
    cash, held, out, prev = capital, {c: 0.0 for c, _ in assets}, [], None
    for d in days:
        flow = 0.0
        changed = prev is not None and (prev.year, prev.month) != (d.year, d.month)
        if prev is None:
            for c, w in assets:
                q = capital * w / (px[c, d] * (1 + cost))
                cash -= q * px[c, d] * (1 + cost)
                held[c] += q
        if changed and amount:
            cash, flow = cash + amount, amount
            for c, w in assets:
                spend = min(amount * w, cash)
                if spend > 0:
                    cash -= spend
                    held[c] += spend / (px[c, d] * (1 + cost))
        if changed and monthly:
            equity = cash + sum(held[c] * px[c, d] for c, _ in assets)
            for c, w in assets:
                gap = equity * w - held[c] * px[c, d]
                if gap > 1e-8:
                    cash -= gap
                    held[c] += gap / (px[c, d] * (1 + cost))
                elif gap < -1e-8:
                    q = min(held[c], -gap / px[c, d])
                    cash += q * px[c, d] * (1 - cost)
                    held[c] -= q
        out.append((d, cash + sum(held[c] * px[c, d] for c, _ in assets), flow))
        prev = d
    return out


@pytest.mark.parametrize("monthly,amount,cost", [(True, 0.0, 0.0), (True, 300.0, 0.002), (False, 300.0, 0.001), (True, 0.0, 0.01)])
def test_rebalancing_equals_the_daily_loop(spark, monthly, amount, cost):
    weights, bars = frames(spark)
    expected = loop([tuple(r) for r in bars.collect()], [tuple(r) for r in weights.collect()], monthly, amount, cost)
    got = p.rebalanced(p.align(weights, bars), "monthly" if monthly else "none", "monthly", amount, cost=cost).orderBy("trade_date").collect()
    assert len(got) == len(expected)
    for g, (d, equity, flow) in zip(got, expected):
        assert g["trade_date"] == d and math.isclose(g["equity"], equity, rel_tol=1e-9) and g["flow"] == flow


def test_free_rebalancing_by_windows_equals_the_fold(spark):
    aligned = p.align(*frames(spark, 5))
    a = {r["trade_date"]: r["equity"] for r in p.rebalanced(aligned, "monthly").collect()}
    b = {r["trade_date"]: r["equity"] for r in p.rebalanced_free(aligned, "monthly").collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[d], b[d], rel_tol=1e-9) for d in a)


def test_weights_add_up_and_bad_ones_go(spark):
    rows = p.normalise_weights(frames(spark)[0]).collect()
    assert len(rows) == 3 and math.isclose(sum(r["weight"] for r in rows), 1.0) and {r["code"] for r in rows} == {"A0", "A1", "A2"}


def test_days_without_a_price_of_one_asset_are_left_out(spark):
    weights, bars = frames(spark, days=5)
    few = bars.where("NOT (stock_code = 'A1' AND day(trade_date) = 26)").unionByName(bars.limit(0))
    assert p.align(weights, few).select("trade_date").distinct().count() == 4


def test_metrics_of_a_single_day_are_null(spark):
    weights, bars = frames(spark, days=1)
    m = p.metrics(p.daily(p.buy_and_hold(p.align(weights, bars)))).first()
    assert (m["days"], m["cumulative_return"], m["mdd"]) == (1, 0.0, 0.0) and m["cagr"] is None and m["sharpe"] is None and m["volatility"] is None


def test_drawdown_is_never_positive_and_returns_compound(spark):
    days = p.daily(p.buy_and_hold(p.align(*frames(spark, 3)))).orderBy("trade_date").collect()
    assert all(r["drawdown"] <= 0 for r in days)
    growth = math.prod(1 + r["daily_return"] for r in days[1:])
    assert math.isclose(growth, days[-1]["equity"] / days[0]["equity"], rel_tol=1e-9)


def test_trades_and_turnover_agree(spark):
    at = p.states(p.align(*frames(spark)), "monthly", cost=0.001)
    trades, sums = p.ledger(at).collect(), p.turnover(at).first()
    assert len(trades) == sums["trades"] and math.isclose(sum(t["gross"] for t in trades), sums["traded"], rel_tol=1e-9)
