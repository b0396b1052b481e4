"""Financial time-series functions.

Closed forms are column expressions over a window per symbol (``Axis``) or plain arithmetic. Recursive filters run through
``recurrent``: rows are dealt by symbol, sorted, and streamed through a task in Arrow batches with a few numbers of
state for each symbol, so memory is bounded however long a series is.

Nulls follow Spark's rules; where a function defines a warm-up value it is 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


class Axis:
    """Windows along a series: all rows so far, the last n rows, and the order itself."""

    def __init__(self, by: Sequence[str], order: Sequence[str]):
        self.w = W.partitionBy(*by).orderBy(*order)
        self.so_far = self.w.rowsBetween(W.unboundedPreceding, 0)

    def last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def lag(self, c: Column, k: int = 1) -> Column:
        return F.lag(c, k).over(self.w)

    def diff(self, c: Column, k: int = 1) -> Column:
        return F.coalesce(c - self.lag(c, k), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(a, b)


def correlation(a: Column, b: Column, w) -> Column:
    """Correlation over a window, of rows that have both; null where one doesn't vary."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))


# ---- returns and rolling statistics -------------------------------------------------------------

def log_returns(price: Column, ax: Axis) -> Column:
    return F.coalesce(F.log(price / ax.lag(price)), F.lit(0.0))


def running_mean(x: Column, ax: Axis) -> Column:
    return F.avg(x).over(ax.so_far)


def running_variance(x: Column, ax: Axis) -> Column:
    """Sample variance so far; 0 for the first row."""
    return F.coalesce(F.var_samp(x).over(ax.so_far), F.lit(0.0))


def rolling_zscore(x: Column, ax: Axis, n: int = 20) -> Column:
    w = ax.last(n)
    return F.coalesce(ratio(x - F.avg(x).over(w), F.stddev_pop(x).over(w)), F.lit(0.0))


def sma(x: Column, ax: Axis, n: int = 20) -> Column:
    return F.avg(x).over(ax.last(n))


def bollinger(x: Column, ax: Axis, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, std = F.avg(x).over(ax.last(n)), F.stddev_pop(x).over(ax.last(n))
    return {"bb_mid": mid, "bb_upper": mid + k * std, "bb_lower": mid - k * std}


def donchian(x: Column, ax: Axis, n: int = 20) -> dict[str, Column]:
    top, low = F.max(x).over(ax.last(n)), F.min(x).over(ax.last(n))
    return {"dc_upper": top, "dc_lower": low, "dc_mid": (top + low) / 2}


def stochastic(high: Column, low: Column, close: Column, ax: Axis, n: int = 14) -> Column:
    """%K; %D is its mean over three rows, on a second pass."""
    top, bottom = F.max(high).over(ax.last(n)), F.min(low).over(ax.last(n))
    return F.coalesce(ratio(100 * (close - bottom), top - bottom), F.lit(0.0))


def rolling(x: Column, ax: Axis, kind: str, n: int) -> Column:
    """min, max, std, skew or kurt over the last n rows."""
    fn = {"min": F.min, "max": F.max, "std": F.stddev_pop, "skew": F.skewness, "kurt": F.kurtosis}[kind]
    return fn(x).over(ax.last(n))


def autocorrelation(x: Column, lagged: Column, ax: Axis, n: int = 20) -> Column:
    """Correlation with a lagged column over the last n rows."""
    return correlation(x, lagged, ax.last(n))


# ---- quotes -------------------------------------------------------------------------------------

def midprice(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    return ratio(bid * ask_size + ask * bid_size, bid_size + ask_size)


def quoted_spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def effective_spread(price: Column, mid: Column) -> Column:
    return 2 * F.abs(price - mid)


def l1_imbalance(bid_size: Column, ask_size: Column) -> Column:
    return F.coalesce(ratio(bid_size - ask_size, bid_size + ask_size), F.lit(0.0))


def order_flow_imbalance(bid: Column, ask: Column, bid_size: Column, ask_size: Column, ax: Axis) -> Column:
    """Change of the bid size while the bid doesn't fall, less that of the ask size while the ask doesn't rise; first row 0."""
    bids = F.when(bid >= ax.lag(bid), bid_size - ax.lag(bid_size)).otherwise(0.0)
    asks = F.when(ask <= ax.lag(ask), ask_size - ax.lag(ask_size)).otherwise(0.0)
    return F.coalesce(bids - asks, F.lit(0.0))


# ---- volatility and liquidity -------------------------------------------------------------------

def realized_variance(r: Column, ax: Axis, n: int = 20) -> Column:
    return F.sum(r * r).over(ax.last(n))


def bipower_terms(r: Column, ax: Axis) -> Column:
    """Products of adjacent absolute returns; their rolling sum times pi/2 is the bipower variation."""
    return F.coalesce(F.abs(r) * F.abs(ax.lag(r)), F.lit(0.0))


def bipower_variation(terms: Column, ax: Axis, n: int = 20) -> Column:
    return (math.pi / 2) * F.sum(terms).over(ax.last(n))


def median_realized_variance(r: Column, ax: Axis, n: int = 20) -> Column:
    """Median of the squared returns times their number."""
    return F.percentile(r * r, F.lit(0.5)).over(ax.last(n)) * F.count(r).over(ax.last(n))


def kyle_lambda(r: Column, volume: Column, ax: Axis, n: int = 20) -> Column:
    w = ax.last(n)
    var = F.var_pop(volume).over(w)
    ok = (F.count(r).over(w) == n) & (var * n > 1e-10)
    return F.when(ok, ratio(F.covar_pop(r, volume).over(w), var)).otherwise(0.0)


def amihud_illiquidity(r: Column, volume: Column, ax: Axis, n: int = 20) -> Column:
    w = ax.last(n)
    return F.when(F.count(r).over(w) == n, F.coalesce(F.avg(F.when(volume > 1e-10, F.abs(r) / volume)).over(w), F.lit(0.0))).otherwise(0.0)


def roll_spread(r: Column, r1: Column, ax: Axis, n: int = 20) -> Column:
    """Twice the root of the negative covariance of adjacent returns; ``r1`` is ``r`` lagged by one. 0 before row n."""
    full, pairs = ax.last(n), ax.last(n - 1)
    m = F.avg(r).over(full)
    cov = (F.sum(r * r1).over(pairs) - m * (F.sum(r).over(pairs) + F.sum(r1).over(pairs)) + (n - 1) * m * m) / (n - 1)
    return F.when((F.row_number().over(ax.w) > n) & (cov < 0), 2 * F.sqrt(-cov)).otherwise(0.0)


def corwin_schultz(high: Column, low: Column, ax: Axis) -> Column:
    """Spread from this bar's range and the range of two bars; 0 before the third bar and where it is negative."""
    h2, l2 = F.greatest(high, ax.lag(high)), F.least(low, ax.lag(low))
    beta, gamma = F.log(high / low) ** 2, F.log(h2 / l2) ** 2
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    return F.when((F.row_number().over(ax.w) > 2) & (spread > 0), spread).otherwise(0.0)


# ---- FX, funding and basis ----------------------------------------------------------------------

def triangular_arbitrage(ab: Column, bc: Column, ac: Column, fees_bps: Column | float) -> dict[str, Column]:
    edge = (ab * bc / ac - 1) * 1e4 - fees_bps
    return {"arb_edge_bps": edge, "arb_route": F.when(edge > 0, "AB->BC->CA").otherwise("no_arb")}


def forward_points(spot: Column, r_dom: Column, r_for: Column, years: Column | float) -> Column:
    return spot * F.exp((r_dom - r_for) * years) - spot


def cip_basis(spot: Column, forward: Column, r_dom: Column, r_for: Column, years: Column | float) -> Column:
    return F.log(forward / spot) / years - (r_dom - r_for)


def carry_signal(r_dom: Column, r_for: Column, volatility: Column | None = None, k: float = 1.0) -> Column:
    return r_dom - r_for - (volatility * k if volatility is not None else 0)


def funding_apr(rate: Column, hours: float = 8.0) -> Column:
    return rate * (8760.0 / hours)


def funding_cost(position: Column, price: Column, rate: Column) -> Column:
    return position * price * rate


def basis_annualized(perp: Column, spot: Column, days: float) -> Column:
    return (perp / spot - 1) * (365.0 / days)


def open_interest_delta(oi: Column, ax: Axis) -> Column:
    return ax.diff(oi)


def perp_fair_price(spot: Column, funding: Column, basis: Column) -> Column:
    return spot * (1 + funding + basis)


def cash_and_carry_edge(perp: Column, spot: Column, funding: Column, fees_bps: float) -> Column:
    return (perp / spot - 1) * 1e4 - (funding * 1e4 + fees_bps)


# ---- execution and risk -------------------------------------------------------------------------

def vwap(price: Column, volume: Column, ax: Axis) -> Column:
    return ratio(F.sum(price * volume).over(ax.so_far), F.sum(volume).over(ax.so_far))


def implementation_shortfall(executed: Column, arrival: Column) -> Column:
    return (executed - arrival) / arrival * 1e4


def arrival_price_impact(executed: Column, mid: Column) -> Column:
    return (executed - mid) / mid * 1e4


def almgren_chriss(spark, quantity: float, kappa: float, horizon: float, slices: int = 10) -> DataFrame:
    """``slice, remaining, trade`` of the optimal schedule."""
    t = F.col("slice") * (horizon / slices)
    left = quantity * F.sinh(kappa * (horizon - t)) / math.sinh(kappa * horizon)
    after = quantity * F.sinh(kappa * (horizon - t - horizon / slices)) / math.sinh(kappa * horizon)
    return spark.range(slices).select(F.col("id").cast("int").alias("slice")).select("slice", left.alias("remaining"), (left - after).alias("trade"))


def cusum_path(x: Column, mean: Column, k: float, ax: Axis) -> Column:
    """Sum so far of the deviations; the CUSUM statistic is this less its minimum so far (0 at most)."""
    return F.sum(x - mean - k).over(ax.so_far)


def cusum(path: Column, ax: Axis) -> Column:
    return path - F.least(F.lit(0.0), F.min(path).over(ax.so_far))


def historical_var(x: Column, ax: Axis, alpha: float = 0.05, n: int = 250) -> Column:
    return -F.percentile(x, F.lit(alpha)).over(ax.last(n))


def historical_cvar(x: Column, ax: Axis, alpha: float = 0.05, n: int = 250) -> Column:
    """Mean loss at or beyond the quantile; the window is an array of n values at most."""
    values, cut = F.collect_list(x).over(ax.last(n)), F.percentile(x, F.lit(alpha)).over(ax.last(n))
    tail = F.filter(values, lambda v: v <= cut)
    return -F.aggregate(tail, F.lit(0.0), lambda a, v: a + v) / F.size(tail)


def cornish_fisher_var(mean: Column, std: Column, skew: Column, kurt: Column, alpha: float = 0.05) -> Column:
    z = NormalDist().inv_cdf(alpha)
    q = z + (z * z - 1) * skew / 6 + (z ** 3 - 3 * z) * kurt / 24 - (2 * z ** 3 - 5 * z) * skew * skew / 36
    return -(mean + q * std)


# ---- guards -------------------------------------------------------------------------------------

def signed_volume(side: Column, volume: Column) -> Column:
    return side * volume


def stale_quote(age: Column, limit: float) -> Column:
    return age > limit


def price_band(price: Column, reference: Column, pct: float) -> Column:
    """Whether the price lies outside the band around the reference."""
    return F.abs(price / reference - 1) > pct


def fat_finger(size: Column, limit: float) -> Column:
    return size > limit


def circuit_break(price: Column, reference: Column, pct: float) -> Column:
    return F.abs(price / reference - 1) > pct


def throttled(seconds: Column, by: Sequence[str], interval: int, limit: int) -> Column:
    """More than ``limit`` events of the key in the last ``interval`` seconds."""
    return F.count("*").over(W.partitionBy(*by).orderBy(seconds).rangeBetween(-interval, 0)) > limit


def outlier_mad(x: Column, ax: Axis, n: int = 50, k: float = 5.0) -> Column:
    """Further from the window's median than k median absolute deviations."""
    values, med = F.collect_list(x).over(ax.last(n)), F.percentile(x, F.lit(0.5)).over(ax.last(n))
    dev = F.array_sort(F.transform(values, lambda v: F.abs(v - med)))
    size = F.size(dev)
    mad = (F.element_at(dev, F.floor((size + 1) / 2).cast("int")) + F.element_at(dev, F.floor(size / 2 + 1).cast("int"))) / 2
    return F.abs(x - med) > k * mad


# ---- several series -----------------------------------------------------------------------------

def hayashi_yoshida(a: DataFrame, b: DataFrame, by: Sequence[str], bucket: float) -> DataFrame:
    """Sum of return products over overlapping intervals: ``by, hy_cov``.

    Inputs hold ``start, end`` (numbers) and ``r`` per interval; overlaps meet in buckets, each pair counted where it begins.
    """
    cut = lambda df, p: df.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in ("start", "end", "r")])
    spread = lambda df, p: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / bucket), F.floor(F.col(f"{p}_end") / bucket))))
    both = spread(cut(a, "a"), "a").join(spread(cut(b, "b"), "b"), [*by, "_b"])
    begin = F.greatest("a_start", "b_start")
    both = both.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.floor(begin / bucket) == F.col("_b")))
    return both.groupBy(*by).agg(F.sum(F.col("a_r") * F.col("b_r")).alias("hy_cov"))


def lead_lag(df: DataFrame, a: str, b: str, ax: Axis, reach: int = 10, n: int = 50) -> DataFrame:
    """``lag`` in -reach..reach with the largest absolute correlation of ``a`` with ``b`` shifted, over the last n rows, and ``lag_corr``;
    of equal ones (to nine digits) the nearest lag, and of two as near the later."""
    shifts = {k: f"_b{k + reach}" for k in range(-reach, reach + 1)}
    df = df.withColumns({name: F.lag(b, k).over(ax.w) for k, name in shifts.items()})
    df = df.withColumns({f"_r{name}": correlation(F.col(a), F.col(name), ax.last(n)) for name in shifts.values()})
    found = [F.struct(F.round(F.abs(f"_r{name}"), 9).alias("m"), F.lit(-abs(k)).alias("near"), F.lit(k).alias("k"), F.col(f"_r{name}").alias("c")) for k, name in shifts.items()]
    df = df.withColumn("_best", F.array_max(F.filter(F.array(*found), lambda s: s["m"].isNotNull())))
    return df.withColumn("lag", F.col("_best.k")).withColumn("lag_corr", F.col("_best.c")).drop("_best", *shifts.values(), *[f"_r{n}" for n in shifts.values()])


# ---- recursive filters --------------------------------------------------------------------------

def recurrent(df: DataFrame, by: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[str],
              step: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Adds ``outputs`` by ``step(values, state)``: values of consecutive rows of one key (rows x inputs), and a dict that
    lives as long as the key's rows. It returns rows x outputs."""
    by = list(by)
    dealt = df.repartition(*by).sortWithinPartitions(*by, *order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{c}` double" for c in outputs])

    def run(batches):
        key, state = None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            keys = list(zip(*(pdf[c] for c in by)))
            x = pdf[list(inputs)].to_numpy(float)
            out = np.empty((len(pdf), len(outputs)))
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(starts, starts[1:]):
                if keys[i] != key:
                    key, state = keys[i], {}
                out[i:j] = step(x[i:j], state)
            yield pd.concat([pdf, pd.DataFrame(out, columns=list(outputs), index=pdf.index)], axis=1)

    return dealt.mapInPandas(run, schema)


#: Rows of a block of a linear recurrence.
LINEAR_BLOCK = 64


def linear(x: np.ndarray, decay: float, before: float = 0.0) -> np.ndarray:
    """v = decay v + x along x, from ``before``: a triangular product for each block, and one number carried between blocks."""
    n = len(x)
    m = -(-n // LINEAR_BLOCK) if n else 0
    lag = np.subtract.outer(np.arange(LINEAR_BLOCK), np.arange(LINEAR_BLOCK))
    weights = np.where(lag >= 0, float(decay) ** np.maximum(lag, 0), 0.0)
    blocks = np.zeros((m, LINEAR_BLOCK))
    blocks.reshape(-1)[:n] = x
    out = blocks @ weights.T
    fade, carry = float(decay) ** np.arange(1, LINEAR_BLOCK + 1), before
    for row in out:
        row += fade * carry
        carry = row[-1]
    return out.reshape(-1)[:n]


def _mean(x: np.ndarray, rate: float, before: float | None) -> np.ndarray:
    """Exponential mean that starts at the first value."""
    steps = rate * x
    if before is None and len(x):
        steps[0] = x[0]
    return linear(steps, 1 - rate, before or 0.0)


def ewma_step(alpha: float) -> Callable:
    """v = alpha x + (1 - alpha) v, from the first value."""

    def step(x, s):
        out = _mean(x[:, 0], alpha, s.get("v"))
        s["v"] = out[-1]
        return out[:, None]

    return step


def ewcov_step(alpha: float) -> Callable:
    """Covariance by exponential means: what it was and alpha times the product of the deviations, x's before and y's after the
    means take the row in, both faded by 1 - alpha."""

    def step(x, s):
        mx, my, cov = s.get("m", (None, None, 0.0))
        means = [_mean(x[:, k], alpha, m) for k, m in ((0, mx), (1, my))]
        last = np.r_[x[0, 0] if mx is None else mx, means[0][:-1]]
        out = linear((1 - alpha) * alpha * (x[:, 0] - last) * (x[:, 1] - means[1]), 1 - alpha, cov)
        s["m"] = means[0][-1], means[1][-1], out[-1]
        return out[:, None]

    return step


def macd_step(fast: int = 12, slow: int = 26, signal: int = 9) -> Callable:
    """macd, signal, histogram of exponential means with alpha 2 / (n + 1)."""
    rates = [2 / (n + 1) for n in (fast, slow, signal)]

    def step(x, s):
        f, w, g = s.get("m", (None, None, None))
        f, w = _mean(x[:, 0], rates[0], f), _mean(x[:, 0], rates[1], w)
        g = _mean(f - w, rates[2], g)
        s["m"] = f[-1], w[-1], g[-1]
        return np.stack([f - w, g, f - w - g], axis=1)

    return step


def rsi_step(period: int = 14) -> Callable:
    """Relative strength by Wilder's means (alpha 1 / period); 50 before any move."""

    def step(x, s):
        last, up, down = s.get("m", (x[0, 0], 0.0, 0.0))
        move = np.diff(x[:, 0], prepend=last)
        up, down = (linear(np.maximum(d, 0.0) / period, 1 - 1 / period, m) for d, m in ((move, up), (-move, down)))
        both = up + down
        s["m"] = x[-1, 0], up[-1], down[-1]
        return np.where(both > 0, 100 * up / np.where(both > 0, both, 1.0), 50.0)[:, None]

    return step


def kalman_step(q: float, r: float) -> Callable:
    """Local-level Kalman filter from the first value with variance r."""

    def step(x, s):
        out = np.empty((len(x), 1))
        v, p = s.get("m", (None, r))
        for i, (z,) in enumerate(x.tolist()):
            if v is None:
                v, p = z, r
            else:
                p += q
                k = p / (p + r)
                v, p = v + k * (z - v), (1 - k) * p
            out[i] = v
        s["m"] = v, p
        return out

    return step


def riskmetrics_step(lam: float = 0.94) -> Callable:
    """sqrt(lam s2 + (1 - lam) r2), from r2."""

    def step(x, s):
        out = _mean(x[:, 0] ** 2, 1 - lam, s.get("v"))
        s["v"] = out[-1]
        return np.sqrt(np.maximum(out, 0.0))[:, None]

    return step


def vpin_step(bucket: float = 100_000.0) -> Callable:
    """Share of the volume by which one side outweighs the other in the volume bucket being filled; a bucket that is full is the last row's,
    and the next row begins another. Inputs: volume, side."""

    def step(x, s):
        out = np.empty((len(x), 1))
        buy, sell = s.get("m", (0.0, 0.0))
        for i, (volume, side) in enumerate(x.tolist()):
            buy, sell = (buy + volume, sell) if side > 0 else (buy, sell + volume)
            total = buy + sell
            out[i] = abs(buy - sell) / total if total > 0 else 0.0
            if total >= bucket:
                buy = sell = 0.0
        s["m"] = buy, sell
        return out

    return step


def pairs_spread(a: Column, b: Column, ratio: Column | float = 1.0) -> Column:
    """What is left of a price after the hedge by another."""
    return a - b * ratio


def hedge_ratio_step(q: float = 0.001, r: float = 0.1) -> Callable:
    """Kalman hedge ratio of a on b from ratio 1 and variance 1: ratio and spread."""

    def step(x, s):
        out = np.empty((len(x), 2))
        beta, p = s.get("m", (1.0, 1.0))
        for i, (a, b) in enumerate(x.tolist()):
            p += q
            k = p * b / (b * b * p + r)
            beta, p = beta + k * (a - beta * b), (1 - k * b) * p
            out[i] = beta, a - beta * b
        s["m"] = beta, p
        return out

    return step
