"""Financial time series over ``events``: symbol = user_id, price = value + 1, order = (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import finance as fin
from tessera.plans.register import Group
from tessera.session import table

QUERIES = Group()
query = QUERIES.query

AX_SQL = "PARTITION BY user_id ORDER BY ts, event_id"
TICKS_SQL = f"""ticks AS (SELECT *, coalesce(ln(price / lag(price) OVER ({AX_SQL})), 0) AS r FROM (SELECT event_id, user_id, ts, value + 1 AS price,
  (1 + event_id % 97)::DOUBLE AS volume, value + 0.9 AS bid, value + 1.1 AS ask, (5 + event_id % 11)::DOUBLE AS bs, (5 + event_id % 7)::DOUBLE AS az FROM events))"""


def axis() -> fin.Axis:
    return fin.Axis(["user_id"], ["ts", "event_id"])


def ticks(spark, d):
    e = table(spark, d, "events")
    id_, v = F.col("event_id"), F.col("value")
    rows = e.select("event_id", "user_id", "ts", (v + 1).alias("price"), (1 + id_ % 97).cast("double").alias("volume"), (v + 0.9).alias("bid"), (v + 1.1).alias("ask"),
                    (5 + id_ % 11).cast("double").alias("bs"), (5 + id_ % 7).cast("double").alias("az"))
    return rows.withColumn("r", fin.log_returns(F.col("price"), axis()))


def closed(name: str, columns, sql: str, extra=None, sql_from: str = "ticks", ctes: str = "") -> None:
    """Registers a query of closed-form columns, rounded alike on both sides."""

    def run(spark, d):
        rows = ticks(spark, d)
        rows = extra(rows, axis()) if extra else rows
        return rows.select("event_id", *[(F.round(c + 2e-9, 8) + 0.0).alias(n) if n[-1] != "_" else c.alias(n) for n, c in columns(axis()).items()])

    sql = sql.replace(", 6) AS", " + 2e-9, 8) + 0.0 AS")  # ties of the rounding go the same way on both sides
    QUERIES[name] = (run, f"WITH {TICKS_SQL}{ctes} SELECT event_id, {sql} FROM {sql_from}")


def c(name):
    return F.col(name)


def last(n):
    return f"{AX_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


FAR = f"{AX_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

closed("fin_log_returns", lambda ax: {"log_return": c("r")}, "round(r, 6) AS log_return")
closed("fin_running_mean_var", lambda ax: {"mean": fin.running_mean(c("price"), ax), "variance": fin.running_variance(c("price"), ax)},
       f"round(avg(price) OVER ({FAR}), 6) AS mean, round(coalesce(var_samp(price) OVER ({FAR}), 0), 6) AS variance")
closed("fin_rolling_zscore", lambda ax: {"zscore": fin.rolling_zscore(c("price"), ax, 5)},
       f"round(CASE WHEN stddev_pop(price) OVER ({last(5)}) > 0 THEN (price - avg(price) OVER ({last(5)})) / stddev_pop(price) OVER ({last(5)}) ELSE 0 END, 6) AS zscore")
closed("fin_sma_bollinger", lambda ax: {"sma": fin.sma(c("price"), ax, 5), **fin.bollinger(c("price"), ax, 5)},
       f"round(avg(price) OVER ({last(5)}), 6) AS sma, round(avg(price) OVER ({last(5)}), 6) AS bb_mid, round(avg(price) OVER ({last(5)}) + 2 * stddev_pop(price) OVER ({last(5)}), 6) AS bb_upper, "
       f"round(avg(price) OVER ({last(5)}) - 2 * stddev_pop(price) OVER ({last(5)}), 6) AS bb_lower")
closed("fin_donchian_stochastic", lambda ax: {**fin.donchian(c("price"), ax, 5), "k": fin.stochastic(c("ask"), c("bid"), c("price"), ax, 5)},
       f"round(max(price) OVER ({last(5)}), 6) AS dc_upper, round(min(price) OVER ({last(5)}), 6) AS dc_lower, round((max(price) OVER ({last(5)}) + min(price) OVER ({last(5)})) / 2, 6) AS dc_mid, "
       f"round(100 * (price - min(bid) OVER ({last(5)})) / (max(ask) OVER ({last(5)}) - min(bid) OVER ({last(5)})), 6) AS k")
closed("fin_rolling_moments", lambda ax: {f"r_{k}": fin.rolling(c("price"), ax, k, 5) for k in ("min", "max", "std")},
       f"round(min(price) OVER ({last(5)}), 6) AS r_min, round(max(price) OVER ({last(5)}), 6) AS r_max, round(stddev_pop(price) OVER ({last(5)}), 6) AS r_std")
closed("fin_quotes", lambda ax: {"mid": fin.midprice(c("bid"), c("ask")), "micro": fin.microprice(c("bid"), c("ask"), c("bs"), c("az")), "spread": fin.quoted_spread(c("bid"), c("ask")),
                                 "effective": fin.effective_spread(c("price"), fin.midprice(c("bid"), c("ask"))), "imbalance": fin.l1_imbalance(c("bs"), c("az"))},
       "round((bid + ask) / 2, 6) AS mid, round((bid * az + ask * bs) / (bs + az), 6) AS micro, round(ask - bid, 6) AS spread, round(2 * abs(price - (bid + ask) / 2), 6) AS effective, "
       "round((bs - az) / (bs + az), 6) AS imbalance")
closed("fin_ofi", lambda ax: {"ofi": fin.order_flow_imbalance(c("bid"), c("ask"), c("bs"), c("az"), ax)},
       f"round(coalesce(CASE WHEN bid >= lag(bid) OVER w THEN bs - lag(bs) OVER w ELSE 0 END - CASE WHEN ask <= lag(ask) OVER w THEN az - lag(az) OVER w ELSE 0 END, 0), 6) AS ofi",
       sql_from=f"ticks WINDOW w AS ({AX_SQL})")
closed("fin_realized_variance", lambda ax: {"rv": fin.realized_variance(c("r"), ax, 5), "medrv": fin.median_realized_variance(c("r"), ax, 5)},
       f"round(sum(r * r) OVER ({last(5)}), 6) AS rv, round(quantile_cont(r * r, 0.5) OVER ({last(5)}) * count(r) OVER ({last(5)}), 6) AS medrv")
closed("fin_bipower", lambda ax: {"bv": fin.bipower_variation(c("terms"), ax, 5)}, f"round(pi() / 2 * sum(terms) OVER ({last(5)}), 6) AS bv",
       extra=lambda df, ax: df.withColumn("terms", fin.bipower_terms(c("r"), ax)), sql_from=f"(SELECT *, coalesce(abs(r) * abs(lag(r) OVER ({AX_SQL})), 0) AS terms FROM ticks)")
closed("fin_kyle_amihud", lambda ax: {"kyle": fin.kyle_lambda(c("r"), c("volume"), ax, 5), "amihud": fin.amihud_illiquidity(c("r"), c("volume"), ax, 5)},
       f"round(CASE WHEN count(r) OVER ({last(5)}) = 5 AND var_pop(volume) OVER ({last(5)}) * 5 > 1e-10 THEN covar_pop(r, volume) OVER ({last(5)}) / var_pop(volume) OVER ({last(5)}) ELSE 0 END, 6) AS kyle, "
       f"round(CASE WHEN count(r) OVER ({last(5)}) = 5 THEN avg(abs(r) / volume) OVER ({last(5)}) ELSE 0 END, 6) AS amihud")
closed("fin_roll_spread", lambda ax: {"roll": fin.roll_spread(c("r"), c("r1"), ax, 5)},
       f"""round(CASE WHEN rn > 5 AND cov < 0 THEN 2 * sqrt(-cov) ELSE 0 END, 6) AS roll""", extra=lambda df, ax: df.withColumn("r1", ax.lag(c("r"))),
       sql_from=f"""(SELECT *, (sum(r * r1) OVER ({last(4)}) - m * (sum(r) OVER ({last(4)}) + sum(r1) OVER ({last(4)})) + 4 * m * m) / 4 AS cov FROM (
 SELECT *, lag(r) OVER ({AX_SQL}) AS r1, avg(r) OVER ({last(5)}) AS m, row_number() OVER ({AX_SQL}) AS rn FROM ticks))""")
closed("fin_corwin_schultz", lambda ax: {"cs": fin.corwin_schultz(c("ask"), c("bid"), ax)}, "round(CASE WHEN rn > 2 AND s > 0 THEN s ELSE 0 END, 6) AS cs",
       sql_from=f"""(SELECT *, 2 * (exp(a) - 1) / (1 + exp(a)) AS s FROM (SELECT *, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))) AS a FROM (
 SELECT *, ln(ask / bid) ** 2 AS b, ln(greatest(ask, lag(ask) OVER ({AX_SQL})) / least(bid, lag(bid) OVER ({AX_SQL}))) ** 2 AS g, row_number() OVER ({AX_SQL}) AS rn FROM ticks)))""")
closed("fin_fx", lambda ax: {"arb_edge_bps": fin.triangular_arbitrage(c("price"), c("bs"), c("price") * c("bs") * 1.01, 2.0)["arb_edge_bps"], "points": fin.forward_points(c("price"), c("bs") / 100, c("az") / 100, 0.5),
                             "cip": fin.cip_basis(c("bid"), c("ask"), c("bs") / 100, c("az") / 100, 0.5), "carry": fin.carry_signal(c("bs"), c("az"), c("volume"), 0.1)},
       "round((price * bs / (price * bs * 1.01) - 1) * 1e4 - 2, 6) AS arb_edge_bps, round(price * exp((bs / 100 - az / 100) * 0.5) - price, 6) AS points, "
       "round(ln(ask / bid) / 0.5 - (bs / 100 - az / 100), 6) AS cip, round(bs - az - volume * 0.1, 6) AS carry")
closed("fin_crypto", lambda ax: {"apr": fin.funding_apr(c("bs") / 1e4), "cost": fin.funding_cost(c("volume"), c("price"), c("bs") / 1e4), "basis_apr": fin.basis_annualized(c("ask"), c("bid"), 30),
                                 "oi_delta": fin.open_interest_delta(c("volume"), ax), "fair": fin.perp_fair_price(c("price"), c("bs") / 1e4, c("az") / 1e4), "cc": fin.cash_and_carry_edge(c("ask"), c("bid"), c("bs") / 1e4, 5.0)},
       f"round(bs / 1e4 * 1095, 6) AS apr, round(volume * price * bs / 1e4, 6) AS cost, round((ask / bid - 1) * 365 / 30, 6) AS basis_apr, round(coalesce(volume - lag(volume) OVER ({AX_SQL}), 0), 6) AS oi_delta, "
       "round(price * (1 + bs / 1e4 + az / 1e4), 6) AS fair, round((ask / bid - 1) * 1e4 - (bs + 5), 6) AS cc")
closed("fin_vwap_shortfall", lambda ax: {"vwap": fin.vwap(c("price"), c("volume"), ax), "shortfall": fin.implementation_shortfall(c("ask"), c("price")), "impact": fin.arrival_price_impact(c("ask"), c("bid"))},
       f"round(sum(price * volume) OVER ({FAR}) / sum(volume) OVER ({FAR}), 6) AS vwap, round((ask - price) / price * 1e4, 6) AS shortfall, round((ask - bid) / bid * 1e4, 6) AS impact")
closed("fin_cusum", lambda ax: {"cusum": fin.cusum(c("path"), ax)}, f"round(path - least(0, min(path) OVER ({FAR})), 6) AS cusum",
       extra=lambda df, ax: df.withColumn("path", fin.cusum_path(c("price"), F.lit(10.0), 0.5, ax)), sql_from=f"(SELECT *, sum(price - 10.0 - 0.5) OVER ({FAR}) AS path FROM ticks)")
closed("fin_historical_var", lambda ax: {"var": fin.historical_var(c("r"), ax, 0.05, 20), "cvar": fin.historical_cvar(c("r"), ax, 0.05, 20)},
       "round(-q, 6) AS var, round(-list_avg(list_filter(vs, lambda v: v <= q)), 6) AS cvar",
       sql_from=f"(SELECT *, quantile_cont(r, 0.05) OVER ({last(20)}) AS q, list(r) OVER ({last(20)}) AS vs FROM ticks)")
closed("fin_guards", lambda ax: {"band_": fin.price_band(c("ask"), c("bid"), 0.05), "fat_": fin.fat_finger(c("volume"), 90), "break_": fin.circuit_break(c("ask"), c("bid"), 0.1),
                                 "throttle_": fin.throttled(F.unix_seconds(c("ts").cast("timestamp")), ["user_id"], 86400, 1), "signed": fin.signed_volume(F.when(c("bs") > 9, 1).otherwise(-1), c("volume")),
                                 "stale_": fin.stale_quote(F.coalesce(F.unix_seconds(c("ts").cast("timestamp")) - ax.lag(F.unix_seconds(c("ts").cast("timestamp"))), F.lit(0)), 86400)},
       f"abs(ask / bid - 1) > 0.05 AS band_, volume > 90 AS fat_, abs(ask / bid - 1) > 0.1 AS break_, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) > 1 AS throttle_, "
       f"round(CASE WHEN bs > 9 THEN volume ELSE -volume END, 6) AS signed, coalesce(epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER ({AX_SQL}), 0) > 86400 AS stale_")
closed("fin_outlier_mad", lambda ax: {"outlier_": fin.outlier_mad(c("price"), ax, 9, 3.0)}, "abs(price - med) > 3 * list_aggregate(list_transform(vs, lambda v: abs(v - med)), 'quantile_cont', 0.5) AS outlier_",
       sql_from=f"(SELECT *, quantile_cont(price, 0.5) OVER ({last(9)}) AS med, list(price) OVER ({last(9)}) AS vs FROM ticks)")


@query("fin_cornish_fisher", f"""WITH {TICKS_SQL}, m AS (SELECT user_id, avg(r) AS mean, stddev_pop(r) AS std, -1.6448536269514729 AS z FROM ticks GROUP BY user_id)
SELECT user_id, round(-(mean + (z + (z * z - 1) * 0.1 / 6 + (z ** 3 - 3 * z) * 0.2 / 24 - (2 * z ** 3 - 5 * z) * 0.01 / 36) * std), 6) AS cf_var FROM m""")
def fin_cornish_fisher(spark, d):
    m = ticks(spark, d).groupBy("user_id").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))
    return m.select("user_id", F.round(fin.cornish_fisher_var(F.col("mean"), F.col("std"), F.lit(0.1), F.lit(0.2)), 6).alias("cf_var"))


@query("fin_almgren_chriss", """SELECT i::INT AS slice, round(1000 * sinh(0.5 * (1 - i * 0.1)) / sinh(0.5), 6) AS remaining,
round(1000 * (sinh(0.5 * (1 - i * 0.1)) - sinh(0.5 * (1 - i * 0.1 - 0.1))) / sinh(0.5), 6) AS trade FROM range(10) t(i)""")
def fin_almgren_chriss(spark, d):
    return fin.almgren_chriss(spark, 1000, 0.5, 1.0).select("slice", F.round("remaining", 6).alias("remaining"), F.round("trade", 6).alias("trade"))


@query("fin_hayashi_yoshida", f"""WITH {TICKS_SQL}, i AS (SELECT user_id % 50 AS g, event_id % 2 AS side, epoch_us(ts) / 1e6 AS e, lag(epoch_us(ts) / 1e6) OVER ({AX_SQL}) AS s, r FROM ticks)
SELECT a.g, round(sum(a.r * b.r), 6) AS hy_cov FROM i a JOIN i b ON a.g = b.g AND a.side = 0 AND b.side = 1 AND a.s < b.e AND b.s < a.e GROUP BY a.g""")
def fin_hayashi_yoshida(spark, d):
    ax, t = axis(), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = ticks(spark, d).select((F.col("user_id") % 50).alias("g"), (F.col("event_id") % 2).alias("side"), t.alias("end"), ax.lag(t).alias("start"), "r").where("start IS NOT NULL")
    return fin.hayashi_yoshida(rows.where("side = 0"), rows.where("side = 1"), ["g"], 86400.0).select("g", F.round("hy_cov", 6).alias("hy_cov"))


def recursive(name: str, inputs, outputs, step, sql=None, pick=None):
    """Registers a recursive filter; with SQL, its last value for each symbol."""

    def run(spark, d):
        rows = ticks(spark, d).withColumn("side", F.when(F.col("bs") > 9, 1.0).otherwise(-1.0))
        out = fin.recurrent(rows.select("event_id", "user_id", "ts", *inputs), ["user_id"], ["ts", "event_id"], inputs, outputs, step)
        if sql:
            best = out.groupBy("user_id").agg(*[F.max_by(o, F.struct("ts", "event_id")).alias(o) for o in outputs])
            return best.select("user_id", *[F.round(o, 6).alias(o) for o in outputs])
        return out.select("event_id", *[F.round(o, 6).alias(o) for o in outputs])

    QUERIES[name] = (run, sql and f"WITH {TICKS_SQL}, s AS (SELECT user_id, list(price ORDER BY ts, event_id) AS xs, list(r ORDER BY ts, event_id) AS rs FROM ticks GROUP BY user_id) SELECT user_id, {sql} FROM s")


recursive("fin_ewma", ["price"], ["ewma"], fin.ewma_step(0.94), "round(list_reduce(xs, lambda v, x: 0.94 * x + 0.06 * v), 6) AS ewma")
recursive("fin_ema", ["price"], ["ema"], fin.ewma_step(0.2), "round(list_reduce(xs, lambda v, x: 0.2 * x + 0.8 * v), 6) AS ema")
recursive("fin_riskmetrics", ["r"], ["vol"], fin.riskmetrics_step(), "round(sqrt(list_reduce(list_transform(rs, lambda x: x * x), lambda v, x: 0.94 * v + 0.06 * x)), 6) AS vol")


def stepped(name: str, inputs, outputs, step, start: str, follow: str, shown: str) -> None:
    """Registers a recursive filter of which every row counts; its SQL goes row by row: ``start`` gives the first row's state, ``follow`` the
    next one's from the state ``s`` and the row ``n``, and ``shown`` the outputs."""

    def run(spark, d):
        rows = ticks(spark, d).withColumn("side", F.when(F.col("bs") > 9, 1.0).otherwise(-1.0))
        out = fin.recurrent(rows.select("event_id", "user_id", "ts", *inputs), ["user_id"], ["ts", "event_id"], inputs, outputs, step)
        return out.select("event_id", *[(F.round(F.col(o) + 2e-9, 8) + 0.0).alias(o) for o in outputs])

    QUERIES[name] = (run, f"""WITH RECURSIVE {TICKS_SQL}, n AS MATERIALIZED (SELECT *, CASE WHEN bs > 9 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side,
row_number() OVER ({AX_SQL}) AS i FROM ticks), s AS (SELECT event_id, user_id, i, {start} FROM n WHERE i = 1
UNION ALL SELECT n.event_id, n.user_id, n.i, {follow} FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT event_id, {", ".join(f"round(({e}) + 2e-9, 8) + 0.0 AS {o}" for o, e in zip(outputs, shown.split("; ")))} FROM s""")


def _mean_sql(old: str, new: str, rate: str) -> str:
    return f"{old} + {rate} * ({new} - {old})"


stepped("fin_ewcov", ["price", "volume"], ["ewcov"], fin.ewcov_step(0.1), "price AS mx, volume AS my, 0.0::DOUBLE AS cov",
        f"{_mean_sql('s.mx', 'n.price', '0.1::DOUBLE')}, {_mean_sql('s.my', 'n.volume', '0.1::DOUBLE')}, "
        f"0.9::DOUBLE * (s.cov + 0.1::DOUBLE * (n.price - s.mx) * (n.volume - ({_mean_sql('s.my', 'n.volume', '0.1::DOUBLE')})))", "cov")
_F, _S, _G = "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 27)", "0.2::DOUBLE"
_M = f"(({_mean_sql('s.f', 'n.price', _F)}) - ({_mean_sql('s.w', 'n.price', _S)}))"
stepped("fin_macd", ["price"], ["macd", "signal", "hist"], fin.macd_step(), "price AS f, price AS w, 0.0::DOUBLE AS g",
        f"{_mean_sql('s.f', 'n.price', _F)}, {_mean_sql('s.w', 'n.price', _S)}, {_mean_sql('s.g', _M, _G)}", "f - w; g; f - w - g")
stepped("fin_rsi", ["price"], ["rsi"], fin.rsi_step(), "price AS p, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down",
        "n.price, s.up + (greatest(n.price - s.p, 0) - s.up) / 14, s.down + (greatest(s.p - n.price, 0) - s.down) / 14", "CASE WHEN up + down > 0 THEN 100 * up / (up + down) ELSE 50 END")
stepped("fin_kalman", ["price"], ["kalman"], fin.kalman_step(0.01, 1.0), "price AS v, 1.0::DOUBLE AS p",
        "s.v + (s.p + 0.01::DOUBLE) / (s.p + 1.01::DOUBLE) * (n.price - s.v), (1 - (s.p + 0.01::DOUBLE) / (s.p + 1.01::DOUBLE)) * (s.p + 0.01::DOUBLE)", "v")
_FULL = "CASE WHEN s.buy + s.sell >= 200 THEN 0.0::DOUBLE ELSE {} END + CASE WHEN n.side {} 0 THEN n.volume ELSE 0 END"
stepped("fin_vpin", ["volume", "side"], ["vpin"], fin.vpin_step(200.0), "CASE WHEN side > 0 THEN volume ELSE 0.0::DOUBLE END AS buy, CASE WHEN side < 0 THEN volume ELSE 0.0::DOUBLE END AS sell",
        f"{_FULL.format('s.buy', '>')}, {_FULL.format('s.sell', '<')}", "abs(buy - sell) / (buy + sell)")
_P = "(s.p + 0.001::DOUBLE)"
_K = f"({_P} * n.volume / (n.volume * n.volume * {_P} + 0.1::DOUBLE))"
_K1 = "(1.001::DOUBLE * volume / (volume * volume * 1.001::DOUBLE + 0.1::DOUBLE))"
stepped("fin_hedge_ratio", ["price", "volume"], ["beta", "spread"], fin.hedge_ratio_step(),
        f"1 + {_K1} * (price - volume) AS beta, (1 - {_K1} * volume) * 1.001::DOUBLE AS p, price, volume",
        f"s.beta + {_K} * (n.price - s.beta * n.volume), (1 - {_K} * n.volume) * {_P}, n.price, n.volume", "beta; price - beta * volume")

_LAGS = list(range(-3, 4))
_SHIFTS = ", ".join(f"lag(volume, {k}) OVER ({AX_SQL}) AS b{k + 3}" for k in _LAGS)


def _corr_sql(b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN price END", b
    spread = f"(stddev_pop({x}) OVER ({last(10)}) * stddev_pop({y}) OVER ({last(10)}))"
    return f"covar_pop({x}, {y}) OVER ({last(10)}) / nullif({spread}, 0)"


@query("fin_lead_lag", f"""WITH {TICKS_SQL}, shifted AS (SELECT *, {_SHIFTS} FROM ticks),
corrs AS (SELECT event_id, {", ".join(f"{_corr_sql(f'b{k + 3}')} AS c{k + 3}" for k in _LAGS)} FROM shifted),
best AS (SELECT event_id, list_max(list_filter([{", ".join(f"{{'m': round(abs(c{k + 3}), 9), 'near': {-abs(k)}, 'k': {k}, 'c': c{k + 3}}}" for k in _LAGS)}], lambda s: s.m IS NOT NULL)) AS s FROM corrs)
SELECT event_id, s.k::INT AS lag, round(s.c + 2e-9, 8) + 0.0 AS lag_corr FROM best""")
def fin_lead_lag(spark, d):
    out = fin.lead_lag(ticks(spark, d), "price", "volume", axis(), reach=3, n=10)
    return out.select("event_id", "lag", (F.round(F.col("lag_corr") + 2e-9, 8) + 0.0).alias("lag_corr"))


closed("fin_pairs_spread", lambda ax: {"spread": fin.pairs_spread(c("ask"), c("bid"), 1.5)}, "round(ask - bid * 1.5, 6) AS spread")


@query("fin_rolling_skew_kurt", f"""WITH {TICKS_SQL}, w AS (SELECT event_id, list(price) OVER ({last(8)}) AS xs FROM ticks),
m AS (SELECT event_id, xs, list_avg(xs) AS mean FROM w),
q AS (SELECT event_id, list_avg(list_transform(xs, lambda x: (x - mean) ** 2)) AS m2, list_avg(list_transform(xs, lambda x: (x - mean) ** 3)) AS m3, list_avg(list_transform(xs, lambda x: (x - mean) ** 4)) AS m4 FROM m)
SELECT event_id, round(m3 / nullif(m2, 0) ** 1.5 + 2e-7, 5) + 0.0 AS skew, round(m4 / nullif(m2, 0) ** 2 - 3 + 2e-7, 5) + 0.0 AS kurt FROM q""")
def fin_rolling_skew_kurt(spark, d):
    x, ax = F.col("price"), axis()
    return ticks(spark, d).select("event_id", (F.round(fin.rolling(x, ax, "skew", 8) + 2e-7, 5) + 0.0).alias("skew"),
                                  (F.round(fin.rolling(x, ax, "kurt", 8) + 2e-7, 5) + 0.0).alias("kurt"))


_PREVIOUS = f"(SELECT *, lag(price) OVER ({AX_SQL}) AS before FROM ticks)"
_HAVING = "CASE WHEN before IS NOT NULL THEN price END"
QUERIES["fin_autocorrelation"] = (
    lambda spark, d: _autocorrelation(ticks(spark, d)),
    f"WITH {TICKS_SQL} SELECT event_id, round(covar_pop({_HAVING}, before) OVER ({last(10)}) / nullif(stddev_pop({_HAVING}) OVER ({last(10)}) * stddev_pop(before) OVER ({last(10)}), 0) + 2e-7, 5) + 0.0 AS autocorr FROM {_PREVIOUS}")


def _autocorrelation(rows):
    rows = rows.withColumn("before", axis().lag(F.col("price")))
    return rows.select("event_id", (F.round(fin.autocorrelation(F.col("price"), F.col("before"), axis(), 10) + 2e-7, 5) + 0.0).alias("autocorr"))
