"""The feature catalogue: formulas as text, one line for each group of features.

``name_{a,b} = formula`` defines name_a and name_b; ``$`` is the value in braces, ``$1`` and ``$2`` its parts around
an underscore.  ``let x = formula`` names a helper for the lines below.  Formulas are written in the algebra of
plans/algebra.py over open, high, low, close, volume and adv.  The figures are fixed values of the feature set.
"""

from __future__ import annotations

import math
import re

from loomspan.plans import algebra as A
from loomspan.plans.algebra import Expr

MOMENTUM = """
ret_{1,3,5,10,21,63,126,252} = change($)
mom_12_1 = lag(close, 21) / lag(close, 252) - 1
mom_6_1 = lag(close, 21) / lag(close, 126) - 1
mom_6_3 = lag(close, 63) / lag(close, 126) - 1
sharpe_{21,63,126,252} = sdiv(mean(ret, $), std(ret, $))
trend_skip21_{63,126,252} = change($) - change(21)
accel_{5_21,21_63,63_252} = change($1) - change($2) * $1 / $2
momentum_pullback = change(126) * (1 - mag(change(21)))
drawdown_adjusted_momentum = change(126) * (close / high_of(high, 126))
multi_horizon_positive_share = where(present(change(126)), (flag(change(21) > 0) + flag(change(63) > 0) + flag(change(126) > 0)) / 3)
post_crash_bounce = flag(change(63) <= -0.15, change(63)) * change(5)
slope_log_price_{10,21,63} = slope(log(close), $)
slope_accel_21 = slope(slope(log(close), 21), 21)
up_day_share_{21,63,150} = mean(flag(ret > 0, ret), $)
upside_capture_63 = sdiv(total(pos(ret), 63), total(mag(ret), 63))
up_streak = where(present(ret), run(ret > 0))
down_streak = where(present(ret), run(ret < 0))
"""

VOLATILITY = """
let hl = log(high / low)
let co = log(close / open)
let oc = log(open / lag(close, 1))
let rs = log(high / close) * log(high / open) + log(low / close) * log(low / open)
vol_{10,21,63,126} = std(ret, $)
downside_vol_{21,63} = std(neg(ret), $)
up_down_vol_ratio_63 = sdiv(sqrt(mean(pos(ret) ** 2, 63)), sqrt(mean(neg(ret) ** 2, 63)))
vol_ratio_{21_63,63_252} = sdiv(std(ret, $1), std(ret, $2))
vol_change_21 = std(ret, 21) - lag(std(ret, 21), 21)
vol_of_vol_63 = std(std(ret, 5), 63)
parkinson_{10,21,50} = sqrt(mean(hl ** 2, $) / (4 * LN2))
garman_klass_21 = sqrt(pos(mean(hl ** 2 / 2 - co ** 2 * (2 * LN2 - 1), 21)))
rogers_satchell_21 = sqrt(pos(mean(rs, 21)))
yang_zhang_{21,63} = sqrt(pos(std(oc, $) ** 2 + yz($) * std(co, $) ** 2 + (1 - yz($)) * mean(rs, $)))
atr_{14,63} = sdiv(mean(tr, $), close)
atr_ratio_14_63 = sdiv(sdiv(mean(tr, 14), close), sdiv(mean(tr, 63), close))
vol_pct_self_{21,63} = rank_past(std(ret, $), 252, 200)
skew_{63,126} = skew(ret, $)
kurt_{63,126} = kurt(ret, $)
worst_day_21 = low_of(ret, 21)
expected_shortfall_63 = mean(where(ret <= quantile(ret, 63, 0.05), ret), 63, 3)
tail_balance_252 = sdiv(mag(quantile(ret, 252, 0.95)), mag(quantile(ret, 252, 0.05)))
"""

DRAWDOWN = """
let below = close / high_of(close, 63) - 1
drawdown_{22,63,252} = close / high_of(close, $) - 1
distance_from_low_63 = close / low_of(low, 63) - 1
ulcer_{14,50} = sqrt(mean(((close / high_of(close, $) - 1) * 100) ** 2, $))
max_drawdown_{63,252} = low_of(close / high_of(close, $) - 1, $)
days_since_high_{63,252} = since_high(close, $)
days_since_low_63 = since_low(close, 63)
underwater_share_63 = mean(flag(below < -0.02, below), 63)
underwater_area_63 = mean(below, 63)
range_position_{20,63,252} = sdiv(close - low_of(low, $), high_of(high, $) - low_of(low, $))
"""

TREND = """
let tp = (high + low + close) / 3
let rise = high - lag(high, 1)
let fall = lag(low, 1) - low
let moved = present(rise) & present(fall)
let di_up = sdiv(mean(where(moved, where((rise > fall) & (rise > 0), rise, 0)), 14), mean(tr, 14))
let di_down = sdiv(mean(where(moved, where((fall > rise) & (fall > 0), fall, 0)), 14), mean(tr, 14))
let ma200 = mean(close, 200)
ma_gap_{10,20,50,100,200} = close / mean(close, $) - 1
sma_slope_{20,50} = sdiv(mean(close, $) - lag(mean(close, $), $), close * $)
rsi_{2,5,14,21} = 100 * sdiv(mean(pos(ret), $), mean(pos(ret), $) + mean(pos(-ret), $))
stochastic_14 = sdiv(close - low_of(low, 14), high_of(high, 14) - low_of(low, 14))
cci_20 = sdiv(tp - mean(tp, 20), 0.015 * mean(mag(tp - mean(tp, 20)), 20, 16))
adx_14 = mean(sdiv(mag(di_up - di_down), di_up + di_down), 14)
aroon_osc_25 = since_low(low, 25) - since_high(high, 25)
bollinger_pctb_20 = sdiv(close - (mean(close, 20) - 2 * std(close, 20)), 4 * std(close, 20))
bollinger_width_20 = sdiv(4 * std(close, 20), mean(close, 20))
efficiency_{21,63} = sdiv(mag(close - lag(close, $)), total(mag(close - lag(close, 1)), $))
time_above_ma200_126 = mean(flag(close >= ma200, ma200), 126)
run_above_ma200 = where(present(ma200), run((close >= ma200) & present(ma200))) / 252
"""

#: Reads exponential averages that ema_columns() adds: one ordered fold for each ticker.
TREND_EMA = """
ema_ratio_{5_20,10_50,20_100,50_200} = ema_$1 / ema_$2 - 1
ppo_12_26 = ema_12 / ema_26 - 1
macd_hist = sdiv(ema_12 - ema_26 - ema_signal, close)
"""

CANDLES = """
candle_body_{1,5,21} = sdiv(mag(close - bar_open($)), bar_high($) - bar_low($))
candle_upper_wick_{1,5,21} = sdiv(bar_high($) - hi2(bar_open($), close), bar_high($) - bar_low($))
candle_lower_wick_{1,5,21} = sdiv(lo2(bar_open($), close) - bar_low($), bar_high($) - bar_low($))
candle_close_location_{1,5,21} = sdiv(close - bar_low($), bar_high($) - bar_low($))
candle_return_{1,5,21} = close / bar_open($) - 1
candle_body_1_mean_{5,21} = mean(sdiv(mag(close - open), high - low), $)
candle_upper_wick_1_mean_{5,21} = mean(sdiv(high - hi2(open, close), high - low), $)
candle_lower_wick_1_mean_{5,21} = mean(sdiv(lo2(open, close) - low, high - low), $)
candle_close_location_1_mean_{5,21} = mean(sdiv(close - low, high - low), $)
range_1 = sdiv(high - low, close)
range_mean_21 = mean(sdiv(high - low, close), 21)
range_ratio_5_vs_prior_5 = sdiv(total(high - low, 5), lag(total(high - low, 5), 5))
clv_imbalance_21 = sdiv(total(sdiv((close - low) - (high - close), high - low) * volume, 21), total(volume, 21))
"""

GAPS = """
let gap = open / lag(close, 1) - 1
let day = close / open - 1
let down = gap < -0.005
let up = gap > 0.005
gap_1 = gap
gap_mean_21 = mean(gap, 21)
gap_abs_sum_21 = total(mag(gap), 21)
gap_balance_63 = total(flag(up, gap) - flag(down, gap), 63)
gap_recovery_average_63 = mean(pos(sdiv(close - open, mag(lag(close, 1) - open))) * flag(down, gap), 63)
gap_down_recovery_rate_126 = sdiv(total(flag(down & (close > open), gap), 126), total(flag(down, gap), 126))
gap_follow_through_63 = sdiv(total(flag(up & (close > open), gap), 63), total(flag(up, gap), 63))
overnight_sum_{21,63} = total(gap, $)
intraday_sum_{21,63} = total(day, $)
overnight_share_63 = sdiv(total(gap, 63), mag(total(gap, 63)) + mag(total(day, 63)))
overnight_minus_intraday_63 = total(gap, 63) - total(day, 63)
gap_fill_rate_66 = sdiv(total(flag(((gap > 0.0005) & (low <= lag(close, 1))) | ((gap < -0.0005) & (high >= lag(close, 1))), gap), 66), total(flag(mag(gap) > 0.0005, gap), 66))
"""

COMPRESSION = """
let span = high - low
let floor_21 = low_of(low, 21)
range_expansion_21 = sdiv(span, mean(span, 21))
hl_compression_21_126 = sdiv(total(span, 21), total(span, 126)) * 6
bollinger_squeeze_63 = sdiv(std(close, 63), mean(close, 63))
donchian_position_{20,55} = sdiv(close - low_of(low, $), high_of(high, $) - low_of(low, $))
donchian_width_20 = sdiv(high_of(high, 20) - low_of(low, 20), close)
vcp_touch_count_21 = total(flag(close <= floor_21 + 0.2 * (high_of(high, 21) - floor_21), close), 21)
nr7_count_21 = total(flag(span <= low_of(span, 7), span), 21)
inside_bar_count_21 = total(flag((high < lag(high, 1)) & (low > lag(low, 1)), high), 21)
breakout_up_{20,50} = close / lag(high_of(high, $), 1) - 1
breakdown_{20,50} = lag(low_of(low, $), 1) / close - 1
"""

VOLUME = """
let dv = close * volume
let tp = (high + low + close) / 3
let flow_up = where(tp > lag(tp, 1), tp * volume, 0)
let flow_down = where(tp < lag(tp, 1), tp * volume, 0)
let signed = sign(ret) * volume
let lv = log(volume)
let x1 = sdiv(lv - mean(lag(lv, 1), 60), std(lag(lv, 1), 60))
let x2 = x1 - lag(x1, 5)
dollar_volume_z_{21,63} = zscore(log(dv), $)
volume_ratio_{5_63,21_252} = sdiv(mean(volume, $1), mean(volume, $2))
volume_migration_21 = sdiv(total(volume, 21), lag(total(volume, 21), 21))
volume_block_product = sdiv(total(volume, 6), lag(total(volume, 6), 30)) * sdiv(lag(total(volume, 6), 5), lag(total(volume, 6), 20))
up_down_volume_ratio_{21,63} = sdiv(total(where(ret > 0, volume, 0), $), total(where(ret < 0, volume, 0), $) + 1)
climactic_volume_21 = sdiv(volume, mean(volume, 21))
price_volume_trend_21 = sdiv(total(volume * ret, 21), total(volume, 21))
obv_slope_{21,63} = sdiv(slope(obv, $), mean(volume, $))
chaikin_money_flow_20 = sdiv(total(sdiv((close - low) - (high - close), high - low) * volume, 20), total(volume, 20))
money_flow_index_14 = 100 * sdiv(total(flow_up, 14), total(flow_up, 14) + total(flow_down, 14))
amihud_63 = log(mean(sdiv(mag(ret), dv), 63) * 1e9)
range_per_dollar_21 = log(sdiv(total(high - low, 21), total(dv, 21)) * 1e9)
liquidity_relief = sdiv(mean(dv, 21), mean(dv, 126)) * flag(std(ret, 21) < std(ret, 126))
kyle_proxy_63 = sdiv(cov(ret, signed, 63), cov(signed, signed, 63)) * 1e6
volume_attention_x1 = x1
volume_attention_x2 = x2
volume_attention_x4 = mean(2 * rank(x2) - 1, 10, 8)
log_adv = log(adv)
"""

RELATIVE = """
let mkt = of_ticker(ret, SPY)
let ew = cross_mean(ret)
let c5 = change(5)
beta_spy_{63,252} = beta(ret, mkt, $)
down_beta_spy_63 = beta(where(mkt < 0, ret), where(mkt < 0, mkt), 63, 20)
beta_decoupling_63_252 = beta(ret, mkt, 63) - beta(ret, mkt, 252)
corr_spy_{21,63} = corr(ret, mkt, $)
up_capture_63 = sdiv(mean(where(ew > 0, ret), 63, 20), mean(where(ew > 0, ew), 63, 20))
down_capture_63 = sdiv(mean(where(ew < 0, ret), 63, 20), mean(where(ew < 0, ew), 63, 20))
relative_return_spy_{5,21,63} = change($) - of_ticker(change($), SPY)
residual_momentum_63 = mean(ret, 63) - beta(ret, mkt, 63) * mean(mkt, 63)
block_relative_return_{5,21,63} = change($) - group_mean(change($))
block_z_return_5 = sdiv(c5 - group_mean(c5), sqrt(pos(group_mean(c5 ** 2) - group_mean(c5) ** 2)))
corr_tlt_63 = corr(ret, of_ticker(ret, TLT), 63)
corr_hyg_63 = corr(ret, of_ticker(ret, HYG), 63)
corr_gld_63 = corr(ret, of_ticker(ret, GLD), 63)
corr_uup_63 = corr(ret, of_ticker(ret, UUP), 63)
corr_vxx_63 = corr(ret, of_ticker(ret, VXX), 63)
beta_tlt_63 = beta(ret, of_ticker(ret, TLT), 63)
beta_uup_63 = beta(ret, of_ticker(ret, UUP), 63)
lead_corr_spy_lag1_63 = corr(ret, lag(mkt, 1), 63)
"""

SCREENERS = """
let rv_21 = std(ret, 21) * YEAR
let rv_63 = std(ret, 63) * YEAR
let rv_pct = rank_past(rv_21, 252, 200)
let expansion = sdiv(rv_63, lag(rv_63, 252))
let hl2 = log(high / low) ** 2
let two = hl2 + lag(hl2, 1)
let wide = log(largest(high, lag(high, 1)) / smallest(low, lag(low, 1))) ** 2
let alpha = clip((sqrt(2 * two) - sqrt(two)) / CS_K - sqrt(wide / CS_K), -5, 5)
let spread = mean(clip(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0, 0.5), 63, 32)
let spread_z = zscore(spread, 252)
let step = log(close) - lag(log(close), 1)
let dp = where(mag(step) <= 0.5, step)
let serial = cov(dp, lag(dp, 1), 63)
let roll = where(present(serial), 2 * sqrt(pos(-serial)))
let ma = mean(close, 200, 150)
let share = mean(flag(close >= ma, ma), 126, 63)
let tail_pct = rank_past(sdiv(mag(quantile(ret, 252, 0.95)), mag(quantile(ret, 252, 0.05))), 252, 200)
let atr_n = sdiv(mean(tr, 14, 10), close)
let atr_pct = rank_past(atr_n, 252, 200)
let dropped = (open / lag(close, 1) - 1 < -std(ret, 63)) & present(ret)
let drops = total(flag(dropped, ret), 63)
let recovered = sdiv(total(flag(dropped & (close > open), ret), 126), total(flag(dropped, ret), 126))
let upside = rank_past(std(where(ret > 0, ret), 21, 8), 252, 200)
let x3 = flag((rv_pct >= 0.99) & (expansion > 2), rv_pct)
let o2 = flag((rank(spread) >= 0.9) & (spread_z >= 3), spread_z)
let o3 = flag(rank(roll) >= 0.99, serial)
let p2 = flag((rank(share) >= 0.95) & (run((close >= ma) & present(ma)) >= 200), share)
let x5 = flag(tail_pct <= 0.01, tail_pct)
let r1 = flag((low_of(atr_pct, 63, 40) <= 0.1) & (atr_n / lag(atr_n, 5) > 1.5) & (atr_n / lag(atr_n, 21) > 1.5), atr_pct)
let g5 = flag((drops >= 6) & (recovered >= 0.6), ret)
let a4 = flag(upside >= 0.98, upside)
let m2 = flag((rank(slope(obv, 63)) >= 0.8) & (rank(slope(log(close), 63)) < 0.5), slope(log(close), 63))
x3_vol_expansion_ratio = expansion
x3_flag = x3
o2_cs_spread_63 = spread
o2_flag = o2
o3_roll_spread_63 = roll
o3_flag = o3
p2_flag = p2
x5_tail_ratio_pct = tail_pct
x5_flag = x5
r1_flag = r1
g5_gap_down_count_63 = drops
g5_recovery_rate_126 = recovered
g5_flag = g5
a4_upside_vol_pct = upside
a4_flag = a4
m2_flag = m2
lens_vote_count = where(present(ret), none(x3) + none(o2) + none(o3) + none(p2) + none(x5) + none(r1) + none(g5) + none(a4) + none(m2))
"""

#: One value for each session.  m_*: market series, c_*: volatility and correlation indices, t_*: yields; all joined as of the session.
MACRO = """
let spy = of_ticker(close, SPY)
let dollar = of_ticker(change(63), UUP)
let ratio = log(m_copper / m_gold)
let metal = ratio - lag(ratio, 63)
let curve = t_10_year - t_3_month
let credit_21 = of_ticker(change(21), HYG) - of_ticker(change(21), LQD)
let spy_ma = mean(spy, 200, 150)
let leg1 = tz(of_ticker(change(21), SPY) - of_ticker(change(21), TLT))
let leg2 = tz(credit_21)
let leg3 = tz(metal)
let leg4 = -tz(dollar)
let leg5 = -tz(m_vix)
let legs = flag(present(leg1)) + flag(present(leg2)) + flag(present(leg3)) + flag(present(leg4)) + flag(present(leg5))
rate_10y_level = t_10_year
curve_10y_3m = curve
curve_10y_2y = t_10_year - t_2_year
rate_10y_change_21 = t_10_year - lag(t_10_year, 21)
curve_10y_3m_change_63 = curve - lag(curve, 63)
rate_3m_level = t_3_month
vix_level = m_vix
vix_z_252 = tz(m_vix)
vix_change_5 = m_vix - lag(m_vix, 5)
vxn_over_vix = m_vxn / m_vix
vix_over_vix3m = c_vix / c_vix3m
vix9d_over_vix = c_vix9d / c_vix
vvix_z_252 = tz(c_vvix)
skew_z_252 = tz(c_skew)
cor1m_level = c_cor1m
cor3m_level = c_cor3m
cor1m_minus_cor3m = c_cor1m - c_cor3m
cor3m_change_5 = c_cor3m - lag(c_cor3m, 5)
credit_hyg_minus_lqd_{5,21} = of_ticker(change($), HYG) - of_ticker(change($), LQD)
rates_ief_minus_shy_{5,21} = of_ticker(change($), IEF) - of_ticker(change($), SHY)
dollar_uup_63 = dollar
copper_over_gold_63 = metal
oil_wti_21 = m_oil / lag(m_oil, 21) - 1
spy_above_ma200 = where(present(spy) & present(spy_ma), flag(spy >= spy_ma))
spy_return_21 = spy / lag(spy, 21) - 1
spy_vol_21 = std(spy / lag(spy, 1) - 1, 21, 17)
regime_composite = where(legs >= 3, (none(leg1) + none(leg2) + none(leg3) + none(leg4) + none(leg5)) / legs)
"""

FAMILIES = {
    "momentum": MOMENTUM, "volatility": VOLATILITY, "drawdown": DRAWDOWN, "trend": TREND, "trend_ema": TREND_EMA, "candles": CANDLES, "gaps": GAPS,
    "compression": COMPRESSION, "volume": VOLUME, "relative": RELATIVE, "screeners": SCREENERS, "macro": MACRO,
}


def _names() -> dict:
    """What formulas can use: the algebra, the panel's columns and a few derived values."""
    names = {n: getattr(A, n) for n in "where present flag sdiv log sqrt exp mag sign floor ceil hi2 lo2 pos neg clip largest smallest lag lead mean total std low_of high_of skew kurt quantile zscore cov beta corr slope rank_past since_high since_low run rank cross_mean group_mean".split()}
    cols = "open high low close volume adv m_vix m_vxn m_copper m_gold m_oil t_10_year t_3_month t_2_year c_vix c_vix3m c_vix9d c_vvix c_skew c_cor1m c_cor3m ema_signal".split()
    names |= {c: A.col(c) for c in [*cols, *[f"ema_{s}" for s in EMA_SPANS]]}
    close, high, low = A.col("close"), A.col("high"), A.col("low")
    ret = close / A.lag(close, 1) - 1
    names |= {
        "ret": ret,
        "tr": A.largest(high - low, A.mag(high - A.lag(close, 1)), A.mag(low - A.lag(close, 1))),
        "obv": A.where(A.present(ret), A.running(A.sign(ret) * A.col("volume"))),
        "change": lambda k: close / A.lag(close, k) - 1,
        "bar_open": lambda n: A.lag(A.col("open"), n - 1),
        "bar_high": lambda n: A.high_of(high, n) if n > 1 else high,
        "bar_low": lambda n: A.low_of(low, n) if n > 1 else low,
        "yz": lambda w: 0.34 / (1.34 + (w + 1) / (w - 1)),
        "none": lambda x: A.first_of(x, 0.0),
        "tz": lambda x: A.sdiv(x - A.mean(x, 252, 201), A.std(x, 252, 201)),
        "LN2": math.log(2),
        "YEAR": math.sqrt(252),
        "CS_K": 3 - 2 * math.sqrt(2),
    }
    return names


EMA_SPANS = (5, 10, 12, 20, 26, 50, 100, 200)


def family(text: str, roles: dict[str, str]) -> dict[str, Expr]:
    """The features of one catalogue text, in its order."""
    scope = _names() | {"of_ticker": A.of_ticker} | roles
    out: dict[str, Expr] = {}
    for line in text.strip().splitlines():
        left, _, formula = line.partition(" = ")
        if left.startswith("let "):
            scope[left[4:]] = eval(formula, {"__builtins__": {}}, scope)  # noqa: S307 (our own text)
            continue
        choice = re.search(r"\{(.*)\}", left)
        for value in choice.group(1).split(",") if choice else [""]:
            parts = value.split("_")
            body = re.sub(r"\$([12])", lambda m, p=parts: p[int(m.group(1)) - 1], formula).replace("$", value)
            name = left[: choice.start()] + value + left[choice.end() :] if choice else left
            out[name] = eval(body, {"__builtins__": {}}, scope)  # noqa: S307
    return out
