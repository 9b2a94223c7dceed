"""SQL of the engine's results, in parts that build on each other: bars, features, percentiles, components, scores."""

from __future__ import annotations

from sextant import config as C

ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _bars(name: str, entity: str, join: str = "") -> str:
    return f"""{name} AS (
  SELECT {entity} AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, first(l_extendedprice / l_quantity ORDER BY {ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {ORDER}) AS close, sum(l_quantity) AS volume
  FROM lineitem {join} WHERE l_quantity > 0 GROUP BY 1, 2)"""


WATCH = """watch AS (SELECT s_suppkey AS entity, r_name AS sector, CAST(-1 - r_regionkey AS BIGINT) AS benchmark
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
BARS = _bars("bars", "l_suppkey")
REGION = _bars("region_bars", "CAST(-1 - r_regionkey AS BIGINT)", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
MARKET = _bars("market", "CAST(0 AS BIGINT)")


def rows(n: int, end: int = 0) -> str:
    """Window of the last n rows of an entity, up to `end` rows from the current one."""
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def guard(value: str, least: int) -> str:
    return f"CASE WHEN n >= {least} THEN {value} END"


def _drawdown(n: int) -> str:
    return guard(f"list_max(list_transform(range(1, len(xs{n}) + 1), lambda i: (list_max(xs{n}[1:i]) - xs{n}[i]) / list_max(xs{n}[1:i]) * 100))", n)


def features(bars: str, out: str) -> str:
    """CTEs `{out}` with all trailing features of the bars in `bars`."""
    lag = lambda w: f"lag(close, {w}) OVER (PARTITION BY entity ORDER BY d)"
    sma = ", ".join(f"{guard(f'avg(close) {rows(w)}', w)} AS SMA{w}" for w in C.SMA_WINDOWS)
    ret = ", ".join(f"close / {lag(w)} - 1 AS return_{w}d" for w in C.RETURN_WINDOWS)
    return f"""{out}_0 AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS n, {lag(1)} AS before, close / {lag(1)} - 1 AS ret FROM {bars}
), {out}_1 AS (
  SELECT *, {sma}, {ret}, greatest(high - low, abs(high - before), abs(low - before)) AS tr,
    {guard(f"avg(volume) {rows(20)}", 20)} AS avg20, {guard(f"avg(volume) {rows(60)}", 60)} AS avg60, {guard(f"avg(close * volume) {rows(20)}", 20)} AS dollar_volume_20d,
    list({{'r': ret, 'v': volume}}) {rows(20)} AS days, sum(CASE WHEN ret > 0 THEN volume ELSE 0.0::DOUBLE END) {rows(20)} AS upv, sum(CASE WHEN ret < 0 THEN volume ELSE 0.0::DOUBLE END) {rows(20)} AS downv,
    CASE WHEN high = low THEN 0.5::DOUBLE ELSE (close - low) / (high - low) END AS close_position,
    {guard(f"stddev_samp(ret) {rows(20)} * sqrt(252.0::DOUBLE)", 21)} AS volatility_20d, {guard(f"stddev_samp(ret) {rows(60)} * sqrt(252.0::DOUBLE)", 61)} AS volatility_60d,
    {guard(f"stddev_samp(CASE WHEN ret < 0 THEN ret END) {rows(20)} * sqrt(252.0::DOUBLE)", 21)} AS downside_volatility_20d,
    list(close) {rows(20)} AS xs20, list(close) {rows(60)} AS xs60, max(close) {rows(252)} AS top252, min(close) {rows(252)} AS low252,
    {guard(f"max(high) {rows(20)}", 20)} AS top20, {guard(f"max(high) {rows(60)}", 60)} AS top60, max(high) {rows(20, -1)} AS before20
  FROM {out}_0
), {out}_2 AS (
  SELECT *, {guard(f"avg(tr) {rows(14)}", 14)} AS ATR14, CASE WHEN n > 20 AND high > before20 THEN high END AS broke FROM {out}_1
), {out} AS (
  SELECT *, ATR14 / close AS ATR_pct, max(broke) {rows(5)} AS broke5,
    {", ".join(f"(close - SMA{w}) / SMA{w} * 100 AS close_vs_SMA{w}_pct" for w in C.SMA_WINDOWS)}, (SMA20 - SMA50) / SMA50 * 100 AS SMA20_vs_SMA50_pct, (SMA50 - SMA200) / SMA200 * 100 AS SMA50_vs_SMA200_pct,
    return_252d IS NULL AS return_252d_missing, volume / avg20 AS volume_ratio_20d, volume / avg60 AS volume_ratio_60d, dollar_volume_20d < 2000000 AS illiquid_flag,
    CASE WHEN n >= 20 THEN CAST(len(list_filter(days, lambda x: x.r > 0 AND x.v > 1.5::DOUBLE * avg20)) AS INTEGER) END AS high_volume_up_days_20d,
    CASE WHEN n >= 20 THEN CAST(len(list_filter(days, lambda x: x.r < 0 AND x.v > 1.5::DOUBLE * avg20)) AS INTEGER) END AS high_volume_down_days_20d,
    CASE WHEN n >= 21 THEN CASE WHEN downv = 0 THEN 10.0::DOUBLE ELSE least(upv / downv, 10.0::DOUBLE) END END AS up_volume_vs_down_volume_20d,
    close_position < 0.35::DOUBLE AS weak_close_flag, close_position > 0.65::DOUBLE AS strong_close_flag, {_drawdown(20)} AS max_drawdown_20d, {_drawdown(60)} AS max_drawdown_60d,
    (top252 - close) / top252 * 100 AS distance_from_52w_high_pct, (close - low252) / low252 * 100 AS distance_from_52w_low_pct,
    close >= 0.98::DOUBLE * top20 AS near_20d_high, close >= 0.97::DOUBLE * top60 AS near_60d_high,
    close > SMA50 AND (top20 - close) / top20 * 100 BETWEEN 3 AND 10 AS pullback_above_SMA50,
    (close - SMA20) / SMA20 * 100 > 15 AS extended_flag, NOT ((close - SMA20) / SMA20 * 100 > 15) AS not_extended_flag
  FROM {out}_2
)"""


FEATURES = f"{BARS}, {features('bars', 'f')}, own AS (SELECT *, CASE WHEN n >= 25 THEN coalesce((broke5 - close) / broke5 * 100 >= 3, FALSE) END AS failed_breakout_flag FROM f)"
REGIME = f"""{REGION}, {features('region_bars', 'g')}, g_vols AS (
  SELECT *, list(volatility_20d) FILTER (volatility_20d IS NOT NULL) {rows(252)} AS vols FROM g
), regime AS (
  SELECT entity AS benchmark, d, {", ".join(f"close > SMA{w} AS benchmark_above_SMA{w}" for w in C.SMA_WINDOWS)}, {", ".join(f"return_{w}d AS benchmark_return_{w}d" for w in C.RETURN_WINDOWS)},
    volatility_20d AS benchmark_volatility_20d,
    CASE WHEN volatility_20d IS NOT NULL AND len(vols) >= 10 THEN CAST(len(list_filter(vols, lambda v: v <= volatility_20d)) AS DOUBLE) / len(vols) * 100 > 80 END AS benchmark_vol_high_flag
  FROM g_vols)"""
PANEL = f"{WATCH}, {FEATURES}, {REGIME}, panel AS (SELECT own.*, sector, regime.*, {', '.join(f'return_{w}d - benchmark_return_{w}d AS relative_strength_{w}d' for w in C.STRENGTH_WINDOWS)} FROM own JOIN watch USING (entity) JOIN regime ON watch.benchmark = regime.benchmark AND own.d = regime.d)".replace("own.*, sector, regime.*", "own.*, sector, regime.* EXCLUDE (d)")


def rank(x: str, keys: str = "d", order: str = "ASC") -> str:
    """Average-tie percent rank of x within the keys."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} {order} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {keys}) * 100 END"


PERCENTILES = f"""{PANEL}, pct AS (SELECT *, {", ".join(f"{rank(f)} AS {f}_percentile" for f in C.NORMAL_PERCENTILES)}, {", ".join(f"{rank(f, order='DESC')} AS {f}_percentile" for f in C.INVERTED_PERCENTILES)},
  {rank('distance_from_52w_high_pct', order='DESC')} AS high_rank FROM panel), ranked AS (
  SELECT * EXCLUDE (high_rank), CASE WHEN extended_flag THEN least(high_rank, 50.0::DOUBLE) ELSE high_rank END AS distance_from_52w_high_adjusted_percentile FROM pct)"""


_FIELDS = [f for g in C.COMPOSITES.values() for f in g["fields"]]
REPORTED = "reported AS (SELECT l_suppkey AS entity, CAST(date_trunc('year', l_shipdate) + INTERVAL 1 YEAR AS DATE) AS filed_date, round(sum(l_extendedprice) / nullif(sum(l_tax * 100), 0), 9) AS trailing_pe, round(avg(l_extendedprice), 9) AS price_to_sales, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE max(l_quantity) END AS ev_to_ebitda, round(avg(l_discount - 0.04::DOUBLE), 9) AS price_to_book, round(avg(l_discount), 9) AS profit_margin, round(avg(l_tax), 9) AS operating_margin, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE round(avg(l_discount - l_tax), 9) END AS return_on_equity, sum(l_quantity) AS debt_to_equity, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE round(avg(l_quantity), 9) END AS short_percent_of_float FROM lineitem GROUP BY 1, 2)"


def scrubbed(f: str) -> str:
    return f"CASE WHEN {f} > 0 THEN {f} END" if f in C.NON_NEGATIVE_VALUATIONS else f


def composites(source: str, out: str, neutral: bool) -> str:
    """CTEs up to `out`: source with the composite percentiles and sector_rank_fallback; needs d, sector and the fields."""
    parts, index = [], f"coalesce(sector = '{C.INDEX_SECTOR}', FALSE)"
    for name, g in C.COMPOSITES.items():
        inside, ranks = neutral and name != "short_interest_percentile", []
        some = f"(coalesce({', '.join(g['fields'])}) IS NOT NULL AND NOT {index})"
        big = f"(sum(CASE WHEN {some} THEN 1 ELSE 0 END) OVER (PARTITION BY d, sector) >= {C.SECTOR_MIN_MEMBERS})"
        for f in g["fields"]:
            order = "DESC" if f in g["inverted"] else "ASC"
            x = rank(f, "d", order)
            if inside:
                x = f"CASE WHEN NOT {index} THEN CASE WHEN {big} THEN CASE WHEN sector IS NOT NULL THEN {rank(f, f'd, sector, {index}', order)} END ELSE {rank(f, f'd, {index}', order)} END END"
            ranks.append(x)
        parts.append((name, ranks, big, inside))
    first = f"{out}_0 AS (SELECT *, " + ", ".join(f"{r} AS {n}_{i}" for n, rs, _, _ in parts for i, r in enumerate(rs)) + "".join(f", {big} AS big_{n}" for n, _, big, inside in parts if inside) + f" FROM {source})"
    mean = lambda n, rs: "round((" + " + ".join(f"coalesce({n}_{i}, 0.0::DOUBLE)" for i in range(len(rs))) + ") / nullif(" + " + ".join(f"CASE WHEN {n}_{i} IS NULL THEN 0 ELSE 1 END" for i in range(len(rs))) + ", 0), 9)"
    fall = " OR ".join(f"({mean(n, rs)} IS NOT NULL AND NOT big_{n})" for n, rs, _, inside in parts if inside) or "FALSE"
    return f"{first}, {out} AS (SELECT *, {', '.join(f'{mean(n, rs)} AS {n}' for n, rs, _, _ in parts)}, {fall} AS sector_rank_fallback FROM {out}_0)"


KNOWN = f"{REPORTED}, with_figures AS (SELECT r.*, {', '.join(f'{scrubbed(f)} AS {f}' for f in _FIELDS)} FROM ranked r ASOF LEFT JOIN reported p ON r.entity = p.entity AND r.d >= p.filed_date), {composites('with_figures', 'composed', True)}"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"


def known(value: str, *needed: str) -> str:
    return f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in needed)} THEN {value} END"


def points(condition: str, n: float) -> str:
    return f"CASE WHEN {condition} THEN {float(n)}::DOUBLE ELSE 0.0::DOUBLE END"


def blend(name: str) -> str:
    weights, penalties = C.BLENDS[name]
    parts = [f"{'coalesce(return_252d_percentile, return_120d_percentile)' if f == 'return_252d' else f + '_percentile'} * {w}::DOUBLE" for f, w in weights]
    needed = [f"{f}_percentile" for f, _ in weights if f != "return_252d"]
    return known(clamp(f"{' + '.join(parts)} - ({' + '.join(points(f'{f} < 0', n) for f, n in penalties)})"), *needed)


_TREND = known(clamp(" + ".join(points(f"{a} > {b}", 20) for a, b in (("close", "SMA20"), ("close", "SMA50"), ("close", "SMA200"), ("SMA20", "SMA50"), ("SMA50", "SMA200")))), "SMA20", "SMA50", "SMA200")
_UP, _DOWN = "return_1d > 0 AND volume_ratio_20d >", "return_1d < 0 AND volume_ratio_20d >"
_VOLUME = known(
    clamp(f"50.0::DOUBLE + {points(f'{_UP} 1.2::DOUBLE', 10)} + {points(f'{_UP} 1.5::DOUBLE', 15)} + {points(f'{_UP} 2', 10)} + {points(f'{_DOWN} 1.5::DOUBLE', -25)} + {points(f'{_DOWN} 2', -15)} + (high_volume_up_days_20d - high_volume_down_days_20d) * 5.0::DOUBLE + {points('weak_close_flag AND volume_ratio_20d > 1.2::DOUBLE', -10)} + {points('strong_close_flag AND volume_ratio_20d > 1.2::DOUBLE', 10)}"),
    "volume_ratio_20d", "return_1d", "high_volume_up_days_20d", "high_volume_down_days_20d", "weak_close_flag",
)
_RISK = known(clamp(" + ".join(f"{f} * {w}::DOUBLE" for f, w in C.RISK_WEIGHTS) + f" - {points('extended_flag', 20)} - {points('close < SMA50', 15)}"), *(f for f, _ in C.RISK_WEIGHTS), "extended_flag", "SMA50")
_SETUP = known(
    clamp(f"{points('close > SMA20', 20)} + {points('close > SMA50', 20)} + {points('not_extended_flag', 20)} + {points('near_20d_high', 15)} + {points('near_60d_high', 15)} + {points('pullback_above_SMA50', 10)} + {points('failed_breakout_flag', -30)}"),
    "SMA20", "SMA50", "not_extended_flag", "near_20d_high", "near_60d_high", "pullback_above_SMA50", "failed_breakout_flag",
)
_REGIME = known(
    clamp(f"{points('benchmark_above_SMA20', 25)} + {points('benchmark_above_SMA50', 25)} + {points('benchmark_above_SMA200', 20)} + {points('benchmark_vol_high_flag', -10)} + {points('benchmark_return_20d > 0', 15)} + {points('benchmark_return_60d > 0', 15)}"),
    "benchmark_above_SMA20", "benchmark_above_SMA50", "benchmark_above_SMA200", "benchmark_return_20d", "benchmark_return_60d", "benchmark_vol_high_flag",
)
COMPONENT_NAMES = ("trend_component", *C.BLENDS, "volume_behavior_component", "risk_component", "setup_component", "market_regime_component")
COMPOSITE_NAMES = tuple(f"{n.removesuffix('_percentile')}_component" for n in C.COMPOSITES)
COMPONENT_NAMES = (*COMPONENT_NAMES, *COMPOSITE_NAMES)
COMPONENTS = f"""{PERCENTILES}, {KNOWN}, comp AS (SELECT *, {_TREND} AS trend_component, {", ".join(f"{blend(n)} AS {n}" for n in C.BLENDS)}, {_VOLUME} AS volume_behavior_component,
  {_RISK} AS risk_component, {_SETUP} AS setup_component, {_REGIME} AS market_regime_component,
  {", ".join(f"CASE WHEN {n} IS NOT NULL THEN {clamp(n)} END AS {c}" for n, c in zip(C.COMPOSITES, COMPOSITE_NAMES))} FROM composed)"""


def score(weights: dict[str, float], penalty: float = 0) -> str:
    near = points(f"days_until_earnings BETWEEN 0 AND {C.EARNINGS_WINDOW_DAYS}", penalty) if penalty else "0"
    total = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for c, w in weights.items())
    value = " + ".join(f"coalesce({c} * {w}::DOUBLE, 0.0::DOUBLE)" for c, w in weights.items())
    return known(clamp(f"({value}) / ({total}) - {near}"), *(c for c in weights if c not in C.SITOUT))


def label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {low} THEN '{name}'" for name, low in C.LABEL_BANDS) + " END"


SCORES = f"{COMPONENTS}, scored AS (SELECT *, {', '.join(f'{score(w)} AS {h}' for h, w in C.SCORE_WEIGHTS.items())} FROM comp)"


def r6(*names: str) -> str:
    """Columns to 6 digits."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)
