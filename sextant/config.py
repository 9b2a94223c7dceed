"""Parameters of the engine, as data: expressions and weights are generated from these values."""

from __future__ import annotations

# Windows, thresholds and weights that results depend on.

SMA_WINDOWS = (20, 50, 200)
RETURN_WINDOWS = (1, 5, 10, 20, 60, 120, 252)
STRENGTH_WINDOWS = (5, 20, 60, 120)
VOLUME_WINDOWS = (20, 60)
HIGH_VOLUME_RATIO = 1.5
UP_DOWN_VOLUME_CAP = 10.0
CLOSE_WEAK, CLOSE_STRONG = 0.35, 0.65
ATR_WINDOW = 14
VOLATILITY_WINDOWS = (20, 60)
DRAWDOWN_WINDOWS = (20, 60)
SESSIONS_A_YEAR = 252
NEAR_HIGH = {20: 0.98, 60: 0.97}
PULLBACK = (3.0, 10.0)
BREAKOUT_LOOKBACK, BREAKOUT_DROP = 5, 3.0
EXTENDED = 15.0
BENCHMARK_RETURN_WINDOWS = (20, 60)
VOL_HIGH_PERCENTILE, VOL_HIGH_LEAST = 80, 10
MIN_DOLLAR_VOLUME = 2_000_000.0
DECILES, DECILE_MIN_NAMES = 10, 30
SECTOR_MIN_MEMBERS, INDEX_SECTOR, MARKET = 8, "Index", "SPY"
STALENESS_DAYS = 7
MACRO_MIN_HISTORY = 252
MACRO_SERIES = ("DGS10", "DGS2", "T10Y2Y", "BAMLH0A0HYM2", "VIXCLS")
TTM_TOLERANCE = 20
RATIO_PERIOD_TOLERANCE = 20
DATA_AGE_DAYS = 550
FACTOR_IC_DRIFT = 0.05
POWER_Z = 2.80
THIN_FRACTION, THIN_LOOKBACK, THIN_MIN_PRIORS = 0.90, 30, 5
PATTERN_MIN_EFFECTIVE, PATTERN_MIN_TRIGGERS, PATTERN_ALPHA, PATTERN_SPLIT = 5, 20, 0.05, 0.6
PATTERN_DRAWS, PATTERN_SEED, PATTERN_LEAST_HISTORY = 500, 20260909, 60
FDR_Q = 0.10
SPARSE_SHARE = 0.40
SPREAD_BASE, SPREAD_COEF, SPREAD_MIN, SPREAD_MAX = 1.0, 12.0, 1.0, 80.0
IMPACT_COEF, PARTICIPATION_CAP = 10.0, 0.10
INITIAL_EQUITY, SUSPICIOUS_MOVE = 100_000.0, 50.0
BACKTEST_NAMES, BACKTEST_HOLDS, BACKTEST_SCORE = (10, 20, 30), (20, 60, 120), "score_60d"
#: Least dollar volume of a holding; prices of the test tables are small, so theirs is set lower than MIN_DOLLAR_VOLUME.
BACKTEST_MIN_ADV = 20_000.0

NORMAL_PERCENTILES = ("return_5d", "return_10d", "return_20d", "return_60d", "return_120d", "return_252d", "relative_strength_5d", "relative_strength_20d", "relative_strength_60d", "relative_strength_120d", "volume_ratio_20d")
INVERTED_PERCENTILES = ("ATR_pct", "volatility_60d", "max_drawdown_60d")

# Fields, weights and bands of the composites, components and scores.
COMPOSITES = {
    "value_percentile": {"fields": ("trailing_pe", "price_to_sales", "ev_to_ebitda", "price_to_book"), "inverted": ("trailing_pe", "price_to_sales", "ev_to_ebitda", "price_to_book")},
    "quality_percentile": {"fields": ("profit_margin", "operating_margin", "return_on_equity", "debt_to_equity"), "inverted": ("debt_to_equity",)},
    "short_interest_percentile": {"fields": ("short_percent_of_float",), "inverted": ("short_percent_of_float",)},
}
NON_NEGATIVE_VALUATIONS = ("trailing_pe", "forward_pe", "price_to_sales", "price_to_book", "ev_to_ebitda")

#: Momentum-like components: (weighted percentile fields, fields whose negative value costs points).
BLENDS = {
    "short_momentum_component": ((("return_5d", 0.40), ("return_10d", 0.35), ("return_20d", 0.25)), (("return_5d", 15), ("return_10d", 10))),
    "momentum_component_20d": ((("return_20d", 0.50), ("return_60d", 0.30), ("return_10d", 0.20)), (("return_20d", 20),)),
    "medium_momentum_component": ((("return_60d", 0.45), ("return_120d", 0.35), ("return_20d", 0.20)), (("return_60d", 20),)),
    "long_momentum_component": ((("return_120d", 0.45), ("return_252d", 0.35), ("return_60d", 0.20)), (("return_120d", 20),)),
    "relative_strength_component_5d": ((("relative_strength_5d", 0.60), ("relative_strength_20d", 0.40)), (("relative_strength_5d", 10),)),
    "relative_strength_component_20d": ((("relative_strength_20d", 0.50), ("relative_strength_60d", 0.50)), (("relative_strength_20d", 10), ("relative_strength_60d", 10))),
    "relative_strength_component_60d": ((("relative_strength_60d", 0.60), ("relative_strength_120d", 0.40)), (("relative_strength_60d", 10),)),
    "relative_strength_component_120d": ((("relative_strength_120d", 0.70), ("relative_strength_60d", 0.30)), (("relative_strength_120d", 10),)),
}
RISK_WEIGHTS = (("ATR_pct_percentile", 0.35), ("volatility_60d_percentile", 0.25), ("max_drawdown_60d_percentile", 0.25), ("distance_from_52w_high_adjusted_percentile", 0.15))
SITOUT = ("value_component", "quality_component", "short_interest_component")
SCORE_WEIGHTS = {
    "score_5d": {"short_momentum_component": 0.15, "relative_strength_component_5d": 0.15, "trend_component": 0.15, "value_component": 0.15, "quality_component": 0.15, "risk_component": 0.10, "short_interest_component": 0.10, "volume_behavior_component": 0.05},
    "score_20d": {"trend_component": 0.18, "momentum_component_20d": 0.15, "relative_strength_component_20d": 0.15, "value_component": 0.15, "quality_component": 0.15, "risk_component": 0.10, "short_interest_component": 0.07, "market_regime_component": 0.05},
    "score_60d": {"trend_component": 0.20, "medium_momentum_component": 0.15, "relative_strength_component_60d": 0.18, "value_component": 0.17, "quality_component": 0.15, "risk_component": 0.08, "short_interest_component": 0.05, "market_regime_component": 0.02},
    "score_120d": {"trend_component": 0.22, "long_momentum_component": 0.15, "relative_strength_component_120d": 0.18, "value_component": 0.15, "quality_component": 0.15, "risk_component": 0.08, "short_interest_component": 0.05, "market_regime_component": 0.02},
}
EARNINGS_PENALTIES = {"score_5d": 20, "score_20d": 12, "score_60d": 5, "score_120d": 0}
EARNINGS_WINDOW_DAYS = 5
#: Versions whose live scores pay for near earnings; all others never do.
LIVE_EARNINGS_VERSIONS = ("v0.2_fundamentals_added", "v0.3_sector_neutral", "v0.5_expanded_universe")
LABEL_BANDS = (("strong", 80), ("decent", 65), ("watchlist", 50), ("weak", 0))
ROUTINE_ITEMS = ("9.01", "5.07")
EVENT_GROUPS = {"earnings": ("2.02",), "officer_change": ("5.02",), "agreement": ("1.01", "2.01"), "redflag": ("4.02", "2.06", "1.03", "3.01"), "disclosure": ("7.01", "8.01")}
EVENT_WINDOWS = (5, 30, 90)
SECTOR_NORMALIZE = {"Tech-Software": "Information Technology", "Healthcare": "Health Care", "Utilities-Power": "Utilities", "Industrials-Power": "Industrials"}
SECTOR_BENCHMARKS = {"Information Technology": "QQQ", "Energy": "XLE", "Financials": "XLF", "Health Care": "XLV", "Industrials": "XLI", "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Utilities": "XLU", "Materials": "XLB", "Real Estate": "XLRE", "Communication Services": "XLC"}

# Tags of each concept in the order of preference; a tag outside the main taxonomy carries its prefix.
CONCEPT_TAGS = {
    "revenue": ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "shares": ("CommonStockSharesOutstanding", "dei:EntityCommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding"),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "long_term_debt": ("LongTermDebtNoncurrent", "LongTermDebt", "LongTermDebtAndCapitalLeaseObligations"),
    "current_debt": ("LongTermDebtCurrent", "DebtCurrent", "ShortTermBorrowings"),
    "finance_lease_noncurrent": ("FinanceLeaseLiabilityNoncurrent",),
    "finance_lease_current": ("FinanceLeaseLiabilityCurrent",),
    "finance_lease": ("FinanceLeaseLiability",),
    "operating_lease_noncurrent": ("OperatingLeaseLiabilityNoncurrent",),
    "operating_lease_current": ("OperatingLeaseLiabilityCurrent",),
    "operating_lease": ("OperatingLeaseLiability",),
    "current_assets": ("AssetsCurrent",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "operating_income": ("OperatingIncomeLoss",),
}
#: Concepts that are a change over a period; all others are balances of a day.
FLOW_CONCEPTS = ("revenue", "net_income", "operating_income")
DEBT_TAGS_WITH_LEASES = ("LongTermDebtAndCapitalLeaseObligations",)
FINANCIAL_SECTORS = ("Financials", "Real Estate")
EPS_TAGS = ("EarningsPerShareDiluted", "EarningsPerShareBasic", "EarningsPerShareBasicAndDiluted")
#: Ratios that are worked out and held back, as they did not agree with a second source.
WITHHELD_RATIOS = ("operating_margin",)
