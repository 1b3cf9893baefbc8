"""The registered queries in SQL (DuckDB dialect), independent of the Spark code.

Common table expressions are shared by name; ``sql`` pulls in what a query needs.
The recurrences are written as recursive queries that go row by row.
"""

from __future__ import annotations

import re

from signalspark.operators.indicators import FILLED_TECHNICAL
from signalspark.params import FoldParams, SweepParams, TradingParams
from workload.spark_queries import DIGITS, FEATURES, SMOOTHED, SMOOTHED_DIGITS
from workload.views import KEYWORDS, NEGATIVE_WORDS, POSITIVE_WORDS, PRIORITY_SCORE

FOLDS, TRADING, SWEEP = FoldParams(), TradingParams(), SweepParams()
SPAN = FOLDS.train_days + FOLDS.test_days

CTES: dict[str, str] = {
    "bars": """
        SELECT Ticker, Date, arg_min(price, k) AS Open, max(price) AS High, min(price) AS Low,
               arg_max(price, k) AS Close, sum(l_quantity) AS Volume
        FROM (SELECT 'E' || (l_suppkey % 6) AS Ticker, CAST(l_shipdate AS DATE) AS Date,
                     l_extendedprice / l_quantity AS price, l_quantity,
                     row(l_orderkey, l_linenumber, l_extendedprice / l_quantity, l_quantity) AS k
              FROM lineitem)
        GROUP BY Ticker, Date""",
    "event_bars": """
        SELECT event_type AS Ticker, CAST(ts AS DATE) AS Date, arg_min(value, event_id) AS Open,
               max(value) AS High, min(value) AS Low, arg_max(value, event_id) AS Close,
               CAST(count(*) AS DOUBLE) AS Volume
        FROM events WHERE isodow(ts) < 6 GROUP BY event_type, CAST(ts AS DATE)""",
    "news": """
        SELECT o_orderkey, 'E' || (o_custkey % 6) AS Ticker,
               o_orderdate + to_minutes(CAST((o_orderkey % 48) * 30 AS INTEGER)) AS Time,
               o_orderpriority AS Headlines, o_orderstatus || ' ' || o_orderkey AS Description
        FROM orders""",
    "scored_news": "SELECT *, greatest(s, 0e0) AS positive, greatest(-s, 0e0) AS negative, "
                   "1e0 - abs(s) AS neutral, s AS sentiment_score FROM (SELECT *, CASE Headlines "
                   + " ".join(f"WHEN '{p}' THEN CAST({x} AS DOUBLE)"
                              for p, x in PRIORITY_SCORE.items())
                   + " ELSE 0e0 END AS s FROM news)",
    "aligned": """
        SELECT n.*, (SELECT min(b.Date) FROM bars b
                     WHERE b.Ticker = n.Ticker AND b.Date >= CAST(n.Time AS DATE)) AS Date
        FROM scored_news n""",
    "aligned_news": "SELECT *, " + "{t}".format(t="""
        least(greatest((hour(Time) + minute(Time) / 60e0 - 95e-1) / 65e-1, 0e0), 1e0)""")
        + " AS t FROM aligned WHERE Date IS NOT NULL",
    "events_aligned": """
        SELECT event_id, event_type AS Ticker, s AS sentiment_score, t,
               (SELECT min(b.Date) FROM event_bars b
                WHERE b.Ticker = e.event_type AND b.Date >= CAST(e.ts AS DATE)) AS Date
        FROM (SELECT *, least(value, 100e0) / 50e0 - 1e0 AS s,
                     least(greatest((hour(ts) + minute(ts) / 60e0 - 95e-1) / 65e-1, 0e0), 1e0) AS t
              FROM events) e""",
    "aligned_events": "SELECT * FROM events_aligned WHERE Date IS NOT NULL",
    "market": """
        SELECT *, CAST(nxt > Close AS INTEGER) AS Target, nxt / Close - 1 AS fwd_return
        FROM (SELECT *, lead(Close) OVER (PARTITION BY Ticker ORDER BY Date) AS nxt FROM bars)
        WHERE nxt IS NOT NULL""",
    "daily": """
        SELECT Ticker, Date, avg(sentiment_score) AS sent_mean,
               coalesce(stddev_samp(sentiment_score), 0) AS sent_std,
               min(sentiment_score) AS sent_min, max(sentiment_score) AS sent_max,
               count(sentiment_score) AS sent_count, avg(positive) AS positive_mean,
               avg(negative) AS negative_mean, avg(neutral) AS neutral_mean
        FROM aligned_news GROUP BY Ticker, Date""",
    "flat": "SELECT m.*, d.* EXCLUDE (Ticker, Date) FROM market m LEFT JOIN daily d "
            "ON d.Ticker = m.Ticker AND d.Date = m.Date",
    "news_weighted": "SELECT *, exp(-1e0 * (1e0 - t)) AS w FROM aligned_news",
    "news_mean": """
        SELECT *, sum(w * sentiment_score) OVER (PARTITION BY Ticker, Date)
                  / sum(w) OVER (PARTITION BY Ticker, Date) AS mu FROM news_weighted""",
    "decayed": """
        SELECT Ticker, Date, sum(w * sentiment_score) / sum(w) AS sent_decay_mean,
               sum(w * (sentiment_score - mu) ** 2) / sum(w) AS sent_decay_var,
               avg(sentiment_score) AS sent_flat_mean, stddev_samp(sentiment_score) AS sent_std,
               count(sentiment_score) AS sent_count
        FROM news_mean GROUP BY Ticker, Date""",
    "decay": "SELECT m.*, d.* EXCLUDE (Ticker, Date) FROM market m LEFT JOIN decayed d "
             "ON d.Ticker = m.Ticker AND d.Date = m.Date",
}

# --- technical indicators, row by row ---

_W = "OVER (PARTITION BY Ticker ORDER BY Date)"
RETURNS = [f"{p}return_{n}d" for n in (1, 5, 10) for p in ("", "log_")]
TECHNICAL = [*RETURNS, "volatility", "Momentum", "EMA_12", "EMA_26", "RSI", "MACD",
             "MACD_signal", "MACD_diff"]


def _indicators(source: str, prefix: str) -> dict[str, str]:
    """Indicator tables over ``source``: {prefix}tech has all columns of it and TECHNICAL."""
    returns = ", ".join(f"Close / lag(Close, {n}) {_W} - 1 AS return_{n}d" for n in (1, 5, 10))
    logs = ", ".join(f"CASE WHEN return_{n}d > -1 THEN ln(1 + return_{n}d) END AS log_return_{n}d"
                     for n in (1, 5, 10))
    return {
        f"{prefix}rows": f"""
            SELECT *, row_number() {_W} AS rn, {returns},
                   coalesce(Close - lag(Close) {_W}, 0) AS step FROM {source}""",
        f"{prefix}ema": f"""
            SELECT Ticker, rn, Close AS e12, Close AS e26, greatest(step, 0e0) AS g,
                   greatest(-step, 0e0) AS l FROM {prefix}rows WHERE rn = 1
            UNION ALL
            SELECT r.Ticker, r.rn, r.Close * (2e0 / 13) + e.e12 * (11e0 / 13),
                   r.Close * (2e0 / 27) + e.e26 * (25e0 / 27),
                   greatest(r.step, 0e0) / 14 + e.g * (13e0 / 14),
                   greatest(-r.step, 0e0) / 14 + e.l * (13e0 / 14)
            FROM {prefix}ema e JOIN {prefix}rows r ON r.Ticker = e.Ticker AND r.rn = e.rn + 1""",
        f"{prefix}sig": f"""
            SELECT Ticker, rn, e12 - e26 AS s FROM {prefix}ema WHERE rn = 26
            UNION ALL
            SELECT e.Ticker, e.rn, (e.e12 - e.e26) * 2e-1 + g.s * 8e-1
            FROM {prefix}sig g JOIN {prefix}ema e ON e.Ticker = g.Ticker AND e.rn = g.rn + 1""",
        f"{prefix}tech": f"""
            SELECT r.*, {logs}, stddev_samp(return_1d) OVER (PARTITION BY r.Ticker ORDER BY Date
                       ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volatility,
                   return_10d AS Momentum, e12 AS EMA_12, e26 AS EMA_26,
                   CASE WHEN r.rn >= 14 THEN
                        CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS RSI,
                   CASE WHEN r.rn >= 26 THEN e12 - e26 END AS MACD,
                   CASE WHEN r.rn >= 34 THEN s END AS MACD_signal,
                   CASE WHEN r.rn >= 34 THEN e12 - e26 - s END AS MACD_diff
            FROM {prefix}rows r JOIN {prefix}ema e ON e.Ticker = r.Ticker AND e.rn = r.rn
            LEFT JOIN {prefix}sig x ON x.Ticker = r.Ticker AND x.rn = r.rn""",
    }


def _sentiment(source: str, name: str, columns: list[str], mean: str) -> dict[str, str]:
    """Lags of ``columns``, momentum and volatility of ``mean``."""
    lags = ", ".join(f"lag({c}, {k}) {_W} AS {c}_lag{k}" for c in columns for k in (1, 2, 3))
    return {name: f"""
        SELECT *, {lags}, {mean} - lag({mean}, 3) {_W} AS sent_momentum,
               stddev_samp({mean}) OVER (PARTITION BY Ticker ORDER BY Date
                   ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sent_volatility FROM {source}"""}


FLAT = ["sent_mean", "sent_std", "sent_min", "sent_max", "sent_count"]
DECAY = ["sent_decay_mean", "sent_decay_var"]
MEANS = ["positive_mean", "negative_mean", "neutral_mean"]


def _made(columns: list[str]) -> list[str]:
    return [f"{c}_lag{k}" for c in columns for k in (1, 2, 3)] + ["sent_momentum", "sent_volatility"]


CTES |= _indicators("bars", "bars_") | _indicators("market", "market_")
CTES |= _sentiment("flat", "flat_features", FLAT, "sent_mean")
CTES |= _sentiment("decay", "decay_features", DECAY, "sent_decay_mean")

# --- folds, rule predictions, trading ---

CTES |= {
    "fold_grid": "SELECT CAST(i AS INTEGER) AS fold FROM range(%d) r(i)" % FOLDS.folds,
    "days": "SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS day_idx, count(*) OVER () AS n "
            "FROM (SELECT DISTINCT Date FROM fold_source)",
    "fold_days": f"""
        SELECT fold, CASE WHEN day_idx < lo + {FOLDS.train_days} THEN 'train' ELSE 'test' END AS role,
               Date, CAST(day_idx AS INTEGER) AS day_idx
        FROM (SELECT d.*, g.fold, g.fold * greatest(1, (n - {SPAN}) // {FOLDS.folds - 1}) AS lo
              FROM days d, fold_grid g)
        WHERE day_idx >= lo AND day_idx < lo + {SPAN} AND lo + {SPAN} <= n""",
    "signals": f"""
        SELECT m.Ticker, m.Date, m.Target, m.fwd_return,
               coalesce(m.Close / lag(m.Close) OVER w - 1, 0) AS baseline,
               coalesce(last_value(f.sent_mean IGNORE NULLS) OVER w, 0) AS flat_sentiment,
               coalesce(last_value(d.sent_decay_mean IGNORE NULLS) OVER w, 0) AS decay_sentiment
        FROM market m LEFT JOIN daily f ON f.Ticker = m.Ticker AND f.Date = m.Date
        LEFT JOIN decayed d ON d.Ticker = m.Ticker AND d.Date = m.Date
        WINDOW w AS (PARTITION BY m.Ticker ORDER BY m.Date ROWS UNBOUNDED PRECEDING)""",
    "rules": "SELECT variant, 'rule' AS model_type, fold, s.Ticker, s.Date, Target AS y_true, "
             "CAST(round(signal, 9) > 0 AS INTEGER) AS y_pred, "
             "round(1 / (1 + exp(-signal)), 3) AS proba, fwd_return / 100 AS fwd_return "
             "FROM (UNPIVOT signals ON baseline, flat_sentiment, decay_sentiment "
             "INTO NAME variant VALUE signal) s JOIN fold_days f ON f.Date = s.Date "
             "WHERE f.role = 'test'",
    "positions": "SELECT *, CASE WHEN y_pred = 1 THEN 1e0 ELSE -1e0 END AS position FROM rules",
    "paths": f"""
        SELECT *, abs(position - lag(position, 1, 0e0) OVER (PARTITION BY variant, model_type, fold, Ticker
                      ORDER BY Date)) * {TRADING.cost} AS cost,
               position * fwd_return - abs(position - lag(position, 1, 0e0) OVER (
                      PARTITION BY variant, model_type, fold, Ticker ORDER BY Date)) * {TRADING.cost}
               AS net_return FROM positions""",
    "portfolio": "SELECT variant, model_type, fold, Date, avg(net_return) AS net_return FROM paths "
                 "GROUP BY variant, model_type, fold, Date",
    "equity": """
        SELECT *, product(1 + net_return) OVER (PARTITION BY variant, model_type, fold ORDER BY Date
                      ROWS UNBOUNDED PRECEDING) - 1 AS cum_return FROM portfolio""",
    "falls": """
        SELECT *, CASE WHEN peak + 1 <> 0 THEN (cum_return - peak) / (peak + 1) END AS drawdown
        FROM (SELECT *, max(cum_return) OVER (PARTITION BY variant, model_type, fold ORDER BY Date
                            ROWS UNBOUNDED PRECEDING) AS peak FROM equity)""",
    "trades": f"""
        SELECT variant, model_type, fold, arg_max(cum_return, Date) AS total_return,
               CASE WHEN stddev_pop(net_return) <= 1e-15 * max(abs(net_return)) THEN 0
                    ELSE sqrt(252e0) * (avg(net_return) - {TRADING.risk_free} / 252e0)
                         / stddev_pop(net_return) END AS sharpe_ratio,
               min(drawdown) AS max_drawdown, avg(net_return) AS mean_return,
               stddev_pop(net_return) AS std_return,
               avg(CAST(net_return > 0 AS INTEGER)) AS win_rate
        FROM falls GROUP BY variant, model_type, fold""",
    "ranked": """
        SELECT *, (rank() OVER (PARTITION BY variant, model_type, fold ORDER BY proba)
                   + (count(*) OVER (PARTITION BY variant, model_type, fold, proba) - 1) / 2e0) AS r,
               (rank() OVER (PARTITION BY variant, model_type ORDER BY proba)
                   + (count(*) OVER (PARTITION BY variant, model_type, proba) - 1) / 2e0) AS r_all
        FROM rules""",
    "counts": """
        SELECT variant, model_type, fold, sum(CAST(y_true = 1 AND y_pred = 1 AS INTEGER)) AS tp,
               sum(CAST(y_true = 0 AND y_pred = 0 AS INTEGER)) AS tn,
               sum(CAST(y_true = 0 AND y_pred = 1 AS INTEGER)) AS fp,
               sum(CAST(y_true = 1 AND y_pred = 0 AS INTEGER)) AS fn,
               sum(y_true) AS n1, count(*) - sum(y_true) AS n0,
               sum(CASE WHEN y_true = 1 THEN r ELSE 0 END) AS ranks
        FROM ranked GROUP BY variant, model_type, fold""",
    "classes": """
        SELECT variant, model_type, fold, (tp + tn) / (tp + tn + fp + fn) AS accuracy,
               CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
               CASE WHEN n1 > 0 AND n0 > 0 THEN (ranks - n1 * (n1 + 1) / 2) / (n1 * n0)
                    ELSE 5e-1 END AS auc,
               CASE WHEN ok THEN tp END AS true_positive, CASE WHEN ok THEN tn END AS true_negative,
               CASE WHEN ok THEN fp END AS false_positive, CASE WHEN ok THEN fn END AS false_negative,
               CASE WHEN ok THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END AS precision,
               CASE WHEN ok THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END END AS recall
        FROM (SELECT *, tp + fp + fn > 0 AND tn + fp + fn > 0 AS ok FROM counts)""",
}

# --- sweep ---

_configs = ", ".join(f"({i}, '{k}', '{p}', CAST({x} AS DOUBLE))" for i, k, p, x in SWEEP.configs())


def _sweep(source: str, prefix: str) -> dict[str, str]:
    """Daily features of every configuration over scored rows with Ticker, Date, t."""
    w = ("CASE decay_type WHEN 'exponential' THEN exp(-param_value * (1 - t)) "
         "ELSE least(greatest(1 - param_value * (1 - t), 0e0), 1e0) END")
    return {
        f"{prefix}weighted": f"""
            SELECT config_id, Ticker, Date, sentiment_score AS s, {w} AS w FROM {source}, configs
            WHERE decay_type <> 'half_life'""",
        f"{prefix}intraday": f"""
            SELECT config_id, Ticker, Date, CASE WHEN sum(w) <> 0 THEN sum(w * s) / sum(w) END
                   AS sent_decay_mean,
                   CASE WHEN sum(w) <> 0 THEN greatest(sum(w * s * s) / sum(w)
                        - (sum(w * s) / sum(w)) ** 2, 0) END AS sent_decay_var,
                   avg(s) AS sent_flat_mean, stddev_samp(s) AS sent_std, count(s) AS sent_count
            FROM {prefix}weighted GROUP BY config_id, Ticker, Date""",
        f"{prefix}means": f"""
            SELECT *, row_number() {_W} AS rn,
                   Date - lag(Date) {_W} AS gap
            FROM (SELECT Ticker, Date, avg(sentiment_score) AS sent_mean FROM {source}
                  GROUP BY Ticker, Date)""",
        f"{prefix}memory": f"""
            SELECT config_id, param_value AS h, Ticker, Date, rn, sent_mean,
                   sent_mean AS sentiment_memory
            FROM {prefix}means, configs WHERE decay_type = 'half_life' AND rn = 1
            UNION ALL
            SELECT m.config_id, m.h, d.Ticker, d.Date, d.rn, d.sent_mean,
                   (1 - pow(5e-1, 1 / m.h)) * d.sent_mean
                   + pow(5e-1, d.gap / m.h) * m.sentiment_memory
            FROM {prefix}memory m JOIN {prefix}means d ON d.Ticker = m.Ticker AND d.rn = m.rn + 1""",
        f"{prefix}daily": f"""
            SELECT config_id, Ticker, Date, sent_decay_mean, sent_decay_var, sent_flat_mean,
                   sent_std, sent_count, NULL::DOUBLE AS sent_mean, NULL::DOUBLE AS sentiment_memory
            FROM {prefix}intraday
            UNION ALL
            SELECT config_id, Ticker, Date, NULL, NULL, NULL, NULL, NULL, sent_mean,
                   sentiment_memory FROM {prefix}memory""",
    }


CTES["configs"] = ("SELECT * FROM (VALUES " + _configs
                   + ") c(config_id, decay_type, param_name, param_value)")
CTES |= _sweep("aligned_events", "e_") | _sweep("aligned_news", "n_")


# --- assembly ---


def _needed(text: str, extra: dict[str, str], found: dict[str, str]) -> None:
    """Collect the tables ``text`` reads, dependencies first."""
    pool = CTES | extra
    for name in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
        if name in pool and name not in found:
            body = pool[name]
            inner = re.sub(rf"\b{name}\b", "", body)
            _needed(inner, extra, found)
            found.setdefault(name, body)


def sql(select: str, **extra: str) -> str:
    """``select`` with the tables it needs in front."""
    found: dict[str, str] = {}
    _needed(select, extra, found)
    parts = [f"{n} AS ({b})" for n, b in found.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + select


def rnd(*columns: str) -> str:
    """Rounded columns, as the Spark results are."""
    return ", ".join(f"round({c}, {digits(c)}) AS {c}" for c in columns)


def digits(column: str) -> int:
    return SMOOTHED_DIGITS if column in SMOOTHED else DIGITS


OHLCV = ["Open", "High", "Low", "Close", "Volume"]
BARS_OF_LINES = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS Date FROM lineitem"
MARKET_DAYS = "SELECT Date FROM market"
RULES = {"fold_source": MARKET_DAYS}
SAMPLE_KEYS = "variant, model_type, fold"


def _decay_sql(weight: str) -> str:
    return sql(f"""
        SELECT Ticker, Date, round(CASE WHEN sum(w) <> 0 THEN sum(w * sentiment_score) / sum(w) END, 9)
                   AS sent_decay_mean,
               round(avg(sentiment_score), 9) AS sent_flat_mean,
               round(stddev_samp(sentiment_score), 9) AS sent_std,
               count(sentiment_score) AS sent_count
        FROM weighted GROUP BY Ticker, Date""",
               weighted=f"SELECT *, {weight} AS w FROM aligned_events")


def _aligned_sql(on: str) -> str:
    return sql(f"""
        SELECT o_orderkey, n.Ticker, b.Date, Time, Headlines, Description, {rnd(*OHLCV)}
        FROM news n JOIN bars b ON b.Ticker = n.Ticker AND b.Date = {on}""")


def _filled(columns: list[str]) -> str:
    """Forward-filled columns, then 0; the class means only get the 0."""
    w = "OVER (PARTITION BY Ticker ORDER BY Date ROWS UNBOUNDED PRECEDING)"
    out = []
    for c in columns:
        if "sent" in c or c in FILLED_TECHNICAL:
            x = f"coalesce(last_value({c} IGNORE NULLS) {w}, 0)"
        else:
            x = f"coalesce({c}, 0)" if c in MEANS else c
        out.append(f"{x} AS {c}" if c.startswith("sent_count") else f"round({x}, {digits(c)}) AS {c}")
    return ", ".join(out)


def _tag(match: str) -> str:
    text = "upper(lang || ' ' || source || ' ' || text)"
    cases = []
    for entity, words in KEYWORDS.items():
        if match == "substring":
            test = " OR ".join(f"contains({text}, '{w}')" for w in words)
        else:
            test = (f"regexp_matches({text}, "
                    f"'(^|[^\\p{{L}}\\p{{N}}])({'|'.join(words)})([^\\p{{L}}\\p{{N}}]|$)')")
        cases.append(f"WHEN {test} THEN '{entity}'")
    return "CASE " + " ".join(cases) + " END"


def _words(words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(words, lambda w: list_contains([{listed}], w)))"


_SPACE = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '')"


def _clean(column: str) -> str:
    return f"trim(regexp_replace({column}, '{_SPACE}', ' ', 'g'), ' ')"


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
ROWS = {"complete": f"SELECT Ticker, Date, Target, fwd_return, {', '.join(FEATURES)} FROM market_tech_light "
                    f"WHERE {_COMPLETE}",
        "market_tech_light": f"""
            SELECT *, stddev_samp(return_1d) OVER (PARTITION BY Ticker ORDER BY Date
                       ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volatility
            FROM (SELECT *, {', '.join(f'Close / lag(Close, {n}) {_W} - 1 AS return_{n}d'
                                       for n in (1, 5, 10))} FROM bars_target)""",
        "bars_target": f"""
            SELECT *, CAST(lead(Close) {_W} > Close AS INTEGER) AS Target,
                   lead(Close) {_W} / Close - 1 AS fwd_return FROM bars"""}
# the last day of a ticker has no target
ROWS["complete"] += " AND Target IS NOT NULL"

_fold_stats = ", ".join(f"avg({c}) FILTER (role = 'train') OVER (PARTITION BY fold) AS {c}_m, "
                        f"stddev_pop({c}) FILTER (role = 'train') OVER (PARTITION BY fold) AS {c}_s"
                        for c in FEATURES)
_ORDER_METRICS = ["accuracy", "f1", "auc", "precision", "recall"]
_TRADE_METRICS = ["total_return", "sharpe_ratio", "max_drawdown", "mean_return", "std_return",
                  "win_rate"]


def _over(names: list[str]) -> str:
    return ", ".join(f"round(avg({n}), 9) AS {n}_mean, round(stddev_pop({n}), 9) AS {n}_std"
                     for n in names)


def _importance(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr({c}, Target)) AS importance FROM {source}"
        for c in columns)


_past = "OVER (PARTITION BY Ticker ORDER BY Date ROWS UNBOUNDED PRECEDING)"
IMPORTANCE = {
    "wide": f"SELECT *, Close / lag(Close) {_W} - 1 AS return_1d, Close / lag(Close, 5) {_W} - 1 "
            f"AS return_5d, Close / lag(Close, 10) {_W} - 1 AS return_10d FROM flat",
    "full_rows": "SELECT Ticker, Date, Target, coalesce(return_10d, 0) AS Momentum, "
                 + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) {_past}, 0) AS {c}"
                             for c in ["return_1d", "return_5d", "return_10d", *FLAT])
                 + " FROM wide",
    "technical_importance": _importance("full_rows", ["Momentum", "return_1d", "return_5d",
                                                      "return_10d"]),
    "sentiment_importance_rows": _importance("full_rows", ["Momentum", "return_1d", *FLAT]),
}

COMPARISON = {
    "compared": "SELECT variant, model_type, CASE variant WHEN 'baseline' THEN 'Baseline' "
                "WHEN 'flat_sentiment' THEN 'Flat Sentiment' ELSE 'Decay Sentiment' END AS Model_, "
                "c.* EXCLUDE (variant, model_type), t.* EXCLUDE (variant, model_type) FROM ("
                + "SELECT variant, model_type, "
                + ", ".join(f"avg({n}) AS {n}_mean, stddev_pop({n}) AS {n}_std" for n in _ORDER_METRICS)
                + " FROM classes GROUP BY variant, model_type) c JOIN (SELECT variant, model_type, "
                + ", ".join(f"avg({n}) AS {n}_mean, stddev_pop({n}) AS {n}_std" for n in _TRADE_METRICS)
                + " FROM trades GROUP BY variant, model_type) t USING (variant, model_type)",
} | RULES

ORACLE_SQL: dict[str, str] = {
    "market_bars": sql(f"SELECT Ticker, Date, {rnd(*OHLCV)} FROM bars"),
    "market_union": sql(f"SELECT Ticker, Date, {rnd(*OHLCV)} FROM bars UNION ALL "
                        f"SELECT Ticker, Date, {rnd(*OHLCV)} FROM event_bars"),
    "news_dedup": sql("SELECT Headlines, Time, min(Description) AS Description FROM news "
                      "GROUP BY Headlines, Time"),
    "trading_calendar": "SELECT DISTINCT 'E' || (l_suppkey % 6) AS Ticker, "
                        "CAST(l_shipdate AS DATE) AS Date FROM lineitem",
    "score_increment": "SELECT DISTINCT sha256(text) AS text_key FROM documents WHERE sha256(text) "
                       "NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))",
    "tag_entity": f"SELECT * FROM (SELECT doc_id, {_tag('substring')} AS by_substring, "
                  f"{_tag('word')} AS by_word FROM documents) WHERE by_substring IS NOT NULL",
    "tag_dictionary": f"SELECT doc_id, t AS Ticker FROM (SELECT doc_id, {_tag('word')} AS t "
                      "FROM documents) WHERE t IS NOT NULL",
    "tag_substring": """
        WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(upper(text), '[^\\p{L}]+')) AS word FROM benchmark),
        ranked AS (SELECT word, ('0x' || substr(md5(word), 1, 6))::INTEGER AS rank, 'E' || length(word) AS tag
                   FROM words WHERE length(word) >= 8)
        SELECT doc_id, arg_min(tag, (rank, word)) AS Ticker FROM
            (SELECT doc_id, upper(concat_ws(' ', lang, source, text)) AS t FROM documents) d, ranked
        WHERE contains(t, word) GROUP BY doc_id""",
    "softmax": f"""
        WITH logits AS (SELECT doc_id, [n_chars / 7e0, (doc_id % 13) * 40e0, -length(source)::DOUBLE] AS l FROM documents),
        raised AS (SELECT doc_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM logits)
        SELECT doc_id, {', '.join(f'round(e[{i}] / list_sum(e), 9) AS {c}' for i, c in enumerate(('negative', 'neutral', 'positive'), 1))}
        FROM raised""",
    "clean_text": f"SELECT doc_id, md5({_clean('text')}) AS text_md5, length(c) AS combined_chars, "
                  f"sha256(c) AS text_key FROM (SELECT doc_id, text, "
                  f"{_clean(chr(40) + 'lang || chr(32) || source || chr(32) || text' + chr(41))} AS c "
                  "FROM documents)",
    "target": sql(f"SELECT Ticker, Date, Target, {rnd('fwd_return')} FROM market"),
    "target_distribution": sql("SELECT Target, count(*) AS n FROM market GROUP BY Target"),
    "score_profile": "SELECT event_type AS Ticker, count(*) AS items, count(s) AS scored, "
                     "round(avg(s), 9) AS mean, round(min(s), 9) AS lowest, round(max(s), 9) AS highest "
                     "FROM (SELECT *, least(value, 100e0) / 50e0 - 1e0 AS s FROM events) "
                     "GROUP BY event_type",
    "sentiment_coverage": sql("SELECT Ticker, count(*) AS days, count(sent_mean) AS days_with_sentiment "
                              "FROM flat GROUP BY Ticker"),
    "normalized_time": "SELECT event_id, round(least(greatest((hour(ts) + minute(ts) / 60e0 - 95e-1) "
                       "/ 65e-1, 0e0), 1e0), 9) AS normalized_time FROM events",
    "align_forward": _aligned_sql("(SELECT min(x.Date) FROM bars x WHERE x.Ticker = n.Ticker AND "
                                  "x.Date >= CAST(n.Time AS DATE))"),
    "align_exact": _aligned_sql("CAST(n.Time AS DATE)"),
    "market_sentiment_join": sql("SELECT Ticker, Date, Target, round(sent_mean, 9) AS sent_mean, "
                                 "round(sent_std, 9) AS sent_std, sent_min, sent_max, sent_count "
                                 "FROM flat"),
    "daily_sentiment": sql(f"SELECT Ticker, Date, sent_count, {rnd(*FLAT[:4], *MEANS)} FROM daily"),
    "intraday_sentiment": sql("""
        SELECT Ticker, Date, round(avg(sentiment_score), 9) AS sentiment_score_mean,
               round(stddev_samp(sentiment_score), 9) AS sentiment_score_std,
               count(sentiment_score) AS sentiment_score_count,
               round(avg(t), 9) AS normalized_time_mean, round(min(t), 9) AS normalized_time_min,
               round(max(t), 9) AS normalized_time_max
        FROM aligned_events GROUP BY Ticker, Date"""),
    "decay_exponential": _decay_sql("exp(-1e0 * (1e0 - t))"),
    "decay_linear": _decay_sql("least(greatest(1e0 - (1e0 - t), 0e0), 1e0)"),
    "decay_custom": _decay_sql("t * t"),
    "decay_variance": sql("SELECT Ticker, Date, round(sum(w * (sentiment_score - mu) ** 2) / sum(w), 9) "
                          "AS sent_decay_var FROM centered GROUP BY Ticker, Date",
                          weighted="SELECT *, least(greatest(1e0 - 8e-1 * (1e0 - t), 0e0), 1e0) AS w "
                                   "FROM aligned_events",
                          centered="SELECT *, sum(w * sentiment_score) OVER p / sum(w) OVER p AS mu "
                                   "FROM weighted WINDOW p AS (PARTITION BY Ticker, Date)"),
    "half_life_memory": sql(
        "SELECT Ticker, Date, round(sent_mean, 9) AS sent_mean, round(m, 9) AS sentiment_memory "
        "FROM memory3",
        memory3="SELECT Ticker, Date, rn, sent_mean, sent_mean AS m FROM n_means WHERE rn = 1 UNION ALL "
                "SELECT d.Ticker, d.Date, d.rn, d.sent_mean, (1 - pow(5e-1, 1 / 3e0)) * d.sent_mean "
                "+ pow(5e-1, d.gap / 3e0) * x.m FROM memory3 x JOIN n_means d "
                "ON d.Ticker = x.Ticker AND d.rn = x.rn + 1"),
    "memory_increment": sql(
        "SELECT Ticker, max(Date) AS Date, round(arg_max(m, Date), 9) AS sentiment_memory FROM memory3 GROUP BY Ticker",
        memory3="SELECT Ticker, Date, rn, sent_mean, sent_mean AS m FROM n_means WHERE rn = 1 UNION ALL "
                "SELECT d.Ticker, d.Date, d.rn, d.sent_mean, (1 - pow(5e-1, 1 / 3e0)) * d.sent_mean "
                "+ pow(5e-1, d.gap / 3e0) * x.m FROM memory3 x JOIN n_means d "
                "ON d.Ticker = x.Ticker AND d.rn = x.rn + 1"),
    "returns": sql(f"SELECT Ticker, Date, {rnd(*RETURNS)} FROM bars_tech"),
    "volatility": sql(f"SELECT Ticker, Date, {rnd('return_1d', 'volatility')} FROM bars_tech"),
    "rsi": sql(f"SELECT Ticker, Date, {rnd('RSI')} FROM bars_tech"),
    "macd": sql(f"SELECT Ticker, Date, {rnd('MACD', 'MACD_signal', 'MACD_diff')} FROM bars_tech"),
    "ema": sql(f"SELECT Ticker, Date, {rnd('EMA_12', 'EMA_26')} FROM bars_tech"),
    "momentum": sql(f"SELECT Ticker, Date, {rnd('Momentum')} FROM bars_tech"),
    "technical_features": sql(f"SELECT Ticker, Date, {rnd(*TECHNICAL)} FROM bars_tech"),
    "sentiment_lags": sql("SELECT Ticker, Date, " + rnd(*[f"sent_mean_lag{k}" for k in (1, 2, 3)])
                          + ", sent_count_lag1, sent_count_lag2, sent_count_lag3 FROM flat_features"),
    "sentiment_momentum": sql(f"SELECT Ticker, Date, {rnd('sent_momentum')} FROM flat_features"),
    "sentiment_volatility": sql(f"SELECT Ticker, Date, {rnd('sent_volatility')} FROM flat_features"),
    "sentiment_features_flat": sql(
        "SELECT Ticker, Date, sent_count_lag1, sent_count_lag2, sent_count_lag3, "
        + rnd(*[c for c in _made(FLAT) if not c.startswith("sent_count")]) + " FROM flat_features"),
    "sentiment_features_decay": sql(
        f"SELECT Ticker, Date, {rnd(*_made(DECAY))} FROM decay_features"),
    "feature_fill": sql(
        f"SELECT Ticker, Date, {_filled(['sent_mean', 'sent_std', 'sent_count', 'positive_mean'])}, "
        f"round(coalesce(Momentum, 0), 9) AS Momentum FROM momentum_rows",
        momentum_rows=f"SELECT *, Close / lag(Close, 10) {_W} - 1 AS Momentum FROM flat"),
    "features_baseline": sql(f"SELECT Ticker, Date, Target, {_filled(TECHNICAL)} FROM market_tech"),
    "features_flat": sql(
        f"SELECT Ticker, Date, Target, {_filled([*TECHNICAL, *FLAT, *MEANS, *_made(FLAT)])} FROM joined",
        joined="SELECT t.*, f.* EXCLUDE (Ticker, Date, Open, High, Low, Close, Volume, nxt, Target, "
               "fwd_return) FROM market_tech t JOIN flat_features f "
               "ON f.Ticker = t.Ticker AND f.Date = t.Date"),
    "features_decay": sql(
        "SELECT Ticker, Date, Target, "
        + _filled([*TECHNICAL, *DECAY, "sent_flat_mean", "sent_std", "sent_count", *_made(DECAY)])
        + " FROM joined",
        joined="SELECT t.*, f.* EXCLUDE (Ticker, Date, Open, High, Low, Close, Volume, nxt, Target, "
               "fwd_return) FROM market_tech t JOIN decay_features f "
               "ON f.Ticker = t.Ticker AND f.Date = t.Date"),
    "model_matrix": sql(
        f"SELECT Ticker, Date, Target, {rnd('log_return_1d', 'log_return_5d', 'log_return_10d')} "
        "FROM market_tech WHERE log_return_1d IS NOT NULL AND log_return_5d IS NOT NULL "
        "AND log_return_10d IS NOT NULL"),
    "rolling_folds": sql("SELECT fold, role, Date, day_idx FROM fold_days", fold_source=BARS_OF_LINES),
    "fold_standardize": sql(
        "SELECT fold, role, Ticker, Date, "
        + ", ".join(f"round(({c} - {c}_m) / {c}_s, 9) AS {c}" for c in FEATURES) + " FROM stats",
        fold_source="SELECT Date FROM complete",
        stats=f"SELECT fold, role, r.*, {_fold_stats} FROM complete r "
              "JOIN fold_days f ON f.Date = r.Date", **ROWS),
    "cv_logistic_keys": sql(
        "SELECT f.fold, r.Ticker, r.Date, CAST(r.Target AS INTEGER) AS y_true, 1 AS sound FROM complete r "
        "JOIN fold_days f ON f.Date = r.Date WHERE f.role = 'test'",
        fold_source="SELECT Date FROM complete", **ROWS),
    "cv_gbt_keys": sql(
        "SELECT f.fold, r.Ticker, r.Date, CAST(r.Target AS INTEGER) AS y_true, 1 AS sound FROM complete r "
        "JOIN fold_days f ON f.Date = r.Date WHERE f.role = 'test'",
        fold_source="SELECT Date FROM complete", **ROWS),
    "tree_attribution_sums": sql(
        "SELECT f.fold, r.Ticker, r.Date, 4 AS n_features, 1 AS sound FROM complete r "
        "JOIN fold_days f ON f.Date = r.Date WHERE f.role = 'test'",
        fold_source="SELECT Date FROM complete", **ROWS),
    "logistic_gradient": sql(
        "SELECT f.fold, count(*) AS n_train, CAST(0.0 AS DOUBLE) AS gradient FROM complete r "
        "JOIN fold_days f ON f.Date = r.Date WHERE f.role = 'train' GROUP BY f.fold",
        fold_source="SELECT Date FROM complete", **ROWS),
    "score_model_totals": sql("SELECT doc_id, CAST(1.0 AS DOUBLE) AS total FROM documents"),
    "classification_metrics": sql(
        f"SELECT {SAMPLE_KEYS}, {rnd(*_ORDER_METRICS)}, "
        + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in
                    ("true_positive", "true_negative", "false_positive", "false_negative"))
        + " FROM classes", **RULES),
    "auc_rank": sql("SELECT variant, model_type, round((sum(CASE WHEN y_true = 1 THEN r_all ELSE 0 END) "
                    "- sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * (count(*) - sum(y_true))), "
                    "9) AS auc FROM ranked GROUP BY variant, model_type", **RULES),
    "cv_metrics": sql(f"SELECT variant, model_type, {_over(_ORDER_METRICS)} FROM classes "
                      "GROUP BY variant, model_type", **RULES),
    "strategy_returns": sql(f"SELECT {SAMPLE_KEYS}, Ticker, Date, {rnd('position', 'cost', 'net_return')}"
                            " FROM paths", **RULES),
    "equity_curve": sql(f"SELECT {SAMPLE_KEYS}, Date, {rnd('net_return', 'cum_return')} FROM equity",
                        **RULES),
    "drawdown": sql(f"SELECT {SAMPLE_KEYS}, Date, {rnd('cum_return', 'drawdown')} FROM falls", **RULES),
    "sharpe": sql(f"SELECT {SAMPLE_KEYS}, {rnd('sharpe_ratio')} FROM trades", **RULES),
    "trading_metrics": sql(f"SELECT {SAMPLE_KEYS}, {rnd(*_TRADE_METRICS)} FROM trades", **RULES),
    "trading_metrics_cv": sql(f"SELECT variant, model_type, {_over(_TRADE_METRICS)} FROM trades "
                              "GROUP BY variant, model_type", **RULES),
    "rule_comparison": sql(
        "SELECT variant, model_type, Model_ AS \"Model\", "
        + rnd(*[f"{n}_{x}" for n in _ORDER_METRICS + _TRADE_METRICS for x in ("mean", "std")])
        + " FROM compared", **COMPARISON),
    "key_findings": sql(
        "SELECT arg_max(Model_, sharpe_ratio_mean) AS best_model, "
        "round(max(sharpe_ratio_mean), 9) AS best_sharpe, "
        "round((max(auc_mean) FILTER (Model_ = 'Decay Sentiment') - max(auc_mean) FILTER "
        "(Model_ = 'Baseline')) / max(auc_mean) FILTER (Model_ = 'Baseline') * 100, 9) "
        "AS auc_improvement_pct FROM compared", **COMPARISON),
    "decay_grid": sql("SELECT c.*, count(*) AS days, "
                      "round(avg(coalesce(sent_decay_mean, sentiment_memory)), 9) AS mean_signal "
                      "FROM configs c JOIN e_daily d USING (config_id) GROUP BY ALL"),
    "sweep_features": sql(
        "SELECT c.config_id, b.Ticker, b.Date, round(b.Close, 9) AS Close, sent_count, "
        + rnd("sent_decay_mean", "sent_decay_var", "sent_flat_mean", "sent_std", "sent_mean",
              "sentiment_memory")
        + " FROM configs c CROSS JOIN event_bars b LEFT JOIN e_daily d ON d.config_id = c.config_id "
          "AND d.Ticker = b.Ticker AND d.Date = b.Date"),
    "grid_summary": sql(
        "SELECT c.*, (SELECT count(DISTINCT fold) FROM fold_days) AS n_folds FROM configs c", **RULES),
    "best_config": sql(
        "SELECT c.*, round(m, 9) AS metric_value FROM (SELECT config_id, "
        "corr(coalesce(sent_decay_mean, sentiment_memory), Target) AS m FROM n_daily d JOIN market k "
        "ON k.Ticker = d.Ticker AND k.Date = d.Date GROUP BY config_id) q JOIN configs c "
        "USING (config_id) ORDER BY m DESC, config_id LIMIT 1"),
    "score_from_probs": sql("SELECT o_orderkey, positive - negative AS sentiment_score "
                            "FROM scored_news"),
    "score_lexicon": f"""
        SELECT doc_id, round((n + 1) / (total + 3e0), 9) AS negative,
               round((total - p - n + 1) / (total + 3e0), 9) AS neutral,
               round((p + 1) / (total + 3e0), 9) AS positive,
               round((p + 1) / (total + 3e0) - (n + 1) / (total + 3e0), 9) AS sentiment_score
        FROM (SELECT doc_id, len(words) AS total, {_words(POSITIVE_WORDS)} AS p,
                     {_words(NEGATIVE_WORDS)} AS n
              FROM (SELECT doc_id, {_TOKENS} AS words FROM documents))""",
    "score_batch": f"""
        SELECT doc_id, round((n + 1) / (total + 3e0), 9) AS negative,
               round((total - p - n + 1) / (total + 3e0), 9) AS neutral,
               round((p + 1) / (total + 3e0), 9) AS positive,
               round((p + 1) / (total + 3e0) - (n + 1) / (total + 3e0), 9) AS sentiment_score
        FROM (SELECT doc_id, len(words) AS total, {_words(POSITIVE_WORDS)} AS p,
                     {_words(NEGATIVE_WORDS)} AS n
              FROM (SELECT doc_id, {_TOKENS} AS words
                    FROM (SELECT doc_id, lang || ' ' || source || ' ' || text AS text
                          FROM documents)))""",
    "linear_attribution": sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(avg(abs(b * ({c} - m))), 9) AS importance FROM complete, "
            f"(SELECT regr_slope(Target, {c}) AS b, avg({c}) AS m FROM complete)" for c in FEATURES),
        **ROWS),
    "importance_compare": sql(
        "SELECT feature, round(coalesce(t.importance, 0), 9) AS baseline_importance, "
        "round(coalesce(s.importance, 0), 9) AS sentiment_importance, "
        "round(coalesce(s.importance, 0) - coalesce(t.importance, 0), 9) AS importance_change "
        "FROM technical_importance t FULL JOIN sentiment_importance_rows s USING (feature)",
        **IMPORTANCE),
    "top_features": sql(
        "SELECT feature, round(importance, 9) AS importance FROM (SELECT * FROM technical_importance "
        "UNION ALL SELECT * FROM sentiment_importance_rows WHERE feature NOT IN "
        "(SELECT feature FROM technical_importance)) ORDER BY importance DESC, feature LIMIT 5",
        **IMPORTANCE),
    "score_histogram": """
        SELECT CAST(bin AS INTEGER) AS bin, round(any_value(lo + (bin - 1) * (hi - lo) / 50), 9)
               AS bin_left, count(*) AS n
        FROM (SELECT lo, hi, least(50, floor((s - lo) / (hi - lo) * 50) + 1) AS bin
              FROM (SELECT s, min(s) OVER () AS lo, max(s) OVER () AS hi
                    FROM (SELECT least(value, 100e0) / 50e0 - 1e0 AS s FROM events)))
        GROUP BY bin""",
    "score_boxplot": """
        SELECT Ticker, round(any_value(q1), 9) AS q1, round(any_value(q2), 9) AS median,
               round(any_value(q3), 9) AS q3,
               round(min(s) FILTER (s >= q1 - 15e-1 * (q3 - q1)), 9) AS whisker_low,
               round(max(s) FILTER (s <= q3 + 15e-1 * (q3 - q1)), 9) AS whisker_high,
               CAST(count(*) FILTER (s < q1 - 15e-1 * (q3 - q1) OR s > q3 + 15e-1 * (q3 - q1))
                    AS BIGINT) AS outliers
        FROM (SELECT *, quantile_cont(s, 25e-2) OVER p AS q1, quantile_cont(s, 5e-1) OVER p AS q2,
                     quantile_cont(s, 75e-2) OVER p AS q3
              FROM (SELECT event_type AS Ticker, least(value, 100e0) / 50e0 - 1e0 AS s FROM events)
              WINDOW p AS (PARTITION BY Ticker))
        GROUP BY Ticker""",
}

# the same results, batched or taken in otherwise
ORACLE_SQL["decay_increment"] = ORACLE_SQL["decay_exponential"]
ORACLE_SQL["score_budget"] = ORACLE_SQL["score_batch"]
