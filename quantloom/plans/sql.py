"""The SQL forms of the shared relations, for DuckDB. with_() puts those that a query names, and what they need, before it."""

from __future__ import annotations

import re

HORIZONS = (1, 5, 10, 20, 40)
FACTORS = ("momentum_20", "momentum_60", "volatility_20", "volatility_60", "volume_change_20")
CORR = "CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def rank(c: str, keys: str) -> str:
    """Average rank of c within keys."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0)"


def _long(value: str, source: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT date, stock, factor_name, {extra}{value} AS x, {h} AS period, forward_return_{h}d AS y FROM {source} WHERE {value} IS NOT NULL AND forward_return_{h}d IS NOT NULL" for h in HORIZONS)


def ic(pairs: str, extra: str = "") -> str:
    keys = f"date, factor_name, period{extra}"
    return f"""SELECT {keys}, count(*) AS n, round({CORR.format(x="x", y="y")}, 12) AS ic, round({CORR.format(x="rx", y="ry")}, 12) AS rank_ic
      FROM (SELECT *, {rank("x", keys)} AS rx, {rank("y", keys)} AS ry FROM {pairs}) GROUP BY {keys}
      HAVING count(*) >= 2 AND max(x) > min(x) AND max(y) > min(y)"""


SUMMARY = """avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, stddev_samp(ic) AS ic_std, stddev_samp(rank_ic) AS rank_ic_std,
  CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) ELSE 0.0 END AS icir,
  CASE WHEN stddev_samp(rank_ic) > 1e-12 THEN avg(rank_ic) / stddev_samp(rank_ic) ELSE 0.0 END AS rank_icir,
  avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ic_ratio,
  CASE WHEN stddev_samp(rank_ic) > 1e-12 THEN avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(rank_ic))) ELSE 0.0 END AS t_stat, count(rank_ic) AS observations"""


def fold_dates(train: int, test: int, least: int) -> str:
    return f"""SELECT f.fold, a.date AS train_start, b.date AS train_end, f.test_start, f.test_end FROM (
      SELECT CAST(floor((i - {least}) / {float(test)}) AS INTEGER) AS fold, min(date) AS test_start, max(date) AS test_end, min(i) AS first FROM calendar WHERE i >= {least} GROUP BY 1) f
      JOIN calendar a ON a.i = greatest(0, f.first - {train}) JOIN calendar b ON b.i = f.first - 1 WHERE b.i - a.i + 1 >= {least}"""


CTE: dict[str, str] = {
    "days": "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(l_shipdate AS DATE) AS day, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, sum(CAST(round(l_quantity) AS BIGINT)) AS q, max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS l FROM lineitem GROUP BY ALL",
    "panel": "SELECT date, stock, 100000.0 + CAST(arg_min(c, day) AS DOUBLE) / 100.0 / CAST(arg_min(q, day) AS DOUBLE) AS open, 100000.0 + max(h) AS high, 100000.0 + min(l) AS low, 100000.0 + CAST(sum(c) AS DOUBLE) / 100.0 / CAST(sum(q) AS DOUBLE) AS close, CAST(sum(q) AS DOUBLE) AS volume, CAST(sum(c) AS DOUBLE) / 100.0 AS amount FROM days GROUP BY date, stock",
    "returns": "SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS r FROM panel",
    "tech": """SELECT date, stock, close, volume, amount, close / lag(close, 20) OVER w - 1 AS momentum_20, close / lag(close, 60) OVER w - 1 AS momentum_60,
      CASE WHEN count(r) OVER v20 = 20 THEN stddev_samp(r) OVER v20 END AS volatility_20, CASE WHEN count(r) OVER v60 = 60 THEN stddev_samp(r) OVER v60 END AS volatility_60,
      CASE WHEN count(volume) OVER v20 = 20 THEN volume / avg(volume) OVER v20 END AS volume_change_20, """ + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS forward_return_{h}d" for h in HORIZONS) + """
      FROM returns WINDOW w AS (PARTITION BY stock ORDER BY date), v20 AS (PARTITION BY stock ORDER BY date ROWS 19 PRECEDING), v60 AS (PARTITION BY stock ORDER BY date ROWS 59 PRECEDING)""",
    "long": " UNION ALL ".join(f"SELECT date, stock, '{f}' AS factor_name, {f} AS factor_value, forward_return_5d AS \"return\", " + ", ".join(f"forward_return_{h}d" for h in HORIZONS) + f" FROM tech WHERE {f} IS NOT NULL AND forward_return_5d IS NOT NULL" for f in FACTORS),
    "bounds": "SELECT date, factor_name, quantile_cont(factor_value, 0.01) AS lo, quantile_cont(factor_value, 0.99) AS hi FROM long GROUP BY date, factor_name",
    "winsor": "SELECT long.*, least(greatest(factor_value, lo), hi) AS winsorized_value FROM long JOIN bounds USING (date, factor_name)",
    "prep": """SELECT *, CASE WHEN factor_name LIKE 'volatility%' THEN -normalized_value ELSE normalized_value END AS directed_value FROM (
      SELECT *, CASE WHEN stddev_pop(winsorized_value) OVER k > 1e-12 THEN round((winsorized_value - avg(winsorized_value) OVER k) / stddev_pop(winsorized_value) OVER k, 12) ELSE 0.0 END AS normalized_value FROM winsor WINDOW k AS (PARTITION BY date, factor_name))""",
    "pairs": _long("directed_value", "prep"),
    "raw_pairs": _long("factor_value", "long"),
    "ics": ic("pairs"),
    "raw_ics": ic("raw_pairs"),
    "calendar": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM long)",
    "expo": "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock, CAST(s_nationkey AS VARCHAR) AS industry, s_acctbal AS market_cap FROM supplier",
    "master": "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock, min(CAST(date_trunc('week', l_shipdate) AS DATE)) AS listing_date, CASE WHEN l_suppkey % 7 = 0 THEN min(CAST(date_trunc('week', l_shipdate) AS DATE)) + 2000 END AS delisting_date FROM lineitem GROUP BY l_suppkey",
    "reports": """SELECT stock, report_period, report_period + 45 AS announcement_date, CAST(c AS DOUBLE) / CAST(q AS DOUBLE) / 1000.0 - 15.0 AS pe, CAST(q AS DOUBLE) / CAST(n AS DOUBLE) / 10.0 AS pb, CAST(d AS DOUBLE) / CAST(n AS DOUBLE) / 100.0 AS roe FROM (
      SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS stock, CAST(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 3 MONTH AS DATE) - 1 AS report_period, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_quantity) AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY ALL)""",
    "membership": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock, DATE '1995-06-05' AS effective_date, DATE '1998-12-28' AS end_date FROM supplier WHERE s_nationkey % 2 = 0
      UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), DATE '1999-01-04', NULL FROM supplier WHERE s_nationkey % 3 = 0""",
    "bench": "SELECT date, avg(r) AS benchmark_return FROM returns GROUP BY date",
    "ages": "SELECT *, row_number() OVER (PARTITION BY stock ORDER BY date) AS trading_age, CASE WHEN count(amount) OVER v = 20 THEN avg(amount) OVER v END AS adv20 FROM panel WINDOW v AS (PARTITION BY stock ORDER BY date ROWS 19 PRECEDING)",
    "universe": "SELECT date, stock, trading_age, adv20 FROM ages WHERE close IS NOT NULL AND volume IS NOT NULL AND trading_age >= 120 AND volume > 0 AND adv20 >= 20000",
    "quant": """SELECT date, factor_name, avg(CASE WHEN q = 1 THEN y END) AS q1, avg(CASE WHEN q = 2 THEN y END) AS q2, avg(CASE WHEN q = 3 THEN y END) AS q3, avg(CASE WHEN q = 4 THEN y END) AS q4, avg(CASE WHEN q = 5 THEN y END) AS q5,
      avg(CASE WHEN q = 5 THEN y END) - avg(CASE WHEN q = 1 THEN y END) AS spread FROM (
      SELECT date, factor_name, y, CAST(greatest(1, least(5, ceil(row_number() OVER (PARTITION BY date, factor_name ORDER BY x, stock) * 1.0 / count(*) OVER (PARTITION BY date, factor_name) * 5))) AS INTEGER) AS q FROM pairs WHERE period = 5) GROUP BY date, factor_name""",
    "groups": """SELECT date, factor_name, avg(CASE WHEN i <= k THEN y END) AS top_return, avg(CASE WHEN i > n - k THEN y END) AS bottom_return, avg(CASE WHEN i <= k THEN y END) - avg(CASE WHEN i > n - k THEN y END) AS long_short FROM (
      SELECT *, greatest(1, ceil(n * CAST(0.3 AS DOUBLE))) AS k FROM (SELECT date, factor_name, forward_return_5d AS y, row_number() OVER (PARTITION BY date, factor_name ORDER BY factor_value DESC NULLS LAST, stock) AS i, count(*) OVER (PARTITION BY date, factor_name) AS n FROM long)) GROUP BY date, factor_name""",
    "fcorr": f"""SELECT date, factor_a, factor_b, count(*) AS n, {CORR.format(x="x", y="y")} AS pearson, {CORR.format(x="rx", y="ry")} AS spearman FROM (
      SELECT *, {rank("x", "date, factor_a, factor_b")} AS rx, {rank("y", "date, factor_a, factor_b")} AS ry FROM (
      SELECT a.date, a.factor_name AS factor_a, b.factor_name AS factor_b, a.factor_value AS x, b.factor_value AS y FROM long a JOIN long b ON a.date = b.date AND a.stock = b.stock AND a.factor_name < b.factor_name)) GROUP BY date, factor_a, factor_b""",
    "folds": fold_dates(156, 26, 104),
    "fold_weights": """SELECT fold, method, factor_name, CASE WHEN sum(abs(s)) OVER k <= 1e-12 THEN 1.0 / count(*) OVER k ELSE s / sum(abs(s)) OVER k END AS weight FROM (
      SELECT fold, factor_name, method, CASE method WHEN 'equal_weight' THEN 1.0 WHEN 'static_weight' THEN 1.0 WHEN 'rolling_ic_weight' THEN coalesce(m, 0.0) ELSE CASE WHEN d > 1e-12 THEN coalesce(m / d, 0.0) ELSE 0.0 END END AS s FROM (
        SELECT fold, factor_name, avg(ic) AS m, stddev_samp(ic) AS d FROM ics JOIN folds ON date BETWEEN train_start AND train_end WHERE period = 1 GROUP BY fold, factor_name)
      CROSS JOIN (VALUES ('equal_weight'), ('static_weight'), ('rolling_ic_weight'), ('rolling_icir_weight')) t(method)) WINDOW k AS (PARTITION BY fold, method)""",
    "wf_scored": "SELECT p.fold, w.method, p.date, p.stock, sum(w.weight * p.directed_value) AS score, max(p.forward_return_1d) AS r FROM (SELECT prep.*, fold FROM prep JOIN folds ON date BETWEEN test_start AND test_end) p JOIN fold_weights w ON p.fold = w.fold AND p.factor_name = w.factor_name GROUP BY p.fold, w.method, p.date, p.stock HAVING score IS NOT NULL AND r IS NOT NULL",
    "wf_held": "SELECT *, score >= quantile_cont(score, 0.8) OVER (PARTITION BY fold, method, date) AS held FROM wf_scored",
    "wf_days": "SELECT fold, method, date, avg(CASE WHEN held THEN r END) AS gross, avg(r) AS benchmark, list(stock) FILTER (WHERE held) AS holding FROM wf_held GROUP BY fold, method, date",
    "wf_daily": """SELECT fold, method, date, gross, benchmark, turnover, turnover * 0.001 AS cost, gross - turnover * 0.001 AS net FROM (
      SELECT *, CASE WHEN p IS NULL THEN 1.0 ELSE CAST(len(holding) + len(p) - 2 * len(list_intersect(holding, p)) AS DOUBLE) / greatest(len(holding) + len(p), 1) END AS turnover FROM (
      SELECT *, lag(holding) OVER (PARTITION BY fold, method ORDER BY date) AS p FROM wf_days))""",
    "wf_equity": "SELECT *, product(1 + net) OVER (PARTITION BY fold, method ORDER BY date) AS equity FROM wf_daily",
    "wf_curve": "SELECT *, equity / max(equity) OVER (PARTITION BY fold, method ORDER BY date) - 1 AS drawdown FROM wf_equity",
}


def with_(query: str) -> str:
    """query with the relations it names."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if name not in used and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(CTE[name])
                if name not in used:
                    used.append(name)

    need(query)
    own = query.removeprefix("WITH ")
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in used) + (",\n" if own != query else "\n") if used else query[: len(query) - len(own)]) + own
