"""Reports from small result frames: markdown, JSON and plot-ready tables."""

from __future__ import annotations

import json
import math
import re
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import two_sided_p
from quantloom.operators.metrics import with_drawdown


def rows(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """A result's rows on the driver; more than `limit` is no report."""
    out = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(out) > limit:
        raise ValueError(f"more than {limit} rows")
    return out


def cell(x) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "N/A"
    return f"{x:.4f}" if isinstance(x, float) else str(x)


def markdown(table: list[dict]) -> str:
    if not table:
        return "(no rows)\n"
    names = list(table[0])
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in table)]) + "\n"


def with_p_value(table: list[dict], t: str = "t_stat") -> list[dict]:
    return [r | {"p_value": two_sided_p(r[t])} for r in table]


def strength(icir: float | None) -> str:
    """How strong a factor is by its ICIR's size."""
    size = abs(icir or 0.0)
    return "Strong" if size >= 0.5 else "Medium" if size >= 0.2 else "Weak"


def document(title: str, sections: dict[str, list[dict] | str]) -> str:
    """Markdown with a heading and a table or text for each section."""
    out = [f"# {title}\n"]
    for name, body in sections.items():
        out += [f"## {name}\n", body if isinstance(body, str) else markdown(body)]
    return "\n".join(out) + "\n"


def factor_json(table: list[dict]) -> str:
    """Factors by score with their place; numbers at four digits."""
    ranked = sorted(table, key=lambda r: (-(r.get("factor_score") or 0.0), r["factor_name"]))
    show = lambda x: round(x, 4) if isinstance(x, float) else x.isoformat() if isinstance(x, date) else x
    return json.dumps([{"rank": i, **{k: show(v) for k, v in r.items()}} for i, r in enumerate(ranked, 1)], ensure_ascii=False, indent=2)


def metrics_from_markdown(text: str) -> dict[str, float]:
    """Numbers of "name: value" and "| name | value |" lines; percents as fractions."""
    out = {}
    for m in re.finditer(r"^[-|*\s]*([A-Za-z][\w /-]*?)\**\s*[:|]\s*\**(-?\d+(?:\.\d+)?)\s*(%?)", text, re.M):
        out[m[1].strip()] = float(m[2]) / (100 if m[3] else 1)
    return out


def report_text(path: str) -> str:
    """A report's text, empty if there is none."""
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.is_file() else ""


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """A result as files: parquet, or csv with a header."""
    df.write.mode("overwrite").option("header", True).format(format).save(path)


def curves(daily: DataFrame, r: str, *keys: str) -> DataFrame:
    """Plot-ready: date, equity and drawdown of a return series."""
    return with_drawdown(daily, r, *keys).select(*keys, "date", "equity", "drawdown")


def heatmap(correlation: DataFrame, value: str = "mean_spearman") -> DataFrame:
    """Plot-ready: both triangles and the diagonal of a factor correlation table."""
    a = correlation.select("factor_a", "factor_b", F.col(value).alias("value"))
    names = a.select(F.col("factor_a").alias("f")).union(a.select("factor_b")).distinct()
    return a.union(a.select("factor_b", "factor_a", "value")).union(names.select("f", "f", F.lit(1.0)))


def stock_report(scores: dict) -> str:
    """Markdown of evaluate_stock()."""
    parts = ("technical_score", "value_score", "quality_score") if "technical_score" in scores else ("momentum_score", "volatility_score", "volume_score")
    sources = "\n".join(f"{k}: {scores[n]}" for k, n in (("Market", "data_source"), ("Financial", "financial_data_source")) if n in scores)
    return document(f"Stock {scores['stock']}", {"Factor scores": [{"score": n, "value": scores[n]} for n in parts], "Final score": f"**{scores['final_score']:.2f} / 100**\n", "Data source": sources + "\n"})


def backtest_report(metrics: dict, rules: dict) -> str:
    """Markdown of a backtest: its rules, returns and risks."""
    percent = ("total_return", "benchmark_return", "alpha", "annual_return", "win_rate")
    return document("Backtest", {"Portfolio rules": [{"rule": k, "value": v} for k, v in rules.items()], "Returns": "\n".join(f"- {n}: {metrics[n]:.2%}" for n in percent) + "\n", "Risks": f"- sharpe_ratio: {metrics['sharpe_ratio']:.4f}\n- max_drawdown: {metrics['max_drawdown']:.2%}\n- information_ratio: {metrics['information_ratio']:.4f}\n"})


def quality_json(quality: dict) -> str:
    """data_quality() as JSON."""
    return json.dumps(quality, ensure_ascii=False, indent=2, default=str)
