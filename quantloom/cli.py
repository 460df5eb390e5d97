"""Command line: evaluate a factor table, generate one from prices, or score stocks."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from quantloom.operators import correlation, factors, ic, preprocess, quantile, scoring
from quantloom.plans import report
from quantloom.sources import ingest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("evaluate", "generate", "score"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--factors", help="names, separated by commas")
    return p


def evaluate(spark: SparkSession, path: str, out: str, names: list[str] | None) -> dict[str, str]:
    """Writes a JSON summary and a markdown report of a factor table; returns their paths."""
    df = ingest.read_factors(spark, path, names)
    df = df.withColumn("forward_return_5d", df["return"]) if "forward_return_5d" not in df.columns else df
    summary = report.rows(scoring.factor_score(scoring.factor_summary(df)))
    prepared = preprocess.with_direction(preprocess.preprocess_factors(df))
    sections: dict = {"Factors": summary, "Information coefficients": report.with_p_value(report.rows(ic.ic_summary(ic.daily_ic(prepared, "directed_value"), "factor_name")))}
    sections["Quantiles"] = report.rows(quantile.quantile_monotonicity(quantile.quantile_returns(prepared, "directed_value", "forward_return_5d"), 5, "factor_name"))
    if len(summary) > 1:
        sections["Correlations"] = report.rows(correlation.average_factor_correlation(correlation.daily_factor_correlation(df, [r["factor_name"] for r in summary])))
    Path(out).mkdir(parents=True, exist_ok=True)
    paths = {"json": f"{out}/factor_summary.json", "markdown": f"{out}/factor_report.md"}
    Path(paths["json"]).write_text(report.factor_json(summary), encoding="utf-8")
    Path(paths["markdown"]).write_text(report.document("Factor report", sections), encoding="utf-8")
    return paths


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    names = args.factors.split(",") if args.factors else None
    if args.command == "evaluate":
        evaluate(spark, args.input, args.output, names)
    elif args.command == "generate":
        wide = factors.technical_factors(ingest.read_prices(spark, args.input))
        report.write_table(factors.to_long(wide, tuple(names or factors.TECHNICAL)), args.output, "csv")
    else:
        report.write_table(scoring.stock_scores(ingest.read_factors(spark, args.input, names)), args.output, "csv")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
