"""Security codes, exchanges and price limits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = r"^[0-9]{6}$"
#: Regular listings by exchange.
LISTED = {"SSE": r"^(600|601|603|605|688|689)[0-9]{3}$", "SZSE": r"^(000|001|002|003|300|301)[0-9]{3}$", "BSE": r"^(4|8|920)[0-9]+$"}


def normalize_code(c: Column) -> Column:
    """Six digits: a trailing ".0" goes, zeros fill up from the left; NULL if that gives no code."""
    bare = F.lpad(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), 6, "0")
    return F.when((F.length(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")) <= 6) & bare.rlike(CODE), bare)


def is_code(c: Column) -> Column:
    return F.coalesce(c.rlike(CODE), F.lit(False))


def exchange_prefix(c: Column) -> Column:
    return F.when(c.rlike("^[569]"), F.lit("sh")).otherwise(F.lit("sz"))


def exchange_suffix(c: Column) -> Column:
    return F.concat(c, F.when(c.rlike("^[569]"), F.lit(".SH")).otherwise(F.lit(".SZ")))


def is_special_treatment(name: Column) -> Column:
    return F.coalesce(F.upper(name).rlike(r"\*?ST"), F.lit(False))


def limit_rate(code: Column, special: Column) -> Column:
    """The daily price limit: special treatment over the board's rule over the default."""
    return F.when(special, F.lit(0.05)).when(code.rlike("^(300|301|688)"), F.lit(0.20)).when(code.rlike("^[84]"), F.lit(0.30)).otherwise(F.lit(0.10))


def sampling_key(code: Column, seed: int) -> Column:
    """A salted digest that orders securities the same way whatever their input order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), code), 256)
