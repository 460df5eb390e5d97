"""Investable universes: eligibility by history, security master and index membership; trade constraints."""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.codes import CODE, LISTED
from quantloom.functions.stats import rolling
from quantloom.schema import by_stock, require_columns


@dataclass(frozen=True)
class UniverseConfig:
    min_listing_days: int = 120
    exclude_st: bool = True
    exclude_suspended: bool = True
    min_adv20: float | None = None


@dataclass(frozen=True)
class UniverseMetadata:
    name: str
    source: str
    point_in_time: bool
    warnings: tuple[str, ...] = field(default_factory=tuple)


def eligible(history: DataFrame, config: UniverseConfig = UniverseConfig()) -> DataFrame:
    """Eligible rows of all dates at once, with trading_age and adv20 from each row's own past."""
    require_columns(history, ["date", "stock", "close", "volume"], "universe history")
    amount = F.col("amount") if "amount" in history.columns else F.col("close") * F.col("volume")
    df = history.withColumns({"trading_age": F.row_number().over(by_stock()).cast("long"), "adv20": rolling(F.avg, amount, by_stock(), 20)})
    df = df.where(F.col("close").isNotNull() & F.col("volume").isNotNull() & (F.col("trading_age") >= config.min_listing_days))
    flag = lambda c: ~F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    if config.exclude_suspended:
        df = df.where("volume > 0")
        df = df.where(flag("is_suspended")) if "is_suspended" in df.columns else df
    if config.exclude_st and "is_st" in df.columns:
        df = df.where(flag("is_st"))
    return df.where(F.col("adv20") >= config.min_adv20) if config.min_adv20 is not None else df


def active(panel: DataFrame, master: DataFrame, end_inclusive: bool = False) -> DataFrame:
    """Rows of securities that are listed on the day; a delisting day counts only if end_inclusive."""
    m = master.select(F.col("stock_code").alias("stock"), "listing_date", "delisting_date")
    on = F.col("date") >= F.col("listing_date")
    end = F.col("delisting_date") >= F.col("date") if end_inclusive else F.col("delisting_date") > F.col("date")
    return panel.join(m, "stock").where(on & (F.col("delisting_date").isNull() | end)).drop("listing_date", "delisting_date")


def members(panel: DataFrame, membership: DataFrame, name: str) -> DataFrame:
    """Rows of securities that belong to an index on the day; both ends of an interval count, overlapping intervals give a row once."""
    m = membership.where(F.col("universe_name") == name).select(F.col("stock").alias("_s"), "effective_date", "end_date")
    inside = (panel.stock == F.col("_s")) & (panel.date >= F.col("effective_date")) & (F.col("end_date").isNull() | (panel.date <= F.col("end_date")))
    return panel.join(m, inside, "left_semi")


def seasoned(panel: DataFrame, master: DataFrame, days: int = 120) -> DataFrame:
    """Rows from `days` calendar days after listing and before delisting."""
    m = master.select(F.col("stock_code").alias("stock"), "listing_date", "delisting_date")
    return panel.join(m, "stock").where((F.col("date") >= F.date_add("listing_date", days)) & (F.col("delisting_date").isNull() | (F.col("date") < F.col("delisting_date")))).drop("listing_date", "delisting_date")


def normalize_master(raw: DataFrame, exchange: str, source: str, code_columns=("stock_code", "code"), name_columns=("stock_name", "name"), listed_columns=("listing_date",), delisted_columns=("delisting_date",)) -> DataFrame:
    """Security-master rows of one exchange's regular listings, from whichever of the candidate columns are there."""
    pick = lambda names: next((F.col(c) for c in names if c in raw.columns), F.lit(None).cast("string"))
    code = F.lpad(F.regexp_extract(pick(code_columns).cast("string"), r"(\d{1,6})", 1), 6, "0")
    listed, gone = pick(listed_columns).try_cast("date"), pick(delisted_columns).try_cast("date")
    df = raw.select(code.alias("stock_code"), pick(name_columns).cast("string").alias("stock_name"), F.lit(exchange).alias("exchange"), listed.alias("listing_date"), gone.alias("delisting_date"))
    df = df.where(F.col("stock_code").rlike(CODE) & F.col("stock_code").rlike(LISTED[exchange]))
    return df.withColumns({"status": F.when(F.col("delisting_date").isNull(), "LISTED").otherwise("DELISTED"), "source": F.lit(source), "data_quality": F.when(F.col("listing_date").isNull(), "LOW").otherwise("HIGH")})


def merge_master(*parts: DataFrame) -> DataFrame:
    """One row a code; a delisted record wins."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    over = Window.partitionBy("stock_code").orderBy(F.col("delisting_date").isNull(), "exchange", "listing_date")
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


class UniverseProvider(ABC):
    """Gives the eligible rows of a history."""

    metadata: UniverseMetadata

    @abstractmethod
    def universe(self, history: DataFrame, name: str = "ALL_A") -> DataFrame: ...


class HistoricalUniverse(UniverseProvider):
    """All securities that the history holds, by the eligibility rules alone."""

    def __init__(self, config: UniverseConfig = UniverseConfig()) -> None:
        self.config, self.metadata = config, UniverseMetadata("ALL_A", "price_history", False, ("securities that left before the history began are missing",))

    def universe(self, history: DataFrame, name: str = "ALL_A") -> DataFrame:
        if name != "ALL_A":
            raise ValueError("only ALL_A can be built from price history")
        return eligible(history, self.config)


class SecurityMasterUniverse(UniverseProvider):
    """Eligible securities that the master lists on the day."""

    def __init__(self, master: DataFrame, config: UniverseConfig = UniverseConfig()) -> None:
        self.master, self.config, self.metadata = master, config, UniverseMetadata("ALL_A", "security_master", True)

    def universe(self, history: DataFrame, name: str = "ALL_A") -> DataFrame:
        return active(eligible(history, self.config), self.master)


class MembershipUniverse(UniverseProvider):
    """Eligible members of a named universe by dated intervals."""

    def __init__(self, membership: DataFrame, config: UniverseConfig = UniverseConfig()) -> None:
        require_columns(membership, ["stock", "universe_name", "effective_date", "end_date"], "membership")
        self.membership, self.config, self.metadata = membership, config, UniverseMetadata("membership", "intervals", True)

    def universe(self, history: DataFrame, name: str = "ALL_A") -> DataFrame:
        return members(eligible(history, self.config), self.membership, name)


class IndexUniverse(MembershipUniverse):
    """Index constituents only."""

    def universe(self, history: DataFrame, name: str = "") -> DataFrame:
        if name in ("", "ALL_A"):
            raise ValueError("an index name is needed")
        return super().universe(history, name)


class RemoteUniverse(UniverseProvider):
    """Current constituents from a remote source have no history: always refused."""

    metadata = UniverseMetadata("remote", "current_constituents", False)

    def universe(self, history: DataFrame, name: str = "ALL_A") -> DataFrame:
        raise NotImplementedError("current constituents give no point-in-time universe")


def eligible_or_all(history: DataFrame, provider: UniverseProvider, name: str = "ALL_A") -> DataFrame:
    """The provider's rows; a date for which it has none keeps all its rows."""
    found = provider.universe(history, name).select("date", "stock").distinct().withColumn("_in", F.lit(True))
    day = Window.partitionBy("date")
    joined = history.join(found, ["date", "stock"], "left").withColumn("_any", F.max(F.coalesce("_in", F.lit(False))).over(day))
    warnings.warn("dates without an eligible security keep all candidates", stacklevel=2)
    return joined.where("_in or not _any").drop("_in", "_any")


def constrain_trades(previous: DataFrame, target: DataFrame, state: DataFrame) -> DataFrame:
    """stock, weight after one rebalance: previous and target (stock, weight) meet in a full join; blocked trades keep the previous weight."""
    col = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in state.columns else F.lit(False)
    halted = col("is_suspended") | ((F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) <= 0) if "volume" in state.columns else F.lit(False))
    s = state.select("stock", halted.alias("halted"), col("limit_up").alias("up"), col("limit_down").alias("down"), col("is_st").alias("st"))
    both = previous.select("stock", F.col("weight").alias("p")).join(target.select("stock", F.col("weight").alias("t")), "stock", "full").join(s, "stock", "left").na.fill({"p": 0.0, "t": 0.0, "halted": False, "up": False, "down": False, "st": False})
    return both.select("stock", executed(F.col("p"), F.col("t"), F.col("halted"), F.col("up"), F.col("down"), F.col("st")).alias("weight"))


def executed(p, t, halted, up, down, st):
    """The weight after a trade from p to t."""
    return F.when((t > p) & (halted | up | st), p).when((t < p) & (halted | down), p).otherwise(t)
