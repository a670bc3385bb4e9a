"""Screen settings: defaults, validation, required history, load and save."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as K

SETTINGS_SCHEMA = (
    "config_id string, min_market_cap double, max_market_cap double, "
    "volume_multiplier double, price_avg_weeks int, ma_short int, "
    "ma_intermediate int, ma_medium int, ma_long int, avg_volume_weeks int, "
    "lookback_weeks int"
)


@dataclass(frozen=True)
class ScreenConfig:
    """One saved screen. Market caps are in millions; 0 disables a bound."""

    min_market_cap: float = 0.0
    max_market_cap: float = 0.0
    volume_multiplier: float = K.DEFAULT_VOLUME_MULTIPLIER
    price_avg_weeks: int = K.DEFAULT_PRICE_AVG_WEEKS
    ma_short: int = K.DEFAULT_MA_SHORT
    ma_intermediate: int = K.DEFAULT_MA_INTERMEDIATE
    ma_medium: int = K.DEFAULT_MA_MEDIUM
    ma_long: int = K.DEFAULT_MA_LONG
    avg_volume_weeks: int = K.DEFAULT_AVG_VOLUME_WEEKS
    lookback_weeks: int = K.DEFAULT_LOOKBACK_WEEKS

    @property
    def ma_periods(self) -> dict[str, int]:
        return {
            "short": self.ma_short,
            "intermediate": self.ma_intermediate,
            "medium": self.ma_medium,
            "long": self.ma_long,
        }

    def validate(self) -> "ScreenConfig":
        """Raise ``ValueError`` on settings the ``live`` dialect refuses."""
        if self.min_market_cap < 0 or self.max_market_cap < 0:
            raise ValueError("market cap bounds must not be negative")
        if 0 < self.max_market_cap < self.min_market_cap:
            raise ValueError("min_market_cap must not exceed max_market_cap")
        periods = list(self.ma_periods.values())
        if periods[0] <= 0 or any(a >= b for a, b in zip(periods, periods[1:])):
            raise ValueError("moving-average periods must be positive and increasing")
        if self.volume_multiplier <= 0:
            raise ValueError("volume_multiplier must be positive")
        return self

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> "ScreenConfig":
        """Load one settings file; absent keys take their defaults."""
        [(_, config)] = configs_from_settings(read_settings(spark, path))
        return config

    def to_json(self, spark: SparkSession, path: str) -> None:
        write_settings(spark, {"settings": self}, path)


def required_years(config: ScreenConfig) -> float:
    """Years of daily history that fill the longest frame, with a buffer."""
    return (
        max(config.ma_periods.values()) / K.WEEKS_PER_YEAR
        + config.avg_volume_weeks / K.WEEKS_PER_YEAR
        + K.HISTORY_BUFFER_YEARS
    )


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Read settings files as a table: JSON objects, arrays of them or JSON lines, one screen a row.

    A screen without ``config_id`` is named after its file: by the name if it alone in the table has that name, else by
    the whole path; with its place in the file if that holds several. A file that is no JSON fails the read.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_replace("_metadata.file_path", r"\.json$", "").alias("file"), F.trim("value").alias("text")
    )
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda x: x != "")
    apart = F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    whole = F.when(F.try_parse_json("text").isNotNull(), F.array("text")).otherwise(
        F.raise_error(F.concat(F.lit("not a settings file: "), "file")).cast("array<string>")
    )
    parts = F.when(apart, lines).otherwise(whole)
    screens = F.flatten(F.transform(parts, lambda x: F.from_json(x, f"array<struct<{SETTINGS_SCHEMA}>>")))
    found = files.select("file", F.size(screens).alias("held"), F.posexplode(screens).alias("place", "s"))
    stem = F.element_at(F.split("file", "/"), -1)
    alone = F.count(F.lit(1)).over(Window.partitionBy(stem)) == F.col("held")
    name = F.concat(F.when(alone, stem).otherwise(F.col("file")), F.when(F.col("held") > 1, F.concat(F.lit("#"), "place")).otherwise(""))
    defaults = asdict(ScreenConfig())
    return found.select(
        F.coalesce("s.config_id", name).alias("config_id"),
        *[F.coalesce(F.col(f"s.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()],
    )


def write_settings(spark: SparkSession, configs: dict[str, ScreenConfig], path: str) -> None:
    """Save settings, one file per screen, including ``lookback_weeks``."""
    settings_frame(spark, configs).withColumn("settings_of", F.col("config_id")).write.partitionBy(
        "settings_of"
    ).json(path)


def settings_frame(spark: SparkSession, configs: dict[str, ScreenConfig]) -> DataFrame:
    rows = [(cid, *asdict(cfg).values()) for cid, cfg in configs.items()]
    return spark.createDataFrame(rows, SETTINGS_SCHEMA)


def configs_from_settings(settings: DataFrame) -> list[tuple[str, ScreenConfig]]:
    """Bring a settings table to the driver, where it shapes the plan: control data, not rows to process."""
    names = [f.name for f in fields(ScreenConfig)]
    rows = settings.select("config_id", *names).collect()
    return [(r["config_id"], ScreenConfig(**{n: r[n] for n in names})) for r in rows]
