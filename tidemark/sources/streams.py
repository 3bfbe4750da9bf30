"""Forecast streams derived from the index series.

Four streams share each series and session: a reversal rule ("base") and three
challengers.  Forecasts use only data known on the signal day; the outcome is
the return to the next session and is unknown on the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.frames import ordered
from tidemark.sources.derive import index_series

STREAMS = ("base", "level", "momentum", "volume")
STREAM_KEYS = ("stream_id", "series_id")


def forecast_streams(spark: SparkSession, root: str) -> DataFrame:
    w = ordered(["series_id"], "trade_date")
    bars = index_series(spark, root).withColumn("r1", F.col("close") / F.col("pre_close") - 1).withColumn(
        "vol_up", F.col("vol") > F.lag("vol").over(w)).withColumn(
        "real_pct_change", F.lead("close").over(w) / F.col("close") - 1).withColumn("pos", F.row_number().over(w) - 1)
    known = bars.where(F.col("r1").isNotNull())
    size = F.abs("r1") / (1 + F.abs("r1"))
    place = F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))

    def variant(name, up, confidence):
        return F.struct(F.lit(name).alias("stream_id"), up.cast("int").alias("predicted_label"), confidence.alias("confidence"))

    variants = F.array(
        variant("base", F.col("r1") <= 0, 0.5 + 0.4 * size),
        variant("level", place <= 0.5, 0.5 + 0.3 * F.abs(place - 0.5)),
        variant("momentum", F.col("r1") > 0, 0.52 + 0.3 * size),
        variant("volume", F.coalesce(F.col("vol_up"), F.lit(False)), 0.5 + 0.2 * size))
    rows = known.select("series_id", "trade_date", "pos", "close", "r1", "real_pct_change", F.explode(variants).alias("v")).select("*", "v.*").drop("v")
    signed = (2 * F.col("predicted_label") - 1) * (F.least(F.abs("r1"), F.lit(0.05)) * 0.5 + 0.001)
    return rows.withColumn("uncalibrated_predicted_return", signed).select(
        "stream_id", "series_id", "trade_date", "pos", "close", "predicted_label", "uncalibrated_predicted_return",
        F.col("uncalibrated_predicted_return").alias("predicted_pct_change"),
        (F.col("close") * (1 + F.col("uncalibrated_predicted_return"))).alias("predicted_close"),
        "confidence", (0.5 + 0.8 * (F.col("confidence") - 0.5)).alias("calibrated_confidence"), "real_pct_change",
        (F.col("predicted_label") == (F.col("real_pct_change") > 0).cast("int")).alias("correct"))


def base_stream(spark: SparkSession, root: str) -> DataFrame:
    """The incumbent stream alone."""
    return forecast_streams(spark, root).where("stream_id = 'base'")
