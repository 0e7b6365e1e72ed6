"""Stop-loss and take-profit distances of a (signal, trial) row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SWING_PIPS, SWING_FALLBACK = 5.0, 1.5


def stop_pips(pip: float | Column) -> Column:
    """fixed_pips, atr_based or swing: the distance to the recent swing, 5 pips at least; 1.5 ATR without one."""
    swing = F.when(F.col("direction") > 0, F.col("recent_low")).otherwise(F.col("recent_high"))
    far = F.greatest(F.abs(F.col("entry_price") - swing) / pip, F.lit(MIN_SWING_PIPS))
    return (
        F.when(F.col("sl_mode") == "fixed_pips", F.col("sl_fixed_pips"))
        .when(F.col("sl_mode") == "atr_based", F.col("atr_pips") * F.col("sl_atr_mult"))
        .otherwise(F.coalesce(far, F.col("atr_pips") * SWING_FALLBACK))
    )


def target_pips(stop: Column) -> Column:
    """rr_ratio, atr_based or fixed_pips, never nearer than the stop."""
    raw = F.when(F.col("tp_mode") == "rr_ratio", stop * F.col("tp_rr_ratio")).when(F.col("tp_mode") == "atr_based", F.col("atr_pips") * F.col("tp_atr_mult")).otherwise(F.col("tp_fixed_pips"))
    return F.greatest(raw, stop)


def with_stops(rows: DataFrame, pip: float = 0.0001) -> DataFrame:
    """Adds sl_pips, tp_pips and the prices sl, tp."""
    rows = rows.withColumn("sl_pips", stop_pips(pip)).withColumn("tp_pips", target_pips(F.col("sl_pips")))
    return rows.withColumns({"sl": F.col("entry_price") - F.col("direction") * F.col("sl_pips") * pip, "tp": F.col("entry_price") + F.col("direction") * F.col("tp_pips") * pip})
