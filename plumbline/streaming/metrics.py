"""Structured metrics over an arriving stream of judged predictions: every metric is a sum of indicators in a window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pct
from ..operators.structured import judged


def rolling_metrics(predictions: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, total, valid_json, joint_accuracy, false_alarm_rate) for each window; later rows than `late` are left out."""
    j = judged(predictions.withWatermark(time, late))
    n, none = F.count(F.lit(1)), F.col("g.error_type") == "none"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = j.groupBy(F.window(time, window).alias("w")).agg(n.alias("total"), pct(count(F.col("valid_json")), n).alias("valid_json"), pct(count(F.col("joint_ok")), n).alias("joint_accuracy"), pct(count(none & (F.col("p.correctness") == "incorrect")), count(none)).alias("false_alarm_rate"))
    return out.select("w.start", "w.end", "total", "valid_json", "joint_accuracy", "false_alarm_rate")
