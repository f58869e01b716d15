"""Forecasts of all origins kept in a table: new weeks add their origins, revised weeks redo the origins from them on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.history import by_week
from weekloom.operators.models import origins_at, point_forecast, rolling_origins
from weekloom.params import Params

KEPT = "series_id string, origin_idx long, known string, horizon int, lp double"


def known_prints(panel: DataFrame) -> DataFrame:
    """(series_id, week_idx, known): a print of all that the series said up to each week. Whatever a model may use of it, holiday effects too, is the same where the print is."""
    upto = by_week().rowsBetween(Window.unboundedPreceding, 0)
    cell = F.xxhash64("week_idx", "y")
    return panel.select("series_id", "week_idx", F.concat_ws("|", F.count("*").over(upto), F.sum(cell.cast("decimal(38,0)")).over(upto).cast("string"), F.bit_xor(cell).over(upto)).alias("known"))


def stale_origins(kept: DataFrame, panel: DataFrame, p: Params) -> DataFrame:
    """(series_id, origin_idx, known) of the origins that kept (KEPT) lacks, or has from other data."""
    origins = rolling_origins(panel, p).select("series_id", "origin_idx").join(known_prints(panel).withColumnRenamed("week_idx", "origin_idx"), ["series_id", "origin_idx"])
    return origins.join(kept.select("series_id", "origin_idx", "known").distinct(), ["series_id", "origin_idx", "known"], "left_anti")


def extended(kept: DataFrame, stale: DataFrame, panel: DataFrame, seen: DataFrame, cal: DataFrame, p: Params) -> DataFrame:
    """kept (KEPT) as a run over all origins would give it: what still holds, and the stale origins' forecasts, which alone are worked out.

    Give stale as a table. Errors of kept forecasts are a join with the panel (evaluate.residuals()). The calendar and the
    parameters are taken to be the same as before.
    """
    made = point_forecast(panel, seen, cal, p, origins_at(panel, stale, p)).join(stale, ["series_id", "origin_idx"])
    holds = known_prints(panel).withColumnRenamed("week_idx", "origin_idx")
    columns = ["series_id", "origin_idx", "known", "horizon", "lp"]
    return kept.join(holds, ["series_id", "origin_idx", "known"], "left_semi").select(columns).unionByName(made.select(columns))
