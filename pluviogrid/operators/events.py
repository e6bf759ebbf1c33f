"""Spells, events, storm tracks. A NULL breaks a spell and belongs to none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_dates import season


def spells(df: DataFrame, keys: list[str], threshold: float = 1.0, inclusive: bool = True, ts: str = "ts", col: str = "value") -> DataFrame:
    """wet, event (number of each wet or dry run from 1), is_start and is_end; one sort by series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("wet", F.when(F.col(col).isNotNull(), F.col(col) >= threshold if inclusive else F.col(col) > threshold))
    d = d.withColumns({"is_start": ~F.col("wet").eqNullSafe(F.lag("wet").over(w)) | (F.row_number().over(w) == 1), "is_end": ~F.col("wet").eqNullSafe(F.lead("wet").over(w)) | F.lead(ts).over(w).isNull()})
    return d.withColumn("event", F.sum(F.col("is_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def event_table(df: DataFrame, keys: list[str], threshold: float = 1.0, inclusive: bool = True, ts: str = "ts", col: str = "value") -> DataFrame:
    """A row for each wet event: start, end, duration in rows, total, peak, mean intensity."""
    s = spells(df, keys, threshold, inclusive, ts, col).where("wet")
    return s.groupBy(*keys, "event").agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count("*").alias("duration"), F.sum(col).alias("total"), F.max(col).alias("peak")).withColumn("intensity", F.col("total") / F.col("duration"))


def on_rows(df: DataFrame, keys: list[str], threshold: float = 1.0, inclusive: bool = True, ts: str = "ts", col: str = "value") -> DataFrame:
    """Every row with its event's total and duration: on all rows, on the last only, and the length on the first only (else 0)."""
    s = spells(df, keys, threshold, inclusive, ts, col)
    w = Window.partitionBy(*keys, "event")
    s = s.withColumns({"dur_all": F.count("*").over(w), "total_all": F.sum(col).over(w), "peak_all": F.max(col).over(w)})
    return s.withColumns({"dur_last": F.when(F.col("is_end"), F.col("dur_all")), "total_last": F.when(F.col("is_end"), F.col("total_all")), "len_first": F.when(F.col("is_start") & F.coalesce("wet", F.lit(False)), F.col("dur_all")).otherwise(0), "cumul_first": F.when(F.col("is_start") & F.coalesce("wet", F.lit(False)), F.col("total_all")), "peak_first": F.when(F.col("is_start") & F.coalesce("wet", F.lit(False)), F.col("peak_all"))})


def event_stats(events: DataFrame, keys: list[str], by_season: bool = False) -> DataFrame:
    """n_events, mean_duration, mean_intensity and total of each cell; by the season of the start on request."""
    d = events.withColumn("season", season(F.col("start"))) if by_season else events
    return d.groupBy(*keys, *["season"] * by_season).agg(F.count("*").alias("n_events"), F.avg("duration").alias("mean_duration"), F.avg("intensity").alias("mean_intensity"), F.sum("total").alias("total_precipitation"))


def sessions(df: DataFrame, keys: list[str], threshold: float = 1.0, ts: str = "ts", col: str = "value") -> DataFrame:
    """By day: wet hours, sessions (events with a wet hour in it), total, duration = hours / sessions, amount = total / sessions, max rate."""
    s = spells(df, keys, threshold, True, ts, col).where("wet")
    d = s.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("hours"), F.count_distinct("event").alias("sessions"), F.sum(col).alias("total"), F.max(col).alias("max_rate"))
    return d.withColumns({"duration": F.col("hours") / F.col("sessions"), "amount": F.col("total") / F.col("sessions")})


def moving_accumulation(df: DataFrame, keys: list[str], n: int, threshold: float = 0.1, ts: str = "ts", col: str = "value") -> DataFrame:
    """Sum of the last n rows (fewer at the start) where the row itself is wet, else 0."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(n - 1), 0)
    return df.withColumn("accumulated", F.when(F.col(col) > threshold, F.sum(col).over(w)).otherwise(0.0))


def decompose(stats: DataFrame, keys: list[str], run: str = "run", present: str = "present", future: str = "future") -> DataFrame:
    """Change of the total by the number, intensity and duration of events, and the rest."""
    p, f = (stats.where(F.col(run) == r).select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("n_events", "mean_intensity", "mean_duration"))) for r, s in ((present, "p"), (future, "f")))
    d = p.join(f, keys)
    n, i, t = (F.col(f"{c}_p") for c in ("n_events", "mean_intensity", "mean_duration"))
    dn, di, dt = (F.col(f"{c}_f") - F.col(f"{c}_p") for c in ("n_events", "mean_intensity", "mean_duration"))
    total = F.col("n_events_f") * F.col("mean_intensity_f") * F.col("mean_duration_f") - n * i * t
    d = d.withColumns({"by_number": dn * i * t, "by_intensity": di * n * t, "by_duration": dt * n * i, "change": total})
    return d.withColumn("residual", F.col("change") - F.col("by_number") - F.col("by_intensity") - F.col("by_duration")).select(*keys, "by_number", "by_intensity", "by_duration", "change", "residual")


def explode_tracks(tracks: DataFrame) -> DataFrame:
    """A row for each step of each storm: parallel arrays zipped; speed is one shorter and 0 at the first step; track is (lat, lon)."""
    z = tracks.withColumn("speed", F.concat(F.array(F.lit(0.0)), "speed"))
    d = z.select("storm_id", F.posexplode(F.arrays_zip("times", "size", "tot", "max", "mean", "speed", "track")).alias("step", "r"))
    return d.select("storm_id", "step", F.col("r.times").alias("ts"), *(F.col(f"r.{c}").alias(c) for c in ("size", "tot", "max", "mean", "speed")), F.get(F.col("r.track"), F.lit(0)).alias("lat"), F.get(F.col("r.track"), F.lit(1)).alias("lon"))


def storm_summary(steps: DataFrame) -> DataFrame:
    d = steps.groupBy("storm_id").agg(F.min("ts").alias("start"), F.count("*").alias("duration"), F.max("size").alias("max_size"), F.sum("tot").alias("tot"), F.max("max").alias("max"), F.avg("mean").alias("mean"), F.avg("speed").alias("mean_speed"))
    return d.withColumn("month", F.month("start"))


def renumber(df: DataFrame, key: str, order: str) -> DataFrame:
    """number: dense number of each key by its first appearance in the order. Keys are few against rows: they alone are ranked in one task."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    numbered = first.withColumn("number", F.dense_rank().over(Window.orderBy("__first", key)) - 1).drop("__first")
    return df.join(numbered, key)


def objects(df: DataFrame, threshold: float, key: str = "ts", col: str = "value") -> DataFrame:
    """Four-connected areas above a threshold at each step: id, cells, total and centre of mass (one step is one group)."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {(int(y), int(x)): float(v) for y, x, v in zip(pdf["y"], pdf["x"], pdf[col]) if v > threshold}
        seen, rows = set(), []
        for start in sorted(cells):
            if start in seen:
                continue
            seen.add(start)
            stack, own = [start], []
            while stack:
                y, x = stack.pop()
                own.append((y, x))
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if n in cells and n not in seen:
                        seen.add(n)
                        stack.append(n)
            total = sum(cells[c] for c in own)
            rows.append((pdf[key].iloc[0], len(rows), len(own), total, sum(c[0] * cells[c] for c in own) / total, sum(c[1] * cells[c] for c in own) / total))
        return pd.DataFrame(rows, columns=[key, "object", "cells", "total", "center_y", "center_x"])

    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(col) > threshold).select(key, "y", "x", col).groupBy(key).applyInPandas(label, f"{key} {kind}, object int, cells int, total double, center_y double, center_x double")
