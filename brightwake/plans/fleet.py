"""Own boat against the fleet, and crew watches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightwake.functions import classify, geo, nautical
from brightwake.operators.rolling import crossings, durations


def around(targets: DataFrame, own: DataFrame, mark_bearing: Column, radius_nm: float = 10.0) -> DataFrame:
    """Targets within the radius of the own boat, nearest first, with distance, bearing, offset and speed made good.

    ``own`` is one row (latitude, longitude, vmg); it becomes three scalars beside each target.
    """
    one = F.broadcast(own.limit(1).select(F.lit(1).alias("__k"), F.col("latitude").alias("own_lat"), F.col("longitude").alias("own_lon"), F.col("vmg").alias("own_vmg")))
    both = targets.withColumn("__k", F.lit(1)).join(one, "__k").drop("__k")
    here = (F.col("own_lat"), F.col("own_lon"), F.col("latitude"), F.col("longitude"))
    out = both.withColumns({
        "distance_nm": geo.distance(*here, geo.EARTH_NM), "bearing": geo.bearing(*here), "vmg": nautical.vmg_to_mark(F.col("sog_kts"), F.col("cog_deg"), mark_bearing),
        "lateral_nm": geo.lateral_offset(F.col("latitude"), F.col("longitude"), F.col("own_lat"), F.col("own_lon"), mark_bearing),
    })
    out = out.filter(F.col("distance_nm") <= radius_nm)
    return out.withColumns({"delta": F.col("vmg") - F.col("own_vmg"), "class": classify.fleet_delta(F.col("vmg") - F.col("own_vmg")), "side": classify.lateral_side(F.col("lateral_nm"))}).orderBy("distance_nm")


def ranking_changes(standings: DataFrame, time: str = "time", boat: str = "boat", score: str = "score") -> DataFrame:
    """Places gained or lost since the boat's last standing, by score at each time."""
    placed = standings.withColumn("place", F.rank().over(Window.partitionBy(time).orderBy(F.desc(score))))
    before = F.lag("place").over(Window.partitionBy(boat).orderBy(time))
    return placed.withColumn("gained", before - F.col("place")).filter("gained <> 0").select(boat, time, "place", "gained")


def early_starts(track: DataFrame, gun: Column, by: list[str]) -> DataFrame:
    """Crossings of the start line (signed ``metres``) before the gun."""
    return crossings(track, by, "metres").filter(F.col("time") < gun)


def watches(changes: DataFrame, asof: Column, by: list[str], most_apart: float = 7200.0) -> DataFrame:
    """Seconds at the helm for each person, and whether the boat's longest and shortest differ too much."""
    held = durations(changes, by, "helmsman", asof)
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return held.withColumn("imbalanced", F.max("seconds").over(w) - F.min("seconds").over(w) > most_apart)


def fatigue_index(speeds: DataFrame, by: list[str], every: str = "30 minutes") -> DataFrame:
    """Loss of mean speed in each window against the first window of the group, with its grade."""
    means = speeds.groupBy(*by, F.window("time", every).alias("w")).agg(F.avg("value").alias("mean"))
    baseline = F.first("mean").over(Window.partitionBy(*by).orderBy("w.start"))
    loss = nautical.fatigue(F.col("mean"), baseline)
    return means.select(*by, F.col("w.end").alias("time"), "mean", loss.alias("loss"), classify.above(loss, [(25, "exhausted"), (15, "tired"), (5, "easing")], "fresh").alias("grade"))


def short_rests(changes: DataFrame, by: list[str], least: float = 7200.0, order: tuple[str, ...] = ()) -> DataFrame:
    """Turns at the helm that begin less than ``least`` seconds after the same person's last one ended.

    ``changes`` are (time, helmsman) with ``by`` for each boat; a turn lasts until another person takes over, and
    naming the same person again begins none. Rows without a time or a person say nothing.
    """
    boat = Window.partitionBy(*(by or [F.lit(0)])).orderBy("time", *order)
    was = F.lag("helmsman").over(boat)
    known = changes.dropna(subset=["time", "helmsman"]).withColumn("__was", was)
    turns = known.filter("__was is null or __was <> helmsman").withColumn("__until", F.lead("time").over(boat))
    rested = F.unix_micros("time") - F.unix_micros(F.lag("__until").over(Window.partitionBy(*by, "helmsman").orderBy("time", *order)))
    return turns.withColumn("rest_seconds", rested / 1_000_000).filter(F.col("rest_seconds") < least).select(*by, "time", "helmsman", "rest_seconds")


def speed_drops(speeds: DataFrame, by: list[str], every: str = "1 hour", loss: float = 15.0) -> DataFrame:
    """Windows whose mean speed is more than ``loss`` per cent below that of the window just before.

    A window without rows ends the comparison: what lies before a gap is no measure. A mean of 0 or less before
    gives no figure.
    """
    means = speeds.groupBy(*by, F.window("time", every)["start"].alias("since")).agg(F.avg("value").alias("mean"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("since")
    before = F.when(F.lag("since").over(w) + F.expr(f"interval {every}") == F.col("since"), F.lag("mean").over(w))
    out = means.withColumn("before", before).filter("before > 0").withColumn("loss_pct", (F.col("before") - F.col("mean")) / F.col("before") * 100)
    return out.filter(F.col("loss_pct") > loss).select(*by, "since", "before", "mean", "loss_pct")
