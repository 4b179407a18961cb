"""Sail plans: the table of what to set by wind and point of sail, and what sea, heel and a poor ratio change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import wind_class

# Fixed values: (point of sail, wind, main, jib, spinnaker, heel target in degrees).
SAIL_PLAN = [
    ("beating", "very_light", "full", "genoa", "down", 12.0), ("beating", "light", "full", "full", "down", 14.0), ("beating", "moderate", "full", "working", "down", 16.0),
    ("beating", "fresh", "1 reef", "working", "down", 18.0), ("beating", "strong", "2 reefs", "working", "down", 20.0), ("beating", "gale", "2 reefs", "storm", "down", 22.0),
    ("reaching", "very_light", "full", "genoa", "ready", 15.0), ("reaching", "light", "full", "genoa", "up", 16.0), ("reaching", "moderate", "full", "working", "ready", 18.0),
    ("reaching", "fresh", "full", "working", "down", 20.0), ("reaching", "strong", "1 reef", "working", "down", 22.0), ("reaching", "gale", "2 reefs", "working", "down", 20.0),
    ("running", "very_light", "full", "out", "up", 12.0), ("running", "light", "full", "out", "up", 13.0), ("running", "moderate", "full", "out", "ready", 15.0),
    ("running", "fresh", "full", "out", "down", 16.0), ("running", "strong", "1 reef", "poled", "down", 18.0), ("running", "gale", "down", "poled", "down", 14.0),
]


def sail_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAIL_PLAN, "point_of_sail string, wind string, main string, jib string, spinnaker string, heel_target double")


def point_of_sail(twa: Column) -> Column:
    """The plan's three rows of angles; it says nothing of 120 to 160 degrees, which count as reaching here."""
    a = F.abs(twa)
    return F.when(a < 45, "beating").when(a < 160, "reaching").when(a.isNotNull(), "running")


def reefed(main: Column) -> Column:
    """One step less of the main."""
    return F.when(main == "full", "1 reef").when(main == "1 reef", "2 reefs").otherwise(main)


def recommended(conditions: DataFrame) -> DataFrame:
    """``conditions`` (tws in knots, twa, heel in degrees, sea, efficiency) with the sails to set and what to mind.

    A rough sea takes a reef and two degrees of heel. ``heel_alert`` is warning beyond the target by two degrees, and
    critical above 24; ``may_add_sail`` is a ratio below 0.85 in less than 16 knots and no rough sea. Without wind or angle
    there is no plan. The plan's eighteen rows are broadcast.
    """
    plan = F.broadcast(sail_plan(conditions.sparkSession)).withColumnRenamed("point_of_sail", "__point").withColumnRenamed("wind", "__wind")
    out = conditions.withColumns({"point_of_sail": point_of_sail(F.col("twa")), "wind": wind_class(F.col("tws"))})
    out = out.join(plan, (F.col("point_of_sail") == F.col("__point")) & (F.col("wind") == F.col("__wind")), "left").drop("__point", "__wind")
    rough = F.coalesce(F.col("sea") == "rough", F.lit(False))
    out = out.withColumns({"main": F.when(rough, reefed(F.col("main"))).otherwise(F.col("main")), "heel_target": F.col("heel_target") - F.when(rough, 2.0).otherwise(0.0)})
    heel = F.abs("heel")
    alert = F.when(heel > F.col("heel_target") + 2, F.when(heel > 24, "critical").otherwise("warning"))
    return out.withColumns({"heel_alert": alert, "may_add_sail": F.coalesce((F.col("efficiency") < 0.85) & (F.col("tws") < 16), F.lit(False)) & ~rough})


def may_hoist(tws: Column, twa: Column, gust: Column, heel: Column, roll: Column, trained: Column) -> Column:
    """Whether the spinnaker may go up: running, and within the limits of wind, gust, heel, roll and crew."""
    return (F.abs(twa) >= 160) & (tws <= 16) & (gust <= 18) & (F.abs(heel) <= 20) & (F.abs(roll) <= 25) & (trained | (tws <= 10))


def must_douse(twa: Column, gust: Column, heel: Column, unstable: Column) -> Column:
    """Any one of these brings it down."""
    return (gust > 18) | (F.abs(heel) > 22) | unstable | (F.abs(twa) < 150)
