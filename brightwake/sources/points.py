"""Points: the canonical long form of all telemetry, and how the driver's events map onto it.

A point is (time, measurement, field, one typed value, source, tags). A series is a measurement, a field and
the tags; all per-series operators group by it explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "time timestamp, measurement string, field string, value_double double, value_string string, value_boolean boolean, source string, tags map<string,string>"

#: Names under which one measurement is also written.
ALIASES = {"navigation.position.lat": "navigation.position.latitude", "navigation.position.lon": "navigation.position.longitude"}


def read(spark: SparkSession, root: str) -> DataFrame:
    """Points under a root that is partitioned by measurement."""
    return spark.read.schema(POINT).parquet(root)


def write(points: DataFrame, root: str, mode: str = "append") -> None:
    """One folder for each measurement, so that a filter on it reads no other files."""
    points.write.mode(mode).partitionBy("measurement").parquet(root)


def series_key(tag: str = "user") -> Column:
    return F.concat_ws("/", "measurement", "field", F.col("tags")[tag])


def unaliased(points: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return points.withColumn("measurement", F.coalesce(names[F.col("measurement")], "measurement"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with a zoned time, which streams and windows ask for."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def from_events(df: DataFrame) -> DataFrame:
    """event_type is the measurement, value its only field, the user a tag."""
    return df.select(
        F.col("ts").alias("time"), F.col("event_type").alias("measurement"), F.lit("value").alias("field"), F.col("value").alias("value_double"), F.lit(None).cast("string").alias("value_string"),
        F.lit(None).cast("boolean").alias("value_boolean"), F.lit(None).cast("string").alias("source"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), F.col("event_id"),
    )


def at_place(points: DataFrame, name: str) -> DataFrame:
    """All points with one ``location`` tag beside their others."""
    return points.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("location"), F.lit(name))))


def at_places(points: DataFrame) -> DataFrame:
    """Points with a ``location`` tag beside their others: of three users one is at Stamford, one at Newport, and one says nothing."""
    user = F.try_element_at("tags", F.lit("user")).cast("bigint")
    place = lambda name: F.map_concat("tags", F.create_map(F.lit("location"), F.lit(name)))
    return points.withColumn("tags", F.when(user % 3 == 0, place("stamford")).when(user % 3 == 1, place("newport")).otherwise(F.col("tags")))


#: Measurements of one boat, dealt over the events by id: (measurement, factor, offset).
BOAT = [
    ("navigation.headingTrue", 0.0128, 0.0), ("navigation.position.latitude", 0.002, 40.6), ("navigation.position.longitude", 0.004, -73.6), ("navigation.speedOverGround", 0.02, 0.0),
    ("navigation.courseOverGroundTrue", 0.0128, 0.0), ("navigation.speedThroughWater", 0.018, 0.0), ("performance.velocityMadeGood", 0.012, 0.0), ("performance.targetSpeed", 0.016, 0.1),
    ("performance.velocityMadeGoodRatio", 0.002, 0.0), ("performance.beatAngle", 0.0016, 0.0), ("environment.wind.speedApparent", 0.03, 0.0), ("environment.wind.angleApparent", 0.0128, 0.0),
    ("environment.wind.speedTrue", 0.025, 0.0), ("environment.wind.angleTrueWater", 0.0128, -3.14), ("environment.wind.directionTrue", 0.0128, 0.0), ("environment.depth.belowKeel", 0.1, 0.0),
    ("environment.water.temperature", 0.02, 283.15), ("environment.current.drift", 0.003, 0.0), ("environment.current.setTrue", 0.0128, 0.0), ("navigation.attitude.roll", 0.002, -0.5),
    ("navigation.attitude.pitch", 0.001, -0.25), ("navigation.attitude.yaw", 0.0128, -3.14), ("weather.temperature", 0.1, -10.0), ("weather.humidity", 0.2, 0.0),
    ("weather.pressure", 0.1, 990.0), ("weather.wind_speed", 0.1, 0.0), ("weather.wind_direction", 0.7, 0.0), ("weather.wind_gust", 0.13, 0.0), ("weather.precipitation", 0.01, 0.0),
    ("environment.moon.illumination", 0.002, 0.0), ("environment.moon.phase", 0.002, 0.0), ("environment.tide.tideHighLevel", 0.005, 0.0), ("environment.tide.tideLowLevel", 0.001, 0.0),
    ("race.startLine.latitude", 0.002, 40.7), ("race.startLine.longitude", 0.004, -73.5), ("regatta.timer", 1.5, -30.0), ("environment.water.depth", 0.1, 0.5),
]


def boat_points(df: DataFrame) -> DataFrame:
    """Each event as one point of one boat: its id picks the measurement, its value is scaled by it."""
    at = (F.col("event_id") % len(BOAT)).cast("int")

    def own(k: int) -> Column:
        return F.get(F.array(*(F.lit(x[k]) for x in BOAT)), at)

    return from_events(df.withColumn("value", F.col("value") * own(1) + own(2))).withColumn("measurement", own(0))

#: Text measurements, dealt likewise.
TEXTS = [
    "sails.mainsail", "sails.jib", "sails.jib.state", "sails.spinnaker", "sails.spinnaker.state", "crew.helmsman.name", "crew.helmsman.watchStart", "crew.helmsman.timeAtHelm", "crew.tactician.name",
    "crew.mainTrimmer.name", "crew.jibTrimmer.name", "crew.bowman.name", "crew.pit.name", "race.start.name", "race.start.time", "race.start.class", "race.mark.windward", "race.mark.leeward",
    "race.mark.gate1", "race.mark.gate2", "race.mark.finish", "environment.sun.sunriseTime", "environment.sun.sunsetTime", "environment.moon.moonriseTime", "environment.moon.moonsetTime",
    "environment.tide.tideHighTime", "environment.tide.tideLowTime", "weather.condition", "crew.helmsman.change", "environment.tide.tideHighLevel", "environment.tide.tideLowLevel", "crew.navigator.name",
]
CLOCK = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def text_points(df: DataFrame) -> DataFrame:
    """Each event as one text point: a time some minutes ahead for times, else the event's type."""
    name = F.get(F.array(*map(F.lit, TEXTS)), (F.col("event_id") % len(TEXTS)).cast("int"))
    ahead = F.date_format(F.col("time") + F.make_dt_interval(mins=(F.col("event_id") % 900).cast("int")), CLOCK)
    rows = from_events(df).withColumns({"kind": F.col("measurement"), "measurement": name})
    return rows.withColumn("value_string", F.when(F.lower("measurement").endswith("time"), ahead).otherwise(F.col("kind"))).drop("kind")


#: Stations with their names, places and distances.
BUOYS = [("44065", "Stamford (Western LIS)", 41.063, -73.591, "5 nm"), ("44025", "Central LIS", 40.876, -73.100, "20 nm"), ("44008", "Block Island (Eastern LIS)", 40.502, -71.029, "50 nm")]
#: The polar table (true wind, speeds upwind, reaching and downwind, best angles).
POLAR = [
    (5.0, 3.2, 4.1, 4.8, 32.0, 155.0), (6.0, 3.9, 5.0, 5.9, 31.0, 155.0), (7.0, 4.6, 5.9, 6.9, 31.0, 155.0), (8.0, 5.2, 6.7, 7.8, 31.0, 155.0), (9.0, 5.8, 7.5, 8.7, 30.0, 155.0), (10.0, 6.4, 8.2, 9.5, 30.0, 155.0),
    (12.0, 7.5, 9.6, 11.0, 30.0, 155.0), (14.0, 8.5, 10.9, 12.4, 29.0, 155.0), (16.0, 9.4, 12.0, 13.7, 29.0, 155.0), (18.0, 10.2, 13.0, 14.8, 28.0, 155.0), (20.0, 10.9, 13.9, 15.8, 28.0, 155.0), (25.0, 12.0, 15.2, 17.2, 27.0, 155.0),
]


def place(lat: float, lon: float) -> str:
    """As the tools write a place."""
    return f"{lat:g}°N, {lon:g}°W"


def buoys(spark: SparkSession) -> DataFrame:
    rows = [(*b, place(b[2], b[3])) for b in BUOYS]
    return spark.createDataFrame(rows, "station string, name string, lat double, lon double, distance string, location string")


def polar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLAR, "tws double, upwind double, reach double, downwind double, upwind_angle double, downwind_angle double")


def polar_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The ``polars`` of one JSON document, sorted; a missing column is an error."""
    names = ["tws", "upwind", "reach", "downwind", "upwind_angle", "downwind_angle"]
    rows = spark.read.option("multiLine", True).json(path).select(F.inline("polars"))
    if missing := [n for n in names if n not in rows.columns]:
        raise ValueError(f"the polar table lacks {missing}")
    return rows.select(*(F.col(n).cast("double").alias(n) for n in names)).orderBy("tws")


def buoy_points(df: DataFrame) -> DataFrame:
    """Each event as a canonical point of one of four stations, named in the tags, the last of them unknown to the dimension."""
    names = ["buoy.wind_speed_knots", "buoy.wind_gust_knots", "buoy.wave_height", "buoy.water_temperature", "buoy.wind_direction"]
    stations = [b[0] for b in BUOYS] + ["44099"]
    pick = lambda xs, by: F.get(F.array(*map(F.lit, xs)), by.cast("int"))
    rows = from_events(df.withColumn("value", F.col("value") / 20))
    user = F.try_element_at("tags", F.lit("user")).cast("bigint")
    return rows.withColumns({"measurement": pick(names, F.col("event_id") % 5), "tags": F.create_map(F.lit("station"), pick(stations, user % 4))})
