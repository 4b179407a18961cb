"""The named queries: each takes points and an as-of instant and gives one row, or a documented list.

All latest values that a query needs come from one scan with conditional aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwake.functions import classify as C
from brightwake.functions import units as U
from brightwake.functions.angles import POINTS_EN, compass, course, degrees_signed
from brightwake.functions.geo import EARTH_M, distance
from brightwake.operators.joins import interpolated, lookup
from brightwake.operators.rolling import two_ranges
from brightwake.operators.series import Series, latest
from brightwake.sources import points as P

Tool = Callable[[DataFrame, Column, str], DataFrame]


def near(points: DataFrame, asof: Column, within: str) -> DataFrame:
    return Series(points).range(asof, within).df


def of(points: DataFrame, asof: Column, within: str, **names: str) -> DataFrame:
    return latest(near(points, asof, within), names, value="value_double")


def texts(points: DataFrame, asof: Column, within: str, **names: str) -> DataFrame:
    return latest(near(points, asof, within), names, value="value_string")


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


NAV, WIND, ATT = "navigation.", "environment.wind.", "navigation.attitude."
SOG, COG, STW, HDG = NAV + "speedOverGround", NAV + "courseOverGroundTrue", NAV + "speedThroughWater", NAV + "headingTrue"
LAT, LON = NAV + "position.latitude", NAV + "position.longitude"
VMG, TARGET = "performance.velocityMadeGood", "performance.targetSpeed"


def get_heading(p, asof, within="1 hour"):
    return of(p, asof, within, x=HDG).select(r(course(F.col("x"))).alias("heading_degrees"), r("x").alias("heading_radians"), F.lit("degrees").alias("unit"))


def get_position(p, asof, within="1 hour"):
    return of(p, asof, within, lat=LAT, lon=LON).select(r("lat", 6).alias("latitude"), r("lon", 6).alias("longitude"), F.lit("degrees").alias("unit"))


def get_sog(p, asof, within="1 hour"):
    return of(p, asof, within, x=SOG).select(r(U.knots_by_division(F.col("x"))).alias("speed_over_ground_knots"), r("x").alias("speed_over_ground_ms"), F.lit("knots").alias("unit"))


def get_cog(p, asof, within="1 hour"):
    return of(p, asof, within, x=COG).select(r(course(F.col("x"))).alias("course_over_ground_degrees"), r("x").alias("course_over_ground_radians"), F.lit("degrees").alias("unit"))


def get_stw(p, asof, within="1 hour"):
    return of(p, asof, within, x=STW).select(r(U.knots_by_division(F.col("x"))).alias("speed_through_water_knots"), r("x").alias("speed_through_water_ms"), F.lit("knots").alias("unit"))


def get_vmg(p, asof, within="1 hour"):
    rows = of(p, asof, within, v=VMG, t=TARGET)
    return rows.select(r(U.knots_by_division(F.col("v"))).alias("vmg_knots"), r(100 * F.col("v") / F.coalesce(F.nullif("t", F.lit(0.0)), F.lit(1.0))).alias("vmg_percent"), F.lit("knots").alias("unit"))


def get_performance(p, asof, within="1 hour"):
    rows = of(p, asof, within, v=VMG, t=TARGET, q="performance.velocityMadeGoodRatio", b="performance.beatAngle")
    return rows.select(r("v").alias("vmg"), r("t").alias("target_vmg"), r("t").alias("target_speed"), r("q").alias("vmg_ratio"), r("b").alias("beat_angle"), F.lit("m/s").alias("unit"))


def _wind(p, asof, within, speed, angle):
    x = F.col("a")
    return of(p, asof, within, s=speed, a=angle).select(r(U.knots_by_division(F.col("s"))).alias("speed_knots"), r(degrees_signed(x)).alias("angle_degrees"), r(x).alias("angle_radians"), C.wind_side(x).alias("direction"))


def get_wind_apparent(p, asof, within="1 hour"):
    return _wind(p, asof, within, WIND + "speedApparent", WIND + "angleApparent")


def get_wind_true(p, asof, within="1 hour"):
    return _wind(p, asof, within, WIND + "speedTrue", WIND + "angleTrueWater")


def get_wind_direction(p, asof, within="1 hour"):
    d = course(F.col("x"))
    return of(p, asof, within, x=WIND + "directionTrue").select(r(d).alias("direction_degrees"), compass(d, POINTS_EN, "N").alias("direction_compass"), F.lit("degrees").alias("unit"))


def get_depth(p, asof, within="1 hour"):
    """The depth of the water; where it isn't written, that below the keel."""
    rows = of(p, asof, within, w="environment.water.depth", k="environment.depth.belowKeel").withColumn("x", F.coalesce("w", "k"))
    return rows.select(r("x").alias("depth_meters"), r(U.feet(F.col("x"))).alias("depth_feet"), F.lit("meters").alias("unit"))


def get_water_temp(p, asof, within="1 hour"):
    c = U.celsius(F.col("x"))
    return of(p, asof, within, x="environment.water.temperature").select(r(c).alias("temperature_celsius"), r(U.fahrenheit(c)).alias("temperature_fahrenheit"), F.lit("celsius").alias("unit"))


def get_current(p, asof, within="1 hour"):
    d = course(F.col("a"))
    return of(p, asof, within, s="environment.current.drift", a="environment.current.setTrue").select(r(U.knots_by_division(F.col("s"))).alias("speed_knots"), r(d).alias("direction_degrees"), compass(d, POINTS_EN, "N").alias("direction_compass"))


def get_heel(p, asof, within="1 hour"):
    return of(p, asof, within, x=ATT + "roll").select(r(degrees_signed(F.col("x"))).alias("heel_degrees"), r("x").alias("heel_radians"), C.heel_side(F.col("x")).alias("side"))


def get_pitch(p, asof, within="1 hour"):
    return of(p, asof, within, x=ATT + "pitch").select(r(degrees_signed(F.col("x"))).alias("pitch_degrees"), r("x").alias("pitch_radians"), C.trim(F.col("x")).alias("trim"))


def get_attitude(p, asof, within="1 hour"):
    return of(p, asof, within, roll=ATT + "roll", pitch=ATT + "pitch", yaw=ATT + "yaw").select(*(r(degrees_signed(F.col(c))).alias(c) for c in ("roll", "pitch", "yaw")), F.lit("degrees").alias("unit"))


def get_race_data(p, asof, within="1 hour"):
    """Thirteen latest values from one scan, as nested groups."""
    names = {"lat": LAT, "lon": LON, "hdg": HDG, "cog": COG, "sog": SOG, "stw": STW, "aws": WIND + "speedApparent", "awa": WIND + "angleApparent", "tws": WIND + "speedTrue", "twa": WIND + "angleTrueWater", "roll": ATT + "roll", "vmg": VMG, "target": TARGET}
    kn = lambda c: r(U.knots_by_division(F.col(c)))
    deg = lambda c: r(degrees_signed(F.col(c)))
    return of(p, asof, within, **names).select(
        F.struct(r("lat", 6).alias("latitude"), r("lon", 6).alias("longitude")).alias("position"), F.struct(deg("hdg").alias("true"), deg("cog").alias("cog")).alias("heading"), F.struct(kn("sog").alias("sog"), kn("stw").alias("stw")).alias("speed"),
        F.struct(kn("aws").alias("apparent_speed"), deg("awa").alias("apparent_angle"), kn("tws").alias("true_speed"), deg("twa").alias("true_angle")).alias("wind"), F.struct(deg("roll").alias("heel")).alias("sailing"), F.struct(r("vmg").alias("vmg"), r("target").alias("target")).alias("performance"),
    )


SPEEDS = ["upwind", "reach", "downwind", "upwind_angle", "downwind_angle"]


def on_polar(rows: DataFrame) -> DataFrame:
    """Adds knots and the polar's columns at the true wind; without wind or boat speed there is no row."""
    kn = rows.withColumns({"stw_kn": U.knots_short(F.col("stw")), "tws_kn": U.knots_short(F.col("tws"))}).filter("stw > 0 and tws > 0")
    return interpolated(kn, "tws_kn", P.polar(rows.sparkSession), "tws", SPEEDS)


def mode_speed(mode: Column) -> Column:
    return F.when(mode == "upwind", F.col("upwind")).when(mode == "reach", F.col("reach")).otherwise(F.col("downwind"))


def get_boat_efficiency(p, asof, within="1 hour"):
    rows = on_polar(of(p, asof, within, stw=STW, tws=WIND + "speedTrue", awa=WIND + "angleApparent", roll=ATT + "roll"))
    rows = rows.withColumn("mode", C.mode_from_apparent(F.coalesce(F.degrees("awa"), F.lit(0.0)))).withColumn("polar", mode_speed(F.col("mode"))).withColumn("eff", 100 * F.col("stw_kn") / F.col("polar"))
    return rows.select(
        r("stw_kn", 2).alias("actual_speed_knots"), r("polar", 2).alias("polar_speed_knots"), r("eff", 1).alias("efficiency_percent"), r(F.col("stw_kn") - F.col("polar"), 2).alias("gap_knots"),
        F.col("mode").alias("sailing_mode"), r("tws_kn", 1).alias("true_wind_speed"), r(F.degrees("roll"), 1).alias("heel_degrees"), C.efficiency_grade(F.col("eff")).alias("assessment"),
    )


def get_current_polar(p, asof, within="1 hour"):
    rows = of(p, asof, within, tws=WIND + "speedTrue").withColumn("stw", F.lit(1.0))
    text = F.concat(F.lit("Polars for "), U.fixed(F.col("tws_kn"), 1), F.lit(" knots true wind"))
    return on_polar(rows).select(r("tws_kn", 1).alias("true_wind_speed_knots"), r("upwind", 2).alias("upwind_speed_knots"), r("reach", 2).alias("reaching_speed_knots"), r("downwind", 2).alias("downwind_speed_knots"), r("upwind_angle", 1).alias("upwind_angle_degrees"), text.alias("description"))


def _boat_speed(polar: str) -> Column:
    return F.struct(r("stw_kn", 2).alias("actual_knots"), r(polar, 2).alias("polar_knots"), r("eff", 1).alias("efficiency_percent"), r(F.col("stw_kn") - F.col(polar), 2).alias("gap_knots"))


def get_upwind_analysis(p, asof, within="1 hour"):
    rows = on_polar(of(p, asof, within, stw=STW, tws=WIND + "speedTrue", awa=WIND + "angleApparent", roll=ATT + "roll", vmg=VMG))
    rows = rows.withColumns({"eff": 100 * F.col("stw_kn") / F.col("upwind"), "heel": F.degrees("roll"), "vmg_kn": U.knots_short(F.col("vmg")), "goal": F.col("upwind") * 0.85})
    vmg = F.struct(r("vmg_kn", 2).alias("actual_vmg"), r("goal", 2).alias("target_vmg"), r(100 * F.col("vmg_kn") / F.col("goal"), 1).alias("efficiency_percent"), r(F.col("vmg_kn") - F.col("goal"), 2).alias("gap_knots"))
    trim = F.struct(r(F.degrees("awa"), 1).alias("apparent_wind_angle_deg"), r("heel", 1).alias("heel_degrees"), C.upwind_heel(F.col("heel")).alias("heel_assessment"))
    advice = C.upwind_advice(F.col("eff"), F.coalesce("heel", F.lit(0.0)), F.col("stw_kn"), F.col("upwind"))
    return rows.select(_boat_speed("upwind").alias("boat_speed_analysis"), F.when(F.col("vmg_kn").isNotNull(), vmg).alias("vmg_analysis"), trim.alias("trim_analysis"), advice.alias("recommendations"))


def get_downwind_analysis(p, asof, within="1 hour"):
    rows = on_polar(of(p, asof, within, stw=STW, tws=WIND + "speedTrue", roll=ATT + "roll")).withColumns({"eff": 100 * F.col("stw_kn") / F.col("downwind"), "heel": F.degrees("roll")})
    trim = F.struct(r("heel", 1).alias("heel_degrees"), C.downwind_heel(F.col("heel")).alias("heel_assessment"))
    return rows.select(_boat_speed("downwind").alias("boat_speed_analysis"), trim.alias("trim_analysis"), C.downwind_advice(F.col("eff"), F.coalesce("heel", F.lit(0.0)), F.col("stw_kn"), F.col("downwind")).alias("recommendations"))


def get_all_polars(p, asof, within=""):
    return P.polar(p.sparkSession)


def get_current_sails(p, asof, within="1 hour"):
    rows = texts(p, asof, within, main="sails.mainsail", jib="sails.jib", jib_state="sails.jib.state", spi="sails.spinnaker", spi_state="sails.spinnaker.state")
    d = lambda c, x: F.coalesce(c, F.lit(x))
    return rows.select(d("main", "unknown").alias("mainsail"), d("jib", "none").alias("jib"), d("jib_state", "unknown").alias("jib_state"), d("spi", "none").alias("spinnaker"), d("spi_state", "none").alias("spinnaker_state"), C.sail_configuration(F.col("main"), F.col("jib"), F.col("spi")).alias("configuration"))


def get_race_start(p, asof, within="2 hours"):
    rows = texts(p, asof, within, name="race.start.name", start="race.start.time", cls="race.start.class", line="race.start.lineLength")
    left = F.floor(F.try_to_timestamp("start").cast("double") - asof.cast("double"))
    return rows.select(
        F.coalesce("name", F.lit("Race 1")).alias("race_name"), F.col("start").alias("start_time"), left.alias("time_to_start_seconds"), F.when(left.isNull(), "unknown").otherwise(C.start_status(left)).alias("start_status"),
        C.signal_sequence(left).alias("signal_sequence"), F.coalesce("cls", F.lit("J/30")).alias("class"), F.coalesce("line", F.lit("unknown")).alias("start_line_length_meters"),
    )


def get_distance_to_line(p, asof, within="2 hours"):
    """To the line's reference point; without one, to a point 0.01 degrees north of the boat, and flagged."""
    rows = of(p, asof, within, lat=LAT, lon=LON, a="race.startLine.latitude", b="race.startLine.longitude").filter("lat is not null and lon is not null")
    rows = rows.withColumns({"known": F.col("a").isNotNull() & F.col("b").isNotNull(), "la": F.coalesce("a", F.col("lat") + 0.01), "lb": F.coalesce("b", "lon")})
    m = distance(F.col("lat"), F.col("lon"), F.col("la"), F.col("lb"), EARTH_M)
    return rows.select(r("lat", 6).alias("latitude"), r("lon", 6).alias("longitude"), r("la", 6).alias("line_latitude"), r("lb", 6).alias("line_longitude"), "known", r(m, 1).alias("distance_meters"), r(U.nautical_miles(m), 3).alias("distance_nm"), C.line_status(m).alias("status"), C.line_advice(m).alias("recommendation"))


def get_race_marks(p, asof, within="2 hours"):
    rows = texts(p, asof, within, windward="race.mark.windward", leeward="race.mark.leeward", g1="race.mark.gate1", g2="race.mark.gate2", finish="race.mark.finish")
    said = lambda c: F.coalesce(c, F.lit("unknown"))
    return rows.select(said("windward").alias("windward_mark"), said("leeward").alias("leeward_mark"), F.array("g1", "g2").alias("gate_marks"), said("finish").alias("finish_line"), C.course_type(F.col("windward"), F.col("leeward"), F.col("g1")).alias("course_type"))


def on_day(p: DataFrame, date: Column) -> DataFrame:
    """Up to, not including, the next midnight."""
    start = date.cast("timestamp")
    return Series(p).between(start, start + F.expr("interval 1 day")).df


def get_sun_data(p, asof, within="", date=None):
    day = F.to_date(asof) if date is None else date
    return latest(on_day(p, day), {"sunrise": "environment.sun.sunriseTime", "sunset": "environment.sun.sunsetTime"}, value="value_string").select(day.cast("string").alias("date"), "sunrise", "sunset", F.lit("points").alias("source"))


def get_moon_data(p, asof, within="", date=None):
    day = F.to_date(asof) if date is None else date
    rows = on_day(p, day)
    hits = latest(rows, {"moonrise": "environment.moon.moonriseTime", "moonset": "environment.moon.moonsetTime"}, value="value_string")
    light = latest(rows, {"i": "environment.moon.illumination", "ph": "environment.moon.phase"}, value="value_double")
    both = hits.withColumn("k", F.lit(1)).join(F.broadcast(light.withColumn("k", F.lit(1))), "k")
    return both.select(day.cast("string").alias("date"), "moonrise", "moonset", r("i").alias("illumination"), C.moon_phase(F.col("ph")).alias("phase"), F.lit("points").alias("source"))


def get_tide_data(p, asof, within="", date=None):
    day = F.to_date(asof) if date is None else date
    rows, tide = on_day(p, day), "environment.tide.tide"
    times = latest(rows, {"high_time": tide + "HighTime", "low_time": tide + "LowTime"}, value="value_string").withColumn("k", F.lit(1))
    levels = latest(rows, {"high": tide + "HighLevel", "low": tide + "LowLevel"}, value="value_double").withColumn("k", F.lit(1))
    return times.join(F.broadcast(levels), "k").select(day.cast("string").alias("date"), "high_time", r("high").alias("high_level"), "low_time", r("low").alias("low_level"), F.lit("points").alias("source"))


EVENTS = {"environment.sun.sunriseTime": "sunrise", "environment.sun.sunsetTime": "sunset", "environment.moon.moonriseTime": "moonrise", "environment.moon.moonsetTime": "moonset"}


def get_next_event(p, asof, within=""):
    """The earliest of today's sun and moon times that is still to come; no row if none is."""
    names = F.create_map(*(F.lit(x) for kv in EVENTS.items() for x in kv))
    last = Series(on_day(p, F.to_date(asof)).filter(F.col("measurement").isin(*EVENTS)), value="value_string").last()
    rows = last.select(F.try_to_timestamp("value_string").alias("at"), names[F.col("measurement")].alias("type"))
    return rows.filter(F.col("at") > asof).orderBy("at", "type").limit(1).select(F.date_format("at", P.CLOCK).alias("time"), "type")


def at_location(p: DataFrame, location: str) -> DataFrame:
    """The points whose ``location`` tag names the place; those that name none are not there."""
    return p.filter(F.try_element_at("tags", F.lit("location")) == location)


def get_current_weather(p, asof, within="30 minutes", location="stamford"):
    w, p = "weather.", at_location(p, location)
    rows = of(p, asof, within, t=w + "temperature", h=w + "humidity", pr=w + "pressure", s=w + "wind_speed", d=w + "wind_direction", g=w + "wind_gust", rain=w + "precipitation")
    sky = texts(p, asof, within, sky=w + "condition").withColumn("k", F.lit(1))
    rows = rows.withColumn("k", F.lit(1)).join(F.broadcast(sky), "k")
    return rows.select(
        r("t", 1).alias("temperature_celsius"), r(U.fahrenheit(F.col("t")), 1).alias("temperature_fahrenheit"), r("h", 0).alias("humidity_percent"), r("pr", 1).alias("pressure_hpa"), r("s", 1).alias("wind_speed_kmh"),
        r(U.knots_from_kmh(F.col("s")), 1).alias("wind_speed_knots"), r("d", 0).alias("wind_direction_degrees"), r("g", 1).alias("wind_gust_kmh"), r(U.knots_from_kmh(F.col("g")), 1).alias("wind_gust_knots"),
        r("rain", 1).alias("precipitation_mm"), F.coalesce("sky", F.lit("Unknown")).alias("condition"), C.weather_text(F.coalesce("sky", F.lit("")), F.col("t"), F.col("h"), F.col("pr")).alias("assessment"),
    )


def get_weather_trend(p, asof, within="30 minutes", before="60 minutes", location="stamford"):
    """Always one row: stable and 0 where one of the two values is missing. A rise has its sign."""
    rows = two_ranges(at_location(p, location).filter(F.col("measurement") == "weather.temperature"), [], "value_double", asof, within, before)
    change = F.coalesce("change", F.lit(0.0))
    label = C.trend(change, 0.5, "Warming", "Cooling")
    text = F.concat(F.lit("Temperature "), F.lower(label), F.when(change > 0, " (+").otherwise(" ("), U.fixed(change, 1), F.lit("°C last 30 min)"))
    return rows.select(label.alias("temperature_trend"), F.round(change, 1).alias("temperature_change_celsius"), text.alias("assessment"))


def get_wind_assessment(p, asof, within="30 minutes", location="stamford"):
    """No row without wind."""
    w = get_current_weather(p, asof, within, location).filter("wind_speed_knots is not null")
    wind, gust = F.col("wind_speed_knots"), F.coalesce("wind_gust_knots", "wind_speed_knots")
    span = F.concat(U.fixed(wind, 1), F.lit(" - "), U.fixed(gust, 1), F.lit(" knots"))
    return w.select(
        "wind_speed_knots", "wind_gust_knots", "wind_direction_degrees", C.wind_condition(wind).alias("sailing_condition"), span.alias("wind_range"), C.wind_advice(wind, gust).alias("recommendations"), C.sail_plan(wind).alias("best_sail_combo")
    )


def get_crew_status(p, asof, within="1 hour"):
    c = "crew."
    roles = {"current_helmsman": "helmsman.name", "helmsman_watch_start": "helmsman.watchStart", "helmsman_time_at_helm": "helmsman.timeAtHelm", "tactician": "tactician.name", "main_trimmer": "mainTrimmer.name", "jib_trimmer": "jibTrimmer.name", "bowman": "bowman.name", "pit_crew": "pit.name"}
    rows = texts(p, asof, within, **{k: c + v for k, v in roles.items()}).withColumn("k", F.lit(1))
    named = near(p, asof, within).filter(F.col("measurement").startswith(c) & F.col("measurement").contains(".name") & F.col("value_string").isNotNull())
    count = named.agg(F.count_distinct("measurement").cast("int").alias("crew_count")).withColumn("k", F.lit(1))
    return rows.join(F.broadcast(count), "k").select(*roles, "crew_count")


def get_helmsman_history(p, asof, within="8 hours", n=10):
    """Newest first, a row for each change, each with the number of changes and the hours looked back over."""
    rows = Series(p).range(asof, within).measurement("crew.helmsman.change").limit(n, F.desc("time"))
    many = rows.agg(F.count(F.lit(1)).cast("int").alias("total_changes")).withColumn("k", F.lit(1))
    rows = rows.withColumn("k", F.lit(1)).join(F.broadcast(many), "k")
    span = (asof.cast("timestamp").cast("double") - (asof.cast("timestamp") - F.expr(f"interval {within}")).cast("double")) / 3600
    return rows.select(F.col("value_string").alias("helmsman"), F.date_format("time", P.CLOCK).alias("time"), F.col("order"), "total_changes", span.alias("race_duration_hours"))


def get_crew_workload(p, asof, within="5 minutes"):
    wind, speed = WIND + "speedTrue", SOG
    mean = lambda m: F.avg(F.when(F.col("measurement") == m, F.col("value_double")))
    rows = near(p, asof, within).filter(F.col("measurement").isin(wind, speed)).agg(U.knots_by_division(mean(wind)).alias("w"), U.knots_by_division(mean(speed)).alias("s"))
    return rows.select(r("w", 1).alias("wind_speed"), r("s", 1).alias("boat_speed"), C.workload(F.col("w")).alias("x")).select("wind_speed", "boat_speed", "x.*")


def stationed(p: DataFrame) -> DataFrame:
    """Points with a ``station`` column, from the tag of that name where they have none of their own; 'unknown' without either."""
    own = [F.col("station")] if "station" in p.columns else []
    tag = [F.try_element_at("tags", F.lit("station"))] if "tags" in p.columns else []
    return p.withColumn("station", F.coalesce(*own, *tag, F.lit("unknown")))


def get_buoy_data(p, asof, within="1 hour"):
    """A row for each station; unknown stations get the default row."""
    rows = near(stationed(p), asof, within).filter(F.col("measurement").startswith("buoy."))
    rows = latest(rows, {"wind_speed": "buoy.wind_speed_knots", "wind_gust": "buoy.wind_gust_knots", "wind_direction": "buoy.wind_direction", "wave_height": "buoy.wave_height", "water_temp": "buoy.water_temperature"}, by=["station"], value="value_double")
    known = lookup(rows, P.buoys(p.sparkSession), "station", {"name": "Unknown", "lat": 0.0, "lon": 0.0, "distance": "?", "location": P.place(0.0, 0.0)})
    return known.select("station", "name", "lat", "lon", "location", "distance", *(r(c).alias(c) for c in ("wind_speed", "wind_gust", "wind_direction", "wave_height", "water_temp")))


def get_wind_comparison(p, asof, within="1 hour"):
    """Winds as they are shown, with one decimal."""
    rows = get_buoy_data(p, asof, within).filter("wind_speed is not null")
    first = F.array_position(F.array(*(F.lit(b[0]) for b in P.BUOYS)), F.col("station"))
    order = F.when(first > 0, first).otherwise(len(P.BUOYS) + 1)  # of equal winds the first station in the list counts
    line = F.concat_ws(", ", F.format_string("%s %s: %.1f kts", "station", "name", "wind_speed"), F.when(F.col("wind_gust").isNotNull(), F.format_string("gust %.1f kts", "wind_gust")), F.col("distance"))
    out = rows.agg(F.array_sort(F.collect_list(line)).alias("summary"), F.max_by("name", F.struct("wind_speed", (-order).alias("o"), "station")).alias("strongest"), F.min_by("name", F.struct("wind_speed", order.alias("o"), "station")).alias("weakest"), F.round(F.avg("wind_speed"), 1).alias("average_wind"))
    return out.withColumn("assessment", C.fleet_wind(F.col("average_wind")))


NUMERIC: dict[str, Tool] = {f.__name__: f for f in (get_heading, get_position, get_sog, get_cog, get_stw, get_vmg, get_performance, get_wind_apparent, get_wind_true, get_wind_direction, get_depth, get_water_temp, get_current, get_heel, get_pitch, get_attitude, get_race_data, get_boat_efficiency, get_current_polar, get_upwind_analysis, get_downwind_analysis, get_all_polars, get_distance_to_line, get_weather_trend, get_crew_workload)}
TEXT: dict[str, Tool] = {f.__name__: f for f in (get_current_sails, get_race_start, get_race_marks, get_sun_data, get_tide_data, get_next_event, get_crew_status, get_helmsman_history)}
MIXED: dict[str, Tool] = {f.__name__: f for f in (get_moon_data, get_current_weather, get_wind_assessment)}
BUOY: dict[str, Tool] = {f.__name__: f for f in (get_buoy_data, get_wind_comparison)}
