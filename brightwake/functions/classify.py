"""Classification ladders, as WHEN chains over lists of bounds. The labels are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first bound that the value is under; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(value < bound, label)
    return out.otherwise(rest)


def above(value: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first bound that the value is over; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(value > bound, label)
    return out.otherwise(rest)


def present(*items: Column) -> Column:
    """An array of those that aren't null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def mode_from_apparent(deg: Column) -> Column:
    """By apparent angle, 0 to 360."""
    a = F.pmod(deg, F.lit(360.0))
    return F.when((a < 60) | (a > 300), "upwind").when((a > 150) & (a < 210), "downwind").otherwise("reach")


def mode_from_true(deg: Column) -> Column:
    """By true angle, either sign."""
    a = F.abs(deg)
    return F.when(a < 60, "upwind").when(a <= 150, "reach").otherwise("downwind")


def efficiency_grade(percent: Column) -> Column:
    return above(percent, [(95, "Excellent"), (90, "Good"), (80, "Fair")], "Poor")


def upwind_heel(deg: Column) -> Column:
    return F.when(deg < 12, "Underheeled").when(deg > 18, "Overheeled").when(deg.isNotNull(), "Optimal")


def downwind_heel(deg: Column) -> Column:
    return F.when(deg < 5, "Good").when(deg > 12, "Too much heel").when(deg.isNotNull(), "Acceptable")


def upwind_advice(efficiency: Column, heel: Column, actual: Column, polar: Column) -> Column:
    low = efficiency < 85
    gap = F.format_string("Speed gap of %.1fkt: Check trim", polar - actual)
    return present(
        F.when(low & (heel > 18), "Heel excessive (>18°): Ease mainsheet").when(low & (heel < 12), "Underheeled (<12°): Move crew out"),
        F.when(low, gap).when(efficiency < 90, "Performance acceptable, minor trim adjustments").when(efficiency < 95, "Good performance, keep current trim").otherwise("Excellent performance! Maintain current setup"),
    )


def downwind_advice(efficiency: Column, heel: Column, actual: Column, polar: Column) -> Column:
    low = efficiency < 85
    gap = F.format_string("Speed gap of %.1fkt: Check sail trim", polar - actual)
    return present(
        F.when(low, gap).when(efficiency < 90, "Reasonable downwind performance").when(efficiency < 95, "Good downwind speed").otherwise("Excellent downwind performance!"),
        F.when(low & (heel > 10), "Too much heel: Reduce crew weight to windward"),
        F.when(low, "Consider different sail combination (jib size, spinnaker)"),
    )


# Bounds and texts of the ladders, as the tools write them.
WIND_CONDITIONS = [
    (5, "Light wind - challenging"),
    (8, "Light breeze - good for training"),
    (12, "Moderate breeze - optimal"),
    (16, "Fresh breeze - good racing conditions"),
    (20, "Strong breeze - manageable"),
    (25, "Strong gale - expert sailing"),
]
SAILS = [(5, "Main + Jib1 (max area)"), (8, "Main + Jib1"), (12, "Main + Jib2"), (16, "Main + Jib3 or Jib2"), (20, "Main (reefed) + Jib3")]
FLEET_WIND = [(5, "Light wind across LIS"), (10, "Light to moderate wind"), (15, "Moderate to fresh wind"), (20, "Fresh to strong wind")]
LINE_STATUS = [(500, "Very close to line"), (1000, "Close to line"), (2000, "Moderate distance"), (5000, "Far from line")]
LINE_ADVICE = [
    (200, "⚠️ DANGER: Too close! Risk of early start."),
    (500, "Getting close. Prepare to come down to line."),
    (1500, "Good position. Plan approach to line."),
    (3000, "Adequate distance. Begin working toward line."),
]
WORKLOAD = [(8, "light"), (12, "moderate"), (16, "high")]
WORKLOAD_PERCENT = {"light": 20, "moderate": 50, "high": 75, "intense": 100}
ROTATION_MINUTES = {"light": 90, "moderate": 60, "high": 45, "intense": 30}
WATCHES = {"light": 2, "moderate": 3, "high": 4, "intense": 5}
PRIORITY = ["Helmsman", "Main Trimmer", "Jib Trimmer", "Bowman"]
WORKLOAD_TEXT = {
    "light": "Light conditions. Crew can focus on trim and tactics.",
    "moderate": "Moderate conditions. Regular rotation recommended.",
    "high": "High workload. Frequent helm rotations advised.",
    "intense": "Intense conditions. Maximum alertness required.",
}


def wind_condition(knots: Column) -> Column:
    return below(knots, WIND_CONDITIONS, "Severe gale - dangerous")


def sail_plan(knots: Column) -> Column:
    return below(knots, SAILS, "Storm jib only")


def wind_advice(wind: Column, gust: Column) -> Column:
    first = below(wind, [(5, "Light conditions - focus on smooth sailing"), (8, "Good for light air sailing"), (12, "Optimal conditions"), (16, "Good racing wind"), (20, "Strong conditions - reef mainsail")], "WARNING: Severe conditions")
    reef = F.concat(F.lit("Consider reefing if gusts exceed "), F.format_string("%.1f", wind + 5))
    second = F.when(wind < 5, "Avoid sudden maneuvers").when(wind < 8, "Watch for wind shear").when(wind < 12, "Standard sail configuration").when(wind < 16, reef).when(wind < 20, "Consider jib2 or storm jib").when(wind.isNotNull(), "Consider returning to harbor")
    return present(first, second, F.when(wind >= 20, "Double-check all safety equipment"), F.when(gust > wind + 8, "Significant gusts detected - adjust trim frequently"))


def weather_text(condition: Column, temperature: Column, humidity: Column, pressure: Column) -> Column:
    parts = F.concat(
        F.when(condition.contains("Rain"), "⚠️ RAIN. ").otherwise(""),
        F.when(condition.contains("Thunderstorm"), "⚠️ THUNDERSTORM. ").otherwise(""),
        F.when(condition.contains("Fog"), "⚠️ FOG. ").otherwise(""),
        F.when(temperature < 0, "🥶 Below freezing. ").otherwise(""),
        F.when(humidity > 90, "💧 High humidity. ").otherwise(""),
        F.when(pressure < 1010, "⬇️ Falling pressure (deteriorating). ").otherwise(""),
        F.when(pressure > 1025, "⬆️ Rising pressure (improving). ").otherwise(""),
    )
    return F.when(parts == "", "✅ Good conditions").otherwise(parts)


def trend(change: Column, step: float, up: str, down: str, flat: str = "Stable") -> Column:
    return F.when(change > step, up).when(change < -step, down).when(change.isNotNull(), flat)


def of_level(level: Column, values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[level]


def workload(wind: Column) -> Column:
    """The level and all that follows from it, as a struct; 10 knots without wind data."""
    level = below(F.coalesce(wind, F.lit(10.0)), WORKLOAD, "intense")
    watches = of_level(level, WATCHES)
    positions = F.slice(F.array(*map(F.lit, PRIORITY)), 1, F.when(level == "light", 0).otherwise(watches - 1))
    return F.struct(level.alias("level"), of_level(level, WORKLOAD_PERCENT).alias("percentage"), of_level(level, ROTATION_MINUTES).alias("rotation_minutes"), watches.alias("watches"), positions.alias("priority_positions"), of_level(level, WORKLOAD_TEXT).alias("assessment"))


def fleet_wind(knots: Column) -> Column:
    return below(knots, FLEET_WIND, "Strong wind conditions across LIS")


def start_status(seconds: Column) -> Column:
    return above(seconds, [(300, "Preparing"), (0, "Countdown"), (-30, "Starting")], "Started")


def signal_sequence(seconds: Column) -> Column:
    counting = F.concat(F.floor(seconds).cast("string"), F.lit("s to start (1 horn blast at 0)"))
    return (
        F.when(seconds.isNull(), "No start time set").when(seconds > 600, "10+ minutes: Prepare").when(seconds > 300, "5-10 min: 1st Warning Signal (3 horn blasts)")
        .when(seconds > 240, "4 min: Preparatory Signal (2 horn blasts)").when(seconds > 0, counting).when(seconds > -30, "START! (Continuing horn)").otherwise("Race started")
    )


def line_status(metres: Column) -> Column:
    return below(metres, LINE_STATUS, "Very far from line")


def line_advice(metres: Column) -> Column:
    return below(metres, LINE_ADVICE, "Far from line. Start heading toward start line.")


def course_type(windward: Column, leeward: Column, gate: Column) -> Column:
    both = windward.isNotNull() & leeward.isNotNull()
    return F.when(both & gate.isNotNull(), "Full Olympic (upwind/downwind/upwind)").when(both, "Simple windward/leeward").otherwise("Unknown/Custom course")


def wind_side(rad: Column) -> Column:
    """Signed or full-circle angles."""
    return F.when(F.pmod(rad, F.lit(6.283185307179586)) < 3.141592653589793, "starboard").when(rad.isNotNull(), "port")


def heel_side(rad: Column) -> Column:
    return F.when(rad > 0, "starboard").when(rad.isNotNull(), "port")


def trim(rad: Column) -> Column:
    return F.when(rad > 0, "bow_up").when(rad.isNotNull(), "bow_down")


MOON = [(6.25, "new_moon"), (18.75, "waxing_crescent"), (31.25, "first_quarter"), (43.75, "waxing_gibbous"), (56.25, "full_moon"), (68.75, "waning_gibbous"), (81.25, "last_quarter"), (93.75, "waning_crescent")]


def moon_phase(phase: Column, turn: float = 1.0) -> Column:
    """``turn`` is the phase of a full cycle: 1, or two pi for angles."""
    return below(phase / turn * 100, MOON, "new_moon")


WEATHER_CODES = {"Clear": [0], "Partly cloudy": [1, 2], "Overcast": [3], "Foggy": [45, 48], "Drizzle": [51, 53, 55], "Rain": [61, 63, 65], "Snow": [71, 73, 75, 77], "Rain showers": [80, 81, 82], "Snow showers": [85, 86], "Thunderstorm": [95, 96, 99]}


def weather_code(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for text, codes in WEATHER_CODES.items():
        out = out.when(code.isin(codes), text)
    return out.otherwise(F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def start_line_side(metres: Column) -> Column:
    return F.when(F.abs(metres) < 50, "on line").when(metres > 0, "before").when(metres.isNotNull(), "behind")


def fleet_delta(vmg_difference: Column) -> Column:
    return trend(vmg_difference, 0.1, "faster", "slower", "equal")


def lateral_side(miles: Column) -> Column:
    return trend(miles, 0.05, "right", "left", "on axis")


def helm_overdue(seconds: Column) -> Column:
    return seconds >= 7200


def wind_class(knots: Column) -> Column:
    return below(knots, [(4, "very_light"), (7, "light"), (12, "moderate"), (16, "fresh"), (20, "strong")], "gale")


def tack_class(deg: Column) -> Column:
    return below(F.abs(deg), [(45, "close_hauled"), (90, "close_reach"), (120, "beam_reach"), (160, "broad_reach")], "run")


def boat_mode(wind_direction: Column, cog: Column) -> Column:
    a = F.abs(F.pmod(wind_direction - cog + 540, F.lit(360.0)) - 180)
    return below(a, [(45, "upwind"), (135, "reaching")], "downwind")


def sail_configuration(main: Column, jib: Column, spinnaker: Column) -> Column:
    worn = F.concat_ws(" + ", main, F.when(jib != "none", jib), F.when(spinnaker != "none", spinnaker))
    return F.when(worn == "", "None set").otherwise(worn)


def sea_state(pitch: Column, roll: Column, wave_height: Column) -> Column:
    """By three limits that each add to a score."""
    score = F.when(pitch > 20, 3).otherwise(0) + F.when(roll > 25, 3).otherwise(0) + F.when(wave_height > 1.5, 2).otherwise(0)
    return below(score, [(3, "calm"), (6, "moderate")], "rough")


def sea_state_graded(pitch: Column, roll: Column, wave_height: Column) -> Column:
    """By grades of each motion; the other published form."""

    def grade(x: Column, bounds: list[tuple[float, int]], most: int) -> Column:
        out = F.lit(most)
        for bound, points in reversed(bounds):
            out = F.when(x < bound, points).otherwise(out)
        return out

    score = grade(pitch, [(10, 0), (15, 1), (20, 2)], 3) + grade(roll, [(8, 0), (15, 1), (25, 2)], 3) + grade(wave_height, [(0.5, 0), (1.5, 1)], 2)
    return F.when(score <= 2, "calm").when(score <= 4, "moderate").otherwise("rough")


def adjusted_sails(plan: Column, heel: Column, sea: Column, efficiency: Column) -> Column:
    """A plan's text with what heel, sea and a poor ratio to the polar ask for."""
    return F.concat_ws("; ", plan, F.when(heel > 22, "reduce sail"), F.when(sea == "rough", "reef the main"), F.when(efficiency < 0.85, "check the configuration against the polar"))


# Normal limits in display units, (measurement, lowest or highest allowed, critical, whether low is bad).
LIMITS = [("roll", 30.0, 40.0, False), ("pitch", 15.0, 20.0, False), ("tws", 30.0, 40.0, False), ("aws", 35.0, 45.0, False), ("cpu_temperature", 80.0, 85.0, False), ("house_voltage", 12.0, 11.5, True), ("battery_soc", 20.0, 10.0, True)]


def limit_state(name: Column, value: Column) -> Column:
    """ok, warn or critical by the table of limits; null for names that it lacks. Angles count by size."""
    out = F.lit(None).cast("string")
    for key, warn, critical, low in LIMITS:
        x = F.abs(value) if key in ("roll", "pitch") else value
        state = F.when(x < critical, "critical").when(x < warn, "warn") if low else F.when(x > critical, "critical").when(x > warn, "warn")
        out = F.when(name == key, state.otherwise("ok")).otherwise(out)
    return out


RINGS = [(0.2, "0.2 nm"), (0.5, "0.5 nm"), (1.0, "1 nm")]


def ring(miles: Column) -> Column:
    """The innermost distance ring that a mark lies in; null outside all."""
    out = F.lit(None).cast("string")
    for bound, label in reversed(RINGS):
        out = F.when(miles < bound, label).otherwise(out)
    return out
