"""Registered queries over feeds and sinks: events written in each text or binary form and read back by its reader.

The SQL says what must come back, straight from the events, so a query is right only if writer and reader agree with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwake.functions import angles, classify, sails, units
from brightwake.plans.series_queries import STAMP, asof, events, r8, stamp
from brightwake.sources import feeds, sinks
from brightwake.sources import points as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def text(form: str, *cells: Column | str) -> Column:
    return F.format_string(form, *(F.col(c) if isinstance(c, str) else c for c in cells))


def by_day(rows: DataFrame, item: Column, by: str = "user") -> DataFrame:
    """(user, day, items) of a day's items in order of time; a day of one user bounds the list."""
    one = rows.groupBy(by, F.date_format("time", "yyyy-MM-dd").alias("day")).agg(F.array_sort(F.collect_list(F.struct("time", "event_id", item.alias("item")))).alias("l"))
    return one.select(by, "day", F.transform("l", lambda x: x["item"]).alias("items"))


def eid() -> Column:
    return F.col("event_id")


@query(f"SELECT event_id, event_type AS measurement, CAST(user_id AS VARCHAR) AS \"user\", CASE WHEN event_id % 3 = 0 THEN value END AS number, CASE WHEN event_id % 3 = 1 THEN 'of ' || event_type || ', a=b' END AS text, CASE WHEN event_id % 3 = 2 THEN value > 20 END AS truth, {STAMP.format('ts')} AS seen FROM events")
def feed_line_protocol(spark, sf_dir):
    """Points of all three types through lines and back, with blanks, commas and equal signs in names and tags."""
    rows = events(spark, sf_dir)
    points = rows.select(
        "time", F.concat(F.lit("deck, aft="), "kind").alias("measurement"), F.concat(F.lit("the value "), eid().cast("string")).alias("field"), F.when(eid() % 3 == 0, F.col("value")).alias("value_double"),
        F.when(eid() % 3 == 1, F.concat(F.lit("of "), "kind", F.lit(", a=b"))).alias("value_string"), F.when(eid() % 3 == 2, F.col("value") > 20).alias("value_boolean"), F.create_map(F.lit("own user"), F.concat(F.lit("no "), F.col("user").cast("string"))).alias("tags"),
    )
    back = feeds.line_protocol(sinks.as_line_protocol(points))
    return back.select(
        F.regexp_extract("field", r"^the value (\d+)$", 1).cast("long").alias("event_id"), F.regexp_extract("measurement", "^deck, aft=(.*)$", 1).alias("measurement"), F.regexp_extract(F.try_element_at("tags", F.lit("own user")), "^no (.*)$", 1).alias("user"),
        F.col("value_double").alias("number"), F.col("value_string").alias("text"), F.col("value_boolean").alias("truth"), stamp("time").alias("seen"),
    )


@query(f"SELECT event_id, 'vessels.self' AS context, 'hub' AS source, value AS number, {STAMP.format('m')} AS seen FROM (SELECT event_id, value, date_trunc('milliseconds', max(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE))) AS m FROM events)")
def feed_hub_updates(spark, sf_dir):
    """A day of a user's values as one hub update, and back."""
    rows = events(spark, sf_dir).withColumns({"path": F.concat_ws(".", "kind", eid().cast("string")), "day": F.to_date("time")})
    back = feeds.deltas(sinks.as_deltas(rows, ["user", "day"], "hub"), "delta")
    return back.select(F.substring_index("path", ".", -1).cast("long").alias("event_id"), "context", "source", F.col("value").cast("double").alias("number"), stamp("time").alias("seen"))


_CSV_TEXT = "#datatype,string,long,double\n#group,false,false,false\n,result,table,_value,_field,host\n"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each day of a user: one table for clicks, one for all else, with comments, and empty cells for every fourth."""
    rows = events(spark, sf_dir)
    line = text(",,%d,%s,%s,%d", F.when(F.col("kind") == "click", 0).otherwise(1), F.when(eid() % 4 == 0, "").otherwise(F.col("value").cast("string")), "kind", "event_id")
    click = F.col("kind") == "click"
    days = by_day(rows, F.struct(click.alias("click"), line.alias("line")))
    table = lambda flag: F.array_join(F.transform(F.filter("items", lambda x: x["click"] == flag), lambda x: x["line"]), "\r\n")
    head = F.lit(_CSV_TEXT.replace("\n", "\r\n"))
    return days.select("user", "day", F.concat(head, table(F.lit(True)), F.lit("\r\n\r\n"), head, table(F.lit(False)), F.lit("\r\n")).alias("text"))


@query("SELECT user_id AS \"user\", strftime(ts, '%Y-%m-%d') AS day, event_id, event_type AS kind, CASE WHEN event_id % 4 <> 0 THEN value END AS number FROM events")
def feed_annotated_csv(spark, sf_dir):
    cells = feeds.annotated_csv(_replies(spark, sf_dir))
    one = cells.groupBy("user", "day", "block", "row").agg(*(F.max(F.when(F.col("column") == c, F.col("value"))).alias(n) for c, n in (("host", "event_id"), ("_field", "kind"), ("_value", "number"))))
    return one.select("user", "day", F.col("event_id").cast("long").alias("event_id"), "kind", F.col("number").cast("double").alias("number"))


@query("SELECT user_id AS \"user\", strftime(ts, '%Y-%m-%d') AS day, CAST(event_type <> 'click' AS INTEGER) AS \"table\", arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) FILTER (event_id % 4 <> 0) AS number FROM events GROUP BY ALL")
def feed_merged_tables(spark, sf_dir):
    """Each table of a reply as one object, later rows over earlier ones."""
    found = feeds.merged_tables(feeds.annotated_csv(_replies(spark, sf_dir)), ["user", "day", "block"])
    at = lambda k: F.try_element_at("object", F.lit(k))
    return found.select("user", "day", at("table").cast("int").alias("table"), at("host").cast("long").alias("event_id"), at("_value").cast("double").alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'boat-' || event_id ELSE substr('Boat of user ' || user_id || ' and friends', 1, 20) END AS name, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 36 + event_id % 4 END AS INTEGER) AS type, round(40 + value / 1000, 8) AS latitude, round(value * 1.94384, 8) AS sog_kts, round(degrees(event_id % 6), 8) AS cog_deg FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND (event_id % 7 = 0 OR event_id % 17 <> 0)")
def feed_vessels(spark, sf_dir):
    """Each event as a vessel tree of one: the own boat, boats without a place and boats of other types don't come back."""
    e = eid()
    name = F.when(e % 5 == 0, "").otherwise(text('"name":"Boat of user %d and friends",', "user"))
    kind = F.when(e % 7 == 0, "").otherwise(text('"design.aisShipType":{"value":{"id":%d}},', F.when(e % 17 == 0, F.lit(70).cast("long")).otherwise(36 + e % 4)))
    place = F.when(e % 13 == 0, "").otherwise(F.concat(F.lit('"navigation.position":{"value":{"latitude":'), (40 + F.col("value") / 1000).cast("string"), F.lit(',"longitude":-73.5}},')))
    tree = F.concat(text('{"boat-%d":{"self":%s,', "event_id", (e % 11 == 0).cast("string")), name, kind, place, F.lit('"navigation.speedOverGround":{"value":'), F.col("value").cast("string"), text('},"navigation.courseOverGroundTrue":{"value":%d}}}', e % 6))
    found = feeds.vessels(events(spark, sf_dir).select("event_id", tree.alias("text")))
    return found.select("event_id", "name", "type", r8("latitude").alias("latitude"), r8("sog_kts").alias("sog_kts"), r8("cog_deg").alias("cog_deg"))


@query("SELECT event_id, round(radians(value % 60 - 30), 8) AS roll, round(radians(event_id % 40 - 20), 8) AS pitch, round(radians(event_id % 360), 8) AS yaw FROM events WHERE event_id % 9 <> 0")
def feed_attitude(spark, sf_dir):
    """Attitude sentences; every ninth lacks its roll and goes."""
    line = sinks.sentence("HEATT", F.when(eid() % 9 != 0, (F.col("value") % 60 - 30).cast("string")), eid() % 40 - 20, eid() % 360)
    found = feeds.attitude(events(spark, sf_dir).select("event_id", line.alias("line")))
    return found.select("event_id", r8("roll").alias("roll"), r8("pitch").alias("pitch"), r8("yaw").alias("yaw"))


@query("SELECT event_id, 'SOL_COMPUTED' AS status, CASE WHEN event_id % 2 = 0 THEN 'NARROW_INT' ELSE 'L1_FLOAT' END AS solution, value AS baseline, round(radians(event_id % 360), 8) AS heading, round(radians(event_id % 40 - 20), 8) AS pitch, round(radians(0.25), 8) AS heading_deviation FROM events WHERE event_id % 5 <> 0 AND event_id % 6 <> 1")
def feed_heading(spark, sf_dir):
    """Headings of two aerials; those without observations or a solution go."""
    status = F.when(eid() % 5 == 0, "INSUFFICIENT_OBS").otherwise("SOL_COMPUTED")
    solution = F.when(eid() % 6 == 1, "NONE").when(eid() % 2 == 0, "NARROW_INT").otherwise("L1_FLOAT")
    line = F.concat(F.when(eid() % 2 == 0, "#UNIHEADINGA").otherwise("#HEADINGA"), F.lit(",97,GPS;"), F.concat_ws(",", status, solution, F.col("value").cast("string"), (eid() % 360).cast("string"), (eid() % 40 - 20).cast("string"), F.lit("0.0"), F.lit("0.25")), F.lit("*1f2e3d4c"))
    found = feeds.heading(events(spark, sf_dir).select("event_id", line.alias("line")))
    return found.select("event_id", "status", "solution", "baseline", *(r8(c).alias(c) for c in ("heading", "pitch", "heading_deviation")))


@query(f"SELECT user_id AS station, \"order\", {STAMP.format('minute')} AS minute, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round(radians(event_id % 361), 8) END AS wind_direction, CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS wind_speed, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(99000 + event_id % 50 * 100 AS DOUBLE) END AS pressure, round(CAST(event_id % 30 AS DOUBLE) + 273.15, 8) AS water_temperature FROM (SELECT *, date_trunc('minute', ts) AS minute, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS \"order\" FROM events) WHERE \"order\" <= 6")
def feed_buoy_text(spark, sf_dir):
    """A file for each station and day, newest first, with its header, the codes for missing values, and columns in another order than usual."""
    rows = events(spark, sf_dir)
    wdir, wspd, pres = F.when(eid() % 4 == 0, "MM").otherwise((eid() % 361).cast("string")), F.when(eid() % 10 == 3, "99.0").otherwise(feeds.measured(F.col("value"))), F.when(eid() % 6 == 0, "MM").otherwise((990 + eid() % 50).cast("string"))
    line = F.concat_ws("  ", F.date_format("time", "yyyy MM dd HH mm"), pres, wdir, wspd, (eid() % 30).cast("string"))
    files = by_day(rows, line).select(F.col("user").alias("station"), F.concat(F.lit("#YY  MM DD hh mm PRES WDIR WSPD WTMP\n#yr  mo dy hr mn hPa degT m/s degC\n"), F.array_join(F.reverse("items"), "\n"), F.lit("\n")).alias("text"))
    # A wind of exactly 99 metres a second is written with a plus, so that it is not taken for the code.
    found = feeds.buoy_rows(files, rows=6)
    return found.select("station", F.col("order").cast("long").alias("order"), stamp("time").alias("minute"), r8("wind_direction").alias("wind_direction"), "wind_speed", "pressure", r8("water_temperature").alias("water_temperature"))


@query("SELECT user_id AS station, \"order\", strftime(ts, '%Y-%m-%dT%H:%M') AS time, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 360 AS DOUBLE) END AS wind_direction, round(value / 1.852, 8) AS wind_speed_kts, round((99000 + event_id % 5000) / 100.0, 8) AS pressure_hpa FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS \"order\" FROM events) WHERE \"order\" <= 4")
def feed_observations(spark, sf_dir):
    """The four newest observations of a station's day out of its feature list; a missing direction is null there."""
    one = F.concat(
        F.lit('{"properties":{"timestamp":"'), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+00:00","windDirection":{"value":'), F.when(eid() % 3 == 0, "null").otherwise((eid() % 360).cast("string")), F.lit('},"windSpeed":{"value":'), F.col("value").cast("string"),
        F.lit('},"windGust":{"value":null},"barometricPressure":{"value":'), (99000 + eid() % 5000).cast("string"), F.lit('},"temperature":{"value":12.5}}}'),
    )
    lists = by_day(events(spark, sf_dir), one).select(F.col("user").alias("station"), F.concat(F.lit('{"features":['), F.array_join(F.reverse("items"), ","), F.lit("]}")).alias("text"))
    found = feeds.observations(lists, most=4)
    return found.select("station", F.col("order").cast("long").alias("order"), "time", "wind_direction", r8("wind_speed_kts").alias("wind_speed_kts"), r8("pressure_hpa").alias("pressure_hpa"))


_CODES = [(code, name) for name, codes in classify.WEATHER_CODES.items() for code in codes]


@query(f"SELECT event_id, value AS temperature, CAST(event_id % 101 AS DOUBLE) AS humidity, CASE event_id % 100 {' '.join(f'WHEN {c} THEN {n!r}' for c, n in _CODES)} ELSE 'Unknown (' || event_id % 100 || ')' END AS sky FROM events")
def feed_current_weather(spark, sf_dir):
    """The current block of a forecast, whose hourly block has the same names; its code as text."""
    reply = F.concat(F.lit('{"hourly":{"temperature_2m":[1,2],"weather_code":[0,0]},"current":{"temperature_2m":'), F.col("value").cast("string"), text(',"relative_humidity_2m":%d,"weather_code":%d}}', eid() % 101, eid() % 100))
    found = feeds.current_weather(events(spark, sf_dir).select("event_id", reply.alias("text")))
    return found.select("event_id", "temperature", "humidity", classify.weather_code(F.col("code").cast("int")).alias("sky"))


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS high_time, round(value / 10, 8) AS high_level, CASE WHEN event_id % 8 = 0 THEN NULL ELSE strftime(date_trunc('minute', ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M') END AS low_time, CASE WHEN event_id % 8 = 0 THEN NULL ELSE 0.25 END AS low_level FROM events")
def feed_tides(spark, sf_dir):
    """First high and first low of each list of predictions; every eighth has no low. Local winter time is five hours behind."""
    local = lambda hours: F.date_format(F.col("time") + F.make_dt_interval(hours=F.lit(hours - 5)), "yyyy-MM-dd HH:mm")
    one = lambda t, v, k: F.concat(F.lit('{"t":"'), t, F.lit('","v":"'), v, F.lit(f'","type":"{k}"}}'))
    high, later, low = one(local(0), (F.col("value") / 10).cast("string"), "H"), one(local(12), F.lit("9.9"), "H"), one(local(6), F.lit("0.25"), "L")
    reply = F.concat(F.lit('{"predictions":['), F.concat_ws(",", F.when(eid() % 8 != 0, low), high, later), F.lit("]}"))
    found = feeds.tides(events(spark, sf_dir).select("event_id", reply.alias("text")))
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return found.select("event_id", minute("high_time").alias("high_time"), r8("high_level").alias("high_level"), minute("low_time").alias("low_time"), "low_level")


@query("""WITH n AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'OK' ELSE 'ALERTING' END || ' Boat ' || user_id || chr(10) || 'seen ' || event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(10) || '• speed: ' || CAST(event_id % 50 AS VARCHAR) || '.5' END AS notice FROM events) SELECT event_id, notice, sha256(notice) AS key FROM n""")
def feed_webhooks(spark, sf_dir):
    """Alert bodies with and without a state and matches, as notices with their keys."""
    body = F.concat(
        F.lit("{"), F.when(eid() % 2 == 0, '"state":"ok",').otherwise(""), text('"title":"Boat %d","message":"seen %s"', "user", "kind"), F.when(eid() % 3 == 0, "").otherwise(text(',"evalMatches":[{"metric":"speed","value":%d.5}]', eid() % 50)), F.lit("}"),
    )
    found = feeds.webhook_messages(events(spark, sf_dir).select("event_id", body.alias("text")))
    return found.select("event_id", "notice", "key")


@query("""WITH e AS (SELECT *, event_id % 4 AS k FROM events) SELECT event_id, 'regatta.sails' AS measurement, 'reefs' AS field, CAST(event_id % 3 AS DOUBLE) AS number, NULL AS text, CAST(NULL AS BOOLEAN) AS truth, 'main' AS tag FROM e WHERE k = 0
UNION ALL SELECT event_id, 'regatta.helmsman', 'name', NULL, event_type, NULL, NULL FROM e WHERE k = 1 UNION ALL SELECT event_id, 'regatta.start_line', 'lat', value, NULL, NULL, 'pin' FROM e WHERE k = 2
UNION ALL SELECT event_id, 'regatta.sails', 'up', NULL, NULL, value > 20, 'main' FROM e WHERE k = 0""")
def feed_race_events(spark, sf_dir):
    """Posted bodies of sails, helm and line as points; posts to other paths and bodies that are no JSON give none."""
    k = eid() % 4
    path = F.when(k == 0, "/api/sail").when(k == 1, "/api/helmsman").when(k == 2, "/api/start_line").otherwise("/api/none")
    body = (
        F.when(k == 0, text('{"type":"main","reefs":%d,"up":%s}', eid() % 3, (F.col("value") > 20).cast("string"))).when(k == 1, text('{"name":"%s"}', "kind"))
        .when(k == 2, F.concat(F.lit('{"point":"pin","lat":'), F.col("value").cast("string"), F.lit("}"))).otherwise(F.lit("{}"))
    )
    rows = events(spark, sf_dir).select(F.struct("time", "event_id").alias("time"), path.alias("path"), body.alias("body"))
    found = feeds.race_events(rows)
    tag = F.coalesce(F.try_element_at("tags", F.lit("type")), F.try_element_at("tags", F.lit("point")))
    return found.select("time.event_id", "measurement", "field", F.col("value_double").alias("number"), F.col("value_string").alias("text"), F.col("value_boolean").alias("truth"), tag.alias("tag"))


@query(f"SELECT {STAMP.format('ts')} AS seen, 'host' AS measurement, field, number FROM (SELECT ts, 'load' AS field, value AS number FROM events UNION ALL SELECT ts, 'twice', value * 2 FROM events WHERE event_id % 2 = 0)")
def feed_host_metrics(spark, sf_dir):
    """Wide rows as points, a field for each figure that is there."""
    rows = events(spark, sf_dir).select("time", F.col("value").alias("load"), F.when(eid() % 2 == 0, F.col("value") * 2).alias("twice"))
    return feeds.long_form(rows, "host", ["load", "twice"]).select(stamp("time").alias("seen"), "measurement", "field", F.col("value_double").alias("number"))


@query("SELECT event_id, round(CAST(floor(value * 100) AS BIGINT) / 100.0, 6) AS wind_speed, CASE WHEN event_id % 12 = 0 THEN NULL ELSE round(radians(event_id % 360), 8) END AS wind_direction FROM events")
def feed_masthead_wind(spark, sf_dir):
    """Frames of speed and direction; every twelfth is cut short and has no direction.

    Two bytes hold speeds up to 655.35; what is beyond goes into a second frame, of how often the first one's count has run over.
    """
    le = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    count = F.floor(F.col("value") * 100)
    tail = F.when(eid() % 12 == 0, "05").otherwise(le(eid() % 360))
    low, high = (F.unhex(F.concat(le(n), tail)) for n in (count % 65536, F.floor(count / 65536)))
    found = feeds.masthead_wind(events(spark, sf_dir).select("event_id", low.alias("frame"), high.alias("over")))
    found = feeds.masthead_wind(found.select("event_id", "over", F.col("wind_speed").alias("rest"), "wind_direction").withColumnRenamed("wind_direction", "direction"), "over")
    return found.select("event_id", F.round(F.col("rest") + F.col("wind_speed") * 65536, 6).alias("wind_speed"), r8("direction").alias("wind_direction"))


@query("SELECT event_id, round((4 * 3200 + 6 * (event_id % 50)) / 1000.0, 6) AS pack_volts, CAST(3 * (event_id % 50) AS INTEGER) AS imbalance_mv FROM events")
def feed_battery_cells(spark, sf_dir):
    """Four cells that differ by steps of the event's number."""
    le = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    frame = F.unhex(F.concat(F.lit("CCF2"), *(le(3200 + k * (eid() % 50)) for k in range(4))))
    found = feeds.battery_cells(events(spark, sf_dir).select("event_id", frame.alias("frame")))
    return found.select("event_id", F.round("pack_volts", 6).alias("pack_volts"), "imbalance_mv")


_SIGNED = "SELECT event_id, '$' || body || '*' || printf('%02X', list_reduce([ascii(c) for c in string_split(body, '')], lambda x, y: xor(x, y))) AS line FROM ({})"


@query(" UNION ALL ".join(_SIGNED.format(f"SELECT event_id, {body} AS body FROM events") for body in (
    "'IIHDT,' || printf('%.1f', event_id % 3600 / 10.0) || ',T'", "'IIMWV,' || printf('%.1f', event_id % 3600 / 10.0) || CASE WHEN true THEN ',R,' END || printf('%.1f', event_id % 400 / 10.0) || ',N,A'", "'IIVHW,' || printf('%.1f', event_id % 3600 / 10.0) || ',T,,M,' || printf('%.1f', event_id % 400 / 10.0) || ',N,,K'",
)))
def sink_sentences(spark, sf_dir):
    """Heading, apparent wind and speed sentences with their checksums."""
    deg, knots = eid() % 3600 / 10, eid() % 400 / 10
    lines = F.array(sinks.heading_sentence(deg), sinks.wind_sentence(deg, knots, False), sinks.speed_sentence(deg, knots))
    return events(spark, sf_dir).select("event_id", F.explode(lines).alias("line"))


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL")
def sink_retention(spark, sf_dir):
    rows = events(spark, sf_dir)
    kept = sinks.retained(rows, asof(rows), "7 days")
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, user_id AS \"user\", event_type AS kind, value FROM events")
def sink_json(spark, sf_dir):
    """Rows as JSON texts, read back at their paths."""
    texts = sinks.as_json(events(spark, sf_dir).select("event_id", "user", "kind", "value"))
    at = lambda path, kind: feeds.json_at(F.col("json"), path, kind)
    return texts.select(at("event_id", "bigint").alias("event_id"), at("user", "bigint").alias("user"), at("kind", "string").alias("kind"), at("value", "double").alias("value"))


@query("WITH v AS (SELECT event_id, value + event_id % 8 / 8.0 AS x FROM events) SELECT event_id, CASE WHEN x * 4 = floor(x * 4) AND (x * 4) % 2 = 1 THEN printf('%.1f', floor(x * 10 + 0.5) / 10) ELSE printf('%.1f', x) END AS fixed, printf('%.2f', x) AS even FROM v WHERE NOT (x * 8 = floor(x * 8) AND (x * 8) % 2 = 1)")
def display_rounding(spark, sf_dir):
    """Two ways to round for display; both decide on the double itself."""
    x = F.col("value") + eid() % 8 / 8
    found = events(spark, sf_dir).withColumn("x", x).filter(~((F.col("x") * 8 == F.floor(F.col("x") * 8)) & ((F.col("x") * 8) % 2 == 1)))
    return found.select("event_id", units.to_fixed(F.col("x"), 1).alias("fixed"), units.fixed(units.round_even(F.col("x"), 2), 2).alias("even"))


@query("SELECT 'zone_' || user_id % 5 AS zone, strftime(ts, '%Y%m%d') AS day, count(DISTINCT user_id) AS stations, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS listed, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def zone_cards(spark, sf_dir):
    """The stations of each zone on each day, listed in order."""
    zone = units.underscored(F.concat(F.lit("zone "), (F.col("user") % 5).cast("string")))
    rows = events(spark, sf_dir).groupBy(zone.alias("zone"), units.day_stamp(F.col("time")).alias("day"))
    listed = rows.agg(F.array_sort(F.collect_set(F.col("user").cast("string"))).alias("all"), F.avg("value").alias("mean"))
    return listed.select("zone", "day", F.size("all").cast("long").alias("stations"), F.array_join("all", ",").alias("listed"), r8("mean").alias("mean"))


_PLAN = "(VALUES " + ", ".join(f"('{p}', '{w}', '{m}', '{j}', '{s}', {h})" for p, w, m, j, s, h in sails.SAIL_PLAN) + ") AS s(point, wind, main, jib, spinnaker, target)"


@query(f"""WITH c AS (SELECT event_id, value % 24 AS tws, event_id * 7 % 361 - 180 AS twa, event_id % 30 AS heel, event_id % 5 = 0 AS rough, user_id % 10 / 10.0 AS efficiency FROM events), k AS (
    SELECT *, CASE WHEN abs(twa) < 45 THEN 'beating' WHEN abs(twa) < 160 THEN 'reaching' ELSE 'running' END AS point, CASE WHEN tws < 4 THEN 'very_light' WHEN tws < 7 THEN 'light' WHEN tws < 12 THEN 'moderate' WHEN tws < 16 THEN 'fresh' WHEN tws < 20 THEN 'strong' ELSE 'gale' END AS wind FROM c
), j AS (SELECT k.*, s.main, s.jib, s.spinnaker, s.target - CASE WHEN rough THEN 2 ELSE 0 END AS heel_target FROM k JOIN {_PLAN} USING (point, wind))
SELECT event_id, CASE WHEN rough AND main = 'full' THEN '1 reef' WHEN rough AND main = '1 reef' THEN '2 reefs' ELSE main END AS main, jib, spinnaker, CAST(heel_target AS DOUBLE) AS heel_target, CASE WHEN heel > heel_target + 2 THEN CASE WHEN heel > 24 THEN 'critical' ELSE 'warning' END END AS heel_alert, efficiency < 0.85 AND tws < 16 AND NOT rough AS may_add_sail FROM j""")
def recommended_sails(spark, sf_dir):
    """What to set for each event's wind, angle, heel and sea."""
    rows = events(spark, sf_dir).select("event_id", (F.col("value") % 24).alias("tws"), (eid() * 7 % 361 - 180).alias("twa"), (eid() % 30).alias("heel"), F.when(eid() % 5 == 0, "rough").otherwise("calm").alias("sea"), (F.col("user") % 10 / 10).alias("efficiency"))
    return sails.recommended(rows).select("event_id", "main", "jib", "spinnaker", "heel_target", "heel_alert", "may_add_sail")
