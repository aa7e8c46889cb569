"""GTFS feeds: calendars, stop times, patterns, frequencies, speeds, fares, checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.clock import format_date, to_seconds
from wayfare.plans.ranking import numbered
from wayfare.plans.staging import cut, small

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
PATTERN_STEP = 1000


def service_days(calendar: DataFrame | None, exceptions: DataFrame | None) -> DataFrame:
    """service_id, date: days of the calendar's weekdays and range, with added (1) and without removed (2) ones."""
    if calendar is None and exceptions is None:
        raise FileNotFoundError("a feed needs a calendar or calendar dates")
    days = None
    if calendar is not None:
        span = F.sequence(F.to_date(format_date(F.col("start_date"))), F.to_date(format_date(F.col("end_date"))), F.expr("interval 1 day"))
        days = calendar.withColumn("date", F.explode(span)).filter(F.get(F.array(*[F.col(d).cast("int") for d in DAYS]), F.weekday("date")) == 1).select("service_id", "date")
    if exceptions is not None:
        if exceptions.filter(~F.col("exception_type").cast("int").isin(1, 2)).limit(1).count():
            raise ValueError("exception types are 1 (added) and 2 (removed)")
        dated = exceptions.select("service_id", F.to_date(format_date(F.col("date"))).alias("date"), F.col("exception_type").cast("int").alias("kind"))
        added = dated.filter("kind = 1").select("service_id", "date")
        days = added if days is None else days.unionByName(added)
        days = days.join(dated.filter("kind = 2"), ["service_id", "date"], "left_anti")
    return days.distinct()


def parsed_stop_times(raw: DataFrame) -> DataFrame:
    """Times as seconds; a repeated (trip_id, stop_sequence) is an error."""
    rows = raw.select("trip_id", F.col("stop_sequence").cast("long").alias("stop_sequence"), "stop_id", F.coalesce(to_seconds(F.col("arrival_time")), F.lit(0)).alias("arrival"), F.coalesce(to_seconds(F.col("departure_time")), F.lit(0)).alias("departure"))
    twice = rows.groupBy("trip_id", "stop_sequence").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"trip {twice[0].trip_id} has stop sequence {twice[0].stop_sequence} twice")
    return rows


def clean_stop_times(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Arrival and departure are the later of both; a row followed by the same stop goes; known stops only; seq from 0."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    later = F.greatest("arrival", "departure")
    kept = rows.withColumn("__next", F.lead("stop_id").over(w)).filter("__next IS NULL OR __next <> stop_id").drop("__next")
    known = kept.withColumn("arrival", later).withColumn("departure", F.col("arrival")).join(stops.select("stop_id").distinct(), "stop_id")
    return known.select("trip_id", "stop_id", "stop_sequence", "arrival", "departure", (F.row_number().over(w) - 1).cast("long").alias("seq"))


def without_repeats(rows: DataFrame) -> DataFrame:
    """Of repeated (stop, next stop) pairs of a trip the first stays; trips of fewer than two stops go."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = rows.withColumn("__next", F.lead("stop_id").over(w))
    pair = Window.partitionBy("trip_id", "stop_id", "__next").orderBy("seq")
    rows = rows.withColumn("__k", F.row_number().over(pair)).filter("__k = 1").drop("__k", "__next")
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("trip_id"))).filter("__n >= 2").drop("__n").withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def pattern_hashes(rows: DataFrame, trips: DataFrame) -> DataFrame:
    """trip_id, route_id, pattern_hash: MD5 of the route and the stops in order."""
    stops = rows.groupBy("trip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda x: x["stop_id"].cast("string")), "").alias("stops"))
    return stops.join(trips.select("trip_id", "route_id"), "trip_id").select("trip_id", "route_id", F.md5(F.concat(F.col("route_id").cast("string"), F.col("stops"))).alias("pattern_hash"))


def pattern_ids(hashes: DataFrame) -> DataFrame:
    """route_id, pattern_hash, pattern_id: the route's number times the step, then its hashes in order."""
    step = F.floor(F.count("*").over(Window.partitionBy("route_id")) / 100) + 1
    own = hashes.select("route_id", "pattern_hash").distinct()
    k = F.row_number().over(Window.partitionBy("route_id").orderBy("pattern_hash"))
    return own.select("route_id", "pattern_hash", (F.col("route_id").cast("long") + PATTERN_STEP * k * step).cast("long").alias("pattern_id"))


def expand_frequencies(frequencies: DataFrame, rows: DataFrame) -> DataFrame:
    """Stop times of every departure: at start, start + headway, ... before the end, each shifted from the trip's own
    first departure; the new trip ids carry the departure."""
    starts = frequencies.select("trip_id", F.explode(F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1), F.col("headway_secs"))).alias("leaves"))
    w = Window.partitionBy("trip_id")
    own = rows.withColumn("__first", F.min("departure").over(w))
    moved = own.join(starts, "trip_id")
    shift = F.col("leaves") - F.col("__first")
    return moved.select(F.concat_ws("-", F.col("trip_id").cast("string"), F.col("leaves").cast("string")).alias("trip_id"), "stop_id", "seq", (F.col("arrival") + shift).alias("arrival"), (F.col("departure") + shift).alias("departure"))


def _settled(trip: pd.DataFrame, limits: pd.DataFrame) -> pd.DataFrame:
    """One trip's times made consistent: unknown (zero) times filled, ties parted, segments slowed to the speed limits."""
    trip = trip.sort_values("seq").reset_index(drop=True)
    times = trip["arrival"].astype("int64").tolist()
    source = [0] * len(times)
    if any(b < a for a, b in zip(times, times[1:], strict=False)):
        for i in range(1, len(times)):
            times[i] = times[i] or times[i - 1]
    if len(times) > 1 and times[-1] == times[-2]:
        times[-1] += 1
        source[-1] = 1
    for i in range(1, len(times)):
        if times[i] == times[i - 1]:
            for j in range(i, len(times)):
                times[j] += 1
                source[j] = max(source[j], 1)
    for i in range(1, len(times)):
        d, elapsed = float(trip["distance"].iloc[i]), times[i] - times[i - 1]
        band = limits[(limits["min_distance"] <= d) & (limits["max_distance"] > d)]
        if band.empty or elapsed <= 0:
            continue
        most, speed = float(band["speed"].iloc[0]), d / elapsed
        if speed > most:
            add = int(elapsed * (speed / most - 1))
            for j in range(i, len(times)):
                times[j] += add
                source[j] = 2
    return trip.assign(arrival=times, departure=times, source_time=source)


def settle_times(rows: DataFrame, limits: pd.DataFrame) -> DataFrame:
    """rows (trip_id, seq, stop_id, arrival, departure, distance from the stop before) with times made consistent and
    source_time 0 as given, 1 parted ties, 2 slowed. limits: min_distance, max_distance, speed."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    columns = [*rows.columns, "source_time"]
    return rows.groupBy("trip_id").applyInPandas(lambda trip: _settled(trip, limits)[columns], f"{fields}, source_time int")


def with_defaults(routes: DataFrame, by_type: DataFrame, default: dict[str, float]) -> DataFrame:
    """Routes with capacities and equivalents of their type, or the default of others."""
    joined = routes.join(F.broadcast(by_type), "route_type", "left")  # a row a mode
    return joined.fillna(default)


def problems(trips: DataFrame, stop_times: DataFrame, days: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """problem, id: what does not refer to anything, and ids that repeat."""
    text = lambda c: F.col(c).cast("string").alias("id")
    named = lambda df, name: df.select(F.lit(name).alias("problem"), "id")
    twice = lambda df, c, name: named(df.groupBy(c).count().filter("count > 1").select(text(c)), name)
    out = named(trips.join(stop_times, "trip_id", "left_anti").select(text("trip_id")).distinct(), "trip without stop times")
    out = out.unionByName(named(trips.join(days, "service_id", "left_anti").select(text("service_id")).distinct(), "service without days"))
    for df, c in ((trips, "trip_id"), (stops, "stop_id"), (routes, "route_id")):
        out = out.unionByName(twice(df, c, f"{c} repeats"))
    return out


def trips_on(trips: DataFrame, days: DataFrame, date: str) -> DataFrame:
    return trips.join(days.filter(F.col("date") == F.to_date(F.lit(date))).select("service_id").distinct(), "service_id", "left_semi")


def stop_pairs(rows: DataFrame) -> DataFrame:
    """pattern_id, seq, from_stop, to_stop: the route links of each pattern."""
    w = Window.partitionBy("pattern_id", "trip_id").orderBy("seq")
    return rows.withColumn("to_stop", F.lead("stop_id").over(w)).filter("to_stop IS NOT NULL").select("pattern_id", "seq", F.col("stop_id").alias("from_stop"), "to_stop").distinct()


def shapes(points: DataFrame) -> DataFrame:
    """shape_id and its points in order."""
    return points.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("shape_pt_sequence").cast("long").alias("k"), F.col("shape_pt_lon").cast("double").alias("lon"), F.col("shape_pt_lat").cast("double").alias("lat")))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def fares(attributes: DataFrame) -> DataFrame:
    """fare_id (numbered by fare, from 1), fare, agency_id, price, currency, payment_method, transfer, transfer_duration; a
    fare without a duration has none, one without transfers listed allows any."""
    own = attributes.select(F.col("fare_id").cast("string").alias("fare"), "agency_id", F.col("price").cast("double").alias("price"), F.col("currency_type").alias("currency"), F.coalesce(F.col("payment_method").cast("int"), F.lit(0)).alias("payment_method"), F.expr("try_cast(transfers AS int)").alias("transfer"), F.expr("try_cast(transfer_duration AS double)").alias("transfer_duration"))
    if own.groupBy("fare").count().filter("count > 1").limit(1).count():
        raise ValueError("a fare is defined twice")
    return numbered(own, ["fare"], "fare_id", 1)


def fare_rules(rules: DataFrame, fare_table: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, zones): every rule with the number of its fare, its route's number or null for any, and its zones' numbers;
    zones are all that rules name, numbered in order. Rules of unknown fares are left out."""
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.col(c).cast("string"))
    own = rules.select(F.col("fare_id").cast("string").alias("fare"), blank("route_id").alias("route"), blank("origin_id").alias("o"), blank("destination_id").alias("d"))
    zones = numbered(own.select(F.explode(F.array("o", "d")).alias("zone")).filter("zone IS NOT NULL").distinct(), ["zone"], "fare_zone_id", 1)
    out = own.join(small(fare_table.select("fare", "fare_id")), "fare")
    known = routes.select(F.col("route").cast("string").alias("route"), F.col("route_id").alias("route_number"))
    out = out.join(small(known), "route", "left")
    for side, name in (("o", "origin"), ("d", "destination")):
        out = out.join(small(zones.select(F.col("zone").alias(side), F.col("fare_zone_id").alias(name))), side, "left")
    return out.select("fare_id", F.col("route_number").alias("route_id"), "origin", "destination"), zones


def load_day(tables: dict[str, DataFrame], date: str) -> dict[str, DataFrame]:
    """A feed's tables (agency, stops, routes, trips, stop_times, calendar, calendar_dates, frequencies, fare_attributes and
    fare_rules as they are there) as the tables of one day's service: stops, routes, patterns, trips, schedule, route
    links, and fares with rules and zones where there are fares."""
    days = service_days(tables.get("calendar"), tables.get("calendar_dates"))
    running = trips_on(tables["trips"], days, date)
    times = parsed_stop_times(tables["stop_times"].join(running.select("trip_id"), "trip_id", "left_semi"))
    rows = without_repeats(clean_stop_times(times, tables["stops"]))
    routes = numbered(tables["routes"].select(F.col("route_id").cast("string").alias("route"), *[c for c in tables["routes"].columns if c != "route_id"]), ["route"], "route_id", 1)
    rows = cut(rows)
    own = running.select("trip_id", F.col("route_id").cast("string").alias("route")).join(small(routes.select("route", "route_id")), "route").select("trip_id", "route_id")
    hashes = cut(pattern_hashes(rows, own))
    ids = pattern_ids(hashes)
    trips = hashes.join(ids.select("pattern_hash", "route_id", "pattern_id"), ["pattern_hash", "route_id"])
    if "frequencies" in tables:
        when = tables["frequencies"].select("trip_id", to_seconds(F.col("start_time")).alias("start"), to_seconds(F.col("end_time")).alias("end"), F.col("headway_secs").cast("long").alias("headway_secs"))
        when = when.join(trips.select("trip_id"), "trip_id", "left_semi")
        made = expand_frequencies(when, rows)
        repeated = rows.join(when.select("trip_id").distinct(), "trip_id", "left_anti").select(F.col("trip_id").cast("string").alias("trip_id"), "stop_id", "seq", "arrival", "departure")
        of = lambda df: df.withColumn("base", F.regexp_replace("trip_id", "-[0-9]+$", ""))
        base = trips.select(F.col("trip_id").cast("string").alias("base"), "route_id", "pattern_id", "pattern_hash")
        departures = of(made.select("trip_id").distinct()).join(base, "base").drop("base")
        still = base.join(when.select(F.col("trip_id").cast("string").alias("base")).distinct(), "base", "left_anti").withColumnRenamed("base", "trip_id")
        trips = departures.select("trip_id", "route_id", "pattern_id", "pattern_hash").unionByName(still)
        rows = repeated.unionByName(made)
    else:
        trips, rows = trips.withColumn("trip_id", F.col("trip_id").cast("string")), rows.withColumn("trip_id", F.col("trip_id").cast("string")).drop("stop_sequence")
    schedule = rows.join(trips.select("trip_id", "pattern_id"), "trip_id")
    out = {"stops": tables["stops"], "routes": routes, "patterns": trips.select("pattern_id", "route_id", "pattern_hash").distinct(), "trips": trips.select("trip_id", "route_id", "pattern_id"), "schedule": schedule, "route_links": stop_pairs(schedule)}
    if "agency" in tables:
        out["agencies"] = tables["agency"]
    if "fare_attributes" in tables:
        out["fares"] = fares(tables["fare_attributes"])
        if "fare_rules" in tables:
            out["fare_rules"], out["fare_zones"] = fare_rules(tables["fare_rules"], out["fares"], routes)
    return out


def last_per_pattern(schedule: DataFrame) -> DataFrame:
    """Of each pattern the schedule of its last trip, for exports of one trip a pattern."""
    w = Window.partitionBy("pattern_id").orderBy(F.desc("trip_id"))
    return schedule.withColumn("__r", F.dense_rank().over(w)).filter("__r = 1").drop("__r")


def delete_pattern(tables: dict[str, DataFrame], pattern_id: int) -> dict[str, DataFrame]:
    """All tables without a pattern and what hangs on it: trips, their schedules, links and mapping."""
    trips = tables["trips"]
    gone = trips.filter(F.col("pattern_id") == pattern_id).select("trip_id")
    out = {}
    for name, df in tables.items():
        if "pattern_id" in df.columns:
            out[name] = df.filter(F.col("pattern_id") != pattern_id)
        elif "trip_id" in df.columns:
            out[name] = df.join(gone, "trip_id", "left_anti")
        else:
            out[name] = df
    return out
