"""Sinks of events: GeoJSON features and collections, daily summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.functions.geo import circle
from embergrid.functions.records import REPORT_ZONE, competition_day


def features(events: DataFrame, with_circle: bool = False) -> DataFrame:
    """One GeoJSON feature per event: a point, or a collection of the point and its circle of uncertainty."""
    point = F.struct(F.lit("Point").alias("type"), F.array("centroid_lon", "centroid_lat").alias("coordinates"))
    if with_circle:
        ring = F.struct(F.lit("Polygon").alias("type"), F.array(circle(F.col("centroid_lat"), F.col("centroid_lon"), F.col("location_uncertainty_m"))).alias("coordinates"))
        geometry = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.to_json(point), F.lit(","), F.to_json(ring), F.lit("]}"))
    else:
        geometry = F.to_json(point)
    rest = F.to_json(F.struct(*[c for c in events.columns if c not in ("centroid_lat", "centroid_lon")]))
    return events.select("event_seq", F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), rest, F.lit("}")).alias("feature"))


def collection(events: DataFrame, name: str, with_circle: bool = False, report_date: str | None = None, generated: str | None = None) -> DataFrame:
    """A FeatureCollection as lines (part, event_seq, line): joined in that order they are one JSON document.

    The head has part 0 and the end part 2. With ``report_date`` the head carries the reference system and the metadata of
    a daily report: date, day of the window, times of generation (UTC and report zone), number of events and counts by
    status. Only those counts (six statuses at most) are gathered into one row; features stay where they are.
    """
    head = {"type": F.lit("FeatureCollection"), "name": F.lit(name)}
    if report_date is not None:
        day = F.lit(report_date).cast("date")
        utc = F.lit(generated).cast("timestamp") if generated else F.current_timestamp()
        iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
        zone = F.to_utc_timestamp(utc, F.current_timezone())
        head["crs"] = F.struct(F.lit("name").alias("type"), F.struct(F.lit("urn:ogc:def:crs:EPSG::4326").alias("name")).alias("properties"))
        head["metadata"] = F.struct(
            F.lit(report_date).alias("report_date"), competition_day(day).alias("competition_day"), F.concat(iso(zone), F.lit("Z")).alias("generation_time_utc"),
            iso(F.from_utc_timestamp(zone, REPORT_ZONE)).alias("generation_time_local"), F.coalesce("total_events", F.lit(0)).alias("total_events"),
            F.col("status_summary"), F.lit("EPSG:4326 (WGS84)").alias("coordinate_reference_system"),
        )
    text = F.to_json(F.struct(*[c.alias(n) for n, c in head.items()]))
    place = [F.lit(None).cast("long").alias("event_seq")]
    first = status_map(events).select(F.lit(0).alias("part"), *place, F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"features":[')).alias("line"))
    least = F.broadcast(events.agg(F.min("event_seq").alias("__least")))  # one row
    body = features(events, with_circle).crossJoin(least).select(F.lit(1).alias("part"), "event_seq", F.concat(F.when(F.col("event_seq") == F.col("__least"), "").otherwise(","), F.col("feature")).alias("line"))
    return first.unionByName(body).unionByName(first.select(F.lit(2).alias("part"), *place, F.lit("]}").alias("line")))


def write_collection(events: DataFrame, path: str, name: str = "events", with_circle: bool = False, **report: str) -> None:
    """The document in sorted part files; read one after the other, by name, they are valid GeoJSON."""
    collection(events, name, with_circle, **report).orderBy("part", "event_seq").select("line").write.mode("overwrite").text(path)


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports, newest first: date, day of the window, number of events and time of generation, off the heads alone."""
    lines = spark.read.text(f"{path.rstrip('/')}/report_date=*/features").where(F.col("value").startswith('{"type":"FeatureCollection"'))
    meta = F.from_json(F.concat("value", F.lit("]}")), "metadata struct<report_date: string, competition_day: int, total_events: long, generation_time_utc: string>")["metadata"]
    return lines.select(meta.alias("m")).select("m.*").orderBy(F.desc("report_date"))


def report_window(t: Column, zone: str = "Australia/Sydney", at: tuple[int, int] = (19, 50)) -> Column:
    """The daily report that a moment belongs to: its date, and from when to when it runs (in UTC, without zone).

    A report ends at a time of day on the zone's clock, so that one runs for 23 or 25 hours where summer time begins or
    ends. A moment at the end belongs to the next report; a null moment to none. ``t`` is a timestamp; the session's zone must
    not repeat hours (UTC does not).
    """
    day, rest = F.make_dt_interval(hours=F.lit(at[0]), mins=F.lit(at[1])), F.make_dt_interval(hours=F.lit(24 - at[0] - (at[1] > 0)), mins=F.lit(-at[1] % 60))
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), t.cast("timestamp_ntz"))
    date = F.to_date(local + rest)
    utc = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz") + day)
    return F.when(t.isNotNull(), F.struct(date.alias("report_date"), utc(F.date_sub(date, 1)).alias("from_utc"), utc(date).alias("to_utc")))


def daily_windows(rows: DataFrame, t: str, value: str, zone: str = "Australia/Sydney") -> DataFrame:
    """Per daily report with rows: its window, the number of rows and the greatest value."""
    w = rows.where(F.col(t).isNotNull()).select(report_window(F.col(t), zone).alias("w"), value)
    return w.groupBy("w.report_date", "w.from_utc", "w.to_utc").agg(F.count("*").alias("n"), F.max(value).alias("greatest"))


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("n"))


def status_map(events: DataFrame) -> DataFrame:
    """One row: counts by status as a map (six statuses at most) and the total."""
    c = status_counts(events)
    return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_summary"), F.sum("n").alias("total_events"))


def markdown_rows(events: DataFrame) -> DataFrame:
    """Table rows of the summary; a power that is null or zero shows as a dash."""
    frp = F.when(F.col("max_frp").isNull() | (F.col("max_frp") == 0), "—").otherwise(F.format_string("%.1f", "max_frp"))
    cells: list[Column] = [F.col("event_seq").cast("string"), F.col("status"), F.format_string("%.4f", "centroid_lat"), F.format_string("%.4f", "centroid_lon"), F.col("detection_count").cast("string"), frp, F.col("source_set")]
    return events.select("event_seq", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def save_report(events: DataFrame, path: str, report_date: str) -> None:
    """A day's report: features with circles, the table's lines, and counts by status, each as files under one folder.

    The date labels the report; it does not select events.
    """
    base = f"{path.rstrip('/')}/report_date={report_date}"
    write_collection(events, f"{base}/features", "daily_report", with_circle=True, report_date=report_date)
    markdown_rows(events).orderBy("event_seq").select("line").write.mode("overwrite").text(f"{base}/table")
    status_counts(events).coalesce(1).write.mode("overwrite").json(f"{base}/status")
