"""Scalar expressions of detection records: ids, confidences, parsing, ranks, reporting values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from embergrid.config import CONFIDENCE_RANK, STATUS_RANK

#: The reporting window, whose first day is day 1.
WINDOW_FIRST, WINDOW_DAYS = "2026-04-09", 13
REPORT_ZONE = "Australia/Sydney"


def iso_utc(t: Column) -> Column:
    """ISO 8601 with offset +00:00; microseconds only where there are any."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def fixed4(x: Column) -> Column:
    """Four decimals, halves to even on the decimal value."""
    return F.format_string("%.4f", F.bround(x.cast("decimal(20,10)"), 4).cast("double"))


def grid_source_id(prefix: str, lat: Column, lon: Column, t: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(prefix), fixed4(lat), fixed4(lon), iso_utc(t)), 256)


def feed_source_id(prefix: str, satellite: Column, lat: Column, lon: Column, t: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(prefix), satellite, lat.cast("string"), lon.cast("string"), iso_utc(t)), 256)


def decode_confidence(code: Column) -> Column:
    return F.when(code == 3, "high").when(code == 2, "nominal").otherwise("low")


def feed_confidence(raw: Column) -> Column:
    """Letters or words as they are; numbers from 80 high, from 30 nominal, below low; the rest nominal."""
    x = F.lower(F.trim(raw))
    n = x.try_cast("int")
    return (
        F.when(x.isin("l", "low"), "low").when(x.isin("h", "high"), "high").when(x.isin("n", "nominal"), "nominal")
        .when(n >= 80, "high").when(n >= 30, "nominal").when(n.isNotNull(), "low").otherwise("nominal")
    )


def number_confidence(raw: Column, is_number: Column) -> Column:
    """Only JSON numbers are classed; strings pass through, null is nominal."""
    n = raw.try_cast("double")
    return F.when(raw.isNull(), "nominal").when(~is_number, raw).when(n >= 80, "high").when(n >= 30, "nominal").otherwise("low")


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero (nor empty); the last one if none is."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values[:-1]], values[-1])


def first_text(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def hhmm(day: Column, clock: Column) -> Column:
    """Timestamp of a date and a clock that may lack leading zeros; null if it can't be read."""
    return F.try_to_timestamp(F.concat_ws(" ", day, F.lpad(clock, 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def day_night(sza: Column, limit: float = 85.0) -> Column:
    return F.when(sza < limit, "D").otherwise("N")


def local_day(t: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(t, REPORT_ZONE))


def competition_day(d: Column) -> Column:
    n = F.datediff(d, F.lit(WINDOW_FIRST).cast("date")) + 1
    return F.when(n.between(1, WINDOW_DAYS), n)


def status_rank(status: Column) -> Column:
    return _rank(status, STATUS_RANK)


def confidence_rank(confidence: Column) -> Column:
    return _rank(confidence, CONFIDENCE_RANK)


def _rank(x: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(x == name, rank).otherwise(out)
    return out


def probability_band(p: Column) -> Column:
    return F.when(p > 0.80, "very high").when(p > 0.50, "high").when(p > 0.20, "moderate").otherwise("low")


def fire_probability(s_max: Column, n_clear: Column, prior: float, scale: float = 2.0, min_clear: int = 48) -> Column:
    """Logistic confidence of a CUSUM; null before enough clear frames."""
    import math

    odds = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), math.log(prior / (1 - prior)) + scale * s_max))
    return F.when(n_clear >= min_clear, 1 / (1 + F.exp(-odds)))


def snap(x: Column, per_degree: int = 20) -> Column:
    """To the nearest 1/per_degree, halves to even."""
    return F.bround(x * per_degree) / per_degree
