"""String, date and record functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_date(year: Column, month: Column, day: Column) -> Column:
    """A date of its parts; NULL where there is no such day."""
    parts = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(parts, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(parts)


def packed_degrees(packed: Column, lon: bool = True) -> Column:
    """Degrees from an integer DDMMSS (latitude) or DDMMSSH (longitude; H 1 is east, 2 west), to 3 places."""
    s = F.lpad(packed.cast("string"), 7 if lon else 6, "0")
    value = F.substring(s, 1, 2).cast("double") + F.substring(s, 3, 2).cast("double") / 60 + F.substring(s, 5, 2).cast("double") / 3600
    return F.round(F.when(F.substring(s, 7, 1) == "2", -value).otherwise(value) if lon else value, 3)


def slug(name: Column) -> Column:
    """Lower case without accents; runs of other signs become one underscore."""
    plain = F.translate(F.lower(name), "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_|_$", "")


def resolution_km(run: Column) -> Column:
    """2 of EPS_2km_RUN."""
    return F.try_element_at(F.regexp_extract_all(run, F.lit(r"_(\d+)km"), F.lit(1)), F.lit(1)).cast("int")


def file_date(name: Column) -> Column:
    """The date of a name that holds yyyy-MM-dd."""
    return F.to_date(F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)), F.lit(1)))


def model_time(text: Column) -> Column:
    """yyyy-MM-dd_HH:mm:ss as a timestamp without zone."""
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd_HH:mm:ss"))


def model_time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH:mm:ss")


def season(ts: Column) -> Column:
    """DJF, MAM, JJA or SON by the month alone."""
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isin(9, 10, 11), "SON")


def month_end(ts: Column) -> Column:
    return F.last_day(ts)


def mid_month(year: Column, month: Column) -> Column:
    """The instant half-way through a month."""
    first = F.make_date(year, month, F.lit(1))
    hours = F.date_diff(F.add_months(first, 1), first) * 12
    return F.timestamp_add("HOUR", hours, first.cast("timestamp_ntz"))


def spanish_number(text: Column) -> Column:
    """A number with a decimal comma; a trace (Ip) is 0, an accumulated reading (Acum) is NULL."""
    t = F.trim(text)
    return F.when(t == "Ip", F.lit(0.0)).when(t == "Acum", F.lit(None).cast("double")).otherwise(F.regexp_replace(t, ",", ".").try_cast("double"))


def json_field(text: Column, field: str, kind: str = "bigint") -> Column:
    return F.get_json_object(text, f"$.{field}").try_cast(kind)
