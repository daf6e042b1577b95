"""Value sets of the access log and the column expressions that test them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log's event types and locations, in the order that ranks them.
EVENTS = ("LOGIN", "LOGOUT", "TOKEN_REFRESH", "ACCESS", "FAILED_LOGIN", "OPEN_APP", "DOWNLOAD", "ADMIN_ACTION")
LOCATIONS = ("US", "VN", "JP", "KR", "SG", "CN", "DE", "FR", "UK", "AU", "CA", "IN", "BR", "RU", "TH")
#: Events that touch a resource.
TOUCHING = ("ACCESS", "DOWNLOAD", "OPEN_APP", "ADMIN_ACTION")
UNKNOWN = "UNKNOWN"
#: Kinds of id with the prefix of valid ones.
PREFIXES = {"user": "U", "device": "D", "app": "APP", "resource": "R"}

#: A row's place in the log: time, then first appearance of each id, then the two ranks.
ORDER = ("timestamp", "user_ord", "device_ord", "app_ord", "resource_ord", "event_tag", "loc_tag")


def rank_of(value: Column, values: tuple[str, ...]) -> Column:
    """Place of a value in its set; values outside it come last."""
    places = F.create_map(*[F.lit(x) for x in chain.from_iterable((v, i) for i, v in enumerate(values))])
    return F.coalesce(F.try_element_at(places, value), F.lit(len(values))).cast("byte")


def touches(event: Column | None = None) -> Column:
    return (F.col("event_type") if event is None else event).isin(*TOUCHING)


def known_location() -> Column:
    return F.col("location") != UNKNOWN


def fits_uint64(digits: Column) -> Column:
    """Whether a string is one or more digits with a value below 2^64."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    fits = (F.length(short) < 20) | ((F.length(short) == 20) & (short <= "18446744073709551615"))
    return F.coalesce(digits.rlike(r"\A[0-9]+\z") & fits, F.lit(False))


def valid_id(value: Column, prefix: str) -> Column:
    return F.coalesce(F.startswith(value, F.lit(prefix)) & fits_uint64(F.substr(value, F.lit(len(prefix) + 1))), F.lit(False))


def resource_key(value: Column) -> Column:
    """The number of a resource, null unless it is R and digits within 64 unsigned bits."""
    return F.when(valid_id(value, "R"), F.substr(value, F.lit(2)).try_cast("decimal(20,0)"))


def utc_text(seconds: Column) -> Column:
    """ISO text of epoch seconds, in UTC whatever the session's time zone. The calendar repeats every 400 years, so any moment has one."""
    era = F.lit(146_097 * 86_400)
    moment = F.timestamp_add("SECOND", F.pmod(seconds, era), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    year = F.year(moment) + whole(seconds - F.pmod(seconds, era), era) * 400
    return F.concat(F.lpad(year.cast("string"), F.greatest(F.lit(4), F.length(year.cast("string"))), F.lit("0")), F.date_format(moment, "-MM-dd'T'HH:mm:ss'Z'"))


def utc_day(seconds: Column) -> Column:
    return whole(seconds, F.lit(86400))


def whole(a: Column, b: Column) -> Column:
    """Quotient of whole numbers, without the detour over doubles."""
    return F.call_function("div", a, b)
