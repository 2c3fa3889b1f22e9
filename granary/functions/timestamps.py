"""Stamps in many formats and zones read as one moment: an ordered cascade of anchored patterns.

Each pattern must match the whole stamp and every part must be a real one (no 31 November, no hour 25).
Policy: a local time that occurs twice is the first of the two; one that is skipped is read with the offset
in force before the jump, both as java.time resolves them. A stamp without zone takes the default zone given,
a date alone is its local midnight. Slashed dates with the year last take the given order (``MDY`` or ``DMY``);
without one only an unambiguous date (a part above 12) is read. Null, blank and senseless stamps give null.
All is Spark expressions; the session's time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations and their offsets.
ZONE_OFFSETS = {
    "z": "+00:00",
    "utc": "+00:00",
    "gmt": "+00:00",
    "wet": "+00:00",
    "bst": "+01:00",
    "cet": "+01:00",
    "west": "+01:00",
    "cest": "+02:00",
    "eet": "+02:00",
    "eest": "+03:00",
    "msk": "+03:00",
    "ist": "+05:30",
    "jst": "+09:00",
    "kst": "+09:00",
    "aest": "+10:00",
    "aedt": "+11:00",
    "nst": "-03:30",
    "ast": "-04:00",
    "adt": "-03:00",
    "est": "-05:00",
    "edt": "-04:00",
    "cst": "-06:00",
    "cdt": "-05:00",
    "mst": "-07:00",
    "mdt": "-06:00",
    "pst": "-08:00",
    "pdt": "-07:00",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?"
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
CLOCK = r"(?:(?:t|,? +| at )(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap]m))?"
COMPACT = r"(?:t(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?()"
ZONE = r"(?: ?([a-z]{1,4}|[+-](?:0\d|1[0-4])(?::?[0-5]\d)?)(?:\[[a-z_/+-]+\])?)?)?"

#: (pattern of the date, its groups as year|month|day, pattern of the clock, date order needed), tried in this order.
CASCADE = [
    (r"(\d{4})-(\d{2})-(\d{2})", "$1|$2|$3", CLOCK, None),
    (r"(\d{4})/(\d{2})/(\d{2})", "$1|$2|$3", CLOCK, None),
    (r"(\d{4})(\d{2})(\d{2})", "$1|$2|$3", COMPACT, None),
    (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3|$2|$1", CLOCK, None),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3|$2|$1", CLOCK, "DMY"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3|$1|$2", CLOCK, "MDY"),
    (r"(1[3-9]|2\d|3[01])/(\d{1,2})/(\d{4})", "$3|$2|$1", CLOCK, ""),
    (r"(\d{1,2})/(1[3-9]|2\d|3[01])/(\d{4})", "$3|$1|$2", CLOCK, ""),
    (WEEKDAY + r"(\d{1,2})(?:st|nd|rd|th)?[ -]" + MONTH + r"[ -](\d{4})", "$3|$2|$1", CLOCK, None),
    (WEEKDAY + MONTH + r" (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", "$3|$1|$2", CLOCK, None),
]

#: Moments outside are senseless; the bounds are those TESTDATA.md states.
FIRST_MS, END_MS = 1199145600000, 1767225600000


def real(epoch_ms: Column, first_ms: int = FIRST_MS, end_ms: int = END_MS) -> Column:
    return F.when((epoch_ms >= first_ms) & (epoch_ms < end_ms), epoch_ms)


def epoch_number(number: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds, told by magnitude, as milliseconds."""
    return (
        F.when((number >= 10**8) & (number < 10**11), number * 1000)
        .when((number >= 10**11) & (number < 10**14), number)
        .when((number >= 10**14) & (number < 10**17), F.floor(number / F.lit(1000)).cast("long"))
        .when(number >= 10**17, F.floor(number / F.lit(10**6)).cast("long"))
    )


def moment(part: Column, default_zone: Column) -> Column:
    """The moment of the nine parts year, month, day, hour, minute, second, fraction, half, zone."""
    number = lambda k: F.when(part[k] != "", part[k].cast("int"))
    month = F.when(part[1].rlike(r"^\d"), part[1].cast("int")).otherwise(F.floor((F.position(F.substring(part[1], 1, 3), F.lit("".join(MONTHS))) + 2) / 3).cast("int"))
    said = F.coalesce(number(3), F.lit(0))
    hour = F.when(part[7] == "", said).when((said >= 1) & (said <= 12), said % 12 + F.when(part[7] == "pm", 12).otherwise(0))
    second = F.coalesce(number(5), F.lit(0))
    zone = part[8]
    named = F.element_at(F.create_map(*[F.lit(x) for pair in ZONE_OFFSETS.items() for x in pair]), zone)
    digits = F.rpad(F.regexp_replace(F.substring(zone, 2, 5), ":", ""), 4, "0")
    shift = F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
    offset = F.when(zone == "", default_zone).when(zone.rlike("^[+-]"), shift).otherwise(named)
    whole = F.try_make_timestamp(part[0].cast("int"), month, part[2].cast("int"), hour, F.coalesce(number(4), F.lit(0)), F.when(second < 60, second).cast("decimal(8,6)"), offset)
    return F.unix_millis(whole) + F.rpad(F.substring(part[6], 1, 3), 3, "0").cast("int")


def read_stamp(stamp: Column, default_zone: Column, date_order: Column) -> Column:
    """Milliseconds since the epoch in UTC, or null. ``default_zone`` is an IANA name or an offset.

    Each pattern rewrites the stamp it matches into one canonical list of parts, so that the calendar and
    zone arithmetic stands in the plan once, whatever the number of patterns.
    """
    text = F.lower(F.trim(F.regexp_replace(stamp, r"[\s\x{A0}]+", " ")))

    def read(t: Column) -> Column:
        parts = F.lit(None).cast("string")
        for date, order, clock, needed in reversed(CASCADE):
            pattern = f"^{date}{clock}{ZONE}$"
            matches = t.rlike(pattern)
            if needed is not None:
                matches = matches & (F.coalesce(date_order, F.lit("")) == needed)
            parts = F.when(matches, F.regexp_replace(t, pattern, order + "|$4|$5|$6|$7|$8|$9")).otherwise(parts)
        split = F.transform(F.array(F.split(parts, r"\|", -1)), lambda p: F.when(p.isNotNull(), moment(p, default_zone)))[0]
        return F.coalesce(split, epoch_number(F.when(t.rlike(r"^\d{9,19}$"), t).try_cast("bigint")))

    return F.transform(F.array(text), read)[0]
