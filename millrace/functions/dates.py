"""Dates: strptime formats as Spark patterns, zones, and the date macros. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.strings import quoted

#: A strptime directive's regex and its Spark pattern.
_DIRECTIVES = {
    "Y": (r"\d{4}", "yyyy"), "m": (r"\d{1,2}", "M"), "d": (r"\d{1,2}", "d"), "e": (r" ?\d{1,2}", "d"), "H": (r"\d{1,2}", "H"), "I": (r"\d{1,2}", "h"),
    "M": (r"\d{1,2}", "m"), "S": (r"\d{1,2}", "s"), "y": (r"\d{2}", "yy"), "b": (r"[A-Za-z]{3}", "MMM"), "h": (r"[A-Za-z]{3}", "MMM"), "B": (r"[A-Za-z]+", "MMMM"),
    "a": (r"[A-Za-z]{3}", ""), "A": (r"[A-Za-z]+", ""), "p": (r"[AaPp][Mm]", "a"), "f": (r"\d{1,6}", "f"), "z": (r"Z|[+-]\d{2}:?\d{2}", "z"), "Z": (r"[A-Z]{1,5}", ""),
    "j": (r"\d{1,3}", "D"), "s": (r"\d{1,12}", "s@"), "n": (r"\s", ""), "t": (r"\s", ""),
}
_SHORT = {"T": "%H:%M:%S", "D": "%m/%d/%y", "F": "%Y-%m-%d", "R": "%H:%M"}
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_OUT = {
    "Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a",
    "f": "SSSSSS", "z": "xx", "Z": "zzz", "j": "DDD",
}


def _expanded(fmt: str) -> list[str]:
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            c = fmt[i + 1]
            out += _expanded(_SHORT[c]) if c in _SHORT else [fmt[i : i + 2]]
            i += 2
        else:
            out.append(fmt[i])
            i += 1
    return out


def strptime(s: Column, *formats: str, year: Column | None = None) -> Column:
    """The first format that fits, or null. Fields are taken by one regex each, so partial formats work; without a year, ``year`` (by default this one) is taken, or the one before if the date would lie over a month ahead."""
    return F.coalesce(*[_strptime(s, f, year) for f in formats])


def _strptime(s: Column, fmt: str, year: Column | None) -> Column:
    regex, fields = "^", {}
    for part in _expanded(fmt):
        if part[0] == "%" and len(part) == 2 and part[1] != "%":
            r, kind = _DIRECTIVES[part[1]]
            fields[kind or f"-{part[1]}"] = len(fields) + 1
            regex += f"({r})"
        elif part.isspace():
            regex += r"\s+" if not regex.endswith(r"\s+") else ""
        else:
            regex += quoted("%" if part == "%%" else part)
    regex += "$"
    get = lambda k: F.regexp_extract(s, regex, fields[k])
    hit = s.rlike(regex)
    if "s@" in fields:
        return F.when(hit, F.timestamp_seconds(get("s@").try_cast("bigint")))
    number = lambda k, default: get(k).try_cast("int") if k in fields else F.lit(default)
    if "MMM" in fields or "MMMM" in fields:
        name = F.initcap(F.substring(get("MMM" if "MMM" in fields else "MMMM"), 1, 3))
        month = ((F.instr(F.lit(_MONTHS), name) + 2) / 3).cast("int")
    else:
        month = number("M", 1)
    hour = number("H", 0)
    if "h" in fields:
        hour = number("h", 12) % 12
        if "a" in fields:
            hour = hour + F.when(F.lower(get("a")) == "pm", 12).otherwise(0)
    second = number("s", 0).cast("decimal(8,6)")
    if "f" in fields:
        second = second + (F.rpad(get("f"), 6, "0").try_cast("bigint") / 1000000).cast("decimal(8,6)")
    day = number("d", 1)
    if "yyyy" in fields:
        y = number("yyyy", 1970)
    elif "yy" in fields:
        short = number("yy", 0)
        y = short + F.when(short < 69, 2000).otherwise(1900)
    else:
        now = F.current_timestamp()
        y = year if year is not None else F.year(now)
    stamp = F.try_make_timestamp(y, month, day, F.coalesce(hour, F.lit(0)), number("m", 0), second)
    if "yyyy" not in fields and "yy" not in fields and year is None:
        stamp = F.when(stamp > F.current_timestamp() + F.expr("interval 31 days"), F.try_make_timestamp(y - 1, month, day, hour, number("m", 0), second)).otherwise(stamp)
    if "D" in fields:
        stamp = F.timestamp_micros(F.unix_micros(F.try_make_timestamp(y, F.lit(1), F.lit(1), hour, number("m", 0), second)) + (number("D", 1) - 1).cast("bigint") * 86400000000)
    if "z" in fields:
        stamp = F.timestamp_micros(F.unix_micros(stamp) - offset_seconds(get("z")).cast("bigint") * 1000000)
    return F.when(hit, stamp)


def offset_seconds(zone: Column) -> Column:
    """Of ``Z``, ``+01:00`` or ``-0530``."""
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    return F.when(zone.isin("Z", "UTC", "GMT"), 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60))


def strftime(fmt: str, t: Column, offset: Column | None = None) -> Column:
    """A timestamp by strftime's directives, at an offset in seconds from UTC."""
    local = t if offset is None else F.timestamp_micros(F.unix_micros(t) + offset.cast("bigint") * 1000000)
    parts, text = [], ""
    for p in _expanded(fmt):
        if p[0] == "%" and len(p) == 2 and p[1] in {**_OUT, "s": "", "u": "", "w": "", "V": ""}:
            if text:
                parts.append(F.lit(text))
                text = ""
            if p[1] == "s":
                parts.append(F.unix_timestamp(t).cast("string"))
            elif p[1] == "z":
                parts.append(format_offset(offset, "") if offset is not None else F.lit("+0000"))
            elif p[1] == "e":
                parts.append(F.lpad(F.dayofmonth(local).cast("string"), 2, " "))
            elif p[1] == "w":
                parts.append((F.dayofweek(local) - 1).cast("string"))
            elif p[1] == "u":
                parts.append((F.weekday(local) + 1).cast("string"))
            elif p[1] == "V":
                parts.append(F.lpad(F.weekofyear(local).cast("string"), 2, "0"))
            elif p[1] == "Z":
                parts.append(F.lit("UTC"))
            else:
                parts.append(F.date_format(local, _OUT[p[1]]))
        else:
            text += "%" if p == "%%" else p
    if text:
        parts.append(F.lit(text))
    return F.concat(*parts) if parts else F.lit("")


def format_offset(seconds: Column, separator: str = ":") -> Column:
    a = F.abs(seconds).cast("int")
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), F.lpad((a / 3600).cast("int").cast("string"), 2, "0"), F.lit(separator), F.lpad((a % 3600 / 60).cast("int").cast("string"), 2, "0"))


def isodate(s: Column) -> Column:
    return F.try_to_timestamp(s)


def format_isodate(t: Column, offset: Column | None = None) -> Column:
    local = t if offset is None else F.timestamp_micros(F.unix_micros(t) + offset.cast("bigint") * 1000000)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), format_offset(offset if offset is not None else F.lit(0)))


def fix_timezone(t: Column, zone: str) -> Column:
    """The wall time that was read as UTC belongs to ``zone``."""
    return F.to_utc_timestamp(t, zone)


def zone_offset(t: Column, zone: str) -> Column:
    """Seconds that ``zone`` is ahead of UTC at an instant."""
    return ((F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)) / 1000000).cast("int")


def guess_timezone(t: Column, received: Column) -> Column:
    """Moves a stamp by the quarter hours that bring it nearest to its receipt."""
    diff = F.unix_micros(received) - F.unix_micros(t)
    step = F.lit(900 * 1000000).cast("bigint")
    return F.timestamp_micros(F.unix_micros(t) + (F.round(diff / step) * step).cast("bigint"))


def stardate(t: Column, digits: int = 2) -> Column:
    """The year and its elapsed part."""
    start = F.make_timestamp(F.year(t), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.make_timestamp(F.year(t) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    part = (F.unix_micros(t) - F.unix_micros(start)) / (F.unix_micros(end) - F.unix_micros(start))
    return F.format_string(f"%.{digits}f", F.year(t) + part)


def macro(name: str, t: Column, offset: Column | None = None) -> Column:
    """A date macro (DATE, ISODATE, HOUR, ...) of a timestamp."""
    local = t if offset is None else F.timestamp_micros(F.unix_micros(t) + offset.cast("bigint") * 1000000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    made = {
        "DATE": lambda: F.concat(F.date_format(local, "MMM "), F.lpad(F.dayofmonth(local).cast("string"), 2, " "), F.date_format(local, " HH:mm:ss")),
        "FULLDATE": lambda: F.concat(F.date_format(local, "yyyy MMM "), F.lpad(F.dayofmonth(local).cast("string"), 2, " "), F.date_format(local, " HH:mm:ss")),
        "ISODATE": lambda: F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), format_offset(offset if offset is not None else F.lit(0))),
        "YEAR": lambda: F.year(local).cast("string"), "YEAR_DAY": lambda: F.lpad(F.dayofyear(local).cast("string"), 3, "0"), "MONTH": lambda: two(F.month(local)),
        "MONTH_WEEK": lambda: F.floor((F.dayofmonth(local) - 1 + F.weekday(F.trunc(local, "month"))) / 7).cast("string"),
        "MONTH_ABBREV": lambda: F.date_format(local, "MMM"), "MONTH_NAME": lambda: F.date_format(local, "MMMM"), "DAY": lambda: two(F.dayofmonth(local)), "HOUR": lambda: two(F.hour(local)),
        "HOUR12": lambda: F.date_format(local, "hh"), "MIN": lambda: two(F.minute(local)), "SEC": lambda: two(F.second(local)), "USEC": lambda: F.date_format(local, "SSSSSS"), "MSEC": lambda: F.date_format(local, "SSS"),
        "AMPM": lambda: F.date_format(local, "a"), "WEEKDAY": lambda: F.date_format(local, "EEE"), "WEEK_DAY": lambda: F.dayofweek(local).cast("string"), "WEEK_DAY_ABBREV": lambda: F.date_format(local, "EEE"),
        "WEEK_DAY_NAME": lambda: F.date_format(local, "EEEE"), "WEEK": lambda: two(F.floor((F.dayofyear(local) + 6 - F.weekday(local)) / 7)), "ISOWEEK": lambda: two(F.weekofyear(local)),
        "TZOFFSET": lambda: format_offset(offset if offset is not None else F.lit(0)), "TZ": lambda: format_offset(offset if offset is not None else F.lit(0)), "UNIXTIME": lambda: F.unix_timestamp(t).cast("string"),
    }
    made["STAMP"] = made["DATE"]
    return made[name]()


MACROS = ("DATE", "FULLDATE", "ISODATE", "STAMP", "YEAR", "YEAR_DAY", "MONTH", "MONTH_WEEK", "MONTH_ABBREV", "MONTH_NAME", "DAY", "HOUR", "HOUR12", "MIN", "SEC", "USEC", "MSEC", "AMPM", "WEEKDAY", "WEEK_DAY", "WEEK_DAY_ABBREV", "WEEK_DAY_NAME", "WEEK", "ISOWEEK", "TZOFFSET", "TZ", "UNIXTIME")
