"""Column expressions shared by the statistics. All times are TIMESTAMP_NTZ, so the session's time zone plays no part."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the dates that count as well formed.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def local_time(text: Column) -> Column:
    """Wall time of an RFC 3339 string, null if it is malformed."""
    return F.when(text.rlike(RFC3339), F.substring(text, 1, 19).try_cast("timestamp_ntz"))


def utc_time(text: Column) -> Column:
    """UTC time of an RFC 3339 string, null if it is malformed."""
    sign = F.when(F.substring(text, -6, 1) == "-", 1).otherwise(-1)
    minutes = F.when(F.substring(text, -1, 1) == "Z", 0).otherwise(
        sign * (F.substring(text, -5, 2).try_cast("int") * 60 + F.substring(text, -2, 2).try_cast("int"))
    )
    return local_time(text) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, as BIGINT."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def round_k(x: Column, k: int) -> Column:
    """Rounds half away from zero on the scaled binary value."""
    scale = float(10**k)
    return F.round(x * scale) / scale


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Text before the last slash; `.` at the root."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1))


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot; dotfiles keep their name, the rest is `(none)`."""
    base = F.regexp_replace(basename(path), "(?s)^[^:]*:", "")
    last = F.concat(F.lit("."), F.substring_index(base, ".", -1))
    dots = F.length(base) - F.length(F.replace(base, F.lit("."), F.lit("")))
    leading = F.startswith(base, F.lit("."))
    return (
        F.when((dots == 0) | (base == "."), "(none)")
        .when(leading & (dots == 1), F.lower(base))
        .when(last == ".", "(none)")
        .otherwise(F.lower(last))
    )


def strip_repo(path: Column) -> Column:
    """Without a leading `<repo>:`, unless what stands before the colon looks like a path or a glob."""
    return F.when(path.rlike(r"(?s)^[^:/*?\[]*:"), F.regexp_replace(path, r"(?s)^[^:]*:", "")).otherwise(path)


def iso_week(ts: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def period(ts: Column, granularity: str) -> Column:
    """Bucket label; an unknown granularity is a month."""
    if granularity == "week":
        return iso_week(ts)
    return F.date_format(ts, {"day": "yyyy-MM-dd", "year": "yyyy"}.get(granularity, "yyyy-MM"))


def minus_months(day: Column, months: int) -> Column:
    """Calendar months back; days that the month lacks run over into the next."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def months(day: Column | str) -> Column:
    """Months since year 0."""
    return F.year(day) * 12 + F.month(day)


def cut_message(message: Column, limit: int, keep: int) -> Column:
    """More than `limit` bytes: the first `keep` bytes and three dots."""
    head = F.make_valid_utf8(F.substring(F.encode(message, "UTF-8"), 1, keep).cast("string"))
    return F.when(F.octet_length(message) > limit, F.concat(head, F.lit("..."))).otherwise(message)


def weekday_name(ts: Column) -> Column:
    names = F.array(*(F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")))
    return F.get(names, F.weekday(ts))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a shell glob in which * and ? do not cross a slash."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif end > 0:
            inner = glob[i + 1 : end]
            negated = inner.startswith("^")
            out.append(f"[{'^' if negated else ''}{re.escape(inner[1:] if negated else inner).replace(chr(92) + '-', '-')}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """True if a pattern fits the base name or the whole path, or names a directory above it (`dist/`, `dist/*`, `dist*`)."""
    found = F.lit(False)
    for p in patterns:
        rule = glob_regex(p)
        found = found | basename(path).rlike(rule) | path.rlike(rule)
        stem = p.removesuffix("*").removesuffix("/")
        if stem and stem != p:
            found = found | F.startswith(path, F.lit(f"{stem}/"))
    return found
