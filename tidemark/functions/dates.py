"""Calendar functions: Beijing days (UTC+8, no summer time), ISO weeks, loose and relative dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

HOURS_AHEAD = "INTERVAL 8 HOURS"
# Hours of the provider's peak price on working days.
PEAK_HOURS = [9, 10, 11, 14, 15, 16, 17]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def beijing(at: Column) -> Column:
    """The wall clock there of a UTC time."""
    return at + F.expr(HOURS_AHEAD)


def beijing_date(at: Column) -> Column:
    return F.to_date(beijing(at))


def beijing_time(at: Column) -> Column:
    return F.date_format(beijing(at), "HH:mm")


def beijing_iso(at: Column) -> Column:
    return F.concat(F.date_format(beijing(at), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def beijing_midnight(day: Column) -> Column:
    return day.cast("timestamp_ntz") - F.expr(HOURS_AHEAD)


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def valid_date(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_peak(at: Column, off_days: list[str] | None = None) -> Column:
    there = beijing(at)
    working = ~F.dayofweek(there).isin(1, 7)
    if off_days:
        working &= ~F.to_date(there).cast("string").isin(off_days)
    return working & F.hour(there).isin(PEAK_HOURS)


def next_off_peak(at: Column) -> Column:
    """The time itself, or where the peak that it lies in ends."""
    hour = F.hour(beijing(at))
    end = F.date_trunc("hour", at).cast("timestamp_ntz") + F.when(hour < 12, F.make_interval(hours=12 - hour)).otherwise(F.make_interval(hours=18 - hour))
    return F.when(is_peak(at), end).otherwise(at)


def story_status(latest: Column, now: Column) -> Column:
    age = F.timestamp_diff("SECOND", latest, now)
    return F.when(age < 24 * 3600, "active").when(age < 72 * 3600, "watching").otherwise("settled")


def slot(at: Column, start: Column, hours: int = 1) -> Column:
    return F.floor(F.timestamp_diff("SECOND", start, at) / (3600 * hours))


def loose_date(s: Column, offset_hours: int = 8) -> Column:
    """A date in text, in UTC; a clock without a zone is at the offset. Without a year there is none.

    Text is read as numbers, words and signs, each of which has a letter in a shape: Y and n numbers
    of four and of one or two digits, N others, M a month's name, A am or pm, Z a zone's name, w
    other words. Where a date and a clock stand in the shape, the numbers are taken from there.
    Reads year, month, day with signs between (then a clock only right behind), month, day, year
    with strokes, and months by name with the day on either side, or none for the first; a year of
    two digits behind day and month. An ISO date alone is midnight in UTC.
    """
    lower = F.regexp_extract_all(F.lower(F.trim(s)), F.lit("[0-9]+|[a-z]+|\\S"), F.lit(0))
    return let(F.filter(lower, lambda t: ~t.isin("st", "nd", "rd", "th")), lambda tokens: let(F.array_join(F.transform(tokens, _role), ""), lambda shape: _dated(tokens, shape, offset_hours)))


def _month(word: Column) -> Column:
    """The number of a month by its name or its first three letters or more; 0 for other words."""
    whole = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.when(F.length(word) >= 3, F.array_position(F.transform(whole, lambda m: F.startswith(m, word)), F.lit(True))).otherwise(0)


def _role(t: Column) -> Column:
    digits = F.when(F.length(t) == 4, "Y").when(F.length(t) < 3, "n").otherwise("N")
    letters = F.when(_month(t) > 0, "M").when(t.isin("am", "pm"), "A").when(t.isin("z", "gmt", "utc"), "Z").otherwise("w")
    return F.when(t.between("0", "9~"), digits).when(t.between("a", "z~"), letters).when(t.isin(*"-/.:+,年月日"), t).otherwise("s")


#: A clock in a shape, with its zone: hour, minute, then perhaps second and its fraction.
ZONE = "(?:Z(?:[+-](?:Y|n:n))?|[+-](?:Y|n:n))"
CLOCK = f"n:n(?::n(?:[.][nNY])?)?A?{ZONE}?"


def _dated(tokens: Column, shape: Column, offset_hours: int) -> Column:
    number = lambda at: F.get(tokens, at - 1).try_cast("int")
    clock_at = F.regexp_instr(shape, F.lit(CLOCK))
    clock = F.regexp_extract(shape, CLOCK, 0)
    # Its place stays, so that places in the rest are those of the tokens.
    rest = F.when(clock_at > 0, F.concat(F.substr(shape, F.lit(1), clock_at - 1), F.repeat(F.lit("_"), F.length(clock)), F.substr(shape, clock_at + F.length(clock)))).otherwise(shape)
    at = {k: F.regexp_instr(rest, F.lit(p)) for k, p in {"ymd": "Y[-/.年]n[-/.月]n", "mdy": "n([-/])n\\1Y", "month": "M", "year": "Y"}.items()}
    behind = F.length(F.regexp_extract(F.substr(rest, at["ymd"] + 5), "^日?w?", 0))
    m = at["month"]
    after = F.length(F.regexp_extract(F.substr(rest, m + 1), "^[.,]*n", 0))
    before = F.length(F.regexp_extract(F.substr(rest, F.lit(1), m - 1), "n[.,]*w?$", 0))
    day_after, day_before = F.when(after > 0, number(m + after)), F.when(before > 0, number(m - before))
    short = (at["year"] == 0) & (after > 0) & (before > 0) & (F.length(F.get(tokens, m + after - 1)) == 2)
    century = lambda y: y + F.when(y < 50, 2000).otherwise(1900)
    none = F.struct(*[F.lit(None).cast("int").alias(c) for c in ("y", "m", "d")])
    part = lambda y, mo, d: F.struct(y.cast("int").alias("y"), mo.cast("int").alias("m"), d.cast("int").alias("d"))
    found = (
        F.when(at["ymd"] > 0, part(number(at["ymd"]), number(at["ymd"] + 2), number(at["ymd"] + 4)))
        .when(at["mdy"] > 0, part(number(at["mdy"] + 4), number(at["mdy"]), number(at["mdy"] + 2)))
        .when((m > 0) & short, part(century(number(m + after)), _month(F.get(tokens, m - 1)), day_before))
        .when((m > 0) & (at["year"] > 0), part(number(at["year"]), _month(F.get(tokens, m - 1)), F.coalesce(day_after, day_before, F.lit(1))))
        .otherwise(none)
    )
    told = (clock_at > 0) & ((at["ymd"] == 0) | (clock_at == at["ymd"] + 5 + behind))
    return let(found, lambda d: _in_utc(tokens, shape, clock, clock_at, told, d, offset_hours))


def _in_utc(tokens: Column, shape: Column, clock: Column, clock_at: Column, told: Column, d: Column, offset_hours: int) -> Column:
    token = lambda k: F.get(tokens, clock_at + k - 2)
    number = lambda k: token(k).try_cast("int")
    has = lambda p: clock.rlike(p)
    half = F.instr(clock, "A")
    hour = F.when(half == 0, number(1)).otherwise(number(1) % 12 + F.when(token(half) == "pm", 12).otherwise(0))
    second = F.when(has("^n:n:n"), number(5)).otherwise(0)
    fraction = F.when(has("^n:n:n[.]"), F.concat(F.lit("0."), token(7)).try_cast("double")).otherwise(0.0)
    sure = told & number(1).between(0, 23) & number(3).between(0, 59) & second.between(0, 59)
    wall = F.when(sure, hour * 3600 + number(3) * 60 + second + fraction).when(~told, 0.0)
    # The zone's sign stands before its last one or three tokens.
    four, two = has("[+-]Y$"), has("[+-]n:n$")
    last = F.length(clock)
    size = F.when(four, F.substr(token(last), F.lit(1), F.lit(2)).try_cast("int") * 60 + F.substr(token(last), F.lit(3), F.lit(2)).try_cast("int")).when(two, number(last - 2) * 60 + number(last)).otherwise(0)
    sign = F.when(token(F.when(four, last - 1).otherwise(last - 3)) == "-", -1).otherwise(1)
    zone = F.when(told & has(f"{ZONE}$"), 60 * F.when(four | two, sign * size).otherwise(0))
    alone = (shape == "Y-n-n") & (F.length(F.array_join(tokens, "")) == 10)
    day = F.try_to_timestamp(F.concat_ws("-", F.lpad(d["y"].cast("string"), 4, "0"), F.lpad(d["m"].cast("string"), 2, "0"), F.lpad(d["d"].cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    seconds = wall - F.coalesce(zone, F.when(alone, 0).otherwise(offset_hours * 3600))
    return F.when(d["y"].isNotNull() & d["m"].isNotNull() & d["d"].isNotNull(), day + F.make_interval(secs=seconds.cast("decimal(18,6)")))


def relative_date(s: Column, now: Column, offset_hours: int = 8) -> Column:
    """An age in text counted back from now, in UTC. Days give the midnight there, smaller units the time."""
    return let(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), r"^[^·]+·\s*", ""), lambda v: _relative(v, now, offset_hours))


def _relative(v: Column, now: Column, offset_hours: int) -> Column:
    # The words for units and days.
    units = {"秒": 1, "分钟": 60, "分": 60, "小时": 3600, "天": 86400, "second": 1, "minute": 60, "min": 60, "m": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400}
    back = {"今天": 0, "昨天": 1, "前天": 2, "yesterday": 1}
    table = lambda m: F.create_map(*[F.lit(x) for p in m.items() for x in p])
    midnight = lambda t: F.date_trunc("day", t + F.expr(f"INTERVAL {offset_hours} HOURS")).cast("timestamp_ntz") - F.expr(f"INTERVAL {offset_hours} HOURS")
    # An age is a number and a unit with a mark behind; the unit is looked up, in the singular.
    compact = F.lower(F.regexp_replace(v, r"\s+", ""))
    body = F.when(F.endswith(compact, F.lit("前")), F.regexp_replace(compact, "前$", "")).when(F.endswith(F.lower(v), F.lit(" ago")), F.regexp_replace(compact, "ago$", ""))
    def age(b: Column) -> Column:
        digits = F.regexp_extract(b, "^[0-9]{1,3}(?![0-9])", 0)
        said = F.substr(b, F.length(digits) + 1, F.length(b))
        # Han units go with the Han mark, others with the English one.
        fits = (digits != "") & (F.endswith(v, F.lit("前")) == said.rlike("^[^a-z]+$"))
        unit = F.coalesce(table(units)[said], F.when(F.length(said) > 2, table(units)[F.regexp_replace(said, "s$", "")]))
        return F.when(fits & unit.isNotNull(), F.struct(digits.try_cast("int").alias("n"), unit.alias("seconds")))

    def back_from_now(x: Column) -> Column:
        counted = now - F.make_interval(secs=(x["n"] * x["seconds"]).cast("decimal(18,6)"))
        return F.when(x["seconds"] >= 86400, midnight(counted)).otherwise(counted)

    ago = let(let(body, age), back_from_now)
    day = F.substring(v, 1, 2)
    clock_text = F.split(F.trim(F.substr(v, F.lit(3), F.length(v))), ":")
    hh, mm = F.get(clock_text, F.lit(0)), F.get(clock_text, F.lit(1))
    told = day.isin("今天", "昨天", "前天") & (F.size(clock_text) == 2) & F.length(hh).between(1, 2) & (F.length(mm) == 2)
    clock = F.when(told & (hh.try_cast("int") < 24) & (mm.try_cast("int") < 60), midnight(now - F.make_interval(days=table(back)[day])) + F.make_interval(hours=hh.try_cast("int"), mins=mm.try_cast("int")))
    word = F.lower(F.regexp_extract(v, "(?i)^(昨天|前天|yesterday)$", 1))
    named = F.when(word != "", midnight(now - F.make_interval(days=table(back)[word])))
    just = F.when(v.rlike("(?i)^(刚刚|just now)$"), now)
    return F.coalesce(clock, just, named, ago)


def crossref_date(parts: Column) -> Column:
    """date-parts [[y, m, d]] as a date; a missing month or day is 1, an impossible one null."""
    p = parts[0]
    text = F.concat_ws("-", F.lpad(F.get(p, F.lit(0)).cast("string"), 4, "0"), *[F.lpad(F.coalesce(F.get(p, F.lit(k)), F.lit(1)).cast("string"), 2, "0") for k in (1, 2)])
    return F.try_to_date(text, "yyyy-MM-dd")


def pacific_to_utc(clock: Column) -> Column:
    """A wall clock in Los Angeles, summer time included, as UTC."""
    return F.to_utc_timestamp(clock, "America/Los_Angeles").cast("timestamp_ntz")
