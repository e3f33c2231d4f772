"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Values are found by one pattern, checked (Luhn, mod 97, calendar, ranges), and permuted by keyed
Feistel networks over exactly the valid values of their format, so the pseudonym is valid too,
two values never share one, and equal values stay linked across documents. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import hmac
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let

#: What each kind looks like; checks follow. Order matters: the first that matches takes the text.
EMAIL = r"(?<![\w.%+\p{L}-])[\w.%+\p{L}\p{N}-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})"
# How long each country's account numbers are, with country and check digits.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}
#: In groups of four, as printed; a country's length says which groups belong to it.
GROUPED = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{GROUPED})(?![A-Za-z0-9])"
#: Cards in one run, in fours or as 4-6-5, so that a number next to one is no part of it.
CARD = r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{1,2}|[0-9]{1,2}(?:-[0-9]{1,2}-|/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4})(?![0-9/-])(?!\.[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
#: Global, local and link-local addresses, in full or with one run of zeros left out.
IPV6 = r"(?<![\w:.])(?:[23][0-9A-Fa-f]{3}|[fF][c-eC-E][0-9A-Fa-f]{2})(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\w:])"
# The months.
MONTHS = "January February March April May June July August September October November December".split()
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE_WORDS = rf"(?<![\w.])[0-9]{{1,2}}(?:st|nd|rd|th)? (?:of )?{MONTH}\.?,? [0-9]{{4}}(?![0-9])|(?<!\w){MONTH}\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}(?![0-9])"
# The months in the other languages of the corpus.
OTHER_MONTHS = {
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
OTHER_MONTH = "(?i:" + "|".join(sorted({m for ms in OTHER_MONTHS.values() for m in ms}, key=lambda m: (-len(m), m))) + ")"
DATE_OTHER = rf"(?<![\w.])[0-9]{{1,2}}(?:er|\.)? (?:de )?{OTHER_MONTH} (?:de )?[0-9]{{4}}(?![0-9])"
PHONE_PLAIN = r"(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
#: A blank in a number with a + is no part of it if another value follows; from the seventh digit
#: on, a plain phone number is one too; four groups of a longer run are no card. After +1 and an area code in brackets seven digits follow.
OTHERS = "|".join((EMAIL, rf"(?:{CARD})(?! [0-9]{{4}}(?![0-9]))", SSN, DATE, IP))
PHONE_PLUS = (
    r"\+1[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]"
    rf"(?:(?:[.-]| (?!{OTHERS}))?[0-9]){{5}}(?:(?:[.-]| (?!{OTHERS}|{PHONE_PLAIN}))?[0-9]){{0,7}}(?![0-9])"
)
#: What a found phone looks like by itself, where nothing follows that could bound it.
PHONE = rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){{5,12}}(?![0-9])|{PHONE_PLAIN}"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, CARD, SSN, DATE, DATE_WORDS, DATE_OTHER, IP, IPV6, f"{PHONE_PLUS}|{PHONE_PLAIN}"))

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Letters beyond ASCII move within their alphabet's range too; those of other scripts stay.
RANGES = ((0xE0, 0xF6), (0xC0, 0xD6), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x430, 0x44F), (0x410, 0x42F))
ALPHABETS = (LOWER, UPPER, DIGITS, *("".join(map(chr, range(a, z + 1))) for a, z in RANGES))
ROUNDS = 6


def round_key(key: str | Column, label: str) -> Column:
    """The key of one round. Of a text key, plans and event logs show only what is derived here,
    which stands for the rounds' keys and not for the key itself; of a column nothing is shown."""
    if isinstance(key, Column):
        return F.concat(key, F.lit(f"|{label}|"))
    return F.lit(hmac.new(key.encode(), label.encode(), hashlib.sha256).hexdigest())


def keyed(key: str | Column, label: str, value: Column) -> Column:
    """A keyed number below 2^60 for a value."""
    return F.conv(F.substring(F.sha2(F.concat(round_key(key, label), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: Column | int, b: Column | int, key: str, label: str) -> Column:
    """The place of x, below a * b, under a keyed permutation of 0 .. a * b - 1.

    An alternating network over Z_a x Z_b: each round adds a keyed function of one side to the
    other, which can be undone whatever the function, so no cycle-walking is needed.
    """
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))

    def rounds(state: Column) -> Column:
        for r in range(ROUNDS):
            if r % 2:
                state = let(state, lambda s, r=r: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(keyed(key, f"{label}{r}", s["l"]), b), b).alias("r")))
            else:
                state = let(state, lambda s, r=r: F.struct(F.pmod(s["l"] + F.pmod(keyed(key, f"{label}{r}", s["r"]), a), a).alias("l"), s["r"].alias("r")))
        return let(state, lambda s: s["l"] * b + s["r"])

    # The quotient is whole, so rounding it is exact where a double's last digit is off.
    return rounds(F.struct(F.round((x - F.pmod(x, b)) / b).cast("long").alias("l"), F.pmod(x, b).alias("r")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def put_digits(shape: Column, new: Column) -> Column:
    """shape with its digits replaced, in order, by those of new."""
    place = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substr(shape, i, F.lit(1)).between("0", "9"), F.substr(new, F.length(digits_of(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substr(shape, i, F.lit(1))))
    return F.array_join(place, "")


def padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(d: Column, key: str, label: str) -> Column:
    """A digit string (1 to 18 long) permuted among all of its length."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    return padded(feistel(d.cast("long"), power10(half), power10(n - half), key, label), n)


def luhn_sum(d: Column, doubled_at: int) -> Column:
    """Sum of digits from the right, every second one doubled; doubled_at: 0 if the last one is."""
    value = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == doubled_at, let(c.cast("int") * 2, lambda t: F.when(t > 9, t - 9).otherwise(t))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda s, v: s + v)


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
    full = let(body, lambda p: F.concat(p, F.pmod(10 - luhn_sum(p, 0) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(d, 1) % 10 == 0, put_digits(m, full)).otherwise(m)


def mod97(s: Column) -> Column:
    """The remainder by 97 of letters (A is 10) and digits read as one number."""
    return F.aggregate(
        F.split(s, ""), F.lit(0),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )


def shift_string(s: Column, key: str | Column, label: str, alphabets: tuple[str, ...] = (LOWER, UPPER, DIGITS)) -> Column:
    """A string permuted among those with characters of the same alphabets in the same places.

    The halves take turns: each character of one moves within its class by a keyed amount that
    depends on the other half.
    """

    def moved(part: Column, other: Column, r: int) -> Column:
        stream = F.sha2(F.concat(round_key(key, f"{label}{r}"), other), 512)

        def one(hex_: Column, i: Column) -> Column:
            c = F.substr(part, i, F.lit(1))
            by = F.conv(F.substr(hex_, 2 * F.pmod(i - 1, F.lit(63)) + 1, F.lit(3)), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), c)
                out = F.when((c != "") & (at > 0), F.substr(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
            return out

        runs = let(stream, lambda h: F.transform(F.sequence(F.lit(1), F.length(part)), lambda i: one(h, i)))
        return F.when(F.length(part) > 0, F.array_join(runs, "")).otherwise("")

    half = F.floor(F.length(s) / 2).cast("int")
    state = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r"))
    for r in range(4):
        if r % 2:
            state = let(state, lambda p, r=r: F.struct(p["l"].alias("l"), moved(p["r"], p["l"], r).alias("r")))
        else:
            state = let(state, lambda p, r=r: F.struct(moved(p["l"], p["r"], r).alias("l"), p["r"].alias("r")))
    return let(state, lambda p: F.concat(p["l"], p["r"]))


def iban(m: Column, key: str) -> Column:
    """The country stays, check digits follow, and so do the blanks of a printed number."""

    def of(d: Column) -> Column:
        country, body = F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(5), F.length(d))
        new = let(shift_string(body, key, "iban"), lambda b: F.concat(country, padded(98 - mod97(F.concat(b, country, F.lit("00"))), 2), b))
        return F.when(mod97(F.concat(body, F.substr(d, F.lit(1), F.lit(4)))) == 1, new).otherwise(d)

    def grouped(d: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(d), F.lit(4)), lambda i: F.substr(d, i, F.lit(4))), " ")

    new = let(F.replace(m, F.lit(" "), F.lit("")), of)
    return F.when(F.contains(m, F.lit(" ")), let(new, grouped)).otherwise(new)


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999, permuted among themselves."""
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    nth = F.when(area > 666, area - 2).otherwise(area - 1).cast("long")
    new = feistel(nth * (99 * 9999) + (group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")

    def shown(x: Column) -> Column:
        a = F.floor(x / (99 * 9999)).cast("int")
        return F.concat_ws("-", padded(F.when(a >= 665, a + 2).otherwise(a + 1), 3), padded(F.pmod(F.floor(x / 9999), F.lit(99)) + 1, 2), padded(F.pmod(x, F.lit(9999)) + 1, 4))

    return F.when(valid, let(new, shown)).otherwise(m)


def move_date(d: Column, key: str) -> Column:
    """A date permuted among the days of its century, 36,525 (75 x 487) or 36,524 (92 x 397)."""
    first = F.floor(F.year(d) / 100).cast("int")
    start = F.make_date(first * 100, F.lit(1), F.lit(1))
    long = first % 4 == 0
    a, b = F.when(long, 75).otherwise(92).cast("long"), F.when(long, 487).otherwise(397).cast("long")
    return F.date_add(start, feistel(F.datediff(d, start).cast("long"), a, b, key, "date").cast("int"))


def date(m: Column, key: str) -> Column:
    """Year first: year, month, day. With points: day, month, year. With strokes or hyphens: month,
    day, year, or, where that is no date, day, month, year; such days stay over 12 by cycle-walking."""
    mark = F.regexp_extract(m, "([-./])", 1)
    part = F.split(m, "[-./]")

    def parsed(y: int, mo: int, d: int) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(part[y], 4, "0"), F.lpad(part[mo], 2, "0"), F.lpad(part[d], 2, "0")), "yyyy-MM-dd")

    narrow = F.exists(part, lambda p: F.length(p) == 1)
    two = lambda x: F.when(narrow, x.cast("string")).otherwise(padded(x, 2))
    four = lambda x: padded(F.year(x), 4)
    ymd = lambda x: F.concat(four(x), mark, two(F.month(x)), mark, two(F.dayofmonth(x)))
    dmy = lambda x: F.concat(two(F.dayofmonth(x)), mark, two(F.month(x)), mark, four(x))
    mdy = lambda x: F.concat(two(F.month(x)), mark, two(F.dayofmonth(x)), mark, four(x))

    def walked(d: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(96)), move_date(d, key), lambda x, _: F.when(F.dayofmonth(x) > 12, x).otherwise(move_date(x, key)))

    def given(d: Column, move, form) -> Column:
        return let(d, lambda x: F.when(x.isNotNull() & (F.year(x) > 0), let(move(x), form)))

    plain = lambda x: move_date(x, key)
    out = (
        F.when(F.length(part[0]) == 4, given(parsed(0, 1, 2), plain, ymd))
        .when(mark == ".", given(parsed(2, 1, 0), plain, dmy))
        .when(part[0].cast("int") <= 12, given(parsed(2, 0, 1), plain, mdy))
        .otherwise(given(parsed(2, 1, 0), walked, dmy))
    )
    return F.coalesce(out, m)


def date_words(m: Column, key: str) -> Column:
    """A day, a month by name and a year, permuted as a date; a short month's name stays short."""
    month = F.regexp_extract(m, f"({MONTH})", 1)
    nth = F.floor(F.instr(F.lit("".join(n[:3] for n in MONTHS)), F.substr(month, F.lit(1), F.lit(3))) / 3).cast("int") + 1
    day = F.regexp_extract(m, "(?<![0-9])([0-9]{1,2})(?![0-9])", 1)
    full = F.array(*[F.lit(n) for n in MONTHS])
    d = F.try_to_date(F.concat_ws("-", F.regexp_extract(m, "([0-9]{4})$", 1), padded(nth, 2), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def shown(x: Column) -> Column:
        n = F.dayofmonth(x)
        ending = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")
        digits = F.when(F.startswith(day, F.lit("0")), padded(n, 2)).otherwise(n.cast("string"))
        name = F.get(full, F.month(x) - 1)
        name = F.when(month == F.get(full, nth - 1), name).otherwise(F.substr(name, F.lit(1), F.lit(3)))
        out = F.regexp_replace(m, F.lit("[0-9]{4}$"), padded(F.year(x), 4))
        out = F.regexp_replace(out, F.lit("(?<![0-9])[0-9]{1,2}(?:st|nd|rd|th)?(?![0-9])"), F.concat(digits, F.when(m.rlike("[0-9](?:st|nd|rd|th)"), ending).otherwise("")))
        return F.regexp_replace(out, F.lit(MONTH), name)

    moved = let(d, lambda x: F.when(x.isNotNull() & (F.year(x) > 0), let(move_date(x, key), shown)))
    return F.coalesce(moved, m)


def date_other(m: Column, key: str) -> Column:
    """A day, a month's name in one of OTHER_MONTHS and a year, permuted as a date. The name is of
    the first language that has the old one, and as large or small as that began."""
    names = F.array(*[F.lit(n) for ms in OTHER_MONTHS.values() for n in ms])
    word = F.regexp_extract(m, f"({OTHER_MONTH})", 1)
    place = F.array_position(F.transform(names, F.lower), F.lower(word)) - 1
    d = F.try_to_date(F.concat_ws("-", F.regexp_extract(m, "([0-9]{4})$", 1), padded(F.pmod(place, F.lit(12)) + 1, 2), F.lpad(F.regexp_extract(m, "^([0-9]{1,2})", 1), 2, "0")), "yyyy-MM-dd")

    def shown(x: Column) -> Column:
        name = F.get(names, (place - F.pmod(place, F.lit(12)) + F.month(x) - 1).cast("int"))
        cased = F.when(F.substring(word, 1, 1) == F.lower(F.substring(word, 1, 1)), F.lower(name)).otherwise(F.initcap(name))
        day = F.when(F.startswith(m, F.lit("0")), padded(F.dayofmonth(x), 2)).otherwise(F.dayofmonth(x).cast("string"))
        out = F.regexp_replace(m, F.lit("[0-9]{4}$"), padded(F.year(x), 4))
        return F.regexp_replace(F.regexp_replace(out, F.lit("^[0-9]{1,2}"), day), F.lit(OTHER_MONTH), cased)

    moved = let(d, lambda x: F.when(x.isNotNull() & (F.year(x) > 0), let(move_date(x, key), shown)))
    return F.coalesce(moved, m)


def ipv6(m: Column, key: str) -> Column:
    """The first group stays; the digits of the others are permuted in their places. Two ways to
    write an address are two values."""
    first = F.regexp_extract(m, "^([^:]+)", 1)
    rest = F.substr(m, F.length(first) + 1, F.length(m))
    low, high = (shift_string(rest, key, "ipv6", (DIGITS + letters,)) for letters in ("abcdef", "ABCDEF"))
    return F.concat(first, F.when(rest.rlike("[A-F]") & ~rest.rlike("[a-f]"), high).when(~rest.rlike("[A-F]"), low).otherwise(shift_string(rest, key, "ipv6", (DIGITS, "abcdef", "ABCDEF"))))


def ip(m: Column, key: str) -> Column:
    """Addresses from 1.0.0.0 to 223.255.255.255, permuted among themselves."""
    o = [F.split(m, r"\.")[i].cast("long") for i in range(4)]
    valid = o[0].between(1, 223) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
    new = feistel((((o[0] - 1) * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 223 * 256, 65_536, key, "ip")
    shown = lambda x: F.concat_ws(".", F.shiftright(x, 24) + 1, F.pmod(F.shiftright(x, 16), F.lit(256)), F.pmod(F.shiftright(x, 8), F.lit(256)), F.pmod(x, F.lit(256)))
    return F.when(valid, let(new, shown)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """The country code stays. Ten-digit numbers of the North American plan keep to areas and
    exchanges from 200; others are permuted among all numbers of their length."""
    d = digits_of(m)
    code = F.when(F.startswith(m, F.lit("+")), digits_of(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1))).otherwise("")
    code = F.when(F.startswith(m, F.lit("+")) & (code == ""), F.substr(d, F.lit(1), F.lit(1))).otherwise(code)
    rest = F.substr(d, F.length(code) + 1, F.length(d))
    area, exchange, line = F.substr(rest, F.lit(1), F.lit(3)).cast("int"), F.substr(rest, F.lit(4), F.lit(3)).cast("int"), F.substr(rest, F.lit(7), F.lit(4)).cast("int")
    planned = code.isin("", "1") & (F.length(rest) == 10) & (area >= 200) & (exchange >= 200)
    nanp = feistel((area - 200).cast("long") * 8_000_000 + (exchange - 200) * 10_000 + line, 800, 8_000_000, key, "nanp")
    shown = lambda x: F.concat(padded(F.floor(x / 8_000_000) + 200, 3), padded(F.pmod(F.floor(x / 10_000), F.lit(800)) + 200, 3), padded(F.pmod(x, F.lit(10_000)), 4))
    new = F.when(planned, let(nanp, shown)).when(F.length(rest) >= 6, permute_digits(rest, key, "phone"))
    return F.coalesce(put_digits(m, F.concat(code, new)), m)


def email(m: Column, key: str) -> Column:
    """The part before the @ is permuted; the domain stays."""
    at = F.instr(m, "@")
    return F.concat(shift_string(F.substr(m, F.lit(1), at - 1), key, "email", ALPHABETS), F.substr(m, at, F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a found value; the value itself if its check fails."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    kinds = ((EMAIL, email), (IBAN, iban), (CARD, card), (SSN, ssn), (DATE, date), (DATE_WORDS, date_words), (DATE_OTHER, date_other), (IP, ip), (IPV6, ipv6), (PHONE, phone))
    return reduce(lambda out, kind: F.when(whole(kind[0]), kind[1](m, key)).otherwise(out), reversed(kinds), m)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count_as: str | None = "pii_values") -> DataFrame:
    """docs with its text column pseudonymised and a column count_as, the number of values changed.

    key is a secret text, or a column that holds it, as from a one-row table that is broadcast.
    With count_as None there is no such column, and all columns of docs stay whatever their names.

    Null texts stay null with 0 values, empty ones empty. All other columns and rows stay, but for
    one named count_as, which is replaced. Each row is treated by itself: no shuffle, whatever the
    size or skew; repeated rows come out the same, and very long texts are read whole.
    """
    column = F.col(f"`{text}`")
    swapped = let(F.regexp_extract_all(column, F.lit(ANY), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, let(F.transform(ms, lambda m: pseudonym(m, key)), lambda new: F.struct(
        F.array_join(F.transform(F.split(column, ANY, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(new, i), F.lit("")))), "").alias("text"),
        F.size(F.filter(F.arrays_zip(ms.alias("a"), new.alias("b")), lambda z: z["a"] != z["b"])).alias("n"),
    ))))
    # No value is without a digit or an @, so texts without either are not searched.
    done = F.when(column.rlike("[0-9@]"), swapped)
    held = "_pii"
    while held in docs.columns:
        held += "_"
    out = docs.withColumn(held, done).withColumn(text, F.coalesce(F.col(held)["text"], column))
    return (out.withColumn(count_as, F.coalesce(F.col(held)["n"], F.lit(0))) if count_as else out).drop(held)
