import datetime
import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii

SCHEMA = "doc_id long, text string"


def run(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [(r["text"], r["pii_values"]) for r in pii.pseudonymise(docs, key).orderBy("doc_id").collect()]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def with_check(body):
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def test_feistel_is_a_permutation(spark):
    for a, b in ((3, 5), (7, 7), (1, 9), (75, 487)):
        got = [r[0] for r in spark.range(a * b).select(pii.feistel(F.col("id"), a, b, "k", "x")).collect()]
        assert sorted(got) == list(range(a * b))
    big = [10**18 - 1 - 977 * k for k in range(300)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in big], "x long").select(pii.feistel(F.col("x"), 10**9, 10**9, "k", "x")).collect()]
    assert len(set(got)) == len(big) and all(0 <= x < 10**18 for x in got)


def test_kinds_stay_valid(spark):
    rng = random.Random(2)
    cards = [with_check("4" + "".join(rng.choice("0123456789") for _ in range(n))) for n in (11, 14, 14, 17) for _ in range(10)]
    for card, (new, n) in zip(cards, run(spark, cards), strict=True):
        assert n == 1 and new != card and len(new) == len(card) and new[0] == "4" and luhn(new)
    ips = [str(ipaddress.IPv4Address(rng.randrange(1 << 24, 224 << 24))) for _ in range(30)]
    new = [t for t, _ in run(spark, ips)]
    assert all(1 <= int(x.split(".")[0]) < 224 and ipaddress.IPv4Address(x) for x in new) and len(set(new)) == len(set(ips))
    days = [datetime.date(1950, 1, 1) + datetime.timedelta(k * 97) for k in range(300)]
    new = [datetime.date.fromisoformat(t) for t, _ in run(spark, [d.isoformat() for d in days])]
    assert len(set(new)) == len(days) and all(a.year // 100 == b.year // 100 for a, b in zip(days, new, strict=True))
    body = "370400440532013000"
    (iban, n), = run(spark, ["DE89" + body])
    assert n == 1 and re.fullmatch(r"DE\d{20}", iban) and mod97(iban[4:] + iban[:4]) == 1
    (ssn, n), = run(spark, ["665-12-3456"])
    assert n == 1 and re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn[:3] not in ("000", "666")
    (phone, n), = run(spark, ["+1 (247) 555-0086"])
    assert n == 1 and re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", phone)
    (mail, n), = run(spark, ["write to Ann.Lee42@mail.example.com."])
    assert n == 1 and re.fullmatch(r"write to [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@mail\.example\.com\.", mail)


def test_century_is_permuted_whole(spark):
    days = spark.range(36525).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    moved = days.select(pii.move_date(F.col("d"), "k").alias("m"))
    assert moved.distinct().count() == 36525 and moved.where("year(m) between 2000 and 2099").count() == 36525


def test_date_forms(spark):
    got = run(spark, ["3/7/1999", "25/12/1980", "31.12.1999", "2024/02/29", "03/07/1999"])
    assert [n for _, n in got] == [1] * 5
    assert re.fullmatch(r"\d{1,2}/\d{1,2}/19\d\d", got[0][0])
    day, month, _ = map(int, got[1][0].split("/"))
    assert day > 12 >= month
    assert re.fullmatch(r"\d\d\.\d\d\.19\d\d", got[2][0]) and re.fullmatch(r"20\d\d/\d\d/\d\d", got[3][0])
    assert [int(x) for x in got[0][0].split("/")] == [int(x) for x in got[4][0].split("/")]


def test_links_across_documents_and_keys(spark):
    a = run(spark, ["call +1 (247) 555-0086 now", "x +1 (247) 555-0086", "y +1 (247) 555-0087"])
    find = lambda t: re.search(r"\+.*\d", t[0])[0]
    assert find(a[0]) == find(a[1]) != find(a[2])
    assert find(run(spark, ["call +1 (247) 555-0086 now"], "other")[0]) != find(a[0])


@pytest.mark.parametrize("text", [None, "", "no values 12 here 3.14", "bad 4336980084469205 card", "999.1.1.1", "2023-02-30", "1.2.3", "v2.0.1.", "x@y", "000-12-3456", "a\nb\n\n"])
def test_others_stay(spark, text):
    assert run(spark, [text]) == [(text, 0)]


def test_surroundings_stay(spark):
    text = "\n4336980084469204, 60.167.242.55 and 60.167.242.55\n\ntail 4336980084469204"
    (new, n), = run(spark, [text])
    assert n == 4
    assert re.fullmatch(r"\n(\d{16}), (\d+\.\d+\.\d+\.\d+) and \2\n\ntail \1", new)


def test_long_and_odd_tables(spark):
    long = "lorem ipsum " * 20_000 + "60.167.242.55" + "a" * 200_000
    docs = spark.createDataFrame([(1, long, 5), (1, long, 5), (None, None, 6)], "doc_id long, text string, n int").withColumnRenamed("n", "m")
    rows = pii.pseudonymise(docs, "k").collect()
    assert [r["pii_values"] for r in rows] == [1, 1, 0] and rows[0]["text"] == rows[1]["text"] != long and rows[0]["m"] == 5
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_the_key_alone_decides(spark):
    """Two plans built apart give the same pseudonyms, for every kind of value."""
    text = "4336980084469204 123-45-6789 2024-02-29 25/12/1980 60.167.242.55 +1 (247) 555-0086 ann.lee@mail.example.com DE89370400440532013000"
    first, second = run(spark, [text]), run(spark, ["x", text])[1:]
    assert first == second and first[0][1] == 8


def test_each_kind_in_front_of_each(spark):
    """A value in front of another is found and changed as it is alone, and so is the other."""
    values = ["4336980084469204", "4336 9800 8446 9204", "123-45-6789", "2024-02-29", "25/12/1980", "31.12.1999", "60.167.242.55", "+1 (247) 555-0086", "+9 (247) 555-0086", "+1 247-555-0086", "+49 30 1234567", "+44 20 7946 0958", "(247) 555-0086", "247-555-0086", "ann.lee@mail.example.com", "42ann@mail.example.com", "DE89370400440532013000"]
    alone = dict(zip(values, run(spark, values), strict=True))
    assert all(n == 1 for _, n in alone.values())
    pairs = [(a, b) for a in values for b in values]
    got = run(spark, [f"{a} {b}" for a, b in pairs])
    wrong = [(p, g) for p, g in zip(pairs, got, strict=True) if g != (f"{alone[p[0]][0]} {alone[p[1]][0]}", 2)]
    assert not wrong


def test_printed_accounts_and_other_orders_of_dates(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32 here", "DE89370400440532013000", "am 2021.03.04, 04-03-2021", "3 März 2021, 3. mars 2021, 3 de marzo de 2021", "v1.2.3 and 2025550143 stay, so does DE88 3704 0044 0532 0130 00", "1er Août 1999"]
    (a, na), (b, nb), (c, nc), (d, nd), (e, ne), (f, nf) = run(spark, texts)
    assert (na, nb, nc, nd, ne, nf) == (2, 1, 2, 3, 0, 1) and e == texts[4]
    de, gb = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) and (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d) here", a).groups()
    for iban in (de, gb):
        plain = iban.replace(" ", "")
        assert mod97(plain[4:] + plain[:4]) == 1
    # The same account is linked however it is printed.
    assert de.replace(" ", "") == b
    assert re.fullmatch(r"am 20\d\d\.\d\d\.\d\d, \d\d-\d\d-20\d\d", c)
    days = re.fullmatch(r"(\d+) (\w+) (20\d\d), (\d+)\. (\w+) (20\d\d), (\d+) de (\w+) de (20\d\d)", d).groups()
    moved = {(int(days[k]), pii.OTHER_MONTHS[lang].index(days[k + 1]), days[k + 2]) for k, lang in ((0, "de"), (3, "fr"), (6, "es"))}
    assert len(moved) == 1
    assert re.fullmatch(r"\d+er [A-ZÉ]\w+ 19\d\d", f)


class Plain:
    """The pseudonyms of some kinds, and their search, once more without Spark."""

    def __init__(self, key):
        self.key = key

    def number(self, label, value):
        import hashlib
        import hmac

        return int(hashlib.sha256((hmac.new(self.key.encode(), label.encode(), hashlib.sha256).hexdigest() + str(value)).encode()).hexdigest()[:15], 16)

    def permuted(self, x, a, b, label):
        left, right = divmod(x, b)
        for r in range(6):
            if r % 2:
                right = (right + self.number(f"{label}{r}", left) % b) % b
            else:
                left = (left + self.number(f"{label}{r}", right) % a) % a
        return left * b + right

    def shifted(self, s, label):
        import hashlib
        import hmac
        import string

        parts = [s[: len(s) // 2], s[len(s) // 2 :]]
        for r in range(4):
            own, other = parts[r % 2], parts[1 - r % 2]
            stream = hashlib.sha512((hmac.new(self.key.encode(), f"{label}{r}".encode(), hashlib.sha256).hexdigest() + other).encode()).hexdigest()
            out = ""
            for i, c in enumerate(own):
                by = int(stream[2 * (i % 63) :][:3], 16)
                alphabet = next((x for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits) if c in x), None)
                out += alphabet[(alphabet.index(c) + by) % len(alphabet)] if alphabet else c
            parts[r % 2] = out
        return "".join(parts)

    def card(self, m):
        d = re.sub(r"\D", "", m)
        if not luhn(d):
            return m
        half = (len(d) - 2) // 2
        body = d[0] + str(self.permuted(int(d[1:-1]), 10**half, 10 ** (len(d) - 2 - half), "card")).zfill(len(d) - 2)
        digits = iter(with_check(body))
        return re.sub(r"\d", lambda _: next(digits), m)

    def ssn(self, m):
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        x = self.permuted((a - 1 - (a > 666)) * 99 * 9999 + (g - 1) * 9999 + s - 1, 898 * 99, 9999, "ssn")
        a = x // (99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"

    def ip(self, m):
        o = list(map(int, m.split(".")))
        if not (0 < o[0] < 224 and max(o) < 256):
            return m
        x = self.permuted(((o[0] - 1) << 24) + (o[1] << 16) + (o[2] << 8) + o[3], 223 * 256, 65536, "ip")
        return ".".join(map(str, ((x >> 24) + 1, x >> 16 & 255, x >> 8 & 255, x & 255)))

    def day(self, m):
        try:
            d = datetime.date(*map(int, m.split("-")))
        except ValueError:
            return m
        start = datetime.date(d.year // 100 * 100, 1, 1)
        sides = (75, 487) if d.year // 100 % 4 == 0 else (92, 397)
        return (start + datetime.timedelta(self.permuted((d - start).days, *sides, "date"))).isoformat()

    def iban(self, m):
        if mod97(m[4:] + m[:4]) != 1:
            return m
        body = self.shifted(m[4:], "iban")
        return f"{m[:2]}{98 - mod97(body + m[:2] + '00'):02d}{body}"

    def text(self, t):
        kinds = [(r"[\w.]+@[\w.-]+\.[a-z]+", lambda m: self.shifted(m.split("@")[0], "email") + "@" + m.split("@")[1]), (r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", self.iban), (r"\b(?:\d{13,19}|\d{4}(?: \d{4}){3})\b", self.card), (r"\b\d{3}-\d{2}-\d{4}\b", self.ssn), (r"\b\d{4}-\d\d-\d\d\b", self.day), (r"\b\d+\.\d+\.\d+\.\d+\b", self.ip)]
        n, out, at = 0, "", 0
        every = re.compile("|".join(f"({p})" for p, _ in kinds), re.A)
        for m in every.finditer(t):
            new = kinds[m.lastindex - 1][1](m[0])
            n, out, at = n + (new != m[0]), out + t[at : m.start()] + new, m.end()
        return out + t[at:], n


def test_as_by_a_second_search_and_replacement(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = [
        lambda: with_check("5" + digits(14)), lambda: "4" + digits(15), lambda: re.sub(r"(....)(?=.)", r"\1 ", with_check("4" + digits(14))), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"19{digits(2)}-{rng.randint(1, 14):02d}-{rng.randint(1, 31):02d}", lambda: f"20{digits(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: f"ab{digits(2)}.cd{digits(3)}@mail{digits(1)}.example.org", lambda: (lambda b: f"GB{98 - mod97(b + 'GB00'):02d}{b}")("WEST" + digits(14)), lambda: "DE" + digits(20), lambda: rng.choice(["word", "noté", "x1", "№", "—"]),
    ]
    texts = [" ; ".join(rng.choice(kinds)() for _ in range(rng.randint(0, 25))) for _ in range(120)]
    assert run(spark, texts, "another key") == [Plain("another key").text(t) for t in texts]
