"""Text functions as column expressions. Lengths count code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that end a line of text, and the entities that are decoded.
BLOCK_END = r"(?i)</(p|div|li|h[1-6]|blockquote|pre|tr)>"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}
HAN = r"[\x{4e00}-\x{9fff}]"
CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
#: Marks of a text that only points to the whole article.
TEASER_MARKS = [r"(?i)\bappeared first on\b", r"(?i)\bread (the )?full (story|article)\b", r"(?i)\bcontinue reading\b", r"(?i)\bread more\b", r"…\s*$", r"\[\s*(…|\.\.\.)\s*\]\s*$"]
#: Names of parameters whose values are secrets.
SECRET_NAMES = "api[-_]?key|access[-_]?token|token|key|secret|password|passwd|pwd|signature|sign|auth|authorization|session(?:id)?"


def replaced(s: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda out, p: F.regexp_replace(out, p[0], p[1]), pairs, s)


def count_matches(s: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body reads it once an element."""
    # One parameter, whatever defaults body has: a second one would be given the index.
    return F.transform(F.array(value), lambda x: body(x))[0]


def collapse(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # A single blank is left as it is; only other white space, and blanks with more behind them, are replaced.
    return F.trim(F.regexp_replace(s, r" \s+|[^\S ]\s*", " "))


def truncate(s: Column, most: int, ellipsis: str = "…") -> Column:
    cut = F.concat(F.rtrim(F.substring(s, 1, max(0, most - len(ellipsis)))), F.lit(ellipsis))
    return F.when(F.length(s) > most, cut).otherwise(s)


def strip_tags(html: Column) -> Column:
    """Text of simple HTML: no scripts or styles, entities decoded, white space collapsed."""
    bare = replaced(html, (r"(?is)<(script|style|noscript).*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (BLOCK_END, "\n"), (r"<[^>]+>", " "))
    return collapse(reduce(lambda s, e: F.replace(s, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), bare))


def escape_html(s: Column) -> Column:
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], s)


def escape_xml(s: Column) -> Column:
    """Escaped for XML 1.0, without the control characters it forbids."""
    return F.regexp_replace(F.replace(escape_html(s), F.lit("'"), F.lit("&apos;")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def cdata(s: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(s, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def cjk_ratio(s: Column) -> Column:
    """Share of CJK characters among letters; 0 without letters."""
    letters = count_matches(s, r"\p{L}")
    return F.when(letters == 0, 0.0).otherwise(count_matches(s, CJK) / letters)


def guess_language(s: Column) -> Column:
    return F.when(cjk_ratio(s) > 0.3, "zh").when(s.rlike("(?i)[a-z]"), "en").otherwise("other")


def looks_zh(s: Column) -> Column:
    """Han characters, and neither kana nor Hangul."""
    return s.rlike(HAN) & ~s.rlike(r"[\x{3040}-\x{30ff}]") & ~s.rlike(r"[\x{ac00}-\x{d7af}]")


def han_density(s: Column) -> Column:
    total = F.length(F.regexp_replace(s, r"\s+", ""))
    return F.when(total == 0, 0.0).otherwise(count_matches(s, HAN) / total)


def is_short_post(s: Column) -> Column:
    """Under 100 characters of mostly Han text, under 500 of other text; an empty one is not short."""
    return (F.length(s) > 0) & (F.length(s) < F.when(count_matches(s, HAN) > 0.3 * F.length(s), 100).otherwise(500))


#: The signs that names and words of other scripts are written with here.
NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
INNER = "0123456789+.#/-"


def led_by(s: Column, chars: str) -> Column:
    """How many characters s begins with that are all among chars."""
    return F.length(s) - F.length(F.ltrim(s, F.lit(chars)))


def plain_words(s: Column) -> Column:
    """The words between blanks, cut before a link, with names behind @ and # taken out."""
    upto = lambda w, mark: F.when(F.instr(w, mark) > 0, F.substring_index(w, mark, 1)).otherwise(w)
    bare = F.transform(F.split(s, r"\s+"), lambda w: upto(upto(w, "https://"), "http://"))
    for mark in "@#":

        def unnamed(w: Column) -> Column:
            parts = F.split(w, mark)  # noqa: B023
            return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(led_by(p, NAME) > 0, F.concat(F.lit(" "), F.ltrim(p, F.lit(NAME)))).otherwise(F.concat(F.lit(mark), p))), "")  # noqa: B023

        bare = F.transform(bare, unnamed)
    return bare


def longest_foreign_run(s: Column) -> Column:
    """The most letters and signs that two or more Latin words one after another have together."""
    tokens = F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9+.#/-]+|\s+|[^A-Za-z0-9+.#/\s-]+"), F.lit(0))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("size"), F.lit(False).alias("apart"), F.lit(0).alias("best"))

    def step(run: Column, t: Column) -> Column:
        # A word that does not begin with a letter begins a run where its letters do.
        word = F.ltrim(t, F.lit(INNER))
        latin, blank = word.between("A", "z~") & t.rlike("^[ -~]+$"), F.trim(F.regexp_replace(t, r"\s", "")) == ""
        joins = run["apart"] & (run["words"] > 0) & (word == t)
        words, size = F.when(joins, run["words"] + 1).otherwise(1), F.when(joins, run["size"]).otherwise(0) + F.length(word)
        grown = F.struct(words.alias("words"), size.alias("size"), F.lit(False).alias("apart"), F.greatest(run["best"], F.when(words > 1, size).otherwise(0)).alias("best"))
        waiting = F.struct(run["words"].alias("words"), run["size"].alias("size"), F.lit(True).alias("apart"), run["best"].alias("best"))
        ended = F.struct(F.lit(0).alias("words"), F.lit(0).alias("size"), F.lit(False).alias("apart"), run["best"].alias("best"))
        return F.when(blank, waiting).when(latin, grown).otherwise(ended)

    return F.aggregate(tokens, none, step, lambda run: run["best"])


def needs_translation(s: Column) -> Column:
    """Not Han text, or under 65 % Han, or with ten or more letters of foreign words in a row."""
    return let(F.array_join(plain_words(s), " "), lambda bare: ~looks_zh(bare) | (han_density(bare) < 0.65) | (longest_foreign_run(bare) >= 10))


def clean_article(s: Column) -> Column:
    """Article text without HTML, links and entities; at most one empty line in a row.

    Text is cut at tags; what stands in scripts and styles goes with them. Then each line is
    tidied by itself, and a line is dropped where it and the one before it are empty.
    """
    quiet = F.regexp_replace(s, r"(?is)<(?=(script|style))\1\b.*?</\1\s*>", " ")
    text = F.array_join(F.split(quiet, "<[^>]+>"), " ")
    words = F.array_join(F.transform(F.split(text, "(?i)(?=https?://)"), lambda part: F.when(F.lower(part).rlike("^https?://\\S"), F.concat(F.lit(" "), F.substr(part, F.length(F.regexp_extract(part, r"^\S+", 0)) + 1, F.length(part)))).otherwise(part)), "")
    decoded = reduce(lambda out, e: F.regexp_replace(out, f"(?i){e[0]}", e[1]), [e for e in ENTITIES.items() if e[0] != "&apos;"], words)
    lines = F.transform(F.split(decoded, "\n"), lambda line: F.trim(F.translate(F.regexp_replace(line, "[ \\t]+", " "), "\t", " ")))
    kept = lambda rows: F.filter(rows, lambda line, i: (line != "") | (F.get(rows, i - 1) != ""))
    return F.regexp_replace(F.array_join(let(lines, kept), "\n"), r"^\s+|\s+$", "")


def pieces(text: Column, ends: str) -> Column:
    """text cut behind each of the signs in ends; signs without text before them are left out."""
    return F.filter(F.split(text, f"(?<=[{ends}])"), lambda p: ~p.isin("", *ends))


def leading_pieces(text: Column, ends: str, chars: int) -> Column:
    """The pieces of text of which the first `chars` characters are made, the last one cut off there;
    all pieces where signs are left out among these, which more characters must stand in for."""
    head = pieces(F.substring(text, 1, chars), ends)
    whole = (F.length(text) <= chars) | (F.aggregate(head, F.lit(0), lambda n, p: n + F.length(p)) == chars)
    return F.when(whole, head).otherwise(pieces(text, ends))


def first_pieces(parts: Column, room: int, enough: int) -> Column:
    """Pieces from the first on, as many as fit into room, until they have `enough` characters."""
    # No piece is empty, so no more than these can fit.
    parts = F.slice(parts, 1, room + 1)
    sums = F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, p: n + F.length(p)))
    # The first piece that is one too many, or else all of them.
    over = F.array_position(F.transform(sums, lambda n: n > room), F.lit(True))
    reached = F.array_position(F.transform(sums, lambda n: n >= enough), F.lit(True))
    last = F.least(F.when(over > 0, over - 1).otherwise(F.size(parts)), F.when(reached > 0, reached).otherwise(F.size(parts)))
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(last.cast("int"), F.lit(0))), "")


def compact_summary(s: Column, most: int = 190) -> Column:
    """Whole sentences up to `most` characters, ending at 80 or more; else whole clauses; else all."""

    def of(text: Column) -> Column:
        sentences, clauses = let(leading_pieces(text, "。！？!?", most + 1), lambda p: first_pieces(p, most, 80)), let(leading_pieces(text, "，；：、,;:", most + 1), lambda p: first_pieces(p, most - 1, 80))
        ended = F.concat(F.regexp_replace(clauses, "[，；：、,;:]$", ""), F.lit("。"))
        return F.when(F.length(text) <= most, text).when(F.length(sentences) >= 50, F.trim(sentences)).when(F.length(clauses) >= 50, ended).otherwise(text)

    return let(F.array_join(F.split(F.trim(s), r"[^\S\n]*\n\s*"), " "), of)


def summary_length_ok(summary: Column, source: Column) -> Column:
    """50 to 200 characters in up to three sentences; 80 and two at least for a long source."""
    n = F.size(F.filter(pieces(F.trim(summary), "。！？!?"), lambda p: F.trim(F.translate(p, "。！？!?", "")) != ""))
    least = F.when(F.length(F.trim(source)) < 500, F.struct(F.lit(50).alias("chars"), F.lit(0).alias("sentences"))).otherwise(F.struct(F.lit(80).alias("chars"), F.lit(2).alias("sentences")))
    # A text that is no summary is not cut into sentences.
    return F.when(F.length(F.trim(summary)) > 200, False).otherwise((F.length(F.trim(summary)) >= least["chars"]) & n.between(least["sentences"], F.lit(3)))


def is_thin(excerpt: Column, metadata: str, least: int = 80) -> Column:
    """Hardly any text once feed metadata (a pattern) is gone."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(excerpt, F.lit("")), metadata, ""))) < least


def is_teaser(s: Column, below: int = 1200) -> Column:
    t = F.trim(s)
    return (F.length(t) < below) & reduce(lambda a, b: a | b, [t.rlike(m) for m in TEASER_MARKS])


#: What a text begins with that is a publication's record or box and no abstract.
NO_ABSTRACT = ["strengths and limitations of this study", "article title:", "publication date:", "author(s):"]


def abstract_issue(raw: Column, identified: bool = False) -> Column:
    """Why a text is no abstract: fragment, oversized, not_abstract, legacy_truncation, or null."""
    longest = max(map(len, NO_ABSTRACT))

    def headed(text: Column) -> Column:
        """The text behind the word abstract and its sign. Only the beginning is looked at."""
        size = reduce(lambda out, word: F.when(F.startswith(F.lower(F.substring(text, 1, len(word))), F.lit(word)), len(word)).otherwise(out), ["abstract", "摘要"], F.lit(0))
        tail = F.ltrim(F.substr(text, size + 1, F.length(text)))
        return F.when(size == 0, text).when(F.substring(tail, 1, 1).isin(*":：."), F.ltrim(F.substr(tail, F.lit(2), F.length(tail)))).otherwise(tail)

    def issue(body: Column) -> Column:
        # Blanks before colons go, so a beginning may take up to twice its characters.
        begins = F.replace(F.lower(F.substring(body, 1, 2 * longest)), F.lit(" :"), F.lit(":"))
        record = reduce(lambda a, b: a | b, [F.startswith(begins, F.lit(p)) for p in NO_ABSTRACT])
        size = F.length(body)
        checks = [(size < 200, "fragment"), (size > 6000, "oversized"), (record, "not_abstract"), (F.lit(not identified) & (F.length(F.trim(raw)) == 2000), "legacy_truncation")]
        return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in checks])

    return let(let(collapse(F.coalesce(raw, F.lit(""))), headed), issue)


def from_inverted_index(index: Column) -> Column:
    """The text of a map from words to their places."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    # Places differ, so the order of structs is theirs; sort_array compares without a lambda.
    return F.array_join(F.sort_array(entries).getField("w"), " ")


def inverted_index(words: Column) -> Column:
    """A map from each of the words to its places, from 0 on, in order. Nothing leaves the row."""

    def of(found: Column) -> Column:
        # Found words are sorted, so each one's places lie side by side, from one start to the next.
        starts = F.filter(F.sequence(F.lit(0), F.size(found)), lambda i: (i < F.size(found)) & ((i == 0) | (F.get(found, i)["w"] != F.get(found, i - 1)["w"])))
        lists = let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(found, i)["w"].alias("w"), F.slice(found, i + 1, F.coalesce(F.get(s, k + 1), F.size(found)) - i).getField("at").alias("at"))))
        return F.map_from_entries(lists)

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at")))), of)


def bigrams(s: Column, drop: str = r"\s+") -> Column:
    """The distinct pairs of neighbouring characters once `drop` is gone, in any order."""

    def of(rest: Column) -> Column:
        # Pairs from the first character on, and from the second; looking a pair up in the text would count from its start each time.
        pairs = lambda text: F.regexp_extract_all(text, F.lit("(?s).."), F.lit(0))
        return F.array_distinct(F.concat(pairs(rest), pairs(F.substr(rest, F.lit(2), F.length(rest)))))

    return let(F.regexp_replace(s, drop, ""), of)


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def title_bigrams(s: Column) -> Column:
    return bigrams(F.lower(s), r"[\p{P}\p{S}\s_]+")


def word_runs(s: Column, width: int = 3) -> Column:
    """Distinct runs of words, without headings and date lines; a Han character is a word."""
    line = r"(?m)^[^\S\n]*(?:#.*|\.\.\.|[\d\s/:.\-年月日]+)$"
    found = F.regexp_extract_all(F.lower(F.regexp_replace(s, line, "")), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]))
        return F.array_distinct(F.when(F.size(w) >= width, runs).otherwise(F.array().cast("array<string>")))

    return let(found, of)


def equal_but_for_loss(a: Column, b: Column) -> Column:
    """Equal where a replacement character on either side stands for any one character.

    Where only one side has them, and not many, what stands between them is compared as a whole;
    only texts that both have some are compared character by character.
    """
    once = lambda s: F.when(F.contains(s, F.lit("��")), F.regexp_replace(s, "�+", "�")).otherwise(s)
    tidy = lambda s: let(collapse(F.coalesce(s, F.lit(""))), once)

    def singly(x: Column, y: Column) -> Column:
        same = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p == q) | (p == "�") | (q == "�"))
        return F.forall(same, lambda p: p)

    def between(text: Column, marked: Column) -> Column:
        """Whether text has what stands between the marks, one character for each mark."""
        start = F.struct(text.alias("rest"), F.lit(True).alias("ok"))
        step = lambda a, p: F.when(a["ok"], F.struct(F.substr(a["rest"], F.length(p) + 2, F.length(a["rest"])).alias("rest"), F.startswith(a["rest"], p).alias("ok"))).otherwise(a)
        return F.aggregate(F.split(marked, "�", -1), start, step, lambda a: a["ok"])

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        few = lambda s: F.length(s) - F.length(F.replace(s, F.lit("�"), F.lit(""))) <= 64
        none = lambda s: ~F.contains(s, F.lit("�"))
        return F.when(F.length(x) != F.length(y), False).when(none(x) & none(y), x == y).when(none(x) & few(y), between(x, y)).when(none(y) & few(x), between(y, x)).otherwise(singly(x, y))

    return let(F.struct(tidy(a).alias("x"), tidy(b).alias("y")), of)


def normal_tags(raw: Column, synonyms: dict[str, str], allowed: list[str], categories: list[str], fallback: str, most: int = 6) -> Column:
    """Known tags once each, synonyms mapped, the category (or fallback) first, at most `most`."""
    mapping = F.create_map(*[F.lit(x) for p in synonyms.items() for x in p]) if synonyms else F.create_map(F.lit(""), F.lit(""))
    # Words that come again are dropped first; each of the others is tidied once.
    bare = lambda t: F.when(F.startswith(t, F.lit("#")), F.substr(t, F.lit(2), F.length(t))).otherwise(t)
    clean = F.transform(F.array_distinct(raw), lambda t: bare(F.trim(t)))
    known = F.filter(F.transform(clean, lambda t: F.coalesce(mapping[t], mapping[F.lower(t)], t)), lambda t: t.isin(allowed))

    def of(tags: Column) -> Column:
        first = F.coalesce(F.get(F.filter(tags, lambda t: t.isin(categories)), F.lit(0)), F.lit(fallback))
        return let(first, lambda own: F.slice(F.concat(F.array(own), F.filter(tags, lambda t: t != own)), 1, most))

    return let(F.array_distinct(known), of)


def display_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~F.startswith(t, F.lit("entity:")))


def search_text(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def reading_minutes(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 450 + 0.5))


def redact(s: Column) -> Column:
    """Error text without user info in links, values of secret parameters, bearer values and keys.

    Text is read as words between blanks. A word loses what it says before an @ in a link, is a
    key as a whole, or follows a scheme's name; within it, a value ends at the next sign that
    parts parameters, and is hidden where the name before it is that of a secret.
    """
    # Texts without any of what is hidden, as most are, are given back as they came.
    named = (F.contains(s, F.lit("=")) | F.contains(s, F.lit(":"))) & s.rlike(f"(?i)(?:{SECRET_NAMES})[\"']?\\s*[=:]")
    other = (F.contains(s, F.lit("://")) & F.contains(s, F.lit("@"))) | F.contains(s, F.lit("sk-")) | s.rlike("(?i)(?:bearer|basic)\\s")
    return F.when(~(named | other), s).otherwise(_redacted(s))


def _redacted(s: Column) -> Column:
    secret = lambda part: F.lower(F.regexp_extract(part, r"([A-Za-z_-]+)[\"']?\s*[=:]", 1)).rlike(f"^(?:{SECRET_NAMES})$")
    hidden = lambda part: F.regexp_replace(part, r"([=:]\s*[\"']?)[^\"']+", "$1[redacted]")
    # Each element is one parameter with the sign that ends it.
    parts = F.regexp_extract_all(s, F.lit(r"(?:[^?&;,#\s(){}]|(?<=:)\s+(?=[\"']))*[?&;,#\s(){}]?"), F.lit(0))
    out = F.array_join(F.transform(parts, lambda p: F.when(secret(p), let(F.regexp_extract(p, r"[?&;,#\s(){}]$", 0), lambda end: F.concat(hidden(F.regexp_replace(p, r"[?&;,#\s(){}]$", "")), end))).otherwise(p)), "")
    without = F.regexp_replace(out, "(?i)(?<=://)[^/@\\s]*@", "")
    words = F.regexp_extract_all(without, F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(let(words, lambda w: F.transform(w, lambda t, i: _without_key(_without_value(t, F.get(w, i - 2))))), "")


#: The characters of a value behind a scheme's name, and of a key.
VALUE, KEY = NAME + "-+=./~", NAME + "-"


def _without_value(word: Column, before: Column) -> Column:
    """word, its value hidden if the word before it ends with the name of a scheme."""
    scheme = F.lower(F.regexp_extract(F.coalesce(before, F.lit("")), "[A-Za-z0-9_]+$", 0)).isin("bearer", "basic")
    rest = F.ltrim(word, F.lit(VALUE))
    return F.when(scheme & (F.length(rest) < F.length(word)), F.concat(F.lit("[redacted]"), rest)).otherwise(word)


def _without_key(word: Column) -> Column:
    """word, with sk- and sixteen characters of a key or more behind it hidden."""
    joined = lambda before: F.coalesce(led_by(F.reverse(before), NAME) > 0, F.lit(False))
    parts = F.split(word, "sk-")

    def part(p: Column, i: Column) -> Column:
        key = (led_by(p, KEY) >= 16) & ~joined(F.get(parts, i - 1))
        return F.when(i == 0, p).when(key, F.concat(F.lit("sk-[redacted]"), F.ltrim(p, F.lit(KEY)))).otherwise(F.concat(F.lit("sk-"), p))

    return F.when(F.contains(word, F.lit("sk-")), F.array_join(F.transform(parts, part), "")).otherwise(word)


def model_slug(name: Column) -> Column:
    """Lower case, letters and digits apart, other characters as single hyphens inside."""
    return replaced(F.lower(name), (r"([a-z])(\d)", "$1-$2"), (r"(\d)([a-z])", "$1-$2"), ("[^a-z0-9]+", "-"), ("^-|-$", ""))


def focused_query(title: Column) -> Column:
    """A short Han query: without a leading label, column name or what follows a colon; 40 characters."""

    def unlabelled(t: Column) -> Column:
        closing = F.when(F.startswith(t, F.lit("【")), F.instr(t, "】")).when(F.startswith(t, F.lit("[")), F.instr(t, "]")).otherwise(0)
        return F.ltrim(F.substr(t, closing + 1, F.length(t)))

    def behind_column(t: Column) -> Column:
        parts = F.split(F.translate(t, "｜", "|"), "[|]", 2)
        narrow = (F.size(parts) == 2) & (F.length(F.regexp_replace(parts[0], r"\s", "")) <= 12)
        return F.when(narrow, F.trim(F.get(parts, F.lit(1)))).otherwise(t)

    def before_colon(t: Column) -> Column:
        head = F.trim(F.substring_index(F.translate(t, "：", ":"), ":", 1))
        return F.when((F.length(head) >= 6) & (F.length(head) < F.length(F.trim(t))), head).otherwise(F.trim(t))

    query = let(let(let(F.trim(title), unlabelled), behind_column), lambda t: F.substring(before_colon(t), 1, 40))
    return let(query, lambda q: F.when(~title.rlike(r"\p{IsHan}") | (F.length(q) < 4), title).otherwise(q))


def outline(html: Column) -> Column:
    """level, id and text of the headings h2 to h4 that have an id."""
    pattern = r"""(?is)<h([2-4])[^>]*\bid="([^"]+)"[^>]*>(.*?)</h\1>"""
    part = lambda k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("level"), part(2).alias("id"), part(3).alias("text"))
    return F.transform(zipped, lambda h: F.struct(h["level"].cast("int").alias("level"), h["id"].alias("id"), strip_tags(h["text"]).alias("text")))


def mask_email(s: Column) -> Column:
    """First character, stars and the domain of a valid address; null otherwise."""
    address = F.lower(F.trim(s))
    valid = address.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(address) <= 254)
    return F.when(valid, F.concat(F.substring(address, 1, 1), F.lit("***@"), F.substring_index(address, "@", -1)))


def csv_cell(s: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(s.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def lead_item(rows: DataFrame, report: str, item: str, title: Column, headline: Column, least: float = 0.5) -> DataFrame:
    """report, lead: the item whose title shares most bigrams with the headline, `least` of the
    shorter at least; the smaller item where two share as much."""
    share = containment(bigrams(title), bigrams(headline))
    scored = rows.select(report, item, share.alias("_s")).where(F.col("_s") >= least)
    return scored.groupBy(report).agg((-F.max(F.struct("_s", (-F.col(item)).alias("_i")))["_i"]).alias("lead"))
