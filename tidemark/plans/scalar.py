"""Filters and scalar functions over documents, pages, events and parts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import math as M
from tidemark.functions import text as T
from tidemark.functions import url as U
from tidemark.plans.registry import Registry
from tidemark.session import checkpointed
from tidemark.plans.relational import load

REGISTRY = Registry()
add = REGISTRY.add
TAGS = {"the": "topic:article", "of": "topic:genitive", "de": "topic:genitive", "and": "topic:and"}
ALLOWED = ["topic:article", "topic:genitive", "topic:and", "cat:en", "cat:fr"]


@add("t01_collapse_truncate", r"""SELECT doc_id, CASE WHEN length(c) > 80 THEN rtrim(left(c, 79)) || '…' ELSE c END AS short FROM
(SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)""")
def t01(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", T.truncate(T.collapse(F.col("text")), 80).alias("short"))


@add("t03_strip_tags", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<noscript.*?</noscript>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|blockquote|pre|tr)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '\s+', ' ', 'g'))) AS text_md5 FROM pages""")
def t03(spark, d):
    (pages,) = load(spark, d, "pages")
    return pages.select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


@add("t04_escape", r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml_md5,
md5('<![CDATA[' || replace(text, ']]>', ']]]]><![CDATA[>') || ']]>') AS cdata_md5 FROM documents""")
def t04(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.escape_xml(F.col("text"))).alias("xml_md5"), F.md5(T.cdata(F.col("text"))).alias("cdata_md5"))


@add("t05_language_guess", r"""SELECT doc_id, CASE WHEN l = 0 THEN 0.0 ELSE round(c / l, 9) END AS cjk, CASE WHEN l > 0 AND c / l > 0.3 THEN 'zh' WHEN regexp_matches(text, '(?i)[a-z]') THEN 'en' ELSE 'other' END AS guess FROM
(SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS l, length(regexp_replace(text, '[^\x{3400}-\x{9fff}\x{f900}-\x{faff}]+', '', 'g')) AS c FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat('语言', 200) ELSE '' END AS text FROM documents))""")
def t05(spark, d):
    (docs,) = load(spark, d, "documents")
    s = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("语言"), 200)).otherwise(""))
    return docs.select("doc_id", s.alias("s")).select("doc_id", F.round(T.cjk_ratio(F.col("s")), 9).alias("cjk"), T.guess_language(F.col("s")).alias("guess"))


MIXED = "CASE doc_id % 4 WHEN 0 THEN '模型 发布 了' || text WHEN 1 THEN '研究者说这是一个新的结果' WHEN 2 THEN 'テスト新' ELSE text END"


@add("t06_short_posts", rf"""SELECT doc_id, regexp_matches(s, '[\x{{4e00}}-\x{{9fff}}]') AND NOT regexp_matches(s, '[\x{{3040}}-\x{{30ff}}]') AND NOT regexp_matches(s, '[\x{{ac00}}-\x{{d7af}}]') AS zh,
CASE WHEN n = 0 THEN 0.0 ELSE round(h / n, 9) END AS density, length(s) > 0 AND length(s) < CASE WHEN h > 0.3 * length(s) THEN 100 ELSE 500 END AS short FROM
(SELECT *, length(regexp_replace(s, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g')) AS h, length(regexp_replace(s, '\s+', '', 'g')) AS n FROM (SELECT doc_id, {MIXED} AS s FROM documents))""")
def t06(spark, d):
    (docs,) = load(spark, d, "documents")
    s = F.col("s")
    return docs.select("doc_id", F.expr(MIXED).alias("s")).select("doc_id", T.looks_zh(s).alias("zh"), F.round(T.han_density(s), 9).alias("density"), T.is_short_post(s).alias("short"))


@add("t07_needs_translation", rf"""SELECT doc_id, NOT (regexp_matches(b, '[\x{{4e00}}-\x{{9fff}}]') AND NOT regexp_matches(b, '[\x{{3040}}-\x{{30ff}}]') AND NOT regexp_matches(b, '[\x{{ac00}}-\x{{d7af}}]'))
OR length(regexp_replace(b, '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g')) / greatest(length(regexp_replace(b, '\s+', '', 'g')), 1) < 0.65
OR len(list_filter(regexp_extract_all(b, '[A-Za-z][A-Za-z0-9+.#/-]*(?:\s+[A-Za-z][A-Za-z0-9+.#/-]*)+'), lambda r: length(regexp_replace(r, '\s+', '', 'g')) >= 10)) > 0 AS needs FROM
(SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s, 'https?://\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '#[A-Za-z0-9_]+', ' ', 'g') AS b FROM (SELECT doc_id, {MIXED} AS s FROM documents))""")
def t07(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", F.expr(MIXED).alias("s")).select("doc_id", T.needs_translation(F.col("s")).alias("needs"))


@add("t08_clean_article", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM
(SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)https?://\S+', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS t FROM pages)""")
def t08(spark, d):
    (pages,) = load(spark, d, "pages")
    return pages.select("page_id", F.md5(T.clean_article(F.col("html"))).alias("clean_md5"))


@add("t09_compact_summary")
def t09(spark, d):
    (docs,) = load(spark, d, "documents")
    s = F.replace("text", F.lit("."), F.lit("。"))
    rows = docs.select("doc_id", "text", T.compact_summary(s).alias("summary"))
    return rows.select("doc_id", "summary", T.summary_length_ok(F.col("summary"), F.col("text")).alias("length_ok"))


@add("t11_thin_teaser", r"""SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '#[A-Za-z]+', '', 'g'))) < 80 AS thin, length(trim(s)) < 1200 AND regexp_matches(trim(s), '(?i)\bread more\b|…\s*$|(?i)\bcontinue reading\b') AS teaser FROM
(SELECT *, text || CASE doc_id % 3 WHEN 0 THEN ' Read more' WHEN 1 THEN '…' ELSE '' END AS s FROM documents)""")
def t11(spark, d):
    (docs,) = load(spark, d, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, " Read more").when(F.col("doc_id") % 3 == 1, "…").otherwise("")
    return docs.select("doc_id", T.is_thin(F.col("text"), "#[A-Za-z]+").alias("thin"), T.is_teaser(F.concat("text", tail)).alias("teaser"))


@add("t15_abstract_quality", r"""SELECT doc_id, CASE WHEN length(t) < 200 THEN 'fragment' WHEN length(t) > 6000 THEN 'oversized' WHEN regexp_matches(t, '(?i)^(Article title\s*:|Publication date\s*:|Author\(s\)\s*:)') THEN 'not_abstract' WHEN length(trim(text)) = 2000 THEN 'legacy_truncation' END AS issue FROM
(SELECT doc_id, text, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '(?i)^(?:abstract|摘要)\s*[:：.]?\s*', '') AS t FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Author(s): ' || text WHEN doc_id % 5 = 0 THEN rpad('Long abstract ', 2000, 'words ') ELSE text END AS text FROM documents))""")
def t15(spark, d):
    (docs,) = load(spark, d, "documents")
    s = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Author(s): "), "text")).when(F.col("doc_id") % 5 == 0, F.rpad(F.lit("Long abstract "), 2000, "words ")).otherwise(F.col("text"))
    return docs.select("doc_id", T.abstract_issue(s).alias("issue"))


@add("t16_inverted_index", r"""SELECT doc_id, md5(replace(text, chr(10), ' ')) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def t16(spark, d):
    (docs,) = load(spark, d, "documents")
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)
    index = docs.where("text is not null").select("doc_id", T.inverted_index(words).alias("index"))
    return index.select("doc_id", F.md5(T.from_inverted_index(F.col("index"))).alias("text_md5"))


@add("t18_bigram_containment", r"""WITH h AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS s FROM documents),
g AS (SELECT DISTINCT doc_id, s[i:i+1] AS p FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM h)), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT a.doc_id AS a, a.doc_id + 1 AS b, round(coalesce(s.n, 0) / least(a.n, b.n), 9) AS share FROM n a JOIN n b ON b.doc_id = a.doc_id + 1
LEFT JOIN (SELECT x.doc_id, count(*) AS n FROM g x JOIN g y ON y.doc_id = x.doc_id + 1 AND x.p = y.p GROUP BY 1) s ON s.doc_id = a.doc_id""")
def t18(spark, d):
    (docs,) = load(spark, d, "documents")
    # Both sides of the join read the same sets, so they are worked out once and kept.
    g = checkpointed(docs.where("text is not null").select("doc_id", T.bigrams(F.col("text")).alias("g")))
    nxt = g.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return g.join(nxt, "doc_id").where((F.size("g") > 0) & (F.size("h") > 0)).select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.round(T.containment(F.col("g"), F.col("h")), 9).alias("share"))


@add("t19_title_dice", r"""WITH h AS (SELECT doc_id, regexp_replace(lower(left(text, 60)), '[\p{P}\p{S}\s_]+', '', 'g') AS s FROM documents),
g AS (SELECT DISTINCT doc_id, s[i:i+1] AS p FROM (SELECT doc_id, s, unnest(range(1, length(s))) AS i FROM h)), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT a.doc_id AS a, round(2 * coalesce(s.n, 0) / (a.n + b.n), 9) AS dice FROM n a JOIN n b ON b.doc_id = a.doc_id + 2
LEFT JOIN (SELECT x.doc_id, count(*) AS n FROM g x JOIN g y ON y.doc_id = x.doc_id + 2 AND x.p = y.p GROUP BY 1) s ON s.doc_id = a.doc_id""")
def t19(spark, d):
    (docs,) = load(spark, d, "documents")
    g = docs.select("doc_id", T.title_bigrams(F.substring("text", 1, 60)).alias("g")).where(F.size("g") > 0)
    nxt = g.select((F.col("doc_id") - 2).alias("doc_id"), F.col("g").alias("h"))
    return g.join(nxt, "doc_id").select(F.col("doc_id").alias("a"), F.round(T.dice(F.col("g"), F.col("h")), 9).alias("dice"))


@add("t20_word_runs", r"""SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS BIGINT) AS n_runs FROM
(SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
def t20(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", F.size(T.word_runs(F.col("text"))).cast("long").alias("n_runs"))


@add("t22_loss_tolerant", r"""SELECT doc_id, length(c) > 0 AS same, false AS other FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) WHERE length(c) > 12""")
def t22(spark, d):
    (docs,) = load(spark, d, "documents")
    # Each step's texts are worked out once and read by the next.
    s = F.col("s")
    lossy = F.concat(F.substring(s, 1, 4), F.lit("��"), F.substr(s, F.lit(6), F.length(s)))
    wrong = F.concat(F.substring(s, 1, 9), F.lit("☃"), F.substr(s, F.lit(11), F.length(s)))
    rows = docs.select("doc_id", T.collapse(F.col("text")).alias("s")).where(F.length("s") > 12)
    return rows.select("doc_id", T.equal_but_for_loss(s, lossy).alias("same"), T.equal_but_for_loss(s, wrong).alias("other"))


@add("t23_tags", r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '[^\s]+') AS w FROM documents),
m AS (SELECT doc_id, lang, list_distinct(list_filter(list_transform(w, lambda t: CASE lower(t) WHEN 'the' THEN 'topic:article' WHEN 'of' THEN 'topic:genitive' WHEN 'de' THEN 'topic:genitive' WHEN 'and' THEN 'topic:and' ELSE t END), lambda t: t IN ('topic:article', 'topic:genitive', 'topic:and', 'cat:en', 'cat:fr'))) AS t FROM w)
SELECT doc_id, CAST(1 + len(t) AS BIGINT) AS n_tags, 'cat:fr' AS first_tag FROM m""")
def t23(spark, d):
    (docs,) = load(spark, d, "documents")
    raw = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    # Worked out in a step of their own, once for both columns.
    rows = docs.select("doc_id", T.normal_tags(raw, TAGS, ALLOWED, ["cat:en", "cat:fr"], "cat:fr").alias("tags"))
    return rows.select("doc_id", F.size("tags").cast("long").alias("n_tags"), F.col("tags")[0].alias("first_tag"))


@add("t25_search_text_minutes", r"""SELECT doc_id, md5(lower(concat_ws(' ', source, lang, left(text, 100)))) AS search_md5, CAST(greatest(1, floor(n_chars / 450 + 0.5)) AS BIGINT) AS minutes FROM documents""")
def t25(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.search_text(F.col("source"), F.col("lang"), F.substring("text", 1, 100))).alias("search_md5"), T.reading_minutes(F.col("n_chars")).alias("minutes"))


@add("t28_redact", r"""SELECT doc_id, CAST(n AS BIGINT) AS n_secrets FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)(^|[?&;,\s])(password|token|secret|api_key)=[^&#\s]+')) AS n FROM documents)""")
def t28(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", T.count_matches(T.redact(F.col("text")), r"=\[redacted\]").cast("long").alias("n_secrets"))


@add("t29_model_slug", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' v' || p_size), '([a-z])(\d)', '\1-\2', 'g'), '(\d)([a-z])', '\1-\2', 'g'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""")
def t29(spark, d):
    (p,) = load(spark, d, "part")
    return p.select("p_partkey", T.model_slug(F.concat("p_brand", F.lit(" v"), F.col("p_size").cast("string"))).alias("slug"))


@add("t31_focused_query")
def t31(spark, d):
    (docs,) = load(spark, d, "documents")
    title = F.concat(F.lit("【快讯】专栏 | 新模型发布的背景与影响："), F.substring("text", 1, 30))
    return docs.select("doc_id", T.focused_query(F.when(F.col("doc_id") % 2 == 0, title).otherwise(F.substring("text", 1, 30))).alias("query"))


@add("t34_outline", r"""SELECT page_id, CAST(len(regexp_extract_all(h, '(?is)<h[2-4][^>]*id="[^"]+"[^>]*>.*?</h[2-4]>')) AS BIGINT) AS n_headings, 'Part ' || page_id AS first_text FROM
(SELECT page_id, '<h2 id="a">Part <b>' || page_id || '</b></h2><p>x</p><h3 class="q" id="b">Next</h3><h5 id="c">no</h5>' || html AS h FROM pages)""")
def t34(spark, d):
    (pages,) = load(spark, d, "pages")
    h = F.concat(F.lit('<h2 id="a">Part <b>'), F.col("page_id").cast("string"), F.lit('</b></h2><p>x</p><h3 class="q" id="b">Next</h3><h5 id="c">no</h5>'), "html")
    found = T.outline(h)
    return pages.select("page_id", F.size(found).cast("long").alias("n_headings"), found[0]["text"].alias("first_text"))


@add("t36_mask_email", r"""SELECT doc_id, CASE WHEN regexp_matches(e, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN left(e, 1) || '***@' || split_part(e, '@', -1) END AS masked FROM
(SELECT doc_id, lower(trim(regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]*[a-z]'))) AS e FROM documents)""")
def t36(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", T.mask_email(F.regexp_extract("text", "[A-Za-z0-9._]+@[A-Za-z0-9.]*[a-z]", 0)).alias("masked"))


@add("k09_csv_guard", r"""SELECT doc_id, CASE WHEN regexp_matches(s, '^[=+@\-\t\r]') THEN '''' || s ELSE s END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '=' ELSE '' END || left(text, 20) AS s FROM documents)""")
def k09(spark, d):
    (docs,) = load(spark, d, "documents")
    s = F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise(""), F.substring("text", 1, 20))
    return docs.select("doc_id", T.csv_cell(s).alias("cell"))


# URLs, identity, hashes


@add("i01_normalise_url", r"""WITH p AS (SELECT page_id, trim(url) AS u FROM pages),
q AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, regexp_extract(u, '\?([^#]*)', 1) AS query FROM p)
SELECT page_id, 'https://' || host || CASE path WHEN '' THEN '/' ELSE path END || CASE len(k) WHEN 0 THEN '' ELSE '?' || array_to_string(list_sort(k), '&') END AS url FROM
(SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i)^(utm_[a-z]+|from|ref|source|spm)$')) AS k FROM q)""")
def i01(spark, d):
    (pages,) = load(spark, d, "pages")
    return pages.select("page_id", U.normalise(F.col("url")).alias("url"))


@add("i02_identity_groups", r"""WITH q AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT 'url:https://' || host || CASE path WHEN '' THEN '/' ELSE path END AS identity, min(page_id) AS survivor, count(*) AS n FROM q GROUP BY 1""")
def i02(spark, d):
    (pages,) = load(spark, d, "pages")
    bare = U.identity_key(F.regexp_replace("url", r"\?[^#]*", ""))
    return pages.groupBy(bare.alias("identity")).agg(F.min("page_id").alias("survivor"), F.count("*").alias("n"))


@add("i03_doi_posts", r"""SELECT doc_id, '10.1234/ab.' || doc_id AS doi, CAST(doc_id AS VARCHAR) AS post, 'x:' || doc_id AS identity FROM documents""")
def i03(spark, d):
    (docs,) = load(spark, d, "documents")
    n = F.col("doc_id").cast("string")
    link = F.concat(F.lit("https://doi.org/10.1234%2FAB."), n, F.lit(".?x=1"))
    post = F.concat(F.lit("https://mobile.twitter.com/someone/status/"), n, F.lit("/photo/1"))
    return docs.select("doc_id", U.doi(link).alias("doi"), U.post_id(post).alias("post"), U.identity_key(post).alias("identity"))


@add("i05_sites", r"""SELECT page_id, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS site, 'web:' || array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS participant FROM
(SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS h FROM pages)""")
def i05(spark, d):
    (pages,) = load(spark, d, "pages")
    return pages.select("page_id", U.site(F.col("url")).alias("site"), U.participant(F.col("url")).alias("participant"))


@add("i06_participant", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'group' END, CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id END, source) AS participant FROM documents")
def i06(spark, d):
    (docs,) = load(spark, d, "documents")
    key = U.participant_key(F.when(F.col("doc_id") % 5 == 0, "group"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"))), F.col("source"))
    return docs.select("doc_id", key.alias("participant"))


@add("i07_content_hash", r"""SELECT doc_id, sha256(source || chr(1) || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) || chr(1)) AS content_hash FROM documents""")
def i07(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", U.content_hash(F.col("source"), F.col("text"), F.lit("")).alias("content_hash"))


@add("i08_stable_hash", r"""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation""")
def i08(spark, d):
    (n,) = load(spark, d, "nation")
    return n.select("n_nationkey", U.stable_hash("n_regionkey", "n_nationkey", "n_name").alias("h"))


@add("i09_holdout", r"""SELECT doc_id, (CASE WHEN n >= 2147483648 THEN n - 4294967296 ELSE n END) % 5 = 0 AS held_out FROM (SELECT doc_id, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS n FROM documents)""")
def i09(spark, d):
    (docs,) = load(spark, d, "documents")
    return docs.select("doc_id", U.held_out(F.col("doc_id").cast("string")).alias("held_out"))


@add("i10_survivors", r"""SELECT DISTINCT ON (md5(text)) md5(text) AS identity, doc_id AS survivor, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents ORDER BY md5(text), n_chars DESC, doc_id""")
def i10(spark, d):
    (docs,) = load(spark, d, "documents")
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), "doc_id"))["doc_id"]
    return docs.groupBy(F.md5("text").alias("identity")).agg(best.alias("survivor"), F.count("*").alias("n"))


@add("f15_url_rules", r"""SELECT page_id, starts_with(regexp_replace(url, '(?i)^http://', 'https://'), 'https://t') AND NOT starts_with(regexp_replace(url, '(?i)^http://', 'https://'), 'https://th') AS allowed, CASE WHEN starts_with(url, 'https://m.') THEN 'https://www.' || substr(url, 11) ELSE url END AS rewritten FROM pages""")
def f15(spark, d):
    (pages,) = load(spark, d, "pages")
    return pages.select("page_id", U.allowed(F.col("url"), ["http://t"], ["https://th"]).alias("allowed"), U.rewrite_prefix(F.col("url"), "https://m.", "https://www.").alias("rewritten"))


@add("f16_navigation_links", r"""SELECT page_id, regexp_matches(path, '(?i)/(label|labels|tag|tags|category|categories|author|authors|page)(/|$)') OR regexp_matches(path, '/(19|20)\d{2}(/\d{1,2})?/?$') OR regexp_matches(path, '(?i)/(login|signin|sign-in|signup|sign-up|register)(/|\.|$)') AS navigation FROM
(SELECT page_id, regexp_extract(CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '/fr/|/en/', '/tag/') WHEN 1 THEN regexp_extract(url, '^https?://[^/]+') || '/2024/05' ELSE url END, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def f16(spark, d):
    (pages,) = load(spark, d, "pages")
    url = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "/fr/|/en/", "/tag/")).when(F.col("page_id") % 4 == 1, F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("/2024/05"))).otherwise(F.col("url"))
    return pages.select("page_id", U.is_navigation(url).alias("navigation"))


@add("f22_private_addresses", r"""SELECT c_custkey, a IN (0, 10, 127) OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND (b IN (18, 19) OR b = 51 AND c = 100) OR a = 203 AND b = 0 AND c = 113 AS private FROM
(SELECT c_custkey, c_custkey % 256 AS a, c_custkey * 7 % 256 AS b, c_custkey % 3 AS c FROM customer)""")
def f22(spark, d):
    (c,) = load(spark, d, "customer")
    k = F.col("c_custkey")
    ip = F.concat_ws(".", (k % 256).cast("string"), (k * 7 % 256).cast("string"), (k % 3).cast("string"), F.lit("9"))
    return c.select("c_custkey", U.private_address(ip).alias("private"))


@add("s05_url_template", r"""SELECT p_partkey, 'https://x.example/' || replace(replace(p_type, ' ', '%20'), '/', '/') || '?q=' || p_brand AS url FROM part""")
def s05(spark, d):
    (p,) = load(spark, d, "part")
    return p.select("p_partkey", U.template("https://x.example/{type}?q={raw:brand}", {"type": F.col("p_type"), "brand": F.col("p_brand")}).alias("url"))


# Dates


@add("d01_beijing", r"""SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS clock, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS iso, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR AS midnight FROM events""")
def d01(spark, d):
    (e,) = load(spark, d, "events")
    at = F.col("ts")
    return e.select("event_id", D.beijing_date(at).alias("day"), D.beijing_time(at).alias("clock"), D.beijing_iso(at).alias("iso"), D.beijing_midnight(D.beijing_date(at)).alias("midnight"))


@add("d02_iso_weeks", r"""SELECT o_orderkey, CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders""")
def d02(spark, d):
    (o,) = load(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return o.select("o_orderkey", D.iso_week(day).alias("week"), D.week_start(day).alias("monday"))


@add("d03_weekly_trunc", "SELECT date_trunc('week', ts + INTERVAL 8 HOUR) AS week, count(*) AS n FROM events GROUP BY 1")
def d03(spark, d):
    (e,) = load(spark, d, "events")
    return e.groupBy(F.date_trunc("week", D.beijing(F.col("ts"))).cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"))


@add("d04_weekly_series", "SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 7 DAY)) AS DATE) AS monday")
def d04(spark, d):
    return spark.range(1).select(F.explode(F.expr("sequence(DATE'2024-01-01', DATE'2024-02-05', INTERVAL 7 DAYS)")).alias("monday"))


@add("d05_loose_dates", r"""SELECT event_id, date_trunc('minute', ts) - INTERVAL 8 HOUR AS read_at FROM events WHERE event_id % 4 < 2 UNION ALL SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR FROM events WHERE event_id % 4 = 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3""")
def d05(spark, d):
    (e,) = load(spark, d, "events")
    k, form = F.col("event_id") % 4, lambda f: F.date_format("ts", f)
    text = F.when(k == 0, F.concat(F.lit("Posted "), form("yyyy/M/d HH:mm"))).when(k == 1, F.concat(form("yyyy"), F.lit("年"), form("M"), F.lit("月"), form("d"), F.lit("日 "), form("H:mm"))).when(k == 2, form("MMM d, yyyy")).otherwise(form("MM-dd"))
    return e.select("event_id", D.loose_date(text).alias("read_at"))


@add("d06_relative_dates", r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN ts - INTERVAL 3 HOUR WHEN 1 THEN ts - INTERVAL 20 MINUTE WHEN 2 THEN date_trunc('day', ts - INTERVAL 1 DAY + INTERVAL 8 HOUR) - INTERVAL 8 HOUR WHEN 3 THEN date_trunc('day', ts - INTERVAL 2 DAY + INTERVAL 8 HOUR) - INTERVAL 8 HOUR + INTERVAL 946 MINUTE END AS read_at FROM events""")
def d06(spark, d):
    (e,) = load(spark, d, "events")
    k = F.col("event_id") % 5
    text = F.when(k == 0, "3 hours ago").when(k == 1, "栏目·20分钟前").when(k == 2, "昨天").when(k == 3, "前天 15:46").otherwise("two days ago")
    return e.select("event_id", D.relative_date(text, F.col("ts")).alias("read_at"))


@add("d08_pacific", r"""SELECT event_id, timezone('UTC', timezone('America/Los_Angeles', ts + INTERVAL 60 DAY)) AS utc FROM events""")
def d08(spark, d):
    (e,) = load(spark, d, "events")
    return e.select("event_id", D.pacific_to_utc(F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("utc"))


@add("d09_off_peak", r"""SELECT event_id, p AS peak, CASE WHEN p THEN date_trunc('hour', ts) + to_hours(CASE WHEN hour(b) < 12 THEN 12 - hour(b) ELSE 18 - hour(b) END) ELSE ts END AS off_peak FROM
(SELECT *, dayofweek(b) NOT IN (0, 6) AND hour(b) IN (9, 10, 11, 14, 15, 16, 17) AS p FROM (SELECT event_id, ts, ts + INTERVAL 8 HOUR AS b FROM events))""")
def d09(spark, d):
    (e,) = load(spark, d, "events")
    return e.select("event_id", D.is_peak(F.col("ts")).alias("peak"), D.next_off_peak(F.col("ts")).alias("off_peak"))


@add("d10_story_status", r"""SELECT event_type, user_id, CASE WHEN a < 86400 THEN 'active' WHEN a < 259200 THEN 'watching' ELSE 'settled' END AS status FROM (SELECT event_type, user_id, epoch((SELECT max(ts) FROM events) - max(ts)) AS a FROM events GROUP BY ALL)""")
def d10(spark, d):
    (e,) = load(spark, d, "events")
    last = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_type", "user_id", D.story_status(F.col("last"), F.col("now")).alias("status"))


@add("d11_slots", r"""SELECT event_id, date_trunc('hour', ts) AS hour, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS slot FROM events""")
def d11(spark, d):
    (e,) = load(spark, d, "events")
    return e.select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), D.slot(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("slot"))


@add("s07_crossref_dates", r"""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE make_date(year(o_orderdate), month(o_orderdate), CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE day(o_orderdate) END) END AS published FROM orders""")
def s07(spark, d):
    (o,) = load(spark, d, "orders")
    y, m, day = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    parts = F.when(F.col("o_orderkey") % 9 == 0, F.array(F.array(y, F.lit(2), F.lit(30)))).when(F.col("o_orderkey") % 2 == 0, F.array(F.array(y, m))).otherwise(F.array(F.array(y, m, day)))
    return o.select("o_orderkey", D.crossref_date(parts).alias("published"))


# Scores


@add("m01_cosine", r"""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m01(spark, d):
    (e,) = load(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return e.join(b, F.col("vec_id") == F.col("a")).select("a", "b", F.round(M.cosine(F.col("embedding"), F.col("v")), 6).alias("cosine"))


@add("m02_normal_cdf")
def m02(spark, d):
    (e,) = load(spark, d, "events")
    z = (F.col("value") - 50) / 20
    return e.select("event_id", F.round(M.normal_cdf(z), 9).alias("phi"), F.round(M.soft_support(z, F.lit(1.5)), 9).alias("support"))


@add("m04_logistic_index", r"""SELECT event_type, round(100 * avg(1 / (1 + exp(-(value - 50) / 10))), 6) AS idx FROM events GROUP BY 1""")
def m04(spark, d):
    (e,) = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(100 * F.avg(M.logistic((F.col("value") - 50) / 10)), 6).alias("idx"))


@add("m05_engagement", r"""SELECT event_id, round(least(2, 1 + log10(1 + greatest(value, 0) + 2 * coalesce(k, 0) + 3 * 5) / 4), 9) AS weight FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def m05(spark, d):
    (e,) = load(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", F.round(M.engagement_weight(F.col("value"), k, F.lit(5), F.lit(-3)), 9).alias("weight"))


@add("m06_display_scores", r"""SELECT p_partkey, floor(p_retailprice / 700 * 100 + 0.5) / 10 AS heat, CAST(floor((p_size % 16) / 15.0 * 100 + 0.5) AS BIGINT) AS dims, p_size % 4 + p_size % 3 + 1 + 3 * (p_size % 2) AS role FROM part""")
def m06(spark, d):
    (p,) = load(spark, d, "part")
    s = F.col("p_size")
    return p.select("p_partkey", M.heat_index(F.col("p_retailprice") / 700).alias("heat"), M.dims_display(s % 16 + 5).alias("dims"), M.role_score(s % 4, s % 3, F.lit(1), s % 2).alias("role"))


@add("m10_thresholds", r"""SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 65 ELSE CASE WHEN s_suppkey % 2 = 0 THEN 67 ELSE 76 END END AS INTEGER) AS threshold, s_acctbal + 100 >= 2 * 65 AS passes FROM supplier""")
def m10(spark, d):
    (s,) = load(spark, d, "supplier")
    k = F.col("s_suppkey")
    tier = F.when(k % 3 == 0, "T1").when(k % 3 == 1, "T1_5").otherwise("T2")
    return s.select("s_suppkey", M.threshold(tier, F.when(k % 2 == 0, "academic").otherwise("industry")).alias("threshold"), M.mean_passes(F.col("s_acctbal"), F.lit(100), F.lit(65)).alias("passes"))


@add("m11_adaptive_interval", r"""SELECT event_type, user_id, CAST(greatest(CASE WHEN n / 30.0 <= 0.15 THEN 1440 ELSE floor(greatest(30, least(1440, 1440 / (3 * n / 30.0))) + 0.5) END, 60) AS BIGINT) AS minutes FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)""")
def m11(spark, d):
    (e,) = load(spark, d, "events")
    per = e.groupBy("event_type", "user_id").agg((F.count("*") / 30.0).alias("per_day"))
    return per.select("event_type", "user_id", M.adaptive_interval(F.col("per_day"), 30, 1440, F.lit(60)).alias("minutes"))


@add("m12_backoff", r"""SELECT s_suppkey, least(360.0, 5.0 * pow(2.0, s_suppkey % 9)) AS wait, CAST('0x' || left(sha256(CAST(s_suppkey AS VARCHAR)), 8) AS BIGINT) % 60 AS jitter FROM supplier""")
def m12(spark, d):
    (s,) = load(spark, d, "supplier")
    return s.select("s_suppkey", M.backoff(F.col("s_suppkey") % 9 + 1, 5, 360).alias("wait"), M.jitter(F.col("s_suppkey").cast("string"), 60).alias("jitter"))


@add("m13_json_guard", r"""SELECT event_id, CASE WHEN json_type(json_extract(j, '$.n')) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(j, '$.n') AS DOUBLE) END AS n FROM
(SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"n": "12"}' WHEN 1 THEN '{"n": null}' ELSE '{"n": ' || event_id || '}' END AS j FROM events)""")
def m13(spark, d):
    (e,) = load(spark, d, "events")
    j = F.when(F.col("event_id") % 3 == 0, '{"n": "12"}').when(F.col("event_id") % 3 == 1, '{"n": null}').otherwise(F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit("}")))
    v = F.parse_json(j)
    number = F.schema_of_variant(F.variant_get(v, "$.n", "variant")).isin("BIGINT", "DOUBLE") | F.startswith(F.schema_of_variant(F.variant_get(v, "$.n", "variant")), F.lit("DECIMAL"))
    return e.select("event_id", F.when(number, F.try_variant_get(v, "$.n", "double")).alias("n"))


@add("m14_struct_edits", r"""SELECT n_nationkey, to_json({'name': n_name, 'region': n_regionkey + 100}) AS edited FROM nation""")
def m14(spark, d):
    (n,) = load(spark, d, "nation")
    row = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(1).alias("gone"))
    return n.select("n_nationkey", F.to_json(row.withField("region", row["region"] + 100).dropFields("gone")).alias("edited"))


@add("m15_nested_path", r"""SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1""")
def m15(spark, d):
    (o,) = load(spark, d, "orders")
    sections = o.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("o_orderkey").alias("items")).groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "items")).alias("sections"))
    items = F.flatten(F.transform("sections", lambda s: s["items"]))
    return sections.select("o_custkey", F.size(items).cast("long").alias("n_items"), F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@add("m16_arrays", r"""SELECT doc_id, CAST(list_position(w, 'the') AS BIGINT) AS first_the, CAST(len(w) AS BIGINT) AS n, list_slice(w, 1, 3)[1] AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""")
def m16(spark, d):
    (docs,) = load(spark, d, "documents")
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return docs.select("doc_id", F.nullif(F.array_position(w, "the").cast("long"), F.lit(0)).alias("first_the"), F.size(w).cast("long").alias("n"), F.get(F.slice(F.array_distinct(w), 1, 3), F.lit(0)).alias("head"))


@add("m17_null_functions", r"""SELECT c_custkey, greatest(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 100.0) AS g, least(CASE WHEN c_acctbal < 0 THEN c_acctbal END, 5.0) AS l, nullif(c_mktsegment, 'BUILDING') AS n FROM customer""")
def m17(spark, d):
    (c,) = load(spark, d, "customer")
    b = F.col("c_acctbal")
    return c.select("c_custkey", F.greatest(F.when(b > 0, b), F.lit(100.0)).alias("g"), F.least(F.when(b < 0, b), F.lit(5.0)).alias("l"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("n"))
