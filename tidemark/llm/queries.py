"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, divergence, langid, licenses, neardup, packing, pii, quality, secret_scan, tokens, training_order, whitening
from tidemark.plans.registry import Registry
from tidemark.session import table

REGISTRY = Registry()
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Keys come from a secret store in production; these make the queries repeatable.
PII_KEY, ORDER_KEY = "pseudonym-key-1", "order-key-1"


@REGISTRY.add("op1_pii_pseudonyms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", "pii_values")


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, sum(s) AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS s FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM docs),
lw AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
norm AS (SELECT doc_id, source, n, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS k FROM lw),
hosts AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM docs GROUP BY source),
freq AS (SELECT source, k, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_id, max(n) AS n FROM norm GROUP BY source, k),
over_limit AS (SELECT f.source, f.k, f.first_id FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
         WHERE CASE WHEN f.n >= 5 THEN f.n_docs >= 5 AND (f.n_docs > 20 OR f.n_docs > 0.1 * h.host_docs) ELSE f.n_docs >= 10 AND f.n_docs > 0.3 * h.host_docs END),
gone AS (SELECT n.doc_id, sum(n.n) AS n FROM norm n JOIN over_limit o ON n.source IS NOT DISTINCT FROM o.source AND n.k = o.k AND n.doc_id <> o.first_id GROUP BY n.doc_id),
s AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
       CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM s
"""


@REGISTRY.add("op2_line_frequency", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, _ = quality.judge(table(spark, sf_dir, "documents"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@REGISTRY.add("op3_training_order")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(table(spark, sf_dir, "documents"), BYTE_BPE, ORDER_KEY)


@REGISTRY.add("op4_chat_windows")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(rows.unionByName(added), BYTE_BPE))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_item AS INTEGER) AS n_item, CAST(n_shared AS INTEGER) AS n_shared, n_shared / n_item AS containment
FROM s JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""


@REGISTRY.add("op5_containment_search", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.a, reach.r FROM l JOIN reach ON l.b = reach.doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c LEFT JOIN n USING (doc_id)
"""


@REGISTRY.add("op6_chosen_path", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@REGISTRY.add("op7_bin_completion")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


@REGISTRY.add("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents carry no paths: each source is made a tree of directories of a hundred ids. By a
    hash of its id, one document in eight is a licence file, half of them one directory higher."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mark = F.crc32(F.col("doc_id").cast("string"))
    name = F.when(mark % 8 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    leaf = F.when(mark % 16 != 0, F.floor(F.col("doc_id") / 100 % 100).cast("string"))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 10_000).cast("string"), leaf, name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


@REGISTRY.add("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


@REGISTRY.add("op10_nearest_centroid")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT x.lang, count(k.term) AS v, CAST(coalesce(sum(k.n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang FROM d) x LEFT JOIN kept k ON k.lang = x.lang GROUP BY x.lang),
g AS (SELECT x.lang, x.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v) AS p,
       1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
         UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@REGISTRY.add("op11_divergence_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@REGISTRY.add("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))
