"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import chosen_path, decontaminate, discriminant, filter_audit, fuzzy_lines, layout_html, mixing, packing, ppm, repetition, source_audit, suffix_levels, webp_encode
from lintel.llm.common import read_table

_WORD = r"[^\x20\x09-\x0D]+"


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "base_failed", "kept")


def _covered_sql(k: int, name: str) -> str:
    """Words in k-word windows that occur twice or more in their text."""
    return f"""
win{k} AS (SELECT d, i, array_to_string(list_slice(ws, i, i + {k - 1}), ' ') AS g FROM w, unnest(range(1, len(ws) - {k - 2})) AS t(i) WHERE len(ws) >= {k}),
rep{k} AS (SELECT d, i FROM win{k} WHERE (d, g) IN (SELECT (d, g) FROM win{k} GROUP BY d, g HAVING count(*) > 1)),
{name} AS (SELECT d, count(DISTINCT i + o) AS n FROM rep{k}, unnest(range(0, {k})) AS u(o) GROUP BY d)"""


OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT d, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM docs),
{_covered_sql(3, "rw")},
{_covered_sql(8, "cw")},
{_covered_sql(51, "lw")},
ln AS (SELECT d, count(*) - count(DISTINCT l) AS n FROM (SELECT d, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '{_WORD}') GROUP BY d),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
 CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
 CAST(coalesce(cw.n, 0) AS BIGINT) AS n_covered_words, coalesce(lw.n, 0) AS n_long
 FROM w LEFT JOIN ln USING (d) LEFT JOIN rw USING (d) LEFT JOIN cw USING (d) LEFT JOIN lw USING (d))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 30 * n_words AND n_long = 0 AS kept
FROM s"""


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.drop("ids")


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return webp_encode.store_texts(docs, columns=["doc_id"]).select("doc_id", *[f"webp.{c}" for c in webp_encode.FIGURES.names])


def op4_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(3)) != 1
    out = discriminant.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), learn)
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op5_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_html.rendered(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_groups(read_table(spark, sf_dir, "documents"), runs=chosen_path.runs_for(0.995))


#: Domains by source, and the weights of the mixture. What the lists do not name goes by "other".
DOMAINS = {"web": range(0, 10), "reference": range(10, 15), "forum": range(15, 20)}
DOMAIN_WEIGHTS = {"web": 0.5, "reference": 0.25, "forum": 0.2, "other": 0.05}
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, "other": 0.05}
MIX_SEED = 20240


def mixture() -> dict:
    """Every domain has every language, and in it its sources by equal weights."""

    def sources(domain: str) -> dict:
        return {f"src{k}": (1.0, None) for k in DOMAINS.get(domain, ())} or {"other": (1.0, None)}

    return {d: (w, {lang: (v, sources(d)) for lang, v in LANGUAGE_WEIGHTS.items()}) for d, w in DOMAIN_WEIGHTS.items()}


def mixture_levels() -> list:
    """The columns domain, language and source of a document, with "other" for what is not named."""
    domain = F.lit("other")
    for name, numbers in DOMAINS.items():
        domain = F.when(F.col("source").isin([f"src{k}" for k in numbers]), name).otherwise(domain)
    named = F.col("source").isin([f"src{k}" for r in DOMAINS.values() for k in r])
    language = F.when(F.col("lang").isin([x for x in LANGUAGE_WEIGHTS if x != "other"]), F.col("lang")).otherwise("other")
    return [domain, language, F.when(named, F.col("source")).otherwise("other")]


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixture(), mixture_levels(), mixing.token_count(F.col("text")), share=0.8, epochs=2, seed=MIX_SEED)


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fuzzy_lines.without_near_lines(docs, n_lines="n_lines", n_removed="n_removed", min_words=1)


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("learn", _remainder(7) != 2)
    out = ppm.scores(docs, "learn")
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_levels.removed_spans(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.expr("CAST(size(spans) DIV 2 AS BIGINT)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The failure conditions of the audit's filters; E, repeated texts, is not one of a single document.
AUDIT_LETTERS = "ABCDE"


def audit_conditions(text: Column) -> dict[str, Column]:
    """Too short, too repetitive, too many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "C": 100 * capitals > 2 * F.length(text), "D": F.rlike(text, F.lit(r"[#$%&*|]"))}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), audit_conditions(text), F.col("source"), AUDIT_LETTERS[-1])


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(read_table(spark, sf_dir, "documents"))


def op13_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.flagged(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


#: All pairs of distinct shingles, and the transitive closure of the links.
OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM d, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS t(i)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM common JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 10 * c >= 8 * (p.n + q.n - c)),
reach(r, q) AS (SELECT r, r FROM d UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.q),
low AS (SELECT reach.r, min(o.doc_id) AS class_id FROM reach JOIN d o ON o.r = reach.q GROUP BY reach.r)
SELECT d.doc_id, low.class_id, coalesce(k.n, 0) AS n_links FROM d JOIN low USING (r) LEFT JOIN (SELECT x AS r, count(*) AS n FROM links GROUP BY x) k USING (r)"""

#: Every 50-byte window as hexadecimal digits.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM d, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS t(p) WHERE doc_id IS NOT NULL),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM w JOIN m USING (g) WHERE first < doc_id),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM c),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY r, k),
e AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM s UNION ALL SELECT d.r, length(h) // 2, NULL, coalesce((SELECT max(b) FROM s WHERE s.r = d.r), 0) FROM d),
x AS (SELECT e.r, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a, b NULLS LAST) AS kept, count(b) AS n_spans, coalesce(sum(b - a), 0) AS gone FROM e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN x USING (r)"""


#: Every document against every edge, then every order's steps.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
m AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(x, b)),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM l p JOIN l q ON q.b <> p.b JOIN l r ON r.b NOT IN (p.b, q.b) JOIN l s ON s.b NOT IN (p.b, q.b, r.b) JOIN l t ON t.b NOT IN (p.b, q.b, r.b, s.b)),
st AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bs[k] AS f, coalesce(list_sum(list_slice(bs, 1, k - 1)), 0)::INTEGER AS s FROM o, unnest(range(1, 6)) AS u(k)),
e AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN mask & (s | f) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
 CAST(sum(CASE WHEN mask & s = 0 AND mask & f <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN mask & s <> 0 AND mask & f <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
 CAST(sum(CASE WHEN mask = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN mask & s = 0 AND mask & f <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
 CAST(sum(CASE WHEN mask & s = 0 AND mask & f <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM c, st GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM e"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_13 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: Every group against every kept term of its language.
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '{_TERM}')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS lsize, count(*) OVER (PARTITION BY lang, source) AS v FROM m),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (size + 5 * v) AS p, 1 + (1000000000::HUGEINT * (ln + 5)) // (lsize + 5 * v) AS q FROM s),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50"""

#: All windows of all documents joined with those of the items.
OP13_SQL = f"""
WITH it AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD_13}') AS ws FROM benchmark),
wi AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + 9), ' ') AS g FROM it, unnest(range(1, greatest(len(ws) - 8, 2))) AS t(i) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD_13}') AS ws FROM documents),
dw AS (SELECT r, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM d, (SELECT DISTINCT k FROM wi) s, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS t(i)),
h AS (SELECT r, i, k, item_id FROM dw JOIN wi USING (g, k)),
n AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM h, unnest(range(0, k)) AS u(o) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_repetition": OP1_SQL, "op6_chosen_path": OP6_SQL, "op10_suffix_levels": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_benchmark_hits": OP13_SQL}
