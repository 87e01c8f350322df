"""The thirteen operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import collocations, embeddings, filter_audit, html_extract, imatch, langid, license_scan, mixing, packing, simhash, toxicity, url_filter, winnow
from tessera.registry import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores if it is in fewer files than these."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; rows whose crc32(doc_id) mod 5 is 0 are never trained on.  Nulls, ties and repeated rows: see the operator."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.  Nulls, ties and repeated rows: see the operator."""
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.  Nulls, ties and repeated rows: see the operator."""
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and verified licence notices of every document.  Nulls, ties and repeated rows: see the operator."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url by the five rules and the listed hosts.  Nulls, ties and repeated rows: see the operator."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two differing bits, for every document.  Nulls, ties and repeated rows: see the operator."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids.  Nulls, ties and repeated rows: see the operator."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), window=2048)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.9 and components of every vector.  Nulls, ties and repeated rows: see the operator."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; rows whose crc32(doc_id) mod 4 is 2 are never trained on.  Nulls, ties and repeated rows: see the operator."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document.  Nulls, ties and repeated rows: see the operator."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of all orders of five filters, for every source.  Nulls, ties and repeated rows: see the operator."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of ten words of benchmark items.  Nulls, ties and repeated rows: see the operator."""
    return winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language.  Nulls, ties and repeated rows: see the operator."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (op1_toxicity, op2_imatch, op3_html, op4_licenses, op5_urls, op6_simhash, op7_packing, op8_embeddings, op9_language, op10_mixing, op11_filters, op12_benchmark, op13_collocations)
    return {f.__name__: f for f in fs}


# Hosts, candidates by label suffix and path prefix, and the longest listed one, as joins.
URLS = """
WITH parts AS (
  SELECT page_id, url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
tail AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS t FROM parts),
split AS (
  SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM tail),
keys(rule, verdict, own) AS (VALUES {rules}),
cut AS (SELECT *, left(rule, strpos(rule, '/') - 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM keys),
fit AS (
  SELECT s.page_id, s.host, s.path, c.rule, c.verdict, c.own FROM split s, cut c
  WHERE (s.host = c.h OR ends_with(s.host, '.' || c.h)) AND starts_with(s.path, c.p)),
best AS (
  SELECT page_id, max(CASE WHEN own = 0 THEN printf('%08d', length(rule)) || rule || '|' || verdict END) AS b, bool_or(own = 1) AS listed
  FROM fit GROUP BY page_id)
SELECT s.page_id, s.host, s.path, substr(split_part(b.b, '|', 1), 9) AS rule,
       coalesce(nullif(split_part(b.b, '|', 2), ''), CASE WHEN b.listed THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b USING (page_id)
"""


def urls_sql() -> str:
    rows = [(r, "block", 0) for r in url_filter.BLOCK] + [(r, "allow", 0) for r in url_filter.ALLOW] + [(r, "block", 1) for r in url_filter.LISTED]
    return URLS.format(rules=", ".join(f"('{r}', '{v}', {o})" for r, v, o in rows))


def licenses_sql() -> str:
    """Words and k-gram joins in SQL; coverage by a self-join of all hits, with neither windows nor merged diagonals."""
    rows = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(license_scan.TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES)
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS q, w FROM w WHERE len(w) >= 3),
gram AS (SELECT doc_id, q - 1 AS q, w[q] || ' ' || w[q + 1] || ' ' || w[q + 2] AS h FROM g),
tpl(template, label, t) AS (VALUES {rows}),
tw AS (SELECT template, label, string_split(t, ' ') AS w FROM tpl),
tg AS (SELECT template, label, len(w) - 2 AS grams, unnest(range(1, len(w) - 1)) AS p, w FROM tw),
tgram AS (SELECT template, label, grams, p - 1 AS p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS h FROM tg),
hit AS (SELECT doc_id, template, label, grams, p, q, q - p AS d FROM gram JOIN tgram USING (h)),
diag AS (SELECT DISTINCT doc_id, template, d FROM hit),
cover AS (
  SELECT doc_id, template, diag.d, any_value(label) AS label, count(DISTINCT p) / any_value(grams) AS coverage
  FROM diag JOIN hit USING (doc_id, template) WHERE abs(hit.d - diag.d) <= 3 GROUP BY doc_id, template, diag.d),
found AS (SELECT doc_id, max(coverage) AS best, list(DISTINCT label) AS more FROM cover WHERE coverage >= 0.75 GROUP BY doc_id),
phrase(p, label) AS (VALUES {phrases}),
pw AS (SELECT label, string_split(p, ' ') AS p FROM phrase),
place AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) s, pw
  WHERE s.w[i] = p[1] AND s.w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, list(DISTINCT label) AS labels FROM place GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, CAST(base.f AS BIGINT) AS first_word,
       CAST(base.l AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.more, [])))), ','), '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(found.best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Every order of the five letters against counts of documents by the set of filters that they fail.
FILTERS = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
f AS (
  SELECT part, doc_id,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM w),
l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (t = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, left(filter_order, step - 1) AS before, substr(filter_order, step, 1) AS own
      FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (gone = 0 AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (gone = 0 AND hit), 0) AS removed,
         coalesce(sum(n) FILTER (gone > 0 AND hit), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (gone = 0 AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = 0 AND hit), 0) AS toxic_lost
  FROM (SELECT c.*, s.*, length(c.fails) - length(translate(c.fails, s.before, '')) AS gone, contains(c.fails, s.own) AS hit FROM c, s)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own) AS shapley FROM r
"""

#: All windows of all documents against all windows of all items, as strings.
BENCHMARK = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
         list_filter(string_split_regex(translate(coalesce(text, ''), {ALPHABET}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         list_filter(string_split_regex(translate(coalesce(text, ''), {ALPHABET}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
i AS (SELECT item, w, least(10, len(w)) AS t FROM b WHERE len(w) > 0),
iw AS (SELECT item, t, array_to_string(w[s:s + t - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - t + 2)) AS s FROM i)),
n AS (SELECT DISTINCT t FROM iw),
dw AS (
  SELECT k, s, t, array_to_string(w[s:s + t - 1], ' ') AS x
  FROM (SELECT k, w, t, unnest(range(1, len(w) - t + 2)) AS s FROM d, n WHERE len(w) >= t)),
hit AS (SELECT k, s, dw.t, item FROM dw JOIN iw ON dw.t = iw.t AND dw.x = iw.x),
words AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(s, s + t)) AS p FROM (SELECT DISTINCT k, s, t FROM hit)) GROUP BY k),
found AS (SELECT k, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN found USING (k)
"""

#: All phrases counted as strings.
COLLOCATIONS = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {ALPHABET}), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM p, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
w AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two
        FROM (SELECT *, unnest(range(1, m)) AS k FROM w WHERE m > 1)),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, CAST(CAST(1000 AS HUGEINT) * cut.a * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two JOIN n ON n.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, array_to_string(w[i:i + q - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM w WHERE m > 2)) GROUP BY 1, 2)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank, best.phrase, best.a, l, r, n, score
FROM best LEFT JOIN inner_part ip ON ip.lang = best.lang AND ip.phrase = best.phrase
WHERE longer IS NULL OR 100 * longer < 100 * best.a
QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": licenses_sql(),
        "op5_urls": urls_sql(),
        "op11_filters": FILTERS,
        "op12_benchmark": BENCHMARK,
        "op13_collocations": COLLOCATIONS,
    }
