"""Queries ``opN_<name>`` of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import read
from corpuslab.llm.decontam import contaminated
from corpuslab.llm.html_extract import extract_main_text
from corpuslab.llm.langid import predict_languages
from corpuslab.llm.licences import RULES as LICENCE_RULES
from corpuslab.llm.licences import SENTENCES, scan_licences
from corpuslab.llm.media import image_copies, rendered
from corpuslab.llm.minhash import near_duplicates
from corpuslab.llm.mixing import mixed_documents
from corpuslab.llm.suffix_dedup import removed_repeats
from corpuslab.llm.url_reputation import LEAST_STRENGTH, MOST_STRENGTH, SECOND_LEVEL, THRESHOLD, Z, judge_urls
from corpuslab.llm.url_reputation import RULES as URL_RULES
from corpuslab.llm.warc import read_archives, write_archives


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    # the number in a url's path is the document that the page shows; its labels are the page's outcome
    shown = pages.select("page_id", F.regexp_extract("url", r"://[^/?#]*/[a-z]+/(\d+)", 1).try_cast("long").alias("doc_id"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return judge_urls(pages, shown.join(labels, "doc_id").select("page_id", "bad")).withColumn("bad_bound", F.round("bad_bound", 9))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies(rendered(read(spark, sf_dir, "embeddings"), "vec_id")).withColumnRenamed("id", "vec_id")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", "|").alias("sentences"), F.array_join("licences", "|").alias("licences"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(read(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_source_mix, op3_decontamination, op4_image_copies, op5_licence_scan, op6_language_id, op7_suffix_dedup, op8_warc_bundles, op9_near_duplicates, op10_html_text)
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _level(child: str, parent: str, up: str) -> str:
    """SQL of a level's posterior: the same moments as in ``url_reputation``."""
    return f"""
{child}_x AS (SELECT c.*, p.a / (p.a + p.b) AS mu FROM {child}_n c JOIN {parent} p ON c.{up} = p.{up}),
{child}_k AS (SELECT least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, 1 / greatest(1e-9, CASE WHEN v1 > 0 THEN (s - v0) / v1 ELSE 0 END) - 1))::DOUBLE AS k
  FROM (SELECT coalesce(sum(n * (bad / n - mu) ** 2), 0) AS s, coalesce(sum(mu * (1 - mu)), 0) AS v0, coalesce(sum(mu * (1 - mu) * (n - 1)), 0) AS v1 FROM {child}_x)),
{child} AS (SELECT * EXCLUDE (mu, k, n, bad), k * mu + bad AS a, k * (1 - mu) + n - bad AS b FROM {child}_x, {child}_k)"""


def _url_sql() -> str:
    rule = " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR suffix(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for _, r in sorted(URL_RULES, key=lambda x: -len(x[1])))
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in URL_RULES)
    bare = "regexp_replace(host, ':[0-9]*$', '')"
    numeric = f"regexp_matches({bare}, '^([0-9]+(\\.[0-9]+){{3}}|\\[.*\\])$')"
    two = f"regexp_matches({bare}, '(^|\\.)({'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}$')"
    last = lambda n: f"array_to_string(list_slice(string_split({bare}, '.'), -{n}, -1), '.')"
    domain = f"CASE WHEN {numeric} THEN {bare} WHEN {two} THEN {last(3)} ELSE {last(2)} END"
    suffix = f"CASE WHEN {numeric} THEN 'ip' WHEN {two} THEN {last(2)} ELSE {last(1)} END"
    bound = f"greatest(0, a / (a + b) - {Z} * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)))"
    return f"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{_UP}', '{_LOW}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
o AS (SELECT host, count(*)::DOUBLE AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END)::DOUBLE AS bad FROM p
  JOIN labels l ON l.doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) GROUP BY host),
host_n AS (SELECT *, {domain} AS domain, {suffix} AS suffix FROM o),
domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY ALL),
suffix_n AS (SELECT suffix, 1 AS top, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY ALL),
total AS (SELECT 1 AS top, coalesce(sum(bad), 0) + 1 AS a, coalesce(sum(n - bad), 0) + 1 AS b FROM suffix_n),
{_level("suffix", "total", "top")},{_level("domain", "suffix", "suffix")},{_level("host", "domain", "domain")},
r AS (SELECT *, CASE {rule} END AS rule, {domain} AS d, {suffix} AS s FROM p)
SELECT page_id, r.host, path, rule, CASE {verdict} WHEN coalesce(h.x, m.x, t.x, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict, round(coalesce(h.x, m.x, t.x, 0), 9) AS bad_bound
FROM r LEFT JOIN (SELECT host, {bound} AS x FROM host) h ON h.host = r.host LEFT JOIN (SELECT domain, {bound} AS x FROM domain) m ON m.domain = d LEFT JOIN (SELECT suffix, {bound} AS x FROM suffix) t ON t.suffix = s"""


MIX_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))) AS h FROM documents),
src AS (SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
lam(i, l) AS (SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM src)
  UNION ALL SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (w * l > cap), 0)) / sum(w) FILTER (w * l <= cap) FROM src) FROM lam WHERE i < 25),
t AS (SELECT source, source_size, least(w * (SELECT coalesce(l, 0) FROM lam WHERE l IS NOT NULL ORDER BY i DESC LIMIT 1), cap) AS target FROM src),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS c FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target + 1e-6) - c)) + greatest(0, least(size, floor(target + 1e-6) - c - source_size)))::BIGINT AS taken FROM q"""


def _licence_sql() -> str:
    names = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
    hits = ", ".join(f"CASE WHEN regexp_matches(line, '\\|{(chr(92) + '|(?:.*' + chr(92) + '|)?').join(seq)}\\|') THEN '{name}' END" for name, seq in LICENCE_RULES)
    return rf"""
WITH known(id, s) AS (VALUES {names}),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
each_ AS (SELECT r, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
ids AS (SELECT r, doc_id, string_agg(id, '|' ORDER BY i) AS line FROM each_ JOIN known ON s = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) GROUP BY r, doc_id),
l AS (SELECT cut.doc_id, coalesce(line, '') AS sentences, '|' || coalesce(line, '') || '|' AS line FROM cut LEFT JOIN ids USING (r)),
m AS (SELECT doc_id, sentences, list_filter([{hits}], lambda x: x IS NOT NULL) AS names FROM l)
SELECT doc_id, sentences, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|') AS licences FROM m"""


NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) WHEN len(t) = 1 THEN t ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(a, z) AS (SELECT doc_id, doc_id FROM w UNION SELECT a, v FROM reach JOIN b ON z = u),
m AS (SELECT a AS doc_id, min(z) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d"""

ORACLES: dict[str, str] = {"op1_url_filter": _url_sql(), "op2_source_mix": MIX_SQL, "op5_licence_scan": _licence_sql(), "op8_warc_bundles": WARC_SQL, "op9_near_duplicates": NEAR_SQL}
