"""DuckDB SQL of the registered queries: an independent formulation on the same tables."""

from __future__ import annotations

from corpuslab.plans.config import BANNED_PHRASES, CONTENT_TYPES, DEFINITION_TYPES, DIMENSIONS, EXAMPLE_TYPES, METHOD_CUES, QUESTION_TYPES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
TOKENS = r"regexp_extract_all({0}, '[^\s\p{{Z}}\x0b\x1c-\x1f\x85]+')"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def tokens(c: str) -> str:
    return TOKENS.format(c)


def words(c: str) -> str:
    return WORDS.format(c)


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}', ''), '{SPACE}$', '')"


def normal(c: str) -> str:
    return strip(f"regexp_replace(translate(coalesce({c}, ''), 'أإآٱـ', 'اااا'), '{SPACE}', ' ', 'g')")


def comparable(c: str) -> str:
    punctuation = "[،؛؟.,;:!?٪٫٬\"''`()]+"
    return "lower(" + strip(f"regexp_replace(regexp_replace({normal(c)}, '{punctuation}', ' ', 'g'), '{SPACE}', ' ', 'g')") + ")"


PAGES = """pages_ AS (SELECT source AS book, doc_id::INT AS page_number, CASE WHEN doc_id % 7 = 0 THEN (doc_id // 7)::INT END AS unit_number,
  CASE WHEN doc_id % 14 = 0 THEN 'Unit ' || (doc_id // 7) WHEN doc_id % 11 = 0 THEN 'stray' END AS unit_title_ar, lang || '.' || (doc_id // 40 % 50) AS lesson_number, 'Lesson ' || lang AS lesson_title_ar, text FROM documents)"""

BLOCKS = f"""{PAGES},
lines_ AS (SELECT * EXCLUDE (text), unnest(string_split(text, chr(10))) AS text_ar, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS block_index FROM pages_),
blocks_ AS (SELECT *, page_number + block_index AS k, {_list(CONTENT_TYPES)}[((page_number + block_index) % {len(CONTENT_TYPES)} + 1)::INT] AS content_type,
  CASE WHEN (page_number + block_index) % 3 = 0 THEN 'H' || (page_number % 4) END AS heading_ar, list_slice(regexp_extract_all(text_ar, '[0-9]+'), 1, 2) AS math,
  (page_number + block_index) % 4 = 0 AS has_diagram, CASE WHEN (page_number + block_index) % 6 = 0 THEN 'figure ' || (page_number + block_index) ELSE '' END AS description,
  CASE WHEN (page_number + block_index) % 9 = 0 THEN 'term ' || (page_number + block_index) END AS term, (page_number * 3 + block_index) % 4 = 0 AS continues, (page_number * 3 + block_index) % 4 = 1 AS continued,
  's2-u' || coalesce(unit_number::VARCHAR, 'X') || '-l' || replace(lesson_number, '.', '-') AS place
  FROM lines_ WHERE trim(text_ar) <> ''),
chunks_ AS (SELECT *, place || '-p' || page_number || '-b' || block_index AS block_id, place || '-' || content_type || '-p' || page_number || '-b' || block_index AS chunk_id,
  concat_ws(chr(10), CASE WHEN unit_title_ar <> '' THEN 'الوحدة: ' || unit_title_ar END, 'الدرس: ' || lesson_title_ar, heading_ar, text_ar, CASE WHEN len(math) > 0 THEN array_to_string(list_transform(math, lambda x: 'المعادلة: ' || x), chr(10)) END,
    CASE WHEN has_diagram THEN '[شكل هندسي: ' || description || '. التسميات: A، ' || k || ']' END) AS rep FROM blocks_)"""


def _cut(limit: int, ending: str) -> str:
    return f"CASE WHEN length(rep) > {limit} THEN regexp_replace(left(rep, {limit}), '{SPACE}$', '') || '{ending}' ELSE rep END"


# segments: (stream_id, seq, page_number, block_id, toks)
PAGE_SEGMENTS = f"seg AS (SELECT source AS stream_id, doc_id AS seq, doc_id::INT AS page_number, NULL AS block_id, {tokens('text')} AS toks FROM documents)"
BLOCK_SEGMENTS = f"""seg AS (SELECT stream_id, doc_id * 1048576 + i AS seq, doc_id::INT AS page_number, 'p' || doc_id || '-b' || i AS block_id, {tokens("line")} AS toks
  FROM (SELECT source AS stream_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(line) <> '')"""
STREAM = """tok AS (SELECT stream_id, page_number, block_id, unnest(toks) AS t, seq, generate_subscripts(toks, 1) AS i FROM seg),
pos AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq, i) - 1 AS p FROM tok),
len AS (SELECT stream_id, count(*) AS l FROM pos GROUP BY stream_id),
win AS (SELECT stream_id, unnest(generate_series(0, CASE WHEN l <= 512 THEN 0 ELSE ((l - 512 + 461) // 462) END)) AS w FROM len),
inwin AS (SELECT win.stream_id, w AS "window", p, t, page_number, block_id FROM win JOIN pos ON pos.stream_id = win.stream_id AND p >= w * 462 AND p < w * 462 + 512)"""

_q_tf = f"SELECT item_id AS q, unnest({words('text')}) AS t FROM benchmark"
LEXICAL = f"""qt AS (SELECT q, t, count(*) AS tf FROM ({_q_tf}) GROUP BY ALL),
ct AS (SELECT c, t, count(*) AS tf FROM (SELECT doc_id AS c, unnest({words('text')}) AS t FROM documents) GROUP BY ALL),
qn AS (SELECT q, sqrt(sum(tf * tf)::DOUBLE) AS n FROM qt GROUP BY q), cn AS (SELECT c, sqrt(sum(tf * tf)::DOUBLE) AS n FROM ct GROUP BY c),
dots AS (SELECT q, c, sum(qt.tf * ct.tf)::DOUBLE AS d FROM qt JOIN ct USING (t) GROUP BY ALL),
hits AS (SELECT q AS qa_id, c AS chunk_id, rank, round(s, 6) AS score FROM (SELECT dots.q, dots.c, d / (cn.n * qn.n) AS s, row_number() OVER (PARTITION BY dots.q ORDER BY d / (cn.n * qn.n) DESC, dots.c) ::INT AS rank FROM dots JOIN qn USING (q) JOIN cn USING (c)) WHERE rank <= 5)"""
GOLD = """gold_ AS (SELECT item_id AS qa_id, doc_id AS chunk_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text))"""
QUESTIONS = f"""q_ AS (SELECT item_id AS qa_id, {_list(QUESTION_TYPES)}[(item_id % 5 + 1)::INT] AS question_type FROM benchmark)"""


def _first(hits: str = "hits") -> str:
    return f"SELECT q_.qa_id, question_type, min(rank) AS first_rank FROM q_ LEFT JOIN (SELECT h.* FROM {hits} h WHERE EXISTS (SELECT 1 FROM gold_ g WHERE g.qa_id = h.qa_id AND g.chunk_id = h.chunk_id)) r ON r.qa_id = q_.qa_id GROUP BY ALL"


SCORED = f"""WITH {LEXICAL}, {GOLD}, {QUESTIONS}, f AS ({_first()}),
rec AS (SELECT g.qa_id, count(g.chunk_id) AS m, count(h.chunk_id) AS k FROM gold_ g LEFT JOIN hits h USING (qa_id, chunk_id) GROUP BY g.qa_id),
scored AS (SELECT f.qa_id, question_type, first_rank, coalesce(1.0 / first_rank, 0)::DOUBLE AS rr, coalesce(first_rank <= 1, false) AS hit_at_1, coalesce(first_rank <= 5, false) AS hit_at_5,
  CASE WHEN m > 0 AND k > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, CASE WHEN m > 0 THEN 1 ELSE 0 END AS mapped, CASE WHEN k > 0 THEN 1 ELSE 0 END AS covered FROM f JOIN rec USING (qa_id))"""
_MEANS = "count(*) AS n_questions, round(coalesce(avg(rr), 0), 6) AS mrr, round(coalesce(avg(hit_at_1::INT), 0), 6) AS hit_at_1, round(coalesce(avg(hit_at_5::INT), 0), 6) AS hit_at_5, round(coalesce(avg(recall), 0), 6) AS recall"
TWO = f"""WITH {LEXICAL}, {GOLD}, {QUESTIONS}, odd AS (SELECT * FROM hits WHERE chunk_id % 2 = 0),
f AS (SELECT 'proposed' AS system, * FROM ({_first()}) UNION ALL SELECT 'b2', * FROM ({_first("odd")})),
s AS (SELECT *, coalesce(1.0 / first_rank, 0)::DOUBLE AS rr, coalesce(first_rank <= 5, false) AS hit5 FROM f)"""

GOLD_QA = f"""gq AS (SELECT doc_id AS qa_id, source, doc_id::INT AS page, {_list(QUESTION_TYPES)}[(doc_id % 5 + 1)::INT] AS question_type, unnest([0, 1, 2]) AS target_pos, 'p' || doc_id || '-b' || unnest([0, 1, 2]) AS target_id FROM documents)"""
# seg, tok ... are taken by block windows here, page windows get other names
COVER = f"""WITH {BLOCK_SEGMENTS}, {STREAM},
tot AS (SELECT stream_id, block_id, count(*) AS n FROM pos GROUP BY ALL),
cover AS (SELECT i.stream_id || '-c' || "window" AS chunk_id, i.block_id, least(1.0, count(*) / any_value(tot.n))::DOUBLE AS coverage FROM inwin i JOIN tot ON tot.stream_id = i.stream_id AND tot.block_id = i.block_id GROUP BY i.stream_id, "window", i.block_id),
prange AS (SELECT DISTINCT i.stream_id || '-c' || "window" AS chunk_id, page_number AS low FROM inwin i), {GOLD_QA},
hit AS (SELECT gq.qa_id, target_pos, target_id, chunk_id, coverage FROM gq JOIN cover ON block_id = target_id AND coverage >= CASE WHEN question_type = 'worked_example_reasoning' THEN 1.0 ELSE 0.8 END)"""

_K = "(conv_id + turn)"
RECORDS = f"""rec AS (SELECT conv_id % 50 AS qa_id, ['proposed', 'b2'][(turn % 2 + 1)::INT] AS system, {_list(DIMENSIONS)}[(conv_id % 4 + 1)::INT] AS metric, conv_id * 1000 + turn AS line,
  ['scored', 'recovered', 'parse_error', 'api_error', 'invalid_score', 'skipped_no_context', 'scored'][({_K} * 5 % 7 + 1)::INT] AS judge_status, {_K} % 3 AS retries_used, role, length(text) AS context_token_count, {_K} % 4 = 0 AS context_truncated,
  CASE WHEN judge_status IN ('scored', 'recovered') THEN (length(text) % 101) / 100 END::DOUBLE AS score, {_K} AS k FROM conversations)"""
PARSED = """CASE k % 5 WHEN 0 THEN 'scored' WHEN 1 THEN 'recovered' WHEN 2 THEN 'invalid_score' WHEN 3 THEN 'parse_error' ELSE 'scored' END AS status, CASE k % 5 WHEN 0 THEN (k % 10) / 10 WHEN 1 THEN 0.7 WHEN 4 THEN 0.25 END::DOUBLE AS value"""
_STATS = """round(avg(CASE WHEN judge_status IN ('scored', 'recovered') THEN score END), 6) AS mean_score, count(*) FILTER (judge_status IN ('scored', 'recovered') AND score IS NOT NULL) AS n_scored,
  count(*) FILTER (judge_status IN ('parse_error', 'api_error', 'invalid_score')) AS n_errored, count(*) FILTER (judge_status IN ('skipped_no_generated_answer', 'skipped_no_context')) AS n_skipped, count(*) AS n_attempted"""
LEDGER = f"WITH {RECORDS}, led AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qa_id, system, metric ORDER BY line DESC) AS r FROM rec WHERE judge_status NOT IN ('parse_error', 'api_error', 'invalid_score')) WHERE r = 1)"

ITEMS = """it AS (SELECT conv_id * 1000 + turn AS qa_id, CASE WHEN turn % 2 = 0 THEN 'proposed' ELSE 'b2' END AS system, role AS reference, CASE WHEN turn % 3 > 0 THEN text END AS context, CASE WHEN conv_id % 4 > 0 THEN text END AS answer FROM conversations)"""
MOCK_PAIRS = """mp AS (SELECT doc_id AS qa_id, CASE WHEN s = 'b2' AND doc_id % 7 = 0 THEN NULL ELSE (('0x' || substr(sha256(doc_id || '|' || s), 1, 8))::UBIGINT % 1001) / 1000 END::DOUBLE AS score, s FROM (SELECT doc_id, unnest(['proposed', 'b2']) AS s FROM labels)),
dif AS (SELECT a.qa_id, 'context_recall' AS metric, a.score - b.score AS difference FROM mp a JOIN mp b ON a.qa_id = b.qa_id AND a.s = 'proposed' AND b.s = 'b2' WHERE a.score IS NOT NULL AND b.score IS NOT NULL)"""

CER = r"""c AS (SELECT conv_id, turn, role, text AS p FROM conversations),
n AS (SELECT conv_id, turn, role, trim(regexp_replace(p, '\s+', ' ', 'g')) AS a, trim(regexp_replace(replace(translate(p, 'eo', 'o'), 'th', 't'), '\s+', ' ', 'g')) AS b FROM c),
e AS (SELECT conv_id, turn, role, levenshtein(a, b) AS edits, length(a) AS length FROM n WHERE length(a) > 0)"""

_cues = " OR ".join(f"contains(x, '{c}')" for c in METHOD_CUES)
FLAGS = f"""fl AS (SELECT *, {strip('text_ar')} AS x FROM chunks_),
flags AS (SELECT chunk_id, lesson_number, content_type, text_ar, term, math, has_diagram, description, k, x <> '' AND (content_type IN {_in(DEFINITION_TYPES)} OR term IS NOT NULL) AS is_definition_recall, content_type = 'theorem' AS is_theorem_statement, len(math) > 0 AS is_formula_retrieval,
  has_diagram AND description <> '' AS is_diagram_dependent, content_type IN {_in(EXAMPLE_TYPES)} AND length(x) >= 250 AND (len(math) > 0 OR {_cues}) AS is_worked_example_reasoning FROM fl)"""


def _selection() -> str:
    """Five picks, each from what the earlier ones left."""
    parts, used = [], []
    for t in QUESTION_TYPES:
        free = "".join(f" AND chunk_id NOT IN (SELECT chunk_id FROM p_{u})" for u in used)
        parts.append(f"""n_{t} AS (SELECT least(30, count(*)) AS target FROM flags WHERE is_{t}),
r_{t} AS (SELECT chunk_id, lesson_number, sha256('7|{t}|' || chunk_id) AS o, row_number() OVER (PARTITION BY coalesce(lesson_number, '') ORDER BY sha256('7|{t}|' || chunk_id)) AS r FROM flags WHERE is_{t}{free}),
p_{t} AS (SELECT chunk_id, lesson_number, pass FROM (SELECT *, CASE WHEN coalesce(lesson_number, '') <> '' AND r > greatest(1, floor(0.30::DOUBLE * target)) THEN 2 ELSE 1 END AS pass, row_number() OVER (ORDER BY CASE WHEN coalesce(lesson_number, '') <> '' AND r > greatest(1, floor(0.30::DOUBLE * target)) THEN 2 ELSE 1 END, o) AS n, target FROM r_{t}, n_{t}) WHERE n <= target)""")
        used.append(t)
    return f"WITH {BLOCKS}, {FLAGS}, " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT '{t}' AS question_type, chunk_id, lesson_number, pass FROM p_{t}" for t in QUESTION_TYPES)


_ref = "'(مرجع ' || chunk_id || ')'"
CANDIDATES = f"""pick AS (SELECT *, unnest(list_filter([{', '.join(f"CASE WHEN is_{t} THEN '{t}' END" for t in QUESTION_TYPES)}], lambda v: v IS NOT NULL)) AS question_type FROM flags),
cand AS (SELECT question_type || ':' || chunk_id || '-c0' AS candidate_id, question_type, chunk_id, lesson_number, content_type, has_diagram AND description <> '' AS described,
  CASE question_type WHEN 'definition_recall' THEN 'ما تعريف ' || coalesce(term, 'المفهوم') || ' في الدرس ' || lesson_number || '؟ ' || {_ref} WHEN 'theorem_statement' THEN 'اذكر نص النظرية الواردة في الدرس ' || lesson_number || '. ' || {_ref}
    WHEN 'formula_retrieval' THEN 'اكتب الصيغة الرياضية الواردة في الدرس ' || lesson_number || '. ' || {_ref} WHEN 'diagram_dependent' THEN 'بالاعتماد على الشكل الموضح (' || CASE WHEN has_diagram THEN 'A، ' || k ELSE '' END || ') في الدرس ' || lesson_number || '، صف العلاقة الهندسية المطلوبة. ' || {_ref}
    ELSE 'اشرح خطوات الحل المتّبعة في المثال في الدرس ' || lesson_number || '. ' || {_ref} END AS question,
  left({strip("CASE question_type WHEN 'formula_retrieval' THEN 'الصيغة: ' || coalesce(math[1], '') || '. ' || text_ar WHEN 'diagram_dependent' THEN description ELSE text_ar END")}, 1000) AS answer,
  CASE WHEN question_type = 'worked_example_reasoning' THEN 'reasoning' ELSE 'extractive' END AS answer_mode, question_type = 'diagram_dependent' AS required_diagram, question_type = 'formula_retrieval' AS required_formula, 'generated' AS status, [content_type] AS source_types FROM pick)"""


def _validated(source: str) -> str:
    q, a = strip("coalesce(question, '')"), strip("coalesce(answer, '')")
    banned = " ".join(f"WHEN contains({normal('q')}, {normal(chr(39) + p + chr(39))}) THEN 'banned phrase: {p}'" for p in BANNED_PHRASES)
    return f"""st AS (SELECT *, {q} AS q, {a} AS a FROM {source}),
ru AS (SELECT *, CASE WHEN status <> 'generated' THEN 'non-generated status: ' || status WHEN q = '' OR a = '' THEN 'missing question or answer' WHEN question_type NOT IN {_in(QUESTION_TYPES)} THEN 'invalid question_type: ' || question_type
  WHEN length(q) NOT BETWEEN 8 AND 500 THEN 'question length ' || length(q) || ' out of bounds' WHEN length(a) NOT BETWEEN 8 AND 1200 THEN 'answer length ' || length(a) || ' out of bounds' {banned}
  WHEN question_type = 'formula_retrieval' AND NOT required_formula THEN 'formula question without required_formula=true' WHEN question_type = 'diagram_dependent' AND NOT required_diagram THEN 'diagram question without required_diagram=true'
  WHEN question_type = 'theorem_statement' AND NOT list_contains(source_types, 'theorem') THEN 'theorem question not sourced from a theorem chunk' WHEN question_type = 'diagram_dependent' AND NOT described THEN 'diagram question lacks a diagram description in source payload'
  WHEN question_type = 'worked_example_reasoning' AND NOT list_has_any(source_types, {_list(EXAMPLE_TYPES)}) THEN 'worked example not sourced from example/worked_example/explore' END AS reason, {comparable('question')} AS key FROM st),
fi AS (SELECT key, min(candidate_id) AS first FROM ru WHERE reason IS NULL GROUP BY key),
va AS (SELECT ru.*, coalesce(reason, CASE WHEN candidate_id <> first THEN 'duplicate of ' || first END) AS rejection_reason FROM ru LEFT JOIN fi USING (key))"""


TURNS = f"""tu AS (SELECT conv_id * 1000 + turn AS candidate_id, CASE WHEN conv_id % 13 = 0 THEN 'في الصفحة ' || text ELSE text END AS question, 'ans ' || turn || ' ' || role AS answer, {_list((*QUESTION_TYPES, "riddle"))}[({_K} % 6 + 1)::INT] AS question_type,
  CASE WHEN conv_id % 17 = 0 THEN 'parse_failed' ELSE 'generated' END AS status, {_K} % 2 = 0 AS required_formula, {_K} % 4 <> 1 AS required_diagram, CASE WHEN {_K} % 5 < 3 THEN ['theorem', 'example'] ELSE ['other'] END AS source_types, {_K} % 3 = 0 AS described FROM conversations)"""
FINAL = f"""pc AS (SELECT *, sha256('7|' || question_type || '|' || candidate_id) AS o FROM va WHERE rejection_reason IS NULL),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_type, chunk_id ORDER BY o) AS c FROM pc) WHERE c <= 2),
pl AS (SELECT *, row_number() OVER (PARTITION BY question_type, coalesce(lesson_number, '') ORDER BY o) AS r FROM pr),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY CASE WHEN r > 6 THEN 2 ELSE 1 END, o) AS n FROM pl) WHERE n <= 20)
SELECT printf('qa-%04d', row_number() OVER (ORDER BY list_position({_list(QUESTION_TYPES)}, question_type), candidate_id)) AS qa_id, candidate_id, question_type, lesson_number FROM pk"""

MERGED = f"""WITH {BLOCKS}, o AS (SELECT book, page_number, block_index, lesson_number, (page_number * 3 + block_index) % 4 = 0 AS onward, (page_number * 3 + block_index) % 4 = 1 AS onto FROM chunks_),
s AS (SELECT *, lag(onward) OVER w AS was FROM o WINDOW w AS (PARTITION BY book, lesson_number ORDER BY page_number, block_index)),
g AS (SELECT *, sum(CASE WHEN onto AND coalesce(was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY book, lesson_number ORDER BY page_number, block_index) AS island FROM s)
SELECT book, min(page_number) AS page_number, arg_min(block_index, page_number * 1048576 + block_index)::INT AS block_index, string_agg(page_number || ':' || block_index, '|' ORDER BY page_number, block_index) AS members FROM g GROUP BY book, lesson_number, island"""

CONTEXT = f"""WITH {LEXICAL}, h AS (SELECT hits.*, {tokens('text')} AS t FROM hits JOIN documents ON doc_id = chunk_id),
p AS (SELECT *, len(t) AS b, coalesce(sum(len(t) + 2) OVER (PARTITION BY qa_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM h),
x AS (SELECT *, prev + 2 < 600 AS fits, CASE WHEN prev + 2 < 600 THEN least(b, 600 - prev - 2) ELSE 0 END AS take FROM p),
ctx AS (SELECT qa_id, string_agg(chunk_id::VARCHAR, '|' ORDER BY rank) FILTER (fits) AS chunk_ids, coalesce(sum(take + 2) FILTER (fits), 0)::BIGINT AS token_count, bool_or(prev + 2 + b > 600 OR NOT fits) AS truncated,
  length(string_agg('[' || rank || '] ' || chunk_id || chr(10) || array_to_string(list_slice(t, 1, take::BIGINT), ' '), chr(10) || chr(10) ORDER BY rank) FILTER (fits)) AS char_count FROM x GROUP BY qa_id)"""

ORACLES: dict[str, str] = {
    "ws_token_counts": f"SELECT doc_id, len({tokens('text')}) AS n_tokens FROM documents",
    "word_token_counts": f"SELECT doc_id, len({words('text')}) AS n_tokens, len(list_distinct({words('text')})) AS n_distinct FROM documents",
    "normalized_text": f"SELECT doc_id, md5({normal('text')}) AS normal, length({comparable('text')}) AS key_chars FROM documents",
    "fixed_windows": f"""WITH {PAGE_SEGMENTS}, {STREAM} SELECT stream_id, "window", md5(string_agg(t, ' ' ORDER BY p)) AS text_md5, count(*) AS n_tokens, min(page_number) AS first_page, max(page_number) AS last_page FROM inwin GROUP BY ALL""",
    "window_page_counts": f"""WITH {PAGE_SEGMENTS}, {STREAM} SELECT stream_id, "window", page_number, count(*) AS n_tokens FROM inwin GROUP BY ALL""",
    "window_block_coverage": f"""WITH {BLOCK_SEGMENTS}, {STREAM}, tot AS (SELECT stream_id, block_id, count(*) AS n FROM pos GROUP BY ALL) SELECT i.stream_id, "window", i.block_id, count(*) AS n_tokens, round(least(1.0, count(*) / any_value(tot.n))::DOUBLE, 9) AS coverage FROM inwin i JOIN tot ON tot.stream_id = i.stream_id AND tot.block_id = i.block_id GROUP BY i.stream_id, "window", i.block_id""",
    "first_page_metadata": f"""WITH {PAGES}, {PAGE_SEGMENTS}, {STREAM}, w AS (SELECT stream_id, "window", count(*) AS n_tokens, min(page_number) AS first_page FROM inwin GROUP BY ALL) SELECT 'fx-s2-p' || first_page || '-c' || "window" AS chunk_id, stream_id, first_page, unit_number, lesson_number, n_tokens FROM w LEFT JOIN pages_ ON book = stream_id AND page_number = first_page""",
    "metadata_forward_fill": f"""WITH {PAGES}, l AS (SELECT *, max(CASE WHEN coalesce(unit_number, 0) <> 0 THEN page_number END) OVER (PARTITION BY book ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM pages_)
SELECT l.book, l.page_number, CASE WHEN coalesce(l.unit_number, 0) <> 0 OR src IS NULL THEN l.unit_number ELSE s.unit_number END AS unit_number, CASE WHEN coalesce(l.unit_number, 0) <> 0 OR src IS NULL THEN l.unit_title_ar ELSE s.unit_title_ar END AS unit_title_ar FROM l LEFT JOIN pages_ s ON s.book = l.book AND s.page_number = src""",
    "block_ids": f"WITH {BLOCKS} SELECT block_id, chunk_id, page_number AS page FROM chunks_",
    "chunk_confidence": f"""WITH {BLOCKS}, v AS (SELECT page_number, block_index, greatest(0, 1.0::DOUBLE - CASE WHEN page_number % 5 > 0 THEN 0 ELSE 0.2 END::DOUBLE - CASE WHEN unit_number IS NULL THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN length(text_ar) < 50 THEN 0.2 ELSE 0 END::DOUBLE) AS c FROM chunks_) SELECT page_number, block_index, round(c, 6) AS confidence, c < 0.6::DOUBLE AS low FROM v""",
    "embedding_text": f"WITH {BLOCKS} SELECT page_number, block_index, md5({_cut(5400, '…')}) AS text_md5 FROM chunks_",
    "embedding_text_truncated": f"WITH {BLOCKS} SELECT page_number, block_index, {_cut(120, '…')} AS text, length(rep) > 120 AS truncated FROM chunks_",
    "block_chunks": f"WITH {BLOCKS} SELECT chunk_id, block_id AS source_block_id, content_type, has_diagram, len(math) > 0 AS has_math, content_type = 'other' AS is_other, CASE WHEN k % 10 = 0 THEN 'S' || k % 3 ELSE '' END AS standards, array_to_string(math, '|') AS math FROM chunks_",
    "merge_blocks_simple": MERGED,
    "diagram_lookup": f"WITH {BLOCKS} SELECT book, page_number, block_index, CASE WHEN page_number % 2 = 0 THEN 'u/' || page_number || '/2|u/' || page_number || '/1' ELSE '' END AS urls FROM chunks_",
    "bbox_normalise": f"""WITH {BLOCKS}, b AS (SELECT page_number, block_index, list_transform([11, 7, 17, 13], lambda m: greatest(0, least(1, (k * m % 1100) / 1000))::DOUBLE) AS v FROM chunks_ WHERE has_diagram),
c AS (SELECT page_number, block_index, v[1] AS x1, v[2] AS y1, v[3] AS x2, v[4] AS y2 FROM b WHERE v[1] < v[3] AND v[2] < v[4]),
d AS (SELECT *, greatest(0, floor(x1 * 1000)::INT - 12) AS "left", greatest(0, floor(y1 * 2000)::INT - 12) AS top, least(1000, floor(x2 * 1000)::INT + 12) AS "right", least(2000, floor(y2 * 2000)::INT + 12) AS bottom FROM c)
SELECT page_number, block_index, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, "left", top, "right", bottom FROM d WHERE "left" < "right" AND top < bottom""",
    "index_metadata": f"WITH {BLOCKS} SELECT chunk_id, page_number AS page_range_start, page_number AS page_range_end, coalesce(unit_number, 0) AS unit_number, lesson_number, {_cut(200, '...')} AS content_text_ar, content_type, has_diagram, k::VARCHAR AS problem_numbers, 1::INT AS source_block_count FROM chunks_",
    "ordered_union": f"""WITH {BLOCKS}, u AS (SELECT page_number, block_index, list_concat(math, [k::VARCHAR, 'A']) AS l FROM chunks_) SELECT page_number, block_index, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS united FROM u""",
    "block_table": f"WITH {BLOCKS} SELECT book, page_number, block_index, content_type, length(text_ar) AS n_chars FROM chunks_ WHERE content_type <> 'other'",
    "sample_blocks": f"WITH {BLOCKS} SELECT page_number || '-' || block_index AS block_id, content_type FROM chunks_ ORDER BY sha256('7|' || page_number || '-' || block_index), block_id LIMIT 50",
    "lexical_topk": f"WITH {LEXICAL} SELECT * FROM hits",
    "dense_topk": """SELECT qa_id, chunk_id, rank, round(s, 6) AS score FROM (SELECT q.vec_id AS qa_id, v.vec_id AS chunk_id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, v.vec_id)::INT AS rank FROM
  (SELECT a.vec_id AS qv, b.vec_id AS cv, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) x
  JOIN embeddings q ON q.vec_id = qv JOIN embeddings v ON v.vec_id = cv) WHERE rank <= 5""",
    "lexical_hits": f"WITH {LEXICAL} SELECT qa_id, rank, chunk_id, score, length(text) AS n_chars, lang FROM hits LEFT JOIN documents ON doc_id = chunk_id",
    "retrieval_scores": f"{SCORED} SELECT qa_id, question_type, first_rank, round(rr, 6) AS reciprocal_rank, hit_at_1, hit_at_5, recall FROM scored",
    "window_unions": f"""WITH {BLOCK_SEGMENTS}, {STREAM}, m AS (SELECT DISTINCT stream_id, "window", page_number, regexp_extract(block_id, '-b([0-9]+)$', 1)::INT AS i FROM inwin),
n AS (SELECT *, page_number + i AS k, page_number * 1048576 + i AS place FROM m),
u AS (SELECT stream_id, "window", string_agg(v, '|' ORDER BY place) AS urls FROM (SELECT stream_id, "window", 'u/' || page_number AS v, min(place) AS place FROM n WHERE k % 4 = 0 GROUP BY ALL) GROUP BY ALL),
s AS (SELECT stream_id, "window", string_agg(v, '|' ORDER BY place) AS standards FROM (SELECT stream_id, "window", 'S' || (k % 3) AS v, min(place) AS place FROM n WHERE k % 10 = 0 GROUP BY ALL) GROUP BY ALL)
SELECT stream_id, "window", coalesce(any_value(urls), '') AS urls, coalesce(any_value(standards), '') AS standards, bool_or(k % 4 = 0) AS has_diagram, bool_or(k % 5 = 0) AS has_math FROM n LEFT JOIN u USING (stream_id, "window") LEFT JOIN s USING (stream_id, "window") GROUP BY ALL""",
    "retrieval_summary_full": f"""{CONTEXT}, {SCORED[len(f"WITH {LEXICAL}, ") :]}, z AS (SELECT scored.*, coalesce(token_count, 0) AS tc FROM scored LEFT JOIN ctx USING (qa_id))
SELECT (CASE WHEN question_type IS NULL THEN 0 ELSE list_position({_list(QUESTION_TYPES)}, question_type) END)::INT AS position, coalesce(question_type, 'overall') AS question_type, {_MEANS},
  round(avg(tc), 6) AS context_tokens_mean, sum(tc)::BIGINT AS context_tokens, sum(mapped)::BIGINT AS with_gold, (count(*) - sum(mapped))::BIGINT AS without_gold FROM z GROUP BY ROLLUP (question_type)""",
    "unexpected_types": f"WITH {TURNS} SELECT question_type, count(*) AS n FROM tu WHERE question_type NOT IN {_in(QUESTION_TYPES)} GROUP BY ALL",
    "report_integrity": """WITH c AS (SELECT count(*) FILTER (item_id % 17 = 0) AS other, count(*) FILTER (item_id % 13 = 0) AS twice, count(*) FILTER (item_id % 9 = 0) AS gone, count(*) FILTER (item_id % 11 = 0 AND item_id % 9 <> 0) AS types FROM benchmark)
SELECT unnest(['summary_for_each_system', 'records_are_labelled', 'counts_agree', 'ids_are_there', 'ids_are_unique', 'ids_are_the_same', 'types_agree', 'one_top_k']) AS "check",
  unnest([0, other, (twice > 0)::INT + (gone > 0)::INT, 0, twice, gone, types, 0])::BIGINT AS n_failures FROM c""",
    "judge_integrity": """SELECT unnest(['no_other_system', 'every_system', 'dimensions', 'one_budget']) AS "check", unnest([0, 1, 1, 1])::BIGINT AS n_failures""",
    "qa_reply_candidates": f"""WITH t AS (SELECT 'task-' || conv_id || '-' || turn AS task, conv_id % 7 = 0 AS down, (conv_id + turn) % 6 AS k, {_list(QUESTION_TYPES)}[((conv_id + turn) % 5 + 1)::INT] AS question_type, md5(text) AS m FROM conversations),
g AS (SELECT *, NOT down AND k IN (0, 1, 5) AS good FROM t)
SELECT task || '-c0' AS candidate_id, question_type, CASE WHEN good THEN 'Q ' || m END AS question, CASE WHEN good AND k = 0 THEN 'A' END AS answer, CASE WHEN good THEN CASE k WHEN 0 THEN 'hard' ELSE 'easy' END END AS difficulty,
  CASE WHEN good THEN CASE k WHEN 5 THEN 'reasoning' ELSE 'extractive' END END AS answer_mode, CASE WHEN good THEN k = 5 END AS required_diagram, CASE WHEN good THEN k = 0 END AS required_formula,
  CASE WHEN down THEN 'down' WHEN k = 2 THEN 'empty response' WHEN k = 3 THEN 'json decode error' WHEN k = 4 THEN 'response was not a JSON object' END AS parse_error,
  CASE WHEN down THEN 'generation_failed' WHEN good THEN 'generated' ELSE 'parse_failed' END AS status FROM g""",
    "qa_unanswered": f"SELECT 'task-' || conv_id || '-' || turn AS task_id, 'theorem_statement' AS question_type FROM conversations WHERE conv_id % 7 <> 0 AND {_list(QUESTION_TYPES)}[((conv_id + turn) % 5 + 1)::INT] = 'theorem_statement'",
    "qa_evidence": f"""WITH {BLOCKS} SELECT page_number, block_index, md5('Ask.' || chr(10) || chr(10) || '--- Source ---' || chr(10) || concat_ws(chr(10), 'Lesson: ' || {strip("lesson_number || ' ' || lesson_title_ar")}, 'Content type: ' || content_type, 'Heading: ' || heading_ar, 'Text:' || chr(10) || {strip("text_ar")})) AS text_md5, true AS ends FROM chunks_""",
    "retrieval_summary": f"{SCORED} SELECT {_MEANS} FROM scored",
    "retrieval_summary_by_type": f"{SCORED} SELECT coalesce(question_type, 'overall') AS question_type, {_MEANS} FROM scored GROUP BY ROLLUP (question_type)",
    "top_k_misses": f"{SCORED} SELECT qa_id, question_type FROM scored WHERE NOT hit_at_5",
    "gold_recall_targets": f"{SCORED} SELECT qa_id, mapped::BIGINT AS n_targets, covered::BIGINT AS n_covered, recall, CASE WHEN mapped = 0 THEN qa_id::VARCHAR ELSE '' END AS unresolved FROM scored",
    "rank_outcomes": f"{TWO} SELECT system, count(*) FILTER (first_rank = 1) AS rank_1, count(*) FILTER (first_rank BETWEEN 2 AND 5) AS rank_2_to_k, count(*) FILTER (first_rank IS NULL) AS missed FROM s GROUP BY system",
    "paired_questions": f"{TWO} SELECT qa_id, round(max(rr) FILTER (system = 'proposed'), 6) AS proposed, round(max(rr) FILTER (system = 'b2'), 6) AS b2 FROM s GROUP BY qa_id",
    "unit_deltas": f"""{TWO}, g AS (SELECT system, question_type, round(avg(rr), 6) AS x, round(avg(hit5::INT), 6) AS y FROM s GROUP BY ALL), m AS (SELECT system, question_type, 'mrr' AS metric, x AS v FROM g UNION ALL SELECT system, question_type, 'hit_at_5', y FROM g)
SELECT a.question_type, a.metric, a.v AS a, b.v AS b, round(a.v - b.v, 6) AS difference FROM m a JOIN m b ON a.question_type = b.question_type AND a.metric = b.metric AND a.system = 'proposed' AND b.system = 'b2'""",
    "set_consistency": "SELECT item_id AS qa_id, 1::BIGINT AS n, 1::BIGINT AS n_systems, 1::BIGINT AS n_types FROM benchmark WHERE item_id % 9 = 0",
    "gold_block_match": f"{COVER} SELECT qa_id, target_id, chunk_id, round(coverage, 6) AS coverage, CASE WHEN chunk_id IS NOT NULL THEN 'block_match' END AS basis FROM gq LEFT JOIN (SELECT * FROM cover WHERE coverage >= 0.99) c ON block_id = target_id",
    "gold_coverage_match": f"{COVER} SELECT qa_id, target_id, chunk_id, round(coverage, 6) AS coverage, 'coverage' AS basis FROM hit",
    "gold_coverage_fallback": f"""{COVER}, miss AS (SELECT gq.* FROM gq LEFT JOIN hit USING (qa_id, target_pos) WHERE hit.chunk_id IS NULL) SELECT qa_id, miss.target_id, prange.chunk_id, NULL::DOUBLE AS coverage, CASE WHEN prange.chunk_id IS NOT NULL THEN 'page_overlap_fallback' END AS basis FROM miss LEFT JOIN prange ON low = coalesce(try_cast(nullif(regexp_extract(miss.target_id, '-p(\\d+)-b\\d+$', 1), '') AS INT), page)""",
    "gold_page_overlap": f"{COVER} SELECT d.doc_id AS qa_id, d.doc_id::VARCHAR AS target_id, chunk_id, CASE WHEN chunk_id IS NOT NULL THEN 'page_overlap_proxy' END AS basis FROM documents d LEFT JOIN prange ON low = d.doc_id",
    "gold_unmapped": f"{COVER} SELECT qa_id, target_id, 'high' AS severity FROM gq WHERE target_id NOT IN (SELECT block_id FROM cover WHERE coverage >= 0.99)",
    "gold_status": f"""{COVER} SELECT qa_id, count(*) AS n_targets, count(b)::BIGINT AS n_mapped, CASE WHEN count(b) = count(*) THEN 'complete' ELSE 'incomplete' END AS mapping_status FROM gq LEFT JOIN (SELECT DISTINCT block_id AS b FROM cover WHERE coverage >= 0.99) ON b = target_id GROUP BY qa_id""",
    "context_assembly": f"{CONTEXT} SELECT qa_id, chunk_ids, token_count, truncated, char_count, (char_count + 2) // 3 AS estimated_tokens FROM ctx",
    "context_verification": f"""{CONTEXT} SELECT qa_id, CASE WHEN qa_id % 7 = 0 THEN 'no_record' WHEN qa_id % 5 = 0 AND contains(chunk_ids, '|') THEN 'chunks_differ' WHEN qa_id % 3 = 0 THEN 'tokens_differ' ELSE 'verified_recorded_generator_context' END AS context_source FROM ctx""",
    "mock_answer": f"SELECT conv_id, turn, CASE WHEN turn % 4 > 0 AND len({tokens('text')}) > 0 THEN array_to_string(list_slice({tokens('text')}, 1, 40), ' ') ELSE 'لا يوجد في السياق المُقدَّم.' END AS answer FROM conversations",
    "qa_eligibility": f"WITH {BLOCKS}, {FLAGS} SELECT chunk_id, {', '.join(f'is_{t}' for t in QUESTION_TYPES)} FROM flags",
    "qa_selection": _selection(),
    "qa_mock_candidates": f"WITH {BLOCKS}, {FLAGS}, {CANDIDATES} SELECT candidate_id, question_type, question, md5(answer) AS answer_md5, answer_mode, required_diagram, required_formula FROM cand",
    "qa_validation": f"WITH {BLOCKS}, {FLAGS}, {CANDIDATES}, {_validated('cand')} SELECT candidate_id, rejection_reason FROM va",
    "qa_rejections": f"WITH {TURNS}, {_validated('tu')} SELECT candidate_id, rejection_reason FROM va WHERE rejection_reason IS NOT NULL",
    "qa_dedup": f"SELECT md5({comparable('text')}) AS key_md5, min(conv_id * 1000 + turn) AS kept, count(*) AS n FROM conversations GROUP BY 1",
    "qa_finalize": f"WITH {BLOCKS}, {FLAGS}, {CANDIDATES}, {_validated('cand')}, {FINAL}",
    "qa_value_counts": f"WITH {BLOCKS} SELECT content_type AS value, count(*) AS n FROM chunks_ GROUP BY ALL",
    "judge_dimensions": f"WITH {ITEMS} SELECT qa_id, system, unnest(CASE WHEN {strip(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')} <> '' THEN {_list(DIMENSIONS)} ELSE {_list(DIMENSIONS[:2])} END) AS metric FROM it",
    "judge_mock_scores": f"""WITH {ITEMS}, d AS (SELECT *, unnest({_list(DIMENSIONS)}) AS metric FROM it),
p AS (SELECT *, metric IN ('faithfulness', 'answer_relevancy') AS na, metric <> 'answer_relevancy' AS nc, metric LIKE 'context%' AS nr, {strip("coalesce(answer, '')")} = '' AS ba, {strip("coalesce(context, '')")} = '' AS bc FROM d),
s AS (SELECT *, CASE WHEN na AND ba THEN 'skipped_no_generated_answer' WHEN nc AND bc THEN 'skipped_no_context' ELSE 'scored' END AS judge_status,
  concat_ws(chr(10), 'Dimension: ' || metric, 'Question: What is said?', CASE WHEN nr THEN 'Reference: ' || reference END, CASE WHEN nc THEN 'Contexts: ' || CASE WHEN bc THEN '(none)' ELSE context END END, CASE WHEN na THEN 'Answer: ' || CASE WHEN ba THEN '(none)' ELSE answer END END) AS prompt FROM p)
SELECT qa_id, metric, judge_status, CASE WHEN judge_status = 'scored' THEN (('0x' || substr(sha256(prompt), 1, 8))::UBIGINT % 1001) / 1000 END::DOUBLE AS score FROM s""",
    "judge_parse": f"WITH {RECORDS}, x AS (SELECT line, {PARSED} FROM rec) SELECT line, status AS judge_status, value AS score FROM x",
    "judge_parse_balanced": f"WITH {RECORDS}, x AS (SELECT line, {PARSED} FROM rec) SELECT line, status AS judge_status, value AS score FROM x",
    "judge_ledger": f"{LEDGER} SELECT qa_id, system, metric, line, judge_status, score FROM led",
    "judge_pending": f"{LEDGER} SELECT DISTINCT qa_id, system, metric FROM rec EXCEPT SELECT qa_id, system, metric FROM led",
    "ledger_merge": f"{LEDGER} SELECT qa_id, system, metric, line, CASE WHEN line % 2 = 0 THEN 1.0 ELSE score END::DOUBLE AS score FROM led WHERE line % 3 > 0 OR line % 2 = 0",
    "judge_recover": f"WITH {RECORDS}, x AS (SELECT *, {PARSED} FROM rec) SELECT line, CASE WHEN judge_status = 'parse_error' AND status IN ('scored', 'recovered') THEN 'recovered' ELSE judge_status END AS judge_status, CASE WHEN judge_status = 'parse_error' AND status IN ('scored', 'recovered') THEN value ELSE score END AS score FROM x",
    "judge_summary": f"WITH {RECORDS} SELECT system, metric, {_STATS}, count(DISTINCT qa_id) AS n_questions FROM rec GROUP BY ALL",
    "judge_by_field": f"WITH {RECORDS} SELECT coalesce(nullif(role, ''), 'unknown') AS value, metric, {_STATS} FROM rec GROUP BY ALL",
    "judge_context_stats": f"""WITH {RECORDS}, o AS (SELECT system, qa_id, min_by(context_token_count, line) AS c, min_by(context_truncated, line) AS x FROM rec GROUP BY ALL)
SELECT r.system, retries, mean_tokens, max_tokens, n_truncated, truncation_rate FROM (SELECT system, sum(retries_used)::BIGINT AS retries FROM rec GROUP BY system) r JOIN (SELECT system, round(avg(c), 6) AS mean_tokens, max(c) AS max_tokens, count(*) FILTER (x) AS n_truncated, round(avg(x::INT), 6) AS truncation_rate FROM o GROUP BY system) s USING (system)""",
    "paired_differences": f"WITH {MOCK_PAIRS} SELECT qa_id, metric, round(difference, 6) AS difference FROM dif",
    "paired_bootstrap": f"""WITH {MOCK_PAIRS}, l AS (SELECT list(difference ORDER BY qa_id) AS d FROM dif),
b AS (SELECT len(d) AS n, unnest(range(2000)) AS b FROM l),
r AS (SELECT b, n, unnest(range(n)) AS i FROM b),
w AS (SELECT b, (('0x' || substr(sha256('7-' || b || '-' || i), 1, 8))::UBIGINT % n + 1)::BIGINT AS j FROM r),
x AS (SELECT row_number() OVER (ORDER BY qa_id) AS j, difference FROM dif),
m AS (SELECT b, sum(difference) / count(*) AS m FROM w JOIN x USING (j) GROUP BY b),
o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m)
SELECT 'context_recall' AS metric, (SELECT len(d) FROM l) AS n, (SELECT round(list_avg(d), 6) FROM l) AS mean, round(max(m) FILTER (r = 50), 6) AS lower, round(max(m) FILTER (r = 1949), 6) AS upper FROM o""",
    "cer_blocks": f"WITH {CER} SELECT conv_id, turn, edits, length, round(edits / length, 6) AS cer FROM e",
    "cer_summary": f"WITH {CER} SELECT role, count(*) AS n, round(sum(edits) / sum(length), 6) AS micro_cer, round(avg(edits / length), 6) AS macro_cer FROM e GROUP BY role",
}
