"""Plain SQL for the registered queries, for another engine to check them by."""

from __future__ import annotations

from functools import reduce

from screenloom.functions import activity as A
from screenloom.functions import html as H
from screenloom.functions import text as T
from screenloom.functions import web as W
from screenloom.operators import answers as N
from screenloom.operators import captures as C
from screenloom.operators import log as L
from screenloom.operators import text as X
from screenloom.operators import web as B
from screenloom.sources.tables import with_views

ORACLES: dict[str, str] = {}


def q(value: str) -> str:
    """A string literal; line ends by code, as some engines read none."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return parts[0] if len(parts) == 1 else "concat(" + ", chr(10), ".join(parts) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def has(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {q(n)})" for n in needles) + ")"


def pick(x: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(x, needles)} THEN {q(name)}" for name, needles in rules) + f" ELSE {q(otherwise)} END"


def clean(x: str) -> str:
    out = reduce(lambda t, p: f"regexp_replace({t}, {q('(?mi)' + p)}, '', 'g')", T.NOISE, x)
    lines = f"list_filter(list_transform(string_split({out}, chr(10)), lambda l: {strip('l')}), lambda l: length(l) > 5 AND regexp_matches(l, '[a-zA-Z]{{3}}'))"
    out = rf"regexp_replace(array_to_string({lines}, ' '), '\s+([.,!?])', '\1', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '([.,!?])', '\1 ', 'g'), '([.,!?]) (\s|$)', '\1\2', 'g')"
    return strip(out)


def sentence_list(x: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"


def words(x: str) -> str:
    return rf"CAST(len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')) AS BIGINT)"


ASKS = r"(^|[^\p{L}\p{N}_])(?i:who|what|when|where|why|how)([^\p{L}\p{N}_]|$)|[?]"
URLS = f"regexp_extract_all(text, {q(W.URL)})"
KINDS = "list_filter([" + ", ".join(f"CASE WHEN {has('text', w)} THEN {q(n)} END" for n, w in W.CATEGORIES) + "], lambda c: c IS NOT NULL)"


def add(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views)


# --- scans and sinks
add("scan_log", "SELECT * FROM actions", "actions")
add("append_action", "SELECT id, CAST(ts_s AS DOUBLE) AS timestamp, action_type, application, description, coalesce(metadata, '{}') AS metadata FROM actions", "actions")
ORACLES["stream_log_sink"] = ORACLES["append_action"]
add(
    "store_context",
    f"""SELECT capture_id, CAST(ts_s AS DOUBLE) AS timestamp, process_name, window_title, substr(text, 1, 500) AS content_summary,
  concat('Visible Text: ', text, chr(10), 'Hidden Text: ', chr(10), 'UI Elements: []', chr(10), 'File Paths: ', chr(10),
    'URLs: ', array_to_string({URLS}, ', '), chr(10), 'Recent Actions: ') AS full_content,
  CAST(memory_usage AS BIGINT) AS memory_usage, cpu_percent FROM captures""",
    "captures",
)
add(
    "report_with_notes",
    """WITH kept AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, response_text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM responses) WHERE back <= 5),
sections AS (
  SELECT conv_id, idx, list_concat([concat('Response ', CAST(idx AS VARCHAR), ':')], string_split(response_text, chr(10))) AS lines FROM kept
  UNION ALL SELECT n.conv_id, coalesce(k.n, 0) + 1, list_concat(['User Notes'], string_split(n.t, chr(10)))
  FROM (SELECT conv_id, """ + strip("notes") + """ AS t FROM notes) n LEFT JOIN (SELECT conv_id, count(*) AS n FROM kept GROUP BY conv_id) k ON k.conv_id = n.conv_id WHERE n.t <> '')
SELECT conv_id, idx, line_no, regexp_replace(l, '[^\\x{00}-\\x{FF}]', '?', 'g') AS line FROM (
  SELECT conv_id, idx, unnest(lines) AS l, CAST(unnest(range(len(lines))) AS INTEGER) AS line_no FROM sections)""",
    "responses", "notes",
)
for _name, _keep in (("report_lines", "WHERE back <= 5"), ("report_lines_all", "")):
    add(
        _name,
        f"""SELECT conv_id, idx, line_no, regexp_replace(l, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g') AS line FROM (
  SELECT conv_id, idx, unnest(lines) AS l, CAST(unnest(range(len(lines))) AS INTEGER) AS line_no FROM (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, lines_ AS lines0,
      list_concat([concat('Response ', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), ':')], lines_) AS lines FROM (
      SELECT conv_id, turn, string_split(response_text, chr(10)) AS lines_, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM responses)
    {_keep}))""",
        "responses",
    )

# --- text
add("clean_text", f"SELECT capture_id, {clean('text')} AS cleaned FROM captures", "captures")
add(
    "clean_lines",
    f"""SELECT capture_id, CASE WHEN t = '' THEN {q(T.NOTHING_LEFT)} ELSE t END AS cleaned FROM (
  SELECT capture_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}),
    lambda l: length(l) >= 5 AND regexp_matches(l, '[a-zA-Z0-9]')), chr(10)) AS t FROM captures)""",
    "captures",
)
add("split_sentences", f"SELECT capture_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT capture_id, {sentence_list('c')} AS s FROM (SELECT capture_id, {clean('text')} AS c FROM captures))", "captures")
add("word_count", f"SELECT capture_id, {words('text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM captures", "captures")
add("has_questions", f"SELECT capture_id FROM captures WHERE regexp_matches({clean('text')}, {q(ASKS)})", "captures")
add(
    "extract_questions",
    f"""SELECT capture_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS question FROM (
  SELECT capture_id, list_filter({sentence_list('text')}, lambda x: regexp_matches(x, {q(ASKS)})) AS s FROM captures)""",
    "captures",
)
add(
    "process_text",
    f"""SELECT capture_id, text AS original, c AS cleaned, CAST(len({sentence_list('c')}) AS BIGINT) AS sentences, {words('c')} AS word_count,
  regexp_matches(c, {q(ASKS)}) AS has_questions FROM (SELECT capture_id, text, {clean('text')} AS c FROM captures)""",
    "captures",
)
add(
    "corpus_text_stats",
    f"""SELECT source, count(*) AS docs, CAST(sum({words('c')}) AS BIGINT) AS words, count(*) FILTER (WHERE regexp_matches(c, {q(ASKS)})) AS asking,
  CAST(sum(len({sentence_list('c')})) AS BIGINT) AS sentences FROM (SELECT source, {clean('text')} AS c FROM captures) GROUP BY source""",
    "captures",
)
_KIND = f"CASE WHEN contains(%s, '?') OR {has('%s', T.ASKING + T.REQUESTS)} THEN 'question' ELSE 'summary' END"
add("route_prompt", f"SELECT capture_id, {_KIND.replace('%s', 'text')} AS kind, CASE WHEN contains(text, '?') THEN 'question' ELSE 'summary' END AS older_kind FROM captures", "captures")
add(
    "capture_outcome",
    f"SELECT source, CASE WHEN {strip('text')} = '' THEN 'no_text' WHEN {clean('text')} = '' THEN 'nothing_left' ELSE 'analysed' END AS outcome, count(*) AS n FROM captures GROUP BY ALL",
    "captures",
)
add(
    "build_prompt",
    f"""SELECT capture_id, kind, concat(CASE WHEN kind = 'question' THEN {q(X.QUESTION_PROMPT)} ELSE {q(X.SUMMARY_PROMPT)} END, t) AS prompt FROM (
  SELECT capture_id, t, {_KIND.replace('%s', 't')} AS kind FROM (
    SELECT capture_id, replace(replace(text, 'filepath:', ''), concat('PS C:', chr(92), '>'), '') AS t FROM captures))""",
    "captures",
)
_BROWSING = f"CASE WHEN {has('text', ('search', 'google', 'results'))} THEN 'Web Search' WHEN {has('text', ('email', 'gmail', 'inbox'))} THEN 'Email' WHEN {has('text', ('youtube', 'video', 'play'))} THEN 'Video Streaming' ELSE 'Web Browsing' END"
_APPS = (
    (("chrome", "firefox", "edge"), "'Web Browser'", _BROWSING),
    (("code", "visual", "studio"), "'Development Environment'", "'Programming'"),
    (("word", "notepad"), "'Document Editor'", "'Document Editing'"),
    (("excel", "calc"), "'Spreadsheet'", "'Data Analysis'"),
    (("outlook", "mail"), "'Email Client'", "'Email Management'"),
)
_TEXTS = (
    (("http", "www"), "'Web Content'", "'General'"),
    (("function", "class", "import", "def", "var", "const"), "'Source Code'", "'Programming'"),
    (("document", "paragraph", "chapter", "section"), "'Document'", "'Reading/Writing'"),
)


def _cascade(k: int, otherwise: str) -> str:
    parts = [f"WHEN {has('process_name', r[0])} THEN {r[k]}" for r in _APPS] + [f"WHEN {has('text', r[0])} THEN {r[k]}" for r in _TEXTS]
    return "CASE " + " ".join(parts) + f" ELSE {otherwise} END"


_DETECTED = f"(SELECT *, {_cascade(1, repr('Unknown'))} AS content_type, {_cascade(2, repr('General'))} AS activity_type FROM captures)"
_SCORE = "CASE " + " ".join(f"WHEN activity_type IN ({', '.join(map(q, names))}) THEN {s}" for s, names in A.SCORES) + " ELSE 4 END"
_PERIOD = "CASE WHEN (ts_s // 3600) % 24 < 12 THEN 'Morning' WHEN (ts_s // 3600) % 24 < 18 THEN 'Afternoon' ELSE 'Evening' END"
add(
    "activity_prompt",
    "SELECT capture_id, activity_type, CASE "
    + " ".join(f"WHEN activity_type IN ({', '.join(map(q, names))}) THEN concat({q(lead)}, substr(text, 1, {n}))" for names, lead, n in X.INSIGHT)
    + f" ELSE concat({q(X.OTHER_INSIGHT[0])}, substr(text, 1, {X.OTHER_INSIGHT[1]})) END AS prompt FROM {_DETECTED}",
    "captures",
)
add("preview", "SELECT capture_id, CASE WHEN length(text) > 150 THEN concat(substr(text, 1, 150), '...') ELSE text END AS short, concat(substr(text, 1, 500), '...') AS always FROM captures", "captures")

# --- web


#: A page without what is hidden, and without templates, which hold no template here.
_SEEN = rf"regexp_replace(html, {q('(?is)' + H.hidden('') + '|(' + H.tag(hold='') + ')')}, concat('\1', chr(1)), 'g')"
_BARE_TEMPLATES = rf"regexp_replace(seen, {q('(?is)<template[ />].*?</template[ />]|<template>.*?</template>')}, chr(1), 'g')"
#: Names of characters as a table of one row, for the queries that decode.
_NAMES = "(SELECT MAP(string_split(" + ", chr(3)), string_split(".join(q(chr(3).join(side)) for side in (H.NAMES.keys(), H.NAMES.values())) + ", chr(3))) AS names) names"
_WESTERN = "[" + ", ".join(f"chr({ord(c)})" for c in H.WESTERN.values()) + "]"


def _number(x: str, base: int) -> str:
    digits = rf"ltrim(regexp_extract({x}, '^&#[xX]?([0-9a-fA-F]+)', 1), '0')"
    n = f"CAST(CASE WHEN length({digits}) > 7 THEN 1114112 WHEN {digits} = '' THEN 0 ELSE " + (f"CAST({digits} AS INT)" if base == 10 else f"CAST(concat('0x', {digits}) AS INT)") + " END AS INT)"
    return f"""list_transform([{n}], lambda n: CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n = 13 THEN chr(13)
      WHEN n BETWEEN 128 AND 159 THEN {_WESTERN}[n - 127] WHEN n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n = 11 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' ELSE chr(n) END)[1]"""


def _decode(x: str, closed_only: bool = False) -> str:
    bare = f"regexp_extract(t, '^&({H.BARE})', 1)"
    name = f"coalesce(names[substr(t, 2)], CASE WHEN {bare} <> '' THEN concat(names[{bare}], substr(t, length({bare}) + 2)) END, t)"
    name = f"CASE WHEN ends_with(t, ';') THEN {name} ELSE t END" if closed_only else name
    one = f"CASE WHEN regexp_matches(t, '^&#[xX]') THEN {_number('t', 16)} WHEN starts_with(t, '&#') THEN {_number('t', 10)} WHEN regexp_matches(t, '^&[A-Za-z]') THEN {name} ELSE t END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, {q(H.REFERENCE)}), lambda t: {one}), '')"


def _attributes(tag: str, name: str) -> str:
    found = f"list_filter(regexp_extract_all(seen, {q('(?is)' + H.tag(hold=''))}), lambda t: regexp_matches(t, '(?i)^<{tag}[ />]'))"
    own = f"list_transform({found}, lambda t: list_filter(regexp_extract_all(t, {q(H.ATTRIBUTE)}), lambda x: regexp_matches(x, {q(H.attribute(name))}))[-1])"
    value = rf"""regexp_replace(x, {q(rf"""(?is)^{name}(?:\s*=\s*(?:"(.*)"|'(.*)'|(.*)))?$""")}, '\1\2\3')"""
    return f"list_transform(list_filter({own}, lambda x: x IS NOT NULL), lambda x: {_decode(value, True)})"


_PAGES = f"(SELECT page_id, url, {_SEEN} AS seen FROM web_pages), {_NAMES}"
_BEGIN = q("(?is)" + H.tag("title", "", ""))
_OWN = f"replace(regexp_extract(seen, {q('(?is)' + H.tag('title', '', '') + '([^<]*)</title[ />]')}, 1), chr(1), '')"
_TITLE = f"CASE WHEN seen IS NULL THEN NULL WHEN regexp_matches(seen, {_BEGIN}) THEN CASE WHEN {_OWN} <> '' THEN {_decode(_OWN)} END ELSE 'No title' END"
_TEXT = f"replace({_decode(f'regexp_replace({_BARE_TEMPLATES}, {q("(?is)" + H.tag(hold=""))}, chr(1), {q("g")})')}, chr(1), '')"
add(
    "extract_page",
    f"""SELECT page_id, url, {_TITLE} AS title, CASE WHEN seen IS NOT NULL THEN concat(substr({_TEXT}, 1, 2000), '...') END AS text_content, array_to_string({_attributes('a', 'href')}[1:10], chr(10)) AS links,
  array_to_string({_attributes('img', 'src')}[1:5], chr(10)) AS images, seen IS NOT NULL AS success, CASE WHEN seen IS NULL THEN {q(B.NOT_STORED)} END AS error FROM {_PAGES}""",
    "web_pages",
)
add("page_links", f"SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS href FROM (SELECT page_id, {_attributes('a', 'href')} AS l FROM {_PAGES})", "web_pages")
add("find_urls", f"SELECT capture_id, CAST(unnest(range(len(u))) AS INTEGER) AS pos, unnest(u) AS url FROM (SELECT capture_id, {URLS} AS u FROM captures)", "captures")
_WEB = has("text", W.WEB_SIGNS)
add("is_web_content", f"SELECT capture_id, {_WEB} AS is_web, CASE WHEN {_WEB} THEN 'web_browser' ELSE 'unknown' END AS content_type FROM captures", "captures")
add("content_categories", f"SELECT capture_id, CAST(unnest(range(len(k))) AS INTEGER) AS pos, unnest(k) AS category FROM (SELECT capture_id, {KINDS} AS k FROM captures)", "captures")
add("category_counts", f"SELECT category, count(*) AS n FROM (SELECT unnest({KINDS}) AS category FROM captures) GROUP BY category", "captures")
add(
    "analyze_web",
    f"""SELECT capture_id, ok AS success, CASE WHEN NOT ok THEN {q(B.NO_CONTENT)} END AS analysis, CASE WHEN ok THEN w END AS word_count,
  CASE WHEN ok THEN CASE WHEN web THEN 'web_browser' ELSE 'unknown' END END AS content_type, CASE WHEN ok THEN len(u) > 0 END AS has_urls,
  CASE WHEN ok THEN CAST(len(u) AS BIGINT) END AS url_count, CASE WHEN ok THEN array_to_string(u[1:5], '|') END AS urls, CASE WHEN ok THEN web END AS is_web_content,
  CASE WHEN ok THEN array_to_string(k, '|') END AS categories,
  CASE WHEN ok THEN round(least(1.0::DOUBLE, 0.2::DOUBLE + CASE WHEN w > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(u) > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN web THEN 0.3::DOUBLE ELSE 0 END), 6) ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN ok THEN CASE WHEN web THEN concat('Web content detected with ', CAST(w AS VARCHAR), ' words', CASE WHEN len(u) > 0 THEN concat(' and ', CAST(len(u) AS VARCHAR), ' URLs') ELSE '' END,
    CASE WHEN len(k) > 0 THEN concat('. Categories: ', array_to_string(k, ', ')) ELSE '' END) ELSE concat('Non-web content with ', CAST(w AS VARCHAR), ' words') END END AS summary
FROM (SELECT capture_id, capture_id % 13 <> 5 AS ok, {words('text')} AS w, {URLS} AS u, {KINDS} AS k, {_WEB} AS web FROM captures)""",
    "captures",
)
add(
    "first_url_page",
    f"SELECT c.capture_id, c.url, p.page_id, p.title FROM (SELECT capture_id, ({URLS})[1] AS url FROM captures) c LEFT JOIN (SELECT url, page_id, {_TITLE} AS title FROM {_PAGES}) p ON p.url = c.url",
    "captures", "web_pages",
)

# --- ordered captures
_SIMILAR = """pairs AS (SELECT seq_id, position, vec, lag(vec) OVER (PARTITION BY seq_id ORDER BY position) AS b FROM frames),
likeness AS (SELECT seq_id, position, round(coalesce((SELECT CASE WHEN isnan(r) OR isinf(r) THEN 0 ELSE r END FROM (
    SELECT corr(x, y) AS r FROM (SELECT CAST(unnest(vec) AS DOUBLE) AS x, CAST(unnest(b) AS DOUBLE) AS y))), 0), 6) AS similarity FROM pairs)"""
add("similarity_to_previous", f"WITH {_SIMILAR} SELECT * FROM likeness", "frames")
add(
    "stream_change",
    f"WITH {_SIMILAR} SELECT seq_id, position, similarity, similarity > 0.95 AND row_number() OVER (PARTITION BY seq_id ORDER BY position) > 1 AS stop FROM likeness",
    "frames",
)
add(
    "capture_until_stop",
    f"""WITH {_SIMILAR}, placed AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY position) AS k FROM likeness),
marked AS (SELECT *, coalesce(max(CAST(similarity > 0.95 AND k > 1 AS INT)) OVER (PARTITION BY seq_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM placed WHERE k <= 10) SELECT seq_id, position, similarity FROM marked WHERE seen = 0""",
    "frames",
)


def _until(term: str) -> str:
    return f"""kept AS (SELECT * FROM (SELECT *, coalesce(max(CAST(contains(lower(text), {q(term)}) AS INT)) OVER (
  PARTITION BY source ORDER BY capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM captures) WHERE seen = 0)"""


def _merged(rows: str) -> str:
    return f"""lines AS (SELECT source, capture_id, k, {strip('l')} AS line FROM (
  SELECT source, capture_id, unnest(s) AS l, unnest(range(len(s))) AS k FROM (SELECT source, capture_id, string_split(text, chr(10)) AS s FROM {rows}))),
firsts AS (SELECT source, line, min((capture_id, k)) AS spot FROM lines WHERE line <> '' GROUP BY source, line),
merged AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY spot) - 1 AS line_idx, line FROM firsts)"""


_CONTEXT = "SELECT *, array_to_string(list(line) OVER (PARTITION BY source ORDER BY line_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context FROM merged"
add("capture_until_text", f"WITH {_until('video')} SELECT source, capture_id FROM kept", "captures")
add(
    "content_structure",
    f"""WITH {_SIMILAR}, placed AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY position) AS k FROM likeness),
g AS (SELECT seq_id, count(*) AS total, count(*) FILTER (WHERE k > 1 AND similarity < 0.8) AS changes, count(*) FILTER (WHERE k > 1 AND similarity > 0.95) AS duplicates FROM placed GROUP BY seq_id)
SELECT *, round(CASE WHEN total > 1 THEN changes / (total - 1) ELSE 0.0 END, 6) AS efficiency FROM g""",
    "frames",
)
add("capture_confidence", f"WITH {_SIMILAR} SELECT seq_id, position, round(1 - similarity, 6) AS confidence, concat('frame ', CAST(position AS VARCHAR)) AS label FROM likeness", "frames")
add("merge_text", f"WITH {_merged('captures')} SELECT * FROM merged", "captures")
add("stream_merge_lines", f"WITH {_merged('captures')} SELECT source, line FROM merged", "captures")
add(
    "combine_capture_text",
    f"""WITH {_merged('captures')}, joined AS (SELECT source, string_agg(line, chr(10) ORDER BY line_idx) AS m FROM merged GROUP BY source)
SELECT f.source, concat(f.visible, CASE WHEN coalesce(m, '') <> '' THEN concat({q(C.SCROLLED)}, m) ELSE '' END) AS combined
FROM (SELECT source, arg_min(text, capture_id) AS visible FROM captures GROUP BY source) f LEFT JOIN joined USING (source)""",
    "captures",
)
add(
    "combine_capture_lines",
    f"""WITH {_merged('captures')}, seen AS (SELECT source, string_split(arg_min(text, capture_id), chr(10)) AS s FROM captures GROUP BY source)
SELECT source, unnest(range(len(s))) AS position, unnest(s) AS line FROM seen
UNION ALL SELECT source, len(s), {q(C.SCROLLED.strip(chr(10)))} FROM seen WHERE source IN (SELECT source FROM merged)
UNION ALL SELECT source, len(s) + 1 + line_idx, line FROM merged JOIN seen USING (source)""",
    "captures",
)
add("line_search", f"WITH {_until('search')}, {_merged('kept')} SELECT * FROM ({_CONTEXT}) WHERE contains(lower(line), 'search')", "captures")
add("line_search_all", f"WITH {_merged('captures')} SELECT * FROM ({_CONTEXT}) WHERE contains(lower(line), 'search')", "captures")
add(
    "search_context",
    f"""WITH {_until('search')}, {_merged('kept')}, hits AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_idx) AS n FROM ({_CONTEXT}) WHERE contains(lower(line), 'search')),
told AS (SELECT source, string_agg(context, chr(10) ORDER BY n) AS context FROM hits WHERE n <= 3 GROUP BY source)
SELECT s.source, coalesce(context, {q(C.NOT_FOUND)}) AS context FROM (SELECT DISTINCT source FROM captures) s LEFT JOIN told USING (source)""",
    "captures",
)

# --- log and classification
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY %s ORDER BY ts_s DESC, id DESC) AS rn FROM actions)"
_RECENT = f"(SELECT application, string_agg(description, '|' ORDER BY rn) AS recent FROM {_RANKED % 'application'} WHERE rn <= 10 GROUP BY application)"
add("recent_actions", "SELECT id, ts_s, description FROM actions WHERE application = 'Code.exe' ORDER BY ts_s DESC, id DESC LIMIT 10", "actions")
add("recent_actions_all", f"SELECT application, CAST(rn AS INTEGER) AS rn, id, ts_s, description FROM {_RANKED % 'application'} WHERE rn <= 10", "actions")
add("attach_recent_actions", f"SELECT capture_id, process_name, coalesce(recent, '') AS recent FROM captures LEFT JOIN {_RECENT} ON process_name = application", "captures", "actions")
add("context_history", "SELECT capture_id, ts_s, process_name FROM captures WHERE ts_s > (SELECT max(ts_s) FROM captures) - 86400", "captures")
add("app_family", f"SELECT capture_id, {pick('process_name', A.FAMILIES, 'generic')} AS family FROM captures", "captures")
_CATEGORY = pick("process_name", A.CATEGORIES, "unknown")
_INTENSITY = "CASE WHEN cpu_percent > 50 OR memory_usage > 500000000 THEN 'high' WHEN cpu_percent > 10 OR memory_usage > 100000000 THEN 'medium' ELSE 'low' END"
_CAPABLE = "CASE " + " ".join(f"WHEN contains(lower(process_name), {q(n)}) THEN [{', '.join(map(q, w))}]" for n, w in A.CAPABILITIES) + " ELSE ['general_purpose'] END"
add("app_category", f"SELECT capture_id, {_CATEGORY} AS category FROM captures", "captures")
add("usage_intensity", f"SELECT capture_id, {_INTENSITY} AS intensity FROM captures", "captures")
add("app_capabilities", f"SELECT capture_id, unnest({_CAPABLE}) AS capability FROM captures", "captures")
_USER = pick("t", A.ACTIVITIES, "general_use")
add("classify_activity", f"SELECT user_id, {_USER} AS activity FROM (SELECT user_id, string_agg(description, ' ' ORDER BY rn) AS t FROM {_RANKED % 'user_id'} WHERE rn <= 10 GROUP BY user_id)", "actions")
add("detect_activity", f"SELECT capture_id, content_type, activity_type FROM {_DETECTED}", "captures")
add("productivity_score", f"SELECT capture_id, {_SCORE} AS score FROM {_DETECTED}", "captures")
add("time_period", f"SELECT {_PERIOD} AS period, count(*) AS n FROM captures GROUP BY 1", "captures")
_ANALYSED = f"(SELECT *, {words('text')} AS w, {_SCORE} AS score, {_PERIOD} AS period FROM {_DETECTED})"
_HINTS = "list_filter([CASE WHEN score < 5 THEN 'low_score' END, CASE WHEN w > 500 THEN 'long_text' END, CASE WHEN " + has("text", ("error", "exception")) + " THEN 'error_seen' END], lambda h: h IS NOT NULL)"
add("suggestions", f"SELECT capture_id, array_to_string({_HINTS}, '|') AS suggestions, CAST(greatest(1, w // 200) AS BIGINT) AS reading_minutes FROM {_ANALYSED}", "captures")
_LINES = f"""concat('Active Application: ', process_name, chr(10), 'Content Type: ', content_type, chr(10), 'Activity Type: ', activity_type, chr(10), 'Time Period: ', period, chr(10),
  'Word Count: ', CAST(w AS VARCHAR), chr(10), 'Character Count: ', CAST(length(text) AS VARCHAR), chr(10), 'Estimated Reading Time: ', CAST(greatest(1, w // 200) AS VARCHAR), ' minutes', chr(10),
  'Productivity Score: ', CAST(score AS VARCHAR), '/10', CASE WHEN len({_HINTS}) > 0 THEN concat(chr(10), 'Suggestions: ', array_to_string({_HINTS}, ', ')) ELSE '' END)"""
add("analyze_context", f"SELECT capture_id, {_LINES} AS analysis FROM {_ANALYSED}", "captures")
add(
    "key_lines",
    f"""SELECT capture_id, {strip("regexp_extract(a, '(?m)Activity Type:(.*)$', 1)")} AS activity_type,
  array_to_string(list_filter(string_split(a, chr(10)), lambda l: {' OR '.join(f'contains(l, {q(k)})' for k in L.KEY_LINES)}), chr(10)) AS kept
FROM (SELECT capture_id, {_LINES} AS a FROM {_ANALYSED})""",
    "captures",
)
add(
    "session_summary",
    f"""SELECT user_id, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS captures, CAST(sum(c) OVER (PARTITION BY user_id) AS BIGINT) AS total_chars, activity_type, n AS times
FROM (SELECT user_id, activity_type, count(*) AS n, sum(length(text)) AS c FROM {_DETECTED} GROUP BY user_id, activity_type)""",
    "captures",
)
add("context_counts", f"SELECT capture_id, CAST(length(text) AS BIGINT) AS text_length, 0::BIGINT AS ui_elements, 0::BIGINT AS file_paths, CAST(len({URLS}) AS BIGINT) AS urls, len({URLS}) > 0 AS web_available FROM captures", "captures")
add("insight_gate", "SELECT response_id FROM responses WHERE length(response_text) > 20 AND NOT contains(lower(response_text), 'error')", "responses")

# --- joins
add(
    "question_context",
    """SELECT q.question_id, q.user_id, q.ts_s, c.seen AS context FROM questions q ASOF LEFT JOIN (
  SELECT user_id, ts_s, arg_max(substr(text, 1, 1000), capture_id) AS seen FROM captures GROUP BY user_id, ts_s) c ON q.user_id = c.user_id AND q.ts_s >= c.ts_s""",
    "questions", "captures",
)
add(
    "content_alignment",
    r"""WITH topics AS (SELECT user_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:3]) AS topic FROM modal_inputs),
told AS (SELECT user_id, lower(string_agg(scene_description, ' ' ORDER BY input_id)) AS t FROM modal_inputs WHERE scene_description IS NOT NULL GROUP BY user_id),
found AS (SELECT user_id, count(*) AS topics, count(*) FILTER (WHERE contains(t, lower(topic))) AS hits FROM topics LEFT JOIN told USING (user_id) GROUP BY user_id)
SELECT u.user_id, coalesce(topics, 0) AS topics, round(CASE WHEN coalesce(topics, 0) > 0 THEN hits / topics ELSE 0.0 END, 6) AS alignment
FROM (SELECT DISTINCT user_id FROM modal_inputs) u LEFT JOIN found USING (user_id)""",
    "modal_inputs",
)
_CONTEXTS = f"""SELECT capture_id, {_CATEGORY} AS app_type, {_INTENSITY} AS usage_intensity, array_to_string({_CAPABLE}, '|') AS capabilities,
  CASE WHEN t IS NOT NULL THEN {_USER} END AS behaviour FROM captures LEFT JOIN (
  SELECT application, string_agg(description, ' ' ORDER BY rn) AS t FROM {_RANKED % 'application'} WHERE rn <= 10 GROUP BY application) ON process_name = application"""
add("context_insights", _CONTEXTS, "captures", "actions")

# --- histories
add("last_n", f"SELECT user_id, id FROM {_RANKED % 'user_id'} WHERE rn <= 50", "actions")
_BACK = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM actions)"
_LEFT = "CASE WHEN n <= 20 THEN n ELSE 15 + (n - 21) % 6 END"
add("bounded_history", f"SELECT user_id, id FROM {_BACK} WHERE back <= {_LEFT}", "actions")
add("stream_bounded_history", f"SELECT user_id, count(*) AS size, arg_max(id, back) AS first_id, arg_min(id, back) AS last_id FROM {_BACK} WHERE back <= {_LEFT} GROUP BY user_id", "actions")
add(
    "sample_every_2nd",
    """SELECT user_id, id, size_before_cut FROM (SELECT user_id, id, CASE WHEN n <= 21 THEN n ELSE 16 + (n - 22) % 6 END AS size_before_cut FROM (
  SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, id) AS n FROM actions)) WHERE size_before_cut % 2 = 0""",
    "actions",
)
add(
    "cooldown",
    """WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, question_id) AS n FROM questions),
walk AS (
  SELECT question_id, user_id, ts_s, n, CASE WHEN trim(question) = '' THEN 'ignored' ELSE 'accepted' END AS status, 0 AS remaining,
    CASE WHEN trim(question) = '' THEN NULL ELSE ts_s END AS last FROM numbered WHERE n = 1
  UNION ALL
  SELECT r.question_id, r.user_id, r.ts_s, r.n,
    CASE WHEN w.last IS NOT NULL AND r.ts_s - w.last < 86400 THEN 'wait' WHEN trim(r.question) = '' THEN 'ignored' ELSE 'accepted' END,
    CASE WHEN w.last IS NOT NULL AND r.ts_s - w.last < 86400 THEN CAST(86400 - (r.ts_s - w.last) AS INT) ELSE 0 END,
    CASE WHEN w.last IS NOT NULL AND r.ts_s - w.last < 86400 THEN w.last WHEN trim(r.question) = '' THEN w.last ELSE r.ts_s END
  FROM walk w JOIN numbered r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT question_id, user_id, ts_s, status, CAST(remaining AS BIGINT) AS remaining FROM walk""",
    "questions",
)
ORACLES["stream_cooldown"] = ORACLES["cooldown"]
add(
    "response_nav",
    """SELECT conv_id, turn, response_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(response_text) OVER w AS previous, lead(response_text) OVER w AS next
FROM responses WINDOW w AS (PARTITION BY conv_id ORDER BY turn, response_id)""",
    "responses",
)
add("answer_at", "SELECT conv_id, response_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, response_id) AS k FROM responses) WHERE k = 2", "responses")

# --- answers
_ROWS = f"""lines AS (SELECT response_id, k AS line_no, {strip('l')} AS line FROM (
  SELECT response_id, unnest(s) AS l, CAST(unnest(range(len(s))) AS INTEGER) AS k FROM (SELECT response_id, string_split(response_text, chr(10)) AS s FROM responses))),
full_lines AS (SELECT * FROM lines WHERE line <> '')"""
_SECTIONS = f"""{_ROWS}, headed AS (SELECT *, ends_with(line, ':') AS h FROM full_lines),
numbered AS (SELECT *, CAST(sum(CAST(h AS INT)) OVER (PARTITION BY response_id ORDER BY line_no) AS BIGINT) AS section_no FROM headed),
named AS (SELECT response_id, section_no, max(substr(line, 1, length(line) - 1)) AS section FROM numbered WHERE h GROUP BY ALL),
sections AS (SELECT response_id, section_no, section, line_no, line FROM numbered JOIN named USING (response_id, section_no) WHERE NOT h AND section_no > 0 AND section <> '')"""
_AFTER = strip("CASE WHEN instr(line, ':') > 0 THEN substr(line, instr(line, ':') + 1) ELSE line END")
_FORMATTED = f"""{_SECTIONS}, first_answers AS (SELECT response_id, section_no, arg_min({_AFTER}, line_no) AS answer FROM sections WHERE starts_with(line, 'A') GROUP BY ALL),
kinds AS (SELECT s.*, coalesce(answer, '') AS answer, CASE WHEN starts_with(line, '•') THEN 'bullet' WHEN starts_with(line, 'Q') THEN 'question' WHEN starts_with(line, 'A') THEN 'answer'
  WHEN regexp_matches(line, '\\p{{Nd}}') THEN 'stat' ELSE 'paragraph' END AS kind FROM sections s LEFT JOIN first_answers USING (response_id, section_no)),
formatted AS (SELECT response_id, section_no, upper(section) AS section, line_no, kind, CASE kind WHEN 'bullet' THEN concat('• ', {strip('substr(line, 2)')})
  WHEN 'question' THEN concat('Q: ', {_AFTER}, chr(10), 'A: ', answer) WHEN 'stat' THEN concat({q(N.STAT_SIGN + ' ')}, line) ELSE line END AS out FROM kinds WHERE kind <> 'answer')"""
add("parse_sections", f"WITH {_SECTIONS} SELECT * FROM sections", "responses")
add("format_answer", f"WITH {_FORMATTED} SELECT * FROM formatted", "responses")
_QA = f"""list_transform(list_filter(list_transform(string_split(response_text, chr(10)), lambda line: {strip('line')}), lambda line: starts_with(line, '%s')), lambda line: {_AFTER})"""
add("extract_qa", f"SELECT response_id, array_to_string({_QA % 'Q'}, '|') AS questions, array_to_string({_QA % 'A'}, '|') AS answers FROM responses", "responses")
add(
    "qa_pairs",
    f"""SELECT response_id, CAST(i AS INTEGER) AS pos, qs[i + 1] AS question, ans[i + 1] AS answer FROM (
  SELECT *, unnest(range(greatest(len(qs), len(ans)))) AS i FROM (SELECT response_id, {_QA % 'Q'} AS qs, {_QA % 'A'} AS ans FROM responses))""",
    "responses",
)
add(
    "line_kinds",
    f"""WITH {_FORMATTED}, pieces AS (SELECT *, row_number() OVER (PARTITION BY response_id, section_no ORDER BY line_no) AS k FROM formatted),
texts AS (SELECT response_id, {strip(f'''string_agg(concat(CASE WHEN k = 1 THEN concat(chr(10), repeat('=', 60), chr(10), '** ', section, ' **', chr(10), repeat('=', 60), chr(10), chr(10)) ELSE '' END, out,
  CASE WHEN kind IN ('bullet', 'stat') THEN chr(10) ELSE concat(chr(10), chr(10)) END), '' ORDER BY line_no)''')} AS t FROM pieces GROUP BY response_id),
shown AS (SELECT response_id, CAST(unnest(range(len(s))) AS INTEGER) AS line_no, unnest(list_transform(s, lambda l: {strip('l')})) AS line FROM (SELECT response_id, string_split(t, chr(10)) AS s FROM texts)),
ruled AS (SELECT *, contains(line, '====================') AS rule, sum(CAST(contains(line, '====================') AS INT)) OVER (PARTITION BY response_id ORDER BY line_no) AS rules FROM shown),
seen AS (SELECT *, lag(rule) OVER w AS rule_before, lag(line) OVER w AS line_before FROM ruled WINDOW w AS (PARTITION BY response_id ORDER BY line_no)),
told AS (SELECT *, CASE WHEN rule THEN 'rule' WHEN rule_before AND rules % 2 = 1 THEN 'title' WHEN starts_with(line, '**') AND ends_with(line, '**') THEN 'section' WHEN starts_with(line, '•') THEN 'bullet'
  WHEN starts_with(line, {q(N.STAT_SIGN)}) THEN 'stat' WHEN starts_with(line, 'Q:') THEN 'question' WHEN starts_with(line, 'A:') AND starts_with(line_before, 'Q:') THEN 'answer' ELSE 'normal' END AS kind FROM seen)
SELECT response_id, line_no, kind, CASE kind WHEN 'title' THEN replace(line, '**', '') WHEN 'section' THEN {strip("regexp_replace(line, '^[*]+|[*]+$', '', 'g')")} ELSE line END AS text FROM told WHERE kind <> 'rule'""",
    "responses",
)
add(
    "bold_spans",
    f"WITH {_ROWS} SELECT response_id, line_no, CAST(i AS INTEGER) AS part, s[i + 1] AS text, i % 2 = 1 AS bold FROM (SELECT *, unnest(range(len(s))) AS i FROM (SELECT response_id, line_no, string_split(line, '**') AS s FROM full_lines))",
    "responses",
)
_FIELD = "json_extract_string(body, '$.%s')"
_VALID = "coalesce(json_valid(body), false)"
_LOST = "(error IS NOT NULL OR body IS NULL)"
_WHY = f"CASE WHEN {_LOST} THEN coalesce(error, 'no answer') END"


def _default(value: str) -> str:
    return f"CASE WHEN NOT {_VALID} AND NOT {_LOST} THEN {value} END"


_TEXT_ANALYSIS = f"""SELECT response_id, {_VALID} AS valid, {_WHY} AS error, {_default("'general'")} AS main_topics, {_default("'neutral'")} AS sentiment,
  {_default("'information seeking'")} AS intent, {_default("'unknown'")} AS technical_content, {_default("'medium'")} AS urgency_level, {_default("''")} AS entities FROM """
_IMAGE_ANALYSIS = f"""SELECT response_id, {_VALID} AS valid, {_WHY} AS error, {_default('body')} AS scene_description, {_default("''")} AS text_detected,
  {_default("'unknown'")} AS application_type, {_default("'general computer use'")} AS visual_context, {_default("''")} AS ui_elements FROM """
add("text_analysis_json", _TEXT_ANALYSIS + "model_json", "model_json")
add("image_analysis_json", _IMAGE_ANALYSIS + "model_json", "model_json")


def _field(name: str) -> str:
    return f"CASE WHEN {_VALID} THEN {_FIELD % name} END"


_CONFIDENCE = f"CASE WHEN {_LOST} THEN 0.0::DOUBLE WHEN {_VALID} THEN coalesce(CAST({_field('confidence_score')} AS DOUBLE), 0.5) ELSE 0.7 END"
_SUMMARY = f"CASE WHEN {_LOST} THEN {q(N.FAILED['summary'])} WHEN {_VALID} THEN coalesce({_field('summary')}, '') ELSE substr(body, 1, 200) END"


def _list(name: str, otherwise: str, lost: str = "''") -> str:
    return f"CASE WHEN {_LOST} THEN {lost} WHEN {_VALID} THEN coalesce(array_to_string(CASE WHEN {_VALID} THEN json_extract_string(body, '$.{name}[*]') END, '|'), '') ELSE {otherwise} END"


add(
    "model_answer",
    f"""SELECT response_id, {_SUMMARY} AS summary, CASE WHEN {_LOST} THEN concat({q(N.FAILED['detailed_analysis'])}, coalesce(error, 'no answer')) WHEN {_VALID} THEN coalesce({_field('detailed_analysis')}, '') ELSE body END AS detailed_analysis,
  {_list('action_suggestions', q(N.UNREAD['action_suggestions'][0]), q(N.FAILED['action_suggestions'][0]))} AS action_suggestions, round({_CONFIDENCE}, 6) AS confidence, {_field('context_used.k')} AS context_k,
  {_list('follow_up_questions', "''")} AS follow_up_questions FROM model_json""",
    "model_json",
)
add("confidence_percent", f"SELECT response_id, CAST(trunc({_CONFIDENCE} * 100) AS INTEGER) AS percent FROM model_json", "model_json")
add(
    "conversation_history",
    f"""SELECT conv_id, response_id, ts_s, n AS inputs, {_SUMMARY} AS response_summary, {_CONFIDENCE} AS confidence FROM (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY ts_s DESC, response_id DESC) AS back FROM model_json) WHERE back <= 50""",
    "model_json",
)

# --- modalities, with the analyses above
add(
    "combine_modalities",
    f"""SELECT m.input_id, user_id, priority, text_words, scene_chars, m.app_type, text_words IS NOT NULL AS has_text, scene_chars IS NOT NULL AS has_image, m.app_type IS NOT NULL AS has_context,
  row_number() OVER (PARTITION BY user_id ORDER BY priority, m.input_id) AS place,
  CAST(CASE WHEN text_words IS NOT NULL AND t.response_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN scene_chars IS NOT NULL AND i.response_id IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN m.app_type IS NOT NULL AND c.capture_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS analyses,
  CASE WHEN text_words IS NOT NULL THEN main_topics END AS main_topics, CASE WHEN text_words IS NOT NULL THEN sentiment END AS sentiment, CASE WHEN text_words IS NOT NULL THEN t.error END AS text_error,
  CASE WHEN scene_chars IS NOT NULL THEN i.scene_description END AS scene_seen, CASE WHEN scene_chars IS NOT NULL THEN visual_context END AS visual_context,
  CASE WHEN m.app_type IS NOT NULL THEN usage_intensity END AS usage_intensity, CASE WHEN m.app_type IS NOT NULL THEN behaviour END AS behaviour
FROM (SELECT input_id, user_id, priority, CASE WHEN text <> '' THEN {words('text')} END AS text_words, CAST(length(scene_description) AS BIGINT) AS scene_chars,
    CASE WHEN coalesce(context_process, '') <> '' THEN {pick('context_process', A.CATEGORIES, 'unknown')} END AS app_type FROM modal_inputs) m
LEFT JOIN ({_TEXT_ANALYSIS} modal_answers) t ON t.response_id = m.input_id LEFT JOIN ({_IMAGE_ANALYSIS} modal_answers) i ON i.response_id = m.input_id
LEFT JOIN ({_CONTEXTS}) c ON c.capture_id = m.input_id""",
    "modal_inputs", "modal_answers", "captures", "actions",
)

# --- streaming
add("interval_counts", "SELECT ts_s - ts_s % 15 AS start_s, count(*) AS n FROM actions GROUP BY 1", "actions")
add("live_activity", "SELECT ts_s - ts_s % 86400 AS start_s, action_type, count(*) AS n FROM actions GROUP BY 1, 2", "actions")
ORACLES["stream_live_activity"] = ORACLES["live_activity"]
add("stream_source", "SELECT capture_id, ts_s FROM captures", "captures")
