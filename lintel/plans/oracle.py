"""The queries once more, as DuckDB SQL over the same tables.

The catalogue's expressions go in as they are: DuckDB's are of the linear-time
family the catalogue is written for.
"""

from __future__ import annotations

from lintel.plans import catalog as C
from lintel.plans import corpus
from lintel.plans import queries as Q
from lintel.sources import store

TRIM = r"'^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+$'"


def q(text: str) -> str:
    """A string literal; control characters by name."""
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in text.split("\0")]
    return " || chr(0) || ".join(parts) if len(parts) > 1 else parts[0]


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {TRIM}, '', 'g')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{0b}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _case(value: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}" for k, v in table.items()) + f" ELSE {default} END"


LANGUAGE = f"coalesce({_case('lower(regexp_extract(path, ' + q(chr(92) + '.[^./]*$') + '))', C.EXTENSIONS)}, {_case('lower(regexp_extract(path, ' + q('[^/]*$') + '))', C.FILE_NAMES)})"


def documents(shift: int = 0, name: str = "docs") -> str:
    """(path, content, size), as corpus.documents."""
    n, m = len(corpus.SUFFIXES), len(corpus.FIXTURES)
    turn = f"(doc_id // {n} + CASE WHEN doc_id % 5 = 0 THEN {shift} ELSE 0 END)"
    return f"""{name} AS (SELECT path, content, CAST(strlen(content) AS BIGINT) AS size FROM (SELECT 'src/' || coalesce(source, 'none') || '/' || doc_id || {_list(corpus.SUFFIXES)}[doc_id % {n} + 1] AS path,
 coalesce(text, '') || chr(10) || {_list(corpus.FIXTURES)}[{turn} % {m} + 1] AS content FROM documents WHERE doc_id IS NOT NULL))"""


def files(shift: int = 0, s: str = "") -> str:
    """Parsed files of known languages, and their lines."""
    return f"""{documents(shift, "docs" + s)},
files{s} AS (SELECT *, string_split(content, chr(10)) AS lines, CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count FROM (SELECT *, {LANGUAGE} AS language FROM docs{s}) WHERE language IS NOT NULL),
lines{s} AS (SELECT path, language, i AS line_no, lines[i] AS line, CASE WHEN i > 1 THEN lines[i - 1] END AS previous FROM files{s}, unnest(range(1, len(lines) + 1)) AS t(i))"""


def _start(line: str, p: str) -> str:
    return f"CAST(strlen(regexp_extract({line}, {q('(?s)^(.*?)(?:(?-s)' + p + ')')}, 1)) AS BIGINT)"


def _hit(k: int, p: str, where: str, lines: str, head: str) -> str:
    return f"SELECT path, language, line_no, line, previous, {k} AS pattern, {head}, {_start('line', p)} AS match_start, regexp_extract(line, {q(p)}) AS match_text FROM {lines} WHERE {where} AND regexp_matches(line, {q(p)})"


def _head(rule, description: str) -> str:
    return f"{q(rule.id)} AS rule_id, {q(rule.title)} AS title, {q(rule.severity)} AS severity, {q(rule.category)} AS category, {q(rule.cwe)} AS cwe, CAST({rule.confidence} AS DOUBLE) AS confidence, {description} AS description"


def _in(languages) -> str:
    return "language IN (" + ", ".join(q(x) for x in languages) + ")" if languages else "TRUE"


def pattern_hits(s: str = "") -> str:
    parts = [_hit(k, r.regex, _in(r.languages) + (f" AND NOT regexp_matches(line, {q(r.exclude)})" if r.exclude else ""), f"lines{s}", _head(r, q(r.description))) for k, r in enumerate(C.PATTERN_RULES)]
    return "\nUNION ALL ".join(parts)


def language_hits(rule, s: str = "") -> str:
    return "\nUNION ALL ".join(_hit(k, p, _in(langs), f"lines{s}", _head(rule, f"{q(rule.description)} || {_trim('line')}")) for k, (langs, p) in enumerate(rule.patterns()))


def _directive(line: str, name: str) -> str:
    """The list of rules that a directive names, or an empty list."""
    low, n = f"lower({line})", len(name)
    at = f"instr({low}, {q(name)})"
    before, after = f"substr({low}, 1, {at} - 1)", f"substr({low}, {at} + {n})"
    mark = " OR ".join(f"contains({before}, {q(m)})" for m in ("//", "#", "/*", "<!--"))
    tokens = rf"regexp_split_to_array(split_part(regexp_extract({after}, '^([^\r\n]*)', 1), '--', 1), '[, \t]+')"
    return f"CASE WHEN {at} > 0 AND ({mark}) AND regexp_matches({after}, '^($|[ \\t])') THEN list_filter({tokens}, lambda x: x <> '') ELSE CAST([] AS VARCHAR[]) END"


def _off(rules: str) -> str:
    return f"(list_contains({rules}, 'all') OR list_contains({rules}, lower(rule_id)))"


def _secret_hits(s: str = "") -> str:
    return _hit(0, C.SECRETS_REGEX, "TRUE", f"lines{s}", _head(C.SECRETS, q(C.SECRETS.description)))


def _dependency_hits(s: str = "") -> str:
    """Known vulnerable packages in the npm manifests among the files."""
    t = _trim("line")
    return f"""SELECT path, language, line_no, line, previous, 0 AS pattern, 'dependency' AS rule_id, 'Vulnerable dependency: ' || name AS title, severity, 'dependency' AS category, 'CWE-1104' AS cwe, CAST(0.9 AS DOUBLE) AS confidence,
 name || ' version ' || version || ' is vulnerable to ' || cve || ': ' || description AS description, CAST(0 AS BIGINT) AS match_start, name || ' ' || version AS match_text
 FROM (SELECT *, regexp_extract(line, {q(C.NPM_PAIR)}, 1) AS name, regexp_replace(regexp_replace(regexp_extract(line, {q(C.NPM_PAIR)}, 2), '^\\^', ''), '^~', '') AS version FROM
 (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no), 0) AS inside FROM (SELECT *, CASE WHEN contains({t}, '"dependencies"') OR contains({t}, '"devDependencies"') THEN 1 WHEN {t} = '}}' THEN 0 END AS e FROM lines{s} WHERE ends_with(lower(path), 'package.json')))
 WHERE inside = 1 AND e IS NULL AND regexp_matches(line, {q(C.NPM_PAIR)})) d JOIN (SELECT * FROM (VALUES {_known_rows()}) AS k(name, bound, fixed, cve, severity, description)) k USING (name) WHERE version <> '' AND {_key("version")} < {_key("bound")}"""


def suppressed(s: str = "") -> str:
    """raw, off and kept."""
    return f"""raw{s} AS ({pattern_hits(s)}
UNION ALL {language_hits(C.SQL_INJECTION, s)}
UNION ALL {language_hits(C.XSS, s)}
UNION ALL {_secret_hits(s)}
UNION ALL {_dependency_hits(s)}),
off{s} AS (SELECT path, list_distinct(flatten(list(d))) AS off FROM (SELECT path, {_directive("line", "lintel:ignore-file")} AS d FROM lines{s} WHERE contains(lower(line), 'lintel:ignore-file')) GROUP BY path HAVING len(flatten(list(d))) > 0),
kept{s} AS (SELECT r.* FROM raw{s} r LEFT JOIN off{s} o USING (path) WHERE NOT {_off("(" + _directive("line", "lintel:ignore") + ")")} AND NOT {_off("(" + _directive("coalesce(previous, '')", "lintel:ignore-next-line") + ")")} AND NOT coalesce({_off("o.off")}, FALSE))"""


def _tls(x: str) -> str:
    out = "NULL"
    for p, v in reversed(C.TLS_SWITCHES):
        out = f"CASE WHEN regexp_matches({x}, {q(p)}) THEN regexp_replace({x}, {q(p)}, {q(chr(92) + '1' + v)}, 'g') ELSE {out} END"
    return out


def findings(shift: int = 0, s: str = "") -> str:
    """All CTEs up to found: the finished findings."""
    links = {r[0]: " ".join(x for x in r[6] if x != r[4]) for r in C.rule_table()}
    return f"""{files(shift, s)},
{suppressed(s)},
based{s} AS (SELECT *, left(sha256(lower(rule_id) || chr(0) || path || chr(0) || {_collapse("line")}), 32) AS base FROM kept{s}),
numbered{s} AS (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line_no, rule_id, match_start, pattern) - 1 AS again FROM based{s}),
found{s} AS (SELECT CASE WHEN again > 0 THEN left(sha256(base || chr(0) || again), 32) ELSE base END AS fingerprint, rule_id, title, severity, {_case("category", C.CATEGORIES, "'other'")} AS category, path AS file_path, line_no AS line_start, CAST(0 AS BIGINT) AS line_end,
 CASE WHEN rule_id <> 'dependency' THEN match_start + 1 END AS column_start, CASE WHEN rule_id <> 'dependency' THEN match_start + strlen(match_text) + 1 END AS column_end, confidence, description, CAST({_case("rule_id", {k: v[0] for k, v in C.CVSS.items()})} AS DOUBLE) AS cvss_score, {_case("rule_id", {k: v[1] for k, v in C.CVSS.items()})} AS cvss_vector,
 cwe, {_case("rule_id", links, "''")} AS owasp, '' AS urls, match_text, CASE WHEN rule_id = 'RULE-TLS-001' THEN {_tls("match_text")} END AS replacement, {_case("rule_id", {k: v[0] for k, v in C.FIXES.items()})} AS summary, {_case("rule_id", {k: v[1] for k, v in C.FIXES.items()})} AS example,
 CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS weight FROM numbered{s})"""


def _finding_columns(extra: str = "") -> str:
    return "path, line_no, rule_id, severity, category, confidence, match_start, match_start + strlen(match_text) AS match_end, match_text" + extra


def _counts(names, column: str = "severity", suffix: str = "") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = {q(s)}) AS {s}{suffix}" for s in names)


def _manifests() -> str:
    n, v = len(corpus.MANIFESTS), len(corpus.VERSIONS)
    return f"""mf AS (SELECT 'p' || doc_id || '/' || {_list(corpus.MANIFESTS)}[doc_id % {n} + 1] AS path, doc_id % {n} AS kind, string_split(replace({_list(corpus.MANIFESTS.values())}[doc_id % {n} + 1], '@', {_list(corpus.VERSIONS)}[(doc_id // {n}) % {v} + 1]), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
ml AS (SELECT path, kind, i AS line_no, lines[i] AS x, {_trim("lines[i]")} AS t FROM mf, unnest(range(1, len(lines) + 1)) AS u(i)),
ev AS (SELECT *, CASE WHEN kind = 0 AND (contains(t, '"dependencies"') OR contains(t, '"devDependencies"')) OR kind = 1 AND starts_with(t, 'require (') THEN 1 WHEN kind = 0 AND t = '}}' OR kind = 1 AND t = ')' THEN 0 END AS e FROM ml),
se AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no), 0) AS inside FROM ev),
deps AS (
SELECT path, line_no, regexp_extract(x, '"([^"]+)"\\s*:\\s*"([^"]+)"', 1) AS name, regexp_replace(regexp_replace(regexp_extract(x, '"([^"]+)"\\s*:\\s*"([^"]+)"', 2), '^\\^', ''), '^~', '') AS version FROM se WHERE kind = 0 AND inside = 1 AND e IS NULL AND regexp_matches(x, '"([^"]+)"\\s*:\\s*"([^"]+)"')
UNION ALL SELECT path, line_no, regexp_extract(t, '^\\s*([^\\s]+)\\s+v?([0-9][^\\s]*)', 1), regexp_extract(t, '^\\s*([^\\s]+)\\s+v?([0-9][^\\s]*)', 2) FROM se WHERE kind = 1 AND inside = 1 AND e IS NULL AND regexp_matches(t, '^\\s*([^\\s]+)\\s+v?([0-9][^\\s]*)')
UNION ALL SELECT path, line_no, string_split({_collapse("t")}, ' ')[2], regexp_replace(string_split({_collapse("t")}, ' ')[3], '^v', '') FROM se WHERE kind = 1 AND starts_with(t, 'require ') AND NOT starts_with(t, 'require (') AND len(string_split({_collapse("t")}, ' ')) >= 3
UNION ALL SELECT path, line_no, lower(regexp_extract(t, '^([a-zA-Z0-9_-]+)\\s*(?:==|>=|<=|~=|>|<)\\s*([0-9][^\\s;#]*)', 1)), regexp_extract(t, '^([a-zA-Z0-9_-]+)\\s*(?:==|>=|<=|~=|>|<)\\s*([0-9][^\\s;#]*)', 2) FROM se WHERE kind = 2 AND regexp_matches(t, '^([a-zA-Z0-9_-]+)\\s*(?:==|>=|<=|~=|>|<)\\s*([0-9][^\\s;#]*)')
UNION ALL SELECT path, line_no, regexp_extract(x, 'gem\\s+[''"]([^''"]+)[''"]', 1), {_trim("regexp_replace(regexp_replace(regexp_extract(x, 'gem" + chr(92) + "s+[''" + chr(34) + "]([^''" + chr(34) + "]+)[''" + chr(34) + "](?:," + chr(92) + "s*[''" + chr(34) + "]([^''" + chr(34) + "]+)[''" + chr(34) + "])?', 2), '^~>', ''), '^>=', '')")} FROM se WHERE kind = 3 AND NOT starts_with(t, '#') AND regexp_matches(x, 'gem\\s+[''"]([^''"]+)[''"]'))"""


def _number(part: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({part}, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0)"


def _key(version: str) -> str:
    """Six dotted numbers as a list, which compares like the version."""
    return "[" + ", ".join(_number(f"split_part({version}, '.', {k})") for k in range(1, 7)) + "]"


def _known_rows() -> str:
    return ", ".join("(" + ", ".join(q(x.removeprefix("<") if k == 1 else x) for k, x in enumerate(row)) + ")" for row in C.KNOWN_VULNERABLE)


KNOWN = f"known(name, bound, fixed, cve, severity, description) AS (VALUES {_known_rows()})"

SCANS = """scans AS (SELECT o_orderkey AS scan_id, o_custkey AS repository_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS completed_at FROM orders)"""
STORED = f"""stored AS (SELECT l_orderkey AS scan_id, {_list(C.SEVERITIES)}[l_linenumber % 5 + 1] AS severity, l_returnflag AS category, l_shipdate AS created_at, l_quantity < 5 AS is_false_positive, l_discount > 0.08 AS suppressed, CASE WHEN l_tax < 0.02 THEN l_shipdate END AS fixed_at, l_linenumber AS line FROM lineitem)"""
COUNTERS = f"counters AS (SELECT scan_id, count(*) AS total_vulnerabilities, {_counts(C.SEVERITIES, suffix='_count')} FROM stored GROUP BY scan_id)"
URLS = f"urls AS (SELECT page_id, replace({_list(Q.URLS)}[page_id % {len(Q.URLS)} + 1], '%', CAST(page_id AS VARCHAR)) AS url FROM pages)"

_SLASH = _in(C.SLASH_COMMENTS)


def _classes() -> str:
    """A recursive walk over the lines of each file that carries an open block comment."""
    opens = f"(({_SLASH} AND NOT o AND starts_with(t, '/*')) OR (language IN ('html', 'xml') AND starts_with(t, '<!--')))"
    comment = f"(t <> '' AND (({_SLASH} AND (o OR starts_with(t, '//'))) OR {opens} OR (language IN ('html', 'xml') AND o) OR (language IN ('python', 'ruby') AND starts_with(t, '#')) OR (language = 'shell' AND starts_with(t, '#') AND NOT starts_with(t, '#!'))))"
    closes = f"CASE WHEN {_SLASH} THEN contains(t, '*/') ELSE contains(t, '-->') END"
    still = f"CASE WHEN t = '' OR NOT ({_SLASH} OR language IN ('html', 'xml')) THEN o WHEN {opens} THEN NOT ({closes}) OR (language IN ('html', 'xml') AND o) WHEN o THEN NOT ({closes}) ELSE FALSE END"
    return f"""tl AS (SELECT path, language, line_no, {_trim("line")} AS t FROM lines),
walk(path, language, line_no, t, o) AS (SELECT path, language, line_no, t, FALSE FROM tl WHERE line_no = 1
 UNION ALL SELECT n.path, n.language, n.line_no, n.t, s.still FROM (SELECT path, line_no, {still} AS still FROM walk) s JOIN tl n ON n.path = s.path AND n.line_no = s.line_no + 1),
classes AS (SELECT path, language, count(*) FILTER (WHERE t <> '' AND NOT {comment}) AS code, count(*) FILTER (WHERE {comment}) AS comment, count(*) FILTER (WHERE t = '') AS blank FROM walk GROUP BY path, language)"""


def _structure(table: dict, trim: tuple) -> str:
    parts = []
    for lang, patterns in table.items():
        x = _trim("line") if lang in trim else "line"
        parts += [f"SELECT path, language, line_no, line, regexp_extract({x}, {q(p)}, 1) AS name FROM lines WHERE language = {q(lang)} AND regexp_matches({x}, {q(p)})" for p in patterns]
    return "\nUNION ALL ".join(parts)


def _whole(table: str, other: str) -> str:
    """Whole findings that the other side has not, of each fingerprint the greatest by path, line, rule."""
    columns = "file_path, line_start, rule_id, title, severity, column_start, confidence"
    return f"SELECT fingerprint, unnest(f) FROM (SELECT fingerprint, arg_max({{{', '.join(f"'{c}': {c}" for c in columns.split(', '))}}}, row({columns})) AS f FROM {table} WHERE fingerprint NOT IN (SELECT fingerprint FROM {other}) GROUP BY fingerprint)"


GO_FUNCTIONS = f"""SELECT path, language, name, start_line, end_line, regexp_matches(name, '^\\p{{Lu}}') AS is_exported, CAST(len(regexp_extract_all(regexp_replace(code, {q(C.GO_PLAIN)}, ' ', 'g'), {q(C.GO_BRANCH)})) + 1 AS BIGINT) AS complexity FROM
 (SELECT s.path, language, name, start_line, end_line, (SELECT array_to_string(f.lines[s.start_line:s.end_line], chr(10)) FROM files f WHERE f.path = s.path) AS code FROM
 (SELECT l.path, language, regexp_extract(line, {q(C.GO_FUNCTION)}, 1) AS name, line_no AS start_line, CASE WHEN regexp_matches(line, {q(C.GO_ONE_LINE)}) THEN line_no ELSE coalesce((SELECT min(e.line_no) FROM lines e WHERE e.path = l.path AND e.line_no > l.line_no AND starts_with(e.line, '}}')), (SELECT max(e.line_no) FROM lines e WHERE e.path = l.path)) END AS end_line
 FROM lines l WHERE language = 'go' AND regexp_matches(line, {q(C.GO_FUNCTION)})) s)"""
GO_IMPORTS = f"""SELECT path, language, CASE WHEN regexp_matches(line, {q(C.GO_IMPORT)}) THEN regexp_extract(line, {q(C.GO_IMPORT)}, 1) ELSE regexp_extract(line, {q(C.GO_IMPORT_LINE)}, 1) END AS name, line_no FROM
 (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no), 0) AS inside FROM (SELECT *, CASE WHEN starts_with(line, 'import (') THEN 1 WHEN starts_with(line, ')') THEN 0 END AS e FROM lines WHERE language = 'go'))
 WHERE regexp_matches(line, {q(C.GO_IMPORT)}) OR inside = 1 AND e IS NULL AND regexp_matches(line, {q(C.GO_IMPORT_LINE)})"""
COMPLEXITY = "complexity AS (SELECT path, sum(" + " + ".join(f"CAST(contains({_trim('line')}, {q(w)}) AS INTEGER)" for w in C.COMPLEXITY_WORDS) + " + CASE WHEN length(regexp_extract(line, '^[ \\t]*')) > 16 THEN 0.5 ELSE 0 END)::DOUBLE / count(*) * 100 AS complexity FROM lines GROUP BY path)"


def _go(kind: int, names: str, lines: str) -> str:
    """What was put into the Go files, moved down by the comment in front; `lines` are the columns that move."""
    value = lambda v: q(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"
    rows = ", ".join(f"({k}, {', '.join(map(value, r))})" for k, f in enumerate(corpus.GO_FILES) for r in f[kind])
    moved = ", ".join(f"{c} + below AS {c}" if c in lines.split() else f'"{c}"' for c in names.split())
    return f"""WITH d AS (SELECT 'go/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '.go' AS path, coalesce(doc_id, 0) % {len(corpus.GO_FILES)} AS k, len(string_split(coalesce(text, ''), chr(10))) AS below FROM documents)
SELECT path, {moved} FROM d JOIN (VALUES {rows}) AS v(k, {", ".join(f'"{c}"' for c in names.split())}) USING (k)"""


def _repository() -> str:
    """The files of both commits, with their objects' ids."""
    side = lambda k: f"""f{k} AS (SELECT 'a' || (i >> 24) || '/b' || (i >> 16) % 256 || '/c' || (i >> 8) % 256 || '/' || name AS path, sha1('blob ' || strlen(content) || chr(0) || content) AS oid,
 string_split(content, chr(10)) AS lines FROM (SELECT *, CAST(regexp_extract(name, '^[0-9]+') AS BIGINT) AS i FROM (SELECT replace(regexp_replace(path, '^src/[^/]*/', ''), '/', '.') AS name, content FROM docs{k})))"""  # noqa: E731
    return f"WITH {documents(0, 'docs0')},\n{documents(1, 'docs1')},\n{side(0)},\n{side(1)}"


def _ended(lines: str) -> str:
    """Lines with their line ends; what follows the last one is a line if it is not empty."""
    each = f"list_transform({lines}, lambda x, i: CASE WHEN i < len({lines}) THEN x || chr(10) ELSE x END)"
    return f"CASE WHEN {lines}[len({lines})] = '' THEN {each}[:-2] ELSE {each} END"


def oracle_sql() -> dict[str, str]:
    """By query name."""
    one, lined = f"WITH {findings()}", f"WITH {files()}"
    both = f"WITH {findings()}, {findings(1, '2')}"
    title = "array_to_string(list_transform(list_filter(string_split(replace(category, '_', ' '), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
    parts = r"'^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::\d*)?([^?#]*)'"
    u = _trim("url")
    part = lambda k: f"regexp_extract({u}, {parts}, {k})"
    full = r"regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)', 1), '\.git$', '')"
    host = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))"
    dark = lambda at: f"format('{{:02x}}', CAST(floor(CAST('0x' || substr(c, {at}, 2) AS INTEGER) * 0.5) AS INTEGER))"
    functions = f"fn AS (SELECT path, language, name, line_no AS start_line, CAST(0 AS BIGINT) AS end_line, CASE WHEN language IN ('javascript', 'typescript') THEN contains(line, 'export') WHEN language = 'java' THEN contains(line, 'public') WHEN language = 'php' THEN FALSE ELSE NOT starts_with(name, '_') END AS is_exported, CAST(0 AS BIGINT) AS complexity FROM ({_structure(C.FUNCTIONS, ('ruby',))}) WHERE NOT (language = 'java' AND name IN ('if', 'for', 'while', 'switch')) UNION ALL {GO_FUNCTIONS})"
    markers = lambda lines: "\nUNION ALL ".join(f"SELECT path, line_no, {q(k)} AS type, {q('Potential ' + k.replace('_', ' ') + ' usage')} AS description, {_start('line', p)} + 1 AS \"column\", {_trim('line')} AS snippet FROM {lines} WHERE regexp_matches(line, {q(p)})" for k, p in C.MARKERS.items())
    snippet = "array_to_string(list_transform(range(greatest(line_no - 2, 1), least(line_no + 2, len(f.lines)) + 1), lambda i: CASE WHEN i = line_no THEN '> ' ELSE '  ' END || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || ' | ' || f.lines[i] || chr(10)), '')"
    catalogue = ", ".join("(" + ", ".join([*(q(x) for x in r[:5]), f"CAST({r[5]} AS DOUBLE)", q(" ".join(r[6]))]) + ")" for r in C.rule_table())
    literal = q(r"""(?s)^((?:\\.|[^"'`\\])*)("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)""")
    return {
        "string_literals": f"""WITH RECURSIVE {files()}, walk(path, line_no, rest, behind, lead, lit) AS (SELECT path, line_no, regexp_replace(line, '\\r$', ''), 0, '', '' FROM lines WHERE regexp_matches(line, {q("[" + chr(34) + chr(39) + "`]")})
 UNION ALL SELECT path, line_no, substr(rest, length(regexp_extract(rest, {literal})) + 1), behind + strlen(regexp_extract(rest, {literal})), regexp_extract(rest, {literal}, 1), regexp_extract(rest, {literal}, 2) FROM walk WHERE regexp_matches(rest, {literal}))
SELECT path, line_no, lit[2:-2] AS value, CAST(behind - strlen(lit) + 1 AS BIGINT) AS "column", starts_with(lit, '`') AS is_raw, starts_with(lit, '`') AND contains(lit, '${{') AS is_template FROM walk WHERE length(lit) > 2""",
        "applied_fixes": f"""{one}, fx AS (SELECT file_path, line_start, match_text, replacement FROM found WHERE replacement IS NOT NULL),
nl AS (SELECT l.path, l.line_no, l.line, CASE WHEN f.match_text IS NULL THEN l.line ELSE substr(l.line, 1, instr(l.line, f.match_text) - 1) || f.replacement || substr(l.line, instr(l.line, f.match_text) + length(f.match_text)) END AS x FROM lines l LEFT JOIN fx f ON f.file_path = l.path AND f.line_start = l.line_no WHERE l.path IN (SELECT file_path FROM fx))
SELECT path, sha256(string_agg(x, chr(10) ORDER BY line_no)) AS sha, count(*) FILTER (WHERE x <> line) AS changed_lines FROM nl GROUP BY path""",
        "rate_limiter": """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, n, start, used) AS (SELECT user_id, n, ts, 1 FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.ts - w.start >= INTERVAL 86400 SECOND THEN e.ts ELSE w.start END, CASE WHEN e.ts - w.start >= INTERVAL 86400 SECOND THEN 1 ELSE w.used + 1 END FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.n = w.n + 1)
SELECT user_id, count(*) FILTER (WHERE used <= 3) AS allowed, count(*) FILTER (WHERE used > 3) AS refused FROM walk GROUP BY user_id""",
        "rule_severity_counts": f"{lined} SELECT rule_id, severity, count(*) AS n FROM ({pattern_hits()}) GROUP BY rule_id, severity",
        "scan_filters": f"WITH {documents()} SELECT path, size, {LANGUAGE} AS language FROM docs WHERE size <= 4000 AND NOT contains(path, 'src/src1/') AND NOT contains(path, 'c9/3') AND NOT starts_with(regexp_replace(path, '/[^/]*$', ''), 'src/src1') AND NOT starts_with(regexp_replace(path, '/[^/]*$', ''), 'c9/3') AND NOT ends_with(path, '.css') AND {LANGUAGE} IS NOT NULL",
        "scan_file_cap": f"WITH {documents()} SELECT path FROM docs ORDER BY string_split(path, '/') LIMIT 100",
        "scan_path_prefix": f"WITH {documents()} SELECT 'repo/y/' || path AS path FROM docs",
        "binary_test": r"SELECT doc_id, doc_id % 11 = 0 OR (CASE WHEN doc_id % 7 = 0 THEN 800 ELSE 0 END) > 0.3 * least(8000, strlen(coalesce(text, '')) + CASE WHEN doc_id % 7 = 0 THEN 800 ELSE 0 END) AS is_binary FROM documents WHERE doc_id IS NOT NULL",
        "regular_files": "SELECT 'd' || doc_id % 16 || '/e' || doc_id % 3 || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents WHERE doc_id % 5 <> 0",
        "lines_by_language": f"{lined} SELECT language, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM files GROUP BY language",
        "pages_line_counts": "SELECT 'pages/' || page_id || '.html' AS path, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size, CAST(len(string_split(coalesce(html, ''), chr(10))) AS BIGINT) AS line_count FROM pages",
        "conversations_line_counts": "SELECT path, CAST(strlen(content) AS BIGINT) AS size, CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count FROM (SELECT 'chats/' || conv_id || '.md' AS path, string_agg(text, chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id)",
        "line_classes": f"WITH RECURSIVE {files()}, {_classes()} SELECT * FROM classes",
        "pattern_findings": f"{lined} SELECT {_finding_columns()} FROM ({pattern_hits()})",
        "sql_injection_findings": f"{lined} SELECT {_finding_columns(', description')} FROM ({language_hits(C.SQL_INJECTION)})",
        "xss_findings": f"{lined} SELECT {_finding_columns(', description')} FROM ({language_hits(C.XSS)})",
        "secrets_findings": f"{lined} SELECT path, line_no, 'secrets' AS rule_id, 'critical' AS severity, 'secrets' AS category, CAST(0.8 AS DOUBLE) AS confidence, {_start('line', C.SECRETS_REGEX)} AS match_start, {_start('line', C.SECRETS_REGEX)} + strlen(regexp_extract(line, {q(C.SECRETS_REGEX)})) AS match_end, regexp_extract(line, {q(C.SECRETS_REGEX)}) AS match_text FROM lines WHERE regexp_matches(line, {q(C.SECRETS_REGEX)})",
        "code_snippets": f"{lined} SELECT h.path, h.line_no, h.rule_id, {snippet} AS code_snippet FROM ({pattern_hits()}) h JOIN files f USING (path)",
        "security_markers": f"{lined} {markers('lines')}",
        "page_markers": f"WITH pl AS (SELECT page_id AS path, 1 AS line_no, unnest(string_split(coalesce(html, ''), chr(10))) AS line FROM pages) SELECT type, count(*) AS n FROM ({markers('pl')}) GROUP BY type",
        "file_suppressions": f"{lined}, {suppressed()} SELECT path, array_to_string(list_sort(off), ',') AS off FROM off",
        "suppressed_findings": f"{lined}, {suppressed()} SELECT path, line_no, rule_id, match_text FROM kept",
        "rule_selection": f"{lined}, {suppressed()} SELECT path, line_no, rule_id, match_text FROM kept WHERE lower(rule_id) IN ('xss', 'rule-tls-001') OR lower(category) IN ('xss', 'rule-tls-001')",
        "findings": f"{one} SELECT fingerprint, rule_id, title, severity, category, file_path, line_start, line_end, column_start, column_end, confidence, cvss_score, cvss_vector, cwe, owasp, urls FROM found",
        "suggested_fixes": f"{one} SELECT fingerprint, summary, CASE WHEN replacement IS NULL THEN 'guidance' ELSE 'safe_replace' END AS kind, match_text AS before, coalesce(replacement, example) AS after, replacement FROM found",
        "imports": f"{lined} SELECT path, language, name, line_no FROM ({_structure(C.IMPORTS, ('python', 'java'))}) UNION ALL {GO_IMPORTS}",
        "functions": f"{lined}, {functions} SELECT * FROM fn",
        "dependencies": f"WITH {_manifests()} SELECT path, name, version, line_no FROM deps",
        "vulnerable_dependencies": f"WITH {_manifests()}, {KNOWN} SELECT path, line_no, 'Vulnerable dependency: ' || name AS title, severity, name || ' version ' || version || ' is vulnerable to ' || cve || ': ' || description AS description, name || ' ' || version AS match_text FROM deps JOIN known USING (name) WHERE version <> '' AND {_key('version')} < {_key('bound')}",
        "version_comparison": f"SELECT p_partkey, a, b, CAST(CASE WHEN {_key('a')} < {_key('b')} THEN -1 WHEN {_key('a')} > {_key('b')} THEN 1 ELSE 0 END AS BIGINT) AS c FROM (SELECT p_partkey, {_list(Q.VERSIONS)}[p_partkey % {len(Q.VERSIONS)} + 1] AS a, {_list(Q.VERSIONS)}[p_size % {len(Q.VERSIONS)} + 1] AS b FROM part)",
        "severity_histogram": f"{one} SELECT count(*) AS total, {_counts(C.SEVERITIES)} FROM found",
        "exit_gate": f"{one} SELECT count(*) FILTER (WHERE severity = 'critical') > 0 AS failed FROM found",
        "findings_by_category": f"{one} SELECT category, count(*) AS n FROM found GROUP BY category",
        "findings_by_rule": f"{one} SELECT rule_id, count(*) AS n, round(avg(confidence), 6) AS average_confidence FROM found GROUP BY rule_id",
        "remediation_roadmap": f"{one} SELECT row_number() OVER (ORDER BY w DESC) AS priority, severity, n AS count, {_case('severity', C.SLA)} AS sla FROM (SELECT severity, count(*) AS n, max(weight) AS w FROM found GROUP BY severity)",
        "report_findings": f"{one} SELECT 'f-' || left(fingerprint, 12) AS anchor, CAST(weight AS BIGINT) AS weight, file_path, line_start, CASE WHEN cvss_score <= 0 THEN '—' ELSE printf('%.1f (%s)', cvss_score, CASE WHEN cvss_score >= 9 THEN 'Critical' WHEN cvss_score >= 7 THEN 'High' WHEN cvss_score >= 4 THEN 'Medium' ELSE 'Low' END) END AS cvss, {title} AS category FROM found",
        "sarif_results": f"{one} SELECT fingerprint, rule_id AS rule, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity IN ('low', 'info') THEN 'note' ELSE 'warning' END AS level, line_start AS line, replacement FROM found",
        "capped_findings": f"{one} SELECT row_number() OVER (ORDER BY file_path, line_start, rule_id, coalesce(column_start, 0), fingerprint) AS index, (SELECT count(*) FROM found) > 150 AS truncated, file_path, line_start, rule_id, column_start, fingerprint FROM found ORDER BY 1 LIMIT 150",
        "data_uris": "SELECT item_id, CASE WHEN length(text) % 3 <> 0 THEN 'data:image/png;base64,' || base64(encode(text)) END AS uri FROM benchmark",
        "text_output": f"{one} SELECT fingerprint, '[' || upper(severity) || '] ' || file_path || ':' || line_start || ' ' || title || ' (' || rule_id || ')' AS line FROM found",
        "json_output": f"{one} SELECT fingerprint, rule_id, line_start, severity FROM found",
        "delta_new": f"{both} {_whole('found', 'found2')}",
        "delta_resolved": f"{both} {_whole('found2', 'found')}",
        "delta_classified": f"{both} SELECT change, count(*) AS n FROM (SELECT DISTINCT fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM found2) THEN 'unchanged' ELSE 'new' END AS change FROM found UNION ALL SELECT DISTINCT fingerprint, 'resolved' FROM found2 WHERE fingerprint NOT IN (SELECT fingerprint FROM found)) GROUP BY change",
        "stored_delta": f"{both} SELECT change, count(*) AS n FROM (SELECT DISTINCT fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM found2) THEN 'unchanged' ELSE 'new' END AS change FROM found UNION ALL SELECT DISTINCT fingerprint, 'resolved' FROM found2 WHERE fingerprint NOT IN (SELECT fingerprint FROM found)) GROUP BY change",
        "delta_counts": f"{both} SELECT count(*) FILTER (WHERE fingerprint NOT IN (SELECT fingerprint FROM found2)) AS new, (SELECT count(DISTINCT fingerprint) FROM found2 WHERE fingerprint NOT IN (SELECT fingerprint FROM found)) AS resolved, count(*) FILTER (WHERE fingerprint IN (SELECT fingerprint FROM found2)) AS unchanged FROM found",
        "baseline_validity": f"{one}, b AS (SELECT CASE WHEN line_start % 5 = 0 THEN upper(fingerprint) ELSE fingerprint END AS f FROM found) SELECT count(*) AS entries, count(*) FILTER (WHERE regexp_matches(f, '^[0-9a-f]{{32}}$')) AS valid, count(*) <= 10000 AND count(*) = count(*) FILTER (WHERE regexp_matches(f, '^[0-9a-f]{{32}}$')) AS accepted FROM b",
        "findings_page": f"{one} SELECT severity, line_start, file_path, fingerprint FROM found ORDER BY severity, line_start, file_path, fingerprint LIMIT 200 OFFSET 200",
        "previous_scans": f"WITH {SCANS} SELECT s.scan_id, (SELECT p.scan_id FROM scans p WHERE p.repository_id = s.repository_id AND p.created_at < s.created_at AND p.status = 'completed' ORDER BY p.completed_at DESC, p.scan_id DESC LIMIT 1) AS previous_id FROM scans s",
        "visible_findings": f"WITH {STORED} SELECT severity, count(*) AS n FROM stored WHERE NOT is_false_positive AND NOT suppressed GROUP BY severity",
        "query_builder": f"WITH {STORED} SELECT category, count(*) AS n FROM stored WHERE severity = 'high' AND line >= 2 AND created_at < TIMESTAMP '1997-01-01' GROUP BY category",
        "query_builder_page": f"WITH {STORED} SELECT scan_id, line, category FROM stored WHERE severity = 'high' ORDER BY created_at DESC, scan_id, line LIMIT 40 OFFSET 25",
        "query_builder_count": f"WITH {STORED} SELECT count(*) AS n FROM stored WHERE severity = 'low' AND line >= 3",
        "baseline_selection": f"WITH {SCANS}, me AS (SELECT * FROM scans WHERE scan_id = 33) SELECT scan_id, (SELECT p.scan_id FROM scans p WHERE p.repository_id = me.repository_id AND p.created_at < me.created_at AND p.status = 'completed' ORDER BY p.completed_at DESC, p.scan_id DESC LIMIT 1) AS baseline_id, NULL AS problem FROM me UNION ALL SELECT me.scan_id, o.scan_id, CASE WHEN o.scan_id IS NULL THEN 'baseline not found' WHEN o.scan_id = me.scan_id THEN 'baseline is the scan itself' WHEN o.repository_id IS DISTINCT FROM me.repository_id THEN 'baseline is of another repository' WHEN o.status <> 'completed' THEN 'baseline is not completed' END FROM me, (VALUES (33), (1), (3), (-7)) v(b) LEFT JOIN scans o ON o.scan_id = v.b",
        "vulnerability_statistics": f"WITH {SCANS}, {STORED} SELECT repository_id, strftime(v.created_at, '%Y-%m-%d') AS date, severity, category, count(*) AS count, count(*) FILTER (WHERE is_false_positive) AS false_positive_count, count(*) FILTER (WHERE suppressed) AS suppressed_count, count(*) FILTER (WHERE fixed_at IS NOT NULL) AS fixed_count FROM stored v JOIN scans s USING (scan_id) GROUP BY ALL",
        "database_findings": f"WITH {STORED} SELECT severity, category, count(*) AS n, max(scan_id) AS last_scan FROM (SELECT scan_id, line, max(severity) AS severity, max(category) AS category, bool_or(suppressed) AS off FROM stored WHERE scan_id IS NOT NULL AND line IS NOT NULL GROUP BY scan_id, line) WHERE NOT coalesce(off, false) GROUP BY severity, category",
        "scan_counters": f"WITH {STORED}, {COUNTERS} SELECT * FROM counters",
        "repository_scan_summary": f"WITH {SCANS}, {STORED}, {COUNTERS}, per AS (SELECT repository_id, count(*) AS total_scans, max((created_at, scan_id))[2] AS last_scan_id FROM scans GROUP BY repository_id) SELECT c_custkey AS repository_id, c_name AS full_name, coalesce(total_scans, 0) AS total_scans, last_scan_id, s.status AS last_scan_status, CASE WHEN s.scan_id IS NOT NULL THEN coalesce(k.total_vulnerabilities, 0) END AS last_scan_vulnerabilities, CASE WHEN s.scan_id IS NOT NULL THEN coalesce(k.critical_count, 0) END AS last_scan_critical, CASE WHEN s.scan_id IS NOT NULL THEN coalesce(k.high_count, 0) END AS last_scan_high FROM customer LEFT JOIN per ON c_custkey = per.repository_id LEFT JOIN scans s ON s.scan_id = last_scan_id LEFT JOIN counters k ON k.scan_id = last_scan_id",
        "streamed_counters": f"WITH stored AS (SELECT DISTINCT l_orderkey AS scan_id, l_linenumber, l_partkey, l_suppkey, {_list(C.SEVERITIES)}[l_linenumber % 5 + 1] AS severity, l_quantity > 45 AS gone FROM lineitem) SELECT scan_id, count(*) FILTER (WHERE NOT gone) AS total_vulnerabilities, {', '.join(f"count(*) FILTER (WHERE NOT gone AND severity = '{x}') AS {x}_count" for x in C.SEVERITIES)} FROM stored GROUP BY scan_id",
        "decoded_metadata": f"{one} SELECT fingerprint, CASE WHEN line_start % 7 <> 0 THEN cwe END AS cwe, CASE WHEN line_start % 7 <> 0 THEN urls END AS urls, CASE WHEN line_start % 5 <> 0 THEN replacement END AS replacement, concat_ws(' ', CASE WHEN line_start % 7 = 0 THEN 'refs' END, CASE WHEN line_start % 5 = 0 THEN 'fix' END) AS damaged FROM found",
        "code_totals": f"WITH RECURSIVE {files()}, {_classes()} SELECT count(*) AS total_files, CAST(sum(line_count) AS BIGINT) AS total_lines, CAST(sum(code) AS BIGINT) AS code_lines, CAST(sum(comment) AS BIGINT) AS comment_lines, CAST(sum(blank) AS BIGINT) AS blank_lines, round(avg(size), 4) AS average_file_size FROM files JOIN classes USING (path)",
        "largest_files": f"{lined} SELECT path, line_count, size FROM files ORDER BY line_count DESC, path DESC LIMIT 10",
        "file_complexity": f"{lined}, {COMPLEXITY} SELECT path, round(complexity, 6) AS complexity FROM complexity",
        "complexity_score": f"{lined}, {COMPLEXITY} SELECT round(coalesce(greatest(0, least(100, 100 - avg(complexity) * 5)), 100), 6) AS complexity_score FROM complexity",
        "duplication_score": f"{lined}, t AS (SELECT {_trim('line')} AS t FROM lines) SELECT round(coalesce(count(DISTINCT t)::DOUBLE / nullif(count(*), 0) * 100, 100), 6) AS duplication_score FROM t WHERE strlen(t) >= 10",
        "function_metrics": f"{lined}, {functions} SELECT count(*) AS total_functions, round(coalesce(avg(greatest(end_line - start_line + 1, 1)), 0), 6) AS average_function_size, coalesce(max(greatest(end_line - start_line + 1, 1)), 0) AS largest_function, count(*) FILTER (WHERE is_exported) AS exported_functions, round(coalesce(avg(complexity), 0), 6) AS average_complexity FROM fn",
        "code_summary": f"{lined}, {COMPLEXITY}, {functions} SELECT (SELECT count(*) FROM files) AS total_files, round(coalesce(greatest(0, least(100, 100 - (SELECT avg(complexity) FROM complexity) * 5)), 100), 6) AS complexity_score, (SELECT count(*) FROM files WHERE language = 'python') AS python_files, (SELECT path FROM files ORDER BY line_count DESC, path DESC LIMIT 1) AS largest, (SELECT least(10, count(*)) FROM files) AS n_largest, (SELECT count(*) FROM fn) AS total_functions",
        "scan_lifecycle": f"SELECT status, target, count(*) AS scans, (status, target) IN ({', '.join(f'({q(a)}, {q(b)})' for a, bs in store.NEXT.items() for b in bs)}) AS allowed FROM (SELECT {_case('o_orderpriority[1]', Q.STATUSES)} AS status, {_case('CAST(o_custkey % 5 + 1 AS VARCHAR)', Q.STATUSES)} AS target FROM orders) GROUP BY status, target",
        "language_extensions": f"{lined}, e AS (SELECT language, string_agg(extension, ' ' ORDER BY extension) AS extensions FROM (VALUES {', '.join(f'({q(v)}, {q(k)})' for k, v in C.EXTENSIONS.items())}) AS t(language, extension) GROUP BY language) SELECT e.language, e.extensions, (SELECT count(*) FROM files f WHERE f.language = e.language) AS files FROM e",
        "severity_bars": f"{one} SELECT severity, count(*) * 100 // (SELECT count(*) FROM found) AS percent FROM found GROUP BY severity",
        "cvss_bands": f"{one} SELECT CASE WHEN cvss_score >= 9 THEN 'Critical' WHEN cvss_score >= 7 THEN 'High' WHEN cvss_score >= 4 THEN 'Medium' WHEN cvss_score > 0 THEN 'Low' ELSE 'None' END AS band, count(*) AS n FROM found GROUP BY band",
        "url_validation": f"WITH {URLS} SELECT page_id, lower({part(1)}) IN ('https', 'ssh') AND NOT (regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#@]*@') AND (lower({part(1)}) = 'https' OR contains({part(2)}, ':'))) AND lower({part(3)}) IN ('github.com', 'gitlab.com', 'bitbucket.org') AND NOT contains({part(4)}, '..') AS allowed FROM urls",
        "repository_from_url": f"WITH {URLS} SELECT page_id, string_split({full}, '/')[-1] AS name, {full} AS full_name, CASE WHEN contains({host}, 'github') THEN 'github' WHEN contains({host}, 'gitlab') THEN 'gitlab' WHEN contains({host}, 'bitbucket') THEN 'bitbucket' ELSE 'generic' END AS provider FROM urls WHERE starts_with(url, 'https://')",
        "changed_files": "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(coalesce(text, '')) AS hash, doc_id FROM documents), a AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old/' || path ELSE path END AS path, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE hash END AS was FROM d), b AS (SELECT path, hash AS now FROM d) SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE was IS NULL OR now IS NULL OR was <> now",
        "go_functions": _go(1, "name start_line end_line is_exported complexity parameters return_type", "start_line end_line"),
        "go_call_sites": _go(2, "name receiver line_no column is_method", "line_no"),
        "go_imports": _go(3, "name alias line_no", "line_no"),
        "git_files": f"{_repository()} SELECT path, '100644' AS mode, oid FROM f1",
        "git_changes": f"{_repository()} SELECT path, CASE WHEN f0.oid IS NULL THEN 'added' WHEN f1.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change, f0.oid AS old_oid, f1.oid AS new_oid FROM f0 FULL JOIN f1 USING (path) WHERE f0.oid IS DISTINCT FROM f1.oid",
        "git_line_changes": f"{_repository()} SELECT path, CAST(len(n) - len(o) AS BIGINT) AS gained, (SELECT min(i) FROM unnest(range(1, 2 + greatest(len(o), len(n)))) AS t(i) WHERE o[i] IS DISTINCT FROM n[i]) AS first_line FROM (SELECT path, {_ended('f0.lines')} AS o, {_ended('f1.lines')} AS n FROM f0 JOIN f1 USING (path) WHERE f0.oid <> f1.oid)",
        "git_branches": "SELECT name, author, last_commit, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS files FROM (VALUES " + ", ".join(f"({q(b)}, {q(a)}, CAST({t} AS BIGINT))" for _, a, t, b in corpus.COMMITS) + ") AS b(name, author, last_commit)",
        "recent_commits": "SELECT event_id AS commit_id FROM events ORDER BY ts DESC, event_id LIMIT 25",
        "rule_catalogue": f"{lined}, n AS (SELECT rule_id, count(*) AS n FROM ({pattern_hits()}) GROUP BY rule_id) SELECT t.*, coalesce(n.n, 0) AS n FROM (VALUES {catalogue}) AS t(rule_id, title, severity, category, cwe, confidence, refs) LEFT JOIN n USING (rule_id)",
        "branding_colours": f"WITH c AS (SELECT doc_id, '#' || left(md5(CAST(doc_id AS VARCHAR)), 6) || CASE WHEN doc_id % 10 = 0 THEN 'g' ELSE '' END AS c FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, CASE WHEN regexp_matches(c, '^#[0-9a-fA-F]{{6}}$') THEN '#' || {dark(2)} || {dark(4)} || {dark(6)} ELSE c END AS dark FROM c",
    }
