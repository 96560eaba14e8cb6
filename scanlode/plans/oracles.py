"""The registered queries as DuckDB SQL, from the same rule and template tables."""

from __future__ import annotations

from scanlode.functions import columns as C
from scanlode.functions.domains import LOW_RULES, MEDIUM_RULES, TAINT_RULES
from scanlode.functions.rules import BUILTIN, FAMILY, FLAGS, REPEATING
from scanlode.operators import dependencies, js_flow, line_scan, py_ast, secrets
from scanlode.operators.reports import LEVELS
from scanlode.plans.queries import OWN_PATTERN
from scanlode.sources import corpus, manifests
from scanlode.sources.corpus import answers_sql, source_files_sql


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _among(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


_NL = "chr(10)"
_LINE = "1 + len(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], '')) - len(replace(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], ''), chr(10), ''))"


def _cut(pattern: str, label: str, where: str) -> str:
    p = _q(pattern)
    return f"SELECT file_path, content, language, {label}, regexp_extract_all(content, {p}) AS m, string_split_regex(content, {p}) AS g FROM source_files WHERE {where} AND regexp_matches(content, {p})"


def _matches(languages: tuple[str, ...] | None = None) -> str:
    """CTE ``matches``: a row per match of every rule."""
    parts = []
    for r in BUILTIN:
        langs = [k for k, v in FAMILY.items() if v == r.language and (languages is None or k in languages)]
        if langs:
            label = f"{_q(r.rule_id)} AS rule_id, {_q(r.rule_name)} AS rule_name, {_q(r.severity)} AS severity, {_q(FLAGS + r.unless if r.unless else '')} AS unless, {r.gated} AS gated"
            parts.append(_cut(FLAGS + r.pattern, label, f"language IN {_among(langs)}"))
    return f"""cuts AS ({' UNION ALL '.join(parts)}),
matches AS (
  SELECT * FROM (
    SELECT file_path, content, language, rule_id, rule_name, severity, unless, gated, i, m[i] AS text, CAST({_LINE} AS INTEGER) AS line_number
    FROM cuts, unnest(generate_series(1, len(m))) AS s(i))
  WHERE unless = '' OR NOT regexp_matches(text, unless)),
lined AS (SELECT *, regexp_replace(string_split(content, {_NL})[line_number], '\\s+$', '') AS snippet FROM matches)"""


def _once(source: str, extra: str = "") -> str:
    label = "CASE WHEN language = 'kotlin' THEN 'java' ELSE language END"
    return f"""SELECT file_path, line_number, rule_id, any_value(rule_name) AS rule_name, any_value(severity) AS severity, any_value({label}) AS language, any_value(snippet) AS snippet{extra}
FROM {source} GROUP BY file_path, line_number, rule_id, CASE WHEN language IN {_among(REPEATING)} THEN i ELSE -1 END"""


def _flow() -> str:
    """CTE ``flows``: script matches, gated ones only with a flow."""
    name, assign, source = _q(js_flow.NAME), _q(js_flow.ASSIGNMENT), _q("(?i)" + js_flow.SOURCES)
    left, right = f"regexp_extract(x, {assign}, 1)", f"regexp_extract(x, {assign}, 2)"
    return f"""tainted AS (
  SELECT file_path, string_split(list_reduce(string_split(content, {_NL}), lambda acc, x:
      CASE WHEN {left} <> '' AND (regexp_matches({right}, {source}) OR list_has_any(regexp_extract_all({right}, {name}), string_split(acc, '|'))) THEN acc || '|' || {left} ELSE acc END, ''), '|') AS names,
    list_transform(list_filter(string_split(content, {_NL}), lambda x: {left} <> '' AND regexp_matches({right}, {_q(js_flow.CLEANERS)})), lambda x: {left}) AS clean
  FROM source_files WHERE language IN ('javascript', 'typescript')),
flowing AS (
  SELECT l.*, regexp_matches(snippet, {source}) OR regexp_matches(text, {source}) AS direct,
    list_sort(list_distinct(list_intersect(regexp_extract_all(text, {name}) || regexp_extract_all(snippet, {name}), names))) AS used, clean
  FROM lined l LEFT JOIN tainted t USING (file_path)),
flows AS (
  SELECT *, CASE WHEN NOT gated THEN '' WHEN direct THEN 'direct_source' ELSE array_to_string(used, ',') END AS sources
  FROM flowing WHERE NOT gated OR direct OR len(list_filter(used, lambda x: NOT list_contains(clean, x))) > 0)"""


def _lines(where: str) -> str:
    return f"(SELECT file_path, language, i AS line_number, string_split(content, {_NL})[i] AS line FROM source_files, unnest(generate_series(1, len(string_split(content, {_NL})))) AS s(i) WHERE {where})"


def _shell() -> str:
    which = " ".join(f"WHEN regexp_matches(line, {_q(p)}) THEN {i}" for i, (_, _, _, p) in enumerate(line_scan.SHELL))
    ids, names, sevs = ([x[k] for x in line_scan.SHELL] for k in range(3))
    pick = lambda v: "[" + ", ".join(map(_q, v)) + "][k + 1]"
    return f"""SELECT file_path, CAST(line_number AS INTEGER) AS line_number, {pick(ids)} AS rule_id, {pick(names)} AS rule_name, {pick(sevs)} AS severity, language, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS snippet
FROM (SELECT *, CASE {which} END AS k FROM {_lines("language = 'bash'")} WHERE NOT regexp_matches(line, '^\\s*#')) WHERE k IS NOT NULL"""


def _config() -> str:
    pair = _q(line_scan.PAIR)
    value = ", ".join(f"nullif(regexp_extract(t, {pair}, {g}), '')" for g in (2, 3, 4))
    return f"""SELECT file_path, CAST(line_number AS INTEGER) AS line_number, CASE WHEN language = 'yaml' THEN 'CFG003' ELSE 'CFG001' END AS rule_id,
  CASE WHEN language = 'yaml' THEN 'Credential in a YAML file' ELSE 'Credential in a configuration file' END AS rule_name, 'HIGH' AS severity, language, t AS snippet
FROM (SELECT *, trim(coalesce({value})) AS v, regexp_extract(t, {pair}, 1) AS k FROM (SELECT *, trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS t FROM {_lines("language IN ('env', 'ini', 'toml', 'conf', 'yaml')")}) WHERE t <> '' AND NOT regexp_matches(t, '^[#;]'))
WHERE k <> '' AND regexp_matches(k, {_q(line_scan.SECRET_KEY)}) AND len(v) >= 6 AND NOT regexp_matches(v, {_q(line_scan.PLACEHOLDER)})"""


_BITS = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / len({0}) AS p FROM unnest(string_split({0}, '')) AS c(x) WHERE x <> '' GROUP BY x))"


def _secret_matches(source: str = "source_files") -> str:
    """CTE ``secret_rows``: matches that count as secrets."""
    rules = [(i, n, "HIGH", p) for i, n, _, p in secrets.TOKENS] + [("SEC013", "Credential assigned in source", "HIGH", secrets.ASSIGNMENT), ("SEC014", "High-entropy text", "MEDIUM", secrets.LITERAL)]
    cuts = " UNION ALL ".join(_cut(p, f"{_q(i)} AS rule_id, {_q(n)} AS rule_name, {_q(s)} AS severity", "language IS NOT NULL") for i, n, s, p in rules).replace("FROM source_files", f"FROM {source}")
    return f"""secret_cuts AS ({cuts}),
secret_found AS (
  SELECT *, regexp_extract(text, {_q(secrets.VALUE)}, 1) AS value, replace(replace(text, '"', ''), chr(39), '') AS bare FROM (
    SELECT file_path, content, language, rule_id, rule_name, severity, m[i] AS text, CAST({_LINE} AS INTEGER) AS line_number FROM secret_cuts, unnest(generate_series(1, len(m))) AS s(i))),
secret_rows AS (
  SELECT f.* FROM secret_found f WHERE CASE rule_id
    WHEN 'SEC013' THEN NOT regexp_matches(value, {_q(secrets.HARMLESS)}) AND NOT regexp_matches(value, {_q(secrets.CONSTANT)})
    WHEN 'SEC014' THEN regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[A-Za-z]') AND NOT regexp_matches(bare, {_q(secrets.HARMLESS)}) AND {_BITS.format('bare')} >= {secrets.LEAST_BITS}
    ELSE TRUE END)"""


_SECRETS = """SELECT file_path, line_number, rule_id, any_value(rule_name) AS rule_name, any_value(severity) AS severity, any_value(language) AS language,
  regexp_replace(string_split(any_value(content), chr(10))[line_number], '\\s+$', '') AS snippet
FROM secret_rows r WHERE rule_id <> 'SEC014' OR NOT EXISTS (SELECT 1 FROM secret_rows o WHERE o.file_path = r.file_path AND o.line_number = r.line_number AND o.rule_id <> 'SEC014')
GROUP BY file_path, line_number, rule_id"""


def _silent(enforce: bool = False) -> str:
    ids = "regexp_extract(snippet, 'scanlode:\\s*ignore\\[([^\\]]+)\\]', 1)"
    until = "regexp_extract(snippet, '\\buntil\\s*=\\s*(\\d{4}-\\d{2}-\\d{2})', 1)"
    told = f" AND {until} <> '' AND regexp_extract(snippet, '\\breason\\s*=\\s*([^\\s]+)', 1) <> ''" if enforce else ""
    return f"(contains(snippet, 'scanlode: ignore') AND ({ids} = '' OR list_contains(list_transform(string_split({ids}, ','), lambda x: trim(x)), rule_id)) AND ({until} = '' OR coalesce(TRY_CAST({until} AS DATE) >= DATE '2025-01-01', FALSE)){told})"


def _interpreted() -> str:
    """CTE ``interpreted``: findings that need an interpreter, from the labelled answers of their templates."""
    names = ", ".join(f"({_q(r[0])}, {_q(r[1])})" for r in (*py_ast.RULES, py_ast.RACE, ("CFG002", "Credential in a JSON file")))
    return f"""{answers_sql()}, names(rule_id, rule_name) AS (VALUES {names}),
interpreted AS (
  SELECT file_path, line_number, rule_id, rule_name, severity, language,
    CASE WHEN language = 'json' THEN '"api_key": "********..."' ELSE regexp_replace(string_split(content, {_NL})[line_number], '\\s+$', '') END AS snippet, sources, own
  FROM source_files JOIN answers USING (template) JOIN names USING (rule_id))"""


def _confidence() -> str:
    return f"""CASE WHEN rule_id IN {_among(LOW_RULES)} THEN 'LOW' WHEN rule_id IN {_among(MEDIUM_RULES)} THEN 'MEDIUM'
      WHEN rule_id IN {_among(TAINT_RULES)} THEN CASE WHEN sources <> '' THEN 'HIGH' ELSE 'MEDIUM' END ELSE own END"""


def _seen(files: str | None = None) -> str:
    """CTE ``seen``: findings, silenced ones gone, calibrated, with fingerprints."""
    one = "file_path, line_number, rule_id, rule_name, severity, language, snippet, sources"
    found = _once("flows", ", min(sources) AS sources")
    return f"""{files or source_files_sql()}, {_matches()}, {_flow()}, {_secret_matches()}, {_interpreted()},
found AS (
  SELECT {one}, 'HIGH' AS own FROM ({found})
  UNION ALL SELECT {one.replace('sources', "'' AS sources")}, 'HIGH' FROM ({_shell()})
  UNION ALL SELECT {one.replace('sources', "'' AS sources")}, 'MEDIUM' FROM ({_config()})
  UNION ALL SELECT {one.replace('sources', "'' AS sources")}, 'HIGH' FROM ({_SECRETS})
  UNION ALL SELECT {one}, own FROM interpreted),
seen AS MATERIALIZED (
  SELECT *, {_confidence()} AS confidence,
    sha1(concat_ws('|', rule_id, file_path, CAST(line_number AS VARCHAR), trim(snippet), language)) AS fingerprint
  FROM found WHERE NOT {_silent()})"""


def _tree(where: str = "TRUE") -> str:
    """``source_files`` of the tree of suppliers' files that a scan enters."""
    return f"all_{source_files_sql('supplier', 's_suppkey', corpus.FOLDERS).replace('source_files AS', 'tree_files AS')}, source_files AS (SELECT * FROM tree_files WHERE tier IS NOT NULL AND left(file_path, 4) = 'src/' AND {where})".removeprefix("all_")


_COLUMNS = "file_path, line_number, rule_id, severity, language, snippet"
_MATRIX = "CAST(count(*) FILTER (predicted AND expect_finding) AS BIGINT) AS tp, CAST(count(*) FILTER (predicted AND NOT expect_finding) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT predicted AND NOT expect_finding) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT predicted AND expect_finding) AS BIGINT) AS fn"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _predicted() -> str:
    return f"""{_seen()},
cases AS (SELECT file_path AS name, expected AS expected_rule, expected IS NOT NULL AS expect_finding FROM source_files WHERE language IS NOT NULL),
predicted AS (
  SELECT name, expected_rule, expect_finding, bool_or(coalesce(hit, FALSE)) AS predicted, min(rank) FILTER (hit) AS best FROM (
    SELECT c.*, s.rule_id IS NOT NULL AND (expected_rule IS NULL OR s.rule_id = expected_rule) AS hit, CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS rank
    FROM cases c LEFT JOIN seen s ON s.file_path = c.name)
  GROUP BY ALL)"""


def _rates(keys: str, source: str) -> str:
    p, r = _ratio("tp", "tp + fp"), _ratio("tp", "tp + fn")
    return f"""SELECT *, {_ratio('2 * precision * recall', 'precision + recall')} AS f1, {_ratio('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_ratio('fp', 'fp + tn')} AS false_positive_rate
FROM (SELECT *, {p} AS precision, {r} AS recall FROM (SELECT {keys}{_MATRIX} FROM {source}))"""


_MODULES = """modules AS (
  SELECT c_custkey AS k, concat('pkg/m', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '.py' ELSE '.js' END) AS file_path FROM customer),
graph AS (
  SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM modules a JOIN modules b ON b.k = a.k // 2 AND right(a.file_path, 3) = right(b.file_path, 3) AND a.k <> b.k)"""


def _manifests(table: str = "part", key: str = "p_partkey", folder: str = "deps/") -> str:
    cases = " ".join(f"WHEN {i} THEN {_q(n)}" for i, (n, _) in enumerate(manifests.templates()))
    texts = " ".join(f"WHEN {i} THEN {_q(t)}" for i, (_, t) in enumerate(manifests.templates()))
    n = len(manifests.templates())
    return f"""files AS (
  SELECT concat({_q(folder)}, {key}, '/', CASE {key} % {n} {cases} END) AS file_path, replace(CASE {key} % {n} {texts} END, '@K@', CAST({key} AS VARCHAR)) AS content, {key} % {n} AS kind FROM {table}),
lines AS (SELECT file_path, kind, content, i, string_split(content, {_NL})[i] AS raw, trim(replace(string_split(content, {_NL})[i], chr(9), ' ')) AS t FROM files, unnest(generate_series(1, len(string_split(content, {_NL})))) AS s(i)),
deps AS (
  SELECT file_path, content, 'PyPI' AS ecosystem, CASE WHEN regexp_matches(t, {_q(dependencies.BARE)}) THEN t ELSE regexp_extract(t, {_q(dependencies.PINNED)}, 1) END AS name, regexp_extract(t, {_q(dependencies.PINNED)}, 2) AS version
  FROM lines WHERE kind = 0 AND t <> '' AND NOT regexp_matches(t, '^(#|-|git\\+|http)')
  UNION ALL
  SELECT file_path, content, 'npm', k, string_split(regexp_replace(json_extract_string(content, concat('$.', section, '."', k, '"')), '^[\\^~>=<v]', ''), ' ')[1]
  FROM files, unnest(['dependencies', 'devDependencies', 'peerDependencies']) AS s(section), unnest(coalesce(json_keys(content, concat('$.', section)), [])) AS e(k) WHERE kind = 1
  UNION ALL
  SELECT file_path, content, 'Go', string_split(d, ' ')[1], regexp_replace(string_split(d, ' ')[2], '^v+', '') FROM (
    SELECT file_path, content, regexp_replace(t, '^require ', '') AS d FROM lines l
    WHERE kind = 2 AND t <> 'require (' AND ((t LIKE 'require %') OR (t <> ')' AND t <> '' AND i > (SELECT min(o.i) FROM lines o WHERE o.file_path = l.file_path AND o.t = 'require (') AND i < (SELECT min(o.i) FROM lines o WHERE o.file_path = l.file_path AND o.t = ')'))))
  UNION ALL
  SELECT file_path, content, 'RubyGems', regexp_extract(raw, '^ {{4}}([^ (]+) +[(][0-9][^)]*[)]', 1), regexp_extract(raw, '^ {{4}}[^ (]+ +[(]([0-9][^)]*)[)]', 1) FROM lines WHERE kind = 3),
dependencies AS (
  SELECT file_path, ecosystem, name, version, CAST(coalesce((SELECT min(l.i) FROM lines l WHERE l.file_path = d.file_path AND contains(l.raw, d.name)), 1) AS INTEGER) AS line FROM deps d WHERE name <> '')"""


def _vulnerable() -> str:
    rows = []
    for i, eco, name, aliases, scores, _, affected in manifests.ADVISORIES:
        numbers = [float(s) for _, s in scores if s.replace(".", "").isdigit() and float(s) >= 4]
        severity = "CRITICAL" if numbers and numbers[0] >= 9 else "HIGH" if numbers and numbers[0] >= 7 else "MEDIUM"
        fixed = next((f for a in affected for r in a[0] for _, f, _ in r[1] if f), None)
        alias = next((a for a in aliases if a.startswith("CVE-")), i)
        rows.append(f"({_q(eco)}, {_q(name)}, {_q(alias)}, {_q(severity)}, {_q(fixed) if fixed else 'NULL'})")
    number = "list_transform(regexp_extract_all({}, '\\d+'), lambda x: CAST(x AS BIGINT))"
    return f"""WITH {_manifests()}, adv(eco, pkg, alias, severity, fixed) AS (VALUES {', '.join(rows)})
SELECT file_path, line AS line_number, concat('SCA-', alias) AS rule_id, severity, concat_ws(' ', name, version) AS snippet,
  CASE WHEN fixed IS NULL THEN 'No fixed version is known.' ELSE concat('Upgrade to ', fixed, ' or later.') END AS fix
FROM dependencies JOIN adv ON ecosystem = eco AND lower(name) = pkg
WHERE version = '' OR fixed IS NULL OR {number.format('version')} < {number.format('fixed')}"""


def _branches() -> str:
    """The answers by hand, for each part's case."""
    severity = {"CVE-2024-1001": "CRITICAL", "CVE-2024-1003": "HIGH"}
    line = {"PyPI": 2, "npm": 1, "Go": 3, "RubyGems": 3}
    rows = [f"({i}, {_q(manifests.SINGLE[eco][0])}, {line[eco]}, {_q('SCA-' + a)}, {_q(severity.get(a, 'MEDIUM'))}, {_q(f'{name} {version}')}, {_q(f'Upgrade to {fix} or later.' if fix else 'No fixed version is known.')})" for i, (eco, name, version, answers) in enumerate(manifests.BRANCH_CASES) for a, fix in answers]
    return f"""WITH answers(i, file, line_number, rule_id, severity, snippet, fix) AS (VALUES {', '.join(rows)})
SELECT concat('branches/', p_partkey, '/', file) AS file_path, line_number, rule_id, severity, snippet, fix FROM part JOIN answers ON p_partkey % {len(manifests.BRANCH_CASES)} = i"""


def oracle_sql() -> dict[str, str]:
    files = source_files_sql()
    family = lambda *langs: f"WITH {files}, {_matches(langs)} SELECT {_COLUMNS} FROM ({_once('lined')})"
    seen = f"WITH {_seen()}"
    bits, measured = f"round({_BITS.format('measured')}, 4) AS bits", "CASE WHEN rule_id = 'SEC013' THEN value ELSE text END AS measured"
    tree = f"WITH {_seen(_tree())}"
    docs = "documents_as_files AS (SELECT doc_id AS file_path, text AS content, 'text' AS language FROM documents)"
    decoded = "numbered"
    for name, char in C.REFERENCES:
        decoded = f"replace({decoded}, {_q(name)}, {_q(char)})"
    code = "CASE WHEN starts_with(lower(c[i]), '&#x') THEN CAST('0x' || regexp_extract(c[i], '[0-9A-Fa-f]+') AS BIGINT) ELSE CAST(regexp_extract(c[i], '[0-9]+') AS BIGINT) END"
    pages = f"""cut_pages AS (SELECT page_id, string_split_regex(html, {_q(C.NUMBERED)}) AS p, regexp_extract_all(html, {_q(C.NUMBERED)}) AS c FROM pages),
numbered_pages AS (SELECT page_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(c) THEN '' ELSE coalesce(chr(CAST({code} AS INTEGER)), '') END), '') AS numbered FROM cut_pages),
pages_as_files AS (SELECT page_id AS file_path, {decoded} AS content, 'html' AS language FROM numbered_pages)"""
    events = "now AS (SELECT event_type AS expected_rule, count(*) FILTER (event_id % 7 <> 0) / count(*) AS precision, count(*) FILTER (event_id % 11 <> 0) / count(*) AS recall FROM events GROUP BY 1)"
    return {
        "route_counts": f"WITH {files} SELECT tier, language, count(*) AS n FROM source_files GROUP BY ALL",
        "script_rules": family("javascript", "typescript"), "java_rules": family("java", "kotlin"), "php_rules": family("php"), "ruby_rules": family("ruby"), "go_rules": family("go"),
        "flow_gate": f"WITH {files}, {_matches(('javascript', 'typescript'))}, {_flow()} SELECT file_path, line_number, rule_id, sources FROM ({_once('flows', ', min(sources) AS sources')})",
        "shell_scan": f"WITH {files} SELECT {_COLUMNS} FROM ({_shell()})",
        "config_scan": f"WITH {files} SELECT {_COLUMNS} FROM ({_config()})",
        "secret_scan": f"WITH {files}, {_secret_matches()} SELECT {_COLUMNS} FROM ({_SECRETS})",
        "document_secrets": f"WITH {docs}, {_secret_matches('documents_as_files')} SELECT file_path AS doc_id, rule_id, line_number, {bits} FROM (SELECT *, {measured} FROM secret_rows)",
        "page_secrets": f"WITH {pages}, {_secret_matches('pages_as_files')} SELECT file_path AS page_id, rule_id, line_number, {bits} FROM (SELECT *, {measured} FROM secret_rows)",
        "suppression": f"WITH {files}, {_matches(('typescript',))} SELECT file_path, line_number, rule_id, {_silent()} AS silent, {_silent(True)} AS silent_enforced FROM ({_once('lined')})",
        "confidence_counts": f"{seen} SELECT rule_id, confidence, count(*) AS n FROM seen GROUP BY ALL",
        "strict_policy": f"{seen} SELECT file_path, line_number, rule_id, severity, confidence FROM seen WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AND confidence IN ('HIGH', 'MEDIUM')",
        "fingerprints": f"{seen} SELECT file_path, line_number, rule_id, fingerprint FROM seen",
        "new_findings": f"{seen} SELECT unnest(kept, recursive := true) FROM (SELECT list({{'file_path': file_path, 'line_number': line_number, 'rule_id': rule_id}}) AS kept FROM seen GROUP BY fingerprint HAVING count(*) FILTER (line_number % 2 = 0) = 0)",
        "python_scan": f"WITH {files}, {_interpreted()} SELECT file_path, line_number, rule_id, severity, own AS confidence, nullif(sources, '') AS sources FROM interpreted WHERE language = 'python'",
        "config_json_scan": f"WITH {files}, {_interpreted()} SELECT {_COLUMNS} FROM interpreted WHERE language = 'json'",
        "full_scan": f"{seen} SELECT file_path, line_number, rule_id, severity, confidence, language, snippet, fingerprint FROM seen",
        "tree_files": f"WITH {_tree()} SELECT file_path, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM source_files",
        "tree_scan": f"""WITH {_seen(_tree("NOT regexp_matches(file_path, '^src/java_[^/]*/') AND right(file_path, 5) <> '.rake'"))}
SELECT file_path, line_number, rule_id, severity, confidence, fingerprint FROM seen WHERE rule_id NOT IN ('CRY102', 'SEC002') AND severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AND confidence IN ('HIGH', 'MEDIUM')""",
        "tree_source_scan": f"""WITH {_seen(_tree("left(file_path, 9) <> 'src/java_' AND regexp_matches(file_path, '[.](py|js|java|rb|sh)$') AND strlen(content) < 160"))}
SELECT file_path, line_number, rule_id, severity, confidence, fingerprint FROM seen""",
        "manifest_tree": f"WITH {_manifests('supplier', 's_suppkey', 'node_modules/deps/')} SELECT * FROM dependencies",
        "baseline_file": f"{tree} SELECT DISTINCT fingerprint FROM seen",
        "json_report": f"{tree} SELECT file_path, line_number, rule_id, rule_name, severity, confidence, language, snippet, fingerprint FROM seen",
        "sarif_report": f"{tree} SELECT rule_id, CASE severity {' '.join(f'WHEN {_q(s)} THEN {_q(x)}' for s, (x, _) in LEVELS.items())} END AS level, file_path AS uri, line_number AS line, snippet, fingerprint FROM seen",
        "sarif_rules": f"{tree} SELECT DISTINCT rule_id, rule_name, CASE severity {' '.join(f'WHEN {_q(s)} THEN {_q(x)}' for s, (_, x) in LEVELS.items())} END AS score FROM seen",
        "cache_file": f"{tree} SELECT file_path, line_number, rule_id, severity, confidence FROM seen JOIN source_files USING (file_path) WHERE key % 2 = 0",
        "cache_merge": f"{tree} SELECT file_path, CAST(strlen(content) + key % 2 AS BIGINT) AS size, CAST(line_number + key % 2 AS INTEGER) AS line_number, rule_id, confidence FROM seen JOIN source_files USING (file_path) WHERE key % 5 <> 0",
        "rescan_changes": f"""WITH {_seen(source_files_sql('customer', 'c_custkey'))},
known AS (SELECT DISTINCT s.file_path, s.rule_id, s.line_number, s.severity, f.key % 3 AS turn FROM seen s JOIN source_files f USING (file_path))
SELECT file_path, 'opened' AS change, rule_id, line_number, severity FROM known
UNION ALL SELECT file_path, 'closed', rule_id, line_number, severity FROM known WHERE turn < 2
UNION ALL SELECT file_path, 'opened', rule_id, line_number + 1, severity FROM known WHERE turn = 0""",
        "history_file": "SELECT CAST(n AS INTEGER) AS files_scanned, CAST(2 * n AS INTEGER) AS findings_total, CAST(n AS INTEGER) AS findings_shown, 'balanced' AS policy FROM (SELECT count(*) AS n FROM nation UNION ALL SELECT count(*) FROM supplier)",
        "own_rules": f"""WITH {files}, cuts AS (SELECT * FROM ({_cut("(?im)" + OWN_PATTERN, "'OWN1' AS rule_id, 'LOW' AS severity", "language IN ('javascript', 'typescript', 'go')")})),
hits AS (SELECT file_path, language, rule_id, severity, content, i, CAST({_LINE} AS INTEGER) AS line_number FROM cuts, unnest(generate_series(1, len(m))) AS s(i))
SELECT file_path, line_number, rule_id, any_value(severity) AS severity, any_value(language) AS language, regexp_replace(string_split(any_value(content), {_NL})[line_number], '\\s+$', '') AS snippet FROM hits GROUP BY file_path, line_number, rule_id, CASE WHEN language = 'go' THEN i ELSE -1 END""",
        "own_detectors": f"""WITH {files}
SELECT file_path, CAST(line_number AS INTEGER) AS line_number, 'OWN2' AS rule_id, 'LOW' AS severity, CAST(NULL AS VARCHAR) AS error FROM {_lines("language IS NOT NULL")} WHERE contains(line, 'SELECT') AND line_number >= 2
UNION ALL SELECT file_path, 1, 'OWN3', 'HIGH', NULL FROM source_files WHERE language = 'bash'
UNION ALL SELECT file_path, NULL, NULL, NULL, 'RuntimeError: no Ruby here' FROM source_files WHERE language = 'ruby'""",
        "labelled_cases": f"WITH {source_files_sql('part', 'p_partkey')} SELECT expected AS expected_rule, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, TRUE AS passed FROM source_files WHERE expected IS NOT NULL GROUP BY expected",
        "long_python_scan": f"""WITH {files}, {_interpreted()},
placed AS (SELECT *, CAST(coalesce(sum(strlen(content) - strlen(replace(content, {_NL}, ''))) OVER (PARTITION BY key // {corpus.TOGETHER} ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS above FROM source_files WHERE language = 'python' AND template NOT IN {_among(corpus.APART)})
SELECT concat('long/f', key // {corpus.TOGETHER}, '.py') AS file_path, above + i.line_number AS line_number, i.rule_id, i.severity, i.own AS confidence FROM placed JOIN interpreted i USING (file_path)""",
        "shard_two_of_three": f"WITH {files} SELECT file_path FROM (SELECT file_path, row_number() OVER (ORDER BY file_path) - 1 AS r FROM source_files) WHERE r % 3 = 1",
        "severity_summary": f"{seen}, counts AS (SELECT d.severity, count(s.severity) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) AS d(severity) LEFT JOIN seen s USING (severity) GROUP BY 1) SELECT * FROM counts UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT) FROM counts",
        "top_rules": f"{seen} SELECT rule_name, count(*) AS n FROM seen GROUP BY 1 ORDER BY n DESC, rule_name LIMIT 5",
        "rule_dictionary": f"{seen} SELECT rule_id, rule_name, severity FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY file_path, line_number) AS r FROM seen) WHERE r = 1",
        "findings_by_file": f"{seen} SELECT file_path, count(*) AS n, string_agg(concat(line_number, ':', rule_id), ' ' ORDER BY line_number, rule_id) AS listed FROM seen GROUP BY 1",
        "import_edges": f"WITH {_MODULES} SELECT src, dst FROM graph",
        "impacted_files": f"WITH RECURSIVE {_MODULES}, reach AS (SELECT unnest(['pkg/m4.py', 'pkg/m3.js']) AS file_path UNION SELECT src FROM graph JOIN reach ON dst = file_path) SELECT file_path FROM reach",
        "cache_hits": "SELECT count(*) FILTER (o_orderkey % 3 <> 0) AS hits, count(*) FILTER (o_orderkey % 3 = 0) AS misses FROM orders",
        "quality_overall": f"WITH {_predicted()} {_rates('', 'predicted')}",
        "quality_by_rule": f"WITH {_predicted()} {_rates('expected_rule, ', 'predicted WHERE expected_rule IS NOT NULL GROUP BY expected_rule')}",
        "quality_by_confidence": f"WITH {_predicted()} SELECT *, {_ratio('tp', 'tp + fp')} AS precision FROM (SELECT ['HIGH', 'MEDIUM', 'LOW'][best + 1] AS strongest, count(*) FILTER (expect_finding) AS tp, count(*) FILTER (NOT expect_finding) AS fp FROM predicted WHERE best IS NOT NULL GROUP BY 1)",
        "quality_violations": f"WITH {events} SELECT expected_rule, metric, 1.0::DOUBLE AS before, round(v, 6) AS now FROM (SELECT expected_rule, 'precision' AS metric, precision AS v FROM now UNION ALL SELECT expected_rule, 'recall', recall FROM now) WHERE 1.0::DOUBLE - v > 0.1::DOUBLE",
        "timing_summary": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS runs, round(avg(value), 6) AS average, min(value) AS least, round(median(value), 6) AS median, max(value) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95, max(value) AS most FROM r GROUP BY event_type""",
        "manifest_dependencies": f"WITH {_manifests()} SELECT * FROM dependencies",
        "quality_budgets": f"""WITH {_predicted()},
overall AS ({_rates('', 'predicted')}), rules AS ({_rates('expected_rule, ', 'predicted WHERE expected_rule IS NOT NULL GROUP BY expected_rule')}),
confidence AS (SELECT ['HIGH', 'MEDIUM', 'LOW'][best + 1] AS name, count(*) FILTER (expect_finding) / count(*) AS precision FROM predicted WHERE best IS NOT NULL GROUP BY 1),
figures AS (
  SELECT 'global' AS scope, 'all' AS name, 'precision' AS metric, 1.0::DOUBLE AS before, precision AS now, 0.001 AS most FROM overall
  UNION ALL SELECT 'global', 'all', 'recall', 1.0, recall, 0.001 FROM overall UNION ALL SELECT 'global', 'all', 'false_positive_rate', 0.0, false_positive_rate, 0.01 FROM overall
  UNION ALL SELECT 'rules', expected_rule, 'precision', 1.0, precision, 0 FROM rules UNION ALL SELECT 'rules', expected_rule, 'recall', 1.0, recall, 0 FROM rules
  UNION ALL SELECT 'confidence', name, 'precision', 1.0, precision, 0.01 FROM confidence)
SELECT scope, name, metric, before, round(now, 6) AS now FROM figures WHERE abs(before - now) > most""",
        "vulnerable_dependencies": _vulnerable(), "dependency_report": _vulnerable(), "advisory_ranges": _branches(),
    }
