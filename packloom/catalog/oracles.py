"""The registered queries in SQL, written independently of the Spark expressions."""

from __future__ import annotations

from packloom import fixed_values as fixed
from packloom.catalog import corpora as made


def _text(value: str) -> str:
    """SQL literal; line breaks and control characters through chr()."""
    out, plain = [], ""
    for c in value:
        if ord(c) < 32 or 127 <= ord(c) < 160:
            out += [f"'{plain}'", f"chr({ord(c)})"] if plain else [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    if plain or not out:
        out.append(f"'{plain}'")
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _map(pairs: dict) -> str:
    return f"map({_list(pairs.keys())}, {_list(pairs.values())})"


def _pick(number: str, *values: str) -> str:
    return f"{_list(values)}[CAST({number} % {len(values)} AS BIGINT) + 1]"


def _name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def _prefixes(path: str, with_self: bool = True) -> str:
    upto = f"len(string_split({path}, '/'))" + ("" if with_self else " - 1")
    return (f"list_transform(generate_series(1, {upto}), "
            f"lambda k: array_to_string(string_split({path}, '/')[1:k], '/'))")


# ---- inputs

DOCS = f"""docs AS (
  SELECT source AS project, lang || '/' || doc_id || {_pick('doc_id', '.txt', '.md', '.log', '.pem')} AS rel_path,
         text AS content, strlen(text) AS length FROM documents)"""
_FOLDER = _pick("doc_id", "src", "src/core", "docs/en", "config", "Node_Modules/lib", ".env.d", "a/.env.d", "tests")
_EXT = _pick("doc_id", ".txt", ".md", ".log", ".PEM", ".rs")
WS = f"""ws AS (
  SELECT source AS project, {_FOLDER} || '/' || lang || '/' || CASE
           WHEN doc_id % 11 = 0 THEN doc_id || '/Credentials.json'
           WHEN doc_id % 13 = 0 THEN doc_id || '/service-account-' || lang || '.json'
           ELSE doc_id || {_EXT} END AS rel_path,
         doc_id, text AS content, strlen(text) AS length FROM documents)"""
RULE_FILES = f"""rule_files AS (
  SELECT project, unnest(['.gitignore', 'src/.ignore', '.git/info/exclude']) AS rel_path,
         unnest([{_text(made.ROOT_RULES)}, {_text(made.SRC_RULES)}, {_text(made.EXCLUDE_RULES)}]) AS content
  FROM (SELECT DISTINCT source AS project FROM documents))"""
RULED = f"{WS}, {RULE_FILES}, ruled AS (SELECT project, rel_path FROM ws UNION ALL SELECT project, rel_path FROM rule_files)"
PAGES = """pages_files AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project,
         page_id || '/' || tail || CASE WHEN tail = '' OR tail LIKE '%/' THEN 'index.html' ELSE '' END AS rel_path,
         html AS content
  FROM (SELECT *, regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1) AS tail FROM pages))"""
RAW = f"""raw AS (
  SELECT project, rel_path, doc_id % 17 = 0 AS has_zero, doc_id % 17 <> 0 AND doc_id % 19 = 0 AS malformed,
         doc_id % 23 = 0 AS denied, content,
         length + CASE WHEN doc_id % 17 = 0 THEN 1 WHEN doc_id % 19 = 0 THEN 2 ELSE 0 END AS length FROM ws)"""


# ---- rules

def _component(path: str) -> str:
    names = {n.lower(): n for n in fixed.BLACKLIST_COMPONENTS}
    first = f"list_filter(string_split(lower({path}), '/'), lambda c: list_contains({_list(names)}, c))[1]"
    return f"{_map(names)}[{first}]"


def _pattern(path: str) -> str:
    hit = f"lower({path}) GLOB g OR lower({_name(path)}) GLOB g"
    return f"list_filter({_list(fixed.BLACKLIST_PATTERNS)}, lambda g: {hit})[1]"


def _blacklist(path: str) -> str:
    return f"coalesce({_component(path)}, {_pattern(path)})"


def _has(path: str, name: str) -> str:
    return f"list_contains(string_split({path}, '/'), '{name}')"


def _ws_include(p: str) -> str:
    return f"({p} GLOB '*.txt' OR {p} GLOB '*.md' OR {p} GLOB '*.rs' OR {_has(p, 'config')})"


def _ws_exclude(p: str) -> str:
    return (f"CASE WHEN starts_with({p}, 'tests/') THEN 'tests/' "
            f"WHEN {p} GLOB 'src/core/9*' OR {p} GLOB 'src/core/*/9*' THEN 'src/core/**/9*' "
            f"WHEN {_has(p, 'fr')} THEN 'fr' END")


_INCLUDE_TEXT = "'*.txt,*.md,*.rs,config'"
_TREE_INCLUDE_TEXT = "'*.txt,*.md,*.log,docs'"


def _tree_include(p: str) -> str:
    return f"({p} GLOB '*.txt' OR {p} GLOB '*.md' OR {p} GLOB '*.log' OR {_has(p, 'docs')})"


# Every prefix of every path judged by the three rule files, last matching line first.
def _verdict(p: str, is_dir: str) -> str:
    inside, name = f"substr({p}, 5)", _name(p)
    return f"""coalesce(
      CASE WHEN NOT starts_with({p}, 'src/') THEN NULL WHEN {inside} = 'core/fr' THEN true
           WHEN regexp_full_match({inside}, 'core/en/[^/]*\\.md') THEN false WHEN {name} LIKE '%.md' THEN true END,
      CASE WHEN {name} = '#odd' THEN true WHEN regexp_full_match({p}, 'a/[^/]*/de/2[^/]*') THEN true
           WHEN {is_dir} AND {name} = 'es' THEN true WHEN {is_dir} AND {p} = 'docs' THEN true
           WHEN regexp_full_match({p}, 'src/core/(.*/)?[^/]*\\.log') THEN false WHEN {name} LIKE '%.log' THEN true END,
      CASE WHEN {name} LIKE '%.rs' THEN true END, false)"""


def _ignored(table: str) -> str:
    """CTEs judging ``table (project, rel_path, is_dir)``; result ``ignored_paths``."""
    return f"""steps AS (
      SELECT project, rel_path, is_dir, unnest({_prefixes('rel_path')}) AS path FROM {table}),
    ignored_paths AS (
      SELECT project, rel_path, bool_or({_verdict('path', '(path <> rel_path OR is_dir)')}) AS ignored
      FROM steps GROUP BY ALL)"""


# Full workspaces: raw files and rule files, plus the directories they imply.
FULL = f"""{WS}, {RULE_FILES}, {RAW}, files AS (
  SELECT project, rel_path, has_zero, malformed, denied, content, length FROM raw
  UNION ALL SELECT project, rel_path, false, false, false, content, strlen(content) FROM rule_files),
outputs AS (SELECT project, min(rel_path) AS rel_path FROM ws GROUP BY project),
listed AS (
  SELECT *, false AS is_dir FROM files
  UNION ALL SELECT DISTINCT project, unnest({_prefixes('rel_path', False)}) AS rel_path,
    false, false, false, NULL, NULL, true FROM files),
listed_keys AS (SELECT DISTINCT project, rel_path, is_dir FROM listed), {_ignored('listed_keys')},
facts AS (
  SELECT l.*, {_blacklist('l.rel_path')} AS black, {_ws_exclude('l.rel_path')} AS excl, {_ws_include('l.rel_path')} AS incl,
         {_tree_include('l.rel_path')} AS tree_incl, i.ignored, o.rel_path IS NOT NULL AS is_output
  FROM listed l JOIN ignored_paths i USING (project, rel_path)
  LEFT JOIN outputs o ON o.project = l.project AND o.rel_path = l.rel_path),
coded AS (
  SELECT *, CASE WHEN is_output THEN 'current_output' WHEN black IS NOT NULL THEN 'blacklist' WHEN ignored THEN 'ignore'
                 WHEN excl IS NOT NULL THEN 'exclude' WHEN NOT incl THEN 'include' WHEN is_dir THEN 'not_a_file'
                 WHEN length > 4096 THEN 'max_size' WHEN denied THEN 'unreadable' WHEN has_zero THEN 'binary'
                 WHEN malformed THEN 'included_lossy' ELSE 'included' END AS content_code,
            CASE WHEN is_output THEN 'current_output' WHEN black IS NOT NULL THEN 'blacklist' WHEN ignored THEN 'ignore'
                 WHEN NOT tree_incl THEN 'include' ELSE 'included' END AS tree_code FROM facts),
decided AS (
  SELECT *, CASE content_code WHEN 'blacklist' THEN black WHEN 'exclude' THEN excl WHEN 'include' THEN {_INCLUDE_TEXT}
                 WHEN 'max_size' THEN 'max-size = 4 KiB, actual = ' || length || ' bytes'
                 WHEN 'unreadable' THEN {_text(made.DENIED)} END AS content_rule,
            CASE tree_code WHEN 'blacklist' THEN black WHEN 'include' THEN {_TREE_INCLUDE_TEXT} END AS tree_rule FROM coded)"""

# Requests: what is asked, where it leads (null: outside), and what it passes through on the way.
EXPLAINED = f"""{FULL}, named AS (
  SELECT project, rel_path AS p, regexp_extract(rel_path, '^(.*)/', 1) AS dir, split_part(rel_path, '/', 1) AS top FROM files),
requests AS (
  SELECT project, p AS path, p AS leads, [] AS passed FROM named
  UNION SELECT project, './' || top || '/..//' || p, p, [top] FROM named
  UNION SELECT project, dir, dir, [] FROM named
  UNION SELECT project, p || '.gone', p || '.gone', [] FROM named
  UNION SELECT project, 'a/../../' || p, NULL, ['a'] FROM named
  UNION SELECT project, 'nope/../' || p, p, ['nope'] FROM named
  UNION SELECT project, p || '/.', p, [p] FROM named
  UNION SELECT project, dir || '/.', CASE WHEN dir = '' THEN NULL ELSE dir END, CASE WHEN dir = '' THEN [] ELSE [dir] END FROM named),
passes AS (
  SELECT q.project, q.path, bool_and(d.rel_path IS NOT NULL) AS whole
  FROM (SELECT project, path, unnest(passed) AS step FROM requests) q
  LEFT JOIN (SELECT project, rel_path FROM decided WHERE is_dir) d ON d.project = q.project AND d.rel_path = q.step GROUP BY ALL),
placed AS (
  SELECT r.*, coalesce(whole, true) AS whole, leads IS NULL AS outside FROM requests r LEFT JOIN passes s ON s.project = r.project AND s.path = r.path),
explained AS (
  SELECT p.project, p.path,
    CASE WHEN NOT whole THEN 'not_found' WHEN outside THEN 'outside_root' WHEN leads = '' THEN 'include' ELSE coalesce(d.content_code, 'not_found') END AS content_code,
    CASE WHEN NOT whole OR outside THEN NULL WHEN leads = '' THEN {_INCLUDE_TEXT} ELSE d.content_rule END AS content_rule,
    CASE WHEN NOT whole THEN NULL WHEN outside THEN 'outside_root' WHEN leads = '' THEN 'include' ELSE d.tree_code END AS tree_code,
    CASE WHEN NOT whole OR outside THEN NULL WHEN leads = '' THEN {_TREE_INCLUDE_TEXT} ELSE d.tree_rule END AS tree_rule
  FROM placed p LEFT JOIN decided d ON d.project = p.project AND d.rel_path = p.leads)"""


def _rule_sentence(code: str, rule: str) -> str:
    return (f"CASE {code} WHEN 'blacklist' THEN 'Rule: blacklist = ' || {rule} WHEN 'exclude' THEN 'Rule: exclude = ' || {rule} "
            f"WHEN 'include' THEN 'Rule: include = ' || {rule} WHEN 'max_size' THEN 'Rule: ' || {rule} "
            f"WHEN 'unreadable' THEN 'Rule: read error = ' || {rule} END")


# ---- tokens: pieces of the encoding's split, counted
_W = r"\t\n\x0B\f\r\x{85}\p{Z}"
_SPECIAL = r"<\|(endoftext|fim_prefix|fim_middle|fim_suffix|endofprompt)\|>"
_PIECES = "|".join([
    r"\x00", r"''(?i:[sdmt]|ll|ve|re)", r"[^\r\n\p{L}\p{N}\x00]?\p{L}+", r"\p{N}{1,3}",
    rf" ?[^{_W}\p{{L}}\p{{N}}\x00]+[\r\n]*", rf"[{_W}]*[\r\n]", rf"[{_W}]+"])


def _tokens(text: str) -> str:
    marked = f"regexp_replace({text}, '{_SPECIAL}', chr(0), 'g')"
    return f"CAST(len(regexp_extract_all({marked}, '{_PIECES}')) AS BIGINT)"


_LF = "chr(10)"


def _opening(path: str) -> str:
    """No path of the documents needs escaping."""
    return f"('<file path=\"' || {path} || '\">' || {_LF})"


_CLOSING = _text(fixed.BLOCK_CLOSING)
# Lines of ``written`` rows, numbered per project in pack order.
_LINES = """cut AS (
  SELECT project, section, rel_path, string_split(left(value, length(value) - 1), chr(10)) AS lines FROM written),
split AS (
  SELECT project, section, rel_path, unnest(generate_series(1, len(lines))) AS line, unnest(lines) AS value FROM cut),
numbered AS (
  SELECT project, value, row_number() OVER (PARTITION BY project ORDER BY section, rel_path <> '', string_split(rel_path, '/'), line) AS line_no FROM split)"""
TREE_INPUT = f"""{WS}, {PAGES}, files AS (
  SELECT project, rel_path FROM ws UNION ALL SELECT project, rel_path FROM pages_files)"""


def _tree(files: str) -> str:
    """CTEs from ``files (project, rel_path)`` to ``drawn`` nodes."""
    return f"""paths AS (
      SELECT project, path, bool_and(path <> rel_path) AS is_dir
      FROM (SELECT project, rel_path, unnest({_prefixes('rel_path')}) AS path FROM {files}) GROUP BY project, path),
    nodes AS (
      SELECT *, {_name('path')} AS name,
             array_to_string(string_split(path, '/')[1:-2], '/') AS parent FROM paths),
    lasts AS (
      SELECT *, name = max(name) OVER (PARTITION BY project, parent) AS is_last FROM nodes),
    bars AS (
      SELECT l.project, l.path, string_agg(CASE WHEN a.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY len(a.path)) AS indent
      FROM (SELECT project, path, unnest({_prefixes('path', False)}) AS above FROM nodes) l
      JOIN lasts a ON a.project = l.project AND a.path = l.above GROUP BY l.project, l.path),
    drawn AS (
      SELECT n.*, coalesce(b.indent, '') AS indent,
             coalesce(b.indent, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || name
               || CASE WHEN is_dir THEN '/' ELSE '' END AS line
      FROM lasts n LEFT JOIN bars b ON b.project = n.project AND b.path = n.path)"""


# Flagship options on documents: include *.txt,*.md, exclude de/, 2 KiB.
PACKED = f"""{DOCS}, judged AS (
  SELECT *, rel_path NOT LIKE '%.pem' AND NOT starts_with(rel_path, 'de/')
            AND (rel_path LIKE '%.txt' OR rel_path LIKE '%.md') AS wanted FROM docs),
kept AS (SELECT * FROM judged WHERE wanted AND length <= 2048),
shown AS (SELECT project, rel_path FROM judged WHERE wanted), {_tree('shown')},
tree_rows AS (
  SELECT project, '' AS rel_path, project || '/' || {_LF} AS value FROM (SELECT DISTINCT project FROM docs)
  UNION ALL SELECT project, path, line || {_LF} FROM drawn),
block_rows AS (
  SELECT project, rel_path, {_opening('rel_path')} || content || {_CLOSING} AS value, content FROM kept),
tokens AS (
  SELECT project, CAST(sum(n) AS BIGINT) AS output_tokens FROM (
    SELECT project, {_tokens('value')} AS n FROM tree_rows
    UNION ALL SELECT project, {_tokens('content')} + {_tokens(_opening('rel_path'))} + {_tokens(_CLOSING)} FROM block_rows)
  GROUP BY project)"""

# Workspaces without ignore files under a cap by project: blocks in pack order and the tokens before each.
CAPPED = f"""{WS}, entries AS (
  SELECT project, rel_path, length, content, false AS is_dir FROM ws
  UNION ALL SELECT DISTINCT project, unnest({_prefixes('rel_path', False)}), NULL, NULL, true FROM ws),
judged AS (
  SELECT *, {_blacklist('rel_path')} IS NULL AS open, {_ws_exclude('rel_path')} IS NOT NULL AS excl, {_ws_include('rel_path')} AS incl,
         {_tree_include('rel_path')} AS tree_incl FROM entries),
shown AS (SELECT project, rel_path FROM judged WHERE open AND tree_incl), {_tree('shown')},
tree_rows AS (
  SELECT project, '' AS rel_path, project || '/' || {_LF} AS value FROM (SELECT DISTINCT project FROM ws)
  UNION ALL SELECT project, path, line || CASE WHEN NOT is_dir AND (project, path) IN (SELECT (project, rel_path) FROM judged WHERE is_dir)
    THEN '/' ELSE '' END || {_LF} FROM drawn),
tree_sizes AS (SELECT project, sum({_tokens('value')}) AS tree FROM tree_rows GROUP BY project),
caps AS (
  SELECT project, CASE WHEN n % 6 <> 5 THEN n % 6 * n % 7 * 900 + 150 END AS cap
  FROM (SELECT DISTINCT source AS project, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS n FROM documents)),
sized AS (
  SELECT project, rel_path, content, {_tokens('content')} + {_tokens(_opening('rel_path'))} + {_tokens(_CLOSING)} AS block_tokens
  FROM judged WHERE open AND NOT excl AND incl AND NOT is_dir AND length <= 4096),
summed AS (
  SELECT *, CAST(coalesce(sum(block_tokens) OVER (PARTITION BY project ORDER BY string_split(rel_path, '/')
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM sized),
capped AS (
  SELECT s.*, cap IS NULL OR tree + tokens_before + block_tokens <= cap AS kept
  FROM summed s JOIN caps USING (project) JOIN tree_sizes USING (project))"""

# Two snapshots of the workspaces and what differs.
DELTAS = f"""{WS}, sized AS (
  SELECT project, rel_path, content, {_tokens('content')} + {_tokens(_opening('rel_path'))} + {_tokens(_CLOSING)} AS tokens FROM (
    SELECT * FROM ws) WHERE {_blacklist('rel_path')} IS NULL AND regexp_matches(rel_path, '\\.(txt|md|rs|log)$')),
edited AS (
  SELECT project, CASE WHEN doc_id % 10 = 1 THEN 'moved/' ELSE '' END || rel_path AS rel_path,
    CASE doc_id % 10 WHEN 2 THEN content || ' more' WHEN 3 THEN 'same text' ELSE content END AS content FROM ws WHERE doc_id % 10 <> 0
  UNION ALL SELECT project, 'copies/' || rel_path, content FROM ws WHERE doc_id % 10 = 4),
resized AS (
  SELECT project, rel_path, content, {_tokens('content')} + {_tokens(_opening('rel_path'))} + {_tokens(_CLOSING)} AS tokens FROM edited
  WHERE {_blacklist('rel_path')} IS NULL AND regexp_matches(rel_path, '\\.(txt|md|rs|log)$')),
both_sides AS (
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.rel_path, b.rel_path) AS rel_path, a.content AS old, b.content AS new,
    a.tokens AS tokens_before, b.tokens AS tokens_after
  FROM sized a FULL JOIN resized b ON a.project = b.project AND a.rel_path = b.rel_path WHERE a.content IS DISTINCT FROM b.content),
gone AS (SELECT *, row_number() OVER (PARTITION BY project, old ORDER BY rel_path) AS k FROM both_sides WHERE new IS NULL),
came AS (SELECT *, row_number() OVER (PARTITION BY project, new ORDER BY rel_path) AS k FROM both_sides WHERE old IS NULL),
deltas AS (
  SELECT project, rel_path, NULL AS from_path, 'changed' AS change, tokens_before, tokens_after FROM both_sides WHERE old IS NOT NULL AND new IS NOT NULL
  UNION ALL SELECT coalesce(g.project, c.project), coalesce(c.rel_path, g.rel_path), CASE WHEN c.rel_path IS NOT NULL THEN g.rel_path END,
    CASE WHEN g.rel_path IS NULL THEN 'added' WHEN c.rel_path IS NULL THEN 'removed' ELSE 'moved' END, g.tokens_before, c.tokens_after
  FROM gone g FULL JOIN came c ON g.project = c.project AND g.old = c.new AND g.k = c.k),
changes AS (SELECT *, (coalesce(tokens_after, 0) - coalesce(tokens_before, 0))::BIGINT AS delta FROM deltas)"""

# ---- profiles
PROFILE_TEXTS = """texts AS (
  SELECT 'doc-' || doc_id AS project, doc_id, CASE doc_id % 8
    WHEN 0 THEN '{"profiles":{"default":{"include":"*.' || lang || '","max_size":' || n_chars
      || '},"wide":{"description":"all of ' || source || '","no_ignore":true,"tree_include":""}}}'
    WHEN 1 THEN '{"include":"*.' || lang || '"}'
    WHEN 2 THEN '{ definitely not json'
    WHEN 3 THEN '{"profiles":{"default":{"max_size":"' || n_chars || '"}}}'
    WHEN 4 THEN '{"profiles":{}}'
    WHEN 5 THEN '{"profiles":{"default":{"exclude":"' || lang || '/","no_blacklist":null,"extra":1,"no_tree":false}}}'
    WHEN 6 THEN '{"max_size":-1}'
    ELSE '{"profiles":{}} x' END AS text FROM documents)"""
_FIELDS = {
    "description": "VARCHAR", "output_path": "VARCHAR", "no_ignore": "BOOLEAN", "include": "VARCHAR",
    "exclude": "VARCHAR", "tree_include": "VARCHAR", "tree_exclude": "VARCHAR", "no_tree": "BOOLEAN",
    "tree_no_ignore": "BOOLEAN", "max_size": "UBIGINT", "no_blacklist": "BOOLEAN",
}


def _typed(json: str) -> str:
    """A JSON object whose known fields have their types."""
    checks = [f"coalesce(json_type({json}, '$.{name}') IN ('{kind}', 'NULL'), true)" for name, kind in _FIELDS.items()]
    return f"(json_type({json}) = 'OBJECT' AND {' AND '.join(checks)})"


PROFILES = f"""{PROFILE_TEXTS}, documents_json AS (
  SELECT project, doc_id, CASE WHEN json_valid(text) THEN text END AS j FROM texts),
named AS (
  SELECT project, k AS name, json_extract(j, '$.profiles."' || k || '"') AS body
  FROM (SELECT project, j, unnest(json_keys(j, '$.profiles')) AS k FROM documents_json WHERE j IS NOT NULL)),
bad AS (SELECT DISTINCT project FROM named WHERE NOT {_typed('body')}),
statuses AS (
  SELECT project, doc_id, CASE
    WHEN j IS NULL THEN 'invalid'
    WHEN json_type(j, '$.profiles') = 'OBJECT' AND project NOT IN (SELECT project FROM bad) THEN 'ok'
    WHEN {_typed('j')} THEN 'legacy' ELSE 'invalid' END AS status FROM documents_json),
profiles AS (
  SELECT project, name, {', '.join(
      f"json_extract_string(body, '$.{n}')" + ('' if k == 'VARCHAR' else f"::{'BIGINT' if k == 'UBIGINT' else k}") + f" AS {n}"
      for n, k in _FIELDS.items())}
  FROM named JOIN statuses USING (project) WHERE status = 'ok')"""
REQUESTS = """requests AS (
  SELECT 'doc-' || doc_id AS project, doc_id, CASE doc_id % 3 WHEN 1 THEN 'wide' WHEN 2 THEN 'default' END AS requested,
         CASE WHEN doc_id % 4 = 0 THEN lang END AS include, CASE WHEN doc_id % 5 = 0 THEN true END AS no_tree FROM documents)"""
CHANGES = """changes AS (
  SELECT 'doc-' || doc_id AS project, doc_id, CASE WHEN doc_id % 16 < 8 THEN 'default' ELSE 'added' END AS name,
         CASE WHEN doc_id % 2 = 0 THEN 'new ' || source END AS description, 'out.txt' AS output_path,
         NULL::BOOLEAN AS no_ignore, NULL::VARCHAR AS include, CASE WHEN doc_id % 3 = 0 THEN lang END AS exclude,
         NULL::VARCHAR AS tree_include, NULL::VARCHAR AS tree_exclude, NULL::BOOLEAN AS no_tree,
         NULL::BOOLEAN AS tree_no_ignore, CASE WHEN doc_id % 5 = 0 THEN doc_id END AS max_size,
         NULL::BOOLEAN AS no_blacklist FROM documents)"""
EDITS = f"""{PROFILES}, {CHANGES}, edits AS (
  SELECT * EXCLUDE (name), ['create', 'update', 'delete', 'rename', 'replace', 'save', 'save_whole'][(doc_id // 8) % 7 + 1] AS op,
         ['default', 'wide', 'extra', 'not valid'][(doc_id // 56) % 4 + 1] AS name,
         CASE WHEN (doc_id // 8) % 7 = 3 THEN ['moved', 'wide'][(doc_id // 64) % 2 + 1] END AS new_name FROM changes
  UNION ALL SELECT * EXCLUDE (name), 'rename', 'wide', 'moved' FROM changes WHERE doc_id % 16 = 0
  UNION ALL SELECT * EXCLUDE (name), 'create', 'moved', NULL FROM changes WHERE doc_id % 48 = 0),
judged AS (
  SELECT e.*, CASE WHEN e.name = 'not valid' THEN 'invalid_name' WHEN s.status <> 'ok' THEN 'invalid_file'
      WHEN op = 'rename' AND EXISTS (SELECT 1 FROM profiles p WHERE p.project = e.project AND p.name = e.new_name) THEN 'already_exists'
      WHEN op = 'create' AND x.name IS NOT NULL THEN 'already_exists'
      WHEN op NOT IN ('create', 'save', 'save_whole') AND x.name IS NULL THEN 'not_found' ELSE 'ok' END AS status
  FROM edits e JOIN statuses s ON s.project = e.project LEFT JOIN profiles x ON x.project = e.project AND x.name = e.name),
claims AS (
  SELECT project, name AS claim FROM judged WHERE status = 'ok'
  UNION ALL SELECT project, new_name FROM judged WHERE status = 'ok' AND op = 'rename'),
twice AS (SELECT project, claim FROM claims GROUP BY ALL HAVING count(*) > 1),
outcomes AS (
  SELECT * REPLACE (CASE WHEN status = 'ok' AND EXISTS (SELECT 1 FROM twice t WHERE t.project = j.project
      AND (t.claim = j.name OR (j.op = 'rename' AND t.claim = j.new_name))) THEN 'claimed_twice' ELSE status END AS status) FROM judged j)"""
_OPTIONS = """options AS (
  SELECT project, exclude_lang, n, n % 2 = 0 AS tree_all, n % 3 = 0 AS no_ignore,
         CASE n % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE n % 3 = 0 END AS tree_no_ignore,
         n % 5 = 4 AS no_tree, n % 7 = 3 AS no_blacklist, n % 6 + 1 AS max_size, ending FROM (
    SELECT source AS project, max(lang) AS exclude_lang, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS n,
           (count(*) % 10) || '.md' AS ending FROM documents GROUP BY source))"""
_OWN_EXCLUDE = f"""CASE WHEN list_contains(string_split(rel_path, '/'), exclude_lang) THEN exclude_lang
  WHEN ends_with(rel_path, ending) THEN '*' || ending END"""
_MANY = "(rel_path GLOB '*.txt' OR rel_path GLOB '*.md' OR rel_path GLOB '*.log' OR rel_path GLOB '*.rs')"


def _filtered(black: str) -> str:
    return f"""WITH {RULED}, f AS (
        SELECT project, rel_path, {black} AS black, {_ws_exclude('rel_path')} AS excl, {_ws_include('rel_path')} AS incl FROM ruled)
      SELECT project, rel_path,
        CASE WHEN black IS NOT NULL THEN 'blacklist' WHEN excl IS NOT NULL THEN 'exclude'
             WHEN NOT incl THEN 'include' ELSE 'included' END AS code,
        CASE WHEN black IS NOT NULL THEN black WHEN excl IS NOT NULL THEN excl WHEN NOT incl THEN {_INCLUDE_TEXT} END AS rule FROM f"""


def _resolved(known: str) -> str:
    """CTEs resolving the requests against the files in ``known (project, status)``."""
    return f"""{PROFILES}, {REQUESTS}, known AS ({known}), r AS (
        SELECT r.*, coalesce(requested, 'default') AS profile, k.status FROM requests r LEFT JOIN known k ON k.project = r.project),
      j AS (
        SELECT r.*, p.name IS NOT NULL AS found, p.* EXCLUDE (project, name, include, no_tree),
               p.include AS saved_include, p.no_tree AS saved_no_tree
        FROM r LEFT JOIN (SELECT * FROM profiles WHERE project IN (SELECT project FROM known)) p
          ON p.project = r.project AND p.name = r.profile),
      s AS (SELECT *, CASE WHEN status IN ('legacy', 'invalid') THEN status
              WHEN requested IS NOT NULL AND NOT found AND status IS NULL THEN 'file_not_found'
              WHEN requested IS NOT NULL AND NOT found THEN 'profile_not_found' ELSE 'ok' END AS config_status FROM j)"""


# Workspaces under options resolved from profile files, one per project, in every state.
PROFILE_RUN = f"""{WS}, {PROFILES}, firsts AS (
  SELECT source AS project, min(doc_id) AS doc_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS n FROM documents GROUP BY source),
asked AS (
  SELECT project, 'doc-' || doc_id AS doc, n, CASE WHEN n % 6 = 5 THEN 'wide' END AS requested, CASE WHEN n % 5 = 1 THEN 'a/' END AS own_exclude
  FROM firsts WHERE n % 7 <> 6),
resolved AS (
  SELECT a.project, p.include, coalesce(own_exclude, p.exclude) AS exclude, coalesce(p.tree_include, p.include) AS tree_include,
    coalesce(p.no_tree, false) AS no_tree, coalesce(p.max_size, 500) AS max_size,
    CASE WHEN s.status <> 'ok' THEN s.status WHEN requested IS NOT NULL AND p.name IS NULL THEN 'profile_not_found'
         WHEN n % 11 = 8 THEN 'several rows of options' END AS config_error
  FROM asked a JOIN statuses s ON s.project = a.doc LEFT JOIN profiles p ON p.project = a.doc AND p.name = coalesce(requested, 'default')),
entries AS (
  SELECT project, rel_path, length, false AS is_dir FROM ws
  UNION ALL SELECT DISTINCT project, unnest({_prefixes('rel_path', False)}) AS rel_path, NULL, true FROM ws),
profiled AS (
  SELECT e.project, e.rel_path, e.is_dir, e.length, {_blacklist('e.rel_path')} AS black, coalesce(starts_with(e.rel_path, r.exclude), false) AS excl, r.exclude,
    r.include, coalesce(r.include, '') = '' OR ends_with(e.rel_path, substr(r.include, 2)) AS incl,
    coalesce(r.tree_include, '') = '' OR ends_with(e.rel_path, substr(r.tree_include, 2)) AS tree_incl,
    coalesce(r.no_tree, false) AS no_tree, coalesce(r.max_size, 500) AS max_size
  FROM entries e LEFT JOIN resolved r ON r.project = e.project WHERE r.config_error IS NULL),
profile_codes AS (
  SELECT *, CASE WHEN black IS NOT NULL THEN 'blacklist' WHEN excl THEN 'exclude' WHEN NOT incl THEN 'include' WHEN is_dir THEN 'not_a_file'
      WHEN length > max_size * 1024 THEN 'max_size' ELSE 'included' END AS content_code,
    CASE WHEN no_tree THEN 'tree_disabled' WHEN black IS NOT NULL THEN 'blacklist' WHEN excl THEN 'exclude' WHEN NOT tree_incl THEN 'include'
      ELSE 'included' END AS tree_code FROM profiled)"""


def oracles() -> dict[str, str]:
    merge = ", ".join(f"coalesce(c.{f}, p.{f}) AS {f}" for f in _FIELDS)
    take = ", ".join(f"CASE WHEN c.project IS NOT NULL THEN c.{f} ELSE p.{f} END AS {f}" for f in _FIELDS)
    edited = ", ".join(
        f"CASE WHEN d.op IN ('update', 'save') THEN coalesce(d.{f}, p.{f}) "
        f"WHEN d.op IN ('replace', 'save_whole') THEN d.{f} ELSE p.{f} END AS {f}"
        for f in ("description", "include", "exclude", "max_size"))
    full_join = "profiles p FULL JOIN changes c ON p.project = c.project AND p.name = c.name"
    keys = "coalesce(c.project, p.project) AS project, coalesce(c.name, p.name) AS name"
    return {
        "parse_patterns": """
          WITH l AS (SELECT source AS project, doc_id, list_filter(list_transform(
              string_split(lang || '/, *.' || lang || ' ,, ' || source || '\\notes , ' || doc_id, ','),
              lambda x: replace(trim(x), '\\', '/')), lambda x: x <> '') AS pats FROM documents),
            e AS (SELECT project, doc_id, unnest(generate_series(0, len(pats) - 1)) AS ord, unnest(pats) AS raw FROM l)
          SELECT project, doc_id, ord, raw, unnest(CASE WHEN NOT regexp_matches(raw, '[/*.]') THEN ['**/' || raw, '**/' || raw || '/**']
            WHEN ends_with(raw, '/') THEN [raw || '**'] ELSE [raw] END) AS glob FROM e""",
        "glob_match": f"""WITH {WS} SELECT project, rel_path, rel_path GLOB '*.txt' AS by_ending, rel_path GLOB 'src/*' AS all_below,
            rel_path GLOB 'src/*/en/*' AS fixed_depth, rel_path GLOB '?onfig/*' AS one_character,
            rel_path GLOB '[st]*/[!e]?/*' AS classes, rel_path GLOB 'a/de/*' OR rel_path GLOB 'a/*/de/*' AS any_between,
            rel_path GLOB 'fr/*' OR rel_path GLOB '*/fr/*' AS anywhere,
            rel_path GLOB 'src/*' OR rel_path GLOB 'tests/*' AS choice FROM ws""",
        "matched_rule": f"""WITH {WS} SELECT project, rel_path, CASE WHEN starts_with(rel_path, 'docs/') THEN 'docs/'
            WHEN ends_with(rel_path, '.rs') THEN '*.rs' WHEN rel_path = 'src/core' THEN 'src/core'
            WHEN {_has('rel_path', 'en')} THEN 'en' WHEN starts_with(rel_path, 'tests/') THEN 'tests/**' END AS rule FROM ws""",
        "matched_rule_by_project": f"""WITH {WS}, {_OPTIONS} SELECT project, rel_path, {_OWN_EXCLUDE} AS rule
            FROM ws JOIN options USING (project)""",
        "first_rule_by_index": f"""WITH {WS}, patterns AS (
            SELECT project, doc_id AS ord, CASE doc_id % 8 WHEN 0 THEN rel_path WHEN 1 THEN '*' || doc_id || '.rs' WHEN 2 THEN rel_path || '/'
                WHEN 3 THEN doc_id::VARCHAR WHEN 4 THEN '*/' || doc_id || '*' WHEN 5 THEN split_part(rel_path, '/', 1) || '/*' || doc_id || '.md'
                WHEN 7 THEN split_part(rel_path, '/', 1) || '/*/' || doc_id || '.txt' END AS raw FROM ws
            UNION ALL SELECT DISTINCT project, 1000000000, unnest(['*.PEM', 'config/']) FROM ws),
          hits AS (
            SELECT w.project, w.rel_path, min({{'ord': p.ord, 'raw': p.raw}}) AS best FROM ws w JOIN patterns p ON p.project = w.project AND CASE
              WHEN ends_with(raw, '/') THEN starts_with(rel_path, raw) WHEN regexp_full_match(raw, '[0-9]+') THEN {_has('rel_path', "' || raw || '").replace("'' || raw || ''", "raw")}
              ELSE rel_path GLOB raw END GROUP BY ALL)
          SELECT project, rel_path, best.ord AS ord, best.raw AS rule FROM ws LEFT JOIN hits USING (project, rel_path)""",
        "blacklist_component": f"WITH {RULED} SELECT project, rel_path, {_component('rel_path')} AS rule FROM ruled",
        "blacklist_pattern": f"WITH {RULED} SELECT project, rel_path, {_pattern('rel_path')} AS rule FROM ruled",
        "filter_decision": _filtered(_blacklist("rel_path")),
        "filter_without_blacklist": _filtered("NULL::VARCHAR"),
        "ignore_rules": f"""WITH {RULE_FILES}, texts AS (
            SELECT project, CASE rel_path WHEN 'src/.ignore' THEN 'src' ELSE '' END AS base_dir,
                   CASE rel_path WHEN 'src/.ignore' THEN 3 WHEN '.gitignore' THEN 2 ELSE 1 END::BIGINT AS priority, content FROM rule_files
            UNION ALL SELECT source, lang || '/' || doc_id, 2, '# ' || doc_id || chr(10) || '*.' || lang || chr(10) || '!/' || source
                   || '/keep.*  ' || chr(10) || chr(10) || doc_id || '/' || chr(10) || '/' || lang || '/**/' || doc_id || '.log'
            FROM documents),
          lines AS (
            SELECT project, base_dir, priority,
                   unnest(generate_series(1, len(string_split(content, chr(10))))) AS line,
                   rtrim(unnest(string_split(content, chr(10)))) AS raw FROM texts),
          parts AS (
            SELECT *, starts_with(raw, '!') AS negated, ends_with(raw, '/') AS dir_only,
                   regexp_replace(regexp_replace(raw, '^(!|\\\\)', ''), '/$', '') AS body
            FROM lines WHERE raw <> '' AND NOT starts_with(raw, '#'))
          SELECT project, base_dir, priority, line, raw, negated, dir_only,
                 CASE WHEN starts_with(body, '/') THEN substr(body, 2) WHEN contains(body, '/') THEN body
                      ELSE '**/' || body END AS glob FROM parts""",
        "ignore_apply": f"""WITH {RULED}, keys AS (SELECT DISTINCT project, rel_path, false AS is_dir FROM ruled), {_ignored('keys')}
            SELECT project, rel_path, ignored FROM ignored_paths""",
        "ignore_switches": f"""WITH {RULED}, {_OPTIONS}, listed AS (
            SELECT project, rel_path, length, false AS is_dir FROM ws
            UNION ALL SELECT project, rel_path, strlen(content), false FROM rule_files
            UNION ALL SELECT DISTINCT project, unnest({_prefixes('rel_path', False)}), NULL::BIGINT, true FROM ruled),
          keys AS (SELECT DISTINCT project, rel_path, is_dir FROM listed), {_ignored('keys')},
          f AS (SELECT *, {_blacklist('rel_path')} AS black, {_OWN_EXCLUDE} AS excl, {_MANY} AS incl
            FROM listed JOIN ignored_paths USING (project, rel_path) JOIN options USING (project))
          SELECT project, rel_path,
            CASE WHEN NOT no_blacklist AND black IS NOT NULL THEN 'blacklist' WHEN NOT no_ignore AND ignored THEN 'ignore'
                 WHEN excl IS NOT NULL THEN 'exclude' WHEN NOT incl THEN 'include' WHEN is_dir THEN 'not_a_file'
                 WHEN length > max_size * 1024 THEN 'max_size' ELSE 'included' END AS content_code,
            CASE WHEN no_tree THEN 'tree_disabled' WHEN NOT no_blacklist AND black IS NOT NULL THEN 'blacklist'
                 WHEN NOT tree_no_ignore AND ignored THEN 'ignore' WHEN NOT tree_all AND excl IS NOT NULL THEN 'exclude'
                 WHEN NOT incl THEN 'include' ELSE 'included' END AS tree_code FROM f""",
        "size_decision": """SELECT doc_id, strlen(text) AS length, doc_id % 5 AS max_kib,
            strlen(text) > (doc_id % 5) * 1024 AS too_large FROM documents""",
        "binary_flag": f"WITH {WS}, {RAW} SELECT project, rel_path, has_zero AS is_binary FROM raw",
        "decode_lossy": f"""WITH {WS}, {RAW} SELECT project, rel_path, malformed AS lossy_utf8, md5(content || CASE WHEN has_zero THEN chr(0)
            WHEN malformed THEN chr(65533) || 'a' ELSE '' END) AS content_md5 FROM raw""",
        "unreadable": f"""WITH {WS}, {RAW}, c AS (SELECT *, CASE WHEN length > 4096 THEN 'max_size' WHEN denied THEN 'unreadable'
              WHEN has_zero THEN 'binary' WHEN malformed THEN 'included_lossy' ELSE 'included' END AS code FROM raw)
            SELECT project, rel_path, code, CASE code WHEN 'max_size' THEN 'max-size = 4 KiB, actual = ' || length || ' bytes'
              WHEN 'unreadable' THEN {_text(made.DENIED)} END AS rule FROM c""",
        "content_files_only": f"""WITH {PAGES} SELECT project, rel_path, true AS is_file FROM pages_files
            UNION ALL SELECT DISTINCT project, unnest({_prefixes('rel_path', False)}), false FROM pages_files""",
        "content_decision": f"WITH {FULL} SELECT project, rel_path, content_code, content_rule FROM decided",
        "tree_decision": f"WITH {FULL} SELECT project, rel_path, tree_code, tree_rule FROM decided",
        "tree_rule_inheritance": """SELECT doc_id,
            CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE lang END AS tree_include,
            CASE WHEN doc_id % 5 = 0 THEN 'x' WHEN doc_id % 2 = 0 THEN source END AS tree_exclude,
            CASE WHEN doc_id % 3 = 2 THEN doc_id % 4 = 1 ELSE doc_id % 2 = 1 END AS tree_no_ignore FROM documents""",
        "explain_paths": f"WITH {EXPLAINED} SELECT * FROM explained",
        "decision_text": f"""WITH {EXPLAINED} SELECT project, path, {_map(fixed.DECISION_TEXT)}[content_code] AS content_result,
            {_rule_sentence('content_code', 'content_rule')} AS content_rule, {_map(fixed.DECISION_TEXT)}[tree_code] AS tree_result,
            {_rule_sentence('tree_code', 'tree_rule')} AS tree_rule FROM explained""",
        "skip_reason": f"""WITH {FULL} SELECT project, rel_path, CASE content_code WHEN 'max_size' THEN 'larger than 4 KiB: ' || length || ' bytes'
            WHEN 'binary' THEN 'binary file' ELSE 'unreadable: ' || {_text(made.DENIED)} END AS reason
            FROM decided WHERE content_code IN ('max_size', 'binary', 'unreadable')""",
        "preview_lines": f"""WITH {FULL} SELECT project, rel_path, CASE content_code
            WHEN 'included' THEN '[EXPECT] ' || rel_path || ' (' || {_tokens('content')} || ' content tokens)'
            WHEN 'included_lossy' THEN '[EXPECT] ' || rel_path || ' (' || {_tokens("content || chr(65533) || 'a'")} || ' content tokens, lossy UTF-8)'
            WHEN 'max_size' THEN '[SKIP] ' || rel_path || ' (larger than 4 KiB: ' || length || ' bytes)'
            WHEN 'binary' THEN '[SKIP] ' || rel_path || ' (binary file)'
            ELSE '[SKIP] ' || rel_path || ' (unreadable: ' || {_text(made.DENIED)} || ')' END AS status_line
            FROM decided WHERE content_code IN ('included', 'included_lossy', 'max_size', 'binary', 'unreadable')""",
        "exclude_outputs": f"""WITH {WS} SELECT project, rel_path FROM ws
            WHERE (project, rel_path) NOT IN (SELECT (project, min(rel_path)) FROM ws GROUP BY project)""",
        "contain_links": f"""WITH {WS} SELECT project, rel_path, CASE doc_id % 5 WHEN 1 THEN '/corpus/' || project || '/src/x'
              WHEN 2 THEN '/corpus/' || project || 'x/secret' WHEN 3 THEN '/etc/passwd' WHEN 4 THEN '' END AS link_target,
            doc_id % 5 IN (2, 3, 4) AS escapes FROM ws""",
        "tree_nodes": f"WITH {TREE_INPUT}, {_tree('files')} SELECT project, parent, name, is_dir FROM drawn",
        "tree_last": f"WITH {TREE_INPUT}, {_tree('files')} SELECT project, parent, name, is_last FROM drawn",
        "tree_indent": f"WITH {TREE_INPUT}, {_tree('files')} SELECT project, parent, name, indent FROM drawn",
        "tree_lines": f"WITH {TREE_INPUT}, {_tree('files')} SELECT project, path AS rel_path, line FROM drawn",
        "tree_text": f"""WITH {TREE_INPUT}, {_tree('files')}
            SELECT project, row_number() OVER (PARTITION BY project ORDER BY string_split(path, '/')) + 1 AS line_no, line FROM drawn
            UNION ALL SELECT DISTINCT project, 1, project || '/' FROM files""",
        "escape_path": """SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
            || ['&quot;&lt;&amp;&gt;', '\\t\\n\\r', '\\u{1}\\u{85}\\u{7F}', ''][CAST(page_id % 4 AS BIGINT) + 1] AS escaped FROM pages""",
        "frame_blocks": f"""WITH {DOCS} SELECT project, rel_path, {_opening('rel_path')} || content || {_CLOSING} AS value FROM docs""",
        "candidate_order": f"""WITH p AS (SELECT source AS project, lang || {_pick('doc_id', '/', '-x/', '.', '/0/')} || doc_id AS rel_path FROM documents)
            SELECT project, rel_path, row_number() OVER (PARTITION BY project ORDER BY string_split(rel_path, '/')) AS seq FROM p""",
        "pack_rows": f"""WITH {PACKED} SELECT project, 0::BIGINT AS section, rel_path, value FROM tree_rows
            UNION ALL SELECT project, 1, rel_path, value FROM block_rows""",
        "write_packs": f"""WITH {PACKED}, written AS (
            SELECT project, 0 AS section, rel_path, value FROM tree_rows UNION ALL SELECT project, 1, rel_path, value FROM block_rows),
          {_LINES} SELECT project, line_no, value FROM numbered""",
        "publish_packs": f"""WITH {PACKED}, written AS (
            SELECT project, 0 AS section, rel_path, value FROM tree_rows WHERE regexp_extract(project, '(\\d+)$', 1)::INT % 2 = 1
            UNION ALL SELECT project, 1, rel_path, value FROM block_rows WHERE regexp_extract(project, '(\\d+)$', 1)::INT % 2 = 1
            UNION ALL SELECT project, 1, rel_path, {_opening('rel_path')} || content || {_CLOSING} FROM docs
              WHERE (rel_path LIKE '%.txt' OR rel_path LIKE '%.log') AND regexp_extract(project, '(\\d+)$', 1)::INT % 2 = 0 AND length <= 512000),
          {_LINES} SELECT project, line_no, value FROM numbered""",
        "streamed_blocks": f"WITH {PACKED} SELECT project, rel_path, value FROM block_rows",
        "streamed_counts": f"""WITH {PACKED}, sized AS (
            SELECT project, count(*) AS n, sum({_tokens('content')} + {_tokens(_opening('rel_path'))} + {_tokens(_CLOSING)}) AS tokens FROM kept GROUP BY project)
          SELECT j.project, coalesce(any_value(s.n), 0)::BIGINT AS files_processed,
            (count(*) FILTER (wanted AND length > 2048))::BIGINT AS files_skipped, coalesce(any_value(s.tokens), 0)::BIGINT AS block_tokens
          FROM judged j LEFT JOIN sized s ON s.project = j.project GROUP BY j.project""",
        "content_tokens": f"""WITH {DOCS}, {PAGES} SELECT project, rel_path, {_tokens('content')} AS content_tokens FROM (
            SELECT project, rel_path, content FROM docs UNION ALL SELECT project, rel_path, content FROM pages_files)""",
        "project_tokens": f"WITH {PACKED} SELECT project, output_tokens FROM tokens",
        "run_stats": f"""WITH {PACKED} SELECT project, CAST(count(*) FILTER (wanted AND length <= 2048) AS BIGINT) AS files_processed,
            CAST(count(*) FILTER (wanted AND length > 2048) AS BIGINT) AS files_skipped, any_value(output_tokens) AS output_tokens
            FROM judged JOIN tokens USING (project) GROUP BY project""",
        "token_cap": f"WITH {CAPPED} SELECT project, rel_path, block_tokens, tokens_before, kept FROM capped",
        "token_cap_stats": f"""WITH {CAPPED}, late AS (
            SELECT project, count(*) AS n FROM judged WHERE open AND NOT excl AND incl AND NOT is_dir AND length > 4096 GROUP BY project),
          kept AS (SELECT project, count(*) FILTER (kept) AS n, count(*) FILTER (NOT kept) AS beyond, sum(block_tokens) FILTER (kept) AS size
            FROM capped GROUP BY project)
          SELECT project, coalesce(k.n, 0)::BIGINT AS files_processed, (coalesce(k.beyond, 0) + coalesce(l.n, 0))::BIGINT AS files_skipped,
            (tree + coalesce(size, 0))::BIGINT AS output_tokens
          FROM tree_sizes LEFT JOIN kept k USING (project) LEFT JOIN late l USING (project)""",
        "token_cap_pack": f"""WITH {CAPPED} SELECT project, 0::BIGINT AS section, rel_path, md5(value) AS value_md5 FROM tree_rows
            UNION ALL SELECT project, 1, rel_path, md5({_opening('rel_path')} || content || {_CLOSING}) FROM capped WHERE kept""",
        "directory_tokens": f"""WITH {WS}, {PAGES}, files AS (
            SELECT project, rel_path, content, strlen(content) AS length FROM ws
            UNION ALL SELECT project, rel_path, content, strlen(content) FROM pages_files),
          kept AS (SELECT project, rel_path, {_tokens('content')} + {_tokens(_opening("replace(replace(rel_path, '&', '&amp;'), '<', '&lt;')"))} + {_tokens(_CLOSING)} AS n
            FROM files WHERE {_blacklist('rel_path')} IS NULL AND NOT starts_with(rel_path, 'tests/') AND length <= 8192),
          dirs AS (SELECT DISTINCT project, unnest([''] || {_prefixes('rel_path', False)}) AS directory FROM files),
          nodes AS (
            SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path <> '', string_split(path, '/')) - 1 AS number FROM (
              SELECT project, directory AS path FROM dirs UNION ALL SELECT project, rel_path FROM kept)),
          spans AS (
            SELECT d.project, d.directory, min(number) AS first, max(number) AS last FROM dirs d JOIN nodes n ON n.project = d.project
              AND (d.directory = '' OR n.path = d.directory OR starts_with(n.path, d.directory || '/')) GROUP BY ALL),
          sums AS (SELECT project, directory, count(*) AS files, sum(n) AS n FROM (
            SELECT project, n, unnest([''] || {_prefixes('rel_path', False)}) AS directory FROM kept) GROUP BY ALL)
          SELECT project, directory, first, last, coalesce(files, 0)::BIGINT AS files, coalesce(n, 0)::BIGINT AS block_tokens
          FROM spans LEFT JOIN sums USING (project, directory)""",
        "token_rollup": f"""WITH {PACKED}, parts AS (
            SELECT project, split_part(rel_path, '/', 1) AS top_dir, regexp_extract(rel_path, '(\\.[^./]*)$', 1) AS extension,
              CASE WHEN starts_with(rel_path, 'de/') AND NOT rel_path LIKE '%.pem' THEN 'exclude' WHEN rel_path LIKE '%.pem' THEN 'blacklist'
                   WHEN NOT wanted THEN 'include' WHEN length > 2048 THEN 'max_size' ELSE 'included' END AS code,
              CASE WHEN wanted AND length <= 2048
                   THEN {_tokens('content')} + {_tokens(_opening('rel_path'))} + {_tokens(_CLOSING)} ELSE 0 END AS n FROM judged)
          SELECT project, top_dir, extension, code, grouping_id(project, top_dir, extension, code)::BIGINT AS level, count(*) AS files,
            sum(n)::BIGINT AS block_tokens FROM parts GROUP BY ROLLUP (project, top_dir, extension, code)""",
        "token_deltas": f"WITH {DELTAS} SELECT * FROM changes",
        "token_delta_totals": f"""WITH {DELTAS} SELECT project, change, count(*) AS files, sum(delta)::BIGINT AS delta
            FROM changes GROUP BY GROUPING SETS ((project, change), (project))""",
        "walk_errors": f"""WITH {WS}, listed AS (
            SELECT project, rel_path, false AS is_dir, doc_id % 5 IN (2, 3, 4) AS bad_link FROM ws
            UNION ALL SELECT DISTINCT project, unnest({_prefixes('rel_path', False)}), true, false FROM ws),
          keys AS (SELECT project, rel_path, is_dir FROM listed), {_ignored('keys')}
          SELECT project, CAST(sum(CASE
              WHEN bad_link AND NOT ignored AND {_blacklist('rel_path')} IS NULL AND NOT starts_with(rel_path, 'tests/') THEN 1
              WHEN is_dir AND rel_path IN ('config', 'docs', 'src/core') THEN CASE WHEN ignored THEN 1 ELSE 2 END
              ELSE 0 END) AS BIGINT) AS walk_errors
          FROM listed JOIN ignored_paths USING (project, rel_path) GROUP BY project""",
        "classify_config": f"WITH {PROFILES} SELECT project, status FROM statuses",
        "parse_profiles": f"WITH {PROFILES} SELECT * FROM profiles",
        "resolve_config": f"""WITH {_resolved('SELECT project, status FROM statuses')}
          SELECT project, profile, config_status, coalesce(output_path, project || {_text(fixed.PACK_SUFFIX)}) AS output_path,
            coalesce(no_ignore, false) AS no_ignore, coalesce(include, saved_include) AS include, exclude, tree_include, tree_exclude,
            coalesce(no_tree, saved_no_tree, false) AS no_tree, coalesce(tree_no_ignore, no_ignore, false) AS tree_no_ignore,
            coalesce(max_size, {fixed.DEFAULT_MAX_KIB})::BIGINT AS max_size, coalesce(no_blacklist, false) AS no_blacklist FROM s""",
        "missing_profile": f"""WITH {_resolved("SELECT project, status FROM statuses WHERE doc_id % 2 = 1")}
          SELECT project, profile, config_status FROM s""",
        "upsert_profiles": f"WITH {PROFILES}, {CHANGES} SELECT {keys}, {merge} FROM {full_join}",
        "replace_profiles": f"WITH {PROFILES}, {CHANGES} SELECT {keys}, {take} FROM {full_join}",
        "edit_profiles": f"WITH {EDITS} SELECT project, op, name, new_name, status FROM outcomes",
        "apply_profile_edits": f"""WITH {EDITS}, done AS (SELECT * FROM outcomes WHERE status = 'ok')
          SELECT p.project, CASE d.op WHEN 'rename' THEN d.new_name ELSE p.name END AS name, {edited}
          FROM profiles p LEFT JOIN done d ON d.project = p.project AND d.name = p.name WHERE d.op IS DISTINCT FROM 'delete'
          UNION ALL SELECT d.project, d.name, d.description, d.include, d.exclude, d.max_size FROM done d
          LEFT JOIN profiles p ON p.project = d.project AND p.name = d.name
          WHERE d.op IN ('create', 'save', 'save_whole') AND p.name IS NULL""",
        "profile_run": f"""WITH {PROFILE_RUN} SELECT project, rel_path, content_code, tree_code,
            CASE content_code WHEN 'blacklist' THEN black WHEN 'exclude' THEN exclude WHEN 'include' THEN include
              WHEN 'max_size' THEN 'max-size = ' || max_size || ' KiB, actual = ' || length || ' bytes' END AS content_rule FROM profile_codes""",
        "config_errors": f"WITH {PROFILE_RUN} SELECT project, config_error FROM resolved WHERE config_error IS NOT NULL",
        "current_outputs": """SELECT 'doc-' || doc_id AS project, CASE doc_id % 6 WHEN 0 THEN 'out/' || lang || '.md' ELSE lang || '.md' END AS rel_path
            FROM documents WHERE doc_id % 6 IN (0, 2)""",
        "valid_profile_name": f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '' ELSE lang END
              || {_pick('doc_id', '.api-1', '/api', ' api', '_api' + chr(10), 'é', '')} AS name FROM documents)
          SELECT doc_id, name, doc_id % 6 = 0 AS valid FROM n""",
        "list_profiles": f"WITH {PROFILES} SELECT project, name, coalesce(description, {_text(fixed.NO_DESCRIPTION)}) AS description FROM profiles",
    }
