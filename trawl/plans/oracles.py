"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

import re

from trawl.plans.bindings import CODE

_OCC = r"""
cut AS (
  SELECT source AS project, 'doc_' || doc_id AS path, doc_id,
         unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS piece,
         generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS pos
  FROM FILES),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY project, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
         lower(lag(piece, 2) OVER (PARTITION BY project, path ORDER BY pos)) AS previous,
         length(piece) - length(replace(piece, chr(10), '')) AS breaks
  FROM cut),
lined AS (
  SELECT *, (1 + coalesce(sum(breaks) OVER w, 0))::BIGINT AS line_no,
         coalesce(max(CASE WHEN breaks > 0 THEN "offset" + length(piece) - strpos(reverse(piece), chr(10)) + 1 END) OVER w, 0)::BIGINT AS line_start
  FROM placed WINDOW w AS (PARTITION BY project, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
NAME AS (
  SELECT project, path, doc_id, piece AS word, "offset", line_no, line_start,
         CASE WHEN previous = 'the' THEN 'Declaration' ELSE 'Reference' END AS kind, coalesce(previous = 'of', false) AS is_super
  FROM lined WHERE regexp_matches(piece, '^[\p{L}\p{N}_]'))"""


def _occ(select: str, files: str = "documents", more: str = "") -> str:
    return "WITH " + _OCC.replace("FILES", files).replace("NAME", "occ") + more + "\n" + select


_LINES = """, parts AS (SELECT source AS project, 'doc_' || doc_id AS path, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
lines AS (SELECT project, path, n::BIGINT AS line_no,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY project, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start, line FROM parts)"""
_FILES = """, marked AS (SELECT d.source AS project, 'doc_' || d.doc_id AS path, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""
_SCOPE = """, scope AS (SELECT DISTINCT d.source AS project FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1 AND quality = 0)"""
_QUERIES = r""", queries AS (SELECT item_id AS query_id, regexp_extract(text, '[\p{L}\p{N}_]+') AS word,
  CASE item_id % 3 WHEN 0 THEN 'any' WHEN 1 THEN 'declaration' ELSE 'super' END AS mode FROM benchmark)"""
_PER_FILE = """SELECT project, path, count(*)::BIGINT AS n_rows, sum("offset")::BIGINT AS sum_offset FROM ({}) GROUP BY ALL"""
_WIDE = """(SELECT DISTINCT source AS project FROM documents UNION SELECT s_name FROM supplier)"""

_SYMBOLS = """symbols AS (
  SELECT p_partkey AS symbol_id, replace(p_brand, '#', '') AS owner, CASE p_size % 12 WHEN 7 THEN '(' || p_type || ')Unit' ELSE p_type END AS signature, replace(p_name, ' ', '_') AS base,
    CASE p_size % 12 WHEN 7 THEN replace(p_name, ' ', '_') || '_=' WHEN 10 THEN 'apply' WHEN 8 THEN replace(p_name, ' ', '_') || ' ' ELSE replace(p_name, ' ', '_') END AS name,
    CASE p_size % 12 WHEN 0 THEN 'interface' WHEN 1 THEN 'trait' WHEN 2 THEN 'class' WHEN 3 THEN 'abstract class' WHEN 4 THEN 'module' WHEN 5 THEN 'type'
      WHEN 6 THEN 'method' WHEN 7 THEN 'method' WHEN 10 THEN 'method' WHEN 8 THEN 'val' WHEN 9 THEN 'var' ELSE 'unknown' END AS kind,
    CASE WHEN p_size % 12 IN (8, 9) OR p_size IN (31, 43, 42) THEN p_type END AS getter,
    CASE WHEN p_size % 12 = 9 OR p_size IN (31, 43) THEN '(' || p_type || ')Unit' END AS setter,
    CASE WHEN p_size IN (31, 43) THEN 'setter' WHEN p_size % 12 = 6 AND p_size >= 40 THEN 'getter' ELSE '' END AS accessor,
    (p_size % 12 = 9 AND p_size >= 33) AS is_local,
    'lib.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || CASE p_size % 12 WHEN 4 THEN '.type' WHEN 5 THEN '[core.Elem.type]' WHEN 2 THEN '[a.B]' ELSE '' END AS qualified_name
  FROM part)"""
_CANON = "regexp_replace(trim({}), '_=$', '')"
#: The last segment of the head and, where there are brackets, those with what is in them but without a trailing .type.
_DISPLAY = r"""(SELECT CASE WHEN strpos(q, '[') > 0 THEN regexp_extract(substr(q, 1, strpos(q, '[') - 1), '[^.]*$') || substr(q, strpos(q, '[')) ELSE regexp_extract(q, '[^.]*$') END
  FROM (SELECT regexp_replace(qualified_name, '\.type$', '') AS q))"""
_BRANDS = """brands AS (SELECT DISTINCT regexp_extract(p_brand, '[0-9]+')::BIGINT AS id FROM part),
up AS (SELECT id AS root, id, 0::BIGINT AS depth FROM brands UNION SELECT up.root, up.id // 2, up.depth + 1 FROM up WHERE up.id >= 2 AND up.id IN (SELECT id FROM brands))"""
_COMPARED = (
    "WITH RECURSIVE "
    + _BRANDS
    + ", "
    + _SYMBOLS
    + """,
kin AS (SELECT DISTINCT 'Brand' || root AS a, 'Brand' || id AS b FROM up UNION SELECT 'Brand' || id, 'Brand' || root FROM up),
classes AS (SELECT *, regexp_replace(trim(name), '_=$', '') AS canon, kind IN ('val', 'var') OR accessor <> '' AS is_value, ends_with(name, '_=') AS sets
  FROM (SELECT DISTINCT name, owner, signature, kind, accessor, is_local, getter, setter FROM symbols)),
ends AS (SELECT DISTINCT trim(name) AS name, owner, signature, regexp_extract(owner, '[0-9]+')::BIGINT AS id, regexp_extract(signature, '[A-Z]+[)A-Za-z]*$') AS tail FROM symbols),
down AS (SELECT a.name, a.owner AS ao, a.signature AS asig, b.owner AS bo, b.signature AS bsig FROM ends a JOIN ends b ON a.name = b.name AND a.id // 2 = b.id AND a.tail = b.tail),
over AS (SELECT * FROM down UNION SELECT name, bo, bsig, ao, asig FROM down),
-- survey 2.4.1, rules 3 to 5: which names and signatures are held against each other
paired AS (SELECT e, m, CASE
    WHEN e.is_value AND m.is_value THEN [e.canon, e.getter, m.canon, m.getter]
    WHEN e.is_value AND m.kind = 'method' AND m.sets THEN [e.canon || '_=', e.setter, m.name, m.signature]
    WHEN e.is_value AND m.kind = 'method' THEN [e.canon, e.getter, m.name, m.signature]
    WHEN e.is_value THEN NULL
    WHEN e.kind = 'method' AND m.is_value AND e.sets THEN [e.name, e.signature, m.canon || '_=', m.setter]
    WHEN e.kind = 'method' AND m.is_value THEN [e.name, e.signature, m.canon, m.getter]
    WHEN e.kind = 'method' AND m.kind <> 'method' THEN NULL
    ELSE [trim(e.name), e.signature, trim(m.name), m.signature] END AS p FROM classes e JOIN classes m USING (canon)),
-- rules 2 and 6
same AS (SELECT DISTINCT e, m FROM paired WHERE e = m OR NOT e.is_local AND NOT m.is_local AND p[1] = p[3]
  AND EXISTS (SELECT 1 FROM kin WHERE kin.a = e.owner AND kin.b = m.owner)
  AND (p[2] = p[4] OR e.owner <> m.owner AND EXISTS (SELECT 1 FROM over o WHERE o.name = p[1] AND o.ao = e.owner AND o.asig = p[2] AND o.bo = m.owner AND o.bsig = p[4]))),
mentioned AS (SELECT c, l_returnflag <> 'N' AS resolved, count(*) AS n FROM lineitem JOIN symbols s ON l_partkey = symbol_id
  JOIN classes c ON c.name = s.name AND c.owner = s.owner AND c.signature = s.signature AND c.kind = s.kind AND c.accessor = s.accessor AND c.is_local = s.is_local GROUP BY ALL),
compared AS (SELECT q.name AS e_name, q.owner AS e_owner, q.signature AS e_signature, q.kind AS e_kind, q.accessor AS e_accessor, q.is_local AS e_is_local, x.c.kind AS m_kind, n,
    CASE WHEN NOT resolved THEN 'PossiblySame' WHEN EXISTS (SELECT 1 FROM same s WHERE s.e = q AND s.m = x.c) THEN 'Same' ELSE 'NotSame' END AS verdict
  FROM classes q JOIN mentioned x ON q.canon = x.c.canon),
sure AS (SELECT *, CASE verdict WHEN 'Same' THEN 'Certain' ELSE 'Uncertain' END AS confidence FROM compared WHERE verdict <> 'NotSame')
"""
)
_HITS = """hits AS (SELECT (regexp_extract(p_brand, '[0-9]+')::BIGINT // 2)::VARCHAR AS root, regexp_extract(p_brand, '[0-9]+') AS qualified_name,
  CASE WHEN l_returnflag = 'N' THEN 'Uncertain' ELSE 'Certain' END AS confidence, l_orderkey || '/' || l_partkey AS path, l_linenumber::BIGINT AS "offset", p_type, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_FIRST = """SELECT root, qualified_name, f.confidence AS confidence, f.path AS path, f."offset" AS "offset" FROM (
  SELECT root, qualified_name, min(struct_pack(confidence := confidence, path := path, "offset" := "offset")) AS f FROM ({}) GROUP BY ALL)"""
_OPEN = """open AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0),
links AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey // 4 AND y.c_mktsegment = x.c_mktsegment AND x.c_custkey <> y.c_custkey
  WHERE x.c_acctbal >= 0 AND y.c_acctbal >= 0),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM open UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
closed AS (SELECT id AS project, min(other) AS component FROM reach GROUP BY id)"""
_CHANGES = """changes AS (SELECT event_id AS seq, ts, user_id AS file_id, CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'REMOVED' ELSE 'CHANGED' END AS kind
  FROM events WHERE event_type <> 'purchase')"""
_AUDIT = (
    _LINES
    + """, twice AS (SELECT * FROM occ UNION ALL SELECT occ.* FROM occ JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND l.quality = 0),
keyed AS (SELECT project, path, word, "offset", kind, is_super, count(*) AS n,
    max(CASE WHEN substr(line, ("offset" - o.line_start + 1)::BIGINT, length(word)) = word THEN 0 ELSE 1 END) AS astray
  FROM twice o LEFT JOIN lines USING (project, path, line_no) GROUP BY ALL),
audit AS (SELECT project, sum(n)::BIGINT AS n_rows, 0::BIGINT AS n_wrong, sum(n - 1)::BIGINT AS n_repeated, sum(n * astray)::BIGINT AS n_astray, sum(n - 1 + n * astray) = 0 AS is_clean FROM keyed GROUP BY project)"""
)

#: The lines of bindings.CODE with a mark before what they tell: ¹ a declaration, ² a reference, ³ one in a super
#: position, ⁴ and ⁵ a constructor's declaration and reference.
_TOLD = (
    "class ⁴¹@[T](¹arg: ²@, val ¹more: ²T) extends ³Base[²@](²arg) with ³Other { self: ²Req => }",
    '  def ¹@[A](¹a: ²Int, ¹b: ²List[²A])(¹c: ²String): Map[A, @] = ²s"got ${²@.²size} of $²a" // @ here',
    "  val ¹@, ¹other: ²Foo = ⁵new ³Part(²@) with ³Rest { }",
    "import ²@.{inner, Other => _}, ²lib.@",
    '/* class @ { */ object ¹@ extends ³Root.³Leaf; "def @"; ²@ ²+ 1',
)


def _code_rows() -> str:
    """VALUES: line modulo five, word (@ for the line's), other characters before it, times @ stands before it, kind, is_super."""
    rows = []
    for k, line in enumerate(_TOLD):
        for mark in re.finditer("[¹²³⁴⁵]", line):
            before = re.sub("[¹²³⁴⁵]", "", line[: mark.start()])
            name = "<init>" if mark[0] in "⁴⁵" else re.match(r"@|\w+|\+", line[mark.end() :])[0]
            kind = "Declaration" if mark[0] in "¹⁴" else "Reference"
            rows.append(f"({k}, '{name}', {len(before) - before.count('@')}, {before.count('@')}, '{kind}', {str(mark[0] == '³').lower()})")
    return ", ".join(rows)


def _code(select: str) -> str:
    sizes = " ".join(f"WHEN {k} THEN {len(x) - x.count('@')} + {x.count('@')} * length(w)" for k, x in enumerate(CODE))
    return f"""WITH cut AS (SELECT source AS project, 'doc_' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
named AS (SELECT project, path, n, (n - 1) % {len(CODE)} AS k, 'w_' || regexp_extract(line, '[a-z]+') AS w FROM cut),
lines AS (SELECT *, coalesce(sum(1 + CASE k {sizes} END) OVER (PARTITION BY project, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start FROM named),
told(k, name, chars, times, kind, is_super) AS (VALUES {_code_rows()}),
occ AS (SELECT project, path, CASE name WHEN '@' THEN w ELSE name END AS word, (line_start + chars + times * length(w))::BIGINT AS "offset", kind, is_super, n::BIGINT AS line_no, line_start, k, w FROM lines JOIN told USING (k))
{select}"""


ORACLES: dict[str, str] = {
    "extract_code": _code('SELECT project, path, word, "offset", line_no, line_start FROM occ'),
    "extract_code_kinds": _code('SELECT project, path, word, "offset", kind FROM occ'),
    "find_subtypes": _code(
        """SELECT root, qualified_name, f.confidence AS confidence, f.path AS path, f."offset" AS "offset" FROM (SELECT 'lib.' || word AS root, project || '.' || w AS qualified_name,
        min(struct_pack(confidence := CASE WHEN line_no % 2 = 0 THEN 'Certain' ELSE 'Uncertain' END, path := path, "offset" := "offset")) AS f
        FROM occ WHERE is_super AND k <> 2 AND line_no % 3 <> 0 GROUP BY ALL)"""
    ),
    "extract_code_super": _code('SELECT project, path, word, "offset" FROM occ WHERE is_super'),
    "extract_words": _occ('SELECT project, path, word, "offset", line_no, line_start FROM occ'),
    "extract_kinds": _occ("""SELECT project, path, word, "offset" FROM occ WHERE kind = 'Declaration'"""),
    "extract_super": _occ('SELECT project, path, word, "offset" FROM occ WHERE is_super'),
    "extract_lines": _occ("SELECT project, path, line_no, line_start, line FROM lines", more=_LINES),
    "quarantine_failures": r"""SELECT source AS project, 'doc_' || doc_id AS path, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(length(text), 0)::BIGINT AS n_covered,
        coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), 0)::BIGINT AS n_words, CASE WHEN text IS NULL THEN 'missing' ELSE '' END AS reason FROM documents""",
    "find_word": _occ("""SELECT project, path, word, "offset", kind FROM occ WHERE word = 'that'"""),
    "find_any_word": _occ('SELECT project, path, word, "offset", kind FROM occ WHERE word IN (SELECT word FROM queries)', more=_QUERIES),
    "find_declarations": _occ("""SELECT project, path, "offset" FROM occ WHERE word = 'and' AND kind = 'Declaration'"""),
    "find_in_super_position": _occ("""SELECT project, path, "offset" FROM occ WHERE word = 'the' AND is_super"""),
    "occurrences_in_file": _occ("""SELECT word, "offset", kind FROM occ WHERE path = 'doc_7' AND project = 'src7'"""),
    "restrict_scope": _occ("""SELECT project, path, "offset" FROM occ WHERE word = 'and' AND project IN (SELECT project FROM scope)""", more=_SCOPE),
    "live_files_only": _occ("""SELECT project, path, "offset" FROM occ WHERE word = 'and' AND doc_id IN (SELECT doc_id FROM labels)"""),
    "batch_search": _occ(
        """SELECT query_id, mode, word, project, path, "offset" FROM occ JOIN queries USING (word)
        WHERE mode = 'any' OR mode = 'declaration' AND kind = 'Declaration' OR mode = 'super' AND is_super""",
        more=_QUERIES,
    ),
    "search_results": _occ("""SELECT project, path, "offset" FROM occ WHERE word = 'that'"""),
    "search_failures": f"SELECT project, 'no index' AS reason FROM {_WIDE} WHERE project NOT IN (SELECT source FROM documents)",
    "dedup_occurrences": _occ(_PER_FILE.format("SELECT * FROM occ")),
    "to_hit": _occ("""SELECT project, path, word, "offset", "offset" + length(word) AS "end", line_no FROM occ WHERE word = 'that'"""),
    "group_hits": _occ("""SELECT project, path, count(*)::BIGINT AS n_hits FROM occ WHERE word = 'and' GROUP BY GROUPING SETS ((project, path), (project))"""),
    "group_lines": _occ("""SELECT project, path, sum(n)::BIGINT AS n_hits, string_agg(line_no || ':' || places, ';' ORDER BY line_no) AS lines
        FROM (SELECT project, path, line_no, count(*) AS n, string_agg("offset", ',' ORDER BY "offset") AS places FROM occ WHERE word = 'and' GROUP BY ALL) GROUP BY project, path"""),
    "count_label": _occ(
        """SELECT project, path, coalesce(path, project) || ' (' || count(*) || ')' AS label FROM occ WHERE word = 'and' GROUP BY GROUPING SETS ((project, path), (project))"""
    ),
    "matches_in_file": _occ(
        """SELECT project, path, "offset" FROM occ WHERE word = 'and' AND project IN (SELECT project FROM scope) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""", more=_SCOPE
    ),
    "snippet": _occ(
        """SELECT occ.project, occ.path, occ."offset", trim(line) || CASE WHEN kind = 'Declaration' THEN '' ELSE ' - Potential match' END AS label,
        (strpos(trim(line), word) - 1)::BIGINT AS highlight_start, length(word)::BIGINT AS highlight_length, (occ."offset" - occ.line_start)::BIGINT AS hit_col
        FROM occ JOIN lines USING (project, path, line_no) WHERE word = 'that'""",
        more=_LINES,
    ),
    "occurrence_string": _occ(
        """SELECT project, path, "offset", word || ' in ' || CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN path ELSE 'File is deleted' END || ' at char ' || "offset" || ' ' || kind AS shown
        FROM occ WHERE word = 'that'"""
    ),
    "alternative_names": f"""WITH {_SYMBOLS} SELECT symbol_id, CASE WHEN kind IN ('val', 'var') THEN {_CANON.format("name")} || '_=,' || {_CANON.format("name")}
        WHEN {_CANON.format("name")} = 'apply' THEN 'apply,' || owner ELSE {_CANON.format("name")} END AS names FROM symbols""",
    "canonical_name": f"WITH {_SYMBOLS} SELECT symbol_id, {_CANON.format('name')} AS canonical FROM symbols",
    "display_name": f"WITH {_SYMBOLS} SELECT symbol_id, {_DISPLAY} AS display FROM symbols",
    "long_display_name": rf"WITH {_SYMBOLS} SELECT symbol_id, regexp_replace(qualified_name, '\.type$', '') AS long_display FROM symbols",
    "entity_kind": f"WITH {_SYMBOLS} SELECT symbol_id, kind FROM symbols",
    "searchable_entities": f"WITH {_SYMBOLS} SELECT symbol_id, kind FROM symbols WHERE kind IN ('val', 'var', 'method')",
    "hierarchy_label": f"""WITH {_SYMBOLS} SELECT symbol_id AS id, {_DISPLAY} || CASE WHEN accessor <> '' THEN ' - Not defined in project' ELSE '' END
        || CASE WHEN is_local THEN ' - Potential match' ELSE '' END AS label FROM symbols""",
    "declaration_location": f"""WITH {_SYMBOLS} SELECT symbol_id, CASE WHEN kind <> 'unknown' THEN owner END AS path, CASE WHEN kind <> 'unknown' THEN symbol_id END AS "offset" FROM symbols""",
    "compare_symbols": _COMPARED + "SELECT e_name, e_owner, e_signature, e_kind, e_accessor, e_is_local, verdict, count(*)::BIGINT AS n_classes, sum(n)::BIGINT AS n_mentions FROM compared GROUP BY ALL",
    "occurrences_of_entity": _COMPARED + "SELECT e_name, e_owner, e_signature, e_kind, e_accessor, e_is_local, confidence, sum(n)::BIGINT AS n FROM sure GROUP BY ALL",
    "find_references": _COMPARED.rstrip()
    + f""", forms AS (SELECT *, CASE WHEN kind IN ('val', 'var') THEN [{_CANON.format("name")} || '_=', {_CANON.format("name")}]
        WHEN {_CANON.format("name")} = 'apply' THEN ['apply', owner] ELSE [{_CANON.format("name")}] END AS names FROM symbols),
    asked AS (SELECT * FROM forms WHERE symbol_id IN (SELECT min(symbol_id) FROM symbols WHERE kind IN ('val', 'var', 'method') GROUP BY owner)),
    written AS (SELECT l_suppkey::VARCHAR AS project, l_orderkey || '/' || l_partkey AS path, names[l_quantity::INTEGER % len(names) + 1] AS word, (l_linenumber * 64)::BIGINT AS "offset", l_returnflag, f.*
      FROM lineitem JOIN forms f ON l_partkey = symbol_id)
    SELECT a.symbol_id AS entity, project, path, word, "offset", CASE l_returnflag WHEN 'N' THEN 'Uncertain' ELSE 'Certain' END AS confidence FROM asked a JOIN written w ON list_contains(a.names, w.word)
    WHERE l_returnflag = 'N' OR EXISTS (SELECT 1 FROM same s WHERE s.e.name = a.name AND s.e.owner = a.owner AND s.e.signature = a.signature AND s.e.kind = a.kind AND s.e.accessor = a.accessor AND s.e.is_local = a.is_local
      AND s.m.name = w.name AND s.m.owner = w.owner AND s.m.signature = w.signature AND s.m.kind = w.kind AND s.m.accessor = w.accessor AND s.m.is_local = w.is_local)""",
    "with_confidence": _COMPARED + "SELECT e_kind, m_kind, confidence, sum(n)::BIGINT AS n_mentions FROM sure GROUP BY ALL",
    "search_summary": _COMPARED
    + """SELECT e_owner, coalesce(sum(n) FILTER (confidence = 'Certain'), 0)::BIGINT AS n_certain, coalesce(sum(n) FILTER (confidence = 'Uncertain'), 0)::BIGINT AS n_uncertain, sum(n)::BIGINT AS n_all FROM sure GROUP BY ALL""",
    "entity_at": """WITH refs AS (SELECT l_suppkey::VARCHAR AS project, l_orderkey || '/' || l_partkey AS path, l_linenumber * 64::BIGINT AS "offset", l_partkey AS symbol_id, length(p_name) AS size,
          l_quantity::INTEGER % 24 AS ahead FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT project, path, ("offset" + ahead)::BIGINT AS "offset", project || '/' || path || '/' || "offset" AS loc_id, CASE WHEN ahead < size THEN symbol_id END AS symbol_id,
          CASE WHEN ahead < size THEN 'found' ELSE 'none' END AS status FROM refs""",
    "enclosing_declaration": _occ(
        r"""SELECT project, path, "offset", loc_id, CASE WHEN i IS NULL THEN CASE WHEN line_no IS NULL THEN 'document' ELSE 'line ' || line_no END WHEN i % 2 = 1 THEN NULL ELSE 'sentence ' || line_no || '.' || i END AS symbol_id
        FROM (SELECT o.project, o.path, o."offset", o.path || '/' || o."offset" AS loc_id, o.line_no, max(s.i) AS i FROM (SELECT * FROM occ WHERE is_super) o
          LEFT JOIN sentences s ON o.project = s.project AND o.path = s.path AND o.line_no = s.line_no AND s.first <= o."offset" AND o."offset" < s.first + s.size GROUP BY ALL)""",
        more=_LINES
        + r""", split AS (SELECT project, path, line_no, line_start, unnest(string_split(line, '. ')) AS part, generate_subscripts(string_split(line, '. '), 1) AS n FROM lines),
        sentences AS (SELECT project, path, line_no, n - 1 AS i, length(part) AS size,
          line_start + coalesce(sum(length(part) + 2) OVER (PARTITION BY project, path, line_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM split)""",
    ),
    "ancestors": f"WITH RECURSIVE {_BRANDS} SELECT root, id, depth FROM up",
    "direct_supertypes": """WITH brands AS (SELECT DISTINCT regexp_extract(p_brand, '[0-9]+')::BIGINT AS id FROM part),
        parents AS (SELECT id AS child, id // 2 AS parent, 0 AS ord FROM brands WHERE id >= 2 UNION ALL SELECT id, id // 3, 1 FROM brands WHERE id >= 6),
        known AS (SELECT child, parent, ord, parent % 3 <> 0 AS is_class FROM parents WHERE parent IN (SELECT id FROM brands))
        SELECT b.id, CASE WHEN coalesce(bool_or(k.is_class), false) THEN '' ELSE 'Object' || CASE WHEN count(k.parent) > 0 THEN ',' ELSE '' END END
          || coalesce(string_agg(k.parent::VARCHAR, ',' ORDER BY k.ord, k.parent), '') AS supertypes FROM brands b LEFT JOIN known k ON k.child = b.id GROUP BY b.id""",
    "direct_subtypes": f"WITH {_HITS} " + _FIRST.format('SELECT root, qualified_name, confidence, path, "offset" FROM hits WHERE root <> qualified_name'),
    "first_per_qualified_name": f"WITH {_HITS} " + _FIRST.format('SELECT p_type AS root, p_name AS qualified_name, confidence, path, "offset" FROM hits'),
    "type_hierarchy": f"""WITH RECURSIVE {_BRANDS} SELECT id AS root, root AS id, depth, NOT EXISTS (SELECT 1 FROM brands x WHERE x.id >= 2 AND x.id // 2 = up.root) AS is_leaf
        FROM up WHERE id IN (SELECT id FROM brands)""",
    "project_closure": f"WITH RECURSIVE {_OPEN} SELECT project, component FROM closed",
    "scope_for": f"""WITH RECURSIVE {_OPEN} SELECT DISTINCT s.project AS seed, t.project FROM closed s JOIN closed t USING (component)
        WHERE s.project IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND t.project IN (SELECT o_custkey FROM orders)""",
    "delete_file_occurrences": _occ(_PER_FILE.format("SELECT * FROM occ WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")),
    "upsert_files": _occ(
        _PER_FILE.format("SELECT * FROM occ"),
        files="(SELECT source, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'of the new ' || text ELSE text END AS text FROM documents)",
    ),
    "rebuild_projects": _occ(_PER_FILE.format("SELECT * FROM occ WHERE project IN (SELECT project FROM scope) OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"), more=_SCOPE),
    "drop_projects": _occ(_PER_FILE.format("SELECT * FROM occ WHERE project NOT IN (SELECT project FROM scope)"), more=_SCOPE),
    "stored_rebuild": _occ(_PER_FILE.format("SELECT * FROM occ WHERE project IN (SELECT project FROM scope) OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"), more=_SCOPE),
    "stored_upsert": _occ(_PER_FILE.format("SELECT * FROM occ WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")),
    "stored_drop": _occ(_PER_FILE.format("SELECT * FROM occ WHERE project NOT IN (SELECT project FROM scope)"), more=_SCOPE),
    "audit_occurrences": _occ("SELECT * FROM audit", more=_AUDIT),
    "projects_to_rebuild": _occ(f"SELECT project FROM {_WIDE} WHERE project NOT IN (SELECT project FROM audit WHERE is_clean)", more=_AUDIT),
    "ingest_records": _occ(
        """SELECT project, count(*)::BIGINT AS n_rows, CASE WHEN l.quality = 0 THEN 'invalid' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'good' END AS outcome
        FROM occ LEFT JOIN labels l USING (doc_id) GROUP BY ALL"""
    ),
    "file_change_stream": f"WITH {_CHANGES} SELECT seq, file_id, kind FROM changes",
    "gate_indexable": f"WITH {_CHANGES} SELECT seq, file_id, kind FROM changes WHERE kind = 'REMOVED' OR file_id IN (SELECT doc_id FROM labels)",
    "collapse_events": f"WITH {_CHANGES} SELECT file_id, arg_max(kind, (ts, seq)) AS kind FROM changes GROUP BY file_id",
    "maintain_index": _occ(
        _PER_FILE.format(
            """SELECT occ.* FROM occ LEFT JOIN final f ON f.file_id = occ.doc_id
            WHERE f.kind IN ('ADDED', 'CHANGED') OR f.kind IS NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
        ),
        more=f", {_CHANGES}, final AS (SELECT file_id, arg_max(kind, (ts, seq)) AS kind FROM changes WHERE kind = 'REMOVED' OR file_id IN (SELECT doc_id FROM labels) GROUP BY file_id)",
    ),
    "project_state": """SELECT project, last_kind, last_kind = 'OPEN' AS is_indexed FROM (SELECT user_id AS project,
        arg_max(CASE event_type WHEN 'signup' THEN 'OPEN' WHEN 'error' THEN 'CLOSE' ELSE 'DELETE' END, (ts, event_id)) AS last_kind
        FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY user_id)""",
}
