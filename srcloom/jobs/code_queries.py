"""Queries over the prose and code corpora, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.rule_catalog import MIGRATIONS, RULES
from srcloom.functions.shared import written
from srcloom.functions.textual import any_glob, glob_pattern
from srcloom.operators import abstractions, code_duplicates, duplicates, metrics, modules, patterns, statements, symbols
from srcloom.sources import rendered
from srcloom.sources.corpora import ENTRY_POINTS, EXTENSIONS, TEST_NAMES, code_files, code_lines, extension, is_test, language, lines_of, project_files, prose_files
from srcloom.sources.tables import table

CODE = f"WITH code AS ({rendered.duckdb_lines(rendered.CODE)})"
PROSE = """WITH code AS (
  SELECT coalesce(source, 'none') || '/' || doc_id::VARCHAR || '.py' AS path, 'python' AS language, unnest(range(1, len(parts) + 1))::INTEGER AS n, unnest(parts) AS line
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
)"""
_TEST = f"regexp_matches(regexp_extract(path, '[^/]*$'), '{TEST_NAMES}')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(pattern)}))"


_FACTS = f""", trimmed AS (
  SELECT *, regexp_replace(line, '^[\\s\\x{{A0}}\\x{{FEFF}}\\x{{2028}}\\x{{2029}}]+', '') AS t FROM code
), strip1 AS (
  SELECT *, regexp_replace(t, '//.*$', '') AS s1 FROM trimmed
), strip2 AS (
  SELECT *, CASE WHEN language = 'python' THEN regexp_replace(s1, '#.*$', '') ELSE s1 END AS s2 FROM strip1
), coded AS (
  SELECT *, regexp_replace(regexp_replace(s2, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), '''(?:[^''\\\\]|\\\\.)*''', '''''', 'g') AS c FROM strip2
), facts AS (
  SELECT path, language, n, line, t, c,
    (regexp_matches(t, '^(?://|\\*|/\\*)') OR (language = 'python' AND starts_with(t, '#'))) AS is_comment,
    {_count('c', r'\bif\b')} + {_count('c', r'\belse\b')} - {_count('c', r'\belse\s+if\b')}
      + {' + '.join(_count('c', p) for p in metrics.BRANCH_WORDS)}
      + {_count('c', r'\?')} - {_count('c', r'\?\.')} - 2 * {_count('c', r'\?\?')} - {_count('c', r'\w\s*\?\s*[:)(]')} AS branches,
    CASE WHEN language = 'go' THEN regexp_matches(c, '\\b(?:func|type|var|const)\\s+[A-Z]') ELSE regexp_matches(c, '\\bexport\\b') END::INT AS exports,
    CASE WHEN language = 'go' THEN regexp_matches(c, '^\\s*import\\s+"') OR (regexp_matches(c, '^\\s*(?:\\.\\s+|[a-zA-Z_]\\w*\\s+)?"[^"]*"') AND NOT regexp_matches(c, '\\bimport\\s*\\(') AND NOT regexp_matches(c, '^\\s*import\\b'))
         ELSE regexp_matches(c, '\\bimport\\b') OR regexp_matches(c, '\\brequire\\s*\\(') END::INT AS imports
  FROM coded
), counted AS (
  SELECT path, count(*)::BIGINT AS line_count, (count(*) FILTER (t <> '' AND NOT is_comment))::BIGINT AS code_lines,
         (count(*) FILTER (is_comment))::BIGINT AS comment_lines, sum(branches)::BIGINT AS branch_points,
         sum(exports)::BIGINT AS exports, sum(imports)::BIGINT AS imports
  FROM facts GROUP BY path
), file_metrics AS (
  SELECT *, CASE WHEN code_lines = 0 THEN 0.0 ELSE comment_lines::DOUBLE / code_lines::DOUBLE END AS comment_ratio FROM counted
)"""
_NESTING = r""", steps AS (
  SELECT path, n, branches, regexp_matches(c, '^\s*\}')::INT AS down, regexp_matches(c, '\{\s*$')::INT AS up FROM facts WHERE language <> 'python'
), summed AS (
  SELECT *, sum(up - down) OVER (PARTITION BY path ORDER BY n) AS after_ FROM steps
), dipped AS (
  SELECT *, after_ - least(0, min(after_ - up) OVER (PARTITION BY path ORDER BY n)) AS depth FROM summed
), held AS (
  SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY n), 0) AS depth_before FROM dipped
), braces AS (
  SELECT path, max(depth)::BIGINT AS max_depth, sum(branches * (1 + depth_before))::BIGINT AS complexity FROM held GROUP BY path
), indented AS (
  SELECT path, n, branches, t <> '' AS filled, length(line) - length(t) AS indent FROM facts WHERE language = 'python'
), opened AS (
  -- a line is open at a later one while all in between, and that one, are indented deeper
  SELECT i.path, i.n, count(*) AS depth FROM indented i JOIN indented j ON i.path = j.path AND j.n <= i.n AND i.filled AND j.filled AND j.indent > 0
  WHERE NOT EXISTS (SELECT 1 FROM indented k WHERE k.path = i.path AND k.filled AND k.n > j.n AND k.n <= i.n AND k.indent <= j.indent)
  GROUP BY i.path, i.n
), levels AS (
  SELECT i.path, i.n, i.branches, CASE WHEN i.filled THEN coalesce(o.depth, 0) END AS depth FROM indented i LEFT JOIN opened o ON o.path = i.path AND o.n = i.n
), weighed AS (
  SELECT *, coalesce(last_value(depth IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM levels
), indents AS (
  SELECT path, coalesce(max(depth), 0)::BIGINT AS max_depth, sum(branches * (1 + before))::BIGINT AS complexity FROM weighed GROUP BY path
), nested AS (SELECT * FROM braces UNION ALL SELECT * FROM indents)"""


def file_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.file_metrics(lines_of(prose_files(spark, folder)))


def code_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.file_metrics(code_lines(spark, folder))


def brace_nesting(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.brace_nesting(metrics.line_facts(code_lines(spark, folder).filter("language <> 'python'")))


def indent_nesting(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.indent_nesting(metrics.line_facts(code_lines(spark, folder).filter("language = 'python'")))


#: Lower than the defaults, so that the small files of the code corpus exceed them.
LOW = {"lines": 20, "complexity": 8, "nesting": 2, "exports": 1, "imports": 4}


def metric_findings(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.metric_findings(code_lines(spark, folder), LOW)


METRIC_FINDINGS = f"""{CODE}{_FACTS}{_NESTING}, j AS (
  SELECT f.*, d.max_depth, d.complexity, {_TEST} AS test, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS name
  FROM file_metrics f LEFT JOIN nested d USING (path)
), m AS (
  SELECT *, regexp_matches(name, '(?i)^(?:helpers?|utils?|misc|lib|tools|functions|methods)$') AS strong, regexp_matches(name, '(?i)^(?:common|shared)$') AS weak FROM j
)
SELECT path, 'metrics-long-file' AS rule, 'medium' AS severity, 'metrics' AS category, line_count AS value FROM m WHERE line_count > CASE WHEN test THEN 40 ELSE 20 END
UNION ALL SELECT path, 'metrics-high-complexity', 'high', 'metrics', complexity FROM m WHERE complexity > 8
UNION ALL SELECT path, 'metrics-deep-nesting', 'medium', 'metrics', max_depth FROM m WHERE max_depth > 2
UNION ALL SELECT path, 'metrics-high-exports', 'medium', 'modularity', exports FROM m WHERE exports > 1
UNION ALL SELECT path, 'metrics-high-imports', 'medium', 'modularity', imports FROM m WHERE imports > 4
UNION ALL SELECT path, 'metrics-low-comments', 'low', 'comment-quality', complexity FROM m WHERE comment_ratio < 0.02 AND complexity > 8
UNION ALL SELECT path, 'metrics-excessive-comments', 'low', 'comment-quality', comment_lines FROM m WHERE comment_ratio > 0.5 AND code_lines >= 20 AND NOT test
UNION ALL SELECT path, 'metrics-grab-bag', 'medium', 'modularity', line_count FROM m WHERE (strong AND (line_count > 150 OR exports > 5)) OR (weak AND line_count > 150 AND exports > 5)
"""


def pattern_hits(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.pattern_hits(code_lines(spark, folder))


def prose_pattern_hits(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.pattern_hits(lines_of(prose_files(spark, folder)))


#: What RE2 lacks, said otherwise.
_RE2 = {
    "magic-number": r"(?:^|[^a-zA-Z0-9_.])[1-9]\d{2,}\b",
    "hardcoded-url": None,
}


def _hit(rule, x: str = "line") -> str:
    if rule.id == "hardcoded-url":
        urls = r"https?://[^\s\"'`]+"
        return f"len(list_filter(regexp_extract_all({x}, {_q(urls.replace(chr(92) + chr(34), chr(34)))}), lambda u: NOT regexp_matches(u, '^https?://(?:localhost|127\\.0\\.0\\.1|example\\.com|schema\\.org|www\\.w3\\.org|tools\\.ietf\\.org)'))) > 0"
    return f"regexp_matches({x}, {_q(_RE2.get(rule.id) or rule.pattern)})"


def _pattern_sql(corpus: str, languages: tuple[str, ...]) -> str:
    hits, vetoes = [], []
    for r in RULES:
        if r.language not in ("common", *languages):
            continue
        here = f"regexp_matches(path, {_q(patterns._files(r))})" + (f" AND NOT regexp_matches(path, {_q('|'.join('(?:' + glob_pattern(g) + ')' for g in r.excludes))}) AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), {_q('|'.join('(?:' + glob_pattern(g) + ')' for g in r.excludes))})" if r.excludes else "")
        if r.language != "common":
            here += f" AND language = '{r.language}'"
        hits.append(f"SELECT path, n, '{r.id}' AS rule, '{r.severity}' AS severity, '{r.category}' AS category, line FROM code WHERE {here} AND {_hit(r)}")
        if r.unless:
            vetoes.append(f"SELECT path, '{r.id}' AS rule FROM code WHERE {here} AND regexp_matches(line, {_q(r.unless)})")
    return f"""{corpus}, hits AS ({' UNION ALL '.join(hits)}), vetoes AS ({' UNION '.join(vetoes)})
SELECT path, n, rule, severity, category, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS match FROM hits ANTI JOIN vetoes USING (path, rule)"""


def race_findings(spark: SparkSession, folder: str) -> DataFrame:
    return patterns.races(code_lines(spark, folder))


def _race_case(k: int) -> str:
    return "CASE " + " ".join(f"WHEN language = '{x}' THEN regexp_matches(line, {_q(p[k])})" for x, p in patterns.RACES.items()) + " END"


RACES = f"""{CODE}, facts AS (
  SELECT path, n, {_race_case(0)} AS is_check, {_race_case(1)} AS act, {_race_case(2)} AS safe, regexp_matches(line, '\\bif\\b') AS cond
  FROM code WHERE language IN ('typescript', 'python') AND NOT {_TEST}
), firsts AS (
  SELECT c.path, c.n, (SELECT min(a.n) FROM facts a WHERE a.path = c.path AND a.act AND a.n > c.n AND a.n <= c.n + 8) AS act_n
  FROM facts c LEFT JOIN facts b ON b.path = c.path AND b.n = c.n - 1 WHERE c.is_check AND (c.cond OR b.cond)
)
SELECT path, n, act_n FROM firsts f WHERE act_n IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM facts s WHERE s.path = f.path AND s.safe AND s.n BETWEEN f.n AND f.act_n)
"""


def inconsistent_patterns(spark: SparkSession, folder: str) -> DataFrame:
    files = code_files(spark, folder).select("path", patterns.without_noise(F.col("content")).alias("content"))
    return patterns.inconsistent(files, 2)


def _approach_sql() -> str:
    each = []
    for concern, approach, pattern in patterns.APPROACHES:
        shown = " OR ".join(f"regexp_matches(x, '\\b{w}\\b')" for w in patterns.CONCERNS[concern])
        each.append(f"SELECT '{concern}' AS concern, '{approach}' AS approach, count(*)::BIGINT AS n_files FROM clean WHERE ({shown}) AND regexp_matches(x, {_q(pattern)}) HAVING count(*) > 0")
    return " UNION ALL ".join(each)


INCONSISTENT = f"""{CODE}, whole AS (SELECT path, string_agg(line, chr(10) ORDER BY n) AS x FROM code WHERE NOT {_TEST} GROUP BY path), clean AS (
  SELECT path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
    '/\\*[\\s\\S]*?\\*/', '', 'g'), '(\\A|[^:])//[^\\n]*', '\\1', 'g'), '(?m)^\\s*#[^\\n]*', '', 'g'), '`[^`]*`', '""', 'g'), '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), '''(?:[^''\\\\]|\\\\.)*''', '''''', 'g'),
    '([=({{\\[,;!&|?:\\s])/[^/\\n]+/[gimsuy]*', '\\1""', 'g') AS x FROM whole
), found AS ({_approach_sql()})
SELECT concern, count(*)::BIGINT AS n_approaches, string_agg(approach || '=' || n_files::VARCHAR, '; ' ORDER BY approach || '=' || n_files::VARCHAR) AS approaches
FROM found GROUP BY concern HAVING count(*) >= 2
"""


def outdated_usage(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.col("html").alias("content"))
    return patterns.outdated(lines_of(pages).union(code_lines(spark, folder)))


def _outdated_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{m.ecosystem}' AS ecosystem, {_q(m.old)} AS old, {_q(m.new)} AS new, '{m.severity}' AS severity, path FROM both_ WHERE language = '{patterns.ECOSYSTEMS[m.ecosystem]}' AND regexp_matches(line, {_q(m.pattern)})" for m in MIGRATIONS
    )
    return f"""{CODE}, both_ AS (
  SELECT path, language, line FROM code UNION ALL
  SELECT 'pages/' || page_id::VARCHAR || '.js', 'typescript', unnest(string_split(html, chr(10))) FROM pages WHERE html IS NOT NULL
), found AS ({each})
SELECT ecosystem, old, new, severity, count(*)::BIGINT AS n_lines, count(DISTINCT path)::BIGINT AS n_files FROM found GROUP BY ALL"""


def _coalesced_groups(patterns_: tuple[str, ...], x: str = "line") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {_q(p)}, 1), '')" for p in patterns_) + ")"


# several-line forms by the line that opened them last and the one that closed last
_STATES = r""", opened AS (
  SELECT *, trim(line, ' ' || chr(9)) AS t,
         CASE WHEN regexp_matches(line, '^import \{$') OR regexp_matches(line, '^from \S+ import \($') OR regexp_matches(line, '^import \($') THEN n END AS import_n,
         CASE WHEN regexp_matches(line, '^export \{$') THEN n END AS export_n, CASE WHEN regexp_matches(line, '^(?:var|const) \($') THEN n END AS block_n,
         CASE WHEN regexp_matches(line, '^[})]') THEN n END AS close_n FROM code
), states AS (
  SELECT *, last_value(import_n IGNORE NULLS) OVER before AS import_at, last_value(export_n IGNORE NULLS) OVER before AS export_at, last_value(block_n IGNORE NULLS) OVER before AS block_at,
         coalesce(last_value(close_n IGNORE NULLS) OVER before, 0) AS closed_at, first_value(close_n IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ends
  FROM opened WINDOW before AS (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_EXPORTS = f"""{_STATES}, named AS (
  SELECT path, language, n, line, CASE language {' '.join(f"WHEN '{x}' THEN {_coalesced_groups(p)}" for x, p in symbols.EXPORTS.items())} END AS name,
         language = 'python' AND coalesce(starts_with(trim(lag(line) OVER (PARTITION BY path ORDER BY n)), '@'), false) AS decorated FROM code
), exports AS (
  SELECT path, language, n, name, language = 'typescript' AND regexp_matches(line, '^export\\s+(?:type|interface)\\b') AS is_type, decorated, false AS handed_on FROM named WHERE name IS NOT NULL
  UNION ALL
  SELECT path, language, export_at, regexp_replace(rtrim(t, ','), '^.* as ', ''), false, false, false FROM states WHERE language = 'typescript' AND export_at > closed_at AND close_n IS NULL
  UNION ALL
  SELECT path, language, n, regexp_replace(trim(regexp_extract(line, 'export\\s+\\{{([^}}]+)\\}}', 1)), '^.* as ', ''), false, false, regexp_matches(line, '^\\s*export\\s+\\{{[^}}]*\\}}\\s+from\\s') FROM code WHERE language = 'typescript' AND regexp_matches(line, 'export\\s+\\{{[^}}]+\\}}')
  UNION ALL
  SELECT path, language, n, regexp_extract(t, '^([A-Z][A-Za-z0-9_]*)', 1), false, false, false FROM states WHERE language = 'go' AND block_at > closed_at AND close_n IS NULL AND regexp_matches(t, '^[A-Z][A-Za-z0-9_]*(?:\\s|$)')
)"""
_IMPORTS = r""", told AS (
  SELECT path, language, n, n AS ends, CASE language
    WHEN 'typescript' THEN coalesce(nullif(regexp_extract(line, '^import\s+\{\s*([^}]+?)\s*\}\s+from', 1), ''), nullif(regexp_extract(line, 'export\s+\{\s*([^}]+?)\s*\}\s+from', 1), ''))
    WHEN 'python' THEN nullif(regexp_extract(line, '^from\s+\S+\s+import\s+([^(]+)$', 1), '')
    WHEN 'go' THEN nullif(regexp_extract(line, '^import\s+([A-Za-z_.][A-Za-z0-9_]*\s+"[^"]+")', 1), '')
    WHEN 'java' THEN nullif(regexp_extract(line, '^import\s+(?:static\s+)?(?:\w+\.)*(\w+)\s*;', 1), '')
    ELSE nullif(regexp_extract(line, '^using\s+([A-Za-z_][A-Za-z0-9_]*)\s*=', 1), '') END AS said,
    CASE language WHEN 'typescript' THEN CASE WHEN starts_with(line, 'export') THEN 're-export' ELSE 'named' END WHEN 'python' THEN 'named' WHEN 'go' THEN 'package' WHEN 'java' THEN 'class' ELSE 'alias' END AS kind
  FROM code
  UNION ALL
  SELECT path, language, CASE WHEN language = 'go' THEN n ELSE import_at END, CASE WHEN language = 'go' THEN n ELSE ends END, regexp_replace(rtrim(t, ','), '^type ', ''), CASE WHEN language = 'go' THEN 'package' ELSE 'named' END
  FROM states WHERE import_at > closed_at AND close_n IS NULL
), imports AS (
  SELECT path, language, n, ends, kind,
    CASE WHEN language = 'go' THEN regexp_extract(said, '([^/"]*)"$', 1) ELSE regexp_replace(said, ' as .*$', '') END AS name,
    CASE WHEN language = 'go' THEN coalesce(nullif(regexp_extract(said, '^([A-Za-z_.][A-Za-z0-9_]*)\s', 1), ''), regexp_extract(said, '([^/"]*)"$', 1)) ELSE regexp_replace(said, '^.* as ', '') END AS local
  FROM told WHERE said IS NOT NULL
), asked AS (SELECT DISTINCT path, language, CASE WHEN kind = 'package' THEN local ELSE name END AS name FROM imports)"""
_ENTRY = "regexp_extract(path, '[^/]*$') IN (" + ", ".join(map(_q, ENTRY_POINTS)) + ")"
_CONFIDENCE = "CASE WHEN is_type THEN least(CASE WHEN language = 'python' AND decorated THEN 0.3 WHEN language = 'python' THEN 0.6 WHEN language IN ('go', 'csharp') THEN 0.7 ELSE 0.9 END, 0.5) WHEN language = 'python' AND decorated THEN 0.3 WHEN language = 'python' THEN 0.6 WHEN language IN ('go', 'csharp') THEN 0.7 ELSE 0.9 END::DOUBLE"


def _code(spark: SparkSession, folder: str) -> DataFrame:
    """The code corpus, rendered once."""
    return written(code_files(spark, folder), "code")


def _symbols(files: DataFrame) -> DataFrame:
    """The symbols of files, found once."""
    return written(symbols.file_symbols(files), "symbols")


def project_roots(spark: SparkSession, folder: str) -> DataFrame:
    """The projects of the code corpus, and its top folders, which hold no manifests."""
    apps = spark.sql("SELECT DISTINCT concat('projects/app', CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)) AS project FROM {part}", part=table(spark, folder, "part"))
    return apps.union(spark.createDataFrame([("orders",), ("parts",), ("projects",)], "project string"))


def exported_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.exports(symbols.file_symbols(code_files(spark, folder)))


def imported_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.imports(symbols.file_symbols(code_files(spark, folder)))


def reachable_files(spark: SparkSession, folder: str) -> DataFrame:
    return modules.reachable_files(_code(spark, folder), project_files(spark, folder))


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    """A log of commits: every order adds its file on its day; those of some priorities change it only."""
    added = F.when(F.col("o_orderpriority") == "5-LOW", "M").otherwise("A")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), added.alias("status"), F.col("o_orderdate").alias("at"))
    named = spark.sql(f"SELECT {rendered.ORDER_PATH} AS path, status, at FROM (SELECT CAST(k AS BIGINT) AS k, CAST(k % 5 AS INT) AS lang, status, at FROM {{orders}})", orders=orders)
    return named


def recent_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files added in the 300 days before the last commit."""
    log = _commits(spark, folder)
    return symbols.recent_files(log, F.lit(log.agg(F.max("at")).first()[0]), 300)


def dead_exports(spark: SparkSession, folder: str) -> DataFrame:
    files = _code(spark, folder)
    return symbols.dead_exports(_symbols(files), modules.reachable_files(files, project_files(spark, folder)), recent_files(spark, folder))


def dead_exports_by_words(spark: SparkSession, folder: str) -> DataFrame:
    files = _code(spark, folder)
    return symbols.dead_exports_by_words(files, symbols.file_symbols(files))


def divergent_exports(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.divergent_exports(symbols.file_symbols(code_files(spark, folder)))


def fan_in(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.fan_in(_symbols(code_files(spark, folder)))


def single_implementations(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.implementations(code_files(spark, folder))


def _with_importers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = _code(spark, folder)
    return files, symbols.fan_in(_symbols(files))


def pass_throughs(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.pass_throughs(*_with_importers(spark, folder))


def single_method_classes(spark: SparkSession, folder: str) -> DataFrame:
    return abstractions.single_method_classes(*_with_importers(spark, folder))


def single_implementation_interfaces(spark: SparkSession, folder: str) -> DataFrame:
    return abstractions.single_implementation_interfaces(*_with_importers(spark, folder))


def unused_imports(spark: SparkSession, folder: str) -> DataFrame:
    return statements.unused_imports(code_files(spark, folder))


def classified_files(spark: SparkSession, folder: str) -> DataFrame:
    files = code_lines(spark, folder).select("path").distinct()
    globs = ("**/*7.ts", "parts/part1*.{go,java}", "orders/order?.*")
    return files.select("path", extension(F.col("path")).alias("extension"), language(F.col("path")).alias("language"), is_test(F.col("path")).alias("is_test"), any_glob(F.col("path"), globs).alias("ignored"))


_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '.(\\.[^.]*)$', 1)"
CLASSIFIED = f"""{CODE}, f AS (SELECT DISTINCT path FROM code)
SELECT path, {_EXT} AS extension, CASE {' '.join(f"WHEN {_EXT} IN ({', '.join(map(_q, e))}) THEN '{x}'" for x, e in EXTENSIONS.items())} END AS language,
       {_TEST} AS is_test,
       (regexp_matches(path, '^(.+/)?[^/]*7\\.ts$') OR regexp_matches(path, '^parts/part1[^/]*\\.(go|java)$') OR regexp_matches(path, '^orders/order[^/]\\.[^/]*$')) AS ignored
FROM f"""


def token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return code_duplicates.token_counts(code_duplicates.token_files(code_files(spark, folder)))


_KEYWORD_LIST = ", ".join(_q(k) for k in duplicates.KEYWORDS)
WINDOW = 40


def _word_items(spark: SparkSession, folder: str) -> DataFrame:
    return prose_files(spark, folder).select("path", F.regexp_extract_all("content", F.lit(r"[^\s]+"), F.lit(0)).alias("items"))


def window_matches(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.window_matches(_word_items(spark, folder), WINDOW)


def duplicate_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.clusters(written(duplicates.window_links(_word_items(spark, folder), WINDOW), "window-links"))


def code_window_matches(spark: SparkSession, folder: str) -> DataFrame:
    return code_duplicates.code_window_matches(code_duplicates.token_files(code_files(spark, folder)))


def code_duplicate_regions(spark: SparkSession, folder: str) -> DataFrame:
    regions = code_duplicates.duplicate_regions(_code(spark, folder))
    return regions.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.concat(x["a"], F.lit(" vs "), x["b"])), "; "))


def code_duplicate_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return code_duplicates.region_clusters(code_duplicates.duplicate_regions(_code(spark, folder)))


_WINDOWS = f"""WITH items AS (
  SELECT coalesce(source, 'none') || '/' || doc_id::VARCHAR || '.py' AS path, regexp_extract_all(coalesce(text, ''), '[^\\s]+') AS w FROM documents
), windows AS (
  SELECT path, start, list_slice(w, start + 1, start + {WINDOW}) AS key FROM (SELECT path, w, unnest(range(len(w) - {WINDOW} + 1)) AS start FROM items WHERE len(w) >= {WINDOW})
), held AS (
  SELECT path, start, md5(array_to_string(key, ' ')) AS key FROM windows
), common AS (
  SELECT key FROM held GROUP BY key HAVING count(*) BETWEEN 2 AND {duplicates.MOST_IN_BUCKET}
), kept AS (SELECT * FROM held SEMI JOIN common USING (key)), pairs AS (
  SELECT a.path AS path_a, b.path AS path_b, count(*)::BIGINT AS n_windows FROM kept a JOIN kept b ON a.key = b.key
   AND (a.path < b.path OR (a.path = b.path AND b.start - a.start >= {WINDOW})) GROUP BY 1, 2
)"""
CLUSTERS = f"""{_WINDOWS.replace('WITH items', 'WITH RECURSIVE items', 1)}, links AS (
  SELECT path_a AS u, path_b AS v FROM pairs WHERE path_a <> path_b UNION SELECT path_b, path_a FROM pairs WHERE path_a <> path_b
), reached AS (
  SELECT u AS path, u AS other FROM links UNION SELECT r.path, l.v FROM reached r JOIN links l ON r.other = l.u
), rooted AS (SELECT path, min(other) AS root FROM reached GROUP BY path)
SELECT path, root, count(*) OVER (PARTITION BY root)::BIGINT AS size FROM rooted"""


# the corpus holds no negative numbers, which RE2 could not tell from differences
_ONE_TOKEN = "|".join((code_duplicates.COMMENT.replace(r"\Z", r"\z"), code_duplicates.STRING, code_duplicates.NAME, code_duplicates.NUMBER, r"[(){}\[\];,.<>+*/=!&|?:-]"))
TOKENS = f"""{CODE}, whole AS (SELECT path, string_agg(line, chr(10) ORDER BY n) AS x FROM code GROUP BY path), raw AS (
  SELECT unnest(list_filter(regexp_extract_all(x, {_q(_ONE_TOKEN)}), lambda t: NOT (t[1] = '#' OR starts_with(t, '//') OR starts_with(t, '/*')))) AS t FROM whole
)
SELECT CASE WHEN t[1] IN ('"', '''', '`') THEN 'STR' WHEN regexp_matches(t[1], '[0-9]') THEN 'NUM' WHEN t IN ({_KEYWORD_LIST}) OR NOT regexp_matches(t[1], '[A-Za-z_$]') THEN t ELSE 'IDENT' END AS token, count(*)::BIGINT AS n
FROM raw GROUP BY 1"""
CODE_WINDOWS = f"""{CODE}, whole AS (SELECT path, string_agg(line, chr(10) ORDER BY n) AS x FROM code GROUP BY path), raw AS (
  SELECT path, list_filter(regexp_extract_all(x, {_q(_ONE_TOKEN)}), lambda t: NOT (t[1] = '#' OR starts_with(t, '//') OR starts_with(t, '/*'))) AS w FROM whole
), items AS (
  SELECT path, list_transform(w, lambda t: CASE WHEN t[1] IN ('"', '''', '`') THEN 'STR' WHEN regexp_matches(t[1], '[0-9]') THEN 'NUM' WHEN t IN ({_KEYWORD_LIST}) OR NOT regexp_matches(t[1], '[A-Za-z_$]') THEN t ELSE 'IDENT' END) AS w
  FROM raw WHERE len(w) >= {code_duplicates.SIZE}
), held AS (
  SELECT path, start, md5(array_to_string(list_slice(w, start + 1, start + {code_duplicates.SIZE}), ' ')) AS key FROM (SELECT path, w, unnest(range(len(w) - {code_duplicates.SIZE} + 1)) AS start FROM items)
), common AS (SELECT key FROM held GROUP BY key HAVING count(*) BETWEEN 2 AND {duplicates.MOST_IN_BUCKET}), kept AS (SELECT * FROM held SEMI JOIN common USING (key))
SELECT a.path AS path_a, b.path AS path_b, count(*)::BIGINT AS n_windows FROM kept a JOIN kept b ON a.key = b.key
 AND (a.path < b.path OR (a.path = b.path AND b.start - a.start >= {code_duplicates.SIZE})) GROUP BY 1, 2"""


_FAN_IN = """, pairs AS (
  SELECT e.path, count(DISTINCT w.path) AS k FROM exports e JOIN asked w ON w.name = e.name AND w.path <> e.path GROUP BY e.path
), fan_in AS (SELECT p.path, coalesce(k, 0)::BIGINT AS fan_in FROM (SELECT DISTINCT path FROM exports) p LEFT JOIN pairs USING (path))"""
_REACHABLE = r""", specs AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '^projects/[^/]*') AS root, unnest(regexp_extract_all(line, '(?:export\s+\*\s+from|\bimport\s*\()\s*[''"]([^''"]+)[''"]', 1)) AS spec FROM code WHERE language = 'typescript'
), bases AS (
  SELECT CASE WHEN starts_with(spec, './') THEN dir || substr(spec, 2) WHEN starts_with(spec, '@lazy/') THEN root || '/src/lazy/' || substr(spec, 7) WHEN starts_with(spec, '@/') THEN root || '/src/' || substr(spec, 3) END AS base FROM specs
), reachable AS (
  SELECT DISTINCT path FROM (SELECT DISTINCT path FROM code) c JOIN bases b ON regexp_replace(c.path, '\.[^./]*$', '') = regexp_replace(b.base, '\.js$', '')
)"""
_ORDER_FILES = f"SELECT {rendered.ORDER_PATH} AS path, o_orderdate AS added_at, o_orderpriority AS priority FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS lang, o_orderdate, o_orderpriority FROM orders)"
_RECENT = f", recent AS (SELECT DISTINCT path FROM ({_ORDER_FILES}) WHERE priority <> '5-LOW' AND added_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 300 DAYS)"
PASS_THROUGHS = f"""{CODE}{_EXPORTS}{_IMPORTS}{_FAN_IN}, whole AS (
  SELECT path, language, string_agg(line, chr(10) ORDER BY n) AS x FROM code WHERE NOT {_TEST} GROUP BY path, language
), counted AS (
  SELECT path, CASE WHEN language = 'go' THEN {_count('x', symbols.GO_PASS_THROUGH)} ELSE {_count('x', symbols.PASS_THROUGH)} + {_count('x', symbols.CONCISE_ARROW)} END::BIGINT AS n_pass,
         {_count('x', symbols.ANY_FUNCTION)}::BIGINT AS n_functions FROM whole
)
SELECT path, fan_in, n_pass, n_functions FROM counted JOIN fan_in USING (path)
WHERE n_pass > 0 AND n_functions > 0 AND n_pass >= 0.5 * n_functions AND fan_in BETWEEN 1 AND 2 AND NOT {_ENTRY}"""

# a file of the corpus has one class at most, which its last line closes
_ASKED = f"""{CODE}{_EXPORTS}{_IMPORTS}{_FAN_IN}, whole AS (SELECT path, language, string_agg(line, chr(10) ORDER BY n) AS x FROM code GROUP BY path, language), few AS (
  SELECT path, language, x FROM whole JOIN fan_in USING (path) WHERE fan_in BETWEEN 1 AND 2 AND language IN ('typescript', 'java', 'csharp') AND NOT {_TEST} AND NOT {_ENTRY}
)"""
SINGLE_METHODS = f"""{_ASKED}, classes AS (
  SELECT path, regexp_extract(x, {_q(abstractions.CLASS)}, 1) AS symbol, regexp_extract_all(substr(x, strpos(x, 'class ')), {_q('(?m)' + abstractions.METHOD)}, 1) AS methods FROM few WHERE contains(x, 'class ')
)
SELECT path, symbol, methods[1] AS method FROM classes WHERE len(methods) = 1"""
SINGLE_IMPLEMENTATIONS = f"""{_ASKED}, offered AS (SELECT DISTINCT path, language, unnest(regexp_extract_all(x, {_q(abstractions.INTERFACE)}, 1)) AS symbol FROM few), listed AS (
  SELECT trim(unnest(string_split(list, ','))) AS symbol, colon FROM (
    SELECT unnest(regexp_extract_all(x, {_q(symbols.IMPLEMENTS)}, 1)) AS list, false AS colon FROM whole UNION ALL SELECT unnest(regexp_extract_all(x, {_q(symbols.COLON)}, 1)), true FROM whole)
)
SELECT o.path, o.symbol FROM offered o JOIN listed n ON n.symbol = o.symbol AND (NOT n.colon OR o.language = 'csharp') GROUP BY o.path, o.symbol HAVING count(*) = 1"""

# the last line of a file that holds a word, of all its imported names only
UNUSED_IMPORTS = f"""{CODE}{_STATES}{_IMPORTS}, mine AS (
  SELECT path, language, n, ends, local FROM imports WHERE kind IN ('named', 'class', 'package') AND NOT {_TEST}
), wanted AS (SELECT DISTINCT path, local AS word FROM mine), words AS (
  SELECT path, n, unnest(list_distinct(regexp_extract_all(line, '[A-Za-z0-9_]+'))) AS word FROM code
), last AS (SELECT path, word, max(n) AS n FROM words SEMI JOIN wanted USING (path, word) GROUP BY ALL)
SELECT i.path, i.language, i.n::INTEGER AS n, i.local AS name FROM mine i LEFT JOIN last l ON l.path = i.path AND l.word = i.local WHERE coalesce(l.n, 0) <= i.ends"""

def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


_D = code_duplicates
# tokens of the corpus do not span lines; a pair's windows are walked in order, a window inside a region found before is passed over
REGIONS = f"""{CODE.replace("WITH code", "WITH RECURSIVE code", 1)}, listed AS (
  SELECT path, n - 1 AS at_line, line, unnest(raws) AS raw, unnest(range(len(raws))) AS i FROM (
    SELECT path, n, line, list_filter(regexp_extract_all(line, {_q(_ONE_TOKEN)}), lambda t: NOT (t[1] = '#' OR starts_with(t, '//') OR starts_with(t, '/*'))) AS raws
    FROM code WHERE NOT regexp_matches(regexp_extract(path, '[^/]*$'), {_q(_D.TEST_NAMES)})) WHERE len(raws) > 0
), coded AS (
  SELECT *, CASE WHEN raw[1] IN ('"', '''', '`') THEN 'STR' WHEN regexp_matches(raw[1], '[0-9]') THEN 'NUM' WHEN raw IN ({_KEYWORD_LIST}) OR NOT regexp_matches(raw[1], '[A-Za-z_$]') THEN raw ELSE 'IDENT' END AS code FROM listed
), stepped AS (
  SELECT *, coalesce(sum(CASE WHEN code IN ('(', '[', '{{') THEN 1 WHEN code IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY at_line, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM coded
), files AS (
  SELECT path, list(code ORDER BY at_line, i) AS w, list(raw ORDER BY at_line, i) AS raws, list(at_line ORDER BY at_line, i) AS at_lines,
         list(depth ORDER BY at_line, i) || [sum(CASE WHEN code IN ('(', '[', '{{') THEN 1 WHEN code IN (')', ']', '}}') THEN -1 ELSE 0 END)] AS depths
  FROM stepped GROUP BY path HAVING count(*) >= {_D.SIZE}
), held AS (
  SELECT path, start, md5(array_to_string(list_slice(w, start + 1, start + {_D.SIZE}), ' ')) AS key FROM (SELECT path, w, unnest(range(len(w) - {_D.SIZE} + 1)) AS start FROM files)
), common AS (SELECT key FROM held GROUP BY key HAVING count(*) BETWEEN 2 AND {duplicates.MOST_IN_BUCKET}), kept AS (SELECT * FROM held SEMI JOIN common USING (key)), pairs AS (
  SELECT a.path AS path_a, b.path AS path_b, list({{'a': a.start, 'b': b.start}} ORDER BY a.start, b.start) AS starts FROM kept a JOIN kept b ON a.key = b.key
   AND (a.path < b.path OR (a.path = b.path AND b.start - a.start >= {_D.SIZE})) GROUP BY 1, 2
), sides AS MATERIALIZED (
  SELECT p.*, a.w AS wa, b.w AS wb, a.at_lines AS la FROM pairs p JOIN files a ON a.path = p.path_a JOIN files b ON b.path = p.path_b
), walk AS (
  SELECT path_a, path_b, 0 AS k, []::STRUCT(a BIGINT, b BIGINT, n BIGINT)[] AS found FROM pairs
  UNION ALL
  SELECT path_a, path_b, k + 1, CASE WHEN free AND la[s.a + n] - la[s.a + 1] + 1 >= {_D.LEAST_LINES} THEN list_append(found, {{'a': s.a, 'b': s.b, 'n': n}}) ELSE found END FROM (
    SELECT *, CASE WHEN free THEN {_D.SIZE} + coalesce(list_filter(range(0, most - {_D.SIZE}), lambda i: wa[s.a + {_D.SIZE} + 1 + i] <> wb[s.b + {_D.SIZE} + 1 + i])[1], most - {_D.SIZE}) END AS n FROM (
      SELECT w.path_a, w.path_b, w.k, w.found, p.wa, p.wb, p.la, p.starts[w.k + 1] AS s, least(len(p.wa) - p.starts[w.k + 1].a, len(p.wb) - p.starts[w.k + 1].b) AS most,
             len(list_filter(w.found, lambda r: (p.starts[w.k + 1].a >= r.a AND p.starts[w.k + 1].a < r.a + r.n) OR (p.starts[w.k + 1].b >= r.b AND p.starts[w.k + 1].b < r.b + r.n)
               )) = 0 AS free
      FROM walk w JOIN sides p ON p.path_a = w.path_a AND p.path_b = w.path_b WHERE w.k < len(p.starts)))
), ended AS (
  SELECT path_a, path_b, unnest(found) AS r FROM walk w JOIN pairs p USING (path_a, path_b) WHERE w.k = len(p.starts)
), shaped AS (
  SELECT path_a, path_b, r.a AS start_a, r.b AS start_b, r.n AS token_count, a.at_lines[r.a + 1] AS start_line_a, a.at_lines[r.a + r.n] AS end_line_a, b.at_lines[r.b + 1] AS start_line_b, b.at_lines[r.b + r.n] AS end_line_b,
         list_slice(a.w, r.a + 1, r.a + r.n) AS x, list_slice(a.raws, r.a + 1, r.a + r.n) AS ra, list_slice(b.raws, r.b + 1, r.b + r.n) AS rb,
         path_a = path_b AND a.depths[r.a + 1] >= 1 AND list_min(list_slice(a.depths, r.a + 1, r.b + r.n + 1)) >= a.depths[r.a + 1] AS in_container
  FROM ended JOIN files a ON a.path = path_a JOIN files b ON b.path = path_b
), measured AS (
  SELECT *, floor(len(list_filter(x, lambda t: list_contains({_list(_D.STRUCTURAL)}, t)))::DOUBLE / token_count * 1000 + 0.5) / 1000 AS structural_ratio,
         floor(len(list_distinct(x))::DOUBLE / token_count * 1000 + 0.5) / 1000 AS token_diversity,
         list_transform(list_filter(range(1, token_count + 1), lambda i: x[i] IN ('STR', 'NUM') AND ra[i] <> rb[i]), lambda i: ra[i] || ' vs ' || rb[i]) AS differing
  FROM shaped
), placed AS (
  SELECT path, f, l, count(*) AS k FROM (SELECT path_a AS path, start_line_a AS f, end_line_a AS l FROM measured UNION ALL SELECT path_b, start_line_b, end_line_b FROM measured) GROUP BY ALL
), sure AS (
  SELECT m.*, floor((0.6 * least(1.0::DOUBLE, structural_ratio / 0.25::DOUBLE) + 0.4::DOUBLE * least(1.0::DOUBLE, token_diversity / 0.15::DOUBLE)) * least(1.0::DOUBLE, 3.0::DOUBLE / greatest(1, a.k, b.k)::DOUBLE) * 100 + 0.5) / 100 AS plain
  FROM measured m JOIN placed a ON a.path = path_a AND a.f = start_line_a AND a.l = end_line_a JOIN placed b ON b.path = path_b AND b.f = start_line_b AND b.l = end_line_b
), texts AS (SELECT path, list(line ORDER BY n) AS lines FROM code GROUP BY path), regions AS (
  SELECT path_a, path_b, start_a::INTEGER AS start_a, start_b::INTEGER AS start_b, token_count::INTEGER AS token_count, start_line_a::INTEGER AS start_line_a, end_line_a::INTEGER AS end_line_a, start_line_b::INTEGER AS start_line_b, end_line_b::INTEGER AS end_line_b,
         1.0::DOUBLE AS similarity, structural_ratio, token_diversity, in_container,
         CASE WHEN structural_ratio < 0.15 THEN 'extract-config' WHEN list_has_any(x, {_list(_D.WRAPPERS)}) THEN 'extract-wrapper' WHEN x[1] IN ({', '.join(map(_q, _D.DECLARATIONS))}) THEN 'extract-and-share' ELSE 'extract-function' END AS category,
         len(differing)::INTEGER AS divergent_literals, array_to_string(differing[1:3], '; ') AS samples,
         CASE WHEN in_container AND structural_ratio < 0.2 AND token_diversity < 0.15 THEN least(plain, 0.45::DOUBLE) ELSE plain END AS confidence,
         array_to_string(lines[start_line_a + 1 : start_line_a + least(end_line_a - start_line_a + 1, {_D.SNIPPET_LINES})], chr(10)) || CASE WHEN end_line_a - start_line_a + 1 > {_D.SNIPPET_LINES} THEN chr(10) || '// ... ' || (end_line_a - start_line_a + 1 - {_D.SNIPPET_LINES})::VARCHAR || ' more lines' ELSE '' END AS snippet
  FROM sure JOIN texts ON texts.path = path_a
), duplicate_regions AS MATERIALIZED (SELECT * FROM regions WHERE confidence >= {_D.LEAST_CONFIDENCE})"""
REGION_CLUSTERS = f"""{REGIONS}, named AS (
  SELECT *, path_a || ':' || start_line_a || '-' || end_line_a AS ra, path_b || ':' || start_line_b || '-' || end_line_b AS rb FROM duplicate_regions
), links AS (SELECT DISTINCT ra AS u, rb AS v FROM named UNION SELECT rb, ra FROM named), reached AS (
  SELECT u AS region, u AS other FROM links UNION SELECT r.region, l.v FROM reached r JOIN links l ON r.other = l.u
), rooted AS (SELECT region, min(other) AS root FROM reached GROUP BY region), members AS (
  SELECT DISTINCT region, path, lines FROM (SELECT ra AS region, path_a AS path, end_line_a - start_line_a + 1 AS lines FROM named UNION ALL SELECT rb, path_b, end_line_b - start_line_b + 1 FROM named)
), sizes AS (
  SELECT root, count(*)::BIGINT AS member_count, count(DISTINCT path)::BIGINT AS files_affected, sum(lines)::BIGINT AS duplicated_lines FROM members JOIN rooted USING (region) GROUP BY root
), stats AS (
  SELECT root, floor(avg(similarity) * 100 + 0.5) / 100 AS similarity, floor(avg(token_count) + 0.5)::BIGINT AS token_count,
         arg_min({{'category': category, 'divergent_literals': divergent_literals, 'snippet': snippet}}, {{'a': path_a, 'b': path_b, 'c': start_a, 'd': start_b}}) AS first
  FROM named JOIN rooted ON rooted.region = ra GROUP BY root
)
SELECT root, member_count, files_affected, duplicated_lines, similarity, token_count, floor(files_affected * similarity * duplicated_lines + 0.5) / 100 AS impact, first.category, first.divergent_literals, first.snippet
FROM sizes JOIN stats USING (root)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "file_metrics": file_metrics,
    "code_metrics": code_metrics,
    "brace_nesting": brace_nesting,
    "indent_nesting": indent_nesting,
    "metric_findings": metric_findings,
    "pattern_hits": pattern_hits,
    "prose_pattern_hits": prose_pattern_hits,
    "race_findings": race_findings,
    "inconsistent_patterns": inconsistent_patterns,
    "outdated_usage": outdated_usage,
    "exported_symbols": exported_symbols,
    "imported_symbols": imported_symbols,
    "reachable_files": reachable_files,
    "recent_files": recent_files,
    "dead_exports": dead_exports,
    "dead_exports_by_words": dead_exports_by_words,
    "divergent_exports": divergent_exports,
    "fan_in": fan_in,
    "implementations": single_implementations,
    "pass_through_files": pass_throughs,
    "single_method_classes": single_method_classes,
    "single_implementation_interfaces": single_implementation_interfaces,
    "unused_imports": unused_imports,
    "classified_files": classified_files,
    "token_histogram": token_histogram,
    "window_matches": window_matches,
    "duplicate_clusters": duplicate_clusters,
    "code_window_matches": code_window_matches,
    "code_duplicate_regions": code_duplicate_regions,
    "code_duplicate_clusters": code_duplicate_clusters,
}

SQL: dict[str, str] = {
    "file_metrics": f"{PROSE}{_FACTS} SELECT * FROM file_metrics",
    "code_metrics": f"{CODE}{_FACTS} SELECT * FROM file_metrics",
    "brace_nesting": f"{CODE}{_FACTS}{_NESTING} SELECT * FROM braces",
    "indent_nesting": f"{CODE}{_FACTS}{_NESTING} SELECT * FROM indents",
    "metric_findings": METRIC_FINDINGS,
    "pattern_hits": _pattern_sql(CODE, ("typescript", "python", "go", "java", "csharp")),
    "prose_pattern_hits": _pattern_sql(PROSE, ("python",)),
    "race_findings": RACES,
    "inconsistent_patterns": INCONSISTENT,
    "outdated_usage": _outdated_sql(),
    "exported_symbols": f"{CODE}{_EXPORTS} SELECT path, language, n::INTEGER AS n, name, is_type, decorated, handed_on FROM exports",
    "imported_symbols": f"{CODE}{_STATES}{_IMPORTS} SELECT path, language, n::INTEGER AS n, name, local, kind FROM imports",
    "reachable_files": f"{CODE}{_REACHABLE} SELECT path FROM reachable",
    "recent_files": f"WITH x AS (SELECT 1){_RECENT} SELECT path FROM recent",
    "dead_exports": f"{CODE}{_EXPORTS}{_IMPORTS}{_REACHABLE}{_RECENT} SELECT path, language, n::INTEGER AS n, name, CASE WHEN language = 'python' AND decorated THEN 0.3 WHEN is_type THEN 0.5 ELSE round(CASE language WHEN 'python' THEN 0.6 ELSE 0.9 END + CASE WHEN path IN (FROM recent) THEN 0.05 ELSE 0 END, 2) END::DOUBLE AS confidence FROM exports e WHERE language IN ('typescript', 'python', 'java') AND NOT {_TEST} AND NOT {_ENTRY} AND path NOT IN (FROM reachable) AND NOT EXISTS (SELECT 1 FROM asked i WHERE i.language = e.language AND i.name = e.name)",
    "dead_exports_by_words": f"{CODE}{_EXPORTS}, words AS (SELECT language, path, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS word FROM code WHERE language IN ('go', 'csharp')), totals AS (SELECT language, word, count(DISTINCT path) AS k FROM words GROUP BY 1, 2) SELECT path, language, n::INTEGER AS n, name, {_CONFIDENCE} AS confidence FROM exports e JOIN totals t USING (language) WHERE t.word = e.name AND t.k = 1 AND NOT {_TEST} AND NOT {_ENTRY}",
    "divergent_exports": f"{CODE}{_EXPORTS} SELECT name, count(DISTINCT path)::BIGINT AS n_files, min(path) AS first_path FROM exports WHERE NOT {_TEST} AND NOT handed_on AND CASE WHEN regexp_matches(name, '[a-z][A-Z]') OR (contains(name, '_') AND len(list_filter(string_split(name, '_'), lambda p: p <> '')) >= 2) THEN length(name) >= 6 ELSE length(name) >= 12 END GROUP BY name HAVING count(DISTINCT path) >= 2",
    "fan_in": f"{CODE}{_EXPORTS}{_IMPORTS}{_FAN_IN} SELECT * FROM fan_in",
    "pass_through_files": PASS_THROUGHS,
    "single_method_classes": SINGLE_METHODS,
    "single_implementation_interfaces": SINGLE_IMPLEMENTATIONS,
    "implementations": f"{CODE}, each AS (SELECT trim(unnest(string_split(nullif(regexp_extract(line, 'implements\\s+([A-Za-z_$][\\w$]*(?:\\s*,\\s*[A-Za-z_$][\\w$]*)*)', 1), ''), ','))) AS interface FROM code) SELECT interface, count(*)::BIGINT AS n_implementations FROM each GROUP BY 1",
    "unused_imports": UNUSED_IMPORTS,
    "classified_files": CLASSIFIED,
    "token_histogram": TOKENS,
    "window_matches": f"{_WINDOWS} SELECT * FROM pairs",
    "duplicate_clusters": CLUSTERS,
    "code_window_matches": CODE_WINDOWS,
    "code_duplicate_regions": f"{REGIONS} SELECT * FROM duplicate_regions",
    "code_duplicate_clusters": REGION_CLUSTERS,
}
