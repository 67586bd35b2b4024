"""Queries over projects: their languages, manifests, dependencies and ignore rules, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcloom.functions.rule_catalog import MIGRATIONS
from srcloom.functions.shared import written
from srcloom.jobs.code_queries import CODE, project_roots
from srcloom.operators import dependencies, patterns
from srcloom.sources import collect, rendered
from srcloom.sources.corpora import code_files, project_files


def _all_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and all other files of the code corpus, rendered once."""
    return written(code_files(spark, folder).select("path", "content").union(project_files(spark, folder)), "project-files")


def manifest_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.manifest_dependencies(project_files(spark, folder))


def unused_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.unused_dependencies(_all_files(spark, folder))


def project_languages(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.project_languages(_all_files(spark, folder), project_roots(spark, folder))


def outdated_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.outdated_dependencies(_all_files(spark, folder), project_roots(spark, folder))


def ignored_files(spark: SparkSession, folder: str) -> DataFrame:
    return collect.ignored_files(code_files(spark, folder), project_files(spark, folder))


#: What a user of the corpus wants left out.
IGNORED = ["# mine", "./projects/app1/svc/", "parts", "**/*7.go", " ", "."]


def ignore_list_matches(spark: SparkSession, folder: str) -> DataFrame:
    return collect.matching_files(code_files(spark, folder), collect.ignore_patterns(IGNORED))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_META = f"meta AS ({rendered.duckdb_lines(rendered.PROJECT_FILES)})"
_WITH = f"{CODE}, {_META}"
_DEPENDENCIES = r""", found AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS project, regexp_extract(path, '[^/]*$') AS file, n, line,
         last_value(CASE WHEN regexp_matches(line, '^  "\w*ependencies": \{$') THEN regexp_extract(line, '"(\w+)"', 1) WHEN regexp_matches(line, '^  \}') THEN 'none' END IGNORE NULLS) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS field
  FROM meta WHERE NOT contains(path, 'node_modules/')
), deps AS (
  SELECT project, 'npm' AS kind, field, regexp_extract(line, '^    "([^"]+)": "', 1) AS name, regexp_extract(line, ': "([^"]*)"', 1) AS version FROM found WHERE file = 'package.json' AND field LIKE '%ependencies' AND regexp_matches(line, '^    "')
  UNION ALL SELECT project, 'go', '', regexp_extract(line, '([^/\s]+)\s+v', 1), regexp_extract(line, '\s(v[0-9.]+)', 1) FROM found WHERE file = 'go.mod' AND regexp_matches(line, '\sv[0-9]')
  UNION ALL SELECT project, 'python', '', regexp_extract(line, '^[^>=<!]+'), nullif(regexp_extract(line, '[>=]+(.*)$', 1), '') FROM found WHERE file = 'requirements.txt'
  UNION ALL SELECT project, 'csharp', '', regexp_extract(line, 'Include="([^"]+)"', 1), regexp_extract(line, 'Version="([^"]+)"', 1) FROM found WHERE file LIKE '%.csproj'
  UNION ALL SELECT project, 'java', '', regexp_extract(line, '<artifactId>([^<]+)<', 1), NULL FROM found WHERE file = 'pom.xml'
), manifests AS (SELECT project, arg_min(kind, list_position(['npm', 'go', 'python', 'csharp', 'java'], kind)) AS manifest FROM deps GROUP BY project)"""
_UNUSED = r""", tokens AS (
  SELECT project, name, name AS token FROM deps
  UNION ALL SELECT project, name, CASE WHEN contains(name, '__') THEN '@' || replace(substr(name, 8), '__', '/') ELSE substr(name, 8) END FROM deps WHERE starts_with(name, '@types/')
  UNION ALL SELECT project, 'typescript', unnest(['tsc', 'tsserver']) FROM (SELECT DISTINCT project FROM deps WHERE name = 'typescript') WHERE project IN (SELECT regexp_replace(path, '/node_modules/.*$', '') FROM meta WHERE contains(path, '/node_modules/typescript/'))
), texts AS (
  SELECT regexp_extract(path, '^projects/[^/]*') AS project, line FROM code
  UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), CASE WHEN path LIKE '%package.json' THEN CASE WHEN contains(line, '"scripts"') THEN regexp_replace(line, '^[^:]*:', '') ELSE '' END ELSE line END
  FROM meta WHERE NOT contains(path, 'node_modules/') AND regexp_matches(path, '/(?:package\.json|tsconfig[^/]*\.json|biome\.json)$')
), used AS (
  SELECT DISTINCT t.project, t.name FROM tokens t JOIN texts x ON x.project = t.project
  WHERE contains(x.line, t.token) AND regexp_matches(x.line, (CASE WHEN regexp_matches(t.token, '^\w') THEN '\b' ELSE '' END) || regexp_replace(t.token, '([^\w])', '\\\1', 'g') || (CASE WHEN regexp_matches(t.token, '\w$') THEN '\b' ELSE '' END))
)"""
_LANGUAGES = r""", roots AS (
  SELECT DISTINCT regexp_extract(path, '^projects/[^/]*') AS project FROM code WHERE starts_with(path, 'projects/') UNION ALL SELECT unnest(['orders', 'parts', 'projects'])
), named AS (
  SELECT r.project, regexp_extract(path, '[^/]*$') AS name, len(string_split(substr(path, length(r.project) + 2), '/')) - 1 AS depth, path FROM (SELECT DISTINCT path FROM code UNION ALL SELECT DISTINCT path FROM meta) f
  JOIN roots r ON r.project = regexp_extract(path, '^[^/]*') OR r.project = regexp_extract(path, '^projects/[^/]*')
), markers AS (
  SELECT DISTINCT project, CASE WHEN name = 'package.json' OR (name = 'tsconfig.json' AND depth = 0) THEN 'typescript' WHEN name = 'go.mod' THEN 'go' WHEN name = 'requirements.txt' THEN 'python' WHEN name IN ('pom.xml', 'build.gradle') THEN 'java' WHEN name LIKE '%.csproj' THEN 'csharp' END AS language
  FROM named WHERE depth <= 1 AND NOT contains(path, '/node_modules/')
), sampled AS (
  SELECT project, path FROM named WHERE project NOT IN (SELECT project FROM markers WHERE language IS NOT NULL) AND depth <= 5 QUALIFY row_number() OVER (PARTITION BY project ORDER BY path) <= 2000
), languages AS (
  SELECT project, language, 'marker' AS told_by FROM markers WHERE language IS NOT NULL
  UNION ALL SELECT DISTINCT project, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.java' THEN 'java' ELSE 'csharp' END, 'extension' FROM sampled
)"""


def _outdated() -> str:
    each = []
    for m in MIGRATIONS:
        language = patterns.ECOSYSTEMS[m.ecosystem]
        first, artifact = m.old.split(" ")[0], m.old.split(".")[-1].split(" ")[0]
        manifest = {
            "javascript": f"kind = 'npm' AND name = {_q(first)}",
            "python": f"kind = 'python' AND lower(name) = {_q(first.lower())}",
            "csharp": f"kind = 'csharp' AND lower(name) = {_q(first.lower())}",
            "java": f"kind = 'java' AND lower(name) = {_q(artifact.lower())}",
        }.get(m.ecosystem)
        gradle = f" UNION ALL SELECT regexp_replace(path, '/[^/]*$', '') FROM meta WHERE path LIKE '%build.gradle' AND regexp_matches(line, {_q('(?i)implementation .[^:]*:' + artifact)})" if m.ecosystem == "java" else ""
        in_manifest = f"SELECT project FROM deps WHERE {manifest}{gradle}" if manifest else "SELECT NULL WHERE false"
        # sources below every root, the folder of all projects among them
        in_source = f"SELECT DISTINCT unnest([regexp_extract(path, '^[^/]*'), regexp_extract(path, '^projects/[^/]*')]) FROM code WHERE language = '{language}' AND regexp_matches(line, {_q(m.pattern)})"
        each.append(f"SELECT r.project, '{m.ecosystem}' AS ecosystem, {_q(m.old)} AS old, {_q(m.new)} AS new, '{m.severity}' AS severity, r.project IN ({in_manifest}) AS manifest FROM roots r JOIN languages l ON l.project = r.project AND l.language = '{language}' WHERE r.project IN ({in_manifest}) OR r.project IN ({in_source})")
    return f""", seen AS ({' UNION ALL '.join(each)})
SELECT project, ecosystem, old, new, severity, CASE WHEN ecosystem = 'go' THEN 'go.mod' WHEN ecosystem IN ('csharp', 'java') THEN 'project' WHEN NOT manifest THEN 'source' WHEN ecosystem = 'javascript' THEN 'package.json' ELSE 'requirements.txt' END AS location,
       CASE ecosystem WHEN 'go' THEN 0.7 WHEN 'csharp' THEN 0.8 WHEN 'java' THEN 0.75 ELSE CASE WHEN manifest THEN 0.9 ELSE 0.7 END END::DOUBLE AS confidence
FROM seen WHERE ecosystem <> 'go' OR project IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM meta WHERE path LIKE '%go.mod')"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manifest_dependencies": manifest_dependencies,
    "unused_dependencies": unused_dependencies,
    "project_languages": project_languages,
    "outdated_dependencies": outdated_dependencies,
    "ignored_files": ignored_files,
    "ignore_list_matches": ignore_list_matches,
}

SQL: dict[str, str] = {
    "manifest_dependencies": f"WITH {_META}{_DEPENDENCIES} SELECT project, kind, field, name, version, manifest FROM deps JOIN manifests USING (project)",
    "unused_dependencies": f"{_WITH}{_DEPENDENCIES}{_UNUSED} SELECT DISTINCT project, name, manifest FROM deps JOIN manifests USING (project) ANTI JOIN used USING (project, name)",
    "project_languages": f"{_WITH}{_LANGUAGES} SELECT * FROM languages",
    "outdated_dependencies": f"{_WITH}{_DEPENDENCIES}{_LANGUAGES}{_outdated()}",
    "ignored_files": rf"""{CODE}, f AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS name, nullif(regexp_extract(path, 'app([0-9]+)/', 1), '')::BIGINT % 2 = 0 AS own FROM code WHERE starts_with(path, 'projects/'))
SELECT path FROM f WHERE (name LIKE '%.java' AND name <> 'Use.java') OR regexp_matches(path, '^projects/[^/]*/go/') OR regexp_matches(path, '/lazy/') OR (regexp_matches(path, '^projects/[^/]*/src/.*\.ts$') AND starts_with(name, 'o') AND NOT (own AND regexp_matches(path, '/src/old/o[^/]*3\.ts$')))""",
    "ignore_list_matches": f"{CODE} SELECT count(DISTINCT path)::BIGINT AS n FROM code WHERE starts_with(path, 'projects/app1/svc/') OR starts_with(path, 'parts/') OR path LIKE '%7.go'",
}
