"""Queries over findings, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.rule_catalog import MIGRATIONS, RULES
from srcloom.functions.shared import written
from srcloom.jobs import code_queries, project_queries
from srcloom.operators import findings as f
from srcloom.operators import scan
from srcloom.sources.corpora import FINDINGS, code_files, findings, project_files
from srcloom.sources.tables import table

_F = f"WITH f AS ({FINDINGS.format(lineitem='lineitem')})"
_SCORE = "CASE severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 ELSE 1.0 END::DOUBLE * coalesce(confidence, 1.0)"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_STAMPED = f""", s AS (
  SELECT *, {_SCORE} AS score, concat_ws(':', coalesce(check_name, ''), coalesce(file, ''), coalesce(description, ''), coalesce(symbol, '')) AS signature FROM f
), stamped AS (
  SELECT *, 'f-' || substr(sha256(signature || ':' || (row_number() OVER (PARTITION BY run_id, signature ORDER BY score DESC, ord) - 1)::VARCHAR), 1, 16) AS id FROM s
)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return f.scored(findings(spark, folder)).select("ord", "severity", "confidence", "score")


def stamped(spark: SparkSession, folder: str) -> DataFrame:
    return f.stamped(findings(spark, folder)).select("run_id", "ord", "id")


def _state(rows: DataFrame, *others: str) -> DataFrame:
    """A run's findings as stored: some severities overridden, some with notes."""
    return rows.select(*others, "id", "severity", "status", F.when(F.col("ord") % 5 == 0, F.concat(F.lit("note "), F.col("ord").cast("string"))).alias("notes"), (F.col("ord") % 6 == 0).alias("severity_overridden"))


_KEY = ("run_id", "id")


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """Every run merged into the run before it; run_id is that of the incoming one."""
    all_runs = f.stamped(findings(spark, folder))
    scans = all_runs.join(f.before(all_runs).select("run_id"), "run_id")
    return f.merged(f.as_prior(_state(all_runs, "run_id")), scans.select("run_id", "id", "severity", F.when(F.col("status") == "fixed", "fixed").alias("status")), _KEY)


def carried(spark: SparkSession, folder: str) -> DataFrame:
    """Dismissals carried from every run to the run after it."""
    all_runs = f.stamped(findings(spark, folder))
    return f.carried(all_runs, f.as_prior(all_runs), _KEY)


def patched(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of all runs after patches to each of them."""
    rows = f.stamped(findings(spark, folder))
    patches = rows.filter("ord % 3 = 0").select(*_KEY, F.lit("ignored").alias("status"), F.lit(None).cast("string").alias("notes"), F.when(F.col("ord") % 2 == 0, "high").alias("severity"), F.lit(1).alias("seq"))
    later = rows.filter("ord % 9 = 0").select(*_KEY, F.lit("in-progress").alias("status"), F.lit("later").alias("notes"), F.lit(None).cast("string").alias("severity"), F.lit(2).alias("seq"))
    return f.patched(_state(rows, "run_id"), patches.union(later), _KEY)


def page(spark: SparkSession, folder: str) -> DataFrame:
    some = f.filtered(findings(spark, folder), severity=["critical", "high"], fixable=True, min_confidence=0.5)
    return f.page(some, "severity", 100, 50).select("ord", "severity", "confidence", "status", "file")


def by_file(spark: SparkSession, folder: str) -> DataFrame:
    return f.grouped_by_file(findings(spark, folder))


def by_category(spark: SparkSession, folder: str) -> DataFrame:
    return f.grouped_by(findings(spark, folder), "category")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    return f.summaries(findings(spark, folder))


def bulk_fix(spark: SparkSession, folder: str) -> DataFrame:
    return f.to_fix(findings(spark, folder)).select("ord", "severity", "confidence")


def _scans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored findings of all runs, and those of new scans of every run but the first, as open ones."""
    all_runs = f.stamped(findings(spark, folder))
    again = all_runs.join(f.before(all_runs).select("run_id"), "run_id")
    columns = ("run_id", "id", "severity")
    return all_runs.select(*columns, "status"), again.select(*columns, F.lit("open").alias("status"))


def replaced(spark: SparkSession, folder: str) -> DataFrame:
    return f.replaced(*_scans(spark, folder))


def cleared(spark: SparkSession, folder: str) -> DataFrame:
    return f.cleared(*_scans(spark, folder))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return _state(f.stamped(findings(spark, folder)), "run_id", "ord", "check_name")


def _some_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of critical findings, and as many that no run has."""
    ids = f.stamped(findings(spark, folder)).filter("severity = 'critical'").select("run_id", "id", "ord")
    return ids.unionByName(ids.withColumn("id", F.concat(F.lit("no-"), F.col("ord").cast("string"))))


def patched_where(spark: SparkSession, folder: str) -> DataFrame:
    return f.patched_where(_stored(spark, folder), F.col("check_name") == "metrics", status="ignored", severity="low").drop("check_name")


def patched_ids(spark: SparkSession, folder: str) -> DataFrame:
    return f.patched_ids(_stored(spark, folder), _some_ids(spark, folder), _KEY, status="in-progress", notes="seen").drop("check_name")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return f.outcomes(_stored(spark, folder), _some_ids(spark, folder), _KEY)


def existing_ids(spark: SparkSession, folder: str) -> DataFrame:
    return f.existing_ids(_stored(spark, folder), _some_ids(spark, folder), _KEY)


def of_ids(spark: SparkSession, folder: str) -> DataFrame:
    return f.of_ids(_stored(spark, folder), _some_ids(spark, folder), _KEY).select("run_id", "id", "severity", "status")


def pruned(spark: SparkSession, folder: str) -> DataFrame:
    return f.pruned(_stored(spark, folder), ("stale", "fixed")).select("run_id", "id", "status")


def relative_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = findings(spark, folder).withColumn("file", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("/work\\shop/"), F.col("file"))).otherwise(F.col("file")))
    return f.relative_paths(rows, "/work/shop").select("ord", "file")


def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    return f.page_facts(f.filtered(findings(spark, folder), severity=["critical", "high"], fixable=True, min_confidence=0.5), 100, 50)


def compact(spark: SparkSession, folder: str) -> DataFrame:
    return f.compact(f.stamped(findings(spark, folder)).withColumn("start_line", F.col("line_number")))


def members(spark: SparkSession, folder: str) -> DataFrame:
    return f.members_of_groups(f.stamped(findings(spark, folder)), "check_name")


def file_groups(spark: SparkSession, folder: str) -> DataFrame:
    return f.file_groups(f.stamped(findings(spark, folder)), 5, 20).withColumn("ids", F.array_join("ids", ","))


def counted(spark: SparkSession, folder: str) -> DataFrame:
    return f.counted(f.filtered(findings(spark, folder), status=["open", "in-progress"], category=["security"]))


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """A run for each customer, touched by each of its orders."""
    orders = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active")
    return f.run_registry(orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), status.alias("status"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("touch_seq")))


def run_registry(spark: SparkSession, folder: str) -> DataFrame:
    return _registry(spark, folder)


def listed_runs(spark: SparkSession, folder: str) -> DataFrame:
    return f.listed_runs(_registry(spark, folder)).select("id", "label", "active")


def without_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = _registry(spark, folder)
    return f.without_run(runs, runs.filter("active OR label = '1-URGENT'")).select("id", "touch_seq", "active")


def _inputs(spark: SparkSession, folder: str) -> scan.Inputs:
    return scan.Inputs(written(code_files(spark, folder), "code"), written(project_files(spark, folder), "projects"), code_queries.project_roots(spark, folder), code_queries.recent_files(spark, folder), code_queries.LOW, 2)


#: Kernels whose results SQL gives; duplicate regions are compared on their own.
_WITH_SQL = {name: kernel for name, kernel in scan.KERNELS.items() if not name.startswith("duplicate")}


def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All scans of the code corpus but duplicates, as one findings table."""
    return scan.scan(_inputs(spark, folder), kernels=_WITH_SQL)[0].select("id", *scan.COLUMNS, "score")


def scan_everything(spark: SparkSession, folder: str) -> DataFrame:
    """All scans of the code corpus, duplicates and their clusters among them."""
    return scan.scan(_inputs(spark, folder))[0].select("id", *scan.COLUMNS, "score")


def scan_without_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of some checks switched off are left out; ids are those of the findings that stay."""
    some = {name: scan.KERNELS[name] for name in ("patterns", "unused-dependencies", "outdated")}
    return scan.scan(_inputs(spark, folder), ["magic-number", "outdated-pattern"], some)[0].select("id", "check_name", "file", "start_line")


def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = scan.scan(_inputs(spark, folder), kernels=_WITH_SQL)[0]
    return f.summaries(rows.withColumn("status", F.lit("open"))).drop("run_id")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all runs with their places; duplicates stand in a second file, too, some by a path from the root of all."""
    rows = f.stamped(findings(spark, folder))
    place = lambda file, line: F.struct(file.alias("file"), line.alias("start_line"), (line + 2).alias("end_line"))
    n = F.regexp_extract("file", r"(\d+)", 1).cast("int")
    second = place(F.concat(F.when(F.col("ord") % 2 == 0, "/work/shop/").otherwise(""), F.lit("src/file"), (n + 1).cast("string"), F.lit(".ts")), F.col("line_number") + 10)
    first = F.array(place(F.col("file"), F.col("line_number")))
    return f.relative_locations(rows.withColumn("locations", F.when(F.col("check_name") == "duplicate", F.concat(first, F.array(second))).otherwise(first)), "/work/shop")


def findings_in_files(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with a place in one of the files of the first suppliers, whichever of their places that is."""
    rows = _located(spark, folder)
    files = table(spark, folder, "supplier").filter("s_suppkey <= 5").select(F.concat(F.lit("src/file"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("file"))
    return f.in_files(rows, files, f.file_index(rows, _KEY), _KEY).select("run_id", "id", "check_name", F.size("locations").alias("n_places"))


_CRITICAL = "SELECT run_id, id FROM stamped WHERE severity = 'critical' UNION ALL SELECT run_id, 'no-' || ord::VARCHAR FROM stamped WHERE severity = 'critical'"
_REGISTRY = """WITH runs AS (
  SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS label, CASE WHEN arg_max(o_orderstatus, o_orderkey) = 'F' THEN 'archived' ELSE 'active' END AS status,
         min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at, max(o_orderkey) AS touch_seq
  FROM orders GROUP BY o_custkey
), registry AS (SELECT *, touch_seq = (SELECT max(touch_seq) FROM runs) AS active FROM runs)"""
def _inner(sql: str) -> str:
    """SQL over the code corpus without the corpus itself, for use below a query that holds it."""
    rest = sql.removeprefix(code_queries.CODE).lstrip()
    return "WITH " + rest[1:] if rest.startswith(",") else rest


_SUGGESTED = "CASE check_name " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in scan.SUGGESTIONS.items()) + " WHEN 'outdated-pattern' THEN (SELECT 'Migrate from ' || chr(39) || m.old || chr(39) || ' to ' || chr(39) || m.new || chr(39) || '.' FROM (VALUES " + ", ".join(f"('{m.old}', '{m.new}')" for m in MIGRATIONS) + ") m(old, new) WHERE contains(description, chr(39) || m.old || chr(39))) END"
_SCANNED = f"""{code_queries.CODE.replace("WITH code AS (", "WITH code AS MATERIALIZED (", 1)}, scanned AS MATERIALIZED (
  SELECT rule AS check_name, severity, category, 'common' AS language, path AS file, 1 AS start_line, rule || ' ' || value::VARCHAR AS description, NULL::VARCHAR AS symbol, 0.95::DOUBLE AS confidence FROM ({_inner(code_queries.SQL['metric_findings'])})
  UNION ALL SELECT rule, severity, category, 'common', path, n::INTEGER, rule, NULL, 0.9 FROM ({_inner(code_queries.SQL['pattern_hits'])})
  UNION ALL SELECT 'toctou', 'high', 'security', 'common', path, n::INTEGER, 'check and act ' || (act_n - n)::VARCHAR || ' lines apart', NULL, 0.85 FROM ({_inner(code_queries.SQL['race_findings'])})
  UNION ALL SELECT 'dead-export', 'low', 'dead-code', language, path, n::INTEGER, 'Exported symbol ' || chr(39) || name || chr(39) || ' appears unused', name, confidence FROM (({_inner(code_queries.SQL['dead_exports'])}) UNION ALL BY NAME ({_inner(code_queries.SQL['dead_exports_by_words'])}))
  UNION ALL SELECT 'unused-import', 'low', 'dead-code', language, path, n::INTEGER, 'Import ' || chr(39) || name || chr(39) || ' is never used', name, 0.85 FROM ({_inner(code_queries.SQL['unused_imports'])})
  UNION ALL SELECT 'unused-dep', 'low', 'dead-code', 'common', NULL, NULL, 'Dependency ' || chr(39) || name || chr(39) || ' declared in ' || manifest || ' manifest but not referenced in source', project || ':' || name, 0.7 FROM ({_inner(project_queries.SQL['unused_dependencies'])})
  UNION ALL SELECT 'outdated-pattern', severity, 'outdated', 'common', project || '/' || location, 1, 'Outdated ' || CASE WHEN location = 'source' THEN 'usage' ELSE 'dependency' END || ' ' || chr(39) || old || chr(39), NULL, confidence FROM ({_inner(project_queries.SQL['outdated_dependencies'])})
  UNION ALL SELECT 'inconsistent-patterns', 'low', 'consistency', 'common', NULL, NULL, 'Inconsistent ' || concern || ' patterns: ' || n_approaches::VARCHAR || ' different approaches found', NULL, 0.75 FROM ({_inner(code_queries.SQL['inconsistent_patterns'])})
  UNION ALL SELECT 'over-engineering', 'low', 'complexity', 'common', path, 1, 'Single-method class (only method: ' || method || ') — a plain function may suffice', symbol, 0.7 FROM ({_inner(code_queries.SQL['single_method_classes'])})
  UNION ALL SELECT 'over-engineering', 'low', 'complexity', 'common', path, 1, 'Interface ' || symbol || ' has only one implementation — may be unnecessary abstraction', symbol, 0.7 FROM ({_inner(code_queries.SQL['single_implementation_interfaces'])})
  UNION ALL SELECT 'over-engineering', 'low', 'complexity', 'common', path, 1, CASE WHEN n_pass >= n_functions THEN 'All ' || n_functions::VARCHAR || ' exported functions are pass-throughs (fan-in: ' || fan_in::VARCHAR || ') — file may be unnecessary indirection' ELSE 'Low fan-in (' || fan_in::VARCHAR || ' importers) with ' || n_pass::VARCHAR || '/' || n_functions::VARCHAR || ' pass-through functions — may be unnecessary abstraction layer' END, regexp_extract(path, '[^/]*$'), 0.7 FROM ({_inner(code_queries.SQL['pass_through_files'])})
  UNION ALL SELECT 'divergent-export', 'medium', 'duplication', 'common', first_path, 1, chr(39) || name || chr(39) || ' is exported by ' || n_files::VARCHAR || ' files', name, 0.8 FROM ({_inner(code_queries.SQL['divergent_exports'])})
), f AS (SELECT *, 0 AS run_id, coalesce(start_line, 0) AS ord, true AS fixable, {_SUGGESTED} AS suggestion FROM scanned)"""

_PATTERN_CHECKS = ", ".join(f"'{r.id}'" for r in RULES) + ", 'unused-dep'"
_STATE = "SELECT id, severity, status, CASE WHEN ord % 5 = 0 THEN 'note ' || ord::VARCHAR END AS notes, ord % 6 = 0 AS severity_overridden FROM stamped"
_STATE_OF_RUNS = _STATE.replace("SELECT id", "SELECT run_id, id", 1)
_STEPS = "steps AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS prior FROM (SELECT DISTINCT run_id FROM f))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "score_findings": scored,
    "stamp_findings": stamped,
    "merge_findings": merged,
    "carry_forward": carried,
    "patch_findings": patched,
    "page_findings": page,
    "findings_by_file": by_file,
    "findings_by_category": by_category,
    "summarise_runs": summaries,
    "bulk_fix_selection": bulk_fix,
    "replace_runs": replaced,
    "clear_runs": cleared,
    "patch_by_filter": patched_where,
    "patch_by_ids": patched_ids,
    "update_outcomes": outcomes,
    "existing_ids": existing_ids,
    "findings_of_ids": of_ids,
    "prune_findings": pruned,
    "relative_paths": relative_paths,
    "page_facts": page_facts,
    "compact_findings": compact,
    "findings_of_groups": members,
    "file_groups_page": file_groups,
    "count_findings": counted,
    "run_registry": run_registry,
    "list_runs": listed_runs,
    "delete_runs": without_runs,
    "scan_findings": scan_findings,
    "scan_everything": scan_everything,
    "scan_without_checks": scan_without_checks,
    "scan_summary": scan_summary,
    "findings_in_files": findings_in_files,
}

SQL: dict[str, str] = {
    "score_findings": f"{_F} SELECT ord, severity, confidence, {_SCORE} AS score FROM f",
    "stamp_findings": f"{_F}{_STAMPED} SELECT run_id, ord, id FROM stamped",
    "merge_findings": f"""{_F}{_STAMPED}, {_STEPS}, o AS ({_STATE_OF_RUNS}), n AS (
  SELECT run_id, id, severity, CASE WHEN status = 'fixed' THEN 'fixed' END AS status FROM stamped WHERE run_id IN (SELECT run_id FROM steps WHERE prior IS NOT NULL)
), old AS (SELECT steps.run_id AS next, o.* FROM o JOIN steps ON steps.prior = o.run_id)
SELECT coalesce(old.next, n.run_id) AS run_id, coalesce(old.id, n.id) AS id,
       CASE WHEN old.id IS NOT NULL AND (old.severity_overridden OR n.id IS NULL) THEN old.severity ELSE n.severity END AS severity,
       CASE WHEN old.id IS NULL THEN coalesce(n.status, 'open') WHEN n.id IS NULL THEN CASE WHEN old.status = 'open' THEN 'stale' ELSE old.status END
            WHEN old.status IN ('open', 'stale') THEN coalesce(n.status, 'open') ELSE old.status END AS status,
       old.notes, coalesce(old.severity_overridden, false) AS severity_overridden
FROM old FULL JOIN n ON old.id = n.id AND old.next = n.run_id""",
    "carry_forward": f"{_F}{_STAMPED}, {_STEPS} SELECT c.run_id, c.id, p.status FROM stamped c JOIN steps ON steps.run_id = c.run_id JOIN stamped p ON p.id = c.id AND p.run_id = steps.prior WHERE p.status IN ('false-positive', 'ignored')",
    "patch_findings": f"""{_F}{_STAMPED}, r AS ({_STATE_OF_RUNS.replace("SELECT run_id", "SELECT ord, run_id")})
SELECT run_id, id, CASE WHEN ord % 9 = 0 THEN severity WHEN ord % 6 = 0 THEN 'high' ELSE severity END AS severity,
       CASE WHEN ord % 9 = 0 THEN 'in-progress' WHEN ord % 3 = 0 THEN 'ignored' ELSE status END AS status,
       CASE WHEN ord % 9 = 0 THEN 'later' ELSE notes END AS notes, severity_overridden OR (ord % 6 = 0 AND ord % 9 <> 0) AS severity_overridden FROM r""",
    "page_findings": f"{_F} SELECT ord, severity, confidence, status, file FROM f WHERE status <> 'stale' AND severity IN ('critical', 'high') AND coalesce(fixable, true) AND coalesce(confidence, 1.0) >= 0.5 ORDER BY {_RANK}, ord LIMIT 50 OFFSET 100",
    "findings_by_file": f"{_F} SELECT file, count(*)::BIGINT AS n, min({_RANK})::INTEGER AS worst_rank FROM f WHERE status <> 'stale' GROUP BY file",
    "findings_by_category": f"{_F} SELECT category AS value, count(*)::BIGINT AS n FROM f WHERE status <> 'stale' GROUP BY category",
    "summarise_runs": f"{_F} " + " UNION ALL ".join(f"SELECT run_id, '{d}' AS dimension, {d} AS value, count(*)::BIGINT AS n FROM f WHERE {d} IS NOT NULL" + ("" if d == "status" else " AND status <> 'stale'") + f" GROUP BY run_id, {d}" for d in ("severity", "category", "status", "check_name", "language")),
    "bulk_fix_selection": f"{_F} SELECT ord, severity, confidence FROM f WHERE status = 'open' AND coalesce(fixable, true) AND (coalesce(confidence, 1.0) >= 0.8 OR severity IN ('critical', 'high'))",
    "replace_runs": f"{_F}{_STAMPED}, {_STEPS} SELECT run_id, id, severity, CASE WHEN run_id = (SELECT min(run_id) FROM f) THEN status ELSE 'open' END AS status FROM stamped",
    "clear_runs": f"{_F}{_STAMPED} SELECT run_id, id, severity, status FROM stamped WHERE run_id = (SELECT min(run_id) FROM f)",
    "patch_by_filter": f"""{_F}{_STAMPED} SELECT run_id, ord, id, CASE WHEN check_name = 'metrics' THEN 'low' ELSE severity END AS severity, CASE WHEN check_name = 'metrics' THEN 'ignored' ELSE status END AS status,
       CASE WHEN ord % 5 = 0 THEN 'note ' || ord::VARCHAR END AS notes, (ord % 6 = 0 OR check_name = 'metrics') AS severity_overridden FROM stamped""",
    "patch_by_ids": f"""{_F}{_STAMPED} SELECT run_id, ord, id, severity, CASE WHEN severity = 'critical' THEN 'in-progress' ELSE status END AS status,
       CASE WHEN severity = 'critical' THEN 'seen' WHEN ord % 5 = 0 THEN 'note ' || ord::VARCHAR END AS notes, ord % 6 = 0 AS severity_overridden FROM stamped""",
    "update_outcomes": f"{_F}{_STAMPED} SELECT run_id, id, count(*)::BIGINT AS n_patches, CASE WHEN id LIKE 'no-%' THEN 'not found' ELSE 'updated' END AS outcome FROM ({_CRITICAL}) GROUP BY run_id, id",
    "existing_ids": f"{_F}{_STAMPED} SELECT DISTINCT run_id, id FROM stamped WHERE severity = 'critical'",
    "findings_of_ids": f"{_F}{_STAMPED} SELECT run_id, id, severity, status FROM stamped WHERE severity = 'critical'",
    "prune_findings": f"{_F}{_STAMPED} SELECT run_id, id, status FROM stamped WHERE status NOT IN ('stale', 'fixed')",
    "relative_paths": f"{_F} SELECT ord, file FROM f",
    "page_facts": f"{_F}, g AS (SELECT count(*)::BIGINT AS total FROM f WHERE status <> 'stale' AND severity IN ('critical', 'high') AND coalesce(fixable, true) AND coalesce(confidence, 1.0) >= 0.5) SELECT total, 100::BIGINT AS \"offset\", 50::BIGINT AS \"limit\", greatest(least(total - 100, 50), 0)::BIGINT AS n, total > 100 + greatest(least(total - 100, 50), 0) AS truncated FROM g",
    "compact_findings": f'{_F}{_STAMPED} SELECT id, check_name AS "check", severity, category, status, description, file, line_number AS start_line, fixable, confidence FROM stamped',
    "findings_of_groups": f"{_F}{_STAMPED} SELECT check_name AS value, id, count(*) OVER (PARTITION BY check_name)::BIGINT AS n FROM stamped WHERE status <> 'stale'",
    "file_groups_page": f"{_F}{_STAMPED}, g AS (SELECT file, count(*)::BIGINT AS n, min({_RANK})::INTEGER AS worst_rank, list_sort(list_distinct(list(id))) AS ids FROM stamped WHERE status <> 'stale' GROUP BY file), t AS (SELECT count(*)::BIGINT AS total_groups, sum(n)::BIGINT AS total_findings FROM g) SELECT file, n, worst_rank, array_to_string(ids, ',') AS ids, total_groups, total_findings FROM g, t ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5",
    "count_findings": f"{_F} SELECT count(*)::BIGINT AS total FROM f WHERE status IN ('open', 'in-progress') AND category = 'security'",
    "run_registry": f"{_REGISTRY} SELECT * FROM registry",
    "list_runs": f"{_REGISTRY} SELECT id, label, active FROM registry WHERE status <> 'archived' OR active",
    "delete_runs": f"{_REGISTRY}, l AS (SELECT * FROM registry WHERE NOT active AND label <> '1-URGENT') SELECT id, touch_seq, touch_seq = (SELECT max(touch_seq) FROM l) AS active FROM l",
    "scan_findings": f"{_SCANNED}{_STAMPED} SELECT id, check_name, severity, category, language, file, start_line, description, symbol, confidence, fixable, suggestion, score FROM stamped",
    "scan_without_checks": f"{_SCANNED.replace('FROM scanned)', 'FROM scanned WHERE check_name IN (' + _PATTERN_CHECKS + ') AND check_name <> ' + chr(39) + 'magic-number' + chr(39) + ')')}{_STAMPED} SELECT id, check_name, file, start_line FROM stamped",
    "findings_in_files": f"""{_F}{_STAMPED}, wanted AS (SELECT s_suppkey AS n FROM supplier WHERE s_suppkey <= 5), placed AS (
  SELECT run_id, id, check_name, regexp_extract(file, '([0-9]+)', 1)::BIGINT AS n FROM stamped
) SELECT run_id, id, check_name, CASE WHEN check_name = 'duplicate' THEN 2 ELSE 1 END::INTEGER AS n_places FROM placed WHERE n IN (FROM wanted) OR (check_name = 'duplicate' AND n + 1 IN (FROM wanted))""",
    "scan_summary": f"{_SCANNED}, g AS (SELECT *, 'open' AS status FROM f) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*)::BIGINT AS n FROM g GROUP BY {d}" for d in ("severity", "category", "status", "check_name", "language")),
}
