"""One findings table from the results of all scans: a mapping for each, their union, scores, identities and a summary.

A scan runs kernels, each a question about the files that is answered by itself: its result is a table of its own in the
scan's folder, published by a marker once it is whole. A kernel that fails leaves a warning and the findings of the
others; a scan that is run again in the same folder takes up the tables that are there and runs the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import shared_folder, written
from srcloom.functions.textual import base_name
from srcloom.operators import abstractions, code_duplicates, dependencies, findings, metrics, modules, patterns, statements, symbols
from srcloom.sources.corpora import lines_of

COLUMNS = ("check_name", "severity", "category", "language", "file", "start_line", "description", "symbol", "confidence", "fixable", "suggestion")

#: Severity, category and certainty of the checks that do not bring their own, and what they suggest.
DEAD = ("low", "dead-code")
UNUSED_IMPORT_CONFIDENCE, METRIC_CONFIDENCE, PATTERN_CONFIDENCE, DIVERGENT_CONFIDENCE, RACE_CONFIDENCE = 0.85, 0.95, 0.9, 0.8, 0.85
UNUSED_DEPENDENCY_CONFIDENCE, INCONSISTENT_CONFIDENCE, OVER_ENGINEERING_CONFIDENCE = 0.7, 0.75, 0.7
SUGGESTIONS = {
    "dead-export": "Remove the export or verify it is consumed externally.",
    "unused-dep": "Remove the dependency or verify it is used via dynamic require.",
    "unused-import": "Remove the unused import.",
    "inconsistent-patterns": "Align with the predominant pattern used elsewhere in the codebase.",
    "over-engineering": "Simplify to the minimum viable abstraction.",
    "divergent-export": "Consolidate into a single shared implementation and import from one location.",
    "toctou": "Use atomic file operations (e.g., O_EXCL/wx flag, exist_ok=True) instead of check-then-act patterns.",
    "extract-function": "Extract the duplicated block into a named function and call it from both sites.",
    "extract-and-share": "Move the duplicated function to a shared module and import it where needed.",
    "extract-wrapper": "Extract the repeated try/catch or setup/teardown into a higher-order wrapper function.",
    "extract-config": "Extract the repeated data structure into a shared constant or factory.",
}
DIVERGENCE = " ⚠️ These blocks differ in {} literal value(s) — these are likely behaviour-significant: parameterise them, do NOT collapse to a single value. Verify with tests."


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _mapped(rows: DataFrame, check: Column | str, severity: Column | str, category: Column | str, file: Column | None, line: Column | None, description: Column, confidence: Column | float, symbol: Column | None = None, language: Column | None = None, suggestion: Column | None = None) -> DataFrame:
    told = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    none = F.lit(None).cast("string")
    suggested = told(suggestion) if suggestion is not None else F.lit(SUGGESTIONS.get(check) if isinstance(check, str) else None).cast("string")
    values = (told(check), told(severity), told(category), F.lit("common") if language is None else language, none if file is None else file, F.lit(None).cast("int") if line is None else line.cast("int"), description, none if symbol is None else symbol, told(confidence).cast("double"), F.lit(True), suggested)
    return rows.select(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def of_metrics(rows: DataFrame) -> DataFrame:
    return _mapped(rows, F.col("rule"), F.col("severity"), F.col("category"), F.col("path"), F.lit(1), _text(F.col("rule"), " ", F.col("value")), METRIC_CONFIDENCE)


def of_patterns(rows: DataFrame) -> DataFrame:
    return _mapped(rows, F.col("rule"), F.col("severity"), F.col("category"), F.col("path"), F.col("n"), F.col("rule"), PATTERN_CONFIDENCE)


def of_races(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "toctou", "high", "security", F.col("path"), F.col("n"), _text("check and act ", F.col("act_n") - F.col("n"), " lines apart"), RACE_CONFIDENCE)


def of_dead_exports(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "dead-export", *DEAD, F.col("path"), F.col("n"), _text("Exported symbol '", F.col("name"), "' appears unused"), F.col("confidence"), F.col("name"), F.col("language"))


def of_unused_imports(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "unused-import", *DEAD, F.col("path"), F.col("n"), _text("Import '", F.col("name"), "' is never used"), UNUSED_IMPORT_CONFIDENCE, F.col("name"), F.col("language"))


def of_divergent_exports(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "divergent-export", "medium", "duplication", F.col("first_path"), F.lit(1), _text("'", F.col("name"), "' is exported by ", F.col("n_files"), " files"), DIVERGENT_CONFIDENCE, F.col("name"))


def of_unused_dependencies(rows: DataFrame) -> DataFrame:
    """A dependency has no place in a file; its project tells it from that of another."""
    return _mapped(rows, "unused-dep", *DEAD, None, None, _text("Dependency '", F.col("name"), "' declared in ", F.col("manifest"), " manifest but not referenced in source"), UNUSED_DEPENDENCY_CONFIDENCE, _text(F.col("project"), ":", F.col("name")))


def of_outdated(rows: DataFrame) -> DataFrame:
    place = F.when(F.col("project") == "", F.col("location")).otherwise(_text(F.col("project"), "/", F.col("location")))
    what = F.when(F.col("location") == "source", "Outdated usage '").otherwise("Outdated dependency '")
    return _mapped(rows, "outdated-pattern", F.col("severity"), "outdated", place, F.lit(1), _text(what, F.col("old"), "'"), F.col("confidence"), suggestion=_text("Migrate from '", F.col("old"), "' to '", F.col("new"), "'."))


def of_inconsistent(rows: DataFrame) -> DataFrame:
    return _mapped(rows, "inconsistent-patterns", "low", "consistency", None, None, _text("Inconsistent ", F.col("concern"), " patterns: ", F.col("n_approaches"), " different approaches found"), INCONSISTENT_CONFIDENCE)


def _over_engineered(rows: DataFrame, symbol: Column, description: Column) -> DataFrame:
    return _mapped(rows, "over-engineering", "low", "complexity", F.col("path"), F.lit(1), description, OVER_ENGINEERING_CONFIDENCE, symbol)


def of_single_method_classes(rows: DataFrame) -> DataFrame:
    return _over_engineered(rows, F.col("symbol"), _text("Single-method class (only method: ", F.col("method"), ") — a plain function may suffice"))


def of_single_implementations(rows: DataFrame) -> DataFrame:
    return _over_engineered(rows, F.col("symbol"), _text("Interface ", F.col("symbol"), " has only one implementation — may be unnecessary abstraction"))


def of_pass_throughs(rows: DataFrame) -> DataFrame:
    every = _text("All ", F.col("n_functions"), " exported functions are pass-throughs (fan-in: ", F.col("fan_in"), ") — file may be unnecessary indirection")
    some = _text("Low fan-in (", F.col("fan_in"), " importers) with ", F.col("n_pass"), "/", F.col("n_functions"), " pass-through functions — may be unnecessary abstraction layer")
    return _over_engineered(rows, base_name(F.col("path")), F.when(F.col("n_pass") >= F.col("n_functions"), every).otherwise(some))


def _duplicate_suggestion() -> Column:
    by = reduce(lambda a, k: a.when(F.col("category") == k, SUGGESTIONS[k]), ("extract-and-share", "extract-wrapper", "extract-config"), F.when(F.col("category") == "extract-function", SUGGESTIONS["extract-function"])).otherwise(SUGGESTIONS["extract-function"])
    before, after = DIVERGENCE.split("{}")
    return F.concat(by, F.when(F.col("divergent_literals") > 0, _text(before, F.col("divergent_literals"), after)).otherwise(""))


def of_duplicates(rows: DataFrame) -> DataFrame:
    """Pairs of regions: the place is that of side a, the symbol names both lines, so that pairs of two files stay apart."""
    symbol = _text(F.col("start_line_a") + 1, "-", F.col("end_line_a") + 1, ":", F.col("start_line_b") + 1, "-", F.col("end_line_b") + 1)
    return _mapped(rows, "duplicate-code", "medium", "duplication", F.col("path_a"), F.col("start_line_a") + 1, _text("Duplicate code block between ", F.col("path_a"), " and ", F.col("path_b")), F.col("confidence"), symbol, suggestion=_duplicate_suggestion())


def of_clusters(rows: DataFrame) -> DataFrame:
    text = _text("Duplicate pattern across ", F.col("files_affected"), " files (", F.col("duplicated_lines"), " duplicated lines, ", F.col("member_count"), " regions)")
    first = r"^(.*):(\d+)-(\d+)$"
    return _mapped(rows, "duplicate-cluster", "medium", "duplication", F.regexp_extract("root", first, 1), F.regexp_extract("root", first, 2).cast("int") + 1, text, F.col("similarity"), F.col("root"), suggestion=_duplicate_suggestion())


@dataclass
class Inputs:
    """What kernels ask: sources (path, language, content), other files of projects, project folders, recently added files; what several need is made once."""

    files: DataFrame
    others: DataFrame | None = None
    projects: DataFrame | None = None
    recent: DataFrame | None = None
    thresholds: dict[str, int] | None = None
    least_approaches: int = 3
    categories: tuple[str, ...] | None = None

    @cached_property
    def lines(self) -> DataFrame:
        return lines_of(self.files)

    @cached_property
    def symbols(self) -> DataFrame:
        return written(symbols.file_symbols(self.files), "symbols")

    @cached_property
    def importers(self) -> DataFrame:
        return written(symbols.fan_in(self.symbols), "fan-in")

    @cached_property
    def all_files(self) -> DataFrame:
        mine = self.files.select("path", "content")
        return mine if self.others is None else mine.union(self.others.select("path", "content"))

    @cached_property
    def roots(self) -> DataFrame:
        return self.files.sparkSession.createDataFrame([("",)], "project string") if self.projects is None else self.projects

    @cached_property
    def regions(self) -> DataFrame:
        return written(code_duplicates.duplicate_regions(self.files), "regions")


def _patterns(x: Inputs) -> DataFrame:
    rules = patterns.RULES if not x.categories else tuple(r for r in patterns.RULES if r.category in x.categories)
    return of_patterns(patterns.pattern_hits(x.lines, rules))


def _inconsistent(x: Inputs) -> DataFrame:
    clean = x.files.filter("content IS NOT NULL").select("path", patterns.without_noise(F.col("content")).alias("content"))
    return of_inconsistent(patterns.inconsistent(clean, x.least_approaches))


KERNELS: dict[str, Callable[[Inputs], DataFrame]] = {
    "metrics": lambda x: of_metrics(metrics.metric_findings(x.lines, x.thresholds)),
    "patterns": _patterns,
    "races": lambda x: of_races(patterns.races(x.lines)),
    "dead-exports": lambda x: of_dead_exports(symbols.dead_exports(x.symbols, modules.reachable_files(x.files, x.all_files), x.recent)),
    "dead-exports-by-words": lambda x: of_dead_exports(symbols.dead_exports_by_words(x.files, x.symbols)),
    "unused-imports": lambda x: of_unused_imports(statements.unused_imports(x.files)),
    "divergent-exports": lambda x: of_divergent_exports(symbols.divergent_exports(x.symbols)),
    "unused-dependencies": lambda x: of_unused_dependencies(dependencies.unused_dependencies(x.all_files)),
    "outdated": lambda x: of_outdated(dependencies.outdated_dependencies(x.all_files, x.roots)),
    "inconsistent": _inconsistent,
    "single-method-classes": lambda x: of_single_method_classes(abstractions.single_method_classes(x.files, x.importers)),
    "single-implementations": lambda x: of_single_implementations(abstractions.single_implementation_interfaces(x.files, x.importers)),
    "pass-throughs": lambda x: of_pass_throughs(symbols.pass_throughs(x.files, x.importers)),
    "duplicates": lambda x: of_duplicates(x.regions),
    "duplicate-clusters": lambda x: of_clusters(code_duplicates.region_clusters(x.regions)),
}

_SCHEMA = "check_name string, severity string, category string, language string, file string, start_line int, description string, symbol string, confidence double, fixable boolean, suggestion string"
_WARNING = "kernel string, message string"


def enabled(rows: DataFrame, disabled: list[str] | None) -> DataFrame:
    """Findings of checks that are not switched off."""
    return rows.filter(~F.col("check_name").isin(*disabled)) if disabled else rows


def _kernel_table(kernel: Callable[[Inputs], DataFrame], inputs: Inputs, path: str) -> DataFrame:
    """The kernel's result as a table; one that a marker says is whole is taken as it is."""
    spark = inputs.files.sparkSession
    try:
        spark.read.schema("done boolean").parquet(f"{path}.done").isEmpty()
    except PySparkException:
        kernel(inputs).write.mode("overwrite").parquet(path)
        spark.createDataFrame([(True,)], "done boolean").write.mode("overwrite").parquet(f"{path}.done")
    return spark.read.schema(_SCHEMA).parquet(path)


def run(inputs: Inputs, kernels: dict[str, Callable[[Inputs], DataFrame]] | None = None, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all kernels that end well, and a warning (kernel, message) for each that fails.

    `at` names the scan's folder; give the one of an earlier run to resume it.
    """
    spark = inputs.files.sparkSession
    at = at or f"{shared_folder(spark)}/srcloom-scan-{uuid.uuid4().hex}"
    parts, warnings = [spark.createDataFrame([], _SCHEMA)], []
    for name, kernel in (KERNELS if kernels is None else kernels).items():
        try:
            parts.append(_kernel_table(kernel, inputs, f"{at}/{name}"))
        except Exception as e:  # a failed kernel must not take the others along, whatever it raised
            warnings.append((name, str(e).split("\n")[0]))
    return reduce(DataFrame.unionByName, parts), spark.createDataFrame(warnings, _WARNING)


def stamped(rows: DataFrame) -> DataFrame:
    """Findings of a scan with run_id 0, their place in it, a score and an id."""
    return findings.stamped(rows.withColumn("run_id", F.lit(0).cast("long")).withColumn("ord", F.coalesce("start_line", F.lit(0)).cast("long")))


def scan(inputs: Inputs, disabled: list[str] | None = None, kernels: dict[str, Callable[[Inputs], DataFrame]] | None = None, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings of a scan in one schema, those of disabled checks left out, and its warnings."""
    rows, warnings = run(inputs, kernels, at)
    return stamped(enabled(rows, disabled)), warnings
