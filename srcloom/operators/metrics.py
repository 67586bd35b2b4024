"""Line and file metrics, nesting, complexity, and findings over thresholds.

All work is on a `lines` DataFrame (path, language, n, line). Counts are per-line expressions and one aggregation by
file; nesting is a running sum over a file's lines, so nothing but the file is ever a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.shared import written
from srcloom.functions.textual import base_name, count_of, matches, replaced, trim_start
from srcloom.sources.corpora import is_test

#: Words and operators that each add one branch point.
BRANCH_WORDS = (r"\bswitch\b", r"\bfor\b", r"\bwhile\b", r"\bdo\b", r"&&", r"\|\|")

#: Default thresholds.
THRESHOLDS = {"lines": 300, "complexity": 100, "nesting": 4, "exports": 10, "imports": 15}


def stripped(trimmed: Column, python: Column) -> Column:
    """A trimmed line without trailing comments and the insides of quotes."""
    x = replaced(trimmed, "//", r"//.*$", "")
    x = F.when(python, replaced(x, "#", r"#.*$", "")).otherwise(x)
    x = replaced(x, '"', r'"(?:[^"\\]|\\.)*"', '""')
    return replaced(x, "'", r"'(?:[^'\\]|\\.)*'", "''")


def branch_points(x: Column) -> Column:
    """Branch points of a stripped line. No two of the words overlap, so one pass counts them all."""
    words = count_of(x, "|".join((*BRANCH_WORDS, r"\bif\b", r"\belse\b")))
    chained = F.when(x.contains("else"), count_of(x, r"\belse\s+if\b")).otherwise(0)
    marks = F.when(x.contains("?"), count_of(x, r"\?") - count_of(x, r"\?\.") - 2 * count_of(x, r"\?\?") - count_of(x, r"\w\s*\?\s*[:)(]")).otherwise(0)
    return words - chained + marks


def line_facts(lines: DataFrame) -> DataFrame:
    """lines with is_comment, is_code, code (the stripped line), branches, exports, imports, and for nesting: down and up (a line
    that begins with } and one that ends with {) and indent (null for blank lines)."""
    python, go = F.col("language") == "python", F.col("language") == "go"
    trimmed = trim_start(F.col("line"))
    facts = lines.withColumn("trimmed", trimmed).withColumn("code", stripped(F.col("trimmed"), F.coalesce(python, F.lit(False))))
    comment = matches(F.col("trimmed"), r"^(?://|\*|/\*)") | (python & F.col("trimmed").startswith("#"))
    code = F.col("code")
    go_import = matches(code, r'^\s*import\s+"') | (matches(code, r'^\s*(?:\.\s+|[a-zA-Z_]\w*\s+)?"[^"]*"') & ~matches(code, r"\bimport\s*\(") & ~matches(code, r"^\s*import\b"))
    return (
        facts.withColumn("is_comment", F.coalesce(comment, F.lit(False)))
        .withColumn("is_code", (F.col("trimmed") != "") & ~F.col("is_comment"))
        .withColumn("branches", branch_points(code))
        .withColumn("exports", F.when(go, matches(code, r"\b(?:func|type|var|const)\s+[A-Z]")).otherwise(code.contains("export") & matches(code, r"\bexport\b")).cast("int"))
        .withColumn("down", F.when(code.contains("}") & matches(code, r"^\s*\}"), 1).otherwise(0))
        .withColumn("up", F.when(code.contains("{") & matches(code, r"\{\s*$"), 1).otherwise(0))
        .withColumn("indent", F.when(F.col("trimmed") != "", F.length("line") - F.length("trimmed")))
        .withColumn("imports", F.when(go, go_import).otherwise((code.contains("import") & matches(code, r"\bimport\b")) | (code.contains("require") & matches(code, r"\brequire\s*\("))).cast("int"))
    )


def file_metrics(lines: DataFrame) -> DataFrame:
    """Counts by file: lines, code and comment lines, branch points, exports, imports and comments per code line."""
    return metrics_of(line_facts(lines))


def metrics_of(facts: DataFrame) -> DataFrame:
    """file_metrics from the facts of lines."""
    long = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    counted = facts.groupBy("path").agg(
        F.count("*").alias("line_count"),
        long(F.count_if("is_code")).alias("code_lines"),
        long(F.count_if("is_comment")).alias("comment_lines"),
        long(F.sum("branches")).alias("branch_points"),
        long(F.sum("exports")).alias("exports"),
        long(F.sum("imports")).alias("imports"),
    )
    return counted.withColumn("comment_ratio", F.coalesce(F.try_divide(F.col("comment_lines").cast("double"), F.col("code_lines").cast("double")), F.lit(0.0)))


def brace_depths(facts: DataFrame) -> DataFrame:
    """facts with depth_before and depth (after the line) of brace nesting.

    A line that begins with } goes down one level unless it is at level 0, then one that ends with { goes up one. Without
    the floor that is a running sum of steps; the floor adds back the deepest dip below 0 so far.
    """
    so_far = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    in_order = Window.partitionBy("path").orderBy("n")
    summed = facts.withColumn("after", F.sum(F.col("up") - F.col("down")).over(so_far))
    dips = summed.withColumn("dip", F.least(F.lit(0), F.min(F.col("after") - F.col("up")).over(so_far)))
    return dips.withColumn("depth", F.col("after") - F.col("dip")).withColumn("depth_before", F.coalesce(F.lag("depth").over(in_order), F.lit(0)))


def indent_nesting(facts: DataFrame) -> DataFrame:
    """path, max_depth and complexity by indentation: a deeper line opens a level, a shallower one closes those deeper than
    itself; a line's branch points weigh one more than the depth before it.

    Only small numbers of each line are gathered, and the fold over a file's lines keeps the stack of open levels; blank
    lines change nothing.
    """
    lines = facts.select("path", "n", "indent", F.col("branches").cast("long").alias("branches"))
    rows = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", "indent", "branches"))).alias("steps"))
    start = F.struct(F.array(F.lit(0)).alias("stack"), F.lit(0).alias("most"), F.lit(0).cast("long").alias("weighed"))

    def step(state: Column, line: Column) -> Column:
        indent = line["indent"]
        open_ = F.filter(state["stack"], lambda level: level <= indent)
        deeper = F.when(F.array_contains(open_, indent), open_).otherwise(F.concat(open_, F.array(indent)))
        stack = F.when(indent.isNull(), state["stack"]).otherwise(deeper)
        return F.struct(stack.alias("stack"), F.greatest(state["most"], F.size(stack) - 1).alias("most"), (state["weighed"] + line["branches"] * F.size(state["stack"])).alias("weighed"))

    folded = rows.select("path", F.aggregate("steps", start, step).alias("end"))
    return folded.select("path", F.col("end.most").cast("long").alias("max_depth"), F.col("end.weighed").alias("complexity"))


def brace_nesting(facts: DataFrame) -> DataFrame:
    """path, max_depth and complexity (branch points weighted by one more than the depth before their line) by braces."""
    depths = brace_depths(facts)
    return depths.groupBy("path").agg(F.max("depth").cast("long").alias("max_depth"), F.sum(F.col("branches") * (1 + F.col("depth_before"))).cast("long").alias("complexity"))


def nesting(lines: DataFrame) -> DataFrame:
    """max_depth and complexity of every file, by indentation in Python and by braces elsewhere."""
    return nesting_of(line_facts(lines))


def nesting_of(facts: DataFrame) -> DataFrame:
    """nesting from the facts of lines."""
    python = F.coalesce(F.col("language") == "python", F.lit(False))
    return brace_nesting(facts.filter(~python)).unionByName(indent_nesting(facts.filter(python)))


#: Names of files that gather what belongs nowhere, surely and perhaps.
GRAB_BAGS, SHARED_BAGS = r"(?i)^(?:helpers?|utils?|misc|lib|tools|functions|methods)$", r"(?i)^(?:common|shared)$"


def metric_findings(lines: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """path, rule, severity, category and value of every threshold that a file exceeds."""
    most = {**THRESHOLDS, **(thresholds or {})}
    told = written(line_facts(lines).drop("line", "trimmed", "code"), "line-facts")  # a few numbers a line, asked three times
    facts = metrics_of(told).join(nesting_of(told), "path", "left").withColumn("test", is_test(F.col("path")))
    name = F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")
    strong, weak = name.rlike(GRAB_BAGS), name.rlike(SHARED_BAGS)
    big, wide = F.col("line_count") > 150, F.col("exports") > 5
    rules = (
        ("metrics-long-file", "medium", "metrics", F.col("line_count") > F.when(F.col("test"), 2 * most["lines"]).otherwise(most["lines"]), F.col("line_count")),
        ("metrics-high-complexity", "high", "metrics", F.col("complexity") > most["complexity"], F.col("complexity")),
        ("metrics-deep-nesting", "medium", "metrics", F.col("max_depth") > most["nesting"], F.col("max_depth")),
        ("metrics-high-exports", "medium", "modularity", F.col("exports") > most["exports"], F.col("exports")),
        ("metrics-high-imports", "medium", "modularity", F.col("imports") > most["imports"], F.col("imports")),
        ("metrics-low-comments", "low", "comment-quality", (F.col("comment_ratio") < 0.02) & (F.col("complexity") > most["complexity"]), F.col("complexity")),
        ("metrics-excessive-comments", "low", "comment-quality", (F.col("comment_ratio") > 0.5) & (F.col("code_lines") >= 20) & ~F.col("test"), F.col("comment_lines")),
        ("metrics-grab-bag", "medium", "modularity", (strong & (big | wide)) | (weak & big & wide), F.col("line_count")),
    )
    fired = [F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), value.cast("long").alias("value"))) for rule, severity, category, hit, value in rules]
    return facts.select("path", F.explode(F.array_compact(F.array(*fired))).alias("f")).select("path", "f.*")
