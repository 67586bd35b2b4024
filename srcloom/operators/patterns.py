"""Rules over lines: the rule catalog, check-then-act races, inconsistent approaches and outdated interfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.rule_catalog import MIGRATIONS, RULES, Rule
from srcloom.functions.textual import glob_pattern, matches, matches_holding, replaced, trim_both
from srcloom.sources.corpora import EXTENSIONS, is_test


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def pattern_hits(lines: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, n, rule, severity, category and match of every line that a rule of its file hits.

    One pass over the lines evaluates the rules of each line's language; a rule whose `unless` pattern is on any line of
    a file has no hits there, which a window over the file's few hits tells, so the text is read once.
    """
    languages = sorted({r.language for r in rules} - {"common"}) or sorted(EXTENSIONS)
    applies = {x: [(k, r) for k, r in enumerate(rules) if r.language in ("common", x)] for x in languages}

    def tried(language: str) -> Column:
        """Codes of the rules that the line hits (twice the place in `rules`) or is the undoing of (one more)."""
        out = []
        for k, r in applies[language]:
            out.append(F.when(matches_holding(F.col("line"), r.pattern), 2 * k))
            if r.unless:
                out.append(F.when(matches_holding(F.col("line"), r.unless), 2 * k + 1))
        return F.array_compact(F.array(*out))

    found = reduce(lambda a, x: a.when(F.col("language") == x, tried(x)), languages[1:], F.when(F.col("language") == languages[0], tried(languages[0])))
    # which files a rule reads is asked of its hits only; the catalog is the one table small enough to send everywhere
    excluded = [("|".join(f"(?:{glob_pattern(g)})" for g in r.excludes) or "(?!)") for r in rules]
    catalog = lines.sparkSession.createDataFrame([(k, r.id, r.severity, r.category, _files(r), x) for k, (r, x) in enumerate(zip(rules, excluded, strict=True))], "k int, rule string, severity string, category string, files string, excludes string")
    hits = lines.select("path", "n", "line", F.explode(found).alias("code")).withColumn("k", F.expr("code div 2").cast("int"))
    hits = hits.join(F.broadcast(catalog), "k").filter("path rlike files AND NOT path rlike excludes AND NOT element_at(split(path, '/'), -1) rlike excludes")
    marked = hits.withColumn("cleared", F.max(F.col("code") % 2).over(Window.partitionBy("path", "rule")))
    return marked.filter("code % 2 = 0 AND cleared = 0").select("path", "n", "rule", "severity", "category", trim_both(F.col("line")).alias("match"))


def _files(rule: Rule) -> str:
    """The rule's file glob as a pattern over the path's end: these globs ask for an extension anywhere."""
    return r"\.(?:" + "|".join(rule.files.rpartition(".")[2].strip("{}").split(",")) + ")$"


#: Per language the check, the act and what makes the pair safe.
RACES = {
    "typescript": (r"\b(?:existsSync|accessSync)\s*\(", r"\b(?:writeFileSync|unlinkSync|renameSync|mkdirSync|rmSync|appendFileSync|copyFileSync)\s*\(", r"""["']wx["']|O_EXCL"""),
    "python": (r"\b(?:os\.path\.exists|os\.path\.isfile|os\.path\.isdir|os\.access)\s*\(", r"\b(?:os\.remove|os\.unlink|os\.rename|os\.mkdir|os\.makedirs|shutil\.rmtree|shutil\.copy|shutil\.move)\s*\(", r"os\.O_EXCL|exist_ok\s*=\s*True|tempfile\."),
}
LOOK_AHEAD = 8


def races(lines: DataFrame) -> DataFrame:
    """path, n (of the check) and act_n of checks in an `if` whose first act follows within LOOK_AHEAD lines, unsafely."""

    def of(k: int) -> Column:
        a, b = RACES.items()
        return F.when(F.col("language") == a[0], matches(F.col("line"), a[1][k])).when(F.col("language") == b[0], matches(F.col("line"), b[1][k]))

    facts = lines.filter(F.col("language").isin(*RACES) & ~is_test(F.col("path"))).select("path", "n", of(0).alias("check"), of(1).alias("act"), of(2).alias("safe"), matches(F.col("line"), r"\bif\b").alias("cond"))
    order = Window.partitionBy("path").orderBy("n")
    seen = (
        facts.withColumn("in_if", F.col("cond") | F.coalesce(F.lag("cond").over(order), F.lit(False)))
        .withColumn("act_n", F.min(F.when(F.col("act"), F.col("n"))).over(order.rowsBetween(1, LOOK_AHEAD)))
        .withColumn("safe_n", F.min(F.when(F.col("safe"), F.col("n"))).over(order.rowsBetween(0, LOOK_AHEAD)))
    )
    return seen.filter(F.col("check") & F.col("in_if") & F.col("act_n").isNotNull() & (F.col("safe_n").isNull() | (F.col("safe_n") > F.col("act_n")))).select("path", "n", "act_n")


#: Words that show a concern, and its approaches.
CONCERNS = {
    "error-handling": ("try", "catch", "throw", "Error"),
    "logging": ("log", "logger", "console", "print"),
    "data-fetching": ("fetch", "axios", "http", "request"),
    "config": ("config", "env", "settings", "getConfig"),
    "validation": ("validate", "schema", "assert", "check"),
    "file-locking": ("lock", "flock", "lockfile", "acquireLock"),
    "process-spawning": ("execSync", "spawnSync", "child_process", "subprocess"),
    "file-io": ("readFileSync", "writeFileSync", "createReadStream", "fsPromises"),
}
APPROACHES = (
    ("error-handling", "try/catch with custom Error", r"throw\s+new\s+[A-Z][A-Za-z]*Error"),
    ("error-handling", "try/catch", r"\btry\s*\{[\s\S]*?\bcatch\b"),
    ("error-handling", "promise .catch()", r"\.catch\s*\("),
    ("error-handling", "error callback (err, data)", r"function\s*\([^)]*\berr\b"),
    ("logging", "console.*", r"\bconsole\.(log|warn|error|info|debug)\s*\("),
    ("logging", "logger object", r"\blogger\.(log|warn|error|info|debug)\s*\("),
    ("logging", "log() call", r"\blog\s*\("),
    ("logging", "print()", r"\bprint\s*\("),
    ("data-fetching", "fetch API", r"\bfetch\s*\("),
    ("data-fetching", "axios", r"\baxios\b"),
    ("data-fetching", "http/https module", r"\bhttp(s)?\.request\b|\bhttp(s)?\.get\b"),
    ("data-fetching", "request library", r"\brequest\s*\("),
    ("config", "process.env", r"\bprocess\.env\b"),
    ("config", "getConfig()", r"\bgetConfig\s*\("),
    ("config", "config object", r"\bconfig\s*\.\s*[A-Za-z]"),
    ("config", "settings object", r"\bsettings\s*\.\s*[A-Za-z]"),
    ("validation", "schema validation (zod/yup/joi)", r"\b(z\.|yup\.|joi\.)"),
    ("validation", "assert()", r"\bassert\s*\("),
    ("validation", "validate()", r"\bvalidate\s*\("),
    ("validation", "manual check (if !x throw)", r"if\s*\(![^)]+\)\s*(throw|return)"),
    ("file-locking", "exclusive file flag (wx/O_EXCL)", r"""["']wx["']|O_EXCL|O_CREAT"""),
    ("file-locking", "lockfile library", r"\b(?:proper-lockfile|lockfile|fd-lock)\b"),
    ("file-locking", "flock/lockf syscall", r"\b(?:flock|lockf|fcntl\.flock)\s*\("),
    ("file-locking", "mkdir-based lock", r"(?i)mkdir(?:Sync)?\s*\([^)]*lock"),
    ("process-spawning", "exec/execSync (shell)", r"\bexec(?:Sync)?\s*\("),
    ("process-spawning", "execFile/execFileSync (no shell)", r"\bexecFile(?:Sync)?\s*\("),
    ("process-spawning", "spawn/spawnSync", r"\bspawn(?:Sync)?\s*\("),
    ("process-spawning", "subprocess (Python)", r"\bsubprocess\.(?:run|call|check_output|Popen)\s*\("),
    ("file-io", "sync fs (readFileSync/writeFileSync)", r"\b(?:readFileSync|writeFileSync|appendFileSync)\s*\("),
    ("file-io", "async fs/promises", r"\bfs/promises\b|\bfsPromises\b|\bfs\.promises\b"),
    ("file-io", "stream I/O", r"\bcreate(?:Read|Write)Stream\s*\("),
    ("file-io", "callback fs", r"\bfs\.(?:readFile|writeFile|appendFile)\s*\([^)]*,\s*(?:function|\()"),
)


def approaches(files: DataFrame) -> DataFrame:
    """concern, approach and n_files over files (path, content, comments and quotes blanked) that are no tests."""
    content = F.col("content")
    shown = {c: _any([matches_holding(content, rf"\b{w}\b") for w in words]) for c, words in CONCERNS.items()}
    # an approach's own words are rarer than those of its concern, so they are looked for first; numbers in one text are compiled
    fired = F.concat_ws(" ", *[F.when(matches_holding(content, p) & shown[c], str(k)) for k, (c, a, p) in enumerate(APPROACHES)])
    each = files.filter(~is_test(F.col("path"))).select(fired.alias("fired")).filter("fired <> ''")
    named = F.array(*[F.struct(F.lit(c).alias("concern"), F.lit(a).alias("approach")) for c, a, _ in APPROACHES])
    met = each.groupBy("fired").agg(F.count("*").alias("n")).select("n", F.explode(F.split("fired", " ").cast("array<int>")).alias("k")).groupBy("k").agg(F.sum("n").alias("n_files"))
    return met.select(F.get(named, F.col("k")).alias("a"), "n_files").select("a.concern", "a.approach", "n_files")


def inconsistent(files: DataFrame, least: int = 3) -> DataFrame:
    """concern, n_approaches and approaches (name and number of files, sorted) of concerns met in several ways."""
    by = approaches(files).groupBy("concern").agg(F.count("*").alias("n_approaches"), F.array_join(F.array_sort(F.collect_list(F.concat("approach", F.lit("="), F.col("n_files").cast("string")))), "; ").alias("approaches"))
    return by.filter(F.col("n_approaches") >= least)


#: What is blanked before approaches are looked for, in this order, what it begins with or holds, and by what.
NOISE = (
    ("/*", r"/\*[\s\S]*?\*/", ""),
    ("//", r"(?<!:)//[^\n]*", ""),
    ("#", r"(?m)^\s*#[^\n]*", ""),
    ("`", r"`[^`]*`", '""'),
    ('"', r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""'),
    ("'", r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", "''"),
    ("/", r"/(?<=[=({\[,;!&|?:\s]/)[^/\n]+/[gimsuy]*", '""'),
)


def without_noise(content: Column) -> Column:
    """Content with comments dropped, and with quoted text and regex literals blanked."""
    return reduce(lambda x, rule: F.transform(F.array(x), lambda y: replaced(y, *rule))[0], NOISE, content)


#: The language whose files show each ecosystem's outdated interfaces.
ECOSYSTEMS = {"javascript": "typescript", "python": "python", "go": "go", "csharp": "csharp", "java": "java"}


def outdated(lines: DataFrame) -> DataFrame:
    """ecosystem, old, new, severity, n_lines and n_files of the migrations whose interface is in use."""
    by: dict[str, Column] = {}
    for ecosystem, language in ECOSYSTEMS.items():
        fired = [F.when(matches(F.col("line"), m.pattern), F.struct(F.lit(m.ecosystem).alias("ecosystem"), F.lit(m.old).alias("old"), F.lit(m.new).alias("new"), F.lit(m.severity).alias("severity"))) for m in MIGRATIONS if m.ecosystem == ecosystem]
        by[language] = F.array_compact(F.array(*fired))
    items = list(by.items())
    found = reduce(lambda a, kv: a.when(F.col("language") == kv[0], kv[1]), items[1:], F.when(F.col("language") == items[0][0], items[0][1]))
    each = lines.select("path", F.explode(found).alias("m")).select("path", "m.*")
    return each.groupBy("ecosystem", "old", "new", "severity").agg(F.count("*").alias("n_lines"), F.count_distinct("path").alias("n_files"))
