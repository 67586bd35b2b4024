"""Exports and imports of files, and what their joins tell: dead and divergent exports, fan-in, unused imports, reach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.textual import group_of, matches, spaced, trim_both
from srcloom.operators.statements import imports_of_content
from srcloom.sources.corpora import is_entry_point, is_test

#: What exports a name, in the order tried.
EXPORTS = {
    "typescript": (
        r"^export\s+(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+interface\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+type\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+enum\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+default\s+(?:(?:async\s+)?function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)",
        r"^export\s+default\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*;?$",
    ),
    "go": (
        r"^func\s+([A-Z][A-Za-z0-9_]*)\s*[(\[]",
        r"^func\s+\([^)]+\)\s+([A-Z][A-Za-z0-9_]*)\s*\(",
        r"^type\s+([A-Z][A-Za-z0-9_]*)\s+",
        r"^var\s+([A-Z][A-Za-z0-9_]*)\s",
        r"^const\s+([A-Z][A-Za-z0-9_]*)\s",
    ),
    "python": (r"^(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", r"^class\s+([A-Za-z_][A-Za-z0-9_]*)\s*[:(]"),
    "csharp": (
        r"public\s+(?:static\s+)?(?:class|interface|struct|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"public\s+(?:static\s+)?(?:\w+\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    ),
    "java": (
        r"public\s+(?:static\s+)?(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)",
        r"public\s+(?:static\s+)?(?:\w+\s+)+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    ),
}


def _by_language(cases: dict[str, Column]) -> Column:
    items = list(cases.items())
    return reduce(lambda a, kv: a.when(F.col("language") == kv[0], kv[1]), items[1:], F.when(F.col("language") == items[0][0], items[0][1]))


#: Words without which no line of a language exports a name.
_EXPORT_WORDS = {"typescript": ("export",), "go": ("func", "type", "var", "const"), "python": ("def", "class"), "csharp": ("public",), "java": ("public",)}
#: Lists of exported names, and what opens and closes a block of Go declarations and names in it.
EXPORT_LIST = r"export\s+\{([^}]+)\}"
GO_BLOCK, GO_BLOCK_NAME = r"^(?:var|const)\s*\(", r"^([A-Z][A-Za-z0-9_]*)(?:\s|$)"


#: Fixed value: a line that hands on names of another module.
HANDS_ON = r"^\s*export\s+\{[^}]*\}\s+from\s+"


def _export(n: Column, name: Column, is_type: Column | bool = False, decorated: Column | bool = False, handed_on: Column | bool = False) -> Column:
    told = lambda x: F.coalesce(F.lit(x) if isinstance(x, bool) else x, F.lit(False))
    return F.struct(n.cast("int").alias("n"), name.alias("name"), told(is_type).alias("is_type"), told(decorated).alias("decorated"), told(handed_on).alias("handed_on"))


def _line_exports(lines: Column) -> Column:
    """Exports that one line states."""

    def of_line(x: Column, k: Column) -> Column:
        cases = {lang: F.when(reduce(lambda a, w: a | x.contains(w), _EXPORT_WORDS[lang], F.lit(False)), F.coalesce(*[group_of(x, p) for p in patterns])) for lang, patterns in EXPORTS.items()}
        decorated = (F.col("language") == "python") & trim_both(F.get(lines, k - 1)).startswith("@")
        return F.struct(_by_language(cases).alias("name"), x.alias("line"), k.alias("k"), decorated.alias("decorated"))

    named = F.filter(F.transform(lines, of_line), lambda e: e["name"].isNotNull())
    return F.transform(named, lambda e: _export(e["k"] + 1, e["name"], (F.col("language") == "typescript") & matches(e["line"], r"^export\s+(?:type|interface)\b"), e["decorated"]))


def _list_exports(content: Column) -> Column:
    """Names of `export { a, b as c }`, which may span lines; a renamed one counts by its new name, at the line of `export`."""

    def of_lists(pieces: Column) -> Column:
        lists = F.regexp_extract_all(content, F.lit(EXPORT_LIST), F.lit(0))

        def of_list(text: Column, k: Column) -> Column:
            passed = F.concat(F.slice(pieces, 1, k + 1), F.slice(lists, 1, k))
            n = F.aggregate(passed, F.lit(0), lambda m, x: m + F.regexp_count(x, F.lit("\n"))) + 1
            inside = F.transform(F.split(F.regexp_extract(text, EXPORT_LIST, 1), ","), lambda x: trim_both(F.regexp_replace(trim_both(x), r"^[\s\S]*\s+as\s+", "")))
            line = F.get(F.split(content, "\n"), n - 1)
            return F.transform(F.filter(inside, lambda x: x != ""), lambda x: _export(n, x, handed_on=line.rlike(HANDS_ON)))

        return F.flatten(F.transform(lists, of_list))

    return F.when(content.rlike(EXPORT_LIST), F.transform(F.array(F.split(content, EXPORT_LIST, -1)), of_lists)[0])


def _block_exports(lines: Column, known: Column) -> Column:
    """Names of Go's `var (...)` and `const (...)` that no line exports already."""
    trimmed = F.transform(lines, lambda x, k: F.struct(trim_both(x).alias("t"), k.alias("k")))

    def told(rows: Column) -> Column:
        places = lambda test: F.transform(F.filter(rows, lambda r: test(r["t"])), lambda r: r["k"])
        last = lambda found, k: F.coalesce(F.array_max(F.filter(found, lambda x: x < k)), F.lit(-1))

        def between(opens: Column, closes: Column) -> Column:
            inside = F.filter(rows, lambda r: r["t"].rlike(GO_BLOCK_NAME) & (last(opens, r["k"]) > last(closes, r["k"])))
            names = F.transform(inside, lambda r: _export(r["k"] + 1, F.regexp_extract(r["t"], GO_BLOCK_NAME, 1)))
            return F.filter(names, lambda e: ~F.exists(known, lambda x: x["name"] == e["name"]))

        both = F.struct(places(lambda t: t.rlike(GO_BLOCK)).alias("opens"), places(lambda t: t == ")").alias("closes"))
        return F.transform(F.array(both), lambda b: between(b["opens"], b["closes"]))[0]

    return F.when(F.col("content").rlike("(?m)" + GO_BLOCK.replace("^", r"^\s*")), F.transform(F.array(trimmed), told)[0])


def exports_of_content() -> Column:
    """The exports of a row (language, content): an array of n, name, is_type, decorated (the line before begins with @) and
    handed_on (its line re-exports names of another module)."""
    none = F.array().cast("array<struct<n:int,name:string,is_type:boolean,decorated:boolean,handed_on:boolean>>")

    def of(lines: Column) -> Column:
        stated = _line_exports(lines)
        listed = F.concat(stated, F.coalesce(_list_exports(F.col("content")), none))
        blocks = F.transform(F.array(stated), lambda known: F.concat(known, F.coalesce(_block_exports(lines, known), none)))[0]
        return F.when(F.col("language") == "typescript", listed).when(F.col("language") == "go", blocks).otherwise(stated)

    return F.transform(F.array(F.split("content", "\n", -1)), of)[0]


def file_symbols(files: DataFrame) -> DataFrame:
    """path, language, exports and imports of files (path, language, content), all found in the file's own row.

    Write it once: every question about symbols is a join on it.
    """
    kept = files.filter(F.col("language").isNotNull() & F.col("content").isNotNull())
    return kept.select("path", "language", exports_of_content().alias("exports"), F.coalesce(imports_of_content(), F.array().cast("array<struct<n:int,name:string,local:string,kind:string>>")).alias("imports"))


def exports(symbols: DataFrame) -> DataFrame:
    """path, language, n, name, is_type, decorated and handed_on of every export."""
    return symbols.select("path", "language", F.explode("exports").alias("e")).select("path", "language", "e.*")


def imports(symbols: DataFrame) -> DataFrame:
    """path, language, n, name, local and kind of every import."""
    return symbols.select("path", "language", F.explode("imports").alias("i")).select("path", "language", "i.*")


def _asked_for(symbols: DataFrame) -> DataFrame:
    """path, language and names (distinct) by which a file asks for symbols: whole modules and packages by their local name."""
    name = lambda i: F.when(i["kind"].isin("module", "require", "package"), i["local"]).otherwise(i["name"])
    return symbols.select("path", "language", F.array_distinct(F.transform("imports", name)).alias("names")).filter(F.size("names") > 0)


#: How sure a finding is by language.
CONFIDENCE = {"python": 0.6, "go": 0.7, "csharp": 0.7}


#: Fixed value: what a recently added file adds to that.
RECENT = 0.05


def _confidence(recent: Column | None = None) -> Column:
    base = _by_language({x: F.lit(c) for x, c in CONFIDENCE.items()})
    sure = F.coalesce(base, F.lit(0.9))
    if recent is not None:
        sure = F.when(recent, F.round(F.least(F.lit(1.0), sure + RECENT), 2)).otherwise(sure)
    sure = F.when((F.col("language") == "python") & F.col("decorated"), 0.3).otherwise(sure)
    return F.when(F.col("is_type"), F.least(sure, F.lit(0.5))).otherwise(sure)


def recent_files(log: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """path of files that a log of commits (path, status, at) adds (status A) within `days` before the time `at`."""
    return log.filter((F.col("status") == "A") & (F.col("at") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("at") <= at)).select("path").distinct()


def dead_exports(symbols: DataFrame, reachable: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """path, language, n, name and confidence of exports outside tests that no file of the language imports.

    Files of `reachable` (path) are left alone; those of `recent` (path) are more likely leftovers, so surer by 0.05.
    """
    imported = _asked_for(symbols).select("language", F.explode("names").alias("name")).distinct()
    files = symbols.filter(F.col("language").isin("typescript", "python", "java") & ~is_test(F.col("path")) & ~is_entry_point(F.col("path")))
    if reachable is not None:
        files = files.join(reachable.select("path"), "path", "left_anti")
    files = files.withColumn("recent", F.lit(False)) if recent is None else files.join(recent.select("path").withColumn("recent", F.lit(True)), "path", "left")
    offered = files.select("path", "language", "recent", F.explode("exports").alias("e")).select("path", "language", "recent", "e.*")
    dead = offered.join(imported, ["language", "name"], "left_anti")
    return dead.select("path", "language", "n", "name", _confidence(F.coalesce("recent", F.lit(False))).alias("confidence"))


def dead_exports_by_words(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Go and C# exports whose name stands nowhere but in their own file, by word counts of the language's files."""
    offered = exports(symbols.filter(F.col("language").isin("go", "csharp") & ~is_test(F.col("path")) & ~is_entry_point(F.col("path"))))
    names = offered.select("language", F.col("name").alias("word")).distinct()
    said = files.filter(F.col("language").isin("go", "csharp")).select("path", "language", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    spread = said.join(names, ["language", "word"], "left_semi").groupBy("language", "word").agg(F.count("*").alias("n_files"), F.min("path").alias("path"))
    alone = spread.filter("n_files = 1").select("language", F.col("word").alias("name"), "path")
    return offered.join(alone, ["language", "name", "path"], "left_semi").select("path", "language", "n", "name", _confidence().alias("confidence"))


def specific(name: Column) -> Column:
    """Whether a name is particular enough to be no coincidence."""
    parts = F.size(F.filter(F.split(name, "_"), lambda p: p != ""))
    return F.when(name.rlike("[a-z][A-Z]") | (name.contains("_") & (parts >= 2)), F.length(name) >= 6).otherwise(F.length(name) >= 12)


def divergent_exports(symbols: DataFrame) -> DataFrame:
    """name, n_files and first_path of specific names that several files outside tests export; names handed on from another module do not count."""
    offered = exports(symbols.filter(~is_test(F.col("path")))).filter(specific(F.col("name")) & ~F.col("handed_on"))
    return offered.groupBy("name").agg(F.count_distinct("path").alias("n_files"), F.min("path").alias("first_path")).filter("n_files >= 2")


def fan_in(symbols: DataFrame) -> DataFrame:
    """path and fan_in of every file that exports: how many other files import one of its names.

    A dotted import counts by its last part too. Importers of a name are counted once, and a file with one imported name
    takes that count, less itself; only files with several imported names meet their importers one by one.
    """
    asked = _asked_for(symbols).select("path", F.explode("names").alias("name"))
    wanted = asked.select("path", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("name")).distinct()
    importers = wanted.groupBy("name").agg(F.count("*").alias("n"))
    offered = symbols.select("path", F.explode(F.array_distinct(F.transform("exports", lambda e: e["name"]))).alias("name"))
    own = wanted.withColumn("own", F.lit(1))
    met = offered.join(importers, "name").join(own, ["path", "name"], "left").groupBy("path")
    names = met.agg(F.count("*").alias("n_names"), F.first("name").alias("name"), F.sum(F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))
    several = offered.join(names.filter("n_names > 1").select("path"), "path", "left_semi")
    pairs = several.join(wanted.withColumnRenamed("path", "importer"), "name").filter("importer <> path").groupBy("path").agg(F.count_distinct("importer").alias("n"))
    counted = names.filter("n_names = 1").select("path", "n").union(pairs.select("path", "n"))
    files = symbols.filter(F.size("exports") > 0).select("path")
    return files.join(counted, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("fan_in"))


#: How implementations are written.
IMPLEMENTS = r"implements\s+([A-Za-z_$][\w$]*(?:\s*,\s*[A-Za-z_$][\w$]*)*)"
COLON = r"class\s+\w+\s*:\s*([A-Za-z_][\w]*(?:\s*,\s*[A-Za-z_][\w]*)*)"


def implemented(files: DataFrame) -> DataFrame:
    """language (of the file), interface and colon (whether a class names it after a colon) of every mention in files."""
    listed = lambda pattern: F.transform(F.flatten(F.transform(F.regexp_extract_all("content", F.lit(spaced(pattern)), F.lit(1)), lambda names: F.split(names, ","))), lambda name: trim_both(name))

    def told(pattern: str, colon: bool) -> Column:
        return F.transform(listed(pattern), lambda name: F.struct(name.alias("interface"), F.lit(colon).alias("colon")))

    some = files.filter(F.col("content").contains("implements") | F.col("content").contains("class"))
    return some.select("language", F.explode(F.concat(told(IMPLEMENTS, False), told(COLON, True))).alias("i")).select("language", "i.*")


def implementations(files: DataFrame) -> DataFrame:
    """interface and n_implementations by the `implements` clauses of files, and in C# by what stands after a class's colon."""
    return implemented(files).filter(~F.col("colon") | (F.col("language") == "csharp")).groupBy("interface").agg(F.count("*").alias("n_implementations"))


#: Functions whose whole body is one returned call, and what counts as a function.
PASS_THROUGH = r"(?:function\s+\w+\s*\([^)]*\)|(?:const|let|var)\s+\w+\s*=\s*(?:\([^)]*\)|[^=])\s*=>)\s*\{?\s*return\s+\w+[\w.]*\([^)]*\)\s*;?\s*\}?"
CONCISE_ARROW = r"(?:const|let|var)\s+\w+\s*=\s*(?:\([^)]*\)|\w+)\s*=>\s*\w+[\w.]*\([^)]*\)\s*;?"
GO_PASS_THROUGH = r"func\s+\w+\s*\([^)]*\)[^{]*\{\s*return\s+\w+\s*\([^)]*\)\s*\}"
ANY_FUNCTION = r"(?:function\s+\w+|=>\s*[{(]|=>\s*\w|\w+\s*\([^)]*\)\s*\{)"


def pass_throughs(files: DataFrame, importers: DataFrame, least: float = 0.5) -> DataFrame:
    """path, fan_in, n_pass and n_functions of files (path, language, content) with one or two importers whose functions
    mostly hand on to another. Tests are left out; `importers` is fan_in's result."""
    content = F.col("content")
    passing = F.when(F.col("language") == "go", F.regexp_count(content, F.lit(GO_PASS_THROUGH))).otherwise(F.regexp_count(content, F.lit(PASS_THROUGH)) + F.regexp_count(content, F.lit(CONCISE_ARROW)))
    counted = files.filter(~is_test(F.col("path")) & ~is_entry_point(F.col("path"))).withColumn("n_pass", passing.cast("long")).withColumn("n_functions", F.regexp_count(content, F.lit(ANY_FUNCTION)).cast("long"))
    met = counted.filter((F.col("n_pass") > 0) & (F.col("n_functions") > 0) & (F.col("n_pass") >= least * F.col("n_functions")))
    return met.join(importers.filter("fan_in BETWEEN 1 AND 2"), "path").select("path", "fan_in", "n_pass", "n_functions")
