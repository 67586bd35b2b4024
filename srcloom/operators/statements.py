r"""Import statements of whole files, over several lines too, and imports that a file does not use.

A file's content is one row, and all work stays in that row: its statements are the matches of one pattern a language,
their lines are counted from the text between the matches, and use is asked of the text that follows. Nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.textual import trim_both
from srcloom.sources.corpora import is_test

_NAME = r"[A-Za-z_$][\w$]*+"
#: What an import statement looks like.
STATEMENTS = {
    "typescript": rf"(?:\b(?:import|export)\s+(?:type\s+)?\{{[^}}]+\}}\s+from|^[^\S\n]*import\s+{_NAME}\s*,\s*\{{[^}}]+\}}\s+from|^[^\S\n]*import\s+(?:\*\s+as\s+)?{_NAME}\s+from|\b(?:const|let|var)\s+(?:\{{[^}}]+\}}|{_NAME})\s*=\s*require\s*\()",
    "python": r"^[^\S\n]*(?:from[^\S\n]+\S+[^\S\n]+import[^\S\n]+(?:\([^)]*\)|(?:[^\n\\]|\\\n)*+)|import[^\S\n]+[^\n]+)",
    "go": r'^[^\S\n]*import(?:[^\S\n]*\([^)]*\)|\s+(?:[A-Za-z_.]\w*\s+)?"[^"\n]+")',
    "java": r"^[^\S\n]*import\s+(?:static\s+)?[\w.]+\s*;",
    "csharp": r"^[^\S\n]*using\s+(?:[A-Za-z_]\w*\s*=[^\n]*|[\w.]+\s*;)",
}
_GO_LINE = r'^[^\S\n]*(?:import\s+)?(?:([A-Za-z_.]\w*)\s+)?"([^"\n]+)"'
_TS_QUOTED_OR_COMMENT = r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|//[^\n]*+|/\*[\s\S]*?\*/)"""

_SYMBOL = "array<struct<name:string,local:string,kind:string,at:int,rest_of_line:boolean>>"


def _newlines(x: Column) -> Column:
    return F.regexp_count(x, F.lit("\n"))


def without_comments(content: Column) -> Column:
    """TypeScript text whose comments are blank; lines and strings stay."""
    pieces, found = F.split(content, _TS_QUOTED_OR_COMMENT, -1), F.regexp_extract_all(content, F.lit(_TS_QUOTED_OR_COMMENT), F.lit(0))
    kept = F.transform(found, lambda x: F.when(x.startswith("//") | x.startswith("/*"), F.repeat(F.lit("\n"), _newlines(x))).otherwise(x))
    return F.array_join(F.zip_with(pieces, kept, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _symbol(name: Column, local: Column, kind: str, at: Column | None = None, rest_of_line: bool = False) -> Column:
    """`at`: lines after the statement's first one. `rest_of_line`: whether use may stand on the statement's last line."""
    at = F.lit(0) if at is None else at
    return F.struct(name.alias("name"), local.alias("local"), F.lit(kind).alias("kind"), at.cast("int").alias("at"), F.lit(rest_of_line).alias("rest_of_line"))


def _listed(text: Column, kind: str, rest_of_line: bool = False) -> Column:
    """Symbols of a comma list, by what stands before and after `as`, without a leading `type`."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[()\\]", " "), ","), lambda s: F.regexp_replace(trim_both(s), r"^type\s+", ""))
    some = F.filter(parts, lambda s: (s != "") & (s != "*"))
    return F.transform(some, lambda s: _symbol(F.regexp_replace(s, r"\s+as\s+[\s\S]*$", ""), F.regexp_replace(s, r"^[\s\S]*\s+as\s+", ""), kind, None, rest_of_line))


def _one(name: Column, kind: str) -> Column:
    return F.array(_symbol(name, name, kind))


def _parsed(language: str, statement: Column) -> Column:
    group = lambda pattern, k=1: F.regexp_extract(statement, pattern, k)
    nothing = F.array().cast(_SYMBOL)
    if language == "typescript":
        braces, first = group(r"\{([^}]+)\}"), group(rf"^\s*(?:import|const|let|var)\s+(?:\*\s+as\s+)?({_NAME})")
        required = F.transform(F.filter(F.transform(F.split(braces, ","), trim_both), lambda s: s != ""), lambda s: _symbol(trim_both(F.regexp_replace(s, r":[\s\S]*$", "")), trim_both(F.regexp_replace(s, r"^[^:]*:|^[\s\S]*\s+as\s+", "")), "require"))
        return (
            F.when(statement.rlike(r"^export"), _listed(braces, "re-export"))
            .when(statement.rlike(r"require\s*\($"), F.when(braces != "", required).otherwise(_one(first, "require")))
            .when(statement.rlike(r"^\s*import\s+\*"), _one(first, "star"))
            .when(statement.rlike(r"^\s*import\s+(?:type\s+)?\{"), _listed(braces, "named", True))
            .when(braces != "", F.concat(_one(first, "mixed-default"), _listed(braces, "named")))
            .otherwise(_one(first, "default"))
        )
    if language == "python":
        return F.when(statement.rlike(r"^\s*from\b"), _listed(group(r"^\s*from\s+\S+\s+import\s+([\s\S]*)$"), "named")).otherwise(_listed(group(r"^\s*import\s+([\s\S]*)$"), "module"))
    if language == "go":
        last = lambda x: F.element_at(F.split(F.regexp_extract(x, _GO_LINE, 2), "/"), -1)
        alias = lambda x: F.regexp_extract(x, _GO_LINE, 1)
        lines = F.transform(F.split(F.regexp_replace(statement, r"^[^\S\n]*import[^\S\n]*\(", ""), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.transform(F.filter(lines, lambda y: y["x"].rlike(_GO_LINE)), lambda y: _symbol(last(y["x"]), F.when(alias(y["x"]) != "", alias(y["x"])).otherwise(last(y["x"])), "package", y["i"]))
    if language == "java":
        return _one(F.element_at(F.split(group(r"import\s+(?:static\s+)?([\w.]+)"), r"\."), -1), "class")
    if language == "csharp":
        alias = group(r"using\s+([A-Za-z_]\w*)\s*=")
        return F.when(alias != "", _one(alias, "alias")).otherwise(_one(group(r"using\s+([\w.]+)"), "namespace"))
    return nothing


def _found(language: str, with_use: bool) -> Column:
    """The symbols that a content of one language imports, as structs; `used` only if it is asked for."""
    pattern = "(?m)" + STATEMENTS[language]
    text = without_comments(F.col("content")) if language == "typescript" else F.col("content")

    def symbols(whole: Column) -> Column:
        pieces, found = F.split(whole, pattern, -1), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        both = F.zip_with(pieces, found, lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))
        return F.transform(F.array(both), lambda parts: F.flatten(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, k: of_statement(parts, p, k))))[0]

    def of_statement(parts: Column, p: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda n, q: n + _newlines(q["a"]) + _newlines(q["b"])) + _newlines(p["a"])
        lead = _newlines(F.regexp_extract(p["b"], r"^\s*", 0))
        rest = F.array_join(F.transform(F.slice(parts, k + 2, F.size(parts)), lambda q: F.concat(q["a"], q["b"])), "")
        # what a Go block lists after a symbol follows it, too
        lines_after = lambda s: F.array_join(F.slice(F.split(p["b"], "\n"), s["at"] + 2, 1 << 30), "\n")
        next_line = F.regexp_replace(rest, r"^[^\n]*\n?", "")

        def told(s: Column) -> Column:
            known = [(before + lead + s["at"] + 1).alias("n"), s["name"].alias("name"), s["local"].alias("local"), s["kind"].alias("kind")]
            if not with_use:
                return F.struct(*known)
            follows = F.when(s["rest_of_line"], rest).otherwise(F.concat(lines_after(s), F.lit("\n"), next_line) if language == "go" else next_line)
            # the name has to stand there at all before a pattern looks for it as a word
            used = follows.contains(s["local"]) & F.rlike(follows, F.concat(F.lit(r"(?<![0-9A-Za-z_])\Q"), s["local"], F.lit(r"\E(?![0-9A-Za-z_])")))
            return F.struct(*known, used.alias("used"))

        return F.transform(_parsed(language, p["b"]), told)

    return F.transform(F.array(text), symbols)[0]


#: Words without which no statement of a language stands in a text.
_HOLDS = {"typescript": ("import", "export", "require"), "python": ("import",), "go": ("import",), "java": ("import",), "csharp": ("using",)}


def imports_of_content(with_use: bool = False) -> Column:
    """The imports of a row (language, content): an array of n, name, local, kind and, if asked for, used."""
    out = None
    for language in STATEMENTS:
        holds = reduce(lambda a, w: a | F.col("content").contains(w), _HOLDS[language], F.lit(False))
        out = (F.when if out is None else out.when)((F.col("language") == language) & holds, _found(language, with_use))
    return F.filter(out, lambda s: s["local"] != "")


def import_symbols(files: DataFrame) -> DataFrame:
    """path, language, n (line of the symbol's statement, or of itself in a Go block), name, local, kind and used (whether
    the local name stands after the statement) of every import of files (path, language, content)."""
    return files.select("path", "language", F.explode(imports_of_content(True)).alias("s")).select("path", "language", "s.*")


#: Kinds of imports whose use is not asked: names handed on, and forms that the check leaves alone.
NOT_ASKED = ("re-export", "star", "require", "mixed-default", "module", "alias", "namespace")


def unused_imports(files: DataFrame) -> DataFrame:
    """path, language, n and name (the local one) of imports that a file outside tests does not use after them. A name
    imported again in TypeScript counts once; Go's `_` and `.` and all of C# are left out."""
    asked = import_symbols(files.filter(~is_test(F.col("path")))).filter(~F.col("kind").isin(*NOT_ASKED) & ~F.col("local").isin("_", "."))
    return asked.filter(~F.col("used")).select("path", "language", "n", F.col("local").alias("name"))
