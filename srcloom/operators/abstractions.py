"""Abstractions that few files need: classes with one method, interfaces with one implementation.

Only files of typed object languages with one or two importers are asked, tests and entry points left out. Class bodies
are cut where their braces close, in the row that holds the file; interfaces meet `implements` clauses of all files by
name, counted before the join, so a name that everything implements is one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.textual import spaced
from srcloom.operators.symbols import implemented
from srcloom.sources.corpora import is_entry_point, is_test

#: How classes, their methods and interfaces are written.
CLASS = r"class\s+([A-Za-z_$][A-Za-z0-9_$]*)"
METHOD = r"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*([A-Za-z_$][A-Za-z0-9_$]*)\s*\("
INTERFACE = r"interface\s+([A-Za-z_$][A-Za-z0-9_$]*)"
LANGUAGES = ("typescript", "java", "csharp")


def class_body(text: Column) -> Column:
    """From the first { of a text to the } that closes it; { alone where none does, null where there is no {."""
    pieces = F.split(F.regexp_replace(text, r"^[^{]*", ""), r"(?<=[{}])", -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        going = ~state["closed"]
        return F.struct(F.when(going, depth).otherwise(state["depth"]).alias("depth"), F.when(going, state["n"] + 1).otherwise(state["n"]).alias("n"), (state["closed"] | (depth == 0)).alias("closed"))

    def cut(parts: Column) -> Column:
        return F.transform(F.array(F.aggregate(parts, start, step)), lambda end: F.array_join(F.slice(parts, 1, F.when(end["closed"], end["n"]).otherwise(1)), ""))[0]

    return F.when(text.contains("{"), F.transform(F.array(pieces), cut)[0])


def _asked(files: DataFrame, importers: DataFrame) -> DataFrame:
    kept = files.filter(F.col("language").isin(*LANGUAGES) & ~is_test(F.col("path")) & ~is_entry_point(F.col("path")) & F.col("content").isNotNull())
    return kept.join(importers.filter("fan_in BETWEEN 1 AND 2"), "path", "left_semi")


def single_method_classes(files: DataFrame, importers: DataFrame) -> DataFrame:
    """path, symbol and method of classes with one method besides the constructor; files has path, language and content,
    importers is fan_in's result. A class without braces has no methods."""
    pattern = spaced(CLASS)
    parts = _asked(files, importers).filter(F.col("content").contains("class")).select(
        "path", F.split("content", pattern, -1).alias("after"), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("heads"), F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("names")
    )
    later = lambda k: F.array_join(F.zip_with(F.concat(F.array(F.lit("")), F.slice("heads", k + 2, F.size("heads"))), F.slice("after", k + 2, F.size("after")), lambda h, t: F.concat(h, t)), "")
    bodies = F.transform("names", lambda name, k: F.struct(name.alias("symbol"), F.transform(F.array(later(k)), class_body)[0].alias("body")))
    classes = parts.select("path", F.explode(bodies).alias("c")).select("path", "c.*")
    methods = F.filter(F.regexp_extract_all("body", F.lit("(?m)" + spaced(METHOD)), F.lit(1)), lambda m: m != "constructor")
    return classes.withColumn("methods", methods).filter(F.size("methods") == 1).select("path", "symbol", F.col("methods")[0].alias("method"))


def single_implementation_interfaces(files: DataFrame, importers: DataFrame) -> DataFrame:
    """path and symbol of interfaces that one `implements` clause of all files names; C# interfaces count what stands
    after a class's colon, too."""
    offered = _asked(files, importers).select("path", "language", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(spaced(INTERFACE)), F.lit(1)))).alias("symbol"))
    counted = implemented(files).groupBy(F.col("interface").alias("symbol")).agg(F.count_if(~F.col("colon")).alias("clauses"), F.count_if("colon").alias("colons"))
    total = F.col("clauses") + F.when(F.col("language") == "csharp", F.col("colons")).otherwise(0)
    return offered.join(counted, "symbol").filter(total == 1).select("path", "symbol")
