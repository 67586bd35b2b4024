"""Which files a module specifier means, and files that are reached without any of their names being imported.

A specifier has an ordered list of base paths (relative to its file, or by the path aliases of the nearest configuration
above it), each base an ordered list of places to look (as it stands, with each extension, as a folder's index). Places
meet the paths of the corpus in an equi-join, and the first that exists is the one meant. Specifiers with equal bases
are asked once, so a module that every file loads is one row of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.sources.corpora import EXTENSIONS

#: Extensions in the order tried, and what hands on or loads a whole module.
TRIED = EXTENSIONS["typescript"]
SOURCE_EXTENSION = r"\.(?:m|c)?[jt]sx?$"
STAR_EXPORT = r"""export\s+\*(?:\s+as\s+[A-Za-z_$][\w$]*)?\s+from\s+["'`]([^"'`]+)["'`]"""
DYNAMIC_IMPORT = r"""(?<![0-9A-Za-z_])import\s*\(\s*["'`]([^"'`]+)["'`]\s*\)"""

_ROOT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*"
_JSON_QUOTED_OR_COMMENT = r"""(?:"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z))"""
_OPTIONS = "struct<baseUrl:string,paths:map<string,array<string>>>"


def normal(path: Column) -> Column:
    """A path without `.`, `..` and empty parts; what stands before its first part stays."""
    step = lambda kept, x: F.when(x.isin("", "."), kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    parts = F.split(F.regexp_replace(path, _ROOT, ""), "/")
    return F.concat(F.regexp_extract(path, _ROOT, 0), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _below(folder: Column, rest: Column) -> Column:
    return normal(F.when(rest.startswith("/") | (folder == ""), rest).otherwise(F.concat(folder, F.lit("/"), rest)))


def plain_json(text: Column) -> Column:
    """JSON without the comments and trailing commas that configurations may hold; strings stay as they are."""
    pieces, found = F.split(text, _JSON_QUOTED_OR_COMMENT, -1), F.regexp_extract_all(text, F.lit(_JSON_QUOTED_OR_COMMENT), F.lit(0))
    kept = F.transform(found, lambda x: F.when(x.startswith('"'), x).otherwise(""))
    joined = F.array_join(F.zip_with(pieces, kept, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(joined, r",(\s*[}\]])", "$1")


def alias_rules(configs: DataFrame) -> DataFrame:
    """folder and rules (pattern and target bases, in order) of every tsconfig.json of files (path, content) that has path aliases.

    One level of `extends` is followed, where it is one path; the extending file's options and paths win. What cannot be
    read has no rules.
    """
    read = configs.select("path", folder_of(F.col("path")).alias("folder"), F.from_json(plain_json(F.col("content")), f"extends string, compilerOptions {_OPTIONS}").alias("c"))
    named = F.when(F.col("c.extends").endswith(".json"), F.col("c.extends")).otherwise(F.concat("c.extends", F.lit(".json")))
    own = read.filter(F.element_at(F.split("path", "/"), -1) == "tsconfig.json").select("folder", F.col("c.compilerOptions").alias("o"), F.when(F.col("c.extends").rlike(r"^[^\[{]"), _below(F.col("folder"), named)).alias("base"))
    bases = read.select(F.col("path").alias("base"), F.col("c.compilerOptions").alias("b"))
    met = own.join(bases, "base", "left")
    empty = F.create_map().cast("map<string,array<string>>")
    mine, theirs = F.coalesce("o.paths", empty), F.coalesce("b.paths", empty)
    keys = F.array_union(F.map_keys(theirs), F.map_keys(mine))
    root = _below(F.col("folder"), F.coalesce("o.baseUrl", "b.baseUrl", F.lit(".")))
    rule = lambda k: F.struct(k.alias("pattern"), F.coalesce(F.element_at(mine, k), F.element_at(theirs, k)).alias("targets"))
    rules = met.select("folder", root.alias("root"), F.filter(F.transform(keys, rule), lambda r: r["targets"].isNotNull()).alias("rules"))
    return rules.filter(F.size("rules") > 0)


def _alias_bases(spec: Column, root: Column, rules: Column) -> Column:
    """Base paths of a specifier by every rule whose pattern it matches, in order."""
    star = lambda r: r["pattern"].contains("*")
    before, after = lambda r: F.regexp_extract(r["pattern"], r"^([^*]*)", 1), lambda r: F.regexp_replace(r["pattern"], r"^[^*]*\*", "")
    wild = lambda r: star(r) & (F.length(spec) >= F.length(before(r)) + F.length(after(r))) & spec.startswith(before(r)) & spec.endswith(after(r))
    caught = lambda r: F.substring(spec, F.length(before(r)) + 1, F.length(spec) - F.length(before(r)) - F.length(after(r)))
    fits = F.filter(rules, lambda r: wild(r) | (~star(r) & (r["pattern"] == spec)))
    return F.flatten(F.transform(fits, lambda r: F.transform(F.filter(r["targets"], lambda t: t.isNotNull()), lambda t: _below(root, F.when(star(r), F.replace(t, F.lit("*"), caught(r))).otherwise(t)))))


def _nearest(folders: DataFrame, rules: DataFrame) -> DataFrame:
    """folder, root and rules of the deepest configuration at or above each folder."""
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asked = folders.select("folder", F.explode(F.array_distinct(above)).alias("at"))
    met = asked.join(rules.withColumnRenamed("folder", "at"), "at")
    return met.groupBy("folder").agg(F.max_by(F.struct("root", "rules"), F.length("at")).alias("c")).select("folder", "c.*")


def specifiers(files: DataFrame) -> DataFrame:
    """folder and spec, once each, of modules that TypeScript files (path, language, content) hand on whole or load while running."""
    some = files.filter((F.col("language") == "typescript") & (F.col("content").contains("export") | F.col("content").contains("import")))
    found = F.concat(F.regexp_extract_all("content", F.lit(STAR_EXPORT), F.lit(1)), F.regexp_extract_all("content", F.lit(DYNAMIC_IMPORT), F.lit(1)))
    return some.select(folder_of(F.col("path")).alias("folder"), F.explode(found).alias("spec")).distinct()


def resolved(specs: DataFrame, paths: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """folder, spec and path of the file that each specifier means; those that mean none are left out."""
    bare = lambda bases: F.transform(F.filter(bases, lambda b: b.rlike(SOURCE_EXTENSION)), lambda b: F.regexp_replace(b, SOURCE_EXTENSION, ""))
    both = lambda bases: F.transform(F.array(bases), lambda b: F.concat(b, bare(b)))[0]
    near = specs.filter(F.col("spec").startswith(".")).select("folder", "spec", both(F.array(_below(F.col("folder"), F.col("spec")))).alias("bases"))
    if rules is not None:
        far = specs.filter(~F.col("spec").startswith("."))
        known = far.join(_nearest(far.select("folder").distinct(), rules), "folder")
        near = near.union(known.select("folder", "spec", both(_alias_bases(F.col("spec"), F.col("root"), F.col("rules"))).alias("bases")).filter(F.size("bases") > 0))
    places = lambda b: F.concat(F.array(b), *[F.array(F.concat(b, F.lit(e))) for e in TRIED], *[F.array(F.concat(b, F.lit(f"/index{e}"))) for e in TRIED])
    asked = near.select("bases").distinct().select("bases", F.posexplode(F.flatten(F.transform("bases", places))).alias("rank", "path"))
    first = asked.join(paths.select("path").distinct(), "path").groupBy("bases").agg(F.min_by("path", "rank").alias("path"))
    return near.join(first, "bases").select("folder", "spec", "path")


def reachable_files(files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """path of files that an `export *` or a dynamic import reaches, so that all their names may be used; configs: files
    (path, content) that may be configurations with path aliases."""
    return resolved(specifiers(files), files, None if configs is None else alias_rules(configs)).select("path").distinct()
