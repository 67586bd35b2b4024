"""Projects by their manifests: languages, dependencies, those that nothing names, and outdated ones.

A project is a folder; a file belongs to every project at or above it. Manifests of five kinds become one long relation.
Dependency names meet sources by the word runs inside them: a name that stands in a text as a word brings each of its runs as
a whole run, so an equi-join on the longest run finds all texts that may hold it. A name that is one run is found by
that alone; longer ones (`@scope/name`, `left-pad`) are looked for in the texts that the join leaves, each read once
for all names asked of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.rule_catalog import MIGRATIONS
from srcloom.functions.textual import base_name, matches, trim_both
from srcloom.operators.modules import folder_of
from srcloom.operators.patterns import ECOSYSTEMS
from srcloom.sources.collect import skipped_folders
from srcloom.sources.corpora import language

#: Kinds of manifests in the order that names a project, and what each file says.
KINDS = ("npm", "go", "python", "csharp", "java")
GO_LINE = r"^([a-zA-Z][^\s]+)\s+(v[\d.]\S*)"
CSHARP_PACKAGE = r'<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?'
POM_ARTIFACT = r"<artifactId>([^<]+)</artifactId>"
CONFIG_NAMES = r"^(?:.*\.config\.(?:[cm]?[jt]s|json)|biome\.jsonc?|tsconfig.*\.json|\.eslintrc.*|\.prettierrc.*|\.babelrc.*)$"
#: Files that tell a language, in the root of a project and in folders right below it.
ROOT_MARKERS = {"typescript": ("package.json", "tsconfig.json"), "go": ("go.mod",), "python": ("requirements.txt", "pyproject.toml", "setup.py"), "java": ("pom.xml", "build.gradle")}
SUB_MARKERS = {"typescript": ("package.json",), "go": ("go.mod",), "python": ("requirements.txt", "pyproject.toml"), "java": ("pom.xml", "build.gradle")}
CSHARP_MARKER = r"\.(?:csproj|sln)$"
#: How deep and how many files are asked where no marker tells.
SAMPLE_DEPTH, SAMPLE_FILES = 5, 2000

_DEPENDENCY = "array<struct<field:string,name:string,version:string>>"
_NPM = "scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"


def _named(name: Column, version: Column | None = None, field: str = "") -> Column:
    return F.struct(F.lit(field).alias("field"), name.alias("name"), (F.lit(None).cast("string") if version is None else version).alias("version"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), trim_both)


def _npm(text: Column) -> Column:
    """Dependencies of a package.json by its three fields, null where it cannot be read."""
    package = F.from_json(text, _NPM)

    def of_field(field: str) -> Column:
        return F.transform(F.map_entries(F.coalesce(package[field], F.create_map().cast("map<string,string>"))), lambda e: _named(e["key"], e["value"], field))

    fields = [of_field(f) for f in ("dependencies", "devDependencies", "peerDependencies")]
    return F.when(F.get_json_object(text, "$").isNotNull(), F.concat(*fields))


def _go(text: Column) -> Column:
    return F.transform(F.filter(_lines(text), lambda x: x.rlike(GO_LINE)), lambda x: _named(F.element_at(F.split(F.regexp_extract(x, GO_LINE, 1), "/"), -1), F.regexp_extract(x, GO_LINE, 2)))


def _python(text: Column) -> Column:
    told = F.transform(_lines(text), lambda x: _named(trim_both(F.regexp_replace(x, r"[>=<!][\s\S]*$", "")), F.nullif(trim_both(F.regexp_extract(x, r"[>=<!]+([^>=<!]*)", 1)), F.lit(""))))
    return F.filter(told, lambda d: d["name"] != "")


def _csharp(text: Column) -> Column:
    names, versions = F.regexp_extract_all(text, F.lit(CSHARP_PACKAGE), F.lit(1)), F.regexp_extract_all(text, F.lit(CSHARP_PACKAGE), F.lit(2))
    return F.zip_with(names, versions, lambda n, v: _named(n, F.nullif(v, F.lit(""))))


def _java(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(POM_ARTIFACT), F.lit(1)), lambda x: _named(x))


def manifests(files: DataFrame) -> DataFrame:
    """project, kind and dependencies of every manifest of files (path, content): package.json, go.mod, requirements.txt,
    the first .csproj of a folder by name, pom.xml. Installed packages are no projects."""
    name, text = base_name(F.col("path")), F.col("content")
    kind = F.when(name == "package.json", "npm").when(name == "go.mod", "go").when(name == "requirements.txt", "python").when(name.endswith(".csproj"), "csharp").when(name == "pom.xml", "java")
    read = {"npm": _npm, "go": _go, "python": _python, "csharp": _csharp, "java": _java}
    listed = reduce(lambda a, k: a.when(F.col("kind") == k, read[k](text)), KINDS[1:], F.when(F.col("kind") == KINDS[0], read[KINDS[0]](text)))
    found = files.withColumn("kind", kind).filter(F.col("kind").isNotNull() & text.isNotNull() & ~F.col("path").rlike(r"(?:^|/)node_modules/"))
    told = found.select(folder_of(F.col("path")).alias("project"), "kind", F.struct("path", listed.cast(_DEPENDENCY).alias("dependencies")).alias("m")).filter("m.dependencies IS NOT NULL")
    return told.groupBy("project", "kind").agg(F.min_by("m.dependencies", "m.path").alias("dependencies"))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """project, kind, field, name, version and manifest (the project's first kind) of every dependency that a manifest names."""
    rows = manifests(files)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    first = rows.groupBy("project").agg(F.min_by("kind", rank).alias("manifest"))
    return rows.join(first, "project").select("project", "kind", "manifest", F.explode("dependencies").alias("d")).select("project", "kind", "d.field", "d.name", "d.version", "manifest")


def _projects_of(path: Column) -> Column:
    """Every folder at or above a file."""
    parts = F.split(folder_of(path), "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))


def _texts(files: DataFrame, projects: DataFrame) -> DataFrame:
    """path, projects and content of what may name a dependency: sources below a project, configurations and scripts in its root."""
    path, text, name = F.col("path"), F.col("content"), base_name(F.col("path"))
    source = language(path).isNotNull() & ~skipped_folders(path)
    config = name.rlike(CONFIG_NAMES) & ~skipped_folders(path)
    package = (name == "package.json") & ~skipped_folders(path)
    content = F.when(package, F.array_join(F.map_values(F.from_json(text, _NPM)["scripts"]), "\n")).otherwise(text)
    above = F.when(source, _projects_of(path)).when(config | package, F.array(folder_of(path)))
    kept = files.select("path", content.alias("content"), above.alias("above")).filter("above IS NOT NULL AND content IS NOT NULL")
    met = kept.select("path", F.explode("above").alias("project")).join(projects, "project").groupBy("path").agg(F.collect_set("project").alias("projects"))
    return kept.select("path", "content").join(met, "path")


_RUN = r"[A-Za-z0-9_]+"


def _named_in(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """project and token, once each, of tokens (project, token) that stand in a text of their project as words."""
    runs = F.regexp_extract_all("token", F.lit(_RUN), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    keyed = asked.distinct().withColumn("run", longest).withColumn("plain", F.col("run") == F.col("token")).filter("run <> ''")
    said = texts.select("path", "projects", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_RUN), F.lit(0)))).alias("run"))
    some = said.join(keyed.select("run").distinct(), "run", "left_semi").select("path", F.explode("projects").alias("project"), "run")
    met = some.join(keyed, ["project", "run"])
    whole = met.filter("plain").select("project", "token")
    asks = met.filter("NOT plain").groupBy("path").agg(F.collect_set(F.struct("project", "token")).alias("asks"))
    edge = lambda t, at, around: F.when(t.rlike(at), F.lit(around)).otherwise("")
    pattern = lambda t: F.concat(edge(t, r"^\w", r"(?<![0-9A-Za-z_])"), F.lit(r"\Q"), t, F.lit(r"\E"), edge(t, r"\w$", r"(?![0-9A-Za-z_])"))
    found = texts.select("path", "content").join(asks, "path").select(F.explode(F.filter("asks", lambda a: F.col("content").contains(a["token"]) & F.rlike("content", pattern(a["token"])))).alias("a"))
    return whole.union(found.select("a.project", "a.token")).distinct()


def _tokens(name: Column) -> Column:
    """What proves that a dependency is used: its name, or for typings the name of what they describe."""
    stem = F.substring(name, 8, 1 << 20)
    described = F.when(stem.contains("__"), F.concat(F.lit("@"), F.regexp_replace(stem, r"^(.*?)__", "$1/"))).otherwise(stem)
    return F.when(name.startswith("@types/"), F.array(name, described)).otherwise(F.array(name))


def unused_dependencies(files: DataFrame) -> DataFrame:
    """project, name and manifest of dependencies that no source, configuration or script of the project names, neither
    by their own name nor by a command they install (by the package.json that lies in node_modules)."""
    named = manifest_dependencies(files).select("project", "name", "manifest").distinct()
    texts = _texts(files, named.select("project").distinct())
    of_name = named.select("project", "name", F.explode(_tokens(F.col("name"))).alias("token"))
    place = r"^(?:(.*)/)?node_modules/((?:@[^/]+/)?[^/]+)/package\.json$"
    installed = files.filter(F.col("path").rlike(place)).select(
        F.regexp_extract("path", place, 1).alias("project"), F.regexp_extract("path", place, 2).alias("name"), F.from_json("content", "bin map<string,string>")["bin"].alias("many"), F.from_json("content", "bin string")["bin"].alias("one")
    )
    commands = F.when(F.col("many").isNotNull(), F.map_keys("many")).when(F.col("one").isNotNull(), F.array(F.element_at(F.split("name", "/"), -1)))
    of_bin = installed.select("project", "name", F.explode(commands).alias("token")).join(named.select("project", "name"), ["project", "name"], "left_semi")
    tokens = of_name.union(of_bin)
    used = tokens.join(_named_in(texts, tokens.select("project", "token")), ["project", "token"]).select("project", "name").distinct()
    return named.join(used, ["project", "name"], "left_anti")


def project_languages(files: DataFrame, projects: DataFrame) -> DataFrame:
    """project, language and told_by (marker or extension) of projects (project), by files (path).

    Markers are asked in the root and in folders right below it; where there are none, the first SAMPLE_FILES files by
    path, down to SAMPLE_DEPTH folders, tell by their extensions. That limit is the feature: a bounded look.
    """
    held = files.select("path", F.explode(_projects_of(F.col("path"))).alias("project")).join(projects.select("project").distinct(), "project")
    rest = F.when(F.col("project") == "", F.col("path")).otherwise(F.substring("path", F.length("project") + 2, 1 << 20))
    parts = held.select("project", "path", F.split(rest, "/").alias("parts")).withColumn("name", F.element_at("parts", -1)).withColumn("depth", F.size("parts") - 1)
    first = F.col("parts")[0]
    near = (F.col("depth") == 1) & ~first.startswith(".") & (first != "node_modules")

    def told(markers: dict[str, tuple[str, ...]]) -> Column:
        return reduce(lambda a, kv: a.when(F.col("name").isin(*kv[1]), kv[0]), markers.items(), F.when(F.col("name").rlike(CSHARP_MARKER), "csharp"))

    marked = parts.withColumn("language", F.when(F.col("depth") == 0, told(ROOT_MARKERS)).when(near, told(SUB_MARKERS))).filter("language IS NOT NULL").select("project", "language").distinct()
    plain = parts.filter((F.col("depth") <= SAMPLE_DEPTH) & ~F.exists("parts", lambda x: x.startswith(".")) & ~skipped_folders(F.col("path"))).join(marked.select("project").distinct(), "project", "left_anti")
    some = plain.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy("path"))).filter(F.col("k") <= SAMPLE_FILES)
    sampled = some.select("project", language(F.col("path")).alias("language")).filter("language IS NOT NULL").distinct()
    return marked.withColumn("told_by", F.lit("marker")).union(sampled.withColumn("told_by", F.lit("extension")))


#: How sure a finding is, by where it was seen.
MANIFEST, SOURCE, GO, CSHARP, JAVA = 0.9, 0.7, 0.7, 0.8, 0.75


def outdated_dependencies(files: DataFrame, projects: DataFrame) -> DataFrame:
    """project, ecosystem, old, new, severity, location and confidence of outdated dependencies and interfaces of projects
    (project): by their manifests, or by their sources where no manifest tells. Only languages of a project are asked."""
    asked = project_languages(files, projects).select("project", "language")
    name, text = base_name(F.col("path")), F.col("content")
    told = lambda m: F.struct(F.lit(m.ecosystem).alias("ecosystem"), F.lit(m.old).alias("old"), F.lit(m.new).alias("new"), F.lit(m.severity).alias("severity"))
    first = lambda m: m.old.split(" ")[0]
    names = lambda field: F.map_keys(F.coalesce(F.from_json(text, _NPM)[field], F.create_map().cast("map<string,string>")))
    npm = F.concat(*[names(f) for f in ("dependencies", "devDependencies", "peerDependencies")])
    lines = F.transform(_lines(text), F.lower)
    required = lambda d: F.exists(lines, lambda x: (x == d) | x.startswith(d + "==") | x.startswith(d + ">"))
    artifact = lambda m: m.old.split(".")[-1].split(" ")[0]

    def fired(ecosystem: str, test) -> Column:
        return F.array_compact(F.array(*[F.when(test(m), told(m)) for m in MIGRATIONS if m.ecosystem == ecosystem]))

    by_manifest = (
        F.when(name == "package.json", fired("javascript", lambda m: F.array_contains(npm, first(m))))
        .when(name == "requirements.txt", fired("python", lambda m: required(first(m).lower())))
        .when(name.endswith(".csproj"), fired("csharp", lambda m: text.rlike(rf"(?i)PackageReference\s+Include\s*=\s*[\"']{first(m)}[\"']")))
        .when(name == "pom.xml", fired("java", lambda m: text.rlike(rf"(?i)<artifactId>\s*{artifact(m)}\s*</artifactId>")))
        .when(name == "build.gradle", fired("java", lambda m: text.rlike(rf"(?i)implementation\s+['\"][^'\"]*:{artifact(m)}[^'\"]*['\"]")))
    )
    in_manifest = files.filter(~F.col("path").rlike("(?:^|/)node_modules/")).select(folder_of(F.col("path")).alias("project"), F.explode(by_manifest).alias("m")).select("project", "m.*", F.lit(True).alias("manifest"))
    of_language = {language_: ecosystem for ecosystem, language_ in ECOSYSTEMS.items()}
    by_source = reduce(lambda a, kv: a.when(F.col("language") == kv[0], fired(kv[1], lambda m: matches(text, m.pattern))), list(of_language.items())[1:], F.when(F.col("language") == "typescript", fired("javascript", lambda m: matches(text, m.pattern))))
    sources = files.withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() & ~skipped_folders(F.col("path")))
    seen = sources.select(F.explode(by_source).alias("m"), _projects_of(F.col("path")).alias("above")).select("m.*", F.explode("above").alias("project")).distinct()
    in_source = seen.select("project", "ecosystem", "old", "new", "severity", F.lit(False).alias("manifest"))
    met = in_manifest.union(in_source).groupBy("project", "ecosystem", "old", "new", "severity").agg(F.max("manifest").alias("manifest"))
    language_of = reduce(lambda a, kv: a.when(F.col("ecosystem") == kv[0], kv[1]), list(ECOSYSTEMS.items())[1:], F.when(F.col("ecosystem") == "javascript", "typescript"))
    kept = met.withColumn("language", language_of).join(asked, ["project", "language"], "left_semi")
    has_go = files.filter(base_name(F.col("path")) == "go.mod").select(folder_of(F.col("path")).alias("project"), F.lit(True).alias("go_mod")).distinct()
    kept = kept.join(has_go, "project", "left").filter("ecosystem <> 'go' OR go_mod")
    place = F.when(F.col("ecosystem") == "go", "go.mod").when(F.col("ecosystem").isin("csharp", "java"), "project").when(~F.col("manifest"), "source").when(F.col("ecosystem") == "javascript", "package.json").otherwise("requirements.txt")
    sure = F.when(F.col("ecosystem") == "go", GO).when(F.col("ecosystem") == "csharp", CSHARP).when(F.col("ecosystem") == "java", JAVA).when(F.col("manifest"), MANIFEST).otherwise(SOURCE)
    return kept.select("project", "ecosystem", "old", "new", "severity", place.alias("location"), sure.alias("confidence"))
