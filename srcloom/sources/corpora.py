"""Source files as DataFrames: from a folder of files, and rendered from the given tables.

`files` has a row for each file (path, content); `lines` a row for each line (path, language, n, line), n from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.functions.textual import base_name
from srcloom.sources import rendered
from srcloom.sources.tables import table

#: The extensions of each language, and folders that hold no sources of a project.
EXTENSIONS = {
    "typescript": (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"),
    "go": (".go",),
    "python": (".py",),
    "csharp": (".cs",),
    "java": (".java",),
}
LARGEST_FILE = 1_000_000

TEST_NAMES = r"\.test\.[jt]sx?$|\.spec\.[jt]sx?$|_test\.go$|test_.*\.py$|.*_test\.py$|.*Test\.java$|.*Tests\.java$|.*Tests\.cs$"


#: Names of files that a framework, a tool or a runtime enters by itself.
ENTRY_POINTS = (
    "index.js", "index.ts", "index.jsx", "index.tsx", "main.js", "main.ts", "main.go", "app.js", "app.ts", "server.js", "server.ts", "__init__.py", "__main__.py", "Program.cs", "Main.java",
    "page.js", "page.ts", "page.jsx", "page.tsx", "layout.js", "layout.ts", "layout.jsx", "layout.tsx", "loading.js", "loading.ts", "loading.jsx", "loading.tsx",
    "error.js", "error.ts", "error.jsx", "error.tsx", "not-found.js", "not-found.ts", "not-found.jsx", "not-found.tsx", "route.js", "route.ts", "middleware.js", "middleware.ts",
    "template.js", "template.ts", "template.jsx", "template.tsx", "app.vue", "root.tsx", "root.jsx", "entry.client.tsx", "entry.server.tsx",
    "+page.svelte", "+layout.svelte", "+server.ts", "+server.js", "cli.js", "cli.ts", "bin.js", "bin.ts", "mod.ts", "mod.js", "setup.py", "setup.cfg", "conftest.py",
    "_app.tsx", "_app.ts", "_app.jsx", "_app.js", "_document.tsx", "_document.ts", "_document.jsx", "_document.js", "_error.tsx", "_error.ts", "_error.jsx", "_error.js",
    "manage.py", "wsgi.py", "asgi.py", "Startup.cs", "Application.java", "global-error.tsx", "global-error.ts", "global-error.jsx", "global-error.js",
    "default.tsx", "default.ts", "default.jsx", "default.js", "instrumentation.ts", "instrumentation.js", "opengraph-image.tsx", "opengraph-image.ts", "opengraph-image.js",
    "twitter-image.tsx", "twitter-image.ts", "twitter-image.js", "sitemap.ts", "sitemap.js", "robots.ts", "robots.js", "manifest.ts", "manifest.js",
)


def is_entry_point(path: Column) -> Column:
    return base_name(path).isin(*ENTRY_POINTS)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """The language that a path's extension belongs to, else null."""
    out = None
    for name, extensions in EXTENSIONS.items():
        out = (F.when if out is None else out.when)(extension(path).isin(*extensions), name)
    return out


def is_test(path: Column) -> Column:
    return base_name(path).rlike(TEST_NAMES)


def files_of_folder(spark: SparkSession, folder: str, largest: int = LARGEST_FILE) -> DataFrame:
    """Sources below a folder, read in tasks. Larger files and other languages are left out before their bytes are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kept = found.filter((F.col("length") <= largest) & language(F.col("path")).isNotNull())
    return kept.select("path", F.decode("content", "UTF-8").alias("content"))


def lines_of(files: DataFrame) -> DataFrame:
    """path, language, n (from 1) and line of files; null content has no lines."""
    return files.filter("content IS NOT NULL").select("path", language(F.col("path")).alias("language"), F.posexplode(F.split("content", "\n", -1)).alias("p", "line")).select("path", "language", (F.col("p") + 1).alias("n"), "line")


def rendered_files(spark: SparkSession, folder: str, templates: list[rendered.Template]) -> DataFrame:
    """A rendered body of text as files: path, language (null for none) and content. They lie by path, so that windows by path move nothing.

    Rows of the tables move to their files and are rendered there."""
    tables = {name: table(spark, folder, name) for name in ("orders", "lineitem", "part")}
    rows = spark.sql(rendered.spark_rows(templates), **tables).repartition("path")
    lines = rows.select("path", F.expr(rendered.spark_lines(templates)).alias("lines"))
    gathered = lines.groupBy("path").agg(F.array_join(F.sort_array(F.flatten(F.collect_list("lines")))["line"], "\n").alias("content"))
    return gathered.select("path", language(F.col("path")).alias("language"), "content")


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """The code corpus: a file for every order and part, and the sources of projects."""
    return rendered_files(spark, folder, rendered.CODE)


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """What projects of the code corpus hold beside sources: manifests, configurations and rules."""
    return rendered_files(spark, folder, rendered.PROJECT_FILES).select("path", "content")


def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The code corpus as lines."""
    return lines_of(code_files(spark, folder))


def prose_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: path from source and id."""
    docs = table(spark, folder, "documents")
    return docs.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


#: Findings of a scan: one for each line of an order, in SQL that both engines run.
FINDINGS = """
SELECT CAST(l_orderkey % 7 AS BIGINT) AS run_id,
       CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord,
       CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'pattern' WHEN 1 THEN 'dead-export' WHEN 2 THEN 'metrics' WHEN 3 THEN 'toctou' ELSE 'duplicate' END AS check_name,
       CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
       CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'R' THEN 'style' ELSE 'dead-code' END AS category,
       CASE CAST(l_orderkey % 9 AS INT) WHEN 0 THEN 'fixed' WHEN 1 THEN 'ignored' WHEN 2 THEN 'false-positive' WHEN 3 THEN 'stale' WHEN 4 THEN 'in-progress' ELSE 'open' END AS status,
       CASE WHEN l_linestatus = 'O' THEN 'typescript' ELSE 'common' END AS language,
       CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 10 END AS confidence,
       CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN false ELSE true END AS fixable,
       'src/file' || CAST(l_suppkey AS STRING) || '.ts' AS file,
       'part ' || CAST(l_partkey % 50 AS STRING) AS description,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'symbol' || CAST(l_partkey % 20 AS STRING) END AS symbol,
       CAST(l_orderkey AS BIGINT) AS order_key, CAST(l_linenumber AS INT) AS line_number
FROM {lineitem}
"""


def findings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(FINDINGS, lineitem=table(spark, folder, "lineitem"))
