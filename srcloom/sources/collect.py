r"""Source files below a folder, walked by tasks: excluded folders are pruned before anything below them is listed.

`spark.read.format("source_tree")` is a Python data source. The driver lists only the first levels, until there are enough
folders to share out; each task then walks its own, reads nothing that the rules leave out, and follows links to files
(never to folders). Folders must be reachable by every executor under the same path, as with any file source.

Rows: path (relative to the root, forward slashes), size, content (null if it cannot be read as UTF-8 with errors
replaced) and skipped (null, or why a folder or file could not be looked into, so that nothing is lost in silence).
"""

from __future__ import annotations

import errno
import os
import re
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from srcloom.functions.textual import any_glob, glob_pattern, trim_both
from srcloom.sources.corpora import EXTENSIONS, LARGEST_FILE, language

#: Folders that hold no sources of a project, and errors that hide a part of the tree.
SKIPPED_FOLDERS = ("node_modules", ".git", "vendor", "dist", "build", ".next", "__pycache__", "obj", "bin", "target", ".gradle", "venv", ".venv", "coverage", "out", ".nyc_output", ".turbo", ".cache")
HIDING_ERRORS = ("EACCES", "EPERM", "EIO", "EMFILE", "ENFILE")
WORKTREE = "worktree"


def skipped_folders(path: Column) -> Column:
    """Whether a relative path lies in a folder that collection prunes."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.isin(*SKIPPED_FOLDERS) | x.startswith(".") | F.lower(x).contains(WORKTREE))


def ignore_patterns(entries: list) -> list[str]:
    """Globs of a user's ignore list: blanks, comments and `.` go, `./` and closing slashes go, a plain path also means all below it."""
    out: dict[str, None] = {}
    for raw in entries if isinstance(entries, list) else []:
        text = raw.strip() if isinstance(raw, str) else ""
        entry = "" if text.startswith("#") else re.sub(r"/+$", "", re.sub(r"^\./", "", text))
        if entry not in ("", "."):
            out[entry] = None
            if not re.search(r"[*?{}\[\]]", entry):
                out[f"{entry}/**"] = None
    return list(out)


def matching_files(files: DataFrame, globs: list[str]) -> DataFrame:
    """How many files (path) a list of globs matches by path or name, as one row (n)."""
    return files.agg(F.count_if(any_glob(F.col("path"), globs)).alias("n"))


class Walk:
    """The rules of a walk. Picklable, as tasks get it."""

    def __init__(self, root: str, globs: list[str], languages: list[str] | None, largest: int):
        self.root, self.largest = root.rstrip("/") or "/", largest
        self.excluded = [re.compile(glob_pattern(g)) for g in globs]
        self.extensions = tuple(e for x in (EXTENSIONS if languages is None else languages) for e in EXTENSIONS.get(x, ()))

    def _rel(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _kept(self, entry: os.DirEntry) -> bool:
        return not any(p.search(self._rel(entry.path)) or p.search(entry.name) for p in self.excluded)

    def _hidden(self, error: OSError, path: str) -> tuple[str, None, None, str] | None:
        code = errno.errorcode.get(error.errno or 0, "")
        return (self._rel(path), None, None, code) if code in HIDING_ERRORS else None

    def listed(self, folder: str, read: bool = True) -> tuple[list[str], list[tuple]]:
        """Folders below to walk, and rows of what lies in `folder` itself, if it is to be read."""
        below, rows = [], []
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            return below, [r for r in [self._hidden(e, folder)] if r]
        for entry in entries:
            is_folder = entry.is_dir(follow_symlinks=False)
            if is_folder and (entry.name.startswith(".") or entry.name in SKIPPED_FOLDERS or WORKTREE in entry.name.lower()) or not self._kept(entry):
                continue
            if is_folder:
                below.append(entry.path)
            elif read and os.path.splitext(entry.name)[1] in self.extensions:
                rows += self._file(entry)
        return below, rows

    def _file(self, entry: os.DirEntry) -> list[tuple]:
        try:
            facts = os.stat(entry.path)
            if not stat.S_ISREG(facts.st_mode) or facts.st_size > self.largest:
                return []
            with open(entry.path, "rb") as f:
                return [(self._rel(entry.path), facts.st_size, f.read().decode("utf-8", "replace"), None)]
        except OSError as e:
            hidden = None if entry.is_symlink() and e.errno == errno.ENOENT else self._hidden(e, entry.path)
            return [hidden] if hidden else []

    def below(self, folder: str) -> Iterator[tuple]:
        left = [folder]
        while left:
            folders, rows = self.listed(left.pop())
            yield from rows
            left += reversed(folders)


class _Share(InputPartition):
    def __init__(self, folders: list[str], rows: list[str]):
        self.folders, self.alone = folders, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        split = lambda name: [x for x in options.get(name, "").split("\n") if x]
        self.walk = Walk(options["path"], split("exclude"), split("languages") or None, int(options.get("largest", LARGEST_FILE)))
        self.shares = int(options.get("shares", 32))

    def partitions(self) -> list[InputPartition]:
        """Folders to walk, dealt out; levels are opened until there are enough of them. Those opened are listed alone."""
        opened, level = [], [self.walk.root]
        while level and len(level) < self.shares and len(opened) < 4 * self.shares:
            opened += level
            level = [f for folder in level for f in self.walk.listed(folder, False)[0]]
        shares: list[_Share] = [_Share([], []) for _ in range(max(1, min(self.shares, len(opened) + len(level))))]
        for k, folder in enumerate(opened):
            shares[k % len(shares)].alone.append(folder)
        for k, folder in enumerate(level):
            shares[k % len(shares)].folders.append(folder)
        return shares

    def read(self, partition: _Share) -> Iterator[tuple]:
        for folder in partition.alone:
            yield from self.walk.listed(folder)[1]
        for folder in partition.folders:
            yield from self.walk.below(folder)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size bigint, content string, skipped string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def collected(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None, largest: int = LARGEST_FILE, shares: int = 32) -> tuple[DataFrame, DataFrame]:
    """Source files below `root` (path, language, content) and what could not be looked into (path, code)."""
    spark.dataSource.register(SourceTree)
    rows = spark.read.format("source_tree").options(path=root, exclude="\n".join(exclude or []), languages="\n".join(languages or []), largest=str(largest), shares=str(shares)).load()
    files = rows.filter("skipped IS NULL").select("path", language(F.col("path")).alias("language"), "content")
    return files, rows.filter("skipped IS NOT NULL").select("path", F.col("skipped").alias("code"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """folder, rank, pattern, negated and folders_only of every rule of every .gitignore of files (path, content), in order.

    pattern is anchored below the folder where the rule holds a slash before its end, else it means any place below it.
    """
    lists = files.filter((F.col("path") == ".gitignore") | F.col("path").endswith("/.gitignore"))
    lines = lists.select(F.regexp_replace("path", r"/?\.gitignore$", "").alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("rank", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", r"(?<!\\)[ \t]+$", ""), r"\\([ #!])", "$1")
    rule = F.regexp_replace(F.when(F.col("raw").startswith("!"), F.substring(text, 2, 1 << 20)).otherwise(text), "^/", "")
    bare = F.regexp_replace(rule, "/$", "")
    kept = lines.filter(~F.col("raw").startswith("#") & (trim_both(F.col("raw")) != ""))
    anchored = F.regexp_replace(F.regexp_replace(text, "^!", ""), "/$", "").contains("/")
    return kept.select("folder", "rank", F.when(anchored, bare).otherwise(F.concat(F.lit("**/"), bare)).alias("glob"), F.col("raw").startswith("!").alias("negated"), rule.endswith("/").alias("folders_only"))


def _as_pattern(glob: Column) -> Column:
    """A gitignore glob as an anchored pattern: `**/`, `/**`, `*`, `?` and [sets]; all else stands for itself."""
    x = F.regexp_replace(glob, r"([.+^${}()|\\])", r"\\$1")
    for a, b in ((r"\[!", "[^"), (r"^\*\*/", "\u0001"), (r"/\*\*/", "\u0002"), (r"/\*\*$", "\u0003"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/(?:.*/)?"), ("\u0003", "/.+")):
        x = F.regexp_replace(x, a, b.replace("$", r"\$"))
    return F.concat(F.lit("^"), x, F.lit("$"))


def ignored_files(files: DataFrame, rule_files: DataFrame) -> DataFrame:
    """path of those of files (path) that the .gitignore files of rule_files (path, content) leave out.

    Every folder on the way to a file, and the file itself, is asked for the rules of all folders above it; the last
    rule of the deepest list that matches decides. An ignored folder takes all below it along, whatever rules say of that.
    """
    parts = F.split("path", "/")
    upto = lambda k: F.array_join(F.slice(parts, 1, k), "/")
    places = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(upto(k).alias("place"), (k < F.size(parts)).alias("is_folder")))).alias("p")).select("p.*").distinct()
    steps = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    asked = places.select("place", "is_folder", F.explode(above).alias("folder"))
    rules = ignore_rules(rule_files).withColumn("pattern", _as_pattern(F.col("glob")))
    listed = rules.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("rank", "pattern", "negated", "folders_only"))).alias("rules"))
    rest = F.when(F.col("folder") == "", F.col("place")).otherwise(F.substring("place", F.length("folder") + 2, 1 << 20))
    last = F.element_at(F.filter("rules", lambda r: (~r["folders_only"] | F.col("is_folder")) & F.rlike(rest, r["pattern"])), F.lit(-1))
    verdicts = asked.join(listed, "folder").select("place", F.length("folder").alias("depth"), F.when(F.size(F.filter("rules", lambda r: (~r["folders_only"] | F.col("is_folder")) & F.rlike(rest, r["pattern"]))) > 0, ~last["negated"]).alias("out")).filter("out IS NOT NULL")
    gone = verdicts.groupBy("place").agg(F.max_by("out", "depth").alias("out")).filter("out").select("place")
    ways = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), upto)).alias("place"))
    return ways.join(gone, "place", "left_semi").select("path").distinct()
