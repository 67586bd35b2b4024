"""Line deduplication with levelled sorted runs of line hashes. DataFrame functions only.

Documents are dealt into batches by their id, and the keys of their lines are written in one folder for each batch. A
run is a table of keys sorted by (hi, lo), with how many documents of the batches so far hold the key and the largest of
them. Each batch is reduced to one row a key and merge-joined with the runs: known keys take their tally along and add
to it, keys that no run holds come in by the anti-join (the rows without a match), and the batch's rows become a run of
level 0. Runs are bucketed and sorted by key, so a merge moves the new batch's keys only and no run. A key's newest run is the one that counts. When a level has `fan_in` runs they are compacted into one run of the next
level, newer ones anti-joining older ones, so that later batches meet few runs. At the end the runs themselves are the
verdict: nothing is counted again.

Text crosses the network at most once (the join of documents with their lists of dropped keys); everything else moves
128-bit hashes. Keys held by many documents are counted by partial aggregation. On the way back to their documents keys
with at least a HOT_SHARE of all lines are joined by broadcast, being fewer than 1 / HOT_SHARE by that bound (64 bytes
each), and all others by sorting, where none fills a task.

Null or empty text is one empty line. A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z in
lower case; keys under `least_chars` code points are never dropped. A doc_id that occurs in several rows counts as one
document, and each of its rows is returned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import bucketed, even_partitions, shared_folder, written
from srcloom.llm.skew import HOT_SHARE, joined

#: Fixed values of the contract.
SPACE = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5

#: Documents that a batch should hold, the fewest and most batches, and runs of a level before it is compacted.
BATCH_DOCS, LEAST_BATCHES, MOST_BATCHES, FAN_IN = 20_000_000, 6, 24, 3
#: Lines of a batch for each bucket of its run, and the fewest buckets.
BUCKET_LINES, LEAST_BUCKETS = 500_000, 8


def lower_ascii(x: Column) -> Column:
    """A-Z in lower case and nothing else; the built-in is exact, and quicker, where all characters are ASCII."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(line: Column, least_chars: int) -> Column:
    """The 128-bit hash of a line's key as a struct, null for keys that are too short."""
    trimmed = F.btrim(line, F.lit(SPACE))
    key = lower_ascii(trimmed)
    return F.when(F.length(trimmed) >= least_chars, F.struct(F.xxhash64(key).alias("hi"), F.xxhash64(F.lit(1), key).alias("lo")))


KEY = ("hi", "lo")


def superseded(newer: DataFrame, older: DataFrame) -> DataFrame:
    """One run of both: the newer one's rows, and those of the older one whose keys the newer one lacks."""
    return newer.unionByName(older.join(newer.select(*KEY), list(KEY), "left_anti"))


class LineRuns:
    """Sorted runs of (hi, lo, n_docs, last_doc) in levels, newest first, as tables in the shared folder.

    All runs have the same buckets of (hi, lo), so that joins among them, and with a batch, move no run.
    """

    def __init__(self, fan_in: int = FAN_IN, buckets: int = 8):
        self.fan_in, self.buckets = fan_in, buckets
        self.levels: list[list[DataFrame]] = []
        self.compactions = 0

    def newest(self) -> DataFrame | None:
        """The newest row of each key, over all runs."""
        runs = [run for level in self.levels for run in level]
        return reduce(superseded, runs) if runs else None

    def add(self, lines: DataFrame) -> None:
        """Adds one batch of (hi, lo, doc_id), whose documents no other batch holds."""
        run = lines.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        seen = self.newest()
        if seen is not None:
            known = seen.select(*KEY, F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last"))
            merged = run.join(known, list(KEY), "left")  # rows without a match are new keys
            run = merged.select(*KEY, (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "_last").alias("last_doc"))
        self._place(self._stored(run), 0)

    def _stored(self, run: DataFrame) -> DataFrame:
        return bucketed(run.repartition(self.buckets, *KEY), "run", KEY, self.buckets, KEY)

    def _place(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].insert(0, run)
        if len(self.levels[level]) >= self.fan_in:
            merged = reduce(superseded, self.levels[level])
            self.levels[level] = []
            self.compactions += 1
            self._place(self._stored(merged), level + 1)


def keyed_lines(docs: DataFrame, least_chars: int, batches: int) -> DataFrame:
    """batch, hi, lo and doc_id of every line whose key is long enough, written by batch."""
    spark = docs.sparkSession
    hashes = F.filter(F.transform(lines_of(F.col("text")), lambda x: _hashes(x, least_chars)), lambda x: x.isNotNull())
    keyed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", F.explode(hashes).alias("key")).select("batch", "key.hi", "key.lo", "doc_id")
    path = f"{shared_folder(spark)}/srcloom-lines-{uuid.uuid4().hex}"
    keyed.write.partitionBy("batch").parquet(path)
    return spark.read.schema("hi long, lo long, doc_id long, batch int").parquet(path)


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """`docs` with text replaced by its kept lines, and n_lines (before) and n_dropped; columns of these names are replaced."""
    docs = docs.drop("n_lines", "n_dropped", "_goes", "_lines", "_kept")
    batches = batches or min(MOST_BATCHES, even_partitions(docs.count(), BATCH_DOCS, LEAST_BATCHES))
    lines = keyed_lines(docs, least_chars, batches)
    runs = LineRuns(fan_in, even_partitions(lines.count() // batches, BUCKET_LINES, LEAST_BUCKETS))
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select("hi", "lo", "doc_id"))
    goes = written(runs.newest().filter(F.col("n_docs") >= least_docs).select(*KEY, "n_docs", "last_doc"), "verdicts")
    found = joined(lines.select(*KEY, "doc_id"), goes, list(KEY), "n_docs", lines.count(), HOT_SHARE)
    dropped = found.filter(F.col("doc_id") < F.col("last_doc")).groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("_goes"))
    split = docs.join(dropped, "doc_id", "left").withColumn("_lines", lines_of(F.col("text")))
    kept = F.filter("_lines", lambda x: ~F.coalesce(F.array_contains("_goes", _hashes(x, least_chars)), F.lit(False)))
    split = split.withColumn("_kept", F.when(F.col("_goes").isNull(), F.col("_lines")).otherwise(kept))
    return split.select(
        *[F.when(F.col("_goes").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of the kept text."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), tallies AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < t.last_doc, false) AS dropped
  FROM keyed k LEFT JOIN tallies t ON k.key = t.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
