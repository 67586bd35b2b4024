"""Findings of runs: identity, scores, merging of scans, patches, and the questions asked of them.

Every function is DataFrame to DataFrame and has no side effect; a store writes its result to a new folder and then
points to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights and ranks of severities.
WEIGHTS = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3}
DISMISSED = ("false-positive", "ignored")
STATUSES = ("open", "in-progress", "fixed", "false-positive", "ignored", "stale")


def _by(x: Column, values: dict, otherwise) -> Column:
    out = None
    for key, value in values.items():
        out = (F.when if out is None else out.when)(x == key, value)
    return out.otherwise(otherwise)


def scored(findings: DataFrame) -> DataFrame:
    """findings with score: the severity's weight times the confidence, 1 where there is none."""
    return findings.withColumn("score", _by(F.col("severity"), WEIGHTS, 1.0) * F.coalesce("confidence", F.lit(1.0)))


def stamped(findings: DataFrame) -> DataFrame:
    """findings with id, a digest of check, file, description, symbol and the occurrence of these within the run.

    Lines are left out, so that a finding that moves keeps its id. Occurrences count by score, then place.
    """
    signature = F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in ("check_name", "file", "description", "symbol")])
    order = Window.partitionBy("run_id", "signature").orderBy(F.desc("score"), "ord")
    counted = scored(findings).withColumn("signature", signature).withColumn("occurrence", F.row_number().over(order) - 1)
    digest = F.sha2(F.concat_ws(":", "signature", F.col("occurrence").cast("string")), 256)
    return counted.withColumn("id", F.concat(F.lit("f-"), F.substring(digest, 1, 16))).drop("signature", "occurrence")


def before(runs: DataFrame) -> DataFrame:
    """run_id and prior: each run of `runs` that has one before it, and that one. Run numbers may have gaps."""
    return runs.select("run_id").distinct().withColumn("prior", F.lag("run_id").over(Window.orderBy("run_id"))).filter("prior IS NOT NULL")


def as_prior(findings: DataFrame) -> DataFrame:
    """findings with the run_id of the run after their own, for which they are the state before; the last run's have none."""
    steps = before(findings).select(F.col("run_id").alias("next"), F.col("prior").alias("run_id"))
    return findings.join(steps, "run_id").withColumn("run_id", F.col("next")).drop("next")


def merged(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """The state after a scan, with the key, severity, status, notes, severity_overridden and every other column.

    With the key (run_id, id) many scans are merged at once. A finding met again keeps its notes, an overridden severity,
    and a status that is neither open nor stale; stale ones open again; its other columns are those of the scan. Open
    findings that the scan did not meet become stale. New ones come with their own status or open, and with their notes.
    """
    kept = (*key, "severity", "status", "notes", "severity_overridden")
    others = [c for c in dict.fromkeys([*existing.columns, *incoming.columns]) if c not in kept]
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    was, now = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    status = (
        F.when(was & now, F.when(F.col("o.status").isin("open", "stale"), F.coalesce("n.status", F.lit("open"))).otherwise(F.col("o.status")))
        .when(was, F.when(F.col("o.status") == "open", "stale").otherwise(F.col("o.status")))
        .otherwise(F.coalesce("n.status", F.lit("open")))
    )
    overridden = F.coalesce("o.severity_overridden", F.lit(False))
    side = lambda c: F.when(now, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in existing.columns and c in incoming.columns else F.col(f"{'o' if c in existing.columns else 'n'}.{c}")
    return joined.select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key],
        F.when(was & (overridden | ~now), F.col("o.severity")).otherwise(F.col("n.severity")).alias("severity"),
        status.alias("status"),
        (F.coalesce("o.notes", "n.notes") if "notes" in incoming.columns else F.col("o.notes")).alias("notes"),
        overridden.alias("severity_overridden"),
        *[side(c).alias(c) for c in others],
    )


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """`existing` with all findings of the runs of `incoming` replaced by those of `incoming`."""
    return cleared(existing, incoming).unionByName(incoming)


def cleared(existing: DataFrame, runs: DataFrame) -> DataFrame:
    """`existing` without the findings of `runs` (run_id)."""
    return existing.join(runs.select("run_id").distinct(), "run_id", "left_anti")


def relative_paths(findings: DataFrame, root: str) -> DataFrame:
    """findings whose file is relative to `root`, with forward slashes, whichever way a scan named it."""
    file = F.translate("file", "\\", "/")
    start = root.replace("\\", "/").rstrip("/") + "/"
    return findings.withColumn("file", F.when(file.startswith(start), F.substring(file, len(start) + 1, 1 << 30)).otherwise(file))


def carried(current: DataFrame, prior: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """The key and status of dismissals of a prior run whose finding the current run has again."""
    dismissed = prior.filter(F.col("status").isin(*DISMISSED)).select(*key, F.col("status").alias("status"))
    return current.select(*key).join(dismissed, list(key))


def patched(findings: DataFrame, patches: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """findings after `patches` (the key, status, notes, severity, seq): the last patch of a key holds, nulls change nothing."""
    last = patches.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).filter("k = 1")
    p = last.select(*key, F.col("status").alias("p_status"), F.col("notes").alias("p_notes"), F.col("severity").alias("p_severity"))
    out = findings.join(p, list(key), "left")
    return (
        out.withColumn("severity_overridden", F.col("severity_overridden") | F.col("p_severity").isNotNull())
        .withColumn("severity", F.coalesce("p_severity", "severity"))
        .withColumn("status", F.coalesce("p_status", "status"))
        .withColumn("notes", F.coalesce("p_notes", "notes"))
        .drop("p_status", "p_notes", "p_severity")
    )


def patched_where(findings: DataFrame, applies: Column, status: str | None = None, notes: str | None = None, severity: str | None = None) -> DataFrame:
    """findings after one patch to all that `applies` holds for; what is None stays, and a severity counts as overridden."""
    here = F.coalesce(applies, F.lit(False))
    values = {c: F.when(here, v).otherwise(F.col(c)) for c, v in (("status", status), ("notes", notes), ("severity", severity)) if v is not None}
    if severity is not None:
        values["severity_overridden"] = F.col("severity_overridden") | here
    return findings.withColumns(values)


def patched_ids(findings: DataFrame, ids: DataFrame, key: tuple[str, ...] = ("id",), **patch: str) -> DataFrame:
    """findings after one patch to those whose key is in `ids`."""
    marked = findings.join(ids.select(*key).distinct().withColumn("_meant", F.lit(True)), list(key), "left")
    return patched_where(marked, F.col("_meant"), **patch).drop("_meant")


def outcomes(findings: DataFrame, patches: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per key of `patches`: n_patches, and whether it was updated or not found."""
    asked = patches.groupBy(*key).agg(F.count("*").alias("n_patches"))
    there = findings.select(*key).distinct().withColumn("_there", F.lit(True))
    return asked.join(there, list(key), "left").select(*key, "n_patches", F.when(F.col("_there"), "updated").otherwise("not found").alias("outcome"))


def existing_ids(findings: DataFrame, ids: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Those of `ids` that findings hold."""
    return ids.select(*key).distinct().join(findings.select(*key), list(key), "left_semi")


def of_ids(findings: DataFrame, ids: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """The findings of `ids`, whatever their status."""
    return findings.join(ids.select(*key).distinct(), list(key), "left_semi")


def pruned(findings: DataFrame, statuses: tuple[str, ...] = ("stale",)) -> DataFrame:
    """findings without those of some statuses."""
    unknown = set(statuses) - set(STATUSES)
    if unknown:
        raise ValueError(f"no such status: {', '.join(sorted(unknown))}")
    return findings.filter(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)))


def filtered(findings: DataFrame, severity: list[str] | None = None, category: list[str] | None = None, language: list[str] | None = None, check: list[str] | None = None, status: list[str] | None = None, fixable: bool | None = None, min_confidence: float | None = None, files: list[str] | None = None) -> DataFrame:
    """Findings that meet every given filter; without a status filter stale ones are left out.

    A finding that does not say counts as fixable and as certain.
    """
    out = findings.filter(F.col("status").isin(*status) if status else F.col("status") != "stale")
    for column, values in (("severity", severity), ("category", category), ("language", language), ("check_name", check), ("file", files)):
        if values:
            out = out.filter(F.col(column).isin(*values))
    if fixable is not None:
        out = out.filter(F.coalesce("fixable", F.lit(True)) == fixable)
    if min_confidence is not None:
        out = out.filter(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    return out


def page(findings: DataFrame, order: str = "severity", offset: int = 0, limit: int = 200) -> DataFrame:
    """`limit` findings from `offset` on, by severity, by confidence or as they came; ties as they came."""
    by = {"severity": [_by(F.col("severity"), RANKS, 4)], "confidence": [F.desc(F.coalesce("confidence", F.lit(1.0)))], "ord": []}[order]
    return findings.orderBy(*by, "ord").offset(offset).limit(limit)


def grouped_by_file(findings: DataFrame) -> DataFrame:
    """file, n and the worst severity rank of findings, without stale ones."""
    return findings.filter("status <> 'stale'").groupBy("file").agg(F.count("*").alias("n"), F.min(_by(F.col("severity"), RANKS, 4)).cast("int").alias("worst_rank"))


def grouped_by(findings: DataFrame, column: str) -> DataFrame:
    """value and n of one column, stale findings left out."""
    return findings.filter("status <> 'stale'").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def summaries(findings: DataFrame) -> DataFrame:
    """run_id, dimension, value and n for severity, category, status, check and language, in one pass.

    Stale findings count by status only.
    """
    dimensions = ("severity", "category", "status", "check_name", "language")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.when((F.col("status") != "stale") | F.lit(d == "status"), F.col(d)).alias("value")) for d in dimensions])
    each = findings.select("run_id", F.explode(pairs).alias("p")).select("run_id", "p.*").filter("value IS NOT NULL")
    return each.groupBy("run_id", "dimension", "value").agg(F.count("*").alias("n"))


def to_fix(findings: DataFrame) -> DataFrame:
    """Open fixable findings that are sure enough or severe enough to fix in bulk."""
    sure = F.coalesce("confidence", F.lit(1.0)) >= 0.8
    return filtered(findings, status=["open"], fixable=True).filter(sure | F.col("severity").isin("critical", "high"))


def page_facts(findings: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """One row on a page of findings: total, offset, limit, n (rows on the page) and whether more follow."""
    total = F.count("*")
    n = F.greatest(F.least(total - offset, F.lit(limit)), F.lit(0)).cast("long")
    return findings.agg(total.alias("total"), F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit"), n.alias("n"), (total > offset + n).alias("truncated"))


def compact(findings: DataFrame) -> DataFrame:
    """The ten columns that triage needs."""
    return findings.select("id", F.col("check_name").alias("check"), "severity", "category", F.coalesce("status", F.lit("open")).alias("status"), "description", "file", "start_line", "fixable", "confidence")


def members_of_groups(findings: DataFrame, column: str) -> DataFrame:
    """value, n and id: every member of each group with the group's size, a row for each, so no group is one row."""
    live = findings.filter(F.col(column).isNotNull() & (F.col("status") != "stale"))
    sizes = live.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return live.select(F.col(column).alias("value"), "id").join(sizes, "value")


def file_groups(findings: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of files with findings, the most findings first, then by name: file, n, worst_rank, the ids of its findings, and
    how many groups and findings there are in all. Only ids of the page's files are gathered."""
    sizes = grouped_by_file(findings)
    page_ = sizes.orderBy(F.desc("n"), "file").offset(offset).limit(limit)
    live = findings.filter("status <> 'stale'").select("file", "id").distinct()
    ids = live.join(page_.select("file"), "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    totals = sizes.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"))
    one = F.lit(1)
    return page_.join(ids, "file").withColumn("_k", one).join(totals.withColumn("_k", one), "_k").select("file", "n", "worst_rank", "ids", "total_groups", "total_findings")


def relative_locations(findings: DataFrame, root: str) -> DataFrame:
    """findings whose places (locations: file, start_line, end_line) are all relative to `root`, with forward slashes."""
    start = root.replace("\\", "/").rstrip("/") + "/"
    plain = lambda x: F.translate(x, "\\", "/")
    short = lambda x: F.when(plain(x).startswith(start), F.substring(plain(x), len(start) + 1, 1 << 30)).otherwise(plain(x))
    return findings.withColumn("locations", F.transform("locations", lambda p: F.struct(short(p["file"]).alias("file"), p["start_line"].alias("start_line"), p["end_line"].alias("end_line"))))


def file_index(findings: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """file and the key of findings with a place in it, once each: the side table that file questions are asked of."""
    return findings.select(F.explode(F.array_distinct(F.transform("locations", lambda p: p["file"]))).alias("file"), *key).filter("file IS NOT NULL")


def in_files(findings: DataFrame, files: DataFrame, index: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Findings with any place in one of `files` (file), by a side table, and rechecked: an index that lags behind adds none."""
    asked = files.select("file").distinct()
    hits = index.join(asked, "file").groupBy(*key).agg(F.collect_set("file").alias("_files"))
    met = findings.join(hits, list(key))
    return met.filter(F.exists("locations", lambda p: F.array_contains("_files", p["file"]))).drop("_files")


def counted(findings: DataFrame) -> DataFrame:
    """How many findings there are, as one row."""
    return findings.agg(F.count("*").alias("total"))


def run_registry(touches: DataFrame) -> DataFrame:
    """id, label, status, created_at, updated_at, touch_seq and active of every run, by its log of touches
    (id, label, status, at, touch_seq): the latest touch tells label and status. The run touched last is the active one."""
    latest = F.max(F.struct("touch_seq", "label", "status"))
    runs = touches.groupBy("id").agg(latest.alias("last"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    newest = touches.agg(F.max("touch_seq").alias("newest"))
    flat = runs.select("id", "last.label", "last.status", "created_at", "updated_at", "last.touch_seq")
    return flat.join(newest, flat["touch_seq"] == newest["newest"], "left").select(*flat.columns, F.col("newest").isNotNull().alias("active"))


def listed_runs(runs: DataFrame) -> DataFrame:
    """Runs that are not archived, and the active one in any case."""
    return runs.filter("status <> 'archived' OR active")


def without_run(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """The registry after the runs of `gone` (id) are deleted: the one touched last of the others becomes active."""
    left = runs.join(gone.select("id").distinct(), "id", "left_anti").drop("active")
    newest = left.agg(F.max("touch_seq").alias("newest"))
    return left.join(newest, left["touch_seq"] == newest["newest"], "left").select(*left.columns, F.col("newest").isNotNull().alias("active"))
