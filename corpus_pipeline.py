"""A training corpus from raw documents: low quality and toxic documents go, repeated lines and near copies go, the rest is packed.

Every stage but the last returns the columns it got. Those that no stage reads are carried along untouched, also if they
are named like something a stage makes (`score`, `n_dropped`, `_n`).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.functions.shared import written
from srcloom.llm import line_dedup, ngram_join, packing, quality_classifier, toxicity
from srcloom.llm.queries import tokenizer_file
from srcloom.sources.tables import table


#: What stages read and change; all other columns are carried through a stage in one, so that no name can clash.
OWN, CARRIED = ("doc_id", "text", "lang", "source", "n_chars"), "_carried"


def _apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that sees only OWN columns and gives the others back as they were, whatever their names."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in OWN]
        if not others:
            return stage(spark, docs, sf_dir)
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        carried = docs.select(*[c for c in docs.columns if c in OWN], F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(others)]).alias(CARRIED))
        kept = stage(spark, carried, sf_dir)
        return kept.select(*[F.col(f"{CARRIED}.c{others.index(c)}").alias(c) if c in others else c for c in docs.columns])

    return run


@_apart
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return quality_classifier.scored(docs).filter("score >= 0.5").select(*docs.columns)


@_apart
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


@_apart
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text."""
    kept = line_dedup.deduplicated(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


@_apart
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, or any if none has one.

    Rows of null doc_id group by their text as all others do, and stay where they have no partner; wordless ones are
    linked with nothing and all stay. Rows repeated with one doc_id and text are copies, also wordless ones, so one stays;
    rows of one doc_id whose texts do not link are no copies, and stay unless other documents' rows link with them.
    """
    row = [F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"]
    marked = docs.withColumns({"_a": F.xxhash64(*row), "_b": F.xxhash64(F.lit(1), *row)})
    rows = ngram_join.grouped_rows(marked, keep=("_a", "_b")).filter("doc_id <=> component_id")
    every = F.col("component").isNull() & F.col("doc_id").isNull()
    alone = rows.filter(every).select("_a", "_b", F.lit(True).alias("_every")).distinct()
    one = rows.filter(~every).groupBy("component", F.when(F.col("component").isNull(), F.col("doc_id")).alias("wordless")).agg(F.min(F.struct("_a", "_b")).alias("row"))
    stays = one.select("row._a", "row._b", F.lit(False).alias("_every")).union(alone)
    order = Window.partitionBy("_a", "_b").orderBy(F.xxhash64(*[c for c in docs.columns if c != "text"]))
    kept = marked.join(stays, ["_a", "_b"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1 OR _every")
    return kept.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences, with their token ids: the packed corpus itself."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Two stages learn models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is a written table that the next reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
