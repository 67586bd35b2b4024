"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over distinct hashed word features (whole words, and their beginnings, which catch inflected
forms) is trained in numpy from confirmed toxic documents and unlabelled text, with the class prior's share taken out
of the unlabelled risk and that difference held at zero or above (nnPU). The prior is the share of toxic rows among the
labelled rows that may be learned from, or less where toxic features are rarer in unlabelled text than that would make
them, as when labelled rows were not drawn evenly.

The fit uses bounded samples, POSITIVES confirmed toxic documents and UNLABELLED others, chosen by a hash of doc_id, one
text each. Their features are counted by tasks, and the driver receives, of each text, only the few that tell toxic texts
from others. Scoring reads every whole text
once, where it lies, with the fitted weights (a few hundred kB) in the task: nothing is shuffled.

Only rows with crc32(doc_id as text) mod 5 other than 0 teach; held-out documents are in neither sample. Labels, lang,
source and doc_id are no inputs of a score. Null and empty texts have no feature and get the bias alone. Without a toxic
label to learn from all scores are 0. Of repeated labels for a document the largest counts; repeated documents are
scored each; null labels are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import written
from srcloom.llm.textbytes import LOWER_VALUE, byte_classes, give_back, mix64, runs_as_binary, text_slices, word_hashes, word_spans

POSITIVES, UNLABELLED, CANDIDATES = 4_000, 12_000, 40_000
#: Bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = 3
FOLDS = 5

_WORD = byte_classes(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, word) of every word and word beginning, with repeats."""
    starts, stops, first = word_spans(data, offsets, _WORD)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    words = word_hashes(data, starts, stops, LOWER_VALUE)
    owners, found, of = [owner], [words], [words]
    for n in BEGINNINGS:
        long = stops - starts > n
        owners.append(owner[long])
        found.append(mix64(word_hashes(data, starts[long], starts[long] + n, LOWER_VALUE) + np.uint64(n)))
        of.append(words[long])
    return np.concatenate(owners), np.concatenate(found), np.concatenate(of)


class _Chosen:
    """Looks features up in a sorted list; a bitmap over their low bits rules most others out first.

    A feature has LEVELS places: place k says that more than k different words of the text show it.
    """

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen
        self.places = len(chosen) * LEVELS
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[chosen & np.uint64((1 << 20) - 1)] = True

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, place), sorted."""
        owner, found, word = features(data, offsets)
        some = self.maybe[found & np.uint64((1 << 20) - 1)]
        owner, found, word = owner[some], found[some], word[some]
        at = np.searchsorted(self.chosen, found)
        at[at == len(self.chosen)] = 0
        hit = self.chosen[at] == found if len(self.chosen) else np.zeros(len(at), dtype=bool)
        pair, word = owner[hit] * self.places + at[hit] * LEVELS, word[hit]
        order = np.lexsort((word, pair))
        pair, word = pair[order], word[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (word[1:] != word[:-1])
        pair, n = np.unique(pair[new], return_counts=True)
        level = np.minimum(n, LEVELS)
        pair = np.repeat(pair, level) + np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level)
        return pair // max(1, self.places), pair % max(1, self.places)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of the batch each feature occurs."""
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text")):
            owner, found, _ = features(data, offsets)
            order = np.lexsort((owner, found))
            owner, found = owner[order], found[order]
            new = np.ones(len(found), dtype=bool)
            new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            ids, n = np.unique(found[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def pu_risk(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of raw scores g, and the slope to follow at each of them.

    risk = prior E_p[loss(g, 1)] + max(0, E_u[loss(g, 0)] - prior E_p[loss(g, 0)]). Where the difference is negative the
    slope is that of its negative, which leads back to where it is a risk.
    """
    g = np.clip(g, -30, 30)
    p = 1 / (1 + np.exp(-g))
    share = np.where(positive, prior / max(1, positive.sum()), 0.0)
    unlabelled = np.where(positive, 0.0, 1.0 / max(1, (~positive).sum()))
    as_negative = np.logaddexp(0, g)
    rest = (unlabelled * as_negative).sum() - (share * as_negative).sum()
    slope = unlabelled * p - share * p
    return float((share * np.logaddexp(0, -g)).sum() + max(0.0, rest)), -share * (1 - p) + slope if rest >= 0 else -slope


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative PU risk, logistic loss, full-batch Adam. rows: feature places of each text.

    No weight goes below 0, as a word cannot make a text less toxic: each step is projected onto that.
    """
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, rounds + 1):
        _, slope = pu_risk(np.bincount(owner, weights=w[columns], minlength=len(rows)) + b, positive, prior)
        grad = np.append(np.bincount(columns, weights=slope[owner], minlength=n_features) + decay * w, slope.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, float(b)


def _spread_of(candidates: np.ndarray):
    """In how many toxic and other texts of a task each feature place occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Chosen(candidates)
        sums = np.zeros((2, lookup.places), dtype=np.int64)
        for batch in batches:
            positive = np.asarray(batch.column("positive"))
            for a, b, data, offsets in text_slices(batch.column("text")):
                owner, at = lookup.present(data, offsets)
                for k, which in enumerate((positive[a:b][owner], ~positive[a:b][owner])):
                    sums[k] += np.bincount(at[which], minlength=lookup.places)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[0, some]), pa.array(sums[1, some])], ["place", "in_p", "in_u"])

    return run


def _places(candidates: np.ndarray, use: np.ndarray):
    """The numbers of the used feature places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Chosen(candidates)
        number = np.full(lookup.places + 1, -1, dtype=np.int32)
        number[use] = np.arange(len(use))
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                owner, at = lookup.present(data, offsets)
                keep = number[at] >= 0
                lists = runs_as_binary(number[at[keep]], np.searchsorted(owner[keep], np.arange(b - a + 1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("positive").slice(a, b - a), lists], ["doc_id", "positive", "at"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of `labels` (doc_id, toxic) over the texts of `docs`; None without a toxic document to learn from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return None
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    toxic = known.filter("toxic = 1").join(ids.distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    others = ids.distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    chosen = [(r[0], r[1]) for r in toxic.union(others).collect()]  # POSITIVES + UNLABELLED rows at most
    positives = [i for i, positive in chosen if positive]
    if not positives:
        return None
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen, "doc_id long, positive boolean")
    texts = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "positive").agg(F.max("text").alias("text")), "toxicity-sample")
    least = max(2, len(positives) // 200)
    counted = texts.filter("positive").select("text").mapInArrow(_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    candidates = np.sort(np.array([r[0] for r in counted.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()], dtype=np.int64).view(np.uint64))

    n_p, n_u = texts.agg(F.count_if(F.col("positive")), F.count_if(~F.col("positive"))).first()
    # features that toxic texts show clearly more often than unlabelled text
    told = texts.select("positive", "text").mapInArrow(_spread_of(candidates), "place int, in_p long, in_u long").groupBy("place").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    p, u = F.col("in_p") / n_p, F.col("in_u") / max(1, n_u)
    pooled = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), (F.col("in_p") + F.col("in_u")) / (n_p + max(1, n_u))))
    z = (p - u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / max(1, n_u)))
    found = told.select("place", p.alias("p"), u.alias("u"), z.alias("z"), "in_p").filter((F.col("z") > 4) & (F.col("p") > 2.5 * F.col("u")) & (F.col("in_p") >= least)).orderBy("place").collect()
    use = np.array([r.place for r in found], dtype=np.int64)
    rows = sorted((r[1], r[0], bytes(r[2])) for r in texts.select("doc_id", "positive", "text").mapInArrow(_places(candidates, use), "doc_id long, positive boolean, at binary").collect())
    positive = np.array([r[0] for r in rows], dtype=bool)
    lists = [np.frombuffer(r[2], dtype=np.int32) for r in rows]
    # toxic texts are at most the share of the unlabelled ones that the rates of their clearest features allow, and a fifth
    clear = sorted(found, key=lambda r: -r.z)[:15]
    prior = min(n_toxic / n, 1.2 * float(np.median([r.u / r.p for r in clear])) if clear else 1.0)
    w, b = fit_nnpu(lists, positive, len(use), prior)
    weights = np.zeros(len(candidates) * LEVELS)
    weights[use] = w
    weights = weights.reshape(-1, LEVELS)
    keep = weights.any(axis=1)
    return Model(candidates[keep], weights[keep].ravel(), b, prior)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with score (double, 0 to 1) and predicted (int); columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    model = fit(docs, labels)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = _Chosen(model.features)
        for column in batches:
            out = np.zeros(len(column))
            for a, b, data, offsets in text_slices(column):
                owner, at = lookup.present(data, offsets)
                g = np.bincount(owner, weights=model.weights[at], minlength=b - a) + model.bias
                out[a:b] = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            yield pa.array(out)
        give_back()

    scores = docs.withColumn("score", score("text") if model else F.lit(0.0))
    return scores.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    return scored(docs.select("doc_id", "text"), labels).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
