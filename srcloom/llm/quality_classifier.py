"""Quality scores from weak labels.

Overlapping heuristic labellers each vote that a document is junk or abstain. Expectation-maximisation over the counts
of their vote patterns, taken over all documents, estimates the share of junk and each labeller's hit and false-alarm
rates; no hand label is used. The posterior of a document's pattern is its soft label, and soft labels train a hashed
linear scorer over the text's shape (trigrams of byte classes, and the labellers' measures in bins), which generalises
beyond the thresholds of single labellers.

The vote patterns that reach the driver number at most 2 ** labellers. The scorer is fitted there on a bounded sample of
about SAMPLE documents, chosen by a hash of doc_id and text, repeated rows once, with its sparse features only (at most
BUCKETS of each). Texts are read twice where they lie, once to vote and once to score; only those of the sample are shuffled.

Null and empty texts have no shape: no labeller fires, and their score is that of the bias. Repeated rows are scored
each and alike; an empty table gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.textbytes import LOWER_VALUE, SPACE, byte_classes, give_back, mix64, runs_as_binary, text_slices, word_hashes, word_spans

SAMPLE = 6_000
BUCKETS = 1 << 12

_UPPER = byte_classes(bytes(range(65, 91)))
_LETTER = byte_classes(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_SYMBOL = byte_classes(b"#*$%&|<>{}[]\\^~=+_@")
_SHOUT = byte_classes(b"!?")
_DIGIT = byte_classes(b"0123456789")
_LINE = byte_classes(b"\n")

#: Each labeller: the measure it looks at and the bound above which it votes junk.
LABELLERS = (
    ("symbols_per_word", 0.30),
    ("symbols_per_byte", 0.08),
    ("shouts_per_word", 0.30),
    ("capitals", 0.50),
    ("same_as_last_word", 0.20),
    ("window_repeats", 0.30),
    ("repeated_lines", 0.30),
    ("few_letters", 0.50),
)
MEASURES = tuple(name for name, _ in LABELLERS)
_BOUNDS = np.array([bound for _, bound in LABELLERS])

#: Sixteen classes of bytes for the shape: control and space, digits, lower, upper, letters beyond ASCII, and marks.
_SHAPE = np.full(256, 15, dtype=np.int64)
for _n, _chars in enumerate((b" \t\x0b\x0c\r", b"\n", bytes(range(48, 58)), bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(128, 256)), b".", b",", b"!?", b"|", b"*", b"$", b"#%&", b"\"'()-:;/", b"<>=+_")):
    _SHAPE[list(_chars)] = _n


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Per text how many hashes equal another one of it that comes before in sorted order."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text, all 0 for a text without words."""
    n = len(offsets) - 1
    starts, stops, first = word_spans(data, offsets, ~SPACE)
    n_words = np.diff(first)
    words = word_hashes(data, starts, stops, LOWER_VALUE)
    owner = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    in_window = np.zeros(max(0, len(words) - 4), dtype=np.uint64)
    for k in range(5):
        in_window = in_window * np.uint64(0x5851F42D4C957F2D) + words[k : k + len(in_window)]
    whole = owner[: len(in_window)] == owner[4:]
    line_starts, line_stops, line_first = word_spans(data, offsets, ~_LINE)
    lines = word_hashes(data, line_starts, line_stops)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    n_lines = np.maximum(np.diff(line_first), 1)
    w = np.maximum(n_words, 1)
    size = np.maximum(np.diff(offsets), 1)
    letters = _per_text(_LETTER[data], offsets)
    symbols = _per_text(_SYMBOL[data], offsets)
    filled = size - _per_text(SPACE[data], offsets)
    repeated = _repeats(line_owner, lines, n)
    out = np.stack(
        [
            symbols / w,
            symbols / size,
            _per_text(_SHOUT[data], offsets) / w,
            _per_text(_UPPER[data], offsets) / np.maximum(letters, 1),
            np.bincount(owner[same], minlength=n) / w,
            _repeats(owner[: len(in_window)][whole], mix64(in_window[whole]), n) / w,
            np.where(repeated >= 3, repeated / n_lines, 0.0),
            1 - (letters + _per_text(_DIGIT[data], offsets) * 0.5) / np.maximum(filled, 1),
        ],
        axis=1,
    )
    out[n_words == 0] = 0
    return out


def _votes(found: np.ndarray) -> np.ndarray:
    return (found > _BOUNDS) @ (1 << np.arange(len(LABELLERS)))


def shape(data: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed features (text, bucket, value): shares of byte-class trigrams and one-hot bins of the measures."""
    n = len(offsets) - 1
    classes = _SHAPE[data]
    codes = classes[:-2] * 256 + classes[1:-1] * 16 + classes[2:] if len(classes) > 2 else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    whole = owner[: len(codes)] == owner[2:]
    pairs, counts = np.unique(owner[: len(codes)][whole] * 4096 + codes[whole], return_counts=True) if n * 4096 > 1 << 26 else _counted(owner[: len(codes)][whole] * 4096 + codes[whole], n * 4096)
    text, code = pairs // 4096, pairs % 4096
    value = np.sqrt(counts / np.maximum(np.diff(offsets)[text], 1))
    bins = np.minimum((found * 10).astype(np.int64), 15)
    kinds = np.arange(len(MEASURES))
    hashed = mix64((kinds * 16 + bins + 1_000_003).astype(np.uint64)) % np.uint64(BUCKETS)
    code = mix64(code.astype(np.uint64)) % np.uint64(BUCKETS)
    return (
        np.concatenate([text, np.repeat(np.arange(n), len(kinds))]),
        np.concatenate([code, hashed.ravel()]).astype(np.int64),
        np.concatenate([value, np.full(n * len(kinds), 0.5)]),
    )


def _counted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(keys, minlength=most)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass(frozen=True)
class LabelModel:
    """Share of junk, and per labeller the rate of votes on junk and on good documents."""

    junk: float
    hit: np.ndarray
    false_alarm: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that documents with these vote patterns are good."""
        fired = (votes[:, None] >> np.arange(len(self.hit))) & 1
        bad = np.log(self.junk) + np.where(fired, np.log(self.hit), np.log1p(-self.hit)).sum(axis=1)
        good = np.log1p(-self.junk) + np.where(fired, np.log(self.false_alarm), np.log1p(-self.false_alarm)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit_labellers(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns; the start takes a document for junk where some labeller fires.

    Rates have a weak prior, and a labeller is held to fire more on junk than on good documents, so that classes keep
    their meaning.
    """
    fired = ((votes[:, None] >> np.arange(len(LABELLERS))) & 1).astype(float)
    bad = np.where(fired.any(axis=1), 0.9, 0.01)
    total = max(counts.sum(), 1)
    for _ in range(rounds):
        n_bad, n_good = (counts * bad).sum(), (counts * (1 - bad)).sum()
        junk = np.clip((n_bad + 1) / (total + 10), 1e-4, 0.5)
        hit = np.clip(((counts * bad) @ fired + 1) / (n_bad + 4), 1e-3, 0.999)
        false_alarm = np.clip(((counts * (1 - bad)) @ fired + 0.1) / (n_good + 100), 1e-5, 0.05)
        model = LabelModel(float(junk), np.maximum(hit, 2 * false_alarm), false_alarm)
        new = 1 - model.posterior(votes)
        if np.abs(new - bad).max(initial=0) < 1e-9:
            break
        bad = new
    return model


def fit_scorer(text: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer, full-batch Adam on soft targets."""
    n = max(1, len(target))
    w, b = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, rounds + 1):
        g = np.bincount(text, weights=w[bucket] * value, minlength=len(target)) + b
        slope = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - target) / n
        grad = np.append(np.bincount(bucket, weights=slope[text] * value, minlength=BUCKETS) + decay * w, slope.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


@dataclass(frozen=True)
class Model:
    labellers: LabelModel
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                votes, n = np.unique(_votes(measures(data, offsets)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(votes.astype(np.int32)), pa.array(n.astype(np.int64))], ["votes", "n"])

    counted = docs.select("text").mapInArrow(vote, "votes int, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    votes, counts = np.array([r[0] for r in counted], dtype=np.int64), np.array([r[1] for r in counted], dtype=np.float64)
    labellers = fit_labellers(votes, counts)
    share = min(1.0, sample / max(1.0, counts.sum()))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                found = measures(data, offsets)
                text, bucket, value = shape(data, offsets, found)
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(found) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_votes(found).astype(np.int32)), runs_as_binary(bucket[order].astype(np.int32), cuts), runs_as_binary(value[order].astype(np.float32), cuts)],
                    ["votes", "bucket", "value"],
                )

    key = F.xxhash64("doc_id", "text")
    picked = docs.select("text", key.alias("key")).filter(F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("key").agg(F.max("text").alias("text"))
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in picked.select("text").mapInArrow(shapes, "votes int, bucket binary, value binary").collect())
    text = np.repeat(np.arange(len(rows)), np.array([len(r[1]) // 4 for r in rows], dtype=np.int64))
    target = labellers.posterior(np.array([r[0] for r in rows], dtype=np.int64)) if rows else np.zeros(0)
    bucket, value = (np.frombuffer(b"".join(r[k] for r in rows), dtype=kind) for k, kind in ((1, np.int32), (2, np.float32)))
    weights, bias = fit_scorer(text, bucket.astype(np.int64), value.astype(np.float64), target)
    return Model(labellers, weights, bias)


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """`docs` with votes (bits by labeller), posterior (of being good, by the labellers) and score (0 to 1, by the scorer)."""
    names = ("votes", "posterior", "score")
    docs = docs.drop(*names, "_judged")
    model = model or fit(docs)

    @F.arrow_udf("struct<votes:int,posterior:double,score:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            votes, score = np.zeros(len(column), dtype=np.int32), np.zeros(len(column))
            for a, b, data, offsets in text_slices(column):
                found = measures(data, offsets)
                at, bucket, value = shape(data, offsets, found)
                g = np.bincount(at, weights=model.weights[bucket] * value, minlength=b - a) + model.bias
                votes[a:b], score[a:b] = _votes(found), 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            yield pa.StructArray.from_arrays([pa.array(votes), pa.array(model.labellers.posterior(votes.astype(np.int64))), pa.array(score)], list(names))
        give_back()

    judged = docs.withColumn("_judged", judge("text"))
    return judged.select(*docs.columns, *[F.col(f"_judged.{n}") for n in names])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score and kept (score of 0.5 or more)."""
    return scored(docs.select("doc_id", "text")).withColumn("kept", F.col("score") >= 0.5).drop("text")
