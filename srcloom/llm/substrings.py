"""Substring deduplication: words covered by a window of 50 words that also starts in a document with a smaller doc_id go.

Method: prefix-partitioned suffix trees. Every window of 50 words has an anchor, the run of 16 words inside it whose hash is
smallest (the leftmost of equals): equal windows have equal anchors at equal offsets, so it is enough to sort the suffixes
that start at anchors, one for 15 words of text. They are split by variable-length prefixes:

1. blocks: documents are packed into blocks of about 512 KB where they are read, with the anchors of each, in a table that
   is bucketed by the task that wrote it; later stages join their findings to it by that task, so texts never move again.
2. The first prefix is the anchor itself, 16 words. A prefix that only one document holds heads no repeat between
   documents and leaves; counts for that are two numbers a prefix and block, summed with partial aggregation.
3. Suffixes of the other prefixes travel with the words that their windows need, in groups of many prefixes that fit
   a task. A block sends equal suffixes once. A group's suffixes are sorted; lengths of the common prefixes of neighbours
   are the suffix tree, an internal node at depth d being a run of neighbours that share d words or more. The words before
   the anchors, read backwards, give a second tree. For each offset of the anchor in a window, a node of each tree
   (50 - offset words to the right, offset words to the left) is a window that repeats; its smallest doc_id stays.
4. Prefixes of more than HOT suffixes (a passage that a third of all documents share) are split by the longest prefix of
   all, the whole window: suffixes that share 50 words are one deep node, of which only the smallest doc_id is needed, so
   they are summed up with partial aggregation and none is gathered; windows that many share come back by broadcast.

Prefixes are compared by 64-bit hashes, the other words of a window by 40 bits each, whole windows of hot prefixes by 128 bits. Windows of one document that repeat in it alone stay.
Rows with equal doc_id are one document to each other, and each is returned. Rows of null doc_id neither lose words
nor cost others any. Null, empty and short texts lose nothing. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import bucketed, even_partitions, written
from srcloom.llm.skew import joined
from srcloom.llm.textbytes import SPACE, give_back, mix64, text_slices, word_hashes, word_spans

#: Fixed value of the contract, and the words of an anchor.
WINDOW, ANCHOR = 50, 16

#: Bytes of text in a block, suffixes in a group, and suffixes from which a prefix is hot.
BLOCK_BYTES, GROUP_SUFFIXES, HOT = 1 << 19, 40_000, 4096

#: Words looked at together in a very long text, and the bits that their places take beside a hash.
_STRETCH, _PLACE_BITS = 1 << 25, np.uint64(26)

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B2 = np.uint64(0xD1B54A32D192ED03)

_ANCHORS = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int32())]))
_BLOCK = "task int, block int, docs binary, anchors array<struct<h:bigint,lo:bigint,hi:bigint,n:int>>"


def grams(words: np.ndarray, k: int, base: np.uint64 = _B) -> np.ndarray:
    """A hash of each run of k words, from runs of 1, 2, 4... words."""
    out, size, run, length, power = None, 0, words, 1, np.full(1, base)
    powers = {1: power}
    while length <= k:
        if k & length:
            out, size = (run, length) if out is None else (out[: len(words) - size - length + 1] * powers[length] + run[size : len(words) - length + 1], size + length)
        if 2 * length > k:
            break
        run = run[: len(words) - 2 * length + 1] * power + run[length : len(words) - length + 1]
        power = power * power
        length *= 2
        powers[length] = power
    return mix64(out)


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of `width` keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return keys if size == width else np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])


def anchors_of(words: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each anchor of texts whose words begin at `first`: its hash and place, and its first and last window."""
    found: list[tuple[np.ndarray, ...]] = []
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for a in range(0, max(0, len(words) - window + 1), _STRETCH):
        part, owner = words[a : a + _STRETCH + window - 1], text_of[a : a + _STRETCH + window - 1]
        h = grams(part, anchor)
        keys = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        least = (least_of(keys, window - anchor + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        windows = np.flatnonzero(owner[: len(part) - window + 1] == owner[window - 1 :])
        if not len(windows):
            continue
        at = least[windows]
        cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(cuts[1:], len(at)) - 1
        found.append((h[at[cuts]].view(np.int64), at[cuts] + a, windows[cuts] + a, windows[ends] + a))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Tokens:
    """The words of a block's texts, and the document of each text; rows of null doc_id have no windows."""

    def __init__(self, docs: pa.RecordBatch, window: int, anchor: int):
        texts = docs.column("text")
        slices = list(text_slices(texts, 1 << 62))
        _, _, self.data, offsets = slices[0]
        self.starts, self.stops, self.first = word_spans(self.data, offsets, ~SPACE)
        self.ids = docs.column("doc_id")
        self.words = word_hashes(self.data, self.starts, self.stops)
        self.doc = self.ids.fill_null(0).to_numpy()
        self.h, self.place, self.i0, self.i1 = anchors_of(self.words, self.first, window, anchor)
        self.row = np.searchsorted(self.first, self.place, side="right") - 1
        known = np.asarray(self.ids.is_valid())[self.row] if len(self.row) else np.zeros(0, dtype=bool)
        self.h, self.place, self.i0, self.i1, self.row = (x[known] for x in (self.h, self.place, self.i0, self.i1, self.row))


def _packed_docs(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked_docs(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(pa.BufferReader(data)).read_all()
    return table.combine_chunks().to_batches()[0]


def _anchor_summary(t: Tokens) -> pa.Array:
    """Each anchor once with its smallest and largest doc_id and how often it stands there; null for what one suffix gives."""
    doc = t.doc[t.row]
    order = np.lexsort((doc, t.h))
    h, doc = t.h[order], doc[order]
    cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(cuts, len(h)))
    lo, hi = doc[cuts], doc[cuts + n - 1]
    fields = [pa.array(h[cuts]), pa.array(lo), pa.array(hi, mask=hi == lo), pa.array(n.astype(np.int32), mask=n == 1)]
    return pa.ListArray.from_arrays(pa.array([0, len(cuts)], pa.int32()), pa.StructArray.from_arrays(fields, ["h", "lo", "hi", "n"]))


def _blocks(window: int, anchor: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            docs = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchors = _anchor_summary(Tokens(docs, window, anchor))
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([_packed_docs(docs)], pa.binary()), anchors.cast(_ANCHORS)], ["task", "block", "docs", "anchors"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.large_string())], ["doc_id", "text"])
            for a, b, data, _ in text_slices(batch.column(1), block_bytes):
                held.append(batch.slice(a, b - a))
                size += len(data)
                if size >= block_bytes or len(held) >= 1000:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()
        give_back()

    return run


_SENT = "task int, block int, bucket int, h binary, doc binary, row binary, place binary, offsets binary, more binary, words binary"
_OWN = "task int, block int, flagged binary, hot array<struct<w1:bigint,w2:bigint,doc:bigint,row:int,at:bigint>>"
_HOT = pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("row", pa.int32()), ("at", pa.int64())]))

#: Bytes of a word's hash that travel with a suffix.
_WORD_BYTES = 5


def _narrow(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES]).tobytes()


def _widened(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _WORD_BYTES, 8), dtype=np.uint8)
    out[:, :_WORD_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _WORD_BYTES)
    return out.reshape(-1).view(np.uint64)


def _runs_of(keep: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> bytes:
    """Flagged windows as triples (row, first word, word after the last) of 64-bit numbers; windows side by side become one."""
    row, start = row[keep], start[keep]
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    if not len(row):
        return b""
    cut = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + window)))
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], len(row)) - 1
    return np.stack([row[begins], start[begins], start[ends] + window], axis=1).astype(np.int64).tobytes()


def _told(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[tuple[int, int, Tokens, np.ndarray, np.ndarray]]:
    """Task and number of each block, its tokens, and which of its suffixes have repeated prefixes, and hot ones."""
    for batch in batches:
        for r in range(batch.num_rows):
            t = Tokens(_unpacked_docs(batch.column("docs")[r].as_py()), window, anchor)
            inside = []
            for name in ("wanted", "hot"):
                some = np.sort(batch.column(name)[r].values.to_numpy(zero_copy_only=False))
                inside.append(np.flatnonzero(some[np.minimum(np.searchsorted(some, t.h), len(some) - 1)] == t.h) if len(some) else np.zeros(0, dtype=np.int64))
            yield batch.column("task")[r].as_py(), batch.column("block")[r].as_py(), t, *inside


def _suffixes(window: int, anchor: int, buckets: int):
    """Of each block the distinct suffixes of repeated prefixes."""
    names = [f.split()[0] for f in _SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for task, block, t, at, _ in _told(batches, window, anchor):
            rows = _sent_suffixes(t, at, _distinct(t, at, window)[0], window, buckets, squeeze) if len(at) else []
            for k in range(0, len(rows), 64):
                part = [{"task": task, "block": block, **x} for x in rows[k : k + 64]]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in part], pa.int32() if n in names[:3] else pa.binary()) for n in names], names)
        give_back()

    return run


def _own(window: int, anchor: int):
    """Of each block the windows that it flags by itself, and its windows with hot prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, block, t, at, hot in _told(batches, window, anchor):
            flags = [_distinct(t, at, window)[1]] if len(at) else []
            windows = pa.array([], _HOT.value_type)
            if len(hot):
                windows, own = _sent_windows(t, hot, window)
                flags.append(own)
            row, start = (np.concatenate(c) for c in zip(*flags, strict=True)) if flags else (np.zeros(0, dtype=np.int64),) * 2
            runs = _runs_of(np.ones(len(row), dtype=bool), row, start, window)
            if runs or len(windows):
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([runs or None], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(windows)], pa.int32()), windows)], ["task", "block", "flagged", "hot"])
        give_back()

    return run


def _firsts(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys and doc, and the first place in that order of each row's group."""
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    cuts = np.flatnonzero(new)
    return order, np.repeat(cuts, np.diff(np.append(cuts, len(order))))


def _distinct(t: Tokens, at: np.ndarray, window: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """Suffixes `at` grouped by the words of their windows (order, first of the group, whether of its smallest document), and
    rows and starts of the windows of other documents, which are repeats."""
    h, place, i0, i1, row = (x[at] for x in (t.h, t.place, t.i0, t.i1, t.row))
    doc, begin, end = t.doc[row], i0, i1 + window
    powers, inverses = np.full(len(t.words) + 1, _B2, dtype=np.uint64), np.full(len(t.words) + 1, np.uint64(pow(int(_B2), -1, 1 << 64)), dtype=np.uint64)
    powers[0] = inverses[0] = 1
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(t.words * np.multiply.accumulate(powers)[:-1])))
    content = mix64((sums[end] - sums[begin]) * np.multiply.accumulate(inverses)[begin] + (end - begin).astype(np.uint64) * _B + (place - begin).astype(np.uint64))
    order, first = _firsts((content, h), doc)
    least = doc[order][first]
    later = order[doc[order] > least]
    runs = (i1 - i0 + 1)[later]
    steps = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    flags = np.repeat(row[later], runs), np.repeat(i0[later] - t.first[row[later]], runs) + steps
    return (order, first, doc[order] == least), flags


def _sent_suffixes(t: Tokens, at: np.ndarray, groups: tuple[np.ndarray, ...], window: int, buckets: int, squeeze) -> list[dict]:
    h, place, i0, i1, row = (x[at] for x in (t.h, t.place, t.i0, t.i1, t.row))
    order, first, same = groups
    lead = np.flatnonzero(first == np.arange(len(order)))  # one for each distinct suffix; its document's others follow it
    extra = np.add.reduceat(same, lead, dtype=np.int64) - 1
    out = []
    where = (h[order[lead]].view(np.uint64) >> np.uint64(13)) % np.uint64(buckets)
    local = place - t.first[row]
    for b in np.unique(where).tolist():
        mine = np.flatnonzero(where == b)
        s, m = order[lead[mine]], extra[mine]
        n = (i1 - i0)[s] + window
        flat = np.repeat(i0[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        others = order[np.repeat(lead[mine] + 1 - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        out.append({
            "bucket": b, "h": h[s].tobytes(), "doc": t.doc[row[s]].tobytes(), "row": row[s].astype(np.int32).tobytes(), "place": local[s].tobytes(),
            "offsets": np.stack([place[s] - i1[s], place[s] - i0[s]], axis=1).astype(np.uint16).tobytes(),
            "more": np.concatenate((m, row[others], local[others])).astype(np.int64).tobytes() if m.any() else None,
            "words": squeeze.compress(_narrow(t.words[flat])),
        })
    return out


def _sent_windows(t: Tokens, at: np.ndarray, window: int) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray]]:
    runs = (t.i1 - t.i0 + 1)[at]
    start = np.repeat(t.i0[at] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    row = np.repeat(t.row[at], runs)
    w1, w2 = grams(t.words, window)[start].view(np.int64), grams(t.words, window, _B2)[start].view(np.int64)
    doc, local = t.doc[row], start - t.first[row]
    order, first = _firsts((w1, w2), doc)
    least = doc[order][first]
    later, s = order[doc[order] > least], order[doc[order] == least]
    return pa.StructArray.from_arrays([pa.array(w1[s]), pa.array(w2[s]), pa.array(doc[s]), pa.array(row[s].astype(np.int32)), pa.array(local[s])], ["w1", "w2", "doc", "row", "at"]), (row[later], local[later])


class SuffixTree:
    """Sorted suffixes (their words from a common prefix on) with the words that neighbours have in common: its internal nodes."""

    def __init__(self, prefix: np.ndarray, words: np.ndarray, depth: int):
        """words: a row for each suffix, 0 beyond its end. prefix: equal where the first `depth` words are."""
        self.order = np.lexsort((*words.T[::-1], prefix))
        p, w = prefix[self.order], words[self.order]
        same = np.cumprod(w[1:] == w[:-1], axis=1, dtype=np.int16).sum(axis=1) if w.shape[1] else np.zeros(max(0, len(w) - 1), dtype=np.int64)
        self.common = np.where(p[1:] == p[:-1], depth + same, -1)

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix the node above it that has `depth` words or more: a number."""
        out = np.zeros(len(self.order), dtype=np.int64)
        out[self.order[1:]] = np.cumsum(self.common < depth)
        return out


def repeats(h: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Whether the window with the anchor at each offset (a column) also starts in a document with a smaller id.

    Suffix i has windows with its anchor at offsets low[i] to high[i]; words: those of its windows, suffix after suffix.
    """
    n, wide = len(h), window - anchor
    ends = np.cumsum(high - low + window)
    at = ends - (high - low + window) + high  # the anchor's own place
    stop = np.concatenate((words, np.zeros(1, dtype=words.dtype)))
    column = np.arange(wide)
    right = at[:, None] + anchor + column
    right = np.where(right < ends[:, None], stop[np.minimum(right, len(words))], 0)
    left = np.where(column < high[:, None], stop[np.maximum(at[:, None] - 1 - column, 0)], 0)
    forward, backward = SuffixTree(h, right, anchor), SuffixTree(h, left, 0)
    out = np.zeros((n, wide + 1), dtype=bool)
    for o in range(wide + 1):
        live = np.flatnonzero((low <= o) & (o <= high))
        if len(live) > 1:
            order, first = _firsts((forward.nodes(window - o)[live], backward.nodes(o)[live]), doc[live])
            out[live[order], o] = doc[live][order] > doc[live][order][first]
    return out


def _group(window: int, anchor: int):
    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        got = {n: [] for n in ("h", "doc", "row", "place", "offsets", "words", "owner", "more")}
        origins: list[tuple[int, int]] = []
        total = 0
        for x in table.to_pylist():
            h = np.frombuffer(x["h"], dtype=np.int64)
            origin = len(origins)
            origins.append((x["task"], x["block"]))
            for n, kind in (("h", np.int64), ("doc", np.int64), ("row", np.int32), ("place", np.int64), ("offsets", np.uint16)):
                got[n].append(np.frombuffer(x[n], dtype=kind))
            got["words"].append(_widened(expand.decompress(x["words"])))
            got["owner"].append(np.full(len(h), origin))
            if x["more"] is not None:
                more = np.frombuffer(x["more"], dtype=np.int64)
                counts, others = more[: len(h)], more[len(h) :].reshape(2, -1)
                got["more"].append(np.stack([np.repeat(np.arange(len(h)) + total, counts), *others], axis=1))
            total += len(h)
        h, doc, row, place, owner, words = (np.concatenate(got[n]) for n in ("h", "doc", "row", "place", "owner", "words"))
        low, high = np.concatenate(got["offsets"]).astype(np.int64).reshape(-1, 2).T
        seen = repeats(h, doc, low, high, words, window, anchor)
        suffix, offset = np.nonzero(seen)
        where, start, whose = row[suffix].astype(np.int64), place[suffix] - offset, owner[suffix]
        if got["more"]:
            more = np.concatenate(got["more"])
            k, o = np.nonzero(seen[more[:, 0]])
            where, start, whose = np.concatenate((where, more[k, 1])), np.concatenate((start, more[k, 2] - o)), np.concatenate((whose, owner[more[k, 0]]))
        order = np.argsort(whose, kind="stable")
        where, start, whose = where[order], start[order], whose[order]
        out = []
        for b in np.unique(whose).tolist():
            a, z = np.searchsorted(whose, [b, b + 1])
            out.append((*origins[b], _runs_of(np.ones(z - a, dtype=bool), where[a:z], start[a:z], window)))
        del got, words, seen
        give_back()
        return pa.table({"task": pa.array([r[0] for r in out], pa.int32()), "block": pa.array([r[1] for r in out], pa.int32()), "flagged": pa.array([r[2] for r in out], pa.binary())})

    return run


def _removed(window: int):
    """The kept text of each document, and the spans of words that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs = _unpacked_docs(batch.column("docs")[r].as_py())
                cells = batch.column("flagged")[r].as_py() or []
                yield _kept(docs, np.concatenate([np.zeros((0, 3), dtype=np.int64), *(np.frombuffer(c, dtype=np.int64).reshape(-1, 3) for c in cells)]))
        give_back()

    return run


def _kept(docs: pa.RecordBatch, spans: np.ndarray) -> pa.RecordBatch:
    _, _, data, offsets = next(text_slices(docs.column("text"), 1 << 62))
    starts, stops, first = word_spans(data, offsets, ~SPACE)
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(change, first[spans[:, 0]] + spans[:, 1], 1)
    np.add.at(change, first[spans[:, 0]] + spans[:, 2], -1)
    keep = np.cumsum(change)[:-1] == 0
    n_words, before = np.diff(first), np.concatenate(([0], np.cumsum(keep)))
    n_kept = np.diff(before[first])
    s, length = starts[keep], stops[keep] - starts[keep] + 1  # one more byte for the space after each word
    ends = np.cumsum(length)
    source = np.repeat(s - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    text = np.append(data, np.uint8(32))[source]
    text[ends - 1] = 32
    cuts = np.concatenate(([0], ends))[before[first]]
    held = pa.array([text[a : max(a, b - 1)].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())
    edges = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
    gone: list[list] = [[] for _ in range(docs.num_rows)]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        while a < b:  # spans of neighbouring texts may touch
            row = int(np.searchsorted(first, a, side="right")) - 1
            z = min(b, int(first[row + 1]))
            gone[row].append({"start": a - int(first[row]), "end": z - int(first[row])})
            a = z
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([docs.column("doc_id"), held, pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array(gone, kind)], ["doc_id", "text", "n_words", "n_removed", "removed"])


def _by_task(rows: DataFrame, value) -> DataFrame:
    """task and a map from its blocks to `value`, gathered within each block."""
    each = rows.groupBy("task", "block").agg(value.alias("v"))
    return each.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("block", "v"))).alias("of"))


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, block_bytes: int = BLOCK_BYTES, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words (before), n_removed and the removed spans of words."""
    read = docs.select("doc_id", "text")
    tasks = (read.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    blocks = bucketed(read.mapInArrow(_blocks(window, anchor, block_bytes), _BLOCK), "blocks", "task", 2 * tasks)
    held = blocks.select("task", "block", F.explode("anchors").alias("a")).select("task", "block", "a.*")
    prefixes = held.groupBy("h").agg(F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi"), F.sum(F.coalesce("n", F.lit(1))).alias("suffixes"), F.count("*").alias("blocks"))
    wanted = written(prefixes.filter("lo < hi").select("h", "suffixes", "blocks"), "prefixes")
    n_suffixes = wanted.filter(F.col("suffixes") <= hot).agg(F.coalesce(F.sum("suffixes"), F.lit(0))).first()[0]
    n_held = blocks.agg(F.coalesce(F.sum(F.size("anchors").cast("long")), F.lit(0))).first()[0]
    asked = joined(held.select("task", "block", "h"), wanted, ["h"], "blocks", n_held)
    is_hot = F.col("suffixes") > hot
    of_block = F.struct(F.collect_list(F.when(~is_hot, F.col("h"))).alias("wanted"), F.collect_list(F.when(is_hot, F.col("h"))).alias("hot"))
    answers = _by_task(asked, of_block).hint("shuffle_hash")
    told = blocks.select("task", "block", "docs").join(answers, "task").withColumn("v", F.element_at("of", F.col("block"))).filter("v IS NOT NULL")
    buckets = even_partitions(n_suffixes, group_suffixes)
    told = told.select("task", "block", "docs", "v.wanted", "v.hot")
    trees = told.mapInArrow(_suffixes(window, anchor, buckets), _SENT).groupBy("bucket").applyInArrow(_group(window, anchor), "task int, block int, flagged binary")
    own = written(told.mapInArrow(_own(window, anchor), _OWN), "own-windows")
    windows = written(own.select("task", "block", F.explode("hot").alias("w")).select("task", "block", "w.*"), "hot-windows")
    nodes = written(windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.count("*").alias("n")), "hot-nodes")
    late = joined(windows, nodes, ["w1", "w2"], "n", windows.count()).filter("doc > least")
    pair = F.struct(F.col("row").cast("long").alias("row"), "at")
    hot_flags = late.groupBy("task", "block").agg(F.collect_list(pair).alias("at")).mapInArrow(_as_runs(window), "task int, block int, flagged binary")
    flags = own.filter("flagged IS NOT NULL").select("task", "block", "flagged").union(trees).union(hot_flags)
    found = blocks.select("task", "block", "docs").join(_by_task(flags, F.collect_list("flagged")).hint("shuffle_hash"), "task", "left")
    out = found.select("docs", F.element_at("of", F.col("block")).alias("flagged"))
    return out.mapInArrow(_removed(window), "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>")


def _as_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for c in batch.column("at"):
                row, start = (c.values.field(k).to_numpy() for k in (0, 1))
                cells.append(_runs_of(np.ones(len(row), dtype=bool), row, start, window))
            yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("block"), pa.array(cells, pa.binary())], ["task", "block", "flagged"])

    return run


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of the kept text."""
    return deduplicated(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
