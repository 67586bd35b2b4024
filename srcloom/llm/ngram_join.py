"""N-gram Jaccard join: documents linked when their word-shingle sets have a Jaccard similarity of 0.75 or more.

Method: prefix-tree join. Sets are ordered by one global order (rarest element first), sets that can meet are
brought together by their prefixes, stored in a trie, and joined by a traversal that starts at the roots whose sets hold
an element of the query's prefix, carries partial overlaps down shared paths and prunes subtrees by length and
remaining-length bounds.

Stages, each a Spark job over packed Arrow rows:

1. digest: per document the size of its set and a fingerprint. Equal sets form a class, which is joined once.
2. postings: every element of every class goes to a bucket of its hash, packed per map block as arrays; a task sends a
   class once, however many copies it reads, and a bucket keeps one posting of a class and an element. Buckets are
   made in proportion to the number of elements. A bucket finds the elements that two classes share and returns them,
   with their document frequency, to their classes: one row for each target, a hash of classes. An element met by many classes of one map block is sent to its
   bucket as one mark instead of one posting for each, so a passage that a third of the corpus repeats stays small; its
   classes get such elements straight from the block, and those of copies in many blocks are merged in two salted steps.
3. A target merges the elements of its classes. An element of one class only cannot lie in an intersection, so a class
   whose shared elements are fewer than 75 % of its set links with nothing and leaves. This is a bound, not a cut.
4. prefixes: in rarest-first order two linked classes share an element of their prefixes; classes that do are put in
   one group (connected components of that relation), which holds every link inside itself.
5. Each group is joined by trie. Groups above a size are dealt in blocks by length class (two linked sets lie in the same
   or in neighbouring ones) and hash; a block is joined with itself once, and with another only by those of its classes
   that share a prefix element with a class there.
6. Links become components, and components come back to documents through the fingerprint; classes of at least a
   HOT_SHARE of all documents, of which there are fewer than 1 / HOT_SHARE, by broadcast.

Nulls, empty texts and texts without words have an empty set and link with nothing. A row is a document: repeated rows
are exact copies of each other. Elements and fingerprints are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import even_partitions, written
from srcloom.llm.skew import joined
from srcloom.llm.textbytes import give_back, mix64, shingle_sets, text_slices
from srcloom.operators.components import components

#: Elements that a bucket sorts at once, postings that a map block holds, and elements of a group joined in one task.
BUCKET_ELEMENTS = 2_000_000
BLOCK_ELEMENTS = 1_000_000
GROUP_ELEMENTS = 2_000_000
#: Fingerprints that a task remembers having sent, and parts in which one class's hot elements are merged first.
SENT, SALTS = 200_000, 64
#: An element of so many classes of one map block is hot: it goes to the end of the order, whatever its exact frequency.
HOT_IN_BLOCK = 32
HOT_FREQUENCY = 2**31 - 1


def _fingerprint(elements: np.ndarray) -> int:
    total = mix64(elements ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(mix64(np.array([total]))[0].astype(np.int64))


def _documents_sets(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, data, offsets in text_slices(batch.column("text")):
            yield ids.slice(a, b - a), shingle_sets(data, offsets, width)


def digests(docs: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and the fingerprint of the set, and the columns (longs) to keep."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                columns = [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [batch.column(c).slice(a, b - a) for c in keep], ["doc_id", "n_shingles", "fp", *keep])

    return docs.select("doc_id", "text", *keep).mapInArrow(run, "doc_id long, n_shingles long, fp long" + "".join(f", {c} long" for c in keep))


_POSTINGS = "bucket int, salt int, fps binary, sizes binary, counts binary, elements binary"
_SHARED = "target int, salt int, fps binary, sizes binary, counts binary, elements binary, frequencies binary"


class _Block:
    """Sets of one map block, until they are dealt to buckets.

    Hot postings need no meeting, so they go to buckets by the task's and the block's number, whatever the block holds.
    They are told by their salt, which is null for others.
    """

    def __init__(self, buckets: int, task: int = 0):
        self.buckets, self.task, self.number = buckets, task, -1
        self.sent: set[int] = set()
        self.clear()

    def clear(self) -> None:
        self.number += 1
        self.fps: list[int] = []
        self.sets: list[np.ndarray] = []
        self.elements = 0

    def add(self, elements: np.ndarray) -> None:
        fp = _fingerprint(elements)
        if len(elements) and fp not in self.sent:
            if len(self.sent) >= SENT:
                self.sent.clear()  # later copies are sent again and dropped by the buckets
            self.sent.add(fp)
            self.fps.append(fp)
            self.sets.append(elements)
            self.elements += len(elements)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.sets:
            return
        fps = np.array(self.fps, dtype=np.int64)
        sizes = np.array([len(s) for s in self.sets], dtype=np.uint32)
        ids = np.concatenate(self.sets)
        owners = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        where = _bucket_of(ids, self.buckets)
        order = np.lexsort((ids, where))
        ids, owners, where = ids[order], owners[order], where[order]
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        counts = np.diff(np.append(starts, len(ids)))
        hot = np.repeat(counts >= HOT_IN_BLOCK, counts)
        out: list[tuple] = []
        if hot.any():
            h, o = ids[hot], owners[hot]
            by = np.argsort(o, kind="stable")
            dealt = int(mix64(np.array([(self.task << 32) + self.number], dtype=np.uint64))[0] >> np.uint64(1))
            out.append((dealt % self.buckets, dealt // self.buckets % SALTS, fps, sizes, np.bincount(o, minlength=len(fps)).astype(np.uint32), h[by]))
        hot_starts = starts[counts >= HOT_IN_BLOCK]
        marks, mark_at = ids[hot_starts], where[hot_starts]
        ids, owners, where = ids[~hot], owners[~hot], where[~hot]
        for b in np.unique(np.concatenate((where, mark_at))).tolist():
            x, y = np.searchsorted(where, [b, b + 1])
            p, q = np.searchsorted(mark_at, [b, b + 1])
            present, local = np.unique(owners[x:y], return_inverse=True)
            by = np.argsort(local, kind="stable")
            # elements owner by owner; what is beyond the owners' counts are marks
            out.append((b, None, fps[present], sizes[present], np.bincount(local, minlength=len(present)).astype(np.uint32), np.concatenate((ids[x:y][by], marks[p:q]))))
        for k in range(0, len(out), 64):
            part = out[k : k + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in part], pa.int32()) for c in range(2)] + [pa.array([r[c].tobytes() for r in part], pa.binary()) for c in range(2, 6)],
                ["bucket", "salt", "fps", "sizes", "counts", "elements"],
            )


def _bucket_of(elements: np.ndarray, buckets: int) -> np.ndarray:
    return ((elements >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _postings(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches):
        block = _Block(buckets, TaskContext.get().partitionId())
        for _, sets in _documents_sets(batches, width):
            for s in sets:
                block.add(s)
                if block.elements >= BLOCK_ELEMENTS or len(block.sets) >= 60_000:
                    yield from block.rows()
                    block.clear()
        yield from block.rows()
        del block
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, _POSTINGS)


def _target_of(fps: np.ndarray, targets: int) -> np.ndarray:
    return (mix64(fps.view(np.uint64)) % np.uint64(targets)).astype(np.int32)


def _by_target(fps: np.ndarray, sizes: np.ndarray, ids: np.ndarray, frequencies: np.ndarray, targets: int, salt: int | None = None) -> list[tuple]:
    """(class, element) postings as one row for each target, sorted by class."""
    target = _target_of(fps, targets)
    order = np.lexsort((fps, target))
    target, fps, sizes, ids, frequencies = target[order], fps[order], sizes[order], ids[order], frequencies[order].astype(np.int32)
    out = []
    for t in np.unique(target).tolist():
        a, b = np.searchsorted(target, [t, t + 1])
        starts = np.flatnonzero(np.concatenate(([True], fps[a + 1 : b] != fps[a : b - 1]))) + a
        counts = np.diff(np.append(starts, b)).astype(np.uint32)
        out.append((t, salt, fps[starts].tobytes(), sizes[starts].astype(np.uint32).tobytes(), counts.tobytes(), ids[a:b].tobytes(), frequencies[a:b].tobytes()))
    return out


def _table_of(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["target", "salt", "fps", "sizes", "counts", "elements", "frequencies"])


def _merged(table: pa.Table) -> tuple[np.ndarray, ...]:
    """fp, size, element and frequency of the distinct (class, element) postings of rows, by class and element; of equal
    ones the greatest frequency."""
    columns = []
    for name, kind in (("fps", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("elements", np.uint64), ("frequencies", np.int32)):
        columns.append(np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)] or [np.zeros(0, dtype=kind)]))
    fps, sizes, counts, ids, frequencies = columns
    fps, sizes = np.repeat(fps, counts), np.repeat(sizes, counts)
    order = np.lexsort((-frequencies.astype(np.int64), ids, fps))
    fps, ids = fps[order], ids[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = (fps[1:] != fps[:-1]) | (ids[1:] != ids[:-1])
    order = order[first]
    return fps[first], sizes[order], ids[first], frequencies[order]


def _salted_merge(targets: int):
    """Hot elements of classes from many blocks, once for each salt."""

    def run(table: pa.Table) -> pa.Table:
        return _table_of(_by_target(*_merged(table), targets))

    return run


def _shared_in_bucket(targets: int):
    return lambda table: _table_of(_shared_postings(table, targets))


def _shared_postings(table: pa.Table, targets: int) -> list[tuple]:
    """The elements of a bucket that several classes hold, for the targets of these classes."""
    parts: list[tuple] = []
    fps, sizes, owners, ids, at = [], [], [], [], 0
    marks = []
    for row in table.to_batches():
        for k in range(row.num_rows):
            get = lambda c: row.column(c)[k].as_buffer()  # noqa: E731, B023
            f, n = np.frombuffer(get("fps"), dtype=np.int64), np.frombuffer(get("sizes"), dtype=np.uint32)
            e, counts = np.frombuffer(get("elements"), dtype=np.uint64), np.frombuffer(get("counts"), dtype=np.uint32)
            who = np.repeat(np.arange(len(f), dtype=np.int32), counts)
            salt = row.column("salt")[k].as_py()
            if salt is not None:
                parts += _by_target(f[who], n[who], e, np.full(len(who), HOT_FREQUENCY), targets, salt)
                continue
            marks.append(e[len(who) :])
            fps.append(f)
            sizes.append(n)
            owners.append(who + np.int32(at))
            ids.append(e[: len(who)])
            at += len(f)
    if ids:
        fps, sizes, owners, ids, marks = (np.concatenate(x) for x in (fps, sizes, owners, ids, marks))
        order = np.argsort(ids, kind="stable")
        ids, owners = ids[order], owners[order]
        marks = np.unique(marks)
        same = ids[1:] == ids[:-1] if len(ids) else np.zeros(0, dtype=bool)
        keep = np.zeros(len(ids), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        if len(marks):
            keep |= np.isin(ids, marks)
        ids, fp, n = ids[keep], fps[owners[keep]], sizes[owners[keep]]
        order = np.lexsort((fp, ids))
        ids, fp, n = ids[order], fp[order], n[order]
        if len(ids):
            once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (fp[1:] != fp[:-1])))  # copies of other tasks
            ids, fp, n = ids[once], fp[once], n[once]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            counts = np.diff(np.append(starts, len(ids)))
            df = np.repeat(np.where(np.isin(ids[starts], marks), HOT_FREQUENCY, counts), counts)
            ids, fp, n, df = ids[df > 1], fp[df > 1], n[df > 1], df[df > 1]
            parts += _by_target(fp, n, ids, df, targets)
    return parts


_RANKED = np.dtype([("f", np.int32), ("e", np.uint64)])


def _ordered(percent: int):
    """Classes of a target whose shared elements can reach the threshold: these, rarest first, and the prefix."""

    def run(table: pa.Table) -> pa.Table:
        fps, sizes, ids, frequencies = _merged(table)
        starts = np.flatnonzero(np.concatenate(([True], fps[1:] != fps[:-1]))) if len(fps) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(fps)))
        least = -(-percent * sizes[starts].astype(np.int64) // 100)
        enough = np.repeat(counts >= least, counts)
        fps, sizes, ids, frequencies = fps[enough], sizes[enough], ids[enough], frequencies[enough]
        order = np.lexsort((ids, frequencies, fps))
        rank = np.empty(len(order), dtype=_RANKED)
        rank["f"], rank["e"] = frequencies[order], ids[order]
        counts, least = counts[counts >= least], least[counts >= least]
        cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        sets = [rank[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        prefixes = [s["e"][: len(s) - k + 1].astype(np.int64) for s, k in zip(sets, least.tolist(), strict=True)]
        columns = [pa.array(fps[cuts[:-1]]), pa.array(sizes[cuts[:-1]].astype(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["fp", "n", "elements", "prefix"])

    return run


class PrefixTree:
    """A trie of sets written in the global order, and the join of sets with it.

    `sets` are increasing arrays of small ints (ranks in the global order), `sizes` the full set sizes. A node holds the
    elements between two branchings, STEP of them at most; sets share the nodes of their common beginning. Per node the
    smallest and largest full size and the farthest end below it serve as bounds.
    """

    STEP = 32
    #: (query, node) pairs that a traversal looks at together.
    FRONTIER = 1 << 16

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.percent, self.sets, self.sizes = percent, sets, sizes.astype(np.int64)
        lengths = np.array([len(s) for s in sets], dtype=np.int64)
        self.universe = int(max((int(s[-1]) for s in sets if len(s)), default=-1)) + 1
        begin, end, parent, of, self.leaf_node = self._built(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()))
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        self.flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        self.first, self.count, self.end, self.parent = cuts[of] + begin, end - begin, end, parent
        total = len(parent)
        self.children = np.argsort(parent, kind="stable")
        self.child_cut = np.searchsorted(parent[self.children], np.arange(-1, total + 1))
        self.by_level = self._levels()
        self.ends = np.argsort(self.leaf_node, kind="stable")
        self.end_cut = np.searchsorted(self.leaf_node[self.ends], np.arange(total + 1))
        self.smallest = self._up(self.sizes, np.minimum, 1 << 60)
        self.largest = self._up(self.sizes, np.maximum, -1)
        self.below = np.maximum(self._up(lengths, np.maximum, -1) - end, 0)
        root = np.arange(total)
        for level in self.by_level[1:]:
            root[level] = root[parent[level]]
        prefixes = [s[: self.prefix_length(len(s), n)] for s, n in zip(sets, self.sizes.tolist(), strict=True)]
        pairs = np.unique(np.concatenate(prefixes) * np.int64(total) + np.repeat(root[self.leaf_node], [len(p) for p in prefixes]))
        #: Which roots have a set below them with an element in its prefix.
        self.index_element, self.index_root = pairs // total, pairs % total

    def prefix_length(self, held: int, size: int) -> int:
        return max(0, held + (-self.percent * size // 100) + 1)

    def _built(self, order: list[int]) -> tuple[np.ndarray, ...]:
        begin, end, parent, of, leaf = [], [], [], [], np.zeros(len(order), dtype=np.int64)
        path: list[int] = []
        last = np.zeros(0, dtype=np.int64)

        def node(a: int, b: int, above: int, owner: int) -> int:
            begin.append(a)
            end.append(b)
            parent.append(above)
            of.append(owner)
            return len(begin) - 1

        for i in order:
            s = self.sets[i]
            k = min(len(s), len(last))
            differs = np.flatnonzero(s[:k] != last[:k])
            common = int(differs[0]) if len(differs) else k
            while path and begin[path[-1]] >= common and end[path[-1]] > common:
                path.pop()
            if path and end[path[-1]] > common:  # the paths part inside a node
                whole = path.pop()
                upper = node(begin[whole], common, parent[whole], of[whole])
                begin[whole], parent[whole] = common, upper
                path.append(upper)
            for a in range(common, len(s), self.STEP):
                path.append(node(a, min(a + self.STEP, len(s)), path[-1] if path else -1, i))
            leaf[i] = path[-1]
            last = s
        return (*(np.array(x, dtype=np.int64) for x in (begin, end, parent, of)), leaf)

    def _levels(self) -> list[np.ndarray]:
        out, level = [], self._children_of(np.array([-1]))[1]
        while len(level):
            out.append(level)
            level = self._children_of(level)[1]
        return out

    def _children_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each child of the nodes, the place of its parent among them, and the child."""
        at, n = self.child_cut[nodes + 1], self.child_cut[nodes + 2] - self.child_cut[nodes + 1]
        reps = np.repeat(np.arange(len(nodes)), n)
        return reps, self.children[at[reps] + np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)]

    def _up(self, values: np.ndarray, best, start: int) -> np.ndarray:
        out = np.full(len(self.parent), start, dtype=np.int64)
        best.at(out, self.leaf_node, values)
        for level in self.by_level[:0:-1]:
            best.at(out, self.parent[level], out[level])
        return out

    def _least_overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest overlap at which sets of a and b elements link: 100 o >= percent (a + b - o)."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def _starts(self, queries: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, root) for roots above a set that holds, in its prefix, an element of the query's prefix."""
        wanted = [s[: self.prefix_length(len(s), n)] for s, n in zip(queries, sizes.tolist(), strict=True)]
        element, query = np.concatenate(wanted), np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        at = np.searchsorted(self.index_element, element)
        n = np.searchsorted(self.index_element, element, side="right") - at
        reps = np.repeat(np.arange(len(element)), n)
        roots = self.index_root[at[reps] + np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)]
        pairs = np.unique(query[reps] * np.int64(max(1, len(self.parent))) + roots)
        return pairs // max(1, len(self.parent)), pairs % max(1, len(self.parent))

    def join(self, queries: list[np.ndarray], sizes: np.ndarray, own: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, set) pairs of different components that link, by place; `own` and `component` name the components of
        queries and sets, and subtrees wholly in the query's component are passed over."""
        low, high = self._up(component, np.minimum, 1 << 60), self._up(component, np.maximum, -1)
        bits = np.zeros((len(queries), self.universe // 8 + 1), dtype=np.uint8)
        for k, s in enumerate(queries):
            s = s[s < self.universe]
            np.bitwise_or.at(bits[k], s >> 3, (1 << (s & 7)).astype(np.uint8))
        held = np.array([len(s) for s in queries])
        q, node = self._starts(queries, sizes)
        stack = [(q, node, np.zeros(len(q), dtype=np.int64))]
        left, right = [], []
        while stack:
            q, node, overlap = stack.pop()
            if len(q) > self.FRONTIER:
                stack.append((q[self.FRONTIER :], node[self.FRONTIER :], overlap[self.FRONTIER :]))
                q, node, overlap = q[: self.FRONTIER], node[: self.FRONTIER], overlap[: self.FRONTIER]
            within = ~((low[node] == high[node]) & (low[node] == own[q]))
            a = sizes[q]
            within &= (100 * self.largest[node] >= self.percent * a) & (self.percent * self.smallest[node] <= 100 * a)
            q, node, overlap = q[within], node[within], overlap[within]
            if not len(q):
                continue
            n = self.count[node]
            reps = np.repeat(np.arange(len(node)), n)
            e = self.flat[self.first[node][reps] + np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)]
            overlap = overlap + np.bincount(reps, weights=(bits[q[reps], e >> 3] >> (e & 7)) & 1, minlength=len(node)).astype(np.int64)
            a = sizes[q]
            smallest = np.maximum(self.smallest[node], -(-self.percent * a // 100))
            alive = overlap + np.minimum(held[q] - overlap, self.below[node]) >= self._least_overlap(a, smallest)
            q, node, overlap = q[alive], node[alive], overlap[alive]
            n_ends = self.end_cut[node + 1] - self.end_cut[node]
            at = np.flatnonzero(n_ends)
            if len(at):
                reps = np.repeat(at, n_ends[at])
                place = np.arange(len(reps)) - np.repeat(np.cumsum(n_ends[at]) - n_ends[at], n_ends[at])
                other = self.ends[self.end_cut[node[reps]] + place]
                ok = (overlap[reps] >= self._least_overlap(sizes[q[reps]], self.sizes[other])) & (component[other] != own[q[reps]])
                left.append(q[reps][ok])
                right.append(other[ok])
            total = np.cumsum(self.child_cut[node + 2] - self.child_cut[node + 1])
            cut = 0
            while cut < len(node):  # children of so many nodes as fill a frontier
                stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + self.FRONTIER, side="right")))
                reps, child = self._children_of(node[cut:stop])
                if len(child):
                    stack.append((q[cut:stop][reps], child, overlap[cut:stop][reps]))
                cut = stop
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_sets(sets: list[np.ndarray], sizes: np.ndarray, percent: int, asks: np.ndarray | None = None, batch: int = 64) -> np.ndarray:
    """For each set the smallest index that it reaches over links. With `asks` only links between a set that asks and one
    that does not are looked for."""
    parent = np.arange(len(sets))
    sizes = sizes.astype(np.int64)
    stands = np.arange(len(sets)) if asks is None else np.flatnonzero(~asks)
    asking = np.arange(len(sets)) if asks is None else np.flatnonzero(asks)
    if not len(stands) or not len(asking):
        return parent
    tree = PrefixTree([sets[i] for i in stands.tolist()], sizes[stands], percent)
    by_length = asking[np.argsort(sizes[asking], kind="stable")]
    at, step = 0, 4
    while at < len(by_length):
        queries = by_length[at : at + step]
        found = tree.join([sets[i] for i in queries.tolist()], sizes[queries], parent[queries], parent[stands])
        for x, y in zip(queries[found[0]].tolist(), stands[found[1]].tolist(), strict=True):
            x, y = _find(parent, x), _find(parent, y)
            parent[max(x, y)] = min(x, y)
        for _ in range(64):
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        at, step = at + step, min(batch, step * 2)
    return parent


def _join_group(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links (as a spanning star of each component) among the classes of one group or block, or between two blocks."""
        raw = [np.frombuffer(x, dtype=_RANKED) for x in frame["elements"]]
        _, rank = np.unique(np.concatenate(raw), return_inverse=True)  # by frequency, then id: the global order
        sets = np.split(rank.astype(np.int64), np.cumsum([len(x) for x in raw])[:-1])
        asks = frame["asks"].to_numpy()
        root = linked_sets(sets, frame["n"].to_numpy(), percent, asks.astype(bool) if frame["i"].iloc[0] != frame["j"].iloc[0] else None)
        fps = frame["fp"].to_numpy()
        return pd.DataFrame({"u": fps, "v": fps[root]})

    return run


def dealt_groups(sets: DataFrame, groups: DataFrame, percent: int, group_elements: int | None = None) -> DataFrame:
    """Which classes meet where: root, blocks i and j, fp, n, elements and asks (whether it is of block j, i being another).

    A group above `group_elements` is cut in blocks by length class and hash. Each block meets itself, and a class visits
    another block of its own or a neighbouring length class where a class holds an element of its prefix.
    """
    most = group_elements or GROUP_ELEMENTS
    placed = sets.select("fp", "n", F.octet_length("elements").alias("w")).join(groups.withColumnRenamed("node", "fp"), "fp")
    # links need sizes within percent of each other, so length classes of that ratio
    length = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("long")
    weight = placed.groupBy("root").agg(F.sum("w").alias("w")).filter(F.col("w") > most * _RANKED.itemsize).select("root", F.lit(True).alias("large"))
    marked = placed.join(weight, "root", "left").withColumn("k", F.when(F.col("large"), length))
    parts = marked.filter("large").groupBy("root", "k").agg(F.ceil(F.sum("w") / (most * _RANKED.itemsize)).alias("parts"))
    blocked = marked.join(parts, ["root", "k"], "left").withColumn("h", F.when(F.col("large"), F.pmod(F.xxhash64("fp"), F.col("parts"))))
    home = blocked.select("fp", "root", F.coalesce(F.col("k") * (1 << 32) + F.col("h"), F.lit(0)).alias("b"), "large")
    home = written(home, "blocks")
    own = home.select("fp", "root", F.col("b").alias("i"), F.col("b").alias("j"), F.lit(False).alias("asks"))
    held = home.filter("large").join(sets.select("fp", F.explode("prefix").alias("element")), "fp")
    hosts = held.select("element", F.col("b").alias("host")).distinct()
    near = (F.col("b") != F.col("host")) & (F.abs(F.shiftright("b", 32) - F.shiftright("host", 32)) <= 1)
    visits = held.join(hosts, "element").filter(near).select("fp", "root", F.least("b", "host").alias("i"), F.greatest("b", "host").alias("j"), (F.col("b") > F.col("host")).alias("asks")).distinct()
    return own.unionByName(visits).join(sets.select("fp", "n", "elements"), "fp")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable over links.

    An empty set is linked with nothing: its component is its own doc_id. An empty table gives an empty result.
    """
    return grouped_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def grouped_rows(docs: DataFrame, width: int = 5, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """As near_duplicates, with the columns (longs) to keep and `component`, which tells components apart whatever their
    rows' doc_id is, and is null for an empty set."""
    digest = written(digests(docs, width, keep), "digest")
    total, n_rows = digest.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    buckets = min(1 << 24, even_partitions(total, BUCKET_ELEMENTS, 12))
    shared = _postings(docs, width, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared_in_bucket(buckets), _SHARED)
    shared = written(shared, "shared")
    hot = shared.filter("salt IS NOT NULL").groupBy("target", "salt").applyInArrow(_salted_merge(buckets), _SHARED)
    gathered = shared.filter("salt IS NULL").unionByName(hot).repartition(buckets, "target")
    sets = written(gathered.groupBy("target").applyInArrow(_ordered(percent), "fp long, n long, elements binary, prefix array<long>"), "sets")
    prefix = sets.select("fp", F.explode("prefix").alias("element"))
    leaders = prefix.groupBy("element").agg(F.min("fp").alias("v"), F.count("*").alias("k")).filter("k > 1").select("element", "v")
    groups = components(prefix.join(leaders, "element").select(F.col("fp").alias("u"), "v"))
    links = dealt_groups(sets, groups, percent).groupBy("root", "i", "j").applyInPandas(_join_group(percent), "u long, v long").filter("u <> v")
    found = components(links)
    classes = written(digest.filter("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    smallest = found.join(classes, found["node"] == classes["fp"]).groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    linked = joined(found, written(smallest, "smallest"), ["root"], "members", found.count()).select(F.col("node").alias("fp"), "component_id", F.col("root").alias("component"))
    named = classes.join(linked, "fp", "left").select(F.col("fp").alias("key"), "copies", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    empty = digest.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    filled = joined(digest.filter("n_shingles > 0").withColumnRenamed("fp", "key"), written(named, "named"), ["key"], "copies", n_rows)
    return filled.unionByName(empty.withColumnRenamed("fp", "key")).select("doc_id", "n_shingles", "component_id", "component", *keep)
