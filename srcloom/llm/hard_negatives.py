"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score lies in a window below the positive's.

Method: STR-packed R-tree. Rows are sorted by label and tiled (by the coordinate that varies most into slabs, then within
each slab by the next), with exact ranks made by Spark, and cut into groups of equal size; within a group the tiling goes
on to leaves. Every node has a minimum bounding box, which bounds the inner product with an anchor by the sum of
one interval for each coordinate. Boxes of whole groups and of whole blocks of anchors are compared before any vector moves. A group
searches its tree for a block of anchors at once, best box first: a box goes if its interval lies outside the score windows of
all queries, or strictly below their k-th best so far; equal scores stay in the race, as ties go to the smaller vec_id.

Two searches: the positives (same label, k best), then the negatives (other labels, within the windows of the positives).
Results are those of brute force. A cell of the search has one group and one block of anchors, whatever the size of the table;
copies of one vector or rows of one label are dealt over groups by rank like all others.

Rows with a null vec_id, label or vector, an empty vector, or null or non-finite components take no part. Only vectors of equal length meet.
Rows that repeat a vec_id are rows of their own, but none is another's positive or negative; each repeated anchor row
is asked for itself. Scores are whole numbers that must fit in a long, as the result's type says. An anchor without
positives, or a window without rows (as below a negative positive score), gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.shared import even_partitions, written
from srcloom.llm.ranking import ranked
from srcloom.llm.skew import joined

#: Fixed values of the contract.
ANCHORS_EACH, RELABEL_EACH, LABELS, SCALE, POSITIVES, NEGATIVES, LEAST_PERCENT, MOST_PERCENT = 50, 7, 10, 256, 5, 3, 50, 95

#: Components in a group, rows in a leaf, children of a node, anchors in a block, groups whose boxes are kept together.
GROUP_COMPONENTS, LEAF, FAN, BLOCK, CHUNK = 1 << 19, 128, 8, 4096, 256

#: Stands for a window without bounds.
_FAR = 1 << 62


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (array<double>) and dim of the rows that take part."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0").filter(finite).withColumn("dim", F.size("vector"))


def coded(vectors: DataFrame) -> DataFrame:
    """The rows of the contract: labels changed for some ids, components as whole numbers."""
    label = F.when(F.col("vec_id") % RELABEL_EACH == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return usable(vectors).withColumn("label", label).withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE)))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        flat, cuts = vectors.values.to_numpy().astype(np.float64), vectors.offsets.to_numpy()
        at = np.arange(cuts[-1] - cuts[0]) - np.repeat(cuts[:-1] - cuts[0], np.diff(cuts))
        flat = flat[cuts[0] : cuts[-1]]
        n = np.bincount(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64()), pa.array(np.bincount(at, flat)), pa.array(np.bincount(at, flat * flat))], ["c", "n", "s", "q"])


def widest(rows: DataFrame, k: int = 2) -> list[int]:
    """The k coordinates that vary most."""
    sums = rows.select("vector").mapInArrow(_spread, "c int, n long, s double, q double").groupBy("c").agg(*[F.sum(x).alias(x) for x in "nsq"])
    found = [r.c for r in sums.orderBy(F.desc(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2), "c").limit(k).collect()]
    return (found + [0] * k)[:k]


def tiled(rows: DataFrame, group_components: int = GROUP_COMPONENTS) -> tuple[DataFrame, int, int]:
    """Rows with their group (place // rows in a group), sorted and tiled by label and coordinates; the number of groups."""
    held = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dim = held.agg(F.count("*"), F.max("dim")).first()
    if not n:
        return held.withColumns({"place": F.lit(0).cast("long"), "group": F.lit(0)}), 0, 1
    each = max(64, group_components // dim)
    first, second = (F.get("vector", F.lit(c)) for c in widest(held))
    one = written(ranked(held, [F.col("dim"), F.col("label"), first, F.col("row")], "slab-ranges", "at"), "slabs")
    labels = one.groupBy("dim", "label").agg(F.min("at").alias("start"), F.count("*").alias("n"), F.count("*").alias("weight"))
    slab = F.ceil(F.col("n") / F.ceil(F.sqrt(F.ceil(F.col("n") / each))))
    slabs = joined(one, written(labels, "labels"), ["dim", "label"], "weight", n).withColumn("slab", F.floor((F.col("at") - F.col("start")) / slab))
    two = ranked(written(slabs.drop("at", "start", "n"), "slabbed"), [F.col("dim"), F.col("label"), F.col("slab"), second, F.col("row")], "tile-ranges", "place")
    return written(two.drop("slab").withColumn("group", F.floor(F.col("place") / each).cast("int")), "tiles"), even_partitions(n, each), each


def str_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows in which each run of `leaf` is a tile: sorted and cut by up to three coordinates in turn."""
    order = np.arange(len(x))
    axes = np.argsort(-x.var(axis=0), kind="stable")[:3]

    def tile(part: np.ndarray, left: np.ndarray) -> np.ndarray:
        part = part[np.argsort(x[part, left[0]], kind="stable")]
        pages = -(-len(part) // leaf)
        if len(left) == 1 or pages == 1:
            return part
        slab = -(-pages // int(np.ceil(pages ** (1 / len(left))))) * leaf
        return np.concatenate([tile(part[a : a + slab], left[1:]) for a in range(0, len(part), slab)])

    return tile(order, axes) if len(x) else order


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    return column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _packed_numbers(x: np.ndarray) -> bytes:
    small = x.size == 0 or (x.min() >= -(2**15) and x.max() < 2**15)
    return x.astype(np.int16 if small else np.int64).tobytes()


def _unpacked_numbers(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int16 if len(data) == 2 * n * dim else np.int64).reshape(n, dim)


_BOX = "low array<double>, high array<double>, least_label long, most_label long"
_GROUP = f"dim int, group int, chunk int, ids binary, labels binary, vectors binary, cuts binary, {_BOX}"
_BLOCK = f"dim int, block int, part int, rows binary, ids binary, labels binary, vectors binary, asker binary, positive binary, least binary, most binary, lowest long, highest long, {_BOX}"


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table({n: pa.array([r[n] for r in rows], kinds[k]) for n, k in fields})


def _box(x: np.ndarray, labels: np.ndarray) -> dict:
    return {"low": x.min(axis=0).astype(float).tolist(), "high": x.max(axis=0).astype(float).tolist(), "least_label": int(labels.min()), "most_label": int(labels.max())}


def _pack_group(key: tuple, table: pa.Table) -> pa.Table:
    x, ids, labels = _vectors(table), table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    order, cuts, held = [], [0], 0
    by = np.argsort(labels, kind="stable")
    for segment in np.split(by, np.flatnonzero(np.diff(labels[by])) + 1):
        if len(segment) >= LEAF or held + len(segment) > LEAF:  # a label of its own leaves; rare labels share one
            if cuts[-1] != sum(map(len, order)):
                cuts.append(sum(map(len, order)))
            held = 0
        order.append(segment[str_order(x[segment], LEAF)])
        if len(segment) >= LEAF:
            cuts += [cuts[-1] + k for k in range(LEAF, len(segment), LEAF)] + [cuts[-1] + len(segment)]
        else:
            held += len(segment)
    order = np.concatenate(order)
    if cuts[-1] != len(order):
        cuts.append(len(order))
    dim, group = key[0].as_py(), key[1].as_py()
    return _table(_GROUP, [{"dim": dim, "group": group, "chunk": group // CHUNK, "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": _packed_numbers(x[order]), "cuts": np.array(cuts).tobytes(), **_box(x, labels)}])


def _pack_block(key: tuple, table: pa.Table) -> pa.Table:
    """Anchors of one block, in parts of BLOCK, with their queries: one without bounds, or one for each positive."""
    out = []
    table = table.sort_by("place")
    for part, a in enumerate(range(0, table.num_rows, BLOCK)):
        some = table.slice(a, BLOCK)
        x, labels = _vectors(some), some.column("label").to_numpy()
        asked = some.column("positives").to_pylist() if "positives" in some.column_names else [None] * some.num_rows
        queries = []
        for k, positives in enumerate(asked):
            for p in positives if positives is not None else [None]:
                score = None if p is None else p["positive_score"]
                low, high = (-_FAR, _FAR) if p is None else (-(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100)
                if low <= high:
                    queries.append((k, 0 if p is None else p["slot"], low, high))
        if queries:
            asker, slot, low, high = (np.array(c, dtype=np.int64) for c in zip(*queries, strict=True))
            out.append({"dim": key[0].as_py(), "block": key[1].as_py(), "part": part, "rows": some.column("row").to_numpy().tobytes(), "ids": some.column("vec_id").to_numpy().tobytes(), "labels": labels.tobytes(),
                        "vectors": _packed_numbers(x), "asker": asker.tobytes(), "positive": slot.tobytes(), "least": low.tobytes(), "most": high.tobytes(), "lowest": int(low.min()), "highest": int(high.max()), **_box(x, labels)})
    return _table(_BLOCK, out)


class RTree:
    """Rows of a group in leaves, with the boxes and labels of all levels of nodes above them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, cuts: np.ndarray, fan: int = FAN):
        self.ids, self.labels, self.x, self.cuts, self.fan = ids, labels, x, cuts, fan
        starts = cuts[:-1]
        self.levels = [(np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts))]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            starts = np.arange(0, len(below[0]), fan)
            self.levels.append(tuple(f.reduceat(v, starts) for f, v in zip((np.minimum, np.maximum) * 2, below, strict=True)))

    def search(self, a: np.ndarray, a_ids: np.ndarray, a_labels: np.ndarray, asker: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows of each query (an anchor and a window of scores), least + 1 places from 0 up where there are fewer."""
        d = a.shape[1]
        size = float(np.abs(a).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * d
        fast = size < 2**53  # sums of doubles are exact
        slack = 0 if fast else size * d * 2.0**-50
        up, down, wide = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64), a.astype(np.float64 if fast else np.int64)
        best, found = np.full((len(asker), k), -(1 << 63), dtype=np.int64), np.full((len(asker), k), (1 << 63) - 1, dtype=np.int64)
        queue: list[tuple[float, int, int, int, np.ndarray, np.ndarray]] = []
        pushed = 0

        def push(level: int, nodes: np.ndarray, queries: np.ndarray) -> None:
            nonlocal pushed
            low, high, l0, l1 = (v[nodes].astype(np.float64) if i < 2 else v[nodes] for i, v in enumerate(self.levels[level]))
            who, at = np.unique(asker[queries], return_inverse=True)
            above, below = (up[who] @ high.T + down[who] @ low.T) + slack, (up[who] @ low.T + down[who] @ high.T) - slack
            own = a_labels[who][:, None]
            fits = (l0 <= own) & (own <= l1) if same else ~((l0 == own) & (l1 == own))
            floor = np.maximum(least[queries], best[queries, -1])
            keep = fits[at] & (above[at] >= floor[:, None]) & (below[at] <= most[queries][:, None])
            for j in range(len(nodes)):
                mine = np.flatnonzero(keep[:, j])
                if len(mine):
                    bound = above[at[mine], j]
                    heapq.heappush(queue, (-float(bound.max()), pushed, level, int(nodes[j]), queries[mine], bound))
                    pushed += 1

        push(len(self.levels) - 1, np.arange(1), np.arange(len(asker)))
        while queue:
            _, _, level, node, queries, bound = heapq.heappop(queue)
            queries = queries[bound >= best[queries, -1]]
            if not len(queries):
                continue
            if level:
                push(level - 1, np.arange(node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0]))), queries)
                continue
            rows = slice(self.cuts[node], self.cuts[node + 1])
            who, at = np.unique(asker[queries], return_inverse=True)
            score = (wide[who] @ self.x[rows].astype(wide.dtype).T).astype(np.int64)
            allowed = ((self.labels[rows] == a_labels[who][:, None]) == same) & (self.ids[rows] != a_ids[who][:, None])
            score, allowed = score[at], allowed[at]
            allowed &= (score >= np.maximum(least[queries], best[queries, -1])[:, None]) & (score <= most[queries][:, None])
            hit = np.flatnonzero(allowed.any(axis=1))
            if len(hit):
                q = queries[hit]
                scores = np.concatenate((best[q], np.where(allowed[hit], score[hit], -(1 << 63))), axis=1)
                ids = np.concatenate((found[q], np.where(allowed[hit], self.ids[rows], (1 << 63) - 1)), axis=1)
                order = np.lexsort((ids, ~scores), axis=-1)[:, :k]  # ~ reverses the order of whole numbers without overflow
                best[q], found[q] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
        return best, found


def _cell(k: int, same: bool):
    kinds = {"row": pa.int64(), "anchor_id": pa.int64(), "slot": pa.int32(), "score": pa.int64(), "vec_id": pa.int64()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in left.to_pylist():
            rows, a_ids, a_labels, asker, slot, least, most = (np.frombuffer(b[n], dtype=np.int64) for n in ("rows", "ids", "labels", "asker", "positive", "least", "most"))
            a = _unpacked_numbers(b["vectors"], len(a_ids), b["dim"])
            for g in right.to_pylist():
                ids, labels, cuts = (np.frombuffer(g[n], dtype=np.int64) for n in ("ids", "labels", "cuts"))
                tree = RTree(ids, labels, _unpacked_numbers(g["vectors"], len(ids), g["dim"]), cuts)
                best, found = tree.search(a, a_ids, a_labels, asker, least, most, k, same)
                q, place = np.nonzero(best > -(1 << 63))
                out.append([rows[asker[q]], a_ids[asker[q]], slot[q], best[q, place], found[q, place]])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
        return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), columns, strict=True)})

    return run


def _meeting(same: bool):
    """Of a block and the boxes of a chunk of groups: the groups that its queries have to see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                boxes = r["boxes"]
                al, ah = np.array(r["low"]), np.array(r["high"])
                xl, xh = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
                corners = np.stack([al * xl, al * xh, ah * xl, ah * xh])
                slack = np.abs(corners).max(initial=0) * len(al) ** 2 * 2.0**-50
                above, below = corners.max(axis=0).sum(axis=1) + slack, corners.min(axis=0).sum(axis=1) - slack
                l0, l1 = np.array([b["least_label"] for b in boxes]), np.array([b["most_label"] for b in boxes])
                one = (r["least_label"] == r["most_label"]) & (l0 == l1) & (l0 == r["least_label"])
                keep = (above >= r["lowest"]) & (below <= r["highest"]) & ((l0 <= r["most_label"]) & (l1 >= r["least_label"]) if same else ~one)
                out.append({"dim": r["dim"], "block": r["block"], "part": r["part"], "chunk": r["chunk"], "groups": [boxes[i]["group"] for i in np.flatnonzero(keep)]})
            kinds = {"dim": pa.int32(), "block": pa.int32(), "part": pa.int32(), "chunk": pa.int32(), "groups": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in kinds.items()], list(kinds))

    return run


def searched(blocks: DataFrame, groups: DataFrame, n_groups: int, k: int, same: bool) -> DataFrame:
    """row, anchor_id, slot, score and vec_id of the k best of each query of the blocks over all groups."""
    chunks = even_partitions(n_groups, CHUNK)
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    boxes = groups.groupBy("dim", "chunk").agg(F.collect_list(F.struct("group", "low", "high", "least_label", "most_label")).alias("boxes"))
    asked = blocks.select("dim", "block", "part", "lowest", "highest", "low", "high", "least_label", "most_label", every.alias("chunk"))
    pairs = written(asked.join(boxes, ["dim", "chunk"]).mapInArrow(_meeting(same), "dim int, block int, part int, chunk int, groups array<int>"), "meetings")
    left = blocks.drop("low", "high", "least_label", "most_label", "lowest", "highest").withColumn("chunk", every).join(pairs, ["dim", "block", "part", "chunk"]).withColumn("group", F.explode("groups")).drop("groups", "chunk")
    meets = pairs.select("dim", "block", "part", F.explode("groups").alias("group"))
    right = groups.select("dim", "group", "ids", "labels", "vectors", "cuts").join(meets, ["dim", "group"])
    cell = ("dim", "block", "part", "group")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k, same), "row long, anchor_id long, slot int, score long, vec_id long")
    by = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def mined(rows: DataFrame, anchors_each: int = ANCHORS_EACH, positives: int = POSITIVES, negatives: int = NEGATIVES, group_components: int = GROUP_COMPONENTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores over rows (vec_id, label, whole-numbered vector, dim)."""
    tiles, n_groups, each = tiled(rows, group_components)
    groups = written(tiles.select("dim", "group", "vec_id", "label", "vector").groupBy("dim", "group").applyInArrow(_pack_group, _GROUP), "groups")
    block = F.floor(F.col("place") / (each * 25)).cast("int").alias("block")
    anchors = tiles.filter(F.col("vec_id") % anchors_each == 0).select("dim", block, "place", "row", "vec_id", "label", "vector")
    plain = written(anchors.groupBy("dim", "block").applyInArrow(_pack_block, _BLOCK), "anchors")
    best = written(searched(plain, groups, max(1, n_groups), positives, True).select("row", F.col("place").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = best.groupBy("row").agg(F.collect_list(F.struct("slot", "positive_score")).alias("positives"))
    windows = written(anchors.join(listed, "row").groupBy("dim", "block").applyInArrow(_pack_block, _BLOCK), "windows")
    found = searched(windows, groups, max(1, n_groups), negatives, False)
    return found.join(best, ["row", "slot"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(vectors: DataFrame) -> DataFrame:
    """The hard negatives of the contract."""
    return mined(coded(vectors))


#: The same rows in DuckDB.
SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL_EACH} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % {ANCHORS_EACH} = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same
  AND {LEAST_PERCENT} * positive_score <= 100 * score AND 100 * score <= {MOST_PERCENT} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
