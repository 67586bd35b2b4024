"""Hard negatives against brute force, with small groups, ties, copies and rows that take no part."""

import math
import random

import numpy as np
import pytest

from srcloom.llm import hard_negatives


def brute(rows, anchors_each=50):
    """Result rows by comparing every anchor with every row."""
    used = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for i, label, v in used:
        if i % anchors_each:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in used if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            inside = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside[:3])]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, row string, place int, dim string"


def told(spark, rows, kind=SCHEMA, **sizes):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], kind)
    return sorted(tuple(r) for r in hard_negatives.mined(hard_negatives.coded(df), **sizes).collect())


def some_rows(seed, n, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(5)]
    return [(i, r.randrange(10), np.float32([x + r.gauss(0, 0.05) for x in r.choice(centres)]).tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "group"), [(1, 1 << 19), (2, 64 * 6)])
def test_hard_negatives_are_those_of_brute_force(spark, seed, group):
    rows = some_rows(seed, 500)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(150)]  # copies of an anchor's vector, in ties
    rows += [(2000, 1, None), (None, 1, rows[0][2]), (2050, None, rows[0][2]), (2100, 1, []), (2150, 1, [None] * 6), (2200, 2, [float("nan")] * 6), (2250, 2, [float("inf")] + [0.0] * 5), (2300, 3, [0.0] * 6)]
    rows += [(2350 + i, 4, [0.1, 0.2, -0.3]) for i in range(60)] + [(2450 + i, 5, [0.1 + i / 1000, 0.1, -0.3]) for i in range(60)]
    assert told(spark, rows, group_components=group) == brute(rows)


def test_one_hot_label_and_repeated_ids(spark):
    rows = [(i, 1 if i % 3 else i % 10, v) for i, _, v in some_rows(3, 300)]
    again = [rows[50], rows[50], rows[7]]
    got = told(spark, rows + again, group_components=64 * 6)
    assert got == sorted(brute(rows + again))


def test_doubles_beyond_exact_sums(spark):
    r = random.Random(5)
    rows = [(i, i % 4, [r.choice([-1, 1]) * r.random() * 1e5 for _ in range(4)]) for i in range(200)]
    rows += [(300 + i, i % 4, [1e4 + i, 5e5, -2e5, 3e5]) for i in range(50)]
    kind = SCHEMA.replace("float", "double")
    assert told(spark, rows, kind) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert told(spark, []) == []
    assert told(spark, [(1, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5])]) == []
    assert told(spark, [(50, 1, [0.5, 0.5])]) == []


def test_search_prunes_boxes_and_keeps_ties():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-3, 3, (400, 3)) + c for c in ([100, 0, 0], [0, 100, 0], [0, 0, 100], [-100, 0, 0])])
    order = hard_negatives.str_order(x, 16)
    x = x[order]
    ids, labels = r.permutation(1600).astype(np.int64), np.zeros(1600, dtype=np.int64)
    tree = hard_negatives.RTree(ids, labels, x, np.arange(0, 1601, 16))
    looked = []
    tree.x = type("Seen", (np.ndarray,), {"__getitem__": lambda self, k: (looked.append(k), np.ndarray.__getitem__(self, k))[1]})(x.shape, x.dtype, x.copy())
    a = np.array([[7, 1, 0]])
    best, found = tree.search(a, np.array([-1]), np.array([0]), np.array([0]), np.array([-(1 << 62)]), np.array([1 << 62]), 5, True)
    score = x @ a[0]
    assert list(zip(best[0].tolist(), found[0].tolist(), strict=True)) == [(int(-s), int(i)) for s, i in sorted(zip(-score, ids, strict=True))[:5]]
    assert len([k for k in looked if isinstance(k, slice)]) < 30  # of 100 leaves
