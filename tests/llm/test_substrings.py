"""Substring dedup against brute force over windows, for several sizes of blocks, groups and hot prefixes."""

import hashlib
import random
import re

import numpy as np
import pytest

from srcloom.llm import substrings
from srcloom.sources.tables import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept text) of each row, from all windows of all rows."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, text string, block string, task int, h string")


def told(df):
    return sorted(map(repr, ((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect())))


def some_rows(seed, n, window):
    """Texts of a small vocabulary with shared passages, copies, near copies and repeats of their own."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(60)}"
    passages = [[word() for _ in range(r.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(r.choice([0, 3, window, 2 * window]))]
        for _ in range(r.randrange(4)):
            text += r.choice(passages) + [word() for _ in range(r.randrange(window))]
        if rows and r.random() < 0.4:
            text = WORD.findall(r.choice(rows)[1] or "")
            if text and r.random() < 0.6:
                text[r.randrange(len(text))] = "edited"
        rows.append((r.randrange(n), r.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize(("seed", "hot", "block", "group"), [(1, 4096, 1 << 20, 40_000), (2, 0, 1 << 20, 40_000), (3, 4096, 200, 10), (4, 6, 500, 40), (5, 3, 50, 7)])
def test_removed_words_are_those_of_brute_force(spark, seed, hot, block, group):
    rows = some_rows(seed, 60, 10) + [(None, None), (None, " ".join("abcdefghijklm")), (3, None), (4, ""), (5, " \t\n"), (90, "x " * 400), (91, "x " * 300), (2, "y " * 200), (2, "y " * 200)]
    rows += [(i, " ".join("abcdefghijklm")) for i in (70, 71, 71, 72)]
    got = substrings.deduplicated(rows_of(spark, rows).repartition(3), 10, 4, hot, block, group)
    assert told(got) == sorted(map(repr, brute(rows, 10)))


def test_a_hot_passage_in_other_surroundings(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(i % 60))} {passage} {' '.join(f'b{i}x{k}' for k in range(i % 7))}") for i in range(300)]
    want = sorted(map(repr, brute(rows, 50)))
    assert told(substrings.deduplicated(rows_of(spark, rows), hot=20, block_bytes=5000)) == want
    assert told(substrings.deduplicated(rows_of(spark, rows))) == want


def test_spans_name_the_removed_words(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, "x y " + " ".join(f"a{i}" for i in range(60)) + " z")]
    got = {r.doc_id: r for r in substrings.deduplicated(rows_of(spark, rows)).collect()}
    assert got[1].removed == [] and [tuple(s) for s in got[2].removed] == [(2, 62)] and got[2].text == "x y z"


def test_documents_table_and_digest(spark, folder):
    docs = table(spark, folder, "documents")
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute([(r.doc_id, r.text) for r in docs.collect()], 50)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs).collect()}
    assert got == want


def test_long_text_and_empty_table(spark):
    rows = [(1, " ".join(f"word{i % 977}" for i in range(30_000))), (2, " ".join(f"word{i % 977}" for i in range(5, 2000)))]
    assert told(substrings.deduplicated(rows_of(spark, rows))) == sorted(map(repr, brute(rows, 50)))
    assert substrings.report(rows_of(spark, rows).limit(0)).collect() == []


def test_blocks_do_not_move(spark, folder):
    plan = substrings.deduplicated(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "docs" in line]


def test_grams_and_least_of():
    words = np.arange(100, dtype=np.uint64) % np.uint64(13)
    for k in (1, 2, 3, 5, 10, 25, 50):
        g = substrings.grams(words, k)
        assert len(g) == 101 - k
        same = {}
        for i, x in enumerate(g.tolist()):
            assert same.setdefault(tuple(words[i : i + k].tolist()), x) == x
        assert len(set(same.values())) == len(same)
        assert substrings.least_of(words, k).tolist() == [min(words[i : i + k].tolist()) for i in range(101 - k)]


def test_suffix_tree_nodes():
    r = np.random.default_rng(7)
    words, prefix = r.integers(0, 2, (200, 6)).astype(np.uint64), r.integers(0, 3, 200)
    tree = substrings.SuffixTree(prefix, words, 4)
    for depth in range(4, 11):
        nodes = tree.nodes(depth)
        for i in range(200):
            same = (prefix == prefix[i]) & (words[:, : depth - 4] == words[i, : depth - 4]).all(axis=1)
            assert ((nodes == nodes[i]) == same).all()
