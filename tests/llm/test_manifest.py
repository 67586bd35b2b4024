"""The Merkle manifest against a plain Python tree, for several page heights, and on nulls, repeats and empty tables."""

import hashlib
import zlib

import pytest

from srcloom.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    return [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def climbed(nodes, at, value):
    """Siblings of place `at` up to the top, and what `value` there folds to."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at - at % 2 : at - at % 2 + 2]
        siblings += [x for k, x in enumerate(run) if k != at % 2]
        run[at % 2] = value
        value, nodes, at = digest(*run), up(nodes), at // 2
    return siblings, value


def expected(rows):
    rows = [tuple(r) for r in rows]
    leaf = lambda r, n: digest(*map(field, (r[0], r[1], r[2], n, r[4])))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[3]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted(by[x], key=lambda y: y[:3]) for x in langs}
    subroots = []
    for x in langs:
        nodes = [y[2] for y in trees[x]]
        while len(nodes) > 1:
            nodes = up(nodes)
        subroots.append(nodes[0])
    top = list(subroots)
    while len(top) > 1:
        top = up(top)
    out = []
    for k, x in enumerate(langs):
        nodes = [y[2] for y in trees[x]]
        for at, (_, _, own, r) in enumerate(trees[x]):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low, value = climbed(nodes, at, leaf(r, r[3] + 1) if tampered else own)
            high, value = climbed(subroots, k, value)
            out.append((r[0], own, subroots[k], top[0], digest(*low, *high), value, value == top[0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int, g string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize(("height", "chunk"), [(1, 0), (1, 2), (2, 1), (3, 16), (10, 16)])
def test_manifest_is_the_plain_tree(spark, height, chunk):
    rows = [(i, f"s{i % 3}", ("en", "de", "ünï", None, "zz")[0 if i % 2 else i % 5], i * 7 % 50, f"text {i} é") for i in range(61)]
    rows += [(None, None, "en", None, None), (None, "s", "en", 3, ""), (7, "s", "en", 1, "same id"), (7, "s", "en", 1, "same row"), (7, "s", "en", 1, "same row"), (98, "lone", "only", 2**63 - 1, "x" * 100_000)]
    got = manifest.report(rows_of(spark, rows), height, chunk).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows)))


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "s", "en", 4, "text")]
    assert [tuple(r) for r in manifest.report(rows_of(spark, one)).collect()] == expected(one)
    assert manifest.report(rows_of(spark, one).limit(0)).collect() == []


def test_manifest_tells_what_was_tampered_with(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for r in manifest.report(docs).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_pages_link_to_their_parents(spark):
    rows = [(i, "s", "ab"[i % 2], 1, "t") for i in range(20)]
    proofs, pages = manifest.manifest(rows_of(spark, rows), 1, 16)
    found = pages.collect()
    places = {(p.tree, p.tier, p.page): p for p in found}
    tops = [p for p in found if p.next_tree is None]
    assert len(tops) == 1 and {r.root for r in proofs.collect()} == {tops[0].top}
    for p in found:
        if p.next_tree is not None:
            parent = places[p.next_tree, p.next_tier, p.next_node // 2]
            assert parent.levels[0][p.next_node % 2] == p.top
