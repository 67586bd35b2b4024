"""Merkle manifest of a table of documents: a hash tree for each language, their roots in a tree of their own, proofs that are checked.

Levels are built bottom up and stored as parent-linked rows. A stored row is a page: the nodes of up to `height` levels
above 2**height consecutive nodes of one tree, its top, and the link (tree, tier, node) under which its top stands in the
page above. The last page of a language's tree links to the language's place in the tree of subroots, and the page at the
top of that one links to nothing. With height 1 a page is one run of two nodes and its parent.

A recursive query ascends from every leaf over these links. At each page it appends the leaf's siblings, level by
level, to the proof and folds the leaf, tampered or not, with them; it ends where a page has no parent. All leaves end in
the same page, so pages are stored once for each 2**16 leaves (`CHUNK`) below them and joined by page and chunk: no key has more
rows than that, whatever the shares of languages, at a cost of at most one page of 2**height hashes for 2**16 leaves and tier.

Ranks come from ranges of (lang, doc_id), so no language is gathered in one task. Digests are kept as 32 bytes.

Nulls: null values are hashed as `-`, a null lang is a language of its own and comes first, rows of null doc_id come
first in theirs and are not tampered with. Rows that repeat a doc_id are leaves each, in the order of their hashes; rows
equal in everything are leaves each too, and any order of them gives the same tree. Empty texts are hashed as `0:`. An
empty table gives no rows. Other columns are not read. n_chars is tampered with as a decimal, so it cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.functions.shared import written
from srcloom.llm.ranking import ranked
from srcloom.llm.skew import joined

#: Levels in a page, the bits of a chunk of leaves, and the fixed value of which crc32s are tampered with.
HEIGHT, CHUNK, TAMPER_EACH = 10, 16, 7

#: The tree of subroots; other trees are named by the rank of their first leaf.
TOP = -1


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and folded (the tampered leaf, or the leaf itself), digests as bytes, and a number of the row."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    head = [_field(F.col(c)) for c in ("doc_id", "source", "lang")]
    leaf = lambda n: F.unhex(F.sha2(F.concat(*head, _field(n), _field(F.col("text"))), 256))
    tampered = F.when(F.pmod(crc, F.lit(TAMPER_EACH)) == 0, leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    out = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), tampered.alias("_t"))
    return out.select("doc_id", "lang", "leaf", F.coalesce("_t", "leaf").alias("folded"), F.monotonically_increasing_id().alias("row"))


def placed(docs: DataFrame) -> DataFrame:
    """Leaves with their rank over all (g), their tree, their place in it (node) and the number of its leaves (n)."""
    found = written(leaves(docs), "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("lang", "doc_id", "leaf", "row")]
    rows = written(ranked(found, order, "leaf-ranges", "g").withColumn("key", _field(F.col("lang"))).drop("row", "lang"), "ranked-leaves")
    trees = rows.groupBy("key").agg(F.min("g").alias("tree"), F.count("*").alias("n"), F.count("*").alias("weight"))
    kept = joined(rows, written(trees, "trees"), ["key"], "weight", rows.count())
    return kept.select("g", "doc_id", "leaf", "folded", "tree", (F.col("g") - F.col("tree")).alias("node"), "n")


_HALVED = "transform(sequence(0, (size({0}) - 1) div 2), i -> unhex(sha2(lower(concat(hex({0}[2 * i]), coalesce(hex(get({0}, 2 * i + 1)), ''))), 256)))"


def pages(nodes: DataFrame, tier: int, height: int) -> DataFrame:
    """Pages over nodes (tree, node, hash, n nodes of the tree, first and last leaf): their levels, top and place."""
    grouped = nodes.groupBy("tree", F.shiftright("node", height).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("below"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    last = F.col("n") <= 1 << height
    depth = F.when(last, F.length(F.bin(F.col("n") - 1)) - (F.col("n") == 1).cast("int")).otherwise(F.lit(height))  # halvings until one is left
    climbed = grouped.withColumn("hashes", F.col("below.hash")).withColumn("depth", depth).drop("below")
    built = climbed.withColumn(
        "levels",
        F.expr(f"aggregate(if(depth = 0, cast(array() as array<int>), sequence(1, depth)), array(hashes), (built, k) -> concat(built, array({_HALVED.format('element_at(built, -1)')})))"),
    )
    return built.select(
        "tree", F.lit(tier).alias("tier"), "page", F.slice("levels", F.lit(1), F.col("depth")).alias("levels"),
        F.expr("element_at(levels, -1)[0]").alias("top"), last.alias("last"), "n", "lo", "hi",
    )


def tree_pages(nodes: DataFrame, height: int) -> list[DataFrame]:
    """All pages of the trees over `nodes`, tier by tier, each tier written before the next is built on it."""
    tiers: list[DataFrame] = []
    widest = nodes.agg(F.max("n")).first()[0]
    while widest is not None:
        tiers.append(written(pages(nodes, len(tiers), height), "pages"))
        if widest <= 1 << height:
            break
        above = F.shiftright(F.col("n") + (1 << height) - 1, height)
        nodes = tiers[-1].filter(~F.col("last")).select("tree", F.col("page").alias("node"), F.col("top").alias("hash"), above.alias("n"), "lo", "hi")
        widest = (widest + (1 << height) - 1) >> height
    return tiers


def linked(tiers: list[DataFrame], parent_of_last: DataFrame | None) -> DataFrame:
    """Pages with the link to their parent; the last page of a tree takes its link from parent_of_last (tree, next_node)."""
    rows = tiers[0]
    for more in tiers[1:]:
        rows = rows.union(more)
    inner = rows.filter(~F.col("last")).select("*", F.col("tree").alias("next_tree"), (F.col("tier") + 1).alias("next_tier"), F.col("page").alias("next_node"))
    ends = rows.filter("last")
    if parent_of_last is None:
        return inner.union(ends.select("*", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")))
    return inner.union(ends.join(parent_of_last, "tree").select(*[ends[c] for c in ends.columns], F.lit(TOP).cast("long"), F.lit(0), "next_node"))


#: One step of the climb: the leaf's siblings in the page, appended and folded, then the link to the page above.
_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT g, doc_id, leaf, folded, CAST('' AS BINARY) AS proof, CAST(NULL AS BINARY) AS subroot, CAST(NULL AS BINARY) AS root,
         CAST(tree AS BIGINT) AS tree, 0 AS tier, CAST(node AS BIGINT) AS node
  FROM {leaves}
  UNION ALL
  SELECT g, doc_id, leaf, step.folded, step.proof, subroot, root, tree, tier, node FROM (
    SELECT c.g, c.doc_id, c.leaf,
           aggregate(
             transform(p.levels, (level, i) -> struct(shiftright(CAST(c.node & {mask} AS INT), i) & 1 AS side, get(level, shiftright(CAST(c.node & {mask} AS INT), i) ^ 1) AS sibling)),
             struct(c.folded AS folded, c.proof AS proof),
             (held, x) -> struct(
               unhex(sha2(lower(if(x.side = 1, concat(hex(x.sibling), hex(held.folded)), concat(hex(held.folded), coalesce(hex(x.sibling), '')))), 256)) AS folded,
               concat(held.proof, coalesce(x.sibling, CAST('' AS BINARY))) AS proof)) AS step,
           if(p.tree >= 0 AND p.next_tree = {top}, p.top, c.subroot) AS subroot,
           if(p.next_tree IS NULL, p.top, c.root) AS root,
           p.next_tree AS tree, p.next_tier AS tier, p.next_node AS node
    FROM climb c JOIN {pages} p
      ON p.tree = c.tree AND p.tier = c.tier AND p.page = shiftright(c.node, {height}) AND p.chunk = shiftright(c.g, {chunk})
  )
)
SELECT g, doc_id, leaf, subroot, root, proof, folded AS folded_root FROM climb WHERE tree IS NULL
"""


def manifest(docs: DataFrame, height: int = HEIGHT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The proofs of all leaves (digests as bytes: leaf, subroot, root, proof, folded_root) and the stored pages of the trees."""
    spark = docs.sparkSession
    found = written(placed(docs), "placed")
    below = tree_pages(found.select("tree", "node", F.col("leaf").alias("hash"), "n", F.col("g").alias("lo"), F.col("g").alias("hi")), height)
    if not below:
        return found.select("g", "doc_id", "leaf", *[F.col("leaf").alias(c) for c in ("subroot", "root", "proof", "folded_root")]), found.sparkSession.createDataFrame([], "tree long")
    subroots = below[0]
    for more in below[1:]:
        subroots = subroots.union(more)
    subroots = written(subroots.filter("last").select("tree", "top", "lo", "hi"), "subroots")
    order = written(ranked(subroots, [F.col("tree")], "subroot-ranges", "next_node").withColumn("n", F.lit(subroots.count())), "subroot-order")
    above = tree_pages(order.select(F.lit(TOP).cast("long").alias("tree"), F.col("next_node").alias("node"), F.col("top").alias("hash"), "n", "lo", "hi"), height)
    stored = linked(below, order.select("tree", "next_node")).union(linked(above, None))
    chunked = written(stored.withColumn("chunk", F.explode(F.sequence(F.shiftright("lo", chunk), F.shiftright("hi", chunk)))).drop("lo", "hi", "n", "last"), "linked-pages")
    # Every leaf climbs, however many there are: the engine's guard against runaway recursion counts rows and would stop at a million.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    proofs = spark.sql(_CLIMB, leaves=found, pages=chunked, mask=(1 << height) - 1, height=height, chunk=chunk, top=TOP)
    return proofs, chunked


def report(docs: DataFrame, height: int = HEIGHT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, digests in hex."""
    text = lambda c: F.lower(F.hex(c))
    proofs, _ = manifest(docs, height, chunk)
    return proofs.select(
        "doc_id", *[text(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(text("proof"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_SQL_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_SQL_HEAD = " || ".join(_SQL_FIELD.format(c) for c in ("doc_id", "source", "lang"))

#: The same rows in DuckDB. crc32 is worked out byte by byte from a table made by its rule.
SQL = f"""
WITH RECURSIVE rounds AS (
  SELECT n::BIGINT AS n, n::BIGINT AS c, 0 AS k FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM rounds WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM rounds WHERE k = 8
), encoded AS (
  SELECT doc_id, lang, sha256({_SQL_HEAD} || {_SQL_FIELD.format("n_chars")} || {_SQL_FIELD.format("text")}) AS leaf,
         sha256({_SQL_HEAD} || {_SQL_FIELD.format("(n_chars + 1)")} || {_SQL_FIELD.format("text")}) AS tampered,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                                     lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS crc
  FROM documents, crc_table
), placed AS (
  SELECT *, CASE WHEN crc % {TAMPER_EACH} = 0 THEN tampered ELSE leaf END AS folded,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM encoded
), levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS l FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], ''))) FROM levels WHERE len(l) > 1
), subroots AS (
  SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(l) = 1
), top_levels AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS l FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], ''))) FROM top_levels WHERE len(l) > 1
), steps AS (
  SELECT p.lang, p.idx, 0 AS part, v.level, (p.idx >> v.level) AS pos, v.l
  FROM placed p JOIN levels v ON p.lang IS NOT DISTINCT FROM v.lang AND len(v.l) > 1
  UNION ALL
  SELECT p.lang, p.idx, 1, v.level, (s.place >> v.level), v.l
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN top_levels v ON len(v.l) > 1
), paths AS (
  SELECT lang, idx, list((pos % 2)::VARCHAR || coalesce(l[xor(pos, 1) + 1], '') ORDER BY part, level) AS path FROM steps GROUP BY lang, idx
), proofs AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT l[1] FROM top_levels WHERE len(l) = 1) AS root, coalesce(q.path, []) AS path,
         list_reduce(list_prepend(p.folded, coalesce(q.path, [])), lambda h, x: CASE WHEN x[1] = '1' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN paths q ON p.lang IS NOT DISTINCT FROM q.lang AND p.idx = q.idx
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM proofs
"""
