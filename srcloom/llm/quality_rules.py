"""Quality rules as a short-circuit cascade. DataFrame functions only.

Each rule rejects a document by an expression over its text or counts, and says how much work that is (characters gone
over). One job over a sample of about SAMPLE_ROWS rows counts which rules reject together and the work of each; rules
are then put in order one by one, each time the one that rejects most of what is left for its work there. They become one
CASE expression: Spark evaluates its branches in turn and stops at the first that rejects. The order depends on nothing
but the rows. It changes how long it takes, never what is kept, because a document is kept when no rule rejects it.

Repeated windows are found inside a row by sorting its window hashes, so nothing is shuffled: documents of any source
or group of copies stay where they were read, and the work of a row grows as n log n with its words.

Null text has no words. Empty and very short texts fail the base rule. Rows are judged one by one, so repeated rows and
ties change nothing; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rows, about, of the sample that the order of rules is estimated on.
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    work: Column  # characters that `rejects` goes over, and one for the comparison


def _without(x: Column, pattern: str) -> Column:
    """How many characters are left of x without those of the pattern."""
    return F.length(F.regexp_replace(x, pattern, ""))


def rules() -> list[Rule]:
    """Rules over text and the counts of `measured`; each is true for a document to reject."""
    text, n, size = F.col("text"), F.col("n_words"), F.length("text")
    letters, capitals = size - _without(text, r"\p{L}+"), size - _without(text, r"\p{Lu}+")
    n_lines = F.regexp_count(text, F.lit("\n")) + 1
    compared = F.lit(1)
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n, compared),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (10 * F.col("n_dup_lines") > 3 * n_lines), compared + F.when(F.col("n_dup_lines") >= 3, size).otherwise(0)),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n), compared),
        Rule("shouting", 10 * capitals > 6 * letters, compared + 2 * size),
        Rule("exclamations", 10 * (size - _without(text, "[!?]+")) > 5 * n, compared + size),
        Rule("ellipses", 10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)\s*(?:\n|$)")) > 3 * n_lines, compared + 2 * size),
        Rule("digits", 10 * (size - _without(text, "[0-9]+")) > 5 * F.col("word_chars"), compared + size),
        Rule("few_letters", 10 * letters < 4 * F.col("word_chars"), compared + size),
    ]


def _bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of x, with x evaluated once: what a lambda names by a column alias, a pushed-down filter would evaluate anew
    for each element."""
    return F.transform(F.array(x), body)[0]


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more, by 64-bit hashes of the windows."""

    def of_hashes(each: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(each, i + k) for k in range(WINDOW)])
        windows = F.when(F.size(each) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(each) - WINDOW), window)).otherwise(F.array().cast("array<long>"))
        return _bound(windows, of_windows)

    def of_windows(windows: Column) -> Column:
        # a text all of whose windows differ, as most are, needs no sort
        sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _bound(sorted_, of_sorted)).otherwise(0)

    def of_sorted(by_hash: Column) -> Column:
        twice = lambda x, k: F.coalesce((x["h"] == F.get(by_hash, k - 1)["h"]) | (x["h"] == F.get(by_hash, k + 1)["h"]), F.lit(False))
        return _bound(F.sort_array(F.transform(F.filter(by_hash, twice), lambda x: x["i"])), of_places)

    def of_places(at: Column) -> Column:
        covers = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(covers, F.lit(0), lambda a, b: a + b)

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long; columns named like results are replaced."""
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "rejected_by", "base_failed", "kept")
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split(F.regexp_replace("_text", "[\t-\r]", " "), " ", -1), ""))
    lines = split.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0))
    return lines.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        _without(F.col("_text"), "[\t-\r ]+").cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), f"[{SYMBOLS}]+")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ordered_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection for work among the rows that the base rule and earlier ones leave; ties by name.

    The sample is about `sample_rows` rows, chosen by a hash of doc_id and text; at most 2 ** rules rows reach the driver.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    left, order = rules(), []
    verdicts = measured(picked).filter(~base_failed()).select(*[F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in left], *[r.work.alias(f"work_{r.name}") for r in left])
    seen = verdicts.groupBy(*[r.name for r in left]).agg(F.count("*").alias("n"), *[F.sum(f"work_{r.name}").alias(f"work_{r.name}") for r in left]).collect()
    while left:
        still = [g for g in seen if not any(g[r.name] for r in order)]
        rate = {r.name: sum(g.n for g in still if g[r.name]) / max(1, sum(g[f"work_{r.name}"] or 0 for g in still)) for r in left}
        best = min(left, key=lambda r: (-rate[r.name], r.name))
        order.append(best)
        left = [r for r in left if r is not best]
    return order


def judged(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """`measured` docs with base_failed, kept and rejected_by (the first rule in the order that rejects, else null)."""
    order = ordered_rules(docs) if order is None else order
    counts = measured(docs)
    first = F.when(base_failed(), "base")
    for rule in order:
        first = first.when(F.coalesce(rule.rejects, F.lit(False)), rule.name)
    return counts.withColumn("rejected_by", first).withColumn("base_failed", base_failed()).withColumn("kept", F.col("rejected_by").isNull())


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    return judged(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows in DuckDB.
SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)
), windows AS (
  SELECT r, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)
), again AS (
  SELECT r, pos FROM windows WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, gram) > 1
), covered AS (
  SELECT r, count(DISTINCT pos + k) AS n FROM again, range(5) AS t(k) GROUP BY r
), lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), duplicates AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
counts AS (
  SELECT t.r, t.doc_id, t.text,
         len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
         length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM texts t LEFT JOIN duplicates d USING (r) LEFT JOIN covered c USING (r)
), shapes AS (
  SELECT *, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS capitals,
         length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS shouts,
         length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
         len(string_split(text, chr(10))) AS n_lines,
         len(regexp_extract_all(text, '(?:\.\.\.|\x{2026})\s*(?:\n|$)')) AS ellipses,
         (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * capitals > 6 * letters
            OR 10 * shouts > 5 * n_words OR 10 * ellipses > 3 * n_lines OR 10 * digits > 5 * word_chars
            OR 10 * letters < 4 * word_chars) AS kept
FROM shapes
"""
