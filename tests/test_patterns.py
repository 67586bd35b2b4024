"""Approaches: what is blanked, and that approaches are compiled."""

import random
from functools import reduce

from pyspark.sql import functions as F

from srcloom.operators import patterns

#: The reference's steps, each tried on every text.
PLAIN = (
    (r"/\*[\s\S]*?\*/", ""),
    (r"(\A|[^:])//[^\n]*", "$1"),
    (r"(?m)^\s*#[^\n]*", ""),
    (r"`[^`]*`", '""'),
    (r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""'),
    (r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", "''"),
    (r"(?<=[=({\[,;!&|?:\s])/[^/\n]+/[gimsuy]*", '""'),
)


def test_noise_is_blanked_as_by_plain_steps(spark):
    chance = random.Random(3)
    pieces = ["/", "//", "/*", "*/", ":", "#", "`", '"', "'", "\\", "\n", " ", "a", "=", "(", "gi", "é"]
    texts = [("".join(chance.choice(pieces) for _ in range(chance.choice([0, 1, 4, 12, 30]))),) for _ in range(3000)]
    plain = reduce(lambda x, rule: F.regexp_replace(x, *rule), PLAIN, F.col("x"))
    rows = spark.createDataFrame(texts, "x string").select("x", plain.alias("want"), patterns.without_noise(F.col("x")).alias("got")).collect()
    assert [r.x for r in rows if r.want != r.got] == []


def test_approaches_are_no_array_without_nulls(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "try { f(); } catch (e) {}\nconsole.log(1);\nlogger.info(2); // log"), ("b.ts", "typescript", None)], "path string, language string, content string")
    rows = patterns.approaches(files.select("path", "content"))
    assert "array_compact" not in rows._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in rows.collect()) == [("error-handling", "try/catch", 1), ("logging", "console.*", 1), ("logging", "log() call", 1), ("logging", "logger object", 1)]
