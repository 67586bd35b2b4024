"""Single-method classes and single-implementation interfaces."""

import pytest
from pyspark.sql import functions as F

from srcloom.operators import abstractions

FILES = [
    ("a.ts", "typescript", "class One {\n  constructor(x) { this.x = {}; }\n  run() { if (x) { y(); } }\n}\nclass Two {\n  a() {}\n  b() {}\n}\nclass Open {\n  c() {\n"),
    ("b.ts", "typescript", "class Many {\n  go() {}\n}\n"),
    ("c.test.ts", "typescript", "class Tested {\n  go() {}\n}\n"),
    ("d.ts", "typescript", "export interface Shape { }\ninterface Lone { }\ninterface Pair { }\ninterface None { }\n"),
    ("e.java", "java", "class X implements Shape,\n    Pair { }\nclass Y implements Pair { }"),
    ("f.cs", "csharp", "interface IFoo { }\ninterface IBar { }\nclass A : IFoo, IBar { }\nclass B : IBar { }"),
    ("g.ts", "typescript", None),
    ("h.ts", "typescript", "class Bare"),
]


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(FILES, "path string, language string, content string")
    importers = spark.createDataFrame([(p, 5 if p == "b.ts" else 1) for p, _, _ in FILES], "path string, fan_in long")
    return files, importers


def test_single_method_classes(tables):
    assert [tuple(r) for r in abstractions.single_method_classes(*tables).collect()] == [("a.ts", "One", "run")]


def test_single_implementation_interfaces(tables):
    assert sorted(tuple(r) for r in abstractions.single_implementation_interfaces(*tables).collect()) == [("d.ts", "Shape"), ("f.cs", "IFoo")]


def test_empty(tables):
    files, importers = tables
    assert abstractions.single_method_classes(files.limit(0), importers).count() == 0 and abstractions.single_implementation_interfaces(files.limit(0), importers).count() == 0


def test_class_body(spark):
    cases = ["class A { x { y } z } w", "no braces", "{ open {", "{}", ""]
    got = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").orderBy("k").select(abstractions.class_body(F.col("c"))).collect()
    assert [r[0] for r in got] == ["{ x { y } z }", None, "{", "{}", None]
