"""Import statements over several lines, with aliases, in blocks and with continuations."""

import pytest

from srcloom.operators import statements

FILES = [
    ("a.ts", "typescript", "import { foo as bar, baz } from './x';\nimport React, {\n  useState,\n  type Shape as Form,\n} from 'react';\n/* import { gone } from 'y';\n */\n// import { out } from 'z';\nexport { thing, other as o } from './t';\nimport * as ns from 'n';\nconst { p: q, r } = require('fs');\nimport Plain from './Plain';\nbar(); useState(1);\n"),
    ("b.py", "python", "from m import (\n    one,\n    two as deux,\n)\nfrom n import three, \\\n    four\nimport os as system, sys\nfrom w import *\nprint(deux, four)\n"),
    ("c.go", "go", 'package c\nimport (\n\tf "fmt"\n\t"os/exec"\n\t_ "embed"\n\t. "math"\n)\nimport "strings"\nfunc main() { f.Println() }\n'),
    ("D.java", "java", "import java.util.List;\nimport static a.b.Kit;\nclass D { List x; }\n"),
    ("E.cs", "csharp", "using Al = A.B;\nusing System.Text;\nclass E {}\n"),
    ("f.test.ts", "typescript", "import { unusedInTest } from './x';\n"),
    ("g.ts", "typescript", None),
    ("h.ts", "typescript", ""),
    ("i.ts", "typescript", "const s = \"// not a comment\"; import { kept } from './k';\nkept(s);\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, language string, content string")


def test_import_symbols(files):
    got = {(r.path, r.n, r.name, r.local, r.kind) for r in statements.import_symbols(files).collect()}
    assert {g[1:] for g in got if g[0] == "a.ts"} == {
        (1, "foo", "bar", "named"), (1, "baz", "baz", "named"), (2, "React", "React", "mixed-default"), (2, "useState", "useState", "named"), (2, "Shape", "Form", "named"),
        (9, "thing", "thing", "re-export"), (9, "other", "o", "re-export"), (10, "ns", "ns", "star"), (11, "p", "q", "require"), (11, "r", "r", "require"), (12, "Plain", "Plain", "default"),
    }
    assert {g[1:4] for g in got if g[0] == "b.py"} == {(1, "one", "one"), (1, "two", "deux"), (5, "three", "three"), (5, "four", "four"), (7, "os", "system"), (7, "sys", "sys")}
    assert {g[1:4] for g in got if g[0] == "c.go"} == {(3, "fmt", "f"), (4, "exec", "exec"), (5, "embed", "_"), (6, "math", "."), (8, "strings", "strings")}
    assert {g[1:4] for g in got if g[0] == "D.java"} == {(1, "List", "List"), (2, "Kit", "Kit")}
    assert {g[1:4] for g in got if g[0] == "E.cs"} == {(1, "Al", "Al"), (2, "System.Text", "System.Text")}


def test_unused_imports(files):
    got = sorted((r.path, r.n, r.name) for r in statements.unused_imports(files).collect())
    assert got == [("D.java", 2, "Kit"), ("a.ts", 1, "baz"), ("a.ts", 2, "Form"), ("a.ts", 12, "Plain"), ("b.py", 1, "one"), ("b.py", 5, "three"), ("c.go", 4, "exec"), ("c.go", 8, "strings")]
    assert statements.unused_imports(files.limit(0)).count() == 0
