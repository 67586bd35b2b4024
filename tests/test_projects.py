"""Projects: manifests, dependencies that nothing names, outdated ones, languages; folders walked and pruned; ignore rules."""

import json
import os
import subprocess

import pytest

from srcloom.operators import dependencies
from srcloom.sources import collect


def files(spark, contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def unused(spark, contents):
    return {(r.project, r.name, r.manifest) for r in dependencies.unused_dependencies(files(spark, contents)).collect()}


def package(**fields):
    return json.dumps(fields)


def test_manifests(spark):
    rows = dependencies.manifest_dependencies(files(spark, {
        "package.json": package(dependencies={"a": "^1", "@s/b": "2"}, devDependencies={"c": "3"}, peerDependencies={"d": "4"}, name="x"),
        "go.mod": "module m\nrequire (\n\tgithub.com/x/y v1.2.3 // indirect\n)\nrequire one/two v0.1\n",
        "requirements.txt": "flask>=2.0\n  jinja2  \n\nred<3\n",
        "B.csproj": '<PackageReference Include="Second" />', "A.csproj": '<PackageReference Include="First" Version="1" />',
        "pom.xml": "<artifactId>core</artifactId><artifactId> web </artifactId>",
        "sub/package.json": "not json", "sub/pom.xml": "<artifactId>deep</artifactId>", "node_modules/z/package.json": package(dependencies={"hidden": "1"}), "none/package.json": None,
    })).collect()
    assert {(r.project, r.kind, r.field, r.name, r.version) for r in rows} == {
        ("", "npm", "dependencies", "a", "^1"), ("", "npm", "dependencies", "@s/b", "2"), ("", "npm", "devDependencies", "c", "3"), ("", "npm", "peerDependencies", "d", "4"),
        ("", "go", "", "y", "v1.2.3"), ("", "python", "", "flask", "2.0"), ("", "python", "", "jinja2", None), ("", "python", "", "red", "3"),
        ("", "csharp", "", "First", "1"), ("", "java", "", "core", None), ("", "java", "", " web ", None), ("sub", "java", "", "deep", None),
    }
    assert {(r.project, r.manifest) for r in rows} == {("", "npm"), ("sub", "java")}


def test_unused_dependencies(spark):
    deps = {"lodash": "1", "left-pad": "1", "@scope/kit": "1", "react": "1", "typescript": "1", "@types/node": "1", "@types/babel__core": "1", "@types/gone": "1", "tool": "1", "eslint-x": "1", "a.b": "1"}
    contents = {
        "package.json": package(dependencies=deps, scripts={"build": "tsc -p . && tool-run"}),
        "src/a.ts": "import x from '@scope/kit/deep';\nrequire('lodash/fp'); // preact, reactive\nimport fs from 'node:fs';\nleft-padding();\nacb",
        "babel.config.js": "module.exports = ['@babel/core', 'eslint-x']",
        "sub/eslint.config.js": "left-pad",
        "node_modules/left-pad/index.js": "left-pad",
        "node_modules/typescript/package.json": package(bin={"tsc": "x"}),
        "node_modules/tool/package.json": package(bin="cli.js"),
        "readme.md": "react",
    }
    # a configuration below the root is a source as well, by its extension
    assert unused(spark, contents) == {("", n, "npm") for n in ("react", "@types/gone", "a.b")}
    contents.pop("sub/eslint.config.js")
    assert ("", "left-pad", "npm") in unused(spark, contents)


def test_unused_dependencies_of_nested_projects(spark):
    contents = {"package.json": package(dependencies={"one": "1", "two": "1"}), "apps/x/package.json": package(dependencies={"one": "1", "two": "1"}), "apps/x/a.js": "one", "b.py": "two", "c.ts": None}
    assert unused(spark, contents) == {("apps/x", "two", "npm")}
    assert unused(spark, {"a.ts": "x"}) == set() and unused(spark, {"package.json": "{}"}) == set()
    plan = dependencies.unused_dependencies(files(spark, contents))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_project_languages(spark):
    found = files(spark, {p: "" for p in ("a/package.json", "a/sub/go.mod", "a/sub/deep/pom.xml", "a/.hid/pom.xml", "a/node_modules/setup.py", "b/x/y.py", "b/x/.z/q.go", "b/dist/r.java", "b/k.none", "c/setup.py", "c/in/setup.py", "d/p/One.csproj", "e/1/2/3/4/5/f.ts", "e/1/2/3/4/5/6/g.py")})
    roots = spark.createDataFrame([(x,) for x in "abcdef"], "project string")
    got = {(r.project, r.language, r.told_by) for r in dependencies.project_languages(found, roots).collect()}
    assert got == {("a", "typescript", "marker"), ("a", "go", "marker"), ("b", "python", "extension"), ("c", "python", "marker"), ("d", "csharp", "marker"), ("e", "typescript", "extension")}


def test_outdated_dependencies(spark):
    contents = {
        "js/package.json": package(devDependencies={"moment": "1", "underscore": "1"}), "js/a.ts": "var x = 1;\nimport moment from 'moment';",
        "py/requirements.txt": "Optparse==1\nurllib2x\n", "py/a.py": "import urllib2\nimport optparse\nos.path.join(x)",
        "go/a.go": "ioutil.ReadFile(x)", "gomod/go.mod": "module x", "gomod/a.go": "ioutil.ReadFile(x)",
        "cs/a.csproj": '<PackageReference Include="webclient" />', "cs/b.cs": "Thread.Sleep(1)",
        "jv/build.gradle": "implementation 'javax:inject:1'", "jv/pom.xml": "<artifactId>Vector</artifactId>", "jv/A.java": "new Date()",
        "none/package.json": "broken", "none/a.py": "import urllib2",
    }
    roots = spark.createDataFrame([(x,) for x in ("js", "py", "go", "gomod", "cs", "jv", "none")], "project string")
    got = {(r.project, r.old, r.location, r.confidence) for r in dependencies.outdated_dependencies(files(spark, contents), roots).collect()}
    assert got == {
        ("js", "moment", "package.json", 0.9), ("js", "underscore", "package.json", 0.9), ("js", "var declarations", "source", 0.7),
        ("py", "optparse", "requirements.txt", 0.9), ("py", "urllib2", "source", 0.7), ("py", "os.path", "source", 0.7),
        ("gomod", "ioutil.ReadFile", "go.mod", 0.7), ("cs", "WebClient", "project", 0.8), ("cs", "Thread.Sleep", "project", 0.8),
        ("jv", "javax.inject", "project", 0.75), ("jv", "Vector", "project", 0.75), ("jv", "java.util.Date", "project", 0.75),
    }


@pytest.fixture
def tree(tmp_path):
    for path in ("a.ts", "src/b.py", "src/deep/er/c.go", "node_modules/d.ts", "dist/e.ts", ".git/f.ts", ".hidden/g.ts", "my-Worktree-1/h.ts", "src/.dot.ts", "src/big.ts", "src/k.txt", "gen/l.ts", "gen/m.test.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * (500 if "big" in path else 3))
    (tmp_path / "src/link.ts").symlink_to(tmp_path / "a.ts")
    (tmp_path / "src/loop").symlink_to(tmp_path / "src")
    (tmp_path / "src/broken.ts").symlink_to(tmp_path / "nowhere.ts")
    return tmp_path


@pytest.mark.parametrize("shares", [1, 3, 32])
def test_collected_files(spark, tree, shares):
    got, skipped = collect.collected(spark, str(tree), ["gen/**", "{x,y}.ts"], largest=400, shares=shares)
    assert sorted((r.path, r.language, r.content) for r in got.collect()) == [("a.ts", "typescript", "xxx"), ("src/.dot.ts", "typescript", "xxx"), ("src/b.py", "python", "xxx"), ("src/deep/er/c.go", "go", "xxx"), ("src/link.ts", "typescript", "xxx")]
    assert skipped.count() == 0
    only, _ = collect.collected(spark, str(tree), ["*.test.ts"], ["typescript"], shares=shares)
    assert {r.path for r in only.collect()} == {"a.ts", "src/.dot.ts", "src/big.ts", "src/link.ts", "gen/l.ts"}
    none, _ = collect.collected(spark, str(tree / "no such folder"), shares=shares)
    assert none.count() == 0


def test_excluded_folders_are_not_listed(tree, monkeypatch):
    listed, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (listed.append(str(p)), scandir(p))[1])
    walk = collect.Walk(str(tree), ["src/deep"], None, 400)
    list(walk.below(str(tree)))
    assert sorted(os.path.relpath(p, tree) for p in listed) == [".", "gen", "src"]


def test_hidden_parts_are_told(tree, monkeypatch):
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(13, "no")) if str(p).endswith("gen") else scandir(p))
    rows = list(collect.Walk(str(tree), [], None, 400).below(str(tree)))
    assert [(r[0], r[3]) for r in rows if r[3]] == [("gen", "EACCES")]


def test_ignore_list(spark):
    assert collect.ignore_patterns([" ./scripts/seed/ ", "", "# note", ".", "*.gen.ts", None, "a(b)", "scripts/seed"]) == ["scripts/seed", "scripts/seed/**", "*.gen.ts", "a(b)", "a(b)/**"]
    assert collect.ignore_patterns("no list") == []
    some = files(spark, {"scripts/seed/x.ts": "", "scripts/seeds.ts": "", "q/a.gen.ts": "", "b.ts": ""})
    assert collect.matching_files(some, collect.ignore_patterns(["scripts/seed", "*.gen.ts"])).first().n == 2
    assert collect.matching_files(some, []).first().n == 0


def test_ignored_files_are_those_of_git(spark, tmp_path):
    rules = {
        ".gitignore": "# c\n*.log\n!keep.log\n/top.ts\nbuild/\ndocs/*.md\n**/gen/**\nfoo/**/bar.ts\nx?.ts\n[ab].py\n\\#odd.ts\nspace.ts   \n!build/keep.ts\nnested\n",
        "src/.gitignore": "*.tmp.ts\n!important.log\n/only.ts\n!x1.ts\n",
        "src/deep/.gitignore": "*\n!*.go\n!.gitignore\n",
    }
    paths = ["a.log", "keep.log", "src/keep.log", "src/important.log", "src/other.log", "top.ts", "src/top.ts", "build/a.ts", "build/keep.ts", "src/build/b.ts", "build.ts", "docs/a.md", "docs/in/a.md", "gen/a.ts", "src/gen/in/a.ts", "foo/bar.ts", "foo/q/r/bar.ts", "x1.ts", "xyz.ts", "src/x1.ts", "src/x2.ts", "a.py", "c.py", "#odd.ts", "space.ts", "src/a.tmp.ts", "a.tmp.ts", "src/only.ts", "src/in/only.ts", "src/deep/a.ts", "src/deep/a.go", "src/deep/in/b.go", "nested/x.ts", "src/nested/y.ts", "nested.ts"]
    for path, text in {**{p: "" for p in paths}, **rules}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    told = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin"], input="\n".join(paths), capture_output=True, text=True).stdout.split("\n")
    got = collect.ignored_files(files(spark, {p: "" for p in paths}), files(spark, rules))
    assert sorted(r.path for r in got.collect()) == sorted(t.strip('"') for t in told if t)
    assert collect.ignored_files(files(spark, {p: "" for p in paths}), files(spark, rules).limit(0)).count() == 0
