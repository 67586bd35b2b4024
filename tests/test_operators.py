"""Operators on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from srcloom.functions.rule_catalog import MIGRATIONS, RULES
from srcloom.functions.textual import ascii_pattern, glob_pattern, hundredths
from srcloom.jobs.code_queries import duplicate_clusters
from srcloom.operators import duplicates, findings, metrics, patterns, statements, symbols
from srcloom.operators.components import components
from srcloom.sources.corpora import files_of_folder, language, lines_of


def lines(spark, **files):
    data = [(name.replace("__", "."), content) for name, content in files.items()]
    return lines_of(spark.createDataFrame(data, "path string, content string"))


def whole(spark, **files):
    data = [(name.replace("__", "."), content) for name, content in files.items()]
    return spark.createDataFrame(data, "path string, content string").withColumn("language", language(F.col("path")))


def test_metrics_of_nested_file(spark):
    text = "function a() {\n  if (x) {\n    for (;;) {\n    }\n  }\n}\n// note\n"
    m = metrics.file_metrics(lines(spark, a__ts=text)).first()
    assert (m.line_count, m.code_lines, m.comment_lines, m.branch_points) == (8, 6, 1, 2)
    n = metrics.nesting(lines(spark, a__ts=text)).first()
    assert (n.max_depth, n.complexity) == (3, 1 * 2 + 1 * 3)


def test_depth_never_falls_below_zero(spark):
    n = metrics.nesting(lines(spark, a__ts="}\n}\nif (a) {\n}")).first()
    assert n.max_depth == 1


def test_indent_depth(spark):
    text = "def a():\n  if x:\n    y\n\n  z\nw"
    facts = metrics.line_facts(lines(spark, a__py=text))
    assert metrics.indent_nesting(facts).first().max_depth == 2


def test_optional_marks_are_no_branches(spark):
    assert metrics.file_metrics(lines(spark, a__ts="x?: T; a ?? b; a?.b; c ? 1 : 2")).first().branch_points == 1


def test_empty_and_null_files(spark):
    df = spark.createDataFrame([("a.ts", ""), ("b.ts", None)], "path string, content string")
    assert [(r.path, r.line_count) for r in metrics.file_metrics(lines_of(df)).collect()] == [("a.ts", 1)]
    assert metrics.metric_findings(lines_of(df)).count() == 0


def test_rules_hit_and_are_cleared(spark):
    hits = patterns.pattern_hits(lines(spark, bad__py="f = open(x)", good__py="with open(x) as f:\n  open(x)", c__test__ts="debugger", d__ts="debugger;"))
    assert sorted((r.path, r.rule) for r in hits.collect()) == [("bad.py", "open-without-context-manager-py"), ("d.ts", "debugger-statement-ts")]


def test_catalog_is_sound(spark):
    assert len(RULES) == 64 and len({r.id for r in RULES}) == 64 and len(MIGRATIONS) == 29
    assert {r.severity for r in RULES} <= {"critical", "high", "medium", "low"}
    tried = [F.lit("x").rlike(ascii_pattern(r.pattern)) for r in RULES] + [F.lit("x").rlike(ascii_pattern(m.pattern)) for m in MIGRATIONS]
    spark.range(1).select(F.array(*tried)).collect()


def test_race_needs_if_and_nearby_write(spark):
    check, write = "if (fs.existsSync(p)) {", "fs.writeFileSync(p, d)"
    far = "\n".join([check, *["x"] * 8, write])
    found = patterns.races(lines(spark, a__ts=f"{check}\n{write}", b__ts=far, c__ts=f"{check}\n{write} // 'wx'", d__ts=f"fs.existsSync(p)\n{write}", e__test__ts=f"{check}\n{write}"))
    assert [(r.path, r.n, r.act_n) for r in found.collect()] == [("a.ts", 1, 2)]


def test_dead_and_divergent_exports(spark):
    files = whole(spark, a__ts="export function usedThing() {\nexport function deadThing() {\nexport type DeadType = 1", b__ts="import { usedThing as u } from './a'\nexport function deadThing() {", c__go="func OnlyHere() {\nfunc Shared() {", d__go="x := Shared()")
    some = symbols.file_symbols(files)
    dead = {(r.path, r.name): r.confidence for r in symbols.dead_exports(some).collect()}
    assert dead == {("a.ts", "deadThing"): 0.9, ("a.ts", "DeadType"): 0.5, ("b.ts", "deadThing"): 0.9}
    assert [(r.name, r.confidence) for r in symbols.dead_exports_by_words(files, some).collect()] == [("OnlyHere", 0.7)]
    assert [(r.name, r.n_files) for r in symbols.divergent_exports(some).collect()] == [("deadThing", 2)]
    assert {r.path: r.fan_in for r in symbols.fan_in(some).collect()} == {"a.ts": 1, "b.ts": 0, "c.go": 0}


def test_unused_imports(spark):
    data = [("a.ts", "typescript", "import { used, unused } from './b'\nused()"), ("b.py", "python", "from m import (x, y)\nprint(x)"), ("c.cs", "csharp", "using Foo = Bar;")]
    some = spark.createDataFrame(data, "path string, language string, content string")
    assert sorted((r.path, r.name) for r in statements.unused_imports(some).collect()) == [("a.ts", "unused"), ("b.py", "y")]


def test_window_matches_and_clusters(spark):
    items = spark.createDataFrame([("a", list("abcdefgh")), ("b", list("xbcdefy")), ("c", list("zz")), ("d", None)], "path string, items array<string>")
    pairs = duplicates.window_matches(items, 5)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 1)]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "path_a string, path_b string")
    assert sorted((r.path, r.root, r["size"]) for r in duplicates.clusters(chain).collect()) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("x", "x", 2), ("y", "x", 2)]


def test_clusters_hold_windows_met_more_often_than_the_cap(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(45))
    docs = [(i, text, "s") for i in range(duplicates.MOST_IN_BUCKET + 101)] + [(9000, text.replace("w", "v") + " " + text.replace("w", "v"), "s"), (9001, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = duplicate_clusters(spark, str(tmp_path)).collect()
    assert {(r.root, r["size"]) for r in found} == {("s/0.py", 601)}
    assert {r.path for r in found} == {f"s/{i}.py" for i in range(601)}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(5, 5)]
    found = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {found[i] for i in range(61)} == {0} and {found[2000 + i] for i in range(50)} == {1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_duplicate_confidence(spark):
    row = spark.range(1).select(duplicates.confidence(F.lit(0.25), F.lit(0.15), F.lit(6.0), F.lit(1.0)).alias("c"), hundredths(F.lit(1.005)).alias("h")).first()
    assert (row.c, row.h) == (0.5, 1.0)


FINDING = "run_id long, ord long, check_name string, file string, description string, symbol string, severity string, confidence double, status string"


def test_ids_number_repeated_signatures(spark):
    rows = [(1, 1, "c", "f", "d", None, "low", None, "open"), (1, 2, "c", "f", "d", None, "high", 0.5, "open"), (1, 3, "c", "f", "e", None, "low", 1.0, "open")]
    ids = [r.id for r in findings.stamped(spark.createDataFrame(rows, FINDING)).orderBy("ord").collect()]
    assert len(set(ids)) == 3 and all(i.startswith("f-") and len(i) == 18 for i in ids)


def test_merge_marks_stale_and_revives(spark):
    state = "id string, severity string, status string, notes string, severity_overridden boolean"
    old = spark.createDataFrame([("a", "low", "open", None, False), ("b", "low", "stale", "n", True), ("c", "low", "ignored", None, False)], state)
    new = spark.createDataFrame([("b", "high", None), ("c", "high", None), ("d", "high", "fixed")], "id string, severity string, status string")
    got = {r.id: (r.severity, r.status, r.notes) for r in findings.merged(old, new).collect()}
    assert got == {"a": ("low", "stale", None), "b": ("low", "open", "n"), "c": ("high", "ignored", None), "d": ("high", "fixed", None)}


def test_filters_treat_missing_as_fixable_and_certain(spark):
    rows = spark.createDataFrame([(1, None, None, "open"), (2, False, 0.9, "open"), (3, True, 0.5, "open"), (4, True, 1.0, "stale")], "ord long, fixable boolean, confidence double, status string")
    assert [r.ord for r in findings.filtered(rows, fixable=True, min_confidence=0.8).collect()] == [1]


@pytest.mark.parametrize("glob, path, hit", [("**/*.test.*", "a/b.test.ts", True), ("*.ts", "a/b.ts", False), ("src/{a,b}.go", "src/b.go", True), ("a?.py", "ab.py", True), ("{a", "{a", True), ("**", "x/y", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(glob_pattern(glob), path)) == hit


def test_folder_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ts").write_text("one\ntwo")
    (tmp_path / "a/big.ts").write_text("x" * 100)
    (tmp_path / "a/readme.md").write_text("no")
    got = files_of_folder(spark, str(tmp_path), largest=50).collect()
    assert [r.content for r in got] == ["one\ntwo"]
    assert spark.createDataFrame([("a.jsx",), ("b.none",), (".ts",)], "p string").select(language(F.col("p"))).collect() == [("typescript",), (None,), (None,)]


def test_findings_of_all_runs(spark, folder):
    from srcloom.jobs import finding_queries as q

    stamped = findings.stamped(q.findings(spark, folder))
    all_runs = sorted(r.run_id for r in stamped.select("run_id").distinct().collect())
    assert q.patched(spark, folder).count() == stamped.count()
    merged = sorted(str(tuple(r)) for r in q.merged(spark, folder).collect())
    carried = sorted(str(tuple(r)) for r in q.carried(spark, folder).collect())
    want_merged, want_carried = [], []
    for prior, run in zip(all_runs, all_runs[1:], strict=False):  # run by run
        old, new = stamped.filter(F.col("run_id") == prior), stamped.filter(F.col("run_id") == run)
        scan = new.select("id", "severity", F.when(F.col("status") == "fixed", "fixed").alias("status"))
        want_merged += [str((run, *r)) for r in findings.merged(q._state(old), scan).collect()]
        want_carried += [str((run, *r)) for r in findings.carried(new, old).collect()]
    assert merged == sorted(want_merged) and carried == sorted(want_carried)



def test_runs_follow_each_other_over_gaps(spark):
    rows = spark.createDataFrame([(1, "x", "ignored"), (4, "x", "open"), (4, "y", "false-positive"), (9, "y", "open"), (9, "x", "open")], "run_id long, id string, status string")
    assert sorted(tuple(r) for r in findings.carried(rows, findings.as_prior(rows), ("run_id", "id")).collect()) == [(4, "x", "ignored"), (9, "y", "false-positive")]


def test_noise_is_blanked(spark):
    text = "a /* x\ny */ b // c\nhttp://kept\n  # hash\nx = `t\nu` + \"q\\\"r\" + 's\\'t';\nif (/fe[t]ch/.test(y)) z = a / b / c;"
    got = spark.createDataFrame([(text,)], "x string").select(patterns.without_noise(F.col("x"))).first()[0]
    assert got == "a  b \nhttp://kept\nx = \"\" + \"\" + '';\nif (\"\".test(y)) z = a \"\" c;" or got == "a  b \nhttp://kept\n\nx = \"\" + \"\" + '';\nif (\"\".test(y)) z = a \"\" c;"


def test_token_counts(spark):
    from srcloom.operators import code_duplicates

    files = spark.createDataFrame([("a.ts", "/* if x */ if (y1 > 0x1F) return `if ${x}`;"), ("b.py", None), ("c.go", "")], "path string, content string")
    assert {r.token: r.n for r in code_duplicates.token_counts(code_duplicates.token_files(files)).collect()} == {"if": 1, "(": 1, "IDENT": 1, ">": 1, "NUM": 1, ")": 1, "return": 1, "STR": 1, ";": 1}


@pytest.mark.parametrize("pattern, strings", [(r"\bfoo\(", ("foo(",)), (r"a(?:bcd|ef)+", ("bcd", "ef")), (r"x?yz", ("yz",)), (r"(?:ab|c*)d", ("d",)), (r"(?i)foo", ()), (r"[ab]\d", ()), (r"foo|bar", ("foo", "bar")), (r"(?<!q)ab(?=longer)", ("ab",)), (r"(", ())])
def test_needed_strings(pattern, strings):
    from srcloom.functions.textual import needed

    assert set(needed(pattern)) == set(strings)
