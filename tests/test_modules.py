"""Exports and imports in all their forms, module specifiers, reachable files, and what they change for dead code."""

import datetime

import pytest
from pyspark.sql import functions as F

from srcloom.operators import modules, symbols
from srcloom.sources.corpora import language


def files(spark, **contents):
    rows = [(k.replace("__", ".").replace("_S_", "/"), v) for k, v in contents.items()]
    return spark.createDataFrame(rows, "path string, content string").withColumn("language", language(F.col("path")))


def exported(spark, **contents):
    return {(r.path, r.n, r.name) for r in symbols.exports(symbols.file_symbols(files(spark, **contents))).collect()}


def reached(spark, configs=None, **contents):
    some = None if configs is None else spark.createDataFrame(configs, "path string, content string")
    return {r.path for r in modules.reachable_files(files(spark, **contents), some).collect()}


def test_export_lists_and_blocks(spark):
    assert exported(spark, a__ts="export { one, two as zwei };\nexport {\n  three,\n  four as vier,\n} from './x';\nexport function five() {}\n") == {("a.ts", 1, "one"), ("a.ts", 1, "zwei"), ("a.ts", 2, "three"), ("a.ts", 2, "vier"), ("a.ts", 6, "five")}
    go = "package a\nvar (\n\tAlpha = 1\n\tbeta = 2\n)\nconst (\n\tGamma\n)\nvar Delta int = 1\nconst (\n\tDelta = 3\n)\ntype Shape struct {\n\tInner int\n}\nfunc (s Shape) Area() int {\n"
    assert exported(spark, a__go=go) == {("a.go", 3, "Alpha"), ("a.go", 7, "Gamma"), ("a.go", 9, "Delta"), ("a.go", 13, "Shape"), ("a.go", 16, "Area")}
    assert exported(spark, a__py="@route\nasync def one(x):\nclass Two:\n  def three(self):\n", b__py="", c__py=None) == {("a.py", 2, "one"), ("a.py", 3, "Two")}
    decorated = {r.name: r.decorated for r in symbols.exports(symbols.file_symbols(files(spark, a__py="@route\ndef one(x):\ndef two():\n"))).collect()}
    assert decorated == {"one": True, "two": False}


def test_names_imported_over_several_lines_are_not_dead(spark):
    some = symbols.file_symbols(files(spark, m__py="def one():\ndef two():\ndef three():\n", n__py="from m import (\n    one,\n    two as deux,\n)\n", o__ts="export const four = 1;\n", p__ts="import {\n  four as f,\n} from './o';\n"))
    assert {(r.path, r.name) for r in symbols.dead_exports(some).collect()} == {("m.py", "three")}
    assert {r.path: r.fan_in for r in symbols.fan_in(some).collect()} == {"m.py": 1, "o.ts": 1}


def test_fan_in_counts_each_importer_once(spark):
    some = symbols.file_symbols(files(spark, a__ts="export const x = 1;\nexport const y = 1;\nexport const z = 1;\n", b__ts="import { x, y } from './a';\nimport { w } from './d';\n", c__ts="import { y } from './a';\n", d__ts="import { w } from './other';\nexport const w = 1;\n", e__cs="using My.Deep.Thing;\npublic class Other {", f__cs="public class Thing {"))
    assert {r.path: r.fan_in for r in symbols.fan_in(some).collect()} == {"a.ts": 2, "d.ts": 1, "e.cs": 0, "f.cs": 1}


def test_reachable_files(spark):
    assert reached(spark, src_S_index__ts="export * from './widget';", src_S_widget__ts="x") == {"src/widget.ts"}
    assert reached(spark, src_S_load__ts="const m = async () => (await import('./lazy')).run();", src_S_lazy__ts="") == {"src/lazy.ts"}
    assert reached(spark, index__ts="export * as ns from './feature';", feature_S_index__ts="x") == {"feature/index.ts"}
    assert reached(spark, a_S_index__ts="export * from '../b/widget.js';", b_S_widget__ts="x") == {"b/widget.ts"}
    assert reached(spark, a__ts="export * from './b'", b__js="x", b__ts="x", b_S_index__ts="x") == {"b.ts"}
    assert reached(spark, a__ts="export * from '@/aliased';", b__py="import('./a')", c__ts=None) == set()


def test_reachable_files_by_alias(spark):
    config = '{\n  // project\n  "compilerOptions": {\n    "baseUrl": "./app", "note": "a // b /* c */",\n    "paths": {\n      "@/*": ["none/*", "lib/*"],\n      "config": ["settings/index.ts"], /* exact */\n    },\n  },\n}'
    sources = dict(w_S_src_S_x__ts="export * from '@/utils';\nimport('config');", w_S_app_S_lib_S_utils__ts="", w_S_app_S_settings_S_index__ts="", src_S_y__ts="export * from '@/utils';")
    assert reached(spark, [("w/tsconfig.json", config)], **sources) == {"w/app/lib/utils.ts", "w/app/settings/index.ts"}
    assert reached(spark, [("tsconfig.json", config), ("w/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}')], w_S_x__ts="export * from '@/u'", w_S_src_S_u__ts="", app_S_lib_S_u__ts="") == {"w/src/u.ts"}
    for broken in ("{", "[]", '{"compilerOptions": {}}', '{"compilerOptions": {"paths": 3}}', "", None):
        assert reached(spark, [("tsconfig.json", broken)], a__ts="export * from '@/b'", src_S_b__ts="") == set()


def test_extended_configuration(spark):
    base, own = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"], "~/*": ["old/*"]}}}', '{"extends": "./tsconfig.base", "compilerOptions": {"paths": {"~/*": ["new/*"]}}}'
    got = reached(spark, [("tsconfig.json", own), ("tsconfig.base.json", base)], a__ts="export * from '@/x';\nexport * from '~/y';", src_S_x__ts="", old_S_y__ts="", new_S_y__ts="")
    assert got == {"src/x.ts", "new/y.ts"}


@pytest.mark.parametrize("path, want", [("a/../b/./c", "b/c"), ("/a/b/../../c", "/c"), ("../a", "a"), ("s3://bucket/a/../b", "s3://bucket/b"), ("", ""), ("a//b", "a/b")])
def test_normal(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(modules.normal(F.col("p"))).first()[0] == want


def test_reached_and_recent_files_in_dead_exports(spark):
    code = files(spark, index__ts="export * from './widget';", widget__ts="export function Widget() {}", old__ts="export const old = 1;\nexport type Old = 1;", new__ts="export const fresh = 1;\nexport type Fresh = 1;", new__py="def fresh():\n@x\ndef hooked():\n")
    day = lambda k: datetime.datetime(2024, 3, 1) + datetime.timedelta(days=k)
    log = spark.createDataFrame([("new.ts", "A", day(-3)), ("new.py", "A", day(-30)), ("old.ts", "A", day(-31)), ("old.ts", "M", day(-1)), ("widget.ts", "A", day(1))], "path string, status string, at timestamp")
    recent = symbols.recent_files(log, F.lit(day(0)))
    assert {r.path for r in recent.collect()} == {"new.ts", "new.py"}
    dead = {(r.path, r.name): r.confidence for r in symbols.dead_exports(symbols.file_symbols(code), modules.reachable_files(code), recent).collect()}
    assert dead == {("old.ts", "old"): 0.9, ("old.ts", "Old"): 0.5, ("new.ts", "fresh"): 0.95, ("new.ts", "Fresh"): 0.5, ("new.py", "fresh"): 0.65, ("new.py", "hooked"): 0.3}


def test_each_table_is_read_once(spark, folder):
    """However many joins ask for symbols, the corpus is rendered once, from one scan of lines."""
    from srcloom.sources.corpora import code_files

    plan = code_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert sum("lineitem.parquet" in line for line in plan.splitlines() if "Scan parquet" in line or "FileScan" in line) == 1


def test_no_joins_on_empty_files(spark):
    none = symbols.file_symbols(files(spark, a__ts="x").limit(0))
    assert symbols.dead_exports(none).count() == 0 and symbols.fan_in(none).count() == 0 and modules.reachable_files(files(spark, a__ts="x").limit(0)).count() == 0
