"""Bodies of source text rendered from the given tables, by templates that both engines run.

A template says for which rows of a source it adds a line, to which file, and where in that file. Spark reads each
source once, however many templates use it, and moves its rows rather than the lines they make, which are several times as long.
"""

from __future__ import annotations

import re

#: The rows that templates see: orders, their lines, parts, and groups of twenty parts that make a project.
SOURCES = {
    "o": "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey % 5 AS INT) AS lang FROM {orders}",
    "l": "SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_orderkey % 5 AS INT) AS lang, CAST(l_partkey AS STRING) AS p, CAST(l_linenumber AS INT) AS ln, CAST(l_linenumber AS STRING) AS t, CAST(l_quantity AS INT) AS q, l_returnflag AS flag FROM {lineitem}",
    "p": "SELECT CAST(p_partkey AS BIGINT) AS p, CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey AS STRING) AS s, CAST(p_partkey % 5 AS INT) AS lang, CAST(p_size AS STRING) AS size, p_brand AS brand, CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS app FROM {part}",
    "a": "SELECT DISTINCT CAST(floor(p_partkey / 20) AS BIGINT) AS k, CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS app FROM {part}",
}
_LANGUAGE = "CASE lang WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'java' ELSE 'csharp' END"
ORDER_PATH = "'orders/order' || CAST(k AS STRING) || CASE lang WHEN 0 THEN CASE WHEN k % 11 = 0 THEN '.test.ts' ELSE '.ts' END WHEN 1 THEN CASE WHEN k % 11 = 0 THEN '_test.py' ELSE '.py' END WHEN 2 THEN '.go' WHEN 3 THEN '.java' ELSE '.cs' END"
_PART = "'parts/part' || CAST(k AS STRING) || CASE lang WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.java' ELSE '.cs' END"

#: (source, path, language, order in the file, line, condition)
Template = tuple[str, str, str, str, str, str | None]

ORDERS_AND_PARTS: list[Template] = [
    ("o", ORDER_PATH, _LANGUAGE, "1", "CASE lang WHEN 1 THEN '# order ' ELSE '// order ' END || CAST(k AS STRING)", None),
    ("l", ORDER_PATH, _LANGUAGE, "10 + ln", "CASE lang WHEN 0 THEN 'import { makePart' || p || ' } from ''../parts/part' || p || ''';' WHEN 1 THEN 'from parts.part' || p || ' import make_part' || p WHEN 2 THEN 'import part' || p || ' \"acme/parts/part' || p || '\"' WHEN 3 THEN 'import acme.parts.MakePart' || p || ';' ELSE 'using MakePart' || p || ' = Acme.Parts.Part' || p || ';' END", None),
    ("o", ORDER_PATH, _LANGUAGE, "80", "CASE lang WHEN 0 THEN 'export function priceOrder' || CAST(k % 97 AS STRING) || '(items) {' WHEN 1 THEN 'def price_order' || CAST(k % 97 AS STRING) || '(items):' WHEN 2 THEN 'func PriceOrder' || CAST(k % 97 AS STRING) || '(items []int) int {' WHEN 3 THEN 'public class PriceOrder' || CAST(k % 97 AS STRING) || ' implements Pricer' || CAST(k % 41 AS STRING) || ' {' ELSE 'public class PriceOrder' || CAST(k % 97 AS STRING) || ' {' END", None),
    ("l", ORDER_PATH, _LANGUAGE, "100 + 10 * ln", "'  total' || t || ' = ' || CASE lang WHEN 0 THEN 'makePart' WHEN 1 THEN 'make_part' WHEN 2 THEN 'part' ELSE 'MakePart' END || p || '(' || CAST(q AS STRING) || ') ? 1 : 0;'", "flag <> 'N'"),
    ("l", ORDER_PATH, _LANGUAGE, "101 + 10 * ln", "CASE q % 8 WHEN 0 THEN '  if (total' || t || ' > 1' || p || ' && ready || late) {' WHEN 1 THEN CASE lang WHEN 0 THEN '  console.log(total' WHEN 1 THEN '  print(total' WHEN 2 THEN '  fmt.Println(total' WHEN 3 THEN '  System.out.println(total' ELSE '  Console.WriteLine(total' END || t || ');' WHEN 2 THEN CASE lang WHEN 1 THEN '  except:' ELSE '  try { run(); } catch (Exception e) {}' END WHEN 3 THEN CASE lang WHEN 1 THEN '  if os.path.exists(path' || t || '): {' ELSE '  if (fs.existsSync(path' || t || ')) {' END WHEN 4 THEN '  logger.info(line' || t || '); fetch(\"https://api.acme.test/' || p || '\");' WHEN 5 THEN '  var old' || t || ' = config.limit ?? process.env.LIMIT;' WHEN 6 THEN CASE lang WHEN 1 THEN '# Step ' ELSE '// Step ' END || t || ' weighs the part' ELSE '  apiKey: \"key' || p || 'abcdefgh\",' END", None),
    ("l", ORDER_PATH, _LANGUAGE, "102 + 10 * ln", "CASE WHEN lang = 1 THEN '    os.remove(path' || t || ')' ELSE '    fs.writeFileSync(path' || t || ', data' || CASE WHEN q % 3 = 0 THEN ', { flag: \"wx\" }' ELSE '' END || ');' END", "q % 8 = 3"),
    ("l", ORDER_PATH, _LANGUAGE, "103 + 10 * ln", "'  }'", "q % 8 IN (0, 3)"),
    ("o", ORDER_PATH, _LANGUAGE, "1000", "'}'", None),
    ("p", _PART, _LANGUAGE, "1", "CASE lang WHEN 0 THEN 'export const makePart' || s || ' = (q) => createPart(q);' WHEN 1 THEN 'def make_part' || s || '(q):' WHEN 2 THEN 'func MakePart' || s || '(q int) int { return create(q) }' WHEN 3 THEN 'public class MakePart' || s || ' implements Pricer' || CAST(p % 41 AS STRING) || ' {' ELSE 'public class MakePart' || s || ' {' END", None),
    ("p", _PART, _LANGUAGE, "2", "CASE lang WHEN 0 THEN 'export interface Part' || s || ' {' WHEN 1 THEN '  return create_part(q)' ELSE '  // size ' || size END", None),
    ("p", _PART, _LANGUAGE, "3", "CASE WHEN lang = 0 THEN '  size: any; // ' || size ELSE '  brand = \"' || brand || '\";' END", None),
    ("p", _PART, _LANGUAGE, "4", "'}'", None),
    ("p", _PART, _LANGUAGE, "5", "'class Kit' || s || ' implements Part' || s || CASE WHEN p % 10 = 0 THEN ', Part' || CAST(p + 5 AS STRING) ELSE '' END || ' {'", "lang = 0"),
    ("p", _PART, _LANGUAGE, "6", "'  weigh(q) { return q; }'", "lang = 0"),
    ("p", _PART, _LANGUAGE, "7", "'  price(q) { return q; }'", "lang = 0 AND p % 3 = 0"),
    ("p", _PART, _LANGUAGE, "8", "'}'", "lang = 0"),
]


def _app(rest: str) -> str:
    return f"'projects/app' || app || '/' || {rest}"


def _file(path: str, language: str, lines: list[tuple[str, str]], condition: str | None = None, source: str = "p") -> list[Template]:
    """Templates of the lines (order, line) of one file, or of one row's share of it."""
    return [(source, _app(path), f"'{language}'", order, line, condition) for order, line in lines]


def _numbered(*lines: str) -> list[tuple[str, str]]:
    return [(str(k), line) for k, line in enumerate(lines, 1)]


#: Projects of several languages: barrels, aliases, dynamic imports, lists over several lines, blocks, decorators.
PROJECTS: list[Template] = [
    *_file("'src/widgets/w' || s || '.ts'", "typescript", _numbered("'export const makeW' || s || ' = 1;'", "'export interface W' || s || ' {}'"), "p % 4 = 0"),
    *_file("'src/widgets/index.ts'", "typescript", [("p", "'export * from ''./w' || s || CASE WHEN p % 8 = 0 THEN '.js' ELSE '' END || ''';'")], "p % 4 = 0"),
    *_file("'src/lazy/l' || s || '.tsx'", "typescript", _numbered("'export default function L' || s || '() {'", "'}'", "'export function helperL' || s || '() {'", "'}'"), "p % 4 = 1"),
    *_file("'src/load.ts'", "typescript", [("p", "'const l' || s || ' = () => import(''' || CASE WHEN p % 8 = 1 THEN './lazy/l' ELSE '@lazy/l' END || s || ''');'")], "p % 4 = 1"),
    *_file("'src/lib/u' || s || '/part.ts'", "typescript", _numbered("'const inner = 1;'", "'export {'", "'  inner as u' || s || ','", "'  spare' || s || ','", "'};'"), "p % 4 = 2"),
    *_file("'src/run.ts'", "typescript", [("p * 10", "'import {'"), ("p * 10 + 1", "'  u' || s || ','"), ("p * 10 + 2", "'  type Opt' || s || ' as O' || s || ','"), ("p * 10 + 3", "'} from ''@/lib/u' || s || '/part'';'"), ("p + 1000000000000", "'u' || s || '();'")], "p % 4 = 2"),
    *_file("'src/old/o' || s || '.ts'", "typescript", _numbered("'export class O' || s || ' {'", "'  run() { return 1; }'", "'}'", "'export type T' || s || ' = string;'", "'export { helper' || s || ' as againShared } from ''../lib/none'';'"), "p % 4 = 3"),
    *_file("'svc/mod' || s || '.py'", "python", _numbered("'@app.route(\"/v' || s || '\")'", "'def view' || s || '():'", "'  return 1'", "'def used' || s || '():'", "'  return 2'", "'class Spare' || s || ':'", "'  pass'"), "p % 5 = 0"),
    *_file("'svc/start' || app || '.py'", "python", [("p * 10", "'from svc.mod' || s || ' import ('"), ("p * 10 + 1", "'    used' || s || ' as u' || s || ','"), ("p * 10 + 3", "')'"), ("p + 1000000000000", "'u' || s || '()'")], "p % 5 = 0"),
    *_file("'svc/start' || app || '.py'", "python", [("p * 10 + 2", "'    Spare' || s || ','")], "p % 10 = 0"),
    *_file("'go/g' || s || '.go'", "go", _numbered("'package g'", "'var ('", "chr(9) || 'Alpha' || s || ' = 1'", "chr(9) || 'beta = 2'", "')'", "'const ('", "chr(9) || 'Gamma' || s", "')'"), "p % 5 = 1"),
    *_file("'go/use.go'", "go", _numbered("'package g'", "'import ('", "chr(9) || 'f \"fmt\"'", "chr(9) || '\"os/exec\"'", "')'", "'func Use() { f.Println() }'"), source="a"),
    *_file("'go/use.go'", "go", [("100 + p", "'func use' || s || '() int { return Alpha' || s || ' }'")], "p % 5 = 1"),
    *_file("'java/J' || s || '.java'", "java", _numbered("'public class J' || s || ' {'", "'  public int run' || s || '(int x) {'", "'    return x;'", "'  }'", "'}'"), "p % 5 = 2"),
    *_file("'src/deps.ts'", "typescript", _numbered("CASE WHEN k % 3 = 0 THEN '// preact and reactive are others' ELSE 'import { React } from ''react'';' END", "'import { kit } from ''@acme/kit' || CAST(k % 4 AS STRING) || ''';'", "CASE k % 4 WHEN 0 THEN '// tests by @babel/core' WHEN 1 THEN '// left-padding' ELSE '// left-pad' END", "'React(kit);'"), source="a"),
    *_file("'java/Use.java'", "java", [("p", "'import acme.J' || s || ';'")], "p % 10 = 2"),
]

#: The projects' files beside their sources: configurations, manifests of some of the five kinds each, an installed package, ignore rules.
PROJECT_FILES: list[Template] = [
    *_file("'tsconfig.json'", "json", _numbered("'{ // aliases of app ' || app", "'  \"extends\": \"./tsconfig.base\", /* shared */'", "'  \"compilerOptions\": {'", "'    \"baseUrl\": \".\",'", "'    \"paths\": { \"@/*\": [\"src/*\"], },'", "'  },'", "'}'"), source="a"),
    *_file("'tsconfig.base.json'", "json", _numbered("'{ \"compilerOptions\": { \"paths\": { \"@lazy/*\": [\"src/lazy/*\"] } } }'"), source="a"),
    *_file("'package.json'", "json", _numbered("'{'", "'  \"name\": \"app' || app || '\",'", "'  \"scripts\": { \"build\": \"tsc -b\", \"lint\": \"biome check\" },'", "'  \"dependencies\": {'", "'    \"react\": \"17.0.' || app || '\",'", "'    \"@acme/kit' || CAST(k % 5 AS STRING) || '\": \"1.0.0\",'", "CASE WHEN k % 2 = 0 THEN '    \"moment\": \"2.29.0\",' ELSE '    \"lodash\": \"4.0.0\",' END", "'    \"left-pad\": \"1.3.0\"'", "'  },'", "'  \"devDependencies\": {'", "'    \"typescript\": \"5.4.0\",'", "'    \"@types/react\": \"20.0.0\",'", "'    \"@types/babel__core\": \"7.0.0\",'", "'    \"@biomejs/biome\": \"1.8.0\"'", "'  }'", "'}'"), "k % 4 <> 3", "a"),
    *_file("'node_modules/typescript/package.json'", "json", _numbered("'{ \"bin\": { \"tsc\": \"bin/tsc\", \"tsserver\": \"bin/tsserver\" }, \"dependencies\": { \"hidden\": \"1\" } }'"), "k % 2 = 0", "a"),
    *_file("'biome.json'", "json", _numbered("'{ \"extends\": [\"@biomejs/biome\"] }'"), "k % 8 = 1", "a"),
    *_file("'requirements.txt'", "text", _numbered("'flask>=2.0'", "'optparse==1.0'", "'svc'"), "k % 3 = 0", "a"),
    *_file("'go.mod'", "text", _numbered("'module app' || app", "'require ('", "chr(9) || 'github.com/acme/os v1.2.3'", "chr(9) || 'github.com/acme/unseen v0.1.0 // indirect'", "')'"), "k % 3 = 1", "a"),
    *_file("'App' || app || '.csproj'", "xml", _numbered("'<ItemGroup><PackageReference Include=\"WebClient\" Version=\"4.0\" /></ItemGroup>'"), "k % 5 = 0", "a"),
    *_file("'pom.xml'", "xml", _numbered("'<dependency><artifactId>acme</artifactId></dependency>'", "'<dependency><artifactId>servlet</artifactId></dependency>'"), "k % 5 = 1", "a"),
    *_file("'build.gradle'", "text", _numbered("'implementation ''javax:inject:1'''"), "k % 5 = 2", "a"),
    *_file("'.gitignore'", "text", _numbered("'# rules'", "'*.java'", "'!Use.java'", "'/go/'", "'src/**/o*.ts'", "'lazy'", "''"), source="a"),
    *_file("'src/.gitignore'", "text", _numbered("'!old/o*3.ts'"), "k % 2 = 0", "a"),
]

CODE = ORDERS_AND_PARTS + PROJECTS


#: The columns of each source.
_COLUMNS = {name: tuple(re.findall(r" AS (\w+)(?:,| FROM)", rows)) for name, rows in SOURCES.items()}


def _bound(sql: str, source: str) -> str:
    """Template SQL with its columns as fields of the struct that holds a row of the source."""
    return re.sub(r"'(?:[^']|'')*'|\b[a-z]\w*\b", lambda m: f"{source}.{m[0]}" if m[0] in _COLUMNS[source] else m[0], sql)


def _any(conditions: list[str | None]) -> str:
    return "true" if None in conditions else " OR ".join(f"({c})" for c in dict.fromkeys(conditions))


def spark_rows(templates: list[Template]) -> str:
    """Spark SQL for path, place (which of the templates' paths it is) and a struct for each source, null but for one, of all rows
    that add lines to a file. To be formatted: {orders}, {lineitem} and {part} name the tables."""
    places = list(dict.fromkeys(t[:2] for t in templates))
    used = [s for s in SOURCES if s in {t[0] for t in templates}]
    parts = []
    for source in used:
        held = f"named_struct({', '.join(f"'{c}', {c}" for c in _COLUMNS[source])})"
        each = [f"CASE WHEN {_any([t[5] for t in templates if t[:2] == place])} THEN named_struct('path', {place[1]}, 'place', {k}) END" for k, place in enumerate(places) if place[0] == source]
        rows = f"SELECT {held} AS {source}_, inline(filter(array({', '.join(each)}), x -> x IS NOT NULL))".replace("{", "{{").replace("}", "}}")
        parts.append(f"SELECT path, place, {', '.join(f'{s}_ AS {s}' if s == source else f'NULL AS {s}' for s in used)} FROM ({rows} FROM ({SOURCES[source]}))")
    return " UNION ALL ".join(parts)


def spark_lines(templates: list[Template]) -> str:
    """A Spark expression over spark_rows' columns: the lines (ord, line) that a row adds."""
    cases = []
    for k, place in enumerate(dict.fromkeys(t[:2] for t in templates)):
        lines = [f"CASE WHEN {_bound(cond or 'true', source)} THEN named_struct('ord', CAST({_bound(order, source)} AS BIGINT), 'line', {_bound(line, source)}) END" for source, path, _, order, line, cond in templates if (source, path) == place]
        cases.append(f"WHEN {k} THEN array_compact(array({', '.join(lines)}))")
    return f"CASE place {' '.join(cases)} END"


def duckdb_lines(templates: list[Template]) -> str:
    """DuckDB SQL for path, language, n (from 1) and line of all lines."""
    used = {t[0] for t in templates}
    sources = ", ".join(f"{name} AS ({rows.format(orders='orders', lineitem='lineitem', part='part')})" for name, rows in SOURCES.items() if name in used)
    each = " UNION ALL ".join(f"SELECT {path} AS path, {language} AS language, CAST({order} AS BIGINT) AS ord, {line} AS line FROM {source} WHERE {cond or 'true'}" for source, path, language, order, line, cond in templates)
    return f"WITH {sources}, rendered AS ({each}) SELECT path, language, CAST(row_number() OVER (PARTITION BY path ORDER BY ord, line) AS INT) AS n, line FROM rendered"
