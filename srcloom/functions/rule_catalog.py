"""The rule catalog: line patterns by language."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    id: str
    language: str
    severity: str
    category: str
    fixable: bool
    files: str
    excludes: tuple[str, ...]
    pattern: str
    unless: str | None = None  # a line of the file that matches it clears the whole file


#: Ids, severities, categories, globs and patterns that results must agree on.
RULES: tuple[Rule, ...] = (
    Rule("magic-number", "common", "low", "hardcoded-magic-values", True, "**/*.{ts,tsx,js,jsx,go,py,cs,java}", ("**/*.test.*", "**/*.spec.*", "**/*_test.go", "**/*.min.js", "**/vendor/**", "**/node_modules/**", "**/*.config.*", "**/*.json",), r"(?<![a-zA-Z0-9_.])\b[1-9]\d{2,}\b", r"(?:status|STATUS|port|PORT|timeout|TIMEOUT|\bHTTP|\bversion|epoch|batch|learning.?rate|threshold|seed|SEED)"),
    Rule("ai-step-comment", "common", "low", "comment-quality", True, "**/*.{ts,tsx,js,jsx,go,py,cs,java}", ("**/*.test.*", "**/*.spec.*", "**/*_test.go", "**/__tests__/**", "**/*.stories.*", "**/*.d.ts", "**/node_modules/**", "**/vendor/**",), r"(?:^|\s)(?://|#|/\*)\s*[Ss]tep\s+\d+"),
    Rule("hardcoded-url", "common", "medium", "hardcoded-values", True, "**/*.{ts,tsx,js,jsx,go,py,cs,java}", ("**/*.test.*", "**/*.spec.*", "**/*_test.go", "**/__tests__/**", "**/*.stories.*", "**/*.d.ts", "**/seed.*", "**/seeds/**", "**/fixtures/**", "**/*.json", "**/*.yaml", "**/*.yml", "**/*.toml", "**/*.env*", "**/*.config.*", "**/*.md", "**/constants.*", "**/constants/**", "**/node_modules/**", "**/vendor/**",), r"""https?://(?!localhost|127\.0\.0\.1|example\.com|schema\.org|www\.w3\.org|tools\.ietf\.org)[^\s"'`]+"""),
    Rule("hardcoded-filepath", "common", "low", "hardcoded-values", True, "**/*.{ts,tsx,js,jsx,go,py,cs,java}", ("**/*.test.*", "**/*.spec.*", "**/*_test.go", "**/__tests__/**", "**/*.d.ts", "**/*.config.*", "**/constants.*", "**/constants/**", "**/node_modules/**", "**/vendor/**",), r"(?:/usr/|/home/|/var/|/tmp/|/etc/|[A-Z]:\\\\)"),
    Rule("hardcoded-secret", "common", "critical", "security", False, "**/*.{ts,tsx,js,jsx,go,py,cs,java}", ("**/*.test.*", "**/*.spec.*", "**/*_test.go", "**/node_modules/**", "**/vendor/**", "**/.env.example",), r"""(?:[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Aa][Pp][Ii][_-]?[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Uu][Tt][Hh][_-]?[Tt][Oo][Kk][Ee][Nn]|[Aa][Cc][Cc][Ee][Ss][Ss][_-]?[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt][_-]?[Kk][Ee][Yy]|[Pp][Rr][Ii][Vv][Aa][Tt][Ee][_-]?[Kk][Ee][Yy]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd])\s*(?:=|:)\s*["'`][A-Za-z0-9+/=_-]{8,}["'`]""", r"example|placeholder|your[_-]|xxx|test|dummy|fake|mock|TODO|CHANGEME"),
    Rule("empty-catch-ts", "typescript", "high", "error-handling", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**", "**/*.min.js", "**/*.wasm.js", "**/vendor/**", "**/dist/**", "**/build/**",), r"catch\s*\([^)]*\)\s*\{\s*\}"),
    Rule("catch-only-logs-ts", "typescript", "medium", "error-handling", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"catch\s*\([^)]*\)\s*\{\s*console\.(?:log|error|warn)"),
    Rule("console-log-debug-ts", "typescript", "medium", "debugging-leftovers", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**", "**/*logger*", "**/*logging*",), r"console\.(?:log|debug|info)\s*\("),
    Rule("debugger-statement-ts", "typescript", "high", "debugging-leftovers", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"\bdebugger\b\s*;?"),
    Rule("full-lodash-import-ts", "typescript", "medium", "inefficient-imports", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"""import\s+\w+\s+from\s+['"]lodash['"]"""),
    Rule("full-rxjs-import-ts", "typescript", "medium", "inefficient-imports", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"""import\s+Rx\s+from\s+['"]rxjs['"]"""),
    Rule("full-ramda-import-ts", "typescript", "medium", "inefficient-imports", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"""import\s+(?:R|ramda)\s+from\s+['"]ramda['"]"""),
    Rule("async-useeffect-ts", "typescript", "high", "react-hooks", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"useEffect\s*\(\s*async\b"),
    Rule("promise-no-catch-ts", "typescript", "high", "error-handling", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"\.then\s*\(.*\)\s*;", r"\.catch\s*\("),
    Rule("any-type-ts", "typescript", "medium", "type-safety", True, "**/*.{ts,tsx}", ("**/*.test.*", "**/*.spec.*", "**/*.d.ts", "**/node_modules/**",), r"(?::\s*any\b|\bas\s+any\b|<[^>]*\bany\b[^>]*>|any\[\])"),
    Rule("ts-ignore-comment-ts", "typescript", "medium", "type-safety", True, "**/*.{ts,tsx}", ("**/*.test.*", "**/*.spec.*", "**/*.d.ts", "**/node_modules/**",), r"//\s*@ts-(?:ignore|expect-error|nocheck)"),
    Rule("non-null-assertion-ts", "typescript", "medium", "type-safety", True, "**/*.{ts,tsx}", ("**/*.test.*", "**/*.spec.*", "**/*.d.ts", "**/node_modules/**",), r"\w+!\.[\w(]"),
    Rule("dangerously-set-inner-html-ts", "typescript", "high", "security", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"dangerouslySetInnerHTML", r"DOMPurify|sanitize|xss"),
    Rule("full-moment-import-ts", "typescript", "medium", "full-library-import", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"""import\s+\w+\s+from\s+['"]moment['"]"""),
    Rule("full-underscore-import-ts", "typescript", "medium", "full-library-import", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**",), r"""import\s+(?:_|underscore)\s+from\s+['"]underscore['"]"""),
    Rule("sql-string-concat-ts", "typescript", "critical", "security", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**", "**/*.d.ts",), r'(?:"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b[^"]*"\s*\+|\+\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b|`[^`]*(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b[^`]*\$\{)', r"(?:prepared|parameterized|placeholder|\$\d+|\?)"),
    Rule("eval-usage-ts", "typescript", "critical", "security", True, "**/*.{ts,tsx,js,jsx}", ("**/*.test.*", "**/*.spec.*", "**/node_modules/**", "**/*.d.ts", "**/*.min.js", "**/*.wasm.js", "**/vendor/**", "**/dist/**", "**/build/**", "**/webpack.config.*", "**/rollup.config.*", "**/vite.config.*",), r"(?:\beval\s*\(|new\s+Function\s*\()"),
    Rule("discarded-error-go", "go", "high", "error-handling", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"(?:,\s*_|^\s*_)\s*(?::=|=)\s*\w[\w.]*\s*\(", r"defer\s+\w+\.Close|_\s*=\s*\w+\.Close|_\s*=\s*fmt\.|for\s+_\s*,|for\s+.*,\s*_\s*:=\s*range|_\s*=\s*\w+\.\(|type\s+_\s"),
    Rule("fmt-println-debug-go", "go", "medium", "debugging-leftovers", True, "**/*.go", ("**/*_test.go", "**/vendor/**", "**/cmd/**", "**/main.go",), r"fmt\.Print(?:ln|f)?\s*\("),
    Rule("spew-dump-debug-go", "go", "high", "debugging-leftovers", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"spew\.(?:Dump|Sdump|Printf|Fprintf)\s*\("),
    Rule("empty-error-handling-go", "go", "high", "error-handling", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"if\s+err\s*!=\s*nil\s*\{\s*return\s+nil\s*\}"),
    Rule("ioutil-deprecated-go", "go", "medium", "deprecated-patterns", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"ioutil\.(?:ReadFile|WriteFile|ReadAll|ReadDir|TempDir|TempFile|NopCloser|Discard)"),
    Rule("bare-return-err-go", "go", "low", "error-handling", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"if\s+err\s*!=\s*nil\s*\{\s*return\s+err\s*\}"),
    Rule("log-println-debug-go", "go", "medium", "debugging-leftovers", True, "**/*.go", ("**/*_test.go", "**/vendor/**", "**/cmd/**",), r"log\.(?:Print|Println|Printf)\s*\(", r"log/slog|go\.uber\.org/zap|sirupsen/logrus"),
    Rule("open-without-defer-close-go", "go", "high", "resource-management", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"(?:\.Open\(|os\.Create\()", r"defer\s+\w+\.Close"),
    Rule("goroutine-no-context-go", "go", "high", "concurrency", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r"go\s+(?:func\s*\(|[a-zA-Z_]\w*(?:\.\w+)?\s*\()", r"context|ctx\.Done|select\s*\{"),
    Rule("panic-in-handler-go", "go", "high", "error-handling", True, "**/*.go", ("**/*_test.go", "**/vendor/**", "**/main.go",), r"\bpanic\s*\(", r"recover\s*\("),
    Rule("log-fatal-go", "go", "medium", "error-handling", True, "**/*.go", ("**/*_test.go", "**/vendor/**", "**/main.go", "**/cmd/**",), r"log\.Fatal(?:f|ln)?\s*\("),
    Rule("sql-string-concat-go", "go", "critical", "security", True, "**/*.go", ("**/*_test.go", "**/vendor/**",), r'(?:fmt\.Sprintf\s*\(\s*"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b|"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)\b[^"]*"\s*\+)'),
    Rule("bare-except-py", "python", "high", "error-handling", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**",), r"\bexcept\s*:"),
    Rule("print-debug-py", "python", "medium", "debugging-leftovers", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**", "**/*cli*", "**/*command*", "**/__main__.py", "**/train*", "**/pipeline*", "**/trainer*",), r"^\s*print\s*\("),
    Rule("pdb-debug-py", "python", "critical", "debugging-leftovers", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**",), r"(?:import\s+pdb\s*;\s*pdb\.set_trace\(\)|import\s+ipdb\s*;\s*ipdb\.set_trace\(\)|breakpoint\s*\(\))"),
    Rule("open-without-context-manager-py", "python", "high", "resource-leaks", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**",), r"\bopen\s*\(", r"with\s+open\s*\("),
    Rule("percent-string-format-py", "python", "low", "deprecated-patterns", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**", "**/migrations/**",), r"""(?:"[^"]*%[sdifr][^"]*"|'[^']*%[sdifr][^']*')\s*%\s*\("""),
    Rule("str-format-method-py", "python", "low", "deprecated-patterns", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**", "**/migrations/**",), r"""(?:"[^"]*\{[^}]*\}[^"]*"|'[^']*\{[^}]*\}[^']*')\.format\s*\("""),
    Rule("os-path-instead-of-pathlib-py", "python", "low", "deprecated-patterns", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**",), r"os\.path\.(?:join|exists|dirname|basename|splitext|abspath|expanduser|isfile|isdir)\s*\("),
    Rule("mutable-default-arg-py", "python", "high", "correctness", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**",), r"def\s+\w+\s*\([^)]*=\s*(?:\[\]|\{\}|set\(\))"),
    Rule("wildcard-import-py", "python", "medium", "maintainability", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**", "**/__init__.py",), r"from\s+\S+\s+import\s+\*"),
    Rule("global-keyword-py", "python", "medium", "maintainability", True, "**/*.py", ("**/*_test.py", "**/test_*.py", "**/tests/**",), r"^\s*global\s+\w+"),
    Rule("empty-catch-cs", "csharp", "high", "error-handling", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"catch\s*(?:\([^)]*\))?\s*\{\s*\}", r"when\s*\("),
    Rule("sync-over-async-cs", "csharp", "high", "concurrency", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"(?:\.Result\b|\.GetAwaiter\s*\(\s*\)\.GetResult\s*\()"),
    Rule("console-writeline-debug-cs", "csharp", "medium", "debugging-leftovers", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**", "**/Program.cs",), r"Console\.(?:Write(?:Line)?|Error\.Write(?:Line)?)\s*\("),
    Rule("debug-writeline-cs", "csharp", "medium", "debugging-leftovers", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"(?:System\.Diagnostics\.)?Debug\.(?:Write(?:Line)?|Assert|Print)\s*\("),
    Rule("debugger-break-cs", "csharp", "critical", "debugging-leftovers", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"Debugger\.(?:Break|Launch)\s*\("),
    Rule("webclient-deprecated-cs", "csharp", "medium", "deprecated-patterns", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"new\s+WebClient\s*\("),
    Rule("thread-sleep-cs", "csharp", "medium", "deprecated-patterns", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"Thread\.Sleep\s*\("),
    Rule("new-thread-cs", "csharp", "low", "deprecated-patterns", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"new\s+Thread\s*\("),
    Rule("missing-using-disposal-cs", "csharp", "high", "resource-leaks", True, "**/*.cs", ("**/*.Tests.*", "**/*Test.cs", "**/*Tests.cs", "**/obj/**", "**/bin/**",), r"(?:new\s+(?:FileStream|StreamReader|StreamWriter|SqlConnection|SqlCommand|HttpClient|MemoryStream|BinaryReader|BinaryWriter|DbContext|TcpClient|UdpClient|Process|Timer|CancellationTokenSource|Socket|NpgsqlConnection|MySqlConnection)\s*\()", r"using\s+(?:var|\w+)"),
    Rule("empty-catch-java", "java", "high", "error-handling", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"catch\s*\([^)]+\)\s*\{\s*\}"),
    Rule("catch-broad-exception-java", "java", "medium", "error-handling", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"catch\s*\(\s*(?:Exception|Throwable)\s+"),
    Rule("raw-type-java", "java", "medium", "type-safety", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"(?:List|Map|Set|Collection|Queue|Deque)\s+\w+\s*[=;]"),
    Rule("printstacktrace-java", "java", "medium", "error-handling", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"\.printStackTrace\s*\(\s*\)"),
    Rule("system-out-debug-java", "java", "medium", "debugging-leftovers", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"System\.(?:out|err)\.print(?:ln|f)?\s*\("),
    Rule("vector-deprecated-java", "java", "medium", "deprecated-patterns", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"\bVector\b"),
    Rule("hashtable-deprecated-java", "java", "medium", "deprecated-patterns", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"\bHashtable\b"),
    Rule("stack-deprecated-java", "java", "low", "deprecated-patterns", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"\bStack\s*<"),
    Rule("stringbuffer-deprecated-java", "java", "low", "deprecated-patterns", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"\bStringBuffer\b"),
    Rule("date-deprecated-java", "java", "medium", "deprecated-patterns", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"(?:new\s+Date\s*\(|Calendar\.getInstance\s*\(|new\s+SimpleDateFormat\s*\()"),
    Rule("missing-try-with-resources-java", "java", "high", "resource-leaks", True, "**/*.java", ("**/*Test.java", "**/*Tests.java", "**/test/**", "**/target/**",), r"(?:new\s+(?:BufferedReader|BufferedWriter|FileReader|FileWriter|FileInputStream|FileOutputStream|InputStreamReader|OutputStreamWriter|ZipFile|Connection|PreparedStatement|ResultSet)\s*\(|\.getConnection\s*\(|\.prepareStatement\s*\(|\.createStatement\s*\(|\.executeQuery\s*\()", r"try\s*\("),
)


@dataclass(frozen=True)
class Migration:
    ecosystem: str
    old: str
    new: str
    severity: str
    pattern: str


#: Outdated interfaces and what replaces them.
MIGRATIONS: tuple[Migration, ...] = (
    Migration("javascript", "moment", "dayjs", "medium", r"""import\s+moment\s+from\s+['"]moment['"]|require\s*\(['"]moment['"]\)"""),
    Migration("javascript", "request", "got", "high", r"""require\s*\(['"]request['"]\)|import\s+request\s+from\s+['"]request['"]"""),
    Migration("javascript", "lodash (full import)", "lodash-es or named imports", "medium", r"""import\s+(?:_|lodash)\s+from\s+['"]lodash['"]|require\s*\(['"]lodash['"]\)"""),
    Migration("javascript", "var declarations", "const / let", "low", r"\bvar\s+\w"),
    Migration("javascript", "callback-style async", "async/await", "low", r"function\s*\([^)]*(?:err|error|cb|callback)[^)]*\)\s*\{"),
    Migration("javascript", "underscore", "native array methods or lodash-es", "low", r"""import\s+_\s+from\s+['"]underscore['"]|require\s*\(['"]underscore['"]\)"""),
    Migration("python", "urllib2", "requests or httpx", "critical", r"import\s+urllib2|from\s+urllib2\s+import"),
    Migration("python", "optparse", "argparse", "medium", r"import\s+optparse|from\s+optparse\s+import"),
    Migration("python", "os.path", "pathlib.Path", "low", r"os\.path\.(?:join|exists|dirname|basename|splitext|abspath|isfile|isdir)\s*\("),
    Migration("python", "percent string formatting (%)", "f-strings", "low", r'"[^"]*%[sdifr][^"]*"\s*%\s*\('),
    Migration("python", ".format() string formatting", "f-strings", "low", r'"[^"]*\{[^}]*\}[^"]*"\.format\s*\('),
    Migration("go", "ioutil.ReadFile", "os.ReadFile", "medium", r"ioutil\.ReadFile\s*\("),
    Migration("go", "ioutil.WriteFile", "os.WriteFile", "medium", r"ioutil\.WriteFile\s*\("),
    Migration("go", "ioutil.ReadAll", "io.ReadAll", "medium", r"ioutil\.ReadAll\s*\("),
    Migration("go", "ioutil.TempDir", "os.MkdirTemp", "medium", r"ioutil\.TempDir\s*\("),
    Migration("go", "ioutil.TempFile", "os.CreateTemp", "medium", r"ioutil\.TempFile\s*\("),
    Migration("csharp", "WebClient", "HttpClient (via IHttpClientFactory)", "medium", r"new\s+WebClient\s*\("),
    Migration("csharp", "Thread.Sleep", "await Task.Delay", "medium", r"Thread\.Sleep\s*\("),
    Migration("csharp", "IAsyncResult / Begin*/End* pattern", "async/await", "low", r"IAsyncResult\s+\w+\s*=|Begin\w+\s*\("),
    Migration("java", "java.util.Date", "java.time.Instant / LocalDateTime", "medium", r"new\s+Date\s*\("),
    Migration("java", "Calendar", "java.time.LocalDate / LocalDateTime", "medium", r"Calendar\.getInstance\s*\("),
    Migration("java", "Vector", "ArrayList", "medium", r"\bVector\s*<"),
    Migration("java", "Hashtable", "HashMap / ConcurrentHashMap", "medium", r"\bHashtable\s*<"),
    Migration("java", "javax.servlet", "jakarta.servlet", "high", r"import\s+javax\.servlet"),
    Migration("java", "javax.persistence", "jakarta.persistence", "high", r"import\s+javax\.persistence"),
    Migration("java", "javax.validation", "jakarta.validation", "high", r"import\s+javax\.validation"),
    Migration("java", "javax.inject", "jakarta.inject", "high", r"import\s+javax\.inject"),
    Migration("java", "javax.annotation", "jakarta.annotation", "high", r"import\s+javax\.annotation"),
    Migration("java", "javax.ws.rs", "jakarta.ws.rs", "high", r"import\s+javax\.ws\.rs"),
)
