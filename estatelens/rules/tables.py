"""Fixed values of the rule tables: suggestions, refactoring hints, relation weights, exemptions.

The texts and numbers below are constants that results must contain literally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Advice per violation type for the pattern report.
MODULE_SUGGESTIONS = {
    "god_class": "Audit all large classes; schedule a refactoring sprint to apply Extract Class.",
    "hook_overload": "Create a `/hooks` directory; extract custom hooks project-wide.",
    "duplicate_hooks": "Search-and-merge duplicate hook calls across all components.",
    "tight_coupling": "Introduce constructor DI or a parameter object pattern across all services.",
    "any_type": "Enable `noImplicitAny` in tsconfig.json to catch new occurrences at compile time.",
    "any_usage": "Enable `noImplicitAny` in tsconfig.json to catch new occurrences at compile time.",
    "console_log": "Install eslint-plugin-no-console and enable as error in CI.",
    "missing_key": "Add eslint-plugin-react `react/jsx-key` rule as error.",
    "inline_handler": "Add eslint rule `react/jsx-no-bind` to catch new occurrences.",
    "long_method": "Adopt a team rule: methods >40 lines require a PR comment.",
    "empty_catch": "Add a linting rule for empty catch blocks (e.g. `no-empty` in ESLint).",
    "todo_placeholder": "Set up a pre-commit hook that blocks TODO/FIXME markers without a ticket number.",
    "unimplemented_stub": "Add a test that calls every exported function — stubs will throw and fail CI.",
    "tech_debt_marker": 'Create a "tech-debt" label in your issue tracker; link each HACK comment.',
    "magic_number": "Create a shared `constants.ts` module; add a lint rule against literal numbers.",
    "no_test_coverage": "Enforce a minimum Jest coverage threshold in jest.config.js.",
    "no_test_file": "Enforce a minimum Jest coverage threshold in jest.config.js.",
    "low_test_coverage": "Set `coverageThreshold` to 50 in jest.config.js; increase to 80 over time.",
    "moderate_test_coverage": "Add branch coverage reporting; target 80% for all core modules.",
    "uncovered_lines": "Focus test additions on the specific uncovered lines listed in the lcov report.",
    "hollow_test_file": "Audit all test files for empty describe/it blocks; add real assertions.",
    "analysis_error": "Investigate analysis failures; they may indicate syntax errors or encoding issues.",
    "high_import_count": "Introduce barrel files or feature modules to reduce per-file import counts.",
}

_TYPE_STEPS = [
    "For each `any`, examine the actual runtime shape of the value.",
    "Create a named interface or type alias in a co-located `types.ts`.",
    "Replace `any` with the specific type or `unknown` + a type guard.",
]
_TEST_STEPS = [
    "Create a `*.test.ts` file alongside the source file.",
    "Write at minimum one test for each exported function.",
    "Run with `--coverage` to verify coverage registers.",
]

# Refactoring hint per violation type: (pattern, priority, rationale, steps).
REFACTORING_HINTS = {
    "god_class": (
        "Extract Service",
        "high",
        "A class with >20 methods violates Single Responsibility and resists change.",
        [
            'List all methods and group them by the "noun" they operate on.',
            "Create one new class per group (e.g. UserRepository, UserValidator).",
            "Move the methods, adjusting access modifiers.",
            "Replace original class references with constructor-injected dependencies.",
            "Delete the original god class once all callers are updated.",
        ],
    ),
    "hook_overload": (
        "Extract Custom Hook",
        "high",
        "Components with >7 hooks are hard to test and reuse.",
        [
            "Identify groups of 2–3 hooks that share a common concern (e.g. form state, auth state).",
            "Create a `useXxx` file in a `/hooks` directory for each group.",
            "Move the hook calls and their derived state into the custom hook.",
            "Return only the values the component needs from the custom hook.",
            "Replace the inline hook calls in the component with a single `useXxx()` call.",
        ],
    ),
    "duplicate_hooks": (
        "Consolidate Hook Calls",
        "medium",
        "Calling the same hook twice creates redundant subscriptions and subtle bugs.",
        [
            "Find all calls to the duplicated hook.",
            "Merge them into a single call at the top of the component.",
            "Destructure all needed values from the single call.",
        ],
    ),
    "tight_coupling": (
        "Apply Dependency Injection",
        "high",
        "Constructors with >5 parameters signal tightly coupled dependencies.",
        [
            "Create a `XxxOptions` or `XxxConfig` class that groups related parameters.",
            "Or: define an interface for each dependency and inject it via the constructor.",
            "Update the constructor signature to accept the interface/options type.",
            "Update all call sites.",
        ],
    ),
    "any_type": ("Add Type Definitions", "medium", "`any` bypasses the type checker and hides bugs.", _TYPE_STEPS),
    "any_usage": ("Add Type Definitions", "medium", "`any` bypasses the type checker and hides bugs.", _TYPE_STEPS),
    "console_log": (
        "Replace Console Statements",
        "low",
        "console.log leaks internals and clutters production logs.",
        [
            "Delete debug console.log calls.",
            "Replace intentional logging with a structured logger (e.g. pino, winston).",
        ],
    ),
    "missing_key": (
        "Add Stable List Keys",
        "high",
        "Missing key props cause React to re-mount list items unnecessarily.",
        [
            "Add `key={item.id}` (or another stable unique field) to the outermost JSX element inside every `.map()` callback.",
            "Never use array index as key unless the list is static and never reordered.",
        ],
    ),
    "inline_handler": (
        "Extract Event Handlers",
        "low",
        "Inline arrow functions in JSX create new references on every render.",
        [
            "Move the inline function body to a named `const handleXxx = useCallback(...)` above the JSX return.",
            "Pass the named function as the event handler prop.",
        ],
    ),
    "long_method": (
        "Decompose Method",
        "medium",
        "Methods >50 lines are hard to test and reason about.",
        [
            'Find the natural "paragraphs" in the method (groups of lines with a shared purpose).',
            "Extract each paragraph into a private helper method with a descriptive name.",
            "Replace the paragraph in the original method with a single call to the helper.",
        ],
    ),
    "empty_catch": (
        "Handle Exceptions Explicitly",
        "high",
        "Empty catch blocks silently swallow errors, making failures invisible.",
        [
            "At minimum, log the error: `console.error(err)` or use your structured logger.",
            "If the error is expected and safe to ignore, add a comment explaining why.",
            "If the error is unrecoverable, rethrow it.",
        ],
    ),
    "todo_placeholder": (
        "Resolve TODO Markers",
        "medium",
        "TODO/FIXME markers indicate incomplete work that should not reach production.",
        [
            "Implement the missing functionality, or create a tracked issue.",
            "Remove the marker once addressed.",
        ],
    ),
    "unimplemented_stub": (
        "Implement Required Functionality",
        "high",
        "Stubs that throw at runtime will crash in production.",
        [
            "Implement the actual logic.",
            "If not yet possible, at least return a safe default and log a warning.",
        ],
    ),
    "tech_debt_marker": (
        "Track and Schedule Technical Debt",
        "low",
        "HACK/WORKAROUND markers accumulate and degrade maintainability.",
        [
            "Create a ticket in your issue tracker referencing the file and line.",
            "Add a comment with the ticket number next to the marker.",
            "Schedule the cleanup in the next sprint.",
        ],
    ),
    "magic_number": (
        "Extract Named Constants",
        "low",
        "Magic numbers make code opaque and brittle to change.",
        [
            "Move each magic number to a `const` at the top of the file or in a `constants.ts`.",
            "Give it a name that explains what it means, not just its value.",
        ],
    ),
    "no_test_coverage": ("Add Unit Tests", "high", "No test coverage means changes are made blind.", _TEST_STEPS),
    "no_test_file": ("Add Unit Tests", "high", "No test coverage means changes are made blind.", _TEST_STEPS),
    "low_test_coverage": (
        "Increase Test Coverage to 80%",
        "medium",
        "Coverage below 50% leaves most logic paths untested.",
        [
            "Run `npx jest --coverage` and open the HTML report.",
            "Focus on uncovered branches (conditionals, error paths).",
            "Add tests until coverage exceeds 80%.",
        ],
    ),
    "hollow_test_file": (
        "Add Real Test Assertions",
        "high",
        "Test files with empty suites or no assertions provide no safety net.",
        [
            "Review the test file for empty `describe` or `it` blocks.",
            "Add at least one real assertion per exported function.",
            "Run tests and verify they fail when code breaks.",
        ],
    ),
}

# Hint for files with many imports.
HIGH_IMPORT_HINT = (
    "Introduce Module Boundary",
    "medium",
    ">15 imports signal a file doing too much; >30 is a coupling crisis.",
    [
        "Identify clusters of imports that relate to the same concern.",
        "Create a barrel/index.ts for each cluster.",
        "Or: split the file into feature-focused modules.",
        "Aim for ≤15 imports per file.",
    ],
)

# Hint for files on a dependency cycle.
CYCLE_HINT = (
    "Break Circular Dependency",
    "high",
    [
        "Identify which import creates the cycle (usually an upward import).",
        "Extract shared types into a new `types.ts` or `interfaces.ts` that neither module imports.",
        "Apply Dependency Inversion: depend on an abstraction (interface), not a concrete implementation.",
        "Or: merge the two tightly coupled files if they are truly inseparable.",
    ],
)

# Weight of each relation type.
RELATION_WEIGHTS = {
    "CLASS_EXTENDS": 3.0,
    "IMPLEMENTS": 3.0,
    "FUNCTION_CALL": 2.0,
    "TEST_COVERS": 2.0,
    "IMPORT": 1.0,
    "CONFIG_REFERENCE": 1.0,
    "SHARED_DEPENDENCY": 0.5,
    "COMMENTS_ABOUT": 0.5,
    "SIMILAR_TOPIC": 0.25,
}

# C# and .NET type names that never count as a dependency.
BUILTIN_TYPES = [
    "String",
    "Int32",
    "Int64",
    "Boolean",
    "Byte",
    "Char",
    "Decimal",
    "Double",
    "Float",
    "Single",
    "Object",
    "Void",
    "DateTime",
    "DateTimeOffset",
    "TimeSpan",
    "Guid",
    "Task",
    "ValueTask",
    "List",
    "Dictionary",
    "HashSet",
    "IEnumerable",
    "IList",
    "IDictionary",
    "ICollection",
    "IQueryable",
    "ILogger",
    "IConfiguration",
    "CancellationToken",
    "Exception",
    "ArgumentException",
    "ArgumentNullException",
    "InvalidOperationException",
    "NotImplementedException",
    "NotSupportedException",
    "Action",
    "Func",
    "Predicate",
    "EventHandler",
    "Nullable",
    "Lazy",
    "Console",
    "Math",
    "Convert",
    "Enumerable",
    "StringBuilder",
    "Regex",
    "File",
    "Path",
    "Directory",
    "Stream",
    "StreamReader",
    "StreamWriter",
    "HttpClient",
    "HttpContext",
    "HttpRequest",
    "HttpResponse",
    "JsonSerializer",
    "JsonConvert",
    "JObject",
    "JArray",
    "JToken",
    "IServiceProvider",
    "IServiceCollection",
    "IHostEnvironment",
    "IWebHostEnvironment",
    "Assert",
    "Fact",
    "Theory",
    "Test",
    "TestFixture",
    "SetUp",
    "TearDown",
    "Migration",
    "MigrationBuilder",
    "OperationBuilder",
    "ColumnBuilder",
    "CreateTableBuilder",
    "DbContext",
    "DbSet",
    "ModelBuilder",
    "EntityTypeBuilder",
]

# Folders a source scan does not enter (scanner list; it also skips dot folders).
SCAN_SKIP_DIRS = [
    "node_modules",
    "dist",
    "build",
    ".git",
    ".next",
    "out",
    "coverage",
    "vendor",
    ".cache",
    "__pycache__",
    "bin",
    "obj",
]
# Folders the health scan does not enter.
HEALTH_SKIP_DIRS = [
    "node_modules",
    ".git",
    "dist",
    "bin",
    "obj",
    "build",
    ".next",
    "coverage",
    ".cache",
    ".turbo",
    "out",
    "target",
]

# Path patterns of test files.
TEST_FILE_PATTERNS = [
    r"\.test\.[jt]sx?$",
    r"\.spec\.[jt]sx?$",
    r"__tests__/",
    r"\.tests\.[jt]sx?$",
    r"\.specs\.[jt]sx?$",
    r"(?i)Tests?\.cs$",
    r"(?i)\.Tests?\.cs$",
]

# Base-name patterns of configuration and tooling files.
CONFIG_FILE_PATTERNS = [
    r"^jest\.config\.",
    r"^vitest\.config\.",
    r"^vite\.config\.",
    r"^next\.config\.",
    r"^playwright\.config\.",
    r"^cypress\.config\.",
    r"^webpack\.config\.",
    r"^rollup\.config\.",
    r"^rspack\.config\.",
    r"^\.eslintrc",
    r"^\.prettierrc",
    r"^prettier\.config\.",
    r"^babel\.config\.",
    r"^postcss\.config\.",
    r"^tailwind\.config\.",
    r"^tsconfig",
    r"^typedoc",
    r"^package\.json$",
    r"^\.editorconfig$",
    r"^\.gitattributes$",
    r"^\.gitignore$",
    r"^\.dockerignore$",
    r"^\.nvmrc$",
    r"^\.npmrc$",
    r"^lerna\.json$",
    r"^nx\.json$",
    r"^turbo\.json$",
    r"^commitlint\.config\.",
    r"^\.commitlintrc",
    r"^lint-staged\.config\.",
    r"^\.lintstagedrc",
    r"^stylelint\.config\.",
    r"^\.stylelintrc",
    r"^\.markdownlint",
]

# Signs of a real test case, JavaScript and then C#.
TEST_CONTENT_PATTERNS = [
    r"\bit\s*\(",
    r"\btest\s*\(",
    r"\bdescribe\s*\(",
    r"\bexpect\s*\(",
    r"\bassert\.",
    r"\bshould\.",
    r"\bsuiteTest\s*\(",
    r"\bspecify\s*\(",
    r"\[Test\]",
    r"\[TestMethod\]",
    r"\[Fact\]",
    r"\[Theory\]",
    r"\[DataTestMethod\]",
    r"\bAssert\.",
    r"\bShould\.",
]

# Fixed value: attribute that exempts a C# file from coverage.
COVERAGE_EXEMPT = r"\[ExcludeFromCodeCoverage(?:Attribute)?(?:\s*\([^)]*\))?\]"

# Marker rules, tried in order on each line: (type, severity, pattern, fix).
MARKER_RULES = [
    (
        "todo_placeholder",
        "warning",
        r"(?i)(?:\/\/|\/\*)\s*(TODO|FIXME|PLACEHOLDER|STUB)\b",
        "Replace with the actual implementation",
    ),
    (
        "tech_debt_marker",
        "info",
        r"(?i)(?:\/\/|\/\*)\s*(HACK|WORKAROUND|KLUDGE|XXX)\b",
        "Create a tracking issue and replace with a proper solution",
    ),
]
# The stub rule of each language.
STUB_PATTERNS = {
    "typescript": r"(?i)throw\s+new\s+(?:Error|TypeError|RangeError)\s*\(\s*['\"`](?:not\s+implemented|todo|placeholder|stub)",
    "csharp": r"throw\s+new\s+NotImplementedException\s*\(",
}
STUB_FIX = "Implement the required functionality"

# Comment prefixes that introduce a rationale, tried in order.
WHY_PATTERNS = [
    r"(?i)\/\/\s*why:\s*(.+)",
    r"(?i)\/\/\s*rationale:\s*(.+)",
    r"(?i)\/\/\s*because:\s*(.+)",
    r"(?i)\/\/\s*reason:\s*(.+)",
]

# C# metric and rule patterns.
CS_METHOD = r"\b(public|private|protected|internal|static)\s+[\w<>\[\]?]+\s+\w+\s*\("
CS_CLASS = r"\b(class|interface|struct|record)\s+\w+"
CS_COMPLEXITY = r"\b(if|else if|while|for|foreach|case|catch|\?)\b"
CS_GOD_METHOD = r"\b(public|private|protected)\s+[\w<>\[\]?]+\s+\w+\s*\("
CS_CONSTRUCTOR = r"public\s+\w+\s*\(([^)]+)\)"
CS_MAGIC_NUMBER = r"[^.a-zA-Z_\"'](\b(?!0\b|1\b)\d{2,}\b)"
#: The matches of CS_GOD_METHOD and CS_MAGIC_NUMBER; what stands before is looked at only behind a first letter or a digit.
CS_GOD_METHOD_FAST = r"p(?<=\bp)(ublic|rivate|rotected)\s+[\w<>\[\]?]+\s+\w+\s*\("
CS_MAGIC_NUMBER_FAST = r"(\d(?<=[^.a-zA-Z_\"']\b\d)\d+\b)"
CS_EMPTY_CATCH = r"catch\s*\([^)]*\)\s*\{\s*\}"
CS_USING = r"(?m)^using\s+([\w.]+);"


def suggestion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODULE_SUGGESTIONS.items()), "type string, suggestion string")


def refactoring_table(spark: SparkSession) -> DataFrame:
    rows = [(t, *hint) for t, hint in REFACTORING_HINTS.items()]
    return spark.createDataFrame(
        rows, "type string, pattern_name string, priority string, rationale string, steps array<string>"
    )


def relation_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RELATION_WEIGHTS.items()), "rel_type string, weight double")
