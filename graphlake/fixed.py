"""Vocabularies, suffix tables and patterns that results depend on, as plain text."""

# ---- Fixed values: files ----

DOCUMENT_SUFFIXES = (".md", ".mdx", ".qmd", ".skill", ".txt", ".rst", ".html", ".yaml", ".yml")
PAPER_SUFFIXES = (".pdf",)
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
VIDEO_SUFFIXES = (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg")

SKIP_DIRS = (
    "venv", ".venv", "node_modules", "__pycache__", ".git",
    "dist", "build", "target", "site-packages", "lib64",
    ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".nox", ".eggs",
    "lcov-report", "visual-tests", "visual-test", "__snapshots__",
    "storybook-static", "dist-protected",
    ".next", ".nuxt", ".turbo", ".angular",
    ".idea", ".cache", ".parcel-cache", ".svelte-kit", ".terraform", ".serverless",
    ".obsidian", ".smart-env", ".worktrees",
)
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "Cargo.lock", "poetry.lock", "Gemfile.lock",
    "composer.lock", "go.sum", "go.work.sum",
)
CREDENTIAL_DIRS = (".ssh", ".gnupg", ".aws", ".azure", ".kube", ".docker")
SENSITIVE_NAMES = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(^|[^A-Za-z0-9])(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)^secring(\.(gpg|pgp))?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd|\.npmrc|\.pypirc|\.git-credentials|\.boto)$",
)
TEMPLATE_NAMES = r"(?i)\.(example|sample|template|dist|defaults?)$"

TEST_DIRS = ("tests", "test", "spec", "specs", "__tests__")
TEST_NAMES = (
    r"(?i)^test_.*",
    r"(?i)^.*_test\..+$",
    r"(?i)^.*\.test\..+$",
    r"(?i)^.*\.spec\..+$",
    r"(?i)^.*_spec\..+$",
    r"(?i)^.*\.tests\.ps1$",
    r"^.*Test\.java$",
    r"^.*Tests\.java$",
    r"^.*Tests\.cs$",
)

# ---- Fixed values: graph vocabulary ----

CONFIDENCE_RANK = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
GENERIC_RELATIONS = ("references", "uses", "mentions")
IMPORT_RELATIONS = ("imports", "imports_from", "re_exports")
STRUCTURAL_RELATIONS = ("imports", "imports_from", "contains", "method")
ACTIVE_DIRS = ("in-progress", "in_progress", "active", "current", "wip")
ARCHIVED_DIRS = ("_done", "done", "archive", "archived", "backup", "bak", "old", "attic", "graveyard", "completed")

# ---- Fixed values: language families by suffix ----

#: Families within which a build keeps inferred calls and imports.
BUILD_FAMILIES = {
    ".py": "py", ".pyi": "py",
    ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js",
    ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js",
    ".go": "go", ".rs": "rs",
    ".java": "jvm", ".kt": "jvm", ".scala": "jvm", ".groovy": "jvm",
    ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c",
    ".cxx": "c", ".hh": "c", ".hxx": "c",
    ".cu": "c", ".cuh": "c", ".metal": "c", ".m": "c", ".mm": "c",
    ".rb": "rb", ".rake": "rb", ".php": "php", ".cs": "cs", ".swift": "swift", ".lua": "lua",
}
#: Families by which surprises judge that an edge crosses languages.
SURPRISE_FAMILIES = {
    ".py": "python", ".pyw": "python",
    ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ejs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js", ".vue": "js", ".svelte": "js",
    ".go": "go",
    ".rs": "rust",
    ".java": "jvm", ".kt": "jvm", ".kts": "jvm", ".scala": "jvm",
    ".c": "c", ".h": "c", ".cpp": "c", ".cc": "c", ".cxx": "c", ".hpp": "c",
    ".rb": "ruby", ".rake": "ruby",
    ".swift": "swift",
    ".cs": "dotnet", ".vb": "dotnet",
    ".php": "php",
    ".r": "r",
    ".cbl": "cobol", ".cob": "cobol", ".cobol": "cobol", ".cpy": "cobol",
    ".sol": "solidity",
    ".erl": "erlang", ".hrl": "erlang", ".escript": "erlang",
}
#: Families within which names of one file may be bound in another.
CALL_FAMILIES = {
    ".js": "jsts", ".jsx": "jsts", ".mjs": "jsts", ".cjs": "jsts",
    ".ts": "jsts", ".tsx": "jsts", ".mts": "jsts", ".cts": "jsts",
    ".vue": "jsts", ".svelte": "jsts", ".astro": "jsts",
    ".java": "jvm", ".kt": "jvm", ".kts": "jvm",
    ".scala": "jvm", ".groovy": "jvm", ".gradle": "jvm",
    ".c": "native", ".h": "native", ".cpp": "native", ".cc": "native",
    ".cxx": "native", ".hpp": "native", ".cu": "native", ".cuh": "native",
    ".metal": "native", ".m": "native", ".mm": "native", ".swift": "native",
    ".py": "python",
    ".go": "go",
    ".rs": "rust",
    ".cbl": "cobol", ".cob": "cobol", ".cobol": "cobol", ".cpy": "cobol",
    ".r": "r",
    ".sol": "solidity",
    ".erl": "erlang", ".hrl": "erlang", ".escript": "erlang",
    ".rb": "ruby", ".rake": "ruby",
    ".php": "php", ".phtml": "php", ".php3": "php", ".php4": "php",
    ".php5": "php", ".php7": "php", ".phps": "php",
    ".cs": "dotnet", ".vb": "dotnet", ".razor": "dotnet", ".cshtml": "dotnet", ".xaml": "dotnet",
    ".lua": "lua", ".luau": "lua",
    ".zig": "zig",
    ".ex": "elixir", ".exs": "elixir",
    ".jl": "julia",
    ".dart": "dart",
    ".sh": "shell", ".bash": "shell",
    ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell",
}
#: Files in which a name is the same in upper and lower case.
CASE_FREE_SUFFIXES = (
    ".php", ".phtml", ".php3", ".php4", ".php5", ".php7", ".phps",
    ".sql",
    ".nim", ".nims", ".nimble",
    ".cbl", ".cob", ".cobol", ".cpy",
    ".vb",
)
#: Files whose calls need an import to be bound.
IMPORT_BOUND_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")

# ---- Fixed values: names ----

#: Words that begin a comment worth keeping.
RATIONALE_MARKS = ("NOTE", "IMPORTANT", "HACK", "WHY", "RATIONALE", "TODO", "FIXME")
#: Library names that are never bound to a project's definitions.
BUILTIN_GLOBALS = (
    "String", "Number", "Boolean", "Object", "Array", "Symbol", "BigInt", "Date", "RegExp",
    "Error", "TypeError", "RangeError", "SyntaxError", "ReferenceError", "EvalError",
    "URIError", "Promise", "Map", "Set", "WeakMap", "WeakSet", "JSON", "Math", "Reflect",
    "Proxy", "Intl", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURIComponent",
    "decodeURIComponent", "encodeURI", "decodeURI", "URL", "URLSearchParams", "FormData",
    "Blob", "File", "Headers", "Request", "Response", "AbortController", "AbortSignal",
    "TextEncoder", "TextDecoder", "console", "str", "int", "float", "bool", "list", "dict",
    "set", "tuple", "bytes", "len", "range", "enumerate", "zip", "map", "filter", "sum",
    "min", "max", "print", "open", "isinstance", "type", "super", "sorted", "reversed",
    "any", "all", "abs", "round", "next", "iter", "hash", "id", "repr", "callable",
    "getattr", "setattr", "hasattr", "delattr", "vars", "dir", "Int", "Int8", "Int16",
    "Int32", "Int64", "UInt", "UInt8", "UInt16", "UInt32", "UInt64", "Double", "Float",
    "Bool", "Character", "Sendable", "Codable", "Decodable", "Encodable", "Equatable",
    "Hashable", "Identifiable", "Comparable", "CaseIterable", "RawRepresentable",
    "CustomStringConvertible", "CustomDebugStringConvertible", "AnyObject",
    "LocalizedError", "Data", "UUID", "Decimal", "Calendar", "Locale", "TimeZone", "Bundle",
    "IndexPath", "IndexSet", "NotificationCenter", "UserDefaults", "FileManager",
    "URLSession", "URLRequest", "URLComponents", "JSONDecoder", "JSONEncoder",
    "DateFormatter", "NumberFormatter", "ISO8601DateFormatter", "NSObject", "NSString",
    "NSError", "NSLock", "NSAttributedString", "DispatchQueue", "DispatchGroup",
    "OperationQueue", "RunLoop", "View", "Color", "Font",
)
#: Labels too common in code to say anything as hubs.
NOISE_LABELS = (
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object",
    "True", "False",
    "MagicMock", "Mock", "AsyncMock", "NonCallableMock",
    "NonCallableMagicMock", "PropertyMock", "patch", "sentinel",
    "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union",
    "Callable", "Type", "ClassVar", "Final", "Literal", "Protocol",
    "Counter", "defaultdict", "OrderedDict", "datetime", "Enum",
    "os", "sys", "re", "json", "io", "abc", "typing",
    "Foundation", "SwiftUI", "UIKit", "AppKit", "Combine",
    "String", "Int", "Double", "Float", "Bool", "Data", "URL", "Date", "UUID",
    "Sendable", "Codable", "Decodable", "Encodable", "Equatable", "Hashable",
    "Identifiable", "Comparable", "AnyObject", "Error", "LocalizedError",
    "NSObject", "NSString", "NSError", "NSLock",
    "View", "Color", "Font", "DispatchQueue",
)
JSON_NOISE_LABELS = (
    "start", "end", "name", "id", "type", "properties",
    "value", "key", "data", "items", "title", "description", "version",
    "dependencies", "devdependencies", "peerdependencies",
    "optionaldependencies", "bundleddependencies", "bundledependencies",
)
#: Words that may differ between two labels of one entity.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "for", "to",
    "in", "on", "at", "by", "with", "from", "as", "is",
    "are", "be", "this", "that", "its",
)
#: Types that belong to their file: they never merge across files.
ANCHORED_TYPES = ("rationale", "document")
#: A label's stem and the ending that tells variants apart.
VARIANT_ENDING = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
