"""Row shapes and the suffixes of source files."""

from __future__ import annotations

NODE_COLUMNS = ("id", "label", "file_type", "source_file", "source_location", "community", "ord")
EDGE_COLUMNS = ("source", "target", "relation", "confidence", "score", "location", "context")

#: Suffixes of files that the extractors read.
CODE_SUFFIXES = (
    ".astro", ".bash", ".c", ".cc", ".cjs", ".cpp", ".cs", ".css", ".cts", ".cxx", ".dart", ".erl", ".ex", ".exs", ".go", ".gradle", ".groovy", ".h", ".hpp", ".hs",
    ".hxx", ".java", ".jl", ".js", ".jsx", ".kt", ".kts", ".lua", ".luau", ".m", ".mjs", ".ml", ".mm", ".mts", ".php", ".pl", ".ps1", ".py", ".pyi", ".pyw",
    ".r", ".rake", ".rb", ".rs", ".scala", ".sh", ".sol", ".sql", ".swift", ".ts", ".tsx", ".vb", ".vue", ".zig",
)
