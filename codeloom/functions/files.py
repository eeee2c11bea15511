"""Per-file columns: language, size, lines, hash, and what kind of file a path names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby", ".php": "php",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin",
}
MANIFESTS = {
    "package.json": "javascript", "tsconfig.json": "typescript", "pyproject.toml": "python", "requirements.txt": "python",
    "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "Gemfile": "ruby",
}
IGNORED = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache"]
PARSEABLE = ["python", "javascript", "typescript"]
MAX_FILE_BYTES = 5 * 1024 * 1024
#: On the lower-cased path: a directory called so, or a file named like a test.
_TEST = r"(^|/)(test|tests|__tests__)/|(^|/)(test_[^/]*|[^/]*_test)\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*flat), key)


def file_name(path: Column) -> Column:
    """The last component; also the label of a file in a graph."""
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By the lower-cased last extension; null if unknown. A name that is only an extension has none."""
    return _lookup(EXTENSIONS, F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1)))


def language_or_manifest(path: Column) -> Column:
    """As ``language``, else by the names of manifest files."""
    return F.coalesce(language(path), _lookup(MANIFESTS, file_name(path)))


def is_ignored(path: Column) -> Column:
    """Whether any component, the file name included, is in the ignore list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED]))


def line_count(content: Column) -> Column:
    """Line feeds, and one more if the last line has none and is not empty."""
    text = F.decode(content, "ISO-8859-1")  # a character a byte
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (feeds + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("int")


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, lower-case hex."""
    return F.sha2(content, 256)


def size_bytes(content: Column) -> Column:
    return F.octet_length(content).cast("long")


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(_TEST)


def qualified_name(parent: Column, name: Column) -> Column:
    """``parent.name``, or the name alone."""
    return F.concat_ws(".", parent, name)
