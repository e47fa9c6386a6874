"""What a path tells: language, test file, entry file, last segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".py": "python", ".go": "go", ".rs": "rust",
}
TEST_PATTERNS = (
    r"(^|/)(tests?|__tests__)(/|$)",
    r"\.(test|spec)\.[cm]?[jt]sx?$",
    r"(^|/)test_[^/]+\.py$",
    r"(^|/)[^/]+_test\.py$",
    r"(^|/)[^/]+_test\.go$",
    r"(^|/)tests/[^/]+\.rs$",
)
ENTRY_PREFIXES = ("index.", "main.", "__init__.", "lib.")


def language(path: Column) -> Column:
    """By the suffix in lower case; null for other files."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)))


def is_test(path: Column, patterns: tuple[str, ...] = TEST_PATTERNS) -> Column:
    return F.coalesce(path.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_entry(path: Column) -> Column:
    base = basename(path)
    found = base.startswith(ENTRY_PREFIXES[0])
    for prefix in ENTRY_PREFIXES[1:]:
        found = found | base.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def last_segment(text: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(text, ".", -1)
