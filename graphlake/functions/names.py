"""Shapes and keys of names, and texts made safe for pages and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words around the labels of a transcription prompt.
PROMPT_HEAD, PROMPT_TAIL = "Technical discussion about ", ". Use proper punctuation and paragraph breaks."
#: Labels looked at and labels named in it.
PROMPT_LOOK, PROMPT_NAME = 10, 5
#: Characters of a label on a page.
LABEL_CHARS = 256


def member_key(label: Column) -> Column:
    """A member's name for comparison: ASCII letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(label, "[^a-zA-Z0-9]+", ""))


def starts_upper(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def is_identifier(name: Column) -> Column:
    """Letters, digits, underscores and anything beyond ASCII, no digit first."""
    return name.rlike(r"^[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*$")


def last_segment(name: Column, separator: str) -> Column:
    return F.substring_index(name, separator, -1)


def joined_name(package: Column, name: Column, separator: str = ".") -> Column:
    """A name inside its package, if there is one."""
    return F.when(F.coalesce(package, F.lit("")) != "", F.concat(package, F.lit(separator), name)).otherwise(name)


def php_alias_key(raw: Column) -> Column:
    """The part of a written name that a ``use`` may rename, in lower case; none for absolute names."""
    name = F.trim(raw)
    return F.when(~F.startswith(name, F.lit("\\")), F.lower(F.substring_index(name, "\\", 1)))


def php_name(raw: Column, namespace: Column, used: Column) -> Column:
    """The full name of a class written as ``raw``: ``used`` is what its :func:`php_alias_key` stands for, or null."""
    name = F.trim(raw)
    rest = F.regexp_replace(name, r"^[^\\]*", "")
    return (
        F.when(F.startswith(name, F.lit("\\")), F.regexp_replace(name, r"^\\", ""))
        .when(used.isNotNull(), F.concat(used, rest))
        .otherwise(joined_name(namespace, name, "\\"))
    )


def safe_label(label: Column) -> Column:
    """A label for a page: without control characters, cut to its first characters."""
    return F.substring(F.regexp_replace(F.coalesce(label, F.lit("")), r"[\x00-\x1f\x7f]", ""), 1, LABEL_CHARS)


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def page_title(path: Column, outputs: list[str]) -> Column:
    """A path from its first output folder on, else its file name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    at = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(parts, o), F.lit(0).cast("long")) for o in outputs])))
    return F.when(at.isNotNull(), F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/")).otherwise(F.element_at(parts, -1))


def transcription_prompt(labels: Column, fallback: str) -> Column:
    """A prompt that names the first labels of an array, empty ones left out; ``fallback`` without any."""
    some = F.filter(F.slice(labels, 1, PROMPT_LOOK), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(some) > 0, F.concat(F.lit(PROMPT_HEAD), F.array_join(F.slice(some, 1, PROMPT_NAME), ", "), F.lit(PROMPT_TAIL))).otherwise(fallback)
