"""Normalisers, tokens and label statistics. ASCII work stays in SQL functions; Unicode folding is Arrow-batched."""

from __future__ import annotations

import math
import textwrap
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_id_ascii(text: Column) -> Column:
    """Id form of ASCII text: word runs in lower case joined by single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _fold_id(x: str) -> str:
    for _ in range(6):
        y = unicodedata.normalize("NFKC", x.casefold())
        if y == x:
            break
        x = y
    words = "".join(c if c == "_" or unicodedata.category(c)[0] in "LN" else " " for c in x)
    return "_".join(p for p in words.replace("_", " ").split(" ") if p)


@F.pandas_udf(T.StringType())
def normalize_id(text: pd.Series) -> pd.Series:
    """Id form of any text: case folding and compatibility forms to a fixpoint, then as for ASCII."""
    return text.map(_fold_id, na_action="ignore")


def make_id(*parts: str) -> str:
    """An id from parts: empty ones dropped, ``_`` and ``.`` trimmed, joined and normalised."""
    trimmed = [p.strip("_.") for p in parts]
    return _fold_id("_".join(p for p in trimmed if p))


@F.pandas_udf(T.StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    return text.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn"), na_action="ignore")


@F.pandas_udf(T.StringType())
def norm_label(text: pd.Series) -> pd.Series:
    """Label form for entity resolution: folded, anything but letters and digits as one space."""

    def one(s: str) -> str:
        folded = unicodedata.normalize("NFKC", s).casefold()
        return " ".join("".join(c if c.isalnum() else " " for c in folded).split())

    return text.map(one, na_action="ignore")


def norm_label_ascii(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII word tokens in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


@F.pandas_udf(T.DoubleType())
def entropy(label: pd.Series) -> pd.Series:
    """Shannon entropy of the label's characters, in bits: one pass over each label, however many characters differ."""

    def one(s: str) -> float:
        return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values()) + 0.0

    return label.map(one, na_action="ignore").astype(float)


#: The same, never moved by the planner below an aggregate before it: where labels are grouped first, each is measured once.
entropy_in_place = F.pandas_udf(entropy.func, T.DoubleType()).asNondeterministic()


@F.pandas_udf(T.StringType())
def shorten_label(text: pd.Series) -> pd.Series:
    """At most 80 columns, cut between words where possible."""

    def one(s: str) -> str:
        s = " ".join(s.split())
        short = textwrap.shorten(s, 80, placeholder="...")
        return s[:77] + "..." if short == "..." else short

    return text.map(one, na_action="ignore")


def suffix(path: Column) -> Column:
    """Final suffix of a path's name with its dot, in lower case; none for dot files and trailing dots."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", 0))


def top_level_dir(path: Column) -> Column:
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return F.when(F.contains(clean, F.lit("/")), F.substring_index(clean, "/", 1)).otherwise(".")


def line_number(location: Column) -> Column:
    """Line of a location such as ``L12``; null otherwise."""
    return F.regexp_extract(location, r"^L(\d+)$", 1).try_cast("int")
