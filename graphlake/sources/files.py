"""File scans: categories, credentials, ignore rules, and a cache of per-file results by content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake.fixed import CREDENTIAL_DIRS, DOCUMENT_SUFFIXES, IMAGE_SUFFIXES, LOCK_FILES, PAPER_SUFFIXES, SENSITIVE_NAMES, SKIP_DIRS, TEMPLATE_NAMES, VIDEO_SUFFIXES
from graphlake.functions.text import suffix
from graphlake.schema import CODE_SUFFIXES


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def category(path: Column) -> Column:
    """code, mcp, paper, image, video or document by name, in this precedence; null for other files."""
    s = suffix(path)
    name = F.lower(name_of(path))
    mcp = F.endswith(name, F.lit(".mcp.json")) | (name == "mcp.json")
    return F.when(mcp, "code").when(s.isin(*CODE_SUFFIXES), "code").when(s.isin(*PAPER_SUFFIXES), "paper").when(s.isin(*IMAGE_SUFFIXES), "image").when(s.isin(*VIDEO_SUFFIXES), "video").when(s.isin(*DOCUMENT_SUFFIXES), "document")


def language_of(path: Column, registry: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """Language of a file by ``(language, suffixes, names)``: by its whole name, else by its longest suffix of several dots.

    Of languages that claim one suffix or name the last counts; a leading dot begins no suffix.
    """
    suffixes = {x.lower(): language for language, own, _ in registry for x in own}
    names = {x: language for language, _, own in registry for x in own}
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map(F.lit(""), F.lit(None).cast("string"))
    name = name_of(path)
    parts = F.split(F.lower(name), "\\.")
    tails = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: (k <= F.size(parts)) & ((k > 2) | (F.element_at(parts, 1) != ""))), lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k, F.size(parts) - k + 1), ".")))
    known = F.filter(F.transform(tails, lambda t: F.try_element_at(table(suffixes), t)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(table(names), name), F.get(known, F.lit(0)))


def is_sensitive(path: Column) -> Column:
    """Credential stores, keys and secret settings; templates of them are not."""
    parts = F.split(path, "/")
    stored = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.lower(p).isin(*CREDENTIAL_DIRS))
    name = name_of(path)
    secret = F.lit(False)
    for pattern in SENSITIVE_NAMES:
        secret = secret | name.rlike(pattern)
    return stored | (secret & ~name.rlike(TEMPLATE_NAMES))


def is_skipped(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*SKIP_DIRS)) | name_of(path).isin(*LOCK_FILES)


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A rule's pattern as an anchored regular expression over paths, and whether it negates."""
    negated = pattern.startswith("!")
    pattern = pattern[1:] if negated else pattern
    only_dirs = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.lstrip("/")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.+$" if only_dirs else "(?:/.*)?$"), negated


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """``path, ignored``: the last matching rule decides; comments and blank lines are no rules.

    The rules are one expression, so each path is read once.
    """
    verdict = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, negated = glob_regex(rule.strip())
            verdict = F.when(F.col("path").rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return paths.select("path", verdict.alias("ignored"))


def _hidden(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """``(uri, length)`` of files below ``root`` with a segment that starts with ``_`` or ``.``, pruned as :func:`is_skipped` prunes."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    out, waiting = [], [(top, False)]
    while waiting:
        folder, inside = waiting.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            below = inside or name.startswith(("_", "."))
            if status.isDirectory():
                if name not in SKIP_DIRS:
                    waiting.append((status.getPath(), below))
            elif below:
                out.append((status.getPath().toString(), status.getLen()))
    return out


def _read_files(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as arrow_fs

    for part in parts:
        content = []
        for uri in part["path"]:
            fs, path = arrow_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
            with fs.open_input_stream(path) as f:
                content.append(f.read())
        yield part.assign(content=content)


def scan(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """Files under ``root``: ``path, category, state, length, content``; state is kept, sensitive, ignored or unclassified.

    Content is a column like any other: plans that do not use it do not read it. Spark's own sources pass over
    names that start with ``_`` or ``.``, such as package initialisers and settings: these are listed
    by the driver through Hadoop's file system and read by the tasks through Arrow's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")
    hidden = _hidden(spark, root)
    if hidden:
        more = spark.createDataFrame(hidden, "path string, length long").repartition(max(1, len(hidden) // 256))
        files = files.unionByName(more.mapInPandas(_read_files, "path string, length long, content binary"))
    top = F.lit(re.sub(r"^file:/+", "/", root).rstrip("/") + "/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    files = files.withColumn("path", F.when(F.startswith(plain, top), F.substring(plain, F.length(top) + 1, F.length(plain))).otherwise(plain))
    files = files.filter(~is_skipped(F.col("path")))
    verdict = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, negated = glob_regex(rule.strip())
            verdict = F.when(F.col("path").rlike(pattern), F.lit(not negated)).otherwise(verdict)
    kind = category(F.col("path"))
    state = F.when(is_sensitive(F.col("path")), "sensitive").when(verdict, "ignored").when(kind.isNull(), "unclassified").otherwise("kept")
    return files.select("path", kind.alias("category"), state.alias("state"), "length", "content")


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def cache_key(version: str) -> Column:
    """Key of a file's extraction: version, path and content."""
    return F.sha2(F.concat_ws("\x00", F.lit(version), "path", F.col("content").cast("string")), 256)


def split_by_cache(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """``(hits with their cached columns, misses)``."""
    keyed = files.withColumn("key", cache_key(version))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def chunk_files(files: DataFrame, budget_tokens: int, group: list[str]) -> DataFrame:
    """``*group, pos, chunk``: files ``pos, size, image`` dealt in order to chunks of ``3 * budget_tokens`` bytes.

    A file costs its bytes plus 2000; one of unknown size stays in the chunk before it and fills it. An image is a chunk of
    its own. A group's numbers meet in one task, which walks over them once; contents do not.
    """
    budget = 3 * budget_tokens

    def deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "size", "image"], kind="stable")
        known = rows["size"].notna().tolist()
        n, used, fresh, out = 0, 0, True, []
        for size, image, given in zip(rows["size"].fillna(0).astype("int64").tolist(), rows["image"].tolist(), known, strict=True):
            cost = size + 2000
            if not fresh and (image or (given and used + cost > budget)):
                n, used = n + 1, 0
            out.append(n)
            if image:
                n, used, fresh = n + 1, 0, True
            else:
                used, fresh = used + (min(cost, budget + 2000) if given else budget + 2000), False
        return pd.DataFrame({**{c: [v] * len(out) for c, v in zip(group, key, strict=True)}, "pos": rows["pos"].to_numpy(), "chunk": out})

    rows = files.select(*group, F.col("pos").cast("long"), F.col("size").cast("long"), "image")
    schema = T.StructType([*(rows.schema[c] for c in group), T.StructField("pos", T.LongType()), T.StructField("chunk", T.IntegerType())])
    return rows.groupBy(*group).applyInPandas(deal, schema)


def chunk_key(files: DataFrame, group: list[str], version: str) -> DataFrame:
    """``group, key``: the key of each chunk's answer, from the version and its files' own keys in order of path.

    A chunk is bounded by its token budget, so its keys make a short list.
    """
    keyed = files.select(*group, "path", cache_key(version).alias("own"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "own"))), lambda x: x["own"])
    return keyed.groupBy(*group).agg(F.sha2(F.concat_ws("\x00", F.lit(version), F.array_join(ordered, "\x00")), 256).alias("key"))
