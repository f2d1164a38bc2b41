"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every text becomes its set of distinct word shingles. Equal sets form one class, so copies
cost one row in all later steps. A class has one signature; each tree of the forest sorts the
classes by its own run of signature values. In that order the classes that share the longest
prefixes stand beside each other: a class is paired with its neighbours as long as the common
prefix holds ``MIN_DEPTH`` values. Where few classes share such a prefix the whole region is
compared; where many do, the window of ``WINDOW`` neighbours keeps those with the longest
prefixes, so the depth adapts to the density of each region.

Pairs whose sketches agree well are confirmed on the full sets. First each class's best pairs
are confirmed and joined to components; then all candidates that still lie between different
components. A candidate inside one component cannot change the result.

Rows of which the window left out neighbours, or of which a scan left out pairs, are crowded. The
regions in which crowded rows still belong to different components are compared in full, in pairs
of tiles: every row outside a region's largest component meets all rows of other components, and
pairs whose sketches agree are confirmed on the full sets at once. A tile pair hands on a spanning
forest of the links it found, at most one for each row. So no link of a crowded region is lost,
and a region that is one component, as large groups of copies soon are, costs nothing.

Chance of missing one link of similarity s in all trees: (1 - s**MIN_DEPTH) ** TREES, at
s = 0.85 about 5e-9, at s = 0.8 about 6e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlake.llm._common import discard, mixed, released, saved, slim, spaced_words, text_slices
from graphlake.llm.components import connected_components

TREES, DEPTH, MIN_DEPTH, WINDOW = 20, 6, 3, 12
#: Signature values in all: each tree sorts by its own run of DEPTH values.
PERMS = TREES * DEPTH
#: Low bytes of the first signature values estimate a pair's similarity; pairs over the threshold less
#: the slack (more than five standard deviations) are looked at in full.
SKETCH, SKETCH_SLACK = 64, 0.25

_PERM = np.random.default_rng(7).integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the bounds of each text in them; a shorter text is one shingle."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    bound = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bound[-1]) - np.repeat(bound[:-1], count) + np.repeat(first[:-1], count)
    size_here = np.repeat(np.minimum(n, size), count)
    out = size_here.astype(np.uint64)
    for k in range(size):
        more = k < size_here
        part = h[np.where(more, at + k, 0)] if len(h) else np.zeros(len(at), np.uint64)
        out = np.where(more, mixed(out * np.uint64(0x9E3779B97F4A7C15) + part), out)
    return out, bound


def text_sets(batch: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For each slice of rows, the sorted distinct shingle hashes of each text."""
    words = spaced_words()
    for lo, hi, data, off in text_slices(batch, column):
        s, e, first = words.split(data, off)
        x, bound = shingle_hashes(words.hashes(data, s, e), first, size)
        yield lo, hi, [np.unique(x[a:b]) for a, b in zip(bound[:-1], bound[1:], strict=True)]


def _sketcher(id_col: str, text_col: str, size: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_col).cast(pa.int64())
            for lo, hi, sets in text_sets(batch, text_col, size):
                n = np.array([len(x) for x in sets], np.int64)
                f = np.zeros((2, len(sets)), np.uint64)
                sig = np.zeros((len(sets), PERMS), np.uint32)
                full = np.flatnonzero(n)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    f[0, full] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    f[1, full] = np.add.reduceat(mixed(flat + np.uint64(0x14057B7EF767814F)), begin)
                    buf = np.empty_like(flat)
                    for k in range(PERMS):
                        np.multiply(flat, _PERM[k], out=buf)
                        sig[full, k] = (np.minimum.reduceat(buf, begin) >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array([x.tobytes() if m else None for x, m in zip(sig, n, strict=True)], pa.binary())],
                    schema=schema,
                )
        released()

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class and tree."""
    names = ["t", "k1", "k2", "k3", "cls", "n", "sketch"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            m = part.num_rows
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(m, PERMS)
            keys = sig.reshape(m, TREES, DEPTH).astype(np.int64)
            cls = part.column("cls").to_numpy()
            n = part.column("n").to_numpy()
            sketch = np.ascontiguousarray((sig[:, :SKETCH] & 0xFF).astype(np.uint8))
            rows = [x.tobytes() for x in sketch]
            for t in range(TREES):
                k = [(keys[:, t, 2 * j] << 31) | (keys[:, t, 2 * j + 1] >> 1) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, t, np.int32)), *map(pa.array, k), pa.array(cls), pa.array(n), pa.array(rows, pa.binary())], names=names)


#: Rows and shingles of one tile in crowded regions.
TILE, TILE_SHINGLES = 1024, 1 << 20

PLANTED = "t int, k1 long, k2 long, k3 long, cls long, n long, sketch binary"
FOUND = "kind int, a long, b long, est double, " + PLANTED


def _common_prefix(k: np.ndarray) -> np.ndarray:
    """Shared leading values of each row and the next, from the packed keys."""
    parts = np.concatenate([np.stack([x >> 31, x & 0x7FFFFFFF], 1) for x in k], 1)  # rows, DEPTH
    same = parts[1:] == parts[:-1]
    return np.cumprod(same, 1).sum(1)


def _scan(similarity: float, edges: bool) -> Callable:
    """Pair neighbours of sorted rows; with ``edges``, also hand on the rows at both ends of the partition.

    The ends of all partitions in their order, a few rows for each, are scanned once more: so neighbours
    meet across the seams, however few rows lie between two seams.
    """
    least = similarity - SKETCH_SLACK

    def pairs(t, k, cls, n, sketch, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs to hand on with their estimates, and the crowded rows."""
        m = len(cls)
        nothing = np.zeros(0, np.int64)
        if m < 2:
            return nothing, nothing, np.zeros(0), nothing
        crowded = []
        lcp = np.where(t[1:] == t[:-1], _common_prefix(k), 0)
        run, ii, jj, ee = lcp.copy(), [], [], []
        for w in range(1, min(WINDOW, m - 1) + 1):
            if w > 1:
                run = np.minimum(run[:-1], lcp[w - 1 :])
            i = np.flatnonzero(run >= MIN_DEPTH)
            if not len(i):
                break
            i = i[i + w >= old]
            j = i + w
            if w == WINDOW:
                crowded += [i, j]
            ok = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (cls[i] != cls[j])
            i, j = i[ok], j[ok]
            for c in range(0, len(i), 20000):
                a, b = i[c : c + 20000], j[c : c + 20000]
                est = (sketch[a] == sketch[b]).mean(1)
                good = est >= least
                ii.append(a[good]), jj.append(b[good]), ee.append(est[good])
        if not ii:
            return nothing, nothing, np.zeros(0), np.unique(np.concatenate(crowded)) if crowded else nothing
        i, j, e = np.concatenate(ii), np.concatenate(jj), np.concatenate(ee)
        keep = _worthwhile(i, j, e, m)
        left = np.ones(len(i), bool)
        left[keep] = False
        return cls[i[keep]], cls[j[keep]], e[keep], np.unique(np.concatenate([*crowded, i[left], j[left]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        begun = 0
        names = ["t", "k1", "k2", "k3", "cls", "n", "sketch"]
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("est", pa.float64()), ("t", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("k3", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

        def ends(rows: pa.Table, kind: int = 1) -> pa.RecordBatch:
            m = rows.num_rows
            nul = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), nul, nul, pa.nulls(m, pa.float64()), *[rows.column(c).combine_chunks() for c in names]], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rows = pa.concat_tables([tail, new]) if tail is not None else new
            if edges and begun < WINDOW:
                # The first rows of a partition may come in several batches.
                yield ends(new.select(names).slice(0, WINDOW - begun))
                begun += new.num_rows
            t = rows.column("t").to_numpy().astype(np.int64)
            k = [rows.column(c).to_numpy() for c in ("k1", "k2", "k3")]
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, SKETCH)
            a, b, e, crowded = pairs(t, k, rows.column("cls").to_numpy(), rows.column("n").to_numpy(), sketch, tail.num_rows if tail is not None else 0)
            if len(a):
                m = len(a)
                nul = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(e), pa.nulls(m, pa.int32()), nul, nul, nul, nul, nul, pa.nulls(m, pa.binary())], schema=schema
                )
            if len(crowded):
                yield ends(rows.select(names).take(pa.array(crowded)), 2)
            tail = rows.slice(max(0, rows.num_rows - WINDOW))
        if tail is not None and edges:
            yield ends(tail.select(names))

    return run


def _worthwhile(i: np.ndarray, j: np.ndarray, e: np.ndarray, m: int) -> np.ndarray:
    """Pairs to hand on: each row's two best, and a maximum spanning forest of all of them."""
    order = np.argsort(-e, kind="stable")
    keep = np.zeros(len(i), bool)
    seen = np.zeros(m, np.int8)
    up = list(range(m))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for p, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            keep[p] = True
        elif seen[a] < 2 or seen[b] < 2:
            keep[p] = True
        if keep[p]:
            seen[a] = min(seen[a] + 1, 100)
            seen[b] = min(seen[b] + 1, 100)
    return np.flatnonzero(keep)


def _across(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between different components of one tile pair of a crowded region: a spanning forest of them."""
    similarity = percent / 100
    least = similarity - SKETCH_SLACK

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cls", kind="stable")
        cls, guest, outside = (rows[c].to_numpy() for c in ("cls", "guest", "outside"))
        n = np.array([len(x) // 8 for x in rows["set"]], np.int64)
        comp = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), SKETCH)
        # Shingles as numbers of this group, so that one flag for each tells what a row shares with others.
        bound = np.concatenate([[0], np.cumsum(n)])
        known, ids = np.unique(np.frombuffer(b"".join(rows["set"]), np.uint64), return_inverse=True)
        own = np.zeros(len(known), bool)
        home = np.flatnonzero(~guest)
        a, b = [], []
        for k in np.flatnonzero(guest).tolist():
            # Two outside rows meet twice, as guest and host: the one of the larger id is the guest that counts.
            j = home[(comp[home] != comp[k]) & (~outside[home] | (cls[home] < cls[k]))]
            j = j[np.minimum(n[j], n[k]) >= similarity * np.maximum(n[j], n[k]) - 1e-9]
            j = j[(sketch[j] == sketch[k]).mean(1) >= least]
            if not len(j):
                continue
            own[ids[bound[k] : bound[k + 1]]] = True
            shared = own[np.concatenate([ids[bound[x] : bound[x + 1]] for x in j.tolist()])]
            inter = np.add.reduceat(shared.astype(np.int64), np.concatenate([[0], np.cumsum(n[j])[:-1]]))
            own[ids[bound[k] : bound[k + 1]]] = False
            for x in j[100 * inter >= percent * (n[j] + n[k] - inter)].tolist():
                if comp[x] != comp[k]:
                    a.append(min(cls[x], cls[k]))
                    b.append(max(cls[x], cls[k]))
                    comp[comp == comp[x]] = comp[k]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _crossing_links(crowd: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``a, b``: links between components in crowded regions; None where every region is one component."""
    region = ["t", "k1", "k2"]
    rows = saved(crowd.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component"), "crowd")
    parts = rows.groupBy(*region, "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    whole = parts.groupBy(*region).agg(F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "w", "comp")).alias("main"), F.count("*").alias("comps"))
    split = whole.filter("comps > 1").select(
        *region, F.col("main.comp").alias("main"),
        _tiles(F.col("m"), F.col("w")).alias("tiles"), _tiles(F.col("m") - F.col("main.m"), F.col("w") - F.col("main.w")).alias("others"),
    )
    split = saved(split, "regions")
    if split.isEmpty():
        return None
    work = rows.join(split, region).withColumn("outside", F.col("comp") != F.col("main"))
    tile = lambda seed, of: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = [*region, "i", "j", "guest", "outside", "cls", "comp", "n", "sketch"]
    hosts = work.withColumns({"guest": F.lit(False), "i": tile(1, "tiles")}).withColumn("j", every("others")).select(columns)
    guests = work.filter("outside").withColumns({"guest": F.lit(True), "j": tile(2, "others")}).withColumn("i", every("tiles")).select(columns)
    full = hosts.unionByName(guests).join(sets.withColumnRenamed("id", "cls"), "cls")
    # Dealt by tile pair: by the region alone, all tiles of a large one would meet in one task.
    key = [*region, "i", "j"]
    return saved(full.repartition(*key).groupBy(*key).applyInPandas(_across(percent), "a long, b long"), "links")


def _tiles(rows: Column, shingles: Column) -> Column:
    """Tiles of bounded rows and bounded shingles."""
    return F.greatest(F.lit(1), F.ceil(rows / TILE), F.ceil(shingles / TILE_SHINGLES)).cast("int")


def _confirmer(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            ok = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sa = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    sb = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.select("a", "b").join(sa, "a").join(sb, "b")
    return joined.mapInArrow(_confirmer(percent), "a long, b long")


def _judged(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n, component_id, first``: first marks the rows of the least id and text of their component."""
    similarity = percent / 100
    text = F.col(text_col).cast("string")
    base = slim(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marked = saved(base.mapInArrow(_sketcher("doc_id", "text", size), "doc_id long, text_hash long, n long, f1 long, f2 long, sig binary"), "sketch")
    # A class has its own number: ids may repeat with different texts.
    classes = saved(
        marked.filter("n > 0 and doc_id is not null").groupBy("f1", "f2")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "classes",
    )
    planted = classes.select("cls", "n", "sig").mapInArrow(_plant, PLANTED)
    order = ["t", "k1", "k2", "k3", "cls"]
    found = saved(planted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(similarity, True), FOUND), "found")
    # One task: its rows are bounded by the partitions of the scan.
    seams = found.filter("kind = 1").drop("kind", "a", "b", "est").dropDuplicates(["t", "cls"]).repartition(1).sortWithinPartitions(*order)
    seams = saved(seams.mapInArrow(_scan(similarity, False), FOUND), "seams")
    pairs = saved(
        found.filter("kind = 0").select("a", "b", "est").union(seams.filter("kind = 0").select("a", "b", "est"))
        .groupBy("a", "b").agg(F.max("est").alias("est")),
        "pairs",
    )
    region = ["t", "k1", F.shiftright("k2", 31).alias("k2"), "cls", "n", "sketch"]
    crowd = saved(found.filter("kind = 2").select(*region).union(seams.filter("kind = 2").select(*region)).dropDuplicates(["t", "cls"]), "crowded")
    discard(found)
    discard(seams)

    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(crowd.select("cls")).distinct()
    ends = ends.join(classes.select("cls", "rep.doc_id", "rep.text_hash"), "cls")
    wanted = base.filter("doc_id is not null").join(ends.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("cls", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in text_sets(batch, "text", size):
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "set"])

    sets = wanted.mapInArrow(sets_of, "id long, set binary")
    # Rows that repeat an id and its text are one class.
    sets = saved(sets.groupBy("id").agg(F.first("set").alias("set")) if _repeats(marked) else sets, "sets")

    sides = pairs.select(F.col("a").alias("x"), "a", "b", "est").union(pairs.select(F.col("b").alias("x"), "a", "b", "est"))
    best = sides.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("est"), "a", "b"))).filter("r <= 2")
    best = best.select("a", "b").distinct()
    links = saved(_confirmed(best, sets, percent), "links")
    comp = connected_components(links)
    ca = comp.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
    rest = rest.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = saved(rest, "rest")
    more = saved(_confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        comp = connected_components(links)
    crossing = _crossing_links(crowd, comp, sets, percent)
    if crossing is not None and not crossing.isEmpty():
        comp = connected_components(links.union(crossing))
    named = classes.select("f1", "f2", "cls", "rep").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    named = saved(named.select("f1", "f2", "rep", F.coalesce("component", "cls").alias("comp")), "named")
    for done in (pairs, crowd, sets, links, rest, more, classes):
        discard(done)
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    named = named.join(least, "comp").select("f1", "f2", "least")
    out = marked.select("doc_id", "text_hash", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    first = ~linked | ((F.col("least.doc_id") == F.col("doc_id")) & (F.col("least.text_hash") == F.col("text_hash")))
    return out.select("doc_id", "text_hash", "n", component.alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their shingle sets. Null and
    wordless texts have empty sets and link with nothing. A text with fewer words than a
    shingle is one shingle. Rows with a null id count as copies of nothing (component null,
    kept true). Rows that repeat an id are documents of their own: each is judged by its own text, and
    may lie in another component than the others. Other columns are not read.
    """
    out = _judged(docs, id_col, text_col, shingle, percent)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of near copies.

    The row of the least id stays; of rows that repeat it, that of the least hash of the text, and of rows
    equal in both, one. Rows with a null id and those without words are no copies and stay.
    """
    judged = saved(_judged(docs, id_col, text_col, shingle, percent), "judged")
    key = {"__id": F.col(id_col).cast("long"), "__text": F.xxhash64(F.col(text_col).cast("string"))}
    names = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")]
    rows = docs.withColumns(key)
    copies = judged.filter("not first").select(*names).distinct()
    rows = rows.join(copies.hint("shuffle_hash"), ["__id", "__text"], "left_anti")
    twice = judged.filter("first and n > 0 and doc_id is not null").groupBy(*names).count().filter("count > 1").drop("count")
    if _repeats(judged) and not (twice := saved(twice, "twice")).isEmpty():
        again = rows.join(twice, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"])
        rows = rows.join(twice, ["__id", "__text"], "left_anti").unionByName(again)
    return rows.select(*docs.columns)


def _repeats(marked: DataFrame) -> bool:
    x = marked.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    return x["n"] != x["d"]
