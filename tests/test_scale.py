"""Steps whose work must grow with the input and no faster, and whose results must not depend on its size."""

from __future__ import annotations

import ast
import math
import random

import pytest
from pyspark.sql import functions as F

from graphlake.functions import similarity, text
from graphlake.operators import analyze, blocks, cluster, entities, merge, resolve, search
from graphlake.plans import fixtures
from graphlake.queries import QUERIES
from graphlake.sources.code import _Walk


def test_functions_find_their_class_without_a_scan_of_all_rows():
    class Unread(list):
        def __iter__(self):
            raise AssertionError("rows were scanned")

    walk = _Walk("a.py")
    walk.rows = Unread()
    walk.visit(ast.parse("class A:\n    def f(self):\n        def g(): pass\ndef h():\n    class B:\n        def k(self): pass\n"))
    assert [walk.rows[k][1:4] for k in range(6)] == [
        ("class", "A", None), ("method", "f", "A"), ("function", "g", "A.f"), ("function", "h", None), ("class", "B", "h"), ("method", "k", "h.B"),
    ]


def test_edges_by_numbers_are_the_edges_of_the_sql(spark, tmp_path):
    for table, sql in {
        "part": "SELECT 1 AS p_partkey", "region": "SELECT 0 AS r_regionkey",
        "nation": "SELECT * FROM VALUES (0, 1), (0, 1), (1, NULL), (NULL, 2) AS t(n_regionkey, n_nationkey)",
        "supplier": "SELECT * FROM VALUES (1, 5), (1, 5), (NULL, 6), (2, NULL) AS t(s_nationkey, s_suppkey)",
        "customer": "SELECT * FROM VALUES (1, 5), (2, 5) AS t(c_nationkey, c_custkey)",
        "orders": "SELECT * FROM VALUES (1, 5, 'F'), (2, 5, 'P'), (3, NULL, 'O'), (4, 6, NULL) AS t(o_orderkey, o_custkey, o_orderstatus)",
        "lineitem": "SELECT * FROM VALUES (1, 5, 7, 'O', 'R', 1), (1, 5, 7, 'F', 'N', 2), (2, 5, 7, 'F', 'A', 1), (2, NULL, 8, 'O', 'N', 1), (3, 5, NULL, 'F', NULL, 3), (4, 6, NULL, NULL, 'R', 1), (9, 6, 9, 'O', 'N', 4) AS t(l_orderkey, l_suppkey, l_partkey, l_linestatus, l_returnflag, l_linenumber)",
    }.items():
        spark.sql(sql).write.parquet(f"file://{tmp_path}/{table}.parquet")
    for place in (f"file://{tmp_path}", "/root/testdata/sf0.001"):
        # With a blank at its end the SELECT is not known and stands as it is.
        got, want = fixtures.frame(spark, place, fixtures.EDGES), fixtures.frame(spark, place, fixtures.EDGES + " ")
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()


def test_hub_suppression_reads_each_level_and_edges_without_sums_of_all_pairs(spark):
    n = spark.createDataFrame([(f"n{i}", "") for i in range(120)], "id string, source_file string")
    pairs = [("n0", f"n{i}") for i in range(1, 90)] + [("n90", "n0"), ("n90", "n91"), ("n91", "n92"), ("n92", "n91"), ("n92", "n92")]
    e = spark.createDataFrame(pairs, "source string, target string")
    got = {r.id: r.hop for r in search.expand_bfs(n, e, ["n90"], 3, hubs=False).collect()}
    assert got == {"n90": 0, "n0": 1, "n91": 1, "n92": 2}
    assert "Join" not in search._ends(e)._jdf.queryExecution().toString() and "Aggregate" not in search._ends(e)._jdf.queryExecution().toString()


def test_calls_across_repositories_meet_sums_of_types(spark):
    parked = spark.createDataFrame([("c1", "r0", "f", "T"), ("c2", "r1", "f", "T"), ("c3", "r2", "f", "T"), ("c4", "r0", "f", "U"), ("c5", None, "f", "U")], "caller_id string, repo string, callee string, type_name string")
    types = spark.createDataFrame([("t0", "T", "r0"), ("t1", "T", "r1"), ("t1", "T", "r1"), ("u1", "U", "r1"), ("u2", "U", "r1")], "id string, label string, repo string")
    methods = spark.createDataFrame([("t0", "f", "m0"), ("t1", "f", "m1"), ("u1", "f", "m2")], "type_id string, name string, id string")
    found = merge.cross_repo_calls(parked, types, methods)
    assert {(r.source, r.target) for r in found.collect()} == {("c1", "m1"), ("c2", "m0")}
    # Below the join with calls, types are one row for each name and repository.
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if "Aggregate [label" in line and "repo" in line)
    assert any("Join" in line and "type_name" in line for line in plan[:at])


def brute_betweenness(ids, pairs, sources):
    """Sums over sources of the shares of shortest paths through each node and pair, by counting paths."""
    near = {i: set() for i in ids}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def search(s):
        far, ways, todo = {s: 0}, {s: 1}, [s]
        for v in todo:
            for w in near[v]:
                if w not in far:
                    far[w], ways[w] = far[v] + 1, 0
                    todo.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
        return far, ways

    found = {i: search(i) for i in ids}
    node, edge = {i: 0.0 for i in ids}, {tuple(sorted((a, b))): 0.0 for a in ids for b in near[a]}
    for s in sources:
        far, ways = found[s]
        for t in far:
            back, there = found[t]
            for v in far:
                if v not in (s, t) and s != t and far[v] + back[v] == far[t]:
                    node[v] += ways[v] * there[v] / ways[t]
            for a in far:
                for b in near[a]:
                    if far[a] + 1 + back[b] == far[t]:
                        edge[tuple(sorted((a, b)))] += ways[a] * there[b] / ways[t]
    return node, edge


@pytest.mark.parametrize("bound", [16_000_000, 0])
@pytest.mark.parametrize("rounds", [64, 1])
def test_betweenness_of_cores_with_trees_is_that_of_all_paths(spark, monkeypatch, bound, rounds):
    monkeypatch.setattr(analyze, "BETWEENNESS_EDGES", bound)
    monkeypatch.setattr(analyze, "PEEL_ROUNDS", rounds)
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "f"), ("d", "e"), ("e", "f"), ("a", "g"), ("g", "h"), ("g", "i"), ("i", "j"), ("f", "k")]
    pairs += [("x", "y"), ("p", "q"), ("q", "r"), ("q", "s"), ("s", "t"), ("u", "u"), ("b", "a"), ("out", "k")]
    ids = sorted({i for p in pairs for i in p} | {"alone"})
    known = [i for i in ids if i != "out"]
    n, e = spark.createDataFrame([(i,) for i in known], "id string"), spark.createDataFrame(pairs, "source string, target string")
    node, edge = brute_betweenness(ids, pairs, known)
    k = len(known)
    got = {r.id: r.betweenness for r in analyze.node_betweenness(n, e, pivots=None, exact_upto=0).collect()}
    assert got == pytest.approx({i: node[i] / ((k - 1) * (k - 2)) for i in known})
    got = {(r.a, r.b): r.betweenness for r in analyze.edge_betweenness(n, e).collect()}
    assert got == pytest.approx({p: d / (k * (k - 1)) for p, d in edge.items()})
    if (bound, rounds) == (0, 64):
        return
    pivots = [r.id for r in n.orderBy(F.xxhash64("id"), "id").limit(4).collect()]
    node, _ = brute_betweenness(ids, pairs, pivots)
    got = {r.id: r.betweenness for r in analyze.node_betweenness(n, e, pivots=4, exact_upto=0).collect()}
    assert got == pytest.approx({i: node[i] * k / 4 / ((k - 1) * (k - 2)) for i in known})


def test_bridges_are_listed_whatever_the_number_of_nodes(spark):
    n = spark.range(5003).select(F.concat(F.lit("n"), "id").alias("id"))
    e = n.filter("id <> 'n0'").select(F.lit("n0").alias("source"), F.col("id").alias("target"))
    found = analyze.bridge_surprises(n, e, 3).collect()
    assert [(r.a, r.b) for r in found] == [("n0", "n1"), ("n0", "n10"), ("n0", "n100")] and found[0].betweenness == pytest.approx(2 / 5003)


@pytest.mark.parametrize("letters,longest", [("ab", 6), ("abcdé世\U0001f600", 20), ("abc\0", 70)])
def test_jaro_of_many_pairs_is_that_of_each(letters, longest):
    draw = random.Random(longest)
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(0, longest)))
    pairs = [(word(), word()) for _ in range(3000)] + [("martha", "marhta")] * 20 + [("same", "same")] * 20 + [("abcd", "wxyz")] * 20
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert similarity.jaro_many(a, b, False).tolist() == [similarity.jaro(x, y) for x, y in pairs]
    assert similarity.jaro_many(a, b, True).tolist() == [similarity.jaro_winkler(x, y) for x, y in pairs]


def test_label_similarity_compares_in_columns(spark, monkeypatch):
    rows = spark.createDataFrame([("abc", "abd"), (None, "x"), ("x", None)], "a string, b string")
    got = rows.select("a", similarity.jaro_similarity("a", "b").alias("j"), similarity.jaro_winkler_similarity("a", "b").alias("w")).collect()
    assert [(r.j, r.w) for r in got] == [(similarity.jaro("abc", "abd"), similarity.jaro_winkler("abc", "abd")), (None, None), (None, None)]


def test_entropy_is_that_of_counts_and_leaves_lambdas_out(spark):
    texts = ["", "a", "ab", "aab", "abcd" * 4, "é世\U0001f600x" * 5, "the quick brown fox " * 9, None]
    f = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.entropy(F.col("t")).alias("h"))
    for r in f.collect():
        want = None if r.t is None else -sum(r.t.count(c) / len(r.t) * math.log2(r.t.count(c) / len(r.t)) for c in set(r.t)) if r.t else 0.0
        assert r.h == (want if want is None else pytest.approx(want))
    assert "lambda" not in f._jdf.queryExecution().toString()


def test_classes_of_bands_hold_every_pair_and_no_other(spark):
    draw = random.Random(3)
    rows = [(f"d{k}", [draw.randint(0, 1) for _ in range(126)]) for k in range(40)]
    rows += [(f"n{k}", [v if i % 9 else 1 for i, v in enumerate(rows[0][1])][: 9 * (k % 14)] + [7 + k] * (126 - 9 * (k % 14))) for k in range(30)]
    f = spark.createDataFrame(rows, "id string, s array<long>")
    want = {(r.a, r.b) for r in similarity.lsh_pairs(f, "id", "s").collect()}
    held = {}
    for r in similarity.lsh_classes(f, "id", "s").collect():
        held.setdefault((r.band, r.class_id), []).append((r.id, r.size))
    assert all(len(x) == x[0][1] and min(i for i, _ in x) == c for (_, c), x in held.items())
    assert {(a, b) for x in held.values() for a, _ in x for b, _ in x if a < b} == want and want


@pytest.mark.parametrize("name", ["resolve_calls", "indirect_calls"])
def test_calls_are_numbered_without_a_window_over_all_rows(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Window" not in plan


def test_go_imports_are_gathered_for_each_source(spark):
    imports = spark.createDataFrame([("f1", "p"), ("f1", "p"), ("f1", "q"), ("f2", "q"), ("f3", "none"), (None, "p")], "source string, import_path string")
    packages = spark.createDataFrame([("p", "f1"), ("p", "f2"), ("q", "f2"), ("q", "f2"), ("q", "f4"), ("q", None)], "import_path string, file_id string")
    have = spark.createDataFrame([("f1", "f4", "calls")], "source string, target string, relation string")
    found = resolve.go_import_fanout(imports, packages, have)
    assert sorted((r.source, r.target) for r in found.collect()) == [("f1", "f2"), ("f2", "f4")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source#" in plan and ", target#" not in "".join(x for x in plan.split("\n") if "Aggregate" in x)


def test_leiden_sends_numbers_of_nodes_and_agrees_with_joins(spark, monkeypatch):
    rng = random.Random(4)
    links = [(f"n{i}", f"n{j}") for i in range(40) for j in range(i) if i // 20 == j // 20 and rng.random() < (0.5 if i // 10 == j // 10 else 0.05)]
    links += [(b, a) for a, b in links[:9]] + [("n1", "n1"), ("n2", None)]
    e = spark.createDataFrame(links, "source string, target string")
    n = spark.createDataFrame([(f"n{i}",) for i in range(41)], "id string")
    grp = n.select("id", (F.substring("id", 2, 9).cast("int") / 20).cast("int").alias("grp"))
    hashes = spark.range(50).select("id", F.xxhash64("id", F.lit(3)).alias("h")).toPandas()
    assert (blocks.xxhash64(hashes["id"].to_numpy(), 3).astype("int64") == hashes["h"]).all()
    monkeypatch.setattr(blocks, "BLOCK_LINKS", 40)
    levels, contracted = [], blocks.contracted
    monkeypatch.setattr(blocks, "contracted", lambda *a: levels.append(1) or contracted(*a))
    for groups in (grp,):
        joined = {r.id: r.community for r in cluster.leiden(n, e, groups=groups, held_nodes=0).collect()}
        assert 3 < len(set(joined.values())) < 30 and len(joined) == 41
        # Without the moves by joins: rounds over blocks shuffle no links.
        with monkeypatch.context() as m:
            m.setattr(cluster, "_moved", None)
            assert {r.id: r.community for r in cluster.leiden(n, e, groups=groups).collect()} == joined
    # What was contracted is moved again in a second level.
    assert levels


def test_chunks_are_dealt_in_one_walk_without_contents(spark):
    from graphlake.sources import files

    rng = random.Random(2)
    rows = [(g, k, None if rng.random() < 0.05 else rng.randint(0, 2500), rng.random() < 0.1) for g in ("a", None) for k in range(60)]
    want, n, used, open_, last = {}, 0, 0, False, "-"
    for g, k, size, image in rows:
        if g != last:
            n, used, open_, last = 0, 0, False, g
        over = size is not None and used + size + 2000 > 9000
        n, used = (n + 1, 0) if open_ and (image or over) else (n, used)
        want[g, k] = n
        n, used, open_ = (n + 1, 0, False) if image else (n, used + (11000 if size is None else min(size + 2000, 11000)), True)
    f = spark.createDataFrame(rows, "source string, pos long, size long, image boolean")
    assert {(r.source, r.pos): r.chunk for r in files.chunk_files(f, 3000, ["source"]).collect()} == want
    # Each group's list is built by no fold that copies it, and texts are measured before rows are numbered.
    assert "aggregate(" not in files.chunk_files(f, 3000, ["source"])._jdf.queryExecution().toString()
    plan = QUERIES["chunk_budget"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("row_number") < plan.index("octet_length")


def test_communities_and_surprises_meet_edges_without_sorting_them(spark):
    plan = QUERIES["html_meta_graph"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    # Edges are derived in the plan, not read back from a table written before.
    assert "/cut-" not in plan.toString() and "lineitem" in plan.toString()
    for name in ("html_meta_graph", "report_surprises"):
        text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert text.count("ShuffledHashJoin") >= 2


def test_merged_graphs_look_up_each_end_once(spark):
    plan = QUERIES["merge_graph_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.split("\n")) == 4


def test_edges_of_questions_are_numbers_that_spell_the_ids(spark, tmp_path):
    for table, sql in {
        "part": "SELECT * FROM VALUES (-7, 30), (NULL, NULL), (1152921504606846975, -30) AS t(p_partkey, p_size)", "region": "SELECT 0 AS r_regionkey",
        "nation": "SELECT * FROM VALUES (0, 1), (0, NULL), (NULL, 2) AS t(n_regionkey, n_nationkey)",
        "supplier": "SELECT * FROM VALUES (1, 5), (1, 5), (NULL, 6), (2, NULL) AS t(s_nationkey, s_suppkey)",
        "customer": "SELECT * FROM VALUES (1, -5), (2, 5) AS t(c_nationkey, c_custkey)",
        "orders": "SELECT * FROM VALUES (1, -5, 'F'), (2, 5, 'P'), (3, NULL, 'O') AS t(o_orderkey, o_custkey, o_orderstatus)",
        "lineitem": "SELECT * FROM VALUES (1, 5, -7, 'O', 'R', 1), (1, 5, 1152921504606846975, 'F', 'N', 2), (2, 5, NULL, 'F', 'A', 1), (2, NULL, 8, 'O', 'N', 1) AS t(l_orderkey, l_suppkey, l_partkey, l_linestatus, l_returnflag, l_linenumber)",
    }.items():
        spark.sql(sql).write.parquet(f"file://{tmp_path}/{table}.parquet")
    spell = lambda c: fixtures.spelled(F.col(c)).alias(c)
    for place in (f"file://{tmp_path}", "/root/testdata/sf0.001"):
        want = fixtures.frame(spark, place, fixtures.EDGES)
        got = fixtures.frame(spark, place, fixtures.NUMBERED_EDGES)
        assert dict(got.dtypes)["source"] == dict(got.dtypes)["target"] == "bigint"
        got = got.select(spell("source"), spell("target"), "relation", "confidence")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()
    want, got = fixtures.frame(spark, place, fixtures.NODES).select("id", "community"), fixtures.frame(spark, place, fixtures.NUMBERED_NODES).select(spell("id"), "community")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    beyond = spark.range(1).select(F.lit(1 << 60).alias("k")).selectExpr(fixtures._number("part_", "k"))
    with pytest.raises(Exception, match="beyond 61 bits"):
        beyond.collect()


def test_cohesion_drops_parallel_edges_within_communities_only(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("e", 2), ("f", 3)], "id string, community int")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("a", "d"), ("c", "d"), ("d", "e"), ("a", "a"), ("x", "a"), ("f", None)], "source string, target string")
    found = cluster.cohesion(m, e)
    assert {r.community: (r.size, r.cohesion) for r in found.collect()} == {1: (3, pytest.approx(2 / 3)), 2: (3, pytest.approx(2 / 3)), 3: (1, 1.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, x in enumerate(plan) if "Aggregate [lo#" in x)
    assert sum("Join" in x for x in plan[at:]) == 2


def test_questions_sum_up_the_ends_of_edges_once(spark):
    n = spark.createDataFrame([(i,) for i in "abcdef"], "id string")
    e = spark.createDataFrame([("a", "b", "calls", "INFERRED"), ("a", "c", "calls", "INFERRED"), ("b", "c", "uses", "AMBIGUOUS"), ("d", "a", "uses", "EXTRACTED"), ("b", None, "uses", "INFERRED")], "source string, target string, relation string, confidence string")
    c = spark.createDataFrame([(1, 9, 0.1), (2, 4, 0.1), (3, 9, 0.2)], "community int, size long, cohesion double")
    b = spark.createDataFrame([("a", 0.5), ("d", 0.0)], "id string, betweenness double")
    found = analyze.questions(n, e, b, c, 100)
    assert [tuple(r) for r in found.collect()] == [(1, "b", "c"), (2, "a", "bridge"), (3, "a", "2"), (3, "b", "2"), (4, "d", "3"), (5, "1", "9")]
    # What is left to plan reads sums of nodes, without a join or a second sum of the edges.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_merges_seek_components_between_stars_only(spark, monkeypatch):
    words = ["payment gateway service", "payment gateway servce", "invoice ledger exporter", "report builder 12", "report builder 012", "report builder 13", "aa"]
    rows = [(f"n{k}", words[k % 7].upper(), "concept" if k % 3 else "image", f"f{k % 4}.md" if k % 5 else None, None, k) for k in range(60)]
    # One id stands in the stars of two forms and so joins them.
    rows += [("both", words[0], "concept", "f1.md", "L1", 70), ("both", words[2], "concept", "f1.md", "L1", 71), ("n_c1", words[2], "concept", "f2.md", "L1", 72), ("code", words[0], "code", "f1.md", None, 73)]
    for held in (rows, rows[:60]):
        n = spark.createDataFrame(held, "id string, label string, file_type string, source_file string, source_location string, ord long")
        exact = entities.exact_norm_merge(n).select("id", "winner")
        sent = []
        with monkeypatch.context() as m:
            m.setattr(entities, "connected_components", lambda e: sent.append(e.count()) or cluster.connected_components(e))
            got = sorted(tuple(r) for r in entities.merge_map(n).collect())
        # The same by components of all edges at once.
        edges = exact.toDF("source", "target").unionByName(entities.fuzzy_pairs(n).toDF("source", "target")).collect()
        root = {r[0]: r[0] for r in held}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        rank = lambda r: (r[0].endswith("_c1"), len(r[0]), r[5], r[0])
        best = {c: min((r for r in held if root[r[0]] == c), key=rank)[0] for c in root.values()}
        assert got == sorted((r[0], best[root[r[0]]]) for r in held if best[root[r[0]]] != r[0]) and len(got) > 20
        assert sent[0] < 12 < exact.count()


def test_fuzzy_pairs_of_other_numbers_never_meet(spark):
    n = spark.createDataFrame([(f"n{k}", f"quarterly report builder number {k}", "concept", "f.md", None, k) for k in range(60)] + [("z", "quarterly report builder number 007", "concept", "f.md", None, 99)], "id string, label string, file_type string, source_file string, source_location string, ord long")
    c = entities.fuzzy_candidates(n).withColumn("numbers", entities._same_numbers(F.col("norm")))
    held = c.collect()
    assert all((x.numbers == y.numbers) == (entities._numbers(x.norm) == entities._numbers(y.norm)) for x in held for y in held)
    every, few = similarity.lsh_pairs(c, "id", "signature").count(), similarity.lsh_pairs(c, "id", "signature", "numbers").count()
    assert few <= 1 < every
    pairs = [(a.norm, b.norm, k % 2 == 0) for k, a in enumerate(held) for b in held[:40]]
    got = entities.merges.func(*map(entities.pd.Series, zip(*pairs, strict=True)))
    assert got.tolist() == [entities.should_merge(*p) for p in pairs]
    # The entropy of a form is taken above the sum over its nodes, not below.
    plan = c._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, x in enumerate(plan) if "Aggregate [norm" in x)
    assert any("entropy(" in x for x in plan[:at]) and not any("entropy(" in x for x in plan[at:])
