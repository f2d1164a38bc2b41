"""Graphs and corpora derived from the catalogue tables.

Each is one SELECT that Spark and other SQL engines read alike, so queries and their checks start
from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Entities of the catalogue as nodes. ``ord`` numbers them in table order.
NODES = """
    SELECT concat('region_', r_regionkey) AS id, r_name AS label, 'document' AS file_type, 'geo/regions.md' AS source_file,
           concat('L', r_regionkey + 1) AS source_location, CAST(NULL AS INT) AS community, CAST(r_regionkey AS BIGINT) AS ord FROM region
    UNION ALL SELECT concat('nation_', n_nationkey), n_name, 'code', concat('geo/nation/n', n_nationkey, '.go'), 'L1', n_nationkey,
           1000000000 + CAST(n_nationkey AS BIGINT) FROM nation
    UNION ALL SELECT concat('supplier_', s_suppkey), s_name, 'code', concat('src/supplier/n', s_nationkey, '.go'), concat('L', s_suppkey),
           s_nationkey, 2000000000 + CAST(s_suppkey AS BIGINT) FROM supplier
    UNION ALL SELECT concat('customer_', c_custkey), c_name, 'code', concat('app/customer/n', c_nationkey, '.py'), concat('L', c_custkey),
           c_nationkey, 3000000000 + CAST(c_custkey AS BIGINT) FROM customer
    UNION ALL SELECT concat('part_', p_partkey), concat(p_name, ' ', p_partkey), 'code', concat('lib/part/', lower(replace(p_brand, '#', '')), '.ts'),
           concat('L', p_partkey), p_size % 25, 4000000000 + CAST(p_partkey AS BIGINT) FROM part
"""

#: Parallel, contradicting and reversed relations between them, before any collapse.
RAW_EDGES = """
    SELECT concat('region_', n_regionkey) AS source, concat('nation_', n_nationkey) AS target, 'contains' AS relation, 'EXTRACTED' AS confidence,
           CAST(1.0 AS DOUBLE) AS score, 'L1' AS location, CAST(NULL AS STRING) AS context FROM nation
    UNION ALL SELECT concat('nation_', s_nationkey), concat('supplier_', s_suppkey), 'contains', 'EXTRACTED', CAST(1.0 AS DOUBLE), 'L1', NULL FROM supplier
    UNION ALL SELECT concat('nation_', c_nationkey), concat('customer_', c_custkey), 'contains', 'EXTRACTED', CAST(1.0 AS DOUBLE), 'L1', NULL FROM customer
    UNION ALL SELECT concat('supplier_', l_suppkey), concat('part_', l_partkey), CASE l_linestatus WHEN 'O' THEN 'calls' ELSE 'references' END,
           CASE l_returnflag WHEN 'R' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
           CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) / 8 END,
           CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('L', l_linenumber) END,
           CASE WHEN l_linenumber % 2 = 0 THEN 'field' END FROM lineitem
    UNION ALL SELECT concat('part_', l_partkey), concat('supplier_', l_suppkey), 'calls', 'INFERRED', CAST(0.75 AS DOUBLE), 'L9', NULL
           FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT concat('customer_', o_custkey), concat('part_', l_partkey), 'references',
           CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, CAST(0.5 AS DOUBLE), 'L2', NULL
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey
"""

#: One directed row for each related pair.
EDGES = f"""
    SELECT source, target, min(relation) AS relation, min(confidence) AS confidence
    FROM ({RAW_EDGES}) WHERE source NOT LIKE 'part%' GROUP BY source, target
"""

#: The same rows as EDGES, summed up by numbers before any id is spelled out: relations and confidences as their places
#: in alphabetical order, so the least number is the least string. No pair comes from two of the parts.
_EDGES_BY_NUMBER = """
    SELECT concat('region_', a) AS source, concat('nation_', b) AS target, 'contains' AS relation, 'EXTRACTED' AS confidence
           FROM (SELECT DISTINCT n_regionkey AS a, n_nationkey AS b FROM nation WHERE n_regionkey IS NOT NULL)
    UNION ALL SELECT concat('nation_', a), concat('supplier_', b), 'contains', 'EXTRACTED'
           FROM (SELECT DISTINCT s_nationkey AS a, s_suppkey AS b FROM supplier WHERE s_nationkey IS NOT NULL)
    UNION ALL SELECT concat('nation_', a), concat('customer_', b), 'contains', 'EXTRACTED'
           FROM (SELECT DISTINCT c_nationkey AS a, c_custkey AS b FROM customer WHERE c_nationkey IS NOT NULL)
    UNION ALL SELECT concat('supplier_', a), concat('part_', b), CASE r WHEN 0 THEN 'calls' ELSE 'references' END,
           CASE c WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'EXTRACTED' ELSE 'INFERRED' END
           FROM (SELECT l_suppkey AS a, l_partkey AS b, min(CASE l_linestatus WHEN 'O' THEN 0Y ELSE 1Y END) AS r,
                 min(CASE l_returnflag WHEN 'R' THEN 1Y WHEN 'N' THEN 2Y ELSE 0Y END) AS c FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey, l_partkey)
    UNION ALL SELECT concat('customer_', a), concat('part_', b), 'references',
           CASE c WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'EXTRACTED' ELSE 'INFERRED' END
           FROM (SELECT o_custkey AS a, l_partkey AS b, min(CASE o_orderstatus WHEN 'F' THEN 1Y WHEN 'O' THEN 2Y ELSE 0Y END) AS c
                 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL GROUP BY o_custkey, l_partkey)
"""

_KINDS = ("region_", "nation_", "supplier_", "customer_", "part_")


def _number(kind: str, key: str) -> str:
    """A node as one number: eight times its key, and its kind. A key that does not fit fails the query."""
    return f"CASE WHEN {key} BETWEEN -{1 << 60} AND {(1 << 60) - 1} OR {key} IS NULL THEN CAST({key} AS BIGINT) * 8 + {_KINDS.index(kind)} ELSE CAST(raise_error('key beyond 61 bits') AS BIGINT) END"


def spelled(number: Column) -> Column:
    """The id in NODES of a node of NUMBERED_NODES."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (number.bitwiseAND(F.lit(7)) + 1).cast("int"))
    return F.concat(kind, F.shiftright(number, 3).cast("string"))


#: Nodes by number, with their communities.
NUMBERED_NODES = f"""
    SELECT {_number("region_", "r_regionkey")} AS id, CAST(NULL AS INT) AS community FROM region
    UNION ALL SELECT {_number("nation_", "n_nationkey")}, n_nationkey FROM nation
    UNION ALL SELECT {_number("supplier_", "s_suppkey")}, s_nationkey FROM supplier
    UNION ALL SELECT {_number("customer_", "c_custkey")}, c_nationkey FROM customer
    UNION ALL SELECT {_number("part_", "p_partkey")}, p_size % 25 FROM part
"""

#: The rows of EDGES between nodes by number: a text is spelled where it is shown, not where rows are dealt, written and joined.
NUMBERED_EDGES = re.sub(r"concat\('(\w+_)', ([ab])\)", lambda m: _number(m[1], m[2]), _EDGES_BY_NUMBER)

#: What contains what: regions, nations, their suppliers and customers, a tree for each region.
FOREST_EDGES = f"SELECT * FROM ({EDGES}) WHERE relation = 'contains'"
#: The same as one tree: the first region holds the others. Its nodes are all that take part in it.
SMALL_EDGES = f"{FOREST_EDGES} UNION ALL SELECT 'region_0', concat('region_', r_regionkey), 'contains', 'EXTRACTED' FROM region WHERE r_regionkey > 0"
SMALL_NODES = f"SELECT * FROM ({NODES}) WHERE source_file NOT LIKE 'lib/%'"

#: What each user did next: a small directed graph with cycles.
EVENTS = """
    SELECT event_type AS source, next_type AS target, count(*) AS weight FROM (
        SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events
    ) WHERE next_type IS NOT NULL GROUP BY event_type, next_type
"""

#: Pages by host and the hosts and paths they link to.
LINKS = """
    SELECT concat('page_', page_id) AS source, concat('href_', h) AS target FROM (
        SELECT page_id, explode(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages
    )
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables of ``sf_dir``; only the tables it names are opened. EDGES are computed by their numbers."""
    sql = _EDGES_BY_NUMBER if sql == EDGES else sql.replace(f"({EDGES})", f"({_EDGES_BY_NUMBER})")
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)
