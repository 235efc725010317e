"""Base tables and carrier views that give them the shapes of the data model.

The carrier text is plain SQL understood by Spark and by the oracle engine.
Keys stay natural (order, part, customer, supplier), so every view grows with the data.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from tidepair.plans.session import ship_package

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

VIEWS = {
    # transport edges: group, suffixed source cell, target cell, probability, input order
    "edges": """
        SELECT concat(l_returnflag, '|', l_linestatus) AS grp,
               concat('S', CAST(l_suppkey AS STRING), '_', CAST(l_linenumber % 2 AS STRING)) AS source_cell,
               concat('T', CAST(l_partkey AS STRING)) AS target_cell,
               sum(l_quantity) / CAST(1024 AS DOUBLE) AS probability,
               min((l_suppkey * 100000000 + l_partkey) * 2 + l_linenumber % 2) AS ord
        FROM {lineitem} GROUP BY 1, 2, 3""",
    # sizes of the two cell tables of each group
    "edge_sizes": """
        SELECT concat(l_returnflag, '|', l_linestatus) AS grp,
               2 * count(DISTINCT l_suppkey) AS n_source,
               count(DISTINCT l_partkey) + count(DISTINCT l_linenumber) AS n_target
        FROM {lineitem} GROUP BY 1""",
    # one order = one cell; patient = customer, study = nation, dataset = segment
    "cells": """
        SELECT concat('C', CAST(o_orderkey AS STRING)) AS cell_id, o_orderkey AS ord, o_custkey AS patient_id,
               c_nationkey AS study, c_mktsegment AS dataset_id, o_orderpriority AS label,
               CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'source' ELSE 'target' END AS role
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # sparse counts, gene = part
    "expr": """
        SELECT concat('C', CAST(l_orderkey AS STRING)) AS cell_id, l_partkey AS gene_index,
               concat('G', CAST(l_partkey AS STRING)) AS gene_id, sum(l_quantity) AS value
        FROM {lineitem} GROUP BY 1, 2, 3""",
    # ordered gene panel
    "genes": """
        SELECT p_partkey AS gene_index, concat('G', CAST(p_partkey AS STRING)) AS gene_id,
               upper(concat(p_name, '-', CAST(p_partkey AS STRING))) AS gene_symbol, p_brand AS brand, p_size
        FROM {part}""",
    # a pair = an order and the next order
    "pairs": """
        SELECT a.o_orderkey AS ord, concat('P', CAST(a.o_orderkey AS STRING)) AS pair_id,
               a.o_custkey AS patient_id, c_mktsegment AS dataset_id, c_nationkey AS study,
               concat('C', CAST(a.o_orderkey AS STRING)) AS source_cell,
               concat('C', CAST(b.o_orderkey AS STRING)) AS target_cell,
               a.o_orderpriority AS source_label, b.o_orderpriority AS target_label,
               a.o_totalprice / CAST(500000 AS DOUBLE) AS probability
        FROM {orders} a JOIN {orders} b ON b.o_orderkey = a.o_orderkey + 1
        JOIN {customer} ON a.o_custkey = c_custkey""",
    # pre/post means per replicate (nation) and gene (part); 0 where a side is absent
    "replicates": """
        SELECT c_nationkey AS replicate_id, concat('G', CAST(l_partkey AS STRING)) AS gene_id,
               coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) / CAST(10 AS DOUBLE) AS source_mean,
               coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) / CAST(10 AS DOUBLE) AS target_mean,
               count(*) AS n_pairs
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        GROUP BY 1, 2""",
    # one score per document with two binary labels
    "scores": """
        SELECT d.doc_id AS id, d.source AS cohort, d.lang AS layer, CAST(d.n_chars AS DOUBLE) AS score,
               l.quality AS label, l.toxic AS label2
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # one order line = one subject; feature = return reason, stratum = ship status
    "survival": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS stratum, l_returnflag AS feature,
               l_quantity AS time_days, CASE WHEN l_tax > 0.03 THEN 1 ELSE 0 END AS event,
               l_discount + l_tax AS value
        FROM {lineitem}""",
    # gene sets: every part belongs to the set of its brand and the set of its type
    "gene_sets": """
        SELECT concat('SET_', p_brand) AS set_name, concat('G', CAST(p_partkey AS STRING)) AS gene_id FROM {part}
        UNION
        SELECT concat('SET_', p_type) AS set_name, concat('G', CAST(p_partkey AS STRING)) AS gene_id FROM {part}""",
    # genes ranked by a change score
    "ranked": """
        SELECT concat('G', CAST(l_partkey AS STRING)) AS gene_id,
               round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END)
                     / CAST(100 AS DOUBLE) + CAST(l_partkey AS DOUBLE) / 1000000007.0, 9) AS score
        FROM {lineitem} GROUP BY l_partkey""",
    # training log: run = user, arm = event type
    "runs": """
        SELECT user_id AS run_id, event_type AS arm, event_id AS epoch, value AS loss,
               user_id % 5 AS fold, CAST(user_id / 5 AS INT) AS config
        FROM {events}""",
    # a spatial sample = label, spot = vector, x and y = first two elements
    "spots": """
        SELECT label AS sample_id, vec_id AS spot_id, CAST(embedding[{one}] AS DOUBLE) AS x,
               CAST(embedding[{two}] AS DOUBLE) AS y, CAST(embedding[{three}] AS DOUBLE) AS value,
               CAST(embedding[{four}] AS DOUBLE) AS value2,
               CASE WHEN embedding[{five}] > 0 THEN 'tumor' ELSE 'stroma' END AS segment_type
        FROM {embeddings}""",
}
_SPARK_INDEX = {"one": 0, "two": 1, "three": 2, "four": 3, "five": 4}
_ORACLE_INDEX = {k: v + 1 for k, v in _SPARK_INDEX.items()}


class Tables:
    """tables('edges') gives a base table or carrier view of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}
        ship_package(spark)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in BASE:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                needs = {n: self(n) for n in re.findall(r"\{(\w+)\}", text) if n not in _SPARK_INDEX}
                for k, v in _SPARK_INDEX.items():
                    text = text.replace("{" + k + "}", str(v))
                self.made[name] = self.spark.sql(text, **needs)
        return self.made[name]


def oracle(body: str) -> str:
    """Prefix a SQL body with the carrier views it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    ctes = []
    for n in used:
        names = {m: m for m in BASE}
        ctes.append(f"{n} AS ({VIEWS[n].format(**names, **_ORACLE_INDEX)})")
    body = body.strip()
    rest = ", " + body[4:].lstrip() if body[:5].upper() == "WITH " or body[:5].upper() == "WITH\n" else " " + body
    return "WITH " + ",\n".join(ctes) + rest


REGISTRY: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a (tables) -> DataFrame function under its name, with its SQL twin."""

    def add(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError("registered twice: " + key)
        REGISTRY[key] = fn
        if sql is not None:
            ORACLES[key] = oracle(sql)
        return fn

    return add
