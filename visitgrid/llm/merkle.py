"""Merkle manifest of a dataset, by cogrouped subtree exchange.

Every row is a leaf. Per group (lang) the leaves ascend by id, and runs of ``FANOUT`` consecutive
nodes become one node until a single one, the subroot, remains; the subroots, ordered by group,
give the root in the same way. The tree is cut in superblocks of ``FANOUT ** DEPTH`` nodes. Going
up, each superblock is reduced to its top node, and the top nodes are the nodes of the next, far
smaller round. Going down, the nodes of a superblock are cogrouped with the one path that leads
from its top to the root: one call finishes the local reduction, joins the inner siblings with the
outer ones, and, for leaves, hashes the proof and folds the leaf up to a root again. No task holds
more than one superblock and one path, whatever the size of a group.

A path is text: per level ``place:siblings``, comma-joined, from the bottom to the root. Siblings are
hex digests one after another, the node's own place left out.

Defined cases: a null value is ``-`` in its leaf, an empty text ``0:``. Rows with equal ids are
ordered by their leaves, so equal rows are interchangeable. A null id comes first, its decimal form
is empty. Null groups are a group of their own, before all others. One row alone is the root, its
proof the hash of the empty text. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgrid.plans.ordered import materialize

FANOUT, DEPTH = 8, 4
BLOCK = FANOUT ** DEPTH
DIGEST = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """Hash of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    def part(v):
        s = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, leaf, tampered): the leaf of every row, and the one a forger would offer."""
    text = F.col("text")
    forged = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_digest(*head, text)
    return docs.select(F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("grp"), "doc_id",
                       leaf.alias("leaf"),
                       F.when(forged, leaf_digest(*head, F.translate(text, UPPER, LOWER))).otherwise(leaf).alias("tampered"))


def numbered(rows: DataFrame, order) -> DataFrame:
    """Adds ``idx``, the place from 0 in its ``grp``, and ``size``, the rows of the group.

    Rows are cut in global ranges of (grp, order) and written; a row's place is its place in its
    range plus the rows of its group in the ranges before.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cut = materialize(rows.repartitionByRange(n, "grp", *order).sortWithinPartitions("grp", *order)
                      .withColumn("__at", F.monotonically_increasing_id())
                      .withColumn("__part", F.spark_partition_id()))
    whole = Window.partitionBy("g")
    before = whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    cells = (cut.groupBy(F.col("grp").alias("g"), F.col("__part").alias("p"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
             .select("g", "p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                     F.sum("n").over(whole).alias("size")))
    return cut.join(cells, (F.col("grp") == F.col("g")) & (F.col("__part") == F.col("p"))).select(
        *rows.columns, (F.col("__at") - F.col("first") + F.col("offset")).alias("idx"), "size")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of one superblock, from its nodes up to its top; a group of one node stays."""
    levels, left = [nodes], size
    for _ in range(DEPTH):
        if left <= 1:
            break
        below = levels[-1]
        levels.append([digest("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])
        left = -(-left // FANOUT)
    return levels


def inner_path(levels: list[list[str]], at: int) -> list[str]:
    """``place:siblings`` of every level below the top, for the node at place ``at``."""
    out = []
    for level in levels[:-1]:
        place = at % FANOUT
        run = level[at - place:at - place + FANOUT]
        out.append(f"{place}:{''.join(run[:place] + run[place + 1:])}")
        at //= FANOUT
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and a path give."""
    for step in path:
        place, _, siblings = step.partition(":")
        cut = int(place) * DIGEST
        node = digest(siblings[:cut] + node + siblings[cut:])
    return node


def tops(nodes: DataFrame) -> DataFrame:
    """The top nodes (grp, idx, size, node) of all superblocks of (grp, idx, size, node)."""
    def top(pdf):
        pdf = pdf.sort_values("idx")
        levels = reduced(pdf["node"].tolist(), int(pdf["size"].iloc[0]))
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "idx": pdf["idx"].iloc[:1] // BLOCK,
                             "size": -(-pdf["size"].iloc[:1] // BLOCK), "node": levels[-1][:1]})

    block = F.floor(F.col("idx") / BLOCK).alias("block")
    return nodes.groupBy("grp", block).applyInPandas(top, "grp string, idx long, size long, node string")


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """All rounds of nodes, from the given ones to those where every group is one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(materialize(tops(rounds[-1])))
    return rounds


def paths(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(grp, idx, path, subroot, root) of every node, from the paths of the tops of their superblocks."""
    def join(left, right):
        left = left.sort_values("idx")
        levels = reduced(left["node"].tolist(), int(left["size"].iloc[0]))
        above = right["path"].iloc[0]
        steps = [",".join([*inner_path(levels, i), *([above] if above else [])]) for i in range(len(left))]
        return pd.DataFrame({"grp": left["grp"], "idx": left["idx"], "path": steps,
                             "subroot": right["subroot"].iloc[0], "root": right["root"].iloc[0]})

    block = F.floor(F.col("idx") / BLOCK).alias("block")
    return (nodes.groupBy("grp", block).cogroup(outer.groupBy("grp", F.col("idx").alias("block")))
            .applyInPandas(join, "grp string, idx long, path string, subroot string, root string"))


def descended(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The paths of the tops of the lowest round, from those of the highest round's nodes."""
    for nodes in reversed(rounds[1:-1]):
        outer = materialize(paths(nodes, outer))
    return outer


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(numbered(materialize(leaves(docs)), ["doc_id", "leaf", "tampered"]))
    rounds = climbed(rows.select("grp", "idx", "size", F.col("leaf").alias("node")))

    # the subroots are the leaves of the tree above; its one group is the whole dataset
    subroots = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node"))
    upper = materialize(numbered(subroots, ["name"]))
    above = climbed(upper.select("grp", "idx", "size", "node"))
    root = above[-1].select("grp", "idx", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    named = upper.select(F.col("idx").alias("at"), F.col("name"), F.col("node"))
    reached = paths(above[0], descended(above, root)) if len(above) > 1 else root
    outer = materialize(reached.join(named, F.col("idx") == F.col("at")).select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", F.col("node").alias("subroot"), "root"))
    outer = descended(rounds, outer)

    def finish(left, right):
        left = left.sort_values("idx")
        levels = reduced(left["leaf"].tolist(), int(left["size"].iloc[0]))
        above = right["path"].iloc[0]
        known = above.split(",") if above else []
        proofs, roots = [], []
        for i, leaf in enumerate(left["tampered"]):
            path = inner_path(levels, i) + known
            proofs.append(digest("".join(step.partition(":")[2] for step in path)))
            roots.append(folded(leaf, path))
        root = right["root"].iloc[0]
        return pd.DataFrame({"doc_id": left["doc_id"], "leaf": left["leaf"], "subroot": right["subroot"].iloc[0],
                             "root": root, "proof_sha256": proofs, "folded_root": roots,
                             "verified": [r == root for r in roots]})

    block = F.floor(F.col("idx") / BLOCK).alias("block")
    # ids travel as text, so that pandas never turns a nullable number into a float
    ready = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    done = (ready.groupBy("grp", block).cogroup(outer.groupBy("grp", F.col("idx").alias("block"))).applyInPandas(
        finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"))
    return done.withColumn("doc_id", F.col("doc_id").cast(kind))


def _sql(levels: int = 8, upper: int = 3) -> str:
    """The same in SQL, for up to FANOUT ** levels leaves per group and FANOUT ** upper groups."""
    def part(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END"

    def hashed(text):
        cols = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"({part(c)})" for c in cols) + ")"

    bit = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    chars = "list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda c, b: {bit}), 4294967295)"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [f"""d AS (SELECT *, {hashed('text')} AS leaf, {hashed(lowered)} AS lower_leaf,
      coalesce('+' || lang, '') AS g, coalesce(doc_id::VARCHAR, '') AS s FROM documents)""",
             f"e AS (SELECT *, CASE WHEN ({crc}) % 3 = 0 THEN lower_leaf ELSE leaf END AS tampered FROM d)",
             """f0 AS (SELECT doc_id, g, leaf, tampered AS h, '' AS proof,
      row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS i FROM e)""",
             "p0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS m FROM f0)"]

    def climb(k, nodes, fold, after, key):
        parts.append(f"""{nodes}{k + 1} AS (SELECT {key}, i, h, count(*) OVER (PARTITION BY {key}) AS m FROM (
      SELECT {key}, i // 8 AS i, CASE WHEN max(m) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
      FROM {nodes}{k} GROUP BY {key}, i // 8))""")
        parts.append(f"""{nodes}s{k} AS (SELECT a.{key}, a.i, a.m, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS pre,
      coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS post
      FROM {nodes}{k} a JOIN {nodes}{k} b ON a.{key} = b.{key} AND a.i // 8 = b.i // 8 GROUP BY a.{key}, a.i, a.m)""")
        parts.append(f"""{fold}{k + 1} AS (SELECT f.doc_id, f.g, f.leaf, f.i // 8 AS i{after}, f.proof || s.pre || s.post AS proof,
      CASE WHEN s.m = 1 THEN f.h ELSE sha256(s.pre || f.h || s.post) END AS h
      FROM {fold}{k} f JOIN {nodes}s{k} s ON f.{key} = s.{key} AND f.i = s.i)""")

    for k in range(levels):
        climb(k, "p", "f", "", "g")
    parts.append(f"q0 AS (SELECT 1 AS u, row_number() OVER (ORDER BY g) - 1 AS i, g AS name, h, count(*) OVER () AS m FROM p{levels})")
    parts.append(f"""r0 AS (SELECT f.doc_id, f.g, f.leaf, q.i, 1 AS u, q.h AS subroot, f.proof, f.h
      FROM f{levels} f JOIN q0 q ON f.g = q.name)""")
    for k in range(upper):
        climb(k, "q", "r", ", f.u, f.subroot", "u")
    return "WITH " + ",\n".join(parts) + f"""
      SELECT r.doc_id, r.leaf, r.subroot, q.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root,
             r.h = q.h AS verified FROM r{upper} r, q{upper} q"""


SQL = _sql()
