"""Merkle manifest of a table: one tree for each group, one over the groups' roots, proofs for every row."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from lurelake.llm.common import numbered, saved

#: Consecutive nodes that become one.
FAN_OUT = 8
#: Hex digits of a hash.
DIGITS = 64


def encoded(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """One level up: (tree, place, size, hash, run), ``run`` the hashes of the children, joined.

    The rows of slot zero ask for their siblings by computed places, XOR in a binary tree and slot offsets
    otherwise; an equi-join on (tree, place) answers, and the rows of slot zero emit the parents.
    """
    place = F.col("place")
    zero = nodes.where((place % fan_out == 0) & (F.col("size") > 1))
    if fan_out == 2:
        siblings = F.array(place.bitwiseXOR(F.lit(1).cast("long")))
    else:
        siblings = F.sequence(place + 1, place + fan_out - 1)
    asked = zero.select("tree", place.alias("first"), F.explode(
        F.filter(siblings, lambda s: s < F.col("size"))).alias("place"))
    answered = asked.join(nodes.select("tree", "place", "hash"), ["tree", "place"])
    runs = zero.select("tree", place.alias("first"), place, "hash", "size").unionByName(
        answered.select("tree", "first", "place", "hash", F.lit(None).cast("long").alias("size")))
    runs = runs.groupBy("tree", "first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda s: s["hash"]), "").alias("run"),
        F.max("size").alias("size"))
    return runs.select("tree", F.floor(F.col("first") / fan_out).cast("long").alias("place"),
                       F.ceil(F.col("size") / fan_out).cast("long").alias("size"), digest(F.col("run")).alias("hash"), "run")


def _grown(leaves: DataFrame, fan_out: int, name: str) -> list[DataFrame]:
    """The levels above the leaves, each a written table, up to that on which every tree has one node."""
    levels, size = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while size > 1:
        levels.append(saved(_parents(levels[-1].select("tree", "place", "size", "hash"), fan_out), name))
        size = -(-size // fan_out)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of the last node of each tree, on whatever level that is."""
    tops = [level.where("size = 1").select("tree", "hash") for level in levels]
    found = tops[0]
    for top in tops[1:]:
        found = found.union(top)
    return found


#: A path upwards: for each level the hashes left and right of the node, joined.
PATH = "array<struct<left:string,right:string>>"


def _step(run: Column, place: Column, fan_out: int) -> Column:
    """What stands left and right of a node in the run it belongs to."""
    at = ((place % fan_out) * DIGITS).cast("int")
    return F.struct(F.substring(run, F.lit(1), at).alias("left"),
                    F.substring(run, at + DIGITS + 1, F.length(run)).alias("right"))


def _paths(levels: list[DataFrame], above: DataFrame, fan_out: int, name: str) -> DataFrame:
    """(tree, place, path) of the lowest level's runs: (tree, place) is the parent, ``path`` leads from the
    parent to the top, then through ``above`` (tree, path).  Built from the top, one join a level; the table
    of a level has a row for each of its nodes, so the lowest has leaves / fan_out rows."""
    paths = levels[-1].where("size = 1").select("tree", "place").join(above, "tree")
    for level, higher in zip(levels[-2:0:-1], levels[:1:-1]):
        parent = F.floor(F.col("place") / fan_out).cast("long")
        known = paths.join(higher.select("tree", "place", "run"), ["tree", "place"]).select(
            "tree", F.col("place").alias("parent"), "path", "run")
        inner = level.where("size > 1").select("tree", "place", parent.alias("parent")).join(known, ["tree", "parent"]).select(
            "tree", "place", F.concat(F.array(_step(F.col("run"), F.col("place"), fan_out)), F.col("path")).alias("path"))
        tops = level.where("size = 1").select("tree", "place").join(above, "tree")
        paths = saved(inner.unionByName(tops), name)
    return paths


def _with_paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fan_out: int, name: str) -> DataFrame:
    """The leaves with ``path``, from the leaf to the top of ``above``."""
    lone = leaves.where("size = 1").join(above, "tree")
    if len(levels) == 1:
        return lone
    runs = levels[1].select("tree", "place", "run").join(_paths(levels, above, fan_out, name), ["tree", "place"])
    runs = runs.select("tree", F.col("place").alias("parent"), "run", "path")
    leaves = leaves.where("size > 1").withColumn("parent", F.floor(F.col("place") / fan_out).cast("long"))
    met = leaves.join(runs, ["tree", "parent"]).withColumn(
        "path", F.concat(F.array(_step(F.col("run"), F.col("place"), fan_out)), F.col("path")))
    return met.drop("parent", "run").unionByName(lone)


def merkle_manifest(df: DataFrame, fields: list[str], group: str, order: str, tampered: dict[str, Column] | None = None,
                    fan_out: int = FAN_OUT) -> DataFrame:
    """Every row's hashes: the order column, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the sha256 of the fields, each as byte count, ``:`` and value, or ``-`` for null.  In each group
    leaves ascend by ``order``; while a group has several nodes, every ``fan_out`` consecutive ones become the
    hash of their concatenation.  The groups' last nodes, null first, then by UTF-8 bytes, make the root alike.
    proof_sha256 hashes a leaf's siblings on every level up to the root.  ``tampered`` replaces fields; the leaf
    that they give is folded with the original siblings into folded_root.

    Null order values come first and are never tampered with; rows equal in group and order ascend by leaf, and
    repeated rows are a leaf each.  An empty table gives an empty result.  Other columns are left out.  Ranges,
    not groups, are the unit of work, so a group of any size is spread; what moves is narrow, text never does.
    """
    def leaf(change: dict[str, Column]) -> Column:
        return digest(*[encoded(change.get(f, F.col(f))) for f in fields])

    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = saved(df.select(F.col(order).alias("key"), tree.alias("tree"), leaf({}).alias("hash"),
                           leaf(tampered or {}).alias("used")), "merkle-leaves")
    sizes = rows.groupBy("tree").agg(F.count("*").alias("size"))
    placed = numbered(rows, "tree", [F.col("key").asc_nulls_first(), F.col("hash")], "merkle-ranges")
    leaves = saved(placed.join(sizes, "tree"), "merkle-places")
    lower = _grown(leaves, fan_out, "merkle-level")

    subroots = saved(_roots(lower).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), "merkle-subroots")
    ranked = numbered(subroots, "tree", [F.col("name")], "merkle-groups")
    tops = saved(ranked.withColumn("size", F.lit(subroots.count()).cast("long")), "merkle-tops")
    upper = _grown(tops, fan_out, "merkle-upper")
    root = _roots(upper).select("tree", F.col("hash").alias("root"))
    ended = root.select("tree", F.expr(f"CAST(array() AS {PATH})").alias("path"))
    above = saved(_with_paths(tops, upper, ended, fan_out, "merkle-paths").join(root, "tree").select(
        F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", "path"), "merkle-above")

    found = _with_paths(leaves, lower, above.select("tree", "path"), fan_out, "merkle-paths").join(
        above.drop("path"), "tree")
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.col("used"), lambda h, s: F.when(
        (s["left"] == "") & (s["right"] == ""), F.sha2(h.cast("binary"), 256)).otherwise(digest(s["left"], h, s["right"])))
    return found.select(
        F.col("key").alias(order), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
