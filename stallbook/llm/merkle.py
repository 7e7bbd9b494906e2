"""Merkle manifest of a dataset: checkpointed hash trees, and proofs by recomputing what lies between checkpoints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallbook.llm.base import let
from stallbook.operators.ranking import positions
from stallbook.session import written

#: Nodes under one node.
FANOUT = 8
#: Levels from one persisted level to the next; those between are recomputed, FANOUT ** STEPS nodes at a time.
STEPS = 2
SUBTREE = FANOUT ** STEPS

PROOF = "array<struct<left:string,right:string>>"


# ---- hashes -----------------------------------------------------------------------------------------------------

def encoded(value: Column) -> Column:
    """A field of a leaf: its length in UTF-8 bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the encoded fields, one after the other."""
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to: each level's siblings to the left, the node, those to the right."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one string, from the leaf upwards and left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _parents(nodes: Column) -> Column:
    """One level up: the hash of every FANOUT consecutive nodes, the last run being as short as it comes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FANOUT + 1, FANOUT), ""), 256))


def _width(n: Column, level: int) -> Column:
    """How many nodes a tree of n nodes has so many levels up."""
    return reduce(lambda m, _: F.ceil(m / FANOUT).cast("bigint"), range(level), n)


def _aligned(nodes: Column, n: Column, then) -> Column:
    """then(levels) on the levels of one aligned subtree, lowest first, up to where its tree has a single node."""
    def climb(levels: list[Column], step: int) -> Column:
        if step > STEPS:
            return then(levels)
        # A tree of one node is finished: nothing is hashed again.
        above = F.when(_width(n, step - 1) > 1, _parents(levels[-1])).otherwise(levels[-1])
        return let(above, lambda x: climb([*levels, x], step + 1))

    return let(nodes, lambda x: climb([x], 1))


# ---- building ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Forest:
    """Trees of one kind: persisted levels from the leaves (tree, i, n, h and further columns) to one node a tree."""

    levels: list[DataFrame]

    @property
    def tops(self) -> DataFrame:
        return self.levels[-1].select("tree", "h")


def _subtrees(level: DataFrame, *more: str) -> DataFrame:
    """(tree, block, width, nodes): the nodes of each aligned subtree in order, SUBTREE at most, and the level's width."""
    nodes = F.array_sort(F.collect_list(F.struct("i", "h", *more)))
    return level.groupBy("tree", F.shiftright("i", STEPS * 3).alias("block")).agg(F.max("n").alias("width"), nodes.alias("nodes"))


def build(leaves: DataFrame, order: list[str]) -> Forest:
    """The trees over leaves (tree, h, and the columns of `order`), leaves in that order.

    Positions are a distributed prefix sum, so a tree may hold all leaves. Every STEPS levels are hashed in one
    aggregate over aligned subtrees of SUBTREE nodes, and only its result is persisted. No leaves: no trees.
    """
    placed = positions(leaves, ["tree"], [*order, "h"], "place").withColumn("i", F.col("place") - 1)
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    level = written(placed.drop("place").join(sizes, "tree"), "leaves")
    most = level.agg(F.max("n")).first()[0] or 1
    levels = [level]
    while most > 1:
        top = _aligned(F.transform("nodes", lambda x: x["h"]), F.col("width"), lambda built: F.element_at(built[-1], 1))
        up = _subtrees(levels[-1].select("tree", "i", "n", "h")).select("tree", F.col("block").alias("i"), _width(F.col("width"), STEPS).alias("n"), top.alias("h"))
        levels.append(written(up, "nodes"))
        most = -(-most // SUBTREE)
    return Forest(levels)


# ---- proofs -----------------------------------------------------------------------------------------------------

def _own_siblings(levels: list[Column], n: Column, place: Column) -> Column:
    """Per level hashed inside an aligned subtree the siblings of a node, or of its ancestor there."""
    parts = []
    for k in range(STEPS):
        at = F.shiftright(place, 3 * k)
        run, inside = F.shiftright(at, 3) * FANOUT, at.bitwiseAND(FANOUT - 1)
        left = F.array_join(F.slice(levels[k], run + 1, inside), "")
        right = F.array_join(F.slice(levels[k], at + 2, FANOUT - 1 - inside), "")
        parts.append(F.when(_width(n, k) > 1, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(PROOF)))
    return F.concat(*parts)


def proofs(forest: Forest, above: DataFrame, *more: str) -> DataFrame:
    """(tree, i, h, more, proof, and further columns of `above`) of every leaf.

    `above` has (tree, proof, ...) for the top node of each tree. From the top down, each persisted node's aligned
    subtree is hashed again from the persisted level below; the siblings found go to its nodes, and what was
    recomputed is dropped with the row. One node in SUBTREE carries the proof above it into the join.
    """
    passed = [c for c in above.columns if c not in ("tree", "proof")]
    known = above.withColumn("block", F.lit(0).cast("bigint"))
    for k, level in reversed(list(enumerate(forest.levels[:-1]))):
        own = list(more) if k == 0 else []
        blocks = _subtrees(level, *own).join(known, ["tree", "block"])
        entry = lambda x, at, levels: F.struct(
            x["i"].alias("i"), x["h"].alias("h"), *(x[c].alias(c) for c in own),
            F.concat(_own_siblings(levels, F.col("width"), at), F.col("proof")).alias("proof"))
        rows = _aligned(F.transform("nodes", lambda x: x["h"]), F.col("width"),
                        lambda levels, entry=entry: F.transform("nodes", lambda x, at: entry(x, at, levels)))
        known = blocks.select("tree", *passed, F.explode(rows).alias("x")).select("tree", "x.*", *passed)
        if k:
            known = known.drop("h").withColumnRenamed("i", "block")
    if len(forest.levels) == 1:  # every tree is a single leaf
        known = forest.levels[0].select("tree", "i", "h", *more).join(above, "tree")
    return known


# ---- the operator -----------------------------------------------------------------------------------------------

def _key(value: Column) -> Column:
    """A name of each tree that is never null and sorts as the values do, null first and by bytes."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", tree: str = "lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Each row is a leaf over `fields`. Per value of `tree`, null among them, leaves ascend by `key` (nulls first, equal
    keys by their hash) into a tree of runs of FANOUT; the trees' roots, in order of the values, make another such
    tree. `tampered` replaces fields in what is verified: folded_root comes from the changed leaf and the siblings as
    stored, and `verified` says whether it is the root. Without it every row is verified.
    Rows that repeat a key, whole repeated rows too, are leaves of their own. Empty texts and nulls differ. A dataset
    of one row is its own root, with the hash of nothing as proof. An empty table gives no rows; other columns are
    not read.
    """
    own, changed = {f: F.col(f) for f in fields}, tampered or {}
    leaves = docs.select(F.col(key).alias("id"), _key(F.col(tree)).alias("tree"), leaf_hash(*own.values()).alias("h"),
                         leaf_hash(*(own | changed).values()).alias("claim"))
    forest = build(leaves, ["id"])
    over = build(forest.tops.select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "h"), ["name"])
    row = over.tops.first()
    root = F.lit(row["h"] if row else None).cast("string")
    tops = over.tops.select("tree", F.array().cast(PROOF).alias("proof"))
    above = proofs(over, tops, "name").select(F.col("name").alias("tree"), F.col("h").alias("subroot"), "proof")
    found = proofs(forest, written(above, "subroots"), "id", "claim")
    folded = found.select(F.col("id").alias(key), F.col("h").alias("leaf"), "subroot", root.alias("root"),
                          F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold(F.col("proof"), F.col("claim")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
