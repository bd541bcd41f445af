"""A Merkle manifest of a dataset: every document a leaf, a tree for each language, a tree over the languages' roots.

Cogrouped subtree exchange:

1. A scan turns each row into the digests of its leaf, as it is and as it is found to be later; texts go no further.
2. Leaves get their places in their language (`places.numbered`).
3. Upwards: superblocks of FANOUT ** levels consecutive nodes are reduced to a node each, level upon level, until a group
   has one. Then the languages' roots, ordered by language, are reduced alike to the root.
4. Downwards: each level's nodes are cogrouped by superblock with what lies outside of it (a row for each superblock: the
   siblings of its own path up to the root), which gives the same for the superblocks below. On the last level leaves are
   cogrouped so: one call reduces the superblock again, joins inner and outer siblings to each leaf's proof, and folds it.

A superblock has 4,096 nodes at most, so no group grows with the data, and levels shrink by as much: 10 ** 11 leaves
take four. Nothing of the tree passes through the driver.

Rows: repeated ids are leaves of their own, ordered by id and leaf; a null id comes first and is written `-`, as any null
is; a null language is a language, the first. A language of one row: its leaf is its subroot. No rows: no rows. Further
columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import broadcast_if_small, materialize
from gravelsift.llm.places import numbered

FANOUT = 8
#: Levels of a superblock: 8 ** 4 nodes.
LEVELS = 4
_NODE = "grp long, place long, total long, digest string"
_OUTER = "grp long, blk long, root string, lefts array<string>, rights array<string>"
_PROVED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def encoded(*columns: Column) -> Column:
    """The columns as one string: `-` for null, else the UTF-8 byte count, a colon, the value."""
    parts = [c.cast("string") for c in columns]
    return F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in parts))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(joined: str) -> str:
    return sha256(joined.encode()).hexdigest()


def height(total: int) -> int:
    """How many times `total` nodes are reduced until one is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and each level above them."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest("".join(low[k : k + FANOUT])) for k in range(0, len(low), FANOUT)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For each level of a tree but its last: what stands left and right of the node above place `at`, in its run."""
    out = []
    for level in tree[:-1]:
        run = level[at - at % FANOUT : at - at % FANOUT + FANOUT]
        out.append(("".join(run[: at % FANOUT]), "".join(run[at % FANOUT + 1 :])))
        at //= FANOUT
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _tree(ordered: pd.DataFrame, levels: int) -> list[list[str]]:
    """A superblock's nodes and the levels above them: fewer if its group has only so many."""
    return reduced(ordered.digest.tolist(), min(levels, height(int(ordered.total.iloc[0]))))


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """A node for each superblock."""
    size = FANOUT**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        grp, place, total = (int(block[c].iloc[0]) for c in ("grp", "place", "total"))
        return pd.DataFrame({"grp": [grp], "place": [place // size], "total": [-(-total // size)], "digest": [_tree(block.sort_values("place"), levels)[-1][0]]})

    return nodes.groupBy("grp", F.floor(F.col("place") / size).alias("blk")).applyInPandas(run, _NODE)


def _climb(nodes: DataFrame, levels: int, label: str) -> list[DataFrame]:
    """The nodes, and above them a table a level of superblocks, until each group has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:  # as many jobs as the tree has levels of superblocks
        out.append(materialize(_up(out[-1], levels), label)[0])
    return out


def _outside(level: DataFrame, outer: DataFrame, levels: int, label: str) -> DataFrame:
    """For each node of a level, as the block below it: the siblings on its way up, within its superblock and outside."""

    def run(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["grp", "blk", "root", "lefts", "rights"])
        ordered, up = block.sort_values("place"), above.iloc[0]
        tree, first = _tree(ordered, levels), int(ordered.place.iloc[0])
        own = [siblings(tree, p - first) for p in ordered.place.tolist()]
        paths = {"lefts": [[a for a, _ in x] + list(up.lefts) for x in own], "rights": [[b for _, b in x] + list(up.rights) for x in own]}
        return pd.DataFrame({"grp": ordered.grp, "blk": ordered.place, "root": up.root} | paths)

    blocks = level.withColumn("blk", F.floor(F.col("place") / FANOUT**levels)).groupBy("grp", "blk")
    return materialize(blocks.cogroup(outer.groupBy("grp", "blk")).applyInPandas(run, _OUTER), label)[0]


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
    found: dict[str, Column] | None = None, levels: int = LEVELS,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    found: columns as a later reader finds them, by name; a row whose leaf differs then doesn't fold to the root.
    """
    spark = docs.sparkSession
    later = encoded(*((found or {}).get(c, F.col(c)) for c in fields))
    leaves = docs.select(F.col(id_col).alias("doc_id"), F.col(group_col).alias("part"), F.sha2(encoded(*map(F.col, fields)), 256).alias("leaf"), F.sha2(later, 256).alias("seen"))
    kind = leaves.schema["doc_id"].dataType.simpleString()
    leaves, _ = materialize(leaves.withColumns({"leaf": F.unhex("leaf"), "seen": F.unhex("seen")}), "merkle-leaves")
    placed = numbered(leaves, ["part"], ["doc_id", "leaf"], "merkle-places", "place", "total")
    parts, _ = materialize(placed.select("part").distinct(), "merkle-parts")
    parts, _ = materialize(numbered(parts, [], ["part"], "merkle-order", "grp", "parts"), "merkle-groups")
    names = parts.select(F.col("part").alias("_part"), "grp", "parts")
    nodes = placed.join(broadcast_if_small(names), F.col("part").eqNullSafe(F.col("_part"))).select("grp", "place", "total", "doc_id", "leaf", "seen", "parts")
    nodes, _ = materialize(nodes, "merkle-nodes")

    trees = _climb(nodes.select("grp", "place", "total", F.lower(F.hex("leaf")).alias("digest")), levels, "merkle-up")
    subroots = trees[-1].select("grp", F.col("digest").alias("subroot"))
    if subroots.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, {_PROVED}, verified boolean")
    roots = subroots.join(names.select("grp", "parts"), "grp")
    top = _climb(roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("parts").alias("total"), F.col("subroot").alias("digest")), levels, "merkle-top")
    nothing = F.array().cast("array<string>")
    outer = top[-1].select("grp", F.col("place").alias("blk"), F.col("digest").alias("root"), nothing.alias("lefts"), nothing.alias("rights"))
    for level in reversed(top[:-1]):
        outer = _outside(level, outer, levels, "merkle-down")
    outer = outer.select(F.col("blk").alias("grp"), F.lit(0).cast("long").alias("blk"), "root", "lefts", "rights")  # a language's tree hangs below its node
    for level in reversed(trees[1:-1]):
        outer = _outside(level, outer, levels, "merkle-down")
    outer = outer.join(broadcast_if_small(materialize(subroots, "merkle-subroots")[0]), "grp")

    def prove(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(leaves):
            return pd.DataFrame(columns=["doc_id", *(x.split()[0] for x in _PROVED.split(", "))])
        ordered, up = leaves.sort_values("place"), above.iloc[0]
        original = [b.hex() for b in ordered.leaf]
        tree = reduced(original, min(levels, height(int(ordered.total.iloc[0]))))
        rest = list(zip(up.lefts, up.rights, strict=True))
        outside = "".join([a + b for a, b in rest])
        first, proofs, folded = int(ordered.place.iloc[0]), [], []
        for place, seen in zip(ordered.place.tolist(), ordered.seen, strict=True):
            inside = siblings(tree, place - first)
            proofs.append(digest("".join([a + b for a, b in inside]) + outside))
            folded.append(fold(seen.hex(), inside + rest))
        return pd.DataFrame({"doc_id": ordered.doc_id, "leaf": original, "subroot": up.subroot, "root": up.root, "proof_sha256": proofs, "folded_root": folded})

    blocks = nodes.select("grp", F.floor(F.col("place") / FANOUT**levels).alias("blk"), "place", "total", "doc_id", "leaf", "seen")
    proved = blocks.groupBy("grp", "blk").cogroup(outer.groupBy("grp", "blk")).applyInPandas(prove, f"doc_id {kind}, {_PROVED}")
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
