"""Merkle manifest of a table: a leaf per row, a tree per source, a tree of the subroots.

Only every ``STEP``-th level of a tree is written. A block is the aligned subtree
between two written levels, ``FANOUT ** STEP`` nodes at most. Proofs come from the
top down: every block regenerates its missing levels from its written nodes, hands
each of them its siblings below the path of the block itself, and drops the levels
again. No group is larger than a block, whatever share of the rows a source has.

Leaves of a source ascend by id, nulls first, then by leaf; rows that are equal in all
hashed columns have equal leaves and keep a place each. A null source is a tree of its
own and comes first. Null fields are hashed as ``-``, empty ones as ``0:``. An empty
table gives no rows and no root. Further columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.sharding import global_numbers
from signalspark.storage import materialize

FANOUT = 3
#: Levels from one written level to the next; a block has FANOUT ** STEP nodes.
STEP = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "struct<pos:bigint,node:string,id:bigint,tampered:string>"
PATH = "array<struct<left:string,right:string>>"


def leaf_of(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each with its length in front."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def n_levels(size: Column) -> Column:
    """Levels above ``size`` nodes, up to the one with a single node."""
    powers = F.array(*[F.lit(FANOUT**k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < size))


def _whole(value: Column, by: int) -> Column:
    return ((value - value % by) / by).cast("long")


def _run(nodes: Column, first: Column) -> Column:
    """The nodes of one run, from its zero-based first place."""
    return F.slice(nodes, (first + 1).cast("int"), FANOUT)


def _above(nodes: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(FANOUT))
    return F.transform(starts, lambda at: F.sha2(F.array_join(_run(nodes, at), ""), 256))


def _levels(nodes: Column, count: Column) -> Column:
    """``nodes`` and the ``count`` levels above them, as an array of arrays."""
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1)))))


def _blocks(nodes: DataFrame, done: int) -> DataFrame:
    """(tree, block, size, up, items): the nodes of a written level by aligned subtree, in order."""
    grouped = (nodes.groupBy("tree", "size", _whole(F.col("pos"), FANOUT**STEP).alias("block"))
               .agg(F.array_sort(F.collect_list("item")).alias("items")))
    return grouped.withColumn("up", F.greatest(F.lit(0), F.least(F.lit(STEP), n_levels(F.col("size")) - done)))


def _node(pos: Column, node: Column) -> Column:
    return F.struct(pos.alias("pos"), node.alias("node"), F.lit(None).cast("long").alias("id"),
                    F.lit(None).cast("string").alias("tampered")).cast(NODE).alias("item")


def written_levels(leaves: DataFrame) -> list[DataFrame]:
    """Every ``STEP``-th level of all trees of ``leaves`` (tree, size, pos, item), the leaves first.

    A tree that has reached its root is in no further level.
    """
    levels = [leaves]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    done = 0
    while FANOUT**done < largest:
        open_trees = levels[-1].filter(n_levels(F.col("size")) > done)
        nodes = F.transform("items", lambda i: i["node"])
        top = F.element_at(F.element_at(_levels(nodes, F.col("up")), -1), 1)
        level = _blocks(open_trees, done).select("tree", "size", F.col("block").alias("pos"), _node(F.col("block"), top))
        levels.append(materialize(level, "merkle_level"))
        done += STEP
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, node): the last node of every tree."""
    tops = [level.filter(n_levels(F.col("size")) <= k * STEP) if k + 1 < len(levels) else level
            for k, level in enumerate(levels)]
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return found.select("tree", F.col("item.node").alias("node"))


def proofs(levels: list[DataFrame], above: DataFrame, emit: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Rows ``emit(item, path, subroot)`` of every leaf; ``above`` has (tree, subroot, path of the root).

    A path holds the siblings before and after the node, level by level, then ``above``'s.
    """
    tops = above.select("tree", F.lit(0).cast("long").alias("block"), "subroot", F.col("path").cast(PATH).alias("path"))
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        ended = levels[k].filter(n_levels(F.col("size")) <= k * STEP).select("tree")
        ending = tops.join(ended, "tree", "left_semi")
        known = ending if paths is None else paths.unionByName(ending)
        if paths is None and k:
            paths = known
            continue
        blocks = _blocks(levels[k], k * STEP).withColumn("levels", _levels(F.transform("items", lambda i: i["node"]), F.col("up")))
        # the join ends the projection: levels are regenerated once per block, not once per node
        joined = blocks.join(known, ["tree", "block"])
        whole = lambda at: F.concat(_within(F.col("levels"), F.col("up"), at), F.col("path"))
        if k:
            made = F.transform("items", lambda i, at: F.struct(
                i["pos"].alias("block"), F.col("subroot").alias("subroot"), whole(at).alias("path")))
            paths = materialize(joined.select("tree", F.inline(made)), "merkle_paths")
    return joined.select(F.inline(F.transform("items", lambda i, at: emit(i, whole(at), F.col("subroot")))))


def _within(levels: Column, up: Column, at: Column) -> Column:
    """Path of the node at place ``at`` of a block through the block's own levels."""
    powers = F.array(*[F.lit(FANOUT**k) for k in range(STEP + 1)])

    def siblings(level: Column, j: Column) -> Column:
        own = _whole(at, F.element_at(powers, j + 1))
        run = _run(level, own - own % FANOUT)
        place = (own % FANOUT).cast("int")
        return F.struct(F.array_join(F.slice(run, F.lit(1), place), "").alias("left"),
                        F.array_join(F.slice(run, place + 2, F.lit(FANOUT)), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), up), siblings)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """Hash of all siblings, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """Written (tree, size, pos, item) of leaves (tree, id, node, tampered, uid), by id within a tree.

    Rows are dealt by ranges of (tree, id, node, uid), so that a tree of any size is many
    tasks; places come from the counts of (range, tree), of which there are few.
    """
    order = ["tree", "id", "node", "uid"]
    dealt = materialize(leaves.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
                        .withColumn("_range", F.spark_partition_id()), "merkle_ranges")
    counts = dealt.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("tree")
    before = along.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("tree", "_range", F.sum("n").over(along).alias("size"),
                                        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset")), "merkle_offsets")
    within = Window.partitionBy("_range", "tree").orderBy(*[F.col(c).asc_nulls_first() for c in order[1:]])
    numbered = (dealt.withColumn("_k", F.row_number().over(within) - 1).join(offsets, ["_range", "tree"])
                .withColumn("pos", F.col("_offset") + F.col("_k")))
    item = F.struct("pos", "node", "id", "tampered").cast(NODE).alias("item")
    return materialize(numbered.select("tree", "size", "pos", item), "merkle_leaves")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             tampered: dict[str, Column] | None = None, with_path: bool = True) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, path) per row: its proof, and the root that gives.

    ``path`` lists (left, right) siblings from the leaf to the root; it is long, so
    ``with_path=False`` leaves it out. ``tampered`` replaces fields by altered ones;
    ``folded_root`` is then the root that the altered row gives with the siblings of the first.
    """
    changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
    # null sorts before the empty text, and both before all others
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_of([F.col(c) for c in fields]).alias("node"),
                         leaf_of(changed).alias("tampered"), F.monotonically_increasing_id().alias("uid"))
    slim = materialize(leaves.withColumn("tampered", F.when(F.col("tampered") != F.col("node"), F.col("tampered"))), "merkle_leaves")
    levels = written_levels(placed_leaves(slim))
    subroots = materialize(roots(levels).withColumn("n", F.lit(1)), "subroots")
    ordered = global_numbers(subroots, ["tree", "node"]).withColumn("_first", F.col("_first").cast("long"))
    # in the tree of the subroots the name of the source has the place of the altered leaf
    item = F.struct(F.col("_first"), F.col("node"), F.lit(None), F.col("tree")).cast(NODE).alias("item")
    upper = written_levels(materialize(ordered.select(
        F.lit("").alias("tree"), F.lit(subroots.count()).cast("long").alias("size"), F.col("_first").alias("pos"), item), "subroots"))
    found = roots(upper).select("node").first()
    root = F.lit(found[0] if found else None).cast("string").alias("root")
    top = docs.sparkSession.createDataFrame([("", None, [])], f"tree string, subroot string, path {PATH}")
    trees = materialize(proofs(upper, top, lambda i, path, _: F.struct(
        i["tampered"].alias("tree"), i["node"].alias("subroot"), path.alias("path"))), "subroot_paths")
    last = [lambda path: path.alias("path")] if with_path else []
    return proofs(levels, trees, lambda i, path, subroot: F.struct(
        i["id"].alias(id_col), i["node"].alias("leaf"), subroot.alias("subroot"), root,
        siblings_digest(path).alias("proof_sha256"), folded(F.coalesce(i["tampered"], i["node"]), path).alias("folded_root"),
        *[f(path) for f in last]))
