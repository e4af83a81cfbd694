"""Full hierarchies from parent-child links.

Method: frontier joins, level by level: the roots are the first frontier; each
join of the frontier with the links below it gives the next level and extends
root, depth and path. What no frontier reaches lies on a cycle or below one.

Defined results: a node without parent, or whose parent is not in the table, is
a root at depth 0; a node that is never reached has root '' and depth -1 (and a
null path); a node that is its own parent is on a cycle; a null or blank parent
is none; null node ids are left out; of repeated node ids any one link counts
(callers reduce them first); an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Levels joined in one job while links are shuffled, and once they are few.
WIDE, THIN = (1, 1, 2, 4), 16
#: Links of a broadcast at most; two ids each, so about 20 MB.
FEW_LINKS = 100_000


def _wide_levels(frontier: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """The next levels below the frontier by shuffled joins; equal exchanges of the links are reused."""
    out = []
    for _ in range(levels):
        f = frontier.select(F.col("t").alias("_t"), F.col("id").alias("_id"), "root", "depth", "path")
        frontier = links.join(f, (F.col("t") == F.col("_t")) & (F.col("parent") == F.col("_id"))).select(
            "t", "id", "named", "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("id")).alias("path")
        )
        out.append(frontier)
    return reduce(DataFrame.union, out)


def _thin_levels(frontier: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """The same with the links broadcast: each step turns a frontier row into itself and its children, in one stage."""
    # a link each, so a node with very many children is no single row
    parents = links.select(F.col("t").alias("_t"), F.col("parent").alias("_p")).distinct()
    frontier = frontier.join(F.broadcast(parents), (F.col("t") == F.col("_t")) & (F.col("id") == F.col("_p")), "left_semi")
    below = links.groupBy(F.col("t").alias("_t"), F.col("parent").alias("_p")).agg(F.collect_list(F.struct("id", "named")).alias("_c"))
    # one text, since each DataFrame call would analyse the growing plan again
    sql = "select t, root, id, named, depth, path, 0 as step from {frontier}"
    for i in range(levels):
        kids = f"transform(_c, c -> named_struct('id', c.id, 'named', c.named, 'depth', depth + 1, 'path', concat(path, array(c.id)), 'step', {i + 1}))"
        me = "named_struct('id', id, 'named', named, 'depth', depth, 'path', path, 'step', step)"
        sql = (
            f"select t, root, x.* from (select /*+ broadcast(b) */ t, root, explode(concat(array({me}), coalesce({kids}, array()))) as x"
            f" from ({sql}) f left join {{below}} b on step = {i} and t = _t and id = _p)"
        )
    df = links.sparkSession.sql(sql, frontier=frontier, below=below)
    return df.filter("step > 0").select("t", "id", "named", "root", "depth", "path")


def resolve_tree(nodes: DataFrame, refs: DataFrame, keep_path: bool = False, scope: str = "table_name", few_links: int = FEW_LINKS) -> DataFrame:
    """(scope, node_id, parent_id, root_id, depth[, path]) of every node.

    ``nodes`` has (scope, node_id, parent_id), ``refs`` (scope, ref, canon) all
    ids that a parent may name and the node each stands for. Levels are written
    to the shared folder, links already resolved are removed after each block,
    so later levels read only what is left; once no more than ``few_links`` are
    left (counted), they are broadcast. The number of jobs follows the depth of
    the forest, not its size. A node with very many children is split by the
    adaptive skew join, since the frontier has one row per node.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "tree")
    n = nodes.filter("node_id is not null").select(F.col(scope).alias("t"), F.col("node_id").alias("id"), F.col("parent_id").alias("named"))
    r = refs.select(F.col(scope).alias("_t"), F.col("ref").alias("_ref"), F.col("canon").alias("parent"))
    all_nodes = scratch.cut(n.join(r, (F.col("t") == F.col("_t")) & (F.col("named") == F.col("_ref")), "left").select("t", "id", "named", "parent"))
    start = F.array("id") if keep_path else F.lit(None).cast("array<string>")
    roots = all_nodes.filter("parent is null").select("t", "id", "named", F.col("id").alias("root"), F.lit(0).alias("depth"), start.alias("path"))
    links = all_nodes.filter("parent is not null")
    left = links.count()
    frontier, done, old, block, reached = roots, [roots], None, 0, 0
    while left:
        thin = left <= few_links
        levels = THIN if thin else WIDE[min(block, len(WIDE) - 1)]
        block, reached = block + 1, reached + levels
        # the frontier is only read here, the rows at its own depth are not given again
        found = scratch.cut((_thin_levels if thin else _wide_levels)(frontier, links, levels))
        count = {x["depth"]: x["n"] for x in found.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not count:
            break
        done.append(found)
        below = found.select(F.col("t").alias("_t"), F.col("id").alias("_id"))
        rest = links.join(F.broadcast(below) if thin else below, (F.col("t") == F.col("_t")) & (F.col("id") == F.col("_id")), "left_anti")
        left -= sum(count.values())
        rest = scratch.cut(rest.coalesce(max(1, left // 100_000)) if thin else rest)
        if old is not None:
            scratch.drop(old)
        links = old = rest
        if reached not in count:
            break
        frontier = found.filter(F.col("depth") == reached)
    # whatever is left is on a cycle or hangs below one
    lost = links.select("t", "id", "named", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    out = reduce(DataFrame.union, [*done, lost])
    cols = [F.col("t").alias(scope), F.col("id").alias("node_id"), F.col("named").alias("parent_id"), F.col("root").alias("root_id"), F.col("depth").cast("long").alias("depth")]
    return out.select(*cols, *([F.col("path")] if keep_path else []))


def descendants(tree: DataFrame, scope: str = "table_name") -> DataFrame:
    """(scope, ancestor_id, node_id, distance): each node below each of its ancestors.

    The pairs come from the paths, so each node gives as many rows as its depth;
    nodes without a path (cycles) give none.
    """
    up = tree.filter("depth > 0").select(scope, "node_id", F.posexplode(F.slice(F.col("path"), 1, F.col("depth").cast("int"))).alias("i", "ancestor_id"), "depth")
    return up.select(scope, "ancestor_id", "node_id", (F.col("depth") - F.col("i")).cast("long").alias("distance"))
