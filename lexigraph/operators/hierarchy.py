"""Parent-child links to full hierarchies: weighted disjoint-set forests.

``forest`` turns distinct (parent, child) links into one row per node: root, depth, number of descendants, with
cycles reported; ``with_paths`` adds the paths and ``descendants`` lists all descendants.

1. Partition-local forests. The links are cut into ranges of child ids. In every range a disjoint-set forest with weights
   takes up link by link: the representative of a set is its topmost node, and every node knows its offset to it. A link that
   would close a cycle is left as it is.
2. Merge. The forests of all ranges are merged by joining a representative with its own pointer, offsets added up; each
   round at least doubles the distance covered: a path of length d takes about log2(d) rounds over rows (node,
   pointer, offset). A round in which no node newly reaches a root proves that the rest hangs on cycles (the lowest
   unresolved node of a tree points to a resolved one and is resolved in the next round).
3. Cycles. Among the rest the image of the pointers shrinks to the nodes on cycles; the smallest id on the way
   becomes stable once it has gone round.
4. Descendants are counted by doubling: the sum over distances below 2^k of a node and of its descendants 2^k further down give
   that below 2^(k+1). Sums are combined in every task before the shuffle, so that a hot root costs no more than others.
5. Paths. Every ``STEP`` levels lie anchors. A node climbs the parent index to its anchor, collecting fewer than ``STEP`` ids;
   the paths of the anchors come in the same way from their own anchors. A whole path is shuffled once, to its nodes.

Defined cases: links with a null end are no links; repeated links count once; a child with several parents
hangs on the smallest parent id (each id is one row); a link to itself is a cycle; nodes on a cycle have depth -1,
nodes only below one depth -2, both with the smallest id on the cycle as root, an empty path and 0 descendants;
pointers that do not come to rest are an error; empty input gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.session import bare, cut, default_parallelism

#: Links of one range.
RANGE_LINKS = 200_000
#: Levels between anchors.
STEP = 16
#: Doublings that cover any path that fits in a table.
MAX_ROUNDS = 64


class WeightedForest:
    """Disjoint sets of nodes; the representative is the topmost node, ``find`` tells it and the offset to it."""

    def __init__(self):
        self.up: dict[int, tuple[int, int]] = {}

    def find(self, node: int) -> tuple[int, int]:
        way, at = [], node
        while at in self.up:
            way.append(at)
            at = self.up[at][0]
        # compress the way: offsets add up from the top
        offset = 0
        for x in reversed(way):
            offset += self.up[x][1]
            self.up[x] = (at, offset)
        return at, offset

    def link(self, child: int, parent: int) -> bool:
        """Hang a set under a parent; False if that would close a cycle. ``child`` must be a representative."""
        if self.find(parent)[0] == child:
            return False
        self.up[child] = (parent, 1)
        return True


def _united(df: DataFrame) -> DataFrame:
    """Cut the lineage of a union; its arms must not add up their partitions round by round."""
    return bare(cut(df.coalesce(default_parallelism(df.sparkSession))))


_POINTERS = pa.schema([("node", pa.int64()), ("ptr", pa.int64()), ("off", pa.int64())])


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pointers of one range: (node, topmost node known here, offset)."""
    forest, closing = WeightedForest(), {}
    for batch in batches:
        for child, parent in zip(batch.column("node").to_pylist(), batch.column("ptr").to_pylist()):
            if not forest.link(child, parent):
                closing[child] = parent
    nodes = [*forest.up]
    for i in range(0, len(nodes), 10_000):
        found = [(x, *forest.find(x)) for x in nodes[i : i + 10_000]]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], schema=_POINTERS)
    if closing:
        yield pa.record_batch([pa.array([*closing], pa.int64()), pa.array([*closing.values()], pa.int64()), pa.array([1] * len(closing), pa.int64())], schema=_POINTERS)


def tree_of(links: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, ptr): the parent of every child; the smallest wins. Partial aggregation makes repeated links cheap."""
    ends = links.select(F.col(parent).cast("bigint").alias("p"), F.col(child).cast("bigint").alias("c")).where("p is not null and c is not null")
    return ends.groupBy(F.col("c").alias("node")).agg(F.min("p").alias("ptr"))


def forest(links: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, parent, root, depth, n_descendants) of the hierarchy of the links; ``parent`` is null at roots, on cycles and below them."""
    tree = cut(tree_of(links, parent, child))
    roots = tree.select(F.col("ptr").alias("node")).distinct().join(tree.select("node"), "node", "left_anti")
    roots = roots.select("node", F.col("node").alias("ptr"), F.lit(0).cast("bigint").alias("off"), F.lit(True).alias("done"))
    ranges = max(1, tree.count() // RANGE_LINKS)
    local = tree.repartitionByRange(ranges, "node").mapInArrow(_local_forest, "node bigint, ptr bigint, off bigint").withColumn("done", F.lit(False))
    state = _united(local.unionByName(roots))
    open_before = None
    for _ in range(MAX_ROUNDS):
        still_open = state.where(~F.col("done")).count()
        if still_open in (0, open_before):
            break
        open_before = still_open
        target = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("up"), F.col("off").alias("up_off"), F.col("done").alias("up_done"))
        moved = state.where(~F.col("done")).join(target, "ptr").select("node", F.col("up").alias("ptr"), (F.col("off") + F.col("up_off")).alias("off"), F.col("up_done").alias("done"))
        state = _united(state.where("done").unionByName(moved))
    else:
        raise RuntimeError(f"{still_open} pointers do not come to rest")
    good = state.where("done").select("node", F.col("ptr").alias("root"), F.col("off").cast("int").alias("depth"))
    good = cut(good.join(tree.withColumnRenamed("ptr", "parent"), "node", "left"))
    out = good.join(_sizes(good), "node").select("node", "parent", "root", "depth", "n_descendants")
    if still_open:
        bad = state.where(~F.col("done")).select("node").join(tree, "node")
        out = out.unionByName(_cycles(bad))
    return out


def _sizes(nodes: DataFrame) -> DataFrame:
    """(node, n_descendants) of (node, parent, depth)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select("node", F.col("parent").alias("far"), F.lit(1).cast("bigint").alias("size"))
    reach = 1
    while reach <= deepest:
        sums = state.where("far is not null").groupBy(F.col("far").alias("node")).agg(F.sum("size").alias("more"))
        new = state.join(sums, "node", "left").select("node", "far", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        climbing = new.where("far is not null").join(state.select(F.col("node").alias("far"), F.col("far").alias("farther")), "far")
        state = _united(new.where("far is null").unionByName(climbing.select("node", F.col("farther").alias("far"), "size")))
        reach *= 2
    return state.select("node", (F.col("size") - 1).alias("n_descendants"))


def _cycles(rest: DataFrame) -> DataFrame:
    """The rows of nodes on and below cycles; ``rest`` has their (node, ptr) links, each to another of them."""
    state = cut(rest.select("node", "ptr", F.col("node").alias("low")))
    last = None
    for _ in range(MAX_ROUNDS):
        up = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("up"), F.col("low").alias("up_low"))
        state = cut(state.join(up, "ptr").select("node", F.col("up").alias("ptr"), F.least("low", "up_low").alias("low")))
        image = state.select(F.col("ptr").alias("node")).distinct()
        ring = state.join(image, "node", "left_semi")
        now = ring.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("pointers on cycles do not come to rest")
    on = image.select("node", F.lit(True).alias("on"))
    lows = ring.select(F.col("node").alias("ptr"), F.col("low").alias("root"))
    j = state.select("node", "ptr").join(lows, "ptr").join(on, "node", "left")
    none = F.lit(None).cast("bigint").alias("parent")
    return j.select("node", none, "root", F.when(F.col("on"), -1).otherwise(-2).alias("depth"), F.lit(0).cast("bigint").alias("n_descendants"))


def paths(nodes: DataFrame) -> DataFrame:
    """(node, path array<bigint>) of the nodes (node, parent, depth) of trees, from the root to the node."""
    return _paths(nodes.select("node", F.col("parent").alias("up"), F.col("depth").cast("bigint").alias("depth"), F.array("node").alias("piece")))


def _paths(tree: DataFrame) -> DataFrame:
    """(node, path): the path of ``up`` and the piece of the node; at a root the piece alone."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    none = F.expr("cast(array() as array<bigint>)")
    anchor = F.col("depth") % STEP == 0
    # at: where the climb has come to; left: levels from there to the anchor
    state = tree.select("node", F.when(anchor, F.col("node")).otherwise(F.col("up")).alias("at"), F.when(anchor, none).otherwise(F.col("piece")).alias("piece"), F.when(anchor, F.lit(0)).otherwise((F.col("depth") - 1) % STEP).alias("left"))
    state, reach = cut(state), 1
    while reach < min(STEP, deepest):
        above = state.select(F.col("node").alias("at"), F.col("at").alias("higher"), F.col("piece").alias("upper"), F.col("left").alias("less"))
        climbed = state.where("left > 0").join(above, "at").select("node", F.col("higher").alias("at"), F.concat("upper", "piece").alias("piece"), F.col("less").alias("left"))
        state = _united(state.where("left = 0").unionByName(climbed))
        reach *= 2
    if deepest < STEP:
        return state.select("node", F.concat(F.array("at"), "piece").alias("path"))
    over = state.select(F.col("node").alias("up"), F.col("at").alias("anchor"), F.col("piece").alias("upper"))
    anchors = tree.where(anchor & (F.col("depth") > 0)).join(over, "up").select("node", F.col("anchor").alias("up"), F.floor(F.col("depth") / STEP).alias("depth"), F.concat("upper", "piece").alias("piece"))
    top = tree.where("depth = 0").select("node", "up", "depth", "piece")
    higher = _paths(_united(top.unionByName(anchors)))
    return state.join(higher.withColumnRenamed("node", "at"), "at").select("node", F.concat("path", "piece").alias("path"))


def with_paths(nodes: DataFrame) -> DataFrame:
    """The rows of ``forest`` with their path; empty on cycles and below them."""
    nodes = cut(nodes)
    found = nodes.where("depth >= 0").join(paths(nodes.where("depth >= 0")), "node")
    return found.unionByName(nodes.where("depth < 0").withColumn("path", F.expr("cast(array() as array<bigint>)")))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node of the trees with every node above it."""
    p = nodes.where("depth > 0") if "path" in nodes.columns else with_paths(nodes).where("depth > 0")
    above = p.select("node", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("place", "ancestor"))
    return above.select("ancestor", "node", (F.col("depth") - F.col("place")).alias("distance"))
