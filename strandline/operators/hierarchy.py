"""Parent-child rows to full hierarchies: path, depth, root, descendants, loops.

Method: level-wise frontier joins from the roots extend paths and depths; the ancestors on each path
give the descendants; nodes that no frontier reaches hang on loops.

Several levels are joined in one job without repeating one another: a row carries its chain of new
nodes on to the next level, and every node is put out by exactly one chain, the one that goes on
through first children.  Each job's rows are written, and only trees that still grow stay in the
next job's edges, so a few deep trees don't re-read all edges.

Scale: frontiers and edges meet on (tree, node, salt).  The children of a parent that holds many are
spread over salts, so a third of all rows under one parent is many tasks; nothing is gathered per tree.
Trees in which some node has several parents take their own rounds; the others don't wait for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.skew import HOT_KEYS
from strandline.workspace import materialise

FIRST_LEVELS, MOST_LEVELS = 4, 16  #: levels of the first job, doubled with every job up to the most
FAN = 10_000  #: a parent with more children is spread over salts
_PEELS_PER_JOB = 8
_ON = ["tree", "node"]


def _edges(rows: DataFrame, tree: str, parent: str, child: str) -> DataFrame:
    return rows.where(F.col(tree).isNotNull() & F.col(parent).isNotNull() & F.col(child).isNotNull()).select(
        F.col(tree).alias("tree"), F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")
    ).dropDuplicates()


def _nodes(rows: DataFrame, tree: str, parent: str, child: str) -> DataFrame:
    named = rows.select(F.col(tree).alias("tree"), F.explode(F.array(F.col(parent).cast("string"), F.col(child).cast("string"))).alias("node"))
    return named.where("tree is not null and node is not null").dropDuplicates()


def frontier_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``tree, node, path`` of everything below ``roots`` (the same columns), the roots themselves included.

    ``edges`` has distinct tree, parent, child, every child under one parent; ``path`` is an array that ends
    with the node.  Loops that hang under no root are never reached.
    """
    sizes = materialise(edges.groupBy("tree", "parent").agg(F.count("*").alias("n"), F.min("child").alias("child")), "families")
    most = max(FAN, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = sizes.where(F.col("n") > most).select("tree", "parent", F.ceil(F.col("n") / most).cast("int").alias("salts"))  # fewer than HOT_KEYS rows
    salts = F.coalesce("salts", F.lit(1))
    firsts = sizes.select("tree", "parent", "child", F.lit(True).alias("first"))
    live = edges.join(firsts, ["tree", "parent", "child"], "left").join(F.broadcast(hot), ["tree", "parent"], "left")
    live = live.select("tree", "parent", "child", F.coalesce("first", F.lit(False)).alias("first"), F.pmod(F.xxhash64("child"), salts).cast("int").alias("salt"))
    live = materialise(live.join(F.broadcast(hot.withColumnRenamed("parent", "child")), ["tree", "child"], "left").select("tree", "parent", "child", "first", "salt", salts.alias("spread")), "edges")
    start = roots.join(F.broadcast(hot.withColumnRenamed("parent", "node")), _ON, "left").select("tree", "node", "path", salts.alias("spread"))
    placed, front, n_levels = [roots], start, FIRST_LEVELS
    while True:
        chains = front.select("tree", "node", "path", "spread", F.lit(0).alias("own"))
        for _ in range(n_levels):
            chains = _extend(chains, live)
        block = materialise(chains.where("own > 0"), "level")
        grown = block.agg(F.max("grown")).first()[0]
        if grown is None:
            break
        owned = F.transform(F.sequence(F.size("path") - F.col("own") + 1, F.size("path")), lambda k: F.slice("path", 1, k))
        placed.append(block.select("tree", F.explode(owned).alias("path")).select("tree", F.element_at("path", -1).alias("node"), "path"))
        if grown < n_levels:
            break
        front = block.where(F.col("grown") == n_levels).select("tree", "node", "path", "spread")
        alive = front.select("tree").dropDuplicates()
        live = materialise(live.join(alive, "tree", "left_semi"), "edges")
        n_levels = min(2 * n_levels, MOST_LEVELS)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _extend(chains: DataFrame, live: DataFrame) -> DataFrame:
    """Every chain by one level; a chain that has ended passes through.

    ``own`` counts the last nodes of the chain that it alone puts out, ``grown`` its new nodes.  Of a node with
    spread children one copy per salt goes on; copies that meet no child are dropped.
    """
    if "grown" not in chains.columns:
        chains = chains.withColumn("grown", F.lit(0))
    salted = chains.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))
    met = salted.join(live.select("tree", F.col("parent").alias("node"), "salt", "child", "first", F.col("spread").alias("next")), ["tree", "node", "salt"], "left")
    met = met.where(F.col("child").isNotNull() | (F.col("spread") == 1))
    more = F.col("child").isNotNull()
    step = lambda new, old: F.when(more, new).otherwise(old)
    return met.select(
        "tree", step(F.col("child"), F.col("node")).alias("node"), step(F.concat("path", F.array("child")), F.col("path")).alias("path"), step(F.col("next"), F.lit(1)).alias("spread"),
        step(F.when(F.col("first"), F.col("own")).otherwise(0) + 1, F.col("own")).alias("own"), (F.col("grown") + more.cast("int")).alias("grown"),
    )


def _ordered_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Like :func:`frontier_paths` where nodes have several parents: placed once all parents are, below the smallest path."""
    parents = materialise(edges.groupBy("tree", "child").agg(F.count("*").alias("n")), "parents")
    placed, front, live = [roots], roots, edges
    while True:
        done = placed[0]
        for more in placed[1:]:
            done = done.unionByName(more)
        touched = front.select("tree", F.col("node").alias("parent")).join(live, ["tree", "parent"]).select("tree", "child").dropDuplicates()
        into = live.join(touched, ["tree", "child"], "left_semi").join(done.withColumnRenamed("node", "parent"), ["tree", "parent"])
        best = into.groupBy("tree", "child").agg(F.count("*").alias("n"), F.min("path").alias("above"))
        front = materialise(best.join(parents, ["tree", "child", "n"]).select("tree", F.col("child").alias("node"), F.concat("above", F.array("child")).alias("path")), "level")
        if front.isEmpty():
            return done
        placed.append(front)


def _ordered_pairs(edges: DataFrame) -> DataFrame:
    """``tree, node, below``: every node with every node that some way leads to, each pair once; without loops."""
    pairs = front = materialise(edges.select("tree", F.col("parent").alias("node"), F.col("child").alias("below")), "pairs")
    links = edges.select("tree", F.col("parent").alias("below"), F.col("child").alias("next"))
    while True:
        step = front.join(links, ["tree", "below"]).select("tree", "node", F.col("next").alias("below")).dropDuplicates()
        front = materialise(step.join(pairs, ["tree", "node", "below"], "left_anti"), "pairs")
        if front.isEmpty():
            return pairs
        pairs = pairs.unionByName(front)


def _peeled(core: DataFrame, both_sides: bool = False) -> DataFrame:
    """The edges left when leaves, and with ``both_sides`` nodes without a parent, are taken off until none is left."""
    while True:
        size = core.count()
        inner = core.select("tree", F.col("parent").alias("child")).dropDuplicates()
        for _ in range(0 if both_sides else _PEELS_PER_JOB - 1):
            inner = core.join(inner, ["tree", "child"], "left_semi").select("tree", F.col("parent").alias("child")).dropDuplicates()
        less = core.join(inner, ["tree", "child"], "left_semi")
        if both_sides:
            less = less.join(core.select("tree", F.col("child").alias("parent")).dropDuplicates(), ["tree", "parent"], "left_semi")
        core = materialise(less.select("tree", "parent", "child"), "peeled")
        if core.count() == size:
            return core


def _loops(edges: DataFrame) -> DataFrame:
    """``tree, node`` of the nodes on loops.  ``edges`` hold those between nodes that no root reaches.

    Where no node has several parents, what peeling leaves is on a loop.  Other trees are taken apart by
    colour: the greatest name is passed on along edges, and what leads back to its owner within one colour
    is its component; rounds keep one row per node, never pairs.
    """
    core = _peeled(edges)
    mixed = core.groupBy("tree", "child").count().where("count > 1").select("tree").dropDuplicates()
    simple = core.join(mixed, "tree", "left_anti").select("tree", F.col("child").alias("node")).dropDuplicates()
    core = materialise(core.join(mixed, "tree", "left_semi"), "mixed")
    found = core.where("parent = child").select("tree", F.col("child").alias("node")).dropDuplicates()
    while True:
        core = _peeled(core, True)
        if core.isEmpty():
            return simple.unionByName(found).dropDuplicates()
        nodes = core.select("tree", F.col("child").alias("node")).dropDuplicates()
        colour = materialise(nodes.withColumn("colour", F.col("node")), "colour")
        while True:
            passed = core.join(colour.withColumnRenamed("node", "parent"), ["tree", "parent"]).groupBy("tree", F.col("child").alias("node")).agg(F.max("colour").alias("c"))
            step = colour.join(passed, _ON, "left").select(*_ON, F.greatest("colour", "c").alias("colour"), (F.coalesce("c", F.col("colour")) > F.col("colour")).alias("moved"))
            step = materialise(step, "colour")
            colour = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        inside = core.join(colour.select("tree", F.col("node").alias("child"), "colour"), ["tree", "child"])
        inside = materialise(inside.join(colour.select("tree", F.col("node").alias("parent"), F.col("colour").alias("c")), ["tree", "parent"]).where("c = colour").select("tree", "parent", "child"), "inside")
        back = front = materialise(colour.where("node = colour").select(*_ON, "colour"), "back")
        while True:
            above = front.join(inside.withColumnRenamed("child", "node"), _ON).select("tree", F.col("parent").alias("node"), "colour").dropDuplicates()
            front = materialise(above.join(back, _ON, "left_anti"), "back")
            if front.isEmpty():
                break
            back = back.unionByName(front)
        many = back.groupBy("tree", "colour").count().where("count > 1").drop("count")
        found = materialise(found.unionByName(back.join(many, ["tree", "colour"], "left_semi").select(*_ON)), "loops")
        for end in ("parent", "child"):
            core = core.join(back.select("tree", F.col("node").alias(end)), ["tree", end], "left_anti")
        core = materialise(core, "mixed")


class _Placed:
    """Nodes and edges of a forest, and what the frontiers reach."""

    def __init__(self, rows: DataFrame, tree: str, parent: str, child: str) -> None:
        self.edges = materialise(_edges(rows, tree, parent, child), "edges")
        self.nodes = materialise(_nodes(rows, tree, parent, child), "nodes")
        roots = self.nodes.join(self.edges.select("tree", F.col("child").alias("node")).dropDuplicates(), _ON, "left_anti")
        roots = roots.select(*_ON, F.array("node").alias("path"))
        self.mixed = materialise(self.edges.groupBy("tree", "child").count().where("count > 1").select("tree").dropDuplicates(), "mixed-trees")
        self.any_mixed = not self.mixed.isEmpty()
        if not self.any_mixed:
            self.good = self.plain = frontier_paths(materialise(roots, "roots"), self.edges)
            return
        self.plain = frontier_paths(materialise(roots.join(self.mixed, "tree", "left_anti"), "roots"), materialise(self.edges.join(self.mixed, "tree", "left_anti"), "edges"))
        self.good = self.plain.unionByName(_ordered_paths(materialise(roots.join(self.mixed, "tree", "left_semi"), "roots"), materialise(self.edges.join(self.mixed, "tree", "left_semi"), "edges")))

    def pairs(self) -> DataFrame:
        """``tree, node, below``, each once, between nodes in state ``tree``."""
        over = self.plain.where(F.size("path") > 1).select("tree", F.col("node").alias("below"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node"))
        over = over.select("tree", "node", "below")
        if not self.any_mixed:
            return over
        held = self.edges.join(self.mixed, "tree", "left_semi").join(self.good.select("tree", F.col("node").alias("child")), ["tree", "child"], "left_semi")
        return over.unionByName(_ordered_pairs(materialise(held.select("tree", "parent", "child"), "held")))


def descendants(rows: DataFrame, tree: str, parent: str, child: str) -> DataFrame:
    """``tree, node, below``: every node in state ``tree`` with each of its descendants; see :func:`hierarchies`."""
    return _Placed(rows, tree, parent, child).pairs()


def hierarchies(rows: DataFrame, tree: str, parent: str, child: str, separator: str = " > ") -> DataFrame:
    """One row per node of each tree: ``tree, node, state, root, depth, path, n_descendants``.

    Nodes are all non-null parents and children, known by tree and exact text; a row whose parent is
    null only names a node, a repeated row counts once, an empty table gives no rows, rows with a
    null tree are left out.  ``state`` is ``tree``, ``cycle`` (on a loop, self-loops too) or ``below`` (not on
    one, but a loop is above).  Outside ``tree`` root and path are '' and depth and n_descendants -1.
    A node with several parents is placed on the level after its last parent, with the smallest path among
    its parents' paths; as a descendant it counts once for every node that some way leads from.
    """
    placed = _Placed(rows, tree, parent, child)
    counts = placed.pairs().groupBy("tree", "node").agg(F.count("*").alias("n_descendants"))
    tree_rows = placed.good.join(counts, _ON, "left").select(
        *_ON, F.lit("tree").alias("state"), F.col("path")[0].alias("root"), (F.size("path") - 1).cast("long").alias("depth"),
        F.array_join("path", separator).alias("path"), F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"),
    )
    rest = materialise(placed.nodes.join(placed.good, _ON, "left_anti"), "unreached")
    if rest.isEmpty():
        return tree_rows
    hung = placed.edges.join(rest.withColumnRenamed("node", "child"), ["tree", "child"], "left_semi").join(rest.withColumnRenamed("node", "parent"), ["tree", "parent"], "left_semi")
    loops = _loops(materialise(hung.select("tree", "parent", "child"), "unreached")).withColumn("on", F.lit(True))
    lost = rest.join(loops, _ON, "left").select(
        *_ON, _named(F.col("on"), "cycle", "below").alias("state"), F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"),
        F.lit("").alias("path"), F.lit(-1).cast("long").alias("n_descendants"),
    )
    return tree_rows.unionByName(lost)


def _named(flag: Column, yes: str, no: str) -> Column:
    return F.when(flag, yes).otherwise(no)
