"""Operators on property graphs: tables of nodes (node_id, ...) and edges (source_id, target_id, ...).

Walks advance by one shuffle join for each level. Each level's front is written into the folder of
``spark.checkpoint.dir``, and what has been visited every few levels, so that plans stay short and a
lost executor costs no more than the level under way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .ranks import within


def kept(df: DataFrame) -> DataFrame:
    """Written into the shared folder and read back: later steps depend on the files alone."""
    return cut(df, "kept")


def reached(edges: DataFrame, starts: DataFrame, depth: int = 0, reverse: bool = False) -> DataFrame:
    """(start_id, node_id, depth): nodes within depth edges of each start, with the least depth; 0 is no limit.

    Start nodes have depth 0. Downstream follows edges from source to target, upstream (reverse) the other way.
    """
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    steps = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
    visited = kept(starts.select(F.col("node_id").alias("start_id"), "node_id").distinct().withColumn("depth", F.lit(0)))
    front, level = visited, 0
    while not depth or level < depth:
        level += 1
        found = front.join(steps, front["node_id"] == steps["_from"]).select("start_id", F.col("_to").alias("node_id")).distinct()
        front = kept(found.join(visited, ["start_id", "node_id"], "left_anti").withColumn("depth", F.lit(level)))
        if not front.limit(1).count():
            break
        visited = kept(visited.unionByName(front)) if level % 4 == 0 else visited.unionByName(front)
    return visited


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes up- and downstream of the starts, and the edges among them."""
    nodes = reached(edges, starts, depth).unionByName(reached(edges, starts, depth, reverse=True)).select("node_id").distinct()
    inside = edges.join(nodes.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(nodes.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return nodes, inside


def containment(levels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Edges from each parent to its child, from (table, parent column, child column) for each level."""
    out = None
    for df, parent, child in levels:
        e = df.select(F.col(parent).cast("string").alias("source_id"), F.col(child).cast("string").alias("target_id")).distinct()
        out = e if out is None else out.unionByName(e)
    return out


def rolled_up(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between the groups of their ends: of is (node_id, group). With the number of edges; none within a group."""
    s = of.select(F.col("node_id").alias("source_id"), F.col("group").alias("source_group"))
    t = of.select(F.col("node_id").alias("target_id"), F.col("group").alias("target_group"))
    return edges.join(s, "source_id").join(t, "target_id").filter("source_group <> target_group").groupBy("source_group", "target_group").agg(F.count(F.lit(1)).alias("n"))


def _runs(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Nodes with one edge in and one out, no loops: (v, p, s) of runs from p to s, and (v, least) of rings that consist of such nodes alone.

    Each node points to the next one of its run; the table is joined to itself, so distances double, until
    all point to the run's last node. What still moves after as many rounds as the count allows is a ring.
    """
    loops = edges.filter("source_id = target_id").select(F.col("source_id").alias("v")).distinct()
    into = edges.groupBy(F.col("target_id").alias("v")).agg(F.count(F.lit(1)).alias("_in"), F.first("source_id").alias("p")).filter("_in = 1").drop("_in")
    out = edges.groupBy(F.col("source_id").alias("v")).agg(F.count(F.lit(1)).alias("_out"), F.first("target_id").alias("s")).filter("_out = 1").drop("_out")
    through = kept(into.join(out, "v").join(loops, "v", "left_anti"))
    n = through.count()
    if not n:
        return None
    following = through.select(F.col("v").alias("s"), F.lit(True).alias("_more"))
    to = kept(through.join(following, "s", "left").select("v", F.when(F.col("_more"), F.col("s")).otherwise(F.col("v")).alias("to"), F.col("v").alias("least")))
    for _ in range(n.bit_length()):
        far = to.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        moved = kept(to.join(far, "to").select("v", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("_to") != F.col("to")).alias("_moved")))
        to = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            break
    last = through.join(following, "s", "left_anti").select(F.col("v").alias("to"), "s")
    first = through.select("v", "p").join(through.select(F.col("v").alias("p")), "p", "left_anti")
    heads = first.join(to, "v").select("to", "p")
    runs = kept(to.select("v", "to").join(last, "to").join(heads, "to").select("v", "p", "s"))
    rings = kept(to.join(last, "to", "left_anti").select("v", "least"))
    return runs, rings


def peeled(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """What is left of (source_id, target_id) when nodes without edges in or without edges out go again and again.

    Runs of nodes with one edge in and one out are replaced by one edge, so chains and trees take
    rounds by the logarithm of their length. Also the runs of each round (v, p, s), whose nodes
    share the fate of that edge, and rings (v, least) that consist of such nodes alone.
    """
    rest, runs, rings = kept(edges.select("source_id", "target_id").distinct()), [], []
    n = rest.count()
    while n:
        found = _runs(rest)
        if found:
            runs.append(found[0])
            rings.append(found[1])
            gone = found[0].select("v").unionByName(found[1].select("v"))
            short = found[0].select(F.col("p").alias("source_id"), F.col("s").alias("target_id")).distinct()
            rest = without_nodes(gone.select(F.col("v").alias("node_id")), rest, gone.select(F.col("v").alias("node_id")))[1].unionByName(short).distinct()
        less = rest.join(rest.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi")
        less = kept(less.join(rest.select(F.col("source_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id"))
        m = less.count()
        rest = less
        if m == n:
            break
        n = m
    every = None
    for r in rings:
        every = r if every is None else every.unionByName(r)
    return rest, runs, every


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or between cycles: what is left when nodes without incoming or without outgoing edges are removed again and again."""
    rest, runs, rings = peeled(edges)
    nodes = rest.select(F.col("source_id").alias("node_id")).unionByName(rest.select(F.col("target_id").alias("node_id"))).distinct()
    if rings is not None:  # runs of earlier rounds may end in a ring
        nodes = nodes.unionByName(rings.select(F.col("v").alias("node_id")))
    for r in reversed(runs):
        ends = r.join(nodes.withColumnRenamed("node_id", "p"), "p", "left_semi").join(nodes.withColumnRenamed("node_id", "s"), "s", "left_semi")
        nodes = kept(nodes.unionByName(ends.select(F.col("v").alias("node_id"))))
    return nodes


def _coloured(edges: DataFrame) -> DataFrame:
    """(v, colour): the greatest node that reaches each node, by passing on what has changed."""
    colours = kept(edges.select(F.col("source_id").alias("v")).unionByName(edges.select(F.col("target_id").alias("v"))).distinct().withColumn("colour", F.col("v")))
    front = colours
    while front.limit(1).count():
        sent = front.join(edges, F.col("v") == F.col("source_id")).groupBy("target_id").agg(F.max("colour").alias("_new"))
        both = kept(colours.join(sent, F.col("v") == F.col("target_id"), "left").select("v", F.greatest("colour", "_new").alias("colour"), (F.coalesce("_new", "colour") > F.col("colour")).alias("_changed")))
        colours, front = both.drop("_changed"), both.filter("_changed").drop("_changed")
    return colours


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node of each node's strongly connected component, for components of two nodes or more.

    The graph is peeled, which costs chains and trees rounds by the logarithm of their length. Of
    what is left each node gets the greatest node that reaches it as its colour; the nodes of a colour that
    reach the node it is named for are a component. The rest is peeled and coloured again. Rounds of
    colouring grow with the longest shortest path among what peeling leaves.
    """
    rest, layers = edges.filter("source_id <> target_id"), []
    found = None
    while True:
        rest, runs, rings = peeled(rest)
        layers.append(runs)
        parts = [] if rings is None else [rings.select(F.col("v").alias("node_id"), F.col("least").alias("colour"))]
        more = rest.limit(1).count()
        if more:
            colours = _coloured(rest)
            inside = rest.join(colours.select(F.col("v").alias("source_id"), F.col("colour").alias("_a")), "source_id").join(colours.select(F.col("v").alias("target_id"), F.col("colour").alias("_b")), "target_id").filter("_a = _b")
            inside = kept(inside.select("source_id", "target_id"))
            roots = colours.filter("v = colour").select(F.col("v").alias("node_id"), "colour")
            reached_back, front = kept(roots), roots
            while True:
                back = front.join(inside, F.col("node_id") == F.col("target_id")).select(F.col("source_id").alias("node_id"), "colour").distinct()
                front = kept(back.join(reached_back, "node_id", "left_anti"))
                if not front.limit(1).count():
                    break
                reached_back = kept(reached_back.unionByName(front))
            parts.append(reached_back)
        for p in parts:
            found = p if found is None else found.unionByName(p)
        if not more:
            break
        found = kept(found)
        rest = without_nodes(found, rest, found.select("node_id"))[1]
    if found is None:
        return edges.select(F.col("source_id").alias("node_id"), F.col("source_id").alias("component")).filter("false")
    # A run belongs to the component that both of its ends are in; runs of later rounds come first.
    for runs in reversed(layers):
        for r in reversed(runs):
            at = r.join(found.select(F.col("node_id").alias("p"), "colour"), "p").join(found.select(F.col("node_id").alias("s"), F.col("colour").alias("_other")), "s")
            found = kept(found.unionByName(at.filter("colour = _other").select(F.col("v").alias("node_id"), "colour")))
    named = found.groupBy("colour").agg(F.min("node_id").alias("component"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return found.join(named, "colour").select("node_id", "component")


def closes_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate edges (source_id, target_id) with whether they would close a cycle: the source is reached from the target.

    Components of the edges and all candidates together say no where the ends are in different ones;
    components of the edges alone say yes where the ends are in the same. Only for the others walks
    are made, over condensed edges inside one component of the first kind, and a walk ends when its
    sources are found. A loop closes a cycle, as a node reaches itself.
    """
    ends = candidates.select("source_id", "target_id").distinct()
    edges = edges.select("source_id", "target_id").distinct()
    both = lambda df, of, name: df.join(of.select(F.col("node_id").alias("source_id"), F.col("component").alias(f"{name}_s")), "source_id", "left").join(of.select(F.col("node_id").alias("target_id"), F.col("component").alias(f"{name}_t")), "target_id", "left")
    possible = kept(components(edges.unionByName(ends)))
    inside = kept(both(edges, possible, "h").filter("h_s = h_t").select("source_id", "target_id"))
    own = kept(components(inside))
    asked = kept(both(both(ends, possible, "h"), own, "g"))
    a, b = F.coalesce("g_s", "source_id"), F.coalesce("g_t", "target_id")
    verdict = F.when(F.col("source_id") == F.col("target_id"), True).when(~F.coalesce(F.col("h_s") == F.col("h_t"), F.lit(False)), False).when(a == b, True)
    asked = kept(asked.select("source_id", "target_id", a.alias("a"), b.alias("b"), verdict.alias("closes")))
    open_ = kept(asked.filter("closes IS NULL").select(F.col("b").alias("start_id"), F.col("a").alias("wanted")).distinct())
    hits = None
    if open_.limit(1).count():
        condensed = both(inside, own, "g").select(a.alias("_from"), b.alias("_to")).filter("_from <> _to").distinct()
        condensed = kept(condensed)
        front = visited = kept(open_.select("start_id", F.col("start_id").alias("node_id")).distinct())
        while front.limit(1).count():
            found = front.join(condensed, front["node_id"] == condensed["_from"]).select("start_id", F.col("_to").alias("node_id")).distinct()
            front = kept(found.join(visited, ["start_id", "node_id"], "left_anti"))
            hit = kept(open_.join(front, (open_["start_id"] == front["start_id"]) & (F.col("wanted") == F.col("node_id")), "left_semi"))
            hits = hit if hits is None else hits.unionByName(hit)
            open_ = kept(open_.join(hit, ["start_id", "wanted"], "left_anti"))
            front = kept(front.join(open_.select("start_id").distinct(), "start_id", "left_semi"))
            visited = kept(visited.unionByName(front))
    if hits is not None:
        hits = hits.select(F.col("start_id").alias("b"), F.col("wanted").alias("a"), F.lit(True).alias("_hit"))
        asked = asked.join(hits, ["a", "b"], "left").withColumn("closes", F.coalesce("closes", "_hit"))
    known = asked.select("source_id", "target_id", F.coalesce("closes", F.lit(False)).alias("closes"))
    return candidates.join(known, ["source_id", "target_id"], "left").withColumn("closes", F.coalesce("closes", F.lit(False)))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its targets in order, joined by commas; empty without any. For nodes of very many targets see ``adjacency_blocks``."""
    lists = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("targets"))
    return nodes.select("node_id").distinct().join(lists, "node_id", "left").withColumn("targets", F.coalesce("targets", F.lit("")))


def adjacency_blocks(edges: DataFrame, size: int = 1024) -> DataFrame:
    """(node_id, block, targets): each node's targets in order, in lists of at most ``size``; a node with a third of all edges is many lists."""
    e = edges.select(F.col("source_id").alias("node_id"), "target_id").distinct()
    placed = within(e, ["node_id"], F.col("target_id"))
    lists = placed.groupBy("node_id", F.floor(F.col("place") / size).alias("block")).agg(F.array_sort(F.collect_list("target_id")).alias("targets"))
    return lists


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes and their edges."""
    ids = gone.select("node_id").distinct()
    left = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), left
