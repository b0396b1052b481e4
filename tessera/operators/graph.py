"""Graph operators on edge tables (``src, dst``) as iterated joins.

Each round of a loop is a join and a pre-aggregated reduction over whole tables; its result is written to the checkpoint
folder, so lineage stays short and lost executors don't matter. Only counts reach the driver: joins in loops are merge joins,
as estimates of their sizes are too low for edges derived from a table, and a broadcast passes through the driver in each round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, without loops and repetitions."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    return both.where("src <> dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, neighbours``: sorted distinct successors; for vertices of bounded degree."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


#: Rounds whose results are kept apart before they are written as one.
ROUNDS_APART = 12


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _grown(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """Results of rounds with one more; they are rewritten as one only now and then, as rewriting in each round would cost rounds times rows."""
    return [*parts, new] if len(parts) < ROUNDS_APART else [cut(_all([*parts, new]))]


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``id, dist, parent`` of every vertex reached from the sources (``id``); the parent is the smallest one."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(sources.select("id").distinct().select("id", F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent")))
    rounds, frontier, depth = [seen], seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges.hint("merge"), F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        known = _all(rounds).select(F.col("id").alias("dst"))
        frontier = cut(step.join(known.hint("merge"), "dst", "left_anti").select(F.col("dst").alias("id"), F.lit(depth).alias("dist"), "parent"))
        if frontier.isEmpty():
            break
        rounds = _grown(rounds, frontier)
    return _all(rounds)


def k_hop(edges: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Vertices at exactly ``k`` hops."""
    return bfs(edges, sources, k).where(F.col("dist") == k).select("id")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``id, component``: the smallest id reachable, directions ignored; by minima and pointer jumping."""
    both = cut(undirected(edges))
    ids = vertices(edges) if nodes is None else nodes.select("id").union(vertices(edges)).distinct()
    label = cut(ids.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.hint("merge"), F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("m"))
        moved = label.join(near.hint("merge"), F.col("id") == F.col("src"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("c"), "component")
        moved = cut(moved)
        jump = moved.select(F.col("id").alias("c"), F.col("c").alias("root"))
        after = cut(moved.join(jump.hint("merge"), "c", "left").select("id", F.least("c", F.coalesce("root", "c")).alias("component"), (F.col("c") != F.col("component")).alias("changed")))
        label = after.select("id", "component")
        if after.where("changed").isEmpty():
            return label


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of strongly connected components (the smallest id in each), by forward-backward colouring.

    Each round colours vertices by the smallest id that reaches them; those that can reach their colour's vertex back
    form its component and leave the graph.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    remaining = cut(vertices(edges))
    done = None
    while not remaining.isEmpty():
        color = cut(remaining.select("id", F.col("id").alias("color")))
        while True:
            inbound = left.join(color.hint("merge"), F.col("src") == F.col("id")).groupBy("dst").agg(F.min("color").alias("m"))
            after = color.join(inbound.hint("merge"), F.col("id") == F.col("dst"), "left").select("id", F.least("color", F.coalesce("m", "color")).alias("color"), (F.col("m") < F.col("color")).alias("ch"))
            after = cut(after)
            color = after.select("id", "color")
            if after.where("ch").isEmpty():
                break
        a, b = color.select(F.col("id").alias("src"), F.col("color").alias("cs")), color.select(F.col("id").alias("dst"), F.col("color").alias("cd"))
        inner = cut(left.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("color")))
        reach = cut(color.where("id = color"))
        frontier = reach
        while True:
            back = frontier.select(F.col("id").alias("dst"), "color").join(inner.hint("merge"), ["dst", "color"]).select(F.col("src").alias("id"), "color").distinct()
            frontier = cut(back.join(reach.hint("merge"), ["id", "color"], "left_anti"))
            if frontier.isEmpty():
                break
            reach = cut(reach.union(frontier))
        found = reach.select("id", F.col("color").alias("component"))
        done = found if done is None else cut(done.union(found))
        remaining = cut(remaining.join(found.hint("merge"), "id", "left_anti"))
        left = cut(left.join(remaining.select(F.col("id").alias("src")).hint("merge"), "src", "left_semi").join(remaining.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_semi"))
    return done if done is not None else vertices(edges).select("id", F.col("id").alias("component"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, sources: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """``id, rank``, summing to 1. Mass of vertices without edges out is dealt out like the restart.

    ``sources`` (``id``) personalises the restart; ``weight`` names a column of edge weights.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = cut(e.join(out.hint("merge"), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    ids = vertices(edges)
    restart = ids.join(sources.select("id").distinct().withColumn("s", F.lit(1.0)).hint("merge"), "id", "left").fillna(0.0, ["s"]) if sources is not None else ids.withColumn("s", F.lit(1.0))
    total = restart.agg(F.sum("s")).first()[0]
    if not total:
        return ids.withColumn("rank", F.lit(0.0))
    leads = e.where("p IS NOT NULL").select(F.col("src").alias("id"), F.lit(True).alias("leads")).distinct()
    restart = restart.join(leads.hint("merge"), "id", "left").select("id", (F.col("s") / total).alias("s"), F.col("leads").isNull().alias("dead"))
    rank = cut(restart.select("id", F.col("s").alias("rank"), "s", "dead"))
    held = F.coalesce(F.sum(F.when(F.col("dead"), F.col("rank"))), F.lit(0.0)).alias("lost")  # by vertices without edges out
    lost = rank.agg(held).first()["lost"]
    for _ in range(max_iter):
        flow = rank.join(e.hint("merge"), F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("f"))
        new = rank.join(flow.hint("merge"), F.col("id") == F.col("dst"), "left").select("id", "s", "dead", F.col("rank").alias("old"), ((1 - damping) * F.col("s") + damping * (F.coalesce("f", F.lit(0.0)) + lost * F.col("s"))).alias("rank"))
        new = cut(new)
        change, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), held).first()
        rank = new.select("id", "rank", "s", "dead")
        if change < tol:
            break
    return rank.select("id", "rank")


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str | None = None) -> DataFrame:
    """``id, dist, parent`` from the nearest source by relaxation; negative weights raise, unreached vertices are absent."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = cut(edges.groupBy("src", "dst").agg(F.min(w).alias("w")))
    if not e.where("w < 0").isEmpty():
        raise ValueError("negative edge weight")
    best = cut(sources.select("id").distinct().select("id", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent")))
    frontier = best
    while True:
        reach = frontier.join(e.hint("merge"), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("parent"))
        both = best.withColumn("old", F.lit(True)).unionByName(reach.withColumn("old", F.lit(False)))
        after = cut(both.groupBy("id").agg(F.min(F.struct("dist", ~F.col("old"), "parent")).alias("b"), F.min(F.when(F.col("old"), F.col("dist"))).alias("was")))
        best = after.select("id", F.col("b.dist").alias("dist"), F.col("b.parent").alias("parent"))
        frontier = after.where("was IS NULL OR b.dist < was").select("id", F.col("b.dist").alias("dist"))
        if frontier.isEmpty():
            return best


def topological_levels(edges: DataFrame) -> DataFrame:
    """``id, level`` by peeling vertices without edges in; vertices on or behind a cycle raise ValueError."""
    left, remaining, done, level = cut(edges.select("src", "dst").distinct()), cut(vertices(edges)), None, 0
    while not remaining.isEmpty():
        free = cut(remaining.join(left.select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else cut(done.union(free))
        remaining = cut(remaining.join(free.hint("merge"), "id", "left_anti"))
        left = cut(left.join(free.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti"))
        level += 1
    return done


def has_cycle(edges: DataFrame) -> bool:
    try:
        topological_levels(edges)
    except ValueError:
        return True
    return False


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c``: each triangle once. Edges point to the vertex of higher degree, which bounds the lists of hubs.

    The heads of both ends of an edge are intersected as lists, so the pairs of a vertex's edges are never rows of a shuffle.
    """
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    e = both.join(degree.hint("merge"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")).hint("merge"), "dst")
    e = e.where("d < d2 OR (d = d2 AND src < dst)")
    heads = cut(e.groupBy("src").agg(F.collect_list("dst").alias("zs")))
    tails = heads.select(F.col("src").alias("x"), F.col("zs").alias("xs"), F.explode("zs").alias("y"))
    both_ends = tails.join(heads.select(F.col("src").alias("y"), "zs").hint("merge"), "y")
    closed = both_ends.select("x", "y", F.explode(F.array_intersect("xs", "zs")).alias("z"))
    abc = F.array_sort(F.array("x", "y", "z"))
    return closed.select(abc[0].alias("a"), abc[1].alias("b"), abc[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """``id, triangles, coefficient`` of each vertex: triangles over d (d - 1) / 2."""
    both = undirected(edges)
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    per = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    t = F.coalesce("t", F.lit(0))
    return degree.join(per, "id", "left").select("id", t.alias("triangles"), F.when(F.col("d") > 1, 2 * t / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("coefficient"))


def _shortest_edges(edges: DataFrame, sources: DataFrame | None, weight: str | None) -> tuple[DataFrame, DataFrame]:
    """Edges on shortest paths with their number of paths (``s, u, v, x, y``: paths to u and to v), and ``s, id, paths``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = cut(edges.where("src <> dst").groupBy("src", "dst").agg(F.min(w).alias("w")))
    if not e.where("w <= 0").isEmpty():
        raise ValueError("edge weights must be positive")
    far = all_pairs(e, sources, "w").select("start", "finish", "dist")
    tail = far.select(F.col("start").alias("s"), F.col("finish").alias("u"), F.col("dist").alias("du"))
    head = far.select(F.col("start").alias("s"), F.col("finish").alias("v"), F.col("dist").alias("dv"))
    on = cut(tail.join(e.hint("merge"), F.col("u") == F.col("src")).select("s", "u", F.col("dst").alias("v"), (F.col("du") + F.col("w")).alias("dv")).join(head.hint("merge"), ["s", "v", "dv"]).select("s", "u", "v"))
    # Paths of k edges in round k; their sum is the number of paths.
    front = cut(far.where("start = finish").select(F.col("start").alias("s"), F.col("finish").alias("id"), F.lit(1.0).alias("paths")))
    rounds = [front]
    while not front.isEmpty():
        step = front.withColumnRenamed("id", "u").join(on.hint("merge"), ["s", "u"]).groupBy("s", F.col("v").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut(step)
        rounds = _grown(rounds, front)
    paths = cut(_all(rounds).groupBy("s", "id").agg(F.sum("paths").alias("paths")))
    both = on.join(paths.select("s", F.col("id").alias("u"), F.col("paths").alias("x")).hint("merge"), ["s", "u"])
    return cut(both.join(paths.select("s", F.col("id").alias("v"), F.col("paths").alias("y")).hint("merge"), ["s", "v"]).select("s", "u", "v", "x", "y")), paths


def _dependencies(on: DataFrame) -> DataFrame:
    """``s, id, d``: how much of the shortest paths from s runs on through a vertex. Round k holds the share of paths k edges on."""
    front = cut(on.groupBy("s", F.col("u").alias("id")).agg(F.sum(F.col("x") / F.col("y")).alias("d")))
    rounds = [front]
    while not front.isEmpty():
        ahead = front.select("s", F.col("id").alias("v"), "d")
        front = cut(on.join(ahead.hint("merge"), ["s", "v"]).groupBy("s", F.col("u").alias("id")).agg(F.sum(F.col("x") / F.col("y") * F.col("d")).alias("d")))
        rounds = _grown(rounds, front)
    return _all(rounds).groupBy("s", "id").agg(F.sum("d").alias("d"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, weight: str | None = None, normalised: bool = False) -> DataFrame:
    """``id, score``: the share of shortest paths through each vertex, by Brandes' dependencies of all sources at once.

    State is one row for each source and reached vertex: without ``sources`` all vertices are, for the exact score; a set of pivots estimates it.
    ``normalised`` divides by the number of pairs of other vertices.
    """
    ids = vertices(edges)
    on, _ = _shortest_edges(edges, sources, weight)
    score = _dependencies(on).where("s <> id").groupBy("id").agg(F.sum("d").alias("score"))
    out = ids.join(score.hint("merge"), "id", "left").fillna(0.0, ["score"])
    if normalised:
        n = ids.count()
        out = out.withColumn("score", F.col("score") / F.lit(float(max(1, (n - 1) * (n - 2)))))
    return out


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """``src, dst, score``: the share of shortest paths through each edge."""
    on, _ = _shortest_edges(edges, sources, weight)
    beyond = _dependencies(on).select("s", F.col("id").alias("v"), "d")
    score = on.join(beyond.hint("merge"), ["s", "v"], "left").groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(
        F.sum(F.col("x") / F.col("y") * (1 + F.coalesce("d", F.lit(0.0)))).alias("score"))
    return edges.select("src", "dst").where("src <> dst").distinct().join(score.hint("merge"), ["src", "dst"], "left").fillna(0.0, ["score"])


def all_pairs(edges: DataFrame, sources: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """``start, finish, dist`` of every pair joined by a path, each vertex with itself at 0; negative weights raise.

    State is one row for each pair; ``sources`` (``id``) restricts the starts.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = cut(edges.groupBy("src", "dst").agg(F.min(w).alias("w")))
    if not e.where("w < 0").isEmpty():
        raise ValueError("negative edge weight")
    ids = vertices(edges) if sources is None else sources.select("id").distinct()
    best = cut(ids.select(F.col("id").alias("start"), F.col("id").alias("finish"), F.lit(0.0).alias("dist")))
    frontier = best
    while True:
        reach = frontier.join(e.hint("merge"), F.col("finish") == F.col("src")).groupBy("start", F.col("dst").alias("finish")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        after = cut(best.join(reach.hint("merge"), ["start", "finish"], "full").select("start", "finish", F.least("dist", "new").alias("dist"),
                                                                      (F.col("dist").isNull() | (F.col("new") < F.col("dist"))).alias("better")))
        best, frontier = after.select("start", "finish", "dist"), after.where("better").select("start", "finish", "dist")
        if frontier.isEmpty():
            return best


def a_star(edges: DataFrame, source: int, goal: int, left: Column, weight: str | None = None) -> DataFrame:
    """``id, dist, parent`` of what a search for the goal settles; the goal's row, if it is reached, has the exact distance.

    ``left`` bounds the distance from a vertex (column ``id``) to the goal from below. A round relaxes the whole frontier; vertices whose
    distance and bound exceed the best distance to the goal so far are searched no further.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = cut(edges.groupBy("src", "dst").agg(F.min(w).alias("w")))
    if not e.where("w < 0").isEmpty():
        raise ValueError("negative edge weight")
    best = cut(edges.sparkSession.createDataFrame([(source, 0.0, None)], "id long, dist double, parent long"))
    frontier, least = best.select("id", "dist"), float("inf")
    while True:
        reach = frontier.where(F.col("dist") + left <= least).join(e.hint("merge"), F.col("id") == F.col("src"))
        reach = reach.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("parent"))).alias("n"))
        better = F.col("dist").isNull() | (F.col("n.dist") < F.col("dist"))
        after = cut(best.join(reach.hint("merge"), "id", "full").select("id", F.when(better, F.col("n.dist")).otherwise(F.col("dist")).alias("dist"),
                                                          F.when(better, F.col("n.parent")).otherwise(F.col("parent")).alias("parent"), better.alias("better")))
        best, frontier = after.select("id", "dist", "parent"), after.where("better").select("id", "dist")
        found = best.where(F.col("id") == goal).first()
        least = found["dist"] if found else least
        if frontier.isEmpty():
            return best


def match_path(edges: DataFrame, names: Sequence[str], where: Sequence[Column | None] | None = None, labels: Sequence[str | None] | None = None) -> DataFrame:
    """Bindings of a chain of edges: one column per vertex in ``names``. ``labels`` restricts each step's ``label``;
    ``where`` gives conditions on the names bound so far."""
    out = None
    for i in range(len(names) - 1):
        step = edges.where(F.col("label") == labels[i]) if labels and labels[i] else edges
        step = step.select(F.col("src").alias(names[i]), F.col("dst").alias(names[i + 1]))
        out = step if out is None else out.join(step, names[i])
        if where and where[i] is not None:
            out = out.where(where[i])
    return out.select(*names)


def diamonds(edges: DataFrame) -> DataFrame:
    """``a, b, c, d`` with edges a-b, a-c, b-d and c-d, and b before c: two-edge paths joined on both of their ends."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    two = e.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), F.col("dst").alias("d")), "m")
    return two.withColumnRenamed("m", "b").join(two.withColumnRenamed("m", "c"), ["a", "d"]).where("b < c").select("a", "b", "c", "d")


def variable_paths(edges: DataFrame, sources: DataFrame, low: int, high: int) -> DataFrame:
    """``start, finish, hops, path`` of simple paths of ``low`` to ``high`` edges from the sources."""
    e = edges.select("src", "dst").distinct()
    front = sources.select(F.col("id").alias("start"), F.col("id").alias("finish"), F.lit(0).alias("hops"), F.array("id").alias("path"))
    found = [front] if low == 0 else []
    for hop in range(1, high + 1):
        front = front.join(e, (F.col("finish") == F.col("src")) & ~F.array_contains("path", F.col("dst")))
        front = front.select("start", F.col("dst").alias("finish"), F.lit(hop).alias("hops"), F.concat("path", F.array("dst")).alias("path"))
        if hop >= low:
            found.append(front)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def closure(edges: DataFrame, sources: DataFrame | None = None, low: int = 1, high: int | None = None, keep_start: bool = False) -> DataFrame:
    """``start, finish, dist``: pairs joined by a path, with the fewest hops, between ``low`` and ``high``.

    The start itself comes with ``low`` 0, and for cycles only with ``keep_start``.
    """
    e = cut(edges.select("src", "dst").distinct())
    starts = (vertices(edges) if sources is None else sources.select("id").distinct()).select(F.col("id").alias("start"))
    seen = cut(starts.select("start", F.col("start").alias("finish"), F.lit(0).alias("dist"), F.lit(True).alias("own")))
    frontier, depth = seen, 0
    while high is None or depth < high:
        depth += 1
        step = frontier.join(e.hint("merge"), F.col("finish") == F.col("src")).select("start", F.col("dst").alias("finish")).distinct()
        step = step.where("start <> finish") if not keep_start else step
        old = seen.where("NOT own").select("start", "finish") if keep_start else seen.select("start", "finish")
        frontier = cut(step.join(old.hint("merge"), ["start", "finish"], "left_anti").select("start", "finish", F.lit(depth).alias("dist"), F.lit(False).alias("own")))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    out = seen if low == 0 else seen.where("NOT own")
    return out.where(F.col("dist") >= low).select("start", "finish", "dist")
