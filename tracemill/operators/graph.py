"""The directly-follows graph: nodes, edges, ends, components, levels, filters.

Tables of the graph are of the size of the model (activities, edges), which may be
large where activities are, say, addresses; nothing here collects them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import seconds
from .metrics import _edges_shown, activity_base, transition_base


def start_end_activities(steps: DataFrame) -> DataFrame:
    """How many cases start and end with each activity."""
    ends = steps.select(F.explode(F.array_compact(F.array(
        F.when(F.col("pos") == 1, F.struct(F.lit("start").alias("kind"), "activity")), F.when(F.col("next_activity").isNull(), F.struct(F.lit("end").alias("kind"), "activity"))
    ))).alias("e"))
    return ends.groupBy("e.kind", "e.activity").agg(F.count("*").alias("case_count"))


def dfg_nodes(steps: DataFrame) -> DataFrame:
    ends = steps.groupBy("activity").agg(F.max(F.col("pos") == 1).alias("is_start"), F.max(F.col("next_activity").isNull()).alias("is_end"))
    return activity_base(steps).join(ends, "activity").select(
        "activity", "occurrence_count", "case_count", seconds("median_service").alias("median_service_seconds"), F.round("manual_share", 6).alias("manual_share"), "is_start", "is_end"
    )


def edge_pairs(transitions: DataFrame) -> DataFrame:
    """The distinct (source, target) of transitions."""
    return transitions.groupBy("source", "target").agg(F.count("*").alias("occurrence_count")).drop("occurrence_count")


#: Steps along edges that are planned at once, between two checkpoints.
STEPS = 3


def _settled(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df (node, value) after steps, each of which joins once, until no value changes."""
    df = df.checkpoint()
    while True:
        now = df
        for _ in range(STEPS):
            now = step(now)
        was = df.select(F.col("node").alias("old"), F.col("value").alias("was"))
        now = now.join(was, F.col("node") == F.col("old")).select("node", "value", (~F.col("value").eqNullSafe(F.col("was"))).alias("moved")).checkpoint()
        df = now.drop("moved")
        if now.where("moved").isEmpty():
            return df


def _pushed(values: DataFrame, edges: DataFrame, value: Column, best: Callable[[str], Column], choose: Callable[..., Column]) -> DataFrame:
    """Values (node, value) after one step: each node takes the best of what its in-edges (source, target) bring."""
    brought = values.join(edges, F.col("node") == F.col("source")).select("target", value.alias("offer")).groupBy("target").agg(best("offer").alias("offer"))
    return values.join(brought, F.col("node") == F.col("target"), "left").select("node", choose("value", "offer").alias("value"))


def _components(edges: DataFrame) -> DataFrame:
    """(activity, component) by Spark alone, for graphs of any size.

    By colours: each activity takes the least activity that reaches it, and the least that it
    reaches. Where both are one, it is in that one's component, which is done. Edges
    between activities of different colours are in no component, and what is left goes
    round again. Ends without an in-edge or an out-edge are left out before (trimmed). Tables
    hold no more rows than the graph has activities and edges, however much reaches what.
    """
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    left, done = edges.where("source <> target"), []
    while True:
        for _ in range(2):
            left = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            left = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        left = left.select("source", "target").checkpoint()
        if left.isEmpty():
            break
        own = left.select(F.col("source").alias("node")).union(left.select("target")).distinct().withColumn("value", F.col("node"))
        back = left.select(F.col("target").alias("source"), F.col("source").alias("target"))
        upper, lower = (_settled(own, lambda df, e=e: _pushed(df, e, F.col("value"), F.min, F.least)) for e in (left, back))
        colours = upper.withColumnRenamed("value", "above").join(lower.withColumnRenamed("value", "below"), "node").checkpoint()
        done.append(colours.where("above = below").select("node", F.col("above").alias("value")))
        rest = colours.where("above <> below").select("node", F.struct("above", "below").alias("colour"))
        source, target = (rest.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("source", "target"))
        left = left.join(source, "source").join(target, "target").where("source_colour = target_colour").select("source", "target")
    named = nodes.join(functools.reduce(DataFrame.union, done), "node", "left") if done else nodes.withColumn("value", F.col("node"))
    return named.select(F.col("node").alias("activity"), F.coalesce("value", "node").alias("component")).checkpoint()


def _levels(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Components (activity, component) with their level, by Spark alone."""
    of = lambda end: found.select(F.col("activity").alias(end), F.col("component").alias(f"{end}_of"))
    between = edges.join(of("source"), "source").join(of("target"), "target").where("source_of <> target_of")
    between = between.select(F.col("source_of").alias("source"), F.col("target_of").alias("target")).distinct().checkpoint()
    start = found.select(F.col("component").alias("node")).distinct().withColumn("value", F.lit(0).cast("long"))
    level = _settled(start, lambda df: _pushed(df, between, F.col("value") + 1, F.max, F.greatest))
    return found.join(level.select(F.col("node").alias("component"), F.col("value").alias("level")), "component").select("activity", "component", "level")


def solved(edges: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(activity, component, level) of a small graph: one walk in depth, with the components in the order in which they end."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    of: dict[str, int] = {}
    path, groups = [], []
    for root in after:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        path.append(root)
        walk = [(root, iter(after[root]))]
        while walk:
            at, rest = walk[-1]
            for to in rest:
                if to not in seen:
                    seen[to] = low[to] = len(seen)
                    path.append(to)
                    walk.append((to, iter(after[to])))
                    break
                if to not in of:
                    low[at] = min(low[at], seen[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[at])
                if low[at] == seen[at]:
                    group = []
                    while not group or group[-1] != at:
                        group.append(path.pop())
                        of[group[-1]] = len(groups)
                    groups.append(group)
    level = [0] * len(groups)
    for k in range(len(groups) - 1, -1, -1):  # the last to end is reached by none of those before
        for a in groups[k]:
            for b in after[a]:
                if of[b] != k:
                    level[of[b]] = max(level[of[b]], level[k] + 1)
    return [(a, min(group), level[k]) for k, group in enumerate(groups) for a in group]


#: Edges of a graph that one task takes (some 100 bytes each).
SMALL_GRAPH = 200_000


def levels(edges: DataFrame) -> DataFrame:
    """(activity, component, level) of all ends of edges (source, target).

    component: the strongly connected component, named by its least activity; level: the
    longest path to it from a component without predecessors. A graph of up to
    SMALL_GRAPH edges is walked by one task; larger ones go by rounds of joins.
    """
    edges = edges.select("source", "target").distinct().checkpoint()
    if edges.count() > SMALL_GRAPH:
        return _levels(edges, _components(edges))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = solved([pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["activity", "component", "level"])

    return edges.repartition(1).mapInArrow(walk, "activity string, component string, level long")


def components(edges: DataFrame) -> DataFrame:
    """(activity, component) of all ends of edges."""
    return levels(edges).drop("level")


def cyclic_activities(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Activities on cycles: in a component with others, or with an edge to themselves."""
    found = components(edges) if found is None else found
    several = found.groupBy("component").agg(F.count("*").alias("k")).where("k > 1")
    loops = edges.where("source = target").select(F.col("source").alias("activity"))
    return found.join(several, "component").select("activity").union(loops).distinct()


def map_nodes(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Nodes of a drawn map: where they stand, and whether most of their work is by hand."""
    return nodes.join(placed, "activity", "left").select(
        "activity", F.coalesce("component", "activity").alias("component"), F.coalesce("level", F.lit(0)).alias("level"), (F.col("manual_share") > 0.5).alias("is_manual")
    )


def map_edges(edges: DataFrame, placed: DataFrame, total_cases: DataFrame) -> DataFrame:
    """Edges of a drawn map: slow ones, width by share of cases, and whether they lead back or stay at a level."""
    level = lambda end: placed.select(F.col("activity").alias(end), F.col("level").alias(f"{end}_level"))
    back = edges.join(level("source"), "source").join(level("target"), "target").select("source", "target", (F.col("target_level") <= F.col("source_level")).alias("is_back"))
    return edge_render_flags(edges, total_cases).join(back, ["source", "target"])


def dfg_edges(transitions: DataFrame) -> DataFrame:
    """Edges; a loop edge has both ends on cycles, be they the same or not."""
    base = transition_base(transitions)
    on = cyclic_activities(edge_pairs(transitions))
    joined = base.join(on.select(F.col("activity").alias("source"), F.lit(True).alias("s")), "source", "left").join(on.select(F.col("activity").alias("target"), F.lit(True).alias("t")), "target", "left")
    return _edges_shown(joined.withColumn("is_loop_edge", F.col("s").isNotNull() & F.col("t").isNotNull()), "is_loop_edge")


def filter_edges(edges: DataFrame, total_cases: DataFrame, share: float) -> DataFrame:
    """Edges that at least this share of the cases has. total_cases: one row, n."""
    return edges.crossJoin(F.broadcast(total_cases)).where(F.col("case_count") >= share * F.col("n")).drop("n") if share > 0 else edges


def filter_nodes(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Nodes that a kept edge touches, or all where none is kept."""
    ends = kept.select(F.col("source").alias("activity")).union(kept.select(F.col("target").alias("activity"))).distinct()
    some = kept.agg(F.count("*").alias("k"))
    marked = nodes.join(ends.withColumn("touched", F.lit(True)), "activity", "left").crossJoin(F.broadcast(some))
    return marked.where("touched OR k = 0").drop("touched", "k")


def edge_render_flags(edges: DataFrame, total_cases: DataFrame) -> DataFrame:
    """How a map draws edges: slow ones, and width by share of cases."""
    top = edges.agg(F.max("median_wait_seconds").alias("m"))
    return edges.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(total_cases)).select(
        "source", "target", (F.col("median_wait_seconds") > 0.6 * F.col("m")).alias("is_slow"), F.round(1 + 4 * F.col("case_count") / F.col("n"), 6).alias("width")
    )
