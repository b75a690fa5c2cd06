"""Cell dependency graph: edges, reachability, cycles.

Graphs are edge tables ``(workbook_id, src, dst)``; every loop moves all
workbooks forward together and joins on (workbook_id, node), so a huge workbook
is spread over many tasks like any other set of keys. Unbranched stretches, such as
a running balance, are contracted to single edges by pointer jumping, so the loops
take as many rounds as there are branchings on a path, not cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.addresses import a1, node_key, ref_col, ref_row, reference_parts, reference_texts
from ledgerloom.operators import ranges, whole
from ledgerloom.session import cut

EDGE = ["workbook_id", "src", "dst"]
NODE = ["workbook_id", "node"]


def with_rectangle(refs: DataFrame) -> DataFrame:
    """Add c1..c2 and r1..r2 (sorted) and the area of ``start``:``end``."""
    first, last = F.col("start"), F.coalesce("end", "start")
    return (
        refs.withColumns(
            {"_ca": ref_col(first), "_cb": ref_col(last), "_ra": ref_row(first), "_rb": ref_row(last)}
        )
        .withColumns(
            {
                "c1": F.least("_ca", "_cb"), "c2": F.greatest("_ca", "_cb"),
                "r1": F.least("_ra", "_rb"), "r2": F.greatest("_ra", "_rb"),
            }
        )
        .withColumn(
            "area",
            (F.col("c2") - F.col("c1") + 1).cast("bigint") * (F.col("r2") - F.col("r1") + 1),
        )
        .drop("_ca", "_cb", "_ra", "_rb")
    )


def references(cells: DataFrame, tabs: DataFrame | None = None) -> DataFrame:
    """One row per reference in a formula, in order: start, end (ranges), dst_tab.

    ``tabs`` (workbook_id, tab_name, tab_key) is needed only where repeated tab
    names were given new keys; without it a sheet name is its own key.
    """
    refs = cells.filter("formula is not null").select(
        "workbook_id",
        F.col("node").alias("src"),
        "tab_key",
        F.posexplode(reference_texts(F.col("formula"))).alias("ref_no", "_text"),
    )
    sheet, first, last = reference_parts(F.col("_text"))
    refs = refs.select(
        "workbook_id", "src", "tab_key", "ref_no",
        sheet.alias("sheet"), first.alias("start"), last.alias("end"),
    )
    if tabs is not None:
        keys = tabs.groupBy("workbook_id", F.col("tab_name").alias("sheet")).agg(
            F.max_by("tab_key", "tab_index").alias("_key")
        )
        refs = refs.join(keys, ["workbook_id", "sheet"], "left").withColumn(
            "sheet", F.coalesce("_key", "sheet")
        ).drop("_key")
    return refs.withColumn("dst_tab", F.coalesce("sheet", "tab_key")).drop("sheet", "tab_key")


def rectangles(cells: DataFrame, tabs: DataFrame | None = None) -> DataFrame:
    """(workbook_id, src, dst_tab, c1, c2, r1, r2): what each formula refers to, as rectangles."""
    return with_rectangle(references(cells, tabs)).select("workbook_id", "src", "dst_tab", "c1", "c2", "r1", "r2")


def placed(cells: DataFrame, *columns: str) -> DataFrame:
    """Cells as rectangles meet them: workbook_id, dst_tab, col, row and ``columns``."""
    return cells.select("workbook_id", F.col("tab_key").alias("dst_tab"), "col", "row", *columns)


def cell_edges(cells: DataFrame, tabs: DataFrame | None = None) -> DataFrame:
    """Formula cell to each cell it refers to, blank ones too, without repeats.

    Rectangles stay rectangles until here: merged per formula and column they are
    disjoint, so listing their cells needs no look for repeats.
    """
    covered = ranges.merged(rectangles(cells, tabs), ["workbook_id", "src"])
    return covered.withColumn("_row", F.explode(F.sequence("r1", "r2"))).select(
        "workbook_id", "src", node_key(F.col("dst_tab"), a1(F.col("col"), F.col("_row"))).alias("dst"))


def formula_cells(cells: DataFrame) -> DataFrame:
    """The formulas, with the columns that ``formula_edges`` reads."""
    return cells.filter("formula is not null").select("workbook_id", "tab_key", "col", "row", "node", "formula")


def formula_edges(cells: DataFrame, tabs: DataFrame | None = None, rects: DataFrame | None = None) -> DataFrame:
    """Formula cell to each formula cell it refers to: all that chains and cycles run along.

    Workbooks that a task can hold are looked through whole; in larger ones rectangles
    meet cells block by block.
    """
    formulas = cells.filter("formula is not null")
    to = placed(formulas, F.col("node").alias("dst"))
    if tabs is not None or rects is not None:
        rects = rectangles(cells, tabs) if rects is None else rects
        return ranges.meet(rects, to).select(*EDGE).distinct()
    # a reference has two signs at least
    large = whole.larger(formulas, 1 + F.length("formula") / 2)
    found = whole.formula_edges(formulas.select("workbook_id", "tab_key", "col", "row", "node", "formula"), large)
    if large.isEmpty():
        return found
    own = lambda df: df.join(F.broadcast(large), "workbook_id", "left_semi")
    return found.unionByName(ranges.meet(rectangles(own(formulas)), own(to)).select(*EDGE).distinct())


# -- contraction ---------------------------------------------------------------


class Contracted:
    """A graph whose unbranched stretches are single edges.

    ``edges``: workbook_id, src, dst, steps, and ``stretch`` (null for a plain edge).
    ``inside``: workbook_id, node, stretch, left, exit: the steps from the node to
    the node where its stretch ends. Every node is on an edge or inside one stretch.
    """

    def __init__(self, edges: DataFrame, inside: DataFrame | None = None) -> None:
        self.edges, self.inside = edges, inside


def contracted(edges: DataFrame) -> Contracted:
    """Contract the paths of nodes that have one way in and one way out.

    Each such node points at the next one; pointers double until they reach the
    last node of their path, which names the stretch. Where they never do, the path
    is a ring by itself and opens at its largest node, which stays a node.
    """
    edges = edges.select(*EDGE)
    ways = edges.select("workbook_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select("workbook_id", F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    inner = ways.groupBy(*NODE).agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 and i = 1").select(*NODE)
    nexts = edges.filter("src != dst").withColumnRenamed("src", "node").join(inner, NODE, "left_semi").withColumnRenamed("dst", "to")
    is_inner = inner.select("workbook_id", F.col("node").alias("to"), F.lit(True).alias("_inner"))
    nexts = nexts.join(is_inner, ["workbook_id", "to"], "left")
    one, end = F.lit(1).cast("bigint"), F.col("_inner").isNull()
    # An open path ends at the inner node whose next one is not inner.
    pointers = cut(nexts.select(
        *NODE, "to", one.alias("steps"), end.alias("there"), F.lit(False).alias("round"), F.when(end, F.col("node")).alias("stretch"),
        F.col("to").alias("top"), one.alias("far")))
    plain = edges.withColumns({"steps": one, "stretch": F.lit(None).cast("string")})
    if pointers.filter("not there").isEmpty():
        return Contracted(plain)
    inside = _jumped(pointers)
    # An edge into the first node of a stretch becomes the stretch's edge; those inside it go.
    begins = edges.join(inside.select("workbook_id", F.col("node").alias("src")), ["workbook_id", "src"], "left_anti")
    into = begins.join(inside.withColumnRenamed("node", "dst"), ["workbook_id", "dst"], "left")
    made = into.select(
        "workbook_id", "src", F.coalesce("exit", "dst").alias("dst"), (F.coalesce("left", F.lit(0)) + 1).alias("steps"), "stretch")
    return Contracted(cut(made), inside)


def _jumped(pointers: DataFrame) -> DataFrame:
    """(node, stretch, left, exit) of every node inside a stretch.

    ``pointers``: node, to, steps; ``there`` where ``to`` lies behind the path's end,
    named by ``stretch``; ``top``, the largest node on the way, ``far`` steps off. A
    round doubles the way of every pointer that is not done. One that meets its
    largest node again has been all around a ring, and knows how far that node is.
    """
    while not pointers.filter("not there and not round").isEmpty():
        ahead = pointers.select(
            "workbook_id", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"),
            F.col("there").alias("_there"), F.col("stretch").alias("_stretch"), F.col("top").alias("_top"), F.col("far").alias("_far"))
        larger = F.col("_top") > F.col("top")
        on = pointers.filter("not there and not round").join(ahead, ["workbook_id", "to"]).select(
            *NODE, F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_there").alias("there"),
            (~F.col("_there") & (F.col("_top") == F.col("top"))).alias("round"),
            F.col("_stretch").alias("stretch"), F.when(larger, F.col("_top")).otherwise(F.col("top")).alias("top"),
            F.when(larger, F.col("steps") + F.col("_far")).otherwise(F.col("far")).alias("far"))
        pointers = cut(pointers.filter("there or round").unionByName(on))
    on_ring = F.col("round")
    return cut(pointers.filter("there or node != top").select(
        *NODE, F.when(on_ring, F.col("top")).otherwise(F.col("stretch")).alias("stretch"),
        F.when(on_ring, F.col("far")).otherwise(F.col("steps")).alias("left"),
        F.when(on_ring, F.col("top")).otherwise(F.col("to")).alias("exit")))


# -- reachability ----------------------------------------------------------------


def reach(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(workbook_id, root, node, depth) for everything reachable, roots included."""
    return reach_from(
        roots.select("workbook_id", "root").distinct().withColumn("node", F.col("root")), edges
    )


def reach_from(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """The same from given start nodes; ``root`` only names the set they belong to.

    ``depth`` is the smallest number of edges. Frontier rounds run over the contracted
    graph; the nodes inside a stretch follow at the end from where it was entered.
    """
    graph = contracted(cut(edges.select(*EDGE).distinct()))
    pair = ["workbook_id", "root", "node"]
    starts = starts.select(*pair).distinct()
    partly = None
    front = starts.withColumn("depth", F.lit(0).cast("bigint"))
    if graph.inside is not None:
        partly = cut(starts.join(graph.inside, NODE))
        leave = partly.select("workbook_id", "root", F.col("exit").alias("node"), F.col("left").alias("depth"))
        front = front.join(graph.inside.select(*NODE), NODE, "left_anti").unionByName(leave)
        front = front.groupBy(*pair).agg(F.min("depth").alias("depth"))
    front = cut(front)
    parts = [front]
    while True:
        step = (
            front.withColumnRenamed("node", "src").join(graph.edges, ["workbook_id", "src"])
            .groupBy("workbook_id", "root", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        )
        known = reduce(DataFrame.unionByName, parts).withColumnRenamed("depth", "_known")
        if graph.inside is None:  # all steps are alike: what was seen was seen earlier
            front = step.join(known, pair, "left_anti")
        else:
            known = known.groupBy(*pair).agg(F.min("_known").alias("_known"))
            front = step.join(known, pair, "left").filter("_known is null or depth < _known").drop("_known")
        front = cut(front)
        if front.isEmpty():
            break
        parts.append(front)
    seen = reduce(DataFrame.unionByName, parts)
    if graph.inside is None:
        return seen.withColumn("depth", F.col("depth").cast("int"))
    seen = cut(seen.groupBy(*pair).agg(F.min("depth").alias("depth")))
    into = graph.edges.filter("stretch is not null").select("workbook_id", F.col("src").alias("node"), "stretch", "steps")
    entered = seen.join(into, NODE).groupBy("workbook_id", "root", "stretch").agg(F.min(F.col("depth") + F.col("steps")).alias("_out"))
    within = entered.join(graph.inside, ["workbook_id", "stretch"]).select(*pair, (F.col("_out") - F.col("left")).alias("depth"))
    ahead = partly.select("workbook_id", "root", "stretch", F.col("left").alias("_left")).join(
        graph.inside, ["workbook_id", "stretch"]).filter("left <= _left").select(*pair, (F.col("_left") - F.col("left")).alias("depth"))
    within = within.unionByName(ahead).groupBy(*pair).agg(F.min("depth").alias("depth"))
    return cut(seen.unionByName(within).withColumn("depth", F.col("depth").cast("int")))


# -- cycles ----------------------------------------------------------------------


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those at nodes that have no way in or no way out, once."""
    heads = edges.select("workbook_id", F.col("src").alias("dst")).distinct()
    tails = edges.select("workbook_id", F.col("dst").alias("src")).distinct()
    return edges.join(heads, ["workbook_id", "dst"], "left_semi").join(tails, ["workbook_id", "src"], "left_semi")


def _core(edges: DataFrame) -> tuple[DataFrame, list[Contracted], list[DataFrame]]:
    """What is left of a graph by trimming and contracting in turn, with the contractions
    and the nodes that turned out to be on a ring of their own, round by round."""
    folded, looped = [], []
    edges = cut(_trimmed(edges.filter("src != dst").select(*EDGE)))
    size = edges.count()
    while size:
        graph = contracted(edges)
        loops = graph.edges.filter("src = dst").select("workbook_id", F.col("src").alias("node")).distinct()
        folded.append(graph)
        looped.append(loops)
        edges = cut(_trimmed(graph.edges.filter("src != dst").select(*EDGE).distinct()).select(*EDGE))
        left = edges.count()
        if left == size:
            break
        size = left
    return edges, folded, looped


def components(edges: DataFrame) -> DataFrame:
    """(workbook_id, node, ring) for every node on a cycle; one ring per component.

    Trimming and contracting in turn leave a core in which every node branches. There
    the largest node name goes along the edges until it settles, and a walk back
    from each such node inside its own colour meets what lies on cycles with it;
    again on the rest. Then the contractions are undone: a stretch between two nodes
    of one ring, or from a node to itself, is part of that ring.
    """
    spark = edges.sparkSession
    alone = edges.filter("src = dst").select("workbook_id", F.col("src").alias("node")).distinct()
    rest, folded, looped = _core(edges)
    found = []
    while not rest.isEmpty():
        ring, colour = _coloured(rest)
        found.append(ring)
        gone = ring.select(*NODE)
        left = rest.join(gone.withColumnRenamed("node", "src"), ["workbook_id", "src"], "left_anti").join(
            gone.withColumnRenamed("node", "dst"), ["workbook_id", "dst"], "left_anti").select(*EDGE)
        before, after = -1, None
        rest = cut(left)
        while (after := rest.count()) and after != before:
            before, rest = after, cut(_trimmed(rest).select(*EDGE))
    rings = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "workbook_id string, node string, ring string")
    sized = rings.groupBy("workbook_id", "ring").agg(F.count(F.lit(1)).alias("_n"))
    rings = cut(rings.join(sized.filter("_n > 1"), ["workbook_id", "ring"]).drop("_n").select(*NODE, "ring"))
    for graph, loops in zip(reversed(folded), reversed(looped)):
        rings = rings.unionByName(loops.join(rings, NODE, "left_anti").withColumn("ring", F.col("node")))
        if graph.inside is not None:
            from_, to = (rings.select("workbook_id", F.col("node").alias(end), F.col("ring").alias(f"_{end}")) for end in ("src", "dst"))
            within = graph.edges.filter("stretch is not null").join(from_, ["workbook_id", "src"]).join(
                to, ["workbook_id", "dst"]).filter("_src = _dst").select("workbook_id", "stretch", F.col("_src").alias("ring"))
            rings = rings.unionByName(graph.inside.join(within, ["workbook_id", "stretch"]).select(*NODE, "ring"))
        rings = cut(rings)
    return cut(rings.unionByName(alone.join(rings, NODE, "left_anti").withColumn("ring", F.col("node"))))


def _coloured(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components of the nodes that keep their own name as the largest that reaches them."""
    colour = cut(rest.select("workbook_id", F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
    while True:
        pushed = rest.join(colour.withColumnRenamed("node", "src"), ["workbook_id", "src"]).select(
            "workbook_id", F.col("dst").alias("node"), "colour")
        after = cut(
            colour.withColumn("_own", F.lit(True)).unionByName(pushed.withColumn("_own", F.lit(False)))
            .groupBy(*NODE).agg(F.max("colour").alias("colour"), F.max(F.when(F.col("_own"), F.col("colour"))).alias("_old")))
        colour = after.drop("_old")
        if after.filter("colour != _old").isEmpty():
            break
    inside = cut(
        rest.join(colour.select("workbook_id", F.col("node").alias("src"), F.col("colour").alias("cs")), ["workbook_id", "src"])
        .join(colour.select("workbook_id", F.col("node").alias("dst"), F.col("colour").alias("cd")), ["workbook_id", "dst"])
        .filter("cs = cd").select("workbook_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    ring = reach(colour.filter("node = colour").select("workbook_id", F.col("node").alias("root")), inside)
    return cut(ring.select(*NODE, F.col("root").alias("ring"))), colour


def elementary_cycles(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """Every elementary cycle as (workbook_id, ring, members), none left out.

    Only edges inside one component are walked, and only its branchings: unbranched
    stretches are single edges on the way and are filled in at the end. ``members``
    begins with the smallest one.
    """
    ends = rings.select("workbook_id", F.col("node").alias("dst"), F.col("ring").alias("_r2"))
    # most edges are on no ring: repeats are looked for among the others only
    within = cut(
        edges.select(*EDGE).join(rings.withColumnRenamed("node", "src"), ["workbook_id", "src"])
        .join(ends, ["workbook_id", "dst"]).filter("ring = _r2").select(*EDGE, "ring").distinct())
    graph = contracted(within)
    named = within.select("workbook_id", F.col("src"), "ring").distinct()
    inside = cut(graph.edges.join(named, ["workbook_id", "src"]).select("workbook_id", "src", "dst", "stretch", "ring"))
    paths = inside.select("workbook_id", "ring", "src").distinct().select(
        "workbook_id", "ring", F.col("src").alias("start"), "src", F.array("src").alias("nodes"),
        F.array().cast("array<string>").alias("stretches"))
    closed = []
    while True:
        steps = paths.join(inside, ["workbook_id", "ring", "src"]).filter("dst >= start")
        steps = steps.filter((F.col("dst") == F.col("start")) | ~F.array_contains("nodes", F.col("dst")))
        steps = cut(steps.withColumn("stretches", F.array_append("stretches", F.col("stretch"))))
        if steps.isEmpty():
            break
        closed.append(steps.filter("dst = start").select("workbook_id", "ring", "nodes", "stretches"))
        paths = steps.filter("dst > start").select(
            "workbook_id", "ring", "start", F.col("dst").alias("src"), F.array_append("nodes", F.col("dst")).alias("nodes"), "stretches")
    if not closed:
        return rings.select("workbook_id", "ring", F.array("node").alias("members")).limit(0)
    cycles = reduce(DataFrame.unionByName, closed)
    if graph.inside is not None:
        parts = cycles.select(
            "workbook_id", "ring", "nodes", "stretches",
            F.posexplode(F.arrays_zip("nodes", "stretches")).alias("_at", "_part"))
        held = graph.inside.groupBy("workbook_id", F.col("stretch").alias("_stretch")).agg(
            F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("at"), "node"))).alias("_held"))
        parts = parts.withColumn("_stretch", F.col("_part.stretches")).join(held, ["workbook_id", "_stretch"], "left")
        piece = F.concat(F.array("_part.nodes"), F.coalesce(F.transform("_held", lambda h: h["node"]), F.array().cast("array<string>")))
        cycles = parts.groupBy("workbook_id", "ring", "nodes", "stretches").agg(
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", piece.alias("p")))), lambda x: x["p"])).alias("nodes_"))
        cycles = cycles.select("workbook_id", "ring", F.col("nodes_").alias("nodes"))
    first = F.array_position("nodes", F.array_min("nodes")).cast("int")
    size = F.size("nodes")
    members = F.concat(F.slice("nodes", first, size), F.slice("nodes", 1, first - 1))
    return cycles.select("workbook_id", "ring", members.alias("members"))
