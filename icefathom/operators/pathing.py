"""Least-cost distance for all voyages at once, and the routes it implies."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icefathom.operators import overlay
from icefathom.operators.spread import block_join
from icefathom.session import ensure_checkpoint_dir, stored

#: Side of a tile where costs depend on the time of departure.
TIMED_TILE = 64
BATCH_VOYAGES = 64
#: Side of the blocks in which routes are walked.
WALK_BLOCK = 256
#: How a way ends inside its block: at the source, in another block, at a node without a row, never.
_ROOT, _LEAVES, _GAP, _CIRCLE = range(4)
_LEG = "voyage_id bigint, i bigint, j bigint, ni bigint, nj bigint, hops bigint, kind int"
_PATH = "voyage_id bigint, i bigint, j bigint, _ti bigint, _tj bigint, hops bigint, way array<bigint>"


def grid_edges(nodes: DataFrame) -> DataFrame:
    """Edges between each node and its eight neighbours; weight is the sum of both costs."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    reach = (
        nodes.withColumn("_di", F.explode(steps))
        .withColumn("_dj", F.explode(steps))
        .filter("_di <> 0 or _dj <> 0")
        .select("i", "j", "cost", (F.col("i") + F.col("_di")).alias("ni"), (F.col("j") + F.col("_dj")).alias("nj"))
    )
    ends = nodes.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("cost").alias("_ncost"))
    return reach.join(ends, ["ni", "nj"]).select("i", "j", "ni", "nj", (F.col("cost") + F.col("_ncost")).alias("w"))


def _tile_solver(slice_len: float, last_slot: int):
    """Task function that settles one tile.

    It is a closure over plain values, so it travels with the job and tasks
    need not have this package installed.
    """

    def settle(edges: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        """Settles all voyages of a batch inside the tile and offers costs to its rim."""
        if edges.empty or state.empty:
            return pd.DataFrame({"voyage_id": [], "i": [], "j": [], "d": [], "inside": []})
        ends = np.concatenate([edges[["i", "j"]].to_numpy(), edges[["ni", "nj"]].to_numpy(), state[["i", "j"]].to_numpy()])
        nodes, code = np.unique(ends, axis=0, return_inverse=True)
        code = code.reshape(-1)
        n_edges = len(edges)
        src, dst, at = code[:n_edges], code[n_edges : 2 * n_edges], code[2 * n_edges :]
        arcs, arc_of = np.unique(np.stack([dst, src], axis=1), axis=0, return_inverse=True)
        slots = edges["slot"].to_numpy()
        weight = np.full((len(arcs), last_slot + 1), np.inf)
        np.minimum.at(weight, (arc_of.reshape(-1), slots), edges["w"].to_numpy(float))
        heads, first = np.unique(arcs[:, 0], return_index=True)
        tails = arcs[:, 1]
        voyages, v_at = np.unique(state["voyage_id"].to_numpy(), return_inverse=True)
        dist = np.full((len(voyages), len(nodes)), np.inf)
        dist[v_at, at] = state["d"].to_numpy()
        inside = np.zeros(len(nodes), dtype=bool)
        inside[src] = True
        inside[at] = True
        before = dist.copy()
        while True:
            leave = dist[:, tails]
            # The same division as in the predecessor step: floor division differs in the last digit.
            slot = np.minimum(np.floor(np.where(np.isfinite(leave), leave, 0) / slice_len), last_slot).astype(int)
            cost = weight[np.arange(len(arcs)), slot]
            offer = np.minimum.reduceat(leave + cost, first, axis=1)
            better = offer < dist[:, heads]
            if not better.any():
                break
            dist[:, heads] = np.where(better, offer, dist[:, heads])
        v, n = np.nonzero(dist < before)
        return pd.DataFrame(
            {"voyage_id": voyages[v], "i": nodes[n, 0], "j": nodes[n, 1], "d": dist[v, n], "inside": inside[n]}
        )

    return settle


def cost_distance(
    edges: DataFrame,
    sources: DataFrame,
    max_iter: int | None = None,
    slice_len: float | None = None,
    tile: int | None = None,
    batch_voyages: int = BATCH_VOYAGES,
    targets: DataFrame | None = None,
    region: int = overlay.REGION,
    directed: bool = True,
) -> DataFrame:
    """Least accumulated cost from each voyage's source to every node.

    ``edges``: i, j, ni, nj, w > 0 and, with ``slice_len``, ``slot``: the
    weight then applies to departures at floor(cost so far / slice_len), the
    last slot going on for ever (later departure must never arrive earlier).
    ``sources``: voyage_id, i, j. Returns voyage_id, i, j, dist and the
    predecessor pi, pj (lowest of equals; null at the source).

    Without ``slice_len`` the search runs on an overlay of tiles (``overlay``): rounds follow
    regions of ``region`` x ``region`` tiles crossed (on a narrow grid they are longer, with as
    many tiles), and only at the end are tiles opened.
    With it, whole tiles are settled round by round, since costs inside depend on the time.

    With ``targets`` (voyage_id, i, j) a voyage stops at the cost of its farthest target. The
    result holds at least every node of a least-cost way to a target, all with their exact
    costs. On the overlay the search is ``directed`` by landmarks as well: nodes from which,
    by the triangle inequality, no target can be reached at that cost are left out. A target
    that is no node of the graph is passed over; one that cannot be reached leaves its
    voyage unbounded. Work is spread by (region or tile, batch of voyages), both bounded, and
    every round is stored in the checkpoint folder. ``max_iter`` makes a run of more rounds an
    error. A node other than a source that has no predecessor is an error too.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    tile = tile or (overlay.TILE if slice_len is None else TIMED_TILE)
    # One copy of the graph, which everything below reads.
    plain = edges.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("i", "j", "ni", "nj")], F.col("w").cast("double").alias("w"),
        F.col("slot") if slice_len is not None else F.lit(0).alias("slot"),
    )
    arcs = overlay.in_tiles(overlay.in_tiles(plain, tile), tile, "ni", "nj", ("_ni", "_nj")).checkpoint()
    spans = [
        (F.max(F.greatest(a, b)) - F.min(F.least(a, b)) + 1).alias(n) for n, a, b in (("rows", "_ti", "_ni"), ("columns", "_tj", "_nj"))
    ]
    checked = arcs.agg(F.max("slot").alias("last"), F.min((F.col("w") > 0) & F.col("w").isNotNull()).alias("ok"), *spans).first()
    if checked["ok"] is False:
        raise ValueError("edge weights must be positive")
    last_slot = int(checked["last"] or 0)
    at = [F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")]
    begin = sources.select("voyage_id", *at).checkpoint()
    n_voyages = begin.select("voyage_id").distinct().count()
    # Few voyages are spread over the tasks there are.
    batches = max(1, -(-n_voyages // batch_voyages), min(n_voyages, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    goals = None if targets is None else targets.select("voyage_id", *at).distinct()
    if slice_len is None:
        sides = overlay.region_sides(region, checked["rows"] or 1, checked["columns"] or 1)
        dist = _settled(arcs, begin, goals, max_iter, tile, sides, batches, directed)
    else:
        dist = _settled_timed(arcs, begin, goals, max_iter, slice_len, last_slot, tile, batches)

    departing = dist.join(arcs.select("i", "j", "ni", "nj", "w", "slot"), ["i", "j"])
    if slice_len is not None:
        departing = departing.filter(F.col("slot") == F.least(F.floor(F.col("dist") / slice_len), F.lit(last_slot)))
    arrive = F.struct((F.col("dist") + F.col("w")).alias("a"), F.col("i").alias("pi"), F.col("j").alias("pj"))
    best = departing.groupBy("voyage_id", F.col("ni").alias("i"), F.col("nj").alias("j")).agg(F.min(arrive).alias("_p"))
    found = dist.join(best, ["voyage_id", "i", "j"], "left")
    # The overlay adds the same costs in another order, so sums may differ in the last digit.
    reached = F.col("_p.a") <= F.col("dist") * (overlay.SLACK if slice_len is None else 1.0)
    broken = F.raise_error(F.lit("cost_distance: a node other than the source has no predecessor")).cast("bigint")
    return found.select(
        "voyage_id", "i", "j", "dist",
        F.when(F.col("dist") == 0, F.lit(None)).when(reached, F.col("_p.pi")).otherwise(broken).cast("bigint").alias("pi"),
        F.when(F.col("dist") == 0, F.lit(None)).when(reached, F.col("_p.pj")).otherwise(broken).cast("bigint").alias("pj"),
    )


def _settled(
    arcs: DataFrame, begin: DataFrame, goals: DataFrame | None, max_iter: int | None, tile: int, region: tuple[int, int],
    batches: int, directed: bool,
) -> DataFrame:
    """Costs (voyage_id, i, j, dist) by the overlay."""
    graph = overlay.build(arcs, tile, region)
    starts = begin.select("voyage_id", F.lit(False).alias("back"), "i", "j", F.lit(0.0).alias("d"))
    aims = marks = ends = None
    spots = overlay.landmark_nodes(arcs) if goals is not None and directed else []
    if goals is not None:
        nodes = arcs.select("i", "j").union(arcs.select("ni", "nj"))
        goals = goals.join(nodes, ["i", "j"], "left_semi").select("voyage_id", "i", "j").checkpoint()
    if spots:
        marks = overlay.landmarks(arcs, graph, spots, tile, region).checkpoint()
        graph = overlay.with_marks(graph, marks, len(spots), tile)
        aims = overlay.goals(begin, goals, marks, len(spots)).checkpoint()
    elif goals is not None:
        aims = overlay.plain_goals(goals).checkpoint()
    if goals is not None:
        # They lower the bound of a voyage only in a region that holds all its goals.
        near = overlay.in_one_region(goals, tile, region)
        if not near.isEmpty():
            ends = overlay.goal_ends(arcs, near, batches, tile).checkpoint()
    first = overlay.open_tiles(arcs, starts, batches, tile)
    if aims is None:
        first = first.withColumn("goal", F.lit(None).cast("array<double>"))
    else:
        first = first.join(aims, "voyage_id", "left")
    labels = overlay.search(graph, first.checkpoint(), batches, tile, region, max_iter, ends)
    dist = overlay.open_tiles(arcs, labels.unionByName(starts), batches, tile).select("voyage_id", "i", "j", F.col("d").alias("dist"))
    if goals is None:
        return dist.checkpoint()
    dist = dist.checkpoint()
    met = goals.join(dist, ["voyage_id", "i", "j"], "left").groupBy("voyage_id").agg(
        F.when(F.count("dist") == F.count(F.lit(1)), F.max("dist") * overlay.SLACK).alias("_most")
    )
    lacks = F.lit(0.0)
    if spots:
        dist = dist.join(marks, ["i", "j"], "left").join(aims, "voyage_id", "left")
        # A node that no landmark meets is bounded by its cost alone.
        lacks = F.greatest(F.lit(0.0), F.coalesce(overlay.lacking("marks", "goal", len(spots)), F.lit(0.0)))
    within = F.coalesce(F.col("dist") + lacks <= F.col("_most"), F.lit(True))
    return dist.join(met, "voyage_id", "left").filter(within).select("voyage_id", "i", "j", "dist").checkpoint()


def _settled_timed(
    arcs: DataFrame, begin: DataFrame, goals: DataFrame | None, max_iter: int | None, slice_len: float, last_slot: int, tile: int, batches: int
) -> DataFrame:
    """Costs (voyage_id, i, j, dist) where a weight depends on the time of departure.

    A round settles whole tiles and passes improved rim costs on.
    """

    def in_batches(df: DataFrame) -> DataFrame:
        return overlay.in_tiles(df, tile).withColumn("_vb", F.pmod(F.xxhash64("voyage_id"), F.lit(batches)).cast("int"))

    area = ["_ti", "_tj", "_vb"]
    arcs = arcs.drop("_ni", "_nj")
    if goals is not None:
        goals = goals.checkpoint()
    state = begin.withColumns({"d": F.lit(0.0), "fresh": F.lit(True)}).checkpoint()
    for _ in range(max_iter) if max_iter is not None else count():
        tagged = in_batches(state)
        active = tagged.filter("fresh").select(*area).distinct()
        work = tagged.join(active, area, "left_semi")
        arc_work = arcs.join(active.toDF(*area), ["_ti", "_tj"])
        solved = (
            arc_work.groupBy(*area)
            .cogroup(work.groupBy(*area))
            .applyInPandas(_tile_solver(slice_len, last_slot), "voyage_id bigint, i bigint, j bigint, d double, inside boolean")
        )
        known = state.select("voyage_id", "i", "j", "d", F.lit(True).alias("inside"))
        state = (
            known.unionByName(solved)
            .groupBy("voyage_id", "i", "j")
            .agg(F.min("d").alias("d"), F.min(F.when(F.col("inside"), F.col("d"))).alias("_known"))
            .select("voyage_id", "i", "j", "d", (F.col("_known").isNull() | (F.col("d") < F.col("_known"))).alias("fresh"))
        )
        if goals is not None:
            state = _within_bound(stored(state), goals)
        state = stored(state)
        if state.filter("fresh").isEmpty():
            break
    else:
        raise RuntimeError(f"cost_distance did not settle within {max_iter} rounds")
    if goals is not None:
        state = state.filter("not beyond")
    return state.select("voyage_id", "i", "j", F.col("d").alias("dist"))


def _within_bound(state: DataFrame, goals: DataFrame) -> DataFrame:
    """Marks labels dearer than all targets of their voyage; those are not carried on."""
    met = goals.join(state.select("voyage_id", "i", "j", "d"), ["voyage_id", "i", "j"], "left")
    bound = met.groupBy("voyage_id").agg(
        F.when(F.count("d") == F.count(F.lit(1)), F.max("d")).alias("_most")
    )
    joined = state.drop("beyond").join(bound, "voyage_id", "left")
    beyond = F.coalesce(F.col("d") > F.col("_most"), F.lit(False))
    return joined.withColumn("beyond", beyond).withColumn("fresh", F.col("fresh") & ~F.col("beyond")).drop("_most")


def _leg_finder(block: int, path: bool):
    """Task function: the way of each wanted node inside one block of a voyage.

    Without ``path`` a row per node: what the way ends in (``_LEG``) and how many steps that
    takes. With it the nodes themselves, as places in the block. A closure over plain values.
    """
    names = [c.split()[0] for c in (_PATH if path else _LEG).split(", ")]
    root, leaves, gap, circle = _ROOT, _LEAVES, _GAP, _CIRCLE

    def find(steps: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame(columns=names)
        first = wanted[["_ti", "_tj"]].to_numpy(np.int64)[0] * block

        def place(i, j) -> np.ndarray:
            return (np.asarray(i, np.int64) - first[0]) * block + np.asarray(j, np.int64) - first[1]

        n = len(steps)
        own = place(steps["i"], steps["j"])
        order = np.argsort(own, kind="stable")
        own, steps = own[order], steps.iloc[order]

        def row_of(places: np.ndarray) -> np.ndarray:
            """Row of each place, -1 where there is none; of equal rows the last."""
            at = np.searchsorted(own, places, side="right") - 1
            return np.where((at >= 0) & (own[np.maximum(at, 0)] == places), at, -1) if n else np.full(len(places), -1)

        before = steps[["pi", "pj"]].to_numpy(float)
        begins = np.isnan(before[:, 0])
        # Exact whole numbers: a float holds them to 2 ** 53 only.
        pi, pj = (steps[c].fillna(-1).to_numpy(np.int64) for c in ("pi", "pj"))
        inside = ~begins & (pi // block * block == first[0]) & (pj // block * block == first[1])
        parent = np.full(n, -1)
        parent[inside] = row_of(place(pi[inside], pj[inside]))
        at = row_of(place(wanted["i"], wanted["j"]))
        if path:
            chain, places = parent.tolist(), own.tolist()
            ways = []
            for x in at.tolist():
                way = []
                while x >= 0:
                    way.append(places[x])
                    x = chain[x]
                ways.append(np.array(way, np.int64))
            return wanted.assign(way=ways)[names]
        kind = np.where(begins, root, np.where(inside, gap, leaves))
        stop = parent < 0
        ahead, hops = np.where(stop, np.arange(n), parent), (~stop).astype(np.int64)
        for _ in range(max(n, 1).bit_length()):
            hops, ahead = hops + hops[ahead], ahead[ahead]
        kind = np.where(stop[ahead], kind[ahead], circle)
        met = at >= 0
        goes = met.copy()
        goes[met] = kind[at[met]] == leaves
        ni, nj = (pd.array(np.where(goes, x[ahead[at]] if n else -1, -1), dtype="Int64") for x in (pi, pj))
        ni[~goes], nj[~goes] = pd.NA, pd.NA
        done = wanted[["voyage_id", "i", "j"]].assign(ni=ni, nj=nj, hops=0, kind=gap)
        done["hops"] = np.where(met, hops[at] if n else 0, 0) + goes
        done["kind"] = np.where(met, kind[at] if n else gap, gap)
        return done[names]

    return find


def extract_routes(pred: DataFrame, targets: DataFrame, max_rounds: int | None = None, block: int = WALK_BLOCK) -> DataFrame:
    """Waypoints of the route to each target, ``seq`` 0 at the source.

    ``targets``: voyage_id, i, j. One pass over blocks of ``block`` x ``block`` nodes finds where
    the way of each target, and of each node entered from another block, leaves its block.
    These legs are joined with themselves, so that rounds follow the logarithm of the blocks
    crossed, and a second pass opens those that are on a wanted route; only then are the
    waypoints written, each once. A target that ``pred`` does not reach has no route and no row
    (``unreachable`` lists those). Routes through more than ``max_rounds`` blocks, or
    predecessors that lead back to a node, are an error.
    """
    ensure_checkpoint_dir(pred.sparkSession)
    key = ["voyage_id", "i", "j"]
    area = ["voyage_id", "_ti", "_tj"]
    numbers = [F.col(c).cast("bigint").alias(c) for c in (*key, "pi", "pj")]
    known = overlay.in_tiles(pred.select(*numbers).dropna(subset=key), block)
    steps = overlay.in_tiles(known, block, "pi", "pj", ("_pti", "_ptj")).checkpoint()
    goals = targets.select(*numbers[:3]).distinct().join(steps.select(*key), key, "left_semi").checkpoint()
    entered = steps.filter("_ti <> _pti or _tj <> _ptj").select("voyage_id", F.col("pi").alias("i"), F.col("pj").alias("j"))
    nodes = steps.select(*key, "pi", "pj", "_ti", "_tj")

    def found(wanted: DataFrame, path: bool) -> DataFrame:
        at = overlay.in_tiles(wanted, block)
        near = nodes.join(at.select(*area).distinct(), area, "left_semi")
        return (
            overlay.dealt(near.toDF(*near.columns), area).groupBy(*area)
            .cogroup(overlay.dealt(at, area).groupBy(*area))
            .applyInPandas(_leg_finder(block, path), _PATH if path else _LEG)
        )

    # Legs of 1, 2, 4 ... blocks. All nodes on a way end as its target does, so that alone is checked.
    legs = [stored(found(entered.union(goals).distinct(), False))]
    n_legs = legs[0].count()
    while 2 ** len(legs) <= 2 * n_legs and not legs[-1].filter("ni is not null").isEmpty():
        then = legs[-1].select("voyage_id", F.col("i").alias("ni"), F.col("j").alias("nj"), F.struct("ni", "nj", "hops", "kind").alias("_then"))
        both = legs[-1].join(then, ["voyage_id", "ni", "nj"], "left")
        goes = F.col("_then").isNotNull()
        ends = [F.when(goes, F.col(f"_then.{c}")).otherwise(F.col(c)).alias(c) for c in ("ni", "nj", "kind")]
        legs.append(stored(both.select(*key, *ends[:2], (F.col("hops") + F.coalesce("_then.hops", F.lit(0))).alias("hops"), ends[2])))
    ended = legs[-1].select(*key, "hops", "kind")
    broken = goals.join(ended, key).filter(F.col("kind") != _ROOT).first()
    if broken is not None and broken["kind"] == _GAP:
        raise ValueError(f"a node of voyage {broken['voyage_id']} is on a way but has no row")
    if broken is not None:
        raise ValueError("predecessors run in a circle")
    # For each target the nodes at which its way enters a block.
    pairs = stored(goals.select("voyage_id", F.col("i").alias("target_i"), F.col("j").alias("target_j"), "i", "j"))
    for part in legs[:-1]:
        ahead = part.filter("ni is not null").select(*key, "ni", "nj")
        further = pairs.join(ahead, key).select(*pairs.columns[:3], F.col("ni").alias("i"), F.col("nj").alias("j"))
        pairs = pairs.unionByName(stored(further))
    if max_rounds is not None and not pairs.groupBy(*pairs.columns[:3]).count().filter(F.col("count") > max_rounds).isEmpty():
        raise RuntimeError(f"routes through more than {max_rounds} blocks")
    # The place of a node on every route through it is its number of steps from the source.
    wanted = stored(pairs.select(*key).distinct().join(ended, key))
    open_ways = stored(found(wanted.select(*key, "hops"), True))
    met = block_join(pairs.withColumn("_way", F.xxhash64("target_i", "target_j")), open_ways, key, "_way", "i")
    walk = met.select("voyage_id", "target_i", "target_j", "hops", "_ti", "_tj", F.posexplode("way").alias("_step", "_at"))
    return walk.select(
        "voyage_id", "target_i", "target_j", (F.col("hops") - F.col("_step")).alias("seq"),
        (F.col("_ti") * block + F.floor(F.col("_at") / block)).alias("i"), (F.col("_tj") * block + F.col("_at") % block).alias("j"),
    )


def unreachable(pred: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that ``cost_distance`` has not reached."""
    return targets.join(pred.select("voyage_id", "i", "j"), ["voyage_id", "i", "j"], "left_anti")
