"""Least-cost search over a tile overlay: rim-to-rim costs once for all voyages.

A tile's rim are its nodes with an edge to or from another tile. The overlay holds, as one
packed row a tile, the cost between every two rim nodes inside the tile and the edges
that cross its border. It is made once; no voyage looks into a tile again on its way.
Tiles are searched in regions of ``REGION`` x ``REGION``, longer where the graph is narrower
than that (``region_sides``): a task settles a region's rim nodes
for a batch of voyages and offers costs to the rims beyond, so rounds follow regions
crossed. Each round stores only the labels that improved. At the end the tiles that are
wanted are opened: one pass spreads the rim costs over their inner nodes.

With goals the search is directed: costs from and to a few landmarks give, by the triangle
inequality, what a node still lacks to its goals at least, and what the whole way costs at
most; a label that cannot keep to that is dropped. The bound never falls by more than an
edge costs along that edge, so a node that is kept has all its predecessors kept.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icefathom.session import stored

TILE = 16
REGION = 32
#: Rounds whose improved labels are read as they were written, before they are merged.
LOG_ROUNDS = 8
#: Room for rounding where two sums of the same costs are compared.
SLACK = 1 + 1e-9
_GRAPH = (
    "_ti long, _tj long, _gi long, _gj long, rims binary, matrix binary, out_at binary, out_to binary, out_w binary,"
    " in_at binary, in_from binary, in_w binary"
)
_LABEL = "voyage_id long, back boolean, i long, j long, d double"


def in_tiles(df: DataFrame, tile: int, i: str = "i", j: str = "j", to: tuple[str, str] = ("_ti", "_tj")) -> DataFrame:
    return df.withColumns({to[0]: F.floor(F.col(i) / tile), to[1]: F.floor(F.col(j) / tile)})


def region_sides(region: int, rows: int, columns: int) -> tuple[int, int]:
    """Sides of a region in tiles: where a graph is narrow, a region holds as many tiles as elsewhere by its length."""
    most = region * region
    return max(region, most // max(1, min(columns, region))), max(region, most // max(1, min(rows, region)))


def _in_batches(df: DataFrame, batches: int) -> DataFrame:
    return df.withColumn("_vb", F.pmod(F.xxhash64("voyage_id"), F.lit(batches)).cast("int"))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key over as many tasks as the session shuffles to.

    Few bytes can mean much work here, so the count is not left to adaptive execution, which
    goes by bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _overlay_builder(tile: int, region: tuple[int, int]):
    """Task function: one tile's edges to its overlay row. A closure over plain values, as all here."""

    def build(edges: pd.DataFrame) -> pd.DataFrame:
        here = edges[["_ti", "_tj"]].to_numpy()[0]
        a, b, w = edges[["i", "j"]].to_numpy(), edges[["ni", "nj"]].to_numpy(), edges["w"].to_numpy(float)
        in_a, in_b = (a // tile == here).all(1), (b // tile == here).all(1)
        leave, enter, stay = in_a & ~in_b, in_b & ~in_a, in_a & in_b
        rims = np.unique(np.concatenate([a[leave], b[enter]]), axis=0)
        if not len(rims):
            return pd.DataFrame()
        nodes, code = np.unique(np.concatenate([rims, a[stay], b[stay], a[leave], b[enter]]), axis=0, return_inverse=True)
        at_rim, tail, head, out_at, in_at = np.split(code.reshape(-1), np.cumsum([len(rims), stay.sum(), stay.sum(), leave.sum()]))
        rim_of = np.full(len(nodes), -1)
        rim_of[at_rim] = np.arange(len(rims))
        dist = np.full((len(nodes), len(rims)), np.inf)
        dist[at_rim, np.arange(len(rims))] = 0.0
        if len(tail):
            order = np.argsort(head, kind="stable")
            tail, weight = tail[order], w[stay][order][:, None]
            heads, first = np.unique(head[order], return_index=True)
            while True:
                offer = np.minimum.reduceat(dist[tail] + weight, first, axis=0)
                if not (offer < dist[heads]).any():
                    break
                dist[heads] = np.minimum(offer, dist[heads])
        gi, gj = here // np.array(region)
        packed = (rims, dist[at_rim].T, rim_of[out_at], b[leave], w[leave], rim_of[in_at], a[enter], w[enter])
        return pd.DataFrame([[*here, gi, gj, *(np.ascontiguousarray(x).tobytes() for x in packed)]], columns=[c.split()[0] for c in _GRAPH.split(",")])

    return build


def build(arcs: DataFrame, tile: int, region: tuple[int, int]) -> DataFrame:
    """One packed row for each tile that has a rim, stored by region. ``arcs`` has both ends' tiles (_ti, _tj, _ni, _nj)."""
    crosses = (F.col("_ti") != F.col("_ni")) | (F.col("_tj") != F.col("_nj"))
    plain = ["i", "j", "ni", "nj", "w"]
    there = arcs.filter(crosses).select(F.col("_ni").alias("_ti"), F.col("_nj").alias("_tj"), *plain)
    made = dealt(arcs.select("_ti", "_tj", *plain).unionByName(there), ["_ti", "_tj"]).groupBy("_ti", "_tj").applyInPandas(_overlay_builder(tile, region), _GRAPH)
    return _by_region(made)


def _by_region(graph: DataFrame) -> DataFrame:
    """The overlay stored so that a round reads the files of its own regions."""
    area = ["_gi", "_gj"]
    return stored(dealt(graph, area).sortWithinPartitions(*area))


def _region_solver():
    """Task function that settles the rims of one region for a batch of voyages."""

    def settle(tiles: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame()
        if tiles.empty or labels.empty:
            return none
        rims = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in tiles["rims"]]
        ends = np.cumsum([len(r) for r in rims])
        starts, n = ends - [len(r) for r in rims], int(ends[-1])
        nodes = np.concatenate(rims)
        lookup = pd.MultiIndex.from_arrays(nodes.T)
        tile_of = np.repeat(np.arange(len(rims)), ends - starts)
        made = []
        for back, part in labels.groupby("back"):
            part = part[part["voyage_id"].isin(part["voyage_id"][part["fresh"]].unique())]
            aims, part = part[part["aim"].notna()], part[part["aim"].isna()]
            at = lookup.get_indexer(pd.MultiIndex.from_arrays([part["i"], part["j"]]))
            part, at = part[at >= 0], at[at >= 0]
            if part.empty:
                continue
            voyages, v_at = np.unique(part["voyage_id"].to_numpy(), return_inverse=True)
            # Edges across borders in the direction of the search, and their far ends outside the region.
            names = ("in_at", "in_from", "in_w") if back else ("out_at", "out_to", "out_w")
            near, far, cost = ([np.frombuffer(x, k) for x in tiles[c]] for c, k in zip(names, (np.int64, np.int64, float)))
            spans = np.concatenate([[0], np.cumsum([len(x) for x in near])])
            near, far, cost = np.concatenate(near), np.concatenate(far).reshape(-1, 2), np.concatenate(cost)
            to = lookup.get_indexer(pd.MultiIndex.from_arrays(far.T)) if len(far) else np.empty(0, int)
            beyond, code = np.unique(far[to < 0], axis=0, return_inverse=True)
            to[to < 0] = n + code.reshape(-1)
            dist = np.full((n + len(beyond), len(voyages)), np.inf)
            fresh = part["fresh"].to_numpy(bool)
            d = part["d"].to_numpy(float)
            np.minimum.at(dist, (at[~fresh], v_at[~fresh]), d[~fresh])
            before = dist.copy()
            np.minimum.at(dist, (at[fresh], v_at[fresh]), d[fresh])
            goals = {v: list(g) for v, g in zip(part["voyage_id"], part["goal"]) if g is not None}
            # What each node still lacks, and the dearest label that can still lead to the goals.
            lacks, most = np.zeros((n, len(voyages))), np.full((n, len(voyages)), np.inf)
            if "marks" in tiles:
                marks = np.concatenate([np.frombuffer(x, float).reshape(-1, len(r)) for x, r in zip(tiles["marks"], rims)], axis=1)
                k = len(marks) // 2
                for x, v in enumerate(voyages):
                    if v in goals:
                        g = np.asarray(goals[v], float)
                        with np.errstate(invalid="ignore"):
                            bounds = np.concatenate([g[2 : k + 2, None] - marks[:k], marks[k:] - g[k + 2 :, None]])
                        lacks[:, x] = np.maximum(np.max(np.where(np.isnan(bounds), -np.inf, bounds), axis=0), 0.0)
            for x, v in enumerate(voyages):
                if v in goals:
                    most[:, x] = goals[v][0] - lacks[:, x]
            dist[:n][dist[:n] > most] = np.inf
            # Rims from which a goal's tile can be finished: by voyage, the goals with their rims and costs.
            ends_of: dict[int, list] = {}
            watched: dict[int, set[int]] = {}
            for (v, _), rows in aims.groupby(["voyage_id", "aim"]):
                x, spot = int(np.searchsorted(voyages, v)), lookup.get_indexer(pd.MultiIndex.from_arrays([rows["i"], rows["j"]]))
                near_end = rows["d"].to_numpy(float)[spot >= 0]
                spot = spot[spot >= 0]
                if len(spot):
                    ends_of.setdefault(x, []).append((spot, near_end))
                    for t in np.unique(tile_of[spot]):
                        watched.setdefault(int(t), set()).add(x)

            whole_of = {
                x: (np.concatenate([s for s, _ in e]), np.concatenate([d for _, d in e]), np.cumsum([0, *(len(s) for s, _ in e[:-1])]))
                for x, e in ends_of.items()
                if voyages[x] in goals and len(e) == goals[voyages[x]][1]
            }

            def tighten(x: int) -> None:
                """All goals of a voyage lie here: their costs so far bound every label."""
                v = voyages[x]
                if x in whole_of:
                    at_end, lack, of_goal = whole_of[x]
                    found = float(np.minimum.reduceat(dist[at_end, x] + lack, of_goal).max()) * SLACK
                    if found < goals[v][0]:
                        goals[v][0] = found
                        most[:, x] = found - lacks[:, x]
                        gone = dist[:n, x] > most[:, x]
                        dist[:n, x][gone] = np.inf
                        moved[:n, x][gone] = False

            # Labels that improved and are not yet passed on; tiles with the least of them go first.
            moved = dist < before
            moved[n:] = False
            while True:
                todo = np.unique(tile_of[np.flatnonzero(moved[:n].any(1))])
                if not len(todo):
                    break
                lead = [np.min(dist[starts[t] : ends[t]], where=moved[starts[t] : ends[t]], initial=np.inf) for t in todo]
                for t in todo[np.argsort(lead)]:
                    low, high = starts[t], ends[t]
                    ways = np.flatnonzero(moved[low:high].any(0))
                    if not len(ways):
                        continue
                    moved[low:high] = False
                    inner = np.frombuffer(tiles["matrix"].iloc[t], float).reshape(high - low, high - low)
                    inner = inner.T if back else inner
                    now = dist[low:high, ways]
                    best = np.minimum(now, (inner[:, :, None] + now[:, None, :]).min(0))
                    best[best > most[low:high, ways]] = np.inf
                    dist[low:high, ways] = best
                    reach = slice(spans[t], spans[t + 1])
                    where, offer = to[reach], best[near[reach]] + cost[reach][:, None]
                    inside = where < n
                    limit = most[np.ix_(where[inside], ways)]
                    offer[inside] = np.where(offer[inside] > limit, np.inf, offer[inside])
                    spot = np.ix_(where, ways)
                    better = offer < dist[spot]
                    np.minimum.at(dist, spot, offer)
                    np.logical_or.at(moved, np.ix_(where[inside], ways), better[inside])
                    for x in watched.get(int(t), ()):
                        tighten(x)
            dist[:n][dist[:n] > most] = np.inf
            x, v = np.nonzero(dist < before)
            spots = np.concatenate([nodes, beyond])[x]
            made.append(
                pd.DataFrame(
                    {
                        "voyage_id": voyages[v], "back": back, "i": spots[:, 0], "j": spots[:, 1], "d": dist[x, v],
                        "goal": pd.Series([goals.get(voyages[y]) if z >= n else None for z, y in zip(x, v)], dtype=object), "inside": x < n,
                    }
                )
            )
        return pd.concat(made, ignore_index=True) if made else none

    return settle


def search(
    graph: DataFrame, starts: DataFrame, batches: int, tile: int, region: tuple[int, int], max_iter: int | None = None, ends: DataFrame | None = None
) -> DataFrame:
    """Costs (voyage_id, back, i, j, d) of all rim nodes, from starts inside their tiles.

    ``back`` searches against the edges. ``starts`` may carry ``goal``: the most a way may
    cost, the number of goals, then for each landmark the least cost from it to a goal, and
    the greatest to it. ``ends`` (voyage_id, aim, i, j, d) are the costs from rims to each goal
    inside its tile; where all goals of a voyage lie in one region, they lower the first.
    """
    parts: list[DataFrame] = []
    offers = starts
    area = ["_gi", "_gj", "_vb"]
    key = ["voyage_id", "back", "i", "j"]
    sides = (tile * region[0], tile * region[1])
    bounds = None

    def placed(df: DataFrame) -> DataFrame:
        where = {g: F.floor(F.col(c) / side) for g, c, side in zip(area, "ij", sides)}
        return _in_batches(df.withColumns(where), batches)

    def reached(df: DataFrame, names: tuple[str, str], by: tuple[int, int]) -> DataFrame:
        """Rows between the outermost regions of the round: files without any are not read."""
        if bounds is None:
            return df
        for c, side, low, high in zip(names, by, bounds[::2], bounds[1::2]):
            df = df.filter(F.col(c).between(F.lit(low * side), F.lit((high + 1) * side - 1)))
        return df

    def merged() -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    for _ in range(max_iter) if max_iter is not None else count():
        fresh = placed(offers.groupBy(*key).agg(F.min("d").alias("d"), F.min("goal").alias("goal")))
        active = fresh.select(*area).distinct()
        nothing, none = F.lit(None).cast("array<double>").alias("goal"), F.lit(None).cast("long").alias("aim")
        labels = fresh.select("*", F.lit(True).alias("fresh"), none)
        if parts:
            known = placed(reached(merged(), ("i", "j"), sides)).join(active, area, "left_semi")
            labels = labels.unionByName(known.select(*key, "d", nothing, *area, F.lit(False).alias("fresh"), none))
        if ends is not None:
            near = placed(reached(ends, ("i", "j"), sides)).join(active, area, "left_semi")
            labels = labels.unionByName(near.select(*key, "d", nothing, *area, F.lit(False).alias("fresh"), "aim"))
        tiles = reached(graph, ("_gi", "_gj"), (1, 1)).join(active.toDF(*area), ["_gi", "_gj"])
        out = (
            dealt(tiles, area).groupBy(*area)
            .cogroup(dealt(labels, area).groupBy(*area))
            .applyInPandas(_region_solver(), _LABEL + ", goal array<double>, inside boolean")
        )
        out = stored(out)
        parts.append(out.filter("inside").select(*key, "d"))
        offers = out.filter("not inside").drop("inside")
        bounds = placed(offers).agg(*[f(c) for c in area[:2] for f in (F.min, F.max)]).first()
        if bounds[0] is None:
            return merged().groupBy(*key).agg(F.min("d").alias("d"))
        if len(parts) > LOG_ROUNDS:
            parts = [stored(merged().groupBy(*key).agg(F.min("d").alias("d")))]
    raise RuntimeError(f"cost_distance did not settle within {max_iter} rounds")


def _opened(edges: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """Costs of all nodes of one tile that its labels lead to."""
    if labels.empty:
        return pd.DataFrame()
    ends = np.concatenate([edges[["i", "j"]].to_numpy(np.int64), edges[["ni", "nj"]].to_numpy(np.int64), labels[["i", "j"]].to_numpy(np.int64)])
    nodes, code = np.unique(ends, axis=0, return_inverse=True)
    tail, head, spot = np.split(code.reshape(-1), [len(edges), 2 * len(edges)])
    weight, made = edges["w"].to_numpy(float), []
    ways = labels["back"].to_numpy(bool)
    for back in np.unique(ways):
        part, at = labels[ways == back], spot[ways == back]
        voyages, v_at = np.unique(part["voyage_id"].to_numpy(), return_inverse=True)
        dist = np.full((len(nodes), len(voyages)), np.inf)
        np.minimum.at(dist, (at, v_at), part["d"].to_numpy(float))
        source, goal = (head, tail) if back else (tail, head)
        order = np.argsort(goal, kind="stable")
        if len(order):
            heads, first = np.unique(goal[order], return_index=True)
            while True:
                offer = np.minimum.reduceat(dist[source[order]] + weight[order][:, None], first, axis=0)
                if not (offer < dist[heads]).any():
                    break
                dist[heads] = np.minimum(offer, dist[heads])
        x, v = np.nonzero(np.isfinite(dist))
        made.append(pd.DataFrame({"voyage_id": voyages[v], "back": back, "i": nodes[x, 0], "j": nodes[x, 1], "d": dist[x, v]}))
    return pd.concat(made, ignore_index=True)


def open_tiles(arcs: DataFrame, labels: DataFrame, batches: int, tile: int) -> DataFrame:
    """Costs inside every tile in which a voyage has a label."""
    area = ["_ti", "_tj", "_vb"]
    spots = _in_batches(in_tiles(labels.select("voyage_id", "back", "i", "j", "d"), tile), batches)
    inner = arcs.filter("_ti = _ni and _tj = _nj").select("_ti", "_tj", "i", "j", "ni", "nj", "w")
    edges = inner.join(spots.select(*area).distinct().toDF(*area), ["_ti", "_tj"])
    spots = spots.toDF(*spots.columns)
    return dealt(edges, area).groupBy(*area).cogroup(dealt(spots, area).groupBy(*area)).applyInPandas(_opened, _LABEL)


def landmark_nodes(arcs: DataFrame) -> list[tuple[int, int]]:
    """Up to four nodes at the outer ends of both diagonals."""
    spot = F.struct("i", "j")
    a, b = F.col("i") + F.col("j"), F.col("i") - F.col("j")
    found = arcs.agg(F.max_by(spot, a), F.min_by(spot, a), F.max_by(spot, b), F.min_by(spot, b)).first()
    return sorted({(int(x["i"]), int(x["j"])) for x in found if x is not None})


def landmarks(arcs: DataFrame, graph: DataFrame, spots: list[tuple[int, int]], tile: int, region: tuple[int, int], max_iter: int | None = None) -> DataFrame:
    """(i, j, marks) of every node: its costs from each landmark, then those to each; infinite where there is no way."""
    spark = arcs.sparkSession
    rows = [(k, back, i, j, 0.0) for k, (i, j) in enumerate(spots) for back in (False, True)]
    at = spark.createDataFrame(rows, _LABEL)
    begin = open_tiles(arcs, at, 1, tile).withColumn("goal", F.lit(None).cast("array<double>")).checkpoint()
    rims = search(graph, begin, 1, tile, region, max_iter)
    costs = open_tiles(arcs, rims.unionByName(at), 1, tile)
    far = F.lit(float("inf"))
    marks = [
        F.coalesce(F.min(F.when((F.col("voyage_id") == k) & (F.col("back") == F.lit(back)), F.col("d"))), far)
        for back in (False, True) for k in range(len(spots))
    ]
    return costs.groupBy("i", "j").agg(F.array(*marks).alias("marks"))


def _marker(n_marks: int):
    """Task function: a tile's overlay row with the landmark costs of its rim, in the rim's order."""

    def mark(tiles: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if tiles.empty:
            return pd.DataFrame()
        rims = np.frombuffer(tiles["rims"].iloc[0], np.int64).reshape(-1, 2)
        at = pd.MultiIndex.from_arrays([marks["i"], marks["j"]]).get_indexer(pd.MultiIndex.from_arrays(rims.T))
        # A rim node that no landmark reaches takes the last, infinite row.
        table = np.stack([*marks["marks"], np.full(2 * n_marks, np.inf)])
        return tiles.assign(marks=[np.ascontiguousarray(table[at].T).tobytes()])

    return mark


def with_marks(graph: DataFrame, marks: DataFrame, n_marks: int, tile: int) -> DataFrame:
    """The overlay with landmark costs, for a directed search."""
    key = ["_ti", "_tj"]
    made = dealt(graph, key).groupBy(*key).cogroup(dealt(in_tiles(marks, tile), key).groupBy(*key)).applyInPandas(_marker(n_marks), _GRAPH + ", marks binary")
    return _by_region(made)


def goals(sources: DataFrame, targets: DataFrame, marks: DataFrame, n_marks: int) -> DataFrame:
    """(voyage_id, goal): what ``search`` needs to direct a voyage to its targets."""
    far = F.array_repeat(F.lit(float("inf")), 2 * n_marks)
    own = marks.select("i", "j", "marks")
    here = sources.join(own, ["i", "j"], "left").select("voyage_id", F.coalesce("marks", far).alias("s"))
    there = targets.join(own, ["i", "j"], "left").select("voyage_id", "i", "j", F.coalesce("marks", far).alias("t"))
    # Over a landmark: from the source to it and on to the target.
    over = F.array_min(F.zip_with(F.slice("s", n_marks + 1, n_marks), F.slice("t", 1, n_marks), lambda a, b: a + b))
    least = [F.min(F.col("t")[k]) for k in range(n_marks)]
    greatest = [F.max(F.col("t")[n_marks + k]) for k in range(n_marks)]
    met = here.join(there, "voyage_id").withColumn("ub", over)
    n_goals = F.count_distinct(F.struct("i", "j")).cast("double")
    return met.groupBy("voyage_id").agg(F.array(F.max("ub") * SLACK, n_goals, *least, *greatest).alias("goal"))


def plain_goals(targets: DataFrame) -> DataFrame:
    """(voyage_id, goal) without landmarks."""
    n_goals = F.count_distinct(F.struct("i", "j")).cast("double")
    return targets.groupBy("voyage_id").agg(F.array(F.lit(float("inf")), n_goals).alias("goal"))


def in_one_region(targets: DataFrame, tile: int, region: tuple[int, int]) -> DataFrame:
    """The targets of those voyages that have them all in one region."""
    placed = targets.withColumn("_g", F.struct(*[F.floor(F.col(c) / (tile * side)) for c, side in zip("ij", region)]))
    one = placed.groupBy("voyage_id").agg((F.min("_g") == F.max("_g")).alias("_one")).filter("_one").select("voyage_id")
    return targets.join(one, "voyage_id", "left_semi")


def goal_ends(arcs: DataFrame, targets: DataFrame, batches: int, tile: int) -> DataFrame:
    """Costs inside its tile from every node to each goal, for ``search``."""
    # Each goal is searched back from on its own, under a number of its own.
    numbered = targets.select("voyage_id", "i", "j").withColumn("aim", F.xxhash64("voyage_id", "i", "j"))
    at = numbered.select(F.col("aim").alias("voyage_id"), F.lit(True).alias("back"), "i", "j", F.lit(0.0).alias("d"))
    costs = open_tiles(arcs, at, batches, tile).select(F.col("voyage_id").alias("aim"), "i", "j", "d")
    return numbered.select("voyage_id", "aim").join(costs, "aim").select("voyage_id", F.lit(False).alias("back"), "aim", "i", "j", "d")


def lacking(marks: str, goal: str, n_marks: int):
    """What a node still lacks to the voyage's goals, at least."""

    def known(x):
        return F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x)

    m, g = F.col(marks), F.col(goal)
    bounds = [known(g[2 + k] - m[k]) for k in range(n_marks)] + [known(m[n_marks + k] - g[2 + n_marks + k]) for k in range(n_marks)]
    return F.array_max(F.array(*bounds))
