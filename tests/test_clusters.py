import random

import pytest

from icefathom.operators import clusters, radar


def brute(points, reach, least):
    """(kind, cluster) of every id, from all pairs."""
    near = {i: [j for j, (u, v) in points.items() if (x - u) ** 2 + (y - v) ** 2 <= reach * reach] for i, (x, y) in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    name = {}
    for i in sorted(core):
        if i in name:
            continue
        name[i], todo = i, [i]
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in name:
                    name[j] = i
                    todo.append(j)
    out = {}
    for i in points:
        reached = [name[j] for j in near[i] if j in core]
        out[i] = ("core", name[i]) if i in core else ("border", min(reached)) if reached else ("noise", None)
    return out


@pytest.mark.parametrize("pair_rows", [1, 10_000])
def test_density_clusters_equal_brute_force(spark, pair_rows):
    draw = random.Random(5)
    points = {i: (draw.uniform(-60, 60), draw.uniform(-60, 60)) for i in range(90)}
    for k, (cx, cy) in enumerate([(0, 0), (9, 3), (-30, 20), (-42, 20)]):  # crowded spots, some within reach of each other
        points |= {1000 * (k + 1) + i: (draw.gauss(cx, 2), draw.gauss(cy, 2)) for i in range(60)}
    points |= {9000 + i: (50.0, 50.0) for i in range(5)}  # points in one place
    df = spark.createDataFrame([(i, x, y, "kept") for i, (x, y) in points.items()], "id long, x double, y double, note string")
    got = {r.id: (r.kind, r.cluster_id) for r in clusters.density_clusters(df, 5.0, 4, "id", pair_rows).collect()}
    assert got == brute(points, 5.0, 4)


def test_crowded_neighbours_are_not_compared_point_by_point(spark):
    """Two cells of 20,000 points, exactly out of reach and just within it."""
    rows = [(i, 0.0 + (i % 100) * 0.01, (i // 100) * 0.02) for i in range(20_000)]
    far = [(50_000 + i, 5.995 + x, y) for i, x, y in rows]  # 5.005 from the nearest of the others
    one = spark.createDataFrame(rows + far, "id long, x double, y double")
    assert {r[0] for r in clusters.density_clusters(one, 5.0, 4, "id").select("cluster_id").distinct().collect()} == {0, 50_000}
    near = spark.createDataFrame(rows + [(i, x - 0.005, y) for i, x, y in far], "id long, x double, y double")
    assert [r[0] for r in clusters.density_clusters(near, 5.001, 4, "id").select("cluster_id").distinct().collect()] == [0]


def test_density_of_odd_rows(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (4, 100.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: (r.kind, r.cluster_id) for r in clusters.density_clusters(df, 5.0, 1, "id").collect()}
    assert got == {1: ("core", 1), 2: (None, None), 3: (None, None), 4: ("core", 4)}
    assert clusters.density_clusters(df.limit(0), 5.0, 1, "id").count() == 0
    with pytest.raises(ValueError):
        clusters.density_clusters(df, 0.0, 1, "id")


def test_connected_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    links = [*chain, *[(999, i) for i in range(300, 340)], (500, 500), (601, 600), (600, 601)]
    draw = random.Random(1)
    draw.shuffle(links)
    got = {r.node: r.root for r in clusters.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 300 for i in [*range(300, 340), 999]}, 500: 500, 600: 600, 601: 600}


def test_radar_objects_by_flood_fill(spark):
    draw = random.Random(3)
    hits = {(s, r, c): draw.randrange(1, 50) for s in range(2) for r in range(40) for c in range(30) if draw.random() < 0.35}
    df = spark.createDataFrame([(*k, v) for k, v in hits.items()] + [(None, 1, 1, 5), (0, 1, 2, None)], "scene long, r long, c long, p long")
    left, want = set(hits), set()
    while left:
        seed = left.pop()
        body, todo = [seed], [seed]
        while todo:
            s, r, c = todo.pop()
            for n in [(s, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    body.append(n)
                    todo.append(n)
        s, r, c = min(body)
        p = sum(hits[b] for b in body)
        centre = round(sum(hits[b] * b[1] for b in body) / p, 6), round(sum(hits[b] * b[2] for b in body) / p, 6)
        want.add((s, r, c, len(body), max(hits[b] for b in body), max(b[1] for b in body), min(b[2] for b in body), *centre))
    clean = df.filter("not (scene = 0 and r = 1 and c = 2 and p is null)")
    got = {
        (x.scene, x.object_r, x.object_c, x.n_pixels, x.peak, x.r_max, x.c_min, round(x.centre_r, 6), round(x.centre_c, 6))
        for x in radar.detection_objects(clean).collect()
    }
    assert got == want
