"""Merged layers, placebo blobs and label grids against sequential brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evalframe.operators import labels, region_growth


def brute_merge(parts, iou, top, layers, least):
    """parts: (layer, number) -> set of cells."""
    found = sorted(((k, v) for k, v in parts.items() if len(v) >= least), key=lambda x: (-len(x[1]), x[0]))
    used, out = set(), []
    for i, (k, seed) in enumerate(found):
        if i in used:
            continue
        members = [(k, seed)]
        for j in range(i + 1, len(found)):
            other = found[j][1]
            if j not in used and len(seed & other) / len(seed | other) > iou:
                used.add(j)
                members.append(found[j])
        union = set().union(*(m for _, m in members))
        half = {c for c in union if 2 * sum(c in m for _, m in members) >= len(members)}
        out.append((half or union, len({k[0] for k, _ in members})))
    out.sort(key=lambda x: -len(x[0]))
    return [(n + 1, len(c), v, v / layers, sorted(c)) for n, (c, v) in enumerate(out[:top])]


def test_merged_layers(spark):
    rng, samples = random.Random(4), {}
    for s in range(12):
        parts = {}
        for layer in range(5):
            taken = set()
            for comp in range(1, 4):
                r, c, h, w = rng.randrange(6), rng.randrange(6), rng.randrange(1, 4), rng.randrange(1, 4)
                cells = {(i, j) for i in range(r, r + h) for j in range(c, c + w)} - taken
                taken |= cells
                if cells:
                    parts[layer, comp] = cells
        samples[s] = parts
    # A chain in which a member of the first seed would have been the seed of the third; five members without a cell in half of them.
    line = lambda a, b: {(0, i) for i in range(a, b)}
    samples[100] = {(0, 1): line(0, 10), (1, 1): line(3, 12), (2, 1): line(6, 14), (3, 1): line(9, 16)}
    samples[101] = {(0, 1): line(0, 9)} | {(k, 1): line(3 * k - 3, 3 * k) for k in (1, 2, 3)}
    rows = [(s, k[0], k[1], r, c) for s, parts in samples.items() for k, cells in parts.items() for r, c in cells]
    df = spark.createDataFrame(rows, "s long, v int, comp int, r int, c int").repartition(5)
    for iou, least in ((0.3, 1), (0.0, 2)):
        regions, cells = region_growth.merged_layers(df, "s", "v", "comp", iou, 5, 3, least)
        held = {}
        for x in cells.collect():
            held.setdefault((x.s, x.region), []).append((x.r, x.c))
        got = {}
        for x in regions.collect():
            got.setdefault(x.s, []).append((x.region, x.area, x.votes, x.weight, sorted(held[x.s, x.region])))
        assert {s: sorted(v) for s, v in got.items()} == {s: w for s, p in samples.items() if (w := brute_merge(p, iou, 3, 5, least))}
    none, _ = region_growth.merged_layers(df.where("s < 0"), "s", "v", "comp", 0.3, 5, 3)
    assert none.count() == 0


def brute_blobs(zone, area, blobs, draw):
    out, used = [], set()
    if len(zone) < area * blobs:
        return out
    for b in range(1, blobs + 1):
        for start in sorted(zone, key=lambda x: (draw[b, x], x)):
            if start in used:
                continue
            seen, queue = [start], [start]
            while queue and len(seen) < area:
                r, c = queue.pop(0)
                for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                    at = (r + i, c + j)
                    if len(seen) < area and at in zone and at not in used and at not in seen:
                        seen.append(at)
                        queue.append(at)
            if len(seen) == area:
                break
        else:
            return out
        used |= set(seen)
        out += [(b, *x) for x in seen]
    return out


def test_placebo_blobs(spark):
    rng, size = random.Random(9), 7
    maps = {k: {(r, c): rng.random() for r in range(size) for c in range(size)} for k in range(10)}
    maps[8] = {x: 0.9 for x in maps[8]}
    away = {k: {x for x in m if rng.random() < 0.06} for k, m in maps.items()}
    rows = [(k, r, c, p) for k, m in maps.items() for (r, c), p in m.items()]
    df = spark.createDataFrame(rows, "k long, r int, c int, p double")
    gone = spark.createDataFrame([(k, r, c) for k, m in away.items() for r, c in m], "k long, r int, c int")
    draw = lambda b: F.pmod(F.xxhash64("k", F.lit(b), "r", "c"), F.lit(50))
    drawn = {b: {(x.k, x.r, x.c): x.d for x in df.select("k", "r", "c", draw(b).alias("d")).collect()} for b in (1, 2, 3)}
    got = {}
    for x in region_growth.placebo_blobs(df, gone, "k", 6, 3, 0.7, draw).collect():
        got.setdefault(x.k, []).append((x.blob, x.r, x.c))
    want, sizes = {}, set()
    for k, m in maps.items():
        near = {(r + i, c + j) for r, c in away[k] for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
        blobs = brute_blobs({x for x, p in m.items() if p < 0.7 and x not in near}, 6, 3, {(b, (r, c)): d for b in drawn for (kk, r, c), d in drawn[b].items() if kk == k})
        sizes.add(len(blobs))
        if blobs:
            want[k] = sorted(blobs)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert 8 not in want and len(sizes) > 1


def blur(grid, size, n, sigma, reflect=False):
    half, out = size // 2, {}
    g = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    back = lambda x: (-x if x < 0 else 2 * (n - 1) - x if x >= n else x) if reflect else x
    for r in range(n):
        for c in range(n):
            out[r, c] = sum(g[i + half] * g[j + half] * grid.get((back(r + i), back(c + j)), 0.0) for i in range(-half, half + 1) for j in range(-half, half + 1)) / sum(g) ** 2
    return out


def parts_of(cells):
    left, n = set(cells), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            r, c = todo.pop()
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
    return n


@pytest.mark.parametrize("sigma", [0.0, 1.0])
def test_single_region_labels(spark, sigma):
    rng, n, rows = random.Random(2), 6, []
    for k in range(6):
        for token in range(5):
            r0, c0 = rng.randrange(n), rng.randrange(n)
            for r in range(n):
                for c in range(n):
                    near = max(abs(r - r0), abs(c - c0)) <= 1
                    rows.append((k, token, r, c, 0.0 if k == 5 else (1.0 if near else 0.01) * rng.uniform(0.4, 1) + (0.9 if rng.random() < 0.01 * k else 0)))
    df = spark.createDataFrame(rows, "k long, token int, r int, c int, p double")
    for empty in (True, False):
        got = {(x.k, x.r, x.c): x.label for x in labels.single_region_labels(df, "k", "token", n, n, skip=2, sigma=sigma, ignore_empty=empty).collect()}
        want = {}
        for k in range(6):
            union = set()
            for token in range(2, 5):
                m = {(r, c): p for kk, t, r, c, p in rows if kk == k and t == token}
                m = {x: p / max(max(m.values()), 1e-12) for x, p in m.items()}
                m = blur(m, 5, n, sigma) if sigma else m
                top, mean = max(m.values()), sum(m.values()) / n / n
                kept = {x for x, p in m.items() if p > 0.3 * top} if top / (mean + 1e-8) >= 3 else set()
                union |= kept if parts_of(kept) == 1 else set()
            soft = blur({x: 1.0 for x in union}, 5, n, 1.0)
            for x in soft:
                want[k, *x] = (-100 if empty else 0) if not union else 1 if x in union else -100 if soft[x] > 0.3 * max(soft.values()) else 0
        assert got == want
        assert set(want.values()) == {1, 0, -100}


def test_pseudo_labels(spark):
    rng, n, rows, known = random.Random(7), 8, [], {}
    for k in range(12):
        scale = 1e-3 if k == 3 else 0.0 if k == 4 else 1.0
        for r in range(n):
            for c in range(n):
                spread = 1.0 if k == 5 else math.exp(-((r - k % 8) ** 2 + (c - 3) ** 2) / 3)
                rows.append((k, r, c, rng.choice([0.0, 0.005, 0.01, 0.3]), spread * rng.random() * scale, 10 + k * 7 % 30, 10 + k * 11 % 30))
    df = spark.createDataFrame(rows, "k long, r int, c int, sink double, p double, w int, h int")
    for smoothing in (False, True):
        for boxed in (False, True):
            box = labels.letter_box(F.col("w"), F.col("h"), n) if boxed else None
            got = {(x.k, x.r, x.c): x.label for x in labels.pseudo_labels(df, "k", n, n, box, smoothing=smoothing, blur=3).collect()}
            want = {}
            for k in range(12):
                mine = {(r, c): (s, p, w, h) for kk, r, c, s, p, w, h in rows if kk == k}
                w, h = next(iter(mine.values()))[2:]
                nw, nh = max(int(w / max(w, h) * n), 1), max(int(h / max(w, h) * n), 1)
                r1, c1, r2, c2 = ((n - nh) // 2, 0, min(nh + math.ceil((n - nh) / 2), n), nw) if nw > nh else (0, (n - nw) // 2, nh, min(nw + math.ceil((n - nw) / 2), n)) if nh > nw else (0, 0, n, n)
                inside = {x: not boxed or r1 <= x[0] < r2 and c1 <= x[1] < c2 for x in mine}
                g = {x: v[1] if v[0] < 1e-2 and inside[x] else 0.0 for x, v in mine.items()}
                if smoothing:
                    soft = blur(g, 5, n, 1.0, reflect=True)
                    g = {x: v if soft[x] > max(soft.values()) * 0.3 / 2 else 0.0 for x, v in g.items()}
                g = {x: v if v > max(g.values()) * 0.2 else 0.0 for x, v in g.items()}
                hot = [x for x, v in blur(g, 3, n, 1.0, reflect=True).items() if v > 0] or [(0, 0), (n - 1, n - 1)]
                a, b, c, d = min(x[0] for x in hot), min(x[1] for x in hot), max(x[0] for x in hot), max(x[1] for x in hot)
                top = max(g.values())
                fine = (c - a + 1) * (d - b + 1) < 0.5 * n * n and top >= 5e-3
                for x, v in mine.items():
                    out = not (a <= x[0] <= c and b <= x[1] <= d)
                    back = out and (v[1] if v[0] < 1e-2 else 0.0) < top * 0.1 or not inside[x]
                    want[k, *x] = -100 if not fine else 1 if g[x] > 0 else 0 if back else -100
            assert got == want
            assert {v for (k, *_), v in want.items() if k in (3, 4)} == {-100} and set(want.values()) == {1, 0, -100}


def test_no_rounds(spark):
    """Labels and blobs are made where a map's cells are, without a job for each round of spreading, along a path of 1,000 cells too."""
    from evalframe.operators import regions

    path = [(k, i // 2, (i + 1) // 2 + 5 * k) for k in (1, 2) for i in range(1000)] + [(2, 0, 0), (2, 600, 0)]
    cells = spark.createDataFrame([(*x, -1.0) for x in path], "k int, r int, c int, p double")
    spark.sparkContext.setJobGroup("rounds", "labels")
    labelled = regions.label_components(cells, "k")
    blobs = region_growth.placebo_blobs(cells, cells.where("k < 0"), "k", 300, 3, 0.0, lambda blob: F.hash(F.lit(blob), "r", "c"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")
    spark.sparkContext.setJobGroup("after", "rows")
    assert {(r.k, r.r, r.c): r.comp for r in labelled.collect()} == {x: 1 + (x[0] == 2 and x[1:] != (0, 0)) + (x == (2, 600, 0)) for x in path}
    made = blobs.groupBy("k", "blob").count().collect()
    assert {r["count"] for r in made} == {300} and {r.k for r in made} == {1, 2}
