"""Components and holes against brute force, including links between blocks."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from voxelcohort.functions import unpack_voxel
from voxelcohort.operators import components
from pyspark.sql import functions as F

LIMIT = {6: 1, 18: 2, 26: 3}


def flood(points, connectivity):
    """Smallest raster voxel of the component of each voxel."""
    steps = [d for d in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= LIMIT[connectivity]]
    left, out = set(points), {}
    while left:
        seed = min(left)
        stack, group = [seed], {seed}
        left.discard(seed)
        while stack:
            z, y, x = stack.pop()
            for dz, dy, dx in steps:
                n = (z + dz, y + dy, x + dx)
                if n in left:
                    left.discard(n)
                    group.add(n)
                    stack.append(n)
        out.update({p: seed for p in group})
    return out


def mask_of(spark, cases):
    rows = [(c, int(z), int(y), int(x)) for c, pts in cases.items() for z, y, x in pts]
    return spark.createDataFrame(rows, "case_id string, z int, y int, x int")


def labelled(df, connectivity):
    z, y, x = unpack_voxel(F.col("component"))
    rows = components.label_components(df, connectivity).select("case_id", "z", "y", "x", z.alias("a"), y.alias("b"), x.alias("c")).collect()
    return {(r["case_id"], r["z"], r["y"], r["x"]): (r["a"], r["b"], r["c"]) for r in rows}


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_random_masks_match_flood_fill(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    cases = {f"c{i}": [tuple(p) for p in np.argwhere(rng.random((5, 7, 9)) < density)] for i, density in enumerate((0.1, 0.25, 0.45))}
    want = {(c, *p): s for c, pts in cases.items() for p, s in flood(pts, connectivity).items()}
    assert labelled(mask_of(spark, cases), connectivity) == want


@pytest.mark.parametrize("parts", [1, 17])
def test_links_between_blocks_need_many_rounds(spark, monkeypatch, parts):
    monkeypatch.setattr(components, "BLOCK_Z_BITS", 1)
    monkeypatch.setattr(components, "BLOCK_Y_BITS", 1)
    monkeypatch.setattr(components, "LINKS_PER_BATCH", 50)
    monkeypatch.setattr(components, "X_BIN", 4)
    rng = np.random.default_rng(5)
    snake = [(z, y, x) for z in range(9) for y in range(9) for x in range(9) if (x % 2 == 0 and (y > 0 or (x // 2) % 2)) or (x % 2 and y == (8 if (x // 2) % 2 == 0 else 0))]
    cases = {"snake": [p for p in snake if p[0] == 4], "dense": [tuple(p) for p in np.argwhere(rng.random((9, 11, 13)) < 0.3)]}
    want = {(c, *p): s for c, pts in cases.items() for p, s in flood(pts, 6).items()}
    assert labelled(mask_of(spark, cases).repartition(parts), 6) == want


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 40)), min_size=1, max_size=60))
def test_any_mask(spark, points):
    want = {("p", *p): s for p, s in flood(points, 26).items()}
    assert labelled(mask_of(spark, {"p": points}), 26) == want


def holes_by_flood(points):
    zs, ys, xs = zip(*points)
    box = list(itertools.product(range(min(zs) - 1, max(zs) + 2), range(min(ys) - 1, max(ys) + 2), range(min(xs) - 1, max(xs) + 2)))
    empty = set(box) - set(points)
    groups = flood(empty, 6)
    outside = groups[box[0]]
    return {p for p in empty if groups[p] != outside}


def test_fill_holes(spark):
    rng = np.random.default_rng(3)
    shell = [p for p in itertools.product(range(4), repeat=3) if any(c in (0, 3) for c in p)]
    cases = {"shell": shell, "noise": [tuple(map(int, p)) for p in np.argwhere(rng.random((6, 6, 6)) < 0.7)], "open": [p for p in shell if p != (0, 1, 1)]}
    got = {(r["case_id"], r["z"], r["y"], r["x"]) for r in components.fill_holes(mask_of(spark, cases)).collect()}
    want = {(c, *p) for c, pts in cases.items() for p in set(pts) | holes_by_flood(pts)}
    assert got == want
    assert ("shell", 1, 1, 1) in got and ("open", 1, 1, 1) not in got


def test_largest_component_prefers_first_on_tie(spark):
    mask = mask_of(spark, {"t": [(0, 0, 0), (0, 0, 1), (2, 2, 2), (2, 2, 3)]})
    runs = components.largest_component(components.to_runs(mask), 6)
    assert [(r["z"], r["x0"], r["x1"]) for r in runs.collect()] == [(0, 0, 1)]
