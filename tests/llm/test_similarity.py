"""Jaccard join, repeats, decontamination and nearest neighbours against brute force."""

import hashlib
import itertools
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import corpus

from voxelcohort.llm import code_index, decontaminate, jaccard_join, links, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def small_sets(seed):
    """Texts of a few words drawn so that subsets of small sets decide many links."""
    rng = np.random.default_rng(seed)
    base = [f"v{k}" for k in range(14)]
    out = []
    for k in range(90):
        words = base[:int(rng.integers(3, 15))]
        for _ in range(int(rng.integers(0, 2))):
            words[int(rng.integers(0, len(words)))] = f"z{int(rng.integers(0, 3))}"
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize("rows", [[r[:2] for r in corpus.rows(4)], small_sets(1), [(k, " ".join(f"p{j}" for j in range(60) if j != k % 30)) for k in range(70)]])
def test_jaccard_components_equal_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("rid", F.lit("x")).withColumn("unit", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """Chains of near copies, whose ends do not link, in lists that are all long enough for rounds."""
    monkeypatch.setattr(jaccard_join, "LARGE_LIST", 1)
    rows = [(k, " ".join(f"p{j}" for j in range(3 * k, 3 * k + 60))) for k in range(60)] + [(100 + k, " ".join(f"p{j}" for j in range(60) if j != k % 30)) for k in range(70)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [7, 1024])
def test_jaccard_counts_all_links_of_a_group(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    rows = [(k, " ".join(f"p{j}" if j != k else f"q{k}" for j in range(70))) for k in range(40)] + small_sets(3)[40:] + [(200, "p1 p2"), (201, "p1 p2"), (202, None)]
    sets = {k: shingles(t) for k, t in rows}
    near = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b) > 0
    want = {k: sum(near(s, x) for x in set(sets.values())) for k, s in sets.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join.link_counts(docs).collect()} == want and max(want.values()) == 39


def test_jaccard_keeps_one_and_handles_nulls(spark):
    docs = corpus.frame(spark, 4)
    want = {c for _, c in brute_components([r[:2] for r in corpus.rows(4)]).values()}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.near_duplicates(odd).collect()) == [(-1, -1), (-1, 3), (-1, 3), (3, 3), (3, 3)]
    assert jaccard_join.near_duplicates(corpus.empty(spark)).count() == 0


def test_jaccard_entries_are_formed_once(spark):
    formed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            formed.add(batch.num_rows)
            yield batch

    rows = [(1, 5, 8, 0), (1, 7, 8, 1), (1, 6, 9, 0), (2, 5, 8, 1), (3, 6, 9, 2), (3, 9, 9, 0)]
    schema = "key long, rid long, n int, place int"
    postings = spark.createDataFrame(rows, schema).repartition(2).mapInArrow(counted, schema)
    got = sorted(tuple(r) for r in jaccard_join._shared(postings).collect())
    ends = {1: (5, 7), 3: (6, 9)}
    assert got == sorted((*r, *ends[r[0]]) for r in rows if r[0] in ends)
    assert formed.value == len(rows)


def test_boundary_weighs_subsets_against_lists():
    assert jaccard_join.boundary({5: 100, 6: 100}, 0.0) < jaccard_join.boundary({5: 100, 6: 100}, 50.0) <= jaccard_join.MOST_LIGHT
    assert jaccard_join.least_overlap(7, 7) == 6 and jaccard_join._light_counts(8) == [6, 7]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}


def brute_repeats(rows):
    words = {k: WORD.findall(t or "") for k, t in rows}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i:i + 13]), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < k:
                gone.update(range(i, i + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_repeats_equal_all_windows(spark, seed):
    rows = [r[:2] for r in corpus.rows(seed)] + [(900 + k, "y " * (12 + k)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.digest_repeats(docs).collect()} == {k: v[:3] for k, v in want.items()}
    if seed == 2:
        assert {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(docs.withColumn("marks", F.lit(1))).collect()} == {k: v[3] for k, v in want.items()}
        assert repeats.digest_repeats(corpus.empty(spark)).count() == 0


def test_repeats_null_and_equal_ids(spark):
    text = " ".join(f"k{j}" for j in range(20))
    got = repeats.remove_repeats(spark.createDataFrame([(None, text), (5, text), (5, text), (6, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (5, 0), (5, 0), (6, 20)]


def brute_leaks(docs, items):
    """The rule alone: every shift, every window."""
    out = {}
    for d, text in docs:
        words = [w.lower() for w in WORD.findall(text or "")]
        for b, item in items:
            target = [w.lower() for w in WORD.findall(item or "")]
            if not target:
                continue
            size = min(decontaminate.WINDOW, len(target))
            for start in range(-len(target) + 1, len(words)):
                equal = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(target)]
                if sum(equal) * 100 < size * decontaminate.EQUAL_PERCENT:
                    continue
                best = max(sum(equal[s:s + size]) for s in range(len(target) - size + 1))
                if best * 100 >= size * decontaminate.EQUAL_PERCENT:
                    out[d, b] = min(out.get((d, b), (0, 0)), (-best, start))
    return {k: (-best, start) for k, (best, start) in out.items()}


@pytest.mark.parametrize("size", range(1, decontaminate.WINDOW + 1))
def test_masks_reach_every_allowed_pattern(size):
    masks = decontaminate.FAMILIES[decontaminate.family_of(size)]
    replaced = size - -(-size * decontaminate.EQUAL_PERCENT // 100)
    placed = [{p + k for k in mask} for mask in masks for p in range(size - mask[-1])]
    assert placed
    for pattern in itertools.combinations(range(size), replaced):
        assert any(place.isdisjoint(pattern) for place in placed), pattern


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SEEDS, 0])
def test_leaks_tolerate_substitutions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    rng = np.random.default_rng(5)
    sizes = (2, 4, 5, 7, 9, 10, 11, 15, 16, 20, 24, 40, 40)
    items = [(k, " ".join(f"b{int(x)}" for x in rng.integers(0, 400, n))) for k, n in enumerate(sizes)] + [(20, None), (21, " \t"), (1, "b1 " * 9), (None, "b1 b2 b3")]
    docs = []
    for k in range(130):
        words = items[k % len(sizes)][1].split()
        for _ in range(k // len(sizes) % 7):
            words[int(rng.integers(0, len(words)))] = "swap"
        docs.append((k, f"Pre fix {' '.join(words[:-1] if k % 5 == 0 else words).upper()}\tend of it"))
    long = [f"x{int(x)}" for x in rng.integers(0, 50, 30_000)]
    docs += [(200, None), (201, ""), (202, items[10][1]), (202, items[10][1]), (203, " ".join(long + items[4][1].split() + long[:99])), (204, items[4][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_seed", F.lit(1)).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_n", F.lit(7))
    got = {(r["doc_id"], r["item_id"]): (r["equal_words"], r["doc_start"]) for r in decontaminate.leaks(frame, bench).collect()}
    want = brute_leaks(docs, [x for x in items if x[0] is not None])
    assert got == want and len(got) > 60 and {(203, 4), (204, 4)} <= set(got)
    kept = decontaminate.without_leaks(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.leaks(frame, bench.filter("false")).count() == 0 and decontaminate.leaks(frame.filter("false"), bench).count() == 0


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    v = (centres[rng.integers(0, 20, 900)] + 0.4 * rng.normal(size=(900, 32))).astype(float)
    v[10], v[11] = v[0], v[0]
    rows = [(k, x.tolist(), "z") for k, x in enumerate(v)] + [
        (900, None, "z"), (950, [0.0] * 32, "z"), (1000, [float("nan")] + [1.0] * 31, "z"), (1001, [None] + [1.0] * 31, "z"), (1050, [float("inf")] + [1.0] * 31, "z"), (1100, [1.0] * 5, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = {}
    for r in code_index.nearest(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    assert sorted(got) == list(range(0, 900, 50)) and all(len(x) == 5 for x in got.values())
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        order = np.lexsort((np.arange(900), -score))[:5]
        hits += len({k for k, _ in found} & set(order.tolist()))
        assert all(abs(score[k] - s) < 1e-12 for k, s in found)
    assert hits >= 0.9 * 5 * len(got) and [k for k, _ in got[0]][:2] == [10, 11]
    assert code_index.nearest(frame.limit(1), F.col("id") % 50 == 0).count() == 0
    assert code_index.nearest(frame.filter("false"), F.col("id") % 50 == 0).count() == 0
    few = {r["vec_id"] for r in code_index.nearest(frame.filter("vec_id < 3"), F.col("id") == 0).collect()}
    assert few == {1, 2}


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    q, x = rng.integers(0, 256, (9, 8), dtype=np.uint8), rng.integers(0, 256, (300, 8), dtype=np.uint8)
    for radius in (20, 26, 33, 64):
        a, b = code_index.candidates(q, x, radius, 8)
        far = np.array([[bin(int.from_bytes(i.tobytes(), "big") ^ int.from_bytes(j.tobytes(), "big")).count("1") for j in x] for i in q])
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(*[y.tolist() for y in np.nonzero(far <= radius)]))
    assert Counter(a.tolist())[0] == 300
