"""Duplicates against plain versions, with nulls, repeats, clashing columns and empty tables."""

import hashlib
import itertools
import random
from collections import Counter

import pytest

from tickloom.llm import exact, near
from tickloom.llm.graph import components

SCHEMA = "doc_id long, text string, id long, row long, key string, bucket int, plain string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, "p") for i, t in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return Counter((i, max(g := groups[lower(t)]), len(g), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


CASES = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (6, "  "), (7, "abc É"), (8, "x " * 60000), (9, "X " * 60000), (10, "İ"), (11, "i̇")]


@pytest.mark.parametrize("heads", [100_000, 2])
def test_exact_matches_plain(spark, heads):
    rows = CASES + [(20 + i, f"Text {i % 17}") for i in range(120)]
    got = exact.exact_duplicates(frame(spark, rows), bucket_heads=heads).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_repeats_nulls_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = exact.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((r.group_size, r.kept) for r in got) == sorted([(4, True), (4, False), (4, False), (4, False), (2, True), (2, False), (1, True)])
    assert {r.keep_id for r in got if r.group_size == 4} == {1}
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    few = [(i << 60, 1) for i in range(4)]  # 4 keys spread out
    many = [((i << 40) + 1, 1) for i in range(64)]  # 64 keys below one prefix
    heads = spark.createDataFrame(few + many, "key long, n int")
    cells, levels = exact.directory(heads, bucket_heads=16)
    depths = {r.depth for r in cells.collect()}
    assert len(depths) > 1 and max(depths) == levels


def plain_near(rows, percent=75):
    sets = [(i, near.shingle_set(t or "", 5)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, "one two three four five six")], []
    for k in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 120, 400]))]
        for _ in range(rng.choice([1, 3, 7])):
            new = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                new[rng.randrange(len(new))] = rng.choice(words)
            rows.append((100 * k + rng.randrange(10, 90) * 100_000, " ".join(new)))
            if rng.random() < 0.4:  # chains: the next one departs from this one
                base = new
    passage = [rng.choice(words) for _ in range(60)]
    for k in range(25):  # one passage in many otherwise different texts
        rows.append((90_000_000 + k, " ".join([rng.choice(words) for _ in range(30)] + passage + [rng.choice(words) for _ in range(20)])))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_matches_plain(spark, seed):
    rows = near_rows(seed)
    got = near.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b C d e f")]
    got = sorted(near.near_duplicates(frame(spark, rows)).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        [("None", 2, "None", True), ("3", 2, "3", True), ("3", 2, "3", True), ("9", 2, "3", False)]
    )
    assert near.near_duplicates(frame(spark, [])).count() == 0


def test_star_rounds_find_what_the_first_centre_misses(spark):
    """A hub linked with every spoke, spokes not linked among themselves, and the hub not the smallest id."""
    base = [f"h{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for k in range(14):
        new = list(base)
        for j in range(5):
            new[(k * 13 + j * 37) % 200] = f"s{k}x{j}"
        rows.append((k + 1, " ".join(new)))
    got = near.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near(rows)


def test_components_on_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(30))
