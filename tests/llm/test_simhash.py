import re

import xxhash

from trackloom.llm import simhash

ROWS = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", "y"), (None, "q r s t", "z"), (None, "q r s t", "z"), (None, None, "n"), (3, "", "e"), (4, "zz yy xx", "r"), (4, "kk ll mm", "r")]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(r[0], ids.get(find(i), r[0]))
    return sorted(((r[0], f"{fp[i]:016x}", ids.get(find(i))) for i, r in enumerate(rows)), key=str)


def got(df, **options):
    out = simhash.near_duplicates(df, **options)
    return sorted(map(tuple, out.select("doc_id", simhash.hex16("fp"), "component_id").collect()), key=str)


def test_documents_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert got(df) == want
    assert got(df, list_limit=1) == want  # every list is split as far as it goes


def test_edge_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp string")
    assert got(df) == brute(ROWS)
    assert got(df.limit(0)) == []


def test_long_text():
    text = "word other thing " * 30_000 + "Ünïcode A\x85B"
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_blocks_meet_every_pair_once_or_more():
    assert len(simhash.BLOCKS) == 14
    from itertools import combinations

    assert all(any(not set(b) & set(c) for b in simhash.BLOCKS) for c in combinations(range(8), 3))


def test_long_lists_are_split_without_losing_a_link(spark):
    """Fingerprints crowded around a few values, so that lists are long at every step."""
    import random

    from pyspark.sql import functions as F

    from trackloom.llm.common import Scratch, star_components

    random.seed(3)
    made = set()
    for base in (random.getrandbits(64), random.getrandbits(64)):
        for _ in range(500):
            x = base
            for _ in range(random.randint(0, 9)):
                x ^= 1 << random.choice([*range(24), *random.choices(range(64), k=6)])
            made.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in made)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: find(x) for x in fps if find(x) != x}
    for limit in (simhash.LIST_LIMIT, 50, 5):
        scratch = Scratch(spark)
        edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), scratch, limit)
        assert {r["u"]: r["root"] for r in star_components(edges, scratch).where(F.col("u") != F.col("root")).collect()} == want


def test_keep_one(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    groups = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted({g[2] for g in groups})
    kept = simhash.keep_one(spark.createDataFrame(ROWS, "doc_id long, text string, key string"))
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e", "x"), (3, "", "e"), (4, "kk ll mm", "r"), (4, "zz yy xx", "r"), (None, "q r s t", "z")]


def test_components_end_with_the_first_stars(spark):
    """Edges that are stars are their own components: one table is written. A chain takes rounds; no edges, none."""
    from trackloom.llm.common import Scratch, star_components

    def roots(edges):
        scratch = Scratch(spark)
        got = star_components(spark.createDataFrame(edges, "u long, v long"), scratch)
        return {r["u"]: r["root"] for r in got.collect()}, scratch.n

    assert roots([(5, 1), (1, 7), (7, 1), (9, 8), (3, 3)]) == ({5: 1, 7: 1, 9: 8}, 1)
    assert roots([]) == ({}, 1)
    assert roots([(2, 1), (3, 1), (3, 2)])[0] == {2: 1, 3: 1}
    chain, n = roots([(i, i + 1) for i in range(40)] + [(60, 50), (60, 55)])
    assert chain == {**{i: 0 for i in range(1, 41)}, 55: 50, 60: 50} and n > 1
