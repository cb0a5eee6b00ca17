import random
import struct
import zlib

import numpy as np
import pytest

from trackloom.llm import packing
from trackloom.llm.queries import ranks_path


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer(tokenizer):
    random.seed(1)
    e = packing.Encoder(ranks_path())
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "1", "é", "<|endoftext|>", ".", "　", "\xa0", "\x1c", "😀", "中"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 25))) for _ in range(3000)] + ["", "x" * 20_000]
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check(df, rows, tokenizer, size=packing.SIZE):
    got = packing.pack(df, ranks_path(), size, with_ids=True).collect()
    left = sorted((str(d), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in rows)
    by, places = {}, {}
    for r in got:
        assert zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"] and r["length"] == len(r["ids"])
        by.setdefault(str(r["doc_id"]), []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(len(ids) for _, ids in left) == sum(r["length"] for r in got)
    for d, own in by.items():
        texts = [ids for k, ids in left if k == d]
        if len(texts) == 1:
            own.sort(key=lambda r: r["piece"])
            assert tuple(i for r in own for i in r["ids"]) == texts[0]
            assert [r["piece"] for r in own] == list(range(len(own))) and (len(own) == 1) == (len(texts[0]) <= size)
            assert all(r["length"] == size for r in own[1:])
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= size
    return len(places), sum(r["length"] for r in got)


def test_documents(spark, sf, tokenizer):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    n, total = check(df, rows, tokenizer)
    assert n <= 1.06 * total / packing.SIZE + 1


def test_edge_rows(spark, tokenizer):
    rows = [(1, None), (2, ""), (2, "hello there"), (None, "x " * 3000), (5, "same"), (5, "same"), (6, "a" * 5000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int")
    check(df, rows, tokenizer)
    check(df, rows, tokenizer, 8)
    assert packing.pack(df.limit(0), ranks_path()).count() == 0


def test_solver_uses_every_piece_and_stays_near_the_bound():
    for seed, n in enumerate((1, 300, 20_000)):
        lengths = np.minimum(1024, np.random.default_rng(seed).lognormal(6, 1.2, n).astype(int) + 1)
        counts = np.bincount(lengths, minlength=1025)
        used = np.zeros(1025, int)
        plan = packing.solve(counts)
        for need, k in plan:
            assert sum(p * m for p, m in need.items()) <= 1024
            for p, m in need.items():
                used[p] += m * k
        assert (used == counts).all() and sum(k for _, k in plan) <= 1.03 * -(-lengths.sum() // 1024) + 1
        assert len(plan) <= 3 * 1024


def test_ids_of_whole_texts(tokenizer):
    import duckdb

    e = packing.Encoder(ranks_path())
    for (text,) in duckdb.sql("select coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet'").fetchall():
        assert np.frombuffer(e.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def fewest(lengths, size):
    """The least number of sequences, by trying every place of every piece."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {*rooms}:
            if room >= lengths[i]:
                k = rooms.index(room)
                put(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, size - lengths[i]])

    put(0, [])
    return best[0]


def test_solver_against_an_exact_one():
    rng, over = np.random.default_rng(5), 0
    for _ in range(150):
        size = int(rng.integers(8, 40))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 11)))
        got = sum(n for _, n in packing.solve(np.bincount(lengths, minlength=size + 1), size))
        over += got - fewest(lengths.tolist(), size)
        assert got <= fewest(lengths.tolist(), size) + 1
    assert over <= 8


def test_index_of_sums():
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = rng.integers(0, 3, 25)
        counts[0], counts[rng.integers(1, 25, 12)] = 0, 0
        sums = packing.Sums(counts)
        pool = np.repeat(np.arange(25), counts).tolist()
        pairs = {tuple(sorted((pool[i], pool[j]))) for i in range(len(pool)) for j in range(i)}
        triples = {tuple(sorted((pool[i], pool[j], pool[k]))) for i in range(len(pool)) for j in range(i) for k in range(j)}
        for gap in range(1, 25):
            assert sums.pairs[gap] == sum(sum(p) == gap for p in pairs)
            got = sums.exact(gap, 0)
            fits = [p for p in (*pairs, *triples) if sum(p) == gap]
            if counts[gap]:
                assert got == [gap]
            else:
                assert sum(x * x for x in got) == max((sum(x * x for x in p) for p in fits), default=0) and (not fits or tuple(sorted(got)) in fits)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_pairs_and_triples_fill_gaps(table):
    import duckdb

    e, lengths = packing.Encoder(ranks_path()), []
    for (text,) in duckdb.sql(f"select coalesce(text, '') from '/root/testdata/{table}/documents.parquet'").fetchall():
        lengths += [n for _, n in packing.cuts(len(e.encode(text)) // 4 + 1, packing.SIZE)]
    plan = packing.solve(np.bincount(lengths, minlength=packing.SIZE + 1))
    full = {k: sum(n for need, n in plan if sum(need.values()) == k and sum(p * m for p, m in need.items()) == packing.SIZE) for k in (2, 3, 4)}
    assert full[2] > 0 and full[3] > 0 and full[4] >= (table == "sf0.001")
    assert sum(n for _, n in plan) <= 1.01 * -(-sum(lengths) // packing.SIZE)


def test_packing_hands_texts_over_in_small_batches_and_plans_no_rows_of_lists(spark, monkeypatch):
    from trackloom.llm.common import TEXTS_TOGETHER

    real, n = packing.pieces, 2 * TEXTS_TOGETHER + 500

    def held(batches):
        for b in batches:
            assert b.num_rows <= TEXTS_TOGETHER, b.num_rows
            yield b

    monkeypatch.setattr(packing, "pieces", lambda docs, *a: real(docs.mapInArrow(held, docs.schema), *a))
    got = packing.pack(spark.range(0, n, 1, 1).selectExpr("id as doc_id", "'some words' as text"), ranks_path(), with_ids=True)
    assert "ExistingRDD" not in got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == n and len({(r["sequence_id"], r["offset"]) for r in rows}) == n
