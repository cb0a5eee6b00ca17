import hashlib
import random
import zlib
from collections import defaultdict

from trackloom.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, shared):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    seqs = dict(own)
    if shared:
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            seqs[c] = own.get(c - (abs(c) % 5 if c > 0 else -(abs(c) % 5)), [])[:h] + v[h:]
    members, kids = defaultdict(list), defaultdict(int)
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    total = {k: [int(not kids[k]), (len(m) - 1) * len(k[-1][1].encode()) if k else 0] for k, m in members.items()}
    for k in sorted(members, key=len, reverse=True):
        if k:
            total[k[:-1]] = [a + b for a, b in zip(total[k[:-1]], total[k], strict=True)]
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], *total[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def made(df, shared=True):
    return sorted(repr(tuple(r)) for r in trie.prefix_trie(df, shared).select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, key string")


def test_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    for shared in (True, False):
        assert made(df, shared) == brute(rows, shared)


def test_edge_rows(spark):
    rows = [(None, 1, "user", "lost"), (0, None, None, None), (0, 0, "", ""), (0, 0, "", ""), (1, 3, "b", "x"), (1, 3, "a", "y"), (-4, 1, "user", "é" * 50_000), (-10, 1, "user", "n"), (-7, 2, "q", None), (10**18 + 3, 1, "user", "far")]
    rows += [(7, i % 3, "ab", "c") for i in range(6)] + [(8, i % 3, "a", "bc") for i in range(6)]
    for shared in (True, False):
        assert made(frame(spark, rows), shared) == brute(rows, shared)
    assert made(frame(spark, rows).limit(0)) == []


def test_copies_and_turnless_conversations(spark):
    # copies whose beginnings are those of a conversation with fewer turns, or of none: some lose all their turns
    rows = [(c, t, "user", f"t{t}") for c in range(1, 400) for t in range(c % 4 + 1) if c % 15]
    assert made(frame(spark, rows).repartition(9)) == brute(rows, True)


def test_a_conversation_over_many_partitions(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(3, i, rnd.choice("ab"), rnd.choice("xyz")) for i in range(3000)] + list(rows_of(rnd)) + [(c, 0, "a", "x") for c in range(20, 300)]
    want = brute(rows, True)
    monkeypatch.setattr(trie, "BLOCK", 100)
    monkeypatch.setattr(trie, "TOGETHER", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert made(frame(spark, rows)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(rnd):
    """Two conversations with the same first thousand turns."""
    same = [(i, rnd.choice("ab"), rnd.choice("xyz")) for i in range(1000)]
    for conv in (5, 10):
        yield from ((conv, i, r, t) for i, r, t in same)
        yield conv, 1000, "a", str(conv)


def test_rounds_are_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    cut = trie.Scratch.cut

    def counted(self, df):
        if df.columns == ["key", "leaves", "saved"]:
            rounds.append(1)
        return cut(self, df)

    monkeypatch.setattr(trie.Scratch, "cut", counted)
    rows = [(0, i, "a", "x") for i in range(200)] + [(1, i, "a", "x") for i in range(100)]
    assert made(frame(spark, rows), False) == brute(rows, False)
    assert len(rounds) == (200).bit_length()
