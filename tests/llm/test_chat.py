import itertools
import random
import re

from trackloom.llm import chat


def brute(roles):
    best = 1 << 60
    for path in itertools.product((1, 2, 3), repeat=len(roles)):
        at, cost = 0, 0
        for r, to in zip(roles, path, strict=True):
            own = chat._as(r)
            cost += (0 if r == chat.ROLES[to] else chat.NAME if own == to else chat.RELABEL) if own else chat.NAME
            ways = ([chat.MERGE] if at == to else []) + ([chat.INSERT * len(chat._BETWEEN[at, to])] if chat._BETWEEN[at, to] is not None else [])
            if not ways:
                cost = 1 << 60
                break
            cost, at = cost + min(ways), to
        best = min(best, cost + chat.END[at])
    return best


def legal(text):
    roles = re.findall(r"^<\|(system|user|assistant)\|>$", text, re.M)
    roles = roles[roles[:1] == ["system"] :]
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and text.count("<|end|>") == len(re.findall(r"^<\|", text, re.M)) - text.count("\n<|end|>")


def conversations(df):
    out = {}
    for r in chat.format_chats(df).orderBy("conv_id", "place", "seq").collect():
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_least_cost_equals_brute_force():
    random.seed(1)
    for _ in range(300):
        roles = [random.choice(["system", "user", "assistant", "human", "tool", None]) for _ in range(random.randint(1, 6))]
        cost, moves = chat.repair(roles)
        assert cost == brute(roles) and len(moves) == len(roles)


def test_stretches_combine_to_the_whole():
    random.seed(2)
    for _ in range(50):
        roles = [random.choice(["system", "user", "assistant", None]) for _ in range(40)]
        parts = [roles[i : i + 7] for i in range(0, 40, 7)]
        ways = chat.thread([chat.matrix(p) for p in parts])
        cost = sum(chat.matrix(p)[4 * a + b] for p, (a, b) in zip(parts, ways, strict=True)) + chat.END[ways[-1][1]]
        assert cost == chat.repair(roles)[0]


def first_way(roles):
    """Of all cheapest ways, the states of the first one by the states from the end on."""
    best = (1 << 60, ())
    for path in itertools.product((1, 2, 3), repeat=len(roles)):
        at, cost = 0, 0
        for r, to in zip(roles, path, strict=True):
            ways = [c for a, b, c, _ in chat.moves(r) if (a, b) == (at, to)]
            cost, at = cost + min(ways, default=1 << 60), to
        best = min(best, (cost + chat.END[at], path[::-1]))
    return best[1][::-1]


def test_the_way_chosen_does_not_follow_from_the_cuts():
    rnd = random.Random(3)
    names = ["system", "user", "assistant", "human", "tool", None, "System"]
    for _ in range(150):
        roles = [rnd.choice(names) for _ in range(rnd.randint(1, 7))]
        want = first_way(roles)
        for _ in range(4):
            cuts = sorted({0, len(roles), *rnd.sample(range(len(roles)), rnd.randint(0, len(roles) - 1))})
            parts = [roles[a:b] for a, b in itertools.pairwise(cuts)]
            ways = chat.thread([chat.matrix(p) for p in parts])
            got = [m for p, (a, b) in zip(parts, ways, strict=True) for m in chat.decode(p, a, b)]
            assert tuple(s for _, s, _ in got) == want
    roles = [rnd.choice(names) for _ in range(2000)]
    seen = set()
    for step in (1, 3, 64, 511, 2000):
        parts = [roles[i : i + step] for i in range(0, 2000, step)]
        ways = chat.thread([chat.matrix(p) for p in parts])
        seen.add(tuple(m for p, (a, b) in zip(parts, ways, strict=True) for m in chat.decode(p, a, b)))
    assert len(seen) == 1


def test_long_conversations_do_not_depend_on_partitions(spark):
    rnd = random.Random(4)
    rows = [(c, i, rnd.choice(["system", "user", "assistant", "tool", None]), f"t{i}") for c in (1, 2) for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before, got = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}, set()
    try:
        for n, adaptive in ((1, "true"), (3, "false"), (8, "true"), (13, "false"), (16, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got.add(tuple(sorted(map(str, chat.format_chats(df).collect()))))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 1


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = conversations(df)
    assert len(got) == df.select("conv_id").distinct().count()
    texts = {c: "".join(r["rendered"] for r in rows) for c, rows in got.items()}
    assert all(map(legal, texts.values()))
    for r in df.collect():
        assert r["text"] in texts[r["conv_id"]]


def test_edge_rows_and_one_long_conversation(spark):
    rows = [(1, i, random.choice(["user", "assistant"]), f"t{i}") for i in range(4000)]
    rows += [(None, 0, None, None), (None, 1, "user", "x"), (2, None, "Human ", ""), (3, 0, "user", "s"), (3, 0, "user", "s"), (3, 1, "assistant", "a"), (4, 0, "assistant", "hi")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = conversations(df.repartition(8))
    assert all(legal("".join(r["rendered"] for r in rows)) for rows in got.values())
    assert [r["turn"] for r in got[1] if r["action"] != "insert"] == list(range(4000))
    assert sum(r["action"] == "merge" for r in got[3]) == 1 and "".join(r["rendered"] for r in got[4]).startswith(("<|user|>\n<|end|>\n<|assistant|>\nhi", "<|user|>\nhi"))
    assert conversations(df.limit(0)) == {}


def test_rows_do_not_depend_on_how_they_are_dealt(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, chat.format_chats(df.repartition(int(n))).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
