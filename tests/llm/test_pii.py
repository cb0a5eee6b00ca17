import hashlib
import math
import random
import re
import time
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from trackloom.llm import pii

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, f in FORMS for m in re.finditer(f, t or "") if valid(k, m[0])]


def check(df, rows):
    want = sorted((str(i), brute(t)) for i, t in rows)
    got = sorted((str(r["doc_id"]), r) for r in pii.digest(pii.find(df)).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, r), (_, b) in zip(got, want, strict=True):
        assert r["base_sha256"] == hashlib.sha256(",".join(b).encode()).hexdigest()
        assert r["spans"].startswith(",".join(b))
        assert [r[f"n_{k}"] for k, _ in FORMS] == [sum(x.startswith(k + ":") for x in b) for k, _ in FORMS]


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_forms_against_plain_ones(spark):
    random.seed(5)
    parts = ["1", "12", "255", "4", "999", "4111111111111111", "4111 1111 1111 1111", "+", "+1 ", "(", ")", "-", " ", ",", ".", "@", "a", "b.c", "x_", "é", "%", "😀", "\n", "AKIA12345678", "a@b.c", "0", "00"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 22)))) for i in range(2000)]
    rows += [(-1, None), (-2, ""), (-3, "9" * 30_000 + "a" * 30_000 + "+1" + " " * 20_000 + "5." * 9000), (-4, "a@b.cc " * 500)]
    check(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int"), rows)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please contact agent u{i}@mail.example.com today or leave") for i in range(30)]
    rows += [(100, "please contact agent ZX-4471-9920 today or leave"), (101, "the model ZX-9999-1111 was sold"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    assert got[100] == "identifier:21:33" and got[101] == "" and got[None] == "" and got[3] == "email:21:40"
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[100] == "please contact agent <IDENTIFIER> today or leave" and red[3] == "please contact agent <EMAIL> today or leave" and red[None] is None


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.cc now", "x"), (1, "mail a@b.cc now", "x"), (2, "no 4111111111111111 é 10.0.0.1", "y"), (3, "", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted(map(tuple, pii.redact(df).collect()), key=str)
    assert got == sorted([(1, "mail <EMAIL> now", "x"), (1, "mail <EMAIL> now", "x"), (2, "no <CARD> é <IP>", "y"), (3, "", "z"), (None, None, None)], key=str)
    assert pii.redact(df.limit(0)).count() == 0


def test_plans_have_no_python(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for out in (pii.digest(pii.find(df)), pii.redact(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


TOKEN = regex.compile(r"(?<![\p{L}\p{N}_@.+/-])(?=[\p{L}_@.+/-]*[0-9])[\p{L}\p{N}_@.+/-]{4,}[\p{L}\p{N}]")
LABEL = r"""(?i:token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?["']?\x20{0,2}[=:]\x20{0,2}["']?"""
SECRET = regex.compile(rf"""(?<={LABEL})(?=[^\s"'`,;<>(){{}}\[\]=:])(?=[^\s"'`,;<>(){{}}\[\]]*[0-9])[^\s"'`,;<>(){{}}\[\]]{{5,}}[\p{{L}}\p{{N}}=]""")


def shape(m):
    for form, mark in ((r"\p{L}+[0-9][\p{L}0-9]*|[0-9]+\p{L}[\p{L}0-9]*", "#"), (r"[0-9]+", "9"), (r"\p{L}+", "a")):
        m = regex.sub(form, mark, m)
    return m


def secrets(t):
    """Values of fields with a telling label that no base span overlaps."""
    base = [tuple(map(int, s.split(":")[1:])) for s in brute(t)]
    return [m.span() for m in SECRET.finditer(t or "") if not any(x < m.end() and m.start() < y for x, y in base)]


def bootstrap(texts):
    """Discovered spans of each text, by the same rules in plain Python."""
    clean = lambda w: re.sub(r"[^\w=:]|_", "", w).lower()
    slots, graph, failed = [], defaultdict(dict), set()
    for i, t in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in brute(t)]
        named = secrets(t)
        for kind, form in [*FORMS, ("secret", SECRET.pattern), ("token", TOKEN.pattern)]:
            ms = [m.span() for m in regex.finditer(form, t)]
            for k, (a, b) in enumerate(ms):
                if kind == "token" and any(x < b and a < y for x, y in base + named) or kind == "secret" and (a, b) not in named or kind in dict(FORMS) and not valid(kind, t[a:b]):
                    continue
                before = regex.sub(r"""["'`(\[{<«]+$(?!\n)""", "", t[ms[k - 1][1] if k else 0 : a]).split()
                after = regex.sub(r"\A[\p{P}\p{S}]+", "", t[b : ms[k + 1][0] if k + 1 < len(ms) else len(t)]).split()
                l1, l2, r1 = clean(before[-1]) if before else "", clean(before[-2]) if len(before) > 1 else "", clean(after[0]) if after else ""
                made = [f"l1 {l1}" if l1 else "", f"l2 {l2} {l1}" if l1 and l2 else "", f"r1 {r1}" if r1 else "", f"lr {l1} {r1}" if l1 and r1 else ""]
                label = l2 if l1 in ("=", ":") else re.sub("[=:]", "", l1) if l1[-1:] in ("=", ":") else ""
                made += [f"f {label}" if label else "", f"s {l1} {shape(t[a:b])}" if l1 else ""]
                for p in filter(None, made):
                    graph[p][t[a:b].lower()] = graph[p].get(t[a:b].lower(), False) or kind != "token"
                failed |= {t[a:b].lower()} if kind == "token" and (shape(t[a:b]) == "9.9.9.9" or shape(t[a:b]) == "9" and 16 <= b - a <= 19) else set()
                if kind == "token":
                    slots.append((i, a, b))
    seeds = {x for own in graph.values() for x, seed in own.items() if seed}
    known = set(seeds)
    while True:
        doubt = {}
        for p, own in graph.items():
            hits = sum(x in known for x in own)
            if hits >= pii.MIN_KNOWN and hits >= pii.MIN_SHARE * len(own) and hits < len(own):
                doubt[p] = 1 - hits / (len(own) + 1)
        votes = defaultdict(list)
        for p, d in doubt.items():
            for x in graph[p]:
                if x not in known and x not in failed:
                    votes[x].append(math.log(d))
        new = {x for x, v in votes.items() if len(v) >= pii.MIN_PATTERNS and 1 - math.exp(sum(v)) >= pii.MIN_CHANCE}
        if not new:
            break
        known |= new
    out = defaultdict(list)
    for i, a, b in slots:
        if texts[i][a:b].lower() in known:
            out[i].append(f"identifier:{a}:{b}")
    return out


def test_bootstrap_equals_plain_python(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet' order by 1").fetchall()
    rows += [(-1 - i, f"{t[:300]} ask agent u{i}@mail.example.com now." + f" Or ask agent ID-{i:06d} now" * (i < 12)) for i, (_, t) in enumerate(rows[:40])]
    want = bootstrap([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("identifier")] for r in pii.digest(pii.find(df)).collect()}
    assert got == {d: want[i] for i, (d, _) in enumerate(rows)}
    assert sum(map(len, want.values())) >= 12


def test_values_of_labelled_fields_and_what_their_contexts_find(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    rows = [(i, f'der Text token = "{h}" und mehr') for i, h in enumerate(hexes)] + [(20 + i, f"export AUTH_SIG {h} now") for i, h in enumerate(hexes)]
    rows += [(50, "export AUTH_SIG ключ-77-õö12 now"), (51, "the token: something else"), (52, "API-KEY:'Zz9.q+1/w=='"), (53, "password = a@b.cc12"), (54, "tokens=abc12"), (55, "see export 20240101 now"), (56, 'secret = "' + "(" * 20_000 + "x1"), (None, None)]
    rows += [(60 + i, f"pay by {4111111111111111 + 10**9 * 9 * i} please") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["n_spans"]) for r in pii.digest(pii.find(df)).collect()}
    assert all(got[i] == ("secret:18:58", 1) and got[20 + i] == ("identifier:16:56", 1) for i in range(12))
    assert got[50] == ("identifier:16:28", 1) and got[52] == ("secret:9:20", 1) and got[53] == ("email:11:19", 1)
    assert all(got[i] == ("", 0) for i in (51, 54, 55, 56, None))
    cards = [i for i in range(60, 100) if brute(dict(rows)[i])]
    assert 3 < len(cards) < 40 and all(got[i] == (("card:7:23", 1) if i in cards else ("", 0)) for i in range(60, 100))
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[0] == 'der Text token = "<SECRET>" und mehr' and red[20] == "export AUTH_SIG <IDENTIFIER> now" and red[51] == "the token: something else"


def test_hidden_seeds_are_found_by_context(spark):
    """A third of the seeds is hidden; contexts that seeds share bring them back, contexts of their own can't."""
    rows = [(f"please write to agent {'u%d@mail.example.com' % i if i % 2 else '10.0.%d.%d' % (i // 200, i % 200)} at once",) for i in range(300)]
    rows += [(f"word{i}x u{i}x@mail.example.com word{i}y",) for i in range(100)] + [("please sell agent-007 at once",)]
    got = pii.recovery(spark.createDataFrame(rows, "text string")).first()
    alone = pii.recovery(spark.createDataFrame(rows[300:400], "text string")).first()
    assert got["n_seeds"] == 400 and 80 < got["n_hidden"] < 160 and got["n_others"] == 0
    assert 60 < got["n_recovered"] < got["n_hidden"] and alone["n_hidden"] > 15 and alone["n_recovered"] == 0
    assert tuple(pii.recovery(spark.createDataFrame([], "text string")).first()) == (0, 0, 0, 0)


def test_discovery_goes_on_until_a_round_adds_nothing(spark):
    """A chain: each kind of context is vouched for by the identifiers that the one before it discovered."""
    rows = [f"aa bb a{i:07d}@x.yy cc" for i in range(400)]
    for k, n in enumerate((160, 64, 26, 11, 4)):
        own = (f"ab{k}", f"cd{k}")
        before = ("aa bb {} cc", *[f"ab{j} cd{j} {{}} ef{j}" for j in range(k)])[-1]
        rows += [before.format(f"key{k}n{i:05d}") for i in range(n)] + [f"{own[0]} {own[1]} key{k}n{i:05d} ef{k}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    want = bootstrap(rows)
    assert {i: [s for s in got[i].split(",") if s.startswith("identifier")] for i in got} == {i: want[i] for i in got}
    assert sum("identifier" in s for s in got.values()) == 2 * 265


def test_long_words_are_read_whole(spark):
    long = "k" * 300
    rows = [(i, f"{long} u{i}@mail.example.com {long}") for i in range(30)] + [(90, f"{long} AB-4471-9920 {long}"), (91, f"{long[1:]} AB-4471-9999 {long[1:]}")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[90] == "identifier:301:313" and got[91] == ""


def test_a_text_of_very_many_matches(spark):
    n = 50_000
    text = " ".join(f"write u{i}@mail.example.com or id AB-{i:07d} é" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "no"), (3, None)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert time.time() - began < 60
    assert got[1]["n_email"] == n and got[1]["base_sha256"] == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert red[1].startswith("write <EMAIL> or id ") and red[1].count("<EMAIL>") == n and "@" not in red[1] and red[2] == "no" and red[3] is None


def test_overlapping_spans_and_running_values(spark):
    random.seed(7)
    for n in (0, 1, 2, 5, 17, 100):
        v = [random.randint(-3, 9) for _ in range(n)]
        df = spark.createDataFrame([(v,)], "v array<bigint>")
        total, best = [sum(v[: i + 1]) for i in range(n)], [max([0, *v[: i + 1]]) for i in range(n)]
        assert df.select(F.expr(pii.running("v", pii._sum)), F.expr(pii.running("v", pii._most))).first() == (total, best)
    for _ in range(20):
        text = "".join(random.choice("abcé😀 ") for _ in range(40))
        spans = sorted((a, -min(40, a + random.randint(1, 9)), "email") for a in random.choices(range(40), k=random.randint(1, 12)))
        out, at = "", 0
        for a, b, k in spans:
            if a >= at:
                out += text[at:a] + "<EMAIL>"
            at = max(at, -b)
        df = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:bigint,minus:bigint,kind:string>>")
        assert df.select(pii._marked("text", "spans")).first()[0] == out + text[at:]
