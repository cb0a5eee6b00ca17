"""Chat formatting by minimum-cost role repair.

A legal conversation may open with a system turn, then user and assistant alternate, the user first, and the assistant has
the last word. Over that automaton a dynamic program chooses for every turn, in order, to keep it, relabel it, merge it into
the turn before, or insert empty turns before it, at the least total cost; the repaired sequence is then rendered.

Costs of consecutive turns combine as matrices over (min, +), which is associative; so does the order of ways that cost the same. So a conversation that holds a third of
all rows isn't a unit of work: rows are range-partitioned by conversation and turn, each stretch of a conversation in a
partition is reduced to one 4 x 4 matrix of costs and one of ranks, the matrices of a conversation (at most one for each partition) give each
stretch the state in which it starts and ends, and the stretches are then decoded by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch

#: States: what stands last so far.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "customer": USER, "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
#: Legal next states.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, NAME, INSERT = 2, 5, 1, 6
#: How a turn begins, how it ends, and what stands between texts that are merged.
OPEN, CLOSE, JOIN = "<|{role}|>\n", "<|end|>\n", "\n\n"


def _path(a: int, b: int) -> tuple[int, ...] | None:
    """The fewest states between a and b, both excluded, so that every step is legal."""
    front = [(a, ())]
    for _ in range(4):
        for s, via in front:
            if b in NEXT[s]:
                return via
        front = [(n, (*via, n)) for s, via in front for n in NEXT[s]]
    return None


_BETWEEN = {(a, b): _path(a, b) for a in range(4) for b in (SYSTEM, USER, ASSISTANT)}


def _as(role: str | None) -> int:
    """The state a role name stands for; 0 if none."""
    return ALIASES.get((role or "").strip().lower(), 0)


def _moves(role: str | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) of one turn; the cheaper of merging and starting a turn."""
    own, out = _as(role), []
    for to in (SYSTEM, USER, ASSISTANT):
        change = (0 if role == ROLES[to] else NAME if own == to else RELABEL) if own else NAME
        for at in range(4):
            if at == to:
                out.append((at, to, change + MERGE, "merge"))
            if _BETWEEN[at, to] is not None and not (at == to and change + MERGE <= change + INSERT * len(_BETWEEN[at, to])):
                out.append((at, to, change + INSERT * len(_BETWEEN[at, to]), "new"))
    return out


_known: dict[str | None, list[tuple[int, int, int, str]]] = {}


def moves(role: str | None) -> list[tuple[int, int, int, str]]:
    if role not in _known and len(_known) < 10_000:
        _known[role] = _moves(role)
    return _known.get(role) or _moves(role)


#: Cost to end in a state: after a user turn the assistant's is inserted.
END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
_NO = 1 << 40


def _steps(roles: list[str | None], entry: dict[int, int]) -> list[dict[int, tuple[int, int, str]]]:
    """For each turn: state -> (least cost, state before, action), from the entry states and their costs."""
    cost, out = dict(entry), []
    for role in roles:
        best: dict[int, tuple[int, int, str]] = {}
        for at, to, c, action in moves(role):
            if at in cost and (to not in best or (cost[at] + c, at) < best[to][:2]):
                best[to] = (cost[at] + c, at, action)
        out.append(best)
        cost = {s: v[0] for s, v in best.items()}
    return out


def matrix(roles: list[str | None]) -> list[int]:
    """Least cost from each state to each, row by row; then the rank of each such way among those that end in its state.

    Ways are ranked by their states from the end on, the state before the first turn last. So of ways that cost the same, the same
    one is chosen wherever a conversation is cut.
    """
    cost = [{at: 0} for at in range(4)]
    rank = {at: {at: 0} for at in range(4)}
    for role in roles:
        steps = [{} for _ in range(4)]
        for at, to, c, _ in moves(role):
            for entry in range(4):
                if at in cost[entry] and (to not in steps[entry] or (cost[entry][at] + c, at) < steps[entry][to]):
                    steps[entry][to] = (cost[entry][at] + c, at)
        ends = {to for s in steps for to in s}
        order = {to: sorted((steps[e][to][1], rank[steps[e][to][1]][e], e) for e in range(4) if to in steps[e]) for to in ends}
        rank = {to: {e: i for i, (_, _, e) in enumerate(found)} for to, found in order.items()}
        cost = [{to: c for to, (c, _) in s.items()} for s in steps]
    return [cost[at].get(to, _NO) for at in range(4) for to in range(4)] + [rank.get(to, {}).get(at, 4) for at in range(4) for to in range(4)]


def decode(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, int, str]]:
    """(state before, state, action) of each turn on the first of the cheapest ways from ``entry`` to ``leave``: see ``matrix``."""
    steps, at, out = _steps(roles, {entry: 0}), leave, []
    for best in reversed(steps):
        _, before, action = best[at]
        out.append((before, at, action))
        at = before
    return out[::-1]


def thread(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, leave) of each stretch on the first of the cheapest ways through all, from the start to a legal end."""
    cost, back = np.array([0, _NO, _NO, _NO]), []
    for m in matrices:
        each, rank = np.array(m).reshape(2, 4, 4)
        total = cost[:, None] + each
        back.append(np.where(total == total.min(axis=0), rank, 5).argmin(axis=0))
        cost = np.minimum(total.min(axis=0), _NO)
    at, out = int(np.argmin([c + END[s] for s, c in enumerate(cost)])), []
    for b in reversed(back):
        out.append((int(b[at]), at))
        at = int(b[at])
    return out[::-1]


def repair(roles: list[str | None]) -> tuple[int, list[tuple[int, int, str]]]:
    """Cost and moves of a whole conversation."""
    if not roles:
        return 0, []
    (entry, leave), m = thread([matrix(roles)])[0], matrix(roles)
    return m[4 * entry + leave] + END[leave], decode(roles, entry, leave)


def _runs(batches, names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal (conv, part), which stand together; a run holds at most one partition's stretch."""
    rows = (row for b in batches for row in b.to_pylist())
    for key, run in groupby(rows, key=lambda r: tuple(r[n] for n in names)):
        yield key, list(run)


def _stretches(batches):
    schema, rows = pa.schema([("conv", pa.binary()), ("part", pa.int32()), ("n", pa.int64()), ("m", pa.list_(pa.int64()))]), []
    for (conv, part), run in _runs(batches, ["conv", "part"]):
        rows.append({"conv": conv, "part": part, "n": len(run), "m": matrix([r["role"] for r in run])})
        if len(rows) == 2000:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _threads(batches):
    schema = pa.schema([("conv", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("start", pa.int64()), ("last", pa.bool_())])
    for batch in batches:
        rows = []
        for conv, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = 0
            for s, (entry, leave) in zip(stretches, thread([s["m"] for s in stretches]), strict=True):
                rows.append({"conv": conv, "part": s["part"], "entry": entry, "leave": leave, "start": start, "last": s is stretches[-1]})
                start += s["n"]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _rendered(rows: list[dict]) -> list[dict]:
    """The pieces of one stretch."""
    out: list[dict] = []
    steps = decode([r["role"] for r in rows], rows[0]["entry"], rows[0]["leave"])
    for i, (r, (before, at, action)) in enumerate(zip(rows, steps, strict=True)):
        pieces = [(s, "", "insert", True) for s in (_BETWEEN[before, at] if action == "new" else ())]
        pieces.append((at, r["text"] or "", "merge" if action == "merge" else "keep" if r["role"] == ROLES[at] else "relabel", action == "new"))
        end = r["last"] and i == len(rows) - 1
        if end:
            pieces += [(s, "", "insert", True) for s in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(at, ())]
        for seq, (role, text, action_, opens) in enumerate(pieces):
            close = CLOSE if opens and r["start"] + i + seq else ""
            head = close + OPEN.format(role=ROLES[role]) if opens else JOIN
            out.append({"conv_id": r["conv_id"], "turn": r["turn"], "place": r["start"] + i, "seq": seq, "role": ROLES[role], "action": action_, "opens": opens, "rendered": head + text + (CLOSE if end and seq == len(pieces) - 1 else "")})
    return out


def _render(schema: pa.Schema):
    def run(batches):
        out: list[dict] = []
        for _, rows in _runs(batches, ["conv", "part"]):
            out += _rendered(rows)
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def format_chats(turns: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each piece: conv_id, turn, place, seq, role, action, opens, rendered.

    ``place`` counts the conversation's turns before the piece's own, ``seq`` the pieces of that turn; they don't depend on how
    rows are dealt. Pieces of a conversation follow (place, seq). ``action`` is keep, relabel, merge or insert. The pieces' ``rendered`` texts, one
    after the other, are the conversation. Turns stand in order of ``turn`` (null first),
    ties in order of role and a hash of the text; repeated rows are turns of their own. Null roles and unknown ones are relabelled; null
    texts are empty; a null conv_id is a conversation of its own. An empty table gives an empty one; other columns are
    ignored.
    """
    scratch = Scratch(turns.sparkSession)
    t = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    conv = F.coalesce(F.col("conv_id").cast("string").cast("binary"), F.lit(b"\xff"))
    order = ["turn", "role", "tie", "text"]
    dealt = t.withColumn("conv", conv).withColumn("tie", F.xxhash64("text")).repartitionByRange("conv", "turn", "role", "tie").withColumn("part", F.spark_partition_id())
    dealt = scratch.cut(dealt)
    parts = lambda df: df.repartition("conv", "part").sortWithinPartitions("conv", "part", *order)
    stretches = parts(dealt).select("conv", "part", "role").mapInArrow(_stretches, "conv binary, part int, n long, m array<bigint>")
    lists = stretches.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "n", "m"))).alias("s"))  # one for each partition at most
    ways = scratch.cut(lists.mapInArrow(_threads, "conv binary, part int, entry int, leave int, start long, last boolean"))
    fields = {f.name: f for f in turns.schema}
    schema = T.StructType([fields["conv_id"], fields["turn"], *[T.StructField(n, k) for n, k in (("place", T.LongType()), ("seq", T.IntegerType()), ("role", T.StringType()), ("action", T.StringType()), ("opens", T.BooleanType()), ("rendered", T.StringType()))]])
    return parts(dealt.join(ways, ["conv", "part"])).mapInArrow(_render(to_arrow_schema(schema)), schema)
