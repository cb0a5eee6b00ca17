"""Best-fit packing into fixed-length sequences by exact-complement hashing.

Which pieces share a sequence depends on their lengths alone, and there are at most ``size`` lengths. So documents are
tokenised and cut into pieces where they lie, the pieces are counted by length, and the packing is solved over that
histogram: at most ``size`` counts reach the driver, whatever the input. A solved pattern (a multiset of lengths that fill
a sequence) stands for as many sequences as its lengths' counts allow. Then every piece gets its rank among the pieces of
its length, and the rank falls into one pattern's range, which gives the sequence and the offset.

Solving: the sums of one, two and three available lengths are indexed by their value. From the longest piece down, the gap
beside it is looked up, and the combination that fills it exactly is consumed as often as the counts allow. Where there are
several, the one with the longest parts is taken (by their squares), and none that is easier than what best fit would put
there: short pieces fit everywhere, so they are kept for the gaps that nothing else fills. What has no exact complement is
packed best-fit, longest piece first.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches

SIZE = 1024
EOS = 2
#: Rows of one length that are ranked together.
RANKED_TOGETHER = 1000
#: Chunks whose ids a worker remembers.
REMEMBERED = 300_000
#: The pre-token pattern of the byte-level vocabulary, and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: A space between two white spaces, or after one at the end: there, pre-tokens are not cut at every space.
_WIDE = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Texts to ids of a byte-level BPE vocabulary, as little-endian 32-bit bytes.

    With this pattern a pre-token starts at every space that isn't inside a run of white space, so a text is the
    concatenation of its space-led chunks, and the ids of short chunks are remembered. The ids are those of the tokenizers
    library without special tokens added (the tests compare whole texts); the rank file of the same vocabulary gives them in
    a third of its time.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        ids = array("I", self.bpe.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _plain(self, text: str) -> bytes:
        if _WIDE.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        known = self.known
        found = [known.get(c) for c in rest]
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    c = rest[i]
                    found[i] = x = self._ids(" " + c)
                    if len(known) < REMEMBERED and len(c) <= 32:
                        known[c] = x
        return self._ids(first) + b"".join(found)

    def encode(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self._plain(text)
        return SPECIAL_ID.to_bytes(4, "little").join(map(self._plain, text.split(SPECIAL)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first takes the remainder."""
    first = n % size or size if n > size else n
    yield 0, first
    for at in range(first, n, size):
        yield at, size


def pieces(docs: DataFrame, ranks_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every row; null text counts as empty."""
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        for batch in batches:
            enc = encoder(ranks_path).encode
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    buf = enc(text.as_py() or "") + EOS.to_bytes(4, "little")
                    for k, (a, n) in enumerate(cuts(len(buf) // 4, size)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(n)
                        own = buf[4 * a : 4 * (a + n)]
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4"))
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


Patterns = list[tuple[dict[int, int], int]]


class Sums:
    """The sums of one, two and three available lengths, indexed by their value.

    ``left`` holds the available counts and is the index of single lengths; ``pairs`` holds for each sum how many pairs of
    available lengths have it. A triple of some sum is a length and a pair of what is missing to that sum.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.left[0] = 0
        self._index()

    def _index(self) -> None:
        one, two = self.left > 0, np.flatnonzero(self.left > 1)
        ordered = np.rint(np.convolve(one.astype(float), one.astype(float))).astype(np.int64)
        ordered[2 * np.flatnonzero(one)] -= 1
        self.pairs = ordered // 2
        self.pairs[2 * two] += 1

    def take(self, parts: list[int]) -> tuple[dict[int, int], int]:
        """Consume a pattern as often as its scarcest length allows: ({length: times}, sequences)."""
        need = {p: parts.count(p) for p in parts}
        n = min(int(self.left[p]) // k for p, k in need.items())
        for p, k in need.items():
            self.left[p] -= n * k
        if any(self.left[p] < 2 for p in need):
            self._index()
        return need, n

    def largest_pair(self, total: int, most: int) -> list[int]:
        """The pair of this sum with the longest part, which is at most ``most``; nothing if there is none."""
        if total < 2 or not self.pairs[total]:
            return []
        a = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        a = a[(self.left[a] > 0) & (self.left[total - a] > (2 * a == total))]
        return [int(a[-1]), total - int(a[-1])] if len(a) else []

    def exact(self, gap: int, least: int) -> list[int]:
        """One to three lengths that fill ``gap``, those with the largest sum of squares; nothing if that is under ``least``."""
        if self.left[gap]:
            return [gap]
        found, most = self.largest_pair(gap, gap), least - 1
        if found:
            most = max(most, sum(p * p for p in found))
            found = found if sum(p * p for p in found) >= least else []
        c = np.arange(-(-gap // 3), gap - 1)
        c = c[(self.left[c] > 0) & (self.pairs[gap - c] > 0)]
        for longest in c[::-1].tolist():
            if longest * longest + (gap - longest) ** 2 <= most:  # no triple with this part or a shorter one is better
                break
            self.left[longest] -= 1
            rest = self.largest_pair(gap - longest, longest)
            self.left[longest] += 1
            squares = longest * longest + sum(p * p for p in rest)
            if rest and squares > most:
                found, most = [longest, *rest], squares
        return found

    def best_fit(self, room: int) -> list[int]:
        """The lengths that best fit puts into ``room``, longest first."""
        parts, spare = [], self.left.copy()
        while room:
            fits = np.flatnonzero(spare[1 : room + 1])
            if not len(fits):
                break
            p = int(fits[-1]) + 1
            k = min(room // p, int(spare[p]))
            parts += [p] * k
            spare[p] -= k
            room -= p * k
        return parts


def solve(counts: np.ndarray, size: int = SIZE) -> Patterns:
    """Patterns ({length: times}, sequences) that use up ``counts`` (index: length, 0 to ``size``).

    Each pattern is as frequent as its scarcest length allows, so each one exhausts a length or leaves less of it than
    the pattern needs; the list's length follows the number of lengths, not of pieces.
    """
    sums, out = Sums(counts), []
    if sums.left[size]:
        out.append(sums.take([size]))
    for longest in range(size - 1, 0, -1):
        while sums.left[longest]:
            sums.left[longest] -= 1
            least = sum(p * p for p in sums.best_fit(size - longest))
            parts = sums.exact(size - longest, least)
            sums.left[longest] += 1
            if not parts:
                break
            out.append(sums.take([longest, *parts]))
    while sums.left.any():
        out.append(sums.take(sums.best_fit(size)))
    return out


def ranges(patterns: Patterns) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times, first sequence, offset) for every length of every pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for need, n in patterns:
        offset = 0
        for p, k in sorted(need.items(), reverse=True):
            at = used.get(p, 0)
            out.append((p, at, at + n * k, k, sequence, offset))
            used[p] = at + n * k
            offset += p * k
        sequence += n
    return out


def pack(docs: DataFrame, ranks_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every row of ``docs`` gives at least one piece, the end id alone for null or empty text; documents over ``size`` ids
    are cut, the first piece taking the remainder. Rows that repeat a doc_id are packed each for itself; pieces of one
    length are interchangeable. An empty table gives an empty one. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # written with a number for each row, which tells equal rows apart
    with small_batches(spark):
        p = scratch.cut(pieces(docs, ranks_path, size, with_ids).withColumn("__tl_row", F.monotonically_increasing_id()))
    histogram = p.groupBy("length").agg(F.count("*").alias("n")).where(F.col("length").between(1, size))
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.collect():  # at most `size` rows
        counts[length] = n
    # rank among the pieces of a length: within salted groups of a bounded size, then the groups' running total
    # Arrow tables are local relations; lists of rows would be RDDs, for which each executor keeps Python workers of another kind
    salts = spark.createDataFrame(pa.table({"length": np.arange(size + 1), "salts": np.maximum(-(-counts // RANKED_TOGETHER), 1)}))
    salted = p.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(__tl_row), salts)")).drop("salts")
    group = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = group.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("__tl_row")) - 1
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("before"))
    # one row for each length: its patterns' ranges, in order of their ranks
    of_length: dict[int, list[tuple[int, ...]]] = {}
    for length, *where in ranges(solve(counts, size)):
        of_length.setdefault(length, []).append(tuple(where))
    place = pa.struct([(name, pa.int64()) for name in ("at", "end", "times", "sequence", "base")])
    of = [[dict(zip(place.names, x, strict=True)) for x in where] for where in of_length.values()]
    places = spark.createDataFrame(pa.table({"length": pa.array(list(of_length), pa.int64()), "places": pa.array(of, pa.list_(place))}))
    at = ranked.join(F.broadcast(places), "length").withColumn("place", F.expr("element_at(filter(places, x -> x.end > rank), 1)"))
    nth = F.col("rank") - F.col("place.at")
    return at.select(*[c for c in p.columns if c != "__tl_row"], (F.col("place.sequence") + F.expr("(rank - place.at) div place.times")).alias("sequence_id"), (F.col("place.base") + nth % F.col("place.times") * F.col("length")).alias("offset"))
