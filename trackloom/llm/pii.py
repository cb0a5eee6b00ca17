"""Personal data by bootstrapped contextual extraction. DataFrame operations only.

Four kinds have a form of their own (email, ip, card, phone), and a fifth, ``secret``, is the value of a field with a telling
label (``token = "..."``); what matches them is the seed. Each seed stands in a lexical context, and each context is a
pattern: the word before, the two words before, the word after, the words on both sides, the label of the field, and the word
before together with the shape of what fills the slot. Quotes and brackets around a slot belong to neither.
Patterns and the identifier-like tokens found in their slots form a bipartite graph. In every round a pattern is scored by
the share of its distinct instances that are known already, and a token that enough high-confidence patterns point to
becomes known itself, so it raises the score of its other patterns in the next round. Tokens discovered so are spans of
kind ``identifier``, beside the spans of the four kinds.

The rounds end when one adds nothing. Places of matches, overlaps and redacted texts come from running sums and maxima over
the sorted matches of a text, in blocks of the root of their number, so a text of very many matches stays affordable.

Counts go over distinct (pattern, instance) pairs of the whole corpus, so thousands of copies of a document weigh as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")
SECRETS, FOUND = "secret", "identifier"
#: The forms. Each equals its plain form match for match, but can neither rescan a run of characters from every position in
#: it nor recurse along a long one: a match can only start where a run starts, or where the last match ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What can fill a slot: five or more letters of any script, digits and joiners, one of them a digit.
TOKEN = r"(?<![\p{L}\p{N}_@.+/-])(?=[\p{L}_@.+/-]*+[0-9])[\p{L}\p{N}_@.+/-]{4,}[\p{L}\p{N}]"
#: Labels of fields whose values are secrets.
LABELS = "token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential"
#: A secret: what follows such a label and = or :, six or more characters with a digit. What is cheap to test comes first.
SECRET = r"(?<=[=:]\x20{0,2}[\x22\x27]?)(?<=(?i:%s)s?[\x22\x27]?\x20{0,2}[=:]\x20{0,2}[\x22\x27]?)(?=[^\s\x22\x27\x60,;<>(){}\[\]=:])(?=[^\s\x22\x27\x60,;<>(){}\[\]0-9]*+[0-9])[^\s\x22\x27\x60,;<>(){}\[\]]{5,}[\p{L}\p{N}=]" % LABELS
#: A pattern counts with so many distinct known instances, and such a share of its instances known.
MIN_KNOWN, MIN_SHARE = 4, 0.7
#: A token is accepted at such a chance that not all of its patterns are wrong, with so many patterns.
MIN_CHANCE, MIN_PATTERNS = 0.95, 2

#: Opening quotes and brackets at the end of what stands before a match; the last word of the rest, the last two, and the
#: first word after the match and its closing marks. Each starts at the start of a run and never goes back, so a long run of
#: characters is read once.
OPEN = r"(?<![\x22\x27\x60(\[{<«])[\x22\x27\x60(\[{<«]++\z"
LAST, LAST_TWO, FIRST = r"(?<!\S)(\S++)\s*+\z", r"(?<!\S)(\S++)\s++\S++\s*+\z", r"\A[\p{P}\p{S}]*+\s*+(\S++)"


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for a value that is computed once, however often it is mentioned."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(values: str) -> str:
    """SQL: an array in consecutive blocks, as many as each has elements."""
    step = f"cast(ceil(sqrt(size({values}))) as int)"
    return f"transform(if(size({values}) > 0, sequence(0, cast(ceil(size({values}) / {step}) as int) - 1), cast(array() as array<int>)), k -> slice({values}, k * {step} + 1, {step}))"


def running(values: str, op: Callable[[str, str], str]) -> str:
    """SQL: for each of an array of longs, ``op`` over all before it and itself, from zero on.

    Appending to an array copies it, so the running values are made in blocks of the root of the array's length.
    """

    def scan(start: str, own: str) -> str:
        step = _let(op("a.at", "x"), "n", "named_struct('at', n, 'out', concat(a.out, array(n)))")
        return f"aggregate({own}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), (a, x) -> {step}, a -> a.out)"

    totals = f"transform(blocks, b -> aggregate(b, 0L, (a, x) -> {op('a', 'x')}))"
    each = f"flatten(transform(blocks, (b, i) -> {scan('if(i > 0, ends[i - 1], 0L)', 'b')}))"
    return _let(values, "vs", _let(_blocks("vs"), "blocks", _let(scan("0L", totals), "ends", each)))


def _sum(a: str, x: str) -> str:
    return f"{a} + {x}"


def _most(a: str, x: str) -> str:
    return f"greatest({a}, {x})"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        digit = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
        return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), digit), F.lit(0), lambda a, x: a + x) % 10 == 0
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _clean(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}=:]+", ""))


def _placed(found: str, pieces: str) -> Column:
    """Matches with their places, from the matches and from what lies between them (code points, end exclusive)."""
    sizes = "transform(found, (m, i) -> cast(length(pieces[i]) + length(m) as bigint))"
    word = lambda piece, form: f"regexp_extract({piece}, r'{form}', 1)"
    at = f"named_struct('m', m, 'start', reach[i] - length(m), 'end', reach[i], 'l1', {word('before', LAST)}, 'l2', {word('before', LAST_TWO)}, 'r1', {word('pieces[i + 1]', FIRST)})"
    at = _let(f"regexp_replace(pieces[i], r'{OPEN}', '')", "before", at)
    # bound, as the optimiser could else put the search itself where a match's place is looked up
    return F.expr(_let(found, "found", _let(pieces, "pieces", _let(running(sizes, _sum), "reach", f"transform(found, (m, i) -> {at})"))))


_SHAPES = ((r"\p{L}++[0-9][\p{L}0-9]*+|[0-9]++\p{L}[\p{L}0-9]*+", "#"), (r"[0-9]++", "9"), (r"\p{L}++", "a"))
_PLACED = "array<struct<m:string,start:bigint,end:bigint,l1:string,l2:string,r1:string>>"


def _shape(m: Column) -> Column:
    """What a token is made of: runs of letters, of digits, of both, and what joins them."""
    for form, mark in _SHAPES:
        m = F.regexp_replace(m, form, mark)
    return m


def _slot(x: Column) -> list[Column]:
    return [x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(F.lower(x["m"])).alias("inst"), *[_clean(x[w]).alias(w) for w in ("l1", "l2", "r1")], _shape(x["m"]).alias("shape")]


def _spans(kind: str) -> Column:
    return F.transform(F.filter(f"__tl_p_{kind}", lambda x: _valid(kind, x["m"])), lambda x: F.struct(F.lit(kind).alias("kind"), *_slot(x)))


def _clear(tokens: str, base: str) -> Column:
    """The tokens, in order, that no base span overlaps.

    Tokens by their end and base spans by their start are sorted together; a token is clear if the greatest end of the base
    spans before it doesn't pass its start.
    """
    event = lambda at, kind, reach, start: f"named_struct('at', {at}, 'kind', {kind}, 'reach', {reach}, 'start', {start})"
    events = f"array_sort(concat(transform(tokens, t -> {event('t.end', 0, '0L', 't.start')}), transform(spans, t -> {event('t.start', 1, 't.end', '0L')})))"
    free = _let(running("transform(events, t -> t.reach)", _most), "reach", "filter(transform(events, (t, i) -> if(t.kind = 0, reach[i] <= t.start, null)), ok -> ok is not null)")
    kept = _let(events, "events", _let(free, "free", "filter(tokens, (t, i) -> free[i])"))
    return F.expr(_let(tokens, "tokens", _let(base, "spans", f"if(size(tokens) > 0 and size(spans) > 0, {kept}, tokens)")))


def extract(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text column) and __tl_base (spans of the four kinds, in order), __tl_secret (values of fields with
    a telling label that no base span overlaps) and __tl_more (other tokens)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = {"email": text.contains("@"), "phone": text.contains("+"), SECRETS: text.rlike(f"(?i)(?:{LABELS})s?[\\x22\\x27]?\\x20{{0,2}}[=:]")}
    digits = text.rlike("[0-9]")
    df = docs.withColumns({"__tl_text": text, "__tl_digits": digits})
    nothing = F.expr(f"cast(array() as {_PLACED})")
    forms = {**FORMS, SECRETS: SECRET, "token": TOKEN}
    df = df.withColumns({f"__tl_f_{kind}": F.when(some.get(kind, F.col("__tl_digits")), F.regexp_extract_all("__tl_text", F.lit(form), F.lit(0))) for kind, form in forms.items()})
    df = df.withColumns({f"__tl_s_{kind}": F.when(F.size(f"__tl_f_{kind}") > 0, F.split("__tl_text", form, -1)) for kind, form in forms.items()})
    df = df.withColumns({f"__tl_p_{kind}": F.when(F.size(f"__tl_f_{kind}") > 0, _placed(f"__tl_f_{kind}", f"__tl_s_{kind}")).otherwise(nothing) for kind in forms})
    df = df.withColumn("__tl_base", F.concat(*map(_spans, KINDS)))
    df = df.withColumn("__tl_secret", F.transform(_clear(f"__tl_p_{SECRETS}", "__tl_base"), lambda x: F.struct(F.lit(SECRETS).alias("kind"), *_slot(x))))
    df = df.withColumn("__tl_more", F.transform(_clear("__tl_p_token", "concat(__tl_base, __tl_secret)"), lambda x: F.struct(*_slot(x))))
    return df.drop("__tl_text", "__tl_digits", *[f"__tl_{a}_{kind}" for kind in forms for a in "fsp"])


def _patterns(x: str) -> Column:
    """The patterns of a slot; parts that are missing give none."""
    part = lambda name: F.col(f"{x}.{name}")
    label = F.when(part("l1").isin("=", ":"), part("l2")).when(part("l1").rlike("[=:]\\z"), F.regexp_replace(part("l1"), "[=:]", "")).otherwise("")
    made = [
        F.when(part("l1") != "", F.concat(F.lit("l1 "), part("l1"))),
        F.when((part("l1") != "") & (part("l2") != ""), F.concat(F.lit("l2 "), part("l2"), F.lit(" "), part("l1"))),
        F.when(part("r1") != "", F.concat(F.lit("r1 "), part("r1"))),
        F.when((part("l1") != "") & (part("r1") != ""), F.concat(F.lit("lr "), part("l1"), F.lit(" "), part("r1"))),
        F.when(label != "", F.concat(F.lit("f "), label)),
        F.when(part("l1") != "", F.concat(F.lit("s "), part("l1"), F.lit(" "), part("shape"))),
    ]
    return F.array_compact(F.array(*made))


def bootstrap(extracted: DataFrame, scratch: Scratch, hidden: Column | None = None) -> DataFrame:
    """The instances known, ``inst``: seeds and what the pattern-instance graph of ``extracted`` discovers; rounds go on until one
    adds nothing. A seed counts wherever it stands, so the value of a labelled field is found without its label too.

    A token of the form of a kind that fails the kind's check (a card by Luhn, an ip by its parts) is never discovered, but counts
    against its patterns. Seeds for which ``hidden``, a condition on ``inst``, holds are not known at first, and are left out of
    the shares of patterns until they are.
    """
    hidden = F.lit(False) if hidden is None else hidden
    slots = extracted.select(F.explode(F.concat(F.transform(F.concat("__tl_base", "__tl_secret"), lambda x: x.dropFields("kind").withField("seed", F.lit(True))), F.transform("__tl_more", lambda x: x.withField("seed", F.lit(False))))).alias("x"))
    failed = (F.col("x.shape") == "9.9.9.9") | (F.col("x.shape") == "9") & (F.col("x.end") - F.col("x.start")).between(16, 19)
    pairs = slots.select("x.inst", "x.seed", (failed & ~F.col("x.seed")).alias("failed"), F.explode(_patterns("x")).alias("pattern"))
    graph = scratch.cut(pairs.groupBy("pattern", "inst").agg((F.max("seed") & ~hidden).alias("seed"), (F.max("seed") & hidden).alias("blind"), F.max("failed").alias("failed")))
    known = scratch.cut(graph.where("seed").select("inst").distinct())
    while True:
        marked = graph.drop("seed").join(known.withColumn("known", F.lit(True)), "inst", "left")
        counts = marked.groupBy("pattern").agg(F.count("*").alias("all"), F.count_if(F.col("known").isNotNull() | ~F.col("blind")).alias("n"), F.count("known").alias("hits"))
        scored = counts.where((F.col("hits") >= MIN_KNOWN) & (F.col("hits") >= MIN_SHARE * F.col("n")) & (F.col("hits") < F.col("all")))
        votes = marked.where("known is null and not failed").join(scored.select("pattern", (1 - F.col("hits") / (F.col("n") + 1)).alias("doubt")), "pattern")
        new = votes.groupBy("inst").agg(F.count("*").alias("n"), F.sum(F.log("doubt")).alias("doubt")).where((F.col("n") >= MIN_PATTERNS) & (1 - F.exp("doubt") >= MIN_CHANCE)).select("inst")
        new = scratch.cut(new)
        if new.isEmpty():
            return known
        known = scratch.cut(known.unionByName(new))


def recovery(docs: DataFrame, hidden: int = 30) -> DataFrame:
    """How well contexts alone find what the forms find: one row of counts of distinct instances.

    ``hidden`` per cent of the seeds (by hash) take part as unknown tokens. n_seeds, n_hidden, n_recovered (hidden ones that
    were discovered) and n_others (discovered, and of none of the five forms); long.
    """
    scratch = Scratch(docs.sparkSession)
    got = scratch.cut(extract(docs.select("text")).select("__tl_base", "__tl_secret", "__tl_more"))
    mask = F.pmod(F.xxhash64("inst"), F.lit(100)) < hidden
    seeds = got.select(F.explode(F.transform(F.concat("__tl_base", "__tl_secret"), lambda x: x["inst"])).alias("inst")).distinct().withColumns({"seed": F.lit(True), "hid": mask})
    found = bootstrap(got, scratch, mask).withColumn("found", F.lit(True))
    both = seeds.join(found, "inst", "full")
    return both.agg(F.count("seed").alias("n_seeds"), F.count_if("hid").alias("n_hidden"), F.count_if(F.col("hid") & F.col("found")).alias("n_recovered"), F.count_if(F.col("seed").isNull()).alias("n_others"))


def _found(extracted: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """``extracted`` (a written table with ``key``, __tl_base, __tl_secret, __tl_more) and __tl_found, the discovered spans.

    ``key`` tells rows apart. Rows without a token beside their base spans take no part in the join.
    """
    known = bootstrap(extracted, scratch)
    more = extracted.where(F.size("__tl_more") > 0)
    hits = more.select(*key, F.explode("__tl_more").alias("x")).select(*key, "x.start", "x.end", "x.inst").join(known, "inst").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__tl_found"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    with_tokens = more.join(hits, key, "left").withColumn("__tl_found", F.coalesce("__tl_found", none))
    without = extracted.where(F.size("__tl_more") == 0).withColumn("__tl_found", none)
    return with_tokens.unionByName(without).drop("__tl_more")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, __tl_base, __tl_secret (labelled values) and __tl_found (discovered spans).

    Null texts count as empty and have no spans. Rows that repeat a doc_id are separate rows. Spans are in code points,
    end exclusive. An empty table gives an empty one. Columns besides doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    got = extract(docs.select("doc_id", "text")).select("doc_id", "__tl_base", "__tl_secret", "__tl_more", F.monotonically_increasing_id().alias("__tl_row"))
    return _found(scratch.cut(got), ["__tl_row"], scratch).drop("__tl_row")


def _written(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the four kinds, base_sha256, spans, and n_spans, how many these are."""
    base, secrets = _written(F.col("__tl_base")), _written(F.col("__tl_secret"))
    more = _written(F.transform("__tl_found", lambda x: F.struct(F.lit(FOUND).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    count = lambda k: F.size(F.filter("__tl_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, secrets, more), ",").alias("spans"), (F.size("__tl_base") + F.size("__tl_secret") + F.size("__tl_found")).cast("long").alias("n_spans"))


def _marked(text: str, spans: str) -> Column:
    """``text`` with its spans (start, minus the end, kind), sorted, replaced by marks.

    A span that starts before the greatest end so far gives no mark of its own. Texts between marks are cut out of the text
    block by block, as a cut counts characters from the start.
    """
    sub = lambda t, at, n: f"substring({t}, cast({at} + 1 as int), cast({n} as int))"
    own = "transform(spans, (x, i) -> named_struct('at', if(i > 0, reach[i - 1], 0L), 'start', x.start, 'kind', x.kind))"
    kept = f"filter({own}, x -> x.start >= x.at)"
    pieces = f"array_join(transform(own, x -> concat({sub('t', 'x.at - own[0].at', 'x.start - x.at')}, '<', upper(x.kind), '>')), '')"
    block = _let(sub(text, "own[0].at", "element_at(own, -1).start - own[0].at"), "t", pieces)
    rest = sub(text, "element_at(reach, -1)", f"length({text})")
    joined = f"concat(array_join(transform({_let(kept, 'kept', _blocks('kept'))}, own -> {block}), ''), {rest})"
    return F.expr(_let(spans, "spans", f"if(size(spans) > 0, {_let(running('transform(spans, x -> -x.minus)', _most), 'reach', joined)}, {text})"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in angle brackets; rows and columns stay.

    Overlapping spans are replaced by one mark, that of the first to start (the longer one, if two start together). Spans
    are found once for each distinct text; texts without a digit or an at sign can't have one and pass by (a secret has a digit).
    """
    scratch = Scratch(docs.sparkSession)
    some = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))  # no span lacks both
    keyed = docs.where(some).withColumns({"__tl_h1": F.xxhash64("text"), "__tl_h2": F.xxhash64(F.lit(1), "text")})
    key = ["__tl_h1", "__tl_h2"]
    # written before anything is filtered by it: a filter would be pushed below, with a copy of the extraction
    got = scratch.cut(extract(keyed.select(*key, "text")).select(*key, "__tl_base", "__tl_secret", "__tl_more"))
    once = scratch.cut(got.where(F.size("__tl_base") + F.size("__tl_secret") + F.size("__tl_more") > 0).dropDuplicates(key))
    spans_of = _found(once, key, scratch)
    found = keyed.join(spans_of, key, "left")
    spans = F.concat(F.transform(F.concat("__tl_base", "__tl_secret"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), x["kind"].alias("kind"))), F.transform("__tl_found", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), F.lit(FOUND).alias("kind"))))
    text = F.when(F.size("__tl_spans") > 0, _marked("text", "__tl_spans")).otherwise(F.col("text"))
    marked = found.withColumn("__tl_spans", F.array_sort(spans)).withColumn("text", text).select(*docs.columns)
    return docs.where(~some).unionByName(marked)
