"""Secret scans with DataFrame functions only: known formats, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of a character class (hexadecimal; base64 with its URL-safe form). Per class, a window slides over the candidate; the
counts of the characters in it are packed into eight numbers, and the sum of c * log2(c) over these is kept up by adding the character that
enters and taking off the one that leaves, so a window costs no rescan. The sum is in whole numbers (SCALE to one bit), so it does not drift. A
window's entropy is log2(w) - sum / w. A candidate whose best window reaches the class's threshold is a span. All happens within a row: no
shuffle, no join, no Python.

What a known format has found, and parts that say that they are an example (MARKS), are blanked before candidates are cut, so they suppress
themselves and not the run around them. Of what is left, candidates of the forms in ALLOW are no secrets. Of random base64 keys (20,000 drawn of
each length) 6.1 % of those of 24 characters are missed, having less entropy than the threshold or no digit; 2.4 % at 28, 1.0 % at 32 and 0.2 %
at 40, where some window will do.

Cases: a null text counts as empty (no spans). Rows are judged one by one, so repeated rows each get their result and a null doc_id is returned
as null. An empty table gives an empty result. Extra columns are ignored by scan() and kept by redact(). Positions are code points from 0, ends
exclusive. A text is read whole, however long: the cost grows with its length, whatever the number of matches and the length of candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

#: Kinds in the order in which spans with one start are listed. Fixed values.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX_LONG = r"[0-9a-f]{24,}"
#: Character classes of candidates: pattern, window, least bits of entropy. Six random base64 characters in seven must differ; a hexadecimal
#: window of 32 has 3.3 bits or more unless it is made up.
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{32,}", 32, 3.2),
    "entropy_base64": (r"[A-Za-z0-9+/_-]{24,}", 24, 4.0),
}
#: Candidates that are no secrets: without a digit (words, joined words, rules of dashes), words with a number at the end, UUIDs. Repetition is
#: possessive, since a group that may give back its matches recurses once for each of them.
ALLOW = (
    r"^[A-Za-z+/_-]+$",
    r"^[A-Za-z]++(?:[-_/][A-Za-z]++)*+[-_/]?[0-9]{1,4}$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
)
#: Every candidate, and every long hexadecimal number, lies in such a run, so texts without one are not looked through for these.
RUN = r"[A-Za-z0-9+/_-]{24}"
#: What a part (a run of letters and digits) holds that is an example or the alphabet or digits in order.
MARKS = r"(?i:abcdefghijkl|0123456789abcdef|1234567890123|example|sample|placeholder|dummy|xxxx)"
MARKED = rf"(?<![A-Za-z0-9])[A-Za-z0-9]*?{MARKS}[A-Za-z0-9]*+"
#: Spans by code points (start, end) and by bytes (low, high).
SPANS = "array<struct<start:int,rank:int,end:int,low:int,high:int>>"
#: Matches whose positions are summed one by one; sums of more go block by block.
BLOCK = 256
#: Units in one bit, and the first of the characters that are counted; ten counts of six bits go into one number.
SCALE, FIRST, PACKED, BITS = 1 << 32, ord("+"), 10, 6


def _none() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it for many elements."""
    return F.transform(F.array(value), f)[0]


def _before(points: Column, plus) -> Column:
    """Of each element of an array of (c, b), what `plus` makes of all before it. Blocks are folded first, then their results, then within blocks, so
    that no fold appends to a long array."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"))

    def folded(values: Column, begin: Column) -> Column:
        state = F.struct(begin.alias("at"), F.array().cast("array<struct<c:int,b:int>>").alias("out"))
        return F.aggregate(values, state, lambda a, x: F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(p: Column) -> Column:
        count = F.floor((F.size(p) + BLOCK - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(p, k * BLOCK + 1, BLOCK))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, folded(F.transform(b, lambda x: F.aggregate(x, zero, plus)), zero), lambda x, at: folded(x, at))))

    return let(points, lambda p: F.when(F.size(p) > 0, whole(p)).otherwise(F.array().cast("array<struct<c:int,b:int>>")))


def _plus(a: Column, x: Column) -> Column:
    return F.struct((a["c"] + x["c"]).alias("c"), (a["b"] + x["b"]).alias("b"))


def _furthest(a: Column, x: Column) -> Column:
    return F.struct(F.greatest(a["c"], x["c"]).alias("c"), F.greatest(a["b"], x["b"]).alias("b"))


def _spans(text: Column, pattern: str, rank: int, may: Column, keep) -> Column:
    """Spans of pattern's leftmost non-overlapping matches. may: false only where there is no match; keep: of a match, whether it counts.
    split() gives the pieces between the matches, whose lengths add up to the positions."""

    def matched(found: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        return let(pairs, placed)

    def placed(pairs: Column) -> Column:
        length = lambda of: lambda x: (of(x["gap"]) + of(x["m"]))
        before = _before(F.transform(pairs, lambda x: F.struct(length(F.length)(x).alias("c"), length(F.octet_length)(x).alias("b"))), _plus)

        def span(x: Column, at: Column) -> Column:
            start, low = at["c"] + F.length(x["gap"]), at["b"] + F.octet_length(x["gap"])
            return F.when(keep(x["m"]), F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"), low.alias("low"), (low + F.octet_length(x["m"])).alias("high")))

        return F.filter(F.zip_with(pairs, before, span), lambda x: x.isNotNull())

    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, matched(m)).otherwise(_none()))).otherwise(_none())


def _replaced(text: Column, spans: Column, mark) -> Column:
    """text with mark(span, end of those before it) in place of its spans, which may overlap. Cut by bytes, whose positions need no search."""

    def cut(x: Column, s: Column) -> Column:
        before = _before(F.transform(s, lambda v: F.struct(v["end"].alias("c"), v["high"].alias("b"))), _furthest)
        gap = lambda low, high: F.when(high > low, F.substring(x, low + 1, high - low).cast("string")).otherwise("")
        pieces = F.zip_with(s, before, lambda v, at: F.concat(gap(at["b"], v["low"]), mark(v, at)))
        rest = gap(F.array_max(F.transform(s, lambda v: v["high"])), F.octet_length(x))
        return F.concat(F.array_join(pieces, ""), rest)

    return F.when(F.size(spans) > 0, let(text.cast("binary"), lambda x: let(F.array_sort(spans), lambda s: cut(x, s)))).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """text with one blank for each code point of its spans."""
    return _replaced(text, spans, lambda v, at: F.repeat(F.lit(" "), F.greatest(v["end"] - F.greatest(v["start"], at["c"]), F.lit(0))))


def best_entropy(s: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of a window of so many characters over s, which are ASCII from + on; 0 for a shorter s. Per step, only
    the counts of the character that enters and of the one that leaves change, and the sum of c * log2(c) with them."""
    if not 1 < window < 1 << BITS:
        raise ValueError("a window's counts must fit their bits")
    # What the sum grows by as a count goes up by one.
    f = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]
    grow = F.array(*[F.lit(b - a).cast("bigint") for a, b in zip(f, f[1:], strict=False)])

    def place(c: Column) -> Column:
        code = F.ascii(c) - FIRST
        shift = code % PACKED * BITS
        return F.struct(F.floor(code / PACKED).cast("int").alias("at"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift).alias("one"))

    def count(n: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.element_at(n, x["at"] + 1), x["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        more = F.element_at(grow, count(acc["n"], new) - F.when((new["at"] == old["at"]) & (new["shift"] == old["shift"]), 1).otherwise(0) + 1)
        less = F.when(old.isNotNull(), F.element_at(grow, count(acc["n"], old))).otherwise(F.lit(0).cast("bigint"))
        n = F.transform(acc["n"], lambda v, j: v + F.when(j == new["at"], new["one"]).otherwise(F.lit(0).cast("bigint")) - F.when(j == old["at"], old["one"]).otherwise(F.lit(0).cast("bigint")))
        # The sum of the step before counts, once its window is full.
        return F.struct(n.alias("n"), (acc["sum"] + more - less).alias("sum"), (acc["i"] + 1).alias("i"), F.when(acc["i"] >= window, F.least(acc["least"], acc["sum"])).otherwise(acc["least"]).alias("least"))

    zero = F.lit(0).cast("bigint")
    words = -(-(ord("z") - FIRST + 1) // PACKED)
    state = F.struct(F.array(*[zero] * words).alias("n"), zero.alias("sum"), F.lit(0).alias("i"), F.lit(f[window]).cast("bigint").alias("least"))
    bits = lambda acc: math.log2(window) - F.when(acc["i"] >= window, F.least(acc["least"], acc["sum"])).otherwise(acc["least"]) / float(SCALE * window)
    entering = F.transform(F.split(s, ""), place)
    leaving = lambda p: F.concat(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda _: F.lit(None).cast("struct<at:int,shift:int,one:bigint>")), F.slice(p, 1, F.greatest(F.size(p) - window, F.lit(0))))
    return F.when(F.length(s) >= window, let(entering, lambda p: F.aggregate(F.zip_with(p, leaving(p), lambda new, old: F.struct(new.alias("new"), old.alias("old"))), state, step, bits))).otherwise(F.lit(0.0))


def base_spans(text: Column, run: Column) -> Column:
    """run: whether the text has a RUN."""
    low = F.lower(text)
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assign = _spans(text, ASSIGN, 0, word, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    access = _spans(text, ACCESS, 1, text.contains("AKIA"), lambda m: F.length(m) >= 20)
    # Runs of 24 or more are what is left of all runs once the shorter ones are dropped.
    hexes = _spans(text, HEX_LONG, 2, run, lambda m: F.lit(True))
    return F.concat(assign, access, hexes)


def entropy_spans(text: Column, run: Column, classes: dict, allow: tuple[str, ...]) -> Column:
    listed = "|".join(f"(?:{p})" for p in allow)
    return F.concat(*[
        _spans(text, pattern, KINDS.index(kind), run, lambda m, w=window, h=least: ~m.rlike(listed) & (best_entropy(m, w) >= h))
        for kind, (pattern, window, least) in classes.items()
    ])


def _found(docs: DataFrame, classes: dict, allow: tuple[str, ...]) -> tuple[DataFrame, str, str]:
    """docs with the base spans and all spans, in columns whose names docs lacks."""
    base, every, run = shared.unused(docs, "__base"), shared.unused(docs, "__every"), shared.unused(docs, "__run")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(run, text.rlike(RUN))
    out = out.withColumn(base, F.array_sort(base_spans(text, F.col(run))))
    blanks = F.concat(base, _spans(text, MARKED, 0, F.col(run), lambda m: F.lit(True)))
    out = out.withColumn(every, F.when(F.col(run), _blanked(text, blanks)))
    new = F.when(F.col(run), entropy_spans(F.col(every), F.col(run), classes, allow)).otherwise(_none())
    return out.withColumn(every, F.array_sort(F.concat(base, new))), base, every


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, classes: dict | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, the number of base spans by kind, the SHA-256 of the joined base spans, and all spans joined, of every row."""
    found, base, every = _found(docs.select("doc_id", "text"), classes or CLASSES, allow)
    ranks = F.transform(base, lambda x: x["rank"])
    counts = [F.size(F.filter(ranks, F.lit(k).__eq__)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", classes: dict | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with each span replaced by mark (spans that overlap, by one mark) and n_chars, if there, counted anew; all rows and columns stay."""
    found, _, every = _found(docs, classes or CLASSES, allow)
    one = lambda v, at: F.when(v["low"] >= at["b"], mark).otherwise("")
    out = found.withColumn("text", F.when(F.size(every) > 0, _replaced(F.col("text"), F.col(every), one)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
