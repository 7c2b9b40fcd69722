"""Secret scans with DataFrame functions only: three base patterns, and sliding-window entropy over candidate strings.

Positions of regular-expression matches come from two built-in functions: ``split`` gives the text between matches,
``regexp_extract_all`` the matches, and running sums of their lengths the offsets (code points). Candidate strings are
runs of one character class. A window slides over each; the counts of its characters are kept up to date by adding
the entering and removing the leaving one, and with them the sum of c*log2(c) from which the entropy follows. A
candidate is reported if the largest entropy of any window reaches the class's bound and no allow rule holds.

Everything happens within a row: no shuffle, no Python. The steps grow with the text, not with its square: characters
are split into an array once, counts of a window are packed into a few long numbers, offsets are running totals in
blocks, candidates find base spans by binary search, and a redacted text is put together from blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base as common

#: The base patterns, and how many characters of which group a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex")
#: The same matches as those of ACCESS and HEX that are long enough: a shorter match takes up its whole run of
#: characters, in which no other could be long enough either. What they find needs no further test.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
#: Running totals are taken in blocks of 2 ** FAN_BITS elements; code points of a block of a text.
FAN_BITS = 6
BLOCK = 4096


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet: ``least`` characters at least, entropy of some ``window`` at least ``bits``."""

    name: str
    alphabet: str
    pattern: str
    least: int
    window: int
    bits: float


#: A random window of 20 characters has about 4.0 bits in the large alphabet, 3.9 in one case with digits, 4.0 in mixed
#: letters and 3.4 in hexadecimal digits; prose and joined words have less. The classes differ in what a candidate must
#: mix, so that only a part of a candidate between its separators can be one of another class as well.
CLASSES = (
    CharacterClass("entropy64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}", 20, 20, 3.6),
    CharacterClass("entropy16", "0123456789ABCDEF", r"(?<![A-Za-z0-9+/_-])[0-9A-F]{24,}(?![A-Za-z0-9+/_-])", 24, 20, 2.9),
    CharacterClass("entropy36", "abcdefghijklmnopqrstuvwxyz0123456789", r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{20,}(?![A-Za-z0-9])", 20, 20, 3.4),
    CharacterClass("entropy32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[A-F0-9]*[G-Z])[A-Z0-9]{20,}(?![A-Za-z0-9])", 20, 20, 3.4),
    CharacterClass("entropy52", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"(?<![A-Za-z0-9])(?=[A-Z]*[a-z])(?=[a-z]*[A-Z])[A-Za-z]{20,}(?![A-Za-z0-9])", 20, 20, 3.8),
    CharacterClass("uuid", "0123456789abcdefABCDEF-", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])", 36, 20, 2.9),
)
WORDS = r"example|placeholder|changeme|your[_-]?(?:key|token|secret)|x{6,}+|0123456789|abcdefghij(?:klmnopqrstuvwxyz)?|qwertyuiop|deadbeef|lorem"
#: Parts of a candidate that say nothing: placeholders, runs that count up, short units repeated four times or more.
FILLER = rf"(?i)(?:{WORDS})|(.{{1,6}}?)\1{{3,}}+"
#: No character of a candidate; and as many others in a row as may stand beside filler.
GONE, STRAY = "\x00", 4


SPAN = "struct<start:int,kind:int,end:int,body:string>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: it becomes the variable of a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, step, zero: Column) -> Column:
    """What ``step`` (a sum or maximum) makes of all values before each one, in three levels of blocks of ``FAN``.

    A fold over the array that carried its results along would copy them at every step.
    """

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, zero, step)

    def blocks(xs: Column) -> Column:
        last = F.greatest(F.shiftright(F.size(xs) - 1, FAN_BITS), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(xs, F.shiftleft(i, FAN_BITS) + 1, F.lit(1 << FAN_BITS))))

    def over(xs: Column, earlier: Column) -> Column:
        inside = lambda i: i.bitwiseAND(F.lit((1 << FAN_BITS) - 1))
        return F.transform(xs, lambda _, i: step(F.get(earlier, F.shiftright(i, FAN_BITS)), fold(F.slice(xs, i - inside(i) + 1, inside(i)))))

    def levels(xs: Column) -> Column:
        top = lambda b2: F.transform(b2, lambda _, i: fold(F.slice(b2, F.lit(1), i)))
        middle = lambda b1: bound(blocks(b1), lambda b2: bound(top(b2), lambda p2: over(b1, p2)))
        return bound(bound(blocks(xs), middle), lambda p1: over(xs, p1))

    return bound(values, levels)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """All matches as array<struct<start, kind, end, body>>, leftmost and non-overlapping, failing ones dropped."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("whole"), bodies.alias("body"))
    long = lambda x: F.coalesce(F.length(x["whole"]), F.lit(0))  # noqa: E731  null after the last match

    def placed(met: Column, before: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            begin = F.get(before, i) + x["gap"]
            return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + long(x)).alias("end"), x["body"].alias("body")).cast(SPAN)

        return F.filter(F.transform(met, span), lambda x: F.coalesce(F.length(x["body"]) >= least, F.lit(False)))

    found = bound(zipped, lambda met: bound(running(F.transform(met, lambda x: x["gap"] + long(x)), _sum, F.lit(0)), lambda before: placed(met, before)))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def largest_entropy(body: Column, c: CharacterClass) -> Column:
    """The largest Shannon entropy (bits a character) of any window of ``body``, by incremental counts.

    With counts k of the w characters in a window the entropy is log2(w) - sum(k*log2(k))/w, so the state is the
    counts, that sum, and the smallest sum met once the window is full. A count takes as many bits as w does; as many
    of them as fit share a long number.
    """
    w, bits = c.window, c.window.bit_length()
    per = 63 // bits
    words = range(-(-len(c.alphabet) // per))
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 1)])
    xlogx = lambda n: F.get(term, n.cast("int"))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % per * bits).cast("int"))
    word = lambda p: F.floor(p / per)
    start = F.struct(*[F.lit(0).cast("bigint").alias(f"k{j}") for j in words], F.lit(0.0).alias("s"), F.lit(1e9).alias("low"))

    def largest(places: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enter, leave = F.get(places, i), F.get(places, i - w)  # null while nothing leaves

            def count(p: Column) -> Column:
                held = F.coalesce(*[F.when(word(p) == j, state[f"k{j}"]) for j in words])
                return F.call_function("shiftright", held, (p % per * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))

            same = F.coalesce(enter == leave, F.lit(False))
            grown = xlogx(count(enter) + 1) - xlogx(count(enter)) + F.coalesce(xlogx(count(leave) - 1) - xlogx(count(leave)), F.lit(0.0))
            s = F.when(same, state["s"]).otherwise(state["s"] + grown)
            now = [state[f"k{j}"] + F.when(word(enter) == j, one(enter)).otherwise(0) - F.when(word(leave) == j, one(leave)).otherwise(0) for j in words]
            low = F.when(i >= w - 1, F.least(state["low"], s)).otherwise(state["low"])
            return F.struct(*[x.alias(f"k{j}") for j, x in enumerate(now)], s.alias("s"), low.alias("low"))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda st: F.log2(F.lit(float(w))) - st["low"] / w)

    places = F.transform(F.split(body, ""), lambda ch: F.position(ch, F.lit(c.alphabet)) - 1)
    return bound(places, largest)


def allowed(body: Column, words: str = WORDS, filler: str = FILLER) -> Column:
    """Whether a candidate is suppressed: it has at most 48 characters and a placeholder, or filler makes it up but for
    ``STRAY`` characters between any two pieces of it and at either end (its entropy may be high, its information is low).

    Anything longer that only contains such a part is reported; no rule depends on how many pieces there are.
    """
    rest = F.regexp_replace(body, filler, GONE)
    short = (F.length(body) <= 48) & F.rlike(body, F.lit(f"(?i){words}"))
    return short | (F.contains(rest, F.lit(GONE)) & ~F.rlike(rest, F.lit(f"[^{GONE}]{{{STRAY + 1}}}")))


def apart(candidates: Column, taken: Column) -> Column:
    """The candidates that overlap no span of ``taken``.

    Of the spans that start before a candidate's end (a binary search by start) the one that reaches farthest decides.
    """

    def free(x: Column, starts: Column, reach: Column) -> Column:
        def halve(state: Column, _: Column) -> Column:
            middle = F.shiftright(state["low"] + state["high"], 1)
            go = state["low"] < state["high"]
            right = F.get(starts, middle) < x["end"]
            return F.struct(F.when(go & right, middle + 1).otherwise(state["low"]).alias("low"), F.when(go & ~right, middle).otherwise(state["high"]).alias("high"))

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))
        before = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")), halve, lambda s: s["low"])
        return F.get(reach, before) <= x["start"]

    def searched(ordered: Column) -> Column:
        starts, ends = F.transform(ordered, lambda x: x["start"]), F.transform(ordered, lambda x: x["end"])
        farthest = running(F.concat(ends, F.array(F.lit(0))), _larger, F.lit(-1))
        return bound(starts, lambda s: bound(farthest, lambda r: F.filter(candidates, lambda x: free(x, s, r))))

    found = bound(F.array_sort(F.transform(taken, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))), searched)
    return F.when((F.size(candidates) == 0) | (F.size(taken) == 0), candidates).otherwise(found)


def _random(c: CharacterClass):
    return lambda x: largest_entropy(x["body"], c) >= c.bits


def joined(array: Column, names: tuple[str, ...]) -> Column:
    """kind:start:end of each span, by start, then kind as listed, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, names)), k + 1)
    ordered = F.array_sort(F.transform(array, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _scanned(rows: DataFrame, text: str, base: str, added: str, classes: tuple[CharacterClass, ...], words: str = WORDS, filler: str = FILLER) -> DataFrame:
    """``rows`` with the columns ``base`` and ``added`` for their column ``text``."""
    t = F.col(text)
    patterns = ((ASSIGN, 2), (ACCESS_LONG, 0), (HEX_LONG, 0))
    found = rows.withColumn(base, F.concat(*[spans(t, p, k, group=g, least=LEAST[KINDS[k]]) for k, (p, g) in enumerate(patterns)]))
    parts = []
    for k, c in enumerate(classes):
        candidates = spans(t, c.pattern, len(KINDS) + k, least=c.least)
        wanted = F.filter(apart(candidates, F.col(base)), lambda x: ~allowed(x["body"], words, filler))
        parts.append(F.filter(wanted, _random(c)))
    return found.withColumn(added, F.concat(*parts))


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", classes: tuple[CharacterClass, ...] = CLASSES, words: str = WORDS, filler: str = FILLER) -> DataFrame:
    """Return ``carry``, ``base`` and ``added``: arrays of spans (start, kind, end, body), offsets in code points.

    ``base`` are the three patterns' matches (kind 0 to 2), each kind leftmost and non-overlapping, never suppressed;
    ``added`` are high-entropy candidates (kind 3 on) that overlap no base span and that aren't :func:`allowed`. A null
    text counts as empty and has neither; ids may be null or repeated; an empty table gives an empty result. A carried
    column called ``base`` or ``added`` gives way to the result's; no other name is reserved.
    """
    carry = tuple(c for c in carry if c.lower() not in ("base", "added"))
    rows = docs.select(common.packed(carry, docs).alias("row"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    return _scanned(rows, "text", "base", "added", classes, words, filler).select(*common.unpacked(carry), "base", "added")


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id, n_assign, n_access, n_hex, base_sha256 and spans, a row for each row of ``docs``."""
    names = KINDS + tuple(c.name for c in CLASSES)
    s = scan(docs, (id_column,), text_column)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return s.select(
        F.col(id_column), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base"), names), 256).alias("base_sha256"), joined(F.concat("base", "added"), names).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans are replaced as one.

    All columns are kept, whatever their names. A null text stays null; repeated rows repeat each other; an empty table
    gives an empty result.
    """
    names = docs.columns
    rows = docs.select(common.packed(names, docs).alias("row"), docs[text_column].cast("string").alias("raw"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    s = _scanned(rows, "text", "base", "added", CLASSES)
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def gaps(spans_: Column) -> Column:
        """What lies between the spans: from the largest end so far to the next start, and to the end of the text."""
        ends = F.concat(F.transform(spans_, lambda x: x["end"]), F.array(F.lit(0)))
        starts = F.concat(F.transform(spans_, lambda x: x["start"]), F.array(F.length("text")))
        between = lambda until: F.zip_with(until, starts, lambda a, b: F.struct(F.greatest(a, F.lit(0)).alias("start"), b.alias("end"), (b >= a).alias("fresh")))
        return F.filter(between(running(ends, _larger, F.lit(-1))), lambda x: x["fresh"])

    def put_together(blocks: Column) -> Column:
        """The gaps' texts with marks between them, each from the blocks it touches."""

        def kept(x: Column) -> Column:
            a, b = F.floor(x["start"] / BLOCK).cast("int"), F.floor(x["end"] / BLOCK).cast("int")
            inside = F.substring(F.get(blocks, a), x["start"] % BLOCK + 1, x["end"] - x["start"])
            head, tail = F.substring(F.get(blocks, a), x["start"] % BLOCK + 1, F.lit(BLOCK)), F.substring(F.coalesce(F.get(blocks, b), F.lit("")), F.lit(1), x["end"] % BLOCK)
            between = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
            return F.when(x["start"] == x["end"], "").when(a == b, inside).otherwise(F.concat(head, between, tail))

        return F.array_join(F.transform(bound(ordered, gaps), kept), mark)

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = bound(blocks, put_together)
    result = s.withColumn("text", F.when(F.size(F.concat("base", "added")) > 0, clean).otherwise(F.col("raw")))
    return result.select(*[F.col("text").alias(c) if c == text_column else x for c, x in zip(names, common.unpacked(names), strict=True)])
