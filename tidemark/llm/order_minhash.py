"""Order MinHash fingerprints with DataFrame functions only.

Shingles of ``K`` words are numbered by occurrence, so that repeats count. A hash of (shingle, occurrence) deals each
into one of ``TUPLES`` bins and orders it there (one-permutation hashing: one hash a shingle instead of one for each
tuple). A bin's ``LEAST`` minimal shingles, in the order in which they stand in the text, make its tuple, hashed
together. A moved, inserted or swapped passage thus changes tuples even where the set of shingles stays the same, which
makes the signature sensitive to edit distance. A bin without shingles borrows the tuple of the next one that has some,
hashed with the distance (rotation densification).

All of it stays in the stage that reads the documents once they are dealt out by id: explode, a running count over
(document, shingle), and two aggregates, each of which a partitioning by id already satisfies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import stored

K = 5
TUPLES = 32
#: Minimal shingles that make a tuple.
LEAST = 3
#: Low bits of a packed selection that hold the position.
POSITION = (1 << 28) - 1
#: The key of a row without an id: the smallest number.
NO_ID = -(1 << 63)
SPACE = " \t\n\x0b\x0c\r"
#: What stands for each tuple of a text without shingles: other characters than a hash has.
NONE = "------"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a text without."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def shingles(w: Column, first: Column) -> Column:
    """Hashes of the shingles from index ``first`` on; a text of fewer than K words is one shingle."""
    last = F.size(w) - F.lit(K)
    at = F.sequence(first, F.greatest(last, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))
    return F.when((F.size(w) > 0) & (first <= F.greatest(last, F.lit(0))), hashes).otherwise(F.array().cast("array<bigint>"))


def next_documents(ids: DataFrame) -> DataFrame:
    """(key, quarter, next) for each distinct key of (key, quarter): ``next`` is the next larger key, after the last the first.

    The order is found range by range: a stored, range-partitioned list of keys, ``lead`` within each partition, and
    the first key of the next non-empty partition at its end (a table of one row a partition).
    """
    distinct = ids.groupBy("key").agg(F.max("quarter").alias("quarter"))
    dealt = stored(distinct.repartitionByRange(F.col("key")).withColumn("part", F.spark_partition_id()), "ordered-ids")
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first"))
    lowest = firsts.agg(F.min("first").alias("lowest"))
    following = firsts.withColumn("following", F.lead("first").over(Window.orderBy("part"))).crossJoin(lowest)
    ends = following.select("part", F.coalesce("following", "lowest").alias("end"))
    led = dealt.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return led.join(F.broadcast(ends), "part").select("key", "quarter", F.coalesce("next", "end").alias("next"))


def with_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, next, text, n, q, edited): each text and its edited form, partitioned by key.

    The key is the id; a null id sorts first. The edited text has its last q = floor(n / 4) code points replaced by
    the first q (or all) of the next document's text; where ids repeat, the smallest of the next id's beginnings.
    """
    key = F.coalesce(docs[id_column].cast("long"), F.lit(NO_ID))
    own = docs.select(key.alias("key"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    lengths = own.select("key", F.floor(F.length("text") / 4).cast("int").alias("quarter"))
    follow = stored(next_documents(lengths), "next-ids")
    beginnings = own.join(follow.withColumnRenamed("key", "reader"), F.col("key") == F.col("next"))
    beginnings = beginnings.groupBy("reader").agg(F.min(F.expr("left(text, quarter)")).alias("beginning"), F.min("next").alias("next"))
    both = own.join(beginnings, F.col("key") == F.col("reader")).drop("reader")
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    both = both.withColumn("n", n).withColumn("q", q).withColumn("stem", F.expr("left(text, n - q)"))
    return both.withColumn("edited", F.concat("stem", F.expr("left(beginning, q)")))


def signatures(rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """key, ``carry``, fingerprint and edited_fingerprint, from (key, row, text, stem, edited), within its partitions.

    Both texts begin with the same words, whose shingles have the same occurrence numbers and positions in either: they
    are handled once, for both. ``side``: 0 both texts, 1 the text only, 2 the edited text only. The carried columns
    travel on one extra row a document, so that a shingle's row is a few numbers.
    """
    split = rows.withColumn("w", words(F.col("text"))).withColumn("e", words(F.col("edited")))
    # All words of the stem but the last, which may go on differently, are common.
    split = split.withColumn("common", F.greatest(F.lit(0), F.size(words(F.col("stem"))) - K))
    facts = F.struct(*[F.col(c) for c in carry])
    hashed = split.select("key", "row", facts.alias("facts"), "common", shingles(F.col("w"), F.lit(0)).alias("own"), shingles(F.col("e"), F.col("common")).alias("tail"))
    first = F.array(F.lit(None).cast("bigint"))
    each = hashed.select("key", "row", "facts", "common", F.size("own").alias("n_own"), F.posexplode(F.concat(first, "own", "tail")).alias("i", "h"))
    i, own = F.col("i") - 1, F.col("i") <= F.col("n_own")
    each = each.select(
        "key", "row", "h", F.when(F.col("i") == 0, F.col("facts")).alias("facts"),
        F.when(own, i).otherwise(i - F.col("n_own") + F.col("common")).alias("at"),
        F.when(own, F.when(i < F.col("common"), 0).otherwise(1)).otherwise(2).alias("side"),
    )
    running = Window.partitionBy("key", "row", "h").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda side: F.sum(F.when(F.col("side").isin(0, side), 1).otherwise(0)).over(running)
    each = each.withColumn("g", F.xxhash64("h", F.when(F.col("side") < 2, count(1)).otherwise(count(2))))
    packed = F.col("g").bitwiseAND(F.lit(~POSITION)).bitwiseOR(F.col("at").cast("long").bitwiseAND(F.lit(POSITION)))
    bin_ = F.when(F.col("h").isNull(), F.lit(-1)).otherwise(F.col("g").bitwiseAND(F.lit(TUPLES - 1)).cast("int"))
    each = each.select("key", "row", "facts", "side", bin_.alias("t"), packed.alias("p"))
    of = lambda side: F.collect_list(F.when(F.col("side").isin(0, side), F.col("p")))
    tuples = each.groupBy("key", "row", "facts", "t").agg(of(1).alias("own"), of(2).alias("edited"))

    def signed(listed: str) -> Column:
        """Hash of the ranks of a bin's minimal shingles in text order; null for none."""
        least = F.slice(F.sort_array(listed), 1, LEAST)
        in_order = F.sort_array(F.transform(least, lambda p: F.shiftleft(p.bitwiseAND(F.lit(POSITION)), 36).bitwiseOR(F.shiftrightunsigned(p, 28))))
        return F.when(F.size(listed) > 0, F.xxhash64(F.transform(in_order, lambda p: p.bitwiseAND(F.lit((1 << 36) - 1)))))

    real = F.when(F.col("t") >= 0, F.struct("t", signed("own").alias("s1"), signed("edited").alias("s2")))
    listed = tuples.select("key", "row", "facts", real.alias("x"))
    gathered = listed.groupBy("key", "row").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.first("facts", ignorenulls=True).alias("facts"))

    def line(field: str) -> Column:
        digits = lambda v: F.lower(F.lpad(F.hex(v.bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))
        given = F.filter("xs", lambda x: x[field].isNotNull())

        def dense(have: Column) -> Column:
            ahead = lambda x, t: (x["t"] - t + TUPLES) % TUPLES
            nearest = lambda t: F.array_min(F.transform(have, lambda x: F.struct(ahead(x, t).alias("d"), x[field].alias("v"))))
            borrowed = lambda n: F.when(n["d"] == 0, digits(n["v"])).otherwise(digits(F.xxhash64(n["v"], n["d"])))
            return F.transform(F.transform(F.sequence(F.lit(0), F.lit(TUPLES - 1)), nearest), borrowed)

        filled = F.get(F.transform(F.array(given), dense), F.lit(0))
        values = F.when(F.size(given) == TUPLES, F.transform(given, lambda x: digits(x[field]))).when(F.size(given) > 0, filled)
        return F.array_join(F.coalesce(values, F.array_repeat(F.lit(NONE), TUPLES)), "")

    return gathered.select("key", "facts.*", line("s1").alias("fingerprint"), line("s2").alias("edited_fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples; 1 for two fingerprints without any, 0 where only one has none."""
    step = len(NONE)
    part = lambda f, i: F.substring(f, i * step + 1, F.lit(step))
    pairs = [(part(a, F.lit(i)), part(b, F.lit(i))) for i in range(TUPLES)]
    either = reduce(lambda x, y: x + y, [F.when((p == NONE) & (q == NONE), 0).otherwise(1) for p, q in pairs])
    equal = reduce(lambda x, y: x + y, [F.when((p == q) & (p != NONE), 1).otherwise(0) for p, q in pairs])
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint each text, its edited form, and compare with that and with the next document.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each input
    row. A null text counts as empty: its fingerprint has no tuples. A null id sorts first; where ids repeat, the next
    document is the one with the smallest fingerprint among those of the next id. An empty table gives an empty result.
    """
    rows = with_edited(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("n_chars", F.col("n").cast("long"))
    signed = stored(signatures(rows, ("next", "n_chars", "edited_sha256")), "order-minhash")
    following = signed.groupBy(F.col("key").alias("next")).agg(F.min("fingerprint").alias("next_fingerprint"))
    both = signed.join(following, "next")
    doc_id = F.when(F.col("key") != F.lit(NO_ID), F.col("key"))
    return both.select(
        doc_id.alias(id_column), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
