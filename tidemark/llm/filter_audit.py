"""Filter interaction audit: what each filter removes, in every order in which the filters could be applied.

A document's outcome under any order depends only on its incidence: which of the five filters it fails, one of 32 masks.
So the corpus shrinks to histograms of masks for each part (all documents, good ones, toxic ones), which are stacked as
the rows of an integer matrix. What happens to each mask at each step of each order is fixed: four 32-by-600 matrices of
zeros and ones (120 orders of five steps) say whether a mask is kept, removed, redundant or a failure of that filter
alone. The products are all counts at once; the cost after the histograms doesn't depend on the corpus.

Whether a text repeats one of a smaller id is found without joining copies: rows are counted by text and mask on the map
side, so a text that a third of the corpus shares costs a few rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

#: The filters by letter; the k-th is bit k of a mask. E, the repeats, is found by comparing texts.
LETTERS = "ABCDE"
REPEAT = 1 << LETTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> dict[str, Column]:
    """Which filters of a single text fail; ``text`` is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 200,
        "B": F.lit(100) * distinct < F.lit(50) * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(3).cast("long") * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def orders(letters: str = LETTERS) -> list[tuple[str, int]]:
    """(order, step) of each column of the matrices, steps from 1."""
    return [("".join(p), k + 1) for p in permutations(letters) for k in range(len(letters))]


def outcomes(letters: str = LETTERS) -> dict[str, np.ndarray]:
    """A matrix for each outcome: a row for each mask, a column for each step of each order, ones where it occurs."""
    masks = np.arange(1 << len(letters))
    bit = {c: 1 << k for k, c in enumerate(letters)}
    shape = (len(masks), len(orders(letters)))
    kept, removed, redundant, unique = (np.zeros(shape, np.int64) for _ in range(4))
    for column, (order, step) in enumerate(orders(letters)):
        before = sum(bit[c] for c in order[: step - 1])
        own = bit[order[step - 1]]
        fails, gone = masks & own != 0, masks & before != 0
        kept[:, column] = ~fails & ~gone
        removed[:, column] = fails & ~gone
        redundant[:, column] = fails & gone
        unique[:, column] = masks == own
    return {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": unique}


def products(everyone: np.ndarray, good: np.ndarray, toxic: np.ndarray, letters: str = LETTERS) -> dict[str, np.ndarray]:
    """Counts for each part (row) and step of an order (column) from the stacked histograms, a row of masks a part."""
    made, n = outcomes(letters), len(everyone)
    stacked = np.concatenate([everyone, good, toxic]) @ made["removed"]
    out = {name: everyone @ matrix for name, matrix in made.items() if name != "removed"}
    out |= {"removed": stacked[:n], "good_lost": stacked[n : 2 * n], "toxic_lost": stacked[2 * n :]}
    own = np.array([letters.index(order[step - 1]) for order, step in orders(letters)])
    of_filter = (own[:, None] == np.arange(len(letters))).astype(np.int64)  # which steps apply which filter
    return out | {"shapley": out["removed"] @ of_filter @ of_filter.T}


def masked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(doc_id, part, h, mask): a row for each row; h stands for the whole text, the mask lacks E."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    part = F.coalesce(docs[part_column].cast("string"), F.lit(""))
    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), part.alias("part"), text.alias("text"))
    bits = [F.when(fails, F.lit(1 << LETTERS.index(c))).otherwise(F.lit(0)) for c, fails in failures(F.col("text")).items()]
    return picked.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("h"), sum(bits[1:], bits[0]).alias("mask"))


def marked(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, good, toxic): a row an id; of repeated labels one that says so is enough."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    return known.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def histograms(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by which filters they fail, E included."""
    rows = masked(docs, id_column, text_column, part_column).groupBy("doc_id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Both sides of the join are plain shuffles, so that it can be split if an id should be hot.
    known = base.stored(marked(labels, id_column), "marked")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "h", "mask", "n", zero("good"), zero("toxic"))
    # Rows without an id repeat nothing, and nothing repeats them.
    texts = rows.groupBy("h", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    smallest = F.min(F.when(~F.col("nameless"), F.col("first.doc_id"))).over(Window.partitionBy("h"))
    new = F.when(F.col("nameless"), F.col("n")).when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(F.lit(0).cast("long"))
    texts = texts.withColumn("new", new)
    cases = F.array(F.struct(F.col("mask"), F.col("new").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(REPEAT)).alias("mask"), (F.col("n") - F.col("new")).alias("n")))
    each = texts.select("part", "good", "toxic", F.inline(cases)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """Return part, filter_order, step and the counts of ``COUNTS``: 600 rows for each part that has documents.

    Filters: A under 200 words, B under half of the words distinct, C over 3 % capital letters, D a mark of #$%&*|, E the
    text of a smaller id. ``labels`` has the id, ``quality`` and ``toxic``; unlabelled and null labels count as neither,
    repeated labels of an id once. Null texts count as empty, null parts as the empty part. Rows that repeat an id each
    count, and don't repeat each other; a row without an id has no label, and never fails E. Other columns are not read,
    whatever their names; an empty table gives an empty result.
    """
    base.ship(docs.sparkSession)
    held = histograms(docs, labels, id_column, text_column, part_column).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))  # 32 at most

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = orders()
        names, steps = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                stack = np.zeros((3, own.num_rows, 1 << len(LETTERS)), np.int64)
                for row, cells in enumerate(own.column("held").to_pylist()):
                    for c in cells:
                        stack[:, row, c["mask"]] = c["n"], c["good"], c["toxic"]
                made = products(*stack)
                parts = own.column("part").take(pa.array(np.repeat(np.arange(own.num_rows), len(columns))))
                arrays = [parts, pa.concat_arrays([names] * own.num_rows), pa.concat_arrays([steps] * own.num_rows), *[pa.array(made[c].ravel()) for c in COUNTS]]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *COUNTS])

    return held.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
