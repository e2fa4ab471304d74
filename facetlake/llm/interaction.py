"""Filter interaction audit: what each filter removes at each place of every order of the filters.

A row fails some of the filters; the failed ones are a bit mask. All that any order of
the filters does follows from how many rows of a part have each mask, so documents become
cells (part, mask) first: a table of at most 2 ** filters rows a part, whatever its size.

The orders are visited by swaps of two neighbours (``swaps``), each order once. A swap at
places i and i + 1 leaves the set of filters before i and that after i + 1 as they were;
so only these two steps are read from the cells again, the others are carried over.
Shapley values are summed along the walk: in each order a filter's share is what it removes
at its step. All parts of a batch are walked together, as columns of one array.

``first_of_equal`` marks rows whose text also stands under a smaller id, without a join on
the text: rows are counted by (digest, id, part) and the least id of a digest is one
aggregate; the rows that hold it are found by (digest, id), which is no hot key even
where a third of all texts are equal.

Defined results: a null text is empty; a null id is neither smaller nor larger than another,
so such a row never fails E and makes no other fail it; rows repeated under one id are equal to each
other, not copies; a document is good or toxic if any row of ``labels`` says so, and a document
without labels is neither; a null part is the empty string; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.common import words_of, written

COUNTS = ("rows", "good", "toxic")
SYMBOLS = "[#$%&*|]"
#: Parts walked together: orders x steps x measures of so many are held at once.
PARTS = 256
MOST_FILTERS = 8
#: Parts that rows without an id are dealt to.
SALTS = 64


def swaps(n: int) -> list[int]:
    """Places i whose swap with i + 1, one after the other, visits every order of n things once."""
    if n < 2:
        return []
    inner, found = swaps(n - 1), []
    for turn in range(len(inner) + 1):
        down = turn % 2 == 0  # the last thing walks through the others, and back in the next turn
        found += range(n - 2, -1, -1) if down else range(n - 1)
        if turn < len(inner):
            found.append(inner[turn] + down)
    return found


class _Cells:
    """Sums over masks of the parts' cells; cells: (measure, part, mask)."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.masks = cells, np.arange(cells.shape[2])

    def where(self, chosen: np.ndarray) -> np.ndarray:
        return self.cells[:, :, chosen].sum(axis=2)

    def step(self, before: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows kept after it, measures of what it removes) of the filter ``bit`` after those of ``before``."""
        reached = (self.masks & before) == 0
        return self.cells[0][:, reached & ((self.masks & bit) == 0)].sum(axis=1), self.where(reached & ((self.masks & bit) != 0))


def walk(cells: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """order -> (step, measure, part) of kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n, sums = len(filters), _Cells(cells)
    every = [sums.where((sums.masks & 1 << f) != 0)[0] for f in range(n)]
    alone = [sums.where(sums.masks == 1 << f)[0] for f in range(n)]
    order, steps = list(range(n)), [(np.zeros(0), np.zeros(0))] * n

    def read(place: int) -> None:
        steps[place] = sums.step(sum(1 << f for f in order[:place]), 1 << order[place])

    for place in range(n):
        read(place)
    shapley, seen = np.zeros((n, cells.shape[1]), np.int64), {}
    for swap in [None, *swaps(n)]:
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            read(swap)
            read(swap + 1)
        for place, f in enumerate(order):
            shapley[f] += steps[place][1][0]
        seen["".join(filters[f] for f in order)] = [(f, *steps[place]) for place, f in enumerate(order)]
    return {name: np.array([[kept, lost[0], every[f] - lost[0], alone[f], lost[1], lost[2], shapley[f]] for f, kept, lost in places]) for name, places in seen.items()}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _walker(filters: str):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                cells = np.array([some.column(1 + m).to_pylist() for m in range(len(COUNTS))], np.int64)
                parts, n = some.column(0).to_pylist(), some.num_rows
                for name, steps in walk(cells, filters).items():
                    for place, measures in enumerate(steps):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(parts, pa.string()), pa.array([name] * n), pa.array(np.full(n, place + 1, np.int32)), *[pa.array(m) for m in measures]],
                            ["part", "filter_order", "step", *MEASURES],
                        )

    return walked


def audit_orders(cells: DataFrame, filters: str) -> DataFrame:
    """cells: part, mask (bit f: fails the f-th filter), rows, good, toxic; a row for each part, order and step."""
    if not 0 < len(set(filters)) == len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters")
    of = lambda c, mask: F.coalesce(F.sum(F.when(F.col("mask") == mask, F.col(c))), F.lit(0)).cast("long")
    wide = cells.groupBy("part").agg(*[F.array(*[of(c, mask) for mask in range(1 << len(filters))]).alias(c) for c in COUNTS])
    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return wide.select("part", *COUNTS).mapInArrow(_walker(filters), schema)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fails A (few words), B (few distinct words), C (capitals), D (symbols)."""
    words = words_of(text)
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = (n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(SYMBOLS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def fail_cells(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask of A to E, rows, good, toxic."""
    body = F.coalesce(F.col(text), F.lit(""))
    flagged = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(body, 256).alias("digest"), text_mask(body).alias("mask"))
    alike = written(flagged.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("rows")), "audit-texts")
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    salted = alike.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0))
    joined = salted.join(known.withColumn("of", F.lit(0).cast("bigint")), (F.col("doc_id") == F.col("labelled")) & (F.col("salt") == F.col("of")), "left")
    counted = written(joined.select("digest", "doc_id", "part", "mask", "rows", *[(F.col("rows") * F.coalesce(c, F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]), "audit-labelled")
    least = alike.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = counted.join(least, ["digest", "doc_id"], "left_semi")
    no_id = counted.filter("doc_id is null")
    sums = [F.sum(c).alias(c) for c in COUNTS]
    signed = lambda df, sign, bit: df.groupBy("part", "mask").agg(*sums).select("part", F.col("mask").bitwiseOR(bit).alias("mask"), *[(F.lit(sign) * F.col(c)).alias(c) for c in COUNTS])
    #: All rows as copies, less those that are none, which are counted without the bit.
    moved = signed(counted, 1, 16)
    for some in (first, no_id):
        moved = moved.unionByName(signed(some, -1, 16)).unionByName(signed(some, 1, 0))
    return moved.groupBy("part", "mask").agg(*sums)


def audit_text_filters(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five filters A to E over ``docs``."""
    return audit_orders(fail_cells(docs, labels, doc_id=doc_id, text=text, part=part), "ABCDE")
