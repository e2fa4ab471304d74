"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded first (lower case, runs of other characters than
letters and digits become one space). An item of m folded characters may be
found with up to k = floor(m * rate) edits. Cut into k + 1 pieces, at least one
piece is in the text as it stands, at most k places from its diagonal. An
Aho-Corasick automaton finds all piece hits in one pass over the text; hits of
one item on near diagonals share a window. An edit spoils at most one of the
item's 4-character blocks, laid end to end, so a window that lacks more than k of
them is out; that loses nothing and spares most chance hits the next step. Myers' bit-parallel
distance (one big integer a column of the pattern's whole length) verifies the
window: the least edit distance between the item and any substring of it.

Items come to every task, so their number and size are checked: items are dealt
into blocks of at most ``block_chars`` characters, and each block is one pass
over the documents, whatever the size of the benchmark. The driver holds one
block at a time: with more than one, each pass is written before the next block
is read. A long document is folded and scanned in one piece; only its windows are
copied.

Defined results: null or blank texts and items match nothing; an item so short that
its budget is 0 is matched exactly, as whole words; repeated documents match each; items with equal text give a match each; an empty
table on either side gives no matches; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.common import written

RATE, BLOCK_CHARS, BLOCK = 0.1, 2_000_000, 4
OTHER = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    return OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks_of(text: str) -> list[str]:
    """The text's whole blocks of BLOCK characters, end to end."""
    return [text[i : i + BLOCK] for i in range(0, len(text) - BLOCK + 1, BLOCK)]


def lacks(window: str, wanted: list[str], most: int) -> bool:
    """True if more than ``most`` of the wanted blocks are not in the window; stops as soon as that is known."""
    for block in wanted:
        if block not in window:
            most -= 1
            if most < 0:
                return True
    return False


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to a substring of text, where the first such substring ends)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | ~(xh | plus) & full, plus & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(xv | hp) & full, hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """All items of a block behind one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        self.items = [(i, t, int(len(t) * rate), blocks_of(t)) for i, x in items if (t := folded(x))]
        self.words = [not budget for _, _, budget, _ in self.items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, distance, end in the folded text) of every item that is in the text; its best place."""
        if not self.items:
            return []
        whole = folded(text)
        diagonals: dict[int, list[int]] = {}
        for last, (length, own) in self.automaton.iter(whole):
            for n, at in own:
                diagonals.setdefault(n, []).append(last + 1 - length - at)
        found = []
        for n, starts in diagonals.items():
            item, pattern, k, wanted = self.items[n]
            if self.words[n]:
                ends = [a + len(pattern) for a in starts if (not a or whole[a - 1] == " ") and whole[a + len(pattern) : a + len(pattern) + 1] in ("", " ")]
                found += [(item, 0, min(ends))] if ends else []
                continue
            best = None
            for low, high in merged(sorted(set(starts)), k):
                a, b = max(0, low - k), min(len(whole), high + len(pattern) + k)
                window = whole[a:b]
                if lacks(window, wanted, k):
                    continue
                distance, end = (0, p + len(pattern)) if (p := window.find(pattern)) >= 0 else myers(pattern, window)
                if distance <= k and (best is None or distance < best[0]):
                    best = distance, a + end
                if best and not best[0]:
                    break
            if best:
                found.append((item, *best))
        return found


def merged(starts: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Runs of diagonals at most 2k + 1 apart: their windows overlap, so they are verified as one."""
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > 2 * k + 1:
            yield low, high
            low = s
        high = s
    yield low, high


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, read row by row: the driver holds one block at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield block


def _with_only(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the only one."""
    block, first = next(blocks), True
    for after in blocks:
        yield block, False
        block, first = after, False
    yield block, first


def _search(items: list[tuple[object, str]], rate: float):
    made: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(items, rate))
        for batch in batches:
            names = batch.schema.names
            at, ids, distances, ends = [], [], [], []
            for n, text in enumerate(batch.column(0)):
                for item, distance, end in made[0].find(text.as_py()):
                    at.append(n)
                    ids.append(item)
                    distances.append(distance)
                    ends.append(end)
            if at:
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[1:]], pa.array(ids, pa.int64()), pa.array(distances, pa.int32()), pa.array(ends, pa.int64())], [*names[1:], "item_id", "distance", "end"])

    return run


def leaks(docs: DataFrame, items: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item in it: the ``carry`` columns, item_id, distance, end (in the folded text)."""
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").orderBy("item_id", "text")
    used = docs.select(F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    schema = ", ".join([*[f"c{i} {used.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))], "item_id bigint, distance int, end bigint"])
    passes = []
    for block, one in _with_only(_blocks(wanted, block_chars)):
        part = used.filter("text is not null").mapInArrow(_search(block, rate), schema)
        passes.append(part if one else written(part, "leaks"))
    found = passes[0]
    for part in passes[1:]:
        found = found.unionByName(part)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "item_id", "distance", "end")


def _drop(items: list[tuple[object, str]], at: int, rate: float):
    made: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(items, rate))
        for batch in batches:
            yield batch.filter(pa.array([not made[0].find(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return run


def keep_clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without those that hold a benchmark item; no shuffle, a pass for each block of items."""
    wanted = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").orderBy("item_id", "text")
    schema = docs.schema
    for block, one in _with_only(_blocks(wanted, block_chars)):
        docs = docs.mapInArrow(_drop(block, schema.names.index(text), rate), schema)
        docs = docs if one else written(docs, "clean")
    return docs
