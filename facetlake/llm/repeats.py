"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every ``length``-byte string that starts in two places has the same content in
both, so the same 64-byte gram of it is the least by hash (the leftmost of equal
ones). Only suffixes that begin at such a gram (about one byte in 70) take part:
the digit of the first radix pass is the gram. Suffixes alone in their gram are
done. The rest carry their context: what lies at most length - 64 bytes before
the gram and at most ``length`` bytes from its start on. Suffixes whose whole
context is found twice are done too: all of it is repeated. One of each kind of
context is left. Those are sorted inside their gram, most significant digit
first: rightward from the gram to depth ``length``, leftward to
``length`` - 64, groups splitting and single suffixes leaving at each pass. A
window that begins s bytes before the gram is repeated exactly if two suffixes
are in one group at depth length - s to the right and s to the left.

A group with more than ``group`` suffixes is split by its next digits before it is
sorted, so that no task gets a frequent gram as a whole. Windows that begin s = low
to high bytes before the gram share its low bytes to the left and length - high
bytes to the right; halving the range of s makes those shared parts longer, and
a suffix goes to the group of its own bytes in each half. Suffixes that are equal
in a whole half are settled before it is halved again: all its windows are repeated,
a span a suffix, and one of each kind goes on. So a suffix has a span for each of the
few halves that make up what it repeats, not one for each window; at the end of the
halving a group is one window, and the same count tells whether it is repeated.
Equal texts share their key, which is their content's hash, so copies add rows
to counts but never texts to a task.

Grams, contexts and texts are compared by 64- and 128-bit hashes, the bytes of a
context one by one. Nothing depends on the order of rows.

Defined results: a null or empty text has no bytes and no spans; texts shorter
than ``length`` keep everything; repeated rows make each other repeated; an
empty table gives no rows; other columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.common import written

LENGTH, GRAM, GROUP = 200, 64, 2_000
#: Suffixes sorted at once.
SORTED = 10_000
#: Bytes handled at once, and bits of a position among them.
PIECE, BITS = 1 << 21, 24
MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Polynomial hashes, modulo 2 ** 64, of all substrings of a piece."""

    def __init__(self):
        n = PIECE + 2 * LENGTH
        self.byte = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.up[: len(data)], dtype=np.uint64)])


_hasher: list[_Hasher] = []


def hasher() -> _Hasher:
    if not _hasher:
        _hasher.append(_Hasher())
    return _hasher[0]


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width`` keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, MASK64, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def suffixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, ...]:
    """(document, position in it, gram hash, context hash) of the chosen suffixes.

    Document d is data[starts[d]:ends[d]]. Windows that begin in [first, last) choose.
    """
    h, n = hasher(), len(data)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    if n < LENGTH:
        return empty
    sums = h.sums(data)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * h.down[: n - GRAM + 1])
    keys = grams >> np.uint64(BITS) << np.uint64(BITS) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(keys, LENGTH - GRAM + 1)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(len(least))
    least = least[(at + LENGTH <= ends[doc[: len(least)]]) & (at >= first) & (at < (n if last is None else last))]
    if not len(least):
        return empty
    pos = (least & np.uint64((1 << BITS) - 1)).astype(np.int64)
    pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])]
    d = doc[pos]
    left, right = np.minimum(LENGTH - GRAM, pos - starts[d]), np.minimum(LENGTH, ends[d] - pos)
    context = (sums[pos + right] - sums[pos - left]) * h.down[pos - left]
    return d, pos - starts[d], grams[pos], mixed(context ^ mixed((left * 1009 + right).astype(np.uint64)))


def document_suffixes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Suffixes of all texts; small texts share a piece, long ones are cut into overlapping pieces."""
    held: list[int] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, ...]]:
        lengths = np.array([len(texts[i]) for i in held])
        ends = np.cumsum(lengths)
        d, *rest = suffixes(np.frombuffer(b"".join(texts[i] for i in held), np.uint8), ends - lengths, ends)
        yield np.array(held)[d], *rest

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        if len(text) > PIECE:
            whole = np.frombuffer(text, np.uint8)
            step, last = PIECE - LENGTH, -1
            for at in range(0, len(text), step):
                a, b = max(0, at - LENGTH), min(len(text), at + step + 2 * LENGTH - 1)
                piece = whole[a:b]
                _, pos, gram, context = suffixes(piece, np.array([0]), np.array([b - a]), at - a, at - a + step)
                pos = pos + a
                #: a piece's first window often chooses what the last one of the piece before has chosen
                new = pos > last
                yield np.full(int(new.sum()), i), pos[new], gram[new], context[new]
                last = int(pos[-1]) if len(pos) else last
            continue
        if held and size + len(text) > PIECE:
            yield from flush()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield from flush()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)]
        for d, pos, gram, context in document_suffixes(batch.column(0).to_pylist()):
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "context": pa.array(context.view(np.int64)), "k1": pa.array(keys[0][d]), "k2": pa.array(keys[1][d]), "pos": pa.array(pos.astype(np.int64))})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts around the wanted positions of each text."""
    inflate = zstandard.ZstdDecompressor()
    for batch in batches:
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row in range(batch.num_rows):
            text = inflate.decompress(batch.column(2)[row].as_py())
            wanted = batch.column(3)[row].as_py()
            pos = [w["pos"] for w in wanted]
            yield pa.RecordBatch.from_pydict({
                "gram": pa.array([w["gram"] for w in wanted], pa.int64()), "k1": pa.array([k1[row]] * len(pos), pa.int64()), "k2": pa.array([k2[row]] * len(pos), pa.int64()), "pos": pa.array(pos, pa.int64()),
                "left": pa.array([text[max(0, p - LENGTH + GRAM) : p] for p in pos], pa.binary()), "right": pa.array([text[p : p + LENGTH] for p in pos], pa.binary()), "many": pa.array([w["many"] for w in wanted], pa.bool_()),
            })


def split_classes(classes: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Classes (0 to n - 1) split by a digit; one radix pass. Numbers stay below the number of rows."""
    n = int(classes.max()) + 1 if len(classes) else 0
    sample = np.zeros(n, digit.dtype)
    sample[classes] = digit
    if np.array_equal(sample[classes], digit):
        return classes
    return np.unique(classes.astype(np.int64) * 512 + digit, return_inverse=True)[1]


def repeated_offsets(group: np.ndarray, left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest s, from ``least`` to ``most``, for which the window that begins s bytes before the gram is repeated in its group; -1 for none.

    Suffixes that end early get a digit of their own (256) there, and depths
    beyond a suffix's end don't count.
    """
    n, reach = len(group), LENGTH - GRAM
    ahead, behind = np.full((n, LENGTH), 256, np.int16), np.full((n, reach), 256, np.int16)
    lengths = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    for i, (a, b) in enumerate(zip(right, left, strict=True)):
        ahead[i, : len(a)] = np.frombuffer(a, np.uint8)
        behind[i, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    by_depth = []
    classes = group
    for depth in range(LENGTH):
        if depth >= GRAM:
            by_depth.append(classes)
        classes = split_classes(classes, ahead[:, depth])
    by_depth.append(classes)
    low, high = np.full(n, -1), np.full(n, -1)
    before = group
    for s in range(reach + 1):
        alive = np.flatnonzero((lengths[0] >= LENGTH - s) & (lengths[1] >= s) & (least <= s) & (s <= most))
        if len(alive) > 1:
            pair = before[alive].astype(np.int64) * n + by_depth[LENGTH - s - GRAM][alive]
            _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
            found = alive[counts[inverse] > 1]
            low[found[low[found] < 0]] = s
            high[found] = s
        if s < reach:
            before = split_classes(before, behind[:, s])
    return low, high


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (low, key); whole groups are sorted together, some thousand rows at a time."""
    held: pa.Table | None = None

    def numbers(table: pa.Table) -> np.ndarray:
        low, key = (table.column(c).to_numpy() for c in ("low", "key"))
        return np.cumsum(np.concatenate([[True], (low[1:] != low[:-1]) | (key[1:] != key[:-1])])) - 1

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = repeated_offsets(numbers(table), *(table.column(c).to_pylist() for c in ("left", "right")), *(table.column(c).to_numpy() for c in ("low", "high")))
        found = (low >= 0) & ~table.column("many").to_numpy()
        pos = table.column("pos").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[found]) for c in ("k1", "k2")] + [pa.array((pos - high)[found]), pa.array((pos - low + LENGTH)[found])], ["k1", "k2", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows < SORTED:
            continue
        group = numbers(held)
        if last := int(np.searchsorted(group, group[-1])):
            yield from flush(held.slice(0, last))
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield from flush(held)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    deflate = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([deflate.compress(t.as_buffer()) for t in batch.column(batch.num_columns - 1)], pa.binary())], batch.schema.names)


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its last column, a binary one, compressed for the shuffle."""
    return df.mapInArrow(_pack, df.schema)


CONTEXT = "gram bigint, k1 bigint, k2 bigint, pos bigint, left binary, right binary, many boolean"
CONTEXT_COLUMNS = ("gram", "k1", "k2", "pos", "left", "right", "many")
SPAN = "k1 bigint, k2 bigint, start bigint, end bigint"


def digits(low: Column, high: Column) -> Column:
    """What all windows from low to high share of a context, hashed with the gram."""
    length = F.octet_length("left")
    return F.xxhash64("gram", F.substring("left", length - low + 1, low), F.substring("right", F.lit(1), LENGTH - high))


def halves(groups: DataFrame) -> DataFrame:
    """The suffixes of ``groups``, each in the half (or halves) of its range of windows where it has a whole window."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high"))))
    dealt = groups.withColumn("part", part).withColumn("low", F.col("part.low")).withColumn("high", F.col("part.high")).drop("part")
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    whole = dealt.filter(F.greatest("low", LENGTH - n_right) <= F.least("high", n_left))
    cut = whole.withColumn("left", F.substring("left", F.greatest(n_left - F.col("high"), F.lit(0)) + 1, F.col("high"))).withColumn("right", F.substring("right", F.lit(1), LENGTH - F.col("low")))
    return cut.withColumn("key", digits(F.col("low"), F.col("high")))


def settled(halved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of suffixes that equal another one in all windows of their half; one suffix of each kind, where a half has several windows)."""
    kind = ["gram", "low", "high", "left", "right"]
    kinds = written(halved.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one"), F.bool_or("many").alias("many")), "repeats-halves-kinds")
    twins = halved.filter("not many").join(kinds.filter("n > 1").select(*kind), kind, "left_semi")
    low, high = F.greatest("low", LENGTH - F.octet_length("right")), F.least("high", F.octet_length("left"))
    spans = twins.select("k1", "k2", (F.col("pos") - high).alias("start"), (F.col("pos") - low + LENGTH).alias("end"))
    ones = kinds.filter("low < high").select("gram", "one.*", "left", "right", (F.col("many") | (F.col("n") > 1)).alias("many"), "low", "high")
    return spans, ones.withColumn("key", digits(F.col("low"), F.col("high")))


def sorted_spans(contexts: DataFrame, group: int) -> DataFrame:
    """Spans from suffixes in groups of bounded size, whatever the size of their grams."""
    now, spans = contexts.withColumn("low", F.lit(0)).withColumn("high", F.lit(LENGTH - GRAM)).withColumn("key", F.col("gram")), []
    for level in range((LENGTH - GRAM).bit_length() + 1):
        large = written(now.groupBy("low", "key").count().filter(F.col("count") > group).select("low", "key"), "repeats-large")
        several = not large.isEmpty()
        small = now.join(large, ["low", "key"], "left_anti") if several else now
        dealt = small.select(*CONTEXT_COLUMNS, "low", "high", "key").repartition("low", "key").sortWithinPartitions("low", "key")
        spans.append(dealt.mapInArrow(_sort, SPAN))
        if not several:
            break
        rest = now.join(large, ["low", "key"], "left_semi")
        found, now = settled(written(halves(rest), f"repeats-halves-{level}"))
        spans.append(found)
    out = spans[0]
    for part in spans[1:]:
        out = out.unionByName(part)
    return out


def repeated_spans(texts: DataFrame, group: int = GROUP) -> DataFrame:
    """(k1, k2, spans) of the texts (k1, k2, data) with repeated strings; spans may overlap and pass the end."""
    chosen = texts.select("data", "k1", "k2").mapInArrow(_scan, "gram bigint, context bigint, k1 bigint, k2 bigint, pos bigint")
    #: written, so that the join's sides are plain exchanges and a frequent gram's rows can be split over tasks
    twice = written(chosen.groupBy("gram").count().filter("count > 1").select("gram"), "repeats-grams")
    shared = written(chosen.join(twice, "gram"), "repeats-shared")
    kinds = written(shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one")), "repeats-kinds")
    reach = LENGTH - GRAM
    full = shared.join(kinds.filter("n > 1").select("gram", "context"), ["gram", "context"]).select("k1", "k2", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end"))
    several = written(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram"), "repeats-several")
    ones = kinds.join(several, "gram").select("gram", "one.*", (F.col("n") > 1).alias("many"))
    wanted = ones.groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "gram", "many")).alias("wanted"))
    one_each = packed(texts.select("k1", "k2", "data")).dropDuplicates(["k1", "k2"])
    cut = one_each.join(wanted, ["k1", "k2"]).select("k1", "k2", "data", "wanted")
    contexts = written(cut.mapInArrow(_cut, CONTEXT), "repeats-contexts")
    spans = full.unionByName(sorted_spans(contexts, group))
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def kept_parts(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what is left, number of maximal runs removed)."""
    parts, at, runs = [], 0, 0
    last = -1
    for a, b in sorted(spans):
        b = min(b, len(data))
        if a > last:
            parts.append(data[at:a])
            runs += 1
            at = last = b
        elif b > last:
            at = last = b
    parts.append(data[at:])
    return b"".join(parts), runs


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inflate = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for z, spans in zip(batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
            data = inflate.decompress(z.as_buffer())
            kept, runs = kept_parts(data, [(s["start"], s["end"]) for s in spans or []])
            out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), text: str = "text", group: int = GROUP) -> DataFrame:
    """The ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    used = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.xxhash64(F.lit(1), F.col(text)).alias("k1"), F.xxhash64(F.lit(2), F.col(text)).alias("k2"), data.alias("data"))
    spans = repeated_spans(used, group)
    joined = packed(used).join(spans, ["k1", "k2"], "left").select(*[f"c{i}" for i in range(len(carry))], "spans", "data")
    schema = ", ".join([*[f"c{i} {used.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry))], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"])
    out = joined.mapInArrow(_remove, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
