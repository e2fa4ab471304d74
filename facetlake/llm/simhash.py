"""SimHash near-duplicate groups by anchor-point covering, and groups of similar texts.

Fingerprints have 64 bits. Anchors are the words of a covering code: bits 0-22
and bits 23-45 each carry the binary Golay code (23 bits, 4096 words, covering
radius 3), so an anchor is a pair of code words, one of 2 ** 24. Every
fingerprint has exactly one home anchor, at most 3 bits away in each half. A
fingerprint within ``threshold`` bits of another is at most 3 + e1 and 3 + e2
bits from the other's home, with e1 + e2 <= threshold; so it is replicated to
every anchor that close, and each home meets all its neighbours at its own
anchor. No pair is missed, and the other 18 bits only take part in comparing.

Equal fingerprints are one row from the start, so groups of exact copies cost
nothing. Anchors with more than ``block`` home fingerprints are dealt into
sub-blocks of homes, each of which gets all replicas. Inside a block, homes are
compared with replicas in numpy, in bounded slices, and only the edges of a
spanning forest leave it. Labels then spread over the edges (large star, small
star, each round a written table) until nothing changes.

``keep_one`` links texts by a Jaccard similarity of ``LEAST`` or more between the
sets of their ``SIZE``-word shingles. Prints of two texts at 0.8 differ in about
ten of 64 bits; anchors for ten bits would take some 400,000 replicas a print, so
the anchors alone can't give these links. They give the first candidates (two
bits); the others share one of ``BANDS`` keys, each of ``ROWS`` min-hashes, which
misses a pair at 0.8 with a chance of 0.0006, a more similar one with less. Every
link, of either kind, is checked on the texts themselves.

A large group of copies must not become all its pairs. So ``ROUNDS`` times the members of
each key are compared with a few of them: the one whose keys have the most members in all (a
text that others extend or edit shares keys with most of them, an edited copy with few; of equal
ones the text with the fewest shingles), and
after the first time some drawn ones. Pairs of which fewer than ``MATCHES`` of all min-hashes agree, or whose sizes
exclude the similarity, go no further; at a similarity of 0.8 that is a chance of 0.00001.
Then labels spread, and only keys whose members still have different labels go on, whole:
members outside a key's most frequent label are dealt into blocks of ``HELD``, all members
into slices of ``STREAMED``; each block meets each slice in one place. There min-hashes are
compared first, which gives the members that have any likely partner of another label; their
texts go to the same place, and likely pairs with different labels are checked on the texts,
each pair at its first common key. Only edges of a spanning forest leave, never a pair for each
comparison, and no comparison is left out, however large a group is.

Defined results: a null or blank text has fingerprint zero, linked like any
other; repeated rows and ids share fingerprints as any copies; a null id never
becomes a component id unless all ids of the component are null; an empty table
gives no rows; other columns are ignored. For ``keep_one``, null and blank texts
have no shingles and are one group; a text of fewer words has one shingle; the
row that stays has the least id (null last), and where ids repeat the least text
hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import written
from facetlake.llm.repeats import packed

SEED = 42
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
N_BITS, RADIUS = 23, 3
#: Pairs compared at once, and hashes counted at once.
SLICE = 1 << 21
SIZE, LEAST = 5, 0.8
BANDS, ROWS, ROUNDS, DRAWN, MATCHES = 14, 4, 2, 3, 32
#: Members of a block that a task holds, and of a slice that it compares with them.
HELD, STREAMED = 512, 8192
_DRAWN = np.random.default_rng(17).integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
_TIMES, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(s), SEED) for s in zip(*(words[k:] for k in range(size)), strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is 1 if set in over half of the hashes."""
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SLICE >> 3):
        part = np.array(hashes[at : at + (SLICE >> 3)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


# --- anchors ----------------------------------------------------------------


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code words; home word of each syndrome's coset (as the error to add); errors of weight <= 5 by syndrome and weight.

    A word's anchors within distance r are word ^ e for the errors e of weight
    up to r in its own coset, so one table of 2048 cosets serves every word.
    """
    r = np.arange(1 << N_BITS, dtype=np.uint32)
    weight = np.bitwise_count(r)
    light = r[weight <= RADIUS + 2]
    light = light[np.argsort(np.bitwise_count(light), kind="stable")]
    s = syndrome(light)
    order = np.argsort(s, kind="stable")
    light, s = light[order], s[order]
    starts = np.searchsorted(s, np.arange(2049))
    return light, np.bitwise_count(light).astype(np.int8), starts


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator polynomial; zero for code words."""
    r = words.astype(np.uint32).copy()
    for bit in range(N_BITS - 1, 10, -1):
        r = np.where((r >> np.uint32(bit)) & np.uint32(1), r ^ np.uint32(GOLAY << (bit - 11)), r)
    return r


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor, is home) for every anchor within reach."""
    errors, weights, starts = golay_tables()
    mask = np.uint64((1 << N_BITS) - 1)
    halves = [(fps >> np.uint64(k * N_BITS) & mask).astype(np.uint32) for k in (0, 1)]

    def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = syndrome(words)
        n = starts[s + 1] - starts[s]
        row = np.repeat(np.arange(len(words)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
        over = np.maximum(weights[at] - RADIUS, 0)
        keep = over <= threshold
        return row[keep], (words[row] ^ errors[at])[keep], over[keep]

    (row_a, word_a, over_a), (row_b, word_b, over_b) = map(near, halves)
    n_b = np.bincount(row_b, minlength=len(fps))
    first_b = np.cumsum(n_b) - n_b
    n = n_b[row_a]
    left = np.repeat(np.arange(len(row_a)), n)
    right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[row_a], n)
    over = over_a[left] + over_b[right]
    keep = over <= threshold
    left, right, over = left[keep], right[keep], over[keep]
    anchor = word_a[left].astype(np.int64) | word_b[right].astype(np.int64) << N_BITS
    return row_a[left], anchor, over == 0


def _replicas(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                row, anchor, home = anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])

    return run


# --- comparing --------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes but the least ones; a, b: edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def block_edges(group: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forest edges of rows sorted by group: homes against all rows of their group, in slices."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    which = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    length = np.diff(np.append(cut, len(group)))
    homes = np.flatnonzero(home & (length[which] > 1))
    todo = np.cumsum(length[which[homes]])
    bits = fps.view(np.uint64)
    at = 0
    while at < len(homes):
        to = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + SLICE, "right")))
        h = homes[at:to]
        n = length[which[h]]
        left = np.repeat(h, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(cut[which[h]], n)
        near = (np.bitwise_count(bits[left] ^ bits[right]) <= threshold) & (fps[left] != fps[right])
        if near.any():
            yield forest(fps[left[near]], fps[right[near]])
        at = to


def _compare(threshold: int):
    """Rows come sorted by (anchor, sub); a group cut by a batch's end waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, sub = (table.column(c).to_numpy() for c in ("anchor", "sub"))
            fps, home = table.column("fp").to_numpy(), table.column("home").to_numpy()
            change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])])
            for a, b in block_edges(np.cumsum(change), fps, home, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 200_000:
                continue
            whole = pa.Table.from_batches(held)
            anchor, sub = whole.column("anchor").to_numpy(), whole.column("sub").to_numpy()
            last = int(np.flatnonzero((anchor != anchor[-1]) | (sub != sub[-1]))[-1]) + 1 if (anchor[0] != anchor[-1] or sub[0] != sub[-1]) else 0
            if last:
                yield from flush(whole.slice(0, last))
            held = whole.slice(last).to_batches()
            rows = whole.num_rows - last
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def near_edges(distinct: DataFrame, *, threshold: int = 2, block: int = 50_000) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (column fp) within threshold bits."""
    spread = distinct.select("fp").mapInArrow(_replicas(threshold), "anchor bigint, fp bigint, home boolean")
    homes = spread.filter("home").groupBy("anchor").count().filter(F.col("count") > block)
    homes = written(homes.select("anchor", F.ceil(F.col("count") / block).cast("int").alias("subs")), "simhash-hot")
    if homes.isEmpty():
        dealt = spread.withColumn("sub", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int")
        dealt = spread.join(homes, "anchor", "left").withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("own", own)
        dealt = dealt.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("home", F.col("home") & (F.col("sub") == F.col("own"))).select("anchor", "fp", "home", "sub")
    dealt = dealt.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub")
    return dealt.mapInArrow(_compare(threshold), "a bigint, b bigint")


# --- components -------------------------------------------------------------


def least_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) with label the least node reachable; nodes without an edge are absent.

    Large star, then small star, until the edges are all node -> least node. Each
    round moves every node at least as near to its least node, and the number of
    rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while True:
        ends = now.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        moving = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0")
        if not moving.agg(F.count("*")).first()[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        sides = now.select("a", "b").union(now.select("b", "a")).toDF("u", "v")
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        now = written(small, "edges")


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 2, block: int = 50_000) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id for every row."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds 0 to 2")
    used = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = written(used.mapInArrow(_fingerprints, f"doc_id {used.schema['doc_id'].dataType.simpleString()}, fp bigint"), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = least_labels(near_edges(distinct, threshold=threshold, block=block))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(component, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- groups by similarity ---------------------------------------------------


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(np.array(shingle_hashes(text, SIZE), np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray | None:
    """BANDS x ROWS min-hashes; none for an empty set."""
    if not len(hashes):
        return None
    least, short = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32), (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1 << 12):
        np.minimum(least, (_TIMES * short[at : at + (1 << 12)] + _PLUS).min(axis=1), out=least)
    return least.view(np.int32)


def band_keys() -> Column:
    """A key for each band of the column ``hashes``."""
    return F.array(*[F.xxhash64(F.lit(k), *[F.get("hashes", F.lit(k * ROWS + i)) for i in range(ROWS)]) for k in range(BANDS)])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(text: str | None) -> tuple[int, int, np.ndarray | None, int]:
    """(name of the shingle set, fingerprint, min-hashes, size of the set)."""
    hashes = shingle_hashes(text, SIZE)
    distinct = np.unique(np.array(hashes, np.uint64))
    return xxhash.xxh64_intdigest(distinct.tobytes()), fingerprint(hashes), min_hashes(distinct), len(distinct)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = [sketch(t.as_py()) for t in part.column(1)]
            signed = [pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *signed, pa.array([f[2] for f in found], pa.list_(pa.int32())), pa.array([f[3] for f in found], pa.int32())], ["doc_id", "key", "node", "fp", "hashes", "n"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are similar; rows come sorted by b, whose set is held."""
    inflate = zstandard.ZstdDecompressor()
    read = lambda z: shingle_set(inflate.decompress(z.as_buffer()).decode("utf-8", "surrogatepass"))
    held: tuple[int | None, np.ndarray] = None, np.zeros(0, np.uint64)
    for batch in batches:
        b = batch.column(1).to_pylist()
        near = np.zeros(len(b), bool)
        for i in range(len(b)):
            if b[i] != held[0]:
                held = b[i], read(batch.column(3)[i])
            near[i] = similarity(read(batch.column(2)[i]), held[1]) >= LEAST
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], ["a", "b"])


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose texts are similar; texts: node, data (compressed)."""
    side = lambda c, d: texts.select(F.col("node").alias(c), F.col("data").alias(d))
    both = pairs.join(side("a", "data_a"), "a").join(side("b", "data_b"), "b").select("a", "b", "data_a", "data_b")
    return written(both.mapInArrow(_check, "a bigint, b bigint"), "simhash-similar")


def anchor_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs of nodes whose prints are equal or within two bits; distinct: node, fp."""
    first = written(distinct.groupBy("fp").agg(F.min("node").alias("least")), "simhash-prints")
    edges = near_edges(first)
    one = lambda c, d: first.select(F.col("fp").alias(c), F.col("least").alias(d))
    across = edges.join(one("a", "node_a"), "a").join(one("b", "node_b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    within = distinct.join(first, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return across.unionByName(within)


class _Side:
    """Rows of one side of a cell as arrays; texts are read when they are first asked for."""

    def __init__(self, rows: pa.Table) -> None:
        self.node, self.label, self.n, self.band, self.main = (rows[c].to_numpy() for c in ("node", "label", "n", "band", "main"))
        self.hashes = rows["hashes"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS * ROWS)
        self.data, self.sets = rows["data"] if "data" in rows.column_names else None, {}

    def shingles(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = shingle_set(zstandard.ZstdDecompressor().decompress(self.data[i].as_buffer()).decode("utf-8", "surrogatepass"))
        return self.sets[i]


def _likely(left: _Side, right: _Side, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in right, places in left) of the pairs to check: likely, of different labels, and here at their first common key."""
    same = right.hashes[at:to, None] == left.hashes[None]
    n = right.n[at:to, None], left.n[None]
    able = (same.sum(axis=2, dtype=np.uint8) >= MATCHES) & (right.label[at:to, None] != left.label[None]) & (5 * np.minimum(*n) >= 4 * np.maximum(*n))
    able &= right.main[at:to, None] | (right.node[at:to, None] > left.node[None])
    i, j = np.nonzero(able)
    first = same[i, j].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == right.band[at + i]
    return at + i[first], j[first]


def _meet(left: _Side, right: _Side, roots: dict, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (right, left) of the likely pairs, slice by slice; if exact, of those similar ones that join two labels."""

    def root(label: int) -> int:
        while (up := roots.get(label, label)) != label:
            roots[label] = label = roots.get(up, up)
        return label

    step = max(1, (SLICE << 4) // (len(left.node) * BANDS * ROWS))
    for at in range(0, len(right.node), step):
        i, j = _likely(left, right, at, min(at + step, len(right.node)))
        if exact:
            joins = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                a, b = root(right.label[x].item()), root(left.label[y].item())
                if a != b and similarity(right.shingles(x), left.shingles(y)) >= LEAST:
                    roots[a], joins[k] = b, True
            i, j = i[joins], j[joins]
        yield i, j


def _cells(exact: bool):
    """Rows come sorted by (cell, right): the left ones are held, the right ones met with them.

    Gives the rows (cell, right, node) that have a likely partner, or if ``exact`` edges (a, b) of similar ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, left, roots = None, [], None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, rights = batch["cell"].to_numpy(), batch["right"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (rights[1:] != rights[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if cells[at] != cell:
                    cell, held, left, roots = cells[at], [], None, {}
                if not rights[at]:
                    held.append(batch.slice(at, to - at))
                    continue
                if not held:
                    continue
                left = left or _Side(pa.Table.from_batches(held))
                right = _Side(pa.Table.from_batches([batch.slice(at, to - at)]))
                for i, j in _meet(left, right, roots, exact):
                    if exact:
                        yield pa.RecordBatch.from_arrays([pa.array(right.node[i]), pa.array(left.node[j])], ["a", "b"])
                        continue
                    i, j = np.unique(i), np.unique(j)
                    is_right = np.concatenate([np.ones(len(i), bool), np.zeros(len(j), bool)])
                    nodes = np.concatenate([right.node[i], left.node[j]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), cell)), pa.array(is_right), pa.array(nodes)], ["cell", "right", "node"])

    return run


def dealt_cells(now: DataFrame) -> DataFrame:
    """Members (bucket, band, node, label) of keys with several labels, dealt to cells: cell, right, node, label, band, main."""
    by_label = now.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", F.col("label").alias("of"))).alias("most")
    mixed = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("total"), most).filter("labels > 1")
    rows = now.join(mixed.select("bucket", "total", (F.col("total") - F.col("most.n")).alias("others"), F.col("most.of").alias("common")), "bucket")
    blocks, slices = F.ceil(F.col("others") / HELD), F.ceil(F.col("total") / STREAMED)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    facts = ["node", "label", "band", (F.col("label") == F.col("common")).alias("main")]
    cell = F.xxhash64("bucket", "block", "slice").alias("cell")
    left = rows.filter("label <> common").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("slice", upto(slices)).select(cell, F.lit(False).alias("right"), *facts)
    right = rows.withColumn("slice", F.pmod(F.xxhash64(F.lit(1), "node"), slices)).withColumn("block", upto(blocks)).select(cell, F.lit(True).alias("right"), *facts)
    return left.unionByName(right)


def unlike_edges(now: DataFrame, facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges that join all similar members of one key with different labels; facts: node, n, hashes."""
    cells = written(dealt_cells(now), "simhash-cells")
    sorted_by = lambda df: df.repartition("cell").sortWithinPartitions("cell", "right")
    likely = sorted_by(cells.join(facts.select("node", "n", "hashes"), "node")).mapInArrow(_cells(False), "cell long, right boolean, node long")
    chosen = written(cells.join(likely.distinct(), ["cell", "right", "node"], "left_semi"), "simhash-likely")
    full = chosen.join(facts.select("node", "n", "hashes"), "node").join(texts, "node")
    return written(sorted_by(full).mapInArrow(_cells(True), "a long, b long"), "simhash-joined")


def similar_labels(members: DataFrame, distinct: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label) of what is similar to others, label the least node reachable; members: bucket, band, node; distinct: node, fp, n, hashes."""
    near = anchor_pairs(distinct.select("node", "fp"))
    for end in ("a", "b"):
        near = near.join(texts.select(F.col("node").alias(end)), end, "left_semi")
    labels = least_labels(checked(near.select("a", "b").distinct(), texts))
    shared = members.join(members.groupBy("bucket").agg(F.count("*").alias("n_members")), "bucket").groupBy("node").agg(F.sum("n_members").alias("shared"))
    facts = written(distinct.join(shared, "node").select("node", "n", "hashes", "shared"), "simhash-facts")

    def labelled() -> DataFrame:
        return written(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "simhash-now")

    for turn in range(rounds):
        now = labelled()
        drawn = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "node").alias("h"), F.col("node").alias("middle"), F.col("label").alias("own"))).alias(f"x{k}") for k in range(DRAWN if turn else 0)]
        central = F.min(F.struct((-F.col("shared")).alias("h"), "n", F.col("node").alias("middle"), F.col("label").alias("own"))).alias("central")
        by_label = now.join(facts.select("node", "n", "shared"), "node").groupBy("bucket", "label").agg(central, *drawn)
        middles = F.array(*[F.struct(F.min(c)["middle"].alias("middle"), F.min(c)["own"].alias("own")) for c in ("central", *[f"x{k}" for k in range(len(drawn))])]).alias("middles")
        mixed = written(by_label.groupBy("bucket").agg(F.count("*").alias("labels"), middles).filter("labels > 1").select("bucket", "middles"), "simhash-mixed")
        pairs = now.join(mixed, "bucket").select("node", "label", F.inline("middles")).filter("label <> own").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).distinct()
        side = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}"))
        alike = F.aggregate(F.zip_with("h_a", "h_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda held, x: held + x)
        likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")).filter(alike >= MATCHES)
        found = checked(likely.select("a", "b"), texts)
        if found.isEmpty():
            break
        labels = least_labels(labels.toDF("a", "b").unionByName(found))
    found = unlike_edges(labelled(), facts, texts)
    return labels if found.isEmpty() else least_labels(labels.toDF("a", "b").unionByName(found))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with one row of each group of similar texts."""
    used = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    sketches = used.mapInArrow(_sketches, f"doc_id {used.schema['doc_id'].dataType.simpleString()}, key bigint, node bigint, fp bigint, hashes array<int>, n int")
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    distinct = written(written(sketches, "simhash-sketches").groupBy("node").agg(F.min(head).alias("head"), F.min("fp").alias("fp"), F.min("hashes").alias("hashes"), F.min("n").alias("n")), "simhash-distinct")
    spread = distinct.filter("hashes is not null").select("node", F.posexplode(band_keys()).alias("band", "bucket"))
    several = written(spread.groupBy("bucket").count().filter("count > 1").select("bucket"), "simhash-several")
    members = written(spread.join(several, "bucket"), "simhash-members")
    wanted = distinct.join(members.select("node").distinct(), "node").select("node", F.col("head.doc_id").alias("head_id"), F.col("head.key").alias("head_key"))
    at_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("key").eqNullSafe(F.col("head_key"))
    texts = written(packed(used.join(wanted, at_head).select("node", F.col("text").cast("binary").alias("data"))).dropDuplicates(["node"]), "simhash-texts")
    labels = similar_labels(members, distinct, texts, rounds)
    heads = distinct.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("head").alias("head")).select(F.col("head.doc_id").alias("head_id"), F.col("head.key").alias("head_key"))
    kept = docs.withColumn("row_key", F.xxhash64(F.col(text))).join(heads, F.col(doc_id).eqNullSafe(F.col("head_id")) & F.col("row_key").eqNullSafe(F.col("head_key")), "left_semi")
    once = Window.partitionBy(doc_id, "row_key").orderBy(F.lit(0))
    return kept.withColumn("row_no", F.row_number().over(once)).filter("row_no = 1").select(*docs.columns)
