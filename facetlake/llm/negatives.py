"""Hard negatives by a block matrix product of anchors with all rows.

Rows are numbered by label and id and cut into blocks of ``WIDE`` rows, anchors into blocks
of ``TALL``; each block is also cut into chunks of ``CHUNK`` dimensions. A task holds one
chunk of one anchor block and of one row block and gives their partial tile of scores, in
whole numbers; the partial tiles of a pair of blocks are shuffled to one place and added as
int64. What leaves a finished tile is its best few rows for each anchor (or each anchor and
positive), and the best of all tiles are those of the table.

Positives come first: only pairs of blocks whose ranges of labels meet can hold them, which
the numbering by label keeps few. Then every pair of blocks gives, for each positive, the
best rows of other labels in the positive's window of scores.

No task holds more than two chunks, or one tile and its parts, however large the table or one
label is; the parts of a tile are at most ``CHUNKS``, as more dimensions make wider chunks.
Tiles travel in the narrowest whole numbers that hold them. The work and the tiles are
anchors x rows, as exact scores of all rows need.

Defined results: a row with a null id, label or vector, with any null or non-finite component,
or with a component whose code is outside +-2 ** 24 (sums might not fit 64 bits) takes no part,
and an empty vector is a vector of zeros;
shorter vectors count as filled with zeros; repeated rows are rows of their own, with
equal ids in any order; an anchor without positives, or a positive without negatives in its
window, gives no rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import written
from facetlake.storage import numbered

TALL, WIDE, CHUNK, CHUNKS = 256, 4096, 32, 16
LIMIT = 1 << 24
#: A block's rows: numbers, ids and labels, and for each row the scores of its positives, and how many there are.
META = "numbers binary, ids binary, labels binary, goals binary, having binary"
META_NAMES = [c.split()[0] for c in META.split(", ")]


def coded(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x); null if the vector takes no part."""
    codes = F.transform(vector, lambda x: F.floor(F.when(F.abs(x.cast("double")) <= F.lit(LIMIT / scale), x.cast("double") * scale)))
    return F.when(F.forall(codes, lambda c: c.isNotNull()), codes)


def _buffer(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _narrow(values: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not values.size or np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.int64)


def _read(cell: pa.Scalar, rows: int) -> np.ndarray:
    """A matrix of ``rows`` rows, of the type that its first byte names."""
    data = cell.as_buffer()
    return np.frombuffer(data, f"<i{data[0]}", offset=8).reshape(rows, -1)


def _sent(matrix: np.ndarray) -> pa.Array:
    small = _narrow(matrix)
    return pa.array([bytes([small.itemsize]) + bytes(7) + small.tobytes()], pa.binary())


def _packer(dims: int, width: int):
    """A block's rows (block, number, vec_id, label, codes, goals) as chunks (block, k, meta..., data)."""

    def packed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("number")
        n = rows.num_rows
        codes, goals = np.zeros((n, dims), np.int64), np.zeros((n, max([1, *(len(g) for g in rows["goals"].to_pylist())])), np.int64)
        having = np.zeros(n, np.int64)
        for i, (code, goal) in enumerate(zip(rows["codes"], rows["goals"], strict=True)):
            code, goal = code.values.to_numpy(), goal.values.to_numpy()
            codes[i, : len(code)], goals[i, : len(goal)], having[i] = code, goal, len(goal)
        meta = [_buffer(rows[c].to_numpy().astype(np.int64)) for c in ("number", "vec_id", "label")] + [_sent(goals), _buffer(having)]
        nothing = [pa.array([None], pa.binary())] * len(meta)
        for k, at in enumerate(range(0, dims, width)):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([k], pa.int32()), *(nothing if k else meta), pa.array([n], pa.int32()), _sent(codes[:, at : at + width])], ["block", "k", *META_NAMES, "n", "data"])

    return packed


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """rows: block, number, vec_id, label, codes, goals; the chunks of their blocks."""
    width = max(CHUNK, -(-dims // CHUNKS))
    used = rows.select("block", "number", "vec_id", "label", "codes", "goals")
    return used.groupBy("block").applyInArrow(_packer(dims, width), f"block long, k int, {META}, n int, data binary")


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right transposed in whole numbers; by floating point where it is exact."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1] if left.size and right.size else 0
    kind = np.float64 if most < 1 << 53 else np.int64
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def _multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial tile of one anchor chunk and one row chunk; the first chunks carry what is known of the rows."""
    rows = pa.Table.from_batches(list(batches))
    side = {rows["anchors"][i].as_py(): i for i in range(rows.num_rows)}
    of = lambda who, c: rows[c][side[who]]
    n = {who: of(who, "n").as_py() for who in side}
    tile = _product(_read(of(True, "data"), n[True]), _read(of(False, "data"), n[False]))
    meta = [pa.array([of(who, c).as_py()], pa.binary()) for who in (True, False) for c in META_NAMES]
    names = [f"{c}_{s}" for s in "ac" for c in META_NAMES]
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int64()), *meta, pa.array([n[True]], pa.int32()), _sent(tile)], ["a", "c", *names, "n_a", "tile"])


def _added(pick):
    """Adds the partial tiles of a pair of blocks and gives what ``pick`` takes from the sum."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, meta = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                part = _read(batch["tile"][i], batch["n_a"][i].as_py())
                total = part.astype(np.int64) if total is None else np.add(total, part, out=total)
                if batch["numbers_a"][i].is_valid:
                    meta = {c: batch[c][i] for c in (f"{m}_{s}" for s in "ac" for m in META_NAMES)}
        known = {c: np.frombuffer(v.as_buffer(), np.int64) for c, v in meta.items() if not c.startswith("goals")}
        yield from pick(total, known | {"goals_a": _read(meta["goals_a"], len(total)).astype(np.int64)})

    return add


def _nearest(scores: np.ndarray, known: dict, chosen: np.ndarray, most: int) -> np.ndarray:
    """Of the columns ``chosen``, the best ``most``: higher scores first, then smaller ids, then smaller numbers."""
    if len(chosen) > 4 * most:
        floor = np.partition(scores[chosen], len(chosen) - most)[len(chosen) - most]
        chosen = chosen[scores[chosen] >= floor]
    return chosen[np.lexsort((known["numbers_c"][chosen], known["ids_c"][chosen], -scores[chosen]))][:most]


def _positives(most: int):
    def pick(total: np.ndarray, known: dict) -> Iterator[pa.RecordBatch]:
        rows, columns = [], []
        for i in range(len(total)):
            same = np.flatnonzero((known["labels_c"] == known["labels_a"][i]) & (known["numbers_c"] != known["numbers_a"][i]))
            best = _nearest(total[i], known, same, most)
            rows.append(np.full(len(best), i))
            columns.append(best)
        i, j = np.concatenate(rows), np.concatenate(columns)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (known["numbers_a"][i], known["numbers_c"][j], known["ids_c"][j], total[i, j])], ["anchor", "number", "vec_id", "score"])

    return pick


def _negatives(most: int, low: int, high: int):
    def pick(total: np.ndarray, known: dict) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        for i, scores in enumerate(total):
            goals = known["goals_a"][i, : known["having_a"][i]]
            if not len(goals):
                continue
            able = np.flatnonzero((100 * scores >= low * goals.min()) & (100 * scores <= high * goals.max()) & (known["labels_c"] != known["labels_a"][i]))
            for place, goal in enumerate(goals):
                best = _nearest(scores, known, able[(100 * scores[able] >= low * goal) & (100 * scores[able] <= high * goal)], most)
                found.append([np.full(len(best), known["numbers_a"][i]), np.full(len(best), place), known["numbers_c"][best], known["ids_c"][best], scores[best]])
        merged = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged], ["anchor", "place", "number", "vec_id", "score"])

    return pick


def tiles(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, pick, schema: str) -> DataFrame:
    """What ``pick`` takes of the scores of each pair of blocks; anchors, rows: chunks; pairs: a, c."""
    chunk = ["k", *META_NAMES, "n", "data"]
    left = anchors.withColumnRenamed("block", "a").join(pairs, "a").select("a", "c", F.lit(True).alias("anchors"), *chunk)
    right = rows.withColumnRenamed("block", "c").join(pairs, "c").select("a", "c", F.lit(False).alias("anchors"), *chunk)
    metas = ", ".join(f"{m.split()[0]}_{s} binary" for s in "ac" for m in META.split(", "))
    partial = left.unionByName(right).groupBy("a", "c", "k").applyInArrow(_multiply, f"a long, c long, {metas}, n_a int, tile binary")
    return partial.groupBy("a", "c").applyInArrow(_added(pick), schema)


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "number")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine_negatives(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    used = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), coded(F.col(vector), scale).alias("codes")).dropna()
    rows = written(numbered(used, ["label", "vec_id"]), "negatives-rows")
    dims, total = rows.agg(F.max(F.size("codes")), F.count("*")).first()
    none = F.array().cast("array<bigint>")
    placed = rows.withColumn("block", F.expr(f"(number - 1) div {WIDE}")).withColumn("goals", none)
    chunks = written(blocks(placed, max(dims or 0, 1)), "negatives-blocks")
    mine = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    anchors = written(numbered(mine.withColumnRenamed("number", "row"), ["label", "vec_id", "row"], name="place").withColumn("block", F.expr(f"(place - 1) div {TALL}")).withColumnRenamed("row", "number"), "negatives-anchors")
    #: The row blocks that hold a label, and so those that an anchor block's positives are in.
    spans = rows.groupBy("label").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    ranges = anchors.select("block", "label").distinct().join(spans, "label").groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    near = written(ranges.select(F.col("block").alias("a"), F.explode(F.expr(f"sequence((first - 1) div {WIDE}, (last - 1) div {WIDE})")).alias("c")), "negatives-near")
    schema = "number long, vec_id long, score long"
    same = tiles(blocks(anchors.withColumn("goals", none), max(dims or 0, 1)), chunks, near, _positives(positives), f"anchor long, {schema}")
    chosen = written(_best(same, ["anchor"], positives), "negatives-positives")
    listed = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.col("vec_id").alias("id")))).alias("listed"))
    aimed = written(anchors.join(listed, anchors["number"] == listed["anchor"]).drop("anchor"), "negatives-aimed")
    last = max(0, (total - 1) // WIDE)
    pairs = aimed.select(F.col("block").alias("a")).distinct().select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("c"))
    other = tiles(blocks(aimed.withColumn("goals", F.col("listed.score")), max(dims or 0, 1)), chunks, pairs, _negatives(negatives, low, high), f"anchor long, place long, {schema}")
    best = _best(other, ["anchor", "place"], negatives)
    named = aimed.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("listed").alias("place", "positive"))
    return best.join(named.withColumn("place", F.col("place").cast("long")), ["anchor", "place"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
