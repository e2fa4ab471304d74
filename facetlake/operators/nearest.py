"""Exact top-k search over sparse and dense vectors without a table of all pairs.

Sparse (``top_sparse``): postings are kept in impact order, in blocks of one term and one
level of weight (levels are geometric steps, so a term has few); a small table holds each
block's greatest weight and size. A query first reads the blocks of greatest impact, up to
``SEED`` postings; the k-th best exact score of what it finds there is a lower bound of its
k-th best score at all. Then it reads a block only if a document in it could still reach
that bound: the block's greatest weight for this term, and for all other terms together
the smaller of the sum of their greatest impacts and, as vectors have unit length, the
length of the rest of the query. Its most frequent terms are not read at all, as long as their
part of the query's length is below the bound. A document found in no such block can't be among
the first k. Of the documents found, those go whose parts read so far miss the bound even with
the most that the unread terms can add: the length of the query's part in them times that of
the document's part in terms as frequent. The others get exact scores.

Texts (``top_texts``): scores of whole texts by TF-IDF without a shuffled row a posting. Each
text's counts stay one row of arrays; the scan cuts texts into pieces, and pieces are packed into
slices of a bounded number of postings. Only a slice's distinct terms are shuffled to get their
weight. A slice holds its texts by term, and all queries stream past it; the best k of a slice
for each query leave it.

Dense (``top_dense``): queries are numbered and packed in blocks of ``QUERIES`` rows, vectors are dealt
to slices; each block meets each slice in one place, as one matrix product a batch, and
only the best k of a slice for each query leave it.

Scores are rounded to ``digits`` before they are compared; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import vectors as V
from facetlake.functions.metrics import top
from facetlake.storage import numbered, written

#: Levels to a halving of the weight; postings that give the first bound; classes of a term's frequency (powers of 2), and how many of them are frequent; rows of a query block and of a slice.
STEPS, SEED, CLASSES, COMMON, QUERIES, SLICE = 4, 2000, 40, 4, 1024, 65_536
#: Postings of a piece and of a slice of texts, at most (a text is never cut), and rows that are counted at once.
PIECE, SLICE_POSTINGS, COUNTED = 1_000_000, 2_000_000, 1_000


# --- sparse -----------------------------------------------------------------


def impact_index(vectors: DataFrame, name: str = "id") -> tuple[DataFrame, DataFrame]:
    """(postings: term, level, id, weight; blocks: term, level, greatest weight, size) of unit vectors (id, term, weight > 0)."""
    level = F.floor(-F.log2("weight") * STEPS).cast("int")
    postings = written(vectors.select("term", level.alias("level"), F.col(name).alias("id"), "weight"), "postings")
    return postings, written(postings.groupBy("term", "level").agg(F.max("weight").alias("most"), F.count("*").alias("n")), "posting-blocks")


def _read(chosen: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of the chosen blocks (query, term, level, weight) of other documents than the query itself."""
    return chosen.withColumnRenamed("weight", "own").join(postings, ["term", "level"]).filter("id <> query")


def _exact(candidates: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, id, score) of the candidate pairs."""
    return V.dots(candidates.join(vectors, "id"), queries, ["query", "term"], ["query", "id"])


def top_sparse(queries: DataFrame, vectors: DataFrame, k: int, *, digits: int = 6, seed: int = SEED) -> DataFrame:
    """(query, id, score, rank) of the best k other vectors that share a term; queries: query, term, weight; vectors: id, term, weight."""
    queries, (postings, blocks) = written(queries, "queries"), impact_index(vectors)
    own = Window.partitionBy("query")
    met = queries.join(blocks, "term").withColumn("impact", F.col("weight") * F.col("most"))
    met = written(met.withColumn("greatest", F.max("impact").over(Window.partitionBy("query", "term"))), "query-blocks")
    first = own.orderBy(F.desc("impact"), "term", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = met.withColumn("upto", F.sum("n").over(first) - F.col("n")).filter(F.col("upto") < seed)
    guess = _read(opened.select("query", "term", "level", "weight"), postings).groupBy("query", "id").agg(F.sum(F.col("own") * F.col("weight")).alias("score"))

    def bound_by(guess: DataFrame) -> DataFrame:
        """(query, bound): the k-th best exact score of the best guesses, less what rounding may move two scores."""
        found = top(_exact(top(guess, 2 * k, ["query"], "id").select("query", "id"), queries, postings.drop("level")), k, ["query"], "id")
        return found.filter(F.col("rank") == k).select("query", (F.col("score") - 2 * 10.0**-digits).alias("bound"))

    terms = met.groupBy("query", "term", "weight", "greatest").agg(F.sum("n").alias("n")).withColumn("class", F.floor(F.log2("n")).cast("int"))
    sums = terms.groupBy("query").agg(F.sum("greatest").alias("all_impacts"), F.sum(F.col("weight") * F.col("weight")).alias("length"))
    bounds = written(sums.join(bound_by(guess), "query", "left"), "query-bounds")
    mass = F.col("weight") * F.col("weight")
    common = (F.col("class") >= F.max("class").over(own) - COMMON).alias("common")
    ahead = own.orderBy(F.desc("common"), F.desc(F.col("n") / mass), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    #: Of the frequent terms those with most postings for their part of the length go first: a document with none but those can't reach the bound, so they need not be read.
    least = F.least(F.sum("greatest").over(ahead), F.sqrt(F.sum(mass).over(ahead)))
    weighed = written(terms.withColumn("common", common).withColumn("reach", least).join(bounds, "query").withColumn("read", F.col("bound").isNull() | (F.col("reach") >= F.col("bound"))), "query-terms")
    essential = weighed.filter("read").select("query", "term")
    unread = weighed.filter("not read").groupBy("query").agg(F.min("class").alias("from_class"), F.sum(mass).alias("unread"))
    rest = F.least(F.col("all_impacts") - F.col("greatest"), F.sqrt(F.greatest(F.lit(0.0), F.col("length") - mass)))
    wanted = met.join(essential, ["query", "term"], "left_semi").join(bounds, "query").withColumn("reach", F.col("impact") + rest).filter("bound is null or reach >= bound")
    parts = _read(wanted.select("query", "term", "level", "weight"), postings).groupBy("query", "id").agg(F.sum(F.col("own") * F.col("weight")).alias("score"))
    #: What a document has in terms as frequent as those that were not read bounds what they can add.
    classes = blocks.groupBy("term").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("class"))
    tails = postings.join(classes, "term").groupBy("id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("class") >= c, F.col("weight") * F.col("weight"))), F.lit(0.0)) for c in range(CLASSES)]).alias("tail"))
    reached = parts.join(bounds, "query").join(unread, "query", "left").join(tails, "id")
    more = F.coalesce(F.sqrt(F.col("unread") * F.get("tail", F.least("from_class", F.lit(CLASSES - 1)))), F.lit(0.0))
    able = written(reached.select("query", "id", "score", more.alias("more"), "bound").filter("bound is null or score + more + 1e-9 >= bound").drop("bound"), "able")
    #: What has been read gives a better bound.
    able = able.join(bound_by(able).withColumnRenamed("bound", "better"), "query", "left").filter("better is null or score + more + 1e-9 >= better").select("query", "id")
    scores = _exact(able, queries, postings.drop("level")).withColumn("score", F.round("score", digits))
    return top(scores, k, ["query"], "id")


def postings_read(queries: DataFrame, vectors: DataFrame) -> int:
    """How many postings full scoring of the queries reads; a figure to hold ``top_sparse`` against."""
    return queries.join(vectors.groupBy("term").agg(F.count("*").alias("n")), "term").agg(F.sum("n")).first()[0] or 0


# --- texts ------------------------------------------------------------------

_TERM, _TEXT, _QUERY = range(3)


def _counts(piece: int):
    """Rows (id, tokens) to (piece, id, terms, counts): each text's distinct tokens; a new piece begins where the last one is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for low in range(0, batch.num_rows, COUNTED):
                some = batch.slice(low, COUNTED)
                lengths = pc.fill_null(pc.list_value_length(some["tokens"]), 0).to_numpy()
                coded = some["tokens"].flatten().dictionary_encode()
                n_terms = max(1, len(coded.dictionary))
                keys = np.repeat(np.arange(some.num_rows), lengths) * n_terms + coded.indices.to_numpy(zero_copy_only=False)
                found, counts = np.unique(keys, return_counts=True)
                sizes = np.bincount(found // n_terms, minlength=some.num_rows)
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(found % n_terms)))
                pieces = number + (held + ends - sizes) // piece
                number, held = int(pieces[-1]), int((held + ends[-1]) - (pieces[-1] - number) * piece)
                yield pa.RecordBatch.from_arrays([pa.array(pieces), some["id"], terms, pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["piece", "id", "terms", "counts"])

    return run


def text_counts(texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(piece, id, terms, counts), written; texts: id long, tokens. Rows with the same id are one text."""
    counted = texts.select("id", "tokens").mapInArrow(_counts(piece), "piece long, id long, terms array<string>, counts array<int>")
    twice = texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        pairs = counted.select("piece", "id", F.inline(F.arrays_zip("terms", "counts")))
        one = pairs.groupBy("id", "terms").agg(F.sum("counts").cast("int").alias("n"), F.min("piece").alias("piece"))
        counted = one.groupBy("id").agg(F.min("piece").alias("piece"), F.collect_list(F.struct("terms", "n")).alias("own")).select("piece", "id", F.col("own.terms").alias("terms"), F.col("own.n").alias("counts"))
    return written(counted, "text-counts")


def _rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: half up, in decimal; equal scores once."""
    own, at = np.unique(scores, return_inverse=True)
    return np.array([float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in own.tolist()])[at]


def _flat(part: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each row has, their numbers (-1 for terms that no text of the slice has) and counts; words come one after the other, with their lengths in bytes."""
    words, lengths = part["words"], part["lengths"].flatten().to_numpy()
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
    ends = pa.py_buffer((begin + np.concatenate([[0], np.cumsum(lengths)])).astype(np.int32))
    codes = pc.index_in(pa.StringArray.from_buffers(len(lengths), ends, words.buffers()[2] or pa.py_buffer(b"")), value_set=vocabulary)
    return pc.list_value_length(part["counts"]).to_numpy(), pc.fill_null(codes, -1).to_numpy(), part["counts"].flatten().to_numpy()


def _cosines(k: int, digits: int):
    """Rows of a slice come as its terms, its texts and all queries: texts are held by term, queries met with them one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, texts, index = [], [], None
        for batch in batches:
            kinds = batch["kind"].to_numpy()
            cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if at == to:
                    continue
                part = batch.slice(at, to - at)
                if kinds[at] == _TERM:
                    terms.append((part["words"], part["x"].to_numpy()))
                elif kinds[at] == _TEXT:
                    if not texts:
                        vocabulary, idf = pa.concat_arrays([t for t, _ in terms]), np.concatenate([x for _, x in terms])
                    texts += (_weighed(part.slice(low, COUNTED), vocabulary, idf) for low in range(0, part.num_rows, COUNTED))
                elif texts:
                    if index is None:
                        index = _by_term(texts, len(idf))
                    for low in range(0, part.num_rows, COUNTED):
                        yield _met(part.slice(low, COUNTED), vocabulary, idf, *index, k, digits)

    return run


def _weighed(part: pa.RecordBatch, vocabulary: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, how many terms each has, their numbers, and their counts over the text's length."""
    sizes, codes, counts = _flat(part, vocabulary)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    norms = np.sqrt(np.bincount(rows, (counts * idf[codes]) ** 2, len(sizes)))
    return part["id"].to_numpy(), sizes, codes, counts / norms[rows]


def _by_term(texts: list[tuple], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts, and where each term's postings begin; the texts in them by place, and their values. Takes the rows from ``texts``."""
    ids, sizes, codes, values = (np.concatenate([x[i] for x in texts]) for i in range(4))
    texts[:] = [()]
    order = np.argsort(codes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n_terms))])
    return ids, starts, np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order], values[order]


def _met(part: pa.RecordBatch, vocabulary: pa.Array, idf: np.ndarray, ids: np.ndarray, starts: np.ndarray, rows: np.ndarray, values: np.ndarray, k: int, digits: int) -> pa.RecordBatch:
    lengths, codes, counts = _flat(part, vocabulary)
    ends, found = np.cumsum(lengths), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for query, norm, low, high in zip(part["id"].to_pylist(), part["x"].to_pylist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
        own = codes[low:high] >= 0
        has = codes[low:high][own]
        score = np.zeros(len(ids))
        for a, b, x in zip(starts[has].tolist(), starts[has + 1].tolist(), (counts[low:high][own] * idf[has] ** 2 / norm).tolist(), strict=True):
            score[rows[a:b]] += x * values[a:b]
        score[ids == query] = 0
        # what may still be among the first k once it is rounded
        least = np.partition(score, -k)[-k] - 2 * 10.0**-digits if k < len(score) else 0
        near = np.flatnonzero((score >= least) & (score > 0))
        rounded = _rounded(score[near], digits)
        best = np.lexsort((ids[near], -rounded))[:k]
        found.append((np.full(len(best), query), ids[near][best], rounded[best]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query", "id", "score"])


def top_texts(texts: DataFrame, asked: Column, k: int, *, digits: int = 6, piece: int = PIECE, size: int = SLICE_POSTINGS) -> DataFrame:
    """(query, id, score, rank) of the best k other texts that share a term, by the cosine of ``vectors.tfidf``; texts: id long, tokens; asked: which ids are queries."""
    spark = texts.sparkSession
    counts = text_counts(texts, piece)
    total = F.lit(texts.count())
    sizes = counts.groupBy("piece").agg(F.sum(F.size("terms")).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # with few texts, a slice for each core
    least = F.greatest(F.lit(1), F.least(F.lit(size), F.ceil(F.max("upto").over(Window.partitionBy()) / spark.sparkContext.defaultParallelism)))
    slices = written(sizes.select("piece", F.floor((F.col("upto") - F.col("n")) / least).cast("int").alias("slice")), "slices")
    n_slices = (slices.agg(F.max("slice")).first()[0] or 0) + 1
    placed = counts.join(F.broadcast(slices), "piece").drop("piece")
    held = placed.select("slice", F.explode("terms").alias("term")).groupBy("slice", "term").agg(F.count("*").alias("n"))
    df = F.sum("n").over(Window.partitionBy("term"))
    terms = written(held.select("slice", "term", (F.log((1 + total) / (1 + df)) + 1).alias("idf")), "slice-terms")
    queries = placed.filter(asked)
    weight = F.col("counts") * F.col("idf")
    own = queries.select("id", "slice", F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    norms = own.join(terms.hint("merge"), ["slice", "term"]).groupBy("id").agg(F.sqrt(F.sum(weight * weight)).alias("x"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice")
    # words one after the other: an array of strings takes 16 bytes a word and more
    packed = F.array_join("terms", "").alias("words"), F.transform("terms", F.octet_length).alias("lengths")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    row = lambda df, kind, *cols: df.select("slice", F.lit(kind).alias("kind"), *cols)
    rows = (
        row(terms, _TERM, none("long", "id"), F.col("term").alias("words"), none("array<int>", "lengths"), none("array<int>", "counts"), F.col("idf").alias("x"))
        .unionByName(row(placed.filter("id is not null"), _TEXT, "id", *packed, "counts", none("double", "x")))
        .unionByName(row(queries.drop("slice").join(norms.hint("merge"), "id").select("*", every), _QUERY, "id", *packed, "counts", "x"))
    )
    met = rows.repartitionById(n_slices, F.col("slice")).sortWithinPartitions("kind").drop("slice")
    return top(met.mapInArrow(_cosines(k, digits), "query long, id long, score double"), k, ["query"], "id")


# --- dense ------------------------------------------------------------------


def _matrix(rows: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    values = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each query: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, query))
    by = query[order]
    starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return order[rank < k]


def _products(dims: int, k: int, digits: int):
    """Rows come sorted by (cell, vectors after queries): queries are held, vectors met with them batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block, best = None, [], None, None

        def given() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(block[0][best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, is_query = batch["cell"].to_numpy(), batch["is_query"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(at, to - at)
                if cells[at] != cell:
                    yield from given()
                    cell, held, block, best = cells[at], [], None, None
                if is_query[at]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    rows = pa.Table.from_batches(held)
                    block = rows["id"].to_numpy(), _matrix(rows["vector"], dims)
                    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                    least = np.full(len(block[0]), -np.inf)
                for low in range(0, part.num_rows, 4096):
                    some = part.slice(low, 4096)
                    ids = some["id"].to_numpy()
                    scores = np.round(np.clip(block[1] @ _matrix(some["vector"], dims).T, -1, 1), digits)
                    q, v = np.nonzero((scores >= least[:, None]) & (ids != block[0][:, None]))
                    merged = np.concatenate([best[0], q]), np.concatenate([best[1], ids[v]]), np.concatenate([best[2], scores[q, v]])
                    kept = _best(*merged, k)
                    best = tuple(m[kept] for m in merged)
                    full = np.bincount(best[0], minlength=len(least)) >= k
                    ends = np.full(len(least), np.inf)
                    np.minimum.at(ends, best[0], best[2])
                    least = np.where(full, ends, -np.inf)
        yield from given()

    return run


def top_dense(queries: DataFrame, vectors: DataFrame, k: int, *, digits: int = 5) -> DataFrame:
    """(query, id, score, rank): the k other vectors of greatest cosine; both sides: id long, vector (unit, of equal length)."""
    kept = written(vectors.select("id", "vector").dropna(), "dense-vectors")
    asked = written(numbered(queries.select("id", "vector").dropna(), ["id"]), "dense-queries")
    (dims, n), n_queries = kept.agg(F.max(F.size("vector")), F.count("*")).first(), asked.count()
    slices, blocks = max(1, -(-n // SLICE)), max(1, -(-n_queries // QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    cell = (F.col("block") * slices + F.col("slice")).cast("long").alias("cell")
    rows = lambda df, is_query: df.select(cell, F.lit(is_query).alias("is_query"), "id", "vector")
    left = rows(asked.withColumn("block", F.floor((F.col("number") - 1) / QUERIES)).withColumn("slice", every(slices)), True)
    right = rows(kept.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("block", every(blocks)), False)
    met = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", F.desc("is_query"))
    found = met.mapInArrow(_products(dims or 0, k, digits), "query long, id long, score double")
    return top(found, k, ["query"], "id")
