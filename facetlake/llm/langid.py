"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is its byte 2-, 3- and 4-grams (lower-cased), each hashed to one of
``BUCKETS`` rows of an embedding table. The mean row goes through a linear layer
and a softmax. Table and layer are trained together by stochastic gradient
descent in numpy, on the driver, from a bounded sample of labelled texts: about
``SAMPLE`` distinct (id, text) pairs, evenly over all languages, at least
``LEAST`` of each that has so many, chosen by hash; of a text of over
``SAMPLE_CHARS`` characters, a stretch of that length at a place given by its
hash. Every language in the labels is learned; more than ``MAX_LANGS`` are an
error, as the model comes to every task. Every whole text is predicted. As the
mean is linear, the trained table and layer fold into one row of logits a
bucket, and predicting is a gather and a sum.

Calibration: a tenth of the sample is kept out of training. On it, with snippets
of many lengths, a temperature is fitted (least log loss) and a rejection
threshold is set to the score below which the calibration set holds at most
``MISS`` of its right predictions. A document is rejected if it has no letter or
its score is below the threshold.

Defined results: with fewer than ten labelled texts a language the scores are not calibrated
and nothing but "und" is rejected; a null text or one without a letter is "und" with score 0;
without any labelled text all others are "und" too; null languages and ids are
not learned from; repeated rows are predicted each; an empty table gives no
rows; other columns are ignored. lang, source and doc_id are no inputs of a
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
SAMPLE, SAMPLE_CHARS, LEAST, MAX_LANGS = 2400, 20_000, 8, 1024
STEPS, RATE, BATCH, SEED, MISS = 400, 3.0, 32, 7, 0.002
LETTER = regex.compile(r"\p{L}")
#: Bytes of a text handled at once.
PIECE = 1 << 20


def subwords(data: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Buckets of the grams of the bytes (those that begin in the first ``starts``), one array; ASCII capitals count as small letters."""
    b = data.astype(np.uint32)
    b += ((b >= 65) & (b <= 90)).astype(np.uint32) * np.uint32(32)
    grams, found = b, []
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        grams = grams[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
        if n in ORDERS:
            mixed = (grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * n)
            found.append((mixed[:starts] >> np.uint32(17)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def encoded(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)


@dataclass
class Model:
    """logits: a row a bucket (temperature included); bias likewise."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        data, total, n = encoded(text), np.zeros(len(self.langs)), 0
        for at in range(0, len(data), PIECE):  # for bounded memory; pieces overlap, and each gram counts where it begins
            ids = subwords(data[at : at + PIECE + max(ORDERS) - 1], PIECE)
            total += np.bincount(ids, minlength=BUCKETS).astype(np.float32) @ self.logits if len(ids) > BUCKETS // 4 else self.logits[ids].sum(axis=0)
            n += len(ids)
        p = softmax(total / max(n, 1) + self.bias)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def snippet(text: str, rng: np.random.Generator) -> str:
    """A random stretch of 10 to 2000 characters, as short texts must be told apart too."""
    n = int(np.exp(rng.uniform(np.log(10), np.log(2000))))
    at = int(rng.integers(0, max(1, len(text) - n + 1)))
    return text[at : at + n]


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language), in an order that doesn't depend on partitions."""
    langs = sorted({y for _, y in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    rng = np.random.default_rng(SEED)
    ys = np.array([langs.index(y) for _, y in rows])
    order = rng.permutation(len(rows))
    few = len(rows) < 10 * len(langs)  # too few to set some aside: nothing is calibrated or rejected
    held, kept = (order[:0], order) if few else (order[: len(rows) // 10], order[len(rows) // 10 :])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    by_lang = [kept[ys[kept] == y] for y in range(len(langs))]
    by_lang = [x for x in by_lang if len(x)]
    for step in range(STEPS):
        rate = RATE * (1 - step / STEPS)
        batch = [int(rng.choice(by_lang[int(rng.integers(len(by_lang)))])) for _ in range(BATCH)]
        grams = [subwords(encoded(snippet(rows[i][0], rng))) for i in batch]
        n = np.array([max(1, len(g)) for g in grams])
        ids, row = np.concatenate(grams), np.repeat(np.arange(len(batch)), [len(g) for g in grams])
        used, ids = np.unique(ids, return_inverse=True)
        share = np.bincount(row * len(used) + ids, minlength=len(batch) * len(used)).reshape(len(batch), -1).astype(np.float32) / n[:, None].astype(np.float32)
        mean = share @ table[used]
        error = softmax(mean @ layer + bias)
        error[np.arange(len(batch)), ys[batch]] -= 1
        back = error @ layer.T
        layer -= rate / len(batch) * mean.T @ error
        bias -= rate / len(batch) * error.sum(axis=0)
        table[used] -= rate * share.T @ back
    model = Model(langs, table @ layer, bias, 0.0)
    if few:
        return model
    tests = [(snippet(rows[i][0], rng) if k else rows[i][0], ys[i]) for i in held for k in range(3)]
    raw = []
    for text, _ in tests:
        ids = subwords(encoded(text))
        raw.append(model.logits[ids].mean(axis=0) + bias if len(ids) else bias)
    raw, truth = np.array(raw), np.array([y for _, y in tests])
    loss = lambda t: -np.log(softmax(raw * t)[np.arange(len(truth)), truth] + 1e-12).mean()
    heat = min(np.geomspace(0.1, 10, 60), key=loss)
    scores = softmax(raw * heat)
    right = np.sort(scores.max(axis=1)[scores.argmax(axis=1) == truth])
    threshold = float(right[int(MISS * len(right))]) if len(right) else 0.0
    return Model(langs, (model.logits * heat).astype(np.float32), bias * heat, min(threshold, 0.9))


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, never learned from; a null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on a sample: the languages are counted first, then each gives its share by hash of the id."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("text") != "") & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages in the labels")
    share = max(LEAST, SAMPLE // max(1, len(counts)))
    dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000))
    #: a margin of four standard deviations, so that hashes give each language its share
    bar = F.create_map(*[x for c in counts for x in (F.lit(c["lang"]), F.lit(int(min(1.0, (share + 4 * share**0.5) / c["count"]) * 1_000_000_000) + 1))]) if counts else F.create_map().cast("map<string,int>")
    place = F.lit(1) + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    chosen = known.filter(dealt < bar[F.col("lang")]).select("lang", F.xxhash64("doc_id", "text").alias("key"), F.substring("text", place, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    rows = chosen.withColumn("rank", rank).filter(F.col("rank") <= share).collect()
    return train([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["key"], r["lang"], r["text"]))])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([bool(x != "und" and s >= model.threshold) for x, s in found])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: Model, *, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    """The ``carry`` columns, lang_pred, score (calibrated, 0 to 1) and accepted."""
    used = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("text"))
    schema = ", ".join(f"c{i} {used.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    out = used.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double, accepted boolean")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score", "accepted")


def _accepted(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (model.predict(t.as_py()) for t in batch.column(at))
            yield batch.filter(pa.array([x != "und" and score >= model.threshold for x, score in found], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that the language model rejects."""
    model = fit(docs, text=text, **options)
    return docs.mapInArrow(_accepted(model, docs.columns.index(text)), docs.schema)
