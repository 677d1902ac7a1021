"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of the whole text, weighted by TF-IDF; document
frequencies are counted over every row that may be learned from. The model is trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a sample of
bounded size, in one task, and its probabilities are calibrated by a temperature fitted on
sample rows that training left out. Only the sparse weights and the frequency table, both
bounded by the number of buckets times languages, go through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that the classifier is fitted on, at most, dealt evenly to the languages.
SAMPLE_ROWS = 4000
#: More languages than this are refused: the model's dense rows take 4 bytes a bucket and language.
MAX_LANGUAGES = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
#: One in so many sample rows is kept for the temperature.
CALIBRATE = 5
SEED = 7
#: Code points whose n-grams are counted at once.
CHUNK = 1 << 20
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the text's n-grams, letters in lower case and all else as a space; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letter_table()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    longest = max(ORDERS)
    for a in range(0, len(codes), CHUNK):
        part = codes[a : a + CHUNK + longest - 1]
        for n in ORDERS:
            m = min(len(part) - n + 1, CHUNK)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + m]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = counts.nonzero()[0]
    return at.astype(np.int32), counts[at]


def weighted(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    """TF-IDF of features, sublinear in the counts, of length 1."""
    at, counts = found
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


# ---------------------------------------------------------------- corpus statistics

_COUNTS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("n", T.LongType())]
)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, langs = np.zeros(BUCKETS, np.int64), {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            if (found := features(text.as_py())) is not None:
                seen[found[0]] += 1
                langs[lang] = langs.get(lang, 0) + 1
    at = seen.nonzero()[0]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([*at.tolist(), *[None] * len(langs)], pa.int32()),
            pa.array([*[None] * len(at), *langs], pa.string()),
            pa.array([*seen[at].tolist(), *langs.values()], pa.int64()),
        ],
        _COUNTS.names,
    )


# ---------------------------------------------------------------- training


class Ftrl:
    """FTRL-proximal for multinomial logistic regression; weights are sparse through the L1 term."""

    def __init__(self, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = x[:, None] * (softmax(x @ w) - (np.arange(w.shape[1]) == label))
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


_WEIGHTS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("class", T.IntegerType()), T.StructField("value", T.DoubleType())]
)


def _train(batches: Iterator[pa.RecordBatch], langs: list[str], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nonzero weights of a bounded sample; the temperature is the row of bucket -1."""
    place = {name: i for i, name in enumerate(langs)}
    rows = []
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (found := features(text)) is not None:
                rows.append((zlib.crc32(text.encode("utf-8", "surrogatepass")), place[lang], found[0], weighted(found, idf)))
    rows.sort(key=lambda r: (r[0], r[1]))
    order = np.random.default_rng(SEED).permutation(len(rows))
    kept = [i for k, i in enumerate(order) if k % CALIBRATE == 0] if len(rows) >= 10 * CALIBRATE else []
    used = [i for k, i in enumerate(order) if k % CALIBRATE] if kept else list(order)
    model = Ftrl(len(langs))
    for _ in range(EPOCHS):
        for i in used:
            model.learn(rows[i][2], rows[i][3], rows[i][1])
    w = model.weights()
    logits = np.array([rows[i][3] @ w[rows[i][2]] for i in kept]).reshape(len(kept), len(langs))
    t = temperature(logits, np.array([rows[i][1] for i in kept], int))
    at, c = w.nonzero()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(at, -1).astype(np.int32)),
            pa.array(np.append(c, 0).astype(np.int32)),
            pa.array(np.append(w[at, c], t)),
        ],
        _WEIGHTS.names,
    )


class Model:
    """Languages, inverse document frequencies, weights and temperature.

    Of the weights only the rows of buckets with any are held (`row_of`: a bucket's row, the
    last one, of zeros, for all others), so its size is bounded by the weights that L1 left.
    """

    def __init__(self, langs: list[str], idf: np.ndarray, at: np.ndarray, classes: np.ndarray, values: np.ndarray, temperature: float):
        self.langs, self.idf, self.temperature = langs, idf, temperature
        used = np.unique(at)
        self.row_of = np.full(BUCKETS, len(used), np.int32)
        self.row_of[used] = np.arange(len(used), dtype=np.int32)
        self.weights = np.zeros((len(used) + 1, len(langs)))
        self.weights[self.row_of[at], classes] = values

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.langs:
            return UNDETERMINED, 0.0
        p = softmax(weighted(found, self.idf) @ self.weights[self.row_of[found[0]]] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from text and lang of the rows that aren't held out and have a text, a lang and a doc_id."""
    spark = docs.sparkSession
    shared.ship(spark)
    known = shared.pick(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    # At most BUCKETS rows and a row per language.
    counted = known.select("text", "lang").mapInArrow(_count, _COUNTS).groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
    table = counted.limit(BUCKETS + MAX_LANGUAGES + 1).toArrow()
    bucket, lang, n = (table[c].to_pylist() for c in ("bucket", "lang", "n"))
    sizes = {name: k for b, name, k in zip(bucket, lang, n) if b is None}
    if len(sizes) > MAX_LANGUAGES or table.num_rows > BUCKETS + MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs, total = sorted(sizes), sum(sizes.values())
    seen = np.zeros(BUCKETS)
    for b, k in zip(bucket, n):
        if b is not None:
            seen[b] = k
    idf = np.log((1 + total) / (1 + seen)) + 1
    if not langs:
        none = np.empty(0, int)
        return Model([], idf, none, none, none, 1.0)
    sample = draw(known, sizes, sample_rows)
    rows = sample.repartition(1).mapInArrow(partial(_train, langs=langs, idf=idf), _WEIGHTS).toArrow()
    at, c, value = (rows[x].to_numpy() for x in ("bucket", "class", "value"))
    return Model(langs, idf, at[at >= 0], c[at >= 0], value[at >= 0], float(value[at < 0][0]))


def draw(known: DataFrame, sizes: dict[str, int], sample_rows: int) -> DataFrame:
    """text and lang of at most sample_rows rows of known (doc_id, text, lang), evenly by language of `sizes` rows.

    The order is a hash of doc_id and text. Rows that share it are equal rows and count
    once, folded before the shuffle, so that no repeated row makes the sample larger.
    """
    each = max(1, sample_rows // len(sizes))
    # Somewhat more than the language's share is drawn, then cut to it.
    share = [F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 1.5 * each / n))]
    order = F.xxhash64("doc_id", "text", F.lit(SEED))
    unit = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    drawn = known.withColumn("_order", order).where(unit < F.create_map(*share)[F.col("lang")])
    once = drawn.groupBy("lang", "_order").agg(F.min("text").alias("text"))
    within = Window.partitionBy("lang").orderBy("_order")
    return once.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= each).select("text", "lang")


_PREDICTED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [model.value.predict(t.as_py()) for t in batch.column(1)]
        names, scores = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], _PREDICTED.names)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, from the whole text alone.

    Texts that are null or have no letter are `und` with score 0, as are all if the model
    has no language. Null doc_ids and repeated rows keep their rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    rows = shared.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_predict, model=spark.sparkContext.broadcast(model)), _PREDICTED)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, by a model fitted on docs' own labelled rows."""
    found = predict(docs, fit(docs, sample_rows))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _accept(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for text in batch.column(0):
            name, score = model.value.predict(text.as_py())
            keep.append(name != UNDETERMINED and score >= least)
        yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(keep, pa.bool_()))


def accepted(docs: DataFrame, least_score: float, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, whole, whose language is determined with at least least_score."""
    spark = docs.sparkSession
    model = fit(docs, sample_rows)
    flat = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = F.col(f"_c{docs.columns.index('text')}").alias("_text")
    f = partial(_accept, model=spark.sparkContext.broadcast(model), least=least_score)
    return flat.select(text, *flat.columns).mapInArrow(f, flat.schema).toDF(*docs.columns)
