"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training rows. The classifier is trained by follow-the-regularised-leader with elastic-net
penalties on a sample of bounded size, in rounds: every partition of the sample continues from the common state, and the
states are averaged. A temperature, fitted on a further slice of the sample, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tablevault.llm.common import settle, small_batches, unused, without

#: Hash buckets of n-grams (2^16), and lengths of n-grams in characters.
BITS, LENGTHS = 16, (1, 2, 3)
#: Labelled rows of a language that the classifier is fitted on, about; a fifth of as many calibrate it.
SAMPLE = 600
#: Parts of the sample that train side by side, and rounds over it.
PARTS, ROUNDS = 8, 3
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"


def hashed_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, text after text, and how many each text has."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in (t or "" for t in texts)]
    sizes = np.fromiter(map(len, points), np.int64, len(points))
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # characters from here to the end of the text
    code, parts, kept = np.zeros(len(flat), np.uint32), [], []
    for n in range(1, max(LENGTHS) + 1):
        ahead = np.zeros(len(flat), np.uint32)
        ahead[: len(flat) - n + 1] = flat[n - 1 :]
        code = code * np.uint32(0x01000193) + ahead + np.uint32(n)
        if n in LENGTHS:
            parts.append(((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16 if BITS <= 16 else np.uint32))
            kept.append(left >= n)
    # Interleaved by position, so that each text's n-grams lie together.
    grams, ok = np.stack(parts, 1), np.stack(kept, 1)
    counts = sum(np.maximum(sizes - n + 1, 0) for n in LENGTHS)
    return grams[ok], counts


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs; and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, flags = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for batch in small_batches(batches, "text", 1 << 20):
            grams, counts = hashed_ngrams(batch.column("text").to_pylist())
            rows += batch.num_rows
            for part in np.split(grams, np.cumsum(counts)[:-1]):
                flags[:] = False
                flags[part] = True
                total += flags
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int32()), pa.array([*total[used], rows], pa.int64())], ["bucket", "n"])

    # As many rows as there are buckets, whatever the size of the table.
    found = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS, np.int64)
    inside = found[found.bucket >= 0]
    df[inside.bucket.to_numpy()] = inside.n.to_numpy()
    return df, int(found[found.bucket < 0].n.sum())


def _features(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """Sparse TF-IDF of each row: buckets and weights of length 1 in all."""

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            grams, counts = hashed_ngrams(batch.column("text").to_pylist())
            out = []
            for part in np.split(grams, np.cumsum(counts)[:-1]):
                bucket, times = np.unique(part, return_counts=True)
                weight = times * idf[bucket]
                out.append((bucket.astype("<u4").tobytes(), (weight / max(np.sqrt((weight**2).sum()), 1e-12)).astype("<f4").tobytes()))
            columns = [batch.column("label"), batch.column("slice"), batch.column("order"), *(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "slice", "order", "buckets", "weights"])

    return sample.mapInArrow(vectorise, "label int, slice int, order long, buckets binary, weights binary")


class Ftrl:
    """State of the learner: z and n for each bucket and class; the weights follow from them."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, bucket: np.ndarray, weight: np.ndarray, label: int) -> None:
        w = self.weights(bucket)
        p = softmax(weight @ w)
        p[label] -= 1
        g = weight[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[bucket] + g * g) - np.sqrt(self.n[bucket])) / ALPHA
        self.z[bucket] += g - sigma * w
        self.n[bucket] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _epoch_from(state: Broadcast):
    """One pass over a part of the sample from a common state; gives the state of the buckets that were ever used."""

    def epoch(frame: pd.DataFrame) -> pd.DataFrame:
        learner = Ftrl(*(a.astype(np.float64) for a in state.value))
        for row in frame.sort_values("order").itertuples():
            learner.learn(np.frombuffer(row.buckets, "<u4"), np.frombuffer(row.weights, "<f4").astype(float), row.label)
        used = np.flatnonzero(learner.n.any(1)).astype(np.int32)
        z, n = (a[used].astype("<f4").tobytes() for a in (learner.z, learner.n))
        return pd.DataFrame({"used": [used.tobytes()], "z": [z], "n": [n]})

    return epoch


def _train(features: DataFrame, classes: int) -> np.ndarray:
    spark = features.sparkSession
    shape = (1 << BITS, classes)
    z, n = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))  # buckets times languages, fixed by the parameters

        states = features.where("slice >= 0").groupBy("slice").applyInPandas(_epoch_from(state), "used binary, z binary, n binary").collect()
        if not states:
            break
        z, n, times = np.zeros(shape, np.float32), np.zeros(shape, np.float32), np.zeros(shape[0], np.float32)
        for s in sorted(states, key=lambda s: (bytes(s.used), bytes(s.z))):
            used = np.frombuffer(s.used, np.int32)
            z[used] += np.frombuffer(s.z, "<f4").reshape(-1, classes)
            n[used] += np.frombuffer(s.n, "<f4").reshape(-1, classes)
            times[used] += 1
        z, n = z / np.maximum(times, 1)[:, None], n / np.maximum(times, 1)[:, None]
        state.unpersist()
    return Ftrl(z, n).weights().astype(np.float32)


def _temperature(features: DataFrame, weights: np.ndarray) -> float:
    """The temperature of the least log loss over the calibration slice, from a grid of factors 1.1."""
    grid = 1.1 ** np.arange(-40, 25)
    shared = features.sparkSession.sparkContext.broadcast(weights)

    def losses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x = np.frombuffer(row.weights, "<f4") @ shared.value[np.frombuffer(row.buckets, "<u4")]
                p = [softmax(x / t)[row.label] for t in grid]
                yield pd.DataFrame({"i": np.arange(len(grid)), "loss": -np.log(np.maximum(p, 1e-12))})

    found = features.where("slice < 0").mapInPandas(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    return float(grid[min(found, key=lambda r: (r["loss"], r["i"]))["i"]]) if found else 1.0


def fit(train: DataFrame, sample: int = SAMPLE) -> dict:
    """Learn from (doc_id, text, lang). Rows without text or lang take no part; without any, only ``und`` can be predicted.

    Of each language about ``sample`` texts are fitted, chosen by a hash of id and text, one at least; frequencies are those of all rows,
    repeated ones each time. Equal texts of a language are fitted once. An empty table gives the model without languages.
    """
    known = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "weights": np.zeros((1 << BITS, 0), np.float32), "idf": np.zeros(1 << BITS, np.float32), "temperature": 1.0}
    df, rows = _frequencies(known)
    idf = np.log((1 + rows) / (1 + df)).astype(np.float32) + 1
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000_007)) / 1_000_000_007
    rate = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(1.2 * sample / sizes[name]))])[F.col("lang")]
    number = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])[F.col("lang")]
    order = F.xxhash64("doc_id", "text")
    calibrates = (F.pmod(order, F.lit(6)) == 0) & ~F.col("least")
    # equal texts count once, so that copies do not break the bound; the least of each language is there even if nothing else is drawn
    least = known.groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), F.struct(order, F.col("doc_id"), F.col("text"))).alias("least"))
    drawn = known.where(place < rate).select("lang", "doc_id", "text", F.lit(False).alias("least"))
    drawn = drawn.unionByName(least.select("lang", "least.*", F.lit(True).alias("least")))
    drawn = drawn.groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id"), F.max("least").alias("least"))
    drawn = drawn.select("text", number.alias("label"), F.when(calibrates, -1).otherwise(F.pmod(order, F.lit(PARTS)).cast("int")).cast("int").alias("slice"), order.alias("order"))
    features = settle(_features(drawn, idf), "features")
    weights = _train(features, len(langs))
    return {"langs": langs, "weights": weights, "idf": idf, "temperature": _temperature(features, weights)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Add lang_pred and score (calibrated probability) from whole texts; ``und`` with score 0 for a null text or one without letters.

    Nothing but ``text`` is read. Columns named like an added one are replaced; other columns stay; ties go to the first language
    by name. Repeated rows are predicted each, an empty table gives an empty one.
    """
    docs = without(docs, ["lang_pred", "score"])
    (lettered,) = unused(docs, "_letters")
    langs, spark = model["langs"], docs.sparkSession
    shared = spark.sparkContext.broadcast((model["weights"] * model["idf"][:, None], model["idf"]))  # fixed by the parameters
    temperature = model["temperature"]
    kept = [f for f in docs.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, idf = shared.value
        times = np.zeros(1 << BITS, np.int32)
        for batch in small_batches(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            letters = np.array(batch.column(lettered).to_pylist(), bool)
            grams, counts = hashed_ngrams(texts)
            scores = np.zeros((len(texts), max(1, len(langs))))
            for i, part in enumerate(np.split(grams, np.cumsum(counts)[:-1])):
                if letters[i] and langs:
                    if len(part) < 20_000:
                        bucket, found = np.unique(part, return_counts=True)
                    else:
                        times = np.bincount(part, minlength=1 << BITS)
                        bucket = np.flatnonzero(times)
                        found = times[bucket]
                    norm = np.sqrt(((found * idf[bucket]) ** 2).sum())
                    scores[i] = found @ table[bucket] / max(norm, 1e-12) / temperature
            p = softmax(scores)
            best = p.argmax(1)
            sure = letters & bool(langs)
            names = [langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
            columns = [batch.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(np.where(sure, p.max(1), 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "lang_pred", "score"])

    return docs.withColumn(lettered, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(tag, schema)
