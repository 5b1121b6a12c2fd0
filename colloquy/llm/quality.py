"""Quality scores by a linear model on naive Bayes features (NB-SVM).

A document's features are indicators of its n-grams, hashed into ``2 ** BITS`` places: words
and pairs of words in lower case, and runs of one to three word shapes.  A shape says how a
word is built (capitals, small letters, digits, the signs on it) and whether it repeats the
word before, so that junk shows in words never seen.  Each indicator is scaled by the log ratio
of its smoothed shares in the two classes, the document's vector is brought to length one, and
a hinge-loss model is fitted by dual coordinate descent: one document's dual weight at a time is
moved to its optimum within [0, C].  A sigmoid over the margin, fitted on documents that the
model has not seen, gives the score.

The fit uses at most ``sample_rows`` labelled documents (20,000 by default), those with the
smallest hash of the id.  They are dealt into ``shards``; each shard is fitted by itself and the
weights are averaged, except that the first shard serves to fit the sigmoid.  Class counts are
summed by Spark.  The driver sees one number pair per feature place, one weight vector per
shard, and the margins of the first shard, all of fixed size.  Scoring reads every whole text
of every document.

Defined cases: a null or empty text has no n-gram and gets the score of the bias alone; labels
that are null, or that have no document, take no part; several labels of one document count as
their largest; without labels of both classes every score is the share of label 1 (one half if
there are none).  Repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from colloquy.llm.common import batches_by_bytes, query, stored, table

BITS = 18
PLACES = 1 << BITS  # the bias has the place after the last
SAMPLE_ROWS = 20_000
SHARDS = 8
COST = 1.0
ROUNDS = 10
THRESHOLD = 0.3


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shapes(words: pa.Array) -> pa.Array:
    for pattern, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0")):
        words = pc.replace_substring_regex(words, pattern, sign)
    return pc.replace_substring_regex(words, r"([^aA0]{3})[^aA0]+", r"\1")


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) pairs of the distinct n-grams, sorted by document, then place."""
    split = pc.utf8_split_whitespace(texts)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes]
    doc, codes = doc[full], codes[full]
    word = pd.util.hash_array(pc.utf8_lower(words).to_numpy(zero_copy_only=False), categorize=False)[codes]
    shape = pd.util.hash_array(shapes(words).to_numpy(zero_copy_only=False), categorize=False)[codes]
    same = doc[1:] == doc[:-1]
    again = np.zeros(len(codes), np.uint64)
    again[1:] = same & (codes[1:] == codes[:-1])
    shape = mixed(shape + again)
    pair = (word[:-1] * np.uint64(3) + word[1:])[same]
    kinds = [(doc, word), (doc[1:][same], pair), (doc, shape), (doc[1:][same], (shape[:-1] * np.uint64(5) + shape[1:])[same])]
    triple = same[1:] & same[:-1]
    kinds.append((doc[2:][triple], (shape[:-2] * np.uint64(7) + shape[1:-1] * np.uint64(5) + shape[2:])[triple]))
    keys = [d * PLACES + (mixed(h + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64) for kind, (d, h) in enumerate(kinds)]
    found = np.unique(np.concatenate(keys))
    return found >> BITS, found & (PLACES - 1)


def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = pc.fill_null(batch.column("text"), "")
        for lo, hi in batches_by_bytes(whole):
            doc, place = ngrams(whole.slice(lo, hi - lo))
            offsets = np.searchsorted(doc, np.arange(hi - lo + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place, pa.int32()))
            own = [batch.column(c).slice(lo, hi - lo) for c in ("shard", "quality", "tie")]
            yield pa.record_batch([*own, lists], names=["shard", "quality", "tie", "places"])


def to_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, PLACES), np.int64)
    for batch in batches:
        label = batch.column("quality").to_numpy(zero_copy_only=False)
        place, row = batch.column("places").flatten().to_numpy(), pc.list_parent_indices(batch.column("places")).to_numpy()
        for k in (0, 1):
            counts[k] += np.bincount(place[label[row] == k], minlength=PLACES)
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["place", "zero", "one"])


def unit_row(place: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's places with the bias, and its scaled values of length one."""
    place = np.append(place, PLACES)
    value = ratio[place]
    return place, value / np.sqrt(value @ value)


def coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float, rounds: int, seed: int) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; rows have length one."""
    weights, dual = np.zeros(PLACES + 1), np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            place, value = rows[i]
            slope = sign[i] * (weights[place] @ value) - 1
            new = min(max(dual[i] - slope, 0.0), cost)
            if new != dual[i]:
                weights[place] += (new - dual[i]) * sign[i] * value
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights


def fitter(ratio: np.ndarray, cost: float, rounds: int) -> Callable:
    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        # an order that rows bring with them, so that a fit does not depend on how they arrive
        shard["bytes"] = [p.tobytes() for p in shard["places"]]
        shard = shard.sort_values(["quality", "tie", "bytes"])
        rows = [unit_row(p, ratio) for p in shard["places"]]
        sign = 2.0 * shard["quality"].to_numpy() - 1
        weights = coordinate_descent(rows, sign, cost, rounds, seed=int(key[0]))
        return pd.DataFrame({"shard": [key[0]], "weights": [weights.astype("<f8").tobytes()]})

    return run


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))

    def margins(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Margins of n documents from their sorted (document, place) pairs."""
        ratio = self.ratio[place]
        top = np.bincount(doc, self.weights[place] * ratio, n) + self.weights[PLACES] * self.ratio[PLACES]
        return top / np.sqrt(np.bincount(doc, ratio * ratio, n) + self.ratio[PLACES] ** 2)


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid over the margins, by Newton steps, with smoothed targets."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.ones(PLACES + 1), np.zeros(PLACES + 1), 0.0, float(np.log(share / (1 - share))))


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, cost: float = COST, rounds: int = ROUNDS
) -> Model:
    """``labels`` has doc_id and quality (0 or 1); only documents that have one are read."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int"))
        .withColumn("tie", F.xxhash64("doc_id", F.lit(2)))
    )
    # at most sample_rows rows of four numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("shard", "quality", "tie", "text")
    rows = stored(texts.mapInArrow(to_features, "shard int, quality int, tie long, places array<int>"), "features")
    size = {(r["shard"] > 0, r["quality"]): r["n"] for r in rows.groupBy("shard", "quality").agg(F.count("*").alias("n")).groupBy((F.col("shard") > 0).alias("shard"), "quality").agg(F.sum("n").alias("n")).collect()}
    if not all(size.get((True, k)) for k in (0, 1)):
        one, zero = (sum(n for (_, q), n in size.items() if q == k) for k in (1, 0))
        return constant(one / (one + zero) if one + zero else 0.5)
    fitted = rows.where("shard > 0")
    sums = fitted.mapInArrow(to_counts, "place long, zero long, one long").groupBy("place").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toPandas()
    counts = np.ones((2, PLACES))
    counts[:, sums["place"]] += sums[["zero", "one"]].to_numpy().T
    shares = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.append(np.log(shares[1] / shares[0]), 1.0)
    parts = fitted.groupBy("shard").applyInPandas(fitter(ratio, cost, rounds), "shard int, weights binary").collect()
    weights = np.mean([np.frombuffer(p["weights"], "<f8") for p in sorted(parts, key=lambda p: p["shard"])], axis=0)
    raw = Model(ratio, weights, 1.0, 0.0)
    # the margins of one shard: at most about sample_rows / shards numbers
    unseen = rows.where("shard = 0").mapInArrow(margin_writer(raw), "quality int, margin double").toPandas().sort_values(["quality", "margin"])
    if unseen["quality"].nunique() < 2:
        return raw
    return Model(ratio, weights, *sigmoid_fit(unseen["margin"].to_numpy(), unseen["quality"].to_numpy()))


def margin_writer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            margin = model.margins(pc.list_parent_indices(places).to_numpy(), places.flatten().to_numpy(), len(places))
            yield pa.record_batch([batch.column("quality"), pa.array(margin)], names=["quality", "margin"])

    return run


def score_writer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = pc.fill_null(rows.field("text"), "")
            for lo, hi in batches_by_bytes(texts):
                some = texts.slice(lo, hi - lo)
                score = model.score(model.margins(*ngrams(some), len(some)))
                yield pa.record_batch([rows.slice(lo, hi - lo), pa.array(score)], names=["row", "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, whatever its columns are, and its score."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(score_writer(model), StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
