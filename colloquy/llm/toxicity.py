"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is itself and its character n-grams of 3 to 5 characters, borders marked, each hashed into
one of ``2 ** BITS`` places; a place has an embedding.  A document is the average of the
embeddings of all its subwords, each as often as it comes, and a linear softmax over that average
gives the classes.  Embeddings and softmax are trained jointly, by stochastic gradients with
per-entry rates (Adagrad), in numpy.  A misspelt word that was never seen shares most n-grams
with its model, so its average lies close to it.  Embeddings start at zero and only subwords of
``min_docs`` sample documents are trained, so a subword never seen adds nothing.

The fit reads at most ``sample_rows`` labelled documents of each class (4,000 by default), those
with the smallest hash of the id, and of these, in the order of another hash, as many whole
documents as ``sample_entries`` (document, place) pairs hold.  Both bounds hold the one task that
trains to a fixed size.  Classes are sampled alike, so the softmax's bias is moved by how the
labels of the whole table stand to those of the sample.

The average is linear, so a trained model is one number per place: the difference of the two
classes' scores.  That table of fixed size goes to the tasks, which score every whole text.

Defined cases: a null or empty text, or one without letters or digits, has no subword and gets
the score of the bias alone; a very long text or word is worked on in blocks of words; labels
that are null, or that have no document, take no part; several labels of one document count as
their largest; without labels of both classes every score is the share of label 1 (one half if
there are none).  Repeated rows get equal scores; all columns of the input pass through in a
struct, so their names cannot clash; an empty table gives no rows.
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
PLACES = 1 << BITS
GRAMS = (3, 4, 5)
SIZE = 8
SAMPLE_ROWS = 4_000
SAMPLE_ENTRIES = 16_000_000
EPOCHS = 8
BATCH = 64
RATE = 10.0
MIN_DOCS = 5
THRESHOLD = 0.5
WORD_BLOCK = 1 << 16
FEATURES = "toxic int, tie long, places array<int>, counts array<float>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of the subwords of each word: n-grams with borders, and the word as a whole."""
    marked = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters up to the word's end
    owners, hashes = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for k in range(max(GRAMS)):
        shifted = codes[k:]
        rolling = mixed(rolling[: len(shifted)] * np.uint64(0x100000001B3) + shifted + np.uint64(1))
        if k + 1 in GRAMS:
            whole = left[: len(rolling)] >= k + 1
            owners.append(word[: len(rolling)][whole])
            hashes.append(rolling[whole])
    owners.append(np.arange(len(words)))
    hashes.append(mixed(pd.util.hash_array(np.array(words, object), categorize=False)))
    place = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(owners), place


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, word code) of each word, and the distinct words: letters and digits in lower case."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")
    split = pc.split_pattern(pc.utf8_trim_whitespace(plain), " ")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes] if len(words) else np.empty(0, bool)
    return doc[full], codes[full], words


def word_blocks(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first word, word, place, number of words) for blocks of the distinct words."""
    for lo, hi in batches_by_bytes(words, WORD_BLOCK * 8):
        some = words.slice(lo, hi - lo).to_pylist()
        word, place = subwords(some)
        yield lo, word, place, hi - lo


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, count), sorted by document, then place."""
    doc, code, words = words_of(texts)
    pairs, times = np.unique(doc * max(1, len(words)) + code, return_counts=True)
    pair_doc, pair_code = np.divmod(pairs, max(1, len(words)))
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo, word, place, n in word_blocks(words):
        order = np.argsort(word, kind="stable")
        place, starts = place[order], np.searchsorted(word[order], np.arange(n + 1))
        mine = (pair_code >= lo) & (pair_code < lo + n)
        local = pair_code[mine] - lo
        size = starts[local + 1] - starts[local]
        at = np.repeat(starts[local] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        key, back = np.unique(np.repeat(pair_doc[mine], size) * PLACES + place[at], return_inverse=True)
        keys.append(key)
        counts.append(np.bincount(back, np.repeat(times[mine], size), len(key)).astype(np.int64))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), len(key))
    return key >> BITS, key & (PLACES - 1), count


def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = pc.fill_null(batch.column("text"), "")
        for lo, hi in batches_by_bytes(whole):
            doc, place, count = bags(whole.slice(lo, hi - lo))
            offsets = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(count, pa.float32())),
            ]
            own = [batch.column(c).slice(lo, hi - lo) for c in ("toxic", "tie")]
            yield pa.record_batch([*own, *lists], names=["toxic", "tie", "places", "counts"])


@dataclass(frozen=True)
class Bags:
    """Documents as shares of their subwords, row by row."""

    start: np.ndarray
    place: np.ndarray
    share: np.ndarray
    label: np.ndarray

    def rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row among the chosen, place, share)."""
        size = self.start[chosen + 1] - self.start[chosen]
        row = np.repeat(np.arange(len(chosen)), size)
        at = np.repeat(self.start[chosen] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return row, self.place[at], self.share[at]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    bag: Bags, size: int = SIZE, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0, min_docs: int = MIN_DOCS
) -> tuple[np.ndarray, float]:
    """The difference of the classes' scores for each place, and of their biases.

    Rare subwords stay at zero, so that they cannot spell out single documents.
    """
    known = np.flatnonzero(np.bincount(bag.place, minlength=PLACES) >= min_docs)
    index = np.full(PLACES, len(known))  # the last row takes what is not trained
    index[known] = np.arange(len(known))
    draw = np.random.default_rng(seed)
    embed, seen_e = np.zeros((size, len(known) + 1)), np.full((size, len(known) + 1), 1e-10)
    weights, bias = draw.uniform(-1, 1, (size, 2)), np.zeros(2)
    seen_w, seen_b = np.full((size, 2), 1e-10), np.full(2, 1e-10)
    n = len(bag.label)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = draw.permutation(n)
        for lo in range(0, n, BATCH):
            chosen = order[lo : lo + BATCH]
            row, place, share = bag.rows(chosen)
            place = index[place]
            mean = np.stack([np.bincount(row, e[place] * share, len(chosen)) for e in embed], axis=1)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(chosen)), bag.label[chosen]] -= 1
            error /= len(chosen)
            back = (error @ weights.T).T
            grad_w, grad_b = mean.T @ error, error.sum(axis=0)
            for e, seen, g in zip(embed, seen_e, back, strict=True):
                grad = np.bincount(place, g[row] * share, len(e))
                grad[-1] = 0.0
                seen += grad * grad
                e -= step * grad / np.sqrt(seen)
            seen_w += grad_w**2
            weights -= 0.1 * step * grad_w / np.sqrt(seen_w)
            seen_b += grad_b**2
            bias -= 0.1 * step * grad_b / np.sqrt(seen_b)
    score = np.zeros(PLACES)
    score[known] = (weights[:, 1] - weights[:, 0]) @ embed[:, :-1]
    return score, float(bias[1] - bias[0])


def trainer(entries: int, **settings) -> Callable:
    """Reads rows until the bound, then trains once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, places, shares, labels, held = [], [], [], [], 0
        for batch in batches:
            if held >= entries:
                continue
            for i in range(batch.num_rows):
                place = batch.column("places")[i].values.to_numpy()
                count = batch.column("counts")[i].values.to_numpy()
                if held and held + len(place) > entries:
                    held = entries
                    break
                held += len(place)
                sizes.append(len(place))
                places.append(place)
                shares.append(count / max(1.0, float(count.sum())))
                labels.append(batch.column("toxic")[i].as_py())
        if not labels:
            return
        label = np.array(labels)
        bag = Bags(np.append(0, np.cumsum(sizes)), np.concatenate(places), np.concatenate(shares), label)
        score, bias = train(bag, **settings)
        counts = [int((label == k).sum()) for k in (0, 1)]
        yield pa.record_batch(
            [pa.array([score.astype("<f8").tobytes()], pa.binary()), pa.array([bias]), *(pa.array([c]) for c in counts)],
            names=["score", "bias", "zeros", "ones"],
        )

    return run


@dataclass(frozen=True)
class Model:
    place: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, code, words = words_of(texts)
        total, size = np.zeros(len(words)), np.zeros(len(words))
        for lo, word, place, n in word_blocks(words):
            total[lo : lo + n] = np.bincount(word, self.place[place], n)
            size[lo : lo + n] = np.bincount(word, minlength=n)
        top, below = (np.bincount(doc, x[code], len(texts)) for x in (total, size))
        return 1 / (1 + np.exp(-np.clip(top / np.maximum(below, 1) + self.bias, -60, 60)))


def log_odds(ones: int, zeros: int) -> float:
    return float(np.log(max(ones, 1e-6) / max(zeros, 1e-6)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_entries: int = SAMPLE_ENTRIES, **settings) -> Model:
    """``labels`` has doc_id and toxic (0 or 1); only documents that have one are read."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = stored(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    # ids that some document has; how many there are of each class
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    here = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    number = {r["toxic"]: r["count"] for r in here.groupBy("toxic").count().collect()}
    if not all(number.get(k) for k in (0, 1)):
        return Model(np.zeros(PLACES), log_odds(number.get(1, 0), number.get(0, 0)) if number else 0.0)
    hashed = here.withColumn("tie", F.xxhash64("doc_id"))
    first = [hashed.where(F.col("toxic") == k).orderBy("tie", "doc_id").limit(sample_rows) for k in (0, 1)]
    # at most twice sample_rows rows of three numbers
    chosen = F.broadcast(first[0].unionAll(first[1]))
    rows = texts.join(chosen, "doc_id").select("toxic", F.xxhash64("doc_id", F.lit(1)).alias("tie"), "text")
    rows = stored(rows.mapInArrow(to_features, FEATURES), "features")
    # the sample is bounded, and so is the task that trains on it; the order makes runs agree
    one = rows.repartition(1).sortWithinPartitions("tie", "toxic", F.size("places"), F.xxhash64("places", "counts"))
    found = one.mapInArrow(trainer(sample_entries, **settings), "score binary, bias double, zeros long, ones long").first()
    shift = log_odds(number[1], number[0]) - log_odds(max(1, found["ones"]), max(1, found["zeros"]))
    return Model(np.frombuffer(found["score"], "<f8"), found["bias"] + shift)


def score_writer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = pc.fill_null(rows.field("text"), "")
            for lo, hi in batches_by_bytes(texts):
                score = model.scores(texts.slice(lo, hi - lo))
                yield pa.record_batch([rows.slice(lo, hi - lo), pa.array(score)], names=["row", "score"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, whatever its columns are, and its score."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(score_writer(model), StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return score_documents(docs, fit(docs, labels)).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
