"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's chance to offend is logistic in
the telling features it holds; a document's is the noisy-or of its sentences and
of a small leak, 1 - (1 - leak) * prod(1 - p).  Only document labels are needed:
the gradient of the document's likelihood reaches the sentences, and the trained
sentence scores locate what offends.  A sentence without a telling feature has
chance 0, so that long documents do not gather chance by length.

Features are lower-cased words and their first 3 to 8 bytes.  Telling are those
that offending documents hold much more often (log-likelihood ratio), found on a
sample of at most `sample_rows` labelled documents, on which the weights are
fitted too.  The sample's texts are written once; a document of it sends the
driver one row per distinct set of telling features, with the number of its
sentences that hold this set, which is all that the noisy-or needs.

Defined results: ids are whole numbers, others stop the job; a null or empty text has the leak as its score; a very long text
is scored whole, as a piece of its own; labels that are null do not count, of
repeated ones the highest does; rows with one id are scored one by one, and learnt
from as one bag of all their sentences; without any offending sample every score
is the leak; null ids are never held out nor labelled; every row is scored; an
empty table gives no rows; other columns, whatever their names, are not read, and
pass through `without_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamframe.llm import kernels as K
from loamframe.storage import Scratch

#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Telling features, at most, and the least log-likelihood ratio and rate ratio of one.
VOCABULARY, LEAST_RATIO, LEAST_LIFT = 4096, 30.0, 3.0
PREFIXES = range(3, 9)
#: Bytes of texts whose features are counted together.
COUNTED_BYTES = 1 << 20
#: A sentence with at least this chance offends.
OFFENDS = 0.3

_IS_TERM = np.isin(np.arange(256), list(b".!?\n"))
_IS_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789'")) | (np.arange(256) >= 128)
_U = np.uint64


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with weights, the bias of a sentence and the leak of a document."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, feature hashes), one kind of feature after another."""
    yield np.arange(len(starts)), K.span_hashes(buf, starts, ends)
    lens = ends - starts
    h = np.zeros(len(starts), dtype=np.uint64)
    alive = np.arange(len(starts))
    for k in range(PREFIXES.stop - 1):
        alive = alive[lens[alive] > k]
        h[alive] = (h[alive] + K.BYTE_CODES[buf[starts[alive] + k]]) * _U(0x9E3779B97F4A7C15)
        if k + 1 in PREFIXES:
            longer = alive[lens[alive] > k + 1]
            yield longer, K.mix(h[longer] ^ _U(k + 1))


def words_and_sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word bounds and rows, and a number per word that changes with the sentence and the row."""
    starts, ends, rows = K.word_bounds(buf, offs, _IS_LETTER[buf])
    before = np.cumsum(_IS_TERM[buf])
    return starts, ends, rows, (before[starts] if len(starts) else starts) + rows


def sampled(docs: DataFrame, ids: np.ndarray, scratch: Scratch) -> DataFrame:
    """doc (the place in the sorted, bounded array ids) and text of the documents that ids holds, as a table."""
    shared = scratch.broadcast(ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(shared.value, own), len(shared.value) - 1)
            rows = np.flatnonzero(shared.value[at] == own)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(at[rows]), batch.column(1).take(pa.array(rows))], names=["doc", "text"])

    return scratch.table(K.in_batches(docs.where(F.col("id").isNotNull()), pick, "doc long, text string"), "sample")


def telling_features(sample: DataFrame, toxic: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Sorted hashes of the features that tell offending documents of the sample."""
    labels = scratch.broadcast(toxic)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i, j, buf, offs in K.pieces(batch.column(1), COUNTED_BYTES, pc.utf8_lower):
                starts, ends, rows, _ = words_and_sentences(buf, offs)
                bad = labels.value[at[i:j]]
                for words, h in word_features(buf, starts, ends):
                    # once for each text that holds it
                    own = rows[words]
                    once = np.unique(K.mix(h + own.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
                    found, where = np.unique(h[once], return_inverse=True)
                    y = bad[own[once]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array(np.bincount(where, y, len(found)).astype(np.int64)), pa.array(np.bincount(where, 1 - y, len(found)).astype(np.int64))],
                        names=["h", "bad", "good"],
                    )

    n_bad, n_good = int(toxic.sum()), int((1 - toxic).sum())
    sums = K.in_batches(sample, count, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = (F.col("bad") + F.col("good")) / F.lit(float(n_bad + n_good))

    def part(x: str, n: int) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (rate * n))).otherwise(0.0) + F.when(
            F.col(x) < n, (n - F.col(x)) * F.log((n - F.col(x)) / ((1 - rate) * n))
        ).otherwise(0.0)

    lift = F.col("bad") * n_good > LEAST_LIFT * (F.col("good") + 0.5) * n_bad
    scored = sums.where((F.col("bad") >= 3) & lift & (rate < 1)).withColumn("ratio", 2 * (part("bad", n_bad) + part("good", n_good)))
    best = scored.where(F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "h").limit(VOCABULARY).select("h").toPandas()
    return np.sort(best["h"].to_numpy(dtype=np.int64).view(np.uint64))


def matches(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature number) of every telling feature of every word."""
    if not len(features):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    table = np.zeros(1 << 16, dtype=bool)
    table[(features & _U(0xFFFF)).astype(np.int64)] = True
    words, found = [], []
    for at, h in word_features(buf, starts, ends):
        maybe = np.flatnonzero(table[(h & _U(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(features, h[maybe]), len(features) - 1)
        hit = features[k] == h[maybe]
        words.append(at[maybe[hit]])
        found.append(k[hit])
    return np.concatenate(words), np.concatenate(found)


def sentence_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sentence: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence number, feature number), sorted."""
    words, found = matches(buf, starts, ends, features)
    pairs = np.unique(sentence[words] * (len(features) + 1) + found)
    return pairs // (len(features) + 1), pairs % (len(features) + 1)


def fit(bag: np.ndarray, times: np.ndarray, instance: np.ndarray, feature: np.ndarray, toxic: np.ndarray, n_features: int, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by Adam on the noisy-or likelihood of the bags.

    instance numbers the distinct feature sets of sentences, bag gives the document
    of each of them, times how many sentences hold it, and feature the features, one
    entry per (instance, feature).
    """
    n, m = len(toxic), len(bag)
    w = np.concatenate((np.full(n_features, 1.0), [-2.0, -4.0]))  # weights, bias, logarithm of the leak's hazard
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(instance, w[:n_features][feature], m) + w[-2] if m else np.zeros(0)
        p = 1 / (1 + np.exp(-z))
        leak = np.exp(w[-1])
        hazard = np.bincount(bag, times * np.logaddexp(0, z), n) + leak
        pull = np.where(toxic > 0, -1 / np.expm1(np.clip(hazard, 1e-6, 700.0)), 1.0) / n
        dz = pull[bag] * p * times
        g = np.concatenate((np.bincount(feature, dz[instance], n_features), [dz.sum(), pull.sum() * leak]))
        g[:n_features] += decay * w[:n_features] / max(1, n_features)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w[-1] = min(w[-1], -2.0)
    return w[:n_features], float(w[-2]), float(-np.expm1(-np.exp(w[-1])))


def bags(sample: DataFrame, features: np.ndarray, scratch: Scratch) -> DataFrame:
    """doc, features (a sorted set; empty for the text itself) and times (sentences that hold just this set)."""
    shared = scratch.broadcast(features)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i, j, buf, offs in K.pieces(batch.column(1), prepare=pc.utf8_lower):
                starts, ends, rows, sentence = words_and_sentences(buf, offs)
                s, f = sentence_features(buf, starts, ends, sentence, shared.value)
                own, first, held = np.unique(s, return_index=True, return_counts=True)
                row = rows[np.searchsorted(sentence, own)] if len(own) else own
                docs = pa.array(np.concatenate((at[i:j], at[i:j][row])))
                sets = K.ragged(f.astype(np.int64), np.concatenate((np.zeros(j - i, np.int64), held)), pa.int64())
                yield pa.RecordBatch.from_arrays([docs, sets], names=["doc", "features"])

    return K.in_batches(sample, work, "doc long, features array<long>").groupBy("doc", "features").agg(F.count(F.lit(1)).alias("times"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model; docs has id and text, labels id and toxic, one row per id.

    The sample is the labelled ids of the smallest hashes.
    """
    known = labels.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas().sort_values("id")
    ids, toxic = known["id"].to_numpy(dtype=np.int64), known["toxic"].to_numpy(dtype=np.int64)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, min(0.1, share + 0.001))
    with Scratch(docs.sparkSession) as scratch:
        sample = sampled(docs, ids, scratch)
        features = telling_features(sample, toxic, scratch)
        rows = bags(sample, features, scratch).toPandas().sort_values(["doc", "features"], key=lambda c: c if c.name == "doc" else c.map(tuple))
    if rows.empty:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0, min(0.1, share))
    held = rows["features"].map(len).to_numpy()
    docs_, bag = np.unique(rows["doc"].to_numpy(), return_inverse=True)
    full = held > 0
    feature = np.concatenate([np.zeros(0, np.int64), *rows["features"][full]]).astype(np.int64)
    instance = np.repeat(np.arange(full.sum()), held[full])
    weights, bias, leak = fit(bag[full], rows["times"].to_numpy()[full].astype(float), instance, feature, toxic[docs_], len(features))
    return Model(features, weights, bias, leak)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def score_piece(buf: np.ndarray, offs: np.ndarray, m: Model) -> tuple[np.ndarray, pa.Array]:
    """Scores of a piece of lower-cased texts, and each text's offending sentences."""
    n = len(offs) - 1
    starts, ends, rows, sentence = words_and_sentences(buf, offs)
    s, f = sentence_features(buf, starts, ends, sentence, m.features)
    own, where = np.unique(s, return_inverse=True)
    z = np.bincount(where, m.weights[f], len(own)) + m.bias
    first = np.searchsorted(sentence, own)
    last = np.searchsorted(sentence, own, side="right") - 1
    row = rows[first] if len(own) else own
    total = 1 - (1 - m.leak) * np.exp(-np.bincount(row, np.logaddexp(0, z), n))
    p = 1 / (1 + np.exp(-z))
    bad = p >= OFFENDS
    chars = np.concatenate(([0], np.cumsum(buf & 0xC0 != 0x80)))
    base = chars[offs[row[bad]]]
    spans = pa.StructArray.from_arrays([pa.array(chars[starts[first[bad]]] - base), pa.array(chars[ends[last[bad]]] - base), pa.array(p[bad])], fields=list(SPAN))
    return total, K.ragged(spans, K.counts_by_row(row[bad], n), SPAN)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs (id, text): id, score and the offending sentences with their code-point spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in K.pieces(batch.column(1), prepare=pc.utf8_lower):
                total, spans = score_piece(buf, offs, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(total), spans], names=["id", "score", "sentences"])

    return K.in_batches(docs, work, "id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id and toxic of the labels that may be learnt from."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).na.drop()
    return known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))


def detect(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row of df: id, held_out, score, predicted and the offending sentences; labels has id_col and label_col."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = score(docs, train(docs, known_labels(labels, id_col, label_col), sample_rows))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def without_toxic(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """df without the rows that score threshold or more; all columns pass through, without a join."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(train(docs, known_labels(labels, id_col, label_col), sample_rows))
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in K.pieces(batch.column(at), prepare=pc.utf8_lower):
                yield batch.slice(i, j - i).filter(pa.array(score_piece(buf, offs, shared.value)[0] < threshold))

    return K.in_batches(df, work, df.schema)
