"""Op 7, toxicity by subword-bag embeddings averaged into a linear softmax.

A word between two blanks gives its 3- to 5-grams of bytes (A-Z as a-z) and itself, hashed
into BUCKETS vectors; a document is the mean of its vectors, and a two-class softmax of it is
the score. Vectors and softmax are trained together in numpy on at most SAMPLE labelled
documents of each class (in the order of md5(doc_id)), whatever the corpus' size; misspelt
words share most of their n-grams with the words seen. The classes' prior comes from all
labels of the training folds. With two classes the softmax needs the vectors only along one
direction, so documents are scored with one number for each bucket.

Labels of documents with crc32(doc_id as text) mod 5 = 0 are never used, and labels, lang,
source and doc_id are never inputs of a score.

Defined results: null, empty and blank texts have no vectors and get the prior; without both
classes among the labels every score is the prior; repeated rows get the same score, and are
learnt from once (the smallest of a doc_id's texts; toxic if any of its labels says so); a null
doc_id is not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _text
from cytomesh.session import bound_batches, table, written

FOLDS, HELD_OUT = 5, 0
SAMPLE = 3000
BITS = 17
BUCKETS = 1 << BITS
DIMENSIONS = 8
STEPS = 100
RATE = 0.05
#: Means are small numbers; a fixed factor for the softmax's input.
SCALE = 100.0
DECAY = 1e-4
LEAST = 10
CHECK = 6
#: Partitions of the training rows.
PARTS = 16

_RNG = np.random.Generator(np.random.PCG64(31))
_LETTER = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(0x94D049BB133111EB)
SIZES = (3, 4, 5)


def subwords(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all subwords by kind, and how many of them lie before each document."""
    n, docs = len(data), len(offs) - 1
    # One blank before each document and one at the end.
    place = np.arange(n) + np.repeat(np.arange(1, docs + 1), np.diff(offs))
    text = np.full(n + docs + 1, 0x20, np.uint8)
    text[place] = data
    blank = _text._WS[text]
    text[blank] = 0x20
    edge = offs + np.arange(docs + 1)  # the blank before each document
    code = _LETTER[text]
    blanks = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    gram = code.copy()
    for size in range(2, max(SIZES) + 1):
        m = len(text) - size + 1
        if m <= 0:
            return
        gram = gram[:m] * _STEP + code[size - 1 : size - 1 + m]
        if size in SIZES:
            at = np.flatnonzero(blanks[size - 1 : size - 1 + m] == blanks[1 : 1 + m])  # no blank inside
            yield ((gram[at] * _LAST) >> np.uint64(64 - BITS)).astype(np.int32), np.searchsorted(at, edge)
    words = _text.find_words(data, offs)
    yield (_text.span_hash(data, words.start, words.end, lower=True) >> np.uint64(64 - BITS)).astype(np.int32), words.first


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct buckets, their counts, and all subwords of each document."""
    data, offs = _text.buffers(texts)
    out = []
    for lo, hi in _text.slabs(offs):
        kinds = list(subwords(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
        for i in range(hi - lo):
            ids, counts = np.unique(np.concatenate([b[f[i] : f[i + 1]] for b, f in kinds]), return_counts=True)
            out.append((ids.astype(np.int32), counts.astype(np.int32), int(counts.sum())))
    return out


class Part:
    """Some training documents: buckets and their shares of each document, one after another."""

    def __init__(self, ids: list[np.ndarray], shares: list[np.ndarray], labels: list[int]):
        self.count = np.array([len(i) for i in ids])
        self.ids, self.shares, self.labels = np.concatenate(ids), np.concatenate(shares), np.array(labels, np.int64)

    def only(self, place: np.ndarray) -> "Part":
        """The buckets that have a place, renumbered."""
        keep = place[self.ids] >= 0
        doc = np.repeat(np.arange(len(self.count)), self.count)[keep]
        self.count = np.bincount(doc, minlength=len(self.count))
        self.ids, self.shares = place[self.ids[keep]], self.shares[keep]
        return self

    def sums(self, along: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.shares * along[self.ids], dtype=np.float64)])
        end = np.cumsum(self.count)
        return total[end] - total[end - self.count]

    def pull(self, error: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.ids, weights=np.repeat(error, self.count) * self.shares, minlength=n)


class Classifier:
    """Bucket vectors and a two-class softmax along one direction."""

    def __init__(self, prior: float):
        rng = np.random.Generator(np.random.PCG64(5))
        self.vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
        self.direction = rng.uniform(-1, 1, DIMENSIONS)
        self.prior = prior
        self.bias = 0.0

    def train(self, parts: list[Part], steps: int = STEPS) -> None:
        """Adam on the mean cross entropy of the two classes, each with half the weight.

        Buckets of fewer than LEAST documents (less with few toxic ones) are left out: they can
        only be memorised. The weights kept are those of the step that is best on every
        CHECK-th document, which take no part in the gradients. Only parts' arrays stay in
        memory; each step goes over them one by one.
        """
        labels = np.concatenate([p.labels for p in parts])
        least = int(np.clip(labels.sum() // 20, 2, LEAST))
        seen = sum(np.bincount(p.ids, minlength=BUCKETS) for p in parts)
        used = np.flatnonzero(seen >= least)
        if not len(used):
            return
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        parts = [p.only(place) for p in parts]
        test = np.zeros(len(labels), bool)
        for label in (0, 1):  # of either class
            test[np.flatnonzero(labels == label)[::CHECK]] = True
        if len(np.unique(labels[~test])) < 2:
            test[:] = False
        weigh = lambda rows: np.where(rows, np.where(labels == 1, 0.5 / max(1, (labels * rows).sum()), 0.5 / max(1, ((1 - labels) * rows).sum())), 0.0)
        weight, judged = weigh(~test), weigh(test if test.any() else ~test)
        vectors, direction, bias = self.vectors[used], self.direction, 0.0
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, direction, np.zeros(1))]
        best = (np.inf, vectors, direction, bias)
        for step in range(1, steps + 1):
            along = (vectors @ direction).astype(np.float32)
            logit = np.clip(np.concatenate([p.sums(along) for p in parts]) + bias, -30, 30)
            chance = 1 / (1 + np.exp(-logit))
            loss = -(judged * np.where(labels == 1, np.log(chance), np.log1p(-chance))).sum()
            if loss < best[0]:
                best = (loss, vectors, direction, bias)
            error = weight * (chance - labels)
            pull, at = np.zeros(len(used)), 0
            for p in parts:
                pull += p.pull(error[at : at + len(p.labels)], len(used))
                at += len(p.labels)
            gradients = (np.outer(pull, direction) + DECAY * vectors, pull @ vectors, np.array([error.sum()]))
            change = []
            for g, (m, v) in zip(gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                change.append(RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
            vectors, direction, bias = vectors - change[0], direction - change[1], bias - float(change[2][0])
        _, vectors, self.direction, self.bias = best
        self.vectors = np.zeros_like(self.vectors)  # buckets left out say nothing
        self.vectors[used] = vectors

    def along(self) -> np.ndarray:
        return (self.vectors @ self.direction * SCALE).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier of documents marked toxic = 1, from the training folds only."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(fold != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Classifier(float(np.log((toxic + 1) / (clean + 1))))
    if not toxic or not clean:
        return model
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(sample))
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    # One text of each id, in an order that does not depend on the files.
    text = text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(PARTS, "doc_id").sortWithinPartitions("doc_id")

    @_text.tidy
    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                got = bags(part.column(1))
                shares = [(SCALE * b[1] / max(1, b[2])).astype(np.float32).tobytes() for b in got]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([b[0].tobytes() for b in got], pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "toxic", "ids", "shares"])

    found = text.select("doc_id", "text", "toxic").mapInArrow(bagged, "doc_id long, toxic int, ids binary, shares binary")
    found = written(found.where("octet_length(ids) > 0"), "bags").select("toxic", "ids", "shares")
    parts, held = [], ([], [], [])
    for r in found.toLocalIterator():  # at most 2 * sample rows, a partition of the written table at a time
        for into, value in zip(held, (np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["shares"]), np.float32), r["toxic"]), strict=True):
            into.append(value)
        if len(held[0]) == 100:
            parts.append(Part(*held))
            held = ([], [], [])
    if held[0]:
        parts.append(Part(*held))
    if parts and len(np.unique(np.concatenate([p.labels for p in parts]))) == 2:
        model.train(parts)
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    along, offset = model.along().astype(np.float32), model.bias + model.prior
    prior = model.prior
    sent = docs.sparkSession.sparkContext.broadcast(along)  # BUCKETS numbers

    @_text.tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        along = sent.value
        for batch in batches:
            data, offs = _text.buffers(batch.column(1))
            for lo, hi in _text.slabs(offs):
                total, number = np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
                for buckets, first in subwords(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
                    total += np.diff(np.concatenate([[0.0], np.cumsum(along[buckets], dtype=np.float64)])[first])
                    number += np.diff(first)
                logit = np.where(number > 0, total / np.maximum(number, 1) + offset, prior)
                p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
