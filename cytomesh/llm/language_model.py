"""Op 8, a hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). Both factors look at the
same hashed features: the word before, the one two before (a skip), and both together. The
first is a softmax over CLASSES classes. Inside a class the softmax over its words is factored
again, along LEVELS binary choices: words are ordered by training count, a word's code is its
place in its class' cumulated count, so that a choice halves what is left, and each choice has
its own weight for every feature, hashed into `buckets` numbers. Words that still share a leaf
share it by count. Words seen at most once, and unseen ones, are a class of their own (TAIL)
without choices, which keeps room for UNSEEN words that training never saw. All P of a context,
over the seen words and UNSEEN unseen ones, sum to 1.

Steps, each over every document:
1. Words of the training documents are counted. Words of the larger counts, KNOWN_WORDS at
   most, are sent to all tasks with their counts and codes.
2. ROUNDS of training: tasks sum, for every feature, what they observe and what the model
   expects. The difference is the gradient; weights move by generalised iterative scaling,
   whose step for a bucket is log(observed / expected) / FEATURES. The sums don't depend on how
   documents are dealt to tasks, and neither do the scores. Buckets grow with the training
   tokens, from 2**LEAST_BITS to 2**MOST_BITS numbers.
3. Scoring in sparse batches of BATCH tokens.
Counts of words that are not sent (none unless there are more than KNOWN_WORDS) enter a score
by log10(count + 1) alone; they are joined to each document's such words by a shuffle.

Defined results: a null or empty text is an end token alone; an empty table gives no rows;
repeated rows each count; a null doc_id is trained on and not held out; other columns are
ignored. Without training documents every count is 0 and the classes are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _text
from cytomesh.session import bound_batches, table, written

CLASSES = 16
TAIL = 0
LEVELS = 7
LEAVES = 1 << LEVELS
FEATURES = 3
UNSEEN = 1000
CLASS_BITS = 12  # buckets of each feature for the classes
LEAST_BITS, MOST_BITS = 14, 20
#: Training tokens for each bucket of the choices.
TOKENS_EACH = 8
BATCH = 1 << 15
ROUNDS = 2
#: Weight of the expected share in the observed one.
SMOOTH = 2.0
KNOWN_WORDS = 1 << 20
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 19
#: Slices that sums travel in, and tasks whose sums are added at once.
SLICES, ADDED = 64, 128
#: Bins of counts: eight to a doubling.
BIN = "cast(floor(8 * log2(count)) as int)"
END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x9E6C63D0876A9A47)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) leaves that rest; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some documents (words, then an end), and the tokens before each."""
    words = _text.find_words(data, offs)
    first = words.first + np.arange(len(offs))
    out = np.full(first[-1], END)
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = _text.span_hash(data, words.start, words.end, lower=True)
    return out, first


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = _text.buffers(batch.column(1))
    for lo, hi in _text.slabs(offs):
        yield lo, hi, *tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def _train(batch: pa.RecordBatch, lo: int, hi: int, first: np.ndarray) -> np.ndarray:
    """The tokens that are learnt from."""
    held = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(np.repeat(~held, np.diff(first)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and count over all training documents; docs is doc_id, text, held."""

    @_text.tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi, hashes, first in _slabs(batch):
                new, n = np.unique(hashes[_train(batch, lo, hi, first)], return_counts=True)
                words, place = np.unique(np.concatenate([words, new]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(words)).astype(np.int64)
                if len(words) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "count"])
                    words, counts = words[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "count"])

    return docs.mapInArrow(counted, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


class Model:
    """Words with their counts and codes, and the weights. A code is class * LEAVES + leaf; the tail's is 0."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tail_mass: int, tail_types: int):
        """words ascending; tail_mass and tail_types are of the seen words that are not among them."""
        self.words, self.counts = words, counts
        self.train_tokens, self.train_types = int(counts.sum()) + tail_mass, len(words) + tail_types
        self.bits = max(1, int(len(words)).bit_length())
        begin = np.searchsorted(words, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.begin = np.append(begin, len(words)).astype(np.int32)
        often = np.flatnonzero(counts > 1)
        often = often[np.lexsort((words[often], -counts[often]))]
        mass = counts[often].astype(np.float64)
        middle = (np.cumsum(mass) - mass / 2) / max(mass.sum(), 1.0)
        self.codes = np.zeros(len(words), np.int32)
        self.codes[often] = LEAVES + np.minimum((middle * (CLASSES - 1) * LEAVES).astype(np.int64), (CLASSES - 1) * LEAVES - 1)
        leaf_mass = np.bincount(self.codes, weights=counts, minlength=CLASSES * LEAVES).astype(np.float64)
        leaf_types = np.bincount(self.codes, minlength=CLASSES * LEAVES).astype(np.float64)
        leaf_mass[0] += tail_mass
        leaf_types[0] += tail_types + UNSEEN
        self.leaf_log = np.log10(np.maximum(leaf_mass + leaf_types, 1e-300))
        share = (leaf_mass + leaf_types).reshape(CLASSES, LEAVES)
        # Node 2**level + prefix of a class: log odds of its upper half.
        self.bias = np.zeros((CLASSES, LEAVES), np.float32)
        self.open = np.zeros((CLASSES, LEAVES), bool)
        for level in range(LEVELS):
            halves = share.reshape(CLASSES, 1 << level, 2, -1).sum(axis=3)
            both = (halves > 0).all(axis=2)
            at = slice(1 << level, 2 << level)
            self.open[:, at] = both
            self.bias[:, at] = np.where(both, np.log(np.maximum(halves[..., 1], 1e-300) / np.maximum(halves[..., 0], 1e-300)), 0)
        self.bias, self.open = self.bias.ravel(), self.open.ravel()
        self.salt = _text.mix(np.arange(CLASSES * LEAVES, dtype=np.uint64) + np.uint64(1))
        total = leaf_mass.reshape(CLASSES, LEAVES).sum(axis=1) + 1
        self.class_bias = np.log(total / total.sum()).astype(np.float32)
        self.class_weights = np.zeros((FEATURES << CLASS_BITS, CLASSES), np.float32)
        self.choice_bits = int(np.clip((max(self.train_tokens, 1) // TOKENS_EACH).bit_length(), LEAST_BITS, MOST_BITS))
        self.choice_weights = np.zeros(1 << self.choice_bits, np.float32)
        self.seen: tuple | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the words, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[slot].astype(np.int64), self.begin[slot + 1].astype(np.int64)
        out = np.full(len(hashes), -1)
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.words[at[left]] == hashes[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def coded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and codes; words that are not known have 0 and the tail's code."""
        place = self.find(hashes)
        known = np.flatnonzero(place >= 0)
        codes, counts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        codes[known], counts[known] = self.codes[place[known]], self.counts[place[known]]
        return counts, codes

    def class_logs(self, features: np.ndarray) -> np.ndarray:
        """log P(class) for each token's context."""
        out = self.class_weights[_class_rows(features, 0)]
        out += self.class_bias
        for i in range(1, FEATURES):
            out += self.class_weights[_class_rows(features, i)]
        out -= np.log(np.exp(np.clip(out, -80, 80, out=out)).sum(axis=1, keepdims=True))
        return out

    def choices(self, codes: np.ndarray, features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Of each level: the tokens with a choice, what they chose, the log odds of the upper half, and their buckets."""
        inner = np.flatnonzero(codes >= LEAVES)
        codes, features = codes[inner], features[:, inner]
        base, leaf = codes & ~(LEAVES - 1), codes & (LEAVES - 1)
        shift = np.uint64(64 - self.choice_bits)
        for level in range(LEVELS):
            node = base + (1 << level) + (leaf >> (LEVELS - level))
            at = np.flatnonzero(self.open[node])
            if not len(at):
                continue
            node = node[at]
            salt = self.salt[node]
            logit = self.bias[node]
            rows = []
            for f in features:
                r = (((f[at] ^ salt) * _SPREAD) >> shift).astype(np.int32)
                logit += self.choice_weights[r]
                rows.append(r)
            yield inner[at], ((leaf[at] >> (LEVELS - 1 - level)) & 1).astype(bool), logit, rows

    def log10(self, codes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """log10 P(leaf of each token | context)."""
        out = self.class_logs(features)[np.arange(len(codes)), codes >> LEVELS].astype(np.float64)
        for at, chosen, logit, _ in self.choices(codes, features):
            out[at] -= np.log1p(np.exp(np.clip(np.where(chosen, -logit, logit), -30, 30)))
        return out / np.log(10)


def _class_rows(features: np.ndarray, i: int) -> np.ndarray:
    return (features[i] >> np.uint64(64 - CLASS_BITS)).astype(np.int64) + (i << CLASS_BITS)


def features_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of every token's features: the word before, the one two before, and both."""
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    two[:2] = START
    begin = first[:-1]
    one[begin] = two[begin] = START
    second = begin + 1
    two[second[second < len(hashes)]] = START  # after a one-token document this is the next one's first token
    return np.stack([_text.mix(one), _text.mix(two ^ np.uint64(0xABCDEF)), _text.mix(one * np.uint64(3) + two)])


def fit(docs: DataFrame, known_words: int = KNOWN_WORDS, rounds: int = ROUNDS) -> tuple[Model, DataFrame, bool]:
    """The trained model, the counts of all words, and whether the model knows all of them."""
    counts = written(word_counts(docs), "word_counts")
    bins = sorted((r["bin"], r["types"], r["mass"]) for r in counts.groupBy(F.expr(BIN).alias("bin")).agg(F.count("*").alias("types"), F.sum("count").alias("mass")).collect())
    types, least = 0, None
    for bin_, n, _ in reversed(bins):
        if types + n > known_words:
            break
        types, least = types + n, bin_
    whole = types == sum(n for _, n, _ in bins)
    sent = counts.where(F.expr(BIN) >= (0 if least is None else least)).toArrow() if types else None  # known_words rows at most
    words = sent["word"].to_numpy().view(np.uint64) if types else np.zeros(0, np.uint64)
    number = sent["count"].to_numpy() if types else np.zeros(0, np.int64)
    order = np.argsort(words)
    rest = [(n, m) for b, n, m in bins if least is None or b < least]
    model = Model(words[order], number[order], sum(m for _, m in rest), sum(n for n, _ in rest))
    for number in range(rounds if model.train_tokens else 0):
        train_round(docs, model, number == 0)
    model.seen = None
    return model, counts, whole


def train_round(docs: DataFrame, model: Model, start: bool) -> None:
    """One step of iterative scaling; before the first one (start) the classes' expectation is their bias."""
    held_back, model.seen = model.seen, None  # the tasks need the weights alone
    sent = docs.sparkSession.sparkContext.broadcast(model)
    model.seen = held_back
    shape = model.class_weights.shape

    names = ["slice", "seen", "expected", "n", "upper_n", "upper_expected"]

    @_text.tidy
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number = TaskContext.get().partitionId()
        seen = np.zeros(shape[0] * CLASSES, np.int64)
        expected = np.zeros(shape)
        n, upper_n, upper_expected = (np.zeros(len(model.choice_weights), t) for t in (np.int64, np.int64, np.float64))
        done = False
        for batch in batches:
            for lo, hi, hashes, first in _slabs(batch):
                train = _train(batch, lo, hi, first)
                _, codes = model.coded(hashes)
                features = features_of(hashes, first)
                held: list[list[np.ndarray]] = [[], [], []]
                for at in range(0, len(train), BATCH):
                    pick = train[at : at + BATCH]
                    f, c = features[:, pick], codes[pick]
                    done = True
                    p = None if start else np.exp(model.class_logs(f))
                    for i in range(FEATURES):
                        rows = _class_rows(f, i) - (i << CLASS_BITS)
                        part = slice(i << CLASS_BITS, (i + 1) << CLASS_BITS)
                        if start:
                            seen.reshape(shape)[part] += np.bincount(rows * CLASSES + (c >> LEVELS), minlength=CLASSES << CLASS_BITS).reshape(-1, CLASSES)
                        else:
                            expected[part] += np.stack([np.bincount(rows, weights=p[:, k], minlength=1 << CLASS_BITS) for k in range(CLASSES)], axis=1)
                    for _, chosen, logit, rows in model.choices(c, f):
                        upper = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                        for r in rows:
                            for into, value in zip(held, (r, chosen, upper), strict=True):
                                into.append(value)
                if held[0]:
                    r, chosen, upper = map(np.concatenate, held)
                    upper_expected += np.bincount(r, weights=upper, minlength=len(n))
                    if start:
                        n += np.bincount(r, minlength=len(n))
                        upper_n += np.bincount(r[chosen], minlength=len(n))
        if done:
            sums = [x.reshape(SLICES, -1) for x in (seen, expected, n, upper_n, upper_expected)]
            use = (start, not start, start, start, True)  # what was seen is summed in the first round
            packed = [pa.array([x[i].astype("<f8").tobytes() if u else None for i in range(SLICES)], pa.binary()) for u, x in zip(use, sums, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), *packed, pa.array([number] * SLICES, pa.int64())], [*names, "part"])

    def added(group: pa.Table) -> pa.Table:
        out = {"slice": group["slice"][:1]}
        for c in names[1:]:
            total = sum((np.frombuffer(x.as_buffer()) for x in group[c] if x.is_valid), np.float64(0))
            out[c] = pa.array([np.asarray(total).tobytes() if np.ndim(total) else None], pa.binary())
        return pa.table(out | {"part": group["part"][:1]})

    schema = ", ".join([f"{names[0]} int", *(f"{c} binary" for c in names[1:]), "part long"])
    # A task's sums have a fixed size, however few rows it has: two tasks a core, not one for each piece of a file.
    sums = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(summed, schema)
    for step in (ADDED, ADDED**2, None):
        sums = sums.groupBy("slice", *[F.expr(f"part div {step}").alias("g")] * (step is not None)).applyInArrow(added, schema)
    rows = sorted(sums.collect(), key=lambda r: r["slice"])  # the sums' fixed size
    if not rows:
        return
    joined = lambda c: np.concatenate([np.frombuffer(bytes(r[c])) for r in rows])
    if start:
        model.seen = joined("seen").reshape(shape), joined("n"), joined("upper_n")
    seen, n, upper = model.seen
    many = seen.sum(axis=1)
    used = many > 0
    many = many[used, None]
    expected = many * np.exp(model.class_bias.astype(np.float64)) if start else joined("expected").reshape(shape)[used]
    fill = SMOOTH * expected / many
    model.class_weights[used] += (np.log((seen[used] + fill) / (expected + fill)) / FEATURES).astype(np.float32)
    expected = joined("upper_expected")
    some = n > 0
    share = np.clip(expected[some] / n[some], 1e-9, 1 - 1e-9)
    odds = np.log((upper[some] + SMOOTH * share) / (n[some] - upper[some] + SMOOTH * (1 - share)))
    model.choice_weights[some] += ((odds - np.log(share / (1 - share))) / FEATURES).astype(np.float32)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def rare_parts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """row, known and log: of the words that the model doesn't know, how many are seen, and their log10(count + 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @_text.tidy
    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, first in _slabs(batch):
                at = np.flatnonzero(sent.value.find(hashes) < 0)
                pair, n = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, hashes[at].view(np.int64)]), axis=1, return_counts=True)
                row = batch.column(3).slice(lo, hi - lo).to_numpy()[pair[0]]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pair[1]), pa.array(n)], ["row", "word", "n"])

    # Equal rows have one name and equal numbers.
    found = docs.mapInArrow(unknown, "row long, word long, n long").groupBy("row", "word").agg(F.max("n").alias("n"))
    return found.join(counts, "word").groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("log"))


def score(docs: DataFrame, rounds: int = ROUNDS, known_words: int = KNOWN_WORDS) -> DataFrame:
    """See SCORES: base and model log10 probabilities of every document."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", held_out(7, 2).alias("held"))
    model, counts, whole = fit(docs, known_words, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @_text.tidy
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        unseen = np.log10(model.train_tokens + model.train_types + 1)
        for batch in batches:
            for lo, hi, hashes, first in _slabs(batch):
                counts, codes = model.coded(hashes)
                features = features_of(hashes, first)
                own = np.log10(counts + 1.0)
                log10 = own - model.leaf_log[codes]
                for at in range(0, len(codes), BATCH):
                    log10[at : at + BATCH] += model.log10(codes[at : at + BATCH], features[:, at : at + BATCH])
                begin, length = first[:-1], np.diff(first)
                base = np.add.reduceat(own, begin) - length * unseen
                known = np.add.reduceat((counts > 0).astype(np.int64), begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(length), pa.array(known), pa.array(np.full(hi - lo, model.train_tokens)), pa.array(base), pa.array(np.add.reduceat(log10, begin)), batch.column(3).slice(lo, hi - lo)],
                    [*(c.split()[0] for c in SCORES.split(", ")), "row"],
                )

    docs = docs.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    out = docs.mapInArrow(scored, SCORES + ", row long")
    if not whole:
        out = out.join(rare_parts(docs, model, counts), "row", "left")
        more = F.coalesce("log", F.lit(0.0))
        out = out.withColumns({"n_known": F.col("n_known") + F.coalesce("known", F.lit(0)), "base_score": F.col("base_score") + more, "score": F.col("score") + more})
    return out.select(*[c.split()[0] for c in SCORES.split(", ")])


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
