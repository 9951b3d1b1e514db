"""Op 2, personal data by patterns and information-theoretic sanitisation.

Base spans come from four patterns; secrets (values given to a password, token or key, and
runs of letters and digits of high character entropy) are protected as well, in spans of kind
secret. The method then asks which words of their documents give such entities away. An
entity is a value that was found, what it generalises to (an address' domain, a number's
country), or its kind. For a word t and an entity e, over the whole corpus of N documents,
    P(e | t)  = (documents with e and t + SMOOTH * P(e)) / (documents with t + SMOOTH)
    PMI(t; e) = log2(P(e | t) / P(e))
    IC(e)     = log2(1 / P(e))
Evidence is what copies don't add to, one piece a document: the distinct contexts (CONTEXT words
on either side) of a value, and the distinct values of a kind or wider entity. A word discloses e if documents that
hold it have at least SUPPORT pieces of evidence (WIDE_SUPPORT of a kind or wider entity, whose
words are many) and the share COVER of all of e's, and PMI >= SHARE * IC > 0.
It becomes a span of kind term wherever it stands outside other spans in a document of e;
documents without e keep it. sanitize() generalises base spans and secrets to their kind and
removes disclosing words.

COVER bounds the words that can disclose an entity by (words in its documents) / COVER, at any
size of the corpus. Entities and words are told apart by 64-bit hashes; bit tables of a fixed
size only keep others out early, and if one fills up the result stays the same.

Defined results: a null or empty text has no span; an empty table gives no rows; repeated
rows get the same spans; a null doc_id stays null; other columns are kept by sanitize() and
ignored otherwise. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm import _text
from cytomesh.session import bound_batches, table, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 4
SUPPORT, WIDE_SUPPORT = 3, 10
COVER = 0.1
SHARE = 0.7
SMOOTH = 2.0
TABLE_BITS = 20
#: Pairs of entity and word that may be broadcast; more are joined by a shuffle.
SENT_PAIRS = 100_000
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 18
#: Names whose values are secrets.
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access-key")
SECRET_LENGTH, SECRET_DIGITS, SECRET_LETTERS, SECRET_BITS = 16, 2, 4, 3.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = ".,;:!?()[]{}<>\"'="
_TERM = re.compile(r"[^\x20\x09-\x0D" + re.escape(_MARKS) + "]+")
_GIVEN = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(SECRET_NAMES) + r")[ ]?[=:][ ]?[\"']?([^\s\"']{6,})")
_RUN = re.compile(r"[A-Za-z0-9]{16,}+")
_BLANK = _text._WS.copy()
_BLANK[[ord(c) for c in _MARKS]] = True
_MAYBE = np.zeros(256, bool)
_MAYBE[48:58] = _MAYBE[64] = True


def _lower(text: str) -> str:
    """A-Z as a-z, like the byte kernels."""
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d // 10 + d % 10 for d in (2 * int(x) for x in digits[-2::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def _entropy(word: str) -> float:
    """Bits a character, by the word's own characters."""
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values())


def secret_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of secrets outside the spans taken."""
    found = [m.span(1) for m in _GIVEN.finditer(text) if any(c.isdigit() for c in m[1])]
    for m in _RUN.finditer(text):
        run = m.group()
        digits = sum(c.isdigit() for c in run)
        if digits >= SECRET_DIGITS and len(run) - digits >= SECRET_LETTERS and _entropy(run) >= SECRET_BITS:
            found.append(m.span())
    out, end = [], -1
    busy = sorted((a, b) for _, a, b in taken)
    cut = [a for a, _ in busy]
    reach = 0
    reaches = [reach := max(reach, b) for _, b in busy]
    for a, b in sorted(found):
        k = bisect_left(cut, b)
        if a >= end and not (k and reaches[k - 1] > a):
            out.append(("secret", a, b))
            end = b
    return out


def _hashes(words: list[str]) -> np.ndarray:
    data, offs = _text.buffers(pa.array(words, pa.string()))
    return _text.span_hash(data, offs[:-1], offs[1:]).view(np.int64) if words else np.zeros(0, np.int64)


def _terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """word, start, end of the words of 3 letters or more outside the spans."""
    taken = sorted((a, b) for _, a, b in spans)
    cut = [a for a, _ in taken]
    reach = 0
    reaches = [reach := max(reach, b) for _, b in taken]
    for m in _TERM.finditer(text):
        x, y = m.span()
        k = bisect_left(cut, y)
        if y - x >= 3 and not (k and reaches[k - 1] > x):
            yield _lower(m.group()), x, y


def entities(kind: str, value: str) -> list[str]:
    """The names of a value: its kind, what it generalises to, and itself."""
    out = [kind, f"{kind}:{value.lower()}"]
    if kind == "email":
        out.append(f"email@{value.rsplit('@', 1)[1].lower()}")
    elif kind == "phone":
        out.append(f"phone+{re.sub('[^0-9]', ' ', value[1:]).split()[0]}")
    return out


def contexts(text: str, spans: list[tuple[str, int, int]]) -> dict[str, str]:
    """One piece of evidence for every name of the spans: the words around a value, the value of a wider name."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    out: dict[str, str] = {}
    for kind, a, b in spans:
        lo, hi = bisect_right(ends, a), bisect_left(starts, b)
        around = [*range(max(0, lo - CONTEXT), lo), *range(hi, min(len(words), hi + CONTEXT))]
        kind_, value, *wider = entities(kind, text[a:b])
        for name, new in [(value, " ".join(text[words[i][0] : words[i][1]].lower() for i in around)), (kind_, value), *((w, value) for w in wider)]:
            out[name] = min(new, out.get(name, new))
    return out


def _row_keys(data: np.ndarray, offs: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A name of each row's text and doc_id."""
    row = _text.span_hash(data, offs[:-1], offs[1:])
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return _text.mix(row ^ _text.mix(ids.view(np.uint64))).view(np.int64)


FOUND = "row long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, marks string, body string, entity array<long>, context array<long>"


def find(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id and FOUND, and with whole all columns of docs as the struct doc.

    row names equal rows, marks has the spans of all kinds but term, and body is the text of rows that have any.
    """
    keep = [F.col("doc_id")] + [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] * whole
    columns = ["doc_id", "doc"][: len(keep)]

    @_text.tidy
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            data, offs = _text.buffers(batch.column(0))
            n = len(batch)
            maybe = np.concatenate([[0], np.cumsum(_MAYBE[data])])
            maybe = np.flatnonzero(maybe[offs[1:]] > maybe[offs[:-1]])
            row = _row_keys(data, offs, batch.column(1))
            counts = np.zeros((n, 5), np.int64)
            sha, marks, body = [empty] * n, [""] * n, [None] * n
            pairs, owner = [], np.zeros(n, np.int64)
            for i in maybe.tolist():
                text = batch.column(0)[i].as_py()
                base = base_spans(text)
                spans = base + secret_spans(text, base)
                if not spans:
                    continue
                for kind, *_ in spans:
                    counts[i, (*KINDS, "secret").index(kind)] += 1
                if base:
                    sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                marks[i], body[i] = _joined(spans), text
                near = contexts(text, spans)
                pairs += near.items()
                owner[i] = len(near)
            bounds = pa.array(np.concatenate([[0], np.cumsum(owner)]).astype(np.int32))
            names = _hashes([p[0] for p in pairs]) & ~1 | np.array([":" not in p[0] for p in pairs], np.int64)  # odd: a kind or wider entity
            arrays = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (names, _hashes([p[1] for p in pairs]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(row), *(pa.array(c) for c in counts.T), pa.array(sha), pa.array(marks), pa.array(body, pa.string()), *arrays], [*columns, *(c.split()[0] for c in FOUND.split(", "))])

    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), *keep)
    schema = ", ".join(f"{c} {t}" for c, t in source.dtypes[1:])
    return source.mapInArrow(found, f"{schema}, {FOUND}")


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _spans_of(marks: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in marks.split(",") if s)]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _bit_table(values: DataFrame) -> bytes:
    """A packed table of 2 ** TABLE_BITS bits with the values' marked."""

    @_text.tidy
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            seen[_slots(batch.column(0).to_numpy())] = True
        packed = np.packbits(seen).reshape(16, -1)
        use = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), pa.array([packed[i].tobytes() for i in use], pa.binary())], ["slice", "bits"])

    def merged(group: pa.Table) -> pa.Table:
        rows = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in group["bits"]])
        return pa.table({"slice": group["slice"][:1], "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    bits = np.zeros((16, (1 << TABLE_BITS) // 128), np.uint8)
    for r in values.mapInArrow(marked, "slice int, bits binary").groupBy("slice").applyInArrow(merged, "slice int, bits binary").collect():  # 128 KB in all
        bits[r["slice"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.tobytes()


def _unpacked(sent) -> np.ndarray:
    return np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct combinations of the keys, and the one of each place."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return [k[order][new] for k in keys], place


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """entity and term (hashes) of the words that give an entity away."""
    spark = docs.sparkSession
    private = found.where("body is not null")
    of = private.select(F.explode(F.array_distinct("entity")).alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    # Each context of an entity counts for one row that has it.
    own = private.select("row", F.explode(F.arrays_zip("entity", "context")).alias("x")).groupBy("x.entity", "x.context").agg(F.min("row").alias("row"))
    own = written(own.select("entity", "row"), "contexts")
    # Only entities with enough contexts can have a disclosing word.
    least = F.expr(f"if(entity & 1 = 1, {WIDE_SUPPORT}, {SUPPORT})")
    many = own.groupBy("entity").agg(F.count("*").alias("evidence")).where(F.col("evidence") >= least)
    rich = spark.sparkContext.broadcast(_bit_table(many.select("entity")))
    owned = own.groupBy("row", "entity").agg(F.count("*").alias("c")).groupBy("row").agg(F.collect_list("entity").alias("owned"), F.collect_list("c").alias("held"))
    # Equal rows are one, that many times.
    rows = private.groupBy("row").agg(F.first("body").alias("body"), F.first("marks").alias("marks"), F.first("entity").alias("entity"), F.count("*").alias("times"))
    rows = rows.join(owned, "row", "left")

    @_text.tidy
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _unpacked(rich)
        for batch in batches:
            entity, term, support, many = [], [], [], []
            for body, marks, names, times, owns, holds in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                names = np.unique(np.array(names, np.int64))
                names = names[seen[_slots(names)]]
                words = _hashes(list({w for w, _, _ in _terms(body, _spans_of(marks))}))
                have = dict(zip(owns or (), holds or (), strict=True))
                entity.append(np.repeat(names, len(words)))
                term.append(np.tile(words, len(names)))
                many.append(np.full(len(names) * len(words), times))
                support.append(np.repeat(np.array([have.get(e, 0) for e in names.tolist()], np.int64), len(words)))
            if entity:
                (e, t), place = _distinct(np.concatenate(entity), np.concatenate(term))
                total = lambda x: pa.array(np.bincount(place, weights=np.concatenate(x), minlength=len(e)).astype(np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(t), total(many), total(support)], ["entity", "term", "both", "support"])

    both = rows.select("body", "marks", "entity", "times", "owned", "held").mapInArrow(met, "entity long, term long, both long, support long")
    both = both.groupBy("entity", "term").agg(F.sum("both").alias("both"), F.sum("support").alias("support")).where(F.col("support") >= least)
    both = written(both.join(of.join(many, "entity"), "entity").where(F.col("support") >= COVER * F.col("evidence")), "disclosing")
    sent = spark.sparkContext.broadcast(_bit_table(both.select("term").distinct()))

    @_text.tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _unpacked(sent)
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offs = _text.buffers(batch.column(0))
            for lo, hi in _text.slabs(offs):
                part = data[offs[lo] : offs[hi]]
                words = _text.find_words(part, offs[lo : hi + 1] - offs[lo], _BLANK)
                hashes = _text.span_hash(part, words.start, words.end, lower=True)
                pick = np.flatnonzero(seen[_slots(hashes)])
                if not len(pick):
                    continue
                new, n = np.unique(_distinct(hashes[pick], words.doc[pick])[0][0], return_counts=True)
                values, place = np.unique(np.concatenate([values, new]), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(values)).astype(np.int64)
            if len(values) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["term", "docs"])
                values, counts = values[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["term", "docs"])

    have = docs.select("text").mapInArrow(counted, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    share = F.col("with_entity") / float(max(docs.count(), 1))
    told = (F.col("both") + SMOOTH * share) / (F.greatest("docs", "both") + SMOOTH)
    return both.join(have, "term").where((share < 1) & (F.log2(told / share) >= SHARE * -F.log2(share))).select("entity", "term")


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """row and terms (sorted distinct spans) of rows with words that disclose one of their entities."""
    spark = docs.sparkSession
    pairs = written(disclosing(docs, found), "pairs")
    few = pairs.count() <= SENT_PAIRS  # 16 bytes each
    tables = [spark.sparkContext.broadcast(_bit_table(pairs.select(c).distinct())) for c in ("entity", "term")]

    @_text.tidy
    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wanted = map(_unpacked, tables)
        for batch in batches:
            out = [[], [], [], [], []]
            for row, body, marks, names in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                names = np.unique(np.array(names, np.int64))
                names = names[seen[_slots(names)]]
                words = [*_terms(body, _spans_of(marks))] if len(names) else []
                hashes = _hashes([w for w, _, _ in words])
                for k in np.flatnonzero(wanted[_slots(hashes)]).tolist():
                    for name in names.tolist():
                        for into, value in zip(out, (row, name, int(hashes[k]), *words[k][1:]), strict=True):
                            into.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.int32()) for c in out[3:])], ["row", "entity", "term", "first", "last"])

    hits = found.where("body is not null").select("row", "body", "marks", "entity").mapInArrow(hit, "row long, entity long, term long, first int, last int")
    hits = hits.join(F.broadcast(pairs) if few else pairs, ["entity", "term"], "left_semi")
    return hits.select("row", F.struct("first", "last").alias("s")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, and spans: base ones, secrets, then terms."""
    bound_batches(docs.sparkSession)
    found = written(find(docs), "found")
    out = found.drop("body", "entity", "context").join(term_spans(docs, found), "row", "left")
    terms = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["first"], F.lit(":"), t["last"])), ",")
    both = F.concat_ws(",", F.when(F.col("marks") != "", F.col("marks")), F.when(F.size("terms") > 0, terms))
    n_term = F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).cast("long")
    n_spans = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_secret") + n_term
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", both.alias("spans"), "n_secret", n_term.alias("n_term"), n_spans.alias("n_spans"))


def sanitize(docs: DataFrame) -> DataFrame:
    """docs with base spans and secrets generalised to [KIND] and disclosing words removed in text.

    Texts are searched once, into a written table; only rows with spans are shuffled, the others go straight through.
    A null text stays null.
    """
    bound_batches(docs.sparkSession)
    found = written(find(docs, whole=True), "found")
    columns = docs.columns

    @_text.tidy
    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            fields = doc.flatten()
            at_text = columns.index("text")
            out = []
            for text, marks, terms in zip(fields[at_text].to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spots = [(a, b, f"[{k.upper()}]") for k, a, b in _spans_of(marks)]
                spots += [(t["first"], t["last"], "") for t in terms or ()]
                parts, at = [], 0
                for a, b, new in sorted(spots, key=lambda m: (m[0], -m[1])):
                    if a >= at:
                        parts += [text[at:a], new]
                    at = max(at, b)
                out.append("".join(parts) + text[at:])
            fields[at_text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, names=columns)], ["doc"])

    plain = found.where("body is null").select("doc")
    private = found.where("body is not null").select("row", "doc", "marks").join(term_spans(docs, found), "row", "left")
    private = private.select("doc", "marks", "terms").mapInArrow(masked, f"doc {dict(found.dtypes)['doc']}")
    return plain.unionByName(private).select("doc.*")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
