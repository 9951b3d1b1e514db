"""Every operator against a brute-force version on a small table of awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cytomesh.llm import _blocks, decontaminate, language_model, near_dedup, packing, pii, quality, records, substring, token_scan, toxicity
from cytomesh.session import scratch_path

WS = rb"[\x20\x09-\x0D]+"


def words(text):
    return [w.decode() for w in re.split(WS, (text or "").encode()) if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_token_counts(docs, rows, empty):
    got = sorted((r.start, r.n_tokens) for r in token_scan.token_counts(docs, file_bytes=2000).collect())
    assert sorted(n for _, n in got) == sorted(len(words(r[1])) + 1 for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    assert token_scan.token_counts(empty).count() == 0
    encode = token_scan.library_ids(records.tokenizer_path(packing.TOKENIZER))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_scan.token_counts(docs, 2000, encode).collect())
    assert collections.Counter((d, n) for _, d, n in got) == collections.Counter((r[0], len(i)) for r, i in zip(rows, tokens(rows, packing.TOKENIZER)))
    assert [d is not None and d for _, d, _ in got] == sorted(d is not None and d for _, d, _ in got)


def test_scan_stitches_blocks_and_files(spark, tmp_path):
    stream = np.array([5, 1, 7, 8, 9, 1, 1, 4, 4, 4, 4, 1, 3], "<u2")
    for i, part in enumerate(np.split(stream, [3, 4, 9])):
        (tmp_path / f"file={i}").mkdir()
        (tmp_path / f"file={i}" / "part").write_bytes(part.tobytes())
    got = sorted((r.start, r.n_tokens) for r in token_scan.scan_tokens(spark, str(tmp_path), block_tokens=2).collect())
    assert got == [(0, 2), (2, 4), (6, 1), (7, 5)]


def tokens(rows, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(records.tokenizer_path(name))
    return [[*e.ids, 1] for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def hot_rows():
    """Two thirds of the rows have one doc_id or none."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    shared = prose(30)
    return [(7 if i % 3 == 0 else None if i % 3 == 1 else i, prose(int(rng.integers(5, 60))) + (" " + shared) * (i % 5 == 0)) for i in range(150)]


def test_hot_ids(spark, empty, monkeypatch):
    rows = hot_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(_blocks, "FLAT", 6)
    ranges = _blocks.range_bounds(docs, 1500)
    numbers = collections.Counter(n for r in rows for n in ranges.of(pa.array([r[0]], pa.int64()), pa.array([zlib.crc32(r[1].encode())])).tolist())
    assert ranges.count > 12 and max(numbers.values()) < 30 and len({n for r in rows if r[0] == 7 for n in ranges.of(pa.array([7]), pa.array([zlib.crc32(r[1].encode())])).tolist()}) > 3
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_scan.token_counts(docs, file_bytes=1500).collect())
    assert collections.Counter((d, n) for _, n, d in got) == collections.Counter((r[0], len(words(r[1])) + 1) for r in rows)
    assert [d for *_, d in got if d is not None] == sorted(r[0] for r in rows if r[0] is not None) and all(a + n == b for (a, n, _), (b, *_) in zip(got, got[1:]))
    test_substring_dedup(docs, rows, empty, 1500)
    path = scratch_path(spark, "records")
    records.write_records(docs, path, records.tokenizer_path(records.TOKENIZER), file_bytes=1500)
    read = records.read_records(spark, path).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in read) == collections.Counter((r[0], crc(i)) for r, i in zip(rows, tokens(rows, records.TOKENIZER)))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(read, read[1:]))


def test_records_round_trip(spark, docs, rows, empty):
    path = scratch_path(spark, "records")
    records.write_records(docs, path, records.tokenizer_path(records.TOKENIZER), file_bytes=3000)
    got = records.read_records(spark, path).orderBy("start").collect()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    want = collections.Counter((r[0], len(i), crc(i)) for r, i in zip(rows, tokens(rows, records.TOKENIZER)))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    index = spark.read.parquet(f"{path}/index")
    fetched = records.fetch(spark, path, index.select("file", "offset", "length").where("doc_id in (5, 9)")).collect()
    ids = {r[0]: i for r, i in zip(rows, tokens(rows, records.TOKENIZER))}
    assert sorted(r.doc_id for r in fetched) == [5, 5, 9] and all(list(r.ids) == ids[r.doc_id] for r in fetched)
    path = scratch_path(spark, "records")
    records.write_records(empty, path, records.tokenizer_path(records.TOKENIZER))
    assert records.read_records(spark, path).count() == 0


def test_damaged_record_is_noticed():
    good = records.frame(b"payload") + b"\n"
    assert [bytes(p) for _, p in records.frames(good)] == [b"payload"]
    for i in range(len(good)):
        with pytest.raises(ValueError):
            list(records.frames(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]))


def test_packing(docs, rows, empty):
    got = packing.pack(docs, packing.tokenizer_path(packing.TOKENIZER), sequence=64).collect()
    by_text = collections.Counter((r[0], len(i)) for r, i in zip(rows, tokens(rows, packing.TOKENIZER)))
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == by_text
    ids = {r[0]: i for r, i in zip(rows, tokens(rows, packing.TOKENIZER))}
    assert all(crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in places:
        assert s * 64 + o == at
        at += n
    assert at == sum(n for _, n in by_text.elements())
    assert packing.pack(empty, packing.tokenizer_path(packing.TOKENIZER)).count() == 0


def shingles(text):
    w = lower(text).encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs, rows, empty):
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    label = {i: i for i, _ in sets}
    for _ in range(4):
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= 75 * len(s | t):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (label[r.doc_id], label[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(dict(sets)[r.doc_id])
    assert near_dedup.near_duplicates(empty).count() == 0


def test_neighbours_cover_a_dense_region():
    n = 100
    u, v = near_dedup.neighbours(np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n))
    assert {(i, i + 1) for i in range(n - 1)} <= set(zip(u.tolist(), v.tolist())) and len(u) < 4 * n


def test_one_heavily_edited_copy_in_a_dense_region(spark):
    """A copy at 0.76 of the original, below 0.75 of the 2000 light copies around it."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(304)]
    heavy = range(10, 90, 10)
    texts = [base, [f"x{i}" if i in heavy else w for i, w in enumerate(base)]]
    for k in range(2000):
        light = rng.sample(range(110, 300, 8), 2)
        texts.append([f"m{k}x{i}" if i in light else w for i, w in enumerate(base)])
    sets = [shingles(" ".join(t)) for t in texts]
    alike = [100 * len(sets[1] & s) >= 75 * len(sets[1] | s) for s in sets]
    assert alike[:2] == [True, True] and not any(alike[2:])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize(("count", "edits"), [(400, 16), (400, 17)])
def test_templated_pages(spark, count, edits):
    """Pages of one template near the threshold: the components of all pairs, however dense the region."""
    rng = np.random.default_rng(count + edits)
    base = [f"t{i}" for i in range(0, 1000)]
    texts = []
    for d in range(count):
        w = [" ".join(base[5 * i : 5 * i + 5]) for i in range(200)]
        for i in rng.choice(200, edits, replace=False):
            w[i] = f"n{d}x{i}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    hit = np.zeros((count, len(number)), np.float32)
    for i, s in enumerate(sets):
        hit[i, [number[g] for g in s]] = 1
    both = hit @ hit.T
    size = hit.sum(axis=1)
    linked = 100 * both >= 75 * (size[:, None] + size[None] - both)
    label = np.arange(count)
    for _ in range(count):
        new = np.where(linked, label[None], count).min(axis=1)
        if (new == label).all():
            break
        label = new
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(count)] == label.tolist()
    i, j = np.nonzero(np.triu(linked, 1))  # every linked pair is in one component
    assert all(got[a] == got[b] for a, b in zip(i.tolist(), j.tolist()))


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(26, 50)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs, labels).collect()}
    for doc_id, text, *_ in rows:
        w = words(text)
        r = got[doc_id, len(w)]
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.kept and r.base_failed)
    assert quality.keep(docs, labels).columns == docs.columns
    assert quality.judge(empty, labels.limit(0)).count() == 0


def test_personal_data(docs, rows, empty):
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for doc_id, text, *_ in rows:
        base = pii.base_spans(text or "")
        r = got[doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        for kind, p in pattern.items():
            assert [(a, b) for k, a, b in base if k == kind] == [m.span() for m in re.finditer(p, text or "") if kind == "email" or 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    told = [i for i, t, *_ in rows if t and "secretword" in t]
    assert told and all(",term:" in got[i].spans for i in told)  # always beside the same address
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert pii.sanitize(docs).count() == len(rows) and clean[0] is None
    assert all("secretword" not in clean[i] and "[EMAIL]" in clean[i] for i in told)
    assert pii.spans(empty).count() == 0 and pii.sanitize(empty).columns == empty.columns


def test_disclosing_words_go_from_whole_documents(spark):
    filler = lambda i, n: " ".join(f"fill{i}x{j}" for j in range(n))
    texts = [f"Codename opens. {filler(i, 20)} mail boss@corp.example.org now {filler(100 + i, 20)}" for i in range(4)]
    texts += [f"{filler(200, 30)} codename, alone {filler(201, 30)}"] + [filler(300 + i, 30) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in pii.spans(docs).collect()}
    for i in range(4):
        at = texts[i].lower().index("codename")
        assert f"term:{at}:{at + 8}" in got[i].split(",")
    assert not any(got[i] for i in range(4, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert not any("codename" in clean[i].lower() for i in range(4)) and clean[4] == texts[4]


def test_words_that_give_a_kind_away(spark):
    """Random prose with tokens and passwords, as in the given tables: the words beside them tell of a secret."""
    rng = np.random.default_rng(6)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    texts = [prose(80) for _ in range(400)] + [f'{prose(30)} token = "{key(40)}" {prose(30)}' for _ in range(15)]
    texts += [f"{prose(30)} password=cc7{key(15)} {prose(30)}" for _ in range(15)] + [f"{prose(20)} AKIA{key(14).upper()}Z7 {prose(9)}" for _ in range(9)]
    texts += [f"{prose(20)} 10.0.{i}.7 {prose(20)}" for i in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    for i, t in enumerate(texts):
        at = [t.index(w) for w in ("token", "password") if w in t]
        assert [s for s in got[i].spans.split(",") if s.startswith("term")] == [f"term:{a}:{a + len(w)}" for a, w in zip(at, [w for w in ("token", "password") if w in t])]
        assert got[i].n_secret == (400 <= i < 439) and got[i].n_ip == (i >= 439)
        assert got[i].n_spans == len([s for s in got[i].spans.split(",") if s])


@pytest.mark.parametrize("text", ["a@b", "a@b.c@d.e", "..@x.y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111111111111111 4111111111111112", "4111-1111 1111-1111", "+1 2", "+1 (800) 555-0199.", "@@a@b.c"])
def test_base_patterns(text):
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            want.append(("card", *m.span()))
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    assert pii.base_spans(text) == want


def test_decontamination(spark, docs, rows, empty):
    passage = next(t for _, t, *_ in rows if t and len(words(t)) == 60)
    items = spark.createDataFrame([(1, passage), (1, passage), (2, "too short"), (3, None), (4, "entirely other words that nobody wrote anywhere in here at all"), (5, "one TWO"), (6, "two"), (None, passage)], "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, items).collect())
    want = collections.Counter((i, k, 0) for i, t, *_ in rows if t and passage in t for k in (1, None))
    want += collections.Counter((i, 5, 0) for i, t, *_ in rows if lower(t).split() == ["one", "two"])
    want += collections.Counter((i, 6, 0) for i, t, *_ in rows for w in re.split("[^a-z0-9\x80-\U0010ffff]+", lower(t)) if w == "two")
    assert got == want
    blocked = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, items, item_block=2).collect())
    assert blocked == got
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0
    clean = decontaminate.clean(docs, items)
    hit = {(i, r) for i, _, r in got}
    assert clean.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter(r[:2] for r in rows if not any(k[0] == r[0] for k in got))
    assert hit


def test_edited_passages_against_all_windows():
    """Documents found, and the least distance of each, against an edit distance over every window."""
    rng = np.random.default_rng(3)
    vocab = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    texts = [" ".join(f"w{rng.integers(300)}" for _ in range(rng.integers(8, 40))) for _ in range(12)]
    items = decontaminate.prepare(list(range(12)), texts)
    seeds = decontaminate._packed.Filter(items.seeds, 20)
    parts = []
    for _ in range(60):
        target = list(items.words[rng.integers(12)])
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(len(target)))
            target[at : at + 1] = [[], [rng.choice(vocab)], [target[at], rng.choice(vocab)]][rng.integers(3)]
        parts.append(np.concatenate([rng.choice(vocab, 25), np.array([int(x) for x in target], np.uint64), rng.choice(vocab, 25)]))
    first = np.cumsum([0, *map(len, parts)])
    got = {}
    for d, item, _, _, distance in decontaminate.search(items, np.concatenate(parts), first, seeds):
        got[d, item] = min(distance, got.get((d, item), 99))
    want = {}
    for d, part in enumerate(parts):
        for item, target in enumerate(items.words):
            least = decontaminate.passage_distance(target, part)[0]
            if least <= int(0.15 * len(target) + 1e-9):
                want[d, item] = least
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 20
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)


@pytest.mark.parametrize("share", [0.05, 0.15])
def test_edited_passages_are_found(share):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{rng.integers(400)}" for _ in range(rng.integers(15, 60))) for _ in range(40)]
    items = decontaminate.prepare(list(range(40)), texts)
    seeds = decontaminate._packed.Filter(items.seeds, 20)
    found = 0
    for i, target in enumerate(items.words):
        text = list(target)
        for _ in range(int(share * len(text))):
            at = int(rng.integers(len(text)))
            text[at : at + 1] = [[], [rng.integers(1 << 62)], [text[at], rng.integers(1 << 62)]][rng.integers(3)]
        around = [rng.integers(1 << 62, size=40).astype(np.uint64) for _ in range(2)]
        text = np.concatenate([around[0], np.array([int(x) for x in text], np.uint64), around[1]])
        found += any(r[1] == i for r in decontaminate.search(items, text, np.array([0, len(text)]), seeds))
    assert found >= 38


@pytest.mark.parametrize("known_words", [1 << 20, 30])
def test_language_model(docs, rows, empty, known_words):
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    text = lambda r: [*lower(r[1]).encode().split(), None]
    counts = collections.Counter(t for r in rows if train(r[0]) for t in text(r))
    n, v = sum(counts.values()), len(counts)
    got = language_model.score(docs, known_words=known_words).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(set)
    for r in rows:
        want[r[0]].add((len(text(r)), sum(counts[t] > 0 for t in text(r)), round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in text(r)), 6)))
    for r in got:
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) in want[r.doc_id]
        assert r.train_tokens == n and r.held_out == (not train(r.doc_id)) and r.score < 0
    again = language_model.score(docs.repartition(7), known_words=known_words).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score)
    assert [r.score for r in sorted(again, key=key)] == pytest.approx([r.score for r in sorted(got, key=key)], rel=1e-9)
    assert language_model.score(empty).count() == 0


def chained(n, seed):
    """Texts in which a word tells the next one, of many words that are equally frequent."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = [int(rng.integers(40))]
        for _ in range(80):
            w.append((w[-1] * 7 + 3) % 40 if rng.random() < 0.9 else int(rng.integers(40)))
        out.append((i, " ".join(f"word{x}" for x in w)))
    return out


def test_language_model_learns_context_inside_a_class(spark):
    made = chained(400, 1)
    shuffled = [(1000 + i, " ".join(np.random.default_rng(i).permutation(t.split()))) for i, t in made[:100]]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    sent, *_ = language_model.fit(docs.withColumn("held", language_model.held_out(7, 2)))

    def mean(rows):
        total = n = 0
        for _, t in rows:
            hashes, first = language_model.tokens(*language_model._text.buffers(pa.array([t])))
            _, codes = sent.coded(hashes)
            total += (sent.log10(codes, language_model.features_of(hashes, first)) + np.log10(sent.coded(hashes)[0] + 1.0) - sent.leaf_log[codes]).sum()
            n += len(hashes)
        return total / n

    held = [r for r in made if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    assert mean(held) > -math.log10(40) + 0.4  # the base knows 40 equal words
    assert mean(held) > mean(shuffled) + 0.4


def test_language_model_is_a_distribution():
    """The probabilities of all words and of UNSEEN unseen ones sum to 1 in any context."""
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(1, 1 << 63, 300, dtype=np.uint64))
    counts = rng.integers(1, 50, 300)
    model = language_model.Model(words, counts, 0, 0)
    model.class_weights += rng.normal(size=model.class_weights.shape).astype(np.float32)
    model.choice_weights += rng.normal(size=model.choice_weights.shape).astype(np.float32)
    unseen = np.arange(language_model.UNSEEN, dtype=np.uint64) * np.uint64(2**40) + np.uint64(7)
    all_words = np.concatenate([words, unseen])
    have, codes = model.coded(all_words)
    context = np.repeat(rng.integers(1, 1 << 63, (language_model.FEATURES, 1), dtype=np.uint64), len(all_words), axis=1)
    total = 10 ** (model.log10(codes, context) + np.log10(have + 1.0) - model.leaf_log[codes])
    assert total.sum() == pytest.approx(1, rel=1e-4)


def test_toxicity_learns_subwords(spark, empty):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    made = []
    for i in range(600):
        w = [word() for _ in range(rng.randrange(20, 80))]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zwixor", "zwixors", "zwixxor", "quavvek", "quavek"])
        made.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in made], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    truth = {i: x for i, _, x in made}
    held = [r for r in toxicity.score(docs, model).collect() if r.held_out]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_scores_word_by_word(docs, rows):
    """Scores of the awkward rows against subwords spelt out one by one."""
    rng = np.random.default_rng(4)
    model = toxicity.Classifier(-0.3)
    model.direction, model.bias = rng.normal(size=toxicity.DIMENSIONS), 0.2
    along = model.along()
    letters, mask = toxicity._LETTER.tolist(), 2**64 - 1

    def bucket(gram):
        h = letters[gram[0]]
        for c in gram[1:]:
            h = (h * int(toxicity._STEP) + letters[c]) & mask
        return (h * int(toxicity._LAST) & mask) >> (64 - toxicity.BITS)

    def want(text):
        found = []
        for w in (text or "").encode().split():
            found += [bucket(w[i : i + k]) for k in (3, 4, 5) for i in range(len(w) - k + 1)]
            data = np.frombuffer(w, np.uint8)
            found.append(int(toxicity._text.span_hash(data, np.array([0]), np.array([len(w)]), lower=True)[0] >> np.uint64(64 - toxicity.BITS)))
        logit = along[found].astype(np.float32).astype(float).mean() + model.bias + model.prior if found else model.prior
        return 1 / (1 + math.exp(-max(-700, min(700, logit))))

    got = toxicity.score(docs, model).collect()
    pairs = collections.Counter((r.doc_id, round(r.score, 5), r.predicted, r.held_out) for r in got)
    assert pairs == collections.Counter((i, round(want(t), 5), int(want(t) >= 0.5), i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, t, *_ in rows)


def test_substring_dedup(docs, rows, empty, block_bytes=1500):
    first = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    got = collections.defaultdict(list)
    for r in substring.remove_repeats(docs, block_bytes=block_bytes).collect():
        got[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        w = words(text)
        gone = {i + j for i in range(len(w) - 12) if doc_id is not None and first[tuple(w[i : i + 13])] < doc_id for j in range(13)}
        want = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
        r = next(r for r in got[doc_id] if (r.n_words, r.n_removed, r.kept) == want)
        got[doc_id].remove(r)
        assert {i for s in r.repeats for i in range(s.first, s.first + s.words)} == gone
    assert not any(got.values()) and substring.remove_repeats(empty).count() == 0


def test_tokens_of_extremes():
    from tokenizers import Tokenizer

    from cytomesh.llm import _tokenize

    texts = ["a<|endoftext|>b", "hello <|startoftext|> world", "<|ENDOFTEXT|>x <|endoftext|>", "plain | <| text", "", "a" * 50_000, "word " * 30_000, "\n" * 1000, "éé, ÀB.c;d'em", "x y", "'s 't we'll don't"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = _tokenize.coder(records.tokenizer_path(name))
        ids, cuts = coder.encode(pa.array(texts))
        for i, e in enumerate(Tokenizer.from_file(records.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == e.ids
