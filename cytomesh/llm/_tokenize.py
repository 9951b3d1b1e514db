"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

A text is cut where its tokenizer's own pre-tokeniser always cuts: before a run of ASCII
white space, and between an ASCII letter and ASCII punctuation. A piece's ids then don't
depend on its neighbours, so they are looked up by the piece's hash, and only pieces not
seen before are encoded. Texts with other white space, where such cuts can differ, and texts
that spell one of the tokenizer's added tokens, which the library finds before it cuts, are
encoded whole. tests/llm/ compares the ids with encode_batch on whole texts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from cytomesh.llm import _text

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
#: Lead bytes of white space and separators that are not in the ASCII set, and rare controls.
_ODD_SPACE = tuple(chr(c) for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_ODD_BYTES = tuple(c.encode() for c in _ODD_SPACE)
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[sorted({b[0] for b in _ODD_BYTES})] = True

_SLOT_BITS = 21
_SLOTS = 1 << _SLOT_BITS
_PROBES = 4
_MOST = 1_200_000  # pieces kept by a worker; beyond them it starts anew
_coders: dict[str, "Coder"] = {}


def coder(path: str) -> "Coder":
    """This worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Spellings that need the whole text, in lower case: a normaliser may change it.
        self.added = tuple(sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()}))
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.alphabet = _byte_alphabet()
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(_SLOTS + _PROBES, np.uint64)
        self.entry = np.full(_SLOTS + _PROBES, -1, np.int32)
        self.n = 0
        self.used = 0
        self.offset = np.zeros(1 << 16, np.int32)
        self.length = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)

    def encode_piece(self, piece: str) -> list[int]:
        core = piece[1:] if piece[:1] == " " else piece
        if core.isalpha():  # one pre-token: the model alone gives the ids
            if not self.lower:
                return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]
            if max(core) <= "\xff":  # lower case and NFC change each character alone
                return [t.id for t in self.model.tokenize(core.lower().encode().decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Keep the ids of new pieces; returns their entries."""
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        entry = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        while self.n + len(ids) > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.offset[entry] = self.used + np.cumsum(lengths) - lengths
        self.length[entry] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        home = (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        left = np.arange(len(ids))
        for probe in range(_PROBES):
            slot, first = np.unique(home[left] + probe, return_index=True)
            free = self.entry[slot] < 0
            took = left[first[free]]
            self.keys[slot[free]], self.entry[slot[free]] = keys[took], entry[took]
            left = np.setdiff1d(left, took, assume_unique=True)
        self.keys[home[left]], self.entry[home[left]] = keys[left], entry[left]  # an older piece goes
        return entry

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        home = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = np.where(self.keys[home] == hashes, self.entry[home], -1)
        for probe in range(1, _PROBES):
            left = np.flatnonzero(found < 0)
            if not len(left):
                break
            slot = home[left] + probe
            found[left] = np.where(self.keys[slot] == hashes[left], self.entry[slot], -1)
        return found

    def _slab(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some documents, and the number of ids of each."""
        n = len(data)
        ws = _text._WS[data]
        cut = ws.copy()
        cut[1:] &= ~ws[:-1]
        cut[1:] |= _PUNCT[data[1:]] & _LETTER[data[:-1]]
        cut[offs[:-1][offs[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        hashes = _text.span_hash(data, start, end) | np.uint64(1)
        if self.n > _MOST:
            self.reset()
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            raw = data.tobytes()
            pieces = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[missing[at]].tolist(), end[missing[at]].tolist(), strict=True)]
            entry = self._add(new, [self.encode_piece(p) for p in pieces])
            found[missing] = entry[np.searchsorted(new, hashes[missing])]
        lengths = self.length[found].astype(np.int64)
        ids = self.ids[_text.spread(self.offset[found], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        first = np.searchsorted(start, offs)
        return ids, np.diff(before[first])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (uint32), and the bounds of each text in them."""
        data, offs = _text.buffers(texts)
        parts, counts = [], np.zeros(len(offs) - 1, np.int64)
        for lo, hi in _text.slabs(offs):
            piece = data[offs[lo] : offs[hi]]
            if not self.odd(piece):
                ids, counts[lo:hi] = self._slab(piece, offs[lo : hi + 1] - offs[lo])
                parts.append(ids)
                continue
            for i in range(lo, hi):
                text = data[offs[i] : offs[i + 1]]
                if self.odd(text):
                    ids = np.array(self.tokenizer.encode(text.tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                    counts[i] = len(ids)
                else:
                    ids, count = self._slab(text, np.array([0, len(text)]))
                    counts[i] = count[0]
                parts.append(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def odd(self, text: np.ndarray) -> bool:
        """Whether the text has odd white space or spells an added token."""
        raw = text.tobytes()
        if _ODD_LEAD[text].any() and any(b in raw for b in _ODD_BYTES):
            return True
        low = raw.lower()
        return any(t in low for t in self.added)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each document, and the new bounds."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, np.uint32)
    new = bounds + np.arange(n + 1)
    last = new[1:] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end_id
    return out, new
