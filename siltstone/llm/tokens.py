"""Tokenising whole texts with the ``tokenizers`` library, fast enough for a corpus.

Both supported kinds of vocabulary cut a text into pieces before any merge, and every cut used here is one that the
tokenizer itself always makes, so the ids of a text are the ids of its pieces in a row. Pieces met before are looked
up, all of a group of texts at once; the library encodes the new ones of the group in one call and their ids are dealt
back by byte lengths. If the lengths don't add up (odd characters), or the tokenizer is of another kind, the library
gets the pieces or texts one by one; so it does texts that spell a special token.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .common import _MASK, eights, give_back, hash_spans, keep, word_spans

#: Bytes that, behind a space, certainly start a character that isn't white space: printable ASCII, U+00C0 to U+02BF.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_SOLID[0xC3:0xCB] = True


#: Pieces of up to so many bytes are known by arrays, longer ones by a dictionary.
SHORT = 16


class Pieces:
    """Ids of pieces met before, by open addressing on arrays.

    A piece of up to 16 bytes is told by its hash, its length and its first eight bytes. The hash joins eight bytes
    after the other by bijections, so these three settle every byte: no piece is taken for another. Longer pieces are
    keys of a dictionary.
    """

    def __init__(self, dtype: np.dtype, slot_bits: int = 22):
        self.shift, self.slots = np.uint64(64 - slot_bits), 1 << slot_bits
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.head, self.bytes = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint8)
        self.start, self.length = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 20, self.dtype), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def full(self) -> bool:
        return self.count > self.slots * 6 // 10 or self.used > self.slots * 8 or len(self.long) > self.slots // 64

    def _is(self, slot: np.ndarray, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.keys[slot] == h) & (self.head[slot] == head) & (self.bytes[slot] == size)

    def find(self, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each short piece, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        out = np.where(self._is(slot, h, head, size), slot, -1)
        todo = np.flatnonzero((out < 0) & (self.bytes[slot] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % self.slots
            hit = self._is(slot[todo], h[todo], head[todo], size[todo])
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (self.bytes[slot[todo]] != 0)]
        return out

    def store(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """New short pieces of different hashes; piece i has the ids before ``ends[i]`` and behind the last one's."""
        base = self.store(ids)
        slot, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.bytes[slot[todo]] == 0]
            at = slot[free]
            self.keys[at], self.head[at], self.bytes[at] = h[free], head[free], size[free]
            todo = todo[~self._is(slot[todo], h[todo], head[todo], size[todo])]
            slot[todo] = (slot[todo] + 1) % self.slots
        starts = np.concatenate([[0], ends[:-1]])
        self.start[slot], self.length[slot] = starts + base, ends - starts
        self.count += len(h)


class Encoder:
    """``encode(parts)``: UTF-8 texts → (their ids in a row, number of ids up to and with each text, led by 0).

    ``special``: strings in a text that spell special tokens become those tokens (the library's own default); without
    it they are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not special
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        # ignoring case: a normalizer may change it before tokens are sought
        self.spelled = re.compile("|".join(map(re.escape, sorted(added))).encode(), re.IGNORECASE) if special and added else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.kind = self._kind(spec)
        ending = (spec["model"].get("end_of_word_suffix") or "") if self.kind == "words" else ""
        self.size = np.zeros(self.vocabulary, np.int64)
        for token, i in spec["model"].get("vocab", {}).items() if self.kind else ():
            self.size[i] = len(token) - (len(ending) if ending and token.endswith(ending) else 0)
        # words repeat more than pieces with what surrounds them
        self.pieces = Pieces(self.dtype, 20 if self.kind == "words" else 22)
        del spec
        give_back()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"].get("type") != "BPE":
            return ""
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "lead"
        steps = pre.get("pretokenizers", [])
        if steps and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[-1].get("type") == "ByteLevel":
            return "words"
        return ""

    def _one_by_one(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.lib.encode_batch_fast(batch, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in found]) if found else np.zeros(0, np.int64)
        return np.array([i for x in found for i in x], self.dtype), ends

    def _new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that the tokenizer keeps apart when they follow each other."""
        words = self.kind == "words"
        if words:
            lengths = [len(p) if p.isascii() else len(unicodedata.normalize("NFC", p.decode()).lower().encode()) for p in pieces]
        else:
            lengths = list(map(len, pieces))
        joined = (b" " if words else b"").join(pieces).decode()
        ids = np.array(self.lib.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        reach, at = np.cumsum(self.size[ids]), np.cumsum(lengths)
        ends = np.searchsorted(reach, at) + 1
        if len(reach) and reach[-1] == at[-1] and (reach[ends - 1] == at).all():
            return ids, ends
        return self._one_by_one([p.decode() for p in pieces])

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        keep("encoders", _encoders.clear)
        if not self.kind:
            ids, ends = self._one_by_one([p.decode() for p in parts])
            return ids, np.concatenate([[0], ends]).astype(np.int64)
        odd = [i for i, p in enumerate(parts) if self.spelled.search(p)] if self.spelled else []
        if not odd:
            return self._by_pieces(parts)
        ids, reach = self._by_pieces([b"" if i in set(odd) else p for i, p in enumerate(parts)])
        found, ends = self._one_by_one([parts[i].decode() for i in odd])
        n = np.diff(reach)
        n[odd] = np.diff(ends, prepend=0)
        return np.insert(ids, np.repeat(reach[odd], n[odd]), found), np.concatenate([[0], np.cumsum(n)])

    def _by_pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw, starts, ends, bounds = (word_spans if self.kind == "words" else _lead_spans)(parts)
        known = self.pieces
        if known.full():
            known.clear()
        size = ends - starts
        first, length = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        text = raw.tobytes()
        long = np.flatnonzero(size > SHORT)
        spans = [text[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        new = [x for x in dict.fromkeys(spans) if x not in known.long]
        for alone in (False, True):
            if some := [x for x in new if (self.kind == "lead" and x[:1] != b" ") == alone]:
                ids, reach = self._one_by_one([x.decode() for x in some]) if alone else self._new(some)
                at = known.store(ids) + np.concatenate([[0], reach])
                known.long |= {x: (int(a), int(b - a)) for x, a, b in zip(some, at, at[1:], strict=False)}
        if len(long):
            first[long], length[long] = np.array([known.long[x] for x in spans]).T
        short = np.flatnonzero(size <= SHORT)
        s, e, n = starts[short], ends[short], size[short]
        h, head = hash_spans(raw, s, e), eights(raw)[s] & _MASK[np.minimum(n, 8)]
        slot = known.find(h, head, n)
        while len(lost := np.flatnonzero(slot < 0)):
            _, pick = np.unique(h[lost], return_index=True)
            pick = lost[np.sort(pick)]
            alone = raw[s[pick]] != 32 if self.kind == "lead" else np.zeros(len(pick), bool)
            for some, get in ((pick[~alone], self._new), (pick[alone], lambda x: self._one_by_one([p.decode() for p in x]))):
                if len(some):
                    known.add(h[some], head[some], n[some], *get([text[a:b] for a, b in zip(s[some].tolist(), e[some].tolist(), strict=True)]))
            slot[lost] = known.find(h[lost], head[lost], n[lost])
        first[short], length[short] = known.start[slot], known.length[slot]
        reach = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(first - reach[:-1], length) + np.arange(reach[-1])
        return known.pool[at], reach[bounds]


def _lead_spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b"".join(parts), np.uint8)
    reach = np.concatenate([[0], np.cumsum(sizes)])
    cut = np.zeros(len(raw) + 1, bool)
    cut[: max(0, len(raw) - 1)] = (raw[:-1] == 32) & _SOLID[raw[1:]]
    cut[reach] = True
    edge = np.flatnonzero(cut)
    return raw, edge[:-1], edge[1:], np.searchsorted(edge, reach)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task, and with it the pieces it has met."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]
