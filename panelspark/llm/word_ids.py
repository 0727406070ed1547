"""Token ids of texts by the tokenizers library, one call per distinct word.

A batch's words are found and hashed by numpy and looked up in a table of fixed size (96 bits tell words apart);
only new ones go to the library, and ids are copied by offsets.

This is right for tokenizers that drop white space and never match across it, which is tried out on the file first;
with any other file whole texts go to the library. If the file's normalizer and pre-tokenizer are those of `LOWER` and
`PATTERN`, words of Latin letters, digits and plain signs are cut and lower-cased in numpy too, and their pieces go
straight to the file's merge model; all other words go the whole way.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from panelspark.llm.common import IS_BLANK
from panelspark.llm.spans import gather, utf8, word_hashes, word_spans

SLOTS = 22                 # bits; the table takes 24 bytes a slot, in use or not
FULL = 0.6
POOL = 32 << 20            # ids kept; when they or the slots are used up, the table starts anew
LONG = 64                  # bytes; longer words are not kept
PROBES = ["a b", " it's  fine,(x)", "Ünïcode\tØ 日本 !", "12 3\n45", "don't ...a b'll", "A  B́", "x\n\n <y>"]

# fixed values of the public format: the parts that the shortcut stands for
LOWER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# its byte-level alphabet: visible bytes stand for themselves, the others for code points from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(256, ODD, np.uint8)
KIND[33:127] = SIGN
KIND[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER  # 0xC3 begins the letters from À to ÿ
KIND[48:58] = DIGIT
KIND[[ord("'"), ord("<")]] = ODD  # contractions and special tokens
KIND[IS_BLANK] = BLANK
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


def latin_pieces(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end) of the pieces of words; a word with an odd byte stays whole and as it is."""
    kind, low = KIND[buf], buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    second = np.flatnonzero(buf[:-1] == 0xC3) + 1
    x = buf[second]
    sign = (x == 0x97) | (x == 0xB7)
    kind[second] = np.where(sign, ODD, LETTER)
    low[second[(x < 0x9F) & ~sign]] += 32
    odd = np.concatenate(([0], np.cumsum(kind == ODD)))
    whole = odd[end] > odd[start]
    cut = np.empty(len(buf), bool)
    cut[0:1] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut &= kind != BLANK
    if whole.any():
        at = gather(start[whole], (end - start)[whole])
        low[at], cut[at] = buf[at], False
    cut[start] = True
    begin = np.flatnonzero(cut)
    word = np.searchsorted(start, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], len(buf)), end[word])
    return low, begin, stop


class WordIds:
    def __init__(self, path: str, slots: int = SLOTS, pool: int = POOL):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.slots, self.most = slots, pool
        parts = json.loads(self.tok.to_str())
        self.by_word = all(self._whole(p) == [i for w in p.encode().split() for i in self._whole(w.decode())] for p in PROBES)
        self.by_piece = (self.by_word and parts["normalizer"] == LOWER and parts["pre_tokenizer"] == PATTERN and parts["model"]["type"] == "BPE"
                         and not parts["post_processor"] and all("<" in t["content"] and not t["normalized"] for t in parts["added_tokens"]))
        self._clear()

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        n = 1 << self.slots
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.at, self.n = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.pool, self.filled, self.used = np.zeros(1 << 20, np.uint32), 0, 0

    # ---- the library

    def _learn(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word or piece."""
        out: list[list[int]] = [[]] * len(words)
        rest = range(len(words))
        if self.by_piece:
            rest, tokenize, match = [], self.tok.model.tokenize, LATIN.fullmatch
            for k, w in enumerate(words):
                if w.isalpha() and w.islower():
                    out[k] = [t.id for t in tokenize(w.decode())]
                elif match(w):
                    out[k] = [t.id for t in tokenize(w.decode("latin-1").translate(ALPHABET))]
                else:
                    rest.append(k)
        for k, e in zip(rest, self.tok.encode_batch_fast([words[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    # ---- the table: open addressing, in whole arrays

    def _find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not kept."""
        mask = (1 << self.slots) - 1
        slot = (h >> np.uint64(64 - self.slots)).astype(np.int64)
        k = self.key[slot]
        hit = (k == h) & (self.check[slot] == c)
        out = np.where(hit, slot, -1)
        todo = np.flatnonzero(~hit & (k != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            k = self.key[slot[todo]]
            hit = (k == h[todo]) & (self.check[slot[todo]] == c[todo])
            out[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit & (k != 0)]
        return out

    def _insert(self, h: np.ndarray, c: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.filled], np.zeros(max(len(flat), self.filled, 1 << 20), np.uint32)])
        self.pool[self.filled: self.filled + len(flat)] = flat
        at = self.filled + np.cumsum(n) - n
        self.filled, self.used = self.filled + len(flat), self.used + len(h)
        mask, slot, todo = (1 << self.slots) - 1, (h >> np.uint64(64 - self.slots)).astype(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.key[s] == 0
            t, s = todo[free], s[free]
            self.key[s], self.check[s], self.at[s], self.n[s] = h[t], c[t], at[t], n[t]
            mine = (self.key[slot[todo]] == h[todo]) & (self.check[slot[todo]] == c[todo])  # of those that met in a slot, one stays
            s = slot[todo[mine]]
            self.at[s], self.n[s] = at[todo[mine]], n[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & mask

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (one more at the end)."""
        if not self.by_word:
            texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(got)), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int64)
        start, end, first = word_spans(buf, offsets, IS_BLANK)
        if self.by_piece and len(start):
            buf, start, end = latin_pieces(buf, start, end)
            first = np.searchsorted(start, offsets)
        h, c = word_hashes(buf, start, end)
        h, c = h | np.uint64(1), (c >> np.uint64(32)).astype(np.uint32)
        slot = self._find(h, c)
        miss = np.flatnonzero(slot < 0)
        extra = np.zeros(0, np.uint32)
        at, n = self.at[slot], self.n[slot].astype(np.int64)
        if len(miss):
            order = miss[np.lexsort((c[miss], h[miss]))]
            fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])))
            new, which = order[fresh], np.cumsum(fresh) - 1
            ids = self._learn([buf[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist())])
            size = np.array(list(map(len, ids)), np.int64)
            extra = np.array(list(chain.from_iterable(ids)), np.uint32)
            at[order], n[order] = -1 - (np.cumsum(size) - size)[which], size[which]  # new words point into `extra`
            keep = np.flatnonzero(end[new] - start[new] <= LONG)
        pool, filled = self.pool, self.filled
        if len(extra):
            pool = np.concatenate([self.pool[:filled], extra])
        at = np.where(at < 0, filled - 1 - at, at)
        out = pool[gather(at, n)]
        bound = np.concatenate(([0], np.cumsum(n)))[first].astype(np.int64)
        if len(miss):
            if self.used + len(keep) > FULL * (1 << self.slots) or self.filled > self.most:
                self._clear()
            if len(keep) <= FULL * (1 << self.slots):
                self._insert(h[new[keep]], c[new[keep]], extra[gather((np.cumsum(size) - size)[keep], size[keep])], size[keep])
        return out, bound

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(*utf8(column))


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process, so that what it has learnt serves later tasks."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
