"""SentencePiece encoding and decoding by a Viterbi pass that words with a common beginning share.

Spaces become marks, and a text falls into marked words, since no piece reaches from a word into the next mark
(checked when the model is loaded). The distinct words of a batch are sorted, which lays out their trie in depth-first
order: for each word the forward scores up to its common prefix with the word before are still valid, and only the
rest is extended. A unigram model takes the best-scoring path. In a BPE model a piece may only follow another if
merging both together would leave them apart; under that rule every prefix has exactly one path, the merge result, so
ids equal the library's for either kind.

Characters outside the vocabulary become bytes. Decoding joins pieces and bytes and takes the mark in front away.

Cases: null and empty texts have no ids; a text with a literal mark (U+2581) decodes to a space there, so its round
trip is false; repeated rows get equal results; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import slices

MARK = "▁"
KEPT = 300_000
UNKNOWN = -1
INF = float("inf")


class Pieces:
    """A SentencePiece model file and the forward pass over it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models with an identity normalizer and a mark in front are supported")
        self.unigram = proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM
        kinds = pb.ModelProto.SentencePiece
        self.names = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece spans words")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.unk_score = min(self.score[i] for i in self.id.values()) - 10
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)
                    else b"" for p in proto.pieces]
        self.longest: dict[str, int] = {}
        for p in self.id:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, bytes] = {}   # words in use, and those of the time before
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.chains: dict[int, tuple] = {}

    # ---- which BPE pieces may be neighbours

    def _merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The merge procedure itself, on a few characters; also the last pair merged."""
        last = None
        while len(symbols) > 1:
            best, at = -INF, -1
            for i in range(len(symbols) - 1):
                k = self.id.get(symbols[i] + symbols[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            last = (symbols[at], symbols[at + 1])
            symbols[at:at + 2] = ["".join(last)]
        return symbols, last

    def _chain(self, piece: int) -> tuple[list[int], list[int]] | None:
        """Symbols at the piece's right edge and at its left edge, from a character up to the whole; None if merging never makes it."""
        if piece not in self.chains:
            name = self.names[piece]
            symbols, last = self._merge(list(name))
            if len(symbols) > 1:
                self.chains[piece] = None
            elif last is None:
                self.chains[piece] = ([piece], [piece])
            else:
                a, b = self._chain(self.id[last[0]]) if last[0] in self.id else None, self._chain(self.id[last[1]]) if last[1] in self.id else None
                # a single character outside the vocabulary can be an edge; it takes part in no other merge
                right = (b[0] if b else []) + [piece]
                left = (a[1] if a else []) + [piece]
                self.chains[piece] = (right, left)
        return self.chains[piece]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging a and b's characters together ends in a, b: at no time is a merge across their border due before the next one on either side."""
        key = a * len(self.names) + b
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            out = self.pairs[key] = self._apart(a, b)
        return out

    def _apart(self, a: int, b: int) -> bool:
        ca, cb = self._chain(a), self._chain(b)
        if ca is None or cb is None:
            return False
        right, left, i, j = ca[0], cb[1], 0, 0
        while True:
            next_a = self.score[right[i + 1]] if i + 1 < len(right) else -INF
            next_b = self.score[left[j + 1]] if j + 1 < len(left) else -INF
            cross = self.id.get(self.names[right[i]] + self.names[left[j]])
            if cross is not None:
                s = self.score[cross]
                # of equals the leftmost goes first
                if s > next_a and s >= next_b:
                    return False
            if next_a == -INF and next_b == -INF:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    # ---- the forward pass

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (uint32) of sorted distinct marked words."""
        get, longest, score, apart, unigram = self.id.get, self.longest, self.score, self.apart, self.unigram
        total, piece, start = [0.0], [UNKNOWN], [0]  # best path to each prefix of the current word
        out, before = [], ""
        for w in words:
            n, same = len(w), 0
            top = min(n, len(before))
            while same < top and w[same] == before[same]:
                same += 1
            before = w
            del total[same + 1:], piece[same + 1:], start[same + 1:]
            for i in range(same + 1, n + 1):
                best, which, begin = -INF, UNKNOWN, i - 1
                for j in range(max(0, i - longest.get(w[i - 1], 0)), i):
                    k = get(w[j:i])
                    if k is not None:
                        if unigram:
                            s = total[j] + score[k]
                            if s > best:
                                best, which, begin = s, k, j
                        elif (piece[j] < 0 or apart(piece[j], k)) and self._chain(k) is not None:
                            best, which, begin = total[j] + score[k], k, j
                            break
                if which < 0:
                    best = total[i - 1] + self.unk_score
                total.append(best)
                piece.append(which)
                start.append(begin)
            ids, i = [], n
            while i:
                if piece[i] >= 0:
                    ids.append(piece[i])
                elif self.byte:
                    ids.extend(self.byte[x] for x in reversed(w[i - 1].encode("utf-8", "surrogatepass")))
                else:
                    ids.append(self.unk)
                i = start[i]
            ids.reverse()
            out.append(array("I", ids).tobytes())
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids per text."""
        split = []
        for t in texts:
            words = ("" if t is None else t.replace(MARK, " ")).split(" ")
            if "" in words and t:
                # runs of spaces: marks gather at the front of the next word
                words = [x[1:] for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(words))]
            split.append(words if t else [])
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        new = set().union(*split).difference(self.known)
        again = new.intersection(self.older)
        self.known |= [(w, self.older[w]) for w in again]
        new = sorted(new - again)
        spaced = [w for w in new if not w or w[0] == MARK]
        plain = [w for w in new if w and w[0] != MARK]
        self.known |= zip(plain, self.encode_words([MARK + w for w in plain]))
        for w in spaced:
            # marks alone or in a run: the library counts these from the same start
            ids = self.processor.encode(w.replace(MARK, " ")) if w else [self.id[MARK]]
            self.known[w] = array("I", ids).tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.uint32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One per worker process."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_decode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_crc32 (little-endian uint32), decoded_sha256, round_trip (the decoded text is the text)."""
    def run(batches):
        m = model(path)
        for b in batches:
            texts = b.column("_text").to_pylist()
            out = []
            for i, j in slices(texts):
                for t, ids in zip(texts[i:j], m.encode(texts[i:j])):
                    back = m.decode(ids)
                    out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
            n, crc, sha, same = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                                             names=["_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    kind = df.schema[doc_id].dataType.simpleString()
    return (df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("_id", doc_id))
