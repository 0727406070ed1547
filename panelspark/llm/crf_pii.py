"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

Patterns (kinds in this order): email, ip, card, phone; each takes its leftmost non-overlapping matches in the whole
text and drops those that fail its test. The field reads runs of words around any digit or @, sees only word shapes
(collapsed character classes, digit counts, the neighbours' shapes), and is trained on a small table of such runs,
labelled by the patterns, from at most `TRAIN_DOCS` texts (smallest hash of id). Tags are decoded by Viterbi, all runs
of a batch at once. A tagged span counts if it touches no pattern span; pattern spans always stay.

Offsets are code points, end exclusive. Cases: a null or empty text has no spans; repeated rows get equal results;
without anything to learn from, the field tags nothing; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelspark.llm.common import Words, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
TRAIN_DOCS, TRAIN_RUNS = 3000, 4000
CONTEXT = 2
ITERATIONS, L2 = 80, 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behind and the atomic runs give the same matches without trying every digit of a long run
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(t: str):
    """Each @ takes the run of local characters before it: the leftmost start that can reach it."""
    begin, at = 0, t.find("@")
    while at >= 0:
        start = begin + len(t[begin:at].rstrip(LOCAL))
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
        begin = m.end() if m else at + 1
        at = t.find("@", begin)


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in _emails(t)]
    for m in IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in PHONE.finditer(t):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


SPECIAL = np.zeros(256, bool)
SPECIAL[[ord(c) for c in "0123456789@"]] = True


def runs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of the runs: words with a digit or @, and CONTEXT words on either side in their text."""
    count = np.concatenate(([0], np.cumsum(SPECIAL[w.buf])))
    mark = np.flatnonzero(count[w.end] > count[w.start])
    if not len(mark):
        return mark, mark
    doc = w.doc_of(mark)
    lo, hi = np.maximum(mark - CONTEXT, w.first[doc]), np.minimum(mark + CONTEXT + 1, w.first[doc + 1])
    new = np.concatenate(([True], (lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])))
    return lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(mark) - 1]))]


def shape(word: str) -> str:
    s = re.sub("[0-9]+", "d", re.sub(r"[^\W\d_]+", "x", word))
    return re.sub(r"(.)\1+", r"\1", s[:64])


def features(word: str, cache: dict[str, tuple]) -> tuple[str, str, str]:
    """The word's own features; neighbours add theirs with a sign of their side."""
    f = cache.get(word)
    if f is None:
        n = sum(c in "0123456789" for c in word)
        size = "0" if n == 0 else "1" if n < 4 else "4" if n < 9 else "9" if n < 12 else "12" if n < 20 else "20"
        f = (f"s={shape(word)}", f"n={size}", f"p={'+' in word}{word.count('.')}{'@' in word}")
        if len(cache) < 200_000:
            cache[word] = f
    return f


class Field:
    """Weights of a linear chain: emission per feature and label, and per neighbouring labels."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.emit = np.zeros((len(vocabulary) + 1, len(LABELS)))  # the last row is for unknown features and stays 0
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.cache: dict[str, tuple] = {}
        self.bar = np.zeros_like(self.move)
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                for i, a in enumerate(LABELS):
                    if a[1:] != b[1:]:
                        self.bar[i, j] = -1e4
        self.begin = np.where([x[0] == "I" for x in LABELS], -1e4, 0.0)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def encode(self, words: list[str]) -> np.ndarray:
        own = [features(x, self.cache) for x in words]
        none = ("s=", "n=", "p=")
        pad = [none, *own, none]
        get, unknown = self.vocabulary.get, len(self.vocabulary)
        return np.array([[get(x, unknown) for x in o] + [get("<" + p[0], unknown), get("<" + p[1], unknown), get(">" + q[0], unknown), get(">" + q[1], unknown)]
                         for p, o, q in zip(pad, own, pad[2:])], dtype=np.int64).reshape(-1, 7)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.emit[codes].sum(axis=-2)

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Maximum penalised likelihood by gradient steps with per-weight scale; forward and backward sums on padded arrays."""
        if not data:
            return
        n, steps, size = len(data), max(len(y) for _, y in data), len(LABELS)
        codes = np.full((n, steps, 7), len(self.vocabulary))
        gold = np.zeros((n, steps), np.int64)
        live = np.zeros((n, steps), bool)
        for i, (x, y) in enumerate(data):
            codes[i, : len(y)], gold[i, : len(y)], live[i, : len(y)] = x, y, True
        both = live[:, 1:]
        seen_emit, seen_move = np.zeros_like(self.emit), np.zeros_like(self.move)
        np.add.at(seen_emit, codes[live], np.eye(size)[gold[live]][:, None, :])
        np.add.at(seen_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        moments = [np.zeros_like(x) for x in (self.emit, self.emit, self.move, self.move)]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for it in range(1, ITERATIONS + 1):
            move, e = self.move + self.bar, self.scores(codes)
            fwd, bwd = np.empty_like(e), np.zeros_like(e)
            fwd[:, 0] = self.begin + e[:, 0]
            for t in range(1, steps):
                fwd[:, t] = np.where(live[:, t, None], lse(fwd[:, t - 1, :, None] + move, 1) + e[:, t], fwd[:, t - 1])
            for t in range(steps - 2, -1, -1):
                bwd[:, t] = np.where(live[:, t + 1, None], lse(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
            z = lse(fwd[:, -1], 1)
            p = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)) * live[..., None]
            want_emit, want_move = np.zeros_like(self.emit), np.zeros_like(self.move)
            np.add.at(want_emit, codes[live], p[live][:, None, :])
            for t in range(1, steps):
                joint = fwd[:, t - 1, :, None] + move + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]
                want_move += (np.exp(np.minimum(joint, 0)) * live[:, t, None, None]).sum(axis=0)
            for k, (w, g) in enumerate(((self.emit, seen_emit - want_emit - L2 * self.emit), (self.move, seen_move - want_move - L2 * self.move))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += 0.15 * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.99 ** it)) + 1e-6)
            self.emit[-1] = 0

    def decode(self, sequences: list[np.ndarray], cells: int = 400_000) -> list[np.ndarray]:
        """Best label path of every sequence; sequences of like length share one array of at most `cells` words."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        move = self.move + self.bar
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(sequences[order[end]]) <= cells:
                end += 1
            part = [sequences[i] for i in order[at:end]]
            lens = np.array([len(x) for x in part])
            steps = int(lens.max())
            codes = np.full((len(part), steps, 7), len(self.vocabulary))
            for i, x in enumerate(part):
                codes[i, : len(x)] = x
            e = self.scores(codes)
            best = self.begin + e[:, 0]
            back = np.empty((len(part), steps, len(LABELS)), np.int8)
            last = best.copy()
            for t in range(1, steps):
                path = best[:, :, None] + move
                back[:, t] = path.argmax(axis=1)
                best = path.max(axis=1) + e[:, t]
                last = np.where((lens == t + 1)[:, None], best, last)
            tags = np.zeros((len(part), steps), np.int64)
            label = last.argmax(axis=1)
            rows = np.arange(len(part))
            for t in range(steps - 1, -1, -1):
                inside = t < lens
                tags[:, t] = label
                label = np.where(inside & (t > 0), back[rows, t, label] if t else label, label)
            for i, k in enumerate(order[at:end]):
                out[k] = tags[i, : lens[i]]
            at = end
        return out


def _labels(spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Label of every word (code points start, end) by the spans that cover it; the earlier span wins."""
    y = np.zeros(len(start), np.int64)
    for s, kind, e in reversed(spans):
        i, j = np.searchsorted(end, s, side="right"), np.searchsorted(start, e, side="left")
        if j > i:
            y[i:j] = 2 + 2 * kind
            y[i] = 1 + 2 * kind
    return y


class Placed:
    """A slice of texts with its word runs and their code point offsets."""

    def __init__(self, texts: list[str | None]):
        self.w = w = Words(texts)
        points = np.concatenate(([0], np.cumsum((w.buf & 0xC0) != 0x80)))
        self.lo, self.hi = runs(w)
        self.doc = w.doc_of(self.lo)
        offsets = np.concatenate(([0], np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])))
        self.zero = points[offsets]
        self.points = points

    def words(self, r: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        w, (i, j) = self.w, (self.lo[r], self.hi[r])
        text = [w.raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(w.start[i:j].tolist(), w.end[i:j].tolist())]
        zero = self.zero[self.doc[r]]
        return text, self.points[w.start[i:j]] - zero, self.points[w.end[i:j]] - zero


def training_runs(df: DataFrame, doc_id: str, text: str, limit: int = TRAIN_DOCS, most: int = TRAIN_RUNS) -> list[tuple[list[str], list[int]]]:
    """The labelled table: words and labels of at most `most` runs from at most `limit` texts."""
    ids = (df.where(F.col(text).rlike("[0-9@]") & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id")).distinct()
           .orderBy(F.xxhash64("_id"), "_id").limit(limit))

    def run(batches):
        for b in batches:
            texts = b.column("_text").to_pylist()
            words, labels = [], []
            for i, j in slices(texts):
                p = Placed(texts[i:j])
                spans = {}
                for r in range(len(p.lo)):
                    d = int(p.doc[r])
                    if d not in spans:
                        spans[d] = base_spans(texts[i + d])
                    t, s, e = p.words(r)
                    if len(t) <= 64:
                        words.append(t)
                        labels.append(_labels(spans[d], s, e).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int64()))], names=["words", "labels"])

    rows = (df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")  # at most `limit` ids
            .select("_text").mapInArrow(run, "words array<string>, labels array<long>")
            .orderBy(F.xxhash64("words"), "words").limit(most).collect())
    return [(r["words"], r["labels"]) for r in rows]


def train(table: list[tuple[list[str], list[int]]]) -> Field:
    cache: dict[str, tuple] = {}
    counts: dict[str, int] = {}
    for words, _ in table:
        own = [features(x, cache) for x in words]
        pad = [("s=", "n=", "p="), *own, ("s=", "n=", "p=")]
        for p, o, q in zip(pad, own, pad[2:]):
            for f in (*o, "<" + p[0], "<" + p[1], ">" + q[0], ">" + q[1]):
                counts[f] = counts.get(f, 0) + 1
    field = Field({f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 1))})
    field.fit([(field.encode(w), np.array(y)) for w, y in table])
    return field


STRIP = ".,;:!?\"'()[]{}<>#*$%&|"


def find_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """Per text: (pattern spans, all spans), each sorted (start, kind, end)."""
    out: list = [([], [])] * len(texts)
    for i, j in slices(texts):
        p = Placed(texts[i:j])
        base = {int(d): base_spans(texts[i + d]) for d in np.unique(p.doc)}
        found = {d: list(s) for d, s in base.items()}
        placed = [p.words(r) for r in range(len(p.lo))]
        for r, tags in enumerate(field.decode([field.encode(x[0]) for x in placed]) if placed else ()):
            d, (words, s, e), k = int(p.doc[r]), placed[r], 0
            while k < len(tags):
                if tags[k] == 0:
                    k += 1
                    continue
                kind, first = (tags[k] - 1) // 2, k
                k += 1
                while k < len(tags) and tags[k] == 2 + 2 * kind:
                    k += 1
                a = int(s[first]) + len(words[first]) - len(words[first].lstrip(STRIP))
                z = int(e[k - 1]) - (len(words[k - 1]) - len(words[k - 1].rstrip(STRIP)))
                if a < z and not any(x < z and a < y for x, _, y in base[d]):
                    found[d].append((a, int(kind), z))
        for d in base:
            out[i + d] = (base[d], sorted(found[d]))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii_spans(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, counts and digest of pattern spans, all spans, and the number the field added."""
    def run(batches):
        for b in batches:
            got = find_spans(b.column("_text").to_pylist(), field)
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in got] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], pa.string()),
                 pa.array([joined(every) for _, every in got], pa.string()), pa.array([len(every) - len(base) for base, every in got], pa.int64())],
                names=["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = df.schema[doc_id].dataType.simpleString()
    return (df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
            .withColumnRenamed("_id", doc_id))


def redact(t: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span becomes its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [t[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + t[at:]


def redacted(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`df`, same columns, with the text's spans replaced; null stays null."""
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [t if t is None or not every else redact(t, every) for t, (_, every) in zip(texts, find_spans(texts, field))]
            cols = [pa.array(new, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return df.mapInArrow(run, df.schema)
