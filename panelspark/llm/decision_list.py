"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of a text are array expressions inside one row, so no text is shuffled. Sequential covering
learns ordered conjunctions of thresholds from the statistics of labelled texts; the list becomes one
conditional expression. Learning sees at most `LABELLED` labelled rows (those with the smallest hash of
their id); the rules then judge every row.

Cases: a null or empty text has no words, zero counts and fails the base rules; repeated rows and ties get
equal results; without labels, or with one class only, the list is empty and the base rules decide alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.common import BLANKS

LABELLED = 8000
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_CONDITIONS = 4
MIN_COVER = 8
MIN_PRECISION = 0.95
CUTS = 24


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, not once per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column, width: int) -> Column:
    """Positions covered by windows (given by hash) whose hash comes up at least twice."""
    def repeated(s):
        same = lambda x, k: F.coalesce(F.get(s, k).getField("h") == x.getField("h"), F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)),
                                        lambda x: x.getField("i")))

    def total(p):
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
                           F.lit(0).cast("bigint"), lambda a, b: a + b)

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(placed, lambda s: let(repeated(s), total))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_stats(text: Column) -> Column:
    """Struct of counts over the whole text. Windows of three words are compared by 64-bit hash."""
    def of_words(t, words):
        hashed = F.transform(words, lambda w: F.xxhash64(w))

        def of_hashes(h):
            threes = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
                                 lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
            return F.struct(F.size(h).cast("bigint").alias("n_words"),
                            F.size(F.array_distinct(h)).cast("bigint").alias("n_distinct"),
                            _covered(threes, 3).alias("n_repeat_words"))

        lines = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
        count = lambda chars: (F.length(t) - F.length(_without(t, chars))).cast("bigint")
        return F.struct(
            let(hashed, of_hashes).alias("w"),
            F.length(_without(t, BLANKS)).cast("bigint").alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            let(lines, lambda a: F.struct(F.size(a).cast("bigint").alias("n"),
                                          (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("dup"))).alias("lines"),
            count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            count("0123456789").alias("n_digits"), count("!?").alias("n_shouts"))

    words = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of_words(t, w)))


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with one more column `_s`: the counts, and `_f`: the features of the rules."""
    s = df.withColumn("_s", text_stats(F.col(text)))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return s.withColumn("_f", F.struct(
        F.col("_s.w.n_words").cast("double").alias("words"),
        ratio("_s.word_chars", "_s.w.n_words").alias("word_length"),
        ratio("_s.n_symbols", "_s.word_chars").alias("symbol_share"),
        ratio("_s.lines.dup", "_s.lines.n").alias("dup_line_share"),
        ratio("_s.w.n_repeat_words", "_s.w.n_words").alias("repeat_share"),
        ratio("_s.w.n_distinct", "_s.w.n_words").alias("distinct_share"),
        ratio("_s.n_upper", "_s.word_chars").alias("upper_share"),
        ratio("_s.n_digits", "_s.word_chars").alias("digit_share"),
        ratio("_s.n_shouts", "_s.word_chars").alias("shout_share")))


FEATURES = ["words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "upper_share", "digit_share", "shout_share"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self, f: Column) -> Column:
        c = f.getField(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = list[Condition]


def _cuts(rows: list[dict]) -> list[Condition]:
    out = []
    for f in FEATURES:
        values = sorted({r[f] for r in rows})
        step = max(1, len(values) // CUTS)
        for a, b in zip(values[step - 1::step], values[step::step]):
            out += [Condition(f, True, (a + b) / 2), Condition(f, False, (a + b) / 2)]
    return out


def _counts(rows: list[tuple[dict, bool]], rule: Rule) -> tuple[int, int]:
    hit = [bad for r, bad in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[tuple[dict, bool]]) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: Rule = []
    while len(rule) < MAX_CONDITIONS:
        p0 = sum(b for _, b in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best = None
        for c in _cuts([r for r, _ in rows]):
            p, n = _counts(rows, [c])
            if p >= MIN_COVER and p + n < p0 + n0:
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, c)
        if best is None:
            break
        rule.append(best[1])
        rows = [x for x in rows if best[1].holds(x[0])]
    return rule


def _prune(rule: Rule, held: list[tuple[dict, bool]]) -> Rule:
    """The prefix of the conjunction with the best (bad - good) / covered on rows not used to grow it."""
    def worth(k):
        p, n = _counts(held, rule[:k])
        return ((p - n) / (p + n) if p + n else -1.0, -k)
    return rule[: max(range(1, len(rule) + 1), key=worth)] if rule else rule


def learn(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Sequential covering: rows are (features, bad) in a fixed order; every third row is held for pruning."""
    rules: list[Rule] = []
    while True:
        grow = [x for i, x in enumerate(rows) if i % 3]
        held = rows[::3]
        rule = _prune(_grow(grow), held)
        if not rule:
            return rules
        p, n = _counts(rows, rule)
        hp, hn = _counts(held, rule)
        if p < MIN_COVER or p < MIN_PRECISION * (p + n) or hp < MIN_PRECISION * (hp + hn) or not hp:
            return rules
        rules.append(rule)
        rows = [x for x in rows if not all(c.holds(x[0]) for c in rule)]


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
             text: str = "text", limit: int = LABELLED) -> list[tuple[dict, bool]]:
    """At most `limit` labelled rows' features, in an order that depends on ids and values only."""
    some = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
            .groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
            .orderBy(F.xxhash64("_id"), "_id").limit(limit))
    rows = (with_stats(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
                       .join(F.broadcast(some), "_id"), "_text")  # at most `limit` rows of two numbers
            .select(F.xxhash64("_id").alias("o"), "_id", "_label", "_f").limit(2 * limit).collect())
    rows.sort(key=lambda r: (r["o"], r["_id"], tuple(r["_f"])))
    return [(r["_f"].asDict(), r["_label"] == 0) for r in rows]


def base_failed(s: Column) -> Column:
    w = s.getField("w")
    return (w.getField("n_words") < MIN_WORDS) | (100 * w.getField("n_repeat_words") > 50 * w.getField("n_words"))


def verdict(rules: list[Rule], f: Column) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects."""
    out = F.when(F.lit(False), F.lit(-1))
    for k, rule in enumerate(rules):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column(f)
        out = out.when(cond, F.lit(k))
    return out


def quality_rules(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """`doc` (the row as a struct, so names can't clash), `_s` (counts), `_rule` (number of the rule that
    rejects, else null), `_base`, `_kept`."""
    s = with_stats(df.select(F.struct("*").alias("doc"), F.col(text).alias("_text")), "_text")
    return (s.withColumn("_rule", verdict(rules, F.col("_f"))).withColumn("_base", base_failed(F.col("_s")))
            .withColumn("_kept", ~F.col("_base") & F.col("_rule").isNull()))
