"""Quality rules: text statistics, fixed base rules, and a learned list of threshold rules.

Sequential covering learns one rule after the other from labelled statistics: a conjunction of thresholds is
grown on two thirds of the rows until it covers hardly any good text, its last conditions are pruned
on the other third, and the rows it covers are taken out. The ordered list becomes one conditional
expression of Spark; nothing but built-in functions runs on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.rows import one_text_per_id

BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
TRAINING_ROWS = 20_000  # the most labelled documents that rules are learned from
PLACE_BITS = 27  # of a word's place in its text; the rest of a long holds the first bits of a window's hash
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, and percent of them in repeated windows


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Hashes are sorted with their places packed below; neighbours alike in the upper bits are the
    only candidates, and are sorted again by the whole hash. So the cost is that of sorting, however much repeats.
    """
    place = (1 << PLACE_BITS) - 1

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.lit(False))

    def of_hashes(hashes: Column) -> Column:
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("bigint"))))
        candidates = _let(packed, lambda p: F.filter(p, lambda x, i: alike(x, F.get(p, i - 1)) | alike(x, F.get(p, i + 1))))
        return _let(candidates, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(of_candidates(hashes, c)))

    def of_candidates(hashes: Column, candidates: Column) -> Column:
        at = lambda x: x.bitwiseAND(F.lit(place)).cast("int")
        whole = F.sort_array(F.transform(candidates, lambda x: F.struct(F.get(hashes, at(x)).alias("h"), at(x).alias("at"))))

        def same(s: Column, x: Column, i: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

        repeated = _let(whole, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        places = F.sort_array(F.transform(repeated, lambda x: x["at"]))
        covered = _let(places, lambda q: F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))))
        return F.aggregate(covered, F.lit(0), lambda total, n: total + n)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows, of_hashes))


def _without(text: Column, signs: str) -> Column:
    """How many characters of ``text`` are among ``signs``."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def text_statistics(text_col: str = "text") -> dict[str, Column]:
    """The statistics by name; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).cast("bigint").alias("n_repeat_words")))
    lined = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return {
        "__words": counted,
        "__lines": lined,
        "word_chars": F.length(F.regexp_replace(text, BLANK + "+", "")).cast("bigint"),
        "n_symbols": _without(text, SYMBOLS).cast("bigint"),
        "n_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint"),
        "n_marks": _without(text, "!?").cast("bigint"),
    }


def with_statistics(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, the statistics, and the columns ``more``."""
    counted = docs.select(F.col(id_col).alias("doc_id"), *more, *[c.alias(n) for n, c in text_statistics(text_col).items()])
    return counted.select("doc_id", *more, "__words.*", "__lines.*", "word_chars", "n_symbols", "n_capitals", "n_marks")


def features() -> dict[str, Column]:
    """What rules may ask for: a number per document."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.try_divide("word_chars", "n_words"),
        "symbols_per_word": F.try_divide("n_symbols", "n_words"),
        "duplicate_lines": F.try_divide("n_dup_lines", "n_lines"),
        "repeated_words": F.try_divide("n_repeat_words", "n_words"),
        "capitals": F.try_divide("n_capitals", "word_chars"),
        "marks_per_word": F.try_divide("n_marks", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, self.feature]
        return value >= self.threshold if self.above else value < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, thresholds: list[np.ndarray], most: int) -> Rule:
    """Add the condition with the highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for feature, cuts in enumerate(thresholds):
            value = x[inside, feature]
            for cut in cuts:
                high = value >= cut
                for above, chosen in ((True, high), (False, ~high)):
                    p1 = int(bad[inside][chosen].sum())
                    n1 = int(chosen.sum()) - p1
                    if p1:
                        new = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if new > gain:
                            best, gain = Condition(feature, above, float(cut)), new
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule that tells bad from good best on rows it was not grown on."""

    def worth(part: Rule) -> float:
        inside = covers(part, x)
        p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn_rules(
    x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4, cuts: int = 24, seed: int = 3
) -> list[Rule]:
    """Rules for bad rows, in order. A rule that is less precise than ``precision`` on the rows kept for pruning ends the list."""
    if not len(x) or not bad.any() or bad.all():
        return []
    shuffled = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[shuffled], bad[shuffled]
    part = np.arange(len(x)) % 3 == 2
    quantiles = np.linspace(0.01, 0.99, cuts)
    thresholds = [np.unique(np.concatenate([np.quantile(x[:, f], quantiles), np.quantile(x[bad, f], quantiles)])) for f in range(x.shape[1])]
    rules: list[Rule] = []
    open_ = np.ones(len(x), bool)
    while len(rules) < most_rules:
        grow, prune = open_ & ~part, open_ & part
        if not bad[grow].any():
            break
        rule = _prune(_grow(x[grow], bad[grow], thresholds, most_conditions), x[prune], bad[prune])
        inside = covers(rule, x) & prune if rule else np.zeros(len(x), bool)
        if not inside.any() or bad[inside].mean() < precision:
            break
        rules.append(rule)
        open_ &= ~covers(rule, x)
    return rules


def rule_name(rule: Rule, names: Sequence[str]) -> str:
    return " and ".join(f"{names[c.feature]} {'>=' if c.above else '<'} {c.threshold:.6g}" for c in rule)


def rule_expression(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that holds, else null: one ordered conditional expression."""
    names, values = list(features()), list(features().values())
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & (values[c.feature] >= c.threshold if c.above else values[c.feature] < c.threshold)
        out = F.when(holds, F.lit(rule_name(rule, names))).otherwise(out)
    return out


def learned_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAINING_ROWS
) -> list[Rule]:
    """Rules for texts with label 0 that pass the base rules, from at most ``most`` labelled documents chosen by a hash of their id."""
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).dropna().dropDuplicates(["__id"])
    known = docs.select(F.col(id_col).alias("__id")).dropna().distinct()
    chosen = usable.join(known, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    rows = one_text_per_id(rows, id_col, text_col, "__label")
    seen = with_statistics(rows, id_col, text_col, "__label").filter(~base_failed())
    sample = seen.select("doc_id", "__label", *features().values()).collect()  # at most `most` rows
    sample.sort(key=lambda r: tuple(-1.0 if v is None else v for v in r))
    x = np.array([[0.0 if v is None else v for v in r[2:]] for r in sample], float).reshape(len(sample), len(features()))
    return learn_rules(x, np.array([r[1] == 0 for r in sample], bool))


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the statistics, base_failed, kept, rule (the learned rule that drops it).

    base_failed: fewer than 50 words, or more than half of the words in three-word windows that occur twice. kept: neither
    that nor a learned rule. Null and empty texts have statistics of 0 and fail the base. Without labels of both kinds there are
    no learned rules. Repeated rows are judged each; an empty table gives no rows. Other columns are not read.
    """
    rule = rule_expression(learned_rules(docs, labels, id_col, text_col))
    judged = with_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("rule", rule)
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")
