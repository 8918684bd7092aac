"""Quality rules learned from labelled statistics as an ordered list of threshold conjunctions.

Sequential covering: a rule for bad documents grows by the condition with the
best gain on two thirds of the labelled rows, is pruned on the other third, and
the rows that it covers leave both parts; then the next rule. Counting happens
in Spark, a step brings back one histogram line per feature and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import let, rolling_hashes, space_words, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: Labelled documents that the rules are fitted on at most, those with the least hash of the id.
MAX_LABELLED = 20_000
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must be right this often on rows that it has not seen.
MIN_PRECISION = 0.97
MIN_COVERED = 5
BINS = 32

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHER = ("n_chars", "n_lines", "n_upper", "n_marks")


def text_stats(text: Column) -> Column:
    """A struct of counts over the whole text.

    ``n_words`` words between white space, ``word_chars`` their code points,
    ``n_symbols`` of ``#*$%&|<>``, ``n_dup_lines`` lines with a word that equal
    an earlier line, ``n_repeat_words`` words in windows of eight that occur at
    least twice in the text; ``n_chars``, ``n_lines`` with a word, ``n_upper``
    capitals, ``n_marks`` punctuation and symbols. A null text counts as empty.
    """
    text = F.coalesce(text, F.lit(""))

    def covered(grams: Column) -> Column:
        """Words under repeated windows: sort the hashes, keep places with an equal neighbour, add up gaps up to eight."""
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(pairs, lambda a: F.filter(
            F.transform(a, lambda x, j: F.when(
                (F.get(a, j + 1)["h"] == x["h"]) | (F.get(a, j - 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull()))
        return let(F.sort_array(places), lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda x, y: F.least(F.lit(WINDOW), y - x)),
            F.lit(0), lambda total, x: total + x))

    def of_words(words: Column) -> Column:
        repeated = let(rolling_hashes(words, WINDOW), lambda g: F.when(
            F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    kept_chars = lambda pattern: F.char_length(F.regexp_replace(text, pattern, "")).cast("long")
    return let(F.struct(let(space_words(text), of_words).alias("w"), line_counts.alias("l")), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"),
        kept_chars(r"[\x20\x09-\x0D]+").alias("word_chars"),
        kept_chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        s["l"]["dup"].alias("n_dup_lines"),
        s["w"]["n_repeat_words"].alias("n_repeat_words"),
        F.char_length(text).cast("long").alias("n_chars"),
        s["l"]["n"].alias("n_lines"),
        kept_chars(r"\P{Lu}+").alias("n_upper"),
        kept_chars(r"[^\p{P}\p{S}]+").alias("n_marks"),
    ))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (F.lit(100) * s["n_repeat_words"] > F.lit(MAX_REPEAT_PCT) * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What rules test: sizes and shares, never null."""
    share = lambda a, b: F.coalesce(s[a] / F.nullif(s[b].cast("double"), F.lit(0.0)), F.lit(0.0))
    return {
        "words": s["n_words"].cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` if ``above``, else ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, a document under none is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def verdict(self, s: Column) -> Column:
        """The list as one conditional expression over a struct of :func:`text_stats`: true to keep."""
        values, case = features(s), None
        for rule in self.rules:
            holds = _all(rule, values)
            case = F.when(holds, F.lit(False)) if case is None else case.when(holds, F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))


def _all(rule: tuple[Condition, ...] | list[Condition], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(values)
    return out


def labelled_stats(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Features of at most ``max_labelled`` labelled documents with ``bad`` and ``grow``, stored.

    Labels without id or quality are left out. The ids are bounded by the
    parameter, so their broadcast is too. Documents that share an id all count.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality"))
        .dropna().groupBy("__id").agg(F.min("__quality").alias("__quality"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    picked = documents.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(
        F.broadcast(chosen), "__id")
    values = features(F.col("s"))
    return stored(
        picked.select("__id", "__quality", text_stats(F.col("__text")).alias("s"))
        .select(
            (F.col("__quality") == 0).alias("bad"),
            (F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(3)) > 0).alias("grow"),
            *[c.alias(n) for n, c in values.items()],
        ),
        "labelled",
    )


def fit(sample: DataFrame, min_precision: float = MIN_PRECISION, max_rules: int = MAX_RULES) -> DecisionList:
    """The decision list for a table of :func:`labelled_stats`; no rules for an empty one."""
    names = [c for c in sample.columns if c not in ("bad", "grow")]
    values = {n: F.col(n) for n in names}
    shares = [(i + 1) / (BINS + 1) for i in range(BINS)]
    # borders from either class, so that a rare class has fine ones as well
    found = sample.groupBy("bad").agg(*[F.percentile(n, shares).alias(n) for n in names]).collect()
    if len(found) < 2:
        return DecisionList()
    borders = {n: sorted({float(f"{x:.4g}") for row in found for x in row[n]}) for n in names}

    def bin_of(name: str) -> Column:
        below = F.filter(F.lit(borders[name]), lambda border: F.col(name) > border)
        return F.struct(F.lit(name).alias("feature"), F.size(below).alias("bin"))

    binned = F.array(*[bin_of(n) for n in names])
    left = sample.withColumn("__bins", binned).persist()
    rules: list[tuple[Condition, ...]] = []
    try:
        while len(rules) < max_rules:
            rest = left
            for r in rules:
                rest = rest.filter(~_all(r, values))
            rule = _grow(rest.filter("grow"), borders, values)
            rule = _prune(rest.filter("not grow"), rule, values, min_precision)
            if not rule:
                break
            rules.append(rule)
    finally:
        left.unpersist()
    return DecisionList(tuple(rules))


def _grow(rows: DataFrame, borders: dict[str, list[float]], values: dict[str, Column]) -> list[Condition]:
    """Add the condition of the best information gain until no good row is covered or none gains."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        counts: dict[str, dict[int, tuple[int, int]]] = {}
        lines = (
            rows.filter(_all(rule, values)).select("bad", F.explode("__bins").alias("b"))
            .groupBy(F.col("b")["feature"].alias("feature"), F.col("b")["bin"].alias("bin"))
            .agg(F.count_if(F.col("bad")).alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        )
        for line in lines:
            counts.setdefault(line["feature"], {})[line["bin"]] = (line["p"], line["n"])
        if not counts:
            break
        p0, n0 = (sum(x[i] for x in next(iter(counts.values())).values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best, choice = 0.0, None
        for name in sorted(counts):
            for i, threshold in enumerate(borders[name]):
                p_above = sum(x[0] for b, x in counts[name].items() if b > i)
                n_above = sum(x[1] for b, x in counts[name].items() if b > i)
                for above, p, n in ((True, p_above, n_above), (False, p0 - p_above, n0 - n_above)):
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best + 1e-9:
                            best, choice = gain, Condition(name, above, threshold)
        if choice is None:
            break
        rule.append(choice)
    return rule


def _prune(
    rows: DataFrame, rule: list[Condition], values: dict[str, Column], min_precision: float
) -> tuple[Condition, ...]:
    """The beginning of the rule with the best (p - n) / (p + n) on unseen rows; empty if it is not right often enough."""
    if not rule:
        return ()
    starts = [tuple(rule[: i + 1]) for i in range(len(rule))]
    got = rows.agg(
        *[F.count_if(F.col("bad") & _all(r, values)).alias(f"p{i}") for i, r in enumerate(starts)],
        *[F.count_if(~F.col("bad") & _all(r, values)).alias(f"n{i}") for i, r in enumerate(starts)],
    ).first()
    scored = [((p - n) / (p + n), -i, r) for i, r in enumerate(starts)
              if (p := got[f"p{i}"]) + (n := got[f"n{i}"]) and p >= MIN_COVERED and p >= min_precision * (p + n)]
    return max(scored, key=lambda x: x[:2])[2] if scored else ()


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    return fit(labelled_stats(documents, labels, max_labelled))


def keep_good(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents, all columns as they are, that pass the base checks and the rules, in one pass without a shuffle."""
    name = "__quality_stats"
    s = F.col(name)
    return (documents.withColumn(name, text_stats(F.col("text")))
            .filter(~base_failed(s) & rules.verdict(s)).drop(name))
