"""Scores of texts that heed what stands around a word.

Two scorers. :func:`score_in_context` averages the polarity of words and phrases
after negators and intensifiers before them have changed it. :func:`score_valence`
sums valences, raised by capitals and exclamation marks and shifted by a turn of
the sentence, and brings the sum between -1 and 1.

A text's words are all in its row: both score rows in place in Arrow batches,
so no text passes an exchange. A table of entries beyond the broadcast bounds
is joined to the words instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.lookup import is_small, lookup_join

VALUE, NEGATOR, INTENSIFIER, TURN = "value", "negator", "intensifier", "turn"
#: A run of letters, or one mark that ends a sentence; modifiers do not reach over a mark.
TOKEN = r"\p{L}+|[.!?;]"
_MARKS = ".!?;"
_BETWEEN = r"[^\p{L}.!?;]+"
_TEXTS_AT_ONCE = 256


def entries(lexicon: DataFrame) -> DataFrame:
    """One row per phrase and role: ``phrase``, ``role``, ``polarity``, ``subjectivity``, ``factor``, ``reach``.

    Phrases are lower-case words with one blank between; entries that repeat
    count with their means, the longest reach, and a missing number is that of
    no effect (0 for polarity and subjectivity, 1 for the factor, 0 for the
    reach). Null or empty phrases and unknown roles are left out.
    """
    def mean(name: str, default: float) -> Column:
        return F.coalesce(F.avg(F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))), F.lit(default)).alias(name)

    phrase = F.array_join(F.regexp_extract_all(F.lower("phrase"), F.lit(r"\p{L}+"), F.lit(0)), " ")
    return lexicon.withColumn("phrase", phrase).filter((F.col("phrase") != "") & F.col("role").isin(VALUE, NEGATOR, INTENSIFIER)).groupBy(
        "phrase", "role").agg(mean("polarity", 0.0), mean("subjectivity", 0.0), mean("factor", 1.0),
                              F.coalesce(F.max("reach"), F.lit(0)).cast("int").alias("reach"))


class _Trie:
    """Phrases as paths of words; all texts of a batch go down it together, one word a step."""

    def __init__(self, phrases: Sequence[str]):
        words = sorted({w for p in phrases for w in p.split()})
        code, edges, self.entry_at = {w: i for i, w in enumerate(words)}, {}, {}
        states = 1
        for i, p in enumerate(phrases):
            at = 0
            for w in p.split():
                key = at * len(words) + code[w]
                if key not in edges:
                    edges[key], states = states, states + 1
                at = edges[key]
            self.entry_at[at] = i
        self.words, self.longest = words, max((len(p.split()) for p in phrases), default=0)
        self.keys = np.array(sorted(edges), "i8")
        self.next = np.array([edges[k] for k in self.keys.tolist()], "i8")
        self.entry = np.full(states, -1, "i8")
        self.entry[list(self.entry_at)] = list(self.entry_at.values())

    def find(self, tokens: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, entry) of the phrases found, in order; none that lies inside a longer one."""
        code = pc.fill_null(pc.index_in(tokens, value_set=pa.array(self.words, tokens.type)), -1).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(code >= 0)
        state, found = np.zeros(len(start), "i8"), []
        for depth in range(self.longest):
            at = start + depth
            inside = at < len(code)
            start, state, at = start[inside], state[inside], at[inside]
            inside = (code[at] >= 0) & (owner[at] == owner[start])
            start, state, at = start[inside], state[inside], at[inside]
            key = state * len(self.words) + code[at]
            place = np.searchsorted(self.keys, key)
            inside = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == key)
            start, state = start[inside], self.next[place[inside]]
            entry = self.entry[state]
            found.append((start[entry >= 0], np.full((entry >= 0).sum(), depth + 1), entry[entry >= 0]))
        if not found:
            return (np.zeros(0, "i8"),) * 3
        start, length, entry = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-length, start))
        start, length, entry = start[order], length[order], entry[order]
        end = start + length
        before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]]) if len(end) else end
        whole = before < end
        return start[whole], length[whole], entry[whole]


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of some texts in order and the text of each."""
    spaced = pc.replace_substring_regex(texts.fill_null(""), f"([{_MARKS}])", r" \1 ")
    split = pc.split_pattern_regex(spaced, _BETWEEN)
    tokens, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.not_equal(tokens, "")
    return tokens.filter(some), owner.filter(some).to_numpy(zero_copy_only=False)


def _by_parts(score_some: Callable[[pa.Array], np.ndarray]) -> Callable[[Column], Column]:
    """A column function that scores some texts at a time, so that the words in memory are few; null stays null."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(i, _TEXTS_AT_ONCE) for i in range(0, len(texts), _TEXTS_AT_ONCE)]
        scored = [pa.array(score_some(p), mask=pc.is_null(p).to_numpy(zero_copy_only=False)) for p in parts]
        return pa.concat_arrays(scored) if scored else pa.array([], pa.float64())

    return score


def _in_place(rows: list[dict]) -> Callable[[Column], Column]:
    phrases = sorted({r["phrase"] for r in rows})
    number = {p: i for i, p in enumerate(phrases)}
    is_value = np.zeros(len(phrases), bool)
    polarity, subjectivity = np.zeros(len(phrases)), np.zeros(len(phrases))
    factor = {role: np.ones(len(phrases)) for role in (NEGATOR, INTENSIFIER)}
    reach = {role: np.zeros(len(phrases), "i8") for role in factor}
    for r in rows:
        i = number[r["phrase"]]
        if r["role"] == VALUE:
            is_value[i], polarity[i], subjectivity[i] = True, r["polarity"], r["subjectivity"]
        else:
            factor[r["role"]][i], reach[r["role"]][i] = r["factor"], r["reach"]
    trie = _Trie(phrases)

    def score_some(texts: pa.Array) -> np.ndarray:
        tokens, owner = _tokens(texts)
        start, length, entry = trie.find(tokens, owner)
        sentence = np.cumsum(pc.is_in(tokens, value_set=pa.array(list(_MARKS), tokens.type)).to_numpy(zero_copy_only=False))
        last = start + length - 1
        at, what = start[is_value[entry]], entry[is_value[entry]]
        change = {}
        for role in factor:
            by, far = np.ones(len(owner)), np.zeros(len(owner), "i8")
            by[last], far[last] = factor[role][entry], reach[role][entry]
            total = np.ones(len(at))
            for d in range(1, int(reach[role].max(initial=0)) + 1):
                e = np.maximum(at - d, 0)
                near = (at >= d) & (owner[e] == owner[at]) & (sentence[e] == sentence[at]) & (far[e] >= d)
                total = np.where(near, total * by[e], total)
            change[role] = total
        p = np.clip(polarity[what] * change[NEGATOR] * change[INTENSIFIER], -1, 1)
        s = np.clip(subjectivity[what] * change[INTENSIFIER], 0, 1)
        of = owner[at]
        n = np.bincount(of, minlength=len(texts))
        some = np.maximum(n, 1)
        p, s = (np.bincount(of, weights=w, minlength=len(texts)) / some for w in (p, s))
        return np.where(n > 0, p * (0.5 + 0.5 * s), 0.0)

    return _by_parts(score_some)


def score_in_context(articles: DataFrame, lexicon: DataFrame, fields: Sequence[str] = ("title", "description")) -> DataFrame:
    """The articles with ``<field>_sentiment`` from words and phrases and the modifiers before them.

    Tokens are runs of letters and sentence marks of the lower-case text. A
    phrase of the lexicon counts where it stands, unless it lies inside a
    longer one; of two that overlap in part both count. A negator or
    intensifier multiplies the polarity of each value that begins up to
    ``reach`` tokens behind its last word within the sentence, several of them
    one after the other; intensifiers also multiply its subjectivity. Both are
    then cut to their range and averaged over the values of the text, and the
    score is the polarity weighted by subjectivity. Without a value a text
    scores 0, a null text null.

    A lexicon of one size is scored in place, a larger one by
    :func:`score_in_context_by_join`.
    """
    known = entries(lexicon)
    if not is_small(known):
        return score_in_context_by_join(articles, known, fields)
    rows = [r.asDict() for r in known.collect()]  # within the broadcast bounds
    score = _in_place(rows)
    return articles.withColumns({f"{name}_sentiment": score(F.lower(name)) for name in fields})


def score_in_context_by_join(
    articles: DataFrame, lexicon: DataFrame, fields: Sequence[str] = ("title", "description"),
) -> DataFrame:
    """Scores as :func:`score_in_context` gives them, for a lexicon of any size.

    Every run of tokens up to the longest phrase meets the lexicon in a join;
    what is found comes back to its article, where it is weighed.
    """
    known = entries(lexicon)
    longest = known.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    # articles with the same content share a key; each copy stays a row
    keyed = articles.withColumn("__content", F.sha2(F.to_json(F.struct(*fields)), 256))
    for name in fields:
        tokens = F.regexp_extract_all(F.lower(name), F.lit(TOKEN), F.lit(0))
        texts = keyed.select("__content", tokens.alias("__tokens")).filter(F.size("__tokens") > 0).dropDuplicates(["__content"])
        runs = texts.select("__content", F.posexplode("__tokens").alias("__at", "__token"), "__tokens").select(
            "__content", "__at", F.explode(F.expr(f"""
                transform(filter(sequence(1, {longest}), n -> n <= size(__tokens) - __at),
                          n -> struct(n as n, array_join(slice(__tokens, __at + 1, n), ' ') as phrase))""")).alias("__run")
        ).select("__content", "__at", "__run.n", "__run.phrase")
        found = lookup_join(runs, known, ["phrase"], "inner")
        one = F.struct(F.col("__at").alias("at"), (F.col("__at") + F.col("n")).alias("till"), "role", "polarity", "subjectivity", "factor", "reach")
        weighed = found.groupBy("__content").agg(F.collect_list(one).alias("__found")).join(texts, "__content").select(
            "__content", F.expr("""
              transform(filter(__found, o -> not exists(__found, x -> x.at <= o.at and x.till >= o.till and x.till - x.at > o.till - o.at)),
                        o -> o)""").alias("__found"), "__tokens")

        def changed(*roles: str) -> str:
            listed = ", ".join(f"'{r}'" for r in roles)
            return f"""aggregate(filter(__found, m -> m.role in ({listed}) and o.at - m.till between 0 and m.reach - 1
                and not exists(slice(__tokens, m.till + 1, o.at - m.till), t -> t in ('.', '!', '?', ';'))), 1D, (a, m) -> a * m.factor)"""

        values = weighed.select("__content", F.expr(f"""
            transform(filter(__found, o -> o.role = '{VALUE}'), o -> struct(
              greatest(-1D, least(1D, o.polarity * {changed(NEGATOR)} * {changed(INTENSIFIER)})) as p,
              greatest(0D, least(1D, o.subjectivity * {changed(INTENSIFIER)})) as s))""").alias("v")).filter(F.size("v") > 0)
        mean = "aggregate(v, 0D, (a, x) -> a + x.{}) / size(v)"
        scores = values.select("__content", F.expr(f"({mean.format('p')}) * (0.5D + 0.5D * {mean.format('s')})").alias("__score"))
        keyed = keyed.join(scores, "__content", "left").withColumn(
            f"{name}_sentiment", F.when(F.col(name).isNotNull(), F.coalesce("__score", F.lit(0.0)))).drop("__score")
    return keyed.drop("__content")


@dataclass(frozen=True)
class ValenceRules:
    """How much capitals, marks and turns weigh, and the sum at which a score is about 0.7."""

    capitals: float = 0.6
    exclamation: float = 0.25
    most_exclamations: int = 4
    question: float = 0.2
    before_turn: float = 0.5
    after_turn: float = 1.5
    scale: float = 4.0


def valences(lexicon: DataFrame) -> DataFrame:
    """One row per word: its mean ``valence`` and whether it is a ``turn`` (role ``turn``); unknown roles count as values."""
    number = F.nanvl(F.col("valence").cast("double"), F.lit(None).cast("double"))
    turn = F.coalesce(F.col("role") == TURN, F.lit(False))
    return lexicon.filter(F.col("word") != "").groupBy(F.lower("word").alias("word")).agg(
        F.coalesce(F.avg(F.when(~turn, number)), F.lit(0.0)).alias("valence"), F.bool_or(turn).alias("turn"))


def score_valence(
    articles: DataFrame, lexicon: DataFrame, fields: Sequence[str] = ("title", "description"), rules: ValenceRules = ValenceRules(),
) -> DataFrame:
    """The articles with ``<field>_valence`` between -1 and 1.

    The valences of the words (runs of letters) are summed. A word of two
    letters or more in capitals counts ``capitals`` more in its direction,
    unless the text has no lower-case letter at all. If the text turns ("but"),
    words before its last turn count ``before_turn`` times and those behind it
    ``after_turn`` times. Exclamation marks, up to ``most_exclamations``, and
    two or more question marks take the sum further in its direction. The score
    is sum / sqrt(sum ** 2 + scale ** 2); 0 without a word of the lexicon, null
    for a null text. A lexicon beyond the broadcast bounds is joined to the words.
    """
    known = valences(lexicon)
    if not is_small(known):
        return _valence_by_join(articles, known, fields, rules)
    rows = sorted((r["word"], r["valence"], r["turn"]) for r in known.collect())  # within the broadcast bounds
    words = [r[0] for r in rows]
    valence, turns = np.array([r[1] for r in rows], "f8"), np.array([r[2] for r in rows], bool)

    def score_some(texts: pa.Array) -> np.ndarray:
        texts = texts.fill_null("")
        split = pc.split_pattern_regex(texts, r"\P{L}+")
        tokens = pc.list_flatten(split)
        owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        code = pc.index_in(pc.utf8_lower(tokens), value_set=pa.array(words, tokens.type))
        hit = pc.is_valid(code).to_numpy(zero_copy_only=False)
        code, at, of = code.filter(pa.array(hit)).to_numpy(zero_copy_only=False), np.flatnonzero(hit), owner[hit]
        big = pc.and_(pc.and_(pc.equal(tokens, pc.utf8_upper(tokens)), pc.not_equal(tokens, pc.utf8_lower(tokens))),
                      pc.greater_equal(pc.utf8_length(tokens), 2)).to_numpy(zero_copy_only=False)[hit]
        mixed = pc.not_equal(texts, pc.utf8_upper(texts)).to_numpy(zero_copy_only=False)
        value = valence[code]
        value = value + np.sign(value) * rules.capitals * (big & mixed[of])
        turn = np.full(len(texts), -1)
        is_turn = turns[code]
        np.maximum.at(turn, of[is_turn], at[is_turn])
        weight = np.where(turn[of] < 0, 1.0, np.where(at < turn[of], rules.before_turn, np.where(at > turn[of], rules.after_turn, 0.0)))
        total = np.bincount(of, weights=value * weight, minlength=len(texts))
        marks, asked = (pc.count_substring(texts, m).to_numpy(zero_copy_only=False) for m in "!?")
        more = rules.exclamation * np.minimum(marks, rules.most_exclamations) + rules.question * (asked > 1)
        total = total + np.sign(np.round(total, 12)) * more
        return total / np.sqrt(total * total + rules.scale**2)

    score = _by_parts(score_some)
    return articles.withColumns({f"{name}_valence": score(F.col(name)) for name in fields})


def _valence_by_join(articles: DataFrame, known: DataFrame, fields: Sequence[str], rules: ValenceRules) -> DataFrame:
    keyed = articles.withColumn("__content", F.sha2(F.to_json(F.struct(*fields)), 256))
    for name in fields:
        texts = keyed.select("__content", F.col(name).alias("__text")).filter("__text is not null").dropDuplicates(["__content"])
        words = texts.select("__content", (F.col("__text") != F.upper("__text")).alias("__mixed"),
                             F.posexplode(F.regexp_extract_all("__text", F.lit(r"\p{L}+"), F.lit(0))).alias("__at", "__word"))
        found = lookup_join(words.withColumn("word", F.lower("__word")), known, ["word"], "inner")
        big = (F.col("__word") == F.upper("__word")) & (F.col("__word") != F.lower("__word")) & (F.length("__word") >= 2) & F.col("__mixed")
        value = F.col("valence") + F.when(big, F.signum("valence") * rules.capitals).otherwise(0.0)
        one = F.struct(F.col("__at").alias("at"), value.alias("v"))
        sums = found.groupBy("__content").agg(F.collect_list(one).alias("__v"), F.max(F.when(F.col("turn"), F.col("__at"))).alias("__turn"))
        sums = sums.select("__content", F.expr(f"""
            aggregate(__v, 0D, (a, x) -> a + x.v * case when __turn is null then 1D when x.at < __turn then {rules.before_turn}D
                      when x.at > __turn then {rules.after_turn}D else 0D end)""").alias("__sum"))
        more = rules.exclamation * F.least(F.regexp_count(name, F.lit("!")), F.lit(rules.most_exclamations)) + F.when(
            F.regexp_count(name, F.lit(r"\?")) > 1, rules.question).otherwise(0.0)
        total = F.coalesce("__sum", F.lit(0.0))
        total = total + F.signum(F.round(total, 12)) * more
        keyed = keyed.join(sums, "__content", "left").withColumn(
            f"{name}_valence", F.when(F.col(name).isNotNull(), total / F.sqrt(total * total + rules.scale**2))).drop("__sum")
    return keyed.drop("__content")
