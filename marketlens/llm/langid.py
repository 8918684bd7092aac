"""Language identification in two steps: the family, then one-versus-one machines within it.

Linear support vector machines with squared hinge loss over hashed byte
trigrams of the whole text. The family is voted among families, the language
among those of the family. Trained on a bounded number of labelled texts per
language; the weights are a small matrix that every task gets. Duels always have
a winner, so each language also has a profile of its trigrams and a floor of
likelihood, below which a text is in none of the languages learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 1 << 12
#: Labelled texts per language that the machines are trained on at most.
PER_LANGUAGE = 1000
#: Parts that a language's documents are chosen in before they are chosen together.
SALTS = 64
#: A value of the label needs so many texts to be learned.
MIN_TEXTS = 5
STEPS, PENALTY = 120, 1e-4
UNKNOWN = "und"
#: Share of the uniform distribution in a profile.
SMOOTHING = 0.01
#: Share of a language's own texts that the floor is measured from.
LOW = 0.01
#: How far below the floor a text may lie, times the root of its trigrams: short ones scatter.
SHORT = 3.0

# Families of related languages by ISO code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_CHUNK = 1 << 20
_ROWS = 256
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def family_of(lang: str) -> str:
    """The family of a label; one that is not listed is a family of its own."""
    return _FAMILY.get(lang, lang)


def trigrams(text: str) -> np.ndarray:
    """Square roots of hashed counts of lower-case byte trigrams over the whole text, of length one; no letter: zeros."""
    data = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)
    counts = np.zeros(DIMS)
    for at in range(0, len(data) - 2, _CHUNK):
        b = _FOLD[data[at : at + _CHUNK + 2]]
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]  # runs of other characters are one blank
        code = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1] * np.uint32(0x9E3779B1) ^ b[2:] * np.uint32(0x85EBCA6B))
        counts += np.bincount((code * np.uint32(0xC2B2AE35)) >> np.uint32(20), minlength=DIMS)
    counts = np.sqrt(counts)
    norm = np.sqrt(counts @ counts)
    return (counts / norm if norm else counts).astype("f4")


def _machine(a: list[np.ndarray], b: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Weights and bias of a two-class machine, classes weighted equally, by accelerated gradient steps.

    A class is a list of blocks of rows whose last number is one; the blocks
    are read in place.
    """
    sides = [(x, y, np.float32(0.5 / max(1, sum(map(len, blocks))))) for blocks, y in ((a, 1), (b, -1)) for x in blocks]
    w = np.zeros(DIMS + 1, "f4")
    ahead, rate = w, 1 / (4 + PENALTY)  # rows have length root two at most
    for t in range(steps):
        pull = sum(x.T @ (weight * y * np.maximum(0, 1 - y * (x @ ahead))) for x, y, weight in sides)
        step = ahead + rate * (2 * pull - PENALTY * ahead)
        ahead, w = step + t / (t + 3) * (step - w), step
    return w


def _profile(x: np.ndarray) -> np.ndarray:
    """Logarithms of the mean shares of trigrams, for rows of roots of shares."""
    return np.log((1 - SMOOTHING) * np.einsum("ij,ij->j", x, x) / len(x) + SMOOTHING / DIMS)


def _likelihood(x: np.ndarray, profile: np.ndarray) -> np.ndarray:
    return np.concatenate([np.square(x[i : i + _ROWS]) @ profile for i in range(0, len(x), _ROWS)])


def _floor(own: np.ndarray, others: list[np.ndarray]) -> float:
    """The mean log-likelihood halfway between a language's own texts, the lowest left out, and texts of other languages.

    Own texts are held against the profile of the other half of them, so that
    few texts do not look more alike than new ones. Without others, evenly
    spread trigrams stand for them.
    """
    halves = [(own[::2], _profile(own[1::2])), (own[1::2], _profile(own[::2]))]
    low = np.quantile(np.concatenate([_likelihood(a, p) for a, p in halves]), LOW)
    far = np.median(np.concatenate([_likelihood(x, p) for _, p in halves for x in others])) if others else np.mean(_profile(own))
    return float((low + min(far, low)) / 2)


@dataclass(frozen=True)
class Model:
    """Machines by pair of classes, over families and over the languages of each; profile and floor per language."""

    families: dict[str, tuple[str, ...]]
    machines: dict[tuple[str, str], np.ndarray]
    profiles: dict[str, tuple[np.ndarray, float]]

    def _fits(self, lang: str, x: np.ndarray) -> bool:
        """Whether trigrams are as likely in the language as those of its own texts are."""
        shares = x * x
        some = shares[shares > 0]
        if not len(some):
            return False
        profile, floor = self.profiles[lang]
        return bool(shares @ profile >= floor - SHORT * np.sqrt(some.min()))  # the rarest stands once in a short text

    def _vote(self, classes: tuple[str, ...], prefix: str, margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The class that wins most duels, margins deciding ties, and how sure its closest duel is."""
        if len(classes) == 1:
            return classes[0], 1.0
        wins = {c: (0, 0.0) for c in classes}
        for a, b in combinations(classes, 2):
            m = margins[prefix + a, prefix + b]
            for c, v in ((a, m), (b, -m)):
                wins[c] = (wins[c][0] + (v > 0), wins[c][1] + v)
        best = max(classes, key=lambda c: (wins[c], c))
        closest = min(margins[prefix + best, prefix + c] if (prefix + best, prefix + c) in margins
                      else -margins[prefix + c, prefix + best] for c in classes if c != best)
        return best, float(1 / (1 + np.exp(-4 * closest)))

    def predictor(self):
        keys = list(self.machines)
        weights = np.stack([self.machines[k] for k in keys]) if keys else np.zeros((0, DIMS + 1), "f4")
        names = tuple(sorted(self.families))

        def predict(text: str | None) -> tuple[str, float, bool]:
            if not names or not text or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, False
            x = trigrams(text)
            margins = dict(zip(keys, (weights[:, :-1] @ x + weights[:, -1]).tolist()))
            family, sure = self._vote(names, "family ", margins)
            lang, sure_too = self._vote(self.families[family], "", margins)
            return lang, sure * sure_too, self._fits(lang, x)

        return predict


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of the id as text leaves 2 by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Machines from documents with an id, a text and a ``lang`` that are not held out.

    Per language the ``per_language`` ids of the least hash are taken, of
    repeated rows of an id the least text, so the sample has a bound in rows
    and does not depend on their order.
    """
    usable = documents.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull())
    rows = usable.select("doc_id", "lang").distinct().withColumn("__salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for keys in (("lang", "__salt"), ("lang",)):  # first within parts, so that a common language is no single task
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        rows = rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per_language).drop("__n")
    chosen = rows.select("doc_id", F.col("lang").alias("__lang"))
    picked = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").filter("lang = __lang").groupBy(
        "doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, np.asarray(trigrams(t.as_py() or ""), "<f2").tobytes())
                    for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])

    found = picked.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow().sort_by("lang")
    langs, counts = np.unique(np.array(found.column("lang").to_pylist(), dtype=object), return_counts=True)
    edges = np.concatenate([[0], np.cumsum(counts)])
    matrix = np.ones((len(found), DIMS + 1), "f4")  # one copy of the sample; all below are views of it
    for i, x in enumerate(found.column("x")):
        matrix[i, :-1] = np.frombuffer(x.as_buffer(), "<f2")
    del found
    rows = {lang: matrix[low:high] for lang, low, high in zip(langs, edges, edges[1:]) if high - low >= MIN_TEXTS}
    families: dict[str, tuple[str, ...]] = {}
    for lang in rows:
        families[family_of(lang)] = (*families.get(family_of(lang), ()), lang)
    machines = {}
    for a, b in combinations(sorted(families), 2):
        machines["family " + a, "family " + b] = _machine(*([rows[x] for x in families[f]] for f in (a, b)))
    for members in families.values():
        for a, b in combinations(members, 2):
            machines[a, b] = _machine([rows[a]], [rows[b]])
    shares = {lang: x[:, :-1] for lang, x in rows.items()}
    profiles = {lang: (_profile(x).astype("f4"), _floor(x, [y for other, y in shares.items() if other != lang]))
                for lang, x in shares.items()}
    return Model(families, machines, profiles)


def identify(documents: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score", fits: str | None = None) -> DataFrame:
    """The documents with the predicted language and its score, 0 to 1, in place of columns of these names.

    ``und`` with score 0 if the text is null, empty or without a letter, or if
    nothing was learned. Only the text decides. The column ``fits``, if named,
    says whether the text is as likely in that language as its own texts are;
    it is false for texts of languages that were not learned.
    """
    documents = documents.drop(lang, score, *[fits] * bool(fits))
    added = [(lang, T.StringType(), pa.string()), (score, T.DoubleType(), pa.float64()), (fits, T.BooleanType(), pa.bool_())]
    added = added if fits else added[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.predictor()
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([x[i] for x in found], t) for i, (_, _, t) in enumerate(added)]],
                [*batch.schema.names, *[name for name, _, _ in added]])

    schema = T.StructType([*documents.schema.fields, *[T.StructField(name, t) for name, t, _ in added]])
    return documents.mapInArrow(run, schema)
