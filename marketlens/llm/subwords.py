"""SentencePiece ids by one pass of an Aho-Corasick automaton over the pieces.

The automaton reports, at each place of a word, every piece that ends there, the
longest first, by its output links. For a unigram model the best sum of scores
is relaxed at the place. A byte-pair model has no sum to maximize: there the ids
of a beginning of a text are fixed, so a place takes the one piece that stands
behind the ids of its start as the merges would have put it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_CACHED_WORDS = 200_000
_CACHED_LETTERS = 64
_CACHED_PAIRS = 1_000_000
_PAIR_BITS = 32


def _word_pattern(pieces: Iterable[str]) -> str:
    """What cuts a text into parts that no merge joins: blanks before a run of characters that meet in pieces.

    Characters that stand side by side in a piece, also by way of others, are of
    one kind; between two kinds no piece can stand. A character that meets
    none, or that no piece has, is a part by itself.
    """
    kind: dict[str, str] = {}

    def root(c: str) -> str:
        while kind[c] != c:
            kind[c] = c = kind[kind[c]]
        return c

    meets = set()
    for piece in pieces:
        letters = piece.lstrip(MARK)
        for c in letters:
            kind.setdefault(c, c)
        for a, b in zip(letters, letters[1:]):
            kind[root(a)] = root(b)
            meets |= {a, b}
    kinds: dict[str, list[str]] = {}
    for c in sorted(kind):
        kinds.setdefault(root(c) if c in meets else "", []).append(re.escape(c))
    alone = kinds.pop("", [])
    runs = [f"[{''.join(k)}]+" for k in sorted(kinds.values(), key=len, reverse=True)]
    runs += [f"[{''.join(alone)}]"] if alone else []
    return f"{MARK}*(?:{'|'.join(runs)})|{MARK}+|[^{MARK}]" if runs else f"{MARK}+|[^{MARK}]"


class Codec:
    """Encoder and decoder for a model file with the identity normalizer and a blank put in front."""

    def __init__(self, path: str, kind: str = "bpe"):
        import ahocorasick
        import sentencepiece

        if kind not in ("bpe", "unigram"):
            raise ValueError("kind is bpe or unigram")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.kind = kind
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.unknown = model.unk_id()
        own = [i for i in range(n)
               if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in own}
        self.scores = {i: model.get_score(i) for i in own}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans words")
        # what stands for each id: its byte, nothing for a control, or the piece
        self.raw = [bytes([self.bytes[i]]) if i in self.bytes else b"" if model.is_control(i) else p.encode()
                    for i, p in enumerate(self.pieces)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.floor = min(self.scores.values()) - 10
        self.word = re.compile(_word_pattern(self.ids), re.DOTALL)
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.fit: dict[int, bool] = {}

    def merges(self, text: str) -> list[str]:
        """Byte-pair merges as defined: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` stands behind ``a``, or alone at the beginning where ``a`` is -1."""
        if len(self.fit) >= _CACHED_PAIRS:
            self.fit.clear()
        pair = [self.pieces[i] for i in (a, b) if i >= 0]
        found = self.fit[a << _PAIR_BITS | b] = self.merges("".join(pair)) == pair
        return found

    def _word(self, word: str) -> list[int]:
        """Ids of a run of known characters, or of one unknown character."""
        if len(word) == 1 and word not in self.ids:
            data = word.encode(errors="replace")
            return [self.byte_ids[b] for b in data] if len(self.byte_ids) == 256 else [self.unknown]
        last: list[int | None] = [None] * (len(word) + 1)
        if self.kind == "bpe":
            last[0], fit = -1, self.fit
            for end, (i, n) in self.automaton.iter(word):
                end += 1
                if last[end] is None:
                    before = last[end - n]
                    if before is not None:
                        found = fit.get(before << _PAIR_BITS | i)
                        if self._fits(before, i) if found is None else found:
                            last[end] = i
        else:
            best = [0.0] + [-np.inf] * len(word)
            for end, (i, n) in self.automaton.iter(word):
                score = best[end + 1 - n] + self.scores[i]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, i
        out, at = [], len(word)
        while at:
            if last[at] is None:
                raise ValueError(f"no pieces for {word!r}")
            out.append(last[at])
            at -= len(self.pieces[last[at]])
        return out[::-1]

    def _kept(self, word: str) -> list[int]:
        """Ids of a word by way of the cache; a full cache becomes the older one, so frequent words stay."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.older.get(word) or self._word(word)
            if len(word) <= _CACHED_LETTERS:
                if len(self.known) >= _CACHED_WORDS:
                    self.older, self.known = self.known, {}
                self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Merges never cross from one match of ``word`` to the next, so each is looked up alone."""
        if not text:
            return []
        words, known = self.word.findall(MARK + text.replace(" ", MARK)), self.known
        try:
            return list(chain.from_iterable([known[w] for w in words]))
        except KeyError:
            return list(chain.from_iterable([known.get(w) or self._kept(w) for w in words]))

    def decode(self, ids: list[int]) -> str:
        """The text; byte ids that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str, kind: str) -> Codec:
    return Codec(path, kind)


def encode_texts(documents: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """The documents with ``ids``, an array of ints; a null or empty text has none.

    ``path`` is a model file that all executors have. A literal U+2581 counts
    as a blank, as in the library. A column ``ids`` of the input is replaced.
    """
    documents = documents.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, kind).encode
        for batch in batches:
            ids = pa.array([encode(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return documents.mapInArrow(run, documents.withColumn("ids", F.array().cast("array<int>")).schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text of their ``ids``; null ids give an empty text."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, "bpe").decode
        for batch in batches:
            texts = pa.array([decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.withColumn("decoded", F.lit("")).schema)


def digests(documents: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """``doc_id``, ``n_ids``, ``ids_crc32`` (little-endian unsigned 32-bit ids), ``decoded_chars``, ``round_trip``."""
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_chars", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, kind)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column("text"):
                text = t.as_py() or ""
                ids = c.encode(text)
                back = c.decode(ids)
                for column, x in zip(out, (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(back), back == text)):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, types)]], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, round_trip boolean")
