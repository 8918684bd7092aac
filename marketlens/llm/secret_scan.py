"""Secrets in texts: a keyword automaton, anchored expressions at its hits, checksums inside the candidates.

An Aho-Corasick automaton goes once over the lower-case text and reports where a
keyword stands; only there is an expression tried, anchored at the keyword. Runs
of hexadecimal digits have no keyword: for them the automaton's word is 24 times
the one letter that stands for all hexadecimal digits in a second view of the
text. Kinds that carry a checksum of their own are secrets only if it is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Alphabets, prefixes and checksum constants of the public formats.
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_POLYNOMIAL = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_PRIVATE_NODE = b"\x04\x88\xad\xe4"
_OPENSSH = b"openssh-key-v1\x00"


def crc62(candidate: str) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    crc, digits = zlib.crc32(candidate[-36:-6].encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = _BASE62[d] + digits
    return candidate[-6:] == digits


def bech32(candidate: str) -> bool:
    """The check polynomial over prefix and data leaves one."""
    low = candidate.lower()
    prefix, _, data = low.rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [_BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(_BECH32_POLYNOMIAL):
            state ^= g if top >> i & 1 else 0
    return state == 1


def private_node(candidate: str) -> bool:
    """78 bytes in base 58 under the version of private nodes, then four bytes of their double SHA-256."""
    number = 0
    for c in candidate:
        number = number * 58 + _BASE58.index(c)
    if number >> 8 * 82:
        return False
    raw = number.to_bytes(82, "big")
    return raw[:4] == _PRIVATE_NODE and hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def key_block(candidate: str) -> bool:
    """The body is whole: an OpenSSH container or one DER sequence that is as long as it says."""
    body = "".join(line for line in candidate.split("\n")[1:-1] if ":" not in line)
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if raw.startswith(_OPENSSH):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    size = raw[1] & 0x7F
    return 0 < size <= 4 and len(raw) == 2 + size + int.from_bytes(raw[2 : 2 + size], "big")


@dataclass(frozen=True)
class Kind:
    """What starts with one of ``keywords`` (lower case), matches ``pattern`` from there, and passes ``valid``.

    A match that fails ``valid`` is dropped, but the search for the kind goes on
    behind its end, as without the test.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    valid: Callable[[re.Match], bool]
    hex_view: bool = False


#: The kinds of every scan, in the order that decides between spans of one start.
BASE = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Kind("hex", ("0" * 24,), r"[0-9a-f]+", lambda m: True, hex_view=True),
)
#: Kinds with a checksum inside.
CHECKED = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc62(m[0])),
    Kind("npm", ("npm_",), r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])", lambda m: crc62(m[0])),
    Kind("age", ("age-secret-key-1",), r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![0-9A-Z])", lambda m: bech32(m[0])),
    Kind("nostr", ("nsec1",), r"nsec1[02-9ac-hj-np-z]{58}(?![0-9a-z])", lambda m: bech32(m[0])),
    Kind("xprv", ("xprv",), r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])", lambda m: private_node(m[0])),
    Kind("pem", ("-----begin ",),
         r"-----BEGIN ((?:[A-Z0-9]+ )?PRIVATE KEY)-----\r?\n(?:[A-Za-z0-9+/=:,\x20.\r\n]|-(?!-))+?\n-----END \1-----", lambda m: key_block(m[0])),
)
KINDS = BASE + CHECKED

#: All hexadecimal digits as one letter; the rest as a blank where it is ASCII.
_HEX_VIEW = bytes(0x30 if chr(i) in "0123456789abcdef" else 0x20 if i < 128 else i for i in range(256))


class Scanner:
    """Automata and expressions of the kinds; one serves all rows of a task."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        self.views = {}
        for hex_view in (False, True):
            words: dict[str, list[int]] = {}
            for i, k in enumerate(kinds):
                if k.hex_view == hex_view:
                    for w in k.keywords:
                        words.setdefault(w, []).append(i)
            if words:
                automaton = ahocorasick.Automaton()
                for w, owners in words.items():
                    automaton.add_word(w, (len(w), owners))
                automaton.make_automaton()
                self.views[hex_view] = automaton

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in order; per kind what its expression finds from the left, without overlaps.

        Two keywords of a kind do not start at one place unless one begins the
        other, and then the expression decides at that place alone.
        """
        # lower case and classes are taken of ASCII alone, so places stay the same
        raw = text.encode("utf-8", "surrogatepass")
        found = []
        for hex_view, automaton in self.views.items():
            view = raw.translate(_HEX_VIEW) if hex_view else raw.lower()
            done = [0] * len(self.kinds)
            hits = automaton.iter(view.decode("utf-8", "surrogatepass"))
            starts = sorted((end - size + 1, owners) for end, (size, owners) in hits) if not hex_view else (
                (end - size + 1, owners) for end, (size, owners) in hits)
            for start, owners in starts:
                for i in owners:
                    if start < done[i]:
                        continue
                    match = self.patterns[i].match(text, start)
                    if match:
                        done[i] = match.end()
                        if self.kinds[i].valid(match):
                            found.append((start, i, match.end()))
        return sorted(found)


@lru_cache(maxsize=4)
def _scanner(kinds: tuple[Kind, ...]) -> Scanner:
    return Scanner(kinds)


def spans(documents: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Every secret as a row: ``doc_id``, ``kind``, ``start``, ``end`` (code points, end exclusive) and ``secret``, its text.

    Null and empty texts have none. Spans of different kinds may overlap and are
    all returned. Repeated rows give repeated results, an empty table none;
    other columns are left aside. Each row is scanned whole, by itself.
    """
    rows = documents.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(kinds)
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                here = scanner.spans(text) if text else []
                owner += [i] * len(here)
                found += [(kinds[k].name, s, e, text[s:e]) for s, k, e in here]
            values = list(zip(*found)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())),
                 *(pa.array(list(v), t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.string())))],
                names=["doc_id", "kind", "start", "end", "secret"])

    more = {"kind": "string", "start": "long", "end": "long", "secret": "string"}
    return rows.mapInArrow(work, rows.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in more.items()]).schema)


def report(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` with the counts of the base kinds, their digest and all spans.

    ``n_assign``, ``n_access``, ``n_hex``; ``base_sha256`` of the base spans as
    ``kind:start:end`` joined by commas, by start, then kind in the order of
    :data:`BASE`; ``spans``, all spans in the same form. Without a secret, with
    a null or an empty text: zeros, the digest of nothing, an empty string.
    """
    rows = documents.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(KINDS)
        nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = scanner.spans(text) if text else []
                if not found:
                    out.append(nothing)
                    continue
                listed = [(k, f"{KINDS[k].name}:{s}:{e}") for s, k, e in found]
                base = [(k, x) for k, x in listed if k < len(BASE)]
                out.append((*(sum(k == i for k, _ in base) for i in range(len(BASE))),
                            hashlib.sha256(",".join(x for _, x in base).encode()).hexdigest(), ",".join(x for _, x in listed)))
            values = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(list(v), t) for v, t in zip(values, [pa.int64()] * 3 + [pa.string()] * 2))],
                names=["doc_id", *more])

    more = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
    return rows.mapInArrow(work, rows.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in more.items()]).schema)
