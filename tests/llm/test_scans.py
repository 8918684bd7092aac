"""Periodic runs, secrets and source divergence against plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import divergence, periods, secret_scan
from marketlens.llm.queries import QUERIES
from tests.conftest import rows
from tests.llm import brute
from tests.llm.conftest import ODD, SF


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [
    [], [0] * 11, [0] * 12, [0] * 200, [0, 1] * 60, list(range(6)) * 2, list(range(50)) * 2 + [1], fibonacci(233), fibonacci(150)[3:],
    list(range(40)) + [9] * 20 + list(range(40)) + [9] * 20 + list(range(7)) * 9])
def test_runs_of_known_words(words):
    assert periods.find_runs(np.array(words, "u8")) == brute.periodic_runs(words)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_runs_of_random_words(seed):
    rnd = random.Random(seed)
    n, letters = rnd.randint(1, 200), rnd.choice((1, 2, 2, 3, 5, 30))
    words = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        s, q = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
        for i in range(s + q, min(n, s + rnd.randint(0, n))):
            words[i] = words[i - q]
    assert periods.find_runs(np.array(words, "u8")) == brute.periodic_runs(words)


def test_two_primes_agree_where_one_may_not_do(monkeypatch):
    words = list(np.random.default_rng(3).integers(0, 40, 30)) * 5
    once = periods.find_runs(np.array(words, "u8"))
    monkeypatch.setattr(periods, "_PRIMES", ((12289, 11, 12), (40961, 3, 13)))  # small enough for sums to pass the first
    assert periods.find_runs(np.array(words, "u8")) == once == brute.periodic_runs(words)


def test_convolution_is_exact():
    rng, b = np.random.default_rng(1), 8
    blocks, windows = rng.integers(0, 50, (5, b)).astype("u8"), rng.integers(0, 50, (5, 4 * b)).astype("u8")
    got = periods._differences(blocks, windows, 2 * b, 0)
    want = [[int(((w[d : d + b].astype(int) - u.astype(int)) ** 2).sum()) for d in range(2 * b)] for u, w in zip(blocks, windows)]
    assert got.tolist() == want


def test_run_query_is_the_plain_one(spark, documents):
    got = QUERIES["op11_periodic_runs"](spark, SF)
    want = [brute.run_digest(r["doc_id"], r["text"]) for r in documents.collect()]
    assert rows(got) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 10


def test_runs_of_odd_rows(odd, none):
    got = periods.run_digests(odd, plant=True)
    short = [(i, t if t is None or len(t) < 1000 else t[:3000]) for i, t, *_ in ODD]
    assert [r for r in rows(got) if r[0] != 7] == sorted((brute.run_digest(i, t) for i, t in short if i != 7), key=repr)
    long = got.filter("doc_id = 7").first()
    assert (long.n_runs, long.period, long.start) == (1, 7, 0)
    assert rows(periods.runs(odd.filter("doc_id = 7"))) == [(7, 0, 28000, 7)]
    assert periods.run_digests(none).count() == periods.runs(none).count() == 0


def crc62(body):
    crc, out = zlib.crc32(body.encode()), ""
    while len(out) < 6:
        crc, d = divmod(crc, 62)
        out = secret_scan._BASE62[d] + out
    return body + out


def node(raw):
    number, out = int.from_bytes(raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4], "big"), ""
    while number:
        number, d = divmod(number, 58)
        out = secret_scan._BASE58[d] + out
    return out


def with_check(prefix, data):
    """The only six letters that the polynomial takes, by the published creation rule."""
    def state(values):
        s = 1
        for v in values:
            top, s = s >> 25, (s & 0x1FFFFFF) << 5 ^ v
            for i in range(5):
                s ^= secret_scan._BECH32_POLYNOMIAL[i] if top >> i & 1 else 0
        return s

    spread = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    end = state(spread + data + [0] * 6) ^ 1
    return prefix + "1" + "".join(secret_scan._BECH32[d] for d in data + [end >> 5 * (5 - i) & 31 for i in range(6)])


DER = b"\x30\x82\x01\x00" + bytes(range(256))
GOOD = {
    "github": "ghp_" + crc62("A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"),
    "npm": "npm_" + crc62("zZyYxXwWvVuUtTsSrRqQpPoOnNmMlL"),
    "age": with_check("age-secret-key-", list(range(32)) + [5] * 20).upper(),
    "nostr": with_check("nsec", [3, 1] * 26),
    "xprv": node(secret_scan._PRIVATE_NODE + bytes(range(74))),
    "pem": "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + base64.encodebytes(DER).decode() + "-----END RSA PRIVATE KEY-----",
}


@pytest.mark.parametrize("kind", sorted(GOOD))
def test_checksums_decide(kind):
    scanner, secret = secret_scan.Scanner(), GOOD[kind]
    names = lambda text: [(secret_scan.KINDS[k].name, s, e) for s, k, e in scanner.spans(text) if k >= 3]
    assert names(f"é İ see {secret}, and more") == [(kind, 8, 8 + len(secret))]
    at = secret.index("MIIB") + 20 if kind == "pem" else len(secret) - 9
    broken = secret[:at] + secret[at + 4 :] if kind == "pem" else secret[:at] + ("2" if secret[at] != "2" else "3") + secret[at + 1 :]
    assert names(f"see {broken}, and more") == []
    assert names(secret + "x" * 3) == ([(kind, 0, len(secret))] if kind in ("pem", "age") else [])


PARTS = ["password", "PassWD", "secret", "ſecret", "toKen", "Token", "api_key", "APIKEY", "AKIA", "akia", "İ", "é", " ", "  ", ":", "=", "==",
         "'", '"', "\n", "abcdef", "0123456789abcdef", "ABCDEFGH01234567", "x", "-", "/+", "deadbeef" * 3, "word "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_base_spans_are_those_of_plain_expressions(parts):
    text = "".join(parts)
    assert [x for x in secret_scan.Scanner().spans(text) if x[1] < 3] == brute.base_secrets(text)


def test_secret_query_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has no secrets
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_secret_scan"](spark, sf).collect()}
    found = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = brute.base_secrets(r["text"])
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        counts = tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert got[r["doc_id"]] == (*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)
        found += len(base)
    assert found > 0


def test_secrets_of_odd_rows(spark, odd, none):
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert rows(secret_scan.report(odd)) == sorted(((r[0], *nothing) for r in ODD), key=repr)
    assert secret_scan.report(none).count() == secret_scan.spans(none).count() == secret_scan.spans(odd).count() == 0
    text = "x " * 50_000 + "Token: '" + "ab12" * 8 + "' " + GOOD["npm"]
    frame = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, None)], "doc_id long, text string, kind string")
    found = [("assign", 100_000, 100_040), ("hex", 100_008, 100_040), ("npm", 100_042, 100_082)]
    assert rows(secret_scan.spans(frame)) == sorted(((i, k, s, e, text[s:e]) for i in (1, 1, None) for k, s, e in found), key=repr)


def test_divergence_of_documents(spark, documents):
    got = rows(divergence.audit(documents, min_documents=4))
    assert got == sorted(brute.divergence([(r["lang"], r["source"], r["text"]) for r in documents.collect()], least=4), key=repr)


def test_divergence_of_odd_rows(odd, none):
    docs = [(lang, source, text) for _, text, lang, source in ODD]
    assert rows(divergence.audit(odd, min_documents=2)) == sorted(brute.divergence(docs, least=2), key=repr)
    assert rows(divergence.audit(odd)) == sorted(brute.divergence(docs), key=repr)  # no term is in ten documents
    assert divergence.audit(none).count() == 0


@pytest.mark.parametrize("bits", [25, 6])
def test_refinement_keeps_exactly_the_frequent_terms(spark, bits):
    """Long terms with long common beginnings, borders of the levels, and a bitmap of 64 bits, where most share one."""
    stems = ["a", "abc", "abcd", "abcde", "abcdefg", "abcdefgh", "abcdefghi", "é" * 4, "é" * 9, "z" * 70, "z" * 71]
    rnd = random.Random(1)
    docs = [(rnd.choice(("en", "de", None)), rnd.choice("abc"), " ".join(rnd.choices(stems, k=4)).upper()) for _ in range(60)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    assert rows(divergence.audit(frame, min_documents=6, bitmap_bits=bits)) == sorted(brute.divergence(docs, least=6), key=repr)


def test_cells_add_up(spark):
    rnd = random.Random(2)
    docs = [("en", f"s{rnd.randrange(7)}", " ".join(rnd.choices([f"w{chr(97 + i)}" for i in range(20)], k=5))) for _ in range(90)]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    assert rows(divergence.audit(frame, min_documents=3, chunk_terms=4, block_sources=2)) == sorted(brute.divergence(docs, least=3), key=repr)


def test_repeated_ids_are_one_training_text(spark):
    """One id on very many rows counts once and does not crowd other ids out."""
    from pyspark.sql import functions as F

    from marketlens.llm import langid

    words = {"en": "the house and the tree with them", "de": "das haus und der baum bei ihnen"}
    docs = spark.createDataFrame([(i, f"{words[lang]} {i}", lang) for i in range(200) for lang in [("en", "de")[i % 2]]],
                                 "doc_id long, text string, lang string")
    many = spark.range(5000).select(F.lit(0).cast("long").alias("doc_id"), F.lit(words["en"] + " 0").alias("text"), F.lit("en").alias("lang"))
    once, often = langid.train(docs, per_language=40), langid.train(docs.union(many), per_language=40)
    assert once.families == often.families == {"germanic": ("de", "en")}
    for key, w in once.machines.items():
        np.testing.assert_allclose(w, often.machines[key], atol=1e-4)


def test_prefixes_shrink_to_the_measured_recall():
    from marketlens.llm import near

    assert near.shortened({}) == 5  # what a pair at the threshold needs
    assert near.shortened({8: 90_000, 6: 5, 3: 2}) == 3 and near.shortened({8: 300_000, 3: 2}) == 5
    assert near.shortened({8: 10, 0: 1}) == 1 and near.shortened({8: 4}, threshold=0.95) == 8


def test_forest_meets_where_prefixes_are_shared(spark, documents):
    """Edges connect exactly the nodes that share a prefix in some tree, over any length."""
    from marketlens.llm import near

    signed = near.signatures(documents).filter("node is not null").select("node", "paths").distinct().cache()
    known = {bytes(r.node): np.frombuffer(r.paths, ">u2").reshape(near.TREES, near.DEPTH) for r in signed.collect()}
    for length in (1, 5, 8):
        groups = {}
        for node, paths in known.items():
            for tree in range(near.TREES):
                groups.setdefault((tree, paths[tree, :length].tobytes()), set()).add(node)
        joined = {n: n for n in known}

        def root(n):
            while joined[n] != n:
                n = joined[n]
            return n

        for held in groups.values():
            first, *others = held
            for n in others:
                joined[root(n)] = root(first)
        got = {n: n for n in known}
        want, joined = {n: root(n) for n in known}, got
        for r in near.met(signed, length).collect():
            joined[root(bytes(r.a))] = root(bytes(r.b))
        pairs = {(want[n], root(n)) for n in known}
        assert len(pairs) == len(set(want.values())) == len({root(n) for n in known})
    signed.unpersist()


def test_sample_measures_depths():
    from marketlens.llm import near

    words = [f"w{i}" for i in range(60)]
    sets = [near.shingles(" ".join(words)), near.shingles(" ".join(words[:-2])), near.shingles("something else altogether said here now")]
    sample = near._Sample(sets)
    for s, want in zip(sets, (1, 1, 0)):
        found = sample.depths(s, near.node_of(s), near.paths_of(s), 0.8)
        assert len(found) == want and all(0 < d <= near.DEPTH for d in found)


def test_references_end_with_their_run_of_text():
    from marketlens.llm import mainpage

    page = "<p>&<b>amp;</b> x&l<i>t;</i>y a&am<!-- -->p;b &amp;lt; &eacute;<b>&#233;</b> &nbsp; z</p>"
    assert [b.text for b in mainpage.leaf_blocks(page)] == ["&amp; x&lt;y a&amp;b &lt; éé z"]
