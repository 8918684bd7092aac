"""Chats, packing, near copies, subwords, languages, codes and pages."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import chat, hamming, langid, mainpage, near, packing, subwords
from tests.llm import brute
from tests.llm.conftest import SF

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# -- chats


@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "x3c", "<", "[", "a", "\n", "é", "<|", "\\x5b"]), max_size=12).map("".join))
def test_escapes_are_reversible_and_hide_controls(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text and not any(c in safe for c in chat.CONTROLS)
    for role in ("assistant", "user", text):
        piece, start, end = chat.render_message(role, text)
        assert chat.read_message(piece) == (role, text)
        assert chat.unescaped(piece[start:end]) == (text if role == "assistant" else "")


def test_turns_round_trip(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    odd = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, None, None),
           (-2, 0, "assistant", "b"), (-2, 0, "assistant", "b"), (-2, None, "assistant", "first"), (None, 1, "user", "x" * 70000)]
    turns = turns.union(spark.createDataFrame(odd, turns.schema)).withColumn("kind", F.lit(1))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_chats(chat.turn_log(turns))).collect()}
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == {c: brute.turns_digest(rows) for c, rows in by.items()}
    assert chat.read_back(chat.format_chats(chat.turn_log(turns.limit(0)))).count() == 0


def test_events_fold(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 2, 2, "delta", None, "llo"),
        (1, 2, 3, "regenerate", None, None), (1, 2, 4, "delta", None, "Good "), (1, 2, 5, "delta", None, "day"),
        (1, 1, 6, "edit", None, "hi there"), (2, 1, 0, "message", "user", None), (2, 1, 1, "edit", None, "a"), (2, 1, 2, "delta", None, "b"),
    ]
    frame = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    got = {}
    for r in chat.format_chats(frame.repartition(3)).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append(chat.read_message(r.formatted))
    assert got == {1: [("user", "hi there"), ("assistant", "Good day")], 2: [("user", "ab")]}


# -- packing


def filled(patterns, capacity):
    counts = {}
    for pattern, n in patterns:
        assert sum(s * k for s, k in pattern) <= capacity and n > 0
        for s, k in pattern:
            counts[s] = counts.get(s, 0) + k * n
    return counts


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=15))
def test_plans_use_every_piece_once(counts):
    patterns = packing.plan(counts, 40)
    assert filled(patterns, 40) == counts
    n, total = sum(k for _, k in patterns), sum(s * k for s, k in counts.items())
    assert -(-total // 40) <= n <= 2 * total / 40 + 1


def fewest(sizes, capacity):
    """Fewest bins by search over sets of pieces."""
    n, full = len(sizes), (1 << len(sizes)) - 1
    best = [(n + 1, 0)] * (full + 1)
    best[0] = (0, capacity)
    for held in range(full + 1):
        bins, used = best[held]
        for i in range(n):
            if not held >> i & 1:
                step = (bins, used + sizes[i]) if used + sizes[i] <= capacity else (bins + 1, sizes[i])
                best[held | 1 << i] = min(best[held | 1 << i], step)
    return best[full][0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_loses_nothing(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    fixed, left = packing.reduce_dominated(counts, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(sizes, 20)


def test_packed_documents(spark, documents, odd):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    strange = spark.createDataFrame([(-1, "a  b   c"), (-2, " x\n \n y <|endoftext|> "), (-3, "\n\n z"), (-4, "don't 12 34's\t\tq ")],
                                    "doc_id long, text string")
    for frame in (documents.select("doc_id", "text").union(strange), odd):
        packed = packing.pack_documents(frame, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
        want = sorted((r.doc_id is not None, r.doc_id or 0, reference.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in frame.collect())
        ids, got = {}, []
        for r in sorted(packed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.piece)):
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
            ids.setdefault(r.doc_id, []).extend(r.ids)
        for known, doc_id, x in want:
            got += x if not known or doc_id in ids else []
        if frame is not odd:
            assert [(r[1], r[2]) for r in want] == sorted(ids.items())
        assert sum(r.length for r in packed) == sum(len(x[2]) for x in want)
        places = {}
        for r in packed:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in places.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 1024
        tokens = sum(len(x[2]) for x in want)
        assert len(places) <= -(-tokens // 1024) * 1.05 + 2


def test_added_tokens_have_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from marketlens.llm.queries import QUERIES

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a<|endoftext|>b", "two words <|endoftext|> and <|endoftext|><|endoftext|>  x ", "<|endoftext", "plain", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for packed in (QUERIES["op3_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, frame, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in packed.collect()} == want


def test_packing_no_rows(none):
    assert packing.pack_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_cut():
    assert packing.cut(5, 4) == [1, 4] and packing.cut(8, 4) == [4, 4] and packing.cut(4, 4) == [4] and packing.cut(1, 4) == [1]


# -- near copies


def check_classes(spark, rows, threshold=0.8):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near.classes(frame, threshold).collect()), key=repr)
    want = sorted(((d, c, n) for (d, _), (c, n) in zip(rows, brute.classes(rows, threshold))), key=repr)
    assert got == want


def near_rows():
    pick, rows = random.Random(3), []
    for base in range(12):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(pick.choice([4, 12, 60, 300]))]
        for _ in range(pick.randint(1, 9)):
            copy = list(words)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = f"v{pick.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n"), (5, rows[3][1]), (None, rows[3][1]), (None, "alone here"), (903, "alone  here")]


def test_classes_equal_brute_force(spark, documents):
    check_classes(spark, near_rows())
    check_classes(spark, [(r.doc_id, r.text) for r in documents.collect()])
    assert near.classes(documents.limit(0)).count() == 0


def test_no_link_is_lost_that_bands_miss(spark):
    rows, length = [], near.prefix_length(0.8)
    for seed in (593, 3398, 3535):  # found by search: similarity 12 / 15, no band in common
        pick = random.Random(seed)
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(22)]
        x, y = " ".join(words[:16]), " ".join(words[:19])
        assert not (near.tree_keys(near.shingles(x), length) == near.tree_keys(near.shingles(y), length)).any()
        rows += [(len(rows), x), (len(rows) + 1, y), (len(rows) + 2, y.replace(" ", "  "))]
    rows += [(100 + i, " ".join([t, *f"one more word {i}".split()])) for i, (_, t) in enumerate(rows)]
    check_classes(spark, rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert near.one_of_each(frame).count() == len({c for c, _ in brute.classes(rows)})


def test_large_groups_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_NODES", 3)
    check_classes(spark, near_rows())


def test_one_of_each(spark, odd):
    rows = near_rows()
    for frame in (spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)),
                  spark.createDataFrame([r for r in rows if r[0] not in (None, 5)], "doc_id long, text string")):
        docs = [(r.doc_id, r.text) for r in frame.collect()]
        found = brute.classes(docs)
        kept = near.one_of_each(frame)
        assert kept.columns == frame.columns
        texts = [r.text for r in kept.collect()]
        worded = [(c, t) for (d, t), (c, _) in zip(docs, found) if brute.space_words(t)]
        assert len(texts) == len({repr(c) for c, _ in worded}) + len(docs) - len(worded)
    assert near.one_of_each(odd).count() == 4 + 4  # those without words, and one each of four texts


def test_shingles_are_told_apart(documents):
    for r in documents.collect():
        assert len(near.shingles(r.text)) == len(brute.shingle_set(r.text))


def test_prefix_reaches_the_recall():
    n = near.prefix_length(0.8)
    assert 1 - (1 - 0.8**n) ** near.TREES >= near.TARGET_RECALL > 1 - (1 - 0.8 ** (n + 1)) ** near.TREES


# -- subwords


def test_ids_equal_the_library(documents, odd, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    strange = spark.createDataFrame([(1, "  two  blanks "), (2, "\n\ttab"), (3, "日本語 ß € 🎉🎉 ok"), (4, "aaaaaaaaaaaaaaaaaaaa"), (5, " "),
                                     (6, "naïve café\r\nx"), (7, "http://www.example.com/?q=1&b=2")], "doc_id long, text string")
    for frame in (documents, odd, strange):
        for r in subwords.encode_texts(frame, PIECES).collect():
            assert r.ids == model.encode(r.text or "")
        back = subwords.decode_ids(subwords.encode_texts(frame, PIECES), PIECES)
        assert all(r.decoded == (r.text or "") for r in back.collect())
        assert all(r.round_trip for r in subwords.digests(frame, PIECES).collect())
    assert subwords.digests(documents.limit(0), PIECES).count() == 0


def test_automaton_gives_the_merges(spark):
    c = subwords.codec(PIECES, "bpe")
    pick = random.Random(1)
    for _ in range(500):
        word = "".join(pick.choice("▁abcdeinorst") for _ in range(pick.randint(1, 14)))
        if all(map(c.ids.get, word)) and "▁" not in word.lstrip("▁"):
            assert [c.pieces[i] for i in c._word(word)] == c.merges(word)


def test_unigram_takes_the_best_sum():
    c = subwords.Codec(PIECES, "unigram")
    pick = random.Random(2)
    for _ in range(100):
        word = "".join(pick.choice("abenot") for _ in range(pick.randint(1, 9)))

        def best(rest):
            return max(((c.scores[c.ids[rest[:k]]] + best(rest[k:])) for k in range(1, len(rest) + 1) if rest[:k] in c.ids), default=-1e9) if rest else 0.0

        assert sum(c.scores[i] for i in c._word(word)) == pytest.approx(best(word))


# -- languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.train(docs)).select("lang", "lang_pred", "score", langid.held_out().alias("h")).collect()
    held = [r for r in got if r.h]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(documents, odd, none, spark):
    model = langid.train(documents)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "und")} <= got and (7, "und") not in got
    assert langid.identify(odd, model).columns.count("score") == 1
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(documents, langid.train(none)).collect()} == {"und"}


def test_stage_rejects_what_was_not_learned(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.01").select("doc_id", "text", "lang", "source").localCheckpoint()
    pick = random.Random(8)
    gibberish = " ".join("".join(pick.choice("bcdfghjklmnpqrstvwxz") for _ in range(pick.randint(2, 9))) for _ in range(80))
    foreign = [
        "В начале было слово и слово было у бога и никто не знал что делать дальше", "今天天气很好我们去公园散步吧然后吃饭",
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", gibberish]
    planted = spark.createDataFrame([(-i, t, None, "x") for i, t in enumerate(foreign, 1)], "doc_id long, text string, lang string, source string")
    before = {r.doc_id: r for r in docs.union(planted).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(planted), "").collect()}
    assert not {-i for i in range(1, len(foreign) + 1)} & kept
    gone = [r.text for i, r in before.items() if i >= 0 and i not in kept]
    assert len(gone) <= 0.005 * len(before), gone


# -- codes


def test_neighbours_are_exact(spark):
    pick = random.Random(4)
    base = [pick.getrandbits(64) - 2**63 for _ in range(30)]
    rows = [(i, pick.choice(base) ^ (1 << pick.randrange(63)) * pick.randint(0, 1)) for i in range(400)] + [(None, 1), (401, None)]
    frame = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming.nearest(frame, frame.filter("id % 50 = 0"), k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    codes = {i: c for i, c in rows if i is not None and c is not None}
    want = {q: sorted(((codes[q] ^ c) % 2**64).bit_count() * 10**6 + i for i, c in codes.items() if i != q)[:7] for q in codes if q % 50 == 0}
    assert {q: [d * 10**6 + i for d, i in x] for q, x in got.items()} == want


def _close_codes(seed, count):
    pick = random.Random(seed)
    base = [pick.getrandbits(64) for _ in range(40)]
    return np.array([pick.choice(base) ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 9))) for _ in range(count)], "u8")


@pytest.mark.parametrize("count", [1, 2, 30, 3000])
@pytest.mark.parametrize("k", [1, 10])
def test_radius_grows_as_far_as_needed(count, k):
    """The k nearest are met, and a radius less would not have covered the last of them."""
    codes = np.unique(_close_codes(8, count))
    index, wanted, radii = hamming.Index(codes, hamming.segments_for(len(codes))), np.ones(len(codes), "i8"), []
    for query in [*codes[:40], *_close_codes(9, 40)]:
        at, distance, radius = index.search(query, wanted, k)
        every = np.sort(np.bitwise_count(codes ^ query).astype("i4"))
        assert len(set(at)) == len(at) and (np.sort(distance)[:k] == every[:k]).all()
        if len(codes) >= k and radius:
            assert every[k - 1] > len(index.parts) * radius - 1
        radii.append((radius, len(at)))
    if count == 3000 and k == 10:
        assert sum(r == 1 for r, _ in radii) > 5 and sum(r > 1 for r, _ in radii) > 5
        assert sum(n for _, n in radii) < 0.5 * len(radii) * len(codes)


def test_blocks_of_codes_and_queries_are_tasks_of_their_own(spark, monkeypatch):
    codes = spark.createDataFrame([(i, int(c) - 2**63) for i, c in enumerate(_close_codes(2, 600))], "id long, code long")
    queries = codes.filter("id % 5 = 0")
    whole = sorted(tuple(r) for r in hamming.nearest(codes, queries).collect())
    monkeypatch.setattr(hamming, "BLOCK_CODES", 70)
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 50)
    cut = hamming.nearest(codes, queries)
    assert sorted(tuple(r) for r in cut.collect()) == whole and len(whole) == 1200
    assert "REPARTITION_BY_NUM" in cut._jdf.queryExecution().toString()


def test_codes_of_few_and_odd_vectors(spark):
    rows = [(0, [1.0, -1.0]), (1, [1.0, float("nan")]), (2, None), (3, []), (50, [-1.0, None])]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").select("id", hamming.sign_code().alias("code"))
    assert {r.id: r.code for r in frame.collect()} == {0: 1, 1: 1, 2: None, 3: None, 50: 0}
    got = [tuple(r) for r in hamming.nearest(frame, frame.filter("id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0), (0, 2, 50, 1), (50, 1, 0, 1), (50, 2, 1, 1)]
    assert hamming.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_wider_vectors_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1.0] * 64), (1, [1.0] * 65)], "id long, embedding array<float>").select(
        "id", hamming.sign_code().alias("code"))
    assert frame.filter("id = 0").collect()[0].code == -1
    with pytest.raises(Exception, match="more than 64 numbers"):
        frame.collect()


# -- pages


def article_of(html):
    """What the markup of the test pages says is the article."""
    return "\n".join(b.text for b in mainpage.leaf_blocks(html) if "article" in b.tags)


@pytest.fixture(scope="module")
def model(spark):
    return mainpage.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def test_articles_of_the_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = mainpage.extract(pages, model)
    html = {r.page_id: r.html for r in pages.collect()}
    rows = got.collect()
    assert len(rows) == len(html) and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == article_of(html[r.page_id]) for r in rows) == len(rows)


def test_other_layouts(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(120).collect()
    pick, right, total = random.Random(99), 0, 0
    texts = [article_of(r.html).split("\n") for r in rows]
    for own in texts:
        page = mainpage.labelled_page([mainpage._escape(t) for t in own], [mainpage._escape(pick.choice(pick.choice(texts))) for _ in range(20)], pick)
        blocks = mainpage.leaf_blocks(page, labelled=True)
        right += sum(a == b.main for a, b in zip(model.decode(blocks), blocks))
        total += len(blocks)
    assert right >= 0.98 * total


def test_viterbi_and_marginals_equal_enumeration(model):
    from itertools import product

    blocks = mainpage.leaf_blocks("<nav><a href=x>m</a></nav><article><p>One two.<p>Three</article><footer>&copy; x</footer>")
    scores, steps = model.scores(blocks), model.steps
    value = {y: sum(s * a for s, a in zip(scores, y)) + sum(steps[a][b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=len(blocks))}
    assert tuple(map(int, model.decode(blocks))) == max(value, key=value.get)
    total = sum(np.exp(v) for v in value.values())
    main, _ = mainpage._marginals(scores, steps)
    for i, p in enumerate(main):
        assert p == pytest.approx(sum(np.exp(v) for y, v in value.items() if y[i]) / total)


def test_blocks():
    html = "<p>a&amp;b  c<br>d<p>e<b>f</b>g<ul><li>h<li>i</ul><script>x<p></script><!-- n --><table><tr><td>1<td>2</table>z &copy &#233;&nbsp;q<p>cut &am"
    assert [b.text for b in mainpage.leaf_blocks(html)] == ["a&b c d", "efg", "h", "i", "1", "2", "z © é q", "cut &am"]
    assert mainpage.leaf_blocks(None) == [] == mainpage.leaf_blocks("  <p> <!--")
    own = f"<p>{mainpage.LABEL}sign"  # a page may hold the character that marks labelled ones
    assert [(b.text, b.main) for b in mainpage.leaf_blocks(own)] == [(f"{mainpage.LABEL}sign", False)]
    assert [(b.text, b.main) for b in mainpage.leaf_blocks(own, labelled=True)] == [("sign", True)]


def test_odd_pages(spark, model):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<"), (2, "u", "<article>" + "<p>word and word." * 5000), (2, "u", "no markup at all, only text.")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = mainpage.extract(frame, model).collect()
    assert len(got) == 5 and max(r.n_chars for r in got) == 5000 * 15 - 1
    assert mainpage.extract(frame.limit(0), model).count() == 0
    assert mainpage.learn(frame.limit(0)).extract("<p>x") in ("", "x")


def test_pages_without_articles(spark):
    pick = random.Random(21)
    word = lambda: "".join(pick.choice("aeioulnrst") for _ in range(pick.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(pick.randint(18, 50))).capitalize() + "."
    rows, want = [], {}
    for i in range(60):
        own = [prose() for _ in range(pick.randint(2, 6))]
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (word() for _ in range(6)))
        rows.append((i, "u", f'<body><nav><ul>{menu}</ul></nav><div class="content">{"".join(f"<p>{t}</p>" for t in own)}</div>'
                             f"<footer>&copy; {word()}</footer></body>"))
        want[i] = "\n".join(own)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in mainpage.extract(frame, mainpage.learn(frame)).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.95 * len(want)
    few = frame.select("page_id", "url", F.lit('<nav><a href="/a">one</a></nav><main><p>Few words.</p></main><footer>&copy; x</footer>').alias("html"))
    assert {r.text for r in mainpage.extract(few, mainpage.learn(few)).collect()} == {"Few words."}


def test_copies_of_a_page_lend_once(spark):
    texts = [f"Text {i} of a page that says little but has an article around it." for i in range(4)]
    frame = spark.createDataFrame([(f"<article><p>{t}</p></article>",) for t in texts for _ in range(20)], "html string")
    lent = "".join(mainpage.labelled_pages(frame, max_labelled=4))
    assert all(t in lent for t in texts)
