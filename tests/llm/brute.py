"""Plain versions of the corpus operators, one document at a time."""

import hashlib
import re
from collections import Counter, defaultdict


def space_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def stats(text):
    text = text or ""
    words = space_words(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if space_words(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in places})))


def shingle_set(text, k=5):
    words = space_words(text)
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def classes(docs, threshold=0.8):
    """(class id, links) per document in order, by an inverted index over all shingles."""
    sets = [shingle_set(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = Counter()
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                common[held[b], held[a]] += 1
    links, parent = Counter(), list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(least.get(root(i)) if sets[i] else docs[i][0], links[i]) for i in range(len(docs))]


def turns_digest(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
    whole = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in rows)
    loss = "".join(text or "" for _, role, text in rows if role == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(whole), len(loss), sha(loss)


def periodic_runs(words, least=12):
    """All runs as (start, length, period), from every period in turn."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            s, e = at, end + q
            if e - s >= max(least, 2 * q) and not any(words[s : e - p] == words[s + p : e] for p in range(1, q)):
                found.append((s, e - s, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_digest(doc_id, text):
    import zlib

    words = space_words(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = periodic_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def base_secrets(text):
    """(start, kind number, end) of the three base kinds, by expressions over the whole text."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(letters, ("password", "passwd", "secret", "token", "api_?key")))
    kinds = (rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    good = (lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24)
    return sorted((m.start(), i, m.end()) for i, k in enumerate(kinds) for m in re.finditer(k, text or "") if good[i](m))


def divergence(docs, least=10, top=10):
    """Rows (lang, source, part, item, value, rank) of (lang, source, text) documents."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))) for lang, source, text in docs]
    holders, uses, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, words in docs:
        groups.add((lang, source))
        holders[lang].update(set(words))
        uses[lang, source].update(words)
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = [t for t, n in holders[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        whole = sum((uses[lang, s] for s in sources), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(uses[lang, s]) for s in sources}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])]
    return out


# -- shards


def column_hash(*values):
    """Spark's xxhash64 over (kind, value) pairs of longs ``q`` and ints ``i``; nulls leave the hash as it is."""
    import struct

    import xxhash

    h = 42
    for kind, value in values:
        if value is not None:
            h = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", value), seed=h)
    return h - 2**64 if h >= 2**63 else h


def place_of(number, n, seed=7, rounds=6):
    """Where the shuffle puts a row number: halves of a by b places, walked until inside."""
    a = next(x for x in range(n + 1) if x * x >= n)
    b = -(-n // a)
    while True:
        left, right = divmod(number, b)
        for i in range(rounds):
            width = b if i % 2 else a
            left, right = right, (left + column_hash(("q", right), ("i", seed), ("i", i)) % width) % width
        number = left * b + right
        if number < n:
            return number


def shard_table(keys, shards, buckets, seed=7):
    """Shard and slot of rows of longs, one after the other."""
    def order(row):
        values = [("q", v) for v in row]
        return (column_hash(*values) % buckets, column_hash(("i", 1), *values), [(v is not None, v or 0) for v in row])

    out = []
    for number, row in enumerate(sorted(keys, key=order)):
        place = place_of(number, len(keys), seed)
        out.append((*row, place % shards, place // shards))
    return out
