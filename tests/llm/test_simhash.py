import random

import xxhash

from tessera.llm import simhash as sh
from tessera.llm.common import components, table

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({c: " " for c in b"\t\n\x0b\f\r"}).split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(pairs):
    """(key, fingerprint) -> key -> smallest key reachable."""
    up = {f: f for _, f in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = sorted(up)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                up[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for k, f in pairs:
        low[find(f)] = min(k, low.get(find(f), k))
    return {k: low[find(f)] for k, f in pairs}


def test_matches_brute_force(spark, documents):
    prints = [(d[0], slow_fingerprint(d[1])) for d in documents]
    want = slow_classes(prints)
    got = sh.report(table(spark, SF, "documents")).collect()
    assert sorted(map(tuple, got)) == sorted((k, f"{f:016x}", want[k]) for k, f in prints)


def test_dense_fingerprints_both_ways(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(150)}
    fps |= {centre[0] ^ sum(1 << b for b in rng.sample(range(40, 64), 4)) for _ in range(2500)}  # a crowded key
    fps = sorted(fps)
    df = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long")
    for segments in (3, 5, 8):
        edges = sh.link_fingerprints(df, 2, segments)
        root = {r.node: r.root for r in components(edges, "a", "b").collect()}
        pairs = [(sh._signed(f), f) for f in fps]
        assert {k: root.get(k, k) for k, _ in pairs} == slow_classes(pairs)
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.distinct().limit(2000).collect())


def test_small_cases(spark, make_docs):
    long = "word " * 40000
    rows = [(9, None), (4, ""), (7, " \t\n"), (3, "One two three four"), (3, "One two three four"),
            (1, "one TWO three\nfour"), (5, "a"), (None, "a"), (None, "lonely nameless text"), (2, long), (8, long)]
    got = {(r.doc_id, r.component_id) for r in sh.report(make_docs(rows)).collect()}
    assert got == {(9, 4), (4, 4), (7, 4), (3, 1), (1, 1), (5, 5), (None, 5), (None, None), (2, 2), (8, 2)}
    kept = sh.keep_one(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept.collect()) == [
        (0, "lonel"), (1, "one T"), (2, "word "), (4, ""), (5, "a")]
    assert sh.report(make_docs([])).count() == 0


def test_repeated_id_in_two_classes(spark, make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (0, c), (1, c), (4, a)]
    kept = sh.keep_one(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, c), (1, a), (1, b)]
