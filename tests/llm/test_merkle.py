import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import merkle, queries

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """(root, proof steps of every node): a step is (left siblings, right siblings)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 8 * 8
            p.append((nodes[run:at[i]], nodes[at[i] + 1:run + 8]))
            at[i] //= 8
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    """Multiset of result rows for (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if text is not None else None
        groups.setdefault(lang, []).append((doc_id is not None, doc_id, plain_leaf(doc_id, source, lang, n_chars, text),
                                            plain_leaf(doc_id, source, lang, n_chars, low) if bad else None))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[g] = plain_tree([r[2] for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in keys])
    out = []
    for g, top in zip(keys, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            fold = r[3] or r[2]
            for left, right in path + top:
                fold = sha("".join(left) + fold + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path + top))
            out.append((r[1], r[2], trees[g][0], root, proof, fold, fold == root))
    return sorted(out, key=str)


def got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_table(spark, documents):
    docs = queries.op13_merkle(spark, "/root/testdata/sf0.001")
    assert got(docs) == plain([(d, t, g, s, n) for d, t, g, s, n in documents])


def test_more_than_a_block_and_uneven_runs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # rounds of 8 nodes: many rounds, many blocks
    rnd = random.Random(3)
    rows = [(i, f"Text {rnd.random()}", "abc"[min(2, i % 7)] * (1 + i % 2), "s", i) for i in rnd.sample(range(5000), 1500)]
    rows += [(7, "x", f"lang{i}", "s", 1) for i in range(70)]  # 70 groups of one row, a root of three levels
    assert got(merkle.report(spark.createDataFrame(rows, COLS).repartition(7))) == plain(rows)


def test_hot_group_over_a_block(spark):
    df = spark.range(9001).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"),
                                  F.lit(None).cast("string").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    want = plain([(i, f"T{i}", "en", None, 3) for i in range(9001)])
    assert got(merkle.report(df.repartition(5))) == want


def test_small_cases(spark, make_docs):
    rows = [(1, None, None, None, None), (None, "Ab", "de", "s", 2), (None, "Ab", "de", "s", 2), (4, "", "de", "s", 0),
            (5, "ÄÖ É Z" * 20000, "", "s", 9), (9, "A", "", "s", 1), (9, "B", "", "s", 1), (-3, "c:-", "é", "ü", -1)]
    df = spark.createDataFrame(rows, COLS).selectExpr("*", "'x' AS leaf", "1 AS root", "2 AS at", "3 AS n", "4 AS g", "5 AS found")
    assert got(merkle.report(df)) == plain(rows)
    assert got(merkle.report(df.where("doc_id = -3"))) == plain(rows[-1:])  # one row: leaf = root, empty proof
    assert got(merkle.report(df.limit(0))) == []
    assert merkle.report(make_docs([(1, "A")])).count() == 1


def test_proofs_verify_and_find_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}", "x" if i % 3 else None, "s", 1) for i in range(100)], COLS)
    m = merkle.manifest(df, ["doc_id", "text"], "lang", "doc_id")
    ok = m.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                  (merkle.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof")) == F.col("root")).alias("bad"))
    assert {tuple(r) for r in ok.collect()} == {(True, False)}


def test_plan_is_native(spark):
    plan = queries.op13_merkle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
