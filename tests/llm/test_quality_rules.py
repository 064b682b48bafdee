import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb

from tessera.llm import quality_rules as qr
from tessera.llm.common import table

SF = "/root/testdata/sf0.01"


def slow(rows, min_docs=10, min_share=0.05, max_removed=0.5, settings_many=25, long_words=20, long_many=10, own=0.6):
    """rows (doc_id, text, host) -> the report's tuples, by plain loops."""
    def norm(line):
        return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))

    holds, hosts, ends = defaultdict(set), defaultdict(set), defaultdict(lambda: (set(), set()))
    for _, text, host in rows:
        hosts[host].add(text or "")
        lines = sorted({norm(x) for x in (text or "").split("\n") if norm(x)}, key=lambda x: hashlib.md5(x.encode()).digest())
        for line in lines:
            holds[host, line].add(text)
            others = [x for x in lines if x != line] or [None]
            ends[host, line][0].add(others[0])
            ends[host, line][1].add(others[-1])

    def above(host, line):
        n, settings = len(holds[host, line]), min(map(len, ends[host, line]))
        many_ = long_many if len(line.split(" ")) >= long_words else settings_many
        return n >= min_docs and (n >= min_share * len(hosts[host]) or settings >= max(many_, own * n))
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        many = Counter(grams)
        hit = {i + o for i, g in enumerate(grams) if many[g] > 1 for o in range(5)}
        lines = [x for x in text.split("\n") if norm(x)]
        gone = [x for x in lines if above(host, norm(x))]
        n_gone = sum(len(norm(x).split(" ")) for x in gone)
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(hit), len(gone), n_gone, failed,
                    not failed and n_gone <= max_removed * len(words)))
    return out


def key(r):
    return tuple(str(x) for x in r)


def test_matches_sql_and_plain_loops(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = qr.report(table(spark, SF, "documents"))
    rows = sorted(map(tuple, got.collect()))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({qr.oracle()})").fetchall()
    assert rows == sorted(want)
    assert rows == sorted(slow(con.execute("SELECT doc_id, text, source FROM documents").fetchall()))
    assert any(r[6] for r in rows) and sum(r[-1] for r in rows) > 0.8 * len(rows)


def test_small_cases(spark, make_docs):
    body = "one two three four five six seven eight nine ten eleven"
    rows = [(i, f"{body} {i}\nMenu  home\tabout us", "h") for i in range(12)]
    rows += [(20, "menu home about us\nmenu home about us\nx y z a b c d", "h"), (21, None, "h"), (22, "", None),
             (23, " \n\t", None), (24, f"{body} q\nmenu home about us", "other"), (24, f"{body} q\nmenu home about us", "other"),
             (None, "a b c d e " * 5, "h"), (25, "été # * ünder <b> | " + body, None), (26, "w " * 30000, "h"),
             (27, "menu home about us\n\n" + body, "h")]
    docs = make_docs(rows).withColumnRenamed("fp", "rules").selectExpr("*", "'mine' AS bad", "7 AS doc")
    for options in ({}, {"broadcast_lines": 0}):
        assert {(r.rules, r.bad, r.doc) for r in qr.clean(docs, **options).collect()} == {("x", "mine", 7)}
        assert qr.clean(docs, **options).columns == docs.columns
    want = slow(rows)
    for options in ({}, {"broadcast_lines": 0}):
        got = [tuple(r) for r in qr.report(docs, **options).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[0]: r[-1] for r in want}[20] is False and {r[0]: r[6] for r in want}[27] == 1
    kept = {r.doc_id: r for r in qr.clean(make_docs(rows)).collect()}
    assert kept[3].text == f"{body} 3" and kept[3].n_chars == len(kept[3].text) and kept[27].text == "\n" + body
    assert set(kept) == {r[0] for r in want if r[-1]} and qr.clean(make_docs(rows)).columns == make_docs(rows).columns
    assert qr.report(make_docs([])).count() == 0


def test_copies_count_once(spark, make_docs):
    rows = [(i, "one two three four five six seven eight nine ten eleven", "h") for i in range(40)]
    assert all(r.kept and not r.n_removed_lines for r in qr.report(make_docs(rows)).collect())


def test_long_texts_count_alike(monkeypatch):
    rng = random.Random(1)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (5, 6, 20, 60, 200)] + [[b"x"] * 30]
    short = [qr._repeated(t) for t in texts]
    monkeypatch.setattr(qr, "_LONG", 4)
    assert [qr._repeated(t) for t in texts] == short and any(short)


def test_limits_hold_at_every_host_size(spark, make_docs):
    """A newsletter line in 40 and a passage in 12 of 1,000 documents go; a short line in 12 and near copies stay."""
    words = lambda i, n=14: " ".join(f"w{i}x{j}" for j in range(n))
    passage = " ".join(f"p{j}" for j in range(55))
    rows = []
    for i in range(1000):
        lines = [words(i), words(i + 5000)]
        lines[1:1] = (["subscribe to our newsletter"] if i % 25 == 0 else []) + ([passage] if i % 83 == 0 else []) + (
            ["short line"] if i % 83 == 1 else [])
        rows.append((i, "\n".join(lines), "big"))
    rows += [(2000 + i, f"{words(9000)}\n{words(9001)}\n{words(9002)} {i}", "big") for i in range(45)]
    got = {r.doc_id: r for r in qr.report(make_docs(rows)).collect()}
    removed = {d: r.n_removed_lines for d, r in got.items() if r.n_removed_lines}
    assert set(removed) == {i for i in range(1000) if i % 25 == 0 or i % 83 == 0}
    assert got[0].n_removed_words == 4 + 55 and not got[83].kept and got[25].kept and all(got[d].kept for d in got if d >= 2000)
    want = {r[0]: r[6] for r in slow(rows)}
    assert {d: r.n_removed_lines for d, r in got.items()} == want
