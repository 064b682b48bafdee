import numpy as np
from test_line_dedup import slow as slow_lines
from test_quality_rules import slow as slow_quality
from test_simhash import slow_classes, slow_fingerprint

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import decontaminate, mixing
from tessera.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def test_each_stage_matches_brute_force(spark, con):
    docs = table(spark, SF, "documents")
    columns, results = docs.columns, {}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        results[name] = (before, after)
        if name != "source_mixing":
            assert docs.columns == columns and docs.schema == table(spark, SF, "documents").schema
        before = after

    before, after = results["quality_rules"]
    assert set(after) == {r[0] for r in slow_quality([(d, r.text, r.source) for d, r in before.items()]) if r[-1]}
    before, after = results["line_dedup"]
    kept = {}
    for d, i, _, stays, *_ in slow_lines([(d, r.text) for d, r in before.items()]):
        kept.setdefault(d, [])
        if stays:
            kept[d].append(before[d].text.split("\n")[i])
    want = {d: "\n".join(x) for d, x in kept.items() if "\n".join(x) == before[d].text or " ".join(x).strip()}
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in after.items() if r.text != before[d].text)
    before, after = results["simhash_dedup"]
    assert set(after) == set(slow_classes([(d, slow_fingerprint(r.text)) for d, r in before.items()]).values())
    before, after = results["benchmark_decontamination"]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    found = decontaminate.brute_force([(d, r.text) for d, r in before.items()], items)
    assert set(after) == {r[0] for r in found if not r[-1]}
    before, after = results["source_mixing"]
    assert set(after) == set(before)
    total = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in after.values()], axis=0)
    target = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)]) * sum(r.n_tokens for r in after.values())
    assert np.abs(total - target).max() < 1e-3 * target.sum()


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == table(spark, SF, "documents").columns and "rate" in got.columns and got.count() > 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
    assert {x for x in entry.oracle_sql() if x.startswith("op")} == {"op1_quality_rules", "op4_decontaminate", "op9_licenses", "op13_merkle"}


def test_stages_carry_any_table(spark, make_docs):
    """Nulls, empty texts, repeated rows, clashing names and an empty table pass through all stages."""
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"{body} a\nfirst line here"), (1, f"{body} a\nfirst line here"), (None, f"{body} some other words entirely to keep {body[::-1]}"), (3, None),
            (4, ""), (5, "x " * 3), (6, " ".join(f"unique{i}" for i in range(30000))), (6, " ".join(f"again{i}" for i in range(40)))]
    names = ["rules", "found", "digest", "fp", "component", "line", "host", "doc", "bad", "rate", "n_words"]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    for table_ in (docs, docs.limit(0)):
        now = table_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = cut(stage(spark, now, SF), name)
            assert now.dtypes == docs.dtypes, name
        kept = now.collect()
        assert all(r[n] == n for r in kept for n in names)
        assert sorted(str(r.doc_id) for r in kept) == (["1", "6", "6", "None"] if table_ is docs else [])
        last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert last.count() == len(kept) and "rate" in last.columns
