"""The pipeline against the stages' brute force on the smallest tables."""

from test_packing import check
from test_text_ops import brute_items

import corpus_pipeline
from weir.llm import pii


def test_stages_in_order(spark, documents):
    sf = "/root/testdata/sf0.001"
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert after.columns == documents.columns
        seen[name] = {r.doc_id: r.text for r in after.collect()}
        docs = after
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert seen["language_id"] == texts  # all of these have letters and a language

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = set(seen["near_duplicates"])
    for a in texts:
        others = [b for b in texts if b != a]
        if a not in kept:
            assert max(near(a, b) for b in others) >= 0.8, a  # nothing unlike is dropped
        else:
            assert all(near(a, b) < 0.8 for b in others if b in kept), a  # no two near copies stay
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d in kept if not brute_items(texts[d], items)}
    assert set(seen["decontamination"]) == clean
    assert seen["pii"] == {d: pii.redact(texts[d]) for d in clean}
    assert all(not pii.detect(t) for t in seen["pii"].values())


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check(rows, 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]


def test_run_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (2, "never said here"), (None, "x")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if name == "empty":
            assert rows == []
            continue
        # null, empty and letterless texts have no language; 6 and its copies are one; the text without an id stays
        assert sorted({r.doc_id or 0 for r in rows}) == [0, 5, 6]
        assert sum(r.length for r in rows if r.doc_id == 5) > 80_000 and len([r for r in rows if r.doc_id == 6]) == 1


def test_stages_keep_other_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[3:4]:
        assert stage(spark, odd, "").columns == odd.columns, name
    assert corpus_pipeline.STAGES[2][1](spark, odd, "/root/testdata/sf0.001").columns == odd.columns == corpus_pipeline.STAGES[0][1](spark, odd, "").columns


def test_columns_may_have_the_names_used_inside(spark):
    """Near-duplicates and decontamination by parts keep a user's columns of any name, texts and numbers alike."""
    from weir.llm import decontam, simhash

    inner = ["_text", "_at", "_word", "_bits", "_maybe", "_kept", "_copy", "_doc", "copy", "row", "of", "said", "group", "name", "n", "p"]
    story = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, story(k % 7)) for k in range(12)] + [(3, story(3)), (None, story(1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, story(2)), (2, story(50) + " only here"), (3, story(5))], "item_id long, text string")
    for kind in ("string", "bigint"):
        wide = docs.selectExpr("*", *(f"cast(coalesce(doc_id, -1) * 100 + {i} as {kind}) as `{c}`" for i, c in enumerate(inner)))
        value = lambda d, i, kind=kind: str(d * 100 + i) if kind == "string" else d * 100 + i
        for got, left in ((simhash.one_of_each(wide), [None, 0, 1, 2, 3, 4, 5, 6]), (decontam.clean(wide, items, 3000), None), (decontam.clean(wide, items), None)):
            found = got.collect()
            assert got.columns == wide.columns and all(r[c] == value(-1 if r.doc_id is None else r.doc_id, i) for r in found for i, c in enumerate(inner))
            want = [d for d, t in rows if t not in (story(2), story(5))] if left is None else left
            assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == sorted((d is not None, d or 0) for d in want)
