"""Neighbour search against brute force, and shards against plain rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import ann, queries, shards


def brute(rows, ask, k=20):
    """``query -> [(vec_id, score)]`` over all pairs."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if ask(i):
            s = (x * np.array(v, float)).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_of_the_query(spark):
    got = queries.op9_neighbours(spark, "/root/testdata/sf0.1").collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, near in want.items():
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        scores = dict(brute_scores(rows, q))
        assert all(s == pytest.approx(scores[v], abs=1e-12) for _, v, s in own)
        hits += len({v for v, _ in near} & {v for _, v, _ in own})
    assert hits / (20 * len(want)) >= 0.95


def brute_scores(rows, q):
    v = np.array(dict(rows)[q], float)
    return [(i, float((np.array(x, float) * v).sum())) for i, x in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as q", "2 as v", "3 as entry", "4 as bucket")


def answers(df, k=20, **options):
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k, **options).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_copies_lengths_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)).astype(np.float32) * rng.uniform(0.5, 3, (60, 1)).astype(np.float32)
    rows = [(i, base[i].tolist()) for i in range(60)] + [(100 + i, base[0].tolist()) for i in range(50)]
    odd = [(201, None), (202, []), (203, [0.0] * 6), (204, [float("nan")] + [1.0] * 5), (205, [None] + [1.0] * 5), (206, [float("inf")] * 6), (207, [1.0] * 5), (None, [1.0] * 6), rows[1]]
    want = {q: [(v, round(s, 9)) for v, s in near] for q, near in brute(rows, lambda i: i % 20 == 0).items()}
    got = answers(frame(spark, rows + odd), plan=ann.Plan(8, 1, 16))  # all axes: exact
    assert got == want
    assert answers(frame(spark, rows + odd), plan=ann.Plan(8, 1, 16), bucket_rows=5) == want
    assert answers(frame(spark, rows[:3]), plan=ann.Plan(8, 1, 16)) == {0: [(v, round(s, 9)) for v, s in brute(rows[:3], lambda i: i == 0)[0]]}
    assert answers(frame(spark, rows).limit(0)) == {}


def test_unlike_vectors_of_one_id_are_rows_of_their_own(spark):
    """Each is a query with its own ranks, and a candidate of the others of its id."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)] + [(20, rng.normal(size=5).astype(np.float32).tolist()) for _ in range(2)] + [(7, rng.normal(size=5).astype(np.float32).tolist())]
    rows.append(rows[20])  # once more, as it is
    different = [r for k, r in enumerate(rows) if r not in rows[:k]]
    want = []
    for k, (i, v) in enumerate(different):
        if i % 20 == 0:
            scores = sorted((-float((np.array(x, float) * np.array(v, float)).sum()), j) for n, (j, x) in enumerate(different) if n != k)
            want += [(i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(scores[:4], 1)]
    for plan in (ann.Plan(8, 1, 16), ann.Plan(1, 1, 1)):  # all axes, and one that must ask again
        got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, 4, plan=plan).collect()]
        if plan.tables == 8:
            assert sorted(got) == sorted(want)
        assert sum(g[:2] == (20, 1) for g in got) == 3 and len(got) == len(want)


def test_cells_of_several_levels_meet_what_one_level_meets(spark):
    """All cells of two levels are exact; some of them give true scores in their order."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = {q: [(v, round(s, 9)) for v, s in near] for q, near in brute(rows, lambda i: i % 20 == 0).items()}
    assert answers(frame(spark, rows), plan=ann.Plan(1, 2, 48 * 48)) == want
    got = answers(frame(spark, rows), plan=ann.Plan(8, 2, 256), bucket_rows=7)
    for q, near in got.items():
        all_scores = {v: round(s, 9) for v, s in brute_scores(rows, q)}
        assert len(near) == 20 and all(all_scores[v] == pytest.approx(s, abs=1e-8) for v, s in near) and near == sorted(near, key=lambda p: (-p[1], p[0]))
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]) >= 18


def test_near_ties_and_large_components(spark):
    """Scores that single precision cannot tell apart, and components that overflow it, are ranked exactly."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 1e-9 * rng.normal(size=16)).tolist()) for i in range(200)]
    rows += [(1000 + i, (1e25 * rng.normal(size=16)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, plan=ann.Plan(2, 1, 64)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, lambda i: i % 20 == 0)
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [v for v, _ in near] for q, near in want.items()}


def test_fitted_plans_meet_less_of_a_larger_table(spark):
    """Recall holds on ten times the vectors, of which a query meets a smaller share."""
    shares = {}
    for n in (2000, 20_000):
        x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        asked = F.col("vec_id") % 200 == 0
        entries = df.select(F.col("vec_id").alias("entry"), F.col("embedding").cast("array<double>").alias("embedding"), F.when(asked, True).alias("asked"))
        plan, recall = ann.fit(entries, 20, 0.0)
        assert recall >= ann.FIT_RECALL
        want = brute(rows, lambda i: i % 200 == 0)
        got = {}
        for r in ann.search(df, asked, plan=plan).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len({v for v, _ in want[q]} & got[q]) for q in want]) >= 18
        hits = [ann.cells(x.astype(float), t, plan.levels, 1)[:, 0][None] == ann.cells(x[::200].astype(float), t, plan.levels, plan.probes)[:, :, None] for t in range(plan.tables)]
        shares[n] = float(np.mean(np.any([h.any(1) for h in hits], axis=0)))
    assert shares[20_000] < 0.8 * shares[2000]


@pytest.mark.parametrize("n,size", [(1, 8), (2, 8), (13, 64), (300, 64)])
def test_no_query_goes_short(spark, n, size):
    """Few probes meet too few entries; the exact search then gives all there are to give."""
    x = np.random.default_rng(n).normal(size=(n, size)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(frame(spark, rows), plan=ann.Plan(1, 1, 1))
    want = {q: [(v, round(s, 9)) for v, s in near] for q, near in brute(rows, lambda i: i % 20 == 0).items() if near}
    assert got == want


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 10))
    y = ann.rotated(x, 3)
    assert np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1) * 16**1.5)
    assert np.allclose(ann.hadamard(np.eye(4)) @ ann.hadamard(np.eye(4)).T, 4 * np.eye(4))
    near = ann.nearest_axes(x, 0, 32)[0]
    assert (near[:, :1] == ann.nearest_axes(x, 0, 1)[0]).all() and all(len(set(r)) == 32 for r in near.tolist())


def test_shards_compact_by_tier(spark, documents, tmp_path):
    store = shards.Shards(spark, str(tmp_path / "s"), documents.schema, base_bytes=20_000, target_bytes=200_000)
    for k in range(9):
        store.append(documents.filter(f"doc_id % 9 = {k}"))
    before = store.manifest()
    assert before["version"] == 9 and len(before["shards"]) == 9
    after = store.compact(keep=100)
    tiers = [store.tier(s) for s in after["shards"]]
    open_tiers = [store.tier(s) for s in after["shards"] if s["bytes"] < 200_000]
    assert all(open_tiers.count(t) < shards.FAN_IN for t in open_tiers) and len(tiers) < 9
    assert store.plan({"shards": [{"id": str(k), "bytes": 200_000, "rows": 1} for k in range(8)]}) is None  # done: not merged again
    assert sum(s["rows"] for s in after["shards"]) == documents.count()
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(store.read()) == same(documents) == same(store.read(9))
    store.vacuum(keep=1)
    assert store.versions() == [after["version"]] and same(store.read()) == same(documents)
    for s in after["shards"]:
        files = [f for f in (tmp_path / "s" / s["id"]).glob("*.parquet")]
        assert len(files) <= max(1, -(-s["bytes"] // 200_000))


def test_two_writers_cannot_commit_one_version(spark, documents, tmp_path):
    store = shards.Shards(spark, str(tmp_path / "s"), documents.schema)
    start = store.manifest()
    store.append(documents)
    with pytest.raises(shards.Conflict):
        store.commit(start, [], [])
    assert store.read().count() == documents.count()


def test_conflicts_leave_no_files(spark, documents, tmp_path, monkeypatch):
    """A merge that loses takes its files away; an append that loses goes on from the winner."""
    store = shards.Shards(spark, str(tmp_path / "s"), documents.schema)
    for k in range(4):
        store.append(documents.filter(f"doc_id % 4 = {k}"))
    folders = lambda: sorted(p.name for p in (tmp_path / "s" / "data").iterdir())
    before, commit = folders(), store.commit
    stale = store.manifest(3)
    monkeypatch.setattr(store, "commit", lambda now, gone, new: commit(stale, gone, new))
    with pytest.raises(shards.Conflict):
        store.compact()
    assert folders() == before
    monkeypatch.setattr(store, "commit", commit)
    manifest, calls = store.manifest, []
    monkeypatch.setattr(store, "manifest", lambda *v: manifest(3) if not calls.append(1) and len(calls) == 1 else manifest(*v))
    assert store.append(documents)["version"] == 5 and len(calls) == 2
    assert store.read().count() == 2 * documents.count()
    sizes = {s["bytes"] for s in store.manifest()["shards"]}
    own = documents.agg(F.sum(F.octet_length("text") + F.octet_length("lang") + F.octet_length("source") + 16)).first()[0]
    assert own in sizes


def test_shards_of_odd_rows(spark, odd, empty, tmp_path):
    rows = odd.withColumn("_other", F.lit("a/b=c"))
    store = shards.Shards(spark, str(tmp_path / "s"), rows.schema, base_bytes=10)
    store.append(rows, F.col("source"))
    store.append(rows, F.col("_other"))
    store.append(rows.limit(0))
    assert sum(s["rows"] for s in store.manifest()["shards"]) == 2 * rows.count()
    store.compact()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, rows.union(rows).collect()))
    none = shards.Shards(spark, str(tmp_path / "e"), empty.schema)
    assert none.read().count() == 0 and none.compact()["version"] == 0
