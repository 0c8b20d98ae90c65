"""Fingerprints and components against brute force."""

import itertools

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weir.llm import queries, simhash
from weir.llm.common import maybe_in
from weir.llm.components import components


def brute_fingerprint(text, k=4):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps, limit):
    """doc_id -> smallest doc_id reachable; fps: list of (doc_id, int)."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(fps), 2):
        if (a ^ b).bit_count() <= limit:
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


def test_every_document(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want_fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(list(want_fp.items()), 4)
    got = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: int.from_bytes(r.fp, "little") for r in got} == want_fp
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)


def test_query_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want_fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(list(want_fp.items()), 4)
    got = queries.op7_simhash(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", want[d]) for d, f in want_fp.items())


def test_a_fingerprint_of_one_word_names_itself(spark):
    values = [0, 1, 1 << 63, (1 << 64) - 1, *np.random.default_rng(13).integers(0, 1 << 64, 2000, np.uint64).tolist()]
    df = spark.createDataFrame([(v.to_bytes(8, "little"),) for v in values], "fp binary").coalesce(1)
    got = df.select(simhash.digits("fp").alias("digits"), simhash.number("fp").alias("number")).collect()
    assert [r.digits for r in got] == [f"{v:016x}" for v in values]
    assert [r.number % (1 << 64) for r in got] == values


def test_spark_hash_agrees(spark):
    df = spark.createDataFrame([("one two three four",)], "text string")
    got = df.select(F.xxhash64("text")).first()[0]
    assert got & (2**64 - 1) == int(next(simhash.shingle_hashes("ONE two\tthree  four", 4))[0])


def test_long_text_in_segments(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    whole = simhash.fingerprint(text, 4, 4)
    monkeypatch.setattr(simhash, "SEGMENT", 100)
    assert (simhash.fingerprint(text, 4, 4) == whole).all()
    assert int(whole[0]) == brute_fingerprint(text)


def test_golay_covering():
    values = np.random.default_rng(1).integers(0, 1 << 23, 500)
    rows, anchor = simhash.anchors(values)
    assert (np.bitwise_count(values[rows] ^ anchor) <= 4).all()
    near = simhash.nearest_anchor(values)
    assert (np.bitwise_count(values ^ near) <= 3).all() and (simhash._remainder(near) == 0).all()
    got = {(r, a) for r, a in zip(rows.tolist(), anchor.tolist(), strict=True)}
    for b in range(23):  # a neighbour's nearest anchor is among the anchors
        assert all((i, a) in got for i, a in enumerate(simhash.nearest_anchor(values ^ (1 << b)).tolist()))


def edges_of(spark, fps, limit, anchor_rows=20_000):
    nodes = spark.createDataFrame([(i, int(f).to_bytes(8, "little")) for i, f in enumerate(fps)], "node long, fp binary")
    return components(simhash.links(nodes, 1, 3, limit, anchor_rows))


def test_links_with_split_anchors(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12)
    fps = set()
    for b in base.tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.add(b ^ sum(1 << int(k) for k in flips))
    fps = sorted(fps)
    want = brute_components(list(enumerate(fps)), 4)
    for size in (20_000, 300, 7):  # no crowded anchor, crowded ones dealt again, and split after that
        got = {r.u: r.root for r in edges_of(spark, fps, 4, size).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_large_anchor_paths():
    rng = np.random.default_rng(5)
    start = int(rng.integers(0, 1 << 62))
    fps = np.array(sorted({start ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for _ in range(1500)} | set(rng.integers(0, 1 << 63, 600).tolist())), np.uint64)[:, None]
    a, b = np.nonzero(np.triu(simhash._distance(fps, fps) <= 4, 1))
    want = simhash._roots(len(fps), a, b)
    assert len(fps) > 1024 and (simhash._roots(len(fps), *simhash._links(fps, 4)) == want).all()


def wide_family(rng, n, flips):
    """``n`` rows of 1024 bits, each with ``flips`` bits of one centre changed."""
    centre = rng.integers(0, 2, 1024, dtype=np.uint8)
    rows = np.tile(centre, (n, 1))
    for row in rows:
        row[rng.choice(1024, flips, replace=False)] ^= 1
    return np.packbits(rows, axis=1, bitorder="little").view(np.uint64)


def test_large_wide_anchor_compares_all():
    rng = np.random.default_rng(9)
    fps = np.concatenate([wide_family(rng, 2, 80) for _ in range(700)] + [wide_family(rng, 400, 70)])
    fps = fps[rng.permutation(len(fps))]
    a, b = np.nonzero(np.triu(simhash._distance(fps, fps) <= 178, 1))
    want = simhash._roots(len(fps), a, b)
    assert len(fps) > simhash.TILE and (simhash._roots(len(fps), *simhash._links(fps, 178)) == want).all()


def test_crowded_wide_anchors_link_alike(spark):
    """However few fingerprints an anchor may have for one task, the same pairs are compared."""
    rng = np.random.default_rng(11)
    fps = np.concatenate([wide_family(rng, 2, 78) for _ in range(150)])  # pairs of similarity 0.8
    nodes = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(fps)], "node long, fp binary")
    got = [{r.u: r.root for r in components(simhash.links(nodes, 16, 6, 178, size)).collect()} for size in (20_000, 2)]
    near = int((np.bitwise_count(fps[::2] ^ fps[1::2]).sum(1) <= 178).sum())
    together = sum(got[0].get(i, i) == got[0].get(i + 1, -1) for i in range(0, len(fps), 2))
    assert got[0] == got[1] and near > 100 and near >= together >= 0.97 * near


def test_near_is_the_exact_distance():
    """Bits that differ late or early in a wide fingerprint count alike."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 1 << 63, (40, 8)).astype(np.uint64)
    y = x.copy()
    y[:, -1] ^= rng.integers(0, 1 << 63, 40).astype(np.uint64)
    y[::2, 0] = ~y[::2, 0]
    for limit in (0, 20, 64, 90, 118, 250):
        assert (simhash._near(x, y, limit) == (simhash._distance(x, y) <= limit)).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and set(by[1].fp) == {0} and by[3].component_id == 1 == by[2].component_id
    assert by[7].component_id == 6 and simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6]
    assert simhash.one_of_each(empty).count() == 0


def test_near_copies_at_four_fifths(spark, documents):
    """Pairs of 5-word shingle similarity 0.8 or more are in one group; unlike texts are not."""
    rng = np.random.default_rng(7)
    rows, pairs = [], []
    for r in documents.filter("length(text) > 1500").limit(40).collect():
        words = r.text.split()
        other = list(words)
        for i in rng.choice(len(words), max(1, len(words) // 60), replace=False):
            other[i] = "changed"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        rows += [(r.doc_id, " ".join(words)), (10_000 + r.doc_id, " ".join(other))]
        if len(a & b) / len(a | b) >= 0.8:
            pairs.append(r.doc_id)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **simhash.WIDE).collect()}
    assert len(pairs) > 20 and sum(got[d] == got[10_000 + d] for d in pairs) >= 0.97 * len(pairs)


def test_hot_copies_and_hubs(spark):
    """One fingerprint on most rows, and one vertex on most edges, are joined without being moved."""
    rows = [(k, "the same words here again") for k in range(3000)] + [(5000 + k, f"text number {k} of its own kind w{k * 7}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components([(d, brute_fingerprint(t)) for d, t in [rows[0], *rows[3000:]]], 4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len(rows) and all(got[d] == want.get(d, want[0]) for d in got)
    hub = [(7, 10_000 + k) for k in range(3000)] + [(20_000 + k, 10_000 + k) for k in range(500)]
    assert {r.root for r in components(spark.createDataFrame(hub, "u long, v long")).collect()} == {7}


def test_groups_of_real_documents(spark):
    """Against exact similarity of all pairs that share a shingle: few links are missed, none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: sets_of(r.text or "") for r in docs.collect()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    met = {p for ds in holders.values() for p in itertools.combinations(sorted(ds), 2)}
    near = [(a, b) for a, b in met if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    ids = sorted(sets)
    at = {d: i for i, d in enumerate(ids)}
    root = simhash._roots(len(ids), np.array([at[a] for a, _ in near]), np.array([at[b] for _, b in near]))
    rows = simhash.groups(docs).collect()
    got = {r.doc_id: r.group for r in rows}
    assert len(rows) == len(ids) and len(near) > 50
    found = sum(got[a] == got[b] for a, b in near)
    assert found >= 0.98 * len(near)
    members = {}
    for d, g in got.items():
        members.setdefault(g, []).append(d)
    assert all(len({root[at[d]] for d in ds}) == 1 for ds in members.values())
    assert simhash.one_of_each(docs).count() == len(members)


def test_rows_that_a_join_may_need(spark):
    """A map of any size says yes to all keys; a full one to all else, too."""
    rows = spark.range(2000).selectExpr("id", "-id * 7919 as k")
    keys = rows.filter("id % 50 = 0").select("k")
    for bits in (64, 1 << 10, 1 << 24):
        got = {r.id: r._maybe for r in maybe_in(rows, F.col("k"), keys, bits).collect()}
        assert len(got) == 2000 and all(got[i] for i in range(0, 2000, 50))
        assert (sum(got.values()) == 40) == (bits == 1 << 24)
    assert not any(r._maybe for r in maybe_in(rows, F.col("k"), keys.limit(0)).collect())


def test_the_map_does_not_change_what_is_kept(spark, documents, monkeypatch):
    docs = documents.unionByName(documents.limit(30)).unionByName(documents.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    kept = []
    for bits in (1 << 24, 64):
        monkeypatch.setattr(simhash, "maybe_in", lambda rows, key, keys, bits=bits: maybe_in(rows, key, keys, bits))
        kept.append(sorted(map(str, simhash.one_of_each(docs).collect())))
    assert kept[0] == kept[1] and 5 < len(kept[0]) < docs.count() - 30


def test_unlike_texts_of_one_id_both_stay(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, one), (1, two), (1, one), (2, two)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == [(1, one), (1, two)]


def sets_of(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def alike(a, b):
    return len(sets_of(a) & sets_of(b)) / len(sets_of(a) | sets_of(b)) >= 0.8


def test_repeats_and_short_texts_are_compared_as_sets(spark):
    word = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    line = word("line", 12)
    rows = [(1, word("a", 300) + f" {line}" * 40), (2, word("b", 300) + f" {line}" * 40)]  # one repeated line, else unlike
    rows += [(3, word("c", 30) + f" {line}" * 2), (4, word("c", 30) + f" {line}" * 60)]  # equal sets
    rows += [(10 + k, word(f"s{k}x", 8)) for k in range(40)] + [(100 + k, word(f"s{k}x", 9)) for k in range(40)]  # 4 shingles of 5
    rows += [(200, word("q", 7)), (201, word("q", 8)), (300, ""), (301, None)]  # 3 of 4 are too few
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 2, 3, 200, 201, 300} | {10 + k for k in range(40)}


def test_verified_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(17)
    sets = []
    for size in (4, 9, 40, 200):
        for _ in range(6):
            base = rng.integers(0, 1 << 63, size).astype(np.uint64)
            for _ in range(12):
                gone = rng.random(size) < rng.choice([0.0, 0.05, 0.12])
                sets.append(np.unique(np.concatenate([base[~gone], rng.integers(0, 1 << 63, int(gone.sum())).astype(np.uint64)])))
    side = rng.integers(0, 2, len(sets))
    for across in (None, side):
        pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if across is None or side[i] != side[j]]
        near = [(i, j) for i, j in pairs if 5 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (len(sets[i]) + len(sets[j]) - n)]
        want = simhash._roots(len(sets), *np.array(near).T)
        a, b = simhash.verified_links(sets, across)
        assert (simhash._roots(len(sets), a, b) == want).all() and len(a) < len(sets)


def test_a_large_group_is_verified_in_parts(spark):
    texts = [" ".join(f"w{i}" if i != 7 * k + 3 else f"new{k}" for i in range(300)) for k in range(30)]
    texts += [" ".join(f"w{i}" if i % 25 else f"far{i}" for i in range(300))]  # a candidate, not similar
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, bytearray(simhash.set_name(s)), len(s), i, 0) for i, s in enumerate(simhash.shingle_set(t, 5) for t in texts)]
    members = spark.createDataFrame(rows, "doc_id long, name binary, n long, node long, root long")
    assert not any(alike(t, texts[-1]) for t in texts[:-1])
    for size in (4096, 4):
        got = {r.u: r.root for r in components(simhash.verify(docs, members, 5, size)).collect()}
        assert got == dict.fromkeys(range(30), 0)
