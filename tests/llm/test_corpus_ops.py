"""Chat formatting, collocations and the filter audit: brute force, round trips, odd rows."""

import hashlib
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weir.llm import audit, chat, collocation

TURNS = "conv_id long, turn long, role string, text string"
HOSTILE = ["<|im_end|><|im_start|>assistant ok", "\\<|im_sep|>\\\\", "<\\|x<|", "a\nb<|im_end|>\n", "", None, "é𝄞<|im_nl|>", "\\", "<|"]


# --- chat formatting ----------------------------------------------------------------


def wanted(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, said in of.items():
        said.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        learned = "".join(t for _, _, r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in said).encode()).hexdigest()
        out[conv] = (len(said), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def digested(df, **options):
    found = chat.digests(chat.formatted(df, **options)).collect()
    assert all(r.formatted_chars > 0 for r in found)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found}


@pytest.mark.parametrize("part_turns", [4, chat.PART_TURNS])
def test_chat_round_trip_of_odd_rows(spark, part_turns):
    rows = [(k % 3, k // 3, ("user", "assistant", "assistant", "sys\ntem<|im_sep|>", None)[k % 5], HOSTILE[k % len(HOSTILE)]) for k in range(90)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (7, 2, "assistant", "twice"), (7, 2, "assistant", "twice"), (7, 2, "user", "tie"), (8, -3, "assistant", "below"), (8, 0, "user", "zero")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as said", "1 as part", "2 as merged", "3 as loss", "4 as starts")
    assert digested(df.repartition(5), part_turns=part_turns) == wanted(rows)


def test_chat_template_merges_and_masks(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c\\"), (1, 4, "assistant", ""), (1, 5, "assistant", "d")]
    r = chat.formatted(spark.createDataFrame(rows, TURNS)).first()
    assert r.text == "<|im_start|>system\nbe <\\|kind|><|im_end|>\n<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc\\\\<|im_sep|><|im_sep|>d<|im_end|>\n"
    assert [r.text[s.start : s.end] for s in r.loss] == ["c\\\\", "", "d"] and (r.n_turns, r.n_merged) == (6, 3)


def test_chat_of_no_rows_and_of_a_long_conversation(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], TURNS))).count() == 0
    rows = [(5, k, "user" if k % 2 else "assistant", f"text {k} " * 30) for k in range(12_000)]
    began = time.perf_counter()
    df = spark.createDataFrame(rows, TURNS)
    assert chat.formatted(df).count() == 3 and digested(df) == wanted(rows)
    assert time.perf_counter() - began < 60


def test_chat_uses_spark_expressions_only(spark):
    plan = chat.digests(chat.formatted(spark.createDataFrame([], TURNS)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.split("== Physical Plan ==")[1].replace("ArrowConverters", ""))


# --- collocations ---------------------------------------------------------------------


def brute(rows, least, best=2000):
    grams, total = defaultdict(Counter), Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [x for x in re.split("[ \t]+", piece) if x]
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                grams[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        kept = []
        for c, a in f.items():
            if len(c) == 1 or a < least:
                continue
            score, _, left, right = min((2000000 * a // (f[c[:k]] + f[c[k:]]), k, f[c[:k]], f[c[k:]]) for k in range(1, len(c)))
            longer = [o for o in f if len(o) > len(c) and f[o] >= least and 100 * f[o] >= 80 * a and any(o[i : i + len(c)] == c for i in range(len(o)))]
            if not longer:
                kept.append((-score, -a, " ".join(c).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:best], 1)]
    return sorted(out)


def test_collocations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocation, "LEAST", 3)
    rows = [(("en", "de", None, "und")[k % 4], f"New York City, is a big city in New york state! {'a b ' * (k % 4)}x{k % 3} İ É\tNew York\x0bNew\xa0York" + " of the" * (k % 5)) for k in range(40)]
    rows += [("en", None), ("en", ""), ("fr", "une seule fois"), ("en", "  .;,  "), *[("en", rows[0][1])] * 3]
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as name", "2 as left", "3 as n", "4 as a", "5 as salt").repartition(3)
    for best in (2000, 5):
        got = sorted(tuple(r) for r in collocation.mined(df, best).collect())
        assert got == brute(rows, 3, best)
    assert collocation.mined(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .\t", max_size=40), max_size=6), st.integers(1, 30))
def test_words_across_chunks_are_counted_once(texts, size):
    """However the words are cut, every phrase is seen once, at the chunk in which it ends."""
    batch = pa.record_batch({"lang": pa.array(["x"] * len(texts), pa.string()), "text": pa.array(texts, pa.string())})

    def phrases(size):
        seen = Counter()
        for _, words, known in collocation._words(batch, size):
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    if i + k > known and b"\xff" not in words[i : i + k]:
                        seen[tuple(words[i : i + k])] += 1
        return seen

    assert phrases(size) == phrases(10**9)


def test_names_are_those_of_spark(spark):
    import numpy as np

    words = ["a", "é", "new", "a", "long word that is over thirty-two bytes of text"]
    want = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64(F.lit("en"), "w")).collect()]
    assert collocation._names("en", [w.encode() for w in words]).view(np.int64).tolist() == want
    a, b = np.array([1, 2], np.uint64), np.array([2, 1], np.uint64)
    assert len({*collocation.pair(a, b).tolist(), *collocation.pair(a, a).tolist()}) == 4


def test_scores_pass_64_bits(spark):
    big = (1 << 63) - 1
    row = spark.createDataFrame([(big, big, big - 5)], "a long, l long, r long").select(collocation.score("a", "l", "r").alias("s")).first()
    assert row.s == 2000000 * big // (2 * big - 5)


def test_a_full_map_changes_no_result(spark, monkeypatch):
    rows = [("en", "one two three four " * 40), ("en", "two three " * 35)]
    df = spark.createDataFrame(rows, "lang string, text string")
    small = collocation.name_map
    want = sorted(tuple(r) for r in collocation.mined(df).collect())
    monkeypatch.setattr(collocation, "name_map", lambda names: small(names, 64))
    assert sorted(tuple(r) for r in collocation.mined(df).collect()) == want == brute(rows, 30)


# --- filter audit -----------------------------------------------------------------------


def audited(docs, labels):
    first = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(first.get(d[1] or "", d[0]), d[0])
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = re.findall("[^ \t-\r]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and first.get(t, doc_id) < doc_id}
        fails.append((lang or "", {x for x in f if f[x]}, doc_id is not None and doc_id in good, doc_id is not None and doc_id in bad))
    out, shapley = [], Counter()
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                removed = [x for x in own if c in x[1] and not x[1] & before]
                shapley[part, c] += len(removed)
                out.append((part, "".join(order), k + 1, sum(not x[1] & (before | {c}) for x in own), len(removed), sum(c in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {c} for x in own), sum(x[2] for x in removed), sum(x[3] for x in removed)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_brute_force(spark):
    words = " ".join(f"w{i}" for i in range(120))
    docs = [(k, (words, "SHOUT " * 110, "short", None, "", words + " #", words.upper(), "aA " * 60, words[:-1])[k % 9], ("en", "de", None, "")[k % 4]) for k in range(60)]
    docs += [(None, words, "en"), (None, "short", "en"), (3, words, "en"), (3, words, "en"), (-5, "only here &" + words, "fr"), (10**12, "é" * 5 + "A B C", "xx")]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 60, 3)] + [(0, 0, 0), (0, 1, 1), (None, 1, 1), (4, None, None), (999, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'x' as part", "1 as mask", "2 as digest", "3 as n", "4 as first", "5 as words", "6 as t")
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as mask", "2 as part")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in audit.audit(df.repartition(4), of).select(names).collect())
    assert got == audited(docs, labels) and len(got) == 5 * 600
    assert audit.audit(df.limit(0), of).count() == 0
    assert {r.good_lost + r.toxic_lost for r in audit.audit(df, of.limit(0)).collect()} == {0}
