"""Language ID, decontamination and personal data against brute force and held-out rows."""

import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from weir.llm import decontam, langid, pii, queries


def test_language_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(held) < 300
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_numerals_are_no_letters(spark):
    """The query's rule: a text without a letter of any script is ``und``, whatever its signs."""
    texts = ["½ ½ 1", "² ① Ⅷ 〇", "_ - 1", "ª", "中", "x", "1 é", "\U0001d54f"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert [got[k] == "und" for k in range(len(texts))] == [True, True, True, False, False, False, False, False]
    assert [langid.has_letter(t) for t in texts] == [r.l for r in docs.orderBy("doc_id").selectExpr(r"text rlike '\\p{L}' as l").collect()]


def test_folded_scores_are_the_kernel_machine():
    texts = ["the cat and the dog", "le chat et le chien", "the man of the house", "la maison de la dame"] * 3
    bits = np.array([langid.presence(t) for t in texts])
    model = langid.fit(bits, ["en", "fr"] * 6)
    assert np.allclose(model.scores(bits), model.kernel(bits) @ model.weights, atol=1e-4)
    shared = (bits[0] & bits[1]).sum() / np.sqrt(bits[0].sum() * bits[1].sum())
    marks = np.concatenate([np.arange(0, 12, 2), np.arange(1, 12, 2)])
    assert model.kernel(bits)[1, int(np.flatnonzero(marks == 0)[0])] == pytest.approx(shared, rel=1e-5)


def grams(text):
    """Positions of the n-grams of a text, one by one."""
    codes = [32 if ord(c) <= 32 else ord(c) for c in text.lower()]
    out = set()
    for n in range(4):
        for i in range(len(codes) - n):
            g = 0
            for k in range(n + 1):
                g = (g * 0x01000193 + codes[i + k] + k + 1) * 0x9E3779B1 & 0xFFFFFFFF
                g ^= g >> 15
            out.add(g & langid.FEATURES - 1)
    return out


def test_query_is_the_kernel_machine_of_whole_texts(spark):
    """Each row of the query, from sets of n-grams, landmark by landmark."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs, ~langid.held_out())
    marks = [set(model.used[model.rows[:, k] > 0].tolist()) for k in range(model.rows.shape[1])]
    got = {r.doc_id: r for r in queries.op1_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.filter("doc_id % 7 = 0").collect():
        scores, sizes = np.zeros(len(model.languages)), []
        for piece in langid.pieces(r.text):
            own = grams(piece)
            kernel = np.array([len(own & m) / np.sqrt(len(own) * n) for m, n in zip(marks, model.sizes, strict=True)])
            scores += kernel @ model.weights * len(piece)
            sizes.append(len(piece))
        scores /= sum(sizes)
        assert got[r.doc_id].lang_pred == model.languages[int(scores.argmax())] and got[r.doc_id].score == pytest.approx(min(1, max(0, (scores.max() + 1) / 2)), abs=1e-4)


def test_pieces_hold_every_gram(monkeypatch):
    text = "Grüße aus der Stadt, and more of it " * 50
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (np.any([langid.presence(p) for p in langid.pieces(text)], axis=0) == whole).all()


def test_a_very_long_mixed_text(spark, documents):
    """A text of a million letters fills no bitmap: its parts decide by their lengths."""
    model = langid.learn(documents)
    of = {}
    for r in documents.collect():
        of.setdefault(r.lang, []).append(r.text)
    one, two = (" ".join(of[k]) * (1 + 700_000 // sum(map(len, of[k]))) for k in ("en", "fr"))
    texts = [(1, one[:700_000] + two[:300_000]), (2, one[:300_000] + two[:700_000])]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert got == {1: "en", 2: "fr"}


def test_language_odd_rows(spark, odd, empty, documents):
    model = langid.learn(documents)
    rows = langid.predict(odd, model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == odd.count() and all(by[k] == ("und", 0.0) for k in (1, 2, 3, 4)) and by[6][0] != "und"
    assert langid.learn(empty) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    kept = langid.identified(documents)
    assert kept.columns == documents.columns and kept.count() == documents.filter("text rlike '[A-Za-z]'").count()
    assert langid.identified(empty).count() == 0


def test_foreign_texts_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    learned, held = docs.filter(~langid.held_out()), docs.filter(langid.held_out()).withColumn("lang", F.lit(None).cast("string"))
    rng = np.random.default_rng(19)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    foreign = [
        "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος", "Быстрая коричневая лиса прыгает через ленивую собаку и бежит в лес",
        "敏捷的棕色狐狸跳过懒狗然后跑进森林里去了", "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään, jossa on paljon puita",
        draw("0123456789abcdef", 2000), draw("abcdefghijklmnopqrstuvwxyz ", 3000), "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000))),
    ]
    rows = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(foreign)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = langid.identified(learned.unionByName(held).unionByName(rows.select(docs.columns)))  # those without a label are not learned from
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [d for d in ids if d < 0]
    n_held, n_learned = held.count(), learned.count()
    kept_held = len(ids & {r.doc_id for r in held.collect()})
    assert kept_held >= 0.99 * n_held and len(ids) - kept_held >= 0.99 * n_learned


def test_all_languages_are_learned_from_rows_with_text(spark):
    rows = [(k, None, "zz") for k in range(300)] + [(1000 + k, f"one two three {k}", "aa") for k in range(2)] + [(5, "one two three 5", "aa")] * 400
    rows += [(3000 + k, None if k < 400 else f"eins zwei drei {k}", "xx") for k in range(405)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "xx"]


def test_three_hundred_languages(spark):
    rng = np.random.default_rng(23)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)] for k in range(300)}
    texts = [(k, " ".join(rng.choice(words[lang], 40)), lang) for k, lang in enumerate(sorted(words) * 4)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.languages == sorted(words)
    got = langid.predict(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_without_labels_only_texts_without_letters_go(spark, odd):
    kept = langid.identified(odd.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 6, 6, 7]


def brute_items(text, items):
    """Item ids that stand verbatim, as words, in a text."""
    flat = f" {' '.join(decontam.words(text))} "
    return {i for i, t in items if decontam.words(t) and f" {' '.join(decontam.words(t))} " in flat}


def test_wand_equals_exhaustive_scoring(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    index = decontam.Index(items)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    for r in docs:
        for passage in index.passages(r.text):
            full = {}
            for t in set(passage) & set(index.postings):
                for k, v in zip(*index.postings[t], strict=True):
                    full[k] = full.get(k, 0.0) + v
            for least in (0.05, 0.2, 0.6):
                assert {k for k, _ in index.search(passage, least)} == {k for k, v in full.items() if v >= least - 1e-12}
            assert index.reaches(passage, 0.6) or max(full.values(), default=0) < 0.6


def test_parts_of_the_items_find_and_score_alike(spark):
    """Scores rest on the statistics of all items, in however many parts they are indexed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = [r.text for r in items.collect()]
    half = [(1000 + k, None, " ".join(t.split()[: -max(1, len(t.split()) // 6)])) for k, t in enumerate(texts)]  # parts of items, some over the limits
    more = spark.createDataFrame([(d, t) for d, _, t in half] + [(None, texts[0]), (None, "clean")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    whole = {(r.doc_id, r.item_id): (r.score, r.question, r.answer) for r in decontam.contaminated(docs, items).collect()}
    for size in (3000, 500):
        got = {(r.doc_id, r.item_id): (r.score, r.question, r.answer) for r in decontam.contaminated(docs, items, size).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in whole)
    kept = [sorted(map(str, decontam.clean(docs, items, size).collect())) for size in (None, 3000)]
    assert kept[0] == kept[1] and len(kept[0]) < docs.count() and "Row(doc_id=None, text='clean')" in kept[0]


def test_passages_hold_every_run():
    index = decontam.Index([(1, "a b")])
    for n in (0, 1, 63, 64, 65, 127, 128, 129, 200, 256, 257, 300, 1000):
        text = " ".join(f"w{i}" for i in range(n))
        runs = [set(p) for p in index.passages(text)]
        for k in range(max(0, n - 63)):
            assert any({f"w{k}", f"w{min(n - 1, k + 63)}"} <= p for p in runs), (n, k)


def test_items_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i in brute_items(r.text, pairs)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert want and got == want
    assert decontam.clean(docs, items).count() == docs.count() - len({d for d, _ in want})
    few = list(decontam.parts(items, 2000))
    assert len(few) > 1 and sum(len(x.ids) for part in few for x in part) == len(pairs)


def test_a_long_item_does_not_widen_the_windows_of_short_ones(spark):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    short, middle, long = words("short", 20), words("middle", 100), words("long", 5000)
    scattered = [w for k, s in enumerate(short) for w in [s, *words(f"fill{k}x", 120)]]  # all words, far apart
    docs = {1: scattered, 2: words("a", 900) + short + words("b", 900), 3: words("c", 70) + middle, 4: words("d", 3333) + long + words("e", 50)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    items = [(1, " ".join(short)), (2, " ".join(middle)), (3, " ".join(long))]
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 1), (3, 2), (4, 3)}
    one, several = decontam.Index(items), decontam.by_length(items)
    assert len(several) == 3  # the classes change windows, not scores
    scores = lambda index, text: {index.ids[k]: s for k, s in index.search(decontam.words(text), 0.0)}
    for _, text in items:
        assert {k: s for x in several for k, s in scores(x, text).items()} == pytest.approx(scores(one, text))


UNSPACED_ITEMS = {
    1: "光合作用主要发生在植物细胞的哪个部分?答案是叶绿体中的类囊体膜。",
    2: "日本で一番高い山はどこにありますか。富士山は静岡県と山梨県にあります。",
    3: "เมืองหลวงของประเทศไทยคือเมืองใด คำตอบคือกรุงเทพมหานคร",
    4: "HTTP协议默认使用哪个端口号?默认端口是80号端口。",
}


def test_items_of_scripts_without_spaces(spark):
    """Items are found inside long runs; other sentences of the same characters, in another order, are not items."""
    fill = "今天天气很好我们一起去公园散步然后回家吃饭看书写字" * 40
    docs = {k: fill + t.replace("?", "") + fill for k, t in UNSPACED_ITEMS.items()}
    docs |= {10 + k: fill + "".join(sorted(t)) + fill for k, t in UNSPACED_ITEMS.items()} | {20: fill, 21: "的"}
    docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(UNSPACED_ITEMS.items()), "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(k, k) for k in UNSPACED_ITEMS]
    assert sorted(r.doc_id for r in decontam.clean(docs, items, 60).collect()) == [11, 12, 13, 14, 20, 21]


@given(st.text("ab_ 1漢字カなไทยั。", max_size=60), st.integers(2, 9))
def test_pieces_give_the_words_of_the_text(text, size):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontam, "SEGMENT", size)
        at, got = 0, []
        while at < len(text):
            end, following = decontam.segment(text, at)
            assert at < following <= end
            got += decontam.words(text[at:end])
            at = following
    assert got == decontam.words(text)


def test_words_of_scripts_without_spaces():
    assert decontam.words("Ab漢字仮名x9 の、c") == ["ab", "漢字", "字仮", "仮名", "x9", "の", "c"]


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma delta"), (4, "solo"), (None, "one two three"), (3, "alpha beta gamma delta")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, items).collect()}
    assert got == {(5, 3)} and decontam.clean(odd, items).columns == odd.columns
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_base(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def luhn(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def test_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find(docs).collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [want.count(f"{k}:") for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


@pytest.mark.parametrize("text", ["a@b@c.d x@y", "a@b..c @x.y a@@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 0000001.2.3.4", "4111 1111 1111 1111 1", "+1 (988) 555-2485 +12 +1234567890123456", "é a.b@c-d.e.f, x+y@z.w_"])
def test_base_edges(text):
    assert pii.joined(pii.detect(text)) == brute_base(text)


DISGUISED = [
    ("write bob.lee [at] mail (dot) example [dot] com now", "email", "bob.lee [at] mail (dot) example [dot] com"),
    ("bob at mail dot example dot com ok", "email", "bob at mail dot example dot com"),
    ("call plus one nine eight eight five five five two four eight five ok", "phone", "plus one nine eight eight five five five two four eight five"),
    ("card four one one one 1111 1111 1111 x", "card", "four one one one 1111 1111 1111"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("an bоb@mail.example.com", "email", "bоb@mail.example.com"),
    ("to 10[.]1[.]2[.]4!", "ip", "10[.]1[.]2[.]4"),
    ("a​nna@x​.com", "email", "a​nna@x​.com"),
    ("host one nine two dot one six eight dot one dot one zero up", "ip", "one nine two dot one six eight dot one dot one zero"),
    ("host 192 dot one sixty", "", ""),
    ("host 10 dot\tone dot 22\tdot seven end", "ip", "10 dot\tone dot 22\tdot seven"),
    ("host 192.168.one.7 up", "ip", "192.168.one.7"),
    ("zehn 10\npunkt\n1 punkt 2 punkt drei", "ip", "10\npunkt\n1 punkt 2 punkt drei"),
    ("card 4111 1111 one 111 1111 ok", "card", "4111 1111 one 111 1111"),
    ("to john&#64;example&#x2e;com.", "email", "john&#64;example&#x2e;com"),
    ("to jоhn&commat;example&period;com", "email", "jоhn&commat;example&period;com"),
    ("john_at_example_dot_com ok", "email", "john_at_example_dot_com"),
    ("an john_b_lee_at_mail_dot_example_dot_com", "email", "john_b_lee_at_mail_dot_example_dot_com"),
    ("write johnօр@x.com", "email", "johnօр@x.com"),
    ("à François.Müller@bücher.example.fr, merci", "email", "François.Müller@bücher.example.fr"),
    ("请联系john@x.com谢谢", "email", "john@x.com"),
    ("host 1O.0.0.1 up", "ip", "1O.0.0.1"),
    ("card 4l11 1111 1111 11I1 ok", "card", "4l11 1111 1111 11I1"),
    ("card 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"),
    ("card 3782/822463/10005", "card", "3782/822463/10005"),
]


@pytest.mark.parametrize("text,kind,want", DISGUISED)
def test_disguises_map_back(text, kind, want):
    _, found = pii.spans(text)
    if not kind:
        assert found == []
        return
    assert (pii.KINDS.index(kind), text.index(want), text.index(want) + len(want)) in found
    assert pii.redact(text) == text.replace(want, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["look at example.com", "one two three", "he was at home dot", "seven of nine at ten", "[at] the (dot)", "look_at_this_dot", "AT&T &amp; &copy; &#64;", "1.2.3.4567 Il lo", "4111.1111.1111.1112", "0123/4567/8901/2345", "für @ ein é@ü"])
def test_prose_stays(text):
    assert pii.spans(text) == ([], []) and pii.redact(text) == text


def test_long_texts_take_linear_time():
    """A million digits, 100,000 disguised addresses, and long runs of each sign."""
    began = time.perf_counter()
    assert pii.spans("1" * 1_000_000) == ([], [])
    base, found = pii.spans("bob at mail dot example dot com ok " * 100_000)
    assert base == [] and len(found) == 100_000 and found[-1][2] == 35 * 100_000 - 4
    for part in ("1.", "+1 ", "a@", "one ", "a b at ", "(at", "a@b dot ", "1 dot ", "plus ", "+1(", "a@b.co ", "192.168.1.1 one ", "é@", "&#64;", "a_at_", "_dot_", "1O", "O1.", "1 l ", "1234/", "1234.1234."):
        pii.spans(part * 100_000)
    assert time.perf_counter() - began < 90


def spans_by_all_pairs(text):
    """As ``pii.spans``, each find held against every other span."""
    base, now, chain = pii.detect(text), text, []
    for step in pii.transducers(text):
        if edits := step(now):
            chain.append(pii.Rewritten(now, edits))
            now = chain[-1].text
    added = []
    for kind, a, b in pii.detect(now) if chain else []:
        touched = False
        for r in reversed(chain):
            touched = touched or r.touched(a, b)
            a, b = r.back(a, b)
        apart = not any(a < y and x < b for _, x, y in base + added)
        wider = any(k == kind and a <= x and y <= b and (a, b) != (x, y) for k, x, y in base)
        if touched and (apart or wider):
            added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (s[1], s[0]))


def test_added_spans_equal_all_pairs():
    rng = np.random.default_rng(29)
    bits = ["a@b.co", " at ", " dot ", "bob", "10.1.2.3", "10", ".", " one ", "4111 1111 1111 1111", "+1 988 555 2485", " ", "mail", "[at]", "(dot)", "2", "\u0430", "-", "é", "&#46;", "_at_", "_dot_", "O", "4111.1111.1111.1111"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits, rng.integers(1, 14)))
        assert pii.spans(text) == spans_by_all_pairs(text), text
        assert pii.joined(pii.detect(text)) == brute_base(text)


def test_pii_odd_rows(spark, odd, empty):
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}
    out = pii.redacted(odd.unionByName(odd.limit(1).selectExpr("99 as doc_id", "'me a@b.co' as text", *odd.columns[2:])))
    last = out.filter("doc_id = 99").first()
    assert out.columns == odd.columns and (last.text, last.n_chars) == ("me [EMAIL]", 10)
    assert pii.find(empty).count() == 0 == pii.redacted(empty).count()
