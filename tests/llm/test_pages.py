"""Archives, extraction and URL lists: round trips, brute force, odd rows."""

import gzip
import hashlib
import html
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weir.llm import extract, urlfilter, warc


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def archive(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(pages, path)
    return path


def test_archive_round_trip(spark, pages, tmp_path):
    path = archive(spark, pages, tmp_path)
    got = warc.assemble(warc.read(spark, path, with_payload=True), with_payload=True).collect()
    want = {r.page_id: r.html.encode() for r in pages.collect()}
    assert {int(r.capture.split(":")[2]): bytes(r.payload) for r in got} == want
    for r in got:
        assert r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload)
        assert r.request.record == r.response.concurrent_to == r.metadata.concurrent_to


def test_archives_are_plain_warc(spark, pages, tmp_path):
    path = archive(spark, pages.limit(3), tmp_path)
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*/*.gz"))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC/1.1\r\n") == 9
    assert list(warc.parse(raw, False)) == list(warc.parse(gzip.compress(raw[:0]) + gzip.compress(raw), False))
    assert warc.read(spark, path).count() == 9


def test_revisits_and_odd_rows(spark, tmp_path):
    big, edge, small = "x" * 1200 + "é\r\n\r\nWARC/1.1\r\n", "é" * 500, "y" * 999
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (5, "u", big), (3, "u", small), (4, "u", small), (6, "u", None), (7, "u", ""), (8, "u", edge), (9, "u", edge), (9, "u", edge), (9, "u", big), (None, "u", big), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record", "'k' as kind", "2 as top")
    got = sorted(map(repr, (tuple(r) for r in warc.assemble(warc.read(spark, archive(spark, df, tmp_path))).select(
        warc.page_of(F.col("capture")), "payload_bytes", "payload_digest", "response.kind", warc.page_of(F.col("response.refers_to"))).collect())))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    of_big, of_edge = (len(big.encode()), sha(big)), (1000, sha(edge))
    assert got == sorted(map(repr, [  # one row for each page row, repeated ids and rows without one included
        (1, *of_big, "revisit", 9), (2, *of_big, "revisit", 9), (5, *of_big, "revisit", 9), (9, *of_big, "response", None), (None, *of_big, "response", None),
        (None, *of_big, "response", None), (3, 999, sha(small), "response", None), (4, 999, sha(small), "response", None), (6, 0, sha(""), "response", None),
        (7, 0, sha(""), "response", None), (8, *of_edge, "revisit", 9), (9, *of_edge, "response", None), (9, *of_edge, "response", None),
    ]))


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    rows = [(k, "u", f"{k} " + "x" * n) for k, n in enumerate([300] * 400 + [70_000] * 12 + [1_500_000] * 2)]
    path = archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), tmp_path)
    sizes = [len(gzip.open(p).read()) for p in (tmp_path / "warc").glob("*/*.gz")]
    assert 8 <= len(sizes) <= 16 and sorted(sizes)[-3] < 400_000
    assert warc.assemble(warc.read(spark, path)).filter("payload_bytes > 0").count() == len(rows)


def test_plain_archives_take_linear_time(spark, pages, tmp_path):
    archive(spark, pages, tmp_path)
    raw = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*/*.gz"))
    many = raw * (200_000_000 // len(raw))
    began = time.perf_counter()
    n = sum(1 for _ in warc.parse(many, False))
    assert n == 3 * pages.count() * (200_000_000 // len(raw)) and time.perf_counter() - began < 30


def test_one_payload_on_most_pages(spark, tmp_path):
    rows = [(k, "u", "same " * 400) for k in range(3000)] + [(9000 + k, "u", f"{k} " * 600) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.assemble(warc.read(spark, archive(spark, df, tmp_path))).select(warc.page_of(F.col("capture")).alias("p"), "response.kind", warc.page_of(F.col("response.refers_to")).alias("to"), "payload_bytes").collect()
    assert len(got) == len(rows) and all((r.kind, r.to, r.payload_bytes) == (("revisit", 2999, 2000) if r.p < 2999 else ("response", None, r.payload_bytes)) for r in got)


def test_revisits_without_a_broadcast(spark, pages, tmp_path, monkeypatch):
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    kinds = warc.read(spark, archive(spark, twice, tmp_path)).groupBy("kind").count().collect()
    n = pages.filter("octet_length(html) >= 1000").count()
    assert {r.kind: r["count"] for r in kinds}["revisit"] >= n


def test_empty_archive(spark, pages, tmp_path):
    assert warc.assemble(warc.read(spark, archive(spark, pages.limit(0), tmp_path))).count() == 0


def reference_text(page):
    """The article of these made pages, by their known layout."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
    body = re.sub(r"<[^>]*(>|$)", "", re.sub(r"<(/?(p|h1|br)[^>]*)>", " \0 ", body))
    return " ".join(" ".join(html.unescape(x).split()) for x in body.split("\0") if x.strip())


def test_extraction_of_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: reference_text(r.html) for r in pages.collect()}
    got = extract.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


PAGE = (
    '<html><head><title>T</title></head><body class="ads-none"><header>Site</header><div class="cookie-notice">We use</div><div id="sidebar">s</div>'
    '<main><header><h1>A &amp; B</h1></header><p>one <b>bo</b>ld<p>two &lt;3 a < b<div class="comments">no</div><form><p>q</form><div class="share">x</div>'
    '<script>if (a<b) "</p>"</script><style>p{}</style><!-- c --><p>t&eacute;st&nbsp; x<br>three</main><footer>f</footer>'
)


def test_furniture_goes():
    assert extract.slots(PAGE) == "A & B one bold two <3 a < b tést x three"
    assert extract.slots("") == "" == extract.slots("<scri")
    assert extract.slots("<article>a<p>b</arti") == "a b"


def test_deep_and_unclosed_elements():
    assert extract.slots("<div>" * 5000 + "deep") == "deep"
    deep = "<article><p>kept</p>" + "<section>" * 500 + "<div class='comments'>" + "<div>" * 20 + "no" + "</div>" * 20 + "reader comment</div>" + "</section>" * 500 + "<p>end</p></article>"
    assert extract.slots(deep) == "kept end"
    started = time.perf_counter()
    assert extract.slots("<div>" * 100_000 + "</p>" * 100_000 + "deep") == "deep"
    assert time.perf_counter() - started < 20


def story(k):
    return f"Story {k} of many, told at some length so that it outweighs the rest of its page. "


def shop_page(k):
    return f"<html><body><div><p>Our shop since 1990</p><span>top</span></div><div><p>{story(k)}</p><p>More {k}.</p></div><div>All rights reserved</div></body></html>"


def test_template_of_pages_without_an_article(spark):
    rows = [(i, "http://h.example/p", shop_page(i)) for i in range(8)]
    rows += [(50, "http://other.example/", "<body><p>Our shop since 1990</p></body>"), (51, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as token", "3 as vector", "4 as template", "5 as small")
    want = {i: f"{story(i).strip()} More {i}." for i in range(8)} | {50: "Our shop since 1990", 51: ""}
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == want
    assert extract.main_text(df.limit(0)).count() == 0


def site_page(k, copy=False):
    """A page without hints: the advert, the byline and the notice in the story go by their place in the template."""
    text = "One story that is on many pages, word for word, and long enough to be most of them. " * 3 if copy else story(k) * 3
    ask = "<p>Like this?</p><ul><li>Tell a friend.</li><li>Tell two.</li></ul>" if k % 5 else ""
    return (
        f"<html><body><div class='x1'>Buy {k}</div><div class='x2'><h1>Head {k}</h1><div class='x3'>By {k}</div><div class='x4'><p>{text}</p>"
        f"<p>The {k % 3}.</p>{ask}<p>{story(k + 1000)}<p>{story(k + 2000)}</p></div></div><div class='x5'><p>Site</p><p>Terms</p></div></body></html>"
    )


def test_sites_without_hints(spark):
    rows = [(i, "http://site.example/", site_page(i)) for i in range(40)]
    rows += [(i, "http://copies.example/", site_page(i, i < 30)) for i in range(40)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, i long, url string, html string")
    for r in extract.main_text(df).join(df.select("page_id", "i"), "page_id").collect():
        head = "One story that is on many pages, word for word, and long enough to be most of them. " * 3 if "copies" in r.url and r.i < 30 else story(r.i) * 3
        assert r.text == f"Head {r.i} {head.strip()} The {r.i % 3}. {story(r.i + 1000).strip()} {story(r.i + 2000).strip()}"


def test_story_outside_of_teasers(spark):
    """Article elements of teasers do not win over the region with the text."""
    page = lambda k: f"<body><div class='main-text'><p>{story(k) * 4}</p></div><div class='row'><article><p>Teaser {k}</p></article></div></body>"
    df = spark.createDataFrame([(k, "http://a.example/", page(k)) for k in range(9)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == {k: (story(k) * 4).strip() for k in range(9)}


def test_pages_without_tags_for_the_article(spark):
    """Where hosts have enough pages, neither article elements nor class names are needed."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", urlfilter.host_of(F.col("url")))
    want = {r.page_id: reference_text(r.html) for r in pages.collect()}
    bare = F.regexp_replace(F.regexp_replace("html", "</?(article|main)[^>]*>", ""), ' class="[^"]*"', "")
    enough = {r.host for r in pages.groupBy("host").count().filter(F.col("count") >= extract.CLASS_PAGES).collect()}
    got = {r.page_id: r.text for r in extract.main_text(pages.withColumn("html", bare)).collect()}
    chosen = [r.page_id for r in pages.collect() if r.host in enough]
    assert len(chosen) > 150 and {k: got[k] for k in chosen} == {k: want[k] for k in chosen}


def brute_template(pages):
    """Template tokens of the pages of one host, from explicit vectors."""
    seen = [[extract.token(b[0], b[4]) for b in extract.blocks(p) if not (b[4] and b[2])] for p in pages]
    size = {extract.token(b[0], b[4]): len(b[4]) for p in pages for b in extract.blocks(p)}
    chars = [sum(len(b[4]) for b in extract.blocks(p) if not b[2]) for p in pages]
    vectors = {t: tuple(s.count(t) for s in seen) for s in seen for t in s}
    groups = {}
    for t, v in vectors.items():
        on = sum(map(bool, v))
        if on >= extract.CLASS_PAGES and on >= extract.CLASS_SHARE * len(pages):
            groups.setdefault(v, set()).add(t)
    groups = {v: g for v, g in groups.items() if len(g) >= extract.CLASS_TOKENS}
    top = max(groups, key=lambda v: (sum(map(bool, v)), -sum(v), len(groups[v])))
    root = [[t for t in s if t in groups[top]] for s in seen]
    root_on = [r for r, n in zip(root, top, strict=True) if n]
    fixed = {t for t in groups[top] if len({i for r in root_on for i, x in enumerate(r) if x == t}) == 1}
    if 2 * sum(size[t] * r.count(t) for r in root_on for t in fixed) > sum(c for c, n in zip(chars, top, strict=True) if n):
        fixed = {t for t in fixed if not size[t]}
    out = set(fixed)
    for v, g in groups.items():
        if v == top:
            continue
        runs = {}
        for s, n in zip(seen, v, strict=True):
            gap, own = 0, {}
            for t in s:
                if t in groups[top]:
                    gap = t
                elif t in g:
                    own.setdefault(gap, []).append(t)
            for gap, run in own.items():
                runs.setdefault(gap, []).append(run)
        for found in runs.values():
            cycles = {tuple(dict.fromkeys(r)) for r in found}
            cycle = min(cycles)
            whole = all(r == list(cycle) * (len(r) // len(cycle)) for r in found)
            text = sum(size[t] for r in found for t in r)
            if len(cycles) == 1 and whole and len(found) == sum(map(bool, v)) and len(cycle) >= extract.CLASS_TOKENS and 2 * text <= sum(c for c, n in zip(chars, v, strict=True) if n):
                out |= set(cycle)
    return out


def test_template_equals_explicit_vectors(spark):
    hosts = {
        "a": [site_page(k) for k in range(12)], "b": [site_page(k, k < 8) for k in range(12)],
        "c": [f"<body><div>one</div><p>x{k}</p><ul>" + "<li><b>By</b><em>n</em><p>Reply</p><i>c</i></li>" * (k % 3 + 1) + "</ul><div>two</div></body>" for k in range(8)],
        "d": [f"<body><div class='a'>l{k}</div>" + ("<p>s</p><p>t</p><p>u</p>" if k % 2 else "<p>t</p><p>s</p><p>u</p>") + "</body>" for k in range(8)],
    }
    rows = [(f"http://{h}.example/", p) for h, ps in hosts.items() for p in ps]
    df = spark.createDataFrame(rows, "url string, html string")
    names = {r.host: r.name for r in df.select(F.xxhash64(urlfilter.host_of(F.col("url"))).alias("host"), F.substring(F.col("url"), 8, 1).alias("name")).distinct().collect()}
    got = {names[r.host]: set(r.template) for r in extract.templates(df).collect()}
    assert got == {h: brute_template(ps) for h, ps in hosts.items()}
    assert extract.token(extract.below(0, "div"), "one") in got["c"]


def test_vectors_do_not_depend_on_the_split(spark, pages):
    rows = pages.select(F.xxhash64("url").alias("host"), "html")
    a = {tuple(r) for r in extract.tokens(rows.coalesce(1)).collect()}
    assert a and a == {tuple(r) for r in extract.tokens(rows.repartition(7)).collect()}


def test_lists_as_of_fetch_time(spark):
    day = lambda d: datetime(2024, 1, d)
    log = [("b.com", "x", day(2), True), ("b.com", "x", day(5), False), ("b.com", "x", day(8), True), ("b.com", "x", day(9), True), ("a.b.com", "y", day(4), True),
           ("a.b.com", "y", day(4), False), ("com", "z", day(1), True), (None, "x", day(1), True), ("q.com", None, day(1), True), ("r.com", "x", day(3), False)]
    log = spark.createDataFrame(log, "domain string, category string, at timestamp_ntz, listed boolean")
    spans = sorted(urlfilter.intervals(log).filter("domain = 'b.com'").collect())
    assert [tuple(r) for r in spans] == [("b.com", "x", day(2), day(5)), ("b.com", "x", day(8), None)]
    seen = [(k, "HTTP://u@A.b.com.:80/p?q", day(k)) for k in (1, 2, 3, 4, 5, 8)] + [(20, "ftp://b.com", day(5)), (21, None, day(5)), (22, "no url", day(5)), (23, "http://b.com/", None), (1, "HTTP://u@A.b.com.:80/p?q", day(1))]
    df = spark.createDataFrame(seen, "page_id long, url string, fetched_at timestamp_ntz").selectExpr("*", "1 as host", "2 as domain", "3 as best")
    got = [tuple(r) for r in urlfilter.judge(df, log).select("page_id", "blocked", "matched", "since").collect()]
    assert len(got) == len(seen)
    want = {1: (False, None, None), 2: (True, "b.com", day(2)), 3: (True, "b.com", day(2)), 4: (True, "a.b.com", day(4)), 5: (True, "a.b.com", day(4)),
            8: (True, "a.b.com", day(4)), 20: (False, None, None), 21: (False, None, None), 22: (False, None, None), 23: (False, None, None)}
    assert {g[0]: g[1:] for g in got} == want
    assert urlfilter.judge(df, log.limit(0)).filter("blocked").count() == 0 and urlfilter.judge(df.limit(0), log).count() == 0


def test_hot_and_long_listed_domains(spark):
    """Thousands of hosts below one domain that was listed and unlisted many times, against the plain rule."""
    start = datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    log = [("big.com", "x", at(7 * k), k % 2 == 0) for k in range(300)] + [("h5.big.com", "y", at(100), True), ("small.com", "z", at(1), True)]
    seen = [(k, f"http://h{k % 900}.big.com/", at(k * 11 % 2400)) for k in range(4000)] + [(5000 + k, f"http://s{k}.small.com/", at(k)) for k in range(30)]
    captures = spark.createDataFrame(seen, "page_id long, url string, fetched_at timestamp_ntz")
    got = {r.page_id: (r.blocked, r.matched, r.since) for r in urlfilter.judge(captures, spark.createDataFrame(log, "domain string, category string, at timestamp_ntz, listed boolean")).collect()}

    def plain(url, t):
        host = url.split("/")[2]
        if host == "h5.big.com" and t >= at(100):
            return True, "h5.big.com", at(100)
        if host.endswith("small.com"):
            return (True, "small.com", at(1)) if t >= at(1) else (False, None, None)
        k = int((t - start).total_seconds() // 3600) // 7
        return (True, "big.com", at(7 * k)) if k % 2 == 0 and k < 300 else (False, None, None)

    assert got == {i: plain(u, t) for i, u, t in seen}


SHOP = "<header><p>Our shop since 1990</p></header>{}<footer>All rights reserved</footer>"


@pytest.mark.parametrize("element", [
    "div class='content has-sidebar'", "div class='main with-nav'", "div class='article-widget'", "div class='widget'", "div id='banner'",
    "article class='post comments-open'", "article class='post banner-post'", "article class='comments'", "main class='sidebar'", "form id='aspnetForm'", "div role='main' class='menu'",
])
def test_names_alone_do_not_drop_the_article(spark, element):
    body = f"<{element}><p>{{}}</p><p>More {{}}.</p></{element.split()[0]}>"
    page = lambda k: f"<html><body>{SHOP.format(body.format(story(k), k))}</body></html>"
    if element.startswith("form"):  # around the whole page, as some servers put it
        page = lambda k: f"<form id='aspnetForm'>{SHOP.format(f'<article><p>{story(k)}</p><p>More {k}.</p></article>')}</form>"
    df = spark.createDataFrame([(k, "http://h.example/", page(k)) for k in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.main_text(df).collect()} == {k: f"{story(k).strip()} More {k}." for k in range(8)}


def test_any_name_on_the_article_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: reference_text(r.html) for r in pages.collect()}
    words = sorted(extract.FURNITURE_WORDS)
    for names in ("has-sidebar comments-open", " ".join(words), "sidebar", "comments"):
        got = extract.main_text(pages.withColumn("html", F.regexp_replace("html", "<article>", f"<article class='{names}'>")))
        assert {r.page_id: r.text for r in got.collect()} == want


def test_furniture_by_its_whole_name():
    keep = "<article><h1>T</h1><p>" + "word " * 40 + "</p>{}</article>"
    said = "T " + ("word " * 40).strip()
    for gone in ("<div class='cookie-notice'>x</div>", "<div class='site-footer'>x</div>", "<ol class='comment-list'><li><article class='comment'>x</article></li></ol>", "<p hidden>x</p>",
                 "<p style='color:red; display: none'>x</p>", "<span aria-hidden='true'>x</span>", "<script>'</scripty>'</script x>", "<style>a</style >", "<div id=navBar>x</div>"):
        assert extract.slots(keep.format(gone)) == said, gone
    for stays in ("<div class='has-sidebar'>x</div>", "<div class='advice'>x</div>", "<p class='note'>x</p>", "<div class='comments-open'>x</div>"):
        assert extract.slots(keep.format(stays)) == f"{said} x", stays
    assert extract.slots(keep.format("<div class='comments'>" + "no " * 500 + "</div>")) == said  # more comments than article
    assert extract.slots("<article>soft<img src='x'>ware, f<svg><path/></svg>a<script>1</script>st<input> a<br>b</article>") == "software, fast a b"
    assert extract.slots("<script>if (1) x</script x><p>after</p>") == "after"


def test_the_template_decides_beside_an_article_element(spark, tmp_path, monkeypatch):
    """Lines that all articles of a host repeat go by the template; with an empty one they stay."""
    from weir.llm import queries

    page = lambda k: f"<body><article><h1>Head {k}</h1><p>{story(k) * 2}</p><p>{story(k + 500)}</p><ul><li>Read on.</li><li>Tell a friend.</li><li>Write to us.</li></ul></article></body>"
    df = spark.createDataFrame([(k, f"http://{'ab'[k % 2]}.example/", page(k)) for k in range(16)], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    text = lambda: {r.page_id: r.text for r in queries.op6_html_extraction(spark, str(tmp_path)).collect()}
    article = {k: f"Head {k} {(story(k) * 2).strip()} {story(k + 500).strip()}" for k in range(16)}
    assert text() == article
    learned = extract.templates
    monkeypatch.setattr(extract, "templates", lambda pages: learned(pages).withColumn("template", F.array().cast("array<long>")))
    assert text() == {k: v + " Read on. Tell a friend. Write to us." for k, v in article.items()}


def test_html_is_parsed_once(spark, monkeypatch):
    """All steps read one table of parsed pages, the result too; columns named as that table's are no part of it."""
    df = spark.createDataFrame([(k, shop_page(k)) for k in range(8)], "page_id long, html string").withColumn("url", F.lit("http://shop.example/"))
    calls, parsed = [], extract.parsed
    monkeypatch.setattr(extract, "parsed", lambda rows, *kept: calls.append(rows.columns) or parsed(rows, *kept))
    named = df.selectExpr("*", "'x' as host", "1 as tokens", "2 as texts", "3 as name", "'y' as template")
    got = extract.main_text(named)
    assert calls == [["page_id", "url", "html", "host"]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan and plan.count("Relation [") == 2  # the parsed pages and the templates
    assert {r.page_id: r.text for r in got.collect()} == {r.page_id: r.text for r in extract.main_text(df).collect()}


def test_parsed_pages_say_what_pages_say(spark, pages):
    """A table of parsed pages gives the text that the pages themselves give."""
    rows = extract.parsed(pages.selectExpr("page_id", "1L as host", "html"), "page_id").collect()
    html_of = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(html_of)
    for r in rows:
        page = extract.Page(*(getattr(r, c) for c in extract.Page._fields))
        assert page == extract.read(html_of[r.page_id] or "") and r.lengths == [len(t) for t in r.texts]
        assert extract.slots(page) == extract.slots(html_of[r.page_id] or "")
