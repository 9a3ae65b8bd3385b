"""Language profiles, page extraction, pattern search and exact copies against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, html_paths, language, wu_manber

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t in enumerate(texts)], DOCS)


# ---- language


def test_languages_and_defined_cases(spark):
    rows = [(0, "the cat and the dog", "en"), (1, "le chat et le chien", "fr"), (2, None, "en"), (3, "", None),
            (4, "12 34 !?", "en"), (5, "the dog", None), (5, "the dog", None), (6, "чужой", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = language.collect_profiles(language.learn_profiles(frame))
    out = language.identify(frame, profiles, carry={"doc_id": frame.doc_id}).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == len(rows)
    assert found[0][0] == "en" and found[1][0] == "fr" and found[5][0] == "en"
    assert found[2] == found[3] == found[4] == ("und", 0.0)
    assert found[6] == ("en", 0.0)  # a tie between languages that know nothing of it: the first by name
    empty = frame.limit(0)
    assert language.collect_profiles(language.learn_profiles(empty)).best("the cat") == ("und", 0.0)
    assert language.identify(empty, profiles).collect() == []


def test_grams_equal_plain_counting_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["Ab", "ça", "über-x", "z9z", "日本", "e"], k=400))
    whole = {}
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = [1, *map(ord, word), 1]
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                gram = padded[k : k + n]
                if gram[0] == 1 and n == 1 or gram[-1] == 1 and n == 1:
                    continue
                code = 0
                for c in gram:
                    code = code << 21 | c
                whole[code] = whole.get(code, 0) + 1
    for piece in (1 << 20, 37):
        monkeypatch.setattr(language, "PIECE", piece)
        grams, counts = language.text_grams(text)
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == whole


def test_out_of_place_distance_by_hand():
    rows = [("aa", g, r + 1) for r, g in enumerate(language._ranked(*language.text_grams("abba abba"), 300).tolist())]
    best, score = language.Profiles(rows, 300).best("abba abba")
    assert (best, score) == ("aa", 1.0)


# ---- pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text &amp; more", "just text & more"),
        ("<body><nav>menu</nav><article><h1>A</h1><p>b <b>c</b>d<br>e<p>f</article><footer>x</footer></body>", "A b cd e f"),
        ("<body><div class='cookie-notice'>no</div><main><div id='post-7'><p>yes&nbsp;&eacute;</p>"
         "<div class='ad'>buy</div><form>q</form></div><section class='comments'>me too</section></main></body>", "yes é"),
        ("<article><script>if (a<b) x('</p>')</script><style>p{}</style><p>t<!-- c -->u</p></article>", "tu"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article><p>unclosed <b>bold<p>next</article> tail", "unclosed bold next"),
    ],
)
def test_main_text_of_a_page(page, text):
    assert html_paths.extract(page, html_paths.vote(page)[0]) == text


def test_hosts_vote_and_pages_without_the_path_keep_their_own(spark):
    good = "<body><div class='main-{}'><p>words of the page number {}</p></div><div class='x'>hi</div></body>"
    rows = [(i, f"http://Host.example/{i}", good.format(i, i)) for i in range(4)]
    rows += [(9, "https://host.example:80/q", "<body><article>other template</article></body>"), (10, None, "<p>no host</p>"),
             (11, "http://host.example/n", None), (0, "http://Host.example/0", good.format(0, 0))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert dict(html_paths.host_paths(pages).collect())["host.example"] == "html>body>div.main-#".removeprefix("html>")
    out = {(r.page_id, r.text) for r in html_paths.extract_pages(pages).collect()}
    assert out == {(i, f"words of the page number {i}") for i in range(4)} | {(9, "other template"), (10, "no host"), (11, "")}
    assert html_paths.extract_pages(pages).count() == len(rows)
    assert html_paths.extract_pages(pages.limit(0)).count() == 0


def test_articles_split_over_blocks_are_kept_whole(spark):
    split = ("<body><div class='post'><p>intro {0} of one</p><div class='body'><p>" + "long text {0} " * 6
             + "</p><div class='more'>" + "further words {0} " * 30 + "</div></div></div><div class='bar'>same on all</div></body>")
    plain = "<body><div class='post'><div class='body'><div class='more'>" + "only words {0} " * 9 + "</div></div></div></body>"
    pages = {i: (split if i % 2 else plain).format(i) for i in range(8)} | {8: split.format(8), 9: plain.format(9)}
    want = {
        i: f"intro {i} of one " + f"long text {i} " * 6 + f"further words {i} " * 29 + f"further words {i}"
        + " same on all" if i in (1, 3, 5, 7, 8) else (f"only words {i} " * 9).strip() for i in pages
    }
    for i in (1, 8):
        assert html_paths.extract(pages[i], html_paths.vote(pages[0])[0]) == want[i]
    frame = spark.createDataFrame([(i, "http://a.example/x", p) for i, p in pages.items()], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_paths.extract_pages(frame).collect()}
    assert all(got[i].removesuffix(" same on all") == want[i].removesuffix(" same on all") for i in pages)


@pytest.mark.parametrize(("page", "text"), [
    ('<div class="content has-sidebar"><p>The text of the page.</p></div>', "The text of the page."),
    ('<div id=wrap class="no-sidebar"><p>The text of the page.</p></div>', "The text of the page."),
    ('<div class="elementor-widget-container"><p>The text of the page.</p></div>', "The text of the page."),
    ('<div class="post job-search-tips"><p>The text of the page.</p></div>', "The text of the page."),
    ('<div><p>Up.</p><p class="share-price">It is 12.</p></div>', "Up. It is 12."),
    ("<div>Hello<aside>ad</aside>World</div>", "Hello World"),
    ("<div>one<form>f</form>two</div>", "one two"),
    ("<div>on<script>f()</script>ly <b>bo</b>ld</div>", "only bold"),
    ('<div><p title="un>Hello</p></div>', "Hello"),
    ("<div><p data-x='it's ok'>Hello</p></div>", "Hello"),
    ('<div><p title="a>b" data-y = \'c>d\' z=e">Hello</p></div>', "Hello"),
    ("<div>a<!-->b<!---->c</3>d</>e<!x>f</div>", "abcdef"),
    ('<div><p>The article has a few words.</p><div class="responses"><p>Well said.</p></div></div>', "The article has a few words."),
    ('<form id="page-form"><div><h1>Title</h1><p>All pages of this site lie in a form.</p></div></form>',
     "Title All pages of this site lie in a form."),
    ('<div><h1>Title</h1><p>Short.</p></div><div id="comments"><article><p>' + "I like it very much. " * 40 + "</p></article></div>",
     "Title Short."),
    ('<div class="widget"><h1>Title</h1><p>The text.</p><div class="share-buttons">Share this</div></div>', "Title The text."),
    ('<p>Text.</p><div class="related-posts"><article><a href=x>Another story with a long name</a></article></div>', "Text."),
    ('<div role="navigation">Menu</div><div><p>Text.</p></div>', "Text."),
    ("x < y and <b", "x < y and"),
])
def test_words_of_classes_are_evidence_and_tags_are_no_text(page, text):
    assert html_paths.extract(page, html_paths.vote(page)[0]) == text


def _templates():
    """Pages of common templates: a frame around the article times the furniture around it."""
    frames = {
        "wordpress": '<div id="page" class="site has-sidebar"><div id="content" class="site-content"><main class="site-main">{}</main></div>{}</div>',
        "elementor": '<div class="elementor-section"><div class="elementor-widget-wrap"><div class="elementor-widget-container">{}</div></div></div>{}',
        "plain": "<div><div>{}</div></div>{}",
        "genesis": '<div class="content-sidebar-wrap"><div class="post-1 hentry">{}</div>{}</div>',
        "form": '<form action="/page.aspx"><div class="main">{}</div>{}</form>',
        "widget": '<div class="widget">{}</div>{}',
        "table": "<table><tr><td>{}</td><td>{}</td></tr></table>",
    }
    furniture = {
        "none": "",
        "sidebar": '<div class="sidebar"><h3>Archive</h3><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>',
        "comments": '<div id="comments"><h3>2 comments</h3><p>Thanks for this.</p></div>',
        "responses": '<section class="post-responses"><p>I see it another way.</p></section>',
        "related": '<div class="related-posts"><a href="/3">More on pumps</a><a href="/4">More on tanks</a></div>',
        "footer": '<footer>All rights reserved</footer><div class="cookie-banner">We use cookies</div>',
    }
    for frame in frames:
        for around in furniture:
            yield frame, around, frames[frame], furniture[around]


@pytest.mark.parametrize(("frame", "around", "page", "rest"), list(_templates()), ids=lambda x: x if "<" not in x else "")
def test_templates_give_their_article(frame, around, page, rest):
    words = [f"Tank {k} was filled at {k % 24} o'clock, as every day." for k in range(9)]
    article = "<h1>Report</h1>" + "".join(f'<p class="p{k}">{w}</p>' for k, w in enumerate(words))
    html = f'<html><head><title>t</title></head><body class="right-sidebar"><nav>Home</nav>{page.format(article, rest)}</body></html>'
    assert html_paths.extract(html, html_paths.vote(html)[0]) == " ".join(["Report", *words])


def test_consensus_of_the_host_takes_marked_elements(spark):
    long = "of the town to all who live in it. " * 5
    rows = [(i, "http://n.example/", f"<div class=notices><p>Notice {i} {long}</p></div>") for i in range(8)]
    rows += [(8, "http://n.example/", "<div class=lead><p>The office moves.</p></div><div class=notices><p>Closed.</p></div>")]
    rows += [(9, None, None), (10, "http://e.example/", ""), (11, "http://o.example/", rows[8][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit("x"))
    got = {r.page_id: r.text for r in html_paths.extract_pages(pages).collect()}
    assert got[8] == "The office moves. Closed." and got[9] == got[10] == "" and got[11] == "The office moves."
    assert all(f"Notice {i} of the town" in got[i] for i in range(8))


def test_pages_of_large_and_of_small_hosts_meet_their_paths(spark, monkeypatch):
    rows = [(i, f"http://{'big' if i % 3 else i}.example/", f"<div><p>Page {i}.</p></div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = sorted(map(tuple, html_paths.extract_pages(pages).collect()))
    monkeypatch.setattr(html_paths, "COPIED_BYTES", 0)
    monkeypatch.setattr(html_paths, "LARGE_HOSTS", 3)
    assert sorted(map(tuple, html_paths.extract_pages(pages).collect())) == want


def test_deep_and_long_pages_end():
    assert html_paths.extract("<div>" * 3000 + "x" + "</div>" * 3000, None) == "x"
    assert len(html_paths.extract("<article>" + "<p>word word" * 50_000 + "</article>", None).split()) == 100_000


# ---- pattern search


def plain_hits(doc, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        b = words(text)
        m = min(window, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == b[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_windows", [10**6, 60])
def test_search_equals_plain_search(spark, block_windows):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Ça", "d1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 20, 30, 14, 3, 1, 2, 0, 13])]
    items = [(i, t.replace("a", f"q{i}") if i in (5, 6) else t) for i, t in items] + [(9, None), (0, items[0][1])]
    texts = [None, "", "x", "Q5", *(" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(30))]
    texts += [f"{items[k][1].upper()}; tail {items[2][1]}" for k in range(5)] + [items[1][1], items[1][1]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs(spark, texts)
    found = wu_manber.find_contamination(frame, bench, carry={"doc_id": frame.doc_id}, block_windows=block_windows)
    out = {r.doc_id: r for r in wu_manber.verdicts(found).collect()}
    for i, text in enumerate(texts):
        n, hit, names = plain_hits(text, items)
        r = out[i]
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, names)
        assert r.items_sha256 == wu_manber.item_digest(names)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_long_texts_are_searched_across_stretches(monkeypatch):
    patterns = wu_manber.Patterns([("7", b" ".join(b"w%d" % i for i in range(13)))])
    text = b"x " * 95 + b" ".join(b"w%d" % i for i in range(13)) + b" y" * 200
    monkeypatch.setattr(wu_manber, "STRETCH", 100)
    (n, spans, items), = wu_manber._hits(patterns, [text])
    assert (n, spans.tolist(), items) == (308, [[95, 108]], {0})


def test_no_benchmark_and_no_documents(spark):
    frame, bench = docs(spark, ["a b"]), spark.createDataFrame([], "item_id bigint, text string")
    assert wu_manber.verdicts(wu_manber.find_contamination(frame, bench)).first().n_hit == 0
    assert wu_manber.find_contamination(frame.limit(0), bench).count() == 0


# ---- exact copies


@pytest.mark.parametrize("how", [{}, {"key_bits": 2, "capacity": 2, "max_depth": 4}, {"key_bits": 0, "capacity": 1}])
def test_copies_by_bytes_even_when_keys_collide(spark, how):
    texts = ["Abc", "aBC", None, "", "É", "é", "abc ", "x" * 100_000, "X" * 100_000, *(f"t{i % 9}" for i in range(30))]
    rows = [(i, t, "sha") for i, t in enumerate(texts)] + [(38, "t2", "again"), (None, "Q", "no id"), (None, "q", "no id")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, sha string")
    normal = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(normal(t), []).append(i)
    out = exact_dedup.find_copies(frame, **how).collect()
    assert len(out) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_hash[bytes(r.sha)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in out) == len(groups)
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted(groups)


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(9)
    leaves = {rng.randrange(1 << 12): rng.randint(1, 9) for _ in range(400)}
    leaves[77] = 500  # cannot be parted
    buckets, depth = exact_dedup.grow_directory(leaves, capacity=20, max_depth=12)
    at = 0
    for first, own in buckets:
        assert first == at
        at += 1 << (12 - own)
        held = sum(n for k, n in leaves.items() if first <= k < at)
        assert held <= 20 or own == 12
    assert at == 1 << 12 and depth == max(own for _, own in buckets) == 12
    assert exact_dedup.grow_directory({}, 20, 12) == ([(0, 0)], 0)


def test_no_documents_have_no_copies(spark):
    assert exact_dedup.find_copies(docs(spark, [])).count() == 0
