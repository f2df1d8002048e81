import hashlib
import html as html_entities
import random

import pytest
from pyspark.sql import functions as F

from roadweave.llm import htmltext, merkle

PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>{before}<article><h1>Head &amp; more</h1><p><b>One<br>two  &nbsp; three<p>Four &#233;</p>{inside}</article><footer>&copy; foot</footer></body></html>'


@pytest.mark.parametrize(
    ("before", "inside"),
    [("", ""), ('<div class="ad">buy this now buy this now buy this now buy this now</div>', ""), ('<aside>side text</aside><form>q</form>', '<div class="comments"><p>a reader says much more than the article itself does, at length</p></div>'), ('<div id="cookie-notice">we use cookies</div><!-- c -->', "<style>p{}</style><script>x</script>")],
)
def test_only_the_article(before, inside):
    page = htmltext.Page(PAGE.format(before=before, inside=inside))
    assert page.text(None) == "Head & more\nOne two three\nFour é"


def test_odd_markup():
    assert htmltext.Page("").text(None) == "" and htmltext.Page("plain & <b>bold</b> < 5").text(None) == "plain & bold < 5"
    assert htmltext.Page('<p title="a > b">x</p').text(None) == "x"
    assert htmltext.Page("<div>" * 3000 + "deep").text(None) == "deep"
    assert htmltext.Page("<!-- never closed <p>x</p>").text(None) == ""


def test_hosts_agree_on_a_path(spark):
    main = '<body><div class="col 7"><p>{a}</p></div><div class="extra"><p>{b}</p></div></body>'
    rows = [(i, "http://h.example/x", main.format(a="word " * 40, b="small")) for i in range(6)]
    rows.append((6, "http://h.example/y", main.format(a="short one", b="word " * 90)))
    rows.append((7, None, main.format(a="alone " * 9, b="x")))
    rows += [(8, "http://e.example/", None), (9, "http://e.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("c"), "path": F.lit("c"), "text": F.lit("c")})
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert got[6].text == "short one" and got[7].text == ("alone " * 9).strip() and got[8].text == got[9].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == 10
    assert htmltext.extract(df.limit(0)).count() == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    out = {}
    for i, (k, t) in enumerate(rows):
        t, follower = t or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(t) // 3
        out[k] = (len(t), hashlib.sha256((t[: len(t) - third] + follower[:third]).encode()).hexdigest())
    return out


def test_edited_texts(spark, text_of):
    rng = random.Random(8)
    rows = [(i * 3, text_of(rng.randint(1, 80)) + "é") for i in range(300)] + [(2, None), (5, ""), (None, "last"), (7, text_of(30_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "guest": F.lit(1), "key": F.lit(1)})
    for n in (50, 4000):
        merkle.RANGE_ROWS, old = n, merkle.RANGE_ROWS
        got = {r.doc_id: r for r in merkle.edited_fingerprints(df).collect()}
        merkle.RANGE_ROWS = old
        assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == brute(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert merkle.edited_fingerprints(one).collect()[0].near_next == 1.0
    assert merkle.edited_fingerprints(one.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d e f")], "doc_id long, text string")
    assert merkle.edited_fingerprints(df).count() == 3


def test_tree(text_of):
    text = text_of(400)
    a, same, other = merkle.trees([text, text, text.replace("\n", " \n", 1)])
    assert a.text() == same.text() and a.root != other.root
    assert merkle.likeness(a, same) == 1 and 0.8 < merkle.likeness(a, other) < 1
    assert merkle.parse(a.text()).text() == a.text() and merkle.differing(a, same) == [] and len(merkle.differing(a, other)) == 1
    roots = [t.root for t in merkle.trees(["", " ", "\n", "a", "a ", " a", "a\n", "b"])]
    assert len(set(roots)) == 8
    alone = [merkle.trees([x])[0].text() for x in ["x y", text, ""]]
    assert [t.text() for t in merkle.trees(["x y", text, ""])] == alone
    lines = text.split("\n")
    cut = merkle.trees(["\n".join(lines[:20] + ["new line here"] + lines[20:])])[0]
    assert merkle.likeness(a, cut) > 0.9


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article class="share story"><p>kept</p></article>', "kept"),
        ('<div class="notice-board"><p>the whole text</p></div>', "the whole text"),
        ('<div class="text-widget"><p>abc</p></div>', "abc"),
        ("<article><p>a <label>lab</label> <math><mi>x</mi></math></p></article>", "a lab x"),
        ('<article><p>long text that is the article</p><div class="share">share me</div></article>', "long text that is the article"),
        ('<article><p>one</p></article><article class="comment"><p>a reader says more than one</p></article>', "one"),
        ("<p>text <!-- never closed", "text"),
        ('<div class="site has-sidebar"><article><p>kept</p></article><div class="sidebar">gone</div></div>', "kept"),
        ('<div class="modal-ready no-nav"><article><p>kept</p></article></div>', "kept"),
        ('<form id="aspnetForm"><main><article><p>kept</p><form>your name</form></article></main></form>', "kept"),
        ('<form><div><p>a text without an article in it</p></div><div class="ad">buy</div></form>', "a text without an article in it"),
        ('<div class="modal"><p>the text of the whole page</p></div><footer>f</footer>', "the text of the whole page"),
        ('<div class="ad"><p>an advert that is longer than the article itself</p></div><article><p>short</p></article>', "short"),
        ('<article><pre>run it <span class="token comment"># set x</span></pre></article>', "run it # set x"),
        ('<article><p>The <span class="copyright">copyright act</span> passed</p></article>', "The copyright act passed"),
        ('<article><p>a</p><section id="newsletter-history"><p>b</p></section><div class="newsletter-box">c</div></article>', "a\nb"),
        ('<div class="content"><div>long long long long</div><div>short tail</div></div>', "long long long long\nshort tail"),
        ('<main><article><p>first</p></article><article><p>second</p></article></main>', "first\nsecond"),
        ('<article><p>one</p></article><section class="comments"><article><p>a reader says more than one</p></article></section>', "one"),
        ('<div class="comments-enabled site-footer-fixed"><main><p>kept</p></main></div>', "kept"),
        ('<div id="main-nav">menu</div><div id="ad_1">buy</div><div class="post-comments">me too</div><div class="story">kept</div>', "kept"),
        ("a < b <a", "a < b"),
    ],
)
def test_class_words_and_inline_elements(source, text):
    assert htmltext.Page(source).text(None) == text


def random_page(rng):
    """A page and its main text, built side by side."""
    word = lambda: rng.choice(["alpha", "beta", "gamma", "d&amp;d", "caf&eacute;", "x&lt;y", "z"])
    read = lambda x: html_entities.unescape(x)
    blocks = []

    def paragraph():
        words = [word() for _ in range(rng.randint(4, 12))]
        inline = [f"<{t}>{w}</{t}>" if (t := rng.choice(["", "", "b", "i", "a", "span class=share", "label"])) and " " not in t else w for w in words]
        blocks.append(read(" ".join(words)))
        return f"<p>{rng.choice([' ', '  ', chr(10)]).join(inline)}" + rng.choice(["</p>", ""])

    body = ""
    for _ in range(rng.randint(2, 6)):
        move = rng.randrange(4)
        if move == 0:
            w = word()
            blocks.append(read(w))
            body += f"<h2>{w}</h2>"
        elif move == 1:
            items = [word() for _ in range(3)]
            blocks.extend(map(read, items))
            body += "<ul>" + "".join(f"<li>{w}" for w in items) + "</ul>"
        else:
            body += paragraph()
        body += rng.choice(["", "", "<script>if (a < b) '<p>'</script>", "<aside>side</aside>", '<div class="ad">buy</div>', "<form>your name<input></form>", "<!-- <p>no</p> -->", '<div class="comments"><p>reader text here</p></div>'])
    before = rng.choice(["", "<nav><ul><li>menu</ul></nav>", "<header><h1>Site</h1></header>", '<div id="cookie-notice">we use cookies</div>'])
    after = rng.choice(["", "<footer>&copy; x</footer>", '<div class="sidebar"><p>more</p></div>'])
    start, end = rng.choice([("", ""), ("", ""), ('<div class="site has-sidebar">', "</div>"), ('<div class="modal-ready no-nav">', "</div>"), ('<form id="aspnetForm"><main>', "</main></form>"), ('<div class="modal">', "</div>")])
    return f"<html><head><title>t</title></head><body>{start}{before}<article>{body}</article>{after}{end}</body></html>", "\n".join(blocks)


def test_extraction_against_pages_built_with_their_text(spark):
    rng = random.Random(12)
    made = [random_page(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, f"http://h{i % 7}.example/", source) for i, (source, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    for i, (source, text) in enumerate(made):
        assert htmltext.Page(source).text(None) == text, source
        assert got[i] == text, source


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "deep", "<b>" * 50_000 + "<div>x</div>" * 50_000, "<td>" + "<b></div>" * 100_000, "<title>" * 100_000 + '<a "' * 100_000, '<div class="notice">' * 50_000 + "deep"])
def test_pages_are_read_in_linear_time(source):
    import time

    began = time.process_time()
    page = htmltext.Page(source)
    page.text(page.path(page.best(1)[0][0]) if page.best(1) else None)
    assert time.process_time() - began < 6


def flat_likeness(a, b):
    """Dice share of the leaves, without the tree."""
    from collections import Counter

    if a.root == b.root:
        return 1.0
    x, y = Counter(a.leaves.tolist()), Counter(b.leaves.tolist())
    n = sum(x.values()) + sum(y.values())
    return min(2 * sum((x & y).values()) / n, 1 - 1 / (n + 1)) if n else 0.0


def naive_branches(a, b):
    """(section, paragraph) of a that b lacks: a paragraph is spare if no free one of b's unmatched sections is like it."""
    from collections import Counter

    def sections(t):
        out, at = [], 0
        for h, n in t.sections.tolist():
            out.append((h, [(k, t.paragraphs["hash"][k]) for k in range(at, at + n)]))
            at += n
        return out

    sa, sb = sections(a), sections(b)
    free = Counter(h for h, _ in sb)
    mine = []
    for i, (h, inside) in enumerate(sa):
        if free[h]:
            free[h] -= 1
        else:
            mine += [(i, k, p) for k, p in inside]
    taken = Counter(h for h, _ in sa)
    theirs = Counter()
    for h, inside in sb:
        if taken[h]:
            taken[h] -= 1
        else:
            theirs.update(p for _, p in inside)
    out = []
    for i, k, p in mine:
        if theirs[p]:
            theirs[p] -= 1
        else:
            out.append((i, k))
    return out if a.root != b.root else []


def test_descent_is_the_naive_comparison(spark, text_of):
    rng = random.Random(3)
    rows = [(i, text_of(rng.randint(1, 300))) for i in range(60)]
    rows += [(100 + i, t.replace("\n", " ", 2)) for i, (_, t) in enumerate(rows[:20])] + [(200, ""), (201, None)]
    got = {r.doc_id: r for r in merkle.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (k, t), (_, follower) in zip(order, order[1:] + order[:1]):
        t, follower = t or "", follower or ""
        third = len(t) // 3
        a, b, c = (merkle.trees([x])[0] for x in (t, t[: len(t) - third] + follower[:third], follower))
        assert got[k].near_edited == flat_likeness(a, b) and got[k].near_next == flat_likeness(a, c)
        assert [tuple(x) for x in got[k].differs] == naive_branches(a, b)
        assert got[k].fingerprint == a.text() and merkle.parse(got[k].fingerprint).text() == a.text()


def test_hot_keys_are_several_ranges(spark):
    rows = [(None, f"n {i}") for i in range(600)] + [(7, f"s {i}") for i in range(600)] + [(i, f"o {i}") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    merkle.RANGE_ROWS, old = 100, merkle.RANGE_ROWS
    lean = df.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    dealt, parts = merkle._ranges(lean)
    sizes = [r["count"] for r in dealt.where("guest = 0").groupBy("part").count().collect()]
    got = merkle.edited_fingerprints(df).collect()
    merkle.RANGE_ROWS = old
    assert sum(sizes) == len(rows) and max(sizes) < 300 and dealt.agg(F.max("part")).collect()[0][0] < parts
    tie = {r.text: r.tie for r in lean.collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], tie[r[1]]), reverse=True)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest() for (_, t), (_, f) in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in got) == want
