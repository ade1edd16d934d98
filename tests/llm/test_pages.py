"""Main text of made pages, and the tree's scores and texts against a slow version."""

import collections
import math
import random
import time

import pytest

from garderobe.llm import pages
from garderobe.llm.pages import Page

SCHEMA = "page_id long, url string, html string, text int, host int"


def blocks(html):
    return [text for _, text in Page(html).blocks]


def test_one_page():
    html = """<!doctype html><html><head><title>T</title><style>p{a:b}</style></head><body class="has-sidebar"><header>Site</header><div id=main><div class='post-body'><h2>Title &amp; more</h2>
      <p>One <b>two</b>\n three<br>four &lt;b&gt;<p>Five<ul><li>a<li>b</ul><div class="comments"><p>Nice!</p></div><div class=share-buttons>share</div><table><tr><td>x<td>y</table></div>
      <aside>side</aside><form><p>in form</p></form></div><p style="display: none">hid</p><script>if (a < b) { "</p>" }</script><!-- <p>no</p> --><footer>foot"""
    assert blocks(html) == ["Title & more", "One two three four <b>", "Five", "a", "b", "x", "y"]


def texts(spark, sources, host="h.example"):
    rows = [(i, f"http://{host}/{i}", source, 1, 2) for i, source in enumerate(sources)]
    return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_article_marks_the_text(spark):
    page = "<body>before<article><header><h1>H</h1></header><p>p1 is the story of the day</p><nav>n</nav>tail</article>after<p>more</p></body>"
    assert texts(spark, [page])[0] == "H\n\np1 is the story of the day\n\ntail"


def test_teaser_is_not_the_article(spark):
    page = '<div class="story"><p>One day it rained for long.</p><p>Then it was dry.</p></div><article class="card">Teaser</article>'
    assert texts(spark, [page])[0] == "One day it rained for long.\n\nThen it was dry.\n\nTeaser"


def test_names_are_doubted():
    assert blocks("<body><form><nav>n</nav><h1>T</h1><p>In a form as a whole</p><div class=comments><p>Nice</p></div></form></body>") == ["T", "In a form as a whole"]
    assert blocks('<nav>n</nav><div class="legal"><p>Terms.</p><p>More terms.</p></div>') == ["Terms.", "More terms."]
    assert blocks('<div class="cookie"><p>We use cookies</p></div>') == [] and blocks('<div class="banner"><h1>Site</h1></div><p>All the text of the page</p>') == ["All the text of the page"]
    assert blocks('<article><p>Short</p><section class="comments"><article class="comment"><p>A comment much longer than the article is</p></article></section></article>') == ["Short"]
    assert blocks("<p>a <span hidden>b <span>c</span> d</span> e</p>") == ["a e"]


def test_outside_the_article_many_pages_tell(spark):
    """Text of its own outside an article stays once enough pages have it; the same words on all pages do not."""
    words = random.Random(5)
    sources = [f'<div class="lead"><p>{words.random()} {words.random()}</p></div><article><h1>Title {words.random()}</h1><p>{words.random()} {words.random()} {words.random()} {words.random()}</p></article><div class="x">Same</div>' for _ in range(80)]
    got = texts(spark, sources)
    assert all(len(t.split("\n\n")) == 3 and "Same" not in t for t in got.values())
    assert all(t.startswith("Title") for t in texts(spark, sources[:4]).values())


def test_small_hosts(spark):
    """No number of pages is a switch: the same page's menu goes when enough pages show it, at no page's cost."""
    for n, menu in ((1, True), (3, True), (9, False), (40, False)):
        got = texts(spark, [r[2] for r in site(n)])
        assert all((t.split("\n\n")[0] == "Home") == menu and f"Text of story {i}" in t for i, t in got.items())


@pytest.mark.parametrize("odd", [lambda n: "<" + "a" * n + ' "x', lambda n: '<a "' * n, lambda n: "<div>" * n + "x", lambda n: "<div class=a><div class=b>" * n, lambda n: "<li><div>" * n, lambda n: "<div>" * n + "<tr><li></li>" * n, lambda n: "<i><div hidden>" + "<b>" * n + "</i>" * n])
def test_time_grows_with_length(odd):
    def seconds(n):
        began = time.process_time()
        Page(odd(n))
        return time.process_time() - began

    assert min(seconds(16000) for _ in range(2)) < 0.3 + 4 * min(seconds(8000) for _ in range(2))


def test_broken_pages():
    assert blocks("") == [] and blocks("just text &copy; &am") == ["just text © &am"] and blocks("<p>a<p>b<div>c") == ["a", "b", "c"]
    assert blocks("<p>a < b and <3</p><p") == ["a < b and <3"] and blocks("<div><p>cut <b") == ["cut"]
    assert blocks("<script>never closed <p>x</p>") == [] and blocks("</p></div>x</span>") == ["x"] and blocks("<p/>a<p>b") == ["a", "b"]
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]


def site(n):
    """A host whose menu and notice have telling names for nobody: plain boxes, alike on all pages."""
    for i in range(n):
        yield (i, f"http://h.example/{i}", f'<body><div class="q1"><p>Home</p><p>About us</p></div><div class="q2"><h1>Story {i}</h1><p>Text of story {i}</p><p>Told everywhere</p></div><div class="q3"><p>We use things</p></div></body>', 1, 2)


@pytest.mark.parametrize("most_sent", [0, 1000])
def test_branches_alike_on_a_host_go(spark, monkeypatch, most_sent):
    monkeypatch.setattr(pages, "MOST_SENT", most_sent)
    rows = list(site(30)) + [(100, "http://other.example/", next(site(1))[2], 1, 2)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Story {i}\n\nText of story {i}\n\nTold everywhere" for i in range(30))
    assert got[100].startswith("Home")  # a single page says nothing about its host


def slow_scores(read_pages):
    """Importance of each leaf of one host, counted page by page."""
    read = list({tuple(p.blocks): p for p in read_pages}.values())
    on, styles, said, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list), {}
    element_pages = collections.Counter()
    for p in read:
        for key in {k for k, _ in p.styles}:
            element_pages[key] += 1
        for key, style in p.styles:
            styles[key].append(style)
        for leaf, (branch, path, outside, features) in p.leaves.items():
            on[leaf] += 1
            where[leaf] = (branch, path, outside)
            said[leaf] += features
    content = {}
    for leaf, m in on.items():
        times = collections.Counter(said[leaf])
        content[leaf] = sum(1 - math.log(times[f], m) for f in said[leaf]) / len(said[leaf]) if m > 1 else 1.0
    result = {}
    for leaf, m in on.items():
        branch, _, outside = where[leaf]
        inside = [other for other in on if branch in where[other][1]]
        inner = sum(on[o] * content[o] for o in inside) / sum(on[o] for o in inside)
        pages_with, uses = element_pages[branch], collections.Counter(styles[branch])
        total = sum(uses.values())
        look = min(1.0, -sum(n / total * math.log(n / total, pages_with) for n in uses.values())) if pages_with > 1 else 1.0
        keep = 0.9 ** len(uses)
        own = (content[leaf] + (1 - keep) * look + keep * inner) / 2
        result[leaf] = ((m - 1) * own + 20 * 0.05) / (m + 19) if outside else ((m - 1) * own + 4) / (m + 3)
    return result


def made_site(seed):
    r = random.Random(seed)
    for _ in range(r.randint(1, 40)):
        menu = "".join(f"<li><a>{r.choice(['Home', 'News', 'Sport', 'Contact'])}</a>" for _ in range(r.randint(2, 4)))
        body = "".join(f"<p>{' '.join(r.choice('ab cd ef gh ij kl mn op qr st'.split()) for _ in range(r.randint(1, 9)))}</p>" for _ in range(r.randint(0, 7)))
        tag = r.choice(["article", "div"])
        yield f'<body><div class=m><ul>{menu}</ul></div><div class=n>{r.choice(["Mind the gap", "We use things"])}</div><{tag}><h2>{r.randint(0, 20)}</h2>{body}</{tag}><div class=z><div class=z>Made in {r.choice(["x", "y"])}</div>loose</div></body>'


@pytest.mark.parametrize("seed", range(4))
def test_scores_and_texts_against_a_slow_version(spark, seed):
    sources = list(made_site(seed)) * 2
    rows = [(i, f"http://h/{i}", source, 1, 2) for i, source in enumerate(sources)]
    frame = spark.createDataFrame(rows, SCHEMA)
    score = slow_scores([Page(source) for source in sources])
    got = {r.leaf: r.importance for r in pages.importance(pages.stage(pages.read_pages(frame), "test")).collect()}
    assert got.keys() == score.keys() and all(abs(got[k] - score[k]) < 1e-9 for k in got)
    text = {r.page_id: r.text for r in pages.main_text(frame).collect()}
    assert text == {i: "\n\n".join(t for leaf, t in Page(source).blocks if score[leaf] >= 0.4) for i, source in enumerate(sources)}


def test_odd_tables(spark):
    rows = [(1, None, None, 1, 2), (None, None, "<p>x</p>", 1, 2), (2, "odd", "", 1, 2), (3, "http://a/", "<p>" + "long " * 50000 + "</p>", 1, 2), (3, "http://a/", "<p>y</p>", 1, 2), (3, "http://a/", "<p>y</p>", 1, 2)]
    got = sorted(((r.page_id, r.url, r.text[:5], r.n_chars) for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (None, None, "x", 1), (2, "odd", "", 0), (3, "http://a/", "long ", 249999), (3, "http://a/", "y", 1), (3, "http://a/", "y", 1)], key=repr)
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_white_space():
    assert blocks("<p>&nbsp; a&nbsp; b\r\n\tc &#160;</p><p>&nbsp;</p>") == ["a b c"]


def story(i, page):
    return (page, f"http://h.example/{page}", f'<body><div class="q1"><p>Home</p></div><div class="q2"><h1>Story {i}</h1><p>Text of story {i}</p></div></body>', 1, 2)


def test_copies_are_no_boilerplate(spark):
    """One story under ten addresses; two under five each; a host with 80 % copies and unique pages besides."""
    def told(stories):
        return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame([story(i, k) for k, i in enumerate(stories)], SCHEMA)).collect()}

    assert set(told([0] * 10).values()) == {"Home\n\nStory 0\n\nText of story 0"}
    assert all(t.endswith(f"Text of story {k % 2}") for k, t in told([0, 1] * 5).items())
    mixed = [0] * 40 + list(range(1, 11))
    assert told(mixed) == {k: f"Story {i}\n\nText of story {i}" for k, i in enumerate(mixed)}


@pytest.mark.parametrize("words", ["we use things on this site", "ab cd ef gh ij kl mn op qr st uv", "one"])
def test_every_word_counts(spark, words):
    """Of a block's words all are compared, not some: those on all pages and those of one, by their number; twice in a leaf of a page is once."""
    sources = [f"<div class=q><p>{words} own{i}</p><p>{words.title()}</p></div>" for i in range(20)]
    frame = spark.createDataFrame([(i, f"http://h/{i}", source, 1, 2) for i, source in enumerate(sources)], SCHEMA)
    (got,) = pages.importance(pages.stage(pages.read_pages(frame), "test")).collect()
    same = len(words.split())
    whole, alike = (same + 2) // 2, (same + 1) // 2  # weights of the blocks
    assert got.m == 20 and abs(got.content - (whole + 1) / (whole + alike + same + 1)) < 1e-9
    found = {(r.weight, r.n): r.found for r in pages.features(pages.distinct_pages(pages.stage(pages.read_pages(frame), "test"))).groupBy("weight", "n").agg(pages.F.count("*").alias("found")).collect()}
    assert sum(found.values()) == same + 1 + 20 + 20 and sum(w * n * k for (w, n), k in found.items()) == 20 * (whole + alike + same + 1)


@pytest.mark.parametrize("held", [1, 5, 1000])
def test_equal_features_become_one(monkeypatch, held):
    monkeypatch.setattr(pages, "MOST_HELD", held)
    r = random.Random(held)
    rows = [(r.choice(["a", "b", ""]), r.randint(-1, 1), [(r.choice([-(2**63), -1, 0, 7, 2**62, 2**63 - 1])) for _ in range(r.randint(1, 4))]) for _ in range(40)]
    frames = [{"host": [h for h, _, _ in part], "leaf": [leaf for _, leaf, _ in part], "feature": [f for *_, f in part], "weight": [[1 + x % 3 for x in f] for *_, f in part]} for part in (rows[:15], [], rows[15:])]
    schema = pages.pa.schema([("host", pages.pa.string()), ("leaf", pages.pa.int64()), ("feature", pages.pa.list_(pages.pa.int64())), ("weight", pages.pa.list_(pages.pa.int32()))])
    got, lots = collections.Counter(), collections.defaultdict(set)
    for batch in pages.counted(pages.pa.RecordBatch.from_pydict(f, schema) for f in frames):
        for row in batch.to_pylist():
            for feature, weight, n in zip(row["feature"], row["weight"], row["n"], strict=True):
                assert weight == 1 + feature % 3
                got[row["host"], row["leaf"], feature] += n
                lots[feature].add(row["lot"])
    assert got == collections.Counter((h, leaf, x) for h, leaf, f in rows for x in f) and all(len(lot) == 1 for lot in lots.values())
