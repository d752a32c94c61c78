"""The style tree against a plain computation, its verdicts, what it does on the test pages, and broken markup."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest

from offerloom.llm import html_extract as H

PAGES = "page_id long, url string, html string"


def plain_tree(pages):
    """{(host, branch): (pages, words, content, importance)} from the definitions, all pages of a host at once."""
    held, shown, seen = {}, {}, Counter()
    for _, url, page in pages:
        blocks, styles = H.read(page, furniture=True)
        host = H.host_of(url)
        for branch in {b for b, _, _ in blocks} | set(styles):
            seen[host, branch] += 1
            count = Counter(w for b, _, t in blocks if b == branch for w in t.split())
            held.setdefault((host, branch), []).append(count)
            shown.setdefault((host, branch), []).extend({tuple(s) for s in styles.get(branch, [])})
    out = {}
    for key, m in seen.items():
        words = set().union(*held[key])
        entropy = 0.0
        for w in words:
            n = [c[w] for c in held[key] if c[w]]
            entropy -= sum(x / sum(n) * math.log(x / sum(n), m) for x in n) if m > 1 else 0
        content = 1 - entropy / len(words) if words else 1.0
        styles = Counter(shown[key])
        total = sum(styles.values())
        style = min(1.0, -sum(x / total * math.log(x / total, m) for x in styles.values())) if m > 1 and total else 1.0
        weight = H.DECAY ** len(styles)
        out[key] = (m, len(words), content, (1 - weight) * style + weight * content)
    return out


def site(host, n, rng, words):
    """Pages whose menus come from a few, beside articles of their own words."""
    menus = [" ".join(rng.choices(words, k=6)) for _ in range(3)]
    for i in range(n):
        own = " ".join(f"{host}{rng.randrange(10**6)}" for _ in range(25))
        parts = "".join(f"<p>{own} {rng.choice(words)}</p>" for _ in range(rng.randint(1, 4)))
        yield i, f"http://{host}.it/{i}", f"<body><div class='box{i}'>{rng.choice(menus)}</div><article><h1>{own[:20]}</h1>{parts}</article><ul><li>{menus[0]}<li>x</ul></body>"


def test_importance_is_what_the_definitions_give(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    pages = [p for host, n in (("a", 30), ("b", 1), ("c", 5)) for p in site(host, n, rng, words)]
    want = plain_tree(pages)
    got = {r.node: r for r in H.style_tree(spark.createDataFrame(pages, PAGES).repartition(3)).collect()}
    assert len(got) == len(want)
    for (host, branch), (m, words_of, content, importance) in want.items():
        r = got[H.node_of(host, branch)]
        assert (r.pages, r.words, r.site) == (m, words_of, H.site_of(host))
        assert r.content == pytest.approx(content, abs=1e-9) and r.importance == pytest.approx(importance, abs=1e-9)
        assert r.standing == (2 if branch.endswith("/article") else 0)


def test_sites_hash_as_in_spark(spark):
    from pyspark.sql import functions as F

    hosts = ["", "a.it", "www.Èé.example.org", "x" * 100]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(F.xxhash64("h")).collect()
    assert [r[0] for r in got] == [H.site_of(h) for h in hosts]


def test_the_tree_tells_repeated_from_own_text_beside_the_main_element(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    pages = [(i, f"http://a.it/{i}", f"<body><div class=teaser>{rng.choice(words[:4])} e {rng.choice(words[4:8])}</div><div class=intro>" + " ".join(f"i{rng.randrange(10**6)}" for _ in range(9)) + "</div><article><p>" + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + "</p></article></body>") for i in range(100)]
    tree = H.style_tree(spark.createDataFrame(pages, PAGES))
    said = {r.node: r.rich for r in H.verdicts(tree).collect()}
    assert said == {H.node_of("a.it", "/body/div.teaser"): False, H.node_of("a.it", "/body/div.intro"): True}
    for few, kept in ((100, 2), (20, 1)):  # on few pages HTML alone says what is main
        got = H.extract(spark.createDataFrame(pages[:few], PAGES)).collect()
        assert all(len(r.text.split("\n\n")) == kept for r in got)


@pytest.mark.parametrize(("sf", "removed", "exact"), [("sf0.01", 12, 4), ("sf0.1", 78, 1361)])
def test_what_the_tree_does_on_the_test_pages(spark, sf, removed, exact):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    assert H.verdicts(H.style_tree(pages)).where("NOT rich").count() == removed
    whole = {r.page_id: r.text for r in H.extract(pages).collect()}
    alone = {r.page_id: r.text for r in H.extract(pages, names=False, declared=False).collect()}
    assert sum(alone[i] == whole[i] for i in whole) == exact
    assert {r.page_id: r.text for r in H.extract(pages, names=False).collect() if r.text != whole[r.page_id]}.keys() <= {i for i in whole if len(whole[i]) < 400}


@pytest.mark.parametrize("inside", ["div class='notice-period'", "h2 class='related-work'", "div class='search-results'", "section id='discussion'", "h2 id='the-navy'", "h2 id='search-algorithms'", "math", "div class='tags'", "div class='share-price'"])
def test_names_that_only_look_like_furniture(inside):
    tag = inside.split()[0]
    assert H.main_text(f"<article><h1>T</h1><{inside}>dentro</{tag}><p>resto</p></article>") == "T\n\ndentro\n\nresto"
    assert H.main_text(f"<div><p>resto</p><{inside}>dentro</{tag}></div>") == "resto\n\ndentro"


@pytest.mark.parametrize("name", ["ad", "ad-slot-2", "left-sidebar", "cookie-notice", "related-posts", "side-bar", "site-header", "share-buttons", "comment-list", "newsletter-signup"])
def test_furniture_goes(name):
    assert H.main_text(f"<div class='x {name}'>via</div><p>resto</p>") == "resto"


def test_a_small_main_element_does_not_speak_for_the_page():
    page = "<div><p>" + "corpo " * 50 + "</p></div><article>scheda</article>"
    assert H.main_text(page) == ("corpo " * 50).strip() + "\n\nscheda"


@pytest.mark.parametrize(
    "broken",
    [lambda n: "<a " * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<a '>'" * n, lambda n: '<a "' * n + ">", lambda n: "<a<a" * n, lambda n: "<ul>" + "<center>" * n + "<li></li>" * n, lambda n: "<script></script " * n, lambda n: "<div class=x>" * n + "hi" + "</div>" * n, lambda n: "<!a" * n, lambda n: "<a " + 'x="' * n + ">"],
)
def test_broken_markup_ends_soon(broken):
    began = time.time()
    H.main_text(broken(350_000))
    H.read(broken(50_000), furniture=True)
    assert time.time() - began < 30


def test_deep_nesting_keeps_its_text():
    assert H.main_text("<div><p>" * 3000 + "fondo" + "</p></div>" * 3000 + "<p>dopo") == "fondo\n\ndopo"


def test_names_in_camel_case_and_names_of_content():
    article = "<article><p>The text.</p>{}</article>"
    for name in ("commentSection", "navLinks", "adBox", "userComments", "AdSlot2", "HTMLAdBanner"):
        assert H.main_text(article.format(f'<div class="{name}">furniture</div>')) == "The text."
    for tag, name in (("table", "menu"), ("ul", "menu"), ("div", "social"), ("div", "loadState"), ("section", "adaptive")):
        inner = {"table": "<tr><td>kept</td></tr>", "ul": "<li>kept</li>"}.get(tag, "<p>kept</p>")
        assert H.main_text(article.format(f'<{tag} class="{name}">{inner}</{tag}>')) == "The text.\n\nkept"
        assert H.main_text(f'<article><{tag} class="{name}">{inner}</{tag}></article>') == "kept"
    assert H.main_text('<body><ul class="menu"><li>Home</li></ul><div><p>The text.</p></div></body>') == "The text."


def test_what_lies_deeper_than_the_limit_is_still_cut_out():
    deep = "<div>" * 600
    for page, want in (
        (f"<body>{deep}<nav>MENU</nav>text{'</div>' * 600}</body>", "text"),
        (f"<body>{deep}<nav><nav>A</nav>B</nav><p>text</p><form>C</form>more</body>", "text\n\nmore"),
        (f"<body>{deep}<div class='commentList'><div>x</div>y</div>text</body>", "text"),
        (f"<body><p>a</p><div>{deep}<nav>open{'</div>' * 601}<p>b</p></body>", "a\n\nb"),
    ):
        assert H.main_text(page) == want
    import time

    began = time.time()
    assert H.main_text("<div>" * 200_000 + "<nav>x</nav>" * 50_000 + "end") == "end" and time.time() - began < 10


def test_long_and_deep_branches_stay_apart():
    long_ = "a" * 80
    blocks, _ = H.read(f'<div class="{long_}b">x</div><div class="{long_}c">y</div>' + "<div>" * 40 + '<section class="p">z</section><section class="q">w</section>')
    assert len({b for b, _, _ in blocks}) == 4
    blocks, _ = H.read("<main>" + "<div>" * 40 + '<section class="p">z</section>')
    assert blocks[0][1] and blocks[0][0].startswith("/main/~")


def test_the_tree_alone_tells_furniture_that_nothing_declares(spark):
    """Sites whose repeated boxes have neither element nor name that says so: the tree decides, page by page of every larger site."""
    rows = []
    for site, pages in enumerate((1, 3, 12, 40, 90)):
        for k in range(pages):
            own = " ".join(f"w{site}{k}x{j}" for j in range(30))
            box = "buy now our best offer of the week and read the rules of this site"
            rows.append((len(rows), f"https://s{site}.org/{k}", f'<body><div class="alpha">{box}</div><div class="beta"><p>{own}</p></div></body>', own, pages))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, own string, pages int")
    right = {}
    for tree in (False, True):
        found = {r.page_id: r.text for r in H.extract(df, tree=tree).collect()}
        right[tree] = {n: sum(found[r[0]] == r[3] for r in rows if r[4] == n) for n in (1, 3, 12, 40, 90)}
    assert right[False] == dict.fromkeys((1, 3, 12, 40, 90), 0)
    assert right[True] == {1: 0, 3: 0, 12: 12, 40: 40, 90: 90}
