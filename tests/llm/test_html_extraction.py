import html
import re
from collections import Counter

import numpy as np

from gleanmark.llm import html_extraction as H


def plain_article(page: str) -> str:
    """The article of the given pages, whose markup is simple, by patterns."""
    article = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    article = re.sub(r"</?(?:b|i|em|strong|a)\b[^>]*>", "", article).replace("<br>", " ")
    blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1|h2|div|ul|li)[^>]*>", article)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = H.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r["text"] == plain_article(source[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def texts(page):
    return [b[0] for b in H.page_blocks(page)]


def test_markup():
    assert texts("<body><header>Site</header><main><header><h1>T &amp; U</h1></header><div class='share-buttons'>x</div>"
                 "<p>a<b>b</b> c&nbsp;d<p>e <br>f<section id='comments'><article>nice</article></section>"
                 "<footer>x</footer></main><aside>y</aside>") == ["T & U", "ab c d", "e f"]
    assert texts("<div hidden>a</div><div style='display: none'>b</div><form><p>c</form><p role='alert'>d<p>e") == ["e"]
    assert texts("<script>var t='</p>'; if (a<b) {}</script><style>p{}</style><!-- c --><p>x &lt;y&gt; &#8364;</p>") == ["x <y> €"]
    assert texts(None) == texts("") == texts("<p></p>") == []
    assert texts("no markup at  all") == ["no markup at all"]


def test_head_without_end_tag():
    assert texts("<html><head><title>t</title><meta charset=utf-8><body><p>a</p></body>") == ["a"]
    assert texts("<head><title>t</title><style>p{}</style><div>a</div><p>b") == ["a", "b"]
    assert texts("<head><title>t</title> words <b>in</b> the body") == ["words in the body"]
    assert texts("<head><noscript><img src=x></noscript><title>t</title><body><p>a") == ["a"]
    assert texts("<html><head><title>t</title></head><body><div>a</div><head><p>b</p></body>") == ["a", "b"]


def test_names_of_wrappers():
    for name in ("container no-sidebar", "with-sidebar", "has-header", "ad-free", "content-sidebar-wrap", "noSidebar", "nav-open"):
        assert texts(f"<body><div class='{name}'><article><p>a</p></article></div></body>") == ["a"]
        assert texts(f"<body><div id='{name.split()[-1]}'><p>a</p></div><div class='sidebar'>s</div></body>") == ["a"]
    for name in ("sidebar", "share-buttons", "site-header", "cookieBanner", "Footer", "ad-slot-3", "x comments"):
        assert texts(f"<body><p>a</p><div class='{name}'>s</div></body>") == ["a"]


def test_articles_in_ruled_out_wrappers():
    assert texts("<div class='sidebar'>s<main>a<p>b</main>t</div>") == ["a", "b"]
    assert texts("<div class='sidebar'>s<article>a<p>b</article>t</div>") == ["a", "b"]
    assert texts("<main><h1>t</h1><div class='sidebar'>s<article>a</article></div></main>") == ["t", "a"]
    assert texts("<div>post</div><div class='sidebar'><article>a</article></div>") == ["post", "a"]
    assert texts("<article>post</article><div class='sidebar'><article>teaser</article></div>") == ["post"]
    assert texts("<div>post</div><section id='comments'><article>nice</article></section>") == ["post"]
    assert texts("<div class='sidebar' hidden><article>a</article></div><nav><article>b</article></nav>") == []


def test_names_of_comments_and_menus():
    for name in ("user-comment", "reader-comments", "article-comments", "userComments", "usercomment-5", "top-navigation-mobile",
                 "topnav", "mainmenu", "entry-comments", "recent-comments"):
        assert texts(f"<article><p>a</p><div class='{name}'><p>s</p></div></article>") == ["a"], name
        assert texts(f"<body><p>a</p><section id='{name}'>s</section></body>") == ["a"], name
    for name in ("comments-open", "platform", "commentary", "article-header", "entry-header", "has-comments", "user", "mobile"):
        assert texts(f"<article><div class='{name}'><h1>t</h1></div><p>a</p></article>") == ["t", "a"], name
        assert texts(f"<body><div class='{name}'><h1>t</h1></div><p>a</p></body>") == ["t", "a"], name


def test_title_beside_the_article():
    assert texts("<h1>Site</h1><main><h1>t</h1><p>teaser</p><article><p>a</p></article><h1>more</h1></main>") == ["t", "a"]
    assert texts("<main><div><h1>t</h1></div><article><h1>u</h1>a</article></main>") == ["t", "u", "a"]


def test_parts_without_end_tag():
    assert texts("<body><nav><ul><li>m</li></ul><article><h1>t</h1><p>a</p></article><footer>f</body>") == ["t", "a"]
    assert texts("<body><nav><a>m</a><p>a<p>b</body>") == ["a", "b"]
    assert texts("<body><nav>m<h1>t</h1><div>a</div><footer>f<p>g") == ["t", "a"]
    assert texts("<nav>m</nav><aside>s<main>a</main>") == ["a"]
    assert texts("<div><nav>m</div><p>a</p>") == ["a"]
    assert texts("<form>f<nav>m<article>a</article></body></html>") == ["a"]
    assert texts("<nav>m<p>n</nav><p>a") == ["a"]
    assert texts("<nav>m") == []


def test_shared_prefixes_brute_force():
    rng = np.random.default_rng(1)
    tokens, page = rng.integers(0, 3, 400), np.sort(rng.integers(0, 6, 400))
    found = H.shared_prefixes(tokens, page, 8)
    spans = [tuple(tokens[i : i + 8]) if i + 8 <= 400 and page[i] == page[i + 7] else None for i in range(400)]
    for i, span in enumerate(spans):
        pages = {page[j] for j in range(400) if spans[j] == span}
        assert found[i] == (len(pages) if span else 0)


def test_boilerplate_of_a_host(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    page = "<body><div>Home and about us and contact the big site of the world</div><div>{}</div></body>"
    rows = [(i, "http://a.example/" + str(i), page.format(t)) for i, t in enumerate(own)]
    rows += [(100, "http://b.example/", page.format("other")), (101, None, None), (102, "no url", ""), (102, "no url", "")]
    found = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(12)] == own
    assert found[100] == "Home and about us and contact the big site of the world\nother"
    assert found[101] == found[102] == ""


def neutral(page: str) -> str:
    """A page whose tags and names say nothing of its parts."""
    page = re.sub(r"<(/?)(?:article|main|nav|footer|header|aside|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)=("[^"]*"|'[^']*')""", "", page)


def test_suffix_arrays_without_markup(spark):
    """Where markup says nothing the repeated runs decide; without them no boilerplate block goes."""
    given = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()
    article = {r["page_id"]: Counter(texts(r["html"])) for r in given}
    bare = [(r["page_id"], r["url"], neutral(r["html"])) for r in given]
    every = {i: Counter(texts(h)) for i, _url, h in bare}
    frame = spark.createDataFrame(bare, "page_id long, url string, html string")
    found = {r["page_id"]: Counter(r["text"].split("\n")) for r in H.extract(frame).collect()}
    assert found.keys() == every.keys()
    lost = kept = n_article = n_other = 0
    for i, blocks in every.items():
        for text, n in blocks.items():
            if text in article[i]:
                n_article, lost = n_article + n, lost + n - found[i][text]
            else:
                n_other, kept = n_other + n, kept + found[i][text]
    assert n_other > 15000 and kept <= 0.1 * n_other
    assert lost <= 0.08 * n_article


def test_unique_region():
    menu, notice = ("home news about us and contact the site", 0, "div"), ("we use small files on your device here", 0, "div")
    own = [[(" ".join(f"w{i}x{k}y{j}" for j in range(12)), 0, "p") for k in range(2)] for i in range(9)]
    shared = ("a passage that some articles of this crawl have in common", 0, "p")
    pages = [[menu, notice, o[0], shared, o[1], menu] for o in own] + [[menu, notice], []]
    kept = H.unique_region(pages, 3, 0.005, 64)
    assert [k.tolist() for k in kept[:9]] == [[False, False, True, True, True, False]] * 9
    assert kept[9].all() and len(kept[10]) == 0
    copy = [(" ".join(f"c{j}" for j in range(100)), 0, "p")]
    pages = [[menu, (f"number {i} of the copies of the article", 0, "p"), *copy] for i in range(5)]
    assert all(k.tolist()[1:] == [True, True] for k in H.unique_region(pages, 3, 0.005, 64))
    assert H.unique_region([], 3, 0.005, 64) == []


def test_copies_and_blocks_of_a_large_host(spark):
    page = "<body><p>one text that stands on every copy of the page and is long enough</p></body>"
    rows = [(i, f"http://a.example/{i}", page) for i in range(40)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), block_pages=10).collect()
    assert len(out) == 40 and all(r["text"].startswith("one text") for r in out)
    by_bytes = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), block_bytes=500).collect()
    assert sorted(r["page_id"] for r in by_bytes) == list(range(40)) and all(r["text"].startswith("one") for r in by_bytes)
    empty = spark.createDataFrame([], "page_id long, url string, html string, n_chars int, text string, host string")
    assert H.extract(empty).count() == 0


def test_size_of_parts_does_not_change_the_text(spark):
    """Passages near the limits, copies and long runs on a host and a crawl that are one part or many."""
    rng = np.random.default_rng(5)

    def own(n: int = 24) -> str:
        return " ".join(f"w{w}" for w in rng.integers(0, 1 << 40, n))

    menus = [own(10) for _ in range(12)]
    copied = own(150)
    rows = []
    for i in range(90):
        # Menu number k stands on every (k + 5)-th page, so the share of the pages runs from 0.2 down to 0.06.
        found = [own(), *(m for k, m in enumerate(menus) if i % (k + 5) == 0), own(), *([copied] if i % 6 == 0 else [])]
        rows.append((i, f"http://a.example/{i}", "<body>" + "".join(f"<div>{t}</div>" for t in found) + "</body>"))
    body = f"<p>{own(12)}</p><p>{own(12)}</p>"
    for i in range(90):
        passages = "".join(f"<p>{menus[k]}</p>" for k, step in enumerate((10, 5)) if i % step)
        rows.append((100 + i, f"http://b.example/{i}", f"<body><article>{passages}<p>{own()}</p></article></body>"))
    rows += [(200 + i, f"http://b.example/c{i}", f"<body><article>{body}</article></body>") for i in range(30)]
    for i in range(40):
        rows.append((300 + i, f"http://c{i}.example/", f"<body><div>{menus[2]}</div><div>{own()}</div><div>{copied if i < 2 else own()}</div></body>"))
    rows += [(400 + i, f"http://d{i}.example/", f"<body><div>{copied}</div></body>") for i in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = {r["page_id"]: r["text"] for r in H.extract(frame).collect()}
    cut = {r["page_id"]: r["text"] for r in H.extract(frame, block_pages=9, crawl_pages=13).collect()}
    assert len(whole) == len(rows) and cut == whole

    # Menus on a tenth of the 90 pages go; in articles, of the passages on 81 and 72 of 91 distinct pages the first.
    for i in range(90):
        assert [m in whole[i] for m in menus] == [i % (k + 5) == 0 and -(-90 // (k + 5)) < 9 for k in range(12)]
    assert not any(menus[0] in whole[100 + i] for i in range(90))
    assert all((menus[1] in whole[100 + i]) == (i % 5 > 0) for i in range(90))
    assert all(menus[2] not in whole[300 + i] for i in range(40)) and all(whole[400 + i] == copied for i in range(5))
