import pytest

from sextant.llm import html as H


def text(source):
    return "\n".join(t for t, _ in H.Page(source).main())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="top ad">Buy</div>%s<footer>&copy; F</footer></body></html>"""


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>A  &amp; B</h1><p>one <b>two<br>three<p>four</p></article>", "A & B\none two three\nfour"),
        ("<article><p>a&am b&amp c&#x41;&nbsp;d</article><p>after", "a&am b& cA d"),
        ("<main><div id=share-bar>s</div><p>a<i>b</i>c</p><aside>x</aside><section class='comments'><p>r</p></section></main>", "abc"),
        ("<main><header><h1>T</h1></header><p hidden>x</p><p style='display: none'>y</p><p>z</main>", "T\nz"),
        ("<header>top</header><div><p>only</p>tail <em>x</em></div><form>f</form>", "only\ntail x"),
        ("<article class=teaser><p>short</p></article><article><p>the longest of them</p></article>", "the longest of them"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc\nd\ne"),
        ("<article><p>x <span class=ad>buy <span>now</span> or</span> y</p><button>b</button></article>", "x y"),
        ("<article><p>a < b > c <3</p><script>if (a < b) {}</script></article>", "a < b > c <3"),
        ("<article><textarea>t</textarea><noscript><p>n</p></noscript><p>k</p></article>", "k"),
        ("<div class='wrap with-sidebar no-ads'><article><p>k</p></article><div class='left sidebar'>s</div></div>", "k"),
        ("<article></article>", ""),
        ("<ARTICLE><P CLASS='lead'>Up</P></ARTICLE>", "Up"),
        ("<article><b>x<p>y</b>z</p></article>", "x\nyz"),
    ],
)
def test_structure(body, want):
    assert text(PAGE % body) == want


def test_odd_pages_in_linear_time():
    for source in ("", "plain", "<", "<p", "<!-- x", "<div>" * 50_000 + "x", "<p><b>" * 50_000 + "x", "</p>" * 50_000, "<a \"" * 50_000, "<li>" * 50_000, "<td>" * 50_000, "<script>" * 50_000, "<!--" * 50_000, "<span class=ad>" * 50_000):
        H.Page(source).main()
    page = H.Page("<div>" * 20_000 + "x" + "</div>y" * 20_000)
    assert len(page.main()) == 20_001 and len(page.main({page.digest[1]})) == 1 and len(page.main({page.digest[20_000]})) == 20_000


def test_templates_of_hosts(spark):
    def page(i, host):
        note = "<div class=x><p>Read our terms</p></div>" if i % 3 else "<div class=x><p>Read our terms</p><p>twice</p></div>"
        return f"<body>{note}<div><p>Story {i} of {host}</p></div><article-like><p>quoted by all</p></article-like></body>"

    rows = [(i, f"http://{h}.example.org/{i}", page(i, h)) for h in "ab" for i in range(30)]
    rows += [(100 + i, f"http://c.example.org/{i}", page(i, "c")) for i in range(4)]  # too few to tell
    rows += [(200 + i, "http://d.example.org/", f"<article><p>Same words</p><div><p>Follow us</p></div><p>{i}</p></article>") for i in range(20)]
    rows += [(300, None, None), (301, "x", ""), (None, "http://a.example.org/z", page(1, "q"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.url): r for r in H.main_text(df).collect()}
    assert len(got) == len(rows)
    for i, url, source in rows:
        t = got[i, url].text
        assert got[i, url].n_chars == len(t)
        if source and "Story" in source:
            wanted = [x for x in ("Read our terms", "twice", f"Story {i - 100 if 100 <= (i or 0) < 200 else i} of", "quoted by all") if x in source]
            if "c.example" in url:
                assert t.split("\n")[0] == "Read our terms"
            else:
                assert t.startswith("Story") and t == t.split("\n")[0]  # what recurs is gone, in either form
        elif source:
            assert t == f"Same words\n{i - 200}"  # quoted paragraphs of an article stay
        else:
            assert t == ""
    assert H.main_text(df.limit(0)).count() == 0


def test_counts_match_plain_ones(spark):
    import random
    from collections import Counter, defaultdict

    r = random.Random(5)
    rows = [(i, f"https://h{i % 3}.net/{i}", "<body>" + "".join(f"<div>{r.choice('abcdefgh')}<p>{r.choice('xyz')}</p></div>" for _ in range(6)) + "</body>") for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in H.main_text(df).collect()}
    holds, pages = defaultdict(Counter), Counter()
    parsed = {}
    for i, url, source in rows:
        page = H.Page(source)
        parsed[i] = page
        pages[url[8:10]] += 1
        holds[url[8:10]].update({d for d in page.digest if d})
    for i, url, _ in rows:
        host, page = url[8:10], parsed[i]
        bad = {d for d, n in holds[host].items() if n >= H.LEAST_PAGES and n >= H.LEAST_SHARE * pages[host]}
        keep = []
        for t, node in page.blocks:
            k = node
            while k and page.digest[k] not in bad:
                k = page.parent[k]
            if not k:
                keep.append(t)
        assert got[i] == "\n".join(keep)


def test_all_articles_and_formulas_stay():
    assert text(PAGE % "<article><p>one</p></article><p>between</p><article><p>two <math><mi>x</mi></math></p></article><article class='card related'><p>other</p></article>") == "one\ntwo x"
    assert text(PAGE % "<main><p>a</p></main><main><article><p>b</p></article></main>") == "b"


def test_menus_without_telling_names_go_by_their_counts(spark):
    """The menu, the notice in the article and the footer say nothing of themselves; their recurring subtrees do."""
    menu = "<div class=x1><ul><li>Home</li><li>World</li></ul></div>"
    body = "<body>%s<article><h1>Story %d</h1><p>Some words %d</p><p>Quoted everywhere</p><div class=x2>Tell your friends</div></article><div class=x3>All rights</div><div>%s</div></body>"
    rows = [(i, "http://a.org/x", body % (menu, i, i, "a" * i)) for i in range(40)]
    rows += [(100 + i, "http://b.org/x", body.replace("article", "section") % (menu, i, i, "tail")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    off = {r.page_id: r.text for r in H.main_text(df, least_pages=1000).collect()}
    for i in range(40):
        assert got[i] == f"Story {i}\nSome words {i}\nQuoted everywhere"
        assert off[i] == got[i] + "\nTell your friends"
        assert got[100 + i] == f"Story {i}\nSome words {i}" and off[100 + i] == f"Home\nWorld\nStory {i}\nSome words {i}\nQuoted everywhere\nTell your friends\nAll rights\ntail"


def test_equal_pages_are_counted_once(spark):
    rows = [(i, "http://a.org/x", "<body><div><p>The only story</p></div></body>") for i in range(30)] + [(99, "http://a.org/y", "<body><p>Else</p></body>")]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "The only story" for i in range(30)} | {99: "Else"}


def test_templates_by_a_join(spark, monkeypatch):
    rows = [(i, "http://a.org/x", f"<body><div>Same</div><p>{i}</p></body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in H.main_text(df).collect()} == {i: str(i) for i in range(20)}
