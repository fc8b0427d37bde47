"""Main text of hand-made pages, and what the host's tree adds."""

from citeloom.llm import site_tree as st

SHELL = ("<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><a href='/'>Home</a></header>"
         "<nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>{body}<footer>&copy; x</footer></body></html>")


def text(html):
    return st.main_text(st.Page(html), frozenset())


def test_article_without_furniture():
    body = ("<aside>side</aside><article><h1>Title &amp; more</h1><p>One  <b>bold</b>\n text&nbsp;here.<br>Next<p>Two<form><input>Name</form>"
            "<div class='ad'>Buy</div><ul><li>x<li>y</ul><!-- c --><section id='comments'><p>Reader says</p></section></article><div class='sidebar'>s</div>")
    assert text(SHELL.format(body=body)) == "Title & more\n\nOne bold text here. Next\n\nTwo\n\nx\n\ny"


def test_tag_soup_and_cut_pages():
    assert text("<article><p><b>Open.<br><p>Second</p></article><footer>f</footer>") == "Open.\n\nSecond"
    assert text("<article><p>Whole<p>cut <a href='x") == "Whole\n\ncut"
    assert text("<article><p>1 < 2 and &lt;b&gt; &am</p><script>unclosed") == "1 < 2 and <b> &am"
    assert text("plain text only") == "plain text only"
    assert text("") == "" and text("<div></div>") == ""
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<body><div><p>Text of a page without article, long enough to stay.</p></div><ul><li><a href='/'>All links</a></li></ul></body>") == (
        "Text of a page without article, long enough to stay.")


def test_everyday_names_alone_do_not_decide():
    parts = ("<div class='entry-header'><h1>Title</h1></div>", "<section id='discussion'><h2 id='social-security'>Head</h2><p>Found</p></section>",
             "<section id='related-work'><p>Others</p></section>", "<section id='comments-on-method'><p>Ours</p></section>", "<p class='notice'>Mind</p>",
             "<h3 id='legal-history'>Law</h3>", "<div class='ad-hoc'><p>Nets</p></div>")
    body = "".join(parts)
    want = "Title\n\nHead\n\nFound\n\nOthers\n\nOurs\n\nMind\n\nLaw\n\nNets"
    assert text(SHELL.format(body=f"<article>{body}<div class='related-posts'>See <a href='/1'>one more</a></div><div class='hidden'>x</div></article>")) == want
    assert text(f"<body><div id='content'>{''.join(parts[:6])}</div></body>") == want[:-6]


def test_names_of_furniture_alone_decide_on_containers():
    names = ("comment-list", "comments-area", "commentList", "sidebar-widget", "ad-slot", "advert-box", "cookie-notice", "newsletter-box", "notice",
             "comment", "share", "related-posts", "promo block share-bar")
    gone = "".join(f"<div class='{n}'><p>out</p></div>" for n in names) + "<div id='comment-section'>out</div><ol class='comment-list'><li>out</ol>"
    gone += "<section class='comments-area'><p>out</p></section>"
    kept = "".join(f"<div class='{n}'><p>in</p></div>" for n in ("ad-hoc", "entry-header", "related-work", "discussion", "legal-text", "has-sidebar", "share-capital"))
    kept += "<pre>x <span class='comment'>in</span></pre><section id='comments-on-method'><p>in</p></section><h2 id='social-security' class='notice'>in</h2><section id='related-posts'><p>in</p></section>"
    assert text(SHELL.format(body=f"<article>{gone}{kept}</article>")) == "\n\n".join(["in"] * 7 + ["x", "in"] + ["in"] * 3)
    long = "<p>Text of a page without article, long enough to stay.</p>"
    assert text(f"<body><div class='header'>Site</div><div class='wrap no-sidebar'>{long}</div><div class='comment'>out</div><div class='share'>out</div></body>") == long[3:-4]


def rows(spark, data):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(data)], "page_id long, url string, html string, host string, low string")


def test_repeated_branches_go_and_copies_do_not_make_a_template(spark, words):
    box = "<div class='box'>The same words stand here on every page</div>"
    data = [(f"http://h.com/{i}", f"<body><div class='main-col'><p>{words(20)}</p></div>{box}</body>") for i in range(12)]
    copy = f"<body><div class='main-col'><p>{words(20)}</p></div><div class='x'>once</div></body>"
    data += [("http://copies.com/1", copy)] * 20
    out = {r.page_id: r for r in st.extract_text(rows(spark, data)).collect()}
    assert all("same words" not in out[i].text and len(out[i].text.split()) == 20 for i in range(12))
    assert all(out[i].text.endswith("once") for i in range(12, 32))
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_article_survives_a_host_of_near_copies(spark, words):
    base = [words(15) for _ in range(5)]
    data = [("http://n.com/", "<body><article>" + "".join(f"<p>{b}</p>" for b in base) + f"<p>{i}</p></article></body>") for i in range(15)]
    out = st.extract_text(rows(spark, data)).collect()
    assert all(r.text == "\n\n".join([*base, str(r.page_id)]) for r in out)


def test_wrapper_of_rare_variants_keeps_its_texts(spark, words):
    box = "<div class='box'>The same words stand here on every page</div>"

    def page(i, open_tag, close_tag):
        rare = i // 5 if i < 100 else 0
        extra = "".join(f"<{t}>{words(4)}</{t}>" for t in ("h2", "h3", "h4", "h5", "pre") if rare & 1 << "h2 h3 h4 h5 pre".split().index(t))
        return f"<body>{open_tag}<p>{words(12)}</p>{extra}{close_tag}{box}</body>"

    kinds = {"http://a.com": ("<article><div class='body'>", "</div></article>"), "http://b.com": ("<div id='content'>The same words of its own", "</div>")}
    data = [(f"{host}/{i}", page(i, *tags)) for host, tags in kinds.items() for i in range(1000)]
    low = {r.path for r in st.importance(st.tree_rows(rows(spark, data).withColumn("host", st.url_host("url")))).filter("importance < 0.3").collect()}
    assert {"/body/article/div.body", "/body/div#content"} <= low
    out = st.extract_text(rows(spark, data)).collect()
    assert len(out) == 2000 and all(len(r.text.split()) >= 12 and "same words" not in r.text for r in out)
    assert all(len(r.text.split("\n\n")) == 1 + bin(r.page_id % 1000 // 5 if r.page_id % 1000 < 100 else 0).count("1") for r in out)


def test_plain_elements_of_an_article_never_fall_with_a_wrapper(spark, words):
    base = [words(15) for _ in range(5)]
    data = [("http://n.com/", f"<body><article><h1>{i}</h1><div class='body'>" + "".join(f"<p>{b}</p>" for b in base) + "</div></article></body>") for i in range(15)]
    assert all(r.text == "\n\n".join([str(r.page_id), *base]) for r in st.extract_text(rows(spark, data)).collect())


def test_everyday_names_go_where_the_branch_repeats(spark, words):
    box = "<div class='share-box'><p>Tell your friends of it</p></div>"
    data = [(f"http://e.com/{i}", f"<body><article><section id='discussion'><p>{words(20)}</p></section><div class='legal-text'><p>{words(9)}</p></div>{box}</article></body>")
            for i in range(12)]
    out = st.extract_text(rows(spark, data)).collect()
    assert all(len(r.text.split()) == 29 and "friends" not in r.text for r in out)


def test_shuffled_join_gives_the_same(spark, words, monkeypatch):
    data = [(f"http://h{i % 2}.com/{i}", f"<body><p>{words(12)}</p><div class='box'>same on all</div></body>") for i in range(16)]
    whole = sorted(map(tuple, st.extract_text(rows(spark, data)).collect()))
    monkeypatch.setattr(st, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, st.extract_text(rows(spark, data)).collect())) == whole


def test_odd_rows(spark):
    data = [(None, "<p>a</p>"), ("http://x.com", None), ("http://x.com", ""), ("no scheme", "<article>b</article>"), ("no scheme", "<article>b</article>"),
            ("http://x.com/l", "<article>" + "<p>w</p>" * 20000 + "</article>")]
    out = {r.page_id: r for r in st.extract_text(rows(spark, data)).collect()}
    assert [out[i].text for i in range(5)] == ["a", "", "", "b", "b"] and out[5].n_chars == 3 * 20000 - 2
    assert st.extract_text(rows(spark, [])).count() == 0
