from changelake.llm import htmltext
from changelake.llm.htmltext import main_text

SIDE = "<aside class='sidebar'><p>lots of side words here to be found in the sidebar with long texts of all kinds</p></aside>"


def test_article_between_menus_and_footers():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- ad -->"
        "<div class='ad'>Buy this now.</div><article><h1>Head</h1><p><b>Bold &amp; more<br>\n next<p>Un<i>clos</i>ed &quo &am</p></article><footer>&copy; foot</footer>"
    )
    assert main_text(page) == "Head Bold & more next Unclosed &quo &am"


def test_other_frames_and_inner_boilerplate():
    body = "<h2>Title</h2><p>Hello <b>wor</b>ld &amp; all you.</p><div class='ad-box'>Buy</div><p>More text here with many words in it.</p><ul><li>one<li>two</ul>"
    for frame in ("<div class='post-content'>{}</div>", "<main>{}</main>", "<div role='main'>{}</div>", "<section class=article>{}</section>", "<div id=\"content\">{}</div>"):
        inner = body + "<div class='comments'><p>great post, really nice of you</p></div><form>Name <input> Mail</form><div class='cookieNotice'>cookies are used</div>"
        page = f"<html><body class='no-sidebar'><header><h1>Site</h1></header>{frame.format(inner)}{SIDE}<footer>foot</footer></body></html>"
        assert main_text(page) == "Title Hello world & all you. More text here with many words in it. one two", frame


def test_frames_only_widen_the_region():
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    assert main_text(f"<article><h1>Title</h1><div class='article-body'><p>{words('a', 50)}</p></div></article>{SIDE}") == f"Title {words('a', 50)}"
    for name in ("entry-content", "content", "text"):
        page = f"<nav><a>menu</a></nav><div><div class='{name}'><p>{words('a', 60)}</p></div><div class='{name}'><p>{words('b', 40)}</p></div></div>{SIDE}"
        assert main_text(page) == f"{words('a', 60)} {words('b', 40)}", name


def test_one_name_around_an_article_does_not_empty_it():
    story = "Title Some words of the story, and some more of them to read."
    article = "<article><h1>Title</h1><p>Some words of the story, and some more of them to read.</p></article>"
    for before, after in (
        ("<div class='page no-sidebar'>", "</div>"), ("<div id='wrapper' class='has-menu'>", "</div>"), ("<div class='modal-page'><main>", "</main></div>"),
        ("<form action='/'>", "</form>"), ("<div class='widget'><div>", "</div></div>"),
    ):
        assert main_text(f"<body>{before}{article}{SIDE}{after}<footer>foot</footer>") == story, before
        plain = article.replace("article>", "div>")
        assert main_text(f"<body>{before}{plain}{after}<footer>foot</footer>") == story, before
    comments = f"<section id='comments'>{'<article>a comment that is long</article>' * 30}</section>"
    assert main_text(f"<body>{article}{comments}") == story


def test_end_tags_that_may_be_left_out():
    body = "<body><p>Some words to read here.</p>"
    for head in ("<head>", "<head><title>t</title><meta charset=x><style>p{}</style>", "<head><script>'<div>'</script><link rel=x>", "<head><title>t</title></head>"):
        assert main_text(f"<html>{head}{body}") == main_text(f"<html>{head}{body[6:]}") == "Some words to read here.", head
    for raw in ("<datalist><option value=a></datalist>", "<datalist><option>one<option>two</datalist>", "<option>one</option>", "<svg>", "<noscript>", "<select>"):
        assert main_text(f"<body>{raw}<p>Some words to read here.</p>") == "Some words to read here.", raw
    assert main_text("<p>Some words.</p><script>var x = 1; <p>more</p>") == "Some words."


def test_plain_input():
    assert main_text("<p>just a para</p>") == "just a para"
    assert main_text("plain text, 1 < 2 &lt;b&gt;") == "plain text, 1 < 2 <b>"
    assert main_text("<p>cut off</p><div cla") == "cut off"
    assert main_text("") == main_text("<nav>menu</nav>") == main_text("<script>x") == ""
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"


def test_deep_and_long_pages():
    assert main_text("<div>" * 20000 + "x " * 5000).startswith("x x")
    assert main_text("<p>a b c</p>" * 20000).count("a") == 20000
    main_text("<a " * 20000), main_text("<" * 20000), main_text("<a href='" * 5000)


def test_weights_come_from_the_labels():
    w = htmltext.learn(htmltext.LABELLED)
    assert w.feature["<nav>"] < -1 < 0.5 < w.feature["<article>"] and w.feature[".comments"] < -1
    assert w.tag["div"] < w.tag["p"] < 0 < w.word


def test_rows(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article><p>a b</p></article>")]
    frame = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in htmltext.extract(frame).collect())
    assert got == [(0, "v", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, "", "", 0)]
    assert htmltext.extract(frame.where("page_id = 9")).count() == 0
