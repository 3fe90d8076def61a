from __future__ import annotations

import random
import time

from tallyline.llm import page_diff as P


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def within(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_alignment_is_a_longest_common_subsequence():
    pick = random.Random(3)
    for _ in range(600):
        a, b = ([pick.randrange(4) for _ in range(pick.randrange(14))] for _ in range(2))
        for cells in (1 << 28, 6):
            shared = [x for x, hit in zip(a, P.shared_lines(a, b, cells)) if hit]
            assert len(shared) == lcs(a, b) and within(shared, b)
    long = list(range(6000))
    assert P.shared_lines(long, long[3000:] + long[:3000], cells=1 << 20).sum() == 3000


def test_lines_and_their_places():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>H</header><div class='cookie-notice'>C<div>x</div></div>"
        "<article><header><h1>A &amp;amp; B</h1></header><p>one<br>two <span class=ad>buy</span>\n x<p>three &lt;b&gt; &#233;"
        "<section id=comments><article>nice</article></section><footer>f</footer></article><p>after<script>'</p>'</script>"
        "<aside>s</aside><form>q</form><p hidden>h</p><!-- <p>c</p> -->tail < 3<nav><ul><li>m</ul></nav></body>"
    )
    places = {2: [], 1: [], 0: []}
    for line in P.lines_of(page):
        places[line.place].append(line.text)
    assert places[2] == ["A &amp; B", "one two x", "three <b> é"]
    assert places[1] == ["after", "tail < 3"]
    assert {"H", "C", "x", "nice", "f", "s", "q", "h", "m"} <= set(places[0]) and "buy" not in str(places)
    assert P.lines_of("") == [] and P.lines_of("<!-- open") == [] and P.lines_of("<p title=it's>don't<p>x'y") == [P.Line("don't", 1), P.Line("x'y", 1)]
    assert [x.text for x in P.lines_of("<article>" + "<b><p>deep" * 2000)] == ["deep"] * 2000


def page(*lines, frame="<p>Menu of the site<p>Sign up today"):
    return f"<body>{frame}" + "".join(f"<p>{x}" for x in lines) + "<p>All rights reserved</body>"


def test_main_texts(spark):
    rows = [
        (1, "http://h.example/a/1", page("one", "two")),
        (2, "http://h.example/a/2", page("three")),
        (3, "http://h.example/a/2b", page("three", "four", "nine", "ten")),
        (4, "http://other.example/a/1", page("five")),
        (5, "http://same.example/x", page("six", "seven")),
        (6, "http://same.example/y", page("six", "seven")),
        (7, None, None),
        (8, "http://h.example/a/3", "<nav>Menu</nav><article><p>eight<p>All rights reserved</article><p>out"),
        (8, "http://h.example/a/3", "<nav>Menu</nav><article><p>eight<p>All rights reserved</article><p>out"),
        (9, "not a url", ""),
    ]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, row int")
    got = sorted((r["page_id"], r["text"]) for r in P.main_texts(pages).collect())
    frame = "Menu of the site\n\nSign up today\n\n{}\n\nAll rights reserved"
    assert got == [
        (1, "one\n\ntwo"),
        (2, "three"),
        (3, "four\n\nnine\n\nten"),
        (4, frame.format("five")),
        (5, frame.format("six\n\nseven")),
        (6, frame.format("six\n\nseven")),
        (7, ""),
        (8, "eight\n\nAll rights reserved"),
        (8, "eight\n\nAll rights reserved"),
        (9, ""),
    ]
    assert P.main_texts(pages.limit(0)).count() == 0


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in P.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_unmarked_story_beside_a_marked_teaser_stays(spark):
    story = "<div>The harbour was closed for the whole of the winter, and no ship came in.</div><p>Why it happened</p><p>Nobody had asked for it.</p>"
    rows = [
        (1, "http://h.example/a", f"<p>Home<p>Contact</p>{story}<article class=card><p>Teaser</article><p>Imprint"),
        (2, "http://h.example/b", "<p>Home<p>Contact<p>Another story that nobody else has told so far.</p><main><h1>Heading</h1></main><p>It goes on after the heading of the page.<p>Imprint"),
        (3, "http://lone.example/b", "<article><p>one</article><div>A sentence between two marked parts.</div><article><p>two</article><p>Imprint"),
    ]
    assert texts_of(spark, rows) == {
        1: "The harbour was closed for the whole of the winter, and no ship came in.\n\nWhy it happened\n\nNobody had asked for it.\n\nTeaser",
        2: "Another story that nobody else has told so far.\n\nHeading\n\nIt goes on after the heading of the page.",
        3: "one\n\nA sentence between two marked parts.\n\ntwo",
    }


def test_large_template_goes_and_versions_of_a_page_stay(spark):
    frame = "".join(f"<p>Menu entry {k}" for k in range(16))
    own = {k: [f"Line {j} of page {k}" for j in range(4)] for k in range(4)}
    rows = [(k, f"http://h.example/{k}", page(*own[k], frame=frame)) for k in own]
    rows += [(10 + k, f"http://two.example/{k}", page(*own[k], frame=frame)) for k in (0, 1)]
    same = [f"Sentence {j}" for j in range(20)]
    rows += [(20, "http://v.example/a", page(*same, "x", frame=frame)), (21, "http://v.example/b", page(*same, "y", frame=frame)), (22, "http://v.example/c", page("z", frame=frame))]
    rows += [(30 + k, f"http://eq.example/{k}", page("six", "seven")) for k in range(3)]
    got = texts_of(spark, rows)
    assert all(got[k] == "\n\n".join(own[k]) for k in own) and all(got[10 + k] == "\n\n".join(own[k]) for k in (0, 1))
    assert got[20] == "\n\n".join([*same, "x"]) and got[21] == "\n\n".join([*same, "y"]) and got[22] == "z"
    assert all(got[30 + k] == "Menu of the site\n\nSign up today\n\nsix\n\nseven\n\nAll rights reserved" for k in range(3))


def article_lines(page):
    return [x.text for x in P.lines_of(page) if x.place == P.ARTICLE]


def kept_lines(page):
    return [x.text for x in P.lines_of(page) if x.place != P.ASIDE]


def test_names_that_only_mention_something_keep_their_text():
    for name in ("post no-comments", "content has-sidebar", "share-of-voters", "without-ads", "menu-of-the-day", "commentary", "with-related", "navigable adverse", "before-footer"):
        assert article_lines(f"<article class='{name}'><p>story</article>") == ["story"], name
        assert kept_lines(f"<div class='{name}'><p>story</div>") == ["story"], name
    for name in ("sidebar", "left-sidebar", "comments-area", "cookie-banner", "site_footer", "navBar", "related-posts", "ad", "ad-slot-2", "post share-buttons", "newsletter-signup", "skip-link", "menu"):
        assert kept_lines(f"<div class='{name}'><p>story</div>") == [], name
        assert kept_lines(f"<div id={name.split()[-1]}><p>story</div>") == [], name


def test_an_article_in_a_frame_is_an_article_and_a_teaser_is_not():
    for frame in ("banner-wrapper", "overlay", "navbar-page masthead"):
        page = f"<div class='{frame}'><p>frame<main><article><p>story<div class='related'><article><p>teaser</article></div></article></main></div>"
        assert article_lines(page) == ["story"], frame
    for teasers in ("related-posts", "sidebar", "widget promo"):
        assert article_lines(f"<div class='{teasers}'><article><p>teaser</article></div><article><p>story</article>") == ["story"], teasers
    assert article_lines("<nav><article><p>x</article></nav><aside><main><p>y</main></aside>") == []


def test_a_headline_before_the_article_is_text():
    texts = lambda page: P._entries(P.lines_of(page))[0]
    assert texts("<p>Home<p>News<h1>River news</h1><nav>m</nav><article><p>story</article><p>Back") == ["River news", "story"]
    assert texts("<h1>Site</h1><p>Home<p>News<article><p>story</article>") == ["story"]
    assert texts("<h1>River news</h1><h2>and more</h2><div class=share>s</div><article><h1>in</h1><p>story</article><h2>Next</h2>") == ["River news", "and more", "in\n\nstory"]


def test_unclosed_tags_take_linear_time():
    for piece in ("<a b ", "<a b='", "<!a ", "<a=\"x ", "</a ", "<aaa"):
        start = time.perf_counter()
        P.lines_of(piece * 100_000)
        assert time.perf_counter() - start < 3, piece
