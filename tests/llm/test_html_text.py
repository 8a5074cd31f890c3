import html
import math
import random
import re
import time

import pytest

from rosterlake.llm import html_text


def by_article(page):
    """What the generated pages hold between the tags of their article, by cutting at tags."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not body:
        return ""
    inner = re.sub(r"<[^>]*\Z", "", body[1])
    inner = re.sub(r"<br>", " ", inner)
    lines = re.split(r"</?(?:h1|p)>", inner)
    lines = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in lines]
    return "\n".join(x for x in lines if x)


def test_query_like_cutting_at_the_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html_text.op3_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == by_article(pages[r.page_id])
        assert r.n_chars == len(r.text)


P = "<p>" + "A sentence of the article that goes on for a while, with words. " * 3 + "</p>"
T = " ".join(("A sentence of the article that goes on for a while, with words. " * 3).split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<html><body></body></html>", ""),
        (f"<body><nav><a href=/>Home</a></nav><div id=content><h1>Title &amp; more</h1>{P}{P}</div><div class='sidebar'>{P}</div><div id=comments>{P}</div></body>", f"Title & more\n{T}\n{T}"),
        (f"<body><header><h2>Site</h2></header><article><header><h1>Head</h1></header>{P}<ul><li>one<li>two</ul><div class=\"comments\">{P}</div></article><footer>{P}</footer>", f"Head\n{T}\none\ntwo"),
        (f"<body><div class='cookie-notice'>We use cookies</div><main><h1>x</h1>{P}<form>{P}</form><pre>a\n  b</pre></main>", f"x\n{T}\na b"),
        (f"<body><div><ul>{'<li><a href=/x>Some link text here</a></li>' * 9}</ul></div><div>{P}{P}{P}</div></body>", f"{T}\n{T}\n{T}"),
        (f"<body><article>{P}<script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><table><tr><td>1<td>2<tr><td>3</table>&lt;b&gt; 5 < 6</article>", f"{T}\n1\n2\n3\n<b> 5 < 6"),
        (f"<article>{P}<p>cut of<b", f"{T}\ncut of"), (f"<article>{P}<p>x &am", f"{T}\nx &am"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_odd_pages():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert html_text.main_text(deep) == "x"
    assert html_text.main_text('<p class="a' * 2000) == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "old", "k"), (1, "<p>x", "old", "k"), (None, "<p>x", None, None)], "page_id long, html string, text string, Html2 string")
    got = html_text.extract(df).orderBy("page_id", "text").collect()
    assert [(r.page_id, r.text, r.Html2) for r in got] == [(None, "x", None), (1, "", "k"), (1, "x", "k")]
    assert html_text.extract(df.filter("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class='wrap has-sidebar'><article><h1>x</h1>{P}</article></div></body>", f"x\n{T}"),
        (f"<body><div id=content class='no-sidebar'>{P}{P}</div></body>", f"{T}\n{T}"),
        (f"<body><div class='post with-comments'>{P}{P}</div><div class='comments'>{P}</div></body>", f"{T}\n{T}"),
        (f"<body><div class='social'><main>{P}</main></div></body>", T), (f"<body><div class='legal'>{P}{P}</div><div class='related'>{P}</div></body>", f"{T}\n{T}"),
        (f"<body><div class='x hidden md:block'><article>{P}</article></div></body>", T), (f"<body><div data-x='a display:none'>{P}</div></body>", T),
        (f"<body><article>{P}</article><div class='comments'>{P}{P}{P}</div></body>", T), (f"<body><div hidden>{P}</div><div STYLE='display : none'>{P}</div><div aria-hidden=true>{P}</div><div>{P}{P}</div></body>", f"{T}\n{T}"),
        (f"<body><div class='widgets sidebar'><article class='teaser'>{P}</article></div><div class='content'>{P}{P}</div></body>", f"{T}\n{T}"),
    ],
)
def test_words_never_cost_the_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("name", ["legal-analysis", "tags", "share", "search", "copyright", "legal", "social", "has-sidebar", "with-comments", "article-header", "related-work", "login", "notice-period"])
def test_an_article_keeps_what_only_sounds_like_something_else(name):
    kept = f"<div class='{name}'><p>Of the {name} that belongs to the text.</p></div>"
    assert html_text.main_text(f"<body><article><h1>x</h1>{P}{kept}{P}</article></body>") == f"x\n{T}\nOf the {name} that belongs to the text.\n{T}"


@pytest.mark.parametrize("name", ["ad-slot", "comment-list", "site-footer", "nav-menu", "cookie-box", "sidebar_left", "comments", "newsletter-signup", "notice", "ads  wide"])
def test_an_article_loses_what_is_none_of_it(name):
    assert html_text.main_text(f"<body><article><h1>x</h1>{P}<div class='{name}'>{P}</div>{P}</article></body>") == f"x\n{T}\n{T}"


# Elements as (tag, children), texts as strings.
INLINE = ("a", "b")


def spell(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(spell, node[1]))}</{node[0]}>"


def below(node):
    return [x for c in node[1] if not isinstance(c, str) for x in (c, *below(c))]


def chars(node):
    return sum(len(" ".join(c.split())) if isinstance(c, str) else chars(c) for c in node[1])


def links(node):
    return chars(node) if node[0] == "a" else sum(links(c) for c in node[1] if not isinstance(c, str))


def density(node, body):
    """By the definition, from the node's own subtree alone."""
    c, lc, t, lt = chars(node), links(node), len(below(node)), sum(x[0] == "a" for x in below(node))
    if not c:
        return 0.0
    ratio = c / max(1, lc) * max(1, t) / max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + links(body) / max(1, chars(body)) * c + math.e)
    return c / max(1, t) * math.log(1 + ratio) / math.log(1 + base)


def brute_text(body):
    """The densest subtree and the siblings that reach the threshold, by recursion."""
    total = lambda n: sum(density(c, body) for c in n[1] if not isinstance(c, str))
    level, order = [body], []
    while level:
        order += level
        level = [c for n in level for c in n[1] if not isinstance(c, str)]
    up = {id(c): n for n in order for c in n[1] if not isinstance(c, str)}
    best = max(order, key=total)
    path = [best]
    while path[-1] is not body:
        path.append(up[id(path[-1])])
    least = min(density(n, body) for n in path)
    taken = {id(best)}
    for node in path[:-1]:
        for c in up[id(node)][1]:
            if not isinstance(c, str) and c is not node and chars(c) and 2 * links(c) <= chars(c) and (density(c, body) >= least or c[0] in ("h1", "h2", "h3")):
                taken.add(id(c))
    lines, held = [], []

    def flush():
        lines.append(" ".join("".join(held).split()))
        held.clear()

    def walk(node, inside):
        if isinstance(node, str):
            if inside:
                held.append(node)
            return
        inside = inside or id(node) in taken
        if node[0] not in INLINE or id(node) in taken:
            flush()
        for c in node[1]:
            walk(c, inside)
        if node[0] not in INLINE or id(node) in taken:
            flush()

    walk(body, id(body) in taken)
    flush()
    return "\n".join(x for x in lines if x)


def test_pages_without_an_article_like_brute_force():
    rng = random.Random(11)
    words = "the of river a stone under long morning was built by people who never saw it again".split()
    say = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))

    def grown(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.35:
            return ("p", [say(5, 60), *([("b", [say(1, 3)]), " ", say(1, 9)] if rng.random() < 0.4 else [])])
        if kind < 0.5:
            return ("ul", [("li", [("a", [say(1, 6)])]) for _ in range(rng.randint(1, 7))])
        if kind < 0.6:
            return (rng.choice(["h1", "h2", "h3"]), [say(1, 8)])
        return (rng.choice(["div", "section"]), [grown(depth + 1) for _ in range(rng.randint(1, 5))])

    seen = 0
    for _ in range(300):
        body = ("body", [grown(0) for _ in range(rng.randint(1, 6))])
        want = brute_text(body)
        assert html_text.main_text(f"<html>{spell(body)}</html>") == want
        seen += 0 < len(want) < chars(body) - 50
    assert seen > 50


def test_the_story_of_pages_without_an_article():
    rng = random.Random(12)
    for n in range(60):
        story = [" ".join(f"word{rng.randrange(99)}" for _ in range(rng.randint(25, 90))) + "." for _ in range(rng.randint(3, 12))]
        paragraphs = "".join(f"<p>{x}</p>" for x in story)
        menu = "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(rng.randint(3, 20)))
        inner = f"<div class='{rng.choice(['post', 'entry', 'story x', 'has-sidebar'])}'><h1>Head {n}</h1>{paragraphs}</div>"
        for _ in range(rng.randrange(4)):
            inner = f"<div>{inner}</div>"
        page = f"<html><head><title>t</title></head><body><div class=top><ul>{menu}</ul></div>{inner}<div class='bottom'><ul>{menu}</ul></div><footer>{paragraphs}</footer></body></html>"
        assert html_text.main_text(page) == "\n".join([f"Head {n}", *story])


def test_beside_an_article():
    other = P.replace("article", "story")
    promo = f"<div><p>{T} It costs little.</p></div>"
    page = f"<body>{promo}<article><h1>x</h1>{P}</article>{promo}<section>{other}</section><section><p>no</p><a href=/>more of these links</a> <a href=/>and these</a></section></body>"
    assert html_text.main_text(page) == f"x\n{T}\n{T.replace('article', 'story')}"


def test_an_article_among_dense_others():
    many = "".join(f"<div><p>{T} {i}</p></div>" for i in range(5))
    assert html_text.main_text(f"<body>{many}<article>{P}</article></body>") == T
    assert html_text.main_text(f"<body>{many}{many}<article>{P}</article></body>").count("\n") == 10  # less than a tenth of the text
    assert html_text.main_text(f"<body>{many}<main>{P}{P}</main></body>") == f"{T}\n{T}"
    long = "".join(f"<p>{T} {i}</p>" for i in range(40))
    assert html_text.main_text(f"<body><div>{long}</div><article>{P}</article></body>").startswith(f"{T} 0\n{T} 1\n")


def test_pages_of_a_million_characters():
    page = f"<body><div class=menu>{'<a href=/>x</a> ' * 20000}</div><article>{P * 4000}</article></body>"
    assert html_text.main_text(page) == "\n".join([T] * 4000)


C = "I do not agree with what is said here at all, and I say so. "


@pytest.mark.parametrize("head", ["<h2>What readers say</h2>", "<h4>9 voices</h4>", ""])
@pytest.mark.parametrize("tag", ["section id='talkback'", "section CLASS=voices", "div id=talkback"])
@pytest.mark.parametrize(("said", "at_once"), [(2, True), (4, True), (6, True), (9, True), (9, False), (14, False)])
def test_readers_never_come_out_with_the_only_article(head, tag, said, at_once):
    story = f"<article><h1>x</h1>{P}</article>"
    words = f"<p>{C * said}</p>" if at_once else f"<p>{C}</p>" * said
    talk = f"<{tag}>{head}{words}</{tag.split()[0]}>"
    assert html_text.main_text(f"<body>{story}{talk}</body>") == f"x\n{T}"
    assert html_text.main_text(f"<body><div>{story}</div><div class=more>{talk}</div></body>") == f"x\n{T}"


@pytest.mark.parametrize("tag", ["blockquote", "p", "q", "figure"])
@pytest.mark.parametrize("name", ["reply", "replies", "notice", "popup"])
def test_an_article_keeps_what_it_quotes(tag, name):
    page = f"<body><article><h1>x</h1>{P}<{tag} class='{name}'>They said so.</{tag}></article></body>"
    assert html_text.main_text(page) == f"x\n{T}\nThey said so."


def test_the_main_text_beside_a_card():
    card = f"<article><h3>Other</h3><p>{C * 3}</p></article>"
    assert html_text.main_text(f"<body><div><h1>x</h1>{P}{P}{P}</div><div>{card}</div></body>").startswith(f"x\n{T}\n{T}\n{T}")


@pytest.mark.parametrize("text", ["a<" * 500_000, "<p>x</p><" + "b" * 1_000_000, "<p>x</p>" + "<b" * 300_000, "<a " * 300_000, "<a b='" * 200_000, "</" * 500_000, "<A/b" * 200_000, "<!" * 500_000], ids=range(8))
def test_twice_the_odd_page_takes_twice_the_time(text):
    def seconds(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    assert min(seconds(text) for _ in range(2)) < 4 * min(seconds(text[: len(text) // 2]) for _ in range(2)) + 0.3
