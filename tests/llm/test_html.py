"""Main text of hand-made pages with known answers."""

import random
import time
from collections import Counter

import pytest

from netlens.llm import html_text
from netlens.llm.html_text import main_text

ARTICLE = "<article><h1>A title</h1><p>First, with <b>bold</b> and a <a href=x>link</a>,\n  done.</p><p>Second &amp; last: caf&eacute; &lt;b&gt;</p></article>"
WANT = "A title\nFirst, with bold and a link, done.\nSecond & last: café <b>"


@pytest.mark.parametrize(
    "page",
    [
        ARTICLE,
        f"<html><head><title>x</title><style>p {{}}</style></head><body><nav><a href=/>Home</a></nav>{ARTICLE}<footer>(c), a, b, c</footer></body></html>",
        f"<body><header>Site, name</header>{ARTICLE}<aside><p>Other, things, to, read, in, the, side, bar</p></aside>",
        f"<body><div class='cookie-notice'>We, use, cookies, a, lot</div>{ARTICLE}<section id='comments'><p>Nice, very, nice, so, nice, indeed, really</p></section>",
        f"<body>{ARTICLE}<form><p>Your, name, please, and, mail</p><input></form><script>var t = '</p><p>no';</script>",
        f"<body><div class=ad>Buy, now, cheap, here</div><div id=main>{ARTICLE}</div><!-- <p>gone</p> -->",
        ARTICLE.replace("</p>", ""),
        ARTICLE.replace("<p>Second", "<br><p>Second"),
    ],
)
def test_article_alone(page):
    assert main_text(page) == WANT


def test_best_container_by_points():
    links = "".join(f"<li><a href=/{i}>Some, linked, words, here</a></li>" for i in range(30))
    text = "<div><div class=list><ul>" + links + "</ul></div><div class=body>" + "<p>Plain prose, of some length, with commas.</p>" * 3 + "</div></div>"
    assert main_text(text) == "\n".join(["Plain prose, of some length, with commas."] * 3)


def test_siblings_that_score_stay():
    part = "<p>" + "Prose, of some length, with commas, goes on. " * 3 + "</p>"
    page = f"<body><div id=a>{part * 3}</div><div id=b>{part * 2}</div><div><a href=x>only, a, link, list</a></div></body>"
    assert main_text(page).count("\n") == 4 and "only" not in main_text(page)


def test_nothing_is_capped():
    page = "<article>" + "".join(f"<p>Sentence number {i}, which stays.</p>" for i in range(3_000)) + "</article>"
    assert main_text(page).count("\n") == 2_999


@pytest.mark.parametrize(
    "page",
    [
        "<body>" + ARTICLE.replace("<article>", "<article class='post comments-open'>"),
        f"<body><div class='layout has-sidebar'>{ARTICLE}<div class=sidebar>Other, things</div></div>",
        f"<body><div id=page class='no-header share'><main class='nav widget'>{ARTICLE}</main></div>",
        f"<body><p><a href=/>Site, of words</a></p><section class=widget>{ARTICLE.replace('article>', 'div>')}</section>",
        f"<body><div class=ad>Buy, {'cheap, ' * 60}</div>{ARTICLE}",
        f"<body>{ARTICLE}<section id=comments>" + "<article class=comment><p>Nice, very, nice, so, nice, indeed</p></article>" * 5 + "</section>",
        f"<body><div class=layout-sidebar>{ARTICLE.replace('</article>', '')}<div class=comments><p>{'Nice, ' * 50}</p></div></article></div>",
        "<body>" + ARTICLE.replace("<article>", "<article class='post comments'>").replace("</article>", "<p class=share>Tell, a, friend</p></article>"),
    ],
)
def test_words_of_class_never_drop_the_article(page):
    assert main_text(page) == WANT


def test_words_of_class_do_not_empty_a_page():
    assert main_text("<div class=widget>One part.</div><div class=share>Two part.</div>") != ""


LONG = "<p>" + "A long part, of many words, goes on. " * 9 + "</p>"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_short_parts_of_an_article_stay(tag):
    short = "<section><p>Two short sentences. Here.</p></section><h3>Heading</h3><p>Short closing line.</p>"
    page = f"<body><div class=top><a href=/>Home</a></div><{tag}><section>{LONG * 4}</section>{short}<ul><li><a href=x>Tag</a></li></ul></{tag}><div><a href=y>Next</a></div>"
    assert main_text(page).split("\n")[4:] == ["Two short sentences. Here.", "Heading", "Short closing line."]


def test_heading_levels_and_short_paragraphs_beside_the_best():
    page = f"<body><div class=top>Site name</div><div id=content><h4>Above</h4><div>{LONG * 8}</div><h3>Heading</h3><p>Closing line.</p></div>"
    assert [x for x in main_text(page).split("\n") if not x.startswith("A long")] == ["Above", "Heading", "Closing line."]


COMMENT = "<p>Nice, very, nice, so, nice, indeed, " + "and, so, on, " * 20 + "</p>"
BODY = "<p>First part, of the post.</p><p>Second part, of it.</p><p>Third part.</p>"
BODY_TEXT = "First part, of the post.\nSecond part, of it.\nThird part."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm><input type=hidden><div>{BODY}</div><label>Name</label><button>Go</button></form>",
        f"<body><form><div class=top><a href=/>Home</a></div><div class=body>{BODY}</div><select><option>x</select></form></body>",
        f"<body><header>Site</header><div class=post>{BODY}</div><div class=comments>{COMMENT * 5}</div>",
        f"<body><div class=post>{BODY}</div><div id=disqus_thread>{COMMENT * 5}</div><aside>{COMMENT}</aside>",
        f"<body><div>{BODY}</div><form><p>Subscribe, now, please, at once</p><input><button>Go</button></form>",
        f"<body><div>{BODY}</div><aside><p>Other, things</p><p>To, read</p><p>There</p></aside>",
    ],
)
def test_forms_around_a_page_and_comments_beside_it(page):
    assert main_text(page) == BODY_TEXT


def test_a_page_of_a_form_alone_has_no_text():
    assert main_text("<body><form><p>Log in, please</p><input><button>Go</button></form>") == ""


@pytest.mark.parametrize("page", ["<div>te,xt" * 20_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<blockquote>x" * 20_000, "<span>" * 20_000 + "<div>x</div>" * 20_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    assert main_text(page)
    assert time.process_time() - start < 2


def slow_text(page: str) -> str:
    """The scoring by its definition, climbing from every block, for pages without marked elements."""
    tree = html_text.Tree()
    tree.feed(page)
    tree.close()
    blocks = html_text._blocks(tree.root)

    def up(n):
        out = [n]
        while out[-1].parent is not None:
            out.append(out[-1].parent)
        return out

    def block_up(n):
        return next(a for a in up(n)[1:] if a.tag in html_text.BLOCK or a is tree.root)

    points, every, links, plain = {}, Counter(), Counter(), Counter()
    for owner, text, linked in blocks:
        score = 1 + text.count(",") + min(len(text) / 100, 3)
        for n in up(owner):
            every[n] += len(text)
            links[n] += linked
            plain[n] += score * (1 - min(1, linked / len(text)))
        box = owner
        while box.tag in html_text.PARAGRAPH:
            box = block_up(box)
        points[box] = points.get(box, 0) + score
        if box is not tree.root:
            points[block_up(box)] = points.get(block_up(box), 0) + score / 2
    if not blocks:
        return ""
    score_of = {n: p * (1 - min(1, links[n] / max(1, every[n]))) for n, p in points.items()}
    best = max(score_of, key=score_of.get)
    outer = [[n for n in up(best) if n.tag == tag] for tag in ("article", "main")]
    article = next((found[-1] for found in outer if found), None)
    holds = (n for n in up(best) if n.tag in html_text.BLOCK and n.tag not in html_text.PARTS and plain[n] >= 0.9 * plain[tree.root])
    whole = article or next(holds, tree.root)
    kept = {best}
    for n in whole.parent.children if whole.parent is not None else ():
        if n is whole or isinstance(n, str) or not every[n]:
            continue
        few = links[n] / every[n] < 0.25
        heading = n.tag in (("h1", "h2") if article else html_text.HEADINGS)
        prose = n.tag in html_text.PARAGRAPH and few and (every[n] > 80 or not article)
        if heading or prose or score_of.get(n, 0) >= max(10, 0.2 * score_of[best]):
            kept.add(n)
    out = []
    for owner, text, linked in blocks:
        little = owner.tag in html_text.HEADINGS or 2 * linked < len(text)
        if any(n in kept or (little and n is whole) for n in up(owner)):
            out.append(text)
    return "\n".join(out)


def test_scoring_against_its_definition():
    rng = random.Random(8)
    tags = ["div", "p", "section", "article", "main", "blockquote", "ul", "li", "h2", "h4", "a href=x", "b", "td", "span"]

    def part(depth: int) -> str:
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["", "Words, of, prose, here. " * rng.randrange(8), "word", "a, b "])
        tag = rng.choice(tags)
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randrange(5))) + (f"</{tag.split()[0]}>" if rng.random() < 0.9 else "")

    for _ in range(1_500):
        page = "".join(part(5) for _ in range(4))
        assert main_text(page) == slow_text(page), page
