"""Main text: nothing that the contract excludes, whatever its share, and a brute-force tree scorer."""

from __future__ import annotations

import random

import pytest

from wattframe.llm import extract

SENTENCES = [f"Sentence {i} of the article, with a clause, goes on until it ends." for i in range(10)]
ARTICLE = "".join(f"<p>{x}</p>" for x in SENTENCES)
SAID = "".join(f"<p>Reader {i} says, at length, that this is so, and that is not, and more, and more, and more.</p>" for i in range(60))
TEXT = "\n\n".join(SENTENCES)

JUNK = {
    "comments": f"<div class='comments'>{SAID}</div>",
    "comments section": f"<section id=comments><ol class=comment-list><li><article class=comment-body>{SAID}</article></ol></section>",
    "one word": f"<div id=commentSection>{SAID}</div>",
    "related": f"<div class='related-posts'>{SAID}</div>",
    "newsletter": f"<div class='newsletter'>{SAID}</div>",
    "advert": f"<div class='advert'>{SAID}</div>",
    "notice": f"<div class='notice'>{SAID}</div>",
    "form": f"<form>{SAID}<input></form>",
    "nav": f"<nav>{SAID}</nav>",
    "menu": f"<ul class='menu'><li>{SAID}</ul>",
    "footer": f"<footer>{SAID}</footer>",
    "aside": f"<aside>{SAID}</aside>",
    "widget": f"<div class='widget widget-text'>{SAID}</div>",
    "script": f"<script>{SAID}</script>",
    "style": f"<style>{SAID}</style>",
}


@pytest.mark.parametrize("junk", JUNK.values(), ids=JUNK.keys())
@pytest.mark.parametrize(
    "page",
    [
        "<body><div id=content>{a}</div>{j}</body>",
        "<body>{j}<div id=content>{a}</div></body>",
        "<body><article>{a}{j}</article></body>",
        "<body><article>{j}{a}</article></body>",
        "<body><main><div><div>{a}</div></div>{j}</main></body>",
        "<body><div class=page>{a}{j}</div></body>",
    ],
)
def test_what_is_not_the_article_goes_whatever_its_share(page, junk):
    assert extract.main_text(page.format(a=ARTICLE, j=junk)) == TEXT


def test_equal_siblings_stay_however_deep():
    three = [f"<p>{x}</p>" for x in SENTENCES[:3]]
    page = f"<body><div><div id=a>{''.join(three)}</div><div id=b><div><div><div>{''.join(three)}</div></div></div></div></div>"
    assert extract.main_text(page) == "\n\n".join(SENTENCES[:3] * 2)


def test_title_of_an_article_beside_its_body():
    page = f"<article><header><h1>Title</h1></header><div class=body><div>{ARTICLE}</div></div><footer>By</footer></article>"
    assert extract.main_text(page) == f"Title\n\n{TEXT}"


def test_wrappers_give_way_only_where_nothing_else_is_left():
    assert extract.main_text(f"<form id=aspnetForm><div>{ARTICLE}</div><div class=comments>{SAID}</div></form>") == TEXT
    assert extract.main_text(f"<div class=widget><p>{SENTENCES[0]}</div><div class=comments>{SAID}</div>") == SENTENCES[0]
    assert extract.main_text(f"<div class=sidebar><form>{ARTICLE}</form></div>") == TEXT
    assert extract.main_text(f"<nav>{SAID}</nav><footer>{SAID}</footer><div class=comments>{SAID}</div>") == ""
    page = f"<div class=widget><article><p>Teaser, short.</article></div><article>{ARTICLE}</article>"
    assert extract.main_text(page) == TEXT


# --- brute force -------------------------------------------------------------------

MARKS = {
    "nav": "<nav>", "footer": "<footer>", "aside": "<aside>", "form": "<form>",
    ".comments": "comments", ".advert": "advert", ".sidebar": "sidebar", ".widget": "widget", ".related": "related",
}


class El:
    """An element: a tag, perhaps a class, and children that are elements or (text, linked) runs."""

    def __init__(self, tag, name, children):
        self.tag, self.name, self.children, self.up = tag, name, children, None
        for c in children:
            if isinstance(c, El):
                c.up = self

    @property
    def mark(self):
        return MARKS.get(self.tag) or MARKS.get(f".{self.name}", "")

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, El):
                yield from c.walk()

    def ups(self):
        return [self.up, *self.up.ups()] if self.up else []

    def html(self):
        inner = "".join(c.html() if isinstance(c, El) else (f"{c[0]}<a href=x>{c[1]}</a>" if c[1] else c[0]) for c in self.children)
        return f"<{self.tag}{f' class={self.name}' if self.name else ''}>{inner}</{self.tag}>"


def said(draw):
    words = lambda n: " ".join(draw.choice(["word", "longer-word", "so,", "and", "then."]) for _ in range(n))
    return (words(draw.randint(1, 40)), (" " + words(draw.randint(1, 20))) if draw.random() < 0.2 else "")


def grown(draw, depth):
    tag = draw.choice(["div", "div", "section", "article", "main", "aside", "form", "nav", "footer", "ul"])
    name = draw.choice(["", "", "", "", "comments", "advert", "sidebar", "widget", "related", "content"]) if tag == "div" else ""
    children = []
    for _ in range(draw.randint(0, 4)):
        kind = draw.random()
        if tag == "ul":
            children.append(El("li", "", [said(draw)]))
        elif kind < 0.45 or depth == 0:
            children.append(El(draw.choice(["p", "p", "p", "h2"]), "", [said(draw)]))
        elif kind < 0.55 and not (children and not isinstance(children[-1], El)):
            children.append(said(draw))
        else:
            children.append(grown(draw, depth - 1))
    return El(tag, name, children)


def brute(body):
    def blocks(e):
        for c in e.children:
            if isinstance(c, El):
                yield from blocks(c)
            else:
                yield e, " ".join((c[0] + c[1]).split()), len(c[1])

    listed = list(blocks(body))
    given = lambda b: 1 + b[1].count(",") + min(len(b[1]) / 100, 3)
    real = lambda b: b[0].tag != "h2" and min(b[2], len(b[1])) < len(b[1])
    articles = [e for e in body.walk() if e.tag in ("article", "main")]
    marked_above = {id(a): [u for u in a.ups() if u.mark] for a in articles}
    around = set()
    if articles and all(marked_above.values()):
        for a in articles:
            if all(u.mark in extract.WRAPPERS for u in marked_above[id(a)]):
                around |= {id(u) for u in marked_above[id(a)]}
    marks = lambda b: {u.mark for u in [b[0], *b[0].ups()] if u.mark and id(u) not in around}
    free = set()
    for tier in (extract.WRAPPERS, extract.WRAPPERS | extract.BOXES):
        while not any(real(b) and marks(b) <= free for b in listed):
            open_ = sorted(set(tier) - free)
            hides = [(sum(given(b) * (1 - b[2] / len(b[1])) for b in listed if real(b) and marks(b) - free == {m}), m) for m in open_]
            most = max((h for h, _ in hides), default=0)
            if most:
                free.add(next(m for h, m in hides if h == most))
                continue
            nested = [m for b in listed for m in sorted(marks(b) & set(open_)) if marks(b) - free <= set(open_)]
            if not nested:
                break
            free.add(nested[0])
    left = [b for b in listed if marks(b) <= free]
    giving = [b for b in left if real(b)] or left

    def worth(e):
        total = 0.0
        for b in giving:
            base = b[0].up if b[0].tag in ("p", "li", "h2") else b[0]
            line = [base, *base.ups()]
            if e in line:
                total += given(b) * (1 - b[2] / len(b[1])) / [1, 2, 3, 6, 9, 12][min(line.index(e), 5)]
        under = [b for b in left if e is b[0] or e in b[0].ups()]
        return total * (1 - sum(b[2] for b in under) / max(sum(len(b[1]) for b in under), 1))

    every = list(body.walk())
    worths = {id(e): worth(e) for e in every}
    top = max(every, key=lambda e: worths[id(e)])
    return left, worths, top


def chosen(left, worths, top):
    if not worths[id(top)]:
        return ""
    roots, at = {id(top)}, top
    inside = any(u.tag == "article" for u in top.ups())
    while at.up and at.tag not in ("article", "body", "main"):
        for near in (c for c in at.up.children if isinstance(c, El)):
            own = [b for b in left if near is b[0] or near in b[0].ups()]
            text, linked = sum(len(b[1]) for b in own), sum(b[2] for b in own)
            if max(worths[id(e)] for e in near.walk()) >= 0.2 * worths[id(top)]:
                roots.add(id(near))
            elif near.tag in ("p", "h2") and text and linked < 0.25 * text:
                roots.add(id(near))
        at = at.up
        if not inside:
            break
    return "\n\n".join(b[1] for b in left if {id(b[0]), *map(id, b[0].ups())} & roots)


def test_every_generated_page_is_scored_as_by_brute_force():
    draw, seen, texts = random.Random(11), 0, 0
    while seen < 400:
        body = El("body", "", [grown(draw, 3) for _ in range(draw.randint(1, 4))])
        left, worths, top = brute(body)
        ranked = sorted(worths.values(), reverse=True)
        if len(ranked) > 1 and ranked[0] and ranked[0] - ranked[1] < 1e-9:
            continue  # a tie: either is the best
        seen += 1
        want = chosen(left, worths, top)
        texts += bool(want)
        assert extract.main_text(f"<html>{body.html()}</html>") == want, body.html()
    assert texts > 200
