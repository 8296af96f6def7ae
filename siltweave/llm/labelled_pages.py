"""A small labelled table of page blocks for the boilerplate classifier.

Pages are put together by rule from invented layouts. A text that belongs to the article begins
with ``MARK``; the mark is cut before features are taken, so that it only serves as the label.
"""

from __future__ import annotations

import random

MARK = "␟"
_SYL = ("ba", "do", "ki", "lu", "me", "no", "pa", "ru", "se", "ti", "vo", "za")
_HAN = "天地人水火木金土日月山川风云石田"


def _drawn(r: random.Random, among: str | tuple[str, ...], n: int) -> list[str]:
    """``n`` draws, as ``r.choice`` makes them, without its calls."""
    bits, size = r.getrandbits, len(among)
    width, out = size.bit_length(), []
    for _ in range(n):
        k = bits(width)
        while k >= size:
            k = bits(width)
        out.append(among[k])
    return out


def _word(r: random.Random) -> str:
    return "".join(_drawn(r, _SYL, r.randint(1, 3)))


def _words(r: random.Random, low: int, high: int, han: bool) -> str:
    n = r.randint(low, high)
    if han:
        return "".join(_drawn(r, _HAN, 2 * n)) + "。"
    return " ".join([_word(r) for _ in range(n)]).capitalize() + "."


def _links(r: random.Random, n: int, han: bool) -> str:
    return "<ul>" + "".join(f'<li><a href="/{_word(r)}">{_words(r, 1, 2, han)[:-1]}</a></li>' for _ in range(n)) + "</ul>"


def _article(r: random.Random, han: bool, para: str, promos: list[str], short: bool) -> str:
    """Headings, paragraphs, lists, quotes, code and a table, with promos put between them."""
    out = []

    def text(a: int, b: int) -> str:
        t = MARK + _words(r, a, b, han)
        for _ in range(r.randint(1, 3) if b > 4 and r.random() < 0.45 else 0):
            t += f' <a href="/{_word(r)}">{_words(r, 1, 2, han)[:-1]}</a> {_words(r, 1, 8, han)}'
        return t

    if r.random() < 0.8:
        out.append(f"<h1>{text(1, 4)}</h1>")
    for k in range(1 if short else r.randint(1, 5)):
        if r.random() < (0.4 if short else 0.9 if k else 0.6):
            out.append(f"<h{r.choice('23')}>{text(1, 4)}</h2>")
        for _ in range(1 if short else r.randint(1, 4)):
            out.append(para % text(4, r.choice((12, 40, 90)) if short else 12 if r.random() < 0.3 else 90))
        if short:
            continue
        kind = r.random()
        if kind < 0.35:
            items = [f"<li>{text(2, 14)}" + (f"<ul><li>{text(2, 8)}</li></ul>" if r.random() < 0.2 else "") + "</li>" for _ in range(r.randint(1, 6))]
            out.append(r.choice(("<ul>%s</ul>", "<ol>%s</ol>")) % "".join(items))
        elif kind < 0.45:
            rows = "".join(f"<tr><td>{_word(r)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5)))
            out.append(f"<table><tr><th>{_word(r)}</th><th>{_word(r)}</th></tr>{rows}</table>")
        elif kind < 0.55:
            code = f"<pre>{MARK}if {_word(r)}:\n  {_word(r)}({r.randint(1, 99)})</pre>"
            out.append(r.choice((code, f"<div>{code}</div>")))
        elif kind < 0.65:
            out.append(f"<blockquote>{text(4, 25)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{text(4, 25)}</p></blockquote>")
        elif kind < 0.85:
            links = "".join(f'<li><a href="/{_word(r)}">{MARK + _words(r, 1, 3, han)[:-1]}</a></li>' for _ in range(r.randint(3, 24)))
            out.append(f"<ul>{links}</ul>")
    for p in promos:
        if not short:
            out.insert(r.randint(1, len(out)), p)
        else:
            out.append(p)
    return "\n".join(out)


def _page(r: random.Random) -> str:
    han, plain = r.random() < 0.25, r.random() < 0.5  # plain: names that tell nothing
    name = lambda told: f'class="{_word(r)}{r.randint(1, 99)}"' if plain or not told else f'class="{told}"'
    w = lambda a, b: _words(r, a, b, han)
    buttons = "".join(f"<button>{w(1, 1)}</button>" for _ in range(r.randint(1, 3)))
    promos = [p for p, share in (
        (f"<div {name('newsletter')}><p>{w(4, 14)}</p><input type=\"email\"></div>", 0.25),
        (f"<div {name('share')}><p>{w(3, 10)}</p>{_links(r, r.randint(2, 4), han)}</div>", 0.2),
        (f"<div {name('share')}>" + " ".join(f'<a href="/s">{_word(r)}</a>' for _ in range(3)) + "</div>", 0.1),
        (f"<div {name('promo')}><p>{w(4, 20)}</p></div>", 0.2),
        (f"<div {name('ad-slot')}><p>{w(4, 14)} <a href=\"/x\">{w(1, 2)}</a></p></div>", 0.2),
        (f"<div {name('ad-slot')}><span>{w(1, 6)}</span></div>", 0.1),
        (f"<div {name('related')}><h3>{w(1, 4)}</h3>{_links(r, r.randint(3, 7), han)}</div>", 0.25),
        (f"<div {name('callout')}><b>{w(1, 3)}</b><p>{w(4, 16)}</p></div>", 0.15),
    ) if r.random() < share]
    para = r.choice(("<p>%s</p>", "<p>%s", f"<div {name('txt')}>%s</div>"))
    body = _article(r, han, para, promos, r.random() < 0.35)
    crumbs = f"<div {name('breadcrumbs')}><a href=\"/\">{w(1, 1)}</a> &raquo; <a href=\"/c\">{w(1, 2)}</a></div>" if r.random() < 0.4 else ""
    comment = lambda: f"<div {name('c')}><b>{_word(r)}{r.randint(1, 99)}</b><p>{w(3, 30)}</p></div>"
    comments = f"<div {name('comments')}><h3>{w(1, 2)} (3)</h3>{''.join(comment() for _ in range(r.randint(1, 4)))}</div>" if r.random() < 0.4 else ""
    extra = "".join(f"<p>{w(6, 24)}</p>" if r.random() < 0.5 else f"<p>{w(4, 14)} <a href=\"/x\">{w(1, 2)}</a></p>" for _ in range(r.randint(0, 2)))
    side = f"<h3>{w(1, 2)}</h3>{_links(r, r.randint(3, 7), han)}{extra}"
    nav = _links(r, r.randint(4, 9), han)
    foot = "".join(f"<p>{w(4, 16)}</p>" for _ in range(r.randint(1, 2))) + _links(r, r.randint(2, 5), han)
    consent = f"<div {name('cookie-banner')}><p>{w(6, 22)}</p>{buttons}</div>" if r.random() < 0.5 else ""
    layout = r.randrange(5)
    if layout == 0:
        page = f"<header><nav>{nav}</nav></header><main>{crumbs}<article>{body}</article>{comments}<aside>{side}</aside></main><footer>{foot}</footer>"
    elif layout == 1:
        page = f"<div {name('nav')}>{nav}</div><div {name('main')}>{crumbs}{body}</div><div {name('sidebar')}>{side}</div>{comments}<div {name('footer')}>{foot}</div>"
    elif layout == 2:
        page = f"<div {name('wrap')}><div {name('panel')}>{side}</div><div {name('body')}>{crumbs}<div {name('content')}>{body}</div>{comments}</div><div {name('menu')}>{nav}</div><div {name('foot')}>{foot}</div></div>"
    elif layout == 3:
        page = f"<table><tr><td>{nav}</td></tr></table><table><tr><td {name('l')}>{side}</td><td {name('m')}>{crumbs}{body}</td></tr></table>{comments}<center>{foot}</center>"
    else:
        page = f"<div {name('top')}>{nav}<div {name('post')}>{crumbs}{body}</div><div {name('side')}>{side}</div>{comments}</div><div {name('foot')}>{foot}</div>"
    page = consent + page if r.random() < 0.5 else page + consent
    return f"<html><head><title>{w(1, 3)}</title></head><body>{page}</body></html>"


def pages(n: int = 2000, seed: int = 5) -> list[str]:
    """The labelled pages; the same ones at every call."""
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]
