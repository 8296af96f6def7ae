"""A small labelled table of document segments for the classifier of markup residue.

Documents in the three notations are put together by rule. The text of what is content begins with
``MARK``, which is cut before features are taken; everything else is residue: templates, frames of
tables and lists, rules, links that place a page, and the lines a site puts around its texts.
"""

from __future__ import annotations

import random

from siltweave.llm.labelled_lines import prose, site_lines

MARK = "\ue000"
_SYL = ("bar", "dol", "kin", "lum", "mek", "nor", "pas", "ruf", "sel", "tin", "vos", "zan")


def _name(r: random.Random) -> str:
    return "".join(r.choice(_SYL) for _ in range(r.randint(2, 3))).capitalize()


def _title(r: random.Random) -> str:
    return r.choice((_name(r), f"{_name(r)} {_name(r)}", r.choice(("History", "Uses", "Notes", "Location", "Verwendung", "Geschichte", "Bugs", "See also", "Trivia", "用途", "背景")), f"The {r.choice(('road', 'shield', 'mill'))} of {_name(r)}"))


def documents(n: int = 900, seed: int = 7) -> list[tuple[str, str, int]]:
    """(notation, text, half) of n documents; ``half`` tells which half of the labelled lines was used."""
    r = random.Random(seed)
    sentences, lines = prose(), site_lines()
    kinds = [r.choice(("content", "content", "wikitext", "html")) for _ in range(n)]
    return [(notation, _document(r, notation, sentences[k % 2 :: 2], lines[k % 2 :: 2]), k % 2) for k, notation in enumerate(kinds)]


def _document(r: random.Random, notation: str, sentences: list[str], lines: list[str]) -> str:
    wiki, html = notation == "wikitext", notation == "html"
    out: list[str] = []

    def link(text: str) -> str:
        if wiki:
            return r.choice((f"[[{text}]]", f"[[{_name(r)}|{text}]]", f"[https://{_name(r)}.example/1 {text}]"))
        return f'<a href="/{_name(r)}">{text}</a>' if html else f"[{text}](/w/{_name(r)}.md)"

    def paragraph(low: int = 1, high: int = 5) -> str:
        if r.random() < 0.2:  # a fragment
            return MARK + " ".join((r.choice(sentences).split() + [_name(r)])[: r.randint(1, 3)])
        t = " ".join(r.choice(sentences) for _ in range(r.randint(low, high)))
        if r.random() < 0.4:
            t = t.replace(" ", f" {link(_name(r))} ", r.randint(1, 2))
        if r.random() < 0.3:
            t = t.replace(" ", f" {_name(r)} {_name(r)} ", 2)
        if r.random() < 0.15:
            t = t.upper() if r.random() < 0.3 else t.rstrip(".。")
        return MARK + t

    def heading() -> str:
        t = MARK + _title(r)
        return f"<h2>{t}</h2>" if html else f"{'=' * (k := r.randint(1, 3))} {t} {'=' * k}" if wiki else f"{'#' * r.randint(1, 4)} {t}"

    def items(texts: list[str]) -> str:
        if html:
            return "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>"
        mark = r.choice("*#") if wiki else r.choice("-*+")
        return "\n".join(f"{mark} {t}" for t in texts)

    def site(t: str) -> str:
        if html:
            return f"<{(tag := r.choice(('p', 'div')))}>{t}</{tag}>"
        return r.choice((t, t, f"> {t}" if not wiki else t, f"*{t}*" if not wiki else f"''{t}''", f"  {t}  ", t.upper(), f"{t} |"))

    def around() -> None:
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            out.append(site(r.choice(lines)))
        if r.random() < 0.06:
            out.append(items([link(x) for x in r.sample(("Home", "About us", "Contact", "Login", "Register", "Search", "Privacy policy", "Startseite", "Impressum", "登录", "首页"), 4)]))

    around()
    if wiki and r.random() < 0.6:
        out.append("{{Infobox " + _name(r).lower() + "\n" + "\n".join(f"| {_name(r).lower()} = {r.choice((_name(r), str(r.randint(1, 999)), _name(r) + '.png', r.choice(sentences)))}" for _ in range(r.randint(1, 6))) + (f"\n* {r.choice(sentences)}" * r.randint(1, 3) if r.random() < 0.15 else "") + "\n}}")
    for _ in range(r.randint(1, 5)):
        if r.random() < 0.7:
            out.append(heading())
        for _ in range(r.randint(0, 3)):
            out.append(f"<p>{paragraph()}</p>" if html else paragraph())
        k = r.random()
        if k < 0.25:
            out.append(items([paragraph(1, 1) if r.random() < 0.7 else MARK + _name(r) for _ in range(r.randint(1, 5))]))
        elif k < 0.35:
            out.append(items([(MARK + link(f"{_name(r)} {_name(r)}")) if not wiki else link(MARK + _name(r)) for _ in range(r.randint(2, 6))]))
        elif k < 0.45:
            rows = [[_name(r), str(r.randint(1, 999))] for _ in range(r.randint(1, 5))]
            if html:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>")
            elif wiki:
                out.append('{| class="wikitable"\n! ' + MARK + "A !! B\n" + "\n".join(f"|-\n| {MARK}{a} || {b}" for a, b in rows) + "\n|}")
            else:
                out.append(f"| {MARK}A | B |\n| --- | --- |\n" + "\n".join(f"| {MARK}{a} | {b} |" for a, b in rows))
        elif k < 0.5:
            out.append(f"<pre>{_name(r)}</pre>" if html or wiki else f"```\n{_name(r)}\n```")
        elif k < 0.53 and not html:
            out.append(f"<math>{_name(r)}_{{1}}</math>" if wiki else f"$${_name(r)}_{{1}}$$")
        elif k < 0.6 and wiki:
            out.append(r.choice((f"[[Category:{_name(r)}]]", f"[[File:{_name(r)}.png|thumb|x]]", "__NOTOC__", "{{" + _name(r) + "}}", "----")))
        elif k < 0.6 and not html:
            out.append(r.choice(("---", "* * *", "- - -", "<ul>", "</ul>", "\\end{itemize}", "***", "</div>")))
        if r.random() < 0.25:
            around()
    around()
    if wiki and r.random() < 0.7:
        out.append(f"[[Category:{_name(r)}]]")
    return "\n".join(out) if html else "\n\n".join(out)
