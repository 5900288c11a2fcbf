"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by their surroundings and by themselves and are mostly
positive, tags are negative; the weights are log-odds learnt from labelled pages. A linear scan finds the
contiguous region of the greatest sum, and its blocks are the article.

An element that a page sets apart (by its tag, class, id or role) may be a box that belongs to no article, even
in the middle of one. A logistic model over its tag, the parts of its names, its role, its paragraphs, its share of
links and its place, learnt from the same pages, tells; no name or tag decides alone. Such a box counts as a
single tag and is left out.

The labelled pages are made from a rule: layouts times filling times kinds of boilerplate, each with its
content marked. `fit` accepts others.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by role.
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
UNSEEN = frozenset("script style noscript template iframe textarea svg canvas object head title datalist noembed noframes xmp map audio video".split())
APART = frozenset("nav footer aside form header menu dialog button select fieldset address figure section table ul ol".split())
MAIN = frozenset("article main".split())
CONTENT_NAMES = frozenset("article content post entry story maincontent articlebody postbody entrycontent".split())
SELF_CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
SCOPES = frozenset("article main section div table ul ol dl body html td th blockquote aside nav footer header form".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
BARE = re.compile(r"[^\W\d_]+|\u00a9")


def tokens(page: str):
    """('text', text), ('open', name, attributes) and ('close', name) in order; comments and raw content go."""
    at, n, lower = 0, len(page), None
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], None
            return
        if page.startswith("<!--", start):
            if start > at:
                yield "text", page[at:start], None
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            if start > at:
                yield "text", page[at:start], None
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        tag = TAG.match(page, start)
        if not tag:  # a bare "<" is text; an unfinished tag at the end is not
            if start + 1 < n and (page[start + 1].isalpha() or page[start + 1] == "/") and page.find(">", start) < 0:
                if start > at:
                    yield "text", page[at:start], None
                return
            yield "text", page[at : start + 1], None
            at = start + 1
            continue
        if start > at:
            yield "text", page[at:start], None
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            yield "close", name, None
            continue
        yield "open", name, tag[3]
        if name in RAW and not tag[3].endswith("/"):
            lower = lower if lower is not None else page.lower()
            end = lower.find("</" + name, at) if len(lower) == n else page.find("</" + name, at)
            if end < 0:
                return
            at = end
        if tag[3].endswith("/") and name not in VOID:
            yield "close", name, None


def hidden(attributes: str) -> bool:
    """Whether a browser wouldn't show the element."""
    if not attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=\s|$|/)", ATTRIBUTE.sub("", attributes)))


def box_features(name: str, attributes: str, in_main: bool, words: int, linked: int, paragraphs: int) -> list[str]:
    """What tells a box from content: tag, name parts (l: the last of a name, f: those before), role, paragraphs, links."""
    found = ["t:" + name, "in" if in_main else "out", f"a:{0 if not linked else 1 if 3 * linked < words else 2}"]
    if paragraphs:
        found.append("p:1" if paragraphs == 1 else "p:2")
    for key, *values in ATTRIBUTE.findall(attributes or ""):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in NAME_PART.findall(word)]
                found += ["f:" + p for p in parts[:-1]] + ["l:" + p for p in parts[-1:]]
        elif key == "role":
            found.append("r:" + value.lower())
    return list(dict.fromkeys(found))


def content_name(attributes: str) -> bool:
    """Whether a class, id or itemprop names the content."""
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "itemprop"):
            if {w.lower() for w in NAME_PART.findall(next((v for v in values if v), ""))} & CONTENT_NAMES:
                return True
    return False


def _measured(stream: list) -> dict[int, tuple[int, int, int, int]]:
    """By place of a start tag: words, linked words and paragraphs inside of it, and the place of its end. One
    pass with running totals, so nesting costs nothing."""
    stack: list[tuple[str, int, int, int, int]] = []
    open_names: Counter = Counter()
    words = linked = paragraphs = 0
    out = {}
    for place, (kind, name, _) in enumerate([*stream, ("end", "", None)]):
        if kind == "text":
            n = len(name.split())
            words += n
            linked += n if open_names["a"] else 0
        elif kind == "open" and name not in VOID:
            paragraphs += name == "p"
            stack.append((name, place, words, linked, paragraphs))
            open_names[name] += 1
        elif kind == "end" or kind == "close" and open_names[name]:
            while stack:
                top, at, w, a, p = stack.pop()
                open_names[top] -= 1
                out[at] = (words - w, linked - a, paragraphs - p, place)
                if top == name and kind == "close":
                    break
    return out


def _primary(stream: list, sizes: dict) -> tuple[int, int]:
    """Place of the start tag of the main element, or else of the article with the most text, and of its end."""
    held = [(name == "main" and sizes[p][0] > 0, sizes[p][0], -p) for p, (kind, name, _) in enumerate(stream) if kind == "open" and name in MAIN]
    if not held:
        return -1, -1
    place = -max(held)[2]
    return place, sizes[place][3]


def sequence(page: str | None, judge=None) -> list[tuple[str, str]]:
    """The page as (feature, text): word runs as ('w:<context>', text), tags as ('t:<name>', ''), block ends as
    ('|', ''), and each box that isn't content as one ('x', ''). `judge` gets the features of an element that
    is set apart and its place; it tells whether it is such a box."""
    if not page:
        return []
    stream = list(tokens(page))
    sizes = _measured(stream)
    primary, primary_end = _primary(stream, sizes)
    stack: list[tuple[str, bool, bool]] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack each name is open
    blocks: list[int] = []  # and where what isn't inline
    scopes: list[int] = []  # and what inline end tags don't reach beyond
    out: list[tuple[str, str]] = []
    skip = main = near = links = headings = 0

    def close(least: int) -> None:
        """Take all entries from a place of the stack on off it."""
        nonlocal skip, main, near, links, headings
        while len(stack) > least:
            name, boiler, content = stack.pop()
            places[name].pop()
            if name not in INLINE:
                blocks.pop()
            if name in SCOPES:
                scopes.pop()
            skip -= boiler
            near -= content
            main -= name in MAIN
            links -= name == "a"
            headings -= name[0] == "h" and name[1:].isdigit()

    for place, (kind, value, attributes) in enumerate(stream):
        if kind == "text":
            if not skip:
                where = "m" if near else "o" if primary >= 0 else "-"
                out.append((f"w:{where}{'a' if links else '-'}{'h' if headings else '-'}{'p' if any(e[0] in ('p', 'li', 'td', 'blockquote', 'pre', 'dd') for e in stack[-3:]) else 'l' if len(value.split()) > LONG else '-'}", value))
            continue
        inline = value in INLINE
        if kind == "open":
            if value in VOID:
                if not skip:
                    out.append((" " if value == "br" else "t:" + ("m:" if near else "") + value, ""))
                continue
            while stack and value in SELF_CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            if not inline and blocks and stack[blocks[-1]][0] == "p" and value in SELF_CLOSED_BY["p"]:
                close(blocks[-1])  # an open <p> ends before a block even with inline elements open inside it
            around = place <= primary < sizes[place][3] and primary_end <= sizes[place][3]
            boiler = value in UNSEEN or hidden(attributes)
            if not boiler and not around and not skip and judge and value not in ("html", "body") and (value in APART or value in MAIN or attributes):
                boiler = judge(box_features(value, attributes, main > 0, *sizes[place][:3]), place)
            if not skip:
                if not inline or boiler:
                    out.append(("|", ""))
                out.append(("x" if boiler else "t:" + ("m:" if near else "") + value, "") if not (boiler and near) else ("t:m:x", ""))
            content = value in MAIN or not boiler and value not in ("html", "body") and bool(attributes) and content_name(attributes)
            places[value].append(len(stack))
            if not inline:
                blocks.append(len(stack))
            if value in SCOPES:
                scopes.append(len(stack))
            stack.append((value, boiler, content))
            skip, main, near = skip + boiler, main + (value in MAIN), near + content
            links, headings = links + (value == "a"), headings + (value[0] == "h" and value[1:].isdigit())
        else:
            if places[value] and not (inline and scopes and places[value][-1] < scopes[-1]):
                close(places[value][-1])
            if not skip and not inline:
                out.append(("|", ""))
    return out


LONG = 15  # words of a run outside of paragraphs that count as many
PLAIN_WORD = 0.2  # what a word adds in the second scan
START, END = "\x02", "\x03"


def _unmarked(text: str) -> str:
    return text.translate({2: None, 3: None})


def _mark(page: str, judge) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """A labelled page's sequence without marks, and by entry the words inside and outside of the content. A tag is
    inside if content comes before and after it: a region holds the boxes in its middle."""
    inside, seq, within, without = False, [], [], []
    for feature, text in sequence(page, judge):
        n_in = n_out = 0
        for piece in re.split(f"([{START}{END}])", text):
            if piece in (START, END):
                inside = piece == START
            elif inside:
                n_in += len(piece.split())
            else:
                n_out += len(piece.split())
        seq.append((feature, _unmarked(text)))
        within.append(n_in)
        without.append(n_out)
    within, without = np.array(within), np.array(without)
    before = np.cumsum(within)
    for i, (feature, _) in enumerate(seq):
        if feature[0] != "w":
            within[i] = 0 < before[i] < before[-1]
            without[i] = not within[i]
    return seq, within, without


def _boxes(page: str) -> list[tuple[list[str], bool]]:
    """(features, holds no content) of the elements of a labelled page that are set apart."""
    stream, inside, before = list(tokens(page)), False, [0]
    for kind, text, _ in stream:  # words of the content so far
        n = 0
        if kind == "text":
            for piece in re.split(f"([{START}{END}])", text):
                inside = piece == START if piece in (START, END) else inside
                n += len(piece.split()) if inside and piece not in (START, END) else 0
        before.append(before[-1] + n)
    sizes, found = _measured(stream), []
    sequence(page, lambda features, place: found.append((features, before[sizes[place][3]] == before[place])) or False)
    return found


#: By kind of box: names and tags under which pages have it, and what it says. Labels of the pages made below.
_KINDS = {
    "nav": ("nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar topnav skip pagination pager", "nav div ul", "Home News Sport Weather About us Contact Archive Next page Previous"),
    "head": ("header masthead topbar banner brand", "header div", "The Daily Site your news every day since 1990"),
    "foot": ("footer copyright colophon imprint bottom legal", "footer div", "© 2024 Example Ltd. All rights reserved. Privacy policy. Terms of use."),
    "side": ("sidebar aside rail widget widgets complementary", "aside div", "Most read this week Popular stories About the author Follow us"),
    "ad": ("ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored", "div aside", "Buy one now and save. Sponsored offer, shop today."),
    "notice": ("cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay", "div section dialog", "We use cookies on this site to improve your experience. Accept all cookies or manage settings in our privacy policy."),
    "form": ("newsletter subscribe subscription signup login form search searchbox share sharing social", "form div", "Subscribe to our newsletter. Enter your email address. Sign up. Log in. Share this."),
    "more": ("related recommended recommendations teaser teasers trending popular", "div section aside", "You may also like. Read more stories. Recommended for you."),
    "comments": ("comment comments commentlist disqus reply replies respond discussion", "section div ol", "Great article, thanks for sharing! I totally agree with this. Reply"),
}
_ROLES = {"nav": "navigation menu menubar toolbar", "head": "banner", "foot": "contentinfo", "side": "complementary", "notice": "dialog alert alertdialog", "form": "search form"}
_FRONT = "site page main top post article js c".split()
_PLAIN = "clearfix x2 a1 row left wide css-1a".split()
_HEADS = "analysis results data history chapter part section body text intro summary lead table figure report review details block row col container wrapper inner box x2 a1".split()


def labelled_pages() -> list[str]:
    """Labelled pages by rule, the same ones always; the content lies between \\x02 and \\x03."""
    rng = np.random.default_rng(19)
    pick = lambda values: values[int(rng.integers(len(values)))]
    prose = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat voluptua".split()
    prose += "the of and to in a is that for it as was with be by on not at are this have from or an we you all our use your i one can now after about more may also like day week read most page site here us out up no who new use improve experience manage example great article agree totally address author story stories follow since every enter save shop today offer next home news sport weather thanks".split()
    sentence = lambda n: " ".join(pick(prose) for _ in range(n)).capitalize() + "."
    names = {k: v[0].split() for k, v in _KINDS.items()}

    def boiler(kind: str) -> str:
        tag, says = pick(_KINDS[kind][1].split()), _KINDS[kind][2]
        part = pick(names[kind])
        name = pick([part, part, f"{pick(_FRONT)}-{part}", f"{part}-{pick(['list', 'container', 'wrapper', 'box', 'inner', 'bar', 'item', part])}", f"{part}_{pick(names[kind])}"])
        given = pick([f' class="{name}"', f' id="{name}"', f' class="{name} {pick(_PLAIN)}"', "" if tag not in ("div", "section", "ul", "ol") else f' class="{name}"'])
        if kind in _ROLES and rng.random() < 0.3:
            given = f' role="{pick(_ROLES[kind].split())}"'
        if rng.random() < 0.1:
            given = f' class="{pick(_PLAIN)}"'
        words = says.split()
        if rng.random() < 0.4:
            says = sentence(int(rng.integers(1, 30)))
        if kind in ("nav", "more"):
            body = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words) + "</ul>" if kind == "nav" or rng.random() < 0.5 else f"<p>{says}</p>" + "".join(f'<p><a href="/{i}">{sentence(5)}</a></p>' for i in range(3))
        elif kind == "comments":
            body = "".join(f"<p>{pick([says, sentence(9)])}</p>" for _ in range(int(rng.integers(1, 5))))
        else:
            body = pick([f"<p>{says}</p>", says, f"<span>{says}</span>", f"<h3>{' '.join(words[:3])}</h3><p>{says}</p>"])
        return f"<{tag}{given}>{body}</{tag}>"

    def content_box() -> str:
        """A part of the article that is set apart, now and then under a name that boilerplate has as well."""
        tag, part = pick(["div", "section", "table", "ul", "ol", "div", "header", "figure", "div", "blockquote"]), pick(_HEADS)
        name = f"{pick(names[pick(list(names))])}-{part}" if rng.random() < 0.4 else pick([part, f"{pick(_HEADS)}-{part}", pick(sorted(CONTENT_NAMES))])
        given = pick([f' class="{name}"', f' id="{name}"', f' class="{name} {pick(_PLAIN)}"', f' class="{pick(_FRONT)}-{part}"', f' class="{pick(_PLAIN)}"', ""])
        item = lambda: f"<li>{sentence(int(rng.integers(1, 12)))}</li>"
        inner = {"ol": lambda: "".join(item() for _ in range(int(rng.integers(1, 6)))), "table": lambda: "<tr>" + "".join(f"<td>{sentence(4)}</td>" for _ in range(4)) + "</tr>", "ul": lambda: "".join(item() for _ in range(int(rng.integers(1, 6)))), "header": lambda: f"<h1>{sentence(6)}</h1>", "figure": lambda: f"<figcaption>{sentence(7)}</figcaption>"}
        return f"<{tag}{given}>{inner.get(tag, lambda: ''.join(f'<p>{sentence(int(rng.integers(5, 40)))}</p>' for _ in range(int(rng.integers(1, 4)))))()}</{tag}>"

    frames = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div><div>{}</div></div>", '<article class="post">{}</article>', "<main><article>{}</article></main>", '<div id="story">{}</div>', "<section>{}</section>", '<div class="x2">{}</div>', "{}"]
    pages = []
    for n in range(360):
        style = rng.random() < 0.35  # without <p>
        parts = [f"<h1>{sentence(6)}</h1>"] if rng.random() < 0.7 else []
        for _ in range(int(rng.integers(1, 7))):
            plain = f"<p>{sentence(int(rng.integers(3, 40)))} " + (f'<a href="/z">{sentence(2)}</a> ' if rng.random() < 0.3 else "") + f"{sentence(int(rng.integers(3, 30)))}</p>"
            bare = f"<div>{sentence(int(rng.integers(8, 120)))}</div>"
            parts.append(content_box() if rng.random() < 0.25 else bare if style else plain)
        inner = list(names)
        if rng.random() < 0.4:  # boxes in the middle of an article
            parts.insert(int(rng.integers(1, len(parts) + 1)), END + boiler(pick(["ad", "form", "more", "notice", "ad"])) + START)
        if rng.random() < 0.2:
            parts.append(END + boiler("comments") + START)
        body = frames[n % len(frames)].format(START + "".join(parts) + END)
        pre = "".join(boiler(k) for k in rng.permutation(["nav", "head", "ad", "notice", "side"])[: int(rng.integers(0, 4))])
        post = "".join(boiler(k) for k in rng.permutation([k for k in inner if k != "head"])[: int(rng.integers(0, 5))])
        if rng.random() < 0.3:  # boxes without any name
            pre += f"<div>{_KINDS['notice'][2]}</div>"
            post += pick(["<div>{}</div>", "<p>{}</p>"]).format(_KINDS["foot"][2])
        pages.append(f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{pre}{body}{post}</body></html>")
    return pages


def _logistic(rows: list[tuple[list[str], bool]], penalty: float = 0.5) -> dict[str, float]:
    """Weights of features by penalised logistic regression, in Newton steps; 'l:?' and 'f:?' stand for other names."""
    counts = Counter(f for features, _ in rows for f in features)
    rare = lambda f: f[:2] + "?" if counts[f] < 3 and f[:2] in ("l:", "f:") else f
    known = {f: i for i, f in enumerate(sorted({rare(f) for features, _ in rows for f in features}), 1)}
    x = np.zeros((len(rows), len(known) + 1))
    x[:, 0] = 1
    for i, (features, _) in enumerate(rows):
        x[i, [known[rare(f)] for f in features]] = 1
    y = np.array([float(label) for _, label in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + penalty * np.eye(len(beta))
        beta -= np.clip(np.linalg.solve(h, x.T @ (p - y) + penalty * beta), -3, 3)
    return {"": float(beta[0])} | {f: float(beta[i]) for f, i in known.items()}


def _judge(weights: dict[str, float]):
    """Whether an element's features speak for a box, by the weights 'b:...'."""
    value = lambda f: weights.get("b:" + f, weights.get("b:" + f[:2] + "?", 0.0) if f[:2] in ("l:", "f:") else 0.0)
    return lambda features, _: weights["b:"] + sum(map(value, features)) > 0


def fit(pages: list[str] | None = None) -> dict[str, float]:
    """Weights by feature, all learnt from labelled pages: 'b:' of boxes; log-odds of lying inside the content of
    words by surroundings ('w:', bounded to -3..2), of tags ('t:', 'x', bounded to -2..-0.1), and of words by
    themselves ('v:', bounded to -2..0, those that content has too have none)."""
    pages = labelled_pages() if pages is None else pages
    weights = {"b:" + f: w for f, w in _logistic([row for page in pages for row in _boxes(page)]).items()}
    inside, outside, words_in, words_out = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        for (feature, text), i, o in zip(*_mark(page, _judge(weights)), strict=True):
            if feature not in ("|", " "):
                inside[feature] += i
                outside[feature] += o
            if feature[0] == "w":  # where one element's words are all inside or all outside
                (words_in if i else words_out).update(set(_bare(text)))
    odds = {f: float(np.log((inside[f] + 1) / (outside[f] + 1))) for f in {*inside, *outside}}
    weights |= {f: (min(2.0, max(-3.0, w)) if f[0] == "w" else min(-0.1, max(-2.0, w))) for f, w in odds.items()}
    most = max(words_out.values(), default=1)
    weights |= {"v:" + w: max(-2.0, -4.0 * n / most) for w, n in words_out.items() if n > 5 and not words_in[w]}
    # Surroundings that the labelled pages lack score like those that differ from them by one mark.
    for f in ["w:" + "".join(c) for c in itertools.product("mo-", "a-", "h-", "pl-")]:
        if f not in weights:
            near = [weights[g] for i in range(3, 6) for c in "ahpl-" if (g := f[:i] + c + f[i + 1 :]) in odds]
            weights[f] = float(np.mean(near)) if near else 0.0
    return weights


def _bare(text: str) -> list[str]:
    return BARE.findall(text.lower())


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """[start, end) of the contiguous entries of the greatest sum, in one pass; (0, 0) if none is positive."""
    best = total = 0.0
    start = first = end = 0
    for i, s in enumerate(scores.tolist()):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, start, end = total, first, i + 1
    return start, end


def score(feature: str, text: str, weights: dict[str, float]) -> float:
    """What an entry of the sequence adds to a region."""
    if feature in ("|", " "):
        return 0.0
    if feature[0] != "w":
        return weights.get(feature, -0.3)
    words = text.split()
    return weights.get(feature, 0.2) * len(words) + sum(weights.get("v:" + w, 0.0) for w in _bare(text)) if words else 0.0


def plain_score(feature: str, text: str, weights: dict[str, float]) -> float:
    """What an entry adds where a page's own layout has to do: words outside of links and beside no main element
    are as good as any, and tags cost nothing."""
    if feature[0] != "w":
        return 0.0
    words = text.split()
    each = PLAIN_WORD if feature[2] != "o" and feature[3] != "a" else -PLAIN_WORD
    return each * len(words) + sum(weights.get("v:" + w, 0.0) for w in _bare(text)) if words else 0.0


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region. On a page of short blocks alone no region is positive, or only headings are; there a
    second scan takes the words by themselves."""
    seq = sequence(page, _judge(weights))
    start, end = best_region(np.array([score(f, t, weights) for f, t in seq]))
    if not any(f[0] == "w" and f[4] != "h" and t.strip() for f, t in seq[start:end]):
        again = best_region(np.array([plain_score(f, t, weights) for f, t in seq]))
        start, end = again if again != (0, 0) else (start, end)
    blocks, now = [], []
    for feature, text in [*seq[start:end], ("|", "")]:
        if feature[0] == "w":
            now.append(text)
        elif feature == " ":
            now.append(" ")
        elif feature in ("|", "x", "t:m:x") and now:
            block = SPACE.sub(" ", html.unescape("".join(now))).strip()
            if block:
                blocks.append(block)
            now = []
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without a word, give an empty text. Repeated rows give repeated rows, an
    empty table an empty one, and other columns aren't looked at. A page is read whole, in one task."""
    weights = fit() if weights is None else weights
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
