"""HTML to Markdown, with pruning of the element tree by density.

Elements are numbered in the order in which they open, so an element's descendants follow it and sums over subtrees are
one pass backwards; what goes with an element that goes is one pass forwards.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.config import Site

# Elements that never hold content.
EXCLUDED_TAGS = ("nav", "header", "footer", "form")
_SILENT = frozenset(("script", "style", "noscript", "template", "head", "svg"))
_BLOCKS = frozenset("p div section article main aside ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 figure body html".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


@dataclass(frozen=True)
class Profile:
    """What is taken over: ``cleanup`` off gives everything but scripts and styles, for a second attempt.

    With cleanup an element goes, with all that is in it, if its score (see ``scores``) is below ``keep_score``.
    ``css_selector`` and ``target_elements`` keep what lies in a matching element (in one of each, if both are given).
    Selectors are lists of compounds of tag, ``.class``, ``#id`` and ``[name]`` or ``[name=value]``, with blanks for
    descent; where nothing matches, nothing is kept.  ``body_width`` breaks lines of running text (0: none), and with
    ``protect_links`` never inside a link.  Without ``unicode_snob`` signs with a plain form are written in ASCII.
    """

    cleanup: bool = True
    excluded: tuple[str, ...] = EXCLUDED_TAGS
    excluded_classes: tuple[str, ...] = ("ad", "ads", "advert", "cookie", "banner")
    word_count_threshold: int = 20
    keep_score: float = 0.45
    ignore_links: bool = False
    ignore_images: bool = False
    ignore_tables: bool = False
    css_selector: str | None = None
    target_elements: tuple[str, ...] = ()
    remove_consent_popups: bool = False
    remove_overlay_elements: bool = False
    body_width: int = 0
    protect_links: bool = True
    unicode_snob: bool = True

    @classmethod
    def of(cls, site: Site, cleanup: bool = True) -> Profile:
        """The profile that a site's settings ask for; the second attempt has no cleanup."""
        m = site.markdown
        return cls(
            cleanup=cleanup, word_count_threshold=site.word_count_threshold, css_selector=site.css_selector, target_elements=tuple(site.target_elements),
            remove_consent_popups=site.remove_consent_popups, remove_overlay_elements=site.remove_overlay_elements,
            ignore_links=m.ignore_links, ignore_images=m.ignore_images, ignore_tables=m.ignore_tables, body_width=m.body_width, protect_links=m.protect_links, unicode_snob=m.unicode_snob,
        )


_COMPOUND = re.compile(r"""(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+(?:=(?:"[^"]*"|'[^']*'|[^\]"']*))?\])*)""")
_CONDITION = re.compile(r"""([.#])([\w-]+)|\[([\w-]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\]"']*)))?\]""")


def _condition(m: re.Match):
    if m[1]:
        return m[1], m[2]
    return m[3].lower(), next((v for v in m.groups()[3:] if v is not None), None)


def selectors(text: str) -> list[list[tuple[str, list]]]:
    """A selector list as chains of (tag, conditions), outermost first."""
    chains = []
    for one in text.split(","):
        parts = [_COMPOUND.fullmatch(p) for p in one.split()]
        if not parts or not all(p and p[0] for p in parts):
            raise ValueError(f"selector: {one.strip() or text!r}")
        chains.append([((p[1] or "*").lower(), [_condition(m) for m in _CONDITION.finditer(p[2])]) for p in parts])
    return chains


def _fits(compound: tuple[str, list], tag: str, attrs: dict) -> bool:
    name, conditions = compound
    if name not in ("*", tag):
        return False
    for kind, value in conditions:
        if kind == ".":
            ok = value in (attrs.get("class") or "").split()
        elif kind == "#":
            ok = attrs.get("id") == value
        else:
            ok = kind in attrs and (value is None or attrs[kind] == value)
        if not ok:
            return False
    return True


def _matches(chains: list, path: list[tuple[str, dict]]) -> bool:
    """Whether the last element of a path from the root fits one of the chains."""
    for chain in chains:
        if not _fits(chain[-1], *path[-1]):
            continue
        rest = chain[:-1]
        for element in reversed(path[:-1]):
            if rest and _fits(rest[-1], *element):
                rest = rest[:-1]
        if not rest:
            return True
    return False


_CONSENT = re.compile(r"cookie|consent|gdpr", re.I)
_OVERLAY = re.compile(r"(?:^|[\s_-])(?:overlay|modal|popup|lightbox)(?:$|[\s_-])", re.I)


# How much an element's tag speaks for content; others than these aren't judged by themselves.
_TAG_WEIGHT = {"article": 1.0, "main": 1.0, "p": 1.0, "blockquote": 1.0, "pre": 1.0, "section": 0.75, "table": 0.75, "figure": 0.75, "div": 0.5, "ul": 0.5, "ol": 0.5, "li": 0.5, "tr": 0.75, "aside": 0.0}
_BESIDE = re.compile(r"(?:^|[\s_-])(?:nav|menu|sidebar|breadcrumbs?|share|social|related|promo|sponsor|comments?|footer|toolbar|pagination|newsletter|teaser)(?:$|[\s_-])", re.I)


def subtree_sums(parents: list[int], own: list[list[int]]) -> list[list[int]]:
    """For each element the sums of its own values and those of all its descendants; a parent (-1: none) has a smaller number."""
    out = [list(x) for x in own]
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            above = out[parents[i]]
            for k, v in enumerate(out[i]):
                above[k] += v
    return out


def score(weight: float, beside: bool, text: int, linked: int, markup: int, words: int, threshold: int) -> float:
    """From 0 to 1, how much an element is content.

    Four tenths are the share of text in text and markup, three the share of text that isn't in links, two the tag's
    weight and one its words against the threshold (whole from there on); a name that tells of navigation costs three.
    """
    density = text / (text + markup) if text else 0.0
    free = 1 - linked / text if text else 0.0
    return 0.4 * density + 0.3 * free + 0.2 * weight + 0.1 * (min(1.0, words / threshold) if threshold else 1.0) - 0.3 * beside


def pruned(elements: list[tuple[int, str, bool]], own: list[list[int]], threshold: int, keep: float) -> list[bool]:
    """Which elements (parent, tag, beside; own characters of text, in links, and of markup, and words) go, by their own score or with one above them.

    What holds an element of ``threshold`` words or more that is kept by its own score stays for its sake, however many
    links are beside that one; a name that tells of navigation is no such holder.
    """
    sums = subtree_sums([e[0] for e in elements], own)
    low, holds = [False] * len(elements), [False] * len(elements)
    for i in range(len(elements) - 1, -1, -1):
        parent, tag, beside = elements[i]
        text, linked, markup, words = sums[i]
        judged = tag in _TAG_WEIGHT and text > 0
        low[i] = judged and score(_TAG_WEIGHT[tag], beside, text, linked, markup, words, threshold) < keep
        holds[i] = not beside and (holds[i] or judged and not low[i] and words >= max(1, threshold))
        if parent >= 0:
            holds[parent] = holds[parent] or holds[i]
    gone: list[bool] = []
    for i, (parent, _, _) in enumerate(elements):
        gone.append(parent >= 0 and gone[parent] or low[i] and not holds[i])
    return gone


class _Reader(HTMLParser):
    def __init__(self, profile: Profile):
        super().__init__(convert_charrefs=True)
        self.p, self.stack, self.silent = profile, [], 0
        self.blocks: list[tuple[str, str, int]] = []  # kind, text, element (-1: outside all)
        self.kind, self.parts, self.link, self.lists, self.title = "p", [], None, [], []
        self.elements: list[tuple[int, str, bool]] = []  # parent, tag, whether its name tells of navigation
        self.own: list[list[int]] = []  # characters of text, in links, and of markup, and words
        self.owner, self.anchors = -1, 0
        wanted = ([profile.css_selector] if profile.css_selector else []) + ([",".join(profile.target_elements)] if profile.target_elements else [])
        self.wanted = [selectors(w) for w in wanted] if profile.cleanup else []
        self.path: list[tuple[str, dict]] = []
        self.inside: list[list[bool]] = []  # for each open element, what of the wanted it lies in

    def _end_block(self, kind: str = "p") -> None:
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.parts))
        text = re.sub(r" *\n *", "\n", text).strip()
        if text:
            self.blocks.append((self.kind, text, self.owner))
        self.kind, self.parts = kind, []
        self.owner = self._top()

    def _top(self) -> int:
        return self.stack[-1][2] if self.stack else -1

    def _drops(self, tag: str, attrs: dict) -> bool:
        if tag in _SILENT:
            return True
        if not self.p.cleanup:
            return False
        named = f"{attrs.get('id') or ''} {attrs.get('class') or ''}"
        if self.p.remove_consent_popups and tag not in ("html", "body") and _CONSENT.search(named):
            return True
        if self.p.remove_overlay_elements and tag not in ("html", "body"):
            fixed = "position:fixed" in (attrs.get("style") or "").replace(" ", "").lower()
            if fixed or attrs.get("role") == "dialog" or attrs.get("aria-modal") == "true" or _OVERLAY.search(named):
                return True
        return tag in self.p.excluded or not set((attrs.get("class") or "").lower().split()).isdisjoint(self.p.excluded_classes) or (tag == "table" and self.p.ignore_tables)

    def _outside(self) -> bool:
        return bool(self.wanted) and not (self.inside and all(self.inside[-1]))

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.wanted and tag not in _VOID:
            self.path.append((tag, attrs))
            above = self.inside[-1] if self.inside else [False] * len(self.wanted)
            self.inside.append([b or _matches(w, self.path) for b, w in zip(above, self.wanted, strict=True)])
        if tag not in _VOID:
            dropped = self._drops(tag, attrs)
            beside = bool(_BESIDE.search(f"{attrs.get('id') or ''} {attrs.get('class') or ''}"))
            self.elements.append((self._top(), tag, beside))
            self.own.append([0, 0, 0, 0])
            self.stack.append((tag, dropped, len(self.elements) - 1))
            self.silent += dropped
            self.anchors += tag == "a"
        if self.silent or self._outside():
            return
        if self.stack:
            self.own[self._top()][2] += 2 * len(tag) + 5 + sum(len(k) + len(v or "") + 4 for k, v in attrs.items())
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            self._end_block("li")
        elif tag in _BLOCKS:
            self._end_block(tag if tag[0] == "h" and tag[1:].isdigit() else "pre" if tag == "pre" else "quote" if tag == "blockquote" else "row" if tag == "tr" else "p")
        elif tag == "br":
            self.parts.append("\n")
        elif tag in ("td", "th") and self.parts:
            self.parts.append(" | ")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")
        elif tag == "a" and not self.p.ignore_links and attrs.get("href"):
            self.link = attrs["href"]
            self.parts.append("[")
        elif tag == "img" and not self.p.ignore_images and attrs.get("src"):
            self.parts.append(f"![{attrs.get('alt') or ''}]({attrs['src']})")

    def handle_endtag(self, tag):
        if tag not in {t for t, _, _ in self.stack}:
            return
        while self.stack:
            outside = self._outside()
            top, dropped, _ = self.stack.pop()
            self.anchors -= top == "a"
            if not self.silent and not outside:
                if top in ("b", "strong"):
                    self.parts.append("**")
                elif top in ("i", "em"):
                    self.parts.append("*")
                elif top == "a" and self.link is not None:
                    self.parts.append(f"]({self.link})")
                    self.link = None
                elif top in ("ul", "ol") and self.lists:
                    self.lists.pop()
                if top in _BLOCKS or top == "li":
                    self._end_block()
            if self.wanted:
                self.path.pop()
                self.inside.pop()
                if not outside and self._outside():
                    self._end_block()
            self.silent -= dropped
            if top == tag:
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        if self.silent or self._outside():
            return
        words = data.split()
        if words and self.stack:
            own, n = self.own[self._top()], sum(map(len, words)) + len(words) - 1
            own[0] += n
            own[1] += n if self.anchors else 0
            own[3] += len(words)
        self.parts.append(data if self.kind == "pre" else data.replace("\n", " "))


# Signs whose plain form isn't their decomposition.
_PLAIN = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "...", "•": "*", "→": "->", "←": "<-", "©": "(C)", "®": "(R)", "\u00a0": " ", "\u200b": ""})


def _ascii(text: str) -> str:
    def one(c: str) -> str:
        bare = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        return bare if bare.isascii() and bare else c

    return text if text.isascii() else "".join(c if c.isascii() else one(c) for c in text.translate(_PLAIN))


def _wrapped(text: str, width: int, protect_links: bool) -> str:
    """Each line broken at blanks so that it has at most ``width`` characters, unless one token has more."""
    token = r"(?:!?\[[^\]]*\]\([^)\s]*\)|\S)+" if protect_links else r"\S+"
    out = []
    for line in text.split("\n"):
        held = ""
        for t in re.findall(token, line):
            if held and len(held) + 1 + len(t) > width:
                out.append(held)
                held = t
            else:
                held = f"{held} {t}" if held else t
        out.append(held)
    return "\n".join(out)


def html_to_markdown(html: str, profile: Profile = Profile()) -> tuple[str, str]:
    """(title, Markdown).  With cleanup, thin elements go (see ``pruned``); a page on which nothing but headings would stay keeps its blocks."""
    r = _Reader(profile)
    r.feed(html or "")
    r.close()
    r._end_block()
    kept = r.blocks
    if profile.cleanup:
        gone = pruned(r.elements, r.own, profile.word_count_threshold, profile.keep_score)
        dense = [b for b in kept if b[2] < 0 or not gone[b[2]]]
        kept = dense if any(b[0][0] != "h" for b in dense) else kept
    out = []
    for kind, text, _ in kept:
        if not profile.unicode_snob:
            text = _ascii(text)
        if profile.body_width and kind in ("p", "li", "quote"):
            text = _wrapped(text, profile.body_width, profile.protect_links)
        if kind[0] == "h" and kind[1:].isdigit():
            out.append("#" * int(kind[1:]) + " " + text.replace("\n", " "))
        elif kind == "li":
            out.append("- " + text.replace("\n", "\n  "))
        elif kind == "pre":
            out.append("```\n" + text + "\n```")
        elif kind == "quote":
            out.append("> " + text.replace("\n", "\n> "))
        elif kind == "row":
            out.append("| " + text + " |")
        else:
            out.append(text)
    return " ".join("".join(r.title).split()), "\n\n".join(out)


def extracted(html: Column, profile: Profile = Profile()) -> Column:
    """(title, markdown) of each page, in Arrow batches."""

    @F.pandas_udf("title string, markdown string")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_to_markdown(h, profile) for h in x], columns=["title", "markdown"])

    return run(html)
