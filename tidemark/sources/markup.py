"""HTML to structured text, images, links and JSON-LD, on the standard library's parser, batched through Arrow."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that end a line; elements whose content isn't shown.
BLOCKS = frozenset("address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENCODED = re.compile(r"&(?:amp;)*lt;/?(?:p|div|ul|ol|li|br|h[1-6]|section|article|table|script|style)\b", re.I)
# What a picture's path, name or text says that is none of the posting; the length from which a text needs none; the least larger side.
DECORATIVE = re.compile(r"(?:^|[\s/_.-])(?:favicon|logo|icon)(?:$|[\s/_.-])", re.I)
SPARSE, SMALL = 600, 160


class Events(HTMLParser):
    """(kind, value, attributes) of a page in order; hidden content is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        self.events.append(("open", tag, dict(attrs)))
        if tag in VOID:
            self.events.append(("close", tag, {}))

    def handle_startendtag(self, tag, attrs):
        self.events += [("open", tag, dict(attrs)), ("close", tag, {})]

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag not in VOID:
            self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("hidden" if self.hidden else "text", data, {}))


def events(page: str) -> list[tuple[str, str, dict]]:
    parser = Events()
    parser.feed(page)
    parser.close()
    return parser.events


#: A text, a strictly written tag or a document type.
STRICT = re.compile(r"""([^<]+)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][a-zA-Z-]*="[^"<>]*")*)[ \t\n]?(/?)>|<!(?i:doctype)[^<>\[]*>""")
# Elements whose content is not read as markup; of these only scripts and styles are cut here.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
ENDS = {t: re.compile(rf"</{t}[\t\n\r\f />]", re.I) for t in ("script", "style")}


def plain_events(page: str) -> list[tuple[str, str]]:
    """``events`` without attributes.  A strictly written page is cut by one expression, several times faster than by the library's parser, which reads all others."""
    found: list[tuple[str, str]] = []
    hidden, at, n = 0, 0, len(page)
    while at < n:
        m = STRICT.match(page, at)
        if not m:
            return [(k, v) for k, v, _ in events(page)]
        at = m.end()
        text, closing, tag, more, whole = m.groups()
        if text:
            found.append(("hidden" if hidden else "text", entities.unescape(text)))
            continue
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if more or whole or tag in RAW:
                return [(k, v) for k, v, _ in events(page)]
            hidden -= 1 if tag in HIDDEN and hidden else 0
            if tag not in VOID:
                found.append(("close", tag))
        elif tag in RAW:
            end = ENDS[tag].search(page, at) if tag in ENDS and not whole else None
            if not end or end[0][-1] != ">" or page.find("<!--", at, end.start()) >= 0:
                return [(k, v) for k, v, _ in events(page)]
            found += [("open", tag), *([("hidden", page[at : end.start()])] if end.start() > at else []), ("close", tag)]
            at = end.end()
        elif whole:
            found += [("open", tag), ("close", tag)]
        else:
            hidden += tag in HIDDEN
            found += [("open", tag), ("close", tag)] if tag in VOID else [("open", tag)]
    return found


def unwrapped(page: str) -> str:
    """A page whose markup was itself escaped, up to twice, as markup."""
    for _ in range(2):
        if not ENCODED.search(page):
            break
        page = entities.unescape(page)
    return page


def lines(text: str) -> str:
    """Lines collapsed and trimmed; empty ones go."""
    found = (" ".join(x.split()) for x in re.split(r"\r\n|\r|\n", text))
    return "\n".join(x for x in found if x)


def structured_text(page: str | None, fallback: str | None = "") -> str:
    """Text with a line per block, ``##``/``###`` before headings and a bullet before list items.

    Without visible text the fallback's lines; a fallback that goes on where the
    page's text ends lends its rest.
    """
    fallback = lines(fallback or "")
    if not (page or "").strip():
        return fallback
    out: list[str] = []
    for kind, value in plain_events(unwrapped(page)):
        if kind == "text":
            out.append(re.sub(r"\s+", " ", value))
        elif kind == "open" and value in HEADINGS:
            out.append("\n" + ("## " if value in ("h1", "h2") else "### "))
        elif kind == "open" and value == "li":
            out.append("\n• ")
        elif kind == "open" and value == "br" or value in BLOCKS:
            out.append("\n")
    made = [x for x in lines("".join(out)).split("\n") if x not in ("##", "###", "•", "")]
    made = [re.sub(r"^(?:#{2,3}|•) (?=(?:#{2,4}|[*•◦-])\s)", "", x) for x in made]
    text = "\n".join(made)
    if not text:
        return fallback
    plain = lambda t: " ".join(re.sub(r"(?:^|\s)(?:#{2,4}|[*•◦-])(?=\s)", " ", t).split())
    shown, more = plain(text), plain(fallback)
    return f"{text}\n{more[len(shown):].strip()}" if more.startswith(shown + " ") else text


def side(value: str | None) -> float | None:
    """A width or height in pixels."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)(?:px)?", (value or "").strip(), re.I)
    return float(m[1]) if m else None


def images(page: str | None, text: str | None, url: str | None, most: int = 3, enough: int = SPARSE) -> list[dict]:
    """Up to three pictures that may stand for a short description: https, on the page's own host, not decorative, not small on both sides."""
    base = urlsplit(url or "")
    if not page or len((text or "").strip()) >= enough or base.scheme != "https" or not base.hostname:
        return []
    found: list[dict] = []
    for kind, tag, attrs in events(page):
        if kind != "open" or tag != "img":
            continue
        known = {f["url"] for f in found}
        full = None
        for src in (attrs.get(k) for k in ("src", "data-src", "data-original")):
            try:
                at = urlsplit(urljoin(url, src.strip())) if (src or "").strip() else None
            except ValueError:
                continue
            if at and at.scheme == "https" and at.hostname == base.hostname and at.username is None and at.password is None and (made := at._replace(fragment="").geturl()) not in known:
                full = made
                break
        sides = [side(attrs.get(k)) for k in ("width", "height")]
        says = " ".join((urlsplit(full or "").path, attrs.get("id") or "", attrs.get("class") or "", attrs.get("alt") or ""))
        if full is None or DECORATIVE.search(says) or None not in sides and max(sides) < SMALL:
            continue
        found.append({"url": full, "alt": (attrs.get("alt") or "").strip()[:200] or f"채용 공고 상세 내용 이미지 {len(found) + 1}"})
        if len(found) == most:
            break
    return found


def links(page: str | None, base: str | None) -> list[dict]:
    """Every link with its text, absolute."""
    out, open_ = [], []
    for kind, value, attrs in events(page or ""):
        if kind == "open" and value == "a" and attrs.get("href"):
            open_.append({"url": urljoin(base or "", attrs["href"].strip()), "text": ""})
        elif kind == "close" and value == "a" and open_:
            link = open_.pop()
            link["text"] = " ".join(link["text"].split())
            out.append(link)
        elif kind == "text" and open_:
            open_[-1]["text"] += value
    return out


def scripts(page: str | None, kind: str | None = None, ident: str | None = None) -> list[str]:
    """Contents of scripts of a type or an id."""
    out, inside = [], False
    for what, value, attrs in events(page or ""):
        if what == "open" and value == "script":
            inside = (kind is None or (attrs.get("type") or "").lower() == kind) and (ident is None or attrs.get("id") == ident)
            if inside:
                out.append("")
        elif what == "close" and value == "script":
            inside = False
        elif inside and what == "hidden":
            out[-1] += value
    return out


@F.pandas_udf(T.StringType())
def html_text(page: pd.Series) -> pd.Series:
    return page.map(lambda p: structured_text(p))


@F.pandas_udf(T.ArrayType(T.StructType().add("url", T.StringType()).add("text", T.StringType())))
def html_links(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links(p, b) for p, b in zip(page, base)])


@F.pandas_udf(T.ArrayType(T.StructType().add("url", T.StringType()).add("alt", T.StringType())))
def description_images(page: pd.Series, text: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([images(p, t, u) for p, t, u in zip(page, text, url)])


def next_page(page: str | None, base: str | None) -> str | None:
    """The following page of an HTML listing: ``rel=next``, or a next link of its pagination that isn't disabled."""
    for kind, tag, attrs in events(page or ""):
        if kind != "open" or tag != "a" or not attrs.get("href"):
            continue
        names = set(re.split(r"\s+", attrs.get("class") or ""))
        if "next" in (attrs.get("rel") or "").split() or "next" in names and not names & {"disabled", "is-disabled"} and attrs.get("aria-disabled") != "true":
            return urljoin(base or "", attrs["href"])
    return None


@F.pandas_udf(T.StringType())
def html_next_page(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([next_page(p, b) for p, b in zip(page, base)], dtype=object)
