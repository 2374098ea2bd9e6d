"""Main text of web pages: page structure, and a suffix array over each host's token streams.

A page is parsed once into blocks. Elements and roles that are never text (``nav``, ``footer``, ``form``,
``aside``, scripts, styles) are chrome, and so is what a class or id calls a menu, advert, sidebar,
cookie notice, footer or reader comment. All other text is either in the page's article (``article``,
``main``) or in doubt: what lies outside of any article, on pages without one, and what a class or id
inside an article calls by a word that chrome and text share (header, related, widget, ...).

The words outside the article and those in doubt make up the page's token stream. Streams of a host are
searched for long stretches that distinct pages share, by :mod:`spindrift.llm.repeats`. Covered words in
doubt are boilerplate and go, unique runs stay; ``n_boilerplate`` counts what goes. Articles are left as
they are: sentences that several articles of a host share are text of each.

Markup is read as browsers read it: a quote counts only where a value begins, and an unclosed one runs to
the next quote or to the end. Every pattern takes time in proportion to the page.

Defined results: null and blank html give an empty text; a page without any text gives an empty
text; a null url is a host of its own; rows with equal url and html are one page; markup that
breaks off is read as far as it goes; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.repeats import Shape, find
from spindrift.llm.shared import MemberFilter
from spindrift.llm.suffix_dedup import merged
from spindrift.session import materialise

#: Words of a stretch that counts as boilerplate when distinct pages of a host share it.
STRETCH = 12

#: An attribute: its name, and the value in quotes or without.
_VALUE = r"\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>|\Z))"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?)?+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")

#: Elements whose content isn't markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_END_OF = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_CHROME = set("nav aside footer form dialog menu button select svg object head".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
#: Words of a class or id that mark chrome, and those that mark it outside of articles; inside, they
#: leave it in doubt.
_MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr masthead menu nav navbar navigation newsletter pagination pager respond sidebar signup skyscraper sponsor sponsored subscribe subscription".split()
)
_DOUBTFUL = set("banner disclaimer header login modal notice notices popup promo promoted promotion related replies share sharing social toolbar widget widgets".split())
_ARTICLE = {"article", "main"}


@dataclass
class Page:
    """``blocks`` of text as (place in the stream, text), the place being -1 for what isn't in doubt; the
    ``stream`` of words outside the article and in doubt. ``has_article``: blocks outside are left out."""

    blocks: list[tuple[int, str]] = field(default_factory=list)
    stream: list[str] = field(default_factory=list)
    has_article: bool = False


#: What an element is: text, in doubt, or chrome.
_TEXT, _DOUBT, _CHROME_KIND = 0, 1, 2


def _kind(name: str, attrs: str, in_article: bool) -> int:
    if name in _CHROME or name == "header" and not in_article:
        return _CHROME_KIND
    kind = _TEXT
    if name in ("html", "body", "article", "main"):
        return kind
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "role" and value in _ROLES or key == "aria-hidden" and value == "true":
            return _CHROME_KIND
        if key in ("class", "id"):
            found = _SPLIT.split(value)
            if not _MARKS.isdisjoint(found):
                return _CHROME_KIND
            if not _DOUBTFUL.isdisjoint(found):
                kind = _DOUBT if in_article else _CHROME_KIND
    return kind


def parse(html: str | None) -> Page:
    """One pass over the markup with a stack of the elements that matter."""
    page, html = Page(), html or ""
    stack: list[tuple[str, int, bool]] = []  # name, kind, article
    names: Counter[str] = Counter()  # of the stack
    chrome = doubt = article = 0
    text: list[str] = []
    outside: list[tuple[int, str]] = []
    at = 0

    def end_block() -> None:
        block = _SPACE.sub(" ", entities.unescape("".join(text))).strip() if text else ""
        text.clear()
        if not block:
            return
        place = -1
        if chrome or doubt or not article:
            place = len(page.stream)
            page.stream.extend(block.split(" "))
        if not chrome:
            (page.blocks if article else outside).append((place, block))

    def push(name: str, kind: int, is_article: bool) -> None:
        nonlocal chrome, doubt, article
        stack.append((name, kind, is_article))
        names[name] += 1
        chrome += kind == _CHROME_KIND
        doubt += kind == _DOUBT
        article += is_article

    def pop(depth: int) -> None:
        nonlocal chrome, doubt, article
        for name, kind, was_article in stack[depth:]:
            names[name] -= 1
            chrome -= kind == _CHROME_KIND
            doubt -= kind == _DOUBT
            article -= was_article
        del stack[depth:]

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        text.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK or name in _ARTICLE:
            end_block()
        elif name in ("br", "td", "th"):
            text.append(" ")
        if m["close"]:
            if names[name]:
                pop(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == name))
            continue
        if name in _RAW:
            stop = _END_OF[name].search(html, at)
            at = stop.end() if stop else len(html)
            continue
        if name in _VOID or m["attrs"].endswith("/"):
            continue
        if name in _ARTICLE:
            if not article:
                # chrome that was never closed ends where an article begins, unless it is comments
                page.has_article |= not chrome or not any(c == _CHROME_KIND for n, c, _ in stack if n not in ("nav", "footer", "form", "header", "menu"))
                if chrome and page.has_article:
                    pop(next(d for d, e in enumerate(stack) if e[1] == _CHROME_KIND))
            push(name, _TEXT, not chrome)
            continue
        kind = _kind(name, m["attrs"], article > 0)
        if kind:
            if name not in ("p", "span", "a", "b", "i", "em", "strong"):
                end_block()
            push(name, kind, False)
        elif (chrome or doubt) and names[name]:
            push(name, _TEXT, False)  # nested element of the same name
    end_block()
    if not page.has_article:
        page.blocks = outside
    return page


def _host_salt(url: str | None) -> int:
    host = re.sub(r"^[a-z]+://", "", (url or "").lower()).split("/", 1)[0].split("@")[-1].split(":")[0]
    return xxhash.xxh3_64_intdigest(host) - (1 << 63)


_PARSED = "page_id {kind}, url string, sid binary, salt long, data binary, blocks array<struct<at:int,text:string>>"


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_boilerplate`` of every page; the last counts the words in doubt
    that went since other pages of the host share them. Pages without any words in doubt stay where
    they are; they are only searched for what others share with them."""
    kind = pages.schema[page_id].dataType.simpleString()
    blocks_type = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, salts, datas, blocks = [], [], [], []
            for i in range(batch.num_rows):
                link, markup = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                page = parse(markup)
                sids.append(xxhash.xxh3_128_digest(f"{link}\n{markup}".encode()))
                salts.append(_host_salt(link))
                datas.append(np.array([xxhash.xxh32_intdigest(w) for w in page.stream], np.uint32).tobytes())
                # what isn't in doubt needs no places
                sure = all(a < 0 for a, _ in page.blocks)
                blocks.append([{"at": -1, "text": "\n".join(t for _, t in page.blocks)}] if sure else [{"at": a, "text": t} for a, t in page.blocks])
            columns = [batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array(salts, pa.int64()), pa.array(datas, pa.binary()), pa.array(blocks, blocks_type)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "sid", "salt", "data", "blocks"])

    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    parsed = materialise(rows.mapInArrow(run, _PARSED.format(kind=kind)), "html-parsed", compression="zstd")
    spans = find(parsed.select("sid", "salt", "data"), Shape(STRETCH, STRETCH // 2, 4), across=True)
    sure = (F.size("blocks") == 1) & (F.get("blocks", F.lit(0))["at"] < 0)
    whole = parsed.where(sure).select("page_id", "url", F.get("blocks", F.lit(0))["text"].alias("text"), F.lit(0).cast("long").alias("n_boilerplate"))
    loose = parsed.where(~sure).select("page_id", "url", "sid", "blocks")
    wanted = MemberFilter(loose.select("sid").distinct(), "sid").keep(spans, "sid")
    covered = wanted.groupBy("sid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for row in batch.select(["blocks", "spans"]).to_pylist():
                ranges = merged(row["spans"] or [])
                flags = np.zeros(ranges[-1][1] if ranges else 0, bool)
                for a, z in ranges:
                    flags[a:z] = True
                out, n = [], 0
                for b in row["blocks"]:
                    at, kept = b["at"], b["text"]
                    if at >= 0 and flags[at:].any():
                        words = kept.split(" ")
                        own = flags[at : at + len(words)].tolist()
                        n += sum(own)
                        kept = " ".join(w for w, f in zip(words, own + [False] * (len(words) - len(own))) if not f)
                    if kept:
                        out.append(kept)
                texts.append("\n".join(out))
                gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "n_boilerplate"])

    cleaned = loose.join(covered, "sid", "left").select("page_id", "url", "blocks", "spans").mapInArrow(unique, f"page_id {kind}, url string, text string, n_boilerplate long")
    return whole.unionByName(cleaned).withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_boilerplate")
