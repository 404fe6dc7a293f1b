"""Main text of web pages: blocks by structure, boilerplate by suffix arrays of each host.

A page is cut into blocks. Blocks in menus, headers, footers and the like are out; blocks in
an article or main element are landmark text; where a page has neither element, its other
blocks are open. Landmark and open text of every page goes through suffix arrays of its
host's concatenated token streams, which find long runs of tokens that pages repeat.

Open text: what runs cover that repeat on pages of otherwise different text (all but
landmark text is looked at) is boilerplate; unique runs are kept.

Landmark text: articles quote each other, so a run counts only if it stands in the landmark
text of more than half of the host's different texts (four at least). An exact check
follows: a block goes if such runs cover all of it, and none goes from a page if that would be
more than half of its text (then the page is a copy with changes, and no notice).

A host's pages are dealt out to shards of bounded size, so a host with a third of
all pages is many tasks; each shard names each of its windows once, and windows that several
of a host's shards name repeat too, so the result doesn't depend on how pages are dealt out.

Copies of a page repeat all of its text, which is no boilerplate: pages of equal or nearly
equal open text (MinHash over three-token shingles) count as one page.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import row_hash, slices, stash
from tableaudit.llm.simhash import components

# Element names by role, and words of class, id and role attributes that mark what isn't article text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "canvas", "object", "audio", "video", "select"}
CHROME = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"}
LANDMARKS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Words of adverts, notices and reader comments, and of a page's other parts; words that say nothing beside them.
NEVER_TEXT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "popup", "modal",
    "overlay", "comment", "comments", "commentlist", "disqus", "reply", "replies", "newsletter", "subscribe", "subscription", "login", "signup", "pagination", "pager", "breadcrumb",
    "breadcrumbs", "hidden",
}
PARTS = {
    "banner", "notice", "notices", "sidebar", "side", "aside", "menu", "nav", "navbar", "navigation", "header", "footer", "masthead", "toolbar", "widget", "widgets", "share", "sharing",
    "social", "related", "recommended", "search", "skip",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies"}
BESIDE = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "form", "global", "group", "home", "icons", "inner", "item", "items", "js", "layout", "left", "link",
    "links", "list", "main", "media", "mobile", "module", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "section", "secondary", "site", "slot", "sticky",
    "thread", "top", "unit", "wrap", "wrapper", "zone",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tooltip"}

# Comments, declarations, tags with quoted attributes; what is cut off by the end of the page is a tag too.
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+'|["'](?=[^>]*+>))*+)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.IGNORECASE)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

OUT, OPEN, TEXT = 0, 1, 2
#: Share of a block's characters that stand in links, above which it is a menu entry (outside of landmarks).
LINKED = 0.8
#: Sketches of open texts: hashes are compared in bands; pages that resemble each other by 0.8 share a band in 99.7 of 100 cases.
BANDS, BAND_ROWS, SHINGLE = 20, 6, 3
_MIX = np.random.default_rng(7).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


@dataclass(frozen=True)
class Params:
    """``run``: tokens of the shortest run that counts as repeated. ``shard_tokens``: tokens of a shard's streams, about.
    ``alike``: resemblance of open texts (estimated from their sketches) from which pages count as one.
    ``site``: share of a host's different landmark texts above which a run is the site's; ``least``: number of texts it must stand in."""

    run: int = 8
    shard_tokens: int = 1 << 19
    alike: float = 0.8
    site: float = 0.5
    least: int = 4


def marks(attrs: str) -> tuple[bool, set[str]]:
    """Whether an element's attributes hide it or give it a role beside the text; and the words by which its class or id names
    a part of a page that isn't the article's text. A name counts if it is made of such words (``site-header``, ``ad slot``) and
    not if it says something else as well (``has-sidebar``, ``entry-header``, ``related-none``)."""
    hard, words = False, set()
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id"):
            for token in value.lower().split():
                said = {w for w in re.split(r"[_-]+|(?<=[a-z])\d+$", token) if w and not w.isdigit()}
                if said <= NEVER_TEXT | PARTS | BESIDE:
                    words |= said & (NEVER_TEXT | PARTS)
        hard |= name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true"
        hard |= name == "style" and bool(HIDDEN_STYLE.search(value))
    return hard, words


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, mark) of a page's blocks in page order; marks are OUT, OPEN or TEXT. A page with a landmark has no open blocks.

    Named parts of a page are out, with these exceptions: a landmark's own name takes it out only if it is a
    reader's comment; a landmark inside a named part is text if the page has no other; inside of a landmark a part
    stays that has a heading or holds most of the landmarks' text, unless it is an advert, a notice or comments."""
    # Blocks as [text, mark, part inside of a landmark or 0, whether the landmark lies in a named part].
    out: list[list] = []
    # Elements: name, counts that they add to: hidden or chrome, named part, landmark, part inside of a landmark.
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    # Parts inside of landmarks: words, whether they have a heading, characters.
    inner: list[list] = [[set(), False, 0]]
    parts: list[str] = []
    gone = named = landmarks = links = linked = within = 0
    has_landmark = False

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text) if links else 0

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                part = len(inner) - 1 if within else 0
                # Outside of landmarks a block that is all link is a menu entry.
                out.append([text, OUT if gone or named and not landmarks else TEXT if landmarks else OUT if linked > LINKED * len(raw.strip()) else OPEN, part, bool(named)])
                inner[part][2] += len(text)
            parts.clear()
            linked = 0

    def leave(upto: int) -> None:
        nonlocal gone, named, landmarks, links, within
        while len(stack) > upto:
            name, hard, part, landmark, inside = stack.pop()
            gone -= hard
            named -= part
            landmarks -= landmark
            within -= inside
            links -= name == "a"

    at, size = 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            say(page[at:])
            break
        say(page[at:less])
        m = TOKEN.match(page, less)
        if not m:
            say("&lt;")
            at = less + 1
            continue
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m["end"]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if place is not None:
                leave(place)
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if m["attrs"].endswith("/") and name in ("svg", "math", "object", "canvas"):
                continue
            parts.append(" " if name not in ("script", "style") else "")
            if close is None:
                if name in ("svg", "math", "object", "canvas", "select", "audio", "video", "noscript"):
                    continue
                break
            at = page.find(">", close.end())
            at = size if at < 0 else at + 1
            continue
        if name in VOID:
            continue
        if name == "p":  # a paragraph ends the one before it
            top = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), None)
            if top is not None and stack[top][0] == "p":
                leave(top)
        hard, words = marks(m["attrs"]) if m["attrs"] and name not in ("html", "body") else (False, set())
        hard |= name in CHROME and not (name == "header" and landmarks)  # an article's own header has its title
        if name in LANDMARKS and not landmarks:
            words &= COMMENTS
        inside = bool(words and landmarks and not within)
        if inside:
            inner.append([words, False, 0])
        if within + inside and re.fullmatch("h[1-6]", name):
            inner[-1][1] = True
        part = bool(words) and not landmarks
        landmark = name in LANDMARKS and not hard and not gone and not part
        has_landmark |= landmark
        gone += hard
        named += part
        landmarks += landmark
        within += inside
        links += name == "a"
        stack.append((name, hard, part, landmark, inside))
    flush()
    if not has_landmark:
        return [(text, mark) for text, mark, _, _ in out]
    most = sum(len(text) for text, mark, _, _ in out if mark == TEXT) / 2
    stays = [not words & NEVER_TEXT and (heading or chars > most) for words, heading, chars in inner]
    stays[0] = True
    clear = any(mark == TEXT and stays[part] and not named for _, mark, part, named in out)
    return [(text, TEXT if mark == TEXT and stays[part] and not (named and clear) else OUT) for text, mark, part, named in out]


def suffix_order(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a token stream, and the rank of each suffix by its first ``depth`` tokens at least."""
    _, rank = np.unique(stream, return_inverse=True)
    rank, h = rank.astype(np.int64), 1
    while h < depth and int(rank.max()) < len(rank) - 1:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        rank, h = rank.astype(np.int64), 2 * h
    return np.argsort(rank, kind="stable"), rank


def neighbours(stream: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a token stream, and whether each suffix agrees with the one after it in their first ``run`` tokens."""
    order, _ = suffix_order(stream, run)
    a, b = order[:-1], order[1:]
    same = np.maximum(a, b) + run <= len(stream)
    for i in range(run):
        same[same] = stream[a[same] + i] == stream[b[same] + i]
    return order, same


def common(stream: np.ndarray, page: np.ndarray, run: int, share: float) -> np.ndarray:
    """One place of each run of ``run`` tokens that stands on more than ``share`` of the pages, which count from 0.

    Each page's last token is one of its own, so no run spans two pages."""
    if len(stream) < run:
        return np.empty(0, np.int64)
    order, same = neighbours(stream, run)
    first = np.flatnonzero(np.r_[True, ~same])
    end = np.r_[first[1:], len(order)]
    most, last = share * (page[-1] + 1), np.searchsorted(page, page, "right") - 1
    many = (end - first > most) & (order[first] + run <= last[order[first]])
    return np.array([order[a] for a, b in zip(first[many], end[many]) if len(np.unique(page[order[a:b]])) > most], np.int64)


def repeated(stream: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """True for tokens covered by a run of ``run`` tokens that stands on distinct pages.

    Between pages ``stream`` has tokens of their own, so no run spans two pages."""
    covered = np.zeros(len(stream) + 1, np.int64)
    if len(stream) >= run:
        order, same = neighbours(stream, run)
        group = np.r_[0, np.cumsum(~same)]
        pages = page[order]
        first = np.flatnonzero(np.r_[True, ~same])
        several = np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first)
        start = order[several[group] & (order + run <= len(stream))]
        np.add.at(covered, start, 1)
        np.add.at(covered, start + run, -1)
    return np.cumsum(covered[:-1]) > 0


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) >> 1


def windows(stream: np.ndarray, run: int) -> np.ndarray:
    """A hash of each window of ``run`` tokens."""
    if len(stream) < run:
        return np.empty(0, np.int64)
    h = np.zeros(len(stream) - run + 1, np.uint64)
    for i in range(run):
        h = h * np.uint64(0x100000001B3) + stream[i:len(stream) - run + 1 + i].astype(np.uint64)
    return h.view(np.int64)


def parse(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) -> (page_id, url, row, host, texts, marks, open, tokens, words, content): ``tokens`` outside of
    landmarks, ``words`` and ``content`` (a hash) of the landmark text."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    source = pages.select("page_id", "url", row_hash(F.col("page_id"), F.col("url"), F.col("html")).alias("row"), host.alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks(x or "") for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string())), pa.array([[m for _, m in b] for b in found], pa.list_(pa.int32())),
                 pa.array([any(m == OPEN for _, m in b) for b in found]), pa.array([sum(t.count(" ") + 1 for t, m in b if m != TEXT) for b in found], pa.int64()),
                 pa.array([sum(t.count(" ") + 1 for t, m in b if m == TEXT) for b in found], pa.int64()), pa.array([_hash("\n".join(t for t, m in b if m == TEXT)) for b in found], pa.int64())],
                names=["page_id", "url", "row", "host", "texts", "marks", "open", "tokens", "words", "content"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url string, row bigint, host string, texts array<string>, marks array<int>, open boolean, tokens bigint, words bigint, content bigint")


def sketch(words: list[str]) -> list[int]:
    """MinHash of the distinct shingles of a text of one word at least."""
    stream = np.array([_hash(w) for w in words], np.int64)
    h = np.unique(windows(stream, min(SHINGLE, len(stream)))).view(np.uint64)
    out = []
    for m in _MIX:
        z = (h ^ m) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int((z >> np.uint64(33)).min()))
    return out


def copies(pages: DataFrame, p: Params) -> DataFrame:
    """(row, page) of the open ``pages`` (host, row, texts, marks): ``page`` is the least row among pages of the host that count as one."""
    source = pages.select("host", "row", "texts", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1)
                text = " ".join(t for t, m in zip(r.column(2)[0].as_py(), r.column(3)[0].as_py()) if m == OPEN)
                own = sketch(text.split(" "))
                bands = [xxhash.xxh64_intdigest(np.array([b, *own[b * BAND_ROWS:(b + 1) * BAND_ROWS]], np.int64).tobytes()) >> 1 for b in range(BANDS)]
                yield pa.RecordBatch.from_arrays(
                    [r.column(0), r.column(1), pa.array([xxhash.xxh128_hexdigest(text)]), pa.array([own], pa.list_(pa.int32())), pa.array([bands], pa.list_(pa.int64()))],
                    names=["host", "row", "content", "sketch", "bands"])

    made = stash(source.mapInArrow(run, "host string, row bigint, content string, sketch array<int>, bands array<bigint>"), "sketches")
    # Equal texts are one page at once; the others are linked to the least page they share a band with, if they are alike.
    equal = stash(made.groupBy("host", "content").agg(F.min("row").alias("first")), "equal")
    one = made.join(equal, F.col("row") == F.col("first"), "left_semi")
    banded = one.select("host", "row", F.explode("bands").alias("band"))
    least = banded.groupBy("host", "band").agg(F.min("row").alias("centre"))
    pairs = banded.join(least, ["host", "band"]).filter("row != centre").select("row", "centre").distinct()
    a, b = one.select("row", F.col("sketch").alias("a")), one.select(F.col("row").alias("centre"), F.col("sketch").alias("b"))
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    links = pairs.join(a, "row").join(b, "centre").filter(same >= p.alike * BANDS * BAND_ROWS)
    tree = components(links.select(F.col("row").alias("a"), F.col("centre").alias("b")))
    whole = equal.join(tree, F.col("first") == F.col("node"), "left").select("host", "content", F.coalesce("root", "first").alias("page"))
    return made.select("host", "row", "content").join(whole, ["host", "content"]).select("row", "page")


def _shard(run: int):
    """For a shard of a host's pages: per open page the covered tokens of its stream and the hashes of its windows that aren't wholly
    covered; and each distinct window of the shard, covered or not, with its least and greatest page, beside the first row that has it."""

    def covered(pdf: pd.DataFrame) -> pd.DataFrame:
        streams, page = [], pdf["page"].to_numpy(np.int64)
        for i, (texts, marks) in enumerate(zip(pdf["texts"], pdf["marks"])):
            words = [_hash(w) for t, m in zip(texts, marks) if m != TEXT for w in t.split(" ")]
            streams.append(np.array([*words, -1 - i], np.int64))  # a token of the row's own ends its stream
        stream = np.concatenate(streams)
        known = repeated(stream, np.repeat(page, [len(s) for s in streams]), run)
        edge = np.cumsum([0, *(len(s) for s in streams)])
        hashes = [windows(s[:-1], run) for s in streams]
        every, of = np.concatenate(hashes), np.repeat(np.arange(len(streams)), [len(h) for h in hashes])
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][:len(every)])
        low, high = (f.reduceat(page[of], first) if len(first) else first for f in (np.minimum, np.maximum))
        by_row = np.argsort(of[first], kind="stable")
        cuts = np.searchsorted(of[first][by_row], np.arange(1, len(streams)))
        named = [np.split(x[by_row], cuts) for x in (every[first], low, high)]
        rows = []
        for i, is_open in enumerate(pdf["open"]):
            own = known[edge[i]:edge[i + 1] - 1]
            before = np.r_[0, np.cumsum(own)]
            rest = before[run:] - before[:-run] < run if is_open and len(hashes[i]) else np.zeros(len(hashes[i]), bool)
            rows.append((own.astype(np.int8).tobytes(), np.flatnonzero(rest).tolist(), hashes[i][rest].tolist(), *(x[i].tolist() for x in named)))
        out = pdf[["host", "shard", "row", "open"]].copy()
        out["covered"], out["at"], out["window"], out["named"], out["low"], out["high"] = zip(*rows)
        return out

    return covered


def main_text(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Blocks are joined by line feeds. Null and empty html, and pages without text, give
    an empty text. Null urls and urls without host share the empty host. Repeated rows
    give equal rows and are one page to the suffix arrays; an empty table gives an
    empty result; other columns are not looked at. The text of every page comes through its
    host's suffix arrays; what they find in landmark text is then checked block by block.
    """
    parsed = stash(parse(pages), "blocks", "zstd")
    closed = landmark_text(parsed.filter("NOT open"), site_runs(parsed, p), p)
    open_pages = parsed.filter("open")
    if not open_pages.isEmpty():
        found = open_text(parsed, p)
        rows = open_pages.select("page_id", "url", "row").join(found, "row").select("page_id", "url", "text")
        closed = closed.union(rows)
    return closed.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def _rows(batches: Iterator[pa.RecordBatch], most: int = 64) -> Iterator[list[dict]]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most).to_pylist()


def _landmark(row: dict) -> list[str]:
    return [t for t, m in zip(row["texts"], row["marks"]) if m == TEXT]


def _common(run: int, share: float):
    """For a shard of a host's landmark texts: their number, and a hash of each run that more than ``share`` of them have."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.drop_duplicates("content")["stream"]
        streams = [np.array([*map(_hash, zlib.decompress(x).decode().split(" ")), -1 - i], np.int64) for i, x in enumerate(texts)]
        stream = np.concatenate(streams)
        at = common(stream, np.repeat(np.arange(len(streams)), [len(x) for x in streams]), run, share)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "texts": [len(streams)], "runs": [windows(stream, run)[at].tolist()]})

    return found


def site_runs(parsed: DataFrame, p: Params) -> DataFrame:
    """(host, runs): hashes of the runs of ``p.run`` tokens that stand in more than ``p.site`` of a host's different landmark texts,
    ``p.least`` at least.

    Equal texts lie in one shard of their host, so numbers add up, and a run that more than a share of all texts have is one that more than
    this share of some shard's texts have: the shards' suffix arrays name candidates (a shard has at most 1 / ``p.site`` times as many as
    its texts have tokens on average), which are then counted in all texts. The result doesn't depend on the deal."""
    texts = parsed.filter("words > 0").select("host", "content", "words", "texts", "marks")
    large = texts.groupBy("host").agg(F.ceil(F.sum("words") / p.shard_tokens).alias("shards")).filter("shards > 1")
    shard = F.pmod(F.xxhash64("content"), F.coalesce("shards", F.lit(1))).cast("int")
    dealt = texts.join(F.broadcast(large), "host", "left").select("host", shard.alias("shard"), "content", "texts", "marks")

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()  # equal texts of a task travel once
        for rows in _rows(batches):
            new = [r for r in rows if (r["host"], r["content"]) not in sent and not sent.add((r["host"], r["content"]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["host"] for r in new], pa.string()), pa.array([r["shard"] for r in new], pa.int32()), pa.array([r["content"] for r in new], pa.int64()),
                 pa.array([zlib.compress(" ".join(_landmark(r)).encode()) for r in new], pa.binary())], names=["host", "shard", "content", "stream"])

    made = dealt.mapInArrow(streams, "host string, shard int, content bigint, stream binary").groupBy("host", "shard").applyInPandas(
        _common(p.run, p.site), "host string, texts bigint, runs array<bigint>")
    made = stash(made, "shard-runs")
    hosts = made.groupBy("host").agg(F.sum("texts").alias("all"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    hosts = stash(hosts.filter((F.col("all") >= p.least) & (F.size("runs") > 0)), "candidates")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            for r in rows:
                has = np.unique(windows(np.array([_hash(w) for t in _landmark(r) for w in t.split(" ")], np.int64), p.run))
                has = has[np.isin(has, np.array(r["runs"], np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([r["host"]] * len(has), pa.string()), pa.array(has), pa.array([r["content"]] * len(has), pa.int64())], names=["host", "window", "content"])

    having = texts.join(hosts, "host").select("host", "content", "texts", "marks", "runs").mapInArrow(count, "host string, window bigint, content bigint")
    numbers = having.groupBy("host", "window").agg(F.count_distinct("content").alias("n")).join(hosts.select("host", "all"), "host")
    site = numbers.filter((F.col("n") > p.site * F.col("all")) & (F.col("n") >= p.least))
    return stash(site.groupBy("host").agg(F.collect_list("window").alias("runs")), "site-runs")


def without(texts: list[str], runs: list[int], run: int) -> list[str]:
    """Blocks of a landmark text less those that ``runs`` cover whole; all of them if that would be more than half of the text."""
    words = [t.split(" ") for t in texts]
    size = [len(w) for w in words]
    at = np.flatnonzero(np.isin(windows(np.array([_hash(x) for w in words for x in w], np.int64), run), np.array(runs, np.int64)))
    covered = np.zeros(sum(size), bool)
    for i in at:
        covered[i:i + run] = True
    gone = [bool(c.all()) for c in np.split(covered, np.cumsum(size)[:-1])]
    return texts if 2 * sum(n for n, g in zip(size, gone) if g) > sum(size) else [t for t, g in zip(texts, gone) if not g]


def landmark_text(pages: DataFrame, runs: DataFrame, p: Params) -> DataFrame:
    """(page_id, url, text) of the ``pages`` without open blocks: their landmark text less what the ``runs`` of their host cover."""
    source = pages.join(runs, "host", "left").select("page_id", "url", "texts", "marks", "runs")
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [without(_landmark(r), r["runs"], p.run) if r["runs"] and TEXT in r["marks"] else _landmark(r) for r in part.select(["texts", "marks", "runs"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["\n".join(x) for x in found], pa.string())], names=["page_id", "url", "text"])

    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string")


def repeats(dealt: DataFrame, p: Params) -> DataFrame:
    """(row, covered, more) of the open pages of ``dealt`` (host, shard, row, page, open, texts, marks): the tokens of a row's stream that
    other pages in its shard repeat, and where windows start that other pages of the host have too. The result doesn't depend on the deal."""
    made = dealt.groupBy("host", "shard").applyInPandas(
        _shard(p.run), "host string, shard int, row bigint, open boolean, covered binary, at array<int>, window array<bigint>, named array<bigint>, low array<bigint>, high array<bigint>")
    made = stash(made, "covered")
    shards = made.groupBy("host").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).filter("a < b").select("host")
    several = made.join(shards, "host", "left_semi")
    # Each shard names each of its windows once: least and greatest page over all shards tell whether several pages have it.
    names = several.select("host", F.explode(F.arrays_zip("named", "low", "high")).alias("w"))
    across = names.groupBy("host", F.col("w.named").alias("window")).agg(F.min("w.low").alias("a"), F.max("w.high").alias("b")).filter("a < b").select("host", "window")
    rest = several.filter("open").select("host", "row", F.explode(F.arrays_zip("at", "window")).alias("w")).select("host", "row", "w.at", "w.window")
    more = rest.join(across, ["host", "window"]).groupBy("row").agg(F.collect_list("at").alias("more"))  # at most a page's own windows
    return made.filter("open").select("row", "covered").join(more, "row", "left")


def open_text(parsed: DataFrame, p: Params) -> DataFrame:
    """(row, text) of the pages with open blocks: what host suffix arrays don't find repeated on other pages."""
    # Evidence: all streams of the hosts that have an open page, each page once.
    hosts = parsed.filter("open").select("host").distinct()
    pages = parsed.filter("tokens > 0").join(hosts, "host", "left_semi").groupBy("row").agg(*[F.first(c).alias(c) for c in ("host", "texts", "marks", "open", "tokens")])
    pages = stash(pages, "streams")
    shards = pages.groupBy("host").agg(F.ceil(F.sum("tokens") / p.shard_tokens).alias("shards"))
    dealt = pages.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    dealt = dealt.join(copies(pages.filter("open"), p), "row", "left").withColumn("page", F.coalesce("page", "row"))
    found = repeats(dealt.select("host", "shard", "row", "page", "open", "texts", "marks"), p)
    source = found.join(pages.filter("open").select("row", "texts", "marks"), "row")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gone = np.frombuffer(r["covered"], np.int8).astype(bool)
                for i in r["more"] or ():
                    gone[i:i + p.run] = True
                kept, at = [], 0
                for text, mark in zip(r["texts"], r["marks"]):
                    if mark == TEXT:
                        kept.append(text)
                        continue
                    words = text.split(" ")
                    if mark == OPEN:
                        kept.append(" ".join(w for w, g in zip(words, gone[at:at + len(words)]) if not g))
                    at += len(words)
                out.append("\n".join(x for x in kept if x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    return source.select("row", "covered", "more", "texts", "marks").mapInArrow(rebuild, "row bigint, text string")
