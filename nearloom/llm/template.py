"""Main text of pages, by templates deduced from equivalence classes of tokens.

A token is an element with the path of elements around it, or the whole text of a block there.
Its occurrence vector says how often it stands on each page of the host; tokens that share a
vector form a class.  A class is valid if it has at least ``CLASS`` tokens and stands on at least
``SUPPORT`` of the host's different pages; texts must stand on ``TEMPLATE_TEXT`` of them and on
``LEAST`` at least.  The elements and texts of valid classes, nested by their paths, are the
host's template.  Elements that repeat in varying number (paragraphs, items) have vectors of
their own and belong to the slot around them.

A slot is what lies between template elements.  The main slot is the innermost template element
that holds ``HELD`` of what the host's pages say in running text, template texts and links left
out; if an article or main element holds as much, it is taken rather than a box inside it.  Its
blocks are the main text, with a heading of the first order that the template shows elsewhere.  On
a page that lacks the host's main slot, the page's own once-opened elements serve as template.
Within the main slot, a template element that holds nothing but template texts is furniture, unless
such texts are the larger part of the slot, as on hosts of near copies, where recurrence tells
nothing.

What the template cannot tell apart is decided by marks: blocks that are mostly links, and
elements that their name or a whole word of class, id or role calls a menu, header, footer,
sidebar, notice, advert, form or comment.

The vectors are never gathered: a token's vector is the sum, over pages, of a hash of page and
count, so one aggregate on (host, token) gives it and a second one, on (host, vector), the classes.
Copies of a page count once.  A host keeps only tokens that stand on half of its pages, so at most
twice as many as an average page has.  Templates are joined to the pages, by broadcast while they
hold fewer than ``BROADCAST_IDS`` tokens together.

Defined results: null or empty html has no text; a null url is a host of its own, the empty one;
repeated rows get equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import BROADCAST_IDS, Scratch, checkpointed
from nearloom.llm.html import Block, read
from nearloom.llm.urlfilter import host_of

CLASS, SUPPORT, HELD, TEMPLATE_TEXT, LEAST = 2, 0.5, 0.6, 0.8, 3

_DROP = frozenset("head nav header footer aside form button menu dialog fieldset select".split())
_CALLED = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar widget widgets related share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search comment comments reply replies respond disqus footer header masthead copyright pagination pager toolbar contentinfo complementary site-header site-footer page-header page-footer site-nav main-nav cookie-banner cookie-notice cookie-consent comment-list comments-area related-posts share-buttons social-share ad-container".split())
_BOX = re.compile(r"(article|main)\b")
_HEADING = re.compile(r"h[1-6]\b")
_PHRASE = re.compile(r"(p|h[1-6]|li|td|pre|blockquote)\b")


def _id(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def mostly(chars: Iterable[tuple[tuple[str, ...], int]]) -> frozenset:
    """The elements that hold more than half of the running text, given as (path, characters)."""
    held: Counter = Counter()
    total = 0
    for path, n in chars:
        total += n
        for i in range(1, len(path) + 1):
            held[path[:i]] += n
    return frozenset(p for p, n in held.items() if 2 * n > total)


def unwanted(path: tuple[str, ...], most: frozenset = frozenset()) -> bool:
    """Whether an element on the path is furniture by its own name or marks.

    Marks are whole words of class, id or role.  They say nothing of an article, a main element, a
    heading, or an element in ``most``.
    """
    in_article = False
    for i, key in enumerate(path):
        name, _, marks = key.partition("[")
        if name == "header" and in_article:
            if not any(_HEADING.match(k) for k in path[i + 1 :]):
                return True
            continue
        if name in _DROP:
            return True
        free = name in ("html", "body", "article", "main") or _HEADING.match(name) or path[: i + 1] in most
        if marks and not free and any(w in _CALLED for v in marks.rstrip("]").split(",") for w in v.partition("=")[2].split()):
            return True
        in_article = in_article or name in ("article", "main")
    return False


_KINDS = "host string, page long, token long, text boolean, n long, path string, chars long, linked long"


def tokens_of(blocks: list[Block], opened: dict) -> list[tuple]:
    """(token, whether a text, how often, path, running characters, those in links) of one page."""
    chars: Counter = Counter()
    linked: Counter = Counter()
    texts: dict = {}
    for b in blocks:
        chars[b.path] += len(b.text)
        linked[b.path] += b.linked
        name = text_token(b)
        old = texts.get(name, (0, 0, 0, 0))
        texts[name] = (old[0] + 1, "\n".join(b.path), old[2] + len(b.text), old[3] + b.linked)
    rows = [(_id("path", *p), False, opened.get(p, 1), "\n".join(p), chars[p], linked[p]) for p in opened.keys() | chars.keys()]
    return rows + [(name, True, *t) for name, t in texts.items()]


def text_token(b: Block) -> int:
    return _id("text", *b.path, b.text)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip([c.split()[0] for c in _KINDS.split(", ")], kinds, strict=True)))
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            html = html.as_py() or ""
            page = _id(html)
            rows += [(host, page, *t) for t in tokens_of(*read(html))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), schema, strict=True)], schema=schema)


class Template:
    """The elements and texts of a host's valid classes, and the element that is the main slot.

    ``tokens``: of paths, those that stand on half of the pages (``valid`` where their class is),
    and valid texts.
    """

    def __init__(self, tokens: list) -> None:
        split = lambda t: tuple(t["path"].split("\n")) if t["path"] else ()
        self.paths = {split(t) for t in tokens if not t["text"] and t["valid"]}
        self.texts = {t["token"] for t in tokens if t["text"]}
        self.known: dict[tuple, tuple] = {}
        said: Counter = Counter()  # running characters that vary, by path
        for t in tokens:
            said[split(t)] += (t["chars"] - t["linked"]) * (-1 if t["text"] else 1)
        self.main = self._main({p: max(0, n) for p, n in said.items()})

    def slot(self, path: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
        """The template elements around a path, the outermost first."""
        if path not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[path] = tuple(path[: i + 1] for i in range(len(path)) if path[: i + 1] in self.paths)
        return self.known[path]

    def _main(self, said: dict) -> tuple[str, ...] | None:
        most = mostly(said.items())
        held: Counter = Counter()
        total = 0
        for path, n in said.items():
            if n and not unwanted(path, most):
                total += n
                for element in self.slot(path):
                    held[element] += n
        fit = [p for p, n in held.items() if n >= HELD * total and not _PHRASE.match(p[-1])]
        return max(fit, key=lambda p: (bool(_BOX.match(p[-1])), len(p), held[p]), default=None)


def own_template(blocks: list[Block], opened: dict) -> Template:
    """What a page alone says: elements opened once are its template."""
    return Template([{"token": t, "text": False, "path": path, "chars": chars, "linked": linked, "valid": n == 1} for t, text, n, path, chars, linked in tokens_of(blocks, opened) if not text])


def main_text(blocks: list[Block], opened: dict, template: Template) -> str:
    if template.main is None or template.main not in opened:
        texts = template.texts
        template = own_template(blocks, opened)
        template.texts = texts
    most = mostly((b.path, len(b.text) - b.linked) for b in blocks)
    own = [b for b in blocks if not unwanted(b.path, most) and 2 * b.linked <= len(b.text)]
    inside = lambda b: template.main is None or template.main in template.slot(b.path)
    fixed = {id(b) for b in own if text_token(b) in template.texts}
    held = [b for b in own if inside(b)]
    box = lambda b: template.slot(b.path)[-1:]
    varied = {box(b) for b in held if id(b) not in fixed} | {(template.main,)}
    if 2 * sum(len(b.text) for b in held if id(b) in fixed) > sum(len(b.text) for b in held):
        varied |= {box(b) for b in held}
    title = lambda b: b.path[-1:] and b.path[-1].partition("[")[0] == "h1" and id(b) not in fixed
    return "\n\n".join(b.text for b in own if (box(b) in varied if inside(b) else title(b)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template] = {}
    for batch in batches:
        texts = []
        for i, html in enumerate(batch.column(3)):
            host = batch.column(2)[i].as_py()
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = Template(batch.column(4)[i].as_py() or [])
            texts.append(main_text(*read(html.as_py() or ""), known[host]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, tokens``: each host's frequent paths and valid texts; ``pages``: host and html."""
    tokens = pages.mapInArrow(_tokens, _KINDS)
    first = [F.max(c).alias(c) for c in ("text", "n", "path", "chars", "linked")]
    once = tokens.groupBy("host", "page", "token").agg(*first)
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)"))
    vectors = scratch.put(once.groupBy("host", "token").agg(vector.alias("vector"), F.count(F.lit(1)).alias("support"), F.max("text").alias("text"), F.max("path").alias("path"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).where(~F.col("text") | (F.col("support") >= LEAST)))
    size = scratch.put(vectors.groupBy("host").agg(F.max("support").alias("pages")))  # the root element stands on all
    few = F.broadcast(size) if size.count() <= BROADCAST_IDS else size
    frequent = scratch.put(vectors.join(few, "host").where(F.col("support") >= SUPPORT * F.col("pages")))
    classes = frequent.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= CLASS)
    valid = frequent.join(classes.withColumn("valid", F.lit(True)), ["host", "vector"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    fixed = F.col("valid") & (F.col("support") >= TEMPLATE_TEXT * F.col("pages")) & (F.col("support") >= LEAST)
    return valid.where(~F.col("text") | fixed).groupBy("host").agg(F.collect_list(F.struct("token", "text", "valid", "path", "chars", "linked")).alias("tokens"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    with Scratch(pages.sparkSession) as scratch:
        found = checkpointed(templates(rows.select("host", "html"), scratch))
    held = found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    few = F.broadcast(found) if held <= BROADCAST_IDS else found
    return rows.join(few, "host", "left").select("page_id", "url", "host", "html", "tokens").mapInArrow(_extracted, "page_id long, url string, text string")
