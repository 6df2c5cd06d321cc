"""Main text of web pages: page structure, then a host suffix array against boilerplate.

A page is cut into blocks of text. What stands directly in an element that the page marks as its
article is article text, also where several articles share a line; scripts, styles and what
elements and roles set apart (menus, headers, footers, asides, forms) are not. Everything else is
loose: pages without an article, <main>, boxes with a class inside an article, and whatever
stands around an article.

The loose tokens of a host's pages, concatenated, are sorted as suffixes. Runs of DEPTH tokens or
more that stand on PAGES distinct pages or more are boilerplate; loose words that they cover are
removed, and unique runs stay. Pages of equal blocks on a host count once, and a page of which
nothing else would be left keeps its text.

A host whose loose text exceeds SHARD is dealt into shards by page. A shard's suffix array tells
for each of its runs of DEPTH tokens on how many of its pages it stands; shards share no page, so
their sums are the host's exact numbers, and a longer repeated run is the union of its runs of
DEPTH tokens. No task holds a host, and only hosts with several shards write runs that stand once.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.llm import batch, store
from loresift.llm.batch import gram_hashes
from loresift.llm.groups import groups

#: Tokens that a repeated run has at least, and distinct pages of the host that it stands on at least.
DEPTH = 12
PAGES = 4
#: Characters of loose text of one shard.
SHARD = 8 << 20

# Elements by what they hold.
RAW = "script style noscript template textarea select option iframe svg math object canvas audio video head title button".split()
APART = "nav header footer aside form dialog menu".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul"
).split()
SPACERS = "br td th wbr".split()
APART_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
#: Elements that hold boxes: only their classes tell what they are for.
BOXES = "div section ul ol dl span ins center".split()
#: Whole classes of boxes that are not article text, also inside an article.
APART_CLASSES = (
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidebars cookie cookies consent gdpr notice notices "
    "banner banners popup modal overlay paywall comment comments comment-list reader-comments user-comments respond disqus "
    "related related-posts related-articles recommended subscribe newsletter signup login share sharing share-buttons social-share "
    "cookie-notice cookie-banner site-notice site-header site-footer ad-slot ad-box"
).split()
#: On pages without an article, also boxes of which a part of a class is one of these.
APART_PARTS = (
    "ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs pagination header masthead "
    "topbar footer sidebar sidebars rail related recommended teaser teasers cookie cookies consent notice notices banner popup modal comment "
    "comments disqus subscribe newsletter signup login share sharing social tagcloud copyright"
).split()

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNPARSED = {n: re.compile(rf"</{n}\s*>", re.I).search for n in ("script", "style", "textarea", "title")}
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|$)|display\s*:\s*none").search
_RAW, _APART, _VOID, _BLOCKS, _SPACERS = map(frozenset, (RAW, APART, VOID, BLOCKS, SPACERS))
_ROLES, _BOXES, _CLASSES, _PARTS = map(frozenset, (APART_ROLES, BOXES, APART_CLASSES, APART_PARTS))


def _set_apart(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element, by itself or its role, holds something else than the article; whether only its class says so."""
    if name in _APART and not (name == "header" and in_article):
        return True, False
    if "=" not in attributes:
        return bool(attributes and _HIDDEN(attributes)), False
    named = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "class" and (name in _BOXES or name == "article"):
            classes = [c.replace("_", "-") for c in value.split()]
            named |= any(c.lower() in _CLASSES for c in classes)
            if not in_article and name in _BOXES:
                named |= any(w.lower() in _PARTS for c in classes for w in _PART.findall(_CAMEL.sub(" ", c)))
        elif key == "role" and value.lower() in _ROLES or key == "aria-hidden" and value.lower() == "true":
            return True, False
    return bool(_HIDDEN(attributes)), named


def _events(source: str) -> list[tuple[str, str, str]]:
    """Page as (kind, name or text, attributes): text, open, close. What scripts and the like hold is left out."""
    events, at = [], 0
    for m in _MARKUP.finditer(source):
        if m.start() < at:
            continue
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if m.start() > at:
            events.append(("text", source[at : m.start()], ""))
        at = m.end()
        if not closing and name in _UNPARSED:
            if not attributes.endswith("/"):
                end = _UNPARSED[name](source, at)
                at = end.end() if end else len(source)
        elif name:
            events.append(("close" if closing else "open", name, attributes))
    if at < len(source):
        events.append(("text", source[at:], ""))
    return events


def _matched(events) -> tuple[set[int], set[int]]:
    """Positions of start tags that an end tag closes, and those of them that hold the page's heading."""
    found, headed, stack = set(), set(), []
    for k, (kind, name, _) in enumerate(events):
        if kind == "open" and name not in _VOID:
            stack.append([name, k, False])
            if name == "h1":
                for held in stack:
                    held[2] = True
        elif kind == "close":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    found.add(stack[depth][1])
                    if stack[depth][2]:
                        headed.add(stack[depth][1])
                    del stack[depth:]
                    break
    return found, headed


ARTICLE, LOOSE, AROUND = range(3)


def blocks(source: str) -> list[tuple[str, int]]:
    """The page's visible blocks in order, references decoded, white space single, each ARTICLE, LOOSE or AROUND.

    ARTICLE: in an article element, in no box with a class. LOOSE: other text that may be the
    article's. AROUND: all else. On a page with an article that has text, nothing outside it is
    LOOSE; else, on one with <main>, nothing outside that. An element set apart whose end tag is
    missing reaches to the next tag only, so a page cut short or badly nested loses no article.
    A box is not set apart for its class if it holds the page's heading.
    """
    events = _events(source)
    matched, headed = _matched(events)
    stack: list[tuple[str, bool, int, bool]] = []
    out: list[tuple[str, bool, int, int, bool]] = []
    text: list[str] = []
    apart = raw = articles = mains = boxes = 0
    pending = False

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, apart > 0 or pending, articles, mains, boxes > 0))
            text.clear()

    def leave(depth):
        nonlocal apart, raw, articles, mains, boxes
        for was, away, inside, box in stack[depth:]:
            apart -= away
            raw -= was in _RAW
            boxes -= box
            if inside:
                articles -= was == "article"
                mains -= was == "main"
        del stack[depth:]

    for k, (kind, name, attributes) in enumerate(events):
        if kind == "text":
            if not raw:
                text.append(name)
            continue
        if name in _BLOCKS or pending:
            flush()
        elif name in _SPACERS:
            text.append(" ")
        pending = False
        if kind == "open" and name not in _VOID:
            away, named = _set_apart(name, attributes, articles > 0)
            away |= named and k not in headed
            if away or name in _RAW:
                flush()
            if k in matched:
                inside = name in ("article", "main") and not away and not apart
                box = articles > 0 and name in _BOXES and "class" in attributes
                if box and not boxes:
                    flush()
                stack.append((name, away, inside, box))
                apart += away
                raw += name in _RAW
                articles += inside and name == "article"
                mains += inside and name == "main"
                boxes += box
            else:
                pending = away
        elif kind == "close":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if any(x[1] or x[3] for x in stack[depth:]):
                        flush()
                    leave(depth)
                    break
    flush()
    held = 2 if any(a and not away for _, away, a, _, _ in out) else 1 if any(m and not away for _, away, _, m, _ in out) else 0
    return [
        (t, AROUND if away or held == 2 and not a or held == 1 and not m else LOOSE if box or not a else ARTICLE)
        for t, away, a, m, box in out
    ]


def page_blocks(column: str) -> Column:
    """Struct of a page's kept blocks, the loose text of kept and other blocks, and each kept block's first word in it (-1: article)."""
    kind = "struct<blocks:array<string>,at:array<int>,loose:string>"

    def compute(pages: pa.Array) -> pa.Array:
        kept, places, loose = [], [], []
        for page in pages.to_pylist():
            mine, at, other, n = [], [], [], 0
            for block, sort in blocks(page or ""):
                if sort != AROUND:
                    mine.append(block)
                    at.append(n if sort == LOOSE else -1)
                if sort != ARTICLE:
                    other.append(block)
                    n += block.count(" ") + 1
            kept.append(mine)
            places.append(at)
            loose.append("\n".join(other))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())), pa.array(loose, pa.string())], ["blocks", "at", "loose"]
        )

    return F.arrow_udf(compute, kind)(F.col(column))


_WHITE = batch.separators(0x20, 0x0A)


def _streams(loose: pa.Array, hosts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the pages, salted by host, and each page's first."""
    tokens, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    salts = hosts.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    for octets, ends in batch.slices(loose.cast(pa.binary())):
        words = batch.Words(octets, ends, _WHITE)
        n = np.diff(words.first)
        tokens.append(words.hashes() ^ np.repeat(batch.mix(salts[at : at + words.rows]), n))
        first.append(first[-1][-1] + words.first[1:])
        at += words.rows
    return np.concatenate(tokens), np.concatenate(first)


def suffix_runs(tokens: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``depth`` tokens in concatenated streams: their hashes, and on how many streams each stands.

    Stream k has tokens first[k] to first[k + 1]. Suffixes are sorted by their first ``depth``
    tokens by prefix doubling; neighbours of equal rank share that many. Suffixes that reach over
    a stream's end are left out.
    """
    at = np.flatnonzero(batch.whole(first, depth))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rank, reach = np.unique(tokens, return_inverse=True)[1], 1
    while reach < depth:
        step = min(reach, depth - reach)
        later = np.append(rank[step:], np.full(step, -1)) + 1
        rank = np.unique(rank * (len(tokens) + 1) + later, return_inverse=True)[1]
        reach += step
    rank, stream = rank[at], batch.row_of(at, first)
    order = np.lexsort((stream, rank))
    rank, stream = rank[order], stream[order]
    new_run = np.append(True, rank[1:] != rank[:-1])
    new_stream = new_run | np.append(True, stream[1:] != stream[:-1])
    begins = np.flatnonzero(new_run)
    pages = np.add.reduceat(new_stream.astype(np.int64), begins)
    return gram_hashes(tokens, depth)[at[order][begins]], pages


def _runs(tables):
    """Runs of each shard (host, run, n): all of a host with several shards, else those on PAGES pages or more."""
    for table, cuts in groups(tables, ("host", "shard")):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            hashes, n = suffix_runs(*_streams(part["loose"].combine_chunks(), part["host"].combine_chunks()))
            if part["shards"][0].as_py() == 1:
                hashes, n = hashes[n >= PAGES], n[n >= PAGES]
            host = np.full(len(n), part["host"][0].as_py(), np.int64)
            yield pa.record_batch([pa.array(host), pa.array(hashes.view(np.int64)), pa.array(n)], ["host", "run", "n"])


def _covered(tables):
    """For each page of a shard (kind 1), the loose words that its host's common runs (kind 0) cover, as bits."""
    for table, cuts in groups(tables, ("host", "shard")):
        rows, masks = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            page = part["kind"].to_numpy() == 1
            common = np.unique(part["run"].to_numpy()[~page].astype(np.int64))
            if page.all() or not page.any():
                continue
            pages = part.filter(pa.array(page))
            tokens, first = _streams(pages["loose"].combine_chunks(), pages["host"].combine_chunks())
            hit = np.isin(gram_hashes(tokens, DEPTH).view(np.int64), common) & batch.whole(first, DEPTH)
            change = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(change, np.flatnonzero(hit), 1)
            np.add.at(change, np.flatnonzero(hit) + DEPTH, -1)
            covered = np.cumsum(change)[:-1] > 0
            for k, row in enumerate(pages["row"].to_pylist()):
                mine = covered[first[k] : first[k + 1]]
                if mine.any():
                    rows.append(row)
                    masks.append(np.packbits(mine).tobytes())
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(masks, pa.binary())], ["row", "covered"])


def _unique_runs(page: list[str], at: list[int], covered: np.ndarray) -> list[str]:
    """The page's blocks without the loose words that are covered; all of them, if nothing would be left."""
    out = []
    for block, first in zip(page, at, strict=True):
        if first >= 0:
            words = block.split(" ")
            block = " ".join(w for w, c in zip(words, covered[first : first + len(words)], strict=True) if not c)
        if block:
            out.append(block)
    return out or page


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have the text "" of 0 characters; an empty table gives no rows. A null
    url counts as one host of its own. Equal pages get equal texts, repeated rows one each. Very
    long pages are read whole; references that decode to white space count as white space. Other
    columns of pages, of any name, are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    parsed = store.materialize(
        pages.select("page_id", "url", F.xxhash64(host).alias("host"), page_blocks("html").alias("p")).select(
            "page_id", "url", "host", "p.*", F.monotonically_increasing_id().alias("row")
        ),
        "blocks",
    )
    loose = parsed.where("loose <> ''").select("row", "host", "loose")
    sizes = loose.groupBy("host").agg(F.ceil(F.sum(F.length("loose")) / SHARD).cast("int").alias("shards"))
    many = store.materialize(sizes.where("shards > 1"), "hosts")
    shards = F.coalesce("shards", F.lit(1))
    dealt = loose.join(store.small(many), "host", "left").select(
        "row", "host", "loose", shards.alias("shards"), F.pmod(F.xxhash64("row"), shards).cast("int").alias("shard")
    )
    once = parsed.groupBy(store.row_key("host", "blocks", "loose").alias("key")).agg(F.min("row").alias("row")).select("row")
    counted = (
        dealt.join(store.small(store.materialize(once, "once")), "row", "left_semi")
        .repartition("host", "shard").sortWithinPartitions("host", "shard")
        .select("host", "shard", "shards", "loose").mapInArrow(_runs, "host long, run long, n long")
    )
    common = counted.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("host", "run")
    common = store.materialize(common, "runs")
    open_pages = parsed.where(F.exists("at", lambda x: x >= 0)).select("row")
    open_pages = dealt.join(store.small(store.materialize(open_pages, "open")), "row", "left_semi")
    spread = common.join(store.small(many), "host", "left").select(
        "host", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.lit(0).alias("kind"), "run",
        F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("loose"),
    )
    mixed = spread.unionByName(open_pages.select("host", "shard", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("run"), "row", "loose"))
    covered = store.materialize(
        mixed.repartition("host", "shard").sortWithinPartitions("host", "shard").mapInArrow(_covered, "row long, covered binary"), "covered"
    )

    def rest(blocks_: pa.Array, at: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for page, places, mask in zip(blocks_.to_pylist(), at.to_pylist(), masks.to_pylist(), strict=True):
            if mask is not None:
                page = _unique_runs(page, places, np.unpackbits(np.frombuffer(mask, np.uint8)))
            out.append("\n".join(page))
        return pa.array(out, pa.string())

    text = F.when(F.col("covered").isNull(), F.array_join("blocks", "\n")).otherwise(F.arrow_udf(rest, T.StringType())("blocks", "at", "covered"))
    return (
        parsed.join(store.small(covered, F.length("covered")), "row", "left")
        .select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
