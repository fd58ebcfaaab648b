"""Main text of web pages, with suffix arrays over the pages of a host.

A page becomes blocks, each in a zone: main (inside an article), chrome (menus, footers,
adverts and so on by their markup) or open. A page with an article is its article, less the
menus and notices inside it; of other pages the open blocks stay, less what the host repeats.
The token streams of the blocks are sorted by suffix, in shards of bounded size; suffixes that
share ``LEAST_RUN`` tokens (by the LCP) are a repeated run, and runs (and the shorter blocks)
are counted over all distinct pages of the host. Any longer repeat is covered by such runs,
each on as many pages at least. Outside articles a run is boilerplate on ``COMMON`` of the pages
if such runs are most of their block, and on ``OFTEN`` of them wherever it stands. Of an article
only blocks go of which every word is in runs on ``OFTEN`` of the host's distinct articles, and
none if these are more than half of its words: then it is a copy. Copies count once.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.session import materialize

SHARD_PAGES = 256
LEAST_RUN = 5
#: Least number and share of a host's distinct pages: of runs that are most of a block, and of runs anywhere.
COMMON = (3, 0.1)
OFTEN = (5, 0.5)
# What HTML elements and usual class names stand for.
RAW = "script style noscript template textarea iframe"
HIDDEN_TAGS = {"head", "title", "svg", "select", "object", "canvas"}
HEAD_TAGS = {"head", "html", "title", "meta", "link", "base", "basefont", "bgsound"}
CHROME = {"nav", "footer", "aside", "form", "button", "menu", "dialog"}
CHROME_NAMES = {"ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "sponsored"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ins", "del", "big"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track"}
ENDS_P = {"p", "div", "ul", "ol", "li", "table", "section", "article", "aside", "nav", "footer", "header", "main", "form", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
MAIN, CHROME_ZONE, OPEN, HIDDEN = 0, 1, 2, 3

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<(" + "|".join(RAW.split()) + r""")(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|$)"""
    r"""|<title(?=[\s>])[^>]*(?<!/)>(?:(?!</?(?:head|body|title|article|main)[\s/>]).)*</title\s*>"""
    r"""|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")


def _zone_of(tag: str, attributes: str, outer: int) -> int:
    if outer == HIDDEN or tag in HIDDEN_TAGS:
        return HIDDEN
    if outer == CHROME_ZONE:
        return outer
    if tag in CHROME or tag == "header" and outer != MAIN:
        return CHROME_ZONE
    if attributes:
        for name, *value in _NAMES.findall(attributes):
            words = set(re.split(r"[\s_-]+", "".join(value).lower()))
            if words & (CHROME_ROLES if name.lower() == "role" else CHROME_NAMES):
                return CHROME_ZONE
            if name.lower() == "role" and "main" in words:
                return MAIN
    return MAIN if tag in ("article", "main") else outer


def _ended_by(tag: str, names: list[str]) -> int:
    """Place of the outermost open element that a start tag ends without an end tag of its own, else how many are open."""
    for at, name in enumerate(names):
        if name in ("head", "title") and tag not in HEAD_TAGS:
            return at
        if name == "select" and tag in ENDS_P or name == "svg" and tag in ENDS_P and "foreignobject" not in names[at:]:
            return at
    return len(names)


def page_blocks(source: str) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page that has text, in page order."""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, text, at = OPEN, [], 0

    def close_block() -> None:
        if text:
            value = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if value and zone != HIDDEN:
                blocks.append((zone, value))
            text.clear()

    def leave(size: int) -> None:
        nonlocal zone
        if size < len(stack):
            close_block()
            zone = stack[size][1]
            del stack[size:]

    for found in _MARKUP.finditer(source):
        if found.start() > at:
            if zone == HIDDEN and stack[-1][0] == "head" and source[at : found.start()].strip():
                leave(len(stack) - 1)
            text.append(source[at : found.start()])
        at = found.end()
        tag = (found[3] or "").lower()
        if not tag:
            continue
        if zone == HIDDEN and not found[2]:
            leave(_ended_by(tag, [name for name, _ in stack]))
        if tag == "br":
            text.append(" ")
        elif tag in INLINE:
            if tag == "span" and not found[2] and found[4] and zone != CHROME_ZONE and _zone_of(tag, found[4], zone) == CHROME_ZONE:
                close_block()
                stack.append((tag, zone))
                zone = CHROME_ZONE
            elif tag == "span" and found[2] and stack and stack[-1][0] == tag:
                close_block()
                zone = stack.pop()[1]
        elif tag in VOID:
            if tag == "hr":
                close_block()
        elif found[2]:
            close_block()
            if any(open_tag == tag for open_tag, _ in stack):
                while True:
                    open_tag, zone = stack.pop()
                    if open_tag == tag:
                        break
        else:
            close_block()
            if tag in ENDS_P and stack and stack[-1][0] == "p":
                zone = stack.pop()[1]
            if not found[4].endswith("/"):
                stack.append((tag, zone))
                zone = _zone_of(tag, found[4], zone)
    if zone == HIDDEN and stack[-1][0] == "head" and source[at:].strip():
        leave(len(stack) - 1)
    text.append(source[at:])
    close_block()
    return blocks


def suffix_array(tokens: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of a token stream in order, each ending with its block, and how many tokens each shares with the one before it.

    Prefix doubling: a suffix's rank is the first place of those that start alike; only what is still tied is sorted again.
    The ranks of all widths then give the LCP. ``tokens`` are small numbers, ``block`` ascends.
    """
    n = len(tokens)
    end = np.searchsorted(block, block, "right")
    counts = np.bincount(tokens)
    rank = (np.cumsum(counts) - counts)[tokens]
    order = np.argsort(rank, kind="stable")
    ranks, width, longest = [rank], 1, int((end - np.arange(n)).max(initial=0))
    while width < longest:
        first = np.append(rank[order] == np.arange(n), True)
        places = np.flatnonzero(~(first[:-1] & first[1:]))
        if not len(places):
            break
        tied = order[places]
        ahead = np.where(tied + width < end[tied], rank[np.minimum(tied + width, n - 1)], -1)
        key = rank[tied] * (n + 1) + ahead + 1
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[places] = tied
        fresh = np.append(True, key[1:] != key[:-1])
        rank, width = rank.copy(), 2 * width
        rank[tied] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        ranks.append(rank)
    a, b, shared = order[1:], order[:-1], np.zeros(max(0, n - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((a + shared < end[a]) & (b + shared < end[b]))
        x, y = (side[inside] + shared[inside] for side in (a, b))
        same = ranks[level][x] == ranks[level][y]
        shared[inside[same]] += np.minimum(1 << level, end[x] - x)[same]
    return order, np.append(np.zeros(min(n, 1), np.int64), shared)


def run_ranks(tokens: np.ndarray, block: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a token stream where ``least`` tokens of one block begin, and the numbers of these suffixes: equal for those that share ``least`` tokens."""
    n = len(tokens)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, shared = suffix_array(tokens, block)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(shared < least)
    whole = np.flatnonzero(block[: n - least + 1] == block[least - 1 :])
    return whole, rank[whole]


def _stream(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words, their numbers, and the block and text number of each, of lists of blocks."""
    words, block, owner, blocks = [], [], [], 0
    for number, own in enumerate(texts):
        for text in own:
            split = text.split(" ")
            words += split
            block += [blocks] * len(split)
            owner += [number] * len(split)
            blocks += 1
    known: dict[str, int] = {}
    tokens = [known.setdefault(word, len(known)) for word in words]
    return words, *(np.array(x, np.int64) for x in (tokens, block, owner))


def _packed(blocks: list[str]) -> bytes:
    """Blocks as they are written and shuffled; none holds a line break."""
    return zlib.compress("\n".join(blocks).encode("utf-8", "surrogatepass")) if blocks else b""


def _unpacked(column: pa.ChunkedArray | pa.Array) -> list[list[str]]:
    return [zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if packed else [] for packed in column.to_pylist()]


_PARSED = "page_id long, url string, host string, main binary, article binary, open boolean, digest binary, zones array<int>, blocks binary, at long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, host, html) with the blocks of articles and a digest of these, and all blocks outside them."""
    for batch in batches:
        mains, articles, opens, digests, zones, blocks = [], [], [], [], [], []
        for source in batch.column(3).to_pylist():
            own = page_blocks(source or "")
            opens.append(bool(own) and all(zone != MAIN for zone, _ in own))
            mains.append(_packed([text for zone, text in own if zone == MAIN]))
            articles.append(hashlib.sha256(mains[-1]).digest() if mains[-1] else None)
            digests.append(hashlib.sha256("\n".join(f"{zone} {text}" for zone, text in own).encode("utf-8", "surrogatepass")).digest())
            zones.append([zone for zone, _ in own if zone != MAIN])
            blocks.append(_packed([text for zone, text in own if zone != MAIN]))
        columns = [mains, articles, opens, digests, zones, blocks, range(batch.num_rows)]
        types = [pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(columns, types)]], names=[part.split()[0] for part in _PARSED.split(", ")])


_RUNS = "host string, run string, n long"


def _run_counts(pages: pa.Table) -> pa.Table:
    """host, run, n: on how many of the distinct pages of a shard each run, and each shorter block, stands."""
    return _counts_from(pages, 1)


def _counts_from(pages: pa.Table, least: float) -> pa.Table:
    texts = _unpacked(pages.column("blocks"))
    words, tokens, block, owner = _stream(texts)
    whole, rank = run_ranks(tokens, block, LEAST_RUN)
    pairs, first = np.unique(rank * (len(texts) + 1) + owner[whole], return_index=True)
    _, start, count = np.unique(pairs // (len(texts) + 1), return_index=True, return_counts=True)
    start, count = start[count >= least], count[count >= least]
    runs = [" ".join(words[i : i + LEAST_RUN]) for i in whole[first[start]]]
    short: dict[str, int] = {}
    for own in texts:
        for text in {text for text in own if text.count(" ") < LEAST_RUN - 1}:
            short[text] = short.get(text, 0) + 1
    short = {text: n for text, n in short.items() if n >= least}
    names, counts = runs + list(short), [*count.tolist(), *short.values()]
    return pa.table({"host": pa.array([pages.column("host")[0].as_py()] * len(names), pa.string()), "run": pa.array(names, pa.string()), "n": pa.array(counts, pa.int64())})


def _often_runs(pages: pa.Table) -> pa.Table:
    """The runs on ``OFTEN``'s share of the distinct articles of a shard. A run on that share of all of a host's is among these in one shard at least."""
    return _counts_from(pages, OFTEN[1] * pages.num_rows)


def _listed_counts(pages: pa.Table, runs: pa.Table) -> pa.Table:
    """host, run, n of the listed runs alone."""
    if not pages.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "run": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    counts = _run_counts(pages)
    return counts.filter(pc.is_in(counts.column("run"), value_set=runs.column("run").combine_chunks()))


_TEXTS = "page_id long, url string, text string"


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marked pages (page_id, url, main) of which nothing goes, with their main text."""
    for batch in batches:
        texts = ["\n\n".join(blocks) for blocks in _unpacked(batch.column(2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _covered(texts: list[list[str]], lists: list[list[str]]) -> list[np.ndarray]:
    """For each list of runs, which words of the blocks stand in one of them."""
    long = [[run for run in runs if run.count(" ") == LEAST_RUN - 1] for runs in lists]
    _, tokens, block, owner = _stream([*texts, *[[run] for runs in long for run in runs]])
    whole, rank = run_ranks(tokens, block, LEAST_RUN)
    covered, first = [], len(texts)
    for runs in long:
        known = rank[(owner[whole] >= first) & (owner[whole] < first + len(runs))]
        first += len(runs)
        hit = np.zeros(len(tokens), bool)
        hit[(whole[np.isin(rank, known)][:, None] + np.arange(LEAST_RUN)).ravel()] = True
        covered.append(hit)
    return covered


def _article_texts(pages: pa.Table, runs: pa.Table) -> pa.Table:
    """The marked pages of one shard with their main text; ``runs``: what the host's articles repeat."""
    texts, listed, result, at = _unpacked(pages.column("main")), runs.column("run").to_pylist(), [], 0
    hit, short = _covered(texts, [listed])[0], set(listed)
    for blocks in texts:
        sizes, gone = [text.count(" ") + 1 for text in blocks], []
        for text, size in zip(blocks, sizes):
            gone.append(text in short if size < LEAST_RUN else bool(hit[at : at + size].all()))
            at += size
        copy = 2 * sum(size for size, out in zip(sizes, gone) if out) > sum(sizes)
        result.append("\n\n".join(text for text, out in zip(blocks, gone) if copy or not out))
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(result, pa.string())})


def _open_texts(pages: pa.Table, runs: pa.Table) -> pa.Table:
    """The pages of one shard, none of them marked, with their main text; ``runs``: what the host repeats."""
    common = dict(zip(runs.column("run").to_pylist(), runs.column("often").to_pylist()))
    texts = _unpacked(pages.column("blocks"))
    covered = _covered(texts, [list(common), [run for run, often in common.items() if often]])
    result, at = [], 0
    for zones, blocks in zip(pages.column("zones").to_pylist(), texts):
        kept = []
        for zone, text in zip(zones, blocks):
            words = text.split(" ")
            repeated, always = (hit[at : at + len(words)] for hit in covered)
            at += len(words)
            own = " ".join(w for w, hit in zip(words, repeated if 2 * repeated.sum() > len(words) else always) if not hit)
            if zone == OPEN and own and own not in common:
                kept.append(own)
        result.append("\n\n".join(kept))
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(result, pa.string())})


def _article_parts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, shard, blocks: each distinct article of the hosts listed with their number of ``articles``, once."""
    parts = rows.where("article is not null").select("host", "main", "article").join(hosts, "host")
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("article"), F.ceil(F.col("articles") / SHARD_PAGES))).drop("articles")
    # one shuffle for the copies and the shards
    return parts.repartition("host", "shard").groupBy("host", "shard", "article").agg(F.first("main").alias("blocks")).drop("article")


def _article_runs(rows: DataFrame) -> DataFrame:
    """host, run: what ``OFTEN`` of a host's distinct articles have."""
    number = F.count_distinct("article")
    hosts = materialize(rows.where("article is not null").groupBy("host").agg(number.alias("articles")).where(F.col("articles") >= OFTEN[0]))
    found = _article_parts(rows, hosts).groupBy("host", "shard").applyInArrow(_often_runs, _RUNS)
    found = materialize(found.select("host", "run").distinct())
    left = hosts.join(found.select("host").distinct(), "host", "left_semi")
    shards = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("articles") / SHARD_PAGES) - 1))
    listed = found.join(left, "host").select("host", shards.alias("shard"), "run").groupBy("host", "shard")
    counts = _article_parts(rows, left).groupBy("host", "shard").cogroup(listed).applyInArrow(_listed_counts, _RUNS)
    counts = counts.groupBy("host", "run").agg(F.sum("n").alias("n")).join(left, "host")
    return materialize(counts.where(F.col("n") >= F.greatest(F.lit(float(OFTEN[0])), F.col("articles") * OFTEN[1])).select("host", "run"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html, any other columns).

    Null or empty html: empty text. Null url: the pages without one count as one host.
    Repeated rows: each returned. A host of any size is cut into shards; what it repeats is counted over all of them.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = materialize(pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(_parsed, _PARSED))
    sizes = materialize(rows.where("open").groupBy("host").agg(F.ceil(F.count("*") / SHARD_PAGES).alias("shards")))

    distinct = rows.join(sizes.select("host"), "host", "left_semi").groupBy("host", "digest").agg(F.first("blocks").alias("blocks"))
    distinct = materialize(distinct)
    total = materialize(distinct.groupBy("host").agg(F.count("*").alias("pages")))
    parts = distinct.join(total, "host").withColumn("shard", F.pmod(F.xxhash64("digest"), F.ceil(F.col("pages") / SHARD_PAGES)))
    runs = parts.select("host", "shard", "blocks").groupBy("host", "shard").applyInArrow(_run_counts, _RUNS)
    runs = runs.groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON[0]).join(total, "host")
    least = [F.greatest(F.lit(float(number)), F.col("pages") * share) for number, share in (COMMON, OFTEN)]
    common = materialize(runs.where(F.col("n") >= least[0]).select("host", "run", (F.col("n") >= least[1]).alias("often")))

    unmarked = rows.where("open").join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("page_id", "digest", "at"), "shards"))
    unmarked = unmarked.select("page_id", "url", "host", "shard", "zones", "blocks").groupBy("host", "shard")
    listed = common.join(sizes, "host").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    decided = unmarked.cogroup(listed.select("host", "shard", "run", "often").groupBy("host", "shard")).applyInArrow(_open_texts, _TEXTS)

    marked, often = rows.where("not open"), _article_runs(rows)
    whole = marked.join(often.select("host").distinct(), "host", "left_anti").select("page_id", "url", "main").mapInArrow(_whole_texts, _TEXTS)
    sizes = marked.join(often.select("host").distinct(), "host", "left_semi").groupBy("host").agg(F.ceil(F.count("*") / SHARD_PAGES).alias("shards"))
    sizes = materialize(sizes)
    articles = marked.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("page_id", "digest", "at"), "shards"))
    articles = articles.select("page_id", "url", "host", "shard", "main").groupBy("host", "shard")
    listed = often.join(sizes, "host").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    cleared = articles.cogroup(listed.select("host", "shard", "run").groupBy("host", "shard")).applyInArrow(_article_texts, _TEXTS)
    return whole.unionByName(cleared).unionByName(decided).withColumn("n_chars", F.length("text").cast("long"))
