"""Main text of web pages: templates of a host from equivalence classes of tokens, and what is left in their slots."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.texts import arrow, blocks, saved, utf8
from tidemark.llm.urls import host_and_path

# Comments, declarations, tags, text. An element of RAW holds no tags; what is cut off at the end still counts.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<",
    re.S,
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
UNSEEN = frozenset("script style noscript template".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table select body article main section div".split())
NOT_TEXT = frozenset(
    "head script style noscript template iframe svg math object canvas button select textarea input nav aside "
    "footer menu xmp noembed noframes title".split()
)
# Elements, and words of class and id names, and roles, of parts that are not the article unless they hold most of it.
NAMED_PARTS = frozenset("form dialog header".split())
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar aside widget widgets nav navbar navigation menu "
    "breadcrumb breadcrumbs footer comment comments disqus reply replies respond discussion share sharing social "
    "related recommended newsletter subscribe subscription signup login search form pagination pager toolbar skip "
    "complementary contentinfo dialog".split()
)
PAGE_HEAD = frozenset("header masthead topbar".split())
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


BROADCAST_TOKENS = 1_000_000
ROOT = 0


@dataclass(frozen=True)
class Deduction:
    """A class belongs to a host's template if its tokens stand on ``share`` of the pages and on ``pages`` at least.

    Pages of a host with the same text outside menus and the like are copies and count as one page.

    On hosts without a template, articles are a page's main part if they hold ``mass`` of its text.
    """

    share: float = 0.3
    pages: int = 4
    mass: float = 0.6


@dataclass
class Element:
    name: str
    token: int
    dropped: bool = False
    inside: bool = False
    named: tuple[int, ...] = ()
    count: dict[str, int] = field(default_factory=dict)


def hashed(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)))


def never_article(name: str, attributes: str, inside: bool) -> bool:
    if name in NOT_TEXT:
        return True
    return (name not in ("body", "html", "article", "main") or inside) and bool(HIDDEN.search(attributes))


def named_part(name: str, attributes: str, inside: bool) -> bool:
    if name in NAMED_PARTS and not (name == "header" and inside):
        return True
    if not attributes or name in ("body", "html", "article", "main") and not inside:
        return False
    for found in NAMED.findall(attributes):
        words = set(WORDS.findall(CAMEL.sub(" ", "".join(found)).lower()))
        if words & NOT_ARTICLE or (words & PAGE_HEAD and not inside):
            return True
    return False


def marked(page: str) -> Iterator[tuple[str, int, int, bool, bool, tuple[int, ...]]]:
    """Tokens of a page in order: (kind, token, token of the element around, dropped, inside an article, named parts around).

    An element's token is a hash of its path with places among siblings of its name. Kinds are "tag",
    "break" (a block ends) and, for text with its references decoded, the text itself with a leading "=".
    """
    stack = [Element("", 0)]
    at, end = 0, len(page)
    while at < end:
        found = TOKEN.match(page, at)
        at = found.end()
        closing, name, attributes = found.groups()
        top = stack[-1]
        if name is None:
            text = found[0]
            if text.startswith(("<!", "<?")):
                continue
            if text != " " and not top.dropped or text.strip():
                text = entities.unescape(text)
                yield "=" + text, hashed(top.token, "text", " ".join(text.split())), top.token, top.dropped, top.inside, top.named
            else:
                yield "= ", 0, top.token, top.dropped, top.inside, top.named
            continue
        name = name.lower()
        if closing:
            if any(e.name == name for e in stack):
                while stack.pop().name != name:
                    pass
                if name not in INLINE and name not in UNSEEN:
                    yield "break", 0, 0, False, False, ()
            continue
        block = name not in INLINE and name not in UNSEEN
        if block:
            yield "break", 0, 0, False, False, ()
            if name not in VOID and any(e.name == "p" for e in stack):
                k = max(i for i, e in enumerate(stack) if e.name == "p")
                if not any(e.name in HOLDERS for e in stack[k:]):
                    del stack[k:]
            if name in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in HOLDERS:
                        break
                    if stack[k].name in CLOSES[name]:
                        del stack[k:]
                        break
        top = stack[-1]
        top.count[name] = nth = top.count.get(name, 0) + 1
        token = hashed(top.token, name, nth)
        yield "tag", token, top.token, top.dropped, top.inside, top.named
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path", "g"):
            continue
        inside = top.inside or name in ("article", "main")
        dropped = top.dropped or never_article(name, attributes, top.inside)
        named = (*top.named, token) if named_part(name, attributes, top.inside) else top.named
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        stack.append(Element(name, token, dropped, inside, named))


@dataclass
class Page:
    """``tokens`` as (kind, token, token of the element around, dropped, inside an article).

    ``total`` is the text outside elements that are never the article, ``parts`` that of each named part.
    """

    tokens: list[tuple[str, int, int, bool, bool]]
    total: int
    parts: dict[int, int]


def runs(page: str, spared: frozenset[int] = frozenset()) -> Page:
    """Tokens of a page, of which those in named parts are dropped.

    A name rules nothing out if its part is ``spared``, or holds most of the page's text: then it stands
    around the article. Beside an article it is ruled out all the same, as articles may be short.
    """
    found = list(marked(page))
    total = beside = 0
    parts: dict[int, int] = {}
    in_article: set[int] = set()
    for kind, token, _, dropped, inside, named in found:
        if kind[0] == "=" and token and not dropped:
            size = len("".join(kind[1:].split()))
            total += size
            beside += size if inside and not named else 0
            for part in named:
                parts[part] = parts.get(part, 0) + size
        elif kind == "tag" and inside:
            in_article.add(token)
    most = {p for p, size in parts.items() if 2 * size > total and (p in in_article or not beside)}
    ruled = parts.keys() - most - spared
    tokens = [(*t[:3], t[3] or any(part in ruled for part in t[5]), t[4]) for t in found]
    return Page(tokens, total, parts)


def main_text(
    page: str,
    template: frozenset[int] | None = None,
    how: Deduction = Deduction(),
    spared: frozenset[int] = frozenset(),
) -> str:
    """Text of the slots outside parts that are never the article; blocks of the template's own text alone are left out.

    All slots of a page are taken. Only without a template, where text that does not change is not known,
    the slots in articles are taken alone if they hold ``mass`` of the text.
    """
    fixed = template or frozenset()
    inner: list[str] = []
    every: list[str] = []
    held: list[str] = []
    own = within = False
    for kind, token, _, dropped, inside in [*runs(page, spared).tokens, ("break", 0, 0, False, False)]:
        if kind == "break":
            block = " ".join("".join(held).split())
            if own and block:
                every.append(block)
                if within:
                    inner.append(block)
            held, own, within = [], False, False
        elif kind[0] == "=" and not dropped:
            held.append(kind[1:])
            own = own or (token != 0 and token not in fixed)
            within = within or inside and token != 0
    alone = template is None and sum(map(len, inner)) >= how.mass * sum(map(len, every))
    return "\n".join(inner if alone else every)


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


TOKENS = "array<struct<token:long,parent:long,is_text:boolean,named:boolean,mass:int,n:int>>"


def tokens_of(page: Page) -> list[tuple]:
    """Distinct tokens of a page: token, element around, is text, is a named part, text in it if so, count."""
    seen: dict[int, list] = {ROOT: [ROOT, False, False, page.total, 1]}
    for kind, token, around, _, _ in page.tokens:
        if not token:
            continue
        if token in seen:
            seen[token][-1] += 1
        else:
            seen[token] = [around, kind[0] == "=", token in page.parts, page.parts.get(token, 0), 1]
    return [(token, *rest) for token, rest in seen.items()]


def body_of(page: Page) -> int:
    """A hash of the page's text outside menus and the like: equal for copies of one article."""
    texts = ("".join(kind[1:].split()) for kind, _, _, dropped, _ in page.tokens if kind[0] == "=" and not dropped)
    return hashed("".join(texts)) >> 1


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32())
    names = "token parent is_text named mass n".split()
    for batch in batches:
        texts = utf8(batch.column("html"))
        for a, b in blocks(texts):
            read = [runs((page or b"").decode("utf-8", "replace")) for page in texts[a:b]]
            pages = [tokens_of(page) for page in read]
            ends = pa.array(np.cumsum([0, *map(len, pages)]), pa.int32())
            columns = list(zip(*(t for page in pages for t in page), strict=True)) or [()] * len(kinds)
            columns[:2] = [signed(c) for c in columns[:2]]
            rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            part = [batch.column("host").slice(a, b - a), pa.array(map(body_of, read), pa.int64())]
            yield pa.RecordBatch.from_arrays([*part, pa.ListArray.from_arrays(ends, rows)], names=["host", "page", "tokens"])


def classes(pages: DataFrame, url: str, html: str, how: Deduction = Deduction()) -> DataFrame:
    """Tokens of the equivalence classes that are frequent on their host.

    Columns host (a hash), token, parent, is_text, named, mass, total (that of the host), support and vector: tokens of a host with equal vectors
    occur equally often on every page. Vectors are sums of a hash of page and count.
    Of copies on a host one is taken, as what only they share is their article.
    Rows of a host are spread by token, so that a host with a third of all pages is no hot group.
    """
    name, _ = host_and_path(F.col(f"`{url}`"))
    host = F.xxhash64(name).alias("host")
    rows = pages.select(host, F.col(f"`{html}`").alias("html"))
    found = arrow(rows, occurrences, f"host long, page long, tokens {TOKENS}")
    found = found.groupBy("host", "page").agg(F.min_by("tokens", F.xxhash64("tokens")).alias("tokens"))
    each = found.select("host", "page", F.inline("tokens"))
    by_token = each.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"),
        F.count("*").alias("support"),
        F.min("parent").alias("parent"),
        F.bool_or("is_text").alias("is_text"),
        F.bool_or("named").alias("named"),
        F.sum("mass").alias("mass"),
    )
    frequent = saved(by_token.where(F.col("support") >= how.pages), "frequent")
    # The root stands on every page.
    hosts = frequent.where(F.col("token") == ROOT).select("host", F.col("support").alias("pages"), F.col("mass").alias("total"))
    joined = frequent.where(F.col("token") != ROOT).join(hosts, "host")
    return joined.where(F.col("support") >= how.share * F.col("pages")).drop("pages")


def templates(tokens: DataFrame) -> DataFrame:
    """One row per host (host, template, spared).

    A class is valid if all its tokens stand in elements of the class itself or of one other class: then it is
    nested in a slot of that class. A text belongs to the template if its class is valid and the element
    around it is of the same class, that is, if the element never has another text.
    Named parts with most of the host's text are spared.
    """
    around = tokens.select("host", F.col("token").alias("parent"), F.col("vector").alias("outer"))
    nested = tokens.join(around, ["host", "parent"], "left").withColumn("outer", F.coalesce("outer", F.lit(0)))
    differs = F.when(F.col("outer") != F.col("vector"), F.col("outer"))
    valid = nested.groupBy("host", "vector").agg(
        (F.coalesce(F.min(differs), F.lit(0)) == F.coalesce(F.max(differs), F.lit(0))).alias("valid")
    )
    rows = nested.join(valid, ["host", "vector"])
    own = F.col("valid") & F.col("is_text") & (F.col("outer") == F.col("vector"))
    most = F.col("named") & (2 * F.col("mass") > F.col("total"))
    return rows.groupBy("host").agg(
        F.collect_set(F.when(own, F.col("token"))).alias("template"),
        F.collect_set(F.when(most, F.col("token"))).alias("spared"),
    )


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def page_texts(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", how: Deduction = Deduction()
) -> DataFrame:
    """Columns (id, url, text, n_chars) of every page.

    A host's template holds a bounded number of tokens, as each stands on a share of its pages. Hosts of
    few pages have none; their pages are read by their elements alone. Null and empty html give an empty
    text. Null urls and urls without a host are pages of one host. Repeated rows each give a row, a null
    id stays null, an empty table gives no rows, and other columns are not read.
    """
    name, _ = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(
        F.col(f"`{id_column}`").alias(id_column), F.col(f"`{url}`").alias(url), F.col(f"`{html}`").alias("page html"), F.xxhash64(name).alias("page host")
    )
    tokens = saved(classes(pages, url, html, how), "tokens")
    known = saved(templates(tokens).withColumnRenamed("host", "page host"), "templates")
    # The tokens decide: few templates go to all executors, and the pages need no shuffle.
    size = known.agg(F.coalesce(F.sum(F.size("template") + F.size("spared") + 1), F.lit(0))).first()[0]
    if size <= BROADCAST_TOKENS:
        known = F.broadcast(known)
    joined = rows.join(known, "page host", "left")
    joined = joined.select(f"`{id_column}`", f"`{url}`", "page html", "template", "spared")
    schema = T.StructType([*joined.schema.fields[:2], *RESULT.fields])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, frozenset[int]] = {}

        def tokens(found: list[int]) -> frozenset[int]:
            key = tuple(found)
            if key not in kept:
                if len(kept) > 1000:
                    kept.clear()
                kept[key] = frozenset(t % (1 << 64) for t in key)
            return kept[key]

        for batch in batches:
            texts = utf8(batch.columns[2])
            for a, b in blocks(texts):
                out = []
                known = [c.slice(a, b - a).to_pylist() for c in batch.columns[3:]]
                for page, template, spared in zip(texts[a:b], *known, strict=True):
                    fixed = None if template is None else tokens(template)
                    out.append(main_text((page or b"").decode("utf-8", "replace"), fixed, how, tokens(spared or [])))
                part = [c.slice(a, b - a) for c in batch.columns[:2]]
                made = [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part, *made], names=schema.names)

    return arrow(joined, extract, schema)


