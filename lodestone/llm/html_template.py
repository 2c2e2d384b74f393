"""HTML extraction by equivalence-class template deduction.

Tokens are elements (an opening and a closing tag) and whole texts between tags. A token's role is the path of elements
above it, each named by tag, class, id and the kind of its first child, so that siblings without names are told apart.
Tokens of one host's pages that occur equally often on every page (equal occurrence vectors) form an equivalence class;
a class is valid if it has enough tokens and pages. Elements of valid classes, which nest as elements do, make up the
host's template; the text between them fills its slots.

An element can hold the article if, on the pages that have it, it holds more than half of the slot text on average, links,
forms and marked asides (menus, adverts, comments) not counting. A page's article is the innermost of those that it has,
or the innermost that is tagged as article or main; the page's text inside it is the main text, with the heading if that
stands outside. Pages without such an element of their host's template are read by that of the whole corpus, and pages
that don't have that either by the same rule on their own elements.

Vectors are never built: a token's vector is told by the sum over pages of a hash of (page, count), which partial sums
combine before any shuffle, so one host may hold any share of the pages.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, join_unique
from lodestone.llm.textbatch import as_strings

#: A class needs this many pages and this many tokens.
MIN_PAGES = 3
MIN_TOKENS = 3
#: Templates are broadcast up to this many tokens in all, and joined by a salted shuffle beyond.
BROADCAST_TOKENS = 200_000
SALTS = 64
EVERYWHERE = ""
#: What every page's text counts for in all.
WHOLE = 1_000_000
#: A template element whose text is to this share links is a menu.
LINKED_PERCENT = 90

#: A tag whose quotes hold a < is read loosely; so no character is looked at again and again.
PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:"[^"<]*"|'[^'<]*'|[^'"><])*+)>|([^<]+)|<""", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(>?)")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMED = re.compile(r"class|id|role", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element that may not hold a block of its own kind ends where the next one begins.
SELF_ENDING = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements, and whole names in class, id or role, that mark what isn't the article.
ASIDE_TAGS = {"head", "nav", "menu", "header", "footer", "aside", "form", "button", "dialog", *RAW}
ASIDE_NAMES = re.compile(r"ads?|adverts?|advertisements?|banners?|sponsor(?:ed)?|promos?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|footers?|headers?|masthead|cookies?|consent|notices?|alerts?|popups?|modal|newsletter|subscribe|share|social|related|recommended|comments?|respond|disqus|replies|widgets?", re.I)
#: Elements that no name marks: the page itself and the article.
NEVER_ASIDE = {"html", "body", "main", "article"}
ARTICLE_TAGS = {"article", "main"}


#: Elements that can hold an article, and its heading.
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center", "table", "tbody", "tr", "fieldset", "figure", "details", "blockquote"}
HEADING = "h1"


def read(page: str) -> list[tuple[str, str, str]]:
    """Events (kind, name, text), kind being open, close or text and a name like div.ad; elements nest properly."""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, str]] = []
    inside: Counter = Counter()  # how many elements of a tag are open
    at, size = 0, len(page)

    def close() -> str:
        tag, name = stack.pop()
        inside[tag] -= 1
        out.append(("close", name, ""))
        return tag

    while at < size:
        m = PIECE.match(page, at)
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if m[0] == "<" and (loose := LOOSE.match(page, m.start())):
            # Quotes that don't pair: the tag ends at the next >, or else the page does.
            if not loose[4]:
                break
            closing, tag, attributes, at = loose[1], loose[2], loose[3], loose.end()
        if tag is None:
            if m[4] is not None or m[0] == "<":
                out.append(("text", "", m[0]))
            continue
        tag = tag.lower()
        if closing:
            if inside[tag]:
                while close() != tag:
                    pass
            elif tag in ("p", "br"):
                out += [("open", tag, ""), ("close", tag, "")]
            continue
        while stack and tag in SELF_ENDING.get(stack[-1][0], ()):
            close()
        if tag in BLOCK and inside["p"] and not inside["button"] and not inside["table"]:
            while close() != "p":  # inline elements left open in a paragraph end with it
                pass
        names = " ".join(next(filter(None, x[1:]), "") for x in ATTRIBUTE.findall(attributes) if x[0].lower() in ("class", "id", "role")) if "=" in attributes and NAMED.search(attributes) else ""
        name = f"{tag}.{names}" if names else tag
        out.append(("open", name, ""))
        if tag in VOID or attributes.endswith("/"):
            out.append(("close", name, ""))
            continue
        stack.append((tag, name))
        inside[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            stop = end.start() if end else size
            if stop > at:
                out.append(("text", "", page[at:stop]))
            at = end.end() if end else size
            close()
    while stack:
        close()
    return out


_SEEN: dict[tuple[int, str], int] = {}


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little") >> 1


def _mix(path: int, name: str) -> int:
    """A 63-bit hash of a path and a name; remembered, as pages repeat theirs."""
    got = _SEEN.get((path, name))
    if got is None:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        got = _SEEN[(path, name)] = _hash(f"{path}/{name}")
    return got


DIGITS = re.compile("[0-9]+")


def roles(events: list[tuple[str, str, str]]) -> list[int]:
    """The role of every event: an element's own for its tags, that of the element around it for a text."""
    out, stack = [], [0]
    for i, (kind, name, _) in enumerate(events):
        if kind == "open":
            k = i + 1
            while events[k][0] == "text" and events[k][2].isspace():
                k += 1
            first = "#" if events[k][0] == "text" else events[k][1].partition(".")[0] if events[k][0] == "open" else ""
            stack.append(_mix(stack[-1], f"{DIGITS.sub('0', name)}[{first}]"))
            out.append(stack[-1])
        elif kind == "close":
            out.append(stack.pop())
        else:
            out.append(stack[-1])
    return out


def asides(events: list[tuple[str, str, str]], role: list[int], known: frozenset[int] | set[int] | None) -> set[int]:
    """Where elements open that are cut: those of ASIDE_TAGS, and those with an aside name whose role is known as an aside.

    Without known asides (None) the name alone decides. A header in the article is the article's own. Where all articles
    of a page stand in elements that would be cut, these are not.
    """
    cut, holding, stack = set(), set(), []
    aside = article = 0
    free = False
    for i, (kind, name, _) in enumerate(events):
        if kind == "open":
            tag = name.partition(".")[0]
            if tag in ASIDE_TAGS:
                is_cut = not (article and tag == "header")
            else:
                is_cut = marked(name, article > 0) and (known is None or role[i] in known)
            if is_cut:
                cut.add(i)
                aside += 1
            if is_article(name):
                article += 1
                if aside:
                    for x in itertools.chain((i,), reversed(stack)):
                        if x in holding:
                            break
                        holding.add(x)
                else:
                    free = True
            stack.append(i)
        elif kind == "close":
            aside -= stack.pop() in cut
            article -= is_article(name)
    return cut if free else cut - holding


def marked(name: str, in_article: bool = False) -> bool:
    """Whether a whole name in an element's class, id or role says that it is an aside."""
    tag, _, names = name.partition(".")
    return bool(names) and tag not in NEVER_ASIDE and any(ASIDE_NAMES.fullmatch(x) and not (in_article and x.lower().startswith("header")) for x in names.split())


def is_article(name: str) -> bool:
    tag, _, names = name.partition(".")
    return tag in ARTICLE_TAGS or names == "main"


#: Kinds of tokens: other elements, elements that can hold an article, those tagged as one, headings, texts.
PLAIN, CONTAINER, ARTICLE, TITLE, TEXT = range(5)


@dataclass
class Token:
    """What a page says about one role: how often it occurs, how deep, its share of the page's slot text, and how much of its text is links."""

    kind: int
    depth: int
    marked: bool = False
    count: int = 0
    share: int = 0
    links: int = 0
    chars: int = 0


def _kind(name: str) -> int:
    tag = name.partition(".")[0]
    return ARTICLE if is_article(name) else CONTAINER if tag in CONTAINERS else TITLE if tag == HEADING else PLAIN


def page_tokens(events: list[tuple[str, str, str]], role: list[int], texts: bool = True) -> dict[int, Token]:
    """The tokens of a page by role; texts tells whether texts are tokens too."""
    cut = asides(events, role, None)
    tokens: dict[int, Token] = {}
    stack: list[tuple[Token, int, tuple[int, int, int]]] = []
    aside = links = 0
    chars = linked = slot = 0  # so far; an element's are what they grow by inside it
    for i, (kind, name, text) in enumerate(events):
        if kind == "open":
            token = tokens.get(role[i])
            if token is None:
                token = tokens[role[i]] = Token(_kind(name), len(stack), marked(name))
            token.count += 1
            stack.append((token, i, (chars, linked, slot)))
            aside += i in cut
            links += name == "a" or name.startswith("a.")
        elif kind == "close":
            token, at, before = stack.pop()
            aside -= at in cut
            links -= name == "a" or name.startswith("a.")
            token.chars += chars - before[0]
            token.links += linked - before[1]
            token.share += slot - before[2]
        elif body := text.strip():
            if texts:
                tokens.setdefault(_hash(f"{role[i]}={' '.join(body.split())}"), Token(TEXT, len(stack))).count += 1
            chars += len(body)
            linked += len(body) if links else 0
            slot += 0 if aside or links else len(body)
    for x in tokens.values():
        x.share = x.share * WHOLE // slot if slot else 0
    return tokens


def article_of(tokens: dict[int, Token], least: int = WHOLE // 2 + 1) -> int | None:
    """The role of the innermost element, or innermost tagged article, that holds so much of a page's slot text."""
    return max(((x.kind == ARTICLE, x.depth, t) for t, x in tokens.items() if x.kind in (CONTAINER, ARTICLE) and x.share >= least), default=(False, 0, None))[2]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "page", "token", "kind", "depth", "marked", "n", "filled", "share", "chars", "links"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 5]
    for batch in batches:
        rows: list[tuple] = []
        for host, key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_strings(batch.column(2)), strict=True):
            events = read(page.as_py())
            found = page_tokens(events, roles(events))
            filled = int(any(x.share for x in found.values()))
            rows.append((host, key, 0, PLAIN, -1, False, 1, filled, 0, 0, 0))  # role 0 is the page
            rows += [(host, key, t, x.kind, x.depth, x.marked, x.count, filled, x.share, x.chars, x.links) for t, x in found.items()]
            if len(rows) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; a null or hostless URL has the host `-`."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host == "", F.lit("-")).otherwise(host)


def templates(pages: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(host, mains, title, cuts, asides) from pages (host, page, html); host '' is the whole corpus.

    A class is the tokens of equal vector; an element is two tokens, its tags, and a text is one. It is valid with min_pages pages and min_tokens
    tokens. mains are the roles that can hold the article, title is that of a heading, cuts are menus and asides are
    marked elements, all of them elements of valid classes. Elements on a hundredth of the pages or more are listed, so a list is at most a
    hundred times as long as a page.
    """
    tokens = pages.mapInArrow(_tokens, "host string, page long, token long, kind int, depth int, marked boolean, n long, filled long, share long, chars long, links long")
    mark = F.xxhash64("page", "n").cast("decimal(38,0)")
    sums = lambda vector, support: [F.sum(vector).cast("decimal(38,0)").alias("vector"), F.sum(support).alias("support"), *[F.max(c).alias(c) for c in ("kind", "depth", "marked")], *[F.sum(c).alias(c) for c in ("filled", "share", "chars", "links")]]
    signed = scratch.put(tokens.groupBy("host", "token").agg(*sums(mark, F.lit(1))))
    everywhere = signed.groupBy("token").agg(*sums("vector", "support")).select(F.lit(EVERYWHERE).alias("host"), *signed.columns[1:])
    both = scratch.put(signed.unionByName(everywhere).where((F.col("support") >= min_pages) | (F.col("token") == 0)))
    scratch.drop(signed)
    size = F.sum(F.when(F.col("kind") == TEXT, 1).otherwise(2))
    valid = both.where(F.col("token") != 0).groupBy("host", "vector", "support").agg(size.alias("size")).where(F.col("size") >= min_tokens).select("host", "vector", "support")
    totals = both.where(F.col("token") == 0).select("host", F.col("support").alias("pages"))
    nodes = scratch.put(both.where((F.col("token") != 0) & (F.col("kind") != TEXT)).join(valid, ["host", "vector", "support"]))
    nodes = join_unique(nodes, totals, ["host"])
    heavy = F.col("kind").isin(CONTAINER, ARTICLE) & (F.col("share") * 2 > F.col("filled") * WHOLE)
    often = F.col("support") * 100 >= F.col("pages")
    menu = (F.col("chars") > 0) & (F.col("links") * 100 >= F.col("chars") * LINKED_PERCENT) & (F.col("support") * 2 > F.col("pages"))
    return scratch.put(nodes.groupBy("host").agg(
        F.collect_set(F.when(often & heavy, F.col("token"))).alias("mains"),
        F.max(F.when((F.col("kind") == TITLE) & (F.col("support") * 2 > F.col("pages")), F.struct("support", "token")))["token"].alias("title"),
        F.collect_set(F.when(menu, F.col("token"))).alias("cuts"), F.collect_set(F.when(often & F.col("marked"), F.col("token"))).alias("asides"),
    ))


@dataclass(frozen=True)
class Template:
    mains: frozenset[int] = frozenset()
    title: int | None = None
    cuts: frozenset[int] = frozenset()
    asides: frozenset[int] = frozenset()


def main_text(page: str, own: Template | None, corpus: Template | None = None) -> str:
    """The text of the article's slots, one block a line.

    The article is the element that the host's template names, or else the corpus's, or else the innermost one that holds
    more than half of the page's own slot text. Menus of the template and asides() inside it hold no main text; markup
    parts blocks or vanishes whether or not it belongs to the template.
    """
    events = read(page)
    role = roles(events)
    tokens = page_tokens(events, role, texts=False)
    known = [x for x in (own, corpus) if x]
    main = next(filter(None, (article_of({t: tokens[t] for t in x.mains if t in tokens}, 0) for x in known)), None)
    title = next((x.title for x in known if x.title in tokens), None)
    if main is None:
        main = article_of(tokens)
        title = next((t for t, x in tokens.items() if x.kind == TITLE), None)
    cut = asides(events, role, frozenset().union(*[x.asides for x in known]) if known else None)
    menus = known[0].cuts if known else frozenset()
    blocks: list[str] = []
    line: list[str] = []
    stack: list[int] = []
    aside = inside = 0
    heading = any(r == title for r in _roles_inside(events, role, main)) if main is not None else True

    def flush() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    for i, (kind, name, text) in enumerate(events):
        if kind == "text":
            if not aside and (inside or main is None):
                line.append(text)
            continue
        tag = name.partition(".")[0]
        step = 1 if kind == "open" else -1
        if kind == "open":
            stack.append(i)
        at = i if kind == "open" else stack.pop()
        if tag == "br":
            line.append(" ")
            continue
        if tag in BLOCK:
            flush()
        aside += step if at in cut or role[at] in menus and role[at] != main else 0
        inside += step if role[at] == main or not heading and role[at] == title else 0
    flush()
    return "\n".join(blocks)


def _roles_inside(events: list[tuple[str, str, str]], role: list[int], main: int) -> Iterator[int]:
    depth = 0
    for (kind, _, _), r in zip(events, role, strict=True):
        if kind != "text" and r == main:
            depth += 1 if kind == "open" else -1
        elif kind == "open" and depth:
            yield r


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    A null or empty page has an empty text; a null url belongs to the host `-`; repeated rows count as pages of their own
    and get the same text; an empty table gives an empty result; other columns are ignored; pages are read whole.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    found = templates(rows.select("host", F.xxhash64("page_id", "url", F.col("html")).alias("page"), "html"), scratch)
    scratch.drop_all_but(found)
    known = found.select("host", F.struct("mains", "title", "cuts", "asides").alias("template"))
    tokens = F.sum(F.size("mains") + F.size("cuts") + F.size("asides") + 4)
    size = found.agg(F.coalesce(tokens, F.lit(0))).first()[0]
    corpus = [_template(r["template"].asDict()) for r in known.where(F.col("host") == EVERYWHERE).collect()]
    own = known.where(F.col("host") != EVERYWHERE)
    if size <= broadcast_tokens:
        joined = rows.join(F.broadcast(own), "host", "left")
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = salted.join(spread, ["host", "__salt"], "left")
    fallback = corpus[0] if corpus else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Template | None] = {}
        for batch in batches:
            texts = []
            for host, page, template in zip(batch.column(2).to_pylist(), as_strings(batch.column(3)), batch.column(4), strict=True):
                if host not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[host] = _template(template.as_py())
                texts.append(main_text(page.as_py(), seen[host], fallback))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    id_type = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def _template(row: dict | None) -> Template | None:
    return Template(frozenset(row["mains"]), row["title"], frozenset(row["cuts"]), frozenset(row["asides"])) if row else None
