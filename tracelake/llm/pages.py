"""Operator 6: main text of HTML pages by equivalence classes of template tokens.

1. tokens: every page is cut into the starts and ends of its elements (with the path of open elements, their class, and for
   containers which one of their kind they are in their parent: a menu, an article and a footer may all be plain divs) and
   whole text blocks with their path. For each host, a token's occurrence vector (how often it is on each page) is folded into
   a signature, a sum of hash(page, count), and a support, for which equal pages of a host count once. Both are aggregated
   map-side, so a host with a third of all pages is no hot spot.
2. classes: tokens of one host with one signature form an equivalence class. It can be valid if it is large (two tokens or
   more) and frequent (half of the host's pages, of three pages at least). The largest class of tokens that are once on a page
   is the root. A second look at the pages keeps a class only if it is ordered (on every page its tokens come round in one
   order, as often as they occur) and nests (each round lies in one gap of the root's tokens, the same on every page).
   Valid classes, the root with the others in its gaps, are the host's template.
3. slots: a text block that is in the template is boilerplate, inside articles as well, but a heading never is. What is left are
   slots between template tokens. The host's main element is the deepest one of the root that holds ``MAIN`` of the words in all
   slots of all pages (links and what is declared to be apart not counted). A page's article is the slots in that element, in
   the <article> it is in or holds, and in its parents below the body up to the farthest that has a heading of its own: titles
   and leads stand beside the body of an article as often as inside. Slots outside articles that are mostly links, over all
   pages, go. Where a host has too few pages for a template, or no such element, the article is what <article> or <main> holds, else all slots.
4. declared: never in the text are what tags, roles or whole class names declare to be menu, header, footer, sidebar, notice,
   advert, form or comments (never a heading or paragraph by its name).

Templates are broadcast only below ``BROADCAST_ROWS`` tokens; else pages are joined with them by host, and a hot host's
pages meet its template by adaptive skew handling. Sizes of a template follow the pages' markup, not the number of pages.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined by one
\\n. Defined cases: null or empty html gives an empty text; a null url is a host of its own; html may be cut off
anywhere or be nested wrongly; a quote that does not end before white space or the end of a tag is no quote; a tag cut off by
the end of the page is markup; a null id stays null; repeated rows are pages each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, materialize, slices, small_batches

#: Pages of a host, share of them, and tokens that make a class valid.
LEAST_PAGES, SUPPORT, LEAST_TOKENS = 3, 0.5, 2
#: Share of a host's words that its main element holds.
MAIN = 0.8
BROADCAST_ROWS = 200_000
# Elements of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
APART = set("nav footer aside form script style noscript template iframe button select textarea svg math object audio video canvas head dialog menu title".split())
ROLES = set("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
CLASSES = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin search share sharing social related recommended recommendations widget pagination pager toolbar copyright hidden".split())
SITE_CLASSES = set("header masthead topbar".split())
#: Words that may stand beside those of CLASSES in one class name (main-nav, comment-list); with any other it means something else (has-sidebar).
PLACES = set("site page main global top bottom left right primary secondary user list box block section area wrapper wrap container inner outer item bar link links text form".split())
#: Elements that stand side by side in different roles, so that their places tell them apart.
CONTAINERS = set("div section article main aside nav header footer form ul ol dl table fieldset".split())
HEADINGS = ("/h1", "/h2", "/h3", "/h4", "/h5", "/h6")
#: Elements that no name drops.
TEXTUAL = set("html body main p h1 h2 h3 h4 h5 h6".split())
#: An open element of the key is closed by the start of one of the value.
CLOSES = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
QUOTED = r"""(?:[^>"']++|"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|["'])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({QUOTED})(>|\Z)|<[^<]*|[^<]+", re.S)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    if tag in APART or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if hidden or name == "style" and "display:none" in value.replace(" ", "") or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in TEXTUAL:
            known = {"comment"} if tag == "article" and name == "class" else set() if tag == "article" else CLASSES if inside else CLASSES | SITE_CLASSES
            if any(_named(x, known) for x in (a or b or c).split()):
                return True
    return False


def _named(token: str, known: set[str]) -> bool:
    """A whole class name or id that says one of the known words, and nothing that could turn it."""
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))
    return bool(words & known) and (len(words) == 1 or words <= known | PLACES)


Block = tuple[str, str, bool, int, int, int, tuple[str, ...]]


def parse(html: str) -> list[str | Block]:
    """In page order: starts and ends of elements as tokens, and blocks: (path, text, set apart, number of the article that it
    is in or 0, words in links, words, tokens of the open elements). A container's token says which one of its kind it is in its parent."""
    events: list[str | Block] = []
    stack: list[tuple[str, bool, int, str, str, Counter[str]]] = []  # name, apart, inside, path, token, containers in it
    text: list[str] = []
    linked = total = links = at = articles = 0
    outermost: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked, total
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                _, apart, inside, path, _, _ = stack[-1] if stack else ("", False, 0, "", "", outermost)
                events.append((path, line, apart, inside, linked, total, tuple(x[4] for x in stack)))
            text.clear()
        linked = total = 0

    def close(k: int) -> None:
        nonlocal links
        if any(x[0] in BLOCK for x in stack[k:]):
            flush()
        for x in reversed(stack[k:]):
            events.append("/" + x[4])
            links -= x[0] == "a"
        del stack[k:]

    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        whole, tag = m[0], m[2]
        if tag is None:
            if whole[0] != "<" or whole[1:2] not in ("!", "?", "/") and not whole[1:2].isalpha():
                text.append(whole)
                n = len(whole.split())
                total += n
                linked += n if links else 0
            continue
        tag = tag.lower()
        if not m[4]:  # cut off inside a tag: go on where the next one starts
            at = html.find("<", m.start() + 1)
            at = at if at > 0 else len(html)
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        while stack and tag in CLOSES.get(next((x[0] for x in reversed(stack) if x[0] in CLOSES), ""), ()):
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in CLOSES)
            if any(x[0] in ("table", "ul", "ol", "dl", "div", "article", "section", "body") for x in stack[k + 1 :]):
                break
            close(k)
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th", "option"):
            text.append(" ")
        _, above, inside, path, within, siblings = stack[-1] if stack else ("", False, 0, "", "", outermost)
        apart = above or _apart(tag, m[3], bool(inside))
        path += "/" + tag
        named = CLASS.search(m[3]) if m[3] else None
        token = f"{within}/{tag}.{named[2].lower()}" if named else f"{within}/{tag}"
        if tag in CONTAINERS:
            siblings[token] += 1
            token = f"{token}[{siblings[token]}]"
        events.append(token)
        if tag in RAW and (end := RAW_END[tag].search(html, at) or (tag in ("script", "style") and re.compile(r"\Z").search(html, at))):
            at = end.end()
        elif tag not in VOID and tag not in RAW:
            if not inside and (tag in ("article", "main") or 'role="main"' in m[3]):
                articles += 1
                inside = articles
            stack.append((tag, apart, inside, path, token, Counter()))
            links += tag == "a"
    flush()
    return events


CLASS = re.compile(r"""\bclass\s*=\s*(["']?)([\w -]{1,60})\1""")


def _hash(path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}") - (1 << 63)


def tokens_of(events: list[str | Block]) -> list[int]:
    return [_hash(e) if isinstance(e, str) else _hash(e[0], e[1]) for e in events]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, w, token, n, shape): token 0 is the page itself, w its share of equal pages of the host; shape: a tag."""
    for b in slices(batches, column="html"):
        hosts, pages, shares, tokens, counts = [], [], [], [], []
        for host, html, w in zip(*(c.to_pylist() for c in b.columns)):
            found = Counter(tokens_of(parse(html)))
            found[0] = 1
            name = xxhash.xxh64_intdigest(html) - (1 << 63)
            hosts += [host] * len(found)
            pages += [name] * len(found)
            shares += [w] * len(found)
            tokens += found.keys()
            counts += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(shares, pa.float64()), pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["host", "page", "w", "token", "n"])


def page_look(html: str, classes: dict[int, int], sizes: dict[int, int], root: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """What a page says of its host's classes: (class, hash of the order of its tokens or 0, gap of the root or -1), and of its
    slots: (token before it, linked words, words, 0), and (token of a root's element, 0, plain words in it, 1)."""
    events = parse(html)
    tokens = tokens_of(events)
    order: dict[int, list[int]] = {}
    gaps: dict[int, list[int]] = {}
    slots: Counter[tuple[int, int]] = Counter()
    inner: Counter[int] = Counter()
    gap = before = plain = 0
    for e, t in zip(events, tokens):
        c = classes.get(t)
        if c is not None:
            before = t
            gap += c == root
            order.setdefault(c, []).append(t)
            gaps.setdefault(c, []).append(gap)
        elif not isinstance(e, str):
            _, _, apart, _, linked, words, above = e
            slots[before, 0] += linked
            slots[before, 1] += words
            if not apart:
                plain += words - linked
                for x in set(above):
                    if classes.get(h := _hash(x)) == root:
                        inner[h] += words - linked
    seen = []
    for c, ts in order.items():
        n = sizes[c]
        rounds = [tuple(ts[i : i + n]) for i in range(0, len(ts), n)]
        ordered = len(ts) % n == 0 and len(set(rounds)) == 1 and len(set(rounds[0])) == n
        nests = c == root or all(len(set(gaps[c][i : i + n])) == 1 for i in range(0, len(ts), n)) and len(set(gaps[c])) == 1
        seen.append((c, _hash(str(rounds[0])) if ordered else 0, (0 if c == root else gaps[c][0]) if nests else -1))
    found = [(t, slots[t, 0], slots[t, 1], 0) for t in {t for t, _ in slots}]
    return seen, found + [(t, 0, n, 1) for t, n in inner.items()] + [(0, 0, plain, 1)]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _classes(rows: DataFrame) -> DataFrame:
    """(host, classes array<struct<token, class>>, root): frequent and large classes, and the largest that is once on a page."""
    copies = materialize(rows.groupBy("host", "key").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    few = copies.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(copies) if few else copies, ["host", "key"], "left").select("host", "html", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("w"))
    seen = rows.mapInArrow(_tokens, "host string, page long, w double, token long, n long")
    vectors = seen.groupBy("host", "token").agg(F.round(F.sum("w"), 6).alias("support"), F.sum(F.shiftright(F.xxhash64("page", "n"), 31)).alias("class"), F.max("n").alias("most"))
    vectors = materialize(vectors.where(F.col("support") >= LEAST_PAGES), "vectors")
    sizes = vectors.where("token = 0").select("host", F.col("support").alias("pages"))
    frequent = vectors.where("token <> 0").join(sizes, "host").where(F.col("support") >= SUPPORT * F.col("pages"))
    large = frequent.groupBy("host", "class", "support").agg(F.count("*").alias("tokens"), F.max("most").alias("most")).where(F.col("tokens") >= LEAST_TOKENS)
    once = F.when(F.col("most") == 1, F.struct("tokens", "support", "class"))
    roots = large.groupBy("host").agg(F.max(once).getField("class").alias("root"))
    found = frequent.join(large.select("host", "class", "support"), ["host", "class", "support"], "left_semi").groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("classes"))
    found = materialize(found.join(roots, "host"), "classes")
    discard(vectors, copies)
    return found


def _beside(rows: DataFrame, found: DataFrame, tokens: Column) -> DataFrame:
    """Pages with what is known of their host: broadcast if that is small."""
    small = (found.agg(F.sum(tokens)).first()[0] or 0) <= BROADCAST_ROWS
    return rows.join(F.broadcast(found) if small else found, "host", "left")


LOOK = "host string, what int, name long, a long, b long"


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What 0: a class, its order and gap; 1: a slot, its linked words and words; 2: an element, its plain words."""
    host_now, known = None, None
    for b in slices(batches, column="html"):
        rows: Counter[tuple] = Counter()
        sums: dict[tuple[str, int, int], list[int]] = {}
        for host, html, found, root in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("classes"), b.column("root").to_pylist()):
            if host_now != host:
                known = {x["token"]: x["class"] for x in found.as_py() or ()}
                sizes, host_now = Counter(known.values()), host
            if not known:
                continue
            seen, slots = page_look(html, known, sizes, root)
            rows.update((host, 0, c, order, gap) for c, order, gap in seen)
            for t, linked, words, what in slots:
                x = sums.setdefault((host, 1 + what, t), [0, 0])
                x[0] += linked
                x[1] += words
        out = [*rows, *((*k, *v) for k, v in sums.items())]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["host", "what", "name", "a", "b"])


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template, marks, links, inner), arrays of long: tokens of valid classes; all that part slots; those before slots of
    links; and of the root's elements that hold ``MAIN`` of the host's words."""
    small_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("key", F.xxhash64("html"))
    classes = _classes(rows)
    looks = _beside(rows.select("host", "html"), classes, F.size("classes")).where("classes is not null").select("host", "html", "classes", "root").mapInArrow(_looks, LOOK)
    looks = materialize(looks.groupBy("host", "what", "name").agg(F.min("a").alias("a"), F.max("a").alias("most_a"), F.min("b").alias("b"), F.max("b").alias("most_b"), F.sum(F.when(F.col("what") > 0, F.col("a"))).alias("sum_a"), F.sum(F.when(F.col("what") > 0, F.col("b"))).alias("sum_b")), "looks")
    valid = looks.where("what = 0 and a = most_a and a <> 0 and b = most_b and b >= 0").groupBy("host").agg(F.collect_set("name").alias("valid"))
    linked = looks.where("what = 1 and 2 * sum_a > sum_b").groupBy("host").agg(F.collect_set("name").alias("links"))
    inner = looks.where("what = 2 and name <> 0").select("host", "name", "sum_b").join(looks.where("what = 2 and name = 0 and sum_b > 0").select("host", F.col("sum_b").alias("total")), "host")
    inner = inner.where(F.col("sum_b") >= MAIN * F.col("total")).groupBy("host").agg(F.collect_set("name").alias("inner"))
    out = classes.join(valid, "host").join(linked, "host", "left").join(inner, "host", "left")
    in_valid = F.filter("classes", lambda x: F.array_contains("valid", x["class"]))
    empty = F.array().cast("array<long>")
    return out.select("host", F.transform(in_valid, lambda x: x["token"]).alias("template"), F.transform("classes", lambda x: x["token"]).alias("marks"), F.coalesce("links", empty).alias("links"), F.when(F.array_contains("valid", F.col("root")), F.coalesce("inner", empty)).otherwise(empty).alias("inner"))


def article(html: str, template: set[int], marks: set[int] = frozenset(), links: set[int] = frozenset(), inner: set[int] = frozenset()) -> str:
    """marks: tokens that part slots; links: those before slots of links; inner: tokens of the elements that hold most of the
    host's words. The deepest of them on the page is the article, with the whole <article> that it is in or holds, and with
    what leads up to it: its parents up to the farthest one, below the body, that has a heading of its own."""
    kept: list[tuple[Block, bool]] = []
    before = 0
    for e in parse(html):
        t = _hash(e) if isinstance(e, str) else _hash(e[0], e[1])
        before = t if t in marks else before
        if not isinstance(e, str) and not e[2] and (t not in template or e[0].endswith(HEADINGS)):
            kept.append((e, before in links))
    main = max(((k, e[6][:k]) for e, _ in kept for k, x in enumerate(e[6], 1) if _hash(x) in inner), default=(0, ()))[1] if inner else ()
    if not main:
        tagged = any(e[3] for e, _ in kept)
        return "\n".join(e[1] for e, of_links in kept if e[3] or not tagged and not of_links)
    whole = {e[3] for e, _ in kept if e[6][: len(main)] == main} - {0}
    for e, _ in kept:
        if e[0].endswith(HEADINGS) and e[6][: len(main)] != main:
            shared = next((k for k, (x, y) in enumerate(zip(e[6], main)) if x != y), min(len(e[6]), len(main)))
            if shared >= len(e[6]) - 1 and shared > 2:  # its own parent is one of the article's, below html and body
                main = main[:shared]
    return "\n".join(e[1] for e, of_links in kept if e[3] in whole or e[6][: len(main)] == main and not (of_links and not e[3]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each page."""
    found = materialize(templates(pages, id_col, url_col, html_col), "templates")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = _beside(rows, found, F.size("marks")).select("page_id", "url", "host", "html", "template", "marks", "links", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[set[int]]] = {}
        for b in slices(batches, column="html"):
            out = []
            for host, html, *found in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), *(b.column(c) for c in ("template", "marks", "links", "inner"))):
                if host not in known:
                    if len(known) > 100:
                        known.clear()
                    known[host] = [set(x.as_py() or ()) for x in found]
                out.append(article(html, *known[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
