"""HTML extraction by wrappers: union-free regular expressions inferred per host.

Every page becomes a stream of block tags and text runs with the tags balanced. Streams of one host
are aligned with the host's wrapper: where stream and wrapper differ, what comes again behind itself
becomes repeated, alone or as a group, what one of them lacks becomes optional, and text that differs
becomes a slot. Alignment adds up counts, places and sets of titles, so that pages give one wrapper in
whatever order and partitions they come. Nothing here recurses, so that any depth is read.

Wrappers are inferred in each task from its own pages; the tasks' wrappers are then aligned with each
other, some of a host's at a time and then those, so that a host of any size sends wrappers and never
its pages, and a task holds one wrapper of a host. A wrapper keeps every kind of element of its host's
pages, however rare: its memory grows with their number. Large wrappers are sent ahead of their host's
pages, once for every PAGES of them.

Every page is then read through its host's wrapper. The article is found by descent from the root, into
the child whose slots, texts that differ between the host's pages, hold most of the words in all pages
of the host, as long as one does. Where on that way the article begins is said by the innermost element
that the host marks (article, main, or a name like article-body), or, if none is on the way, by a marked
one that holds slots; without any such mark the article is where the descent ends. Sibling items of that kind belong to
it. Texts that the wrapper found to be the same on pages of TITLES or more titles (copies share their
title) are the template's and left out, but for headings and repeated groups, in a marked article only
those that none of its pages lacks. Menus, headers, footers, sidebars, notices, adverts, forms and reader
comments that are items of the article, whose words can differ from page to page as its own do, are known
by their element, and last by whole classes and roles, which never speak of html, body, main or article;
compounds count if each part is such a name.

Defined cases: null or empty html, and html without text, give an empty text; html that ends early or
is badly nested is read as far as it goes, however deep; a url without a host belongs to the host '';
repeated rows give a row each; null ids and urls stay null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import prepare
from presslake.session import checkpoint, read

#: Titles of the pages that share a text before it can be the template's.
TITLES = 3
#: Items of a wrapper that ``pruned`` shows, items of all wrappers of a task before it hands them on, and parts in which a host's wrappers are aligned first.
ITEMS, HELD, PARTS = 200_000, 100_000, 64
#: Share of the words that one child must hold for the descent to go on.
MOST = 0.6
#: Bytes of all wrappers up to which they are broadcast; beyond it they meet their hosts' pages by a shuffle, about so many pages at a time.
BROADCAST_BYTES, PAGES = 8 << 20, 4096

#: Elements (fixed values).
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style noscript template iframe svg textarea select button canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav aside footer form menu dialog head title".split())
WHOLE = frozenset("html body main article".split())
#: Elements that the descent doesn't go into.
LEAVES = HEADINGS | frozenset("p pre blockquote ul ol table dl".split())
#: An opening tag ends an open element of these names that it cannot stand in, up to a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head", "title"}}
CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "body": {"html"}}
#: Classes and roles that name what isn't the article, alone or joined by - or _ with each other or with PLAIN words.
NAMED_OUT = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay share sharing social breadcrumb breadcrumbs pagination pager related recommended recommendations menu navbar nav navigation footer comment comments disqus reply replies respond widget widgets toolbar masthead skip paywall login search complementary contentinfo".split())
PLAIN = frozenset("area articles bar block box btn button buttons container form icons inner items links list posts slot stories top bottom unit wrap wrapper".split())
#: Those that alone leave an element of an article out; the others can name its sections (search, related, notice, reply).
INSIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar newsletter subscribe signup popup modal overlay breadcrumb breadcrumbs pagination pager navbar nav navigation comments disqus widget widgets toolbar masthead paywall contentinfo".split())
NAMED_IN = frozenset("articlebody article-body article-content post-content entry-content story-body main-content post-body article__body".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DIGITS = re.compile(r"\d+")


class Item:
    """An element or a text, of a page or, aligned over many, of a wrapper.

    ``key`` is tag and names ("" for text), ``n`` how often it came, ``rep`` whether it follows itself, ``again``
    whether it is in a group that does, ``at`` the sum of its places among its siblings, ``text`` a page's text,
    ``mark`` the text's checksum (None is a slot), ``titles`` those of the pages with that text, ``words`` its words.
    """

    __slots__ = ("key", "tag", "out", "marked", "inside", "n", "rep", "again", "at", "kids", "text", "mark", "titles", "words")

    def __init__(self, key: str, tag: str, out: bool = False, marked: bool = False, inside: bool = False):
        self.key, self.tag, self.out, self.marked, self.inside = key, tag, out, marked, inside
        self.n, self.rep, self.again, self.at, self.kids = 1, False, False, None, []
        self.text, self.mark, self.titles, self.words = None, None, (), 0


def _names_out(name: str, inside: bool) -> bool:
    """Whether a class or role names what isn't the article; ``inside``: it stands in an article."""
    parts = [part for part in re.split(r"[-_]+", name) if part]
    if len(parts) == 1:
        return parts[0] in (INSIDE if inside else NAMED_OUT)
    return any(part in NAMED_OUT for part in parts) and all(part in NAMED_OUT or part in PLAIN or part.isdigit() for part in parts)


def _element(tag: str, attributes: str, inside: bool) -> Item:
    names, out, marked, within = [], tag in OUT, tag in ("article", "main"), inside or tag == "article"
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden":
                out = out or value != "until-found"
            elif name == "aria-hidden":
                out = out or value == "true"
            elif name == "id":
                continue
            else:
                words = value.split()
                named = any(w in NAMED_IN for w in words)
                marked = marked or named or value == "main" and name == "role"
                within = within or named
                out = out or name != "itemprop" and tag not in WHOLE and any(_names_out(w, inside) for w in words)
                if tag not in WHOLE:  # a page has one of these, whatever it is called
                    names += [f"{'.' if name == 'class' else '@'}{DIGITS.sub('0', w)}" for w in words]
    return Item(tag + "".join(sorted(names)), tag, out, marked, within)


def parse(text: str) -> Item:
    """The page's stream as a balanced tree of block elements; text runs keep their inline text, with character references decoded."""
    root = Item("#root", "#root")
    stack, run, at, end = [root], [], 0, len(text)
    opened: Counter[str] = Counter()
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            if joined := " ".join(html.unescape("".join(run)).split()):
                own = Item("", "")
                own.text, own.words = joined, max(0, joined.count(" ") + 1 - linked)
                stack[-1].kids.append(own)
            run.clear()
        linked = 0

    def close(tag: str) -> None:
        while stack[-1].tag != tag:
            opened[stack.pop().tag] -= 1
        opened[stack.pop().tag] -= 1

    while at < end:
        m = TOKEN.search(text, at)
        piece = text[at : m.start() if m else end]
        if piece:
            run.append(piece)
            linked += piece.count(" ") + 1 if links > 0 else 0
        if not m:
            break
        at = m.end()
        if not (tag := m[2]):
            if m[0].startswith("<![CDATA["):
                run.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                if opened[tag]:
                    flush()
                    close(tag)
                elif tag == "p":
                    flush()
                links = 0
            elif tag == "a":
                links = 0
            continue
        if tag in RAW:
            shut = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = shut.end() if shut else end
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            links = 1
        if tag not in BLOCKS:
            continue
        flush()
        while stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:  # no block stands in a paragraph
            opened[stack.pop().tag] -= 1
        if tag in ENDS and any(opened[t] for t in ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CONTAINERS[tag]:
                    break
                if stack[i].tag in ENDS[tag]:
                    for gone in stack[i:]:
                        opened[gone.tag] -= 1
                    del stack[i:]
                    break
        own = _element(tag, m[3], stack[-1].inside)
        stack[-1].kids.append(own)
        if tag not in VOID:
            stack.append(own)
            opened[tag] += 1
    flush()
    return root


def walk(root: Item) -> Iterator[Item]:
    """All items under ``root`` in the order of the stream."""
    stack = [root]
    while stack:
        own = stack.pop()
        yield own
        stack += reversed(own.kids)


def marked_page(page: Item) -> Item:
    """The page's texts as checksums, with its title's."""
    title = next((k.text for own in walk(page) if own.tag == "title" for k in own.kids if k.text), "")
    titles = (zlib.crc32(title.encode("utf-8", "replace")),)
    for own in walk(page):
        if own.text is not None:
            own.mark, own.titles = zlib.crc32(own.text.encode("utf-8", "replace")), titles
    return page


def align(wrapper: Item, other: Item) -> None:
    """Aligns the stream ``other``, a page's or a wrapper's, with ``wrapper``, element by element.

    A child goes on with the wrapper's item of its key, or opens one; what follows itself, alone or with others
    between, becomes repeated, what one side lacks optional by its count, texts that differ a slot. Counts, places
    and titles are sums and sets, so that streams give one wrapper in whatever order they come.
    """
    work = [(wrapper, other)]
    while work:
        own, new = work.pop()
        known = {k.key: k for k in own.kids}
        places: dict[str, int] = {}
        last: dict[str, int] = {}
        before, group = None, -1
        for i, child in enumerate(new.kids):
            rank = places.setdefault(child.key, len(places))
            if (into := known.get(child.key)) is None:
                into = known[child.key] = Item(child.key, child.tag, child.out, child.marked, child.inside)
                into.n, into.at, into.mark, into.titles = 0, 0, child.mark, child.titles
                own.kids.append(into)
            into.at += rank if child.at is None else child.at
            into.n += child.n
            into.rep |= child.rep or before == child.key
            into.again |= child.again
            if before != child.key and child.key in last:  # it comes again behind others: they are a group
                for between in new.kids[max(last[child.key], group) : i + 1]:
                    known[between.key].again = True
                group = i
            before, last[child.key] = child.key, i
            into.words += child.words
            if into.mark != child.mark:
                into.mark, into.titles = None, ()
            elif into.mark is not None:
                into.titles = tuple(sorted({*into.titles, *child.titles})[:TITLES])
            if child.kids:
                work.append((into, child))


def ordered(kids: list[Item]) -> list[Item]:
    """A wrapper's items by their mean place."""
    return sorted(kids, key=lambda k: (k.at / k.n, k.key))


def pruned(wrapper: Item) -> Item:
    """The wrapper's ITEMS commonest items, by their path where counts are equal: a view of it for people. Pages are read through whole wrappers."""
    items, of = [], {id(wrapper): wrapper.n}
    for own in walk(wrapper):
        items.append(own)
        for k in own.kids:  # no item counts for more than its parent, so that parents stay
            of[id(k)] = min(k.n, of[id(own)])
    if len(items) <= ITEMS:
        return wrapper
    stay = {id(own) for own in sorted(items, key=lambda own: -of[id(own)])[:ITEMS]}
    for own in items:
        own.kids = [k for k in own.kids if id(k) in stay]
    return wrapper


def written(wrapper: Item) -> str:
    """The wrapper's items in order, each with its depth."""
    rows, stack = [], [(wrapper, 0)]
    while stack:
        own, depth = stack.pop()
        rows.append([depth, own.key, own.tag, own.out, own.marked, own.n, own.rep, own.again, own.at, own.mark, own.titles, own.words])
        stack += [(k, depth + 1) for k in reversed(ordered(own.kids))]
    return json.dumps(rows)


def restored(text: str) -> Item:
    path: list[Item] = []
    for depth, key, tag, out, marked, n, rep, again, at, mark, titles, words in json.loads(text):
        own = Item(key, tag, out, marked)
        own.n, own.rep, own.again, own.at, own.mark, own.titles, own.words = n, rep, again, at, mark, tuple(titles), words
        del path[depth:]
        if path:
            path[-1].kids.append(own)
        path.append(own)
    return path[0]


def expression(wrapper: Item) -> str:
    """The wrapper as text: ? optional, + repeated, (a b)+ a repeated group, # a slot, 'crc' a constant text."""
    out, stack = [], [(wrapper, wrapper.n, False)]
    while stack:
        own, of, done = stack.pop()
        if isinstance(own, str):
            out.append(own)
        elif done:
            sign = ("*" if own.rep else "?") if own.n < of else "+" if own.rep else ""
            out.append(f"</{own.tag}>{sign}")
        elif not own.key:
            out.append(("#" if own.mark is None else f"'{own.mark:x}'") + ("?" if own.n < of else ""))
        else:
            out.append(f"<{own.key}>")
            stack.append((own, of, True))
            kids = ordered(own.kids)
            for i, k in reversed(list(enumerate(kids))):
                if k.again and (i + 1 == len(kids) or not kids[i + 1].again):
                    stack.append((")+", 0, False))
                stack.append((k, own.n, False))
                if k.again and (i == 0 or not kids[i - 1].again):
                    stack.append(("(", 0, False))
    return "".join(out)


class Reader:
    """Reads pages through a wrapper."""

    def __init__(self, wrapper: Item):
        self.root = wrapper
        self.weight: dict[int, float] = {}
        order = list(walk(wrapper))
        self.kids = {id(own): {k.key: k for k in own.kids} for own in order}
        self.slots = any(not own.key and not self.constant(own) for own in order)
        for own in reversed(order):  # children come before their parents
            words = own.words if not own.key and not self.constant(own) else 0
            self.weight[id(own)] = 0 if own.out else words + sum(self.weight[id(k)] for k in own.kids)

    @staticmethod
    def constant(item: Item) -> bool:
        return item.mark is not None and len(item.titles) >= TITLES

    def matched(self, own: Item, item: Item | None) -> list[tuple[Item, Item | None]]:
        """The element's children in order, each with the wrapper's item for it; None where the wrapper has none."""
        known = self.kids[id(item)] if item is not None else {}
        return [(child, known.get(child.key)) for child in own.kids]

    def descent(self, page: Item) -> list[list[tuple[Item, Item]]]:
        """From the page's root into the child whose slots hold most of the words, as long as one does: the elements of every step, several only at the last."""
        path: list[list[tuple[Item, Item]]] = [[(page, self.root)]]
        while self.slots:
            own, item = path[-1][0]
            every = self.matched(own, item)
            some = [(k, i) for k, i in every if k.key and not k.out and i is not None]
            each = {id(i): self.weight[id(i)] for _, i in some}
            best = max(some, key=lambda x: self.weight[id(x[1])], default=None)
            loose = sum(self.weight[id(i)] for k, i in every if not k.key and i is not None)
            if best is None or best[1].tag in LEAVES or not self.weight[id(best[1])] or self.weight[id(best[1])] < MOST * (sum(each.values()) + loose):
                break
            path.append([x for x in some if x[1] is best[1]])
            if len(path[-1]) > 1:
                break
        return path

    def article(self, page: Item) -> tuple[list[tuple[Item, Item | None]], bool]:
        """The elements that are the article, with their items, and whether the host marks them.

        The descent says where the page's own words are. How much around them belongs to the article is said by the
        innermost of its elements that the host marks, or else by marked ones in its last element, or elsewhere: a mark
        there counts only if it holds slots, that is, if the host's pages have words of their own in it.
        """
        path = self.descent(page)
        on_path = [step for step in path if step[0][1].marked]
        for step in reversed([s for s in on_path if s[0][1].tag != "main"] or on_path):
            if step[0][1].tag != "main" or not (inner := self.marked_in(step)):
                return step, True
            return inner, True
        for step in (path[-1], path[0]):
            if (inner := self.marked_in(step)) and (step is path[-1] or any(self.weight[id(i)] for _, i in inner)):
                return inner, True
        return (path[-1], False) if self.slots else ([], False)  # an expression without slots reads nothing

    def marked_in(self, step: list[tuple[Item, Item]]) -> list[tuple[Item, Item]]:
        """The marked elements inside, of one parent: those with most words of slots."""
        found: dict[int, list] = {}
        stack: list[tuple[Item, Item | None, Item | None]] = [(k, i, item) for own, item in reversed(step) for k, i in reversed(self.matched(own, item)) if k.key and (not k.out or k.tag == "form")]
        while stack:
            own, item, parent = stack.pop()
            if item is not None and item.marked and not own.out:
                found.setdefault(id(parent), []).append((own, item))
                if own.tag == "article":
                    continue
            stack += [(k, i, item) for k, i in reversed(self.matched(own, item)) if k.key and (not k.out or k.tag == "form")]
        inner = [group for group in ([x for x in g if x[1].tag != "main"] for g in found.values()) if group] or list(found.values())
        return max(inner, key=lambda g: max(self.weight[id(i)] for _, i in g), default=[])

    def text(self, page: Item) -> str:
        """The article's blocks, one a line."""
        chosen, marked = self.article(page)
        blocks: list[str] = []
        stack = list(reversed(chosen))
        while stack:
            own, item = stack.pop()
            if not own.key:
                blocks.append(own.text)
                continue
            single = item is not None and item.tag not in HEADINGS and not item.rep
            for child, i in reversed(self.matched(own, item)):
                if not child.key:
                    if not (single and i is not None and not i.rep and self.constant(i) and (i.n >= item.n or not marked)):
                        stack.append((child, i))
                elif not child.out and (child.tag != "header" or marked):
                    stack.append((child, i))
        return "\n".join(blocks)


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html").withColumn("host", F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host. pages: (host, html)."""
    prepare(pages.sparkSession)
    names = ["host", "wrapper"]

    def rows(hosts: dict[str, Item]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(hosts), pa.string()), pa.array([written(w) for w in hosts.values()], pa.string())], names=names)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Item] = {}
        size: Counter[str] = Counter()
        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if not page:
                    continue
                if host not in hosts:
                    hosts[host] = Item("#root", "#root")
                    hosts[host].n = 0
                hosts[host].n += 1
                align(hosts[host], marked_page(parse(page)))
            for host in {*batch.column("host").to_pylist()} & hosts.keys():
                size[host] = sum(1 for _ in walk(hosts[host]))
            if sum(size.values()) > HELD:
                yield rows(hosts)
                hosts, size = {}, Counter()
        yield rows(hosts)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Wrappers sorted by host: one is held at a time."""
        host, own = None, None
        for batch in batches:
            for name, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()):
                new = restored(text)
                if name == host:
                    own.n += new.n
                    align(own, new)
                else:
                    if own is not None:
                        yield rows({host: own})
                    host, own = name, new
        if own is not None:
            yield rows({host: own})

    schema = "host string, wrapper string"
    tasks = pages.select("host", "html").mapInArrow(per_task, schema).withColumn("task", F.spark_partition_id())
    part = F.pmod("task", F.lit(PARTS))
    some = tasks.repartition("host", part).sortWithinPartitions("host", part, "task", "wrapper").select(*names, part.alias("part"))

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = (pa.record_batch([pa.array([f"{p} {h}" for p, h in zip(b.column("part").to_pylist(), b.column("host").to_pylist())], pa.string()), b.column("wrapper")], names=names) for b in batches)
        for out in together(keyed):
            yield pa.record_batch([pa.array([h.split(" ", 1)[1] for h in out.column("host").to_pylist()], pa.string()), out.column("wrapper")], names=names)

    return some.mapInArrow(in_parts, schema).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(together, schema)


def _ahead(hosted: DataFrame, plans: DataFrame) -> DataFrame:
    """The pages and, before every PAGES or so of a host's, a row with its wrapper and no page."""
    shares = hosted.groupBy("host").agg(F.ceil(F.count("*") / F.lit(PAGES)).cast("int").alias("shares"))
    salted = hosted.join(shares, "host").withColumn("share", F.pmod(F.xxhash64("page_id", "url"), "shares").cast("int"))
    none = F.lit(None).cast("string")
    own = salted.select("host", "share", "page_id", "url", "html", none.alias("wrapper"), F.lit(True).alias("is_page"))
    each = plans.join(shares, "host").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    first = each.select("host", "share", F.lit(None).cast("long").alias("page_id"), none.alias("url"), none.alias("html"), "wrapper", F.lit(False).alias("is_page"))
    return own.unionByName(first).repartition("host", "share").sortWithinPartitions("host", "share", "is_page")


def extract(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, read through its host's wrapper. pages: (page_id, url, html)."""
    hosted = with_host(pages)
    plans = checkpoint(infer(hosted)) if wrappers is None else wrappers
    size = plans.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        read_by = hosted.join(F.broadcast(plans), "host", "left").withColumn("is_page", F.lit(True))
    else:
        read_by = _ahead(hosted, plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reader] = {}
        last, reader = None, None  # of a wrapper that was sent ahead
        for batch in batches:
            texts = []
            for host, page, wrapper, is_page in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper", "is_page"))):
                if not is_page:
                    if host != last:
                        last, reader = host, Reader(restored(wrapper))
                    continue
                if wrapper and page and wrapper not in known:
                    if len(known) > 256:
                        known.clear()
                    known[wrapper] = Reader(restored(wrapper))
                own = known.get(wrapper) if wrapper else reader if host == last else None
                texts.append(own.text(parse(page)) if page and own else "")
            own = batch.filter(batch.column("is_page"))
            yield pa.record_batch([own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return read_by.select("host", "page_id", "url", "html", "wrapper", "is_page").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
