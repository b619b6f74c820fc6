"""HTML extraction by union-free wrappers, inferred from all pages of a host.

The token streams of a host's pages are aligned element by element, from the root down: children of one signature under aligned parents
align. A child that some instance of its parent lacks becomes optional, one that an instance has more than once becomes repeated, and texts
that differ become slots. So a wrapper is a regular expression of concatenation, optional and repeated groups and text slots, without unions,
and taking in another page changes counters alone: the result doesn't depend on the order of pages or on how they lie in partitions.

The wrapper tells where the article is: the deepest element under which most of the host's unlinked slot words lie. Within it, texts that
are the same on LEAST_PAGES different pages, blocks of links, and single generic containers after the text are left out; headings and labels
that are the same everywhere stay where slots stand on both sides. The blocks of all pages' articles are also aligned from both ends: what they
all begin or end with is template, even where other texts share its path.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, stored, table

#: Elements that hold no article text, class or id words of generic containers that hold none, elements that break a block, elements without an end.
SKIPPED = frozenset("head title nav footer aside form script style noscript template svg iframe button select option textarea input label dialog object canvas audio video menu".split())
SKIPPED_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer sidebar related comment comments commentlist disqus respond cookie cookies consent gdpr notice notices popup modal newsletter pagination responses replies".split())
#: Words that may stand beside one of these in a name; a name with any other word ("notice-of-motion") says something else.
BESIDE = frozenset("area banner bar block bottom box bottomline button container content entry footer global group header holder inner item items left link links list main menu module outer page panel post posts primary right row secondary section sections side site slot text thread top unit user reader wrap wrapper widget widgets js ui the".split())
#: Names of a reader's words only if they say so.
READERS = frozenset({"reviews", "opinions"})
#: A text of these that is the same on all pages may belong to the article.
LABELS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption".split())
GENERIC = frozenset("div section ul ol table aside center details dl fieldset".split())
#: An article called so is none.
NO_ARTICLE = frozenset("comment comments reply ad ads advert related".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|svg|iframe"
RAW_NAMES = frozenset(RAW.split("|"))
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: A text is template if so many different pages have it; an element holds the article if this share of the host's slot words lies under it.
LEAST_PAGES, MAIN_SHARE = 3, 0.5
_NUMBERED = re.compile(r"\S*\d\S*")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def names_no_article(names: str) -> bool:
    """Whether a class or id says that what it names is no article: one of its names is made of SKIPPED_WORDS, and at most words that mean nothing beside them."""
    for name in names.split():
        words = re.findall(r"[a-z]+", name)
        telling = [w for w in words if w in SKIPPED_WORDS]
        if telling and all(w in SKIPPED_WORDS or w in BESIDE for w in words) or READERS & set(words) and {"user", "reader"} & set(words):
            return True
    return False


class Node:
    """An open element: its name, its signature (name, class and id, less words with digits, which number elements), the path of block elements down to it, whether its text is a link's, is left out, is or is in a marked article."""

    __slots__ = ("article", "block", "link", "name", "sign", "skipped")

    def __init__(self, name: str, attributes: str, parent: Node | None, skipped: frozenset[str] = SKIPPED):
        found = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMES.findall(attributes)} if attributes else {}
        words = set(re.findall(r"[a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}")) if found else ()
        self.name = name
        self.sign = name + "".join(mark + " ".join(x) for mark, key in ((".", "class"), ("#", "id")) if found.get(key) and (x := _NUMBERED.sub(" ", found[key]).replace(">", " ").split()))
        self.block = parent.block if parent is not None else ""
        if name in BLOCKS:
            self.block += ">" + self.sign if self.block else self.sign
        self.link = name == "a" or parent is not None and parent.link
        marked = name == "main" or found.get("role") == "main" or name == "article" and not (words and words & NO_ARTICLE)
        within = parent is not None and parent.article
        out = name in skipped or name == "header" and not within or name == "article" and not marked or name in GENERIC and bool(words) and names_no_article(f"{found.get('class', '')} {found.get('id', '')}")
        # an outermost marked article is never left out for what its ancestors are called; what is left out of an article stays out
        self.skipped = parent is not None and parent.skipped and not (marked and not within) or not marked and out
        self.article = within or marked and not self.skipped


def parse(page: str, skipped: frozenset[str] = SKIPPED) -> Iterator[tuple[str, str, Node | None]]:
    """Tokens of a page (elements named in skipped hold no article): ("text", raw text, innermost element), ("open", sign, element), ("close", sign, element); unclosed elements end where their parent does."""
    stack: list[Node] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], stack[-1] if stack else None
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:  # an element whose text is no markup
                yield "open", m[1].lower(), Node(m[1].lower(), "", stack[-1] if stack else None, skipped)
            continue
        if m[2]:
            if any(x.name == name for x in stack):
                while stack:
                    x = stack.pop()
                    yield "close", x.sign, x
                    if x.name == name:
                        break
            elif name in BLOCKS:
                yield "close", name, None
            continue
        ends = _CLOSES.get(name) or ({"p"} if name in BLOCKS else None)
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in ends:
                    while len(stack) > i:
                        x = stack.pop()
                        yield "close", x.sign, x
                    break
                if stack[i].name in BLOCKS:
                    break
        x = Node(name, m[4], stack[-1] if stack else None, skipped)
        yield "open", x.sign, x
        if name in VOID:
            continue
        if m[4].rstrip().endswith("/"):
            yield "close", x.sign, x
        else:
            stack.append(x)
    if at < len(page):
        yield "text", page[at:], stack[-1] if stack else None


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def blocks_of(tokens: Iterable[tuple[str, str, Node | None]]) -> list[tuple[str, str, int, bool]]:
    """The blocks of text of a parsed page, without skipped elements: (path of block elements, text, words in links, whether in a marked article)."""
    out, held, links, key = [], [], [], ("", False)

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((key[0], text, sum(links), key[1]))
        held.clear(), links.clear()

    for kind, value, node in tokens:
        if kind == "text":
            if node is not None and node.skipped:
                continue
            at = (node.block, node.article) if node is not None else ("", False)
            if at != key:
                flush()
                key = at
            held.append(value)
            if node is not None and node.link:
                links.append(len(value.split()))
        else:
            name = node.name if node is not None else value
            if name in BLOCKS:  # what is left out within a line doesn't part it
                flush()
            elif name == "br":
                held.append(" ")
    flush()
    return out


def read(page: str) -> tuple[list, list[tuple[str, str, int, bool]]]:
    """The tokens and blocks of a page. A page that lies in one form altogether is read as if there were no form."""
    tokens = list(parse(page))
    blocks = blocks_of(tokens)
    if not blocks and "<form" in page.lower():
        tokens = list(parse(page, SKIPPED - {"form"}))
        blocks = blocks_of(tokens)
    return tokens, blocks


def article_of(blocks: list[tuple[str, str, int, bool]]) -> list[tuple[str, str, int, bool]]:
    """The blocks of marked articles, or all."""
    return [b for b in blocks if b[3]] or blocks


def _common(a: list[int], b: list[int]) -> list[int]:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def above(path: str) -> str:
    return path.rpartition(">")[0]


def name_of(path: str) -> str:
    return re.split(r"[.#]", path.rpartition(">")[2], maxsplit=1)[0]


class Wrapper:
    """What the pages of a host have in common, in counters that add up.

    groups: path of a block element -> [its instances, {signature of a child: [instances that have it, most in one instance, sum of its first places]}].
    slots: path -> [hash of its text (None once two texts of that path differ, on one page or two: a slot), up to LEAST_PAGES different pages
    that have that text, words, words in links].
    pages: up to LEAST_PAGES different pages.
    ends: the blocks (hashes of path and text) that all pages' articles begin with, and, from the last on, those that they end with.
    """

    def __init__(self, groups: dict[str, list], slots: dict[str, list], pages: list[int], ends: list[list[int]] | None = None):
        self.groups, self.slots, self.pages, self.ends = groups, slots, pages, ends

    @classmethod
    def of(cls, page: str) -> Wrapper:
        tokens, blocks = read(page)
        said = xxhash.xxh64_intdigest("\n".join(text for _, text, _, _ in blocks).encode("utf-8", "surrogatepass"))
        slots: dict[str, list] = {}
        for path, text, linked, _ in blocks:
            own = slots.setdefault(path, [_hash(text), [said], 0, 0])
            if own[0] != _hash(text):
                own[:2] = None, []
            own[2] += len(text.split())
            own[3] += linked
        groups: dict[str, list] = {}
        open_: list[tuple[str, dict]] = [("", {})]

        def close():
            path, children = open_.pop()
            own = groups.setdefault(path, [0, {}])
            own[0] += 1
            for sign, (n, at) in children.items():
                was = own[1].setdefault(sign, [0, 0, 0])
                was[:] = was[0] + 1, max(was[1], n), was[2] + at

        for kind, _, node in tokens:
            if kind == "text" or node is None or node.name not in BLOCKS:
                continue
            if kind == "open":
                children = open_[-1][1]
                children[node.sign] = (1, len(children)) if node.sign not in children else (children[node.sign][0] + 1, children[node.sign][1])
                if node.name not in VOID and node.name not in RAW_NAMES:
                    open_.append((node.block, {}))
            elif len(open_) > 1:
                close()
        while open_:
            close()
        line = [_hash(f"{path} {text}") for path, text, _, _ in article_of(blocks)]
        return cls(groups, slots, [said] if blocks else [], [line, line[::-1]] if blocks else None)

    def align(self, other: Wrapper) -> None:
        """Take in another wrapper of the same host."""
        for path, (n, children) in other.groups.items():
            own = self.groups.setdefault(path, [0, {}])
            own[0] += n
            for sign, (have, most, at) in children.items():
                was = own[1].setdefault(sign, [0, 0, 0])
                was[:] = was[0] + have, max(was[1], most), was[2] + at
        for k, (said, seen, words, linked) in other.slots.items():
            own = self.slots.get(k)
            if own is None:
                self.slots[k] = [said, seen, words, linked]
                continue
            own[:2] = (said, sorted({*own[1], *seen})[:LEAST_PAGES]) if said is not None and said == own[0] else (None, [])
            own[2] += words
            own[3] += linked
        self.pages = sorted({*self.pages, *other.pages})[:LEAST_PAGES]
        if self.ends is None or other.ends is None:  # a page without text has no ends
            self.ends = self.ends or other.ends
        else:
            self.ends = [_common(a, b) for a, b in zip(self.ends, other.ends)]

    def repeated(self, path: str) -> bool:
        group = self.groups.get(above(path))
        found = group and group[1].get(path.rpartition(">")[2])
        return bool(found) and found[1] > 1

    def expression(self, path: str = "") -> str:
        """The wrapper below a path: `#` a slot, quotes a text that is always the same, `?` optional, `+` repeated, `*` both."""
        n, children = self.groups.get(path, [0, {}])
        out = []
        if path in self.slots:
            out.append("#" if self.slots[path][0] is None else '"="')
        for sign, (have, most, at) in sorted(children.items(), key=lambda x: (x[1][2] / x[1][0], x[0])):
            below = f"{path}>{sign}" if path else sign
            mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[have < n, most > 1]
            out.append(f"({sign} {self.expression(below)})".replace(" )", ")") + mark)
        return " ".join(out)

    def template(self) -> set[str]:
        """Paths of blocks that say the same wherever they are (on LEAST_PAGES different pages or more; copies of a page show nothing about its template), and, with a ~ before them, paths of blocks whose text is mostly links."""
        return {k for k, (said, seen, _, _) in self.slots.items() if said is not None and len(seen) >= LEAST_PAGES} | {"~" + k for k, (_, _, words, linked) in self.slots.items() if 2 * linked > words}

    def region(self) -> tuple[str, set[str]] | None:
        """The path of the element that holds the article, and paths under it that hold none: single generic containers that say little. None where too few different pages have been seen to tell slots from template."""
        if len(self.pages) < LEAST_PAGES:
            return None
        mass = {k: words - linked for k, (said, _, words, linked) in self.slots.items() if said is None and words > linked}
        under: dict[str, int] = {}
        for k, words in mass.items():
            while True:
                under[k] = under.get(k, 0) + words
                if not k:
                    break
                k = above(k)
        whole = under.get("", 0)
        if not whole:
            return None
        at = ""
        while below := [k for k in under if k and above(k) == at and under[k] > MAIN_SHARE * whole and 2 * mass.get(k, 0) <= under[k]]:
            at = below[0]
        return at, {k for k in self.slots if k != at and above(k) == at and name_of(k) in GENERIC and not self.repeated(k) and mass.get(k, 0) < under[at] / 5}

    def rules(self) -> list[str]:
        """What extract() needs: template() with !path for the region, -path for what is left out after its text, and ^n and $n for the number of blocks that all articles begin and end with."""
        found, ends = self.region(), []
        if self.ends and len(self.pages) >= LEAST_PAGES:
            ends = [f"{mark}{len(x)}" for mark, x in zip("^$", self.ends) if x]
        return sorted(self.template()) + (["!" + found[0], *sorted("-" + k for k in found[1])] if found else []) + ends

    def dump(self) -> str:
        return json.dumps([self.groups, self.slots, self.pages, self.ends], sort_keys=True)

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))


def extract(page: str | None, rules: Iterable[str] = ()) -> str:
    """The main text, in whole blocks: what lies in the region that the host's wrapper names, with the titles (h1) on the way to it, less template, blocks of links and what the wrapper leaves out. A marked article (article, main) that this region meets, or that it misses altogether, is the region. Where the wrapper names none: the marked article, or else all blocks. Skipped elements never count."""
    if not page:
        return ""
    rules = set(rules)
    region = next((r[1:] for r in rules if r[0] == "!"), None)
    blocks = read(page)[1]
    line = article_of(blocks)
    head, tail = (next((int(r[1:]) for r in rules if re.fullmatch(rf"{re.escape(mark)}\d+", r)), 0) for mark in "^$")
    ends: set[int] = set()
    if head + tail < len(line):
        ends = {id(b) for b in line[:head] if name_of(b[0]) not in LABELS} | {id(b) for b in line[len(line) - tail :]}
    marked = [b for b in blocks if b[3]]
    if region is not None:
        inside = [b for b in blocks if b[0] == region or b[0].startswith(region + ">") or not region or name_of(b[0]) == "h1" and (region + ">").startswith(above(b[0]) + ">")]
        blocks = inside if any(name_of(b[0]) != "h1" for b in inside) else blocks
    if marked:
        blocks = [b for b in blocks if b[3]] or marked
        plain = [b[0] not in rules and id(b) not in ends for b in blocks]
    else:
        plain = [not rules & {b[0], "~" + b[0], "-" + b[0]} and id(b) not in ends for b in blocks]
    slots = [i for i, kept in enumerate(plain) if kept]
    first, last = (slots[0], slots[-1]) if slots else (0, -1)

    def stays(i: int, b: tuple) -> bool:
        if plain[i] or id(b) in ends:
            return plain[i]
        # a label between slots, and what stands before the text in a container of its own
        return i < last and (b[0] in rules and name_of(b[0]) in LABELS and first < i or "-" + b[0] in rules and not rules & {b[0], "~" + b[0]})

    out = [b[1] for i, b in enumerate(blocks) if stays(i, b)]
    return "\n".join(out or ([b[1] for b in blocks] if marked else []))


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and task: the pages of a hot host are taken in where they lie."""
    held: dict[str, Wrapper] = {}
    for b in batches:
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            host, new = host_of(url), Wrapper.of(page or "")
            if host in held:
                held[host].align(new)
            else:
                held[host] = new
            if len(held) >= 5000:
                yield _told(held)
                held = {}
    if held:
        yield _told(held)


def _told(held: dict[str, Wrapper]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([w.dump() for w in held.values()])], ["host", "wrapper"])


def _merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = None
    for b in rows:
        for text in b.column("wrapper").to_pylist():
            new = Wrapper.load(text)
            if whole is None:
                whole = new
            else:
                whole.align(new)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([whole.dump()]), pa.array([whole.rules()], pa.list_(pa.string()))], ["host", "wrapper", "template"])


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper, template) from all pages of each host. Tasks send one wrapper per host, so a host that holds a third of the pages is merged from as many rows as there are tasks."""
    parts = pages.select(F.col(url), F.col(page)).mapInArrow(_partial, "host string, wrapper string")

    def merge(key, table_):
        out = list(_merge(key, iter(table_.sort_by("wrapper").to_batches())))
        return pa.Table.from_batches(out)

    return parts.groupBy("host").applyInArrow(merge, "host string, wrapper string, template array<string>")


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = b.num_columns
        texts = [extract(page, t or ()) for page, t in zip(b.column(k - 2).to_pylist(), b.column(k - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[: k - 2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[: k - 2], "text", "n_chars"])


def extract_pages(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html", most_broadcast: int = 100_000) -> DataFrame:
    """The columns in keep with text and n_chars.

    Wrappers decide on all pages of hosts with LEAST_PAGES different pages. Only the rules of hosts that have any are joined (broadcast up
    to most_broadcast hosts as counted, shuffled beyond). A repeated text that shares its path with texts that differ is not template.
    Defined results: null or empty html gives an empty text; a null or odd url belongs to the host ''; a page alone on its host, or with
    copies of itself alone, has no template and no region, but for links and a marked article; markup that is cut off ends where the page
    ends; an attribute whose quote never ends, ends with its tag; elements with equal shares can't both hold more than MAIN_SHARE; equal pages
    of a host get equal texts; an empty table gives no rows; columns in keep that are called text or n_chars are replaced.
    """
    keep = others(keep, ["text", "n_chars"])
    found = stored(wrappers(pages, url, page).select(F.col("host").alias("_host"), "template").where(F.size("template") > 0), "html-wrappers")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.struct(F.lit(0).alias("_"), *keep).alias("_kept"), F.col(page).alias("_page"), host.alias("_host"))
    if found.count() <= most_broadcast:
        found = F.broadcast(found)
    rows = rows.join(found, "_host", "left").select(*(F.col("_kept")[c].alias(c) for c in keep), "_page", "template")
    return rows.mapInArrow(_extract, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
