"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is read as a stream of tags and texts; tandem repeats are folded into ``(...)+``. The streams of a host's pages
are aligned with its wrapper one after another: what only one side has becomes optional, a part that stands once where the
other side repeats it becomes the repeated group, texts that read alike stay constant, and texts that differ become slots.
Each text of the wrapper is named by the sections around it. The host's constants, those that the wrapper still has for
nearly all of the host's distinct pages after all alignments, are template outside an article. So is a text if an
element around it says so (navigation, header, footer, sidebar, advert, form, notice, comments, or a name of that
kind), or if it lies outside the page's article where the wrapper has slots in one. All else is main text. Names of html and
body say nothing, nor do those of elements around the article or around most of the page's text.

A null or empty page has the empty text. Pages without a host form one host. Repeated rows stay; other columns are not
carried along. Hosts of any size are folded in a tree of slices, each with no more in memory than one wrapper, and the
pages of a crowded host meet copies of its wrapper in several tasks.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import materialize
from vitrine.llm.urls import url_parts

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|([^<]+|<)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TEMPLATE = frozenset("head nav header footer aside form button dialog menu".split())
MAIN = frozenset("article main".split())
#: Words in the names of elements that aren't main text, and of those that are.
TEMPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert warning popup modal overlay comment comments reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager form skip copyright legal disclaimer contentinfo complementary hidden".split())
#: Words that say nothing of what an element holds.
PLAIN_WORDS = frozenset("area block bar body box button col column container content group head header inner item items link links list main outer panel row section text title unit wrap wrapper zone bottom end left right top".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
MAIN_WORDS = frozenset("article main content post entry story body text".split())
#: Wrappers that one task aligns one after another; copies of the wrapper of a crowded host; tokens between anchors that are compared pair by pair.
TOGETHER, COPIES, PAIRWISE = 64, 64, 300
#: A text is the host's own if it reads the same on as many distinct pages, and on this share of all of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.9


def _label(tag: str, attributes: str) -> str:
    names = sorted({w for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}) if "=" in attributes else []
    return ".".join([tag, *names])


def read_page(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, label or text, path): kind is + for an opened element, - for a closed one, / for a break, # for text. The path has all elements around, from the outermost."""
    stack: list[str] = []
    skip, at, size = "", 0, len(page)
    while at < size:
        if skip:
            end = re.compile(rf"</{re.escape(skip)}\b[^>]*>", re.I).search(page, at)
            at, skip = (end.end() if end else size), ""
            continue
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            if not m[4].isspace():
                yield "#", m[4], ">".join(stack)
            elif stack:
                yield " ", m[4], ">".join(stack)
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].split(".", 1)[0] == tag:
                    del stack[i:]
                    break
            yield ("-" if tag not in INLINE else "~"), tag, ""
            continue
        if tag in RAW:
            skip = "" if m[3].endswith("/") else tag
            yield "/", tag, ""
            continue
        if tag in VOID:
            yield ("/" if tag in ("br", "hr") else "~"), tag, ""
            continue
        if tag in CLOSES_P or tag == "li":
            closing = "li" if tag == "li" else "p"
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i].split(".", 1)[0]
                if name == closing:
                    del stack[i:]
                    break
                if name not in INLINE:
                    break
        label = _label(tag, m[3])
        if tag in INLINE and "." not in label:
            yield "~", label, ""
            continue
        stack.append(label)
        yield ("+" if tag not in INLINE else "~"), label, ""


class Token(NamedTuple):
    """A part of a wrapper: a tag, a text ``#path`` or a repeated group. ``text`` tells a constant text, 0 one that varies; ``pages`` have it."""

    name: str
    optional: bool = False
    text: int = 0
    pages: int = 1


def fold_repeats(tokens: list[Token]) -> list[Token]:
    """Tandem repeats of up to eight tokens become one token ``(...)+``, until there are none."""
    changed = True
    while changed:
        changed = False
        for n in range(1, 9):
            out, i, names = [], 0, [t.name for t in tokens]
            while i < len(tokens):
                unit = names[i : i + n]
                j = i + n
                while len(unit) == n and names[j : j + n] == unit:
                    j += n
                group = unit[0] if n == 1 and unit[0].endswith(")+") else f"({' '.join(unit)})+"
                if j > i + n:
                    out.append(Token(group))
                    i, changed = j, True
                elif len(unit) == n and out and out[-1].name == group:
                    # a part that follows its own group belongs to it
                    i, changed = j, True
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
    return tokens


def _grouped(tokens: list[Token], other: set[str]) -> list[Token]:
    """Parts that stand once here and as a repeated group in ``other`` become that group."""
    here = {t.name for t in tokens}
    units = {}
    for g in other:
        if g.endswith(")+") and g not in here:
            unit = tuple(g[1:-2].split(" "))
            if not any("(" in x for x in unit):
                units.setdefault(unit[0], []).append((unit, g))
    if not units or here.isdisjoint(units):
        return tokens
    out, i, names = [], 0, [t.name for t in tokens]
    while i < len(tokens):
        for unit, g in units.get(names[i], ()):
            if tuple(names[i : i + len(unit)]) == unit:
                out.append(Token(g, tokens[i].optional, 0, tokens[i].pages))
                i += len(unit)
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def matching(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of common tokens in both, ascending. Common ends first, then tokens that are unique on both sides as anchors; what is left between these is compared pair by pair if it is short."""
    low, ea, eb = 0, len(a), len(b)
    while low < min(ea, eb) and a[low] == b[low]:
        low += 1
    while ea > low and eb > low and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    out = [(i, i) for i in range(low)]
    if ea > low and eb > low:
        if max(ea, eb) - low <= PAIRWISE:
            for i, j, n in SequenceMatcher(None, a[low:ea], b[low:eb], autojunk=False).get_matching_blocks():
                out += [(low + i + k, low + j + k) for k in range(n)]
        else:
            ca, cb = Counter(a[low:ea]), Counter(b[low:eb])
            at = {t: j for j, t in enumerate(b[low:eb], low) if cb[t] == 1}
            pairs = [(i, at[t]) for i, t in enumerate(a[low:ea], low) if ca[t] == 1 and t in at]
            tails, ends, before = [], [], []  # the longest ascending chain of anchors
            for k, (_, j) in enumerate(pairs):
                x = bisect_left(tails, j)
                tails[x : x + 1] = [j]
                ends[x : x + 1] = [k]
                before.append(ends[x - 1] if x else -1)
            chain, k = [], ends[-1] if ends else -1
            while k >= 0:
                chain.append(pairs[k])
                k = before[k]
            i0, j0 = low, low
            for i, j in [*reversed(chain), (ea, eb)]:
                if chain:
                    out += [(i0 + x, j0 + y) for x, y in matching(a[i0:i], b[j0:j])]
                if i < ea:
                    out.append((i, j))
                i0, j0 = i + 1, j + 1
    return out + [(ea + k, eb + k) for k in range(len(a) - ea)]


def align(wrapper: list[Token], page: list[Token]) -> list[Token]:
    """The wrapper generalised to cover the page too: common tokens stay, texts that differ vary, the rest of either side becomes optional."""
    names = {t.name for t in wrapper}, {t.name for t in page}
    wrapper, page = _grouped(wrapper, names[1]), _grouped(page, names[0])
    out: list[Token] = []
    i = j = 0
    for x, y in [*matching([t.name for t in wrapper], [t.name for t in page]), (len(wrapper), len(page))]:
        out += [t._replace(optional=True) for t in (*wrapper[i:x], *page[j:y])]
        if x < len(wrapper):
            a, b = wrapper[x], page[y]
            out.append(Token(a.name, a.optional or b.optional, a.text if a.text == b.text else 0, a.pages + b.pages))
        i, j = x + 1, y + 1
    return out


def text_key(text: str) -> int:
    return zlib.crc32(text.strip().encode("utf-8", "surrogatepass")) + 1


def skeleton(page: str) -> list[Token]:
    """The page as folded tokens; texts carry the path of their sections."""
    tokens = []
    for kind, what, path in read_page(page):
        if kind == "#":
            tokens.append(Token(f"#{path}", text=text_key(what)))
        elif kind in "+-":
            tokens.append(Token(f"{kind}{what}"))
    return fold_repeats(tokens)


def slots(wrapper: list[Token]) -> set[str]:
    """Paths of all texts of a wrapper."""
    return {m[1] for t in wrapper for m in re.finditer(r"#([^ )]*)", t.name)}


def constants(wrapper: list[Token], pages: int) -> list[tuple[str, int]]:
    """Paths and keys of texts that the wrapper has for nearly all of a host's pages."""
    least = max(LEAST_PAGES, LEAST_SHARE * pages)
    return sorted({(t.name[1:], t.text) for t in wrapper if t.text and t.pages >= least})


@lru_cache(1 << 16)
def _words(label: str) -> frozenset[str]:
    return frozenset(w for name in label.split(".")[1:] for w in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", name) if w)


@lru_cache(1 << 16)
def _wholly_template(label: str) -> bool:
    """Whether a whole name calls the element template: ``ad-box`` does, ``notice-of-award`` doesn't."""
    for name in label.split(".")[1:]:
        words = {w for w in re.split(r"[-_:\d]+|(?<=[a-z])(?=[A-Z])", name) if w}
        if words & TEMPLATE_WORDS and words <= TEMPLATE_WORDS | PLAIN_WORDS:
            return True
    return False


def _named(labels: list[str]) -> list[int]:
    """Places in a path of elements that only their names call template: by any word outside an article, by a whole name within one, where words are the article's own."""
    found, inside = [], False
    for i, label in enumerate(labels):
        tag = label.split(".", 1)[0]
        if tag not in TEMPLATE and tag not in ("html", "body") and (_wholly_template(label) if inside else _words(label) & TEMPLATE_WORDS):
            found.append(i)
        inside |= tag in MAIN
    return found


@lru_cache(1 << 16)
def _named_template(path: str) -> tuple[str, ...]:
    """The elements of a path, each by its own path, that only their names call template."""
    labels = path.split(">")
    return tuple(">".join(labels[: i + 1]) for i in _named(labels))


def template_path(path: str, free: frozenset[str] = frozenset()) -> bool:
    """Whether an element of the path is template. The names of html, body and the elements in ``free`` don't count."""
    inside = False
    for tag in (x.split(".", 1)[0] for x in path.split(">")):
        if tag in TEMPLATE and not (tag == "header" and inside):
            return True
        inside |= tag in MAIN
    return any(x not in free for x in _named_template(path))


def main_path(path: str) -> bool:
    return any(label.split(".", 1)[0] in MAIN or "main" in _words(label) for label in path.split(">"))


def named_path(path: str) -> bool:
    return any(_words(label) & MAIN_WORDS for label in path.split(">"))


def layout(found: list[tuple[str, str, str]]) -> frozenset[str]:
    """Elements whose names tell of the layout (``with-sidebar``), as they are around the article or most of the page's text.

    Each element counts alone, not all of its name. One around articles counts as such if these have more text than
    the main text elsewhere (or than all text elsewhere that isn't template, if none is called main text); so teasers and comments don't."""
    opened: dict[str, int] = {}
    size: dict[tuple[str, int], int] = {}
    articles: dict[tuple[str, int], int] = {}
    strict = {path: template_path(path) for kind, _, path in found if kind == "#"}
    total, left, called = 0, 0, 0
    for kind, what, path in found:
        if kind in "+~" and "." in what:
            opened[what] = opened.get(what, 0) + 1
        if kind != "#":
            continue
        n = len(what.strip())
        total += n
        if not strict[path]:
            left += n
            called += n if main_path(path) or named_path(path) else 0
        for element in _named_template(path):
            key = (element, opened.get(element.rsplit(">", 1)[-1], 0))
            size[key] = size.get(key, 0) + n
            below = path[element.rfind(">") + 1 :]
            if any(x.split(".", 1)[0] in MAIN for x in below.split(">")):
                articles[key] = articles.get(key, 0) + n
    free = set()
    for (element, i), n in size.items():
        comments = bool(_words(element.rsplit(">", 1)[-1]) & COMMENT_WORDS)
        if (2 * n > total and not (comments and called)) or articles.get((element, i), 0) > (called or left):
            free.add(element)
    return frozenset(free)


def kept_slots(paths: set[str], free: frozenset[str] = frozenset()) -> tuple[set[str], str]:
    """Slots with main text, and what that rests on: in the ``article`` if there is one, else in an element ``named`` as content, else ``any`` that isn't template by name."""
    left = {p for p in paths if not template_path(p, free)}
    if found := {p for p in left if main_path(p)}:
        return found, "article"
    if found := {p for p in left if named_path(p)}:
        return found, "named"
    return left, "any"


def _constant(path: str, text: str, fixed: frozenset[tuple[str, int]], rests: str) -> bool:
    """Whether a text is the host's own. Nothing in an article is, nor a paragraph or heading of named content."""
    if rests == "article" or not fixed or (rests == "named" and path.rsplit(">", 1)[-1].split(".", 1)[0] in ("p", "h1")):
        return False
    return (path, text_key(text)) in fixed


def extract(page: str, wrapper: set[str] | None = None, fixed: frozenset[tuple[str, int]] = frozenset()) -> str:
    """Main text of a page: text of kept slots without the host's constants, one space within and between blocks. The page's own slots count where the wrapper doesn't cover them."""
    found = list(read_page(page))
    own = {path for kind, _, path in found if kind == "#"}
    free = layout(found) if any(map(_named_template, own)) else frozenset()
    for paths in (wrapper | own if wrapper else own, own):
        keep, rests = kept_slots(paths, free)
        kept = {(path, what) for kind, what, path in found if kind == "#" and path in keep and not _constant(path, what, fixed, rests)}
        if kept:
            break
    out: list[str] = []
    for kind, what, path in found:
        if kind == " ":
            if path in keep:
                out.append(what)
        elif kind == "#":
            if (path, what) in kept:
                out.append(entities.unescape(what))
        elif kind != "~":
            out.append(" ")
    return " ".join("".join(out).split())


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, slots, fixed, pages) from (host, html): the slots and constants of each host's wrapper, and how many pages it has.

    Exact copies are one page. Pages of one shape are first brought together by an aggregate: their texts at each place are
    constant or vary. The shapes of a host are then aligned, TOGETHER at a time, level by level until one wrapper is left."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                tokens = skeleton(page)
                digest = hashlib.md5(page.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                out.append((host, "\n".join(t.name for t in tokens), digest, [t.text for t in tokens]))
            yield pd.DataFrame(out, columns=["host", "shape", "page", "texts"])

    key = F.substring(F.unhex(F.sha2("shape", 256)), 1, 16).alias("key")
    seen = materialize(pages.mapInPandas(read, "host string, shape string, page binary, texts array<long>").select("host", "page", key, "shape", "texts"), "shapes")
    distinct = seen.groupBy("host", "page").agg(F.first(F.struct("key", "texts")).alias("x"), F.count("*").alias("rows")).select("host", "rows", "x.key", "x.texts")
    # a place of 0 in every row counts the pages
    places = distinct.select("host", "key", "rows", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "texts")).alias("at", "text")).filter("at = 0 or text > 0")
    alike = places.groupBy("host", "key", "at").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count("*").alias("n"), F.sum("rows").alias("rows"))
    text = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0)
    kinds = alike.groupBy("host", "key").agg(F.max(F.when(F.col("at") == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("at") == 0, F.col("rows"))).alias("rows"), F.collect_list(F.when(F.col("at") > 0, F.struct("at", text.alias("text")))).alias("texts"))
    shapes = seen.groupBy("host", "key").agg(F.first("shape").alias("shape"))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, shape, n, rows, texts in zip(batch["host"], batch["shape"], batch["n"], batch["rows"], batch["texts"], strict=True):
                known = {x["at"]: x["text"] for x in texts}
                names = shape.split("\n") if shape else []
                out.append((host, n, rows, shape, [False] * len(names), [known.get(i + 1, 0) for i in range(len(names))], [n] * len(names)))
            yield pd.DataFrame(out, columns=MADE_NAMES)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, wrapper, n, rows = None, [], 0, 0

        def told() -> tuple:
            return now[0], n, rows, "\n".join(t.name for t in wrapper), [t.optional for t in wrapper], [t.text for t in wrapper], [t.pages for t in wrapper]

        for batch in batches:
            out = []
            for host, part, n2, rows2, shape, optional, texts, counts in zip(*(batch[c] for c in ["host", "part", *MADE_NAMES[1:]]), strict=True):
                tokens = [Token(*x) for x in zip(shape.split("\n"), optional.tolist(), texts.tolist(), counts.tolist(), strict=True)] if shape else []
                if (host, part) != now:
                    if now:
                        out.append(told())
                    now, wrapper, n, rows = (host, part), tokens, n2, rows2
                else:
                    wrapper, n, rows = align(wrapper, tokens), n + n2, rows + rows2
            if out:
                yield pd.DataFrame(out, columns=MADE_NAMES)
        if now:
            yield pd.DataFrame([told()], columns=MADE_NAMES)

    level = shapes.join(kinds.withColumnsRenamed({"host": "h", "key": "k"}), F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k"))).select("host", "shape", "n", "rows", "texts").mapInPandas(start, MADE)
    level = materialize(level, "wrappers")
    while True:
        sizes = level.groupBy("host").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
        most = sizes.agg(F.max("parts").alias("m")).first()["m"] or 1
        dealt = level.join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).withColumn("part", F.pmod(F.xxhash64("shape"), F.col("parts")).cast("int"))
        dealt = dealt.select("host", "part", *MADE_NAMES[1:]).repartition("host", "part").sortWithinPartitions("host", "part", F.desc("n"), "shape")
        level = materialize(dealt.mapInPandas(fold, MADE), "wrappers")
        if most == 1:
            break

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, n, rows, shape, texts, counts in zip(*(batch[c] for c in ["host", "n", "rows", "shape", "texts", "counts"]), strict=True):
                wrapper = [Token(x, False, t, k) for x, t, k in zip(shape.split("\n"), texts.tolist(), counts.tolist(), strict=True)] if shape else []
                fixed = constants(wrapper, n)
                out.append((host, rows, sorted(slots(wrapper)), [p for p, _ in fixed], [t for _, t in fixed]))
            yield pd.DataFrame(out, columns=["host", "rows", "slots", "paths", "keys"])

    return level.mapInPandas(listed, "host string, rows long, slots array<string>, paths array<string>, keys array<long>")


MADE = "host string, n long, rows long, shape string, optional array<boolean>, texts array<long>, counts array<long>"
MADE_NAMES = [x.split()[0] for x in MADE.split(", ")]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page. The pages of hosts with over a thousandth of all, at most a thousand hosts, meet copies of their wrapper in as many tasks."""
    host, _ = url_parts(F.col(url_col))
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = dict(given.dtypes)["id"]
    wrappers = materialize(infer_wrappers(given.select("host", "html")), "hosts")
    total = wrappers.agg(F.sum("rows").alias("n")).first()["n"] or 0
    crowded = materialize(wrappers.filter(F.col("rows") > max(1000, total / 1000)).select(F.col("host").alias("crowd")), "crowded")
    several = F.col("crowd").isNotNull()
    salted = given.join(F.broadcast(crowded), F.col("host") == F.col("crowd"), "left").withColumn("salt", F.when(several, F.pmod(F.xxhash64("html", "url"), F.lit(COPIES))).otherwise(0))
    copies = wrappers.join(F.broadcast(crowded), F.col("host") == F.col("crowd"), "left").withColumn("salt", F.explode(F.when(several, F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0))))).select(F.col("host").alias("of"), "salt", "slots", "paths", "keys")
    joined = salted.join(copies.withColumnRenamed("salt", "copy"), F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")), "left").select(F.col("id").cast("string").alias("id"), "url", "html", "slots", "paths", "keys")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h, None if s is None else set(s), frozenset(zip(p, k, strict=True)) if p is not None else frozenset()) for h, s, p, k in zip(batch["html"], batch["slots"], batch["paths"], batch["keys"], strict=True)]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = joined.mapInPandas(rows, "id string, url string, text string, n_chars long")
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
