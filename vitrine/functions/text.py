"""Text columns: normal forms, keys, cleaning. All stay in the JVM but accents, character references and the similarity ratio."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import cache, reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Articles cut from the front of a title, one after another in this order.
ARTICLES = ("the ", "a ", "an ", "le ", "la ", "les ", "de ", "het ", "een ")
#: What is noted in brackets behind the title of a partial or copied picture.
COPY_NOTES = ("cropped", "detail", "full view", "reproduction")
#: Patterns of marks in prose, in the order in which they are taken off, and what stays of each.
MARKDOWN = (
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
)


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trimmed(c: Column) -> Column:
    """Lower case without outer spaces; null is empty."""
    return F.lower(F.trim(blank(c)))


def item_key(title: Column, agent: Column) -> Column:
    """Title and artist with all but letters and digits as one space, joined by a bar."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", " "))
    return F.concat_ws("|", plain(title), plain(agent))


def _plain(t: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, t) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _unaccented(texts: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else _plain(t, f) for t, f in zip(texts, form, strict=True)], dtype=object)


@cache
def _letters(form: str) -> tuple[str, str, str]:
    """Letters of the basic plane that become one letter or none: these letters and what they become, those that become none last; and the letters that become several."""
    became = {c: _plain(c, form) for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)])}
    one = sorted((c for c, d in became.items() if d != c and len(d) < 2), key=lambda c: not became[c])
    return "".join(one), "".join(became[c] for c in one), "".join(c for c, d in became.items() if len(d) > 1)


def unaccented(c: Column, form: str = "NFD") -> Column:
    """Without combining marks, after a Unicode decomposition. No built-in function decomposes.

    Marks are dropped, so each letter becomes something by itself, mostly one letter, and those are translated in place. Only texts with
    a letter that becomes several, or one beyond the basic plane, go to Python: batches of whole texts would fill its memory."""
    old, new, several = _letters(form)
    other = (F.octet_length(F.translate(c, several, "")) < F.octet_length(c)) | c.rlike("[^\\x{0}-\\x{FFFF}]")
    ascii_ = F.octet_length(c) == F.length(c)
    asked = _unaccented(F.when(~ascii_ & other, c), F.lit(form))
    return F.when(ascii_, c).otherwise(F.coalesce(asked, F.translate(c, old, new)))


def match_form(c: Column) -> Column:
    """For comparison: lower case, without accents, articles cut in order."""
    out = unaccented(F.lower(F.trim(blank(c))))
    for a in ARTICLES:
        out = F.regexp_replace(out, f"^{a}", "")
    return F.trim(out)


def loose_title(c: Column) -> Column:
    """Letters, digits and single spaces; without a leading article."""
    plain = F.regexp_replace(F.translate(unaccented(F.lower(blank(c)), "NFKD"), "-–—", "   "), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(plain), "^(the|a|an) ", ""), " +", " "))


def work_key(c: Column) -> Column:
    """What stands before the first bracket and comma."""
    return F.lower(F.trim(F.substring_index(F.substring_index(blank(c), "(", 1), ",", 1)))


def surname(c: Column) -> Column:
    return F.element_at(F.split(F.trim(blank(c)), r"\s+"), -1)


def display_title(c: Column) -> Column:
    """Without a structured suffix, white space folded; the original if nothing is left."""
    cut = F.element_at(F.split(F.trim(c), r"\s+QS:P\d+"), 1)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(cut, r"\s+", " ")), F.lit("")), c)


@F.pandas_udf(T.StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references of HTML as the characters that they stand for."""
    return pd.Series([t if t is None or "&" not in t else unescape(t) for t in texts], dtype=object)


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that it uses several times, computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _before_bracket(c: Column, held: Column) -> Column:
    return F.rtrim(F.left(c, F.length(c) - F.length(held) - 2))


def _bracket(c: Column) -> Column:
    """What the brackets at the end of a text hold; empty if there are none."""
    return F.regexp_extract(c, r"\(([^()]+)\)$", 1)


def _plate_species(body: Column) -> Column:
    """The bird on a plate: the editor's name for it, else what stands before the first comma or semicolon."""
    core = F.get(F.split(F.trim(body), " [:/] ", 2), F.lit(0))
    editor = F.trim(F.regexp_extract(core, r"\[i\.e\.([^\]]+)\]", 1))
    return F.coalesce(F.nullif(editor, F.lit("")), F.trim(F.get(F.split(core, "[,;]", 2), F.lit(0))))


def _reading(title: Column, series: Column | None = None) -> Column:
    return F.struct(title.alias("title"), (F.lit(None).cast("string") if series is None else series).alias("series"))


def catalog_title(c: Column) -> tuple[Column, Column]:
    """Title and series (or null) of a raw title.

    Character references and white space are resolved and a copy note is cut. A plate of the American birds is named by its
    species. Otherwise a series is what follows ``from the series`` (the part before ``also known as`` is then the title) or
    stands in brackets as ``(from ...)``. A plate number I. becomes 1. unless a II. follows; quotes around the whole go."""

    def without_note(t: Column) -> Column:
        return let(_bracket(t), lambda note: F.when(F.lower(note).isin(*COPY_NOTES), _before_bracket(t, note)).otherwise(t))

    def first_name(called: Column) -> Column:
        known = F.split(called, ", ?also known as ", 2)
        name = F.get(known, F.lit(0))
        return F.when(F.size(known) > 1, let(_bracket(name), lambda held: F.when(held == "", name).otherwise(_before_bracket(name, held)))).otherwise(name)

    def read(t: Column) -> Column:
        plate = F.lower(t).startswith("the birds of america. [livraison]") & t.contains(",")
        species = _plate_species(F.get(F.split(t, ",", 2), F.lit(1)))
        halves = F.split(t, ", ?from the series ", 2)
        of_series = _reading(F.trim(first_name(F.get(halves, F.lit(0)))), F.trim(F.btrim(F.get(halves, F.lit(1)), F.lit('"'))))
        source = _bracket(t)
        of_source = _reading(_before_bracket(t, source), F.trim(F.substring(source, 6, 1 << 30)))
        return F.when(plate, _reading(species)).when(F.size(halves) > 1, of_series).when(source.startswith("from "), of_source).otherwise(_reading(t))

    def finished(t: Column) -> Column:
        arabic = F.when(t.startswith("I. ") & ~t.contains("II."), F.concat(F.lit("1"), F.substring(t, 2, 1 << 30))).otherwise(t)
        return let(arabic, lambda v: F.when(v.startswith('"') & v.endswith('"') & (F.length(v) > 1), F.trim(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v))

    found = let(let(F.trim(F.regexp_replace(decoded(c), r"\s+", " ")), without_note), read)
    return let(found.title, finished), found.series


def without_tags(c: Column) -> Column:
    return F.regexp_replace(blank(c), "<[^>]+>", "")


def without_markdown(c: Column) -> Column:
    """Plain prose: emphasis marks off, outer ones first, links as their text, headings without their signs."""
    return reduce(lambda text, rule: F.regexp_replace(text, *rule), MARKDOWN, blank(c))


def slug(c: Column, most: int | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most:
        out = F.regexp_replace(F.substring(out, 1, most), "-+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(blank(c), "[^A-Za-z0-9_.-]", "")


def file_name(collection: Column, title: Column, url: Column) -> Column:
    """Collection, slug and eight letters of the address's hash."""
    return F.concat(F.concat_ws("__", slug(collection), slug(title, 40), F.substring(F.sha1(url), 1, 8)), F.lit(".jpg"))


def tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank(c), "[|,]"), lambda x: F.trim(x)), lambda x: x != "")


def title_tags(c: Column) -> Column:
    """The first five words of more than three letters."""
    return F.slice(F.filter(F.split(F.lower(blank(c)), r"[^a-z0-9]+"), lambda w: F.length(w) > 3), 1, 5)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(blank(c)), r"\s+"), lambda w: w != "")


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(blank(c)), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def human_size(n: Column) -> Column:
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = F.when(F.lit(False), "")
    for size, unit in steps:
        out = out.when(n >= size, F.concat(F.round(n / size, 1).cast("decimal(20,1)").cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def commons_name(c: Column) -> Column:
    spaced = F.translate(blank(c), "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def redacted(c: Column) -> Column:
    """Secrets replaced, at most 300 letters kept."""
    return F.left(F.regexp_replace(blank(c), r"(?i)((?:token|key|secret|password)\s*[=:]\s*)\S+", "$1<redacted>"), F.lit(300))


def host_label(c: Column) -> Column:
    """A host name of at most 63 letters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(out, 1, 63), "-+$", "")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity; the order of arguments matters."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
