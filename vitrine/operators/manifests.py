"""Manifest documents checked against a described schema, which becomes one nested Catalyst expression over a variant.

A rule takes a value (a variant, null where the key is absent) and its path, and gives the texts of its faults. Rules are put together by
``shape`` (an object's keys), ``each`` (an array's elements) and ``entries`` (a map's values), and paths grow on the way down, so
a whole document is one column expression: no Python row, no join, one pass. Unknown keys are allowed everywhere.

A null text and one that isn't JSON (or repeats a key) is no object. JSON's null counts as absent where a key may be left out by null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import let

Rule = Callable[[Column, Column | None], Column]

#: The version of manifests, what an access text looks like, and which licences ask for attribution.
VERSION = 2
ACCESS = r"(?i)^(free|entitlement:[a-z0-9_-]+:.+)$"
ATTRIBUTED = r"(?i)^cc-by"


def at(path: Column | None, name: str) -> Column:
    return F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))


def said(wrong: Column, *text: Column | str) -> Column:
    """A list of one text if something is wrong, else an empty one."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))).otherwise(F.array().cast("array<string>"))


def kind(v: Column) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...> and so on; empty if there is no value."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def text_of(v: Column) -> Column:
    """The value if it is a text, else null."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def filled(v: Column) -> Column:
    return F.coalesce(text_of(v).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def there(v: Column) -> Column:
    return v.isNotNull() & (kind(v) != "VOID")


def whole(v: Column) -> Column:
    """Whether a number is whole: digits without a point. Truth values count as numbers."""
    long_ = kind(v).rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    return kind(v).isin("BIGINT", "BOOLEAN") | long_


def shares(v: Column, n: int) -> Column:
    """Whether a value is an array of n numbers from 0 to 1."""
    number = lambda x: kind(x).rlike("^(BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*)$") & F.try_variant_get(x, "$", "double").between(0, 1)
    return F.coalesce(let(F.try_variant_get(v, "$", "array<variant>"), lambda a: (F.size(a) == n) & F.forall(a, lambda x: F.coalesce(number(x), F.lit(False)))), F.lit(False))


def get(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def asks(holds: Callable[[Column], Column], *text: str) -> Rule:
    """A rule that says ``path text`` unless the value holds."""
    return lambda v, path: said(~holds(v), path, *text)


required = asks(filled, " is required (non-empty string)")


def need(name: str, rule: Rule) -> Rule:
    """The key's value must pass, also if it is absent."""
    return lambda v, path: let(get(v, name), lambda x: rule(x, at(path, name)))


def may(name: str, rule: Rule, null: bool = False) -> Rule:
    """The key's value must pass if the key is there; with ``null``, a null is as if it weren't."""
    return lambda v, path: let(get(v, name), lambda x: F.when(there(x) if null else x.isNotNull(), rule(x, at(path, name))).otherwise(F.array().cast("array<string>")))


def shape(*rules: Rule, wrong: str = " must be an object") -> Rule:
    """All rules' faults in their order, or one fault if the value is no object."""
    return lambda v, path: F.when(kind(v).startswith("OBJECT"), F.concat(*[r(v, path) for r in rules])).otherwise(said(F.lit(True), *([path] if path is not None else []), wrong))


def each(rule: Rule, wrong: str = " must be an array") -> Rule:
    def faults(v: Column, path: Column) -> Column:
        inner = lambda a: F.flatten(F.transform(a, lambda x, i: rule(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(kind(v).startswith("ARRAY"), inner(F.try_variant_get(v, "$", "array<variant>"))).otherwise(said(F.lit(True), path, wrong))

    return faults


def entries(rule: Rule, wrong: str = " must be an object") -> Rule:
    def faults(v: Column, path: Column) -> Column:
        listed = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        inner = F.flatten(F.transform(listed, lambda e: rule(e.value, F.concat(path, F.lit("['"), e.key, F.lit("']")))))
        return F.when(kind(v).startswith("OBJECT"), inner).otherwise(said(F.lit(True), path, wrong))

    return faults


def licensed(by_default: Column | None = None) -> Rule:
    """An asset has a licence, or the manifest has one for all; a CC-BY licence names whom it is due to."""

    def faults(v: Column, path: Column) -> Column:
        licence, none = get(v, "license"), F.lit(False) if by_default is None else by_default
        due = let(text_of(licence), lambda t: said(F.trim(t).rlike(ATTRIBUTED) & ~filled(get(v, "attribution")), path, ".attribution is required when license is '", t, "'"))
        unset = said(~none, path, ".license is required (no manifest default_license set)")
        return F.when(~there(licence), unset).when(~filled(licence), said(F.lit(True), path, ".license must be a non-empty string")).otherwise(due)

    return faults


def texts(v: Column) -> Column:
    return F.coalesce(F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: kind(x) == "STRING"), F.lit(False))


def addressed(v: Column, path: Column) -> Column:
    return said(~filled(get(v, "full_url")) & ~filled(get(v, "local_file")), path, ": one of full_url or local_file is required (non-empty string)")


def shown(v: Column) -> Column:
    """A value as the fault text prints it."""
    plain = F.initcap(F.to_json(v))
    return F.when(~there(v), "None").when(kind(v) == "STRING", F.concat(F.lit("'"), text_of(v), F.lit("'"))).when(kind(v) == "BOOLEAN", plain).otherwise(F.to_json(v))


def version(v: Column, path: Column) -> Column:
    number = F.when(kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    return said(~F.coalesce(number == VERSION, F.lit(False)), path, f" must be {VERSION} (got ", shown(v), ")")


def manifest(by_default: Column) -> Rule:
    """The whole schema: every line is a rule, in the order in which faults are told."""
    unit = " must be [x0,y0,x1,y1] with each value a number in 0..1"
    image = shape(
        addressed,
        *[may(side, asks(whole, " must be an integer")) for side in ("width", "height")],
        may("focal_point", asks(lambda v: shares(v, 2), " must be [x, y] with each value a number in 0..1"), null=True),
        may("aspect_crops", entries(asks(lambda v: shares(v, 4), unit)), null=True),
        licensed(by_default),
    )
    body = lambda v, path: said(~filled(get(v, "body")), path, " must be an object with a non-empty 'body'")
    point = shape(need("commentary", required), need("bbox", asks(lambda v: shares(v, 4), " must be [x, y, w, h] with each value a number in 0..1")))
    track = shape(need("url", required), licensed())
    interpretation = shape(
        need("author", asks(filled, " is required (interpretation is separately authored)")),
        licensed(),
        may("sections", each(body), null=True),
        may("points_of_interest", each(point), null=True),
        may("audio", each(track), null=True),
    )
    item = shape(
        need("id", required),
        need("title", required),
        may("tags", asks(texts, " must be an array of strings")),
        may("access", asks(lambda v: F.coalesce(text_of(v).rlike(ACCESS), F.lit(False)), " must be 'free' or 'entitlement:<provider>:<id>'")),
        need("image", lambda v, path: F.when(v.isNull(), said(F.lit(True), path, " is required")).otherwise(image(v, path))),
        may("interpretation", interpretation),
    )
    return shape(
        need("manifest_version", version),
        need("id", required),
        need("title", required),
        may("cover_image", asks(filled, " must be a non-empty string (URL) when present")),
        may("publisher", shape(need("id", required), need("name", required))),
        need("items", each(item, wrong=" is required (array)")),
        wrong="manifest must be a JSON object",
    )


def manifest_faults_of(v: Column) -> Column:
    """The faults of a parsed manifest, in order; an empty list if it is valid."""
    return manifest(filled(get(v, "default_license")))(v, None)


def manifest_faults(document: Column) -> Column:
    """The faults of a manifest's JSON text, in order; an empty list if it is valid."""
    return let(F.try_parse_json(document), manifest_faults_of)
