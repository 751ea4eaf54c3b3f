"""Building a collection from what its picks and searches found: budgets, one row for each work, a fill up to a target, floors of size, crops of an item.

Everything is set at a time. A collection may hold any share of all rows: places come from ``numbered``, which cuts keys into
ranges, and the rows of one key and address that could not matter are dropped before any window sees them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import values as V
from vitrine.functions.text import let
from vitrine.operators.core import ASPECT_TOLERANCE, FINE_EXTENT, FOCAL_MARGIN, LEAST_EXTENT, numbered
from vitrine.operators.lineage import checkpoint

#: The least long edge of a picture, that of works kept from before the floor was raised, and the target of a collection that names none.
FLOOR, OLD_FLOOR, TARGET = 3840, 2160, 20
#: Names of crop shapes, what counts as the whole frame, and how far a corner may move before it is told.
SHAPES, EDGE, MOVED_FAR = ("16:9", "9:16", "4:3", "3:4"), 0.002, 0.15


#: Rows of the first slab of a loop that is settled by slabs of place, and how many times larger each next one is.
SLAB, GROWTH = 50_000, 4


def budget(target: Column, queries: Column) -> Column:
    """How many rows a collection asks of each of its queries."""
    return F.greatest(F.lit(6), F.floor(target / F.greatest(queries, F.lit(1))) + 4)


def within_budgets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Of what queries found (collection, query, place, ...) the first rows of each, as many as the collection's budget (collection, target) allows."""
    queries = found.groupBy("collection").agg(F.countDistinct("query").alias("__q"))
    asked = targets.join(queries, "collection").select("collection", budget(F.col("target"), F.col("__q")).alias("__budget"))
    placed = numbered(found, ["collection", "query"], F.col("place"), [F.col("place")], "__at")
    return placed.join(asked, "collection").filter(F.col("__at") <= F.col("__budget")).drop("__at", "__budget")


def one_of_each_work(items: DataFrame, group: str, place: str, url: str, key: str, score: str) -> DataFrame:
    """One row for each key, as a loop in order of place finds it, with ``first``, the place at which the key came in.

    The loop passes over a row whose address stands in the list already, takes the first row of a key, and lets a row with a higher score
    take the place of the one that stands, whose address is free again from then on. Rows without an address or key are left out.

    What a row does depends on rows before it only, so the rows are taken in slabs of place, each several times as large as the one before.
    What earlier slabs left standing goes on into the next, and rows that can't be taken any more are dropped first (see ``_alive``). In a slab rounds
    settle it (see ``_settled``). A score is the address's, so where an address belongs to one key alone, its first row stands for all."""
    given = items.filter(F.col(url).isNotNull() & F.col(key).isNotNull()).withColumnsRenamed({group: "__g", place: "__p", url: "__u", key: "__k", score: "__s"})
    ours = given.select("__g", "__p", "__u", "__k", F.coalesce("__s", F.lit(0)).alias("__s"))
    shared = ours.groupBy("__g", "__u").agg(F.min("__k").alias("__lo"), F.max("__k").alias("__hi")).filter("__lo <> __hi").select("__g", "__u")
    alone = ours.join(shared, ["__g", "__u"], "left_anti").groupBy("__g", "__u", "__k").agg(F.min("__p").alias("__p"), F.min_by("__s", "__p").alias("__s"))
    rest = checkpoint(alone.unionByName(ours.join(shared, ["__g", "__u"], "left_semi")).select("__g", "__p", "__u", "__k", "__s"))
    size, cuts = rest.count(), []
    while size > SLAB * GROWTH ** len(cuts):
        cuts.append(1.0 / GROWTH ** (len(cuts) + 1))
    bounds = sorted(set(rest.agg(F.percentile_approx("__p", cuts, 10_000).alias("q")).first()["q"])) if cuts and size else []
    taken = None
    for bound in [*bounds, None]:
        slab = rest if bound is None else rest.filter(F.col("__p") <= bound)
        rows = slab.withColumn("__known", F.lit(False))
        taken = _settled(rows if taken is None else rows.unionByName(taken.withColumn("__known", F.lit(True))))
        if bound is not None:
            rest = _alive(rest.filter(F.col("__p") > bound), taken)
    chosen = taken.groupBy("__g", "__k").agg(F.max("__p").alias("__p"), F.min("__p").alias("first"))
    return given.join(chosen, ["__g", "__k", "__p"]).withColumnsRenamed({"__g": group, "__p": place, "__u": url, "__k": key, "__s": score})


def _settled(rows: DataFrame) -> DataFrame:
    """The rows that the loop takes, of all rows up to some place; those that are ``__known`` to be taken come before the others.

    Taken rows are guessed, two windows (the best taken score of the key so far; whether the address's last taken row still stands) correct
    them, and each round the rows up to the first wrong one are right for good."""
    rows = rows.withColumn("taken", F.lit(True))
    by_key, by_url = Window.partitionBy("__g", "__k").orderBy("__p"), Window.partitionBy("__g", "__u").orderBy("__p")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    later = by_key.rowsBetween(1, Window.unboundedFollowing)
    while True:
        best = F.max(F.when(F.col("taken"), F.col("__s"))).over(earlier(by_key))
        ends = F.first(F.when(F.col("taken"), F.col("__p")), ignorenulls=True).over(later)
        marked = rows.withColumns({"__best": best, "__mine": F.when(F.col("taken"), F.struct("__p", ends.alias("end")))})
        last = F.last("__mine", ignorenulls=True).over(earlier(by_url))
        stands = last.isNotNull() & (last["end"].isNull() | (last["end"] > F.col("__p")))
        taken = F.col("__known") | (~F.coalesce(stands, F.lit(False)) & (F.col("__best").isNull() | (F.col("__s") > F.col("__best"))))
        after = checkpoint(marked.withColumn("__new", taken).select("__g", "__p", "__u", "__k", "__s", "__known", "taken", "__new"))
        settled = after.filter("taken <> __new").isEmpty()
        rows = after.select("__g", "__p", "__u", "__k", "__s", "__known", F.col("__new").alias("taken"))
        if settled:
            return rows.filter("taken").select("__g", "__p", "__u", "__k", "__s")


def _alive(rest: DataFrame, taken: DataFrame) -> DataFrame:
    """Of later rows those that may still be taken, given what is taken of all rows before them.

    A row isn't taken if its key has a score as high, nor if its address stands for a key of which no living row has a higher score: that stands for
    good. Rows that die may make other addresses stand for good, so this is asked again until nothing changes, on one row for each key and address."""
    best = taken.groupBy("__g", "__k").agg(F.max("__s").alias("__best"))
    # scores of a key rise, so its best taken row is the one that stands
    standing = taken.join(best, ["__g", "__k"]).filter(F.col("__s") == F.col("__best")).select("__g", "__u", "__k", "__best")
    kinds = rest.groupBy("__g", "__k", "__u").agg(F.max("__s").alias("__s")).join(best, ["__g", "__k"], "left")
    kinds = checkpoint(kinds.filter("__best is null or __s > __best").select("__g", "__k", "__u", "__s"))
    left = kinds.count()
    while True:
        hopes = kinds.groupBy("__g", "__k").agg(F.lit(True).alias("__hope"))
        for_good = standing.join(hopes, ["__g", "__k"], "left_anti").select("__g", "__u")
        kinds = checkpoint(kinds.join(for_good, ["__g", "__u"], "left_anti"))
        before, left = left, kinds.count()
        if left == before:
            break
    living = rest.join(kinds.select("__g", "__k", "__u"), ["__g", "__k", "__u"], "left_semi").join(best, ["__g", "__k"], "left")
    return checkpoint(living.filter("__best is null or __s > __best").select("__g", "__p", "__u", "__k", "__s"))


def assemble(picks: DataFrame, found: DataFrame, specs: DataFrame) -> DataFrame:
    """The items of collections (collection, target, supplement, kind): (collection, place, source, url, kind).

    ``picks`` and ``found`` hold (collection, place, key, url, thumbnail, dated, score, source, verified); picks come first, what
    queries found only tops up where the collection asks for a supplement. Of each work one row stays; dated works come before others,
    then better ones, then earlier ones; of the first 2 * target those that are verified (picks are; ``verified`` null means not) fill the target."""
    told = specs.select("collection", F.coalesce("target", F.lit(TARGET)).alias("target"), F.coalesce("supplement", F.lit(False)).alias("supplement"), "kind")
    first = picks.withColumns({"__pick": F.lit(True), "verified": F.lit(True)})
    more = found.withColumn("__pick", F.lit(False)).join(told.filter("supplement").select("collection"), "collection", "left_semi")
    both = first.unionByName(more).filter("thumbnail is not null and thumbnail <> '' and url <> ''")
    both = both.withColumn("__order", F.when(F.col("__pick"), F.lit(0)).otherwise(F.lit(1 << 40)) + F.col("place"))
    works = checkpoint(one_of_each_work(both, "collection", "__order", "url", "key", "score"))  # read several times, as what follows is
    worth = -(F.coalesce(F.col("dated").cast("int"), F.lit(0)) * 1000 + F.coalesce("score", F.lit(0)))
    ranked = numbered(works.withColumn("__w", worth), ["collection"], F.col("__w"), [F.col("__w"), F.col("first")], "__rank", then=F.col("first"))
    sound = checkpoint(ranked.join(told, "collection").filter((F.col("__rank") <= 2 * F.col("target")) & F.coalesce("verified", F.lit(False))))
    filled = numbered(sound, ["collection"], F.col("__rank"), [F.col("__rank")], "n").filter(F.col("n") <= F.col("target"))
    return filled.select("collection", F.col("n").cast("int").alias("place"), "source", "url", "kind")


def floor_of(collection: Column, old: Column, floors: Mapping[str, int], floor: int = FLOOR) -> Column:
    """The least long edge that a work of a collection needs: the collection's own or the usual one, and for works from before at most the old one."""
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), collection), F.lit(floor)) if floors else F.lit(floor)
    return F.when(F.coalesce(old, F.lit(False)), F.least(own, F.lit(OLD_FLOOR))).otherwise(own)


def size_verdict(edge: Column, floor: Column, cropped: Column) -> Column:
    """``kept``, ``cropped`` for one under the floor that was cropped by hand and is kept so, ``too_small``; an unknown size is 0."""
    small = F.coalesce(edge, F.lit(0)) < floor
    return F.when(~small, "kept").when(F.coalesce(cropped, F.lit(False)), "cropped").otherwise("too_small")


def box_is_sound(box: Column) -> Column:
    """Four shares that span an area."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    return F.coalesce((F.size(box) == 4) & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1), F.lit(False))


def box_is_whole(box: Column) -> Column:
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    return F.coalesce((F.size(box) == 4) & (x0 <= EDGE) & (y0 <= EDGE) & (x1 >= 1 - EDGE) & (y1 >= 1 - EDGE), F.lit(False))


def gated_box(box: Column, aspect: Column, fx: Column, fy: Column, target: float) -> Column:
    """A struct of a sound box: ``box`` snapped to the target's aspect, ``reason`` for which it is dropped or null, and ``warnings``."""

    def judged(s: Column) -> Column:
        x0, y0, x1, y1 = (F.get(s, F.lit(i)) for i in range(4))
        across, down = x1 - x0, y1 - y0
        extent = F.greatest(across, down)
        cramped = lambda f, low, high: f.between(0, 1) & (f != 0.5) & (F.least(f - low, high - f) < FOCAL_MARGIN * (high - low) - 1e-12)
        off = F.abs(aspect * across / F.greatest(down, F.lit(1e-9)) - target) > ASPECT_TOLERANCE * target
        close = F.coalesce(cramped(fx, x0, x1), F.lit(False)) | F.coalesce(cramped(fy, y0, y1), F.lit(False))
        reason = F.when(off, "aspect_inexact").when(extent < LEAST_EXTENT, "not_maximal").when(close, "focal_outside")
        moved = F.exists(F.zip_with(box, s, lambda a, b: F.abs(a - b)), lambda d: d > MOVED_FAR)
        warnings = F.array_compact(F.array(F.when(reason.isNull() & (extent < FINE_EXTENT), F.lit("near_maximal")), F.when(moved, F.lit("snap_moved_far"))))
        return F.struct(s.alias("box"), reason.alias("reason"), warnings.alias("warnings"))

    return let(V.snapped_box(*[F.get(box, F.lit(i)) for i in range(4)], aspect, target), judged)


def gate_items(df: DataFrame, shapes: Sequence[str] = SHAPES) -> DataFrame:
    """Items (id, aspect, fx, fy, crops as a map of boxes by shape) with what is kept of their crops: (id, crops, verdict, dropped).

    One malformed box (not four shares that span an area) says that the whole item can't be trusted: nothing is kept and the verdict is
    ``malformed``. A sound box that fails the gate takes only its own shape with it, for the reason in ``dropped``. A box of the whole
    frame is kept as such. If nothing is left the verdict is ``empty``, else null. Other shapes' boxes are passed over."""

    def of(name: str) -> Column:
        wide, high = map(float, name.split(":"))
        gated = lambda box: gated_box(box, F.col("aspect"), F.col("fx"), F.col("fy"), wide / high)
        whole = F.struct(F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("box"), F.lit(None).cast("string").alias("reason"), F.array().cast("array<string>").alias("warnings"))
        bad = F.struct(F.lit(None).cast("array<double>").alias("box"), F.lit("malformed").alias("reason"), F.array().cast("array<string>").alias("warnings"))
        told = let(F.element_at("crops", name), lambda box: F.when(box_is_whole(box), whole).when(box_is_sound(box), gated(box)).otherwise(bad))
        return F.when(F.array_contains(F.map_keys("crops"), name), F.struct(F.lit(name).alias("shape"), told.alias("told")))

    found = df.withColumn("__all", F.array_compact(F.array(*map(of, shapes)))).withColumn("__bad", F.exists("__all", lambda x: F.coalesce(x.told.reason == "malformed", F.lit(False))))
    pairs = lambda keep, value: F.map_from_entries(F.transform(F.filter("__all", keep), lambda x: F.struct(x["shape"], value(x))))
    kept = F.when(F.col("__bad"), F.create_map().cast("map<string,array<double>>")).otherwise(pairs(lambda x: x.told.reason.isNull(), lambda x: x.told.box))
    dropped = pairs(lambda x: x.told.reason.isNotNull(), lambda x: x.told.reason)
    verdict = F.when(F.col("__bad"), "malformed").when(F.size("crops") == 0, "empty")
    return found.withColumns({"crops": kept}).withColumn("dropped", dropped).withColumn("verdict", verdict).select("id", "crops", "verdict", "dropped")
