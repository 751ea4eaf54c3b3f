"""Set-at-a-time forms of the application's list processing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import text as X
from vitrine.functions import values as V


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order (arg-max, first-wins dedup, stable picks)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(rank) <= n)


def insert_if_absent(new: DataFrame, old: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """New rows whose key stands nowhere in the old table, one for each key."""
    return first_per_key(new.join(old.select(key).distinct(), key, "left_anti"), [key], order)


def latest(df: DataFrame, key: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Upsert by key: the latest row wins."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("__x")).select(*key, *[F.col(f"__x.{c}").alias(c) for c in rest])


def flagged(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether the key stands in another table, by an equi-join on its distinct keys."""
    return df.join(other.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def contains_all(df: DataFrame, columns: Sequence[Column], query: str) -> DataFrame:
    """Rows in whose columns every word of the query stands somewhere."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = df
    for word in query.lower().split():
        out = out.filter(hay.contains(word))
    return out


def suggest(df: DataFrame, name: str, order: str, query: str, n: int = 10) -> DataFrame:
    """Names with the query at their start first, then inside; at least two letters."""
    q, low = query.strip().lower(), F.lower(F.col(name))
    if len(q) < 2:
        return df.limit(0)
    hits = df.filter(low.contains(q)).groupBy(name).agg(F.min(order).alias(order))
    return hits.orderBy(F.when(low.startswith(q), 0).otherwise(1), order).limit(n)


def range_cuts(df: DataFrame, by: Column, n: int) -> list:
    """At most n - 1 ascending values that cut the rows into ranges of about equal size, from a distributed quantile summary."""
    found = df.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else None
    return sorted(set(found or []))


def range_of(by: Column, cuts: Sequence) -> Column:
    """How many cuts are below the value, by binary search; nulls come first."""
    if not cuts:
        return F.lit(0)
    listed, steps = F.array(*map(F.lit, cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    further = lambda p, s: F.when((p + s <= len(cuts)) & (F.get(listed, p + s - 1) < by), p + s).otherwise(p)
    return F.when(by.isNull(), 0).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further))


def ranges(df: DataFrame) -> int:
    """How many ranges to cut a table into: four a shuffle partition, at most a thousand."""
    return min(1000, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_ranges(df: DataFrame, by: Column, then: Column | None = None, name: str = "__r") -> DataFrame:
    """``df`` with the number of each row's range, in ascending order of ``by`` and, among its frequent values, of ``then``.

    A value that alone spans several quantiles is cut again by quantiles of ``then``, so ties don't make a large range."""
    n = ranges(df)
    found = df.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else None
    spans = Counter(found or [])
    cuts = sorted(spans)
    heavy = {v: k for v, k in spans.items() if k > 1} if then is not None else {}
    place = range_of(by, cuts)
    if not heavy:
        return df.withColumn(name, place.cast("double"))
    rows = df.select(by.alias("v"), then.alias("t")).filter(F.col("v").isin(list(heavy)))
    most = max(heavy.values()) + 1
    inner = {r["v"]: sorted(set(r["q"] or [])) for r in rows.groupBy("v").agg(F.percentile_approx("t", [i / most for i in range(1, most)], 10_000).alias("q")).collect()}  # a row for each heavy value, at most n / 2
    share = F.lit(0.0)
    for v, cut in sorted(inner.items()):
        share = F.when(by == F.lit(v), range_of(then, cut) / F.lit(float(len(cut) + 1))).otherwise(share)
    return df.withColumn(name, place + share)


def numbered(df: DataFrame, keys: Sequence[str], by: Column, order: Sequence[Column], name: str, then: Column | None = None) -> DataFrame:
    """``df`` with the place of each row among those of its keys, from 1, for keys with any number of rows.

    ``order`` begins with ``by``, a number, and goes on with ``then``, another one, if many rows may have one value of ``by``. Rows are
    cut into ranges by quantiles of all rows; a window numbers each range of a key, and the rows of the key's earlier ranges, one
    count each, are added. So no task sorts a whole key. ``df`` is read three times: what is dear to compute is written first."""
    cut = in_ranges(df, by, then)
    counts = cut.groupBy(*keys, "__r").agg(F.count("*").alias("__c"))
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, "__r", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__b"))
    within = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__r").orderBy(*order)))
    same = F.lit(True)
    for k in [*keys, "__r"]:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return within.alias("x").join(before.alias("y"), same).select("x.*", (F.col("__n") + F.col("__b")).alias(name)).drop("__r", "__n")


def clamped_fold(df: DataFrame, key: str, order: Sequence[str], skip: Column, seconds: Column, start: float = 1.0) -> DataFrame:
    """Affinity after all events in order: a skip takes 0.1 down to 0.1, a view adds 0.05 a half minute up to 5.

    Each event is x -> min(max(x + shift, low), high), and such steps are closed under composition. The first of ``order``, a
    time, is cut into ranges by quantiles of all events; each range of a key is composed to one step in its own task, and
    the few steps of a key are then applied in order. So no row or task holds all events of a crowded key."""
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    marked = df.select(key, at.alias("__at"), *order, skip.alias("__skip"), seconds.alias("__sec"))
    marked = marked.withColumn("__r", range_of(F.col("__at"), range_cuts(marked, F.col("__at"), ranges(df))))
    wide = F.lit(1e300)
    whole = F.struct(F.lit(0.0).alias("shift"), (-wide).alias("low"), wide.alias("high"))
    event = F.struct(*order, F.when(F.col("__skip"), F.lit(-0.1)).otherwise(F.coalesce(0.05 * F.col("__sec") / 30.0, F.lit(0.0))).alias("shift"), F.when(F.col("__skip"), F.lit(0.1)).otherwise(-wide).alias("low"), F.when(F.col("__skip"), wide).otherwise(F.lit(5.0)).alias("high"))
    held = lambda v, e: F.least(F.greatest(v + e.shift, e.low), e.high)
    then = lambda a, e: F.struct((a.shift + e.shift).alias("shift"), held(a.low, e).alias("low"), held(a.high, e).alias("high"))
    composed = F.aggregate(F.array_sort(F.collect_list(event)), whole, then)
    parts = marked.groupBy(key, "__r").agg(composed.alias("step"), F.sum("__sec").alias("seconds"), F.count_if("__skip").alias("skips"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("__r", "step"))), lambda x: x.step)
    return parts.groupBy(key).agg(F.aggregate(steps, F.lit(start), held).alias("affinity"), F.sum("seconds").alias("seconds"), F.sum("skips").alias("skips"))


#: Points of a relevance score by what is found.
BY_NAME, BY_LIKENESS, BY_QUERY, TITLE_POINTS, MARK_POINTS, WHOLE_POINTS = 30.0, 25.0, 20.0, 20.0, 20.0, 15.0
IMAGE_POINTS = {r"/full/max/|/full/full/": 15.0, r"width=2000|/print/": 12.0, r"/full/": 10.0, r".": 5.0}
MARKS = r'"ishighlight": ?true|"highlight": ?1|"is_boosted": ?true'


def relevance(artist: str, query: str) -> Column:
    """Score from 0 to 100 of proposed_title, proposed_artist, source_url and context_hints for an artist query."""
    who, what, url, hints = (X.blank(F.col(c)) for c in ("proposed_artist", "proposed_title", "source_url", "context_hints"))
    low, name = F.lower(who), artist.lower()
    alike = X.ratio(X.match_form(F.lit(artist)), X.match_form(who)) >= 0.85
    by = F.when(low.contains(name) | F.lit(name).contains(low), BY_NAME).when(alike, BY_LIKENESS).when(low.contains(query.lower()), BY_QUERY).otherwise(0.0)
    words = F.array(*map(F.lit, query.lower().split())) if query.split() else F.array().cast("array<string>")
    share = F.size(F.filter(words, lambda w: F.lower(what).contains(w))) / F.greatest(F.size(words), F.lit(1))
    image = F.lit(0.0)
    for pattern, points in reversed(IMAGE_POINTS.items()):
        image = F.when(url.rlike(pattern), points).otherwise(image)
    filled = F.array(~what.isin("", "Unknown"), ~who.isin("", "Unknown Artist"), hints != "")
    whole = F.size(F.filter(filled, lambda x: x)) / 3
    return F.round(by + TITLE_POINTS * share + F.when(F.lower(hints).rlike(MARKS), MARK_POINTS).otherwise(0.0) + image + WHOLE_POINTS * whole, 1)


def leader_dedup(df: DataFrame, session: str, key: str, order: Sequence[str], least: float = 0.85) -> DataFrame:
    """In order, a row stays unless its key is similar to one that stays already. Sessions are bounded (a search's results) and independent."""
    from difflib import SequenceMatcher

    def close(k: str, x: str, letters: Counter, others: Counter) -> bool:
        """Equal texts are alike; the lengths and the letters that two texts share bound their ratio from above."""
        size = len(k) + len(x)
        if k == x:
            return True
        if 2 * min(len(k), len(x)) < least * size or 2 * (letters & others).total() < least * size:
            return False
        return SequenceMatcher(None, k, x).ratio() >= least

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(list(order))
        kept: dict[str, Counter] = {}
        stay = []
        for k in ordered[key]:
            letters = Counter(k or "")
            stay.append(not k or not (k in kept or any(close(k, x, letters, others) for x, others in kept.items())))
            if stay[-1] and k:
                kept[k] = letters
        return ordered[stay]

    return df.groupBy(session).applyInPandas(keep, df.schema)


def weighted_order(df: DataFrame, group: str, weight: Column, seed: int = 7) -> DataFrame:
    """A whole bag drawn without replacement: descending log(u) / weight, with u from a hash of the row's id."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    turn = F.log(u) / F.greatest(F.lit(0.1), weight) * -1
    return numbered(df, [group], turn, [turn, F.col("id")], "draw")


def pixel_statistics(df: DataFrame, keys: Sequence[str], value: Column, low: float, high: float, bins: int = 256, over: float | None = None) -> DataFrame:
    """(keys, n, mean, deviation, share_over, histogram) of a number, in one pass over the rows.

    Rows are added up by bin, so tasks hand on at most ``bins`` rows of a key whatever its size, and these make the key's array of counts.
    Bins are even from ``low`` to ``high``; what lies outside counts in the outer ones. Nulls and NaN count nowhere; a key of nothing else has n 0,
    nulls and an empty histogram of zeros. The deviation is that of all rows, not of a sample."""
    v = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) * (bins / (high - low))))).cast("int")
    sums = df.select(*keys, v.alias("__v"), F.when(v.isNotNull(), place).alias("__b")).groupBy(*keys, "__b").agg(F.count("__v").alias("__n"), F.sum("__v").alias("__s"), F.sum(F.col("__v") * F.col("__v")).alias("__q"), F.count_if(F.col("__v") > (high if over is None else over)).alias("__o"))
    counts = F.map_from_entries(F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__n"))))
    each = sums.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum("__s").alias("__s"), F.sum("__q").alias("__q"), F.sum("__o").alias("__o"), counts.alias("__c"))
    n = F.nullif("n", F.lit(0))
    mean = F.col("__s") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / n - mean * mean))
    histogram = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("__c", i), F.lit(0).cast("long")))
    return each.select(*keys, "n", mean.alias("mean"), deviation.alias("deviation"), (F.col("__o") / n).alias("share_over"), histogram.alias("histogram"))


def least_squares(df: DataFrame, features: Sequence[str], target: str) -> tuple[np.ndarray, float]:
    """Coefficients (the intercept first) and R squared from one aggregate of products; only k x k sums reach the driver."""
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * y) for a in x] + [F.sum(y * y)]
    row = list(df.dropna(subset=[*features, target]).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    k, at = len(x), 0
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at]
            at += 1
    xy, yy = np.array(row[at : at + k]), row[at + k]
    beta = np.linalg.lstsq(m, xy, rcond=None)[0]
    total = yy - xy[0] ** 2 / m[0, 0]
    return beta, 1 - (yy - 2 * beta @ xy + beta @ m @ beta) / total if total else 1.0


def holdout_residuals(df: DataFrame, features: Sequence[str], target: str, held: Column) -> DataFrame:
    """Rows that are held out, with ``predicted`` by least squares on the others, clamped to the targets learned from, and ``residual``.

    Fewer rows to learn from than features and two are an error."""
    rest = df.filter(~held)
    size = rest.agg(F.count("*").alias("n"), F.min(target).alias("low"), F.max(target).alias("high")).first()
    if size["n"] < len(features) + 2:
        raise ValueError(f"only {size['n']} rows to learn {len(features)} features from")
    beta, _ = least_squares(rest, features, target)
    guess = sum((float(b) * F.col(f) for b, f in zip(beta[1:], features, strict=True)), F.lit(float(beta[0])))
    told = df.filter(held).withColumn("predicted", F.greatest(F.lit(float(size["low"])), F.least(F.lit(float(size["high"])), guess)))
    return told.withColumn("residual", F.col("predicted") - F.col(target))


def farthest_points(df: DataFrame, id_col: str, features: Sequence[str], n: int) -> list:
    """Greedy max-min selection of a few rows: each round keeps distances to the nearest chosen row and picks the farthest. n is small and bounds the rounds."""
    first = df.orderBy(id_col).first()
    chosen = [first]
    for _ in range(n - 1):
        d = F.least(*[sum((F.pow(F.col(f) - float(c[f]), 2) for f in features), F.lit(0.0)) for c in chosen], F.lit(float("inf")))
        left = df.filter(~F.col(id_col).isin([c[id_col] for c in chosen])).withColumn("__d", d)
        found = left.agg(F.min_by(F.struct(*df.columns), F.struct(-F.col("__d"), id_col)).alias("x")).first()["x"]
        if found is None:
            break
        chosen.append(found)
    return [c[id_col] for c in chosen]


def reach(edges: DataFrame, root: str, most: int) -> DataFrame:
    """Nodes within ``most`` steps of a root in (parent, child), each at its first depth; the frontier stays distributed."""
    seen = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    front = seen
    for depth in range(1, most + 1):
        front = edges.join(front.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


def manifest_errors(df: DataFrame) -> DataFrame:
    """(id, errors) of manifests with items(title, image(full_url, local_file, license, attribution, focal_point)): a list of the faults in item order."""

    def faults(item: Column, i: Column) -> Column:
        at = F.concat(F.lit("items["), i.cast("string"), F.lit("]"))
        image = item.image
        filled = lambda c: F.trim(X.blank(c)) != ""
        point = image.focal_point
        wrong = point.isNotNull() & ((F.size(point) != 2) | F.exists(point, lambda v: (v < 0) | (v > 1)))
        return F.array_compact(F.array(
            F.when(~filled(item.title), F.concat(at, F.lit(".title is required"))),
            F.when(~filled(image.full_url) & ~filled(image.local_file), F.concat(at, F.lit(".image: one of full_url or local_file is required"))),
            F.when(image.license.isNull() & ~filled(F.col("default_license")), F.concat(at, F.lit(".image.license is required"))),
            F.when(image.license.isNotNull() & ~filled(image.license), F.concat(at, F.lit(".image.license must be filled"))),
            F.when(F.lower(F.trim(image.license)).startswith("cc-by") & ~filled(image.attribution), F.concat(at, F.lit(".image.attribution is required"))),
            F.when(wrong, F.concat(at, F.lit(".image.focal_point must be two numbers from 0 to 1"))),
        ))

    top = F.array_compact(F.array(F.when(F.trim(X.blank(F.col("title"))) == "", F.lit("title is required")), F.when(F.size("items") < 1, F.lit("items must not be empty"))))
    return df.select("id", F.concat(top, F.flatten(F.transform("items", faults))).alias("errors"))


#: How exact an aspect must be, how large a box, from where it is fine, and how far a focal point stays from its edges.
ASPECT_TOLERANCE, LEAST_EXTENT, FINE_EXTENT, FOCAL_MARGIN = 0.005, 0.90, 0.98, 0.05


def gate_crops(df: DataFrame, target: float) -> DataFrame:
    """Snapped boxes of (id, x0, y0, x1, y1, aspect, fx, fy) with ``reason``, the first fault for which a box is dropped or null, and ``warning`` for one that is kept but not large.

    A focal coordinate of exactly 0.5, outside the frame or null says nothing. A box with a missing coordinate is ``malformed``."""
    corners = ["x0", "y0", "x1", "y1"]
    box = df.withColumns(dict(zip([f"s{c}" for c in corners], V.snapped(*map(F.col, corners), F.col("aspect"), target), strict=True)))
    across, down = F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0")
    extent = F.greatest(across, down)
    got = F.col("aspect") * across / F.greatest(down, F.lit(1e-9))

    def cramped(axis: str, length: Column) -> Column:
        f = F.col(f"f{axis}")
        room = F.least(f - F.col(f"s{axis}0"), F.col(f"s{axis}1") - f)
        return f.between(0, 1) & (f != 0.5) & (room < FOCAL_MARGIN * length - 1e-12)

    faults = {
        "malformed": F.array_contains(F.transform(F.array(*corners, "aspect"), lambda v: v.isNull()), True),
        "aspect_inexact": F.abs(got - target) > ASPECT_TOLERANCE * target,
        "not_maximal": extent < LEAST_EXTENT,
        "focal_outside": cramped("x", across) | cramped("y", down),
    }
    listed = F.array_compact(F.array(*[F.when(F.coalesce(found, F.lit(False)), F.lit(name)) for name, found in faults.items()]))
    return box.withColumns({"reason": F.get(listed, F.lit(0)), "warning": F.when((F.size(listed) == 0) & (extent < FINE_EXTENT), F.lit("near_maximal"))})


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """JSON text with sorted keys and no spaces, without its signature; null if it doesn't parse."""
    import json

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(t):
            try:
                found = json.loads(t)
            except (TypeError, ValueError):
                return None
            if isinstance(found, dict):
                found.pop("signature", None)
            return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

        for b in batches:
            yield b.assign(canonical=b[column].map(one))

    from pyspark.sql import types as T

    return df.mapInPandas(rows, T.StructType([*df.schema.fields, T.StructField("canonical", T.StringType())]))
