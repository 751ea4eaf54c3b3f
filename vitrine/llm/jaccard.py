"""Near-duplicate groups: an exact Jaccard join of word-shingle sets in metric space.

Distances between documents that share nothing are all one, so no pivot can tell them apart. A first cut
therefore forms regions around pivots by what near documents must share: in one order of all shingles, two
sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1`` of each. The pivot of a shingle is the
smallest set that has it there; a set goes to the region of every pivot that it meets so, at the boundary to several.
Shingles that many documents hold come last in the order, which only affects speed.

Within a region, pivots are drawn again and create Voronoi cells. Jaccard distance is a metric, so a set
whose distances to its own and another pivot differ by at most twice the joined distance is replicated to that
cell as well; cells join recursively. Small cells compare what the triangle inequality leaves: sets whose
sizes, and whose counts in 64 slices of the hash space, allow the threshold, and which aren't connected yet. Regions too
large for one task are cut into cells by Spark in the same way, and what no pivot cuts is joined in pairs of tiles.

Sets with equal shingles are one node, whatever ids their rows have. A null or empty text, or one without words, has no
shingles and links with nothing. Rows without an id link others as any row does; they take their set's component, but no
component is named by them, and one without any id has none. Repeated rows stay; other columns are not carried along.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import begin, keyed, materialize, partitions
from vitrine.llm.components import components

LONG = 1500  # sets of at least so many shingles have finer slices: 64 tell too little
SLICES, LEAF, PIVOTS, CAP, CROWD, CROWDED = 64, 8, 8, 3000, 100_000, 8
SHINGLES = 1 << 22  # of all sets of a region that one task joins; one set may have more
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LETTERS = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            have = _powers[k]
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
            _powers[k] = have
    return _powers


def shingles(text: str, k: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles of k words; of the whole sequence if it has fewer."""
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)  # bytes: only A-Z change
    inner = np.zeros(len(raw) + 2, dtype=np.int8)
    inner[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inner)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[raw] * up[: len(raw)], out=sums[1:])
    words = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + words[i : len(words) - k + 1 + i]
    return np.unique(_mixed(out))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """96 bits that stand for a set."""
    return struct.unpack("<qi", hashlib.blake2b(s.tobytes(), digest_size=12).digest())


def among(s: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Which of s stand in the ascending ``crowded``."""
    if not len(crowded):
        return np.zeros(len(s), dtype=bool)
    return crowded[np.minimum(np.searchsorted(crowded, s), len(crowded) - 1)] == s


def prefix(s: np.ndarray, crowded: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles in the common order (hash, crowded ones last), one of which any set near enough shares."""
    n = len(s)
    size = n - -(-num * n // den) + 1
    last = among(s, crowded)
    return np.concatenate([s[~last], s[last]])[:size]


def near(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


class Region:
    """Exact components of the sets of one region."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets])
        self.of = np.arange(len(sets))
        owner = np.repeat(np.arange(len(sets)), self.size)
        slices = (np.concatenate(sets) & np.uint64(SLICES - 1)).astype(np.int64)
        self.counts = np.bincount(owner * SLICES + slices, minlength=len(sets) * SLICES).reshape(-1, SLICES).astype(np.int32)

    def union(self, i: int, j: int) -> None:
        a, b = sorted((int(self.of[i]), int(self.of[j])))
        if a != b:
            self.of[self.of == b] = a

    def distances(self, pivot: int, members: np.ndarray) -> np.ndarray:
        p = self.sets[pivot]
        flat = np.concatenate([self.sets[x] for x in members])
        to = np.minimum(np.searchsorted(p, flat), len(p) - 1)
        size = self.size[members]
        shared = np.add.reduceat((p[to] == flat).astype(np.int64), np.cumsum(size) - size)
        return 1 - shared / (size + len(p) - shared)

    def join(self, members: np.ndarray) -> None:
        """Links all pairs of members that reach the threshold, but for those that are connected already."""
        if len(members) < 2 or (self.of[members] == self.of[members[0]]).all():
            return
        if len(members) <= LEAF:
            return self.leaf(members)
        reach = 1 - self.num / self.den
        pivots = [int(members[0])]
        rows = [self.distances(pivots[0], members)]
        for x in members[rows[0] <= reach]:
            self.union(pivots[0], int(x))
        while len(pivots) < PIVOTS:
            far = np.min(rows, axis=0)
            k = int(far.argmax())
            if far[k] <= 0:
                break
            pivots.append(int(members[k]))
            rows.append(self.distances(pivots[-1], members))
            for x in members[rows[-1] <= reach]:
                self.union(pivots[-1], int(x))
        d = np.array(rows)
        window = d <= d.min(axis=0) + 2 * reach + 1e-9
        if window.sum() > 2 * len(members) or window.sum(axis=1).max() > 0.9 * len(members):
            return self.leaf(members)
        for cell in window:
            self.join(members[cell])
        return None

    def leaf(self, members: np.ndarray) -> None:
        members = members[np.argsort(self.size[members], kind="stable")]
        size, counts = self.size[members], self.counts[members]
        top = np.searchsorted(size, size * self.den // self.num, side="right")
        for i, x in enumerate(members.tolist()):
            rest = np.arange(i + 1, top[i])
            rest = rest[self.of[members[rest]] != self.of[x]]
            if not len(rest):
                continue
            # |a ^ b| is at least the sum of differences over slices, and at most this share of |a| + |b| for a link
            least = np.abs(counts[rest] - counts[i]).sum(axis=1)
            rest = rest[least * (self.den + self.num) <= (self.den - self.num) * (size[rest] + size[i])]
            for y in members[rest].tolist():
                if self.of[x] != self.of[y] and near(self.sets[x], self.sets[y], self.num, self.den):
                    self.union(x, y)


def region_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the first of its component."""
    region = Region(sets, num, den)
    region.join(np.arange(len(sets)))
    return region.of


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, cap: int = CAP, keep_hash: bool = False) -> DataFrame:
    """(id, n_shingles, component_id): documents are linked when den * intersection >= num * union; ``keep_hash`` adds the text's ``text_hash`` and whether the row is its group's ``first``, the least by id and hash.

    Two passes shingle all texts: one keeps a sketch of each, one its prefix. Texts travel only for sets that have partners."""
    given, kind = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    given = given.withColumn("t", F.xxhash64("text"))

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("ngram_jaccard")
        seen, total = set(), {}
        for batch in batches:
            sets = [shingles(t, k) for t in batch["text"]]
            keys = [set_key(s) for s in sets]
            out = {"id": batch["id"], "t": batch["t"], "a": [x[0] for x in keys], "b": [x[1] for x in keys], "n": [len(s) for s in sets]}
            yield pd.DataFrame(out | {"counts": [coarse(s) for s in sets], "fine": [fine(s) for s in sets], "h": 0, "m": 0})
            new = {key: s for key, s in zip(keys, sets, strict=True) if key not in seen}
            seen.update(new)
            if new:
                h, n = np.unique(np.concatenate(list(new.values())), return_counts=True)
                often = n >= CROWDED
                for x, y in zip(h[often].view(np.int64).tolist(), n[often].tolist(), strict=True):
                    total[x] = total.get(x, 0) + y
        yield pd.DataFrame({"id": None, "t": 0, "a": 0, "b": 0, "n": 0, "counts": None, "fine": None, "h": pd.Series(list(total), dtype="int64"), "m": pd.Series(list(total.values()), dtype="int64")})

    drawn = materialize(given.mapInPandas(sketches, "id string, t long, a long, b int, n int, counts binary, fine binary, h long, m long"), "sketches")
    # at most CROWD shingles, the most frequent among those that stand often in one task's documents: only the order depends on them
    often = drawn.filter("m > 0").groupBy("h").agg(F.sum("m").alias("m")).orderBy(F.desc("m"), "h").limit(CROWD)
    crowded = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in often.collect()], dtype=np.int64).view(np.uint64)))
    each = drawn.filter("m = 0").withColumn("id", F.col("id").cast(kind))
    # a set's node has the row of the least id (rows without one last), by which its text is found
    nodes = materialize(each.filter("n > 0").groupBy("a", "b").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("x"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("fine").alias("fine")).select("a", "b", "x.id", "x.t", "n", "counts", "fine"), "sets")
    texts = given.withColumn("id", F.col("id").cast(kind))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("ngram_jaccard")
        last, seen = crowded.value, set()
        for batch in batches:
            out = []
            for t in batch["text"]:
                s = shingles(t, k)
                key = set_key(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    own = prefix(s, last, num, den)
                    out.append((key[0], own[~among(own, last)].view(np.int64), own[among(own, last)].view(np.int64)))
            yield pd.DataFrame(out, columns=["a", "rare", "common"])

    # the first 64 bits of a set's key do here: sets that share them are told apart when regions are joined with the nodes
    parts = materialize(given.select("text").mapInPandas(heads, "a long, rare array<long>, common array<long>"), "heads")
    alike = Window.partitionBy("s")
    rare = parts.select("a", F.explode("rare").alias("s")).select("a", F.min("a").over(alike).alias("pa"), F.max("a").over(alike).alias("za"), F.count("*").over(alike).alias("c"))
    common = parts.select("a", F.explode("common").alias("s"))
    pivots = common.groupBy("s").agg(F.min("a").alias("pa"), F.max("a").alias("za"), F.count("*").alias("c"))  # at most CROWD rows
    met = rare.unionByName(common.join(F.broadcast(pivots), "s").drop("s")).filter("c > 1").select("pa", "a").distinct()
    region = materialize(met.join(nodes.select("a", "b", "n"), "a").select("pa", F.lit(0).alias("pb"), "a", "b", "n"), "regions")
    small = materialize(_with_partners(_small_regions(region, nodes, texts, k, num, den, cap), nodes, num, den), "partners")
    links = _join_regions(_small_regions(small, nodes, texts, k, num, den, cap), nodes, texts, k, num, den)
    named = components(materialize(links, "links"))

    grouped = nodes.select(F.struct("a", "b").alias("node"), "a", "b", "id", "t").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("x")).select("component", F.col("x.id").alias("found"), F.col("x.t").alias("chosen"))
    of_set = grouped.select("a", "b", "component").join(least, "component").drop("component")
    told = each.select("id", "t", "n", "a", "b").join(of_set, ["a", "b"], "left")
    out = told.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("id")).alias("component_id"), "t", "found", "chosen")
    if not keep_hash:
        return out.drop("t", "found", "chosen")
    first = (F.col("n_shingles") == 0) | (F.col(id_col).eqNullSafe(F.col("found")) & F.col("chosen").eqNullSafe(F.col("t")))
    return out.select(id_col, "n_shingles", "component_id", F.col("t").alias("text_hash"), first.alias("first"))


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text) of the nodes in ``wanted``, each found by the id (or its absence) and the hash of one of its texts."""
    chosen = wanted.select("a", "b").distinct().join(nodes.select("a", "b", F.col("id").alias("own"), F.col("t").alias("hash")), ["a", "b"])
    met = texts.join(chosen, (F.col("t") == F.col("hash")) & F.col("id").eqNullSafe(F.col("own")))
    return met.groupBy("a", "b").agg(F.first("text").alias("text"))


def _tiles(over: DataFrame, cap: int) -> DataFrame:
    """Large regions (with their sets m and shingles w) as regions of two tiles each: every pair of tiles, so that each pair of sets meets."""
    tiles = F.ceil(F.greatest(F.col("m") * 2 / cap, F.col("w") * 2 / SHINGLES)).cast("int")
    cut = over.withColumns({"t": F.pmod(F.xxhash64("a", "b"), tiles).cast("int"), "other": F.explode(F.sequence(F.lit(0), tiles - 1))})
    low, high = F.least("t", "other"), F.greatest("t", "other")
    return cut.select(F.xxhash64("pa", "pb", low, high).alias("pa"), F.hash("pa", "pb", low, high).alias("pb"), "a", "b", "n")


def _small_regions(region: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, num: int, den: int, cap: int) -> DataFrame:
    """Regions of at most ``cap`` sets and SHINGLES shingles. Larger ones are cut into Voronoi cells, up to three times; what replication would more than treble, or stays large, into pairs of tiles."""
    done = None

    def keep(more: DataFrame) -> None:
        nonlocal done
        done = more if done is None else done.unionByName(more)

    for depth in range(4):
        large = region.groupBy("pa", "pb").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter((F.col("m") > cap) | ((F.col("w") > SHINGLES) & (F.col("m") > 2)))
        if large.isEmpty():
            break
        keep(region.join(large, ["pa", "pb"], "left_anti"))
        over = region.join(large, ["pa", "pb"])
        if depth == 3:
            region = _tiles(over, cap)
            break
        # about 32 candidates a region by hash, of which 8 become its pivots: one short row for each large region
        chance = F.pmod(F.xxhash64("a", "b", F.lit(depth)), F.lit(1 << 30)) < F.lit(float(32 << 30)) / F.col("m")
        own_texts = materialize(_texts_of(over, nodes, texts), "texts")
        chosen = over.filter(chance).join(own_texts, ["a", "b"]).groupBy("pa", "pb").agg(F.slice(F.collect_list("text"), 1, PIVOTS).alias("pivots"))
        meet = over.join(own_texts, ["a", "b"]).join(chosen, ["pa", "pb"], "left")

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            begin("ngram_jaccard")
            reach, now, own = 1 - num / den, None, []
            for batch in batches:
                out = []
                for pa, pb, m, a, b, n, text, pivots in zip(batch["pa"], batch["pb"], batch["m"], batch["a"], batch["b"], batch["n"], batch["text"], batch["pivots"], strict=True):
                    if (pa, pb) != now:
                        now, own = (pa, pb), [shingles(p, k) for p in pivots] if pivots is not None else []
                    s = shingles(text, k)
                    shared = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in own])
                    d = 1 - shared / (np.array([len(p) for p in own]) + len(s) - shared)
                    for j in np.flatnonzero(d <= d.min(initial=1) + 2 * reach + 1e-9).tolist() if len(own) else [0]:
                        out.append((pa, pb, m, j, a, b, n))
                yield pd.DataFrame(out, columns=["pa", "pb", "m", "j", "a", "b", "n"])

        found = materialize(meet.select("pa", "pb", "m", "a", "b", "n", "text", "pivots").mapInPandas(cells, "pa long, pb int, m long, j int, a long, b int, n int"), "cells")
        much = found.groupBy("pa", "pb").agg(F.count("*").alias("c"), F.max("m").alias("m")).filter("c > 3 * m").select("pa", "pb")
        keep(_tiles(over.join(much, ["pa", "pb"], "left_semi"), cap))
        region = found.join(much, ["pa", "pb"], "left_anti").select(F.xxhash64("pa", "pb", "j").alias("pa"), F.hash("pa", "pb", "j").alias("pb"), "a", "b", "n")
        region = materialize(region, "cells")
    keep(region)
    return done


def slice_counts(s: np.ndarray, slices: int = SLICES) -> np.ndarray:
    return np.bincount((s & np.uint64(slices - 1)).astype(np.int64), minlength=slices)


def coarse(s: np.ndarray) -> bytes:
    """Counts in SLICES slices, as bytes: those over 255 count as 255, which only brings sets nearer."""
    return np.minimum(slice_counts(s), 255).astype(np.uint8).tobytes()


def fine(s: np.ndarray) -> bytes | None:
    """Of a long set, counts in a power of two of slices with 8 to 16 shingles each, as bytes; none if one is over 255."""
    if len(s) < LONG:
        return None
    found = slice_counts(s, 1 << (len(s) // 16).bit_length())
    return None if found.max() > 255 else found.astype(np.uint8).tobytes()


def fine_distance(a: bytes, b: bytes) -> int:
    """The least by which two long sets differ: wider counts fold to the narrower, as slices are the hash's low bits."""
    width = min(len(a), len(b))
    x, y = (np.frombuffer(v, dtype=np.uint8).reshape(-1, width).sum(axis=0, dtype=np.int32) for v in (a, b))
    return int(np.abs(x - y).sum())


def _with_partners(region: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Regions cut to what the triangle inequality leaves together, by sizes and slice counts alone, so that no texts travel.

    A group of members joined by pairs that may be near is named by its smallest member, so the same group found around several pivots is one."""
    alone = region.groupBy("pa", "pb").agg(F.count("*").alias("m")).filter("m > 1").select("pa", "pb")
    full = region.drop("n").join(alone, ["pa", "pb"]).join(nodes, ["a", "b"])
    dealt = full.select("pa", "pb", "a", "b", "n", "counts", "fine").repartition(partitions(region.sparkSession), "pa", "pb").sortWithinPartitions("pa", "pb")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("ngram_jaccard")
        now, keys, held = None, [], []

        def ended() -> list[tuple]:
            if len(held) < 2:
                return []
            counts = np.frombuffer(b"".join(c for _, c, _ in held), dtype=np.uint8).reshape(-1, SLICES).astype(np.int32)
            size = np.array([n for n, _, _ in held])
            order = np.argsort(size, kind="stable")
            size, counts = size[order], counts[order]
            top = np.searchsorted(size, size * den // num, side="right")
            of = np.arange(len(size))
            for i in range(len(size)):
                rest = slice(i + 1, top[i])
                fits = np.abs(counts[rest] - counts[i]).sum(axis=1) * (den + num) <= (den - num) * (size[rest] + size[i])
                mine = held[order[i]][2]
                if mine is not None:
                    for j in np.flatnonzero(fits).tolist():
                        theirs = held[order[i + 1 + j]][2]
                        fits[j] = theirs is None or fine_distance(mine, theirs) * (den + num) <= (den - num) * (size[i + 1 + j] + size[i])
                for x in set(of[rest][fits].tolist()) - {int(of[i])}:
                    of[of == x] = of[i]
            own: dict[int, list[tuple]] = {}
            for j, x in zip(order.tolist(), of.tolist(), strict=True):
                own.setdefault(x, []).append(keys[j])
            return [(*low[:2], *key) for group in own.values() if len(group) > 1 for low in (min(group),) for key in group]

        for batch in batches:
            out = []
            for pa, pb, a, b, *own in zip(batch["pa"].tolist(), batch["pb"].tolist(), batch["a"].tolist(), batch["b"].tolist(), batch["n"].tolist(), batch["counts"], batch["fine"], strict=True):
                if (pa, pb) != now:
                    out += ended()
                    now, keys, held = (pa, pb), [], []
                keys.append((a, b, own[0]))
                held.append(own)
            if out:
                yield pd.DataFrame(out, columns=["pa", "pb", "a", "b", "n"])
        if out := ended():
            yield pd.DataFrame(out, columns=["pa", "pb", "a", "b", "n"])

    return dealt.mapInPandas(rows, "pa long, pb int, a long, b int, n int").distinct()


def _join_regions(region: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between set keys that connect what each region connects: from the first set of a component to its others."""
    full = region.join(_texts_of(region, nodes, texts), ["a", "b"])
    dealt = full.select("pa", "pb", "a", "b", "text").repartition(partitions(region.sparkSession), "pa", "pb").sortWithinPartitions("pa", "pb")
    names = ["ua", "ub", "va", "vb"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("ngram_jaccard")
        now, keys, held = None, [], []

        def ended() -> list[tuple]:
            if len(held) < 2:
                return []
            of = region_links([shingles(t, k) for t in held], num, den)
            return [(*keys[j], *keys[i]) for i, j in enumerate(of.tolist()) if i != j]

        for batch in batches:
            out = []
            for pa, pb, a, b, text in zip(batch["pa"].tolist(), batch["pb"].tolist(), batch["a"].tolist(), batch["b"].tolist(), batch["text"], strict=True):
                if (pa, pb) != now:
                    out += ended()
                    now, keys, held = (pa, pb), [], []
                keys.append((a, b))
                held.append(text)
            if out:
                yield pd.DataFrame(out, columns=names)
        if out := ended():
            yield pd.DataFrame(out, columns=names)

    found = dealt.mapInPandas(rows, "ua long, ub int, va long, vb int")
    return found.select(F.struct(F.col("ua").alias("a"), F.col("ub").alias("b")).alias("u"), F.struct(F.col("va").alias("a"), F.col("vb").alias("b")).alias("v"))
