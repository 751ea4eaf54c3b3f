"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps modular prefix sums of a text's code points for two primes. Any span's hash follows
from two entries, so spans compare in constant time and the longest common extension of two places takes
a binary search. A document's fingerprint holds its length and the hashes of up to 32 prefixes and 32
suffixes whose lengths are multiples of one step, a power of two. It also holds the length and hash of
every span between cut points, which the text itself chooses: the ends of windows with a low hash, one
in ``EVERY`` places on average. Two fingerprints are alike by the share of the longer text that their
longest common prefix and suffix cover, found by binary search, or that lies in spans which both hold,
whichever is larger. So edits anywhere cost only the spans that they touch.

Null texts count as empty; two empty texts are alike by 1, an empty and another by 0. Repeated rows and
equal ids are put in order by their texts. Documents without an id come first. Ids are whole numbers. An empty table gives no
rows. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import bucket_bounds, bucket_of, partitions, unkeyed

#: Two primes under 2**31 and a base for each.
MODULI = ((2147483629, 911382323), (2147483587, 972663749))
MARKS = 32
#: A span ends after a window of so many code points if its hash is among the lowest of so many.
WINDOW, EVERY = 12, 48


class Powers:
    """Powers of a base and of its inverse, grown as longer texts come up to ``KEEP`` and made afresh beyond."""

    KEEP = 1 << 21

    def __init__(self, mod: int, base: int):
        self.mod = mod
        self.up, self.down = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))
        self.bases = (base, pow(base, -1, mod))

    def _grown(self, have: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), self.mod)) % np.uint64(self.mod)])
        return have

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self._grown(self.up, self.bases[0], n), self._grown(self.down, self.bases[1], n)
        if len(up) <= self.KEEP:
            self.up, self.down = up, down
        return up, down


POWERS = [Powers(m, b) for m, b in MODULI]


class PrefixHash:
    """Prefix hashes of a text: ``span(i, j)`` identifies the code points from i up to j."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums, self.down = [], []
        for (mod, _), powers in zip(MODULI, POWERS, strict=True):
            up, down = powers.to(self.n + 1)
            terms = points * up[: self.n] % np.uint64(mod)
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(terms, out=s[1:])
            self.sums.append(s % np.uint64(mod))
            self.down.append(down)

    def spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for (mod, _), s, down in zip(MODULI, self.sums, self.down, strict=True):
            m = np.uint64(mod)
            out = out << np.uint64(32) | (s[j] + m - s[i]) % m * down[i] % m
        return out

    def cuts(self) -> np.ndarray:
        """Places after the start at which windows with a low hash end, and the end. A window like the one before it doesn't count."""
        mod, m = MODULI[0][0], np.uint64(MODULI[0][0])
        s, k = self.sums[0], max(0, self.n + 1 - WINDOW)
        seen = (s[WINDOW:] + m - s[:k]) % m * self.down[0][:k] % m
        low = seen < np.uint64(mod // EVERY)
        low[1:] &= seen[1:] != seen[:-1]
        at = np.flatnonzero(low) + WINDOW
        return np.append(at[at < self.n], self.n) if self.n else at

    def span(self, i: int, j: int) -> int:
        return int(self.spans(np.array([i]), np.array([j]))[0])


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest common extension of a from i and b from j."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.span(i, i + mid) == b.span(j, j + mid) else (low, mid - 1)
    return low


def fingerprint(text: str) -> str:
    """``length.step.prefix hashes.suffix hashes.spans``, hexadecimal, sixteen letters a hash; a span is its hash and length, and how often it stands there if more than once."""
    h = PrefixHash(text)
    step = 1
    while h.n // step > MARKS:
        step *= 2
    at = np.arange(step, h.n + 1, step)
    whole = np.array([h.n])[: h.n > 0]
    to = np.concatenate([at, whole]).astype(np.int64)
    heads = h.spans(np.zeros(len(to), dtype=np.int64), to).astype(">u8").tobytes().hex()
    tails = h.spans(h.n - at, np.full(len(at), h.n)).astype(">u8").tobytes().hex()
    ends = h.cuts()
    starts = np.concatenate([ends[:0], [0], ends[:-1]])[: len(ends)].astype(np.int64)
    held = Counter(zip(h.spans(starts, ends).tolist(), (ends - starts).tolist(), strict=True))
    spans = ",".join(f"{x:016x}{n:x}" + f"*{k:x}" * (k > 1) for (x, n), k in held.items())
    return f"{h.n:x}.{step:x}.{heads}.{tails}.{spans}"


def _spans(text: str) -> dict[str, int]:
    return {s: int(k or "1", 16) for s, _, k in (x.partition("*") for x in text.split(",") if x)}


def _agree(a: str, b: str, step_a: int, step_b: int) -> int:
    """Longest multiple of both steps, in places of the finer marks, up to which the marks agree: binary search, as agreement is downward closed."""
    step = max(step_a, step_b)
    ka, kb = step // step_a * 16, step // step_b * 16
    low, high = 0, min(len(a) // ka, len(b) // kb)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid * ka - 16 : mid * ka] == b[mid * kb - 16 : mid * kb] else (low, mid - 1)
    return low * step


def likeness(x: str, y: str) -> float:
    """From 0 to 1: covered by the common prefix and suffix, as far as the marks tell, or by common spans, of the longer text."""
    if x == y:
        return 1.0
    nx, sx, hx, tx, px = x.split(".")
    ny, sy, hy, ty, py = y.split(".")
    n, m, s, t = int(nx, 16), int(ny, 16), int(sx, 16), int(sy, 16)
    if not n or not m:
        return 0.0
    both = _agree(hx[: n // s * 16], hy[: m // t * 16], s, t) + _agree(tx, ty, s, t)
    a, b = _spans(px), _spans(py)
    shared = sum(min(k, b[x]) * int(x[16:], 16) for x, k in a.items() if x in b)
    return min(max(both, shared), min(n, m)) / max(n, m)


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by as many of the next document's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str, per_row, schema: str) -> DataFrame:
    """``per_row(text, following)`` over documents in ascending id, the first following the last.

    Ids are cut into buckets by quantiles of all ids; one shuffle brings each bucket into one task in order, with the
    first document of the next bucket (one row a bucket) as its end. Nothing else crosses buckets."""
    spark = docs.sparkSession
    n = partitions(spark)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = bucket_bounds(base.select("id"), "id", 4 * n)
    base = base.withColumn("bucket", bucket_of(F.col("id"), bounds))
    heads = base.groupBy("bucket").agg(F.min_by("text", F.struct("id", "text")).alias("text"))
    ring = Window.partitionBy(F.lit(0)).orderBy("bucket")  # one row for each bucket
    around = Window.partitionBy(F.lit(0))
    ends = heads.withColumn("to", F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(around))).select(F.lit(None).cast(dict(base.dtypes)["id"]).alias("id"), "text", F.col("to").alias("bucket"), F.lit(1).alias("end"))
    ordered = base.withColumn("end", F.lit(0)).unionByName(ends).repartition(n, "bucket").sortWithinPartitions("bucket", "end", "id", "text").select(F.col("id").cast("string").alias("id"), "text", "end")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for key, text, end in zip(batch["id"], batch["text"], batch["end"], strict=True):
                if held is not None:
                    out.append((held[0], *per_row(held[1], text)))
                held = None if end else (key, text)
            if out:
                yield pd.DataFrame(out, columns=["id", *(x.split()[0] for x in schema.split(", "))])

    return unkeyed(ordered.mapInPandas(rows, f"id string, {schema}"), id_col, dict(base.dtypes)["id"])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: fingerprints of the text and of its edited text, and their likeness to each other and to the next document's."""
    last: list[tuple[str, str]] = []

    def one(text: str, following: str) -> tuple:
        known = dict(last)
        mine = known[text] if text in known else fingerprint(text)
        theirs = fingerprint(following)
        last[:] = [(following, theirs)]
        changed = edited(text, following)
        other = fingerprint(changed)
        return len(text), hashlib.sha256(changed.encode()).hexdigest(), mine, other, likeness(mine, other), likeness(mine, theirs)

    return with_next(docs, id_col, text_col, one, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
