"""Removal of every byte covered by a string of ``length`` bytes that starts at two places or more.

Strings are first gathered so that equal ones meet. The smallest hash of a short gram among all grams of a
string is its anchor; equal strings have equal anchors at equal places. Each run of starts that share an
anchor gives one context, the bytes that those strings cover. Contexts whose anchor gram occurs once
are done with; the others meet by anchor gram and are laid out side by side, aligned at the anchor.

Such a collection is sorted column by column, from the last to the first: each round inserts one symbol of every
context and updates the order of their suffixes (the collection's Burrows-Wheeler order at this column)
and where each suffix parts from its neighbour (its common prefix). Columns stand in an external
file and are read one after another. A string starting at a column is repeated if it shares ``length``
bytes with a neighbour. A collection too large for one task is dealt out over several; one row for each
of its distinct strings and tasks then tells which strings other tasks hold as well.

Null texts count as empty. Equal texts are handled once, as one text with several copies. Rows with equal
ids stay apart. Texts shorter than ``length`` are kept whole; an empty table gives an empty one. Columns other than
the text are carried along; those with the name of a result column give way to it.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import begin, materialize, partitions

LENGTH, GRAM, BLOCK = 200, 32, 8192
#: Contexts of one anchor gram that one task sorts, and bytes of contexts that it holds at a time.
TOGETHER, HELD = 20_000, 48 << 20


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit polynomial hash of every gram, by doubling."""
    base, done = 0x9E3779B97F4A7C15, 1
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    while done < gram:
        step = min(done, gram - done)  # a gram of done + step letters is two of done letters, the second step further on
        h = h[: len(h) - step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        done += step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of a text: place, first and last start of the strings that have it, and its gram's hash."""
    if len(text) < length:
        return (*[np.empty(0, dtype=np.int64)] * 3, np.empty(0, dtype=np.uint64))
    h = gram_hashes(np.frombuffer(text, dtype=np.uint8), gram)
    least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    done, want = 1, length - gram + 1
    while done < want:
        step = min(done, want - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    place = at[first]
    return place, first, np.append(first[1:], len(at)) - 1, h[place]


class Columns:
    """Contexts aligned at their anchors, stored column by column in an external file. Symbol 0 stands beyond either end."""

    def __init__(self, contexts: list[bytes], left: np.ndarray, most_left: int, most_right: int):
        self.file, self.blocks, self.lead = tempfile.TemporaryFile(), [], most_left  # noqa: SIM115
        self.left, self.right = left, np.array([len(c) for c in contexts], dtype=np.int64) - left
        width, at = most_left + most_right, 0
        for i in range(0, len(contexts), BLOCK):
            part = contexts[i : i + BLOCK]
            grid = np.zeros((len(part), width), dtype=np.uint8)
            size = np.array([len(c) for c in part])
            flat = np.frombuffer(b"".join(part), dtype=np.uint8)
            row = np.repeat(np.arange(len(part)), size)
            col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(most_left - left[i : i + BLOCK], size)
            grid[row, col] = flat
            self.file.write(np.ascontiguousarray(grid.T).tobytes())
            self.blocks.append((at, len(part)))
            at += width * len(part)

    def read(self, c: int) -> np.ndarray:
        """The symbols of column c, counted from the anchor, plus one; 0 where a context has none."""
        out = []
        for at, n in self.blocks:
            self.file.seek(at + (c + self.lead) * n)
            out.append(np.frombuffer(self.file.read(n), dtype=np.uint8))
        s = np.concatenate(out).astype(np.int16) + 1
        s[(self.right <= c) | (-self.left > c)] = 0
        return s


def insert_columns(group: np.ndarray, contexts: list[bytes], left: np.ndarray, length: int, gram: int, each=None) -> np.ndarray:
    """For each distance before the anchor (rows) and context (columns), whether the string that starts there stands in another context of its group too.

    ``group`` ascends. ``each(d, order, part)`` is told, for each start, the order and where each suffix parts from the one before it."""
    m, most = len(contexts), int(left.max(initial=0))
    columns = Columns(contexts, left, most, length)
    found = np.zeros((most + 1, m), dtype=bool)
    order, part, own = np.arange(m), np.full(m, length, dtype=np.int64), group.copy()
    apart = -1 << 30
    head = np.diff(own, prepend=own[:1] - 1) != 0
    part[head] = apart
    for c in range(length - 1, -most - 1, -1):
        if not len(order):
            break
        s = columns.read(c)[order]
        mixed = np.zeros(len(order), dtype=bool)
        mixed[1:] = (s[1:] != s[:-1]) & ~head[1:]
        mixed |= s == 0
        if mixed.any():
            ranks = np.cumsum(head) - 1
            touched = np.zeros(ranks[-1] + 1, dtype=bool)
            touched[ranks[mixed]] = True
            at = np.flatnonzero(touched[ranks])
            old, symbols, g = part[at], s[at], ranks[at]
            to = np.argsort(g * 512 + symbols, kind="stable")
            new = np.full(len(at), c, dtype=np.int64)
            g2, s2 = g[to], symbols[to]
            same = np.zeros(len(at), dtype=bool)
            same[1:] = (g2[1:] == g2[:-1]) & (s2[1:] == s2[:-1]) & (s2[1:] != 0)
            j = np.flatnonzero(same)
            i, k = to[j - 1] + 1, to[j] + 1
            near = k - i == 1
            new[j[near]] = old[i[near]]
            far = j[~near]
            if len(far):
                edges = np.stack([i[~near], k[~near]], axis=1).ravel()
                new[far] = np.minimum.reduceat(np.append(old, apart), edges)[::2]
            new[np.diff(g2, prepend=-1) != 0] = apart
            order[at], part[at] = order[at][to], new
        if c > 0:
            continue
        if each is not None:
            each(-c, order, part)
        close = part >= c + length
        close[:-1] |= close[1:]
        found[-c, order[close]] = True
        # suffixes that part before the nearest start still to come can never meet again: they form groups of their own
        head = part < length - most
        lone = head & np.append(head[1:], True)
        if lone.any() and each is None:
            stay = ~lone
            order, part, head = order[stay], part[stay], head[stay]
        part[head] = apart
    columns.file.close()
    return found


def _spans(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated starts: context, and the run's first and last start relative to the anchor (as distances before it)."""
    if not found.size:
        return (np.empty(0, dtype=np.int64),) * 3
    edge = np.zeros((1, found.shape[1]), dtype=bool)
    grid = np.concatenate([edge, found, edge]).T  # a row for each context
    step = np.diff(grid.astype(np.int8), axis=1)
    ctx, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return ctx, high - 1, low


def unpacked(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text)


def keyed_texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("__k"), text.alias("__text"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """(k, spans as arrays of starts and ends) of distinct texts (k, packed, copies); spans may overlap."""
    spark = texts.sparkSession

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("suffix_dedup")
        for batch in batches:
            out = []
            for k, raw, copies in zip(batch["k"], batch["packed"], batch["copies"], strict=True):
                h, n = np.unique(anchors(unpacked(raw), length, gram)[3].view(np.int64), return_counts=True)
                if len(h):
                    out.append((k, h, n * copies))
            if out:
                yield pd.DataFrame(out, columns=["k", "h", "n"])

    pairs = F.explode(F.arrays_zip("h", "n")).alias("x")
    seen = texts.mapInPandas(grams, "k binary, h array<long>, n array<long>").select("k", pairs).select("k", "x.h", "x.n")
    often = seen.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    of_text = seen.drop("n").join(often, "h").groupBy("k").agg(F.collect_list("h").alias("h"), F.collect_list("n").alias("n"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("suffix_dedup")
        for batch in batches:
            out = []
            for k, packed, copies, hs, ns in zip(batch["k"], batch["packed"], batch["copies"], batch["h"], batch["n"], strict=True):
                raw = unpacked(packed)
                place, first, last, own = anchors(raw, length, gram)
                own = own.view(np.int64)
                known = np.argsort(hs)
                hs, ns = hs[known], ns[known]
                to = np.minimum(np.searchsorted(hs, own), len(hs) - 1)
                at = np.flatnonzero(hs[to] == own)
                same: dict[tuple, list[int]] = {}
                for p, i, j, h, n in zip(place[at].tolist(), first[at].tolist(), last[at].tolist(), own[at].tolist(), ns[to[at]].tolist(), strict=True):
                    same.setdefault((h, n, p - i, raw[i : j + length]), []).append(p)
                out += [(h, -(-n // together), k, np.array(ps, dtype=np.int32), left, copies > 1 or len(ps) > 1, context) for (h, n, left, context), ps in same.items()]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["h", "tasks", "k", "places", "back", "many", "context"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["h", "tasks", "k", "places", "back", "many", "context"])

    laid = texts.join(of_text, "k").mapInPandas(contexts, "h long, tasks long, k binary, places array<int>, back int, many boolean, context binary")
    laid = laid.withColumn("task", F.pmod(F.xxhash64("k", "places"), F.col("tasks")))

    def rows(h, task, tasks, k, places, left, many, context):
        h = np.array(h)
        group = np.cumsum(np.diff(h, prepend=h[:1] - 1).astype(bool) | (np.diff(task, prepend=-1) != 0))
        left, several = np.array(left, dtype=np.int64), np.array(tasks) > 1
        probes: list[tuple] = []

        def each(d: int, order: np.ndarray, part: np.ndarray) -> None:
            """One row for each distinct string of a group that other tasks also hold strings of."""
            own = several[order] & (left[order] >= d) & (np.array([len(context[x]) - left[x] for x in order]) >= length - d)
            starts = part < length - d
            runs = np.cumsum(starts)
            size = np.bincount(runs, weights=own, minlength=runs[-1] + 1 if len(runs) else 1)
            for i in np.flatnonzero(own & starts).tolist():
                x = int(order[i])
                string = context[x][left[x] - d : left[x] - d + length]
                probes.append((k[x], (places[x] - d).tolist(), (places[x] - d + length).tolist(), hashlib.blake2b(string, digest_size=16).digest(), bool(size[runs[i]] > 1 or many[x])))

        found = insert_columns(group, context, left, length, gram, each if several.any() else None)
        for x in np.flatnonzero(many).tolist():
            low = length - (len(context[x]) - left[x])
            found[low : left[x] + 1, x] = True
        out = [(k[x], (places[x] - far).tolist(), (places[x] - near + length).tolist(), None, True) for x, far, near in zip(*(a.tolist() for a in _spans(found, length)), strict=True)]
        return pd.DataFrame(out + probes, columns=["k", "s", "e", "string", "done"])

    def sort_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("suffix_dedup")
        names = ["h", "task", "tasks", "k", "places", "back", "many", "context"]
        held, size = {x: [] for x in names}, 0
        for batch in batches:
            if size > HELD:
                # groups stand together: what comes before the last one is complete
                h, task = held["h"], held["task"]
                cut = len(h) - 1
                while cut > 0 and (h[cut - 1], task[cut - 1]) == (h[-1], task[-1]):
                    cut -= 1
                if cut:
                    yield rows(*(held[x][:cut] for x in names))
                    held = {x: held[x][cut:] for x in names}
                    size = sum(map(len, held["context"]))
            for x in names:
                held[x] += batch[x].tolist()
            size += int(batch["context"].map(len).sum())
        if held["h"]:
            yield rows(*(held[x] for x in names))

    n = partitions(spark)
    dealt = laid.repartition(n, "h", "task").sortWithinPartitions("h", "task")
    told = materialize(dealt.mapInPandas(sort_columns, "k binary, s array<int>, e array<int>, string binary, done boolean"), "spans")
    shared = told.filter("string is not null").groupBy("string").agg(F.count("*").alias("n"), F.collect_list(F.when(~F.col("done"), F.struct("k", "s", "e"))).alias("x")).filter("n > 1")
    both = told.filter("string is null").select("k", "s", "e").unionByName(shared.select(F.explode("x").alias("x")).select("x.*"))
    return both.groupBy("k").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("e")).alias("e"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, then n_bytes, n_removed, n_spans and kept_sha256; ``keep_text`` adds what is left, without the parts of letters that a cut has halved, in ``kept_text``."""
    given = keyed_texts(docs, text_col)

    def press(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("suffix_dedup")
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "packed": [pack(t.encode()) for t in batch["text"]]})

    # texts travel compressed: they are shuffled three times
    pressed = given.select(F.col("__k").alias("k"), F.col("__text").alias("text")).mapInPandas(press, "k binary, packed binary")
    texts = materialize(pressed.groupBy("k").agg(F.first("packed").alias("packed"), F.count("*").alias("copies")), "texts")
    spans = repeated_spans(texts, length, gram, together)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text]

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        begin("suffix_dedup")
        last, row = None, None
        for texts, starts, ends in batches:
            out = []
            for packed, s, e in zip(texts, starts, ends, strict=True):
                # copies of a text stand together and are cut once
                if packed != last:
                    last, row = packed, without(unpacked(packed), s, e)
                out.append((*row[:3], hashlib.sha256(row[3]).hexdigest(), row[3].decode("utf-8", "ignore")) if keep_text else (*row[:3], hashlib.sha256(row[3]).hexdigest()))
            yield pd.DataFrame(out, columns=names)

    clash = [c for c in docs.columns if c in {*names, text_col}]
    rest = given.drop("__text", *clash).withColumnRenamed("__k", "k")
    # all three are dealt by the text's key, so texts aren't shuffled again for their rows
    spread = texts.drop("copies").withColumnRenamed("packed", "__packed").join(spans.withColumnsRenamed({"s": "__s", "e": "__e"}), "k", "left").join(rest, "k")
    told = spread.withColumn("__cut", cut.asNondeterministic()("__packed", "__s", "__e"))
    return told.select(*[c for c in rest.columns if c != "k"], "__cut.*")


def without(raw: bytes, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[int, int, int, bytes]:
    """Bytes of a text, how many the spans cover, in how many runs, and what is left."""
    if starts is None or not len(starts):
        return len(raw), 0, 0, raw
    order = np.argsort(starts, kind="stable")
    first, reach = starts[order], np.maximum.accumulate(ends[order])
    heads = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
    low, high = first[heads].tolist(), reach[np.append(heads[1:], len(first)) - 1].tolist()
    left = b"".join(raw[a:b] for a, b in zip([0, *high], [*low, len(raw)], strict=True))
    return len(raw), len(raw) - len(left), len(low), left
