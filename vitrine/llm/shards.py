"""Token-id shards compressed by Re-Pair, with rules and expansion lengths for random access.

Documents are encoded, given an end id, and written in ascending id as shards of bounded size. In each
shard frequent pairs of neighbouring ids are repeatedly replaced by nonterminals (never across a
document's end), the most frequent first: each round takes all pairs down to a quarter of the round before, until no
pair stands often enough to pay for its rule. A shard is one row of a Parquet table in the shared folder: its documents' ids, places and lengths, the rules,
how many ids each rule stands for, and the compressed symbols. One document decodes from its own
symbols and the rules alone.

Null texts count as empty and have the end id only. Equal ids are put in order by their texts, documents
without an id come first, an empty table has no shards. Ids are whole numbers. Other columns are not carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import encoder
from vitrine.llm.common import begin, bucket_bounds, bucket_of, materialize, partitions, unkeyed

SHARD_IDS, BITS = 1 << 20, 18
#: A rule takes twelve bytes and saves about two at each use.
LEAST, FACTOR = 6, 4
SHARD = "bucket int, shard int, first_id long, n_ids long, terminals int, doc_ids array<string>, symbol_at array<int>, n_tokens array<int>, rules binary, expands binary, symbols binary, n_symbols int"


def _without_own_overlap(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of ascending places of pairs stay if every other one of a pair that overlaps itself goes, from the left."""
    heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]))) if len(at) else np.empty(0, dtype=np.int64)
    return (np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))) % 2 == 0


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of ascending places are replaced: none that overlap, those of a higher rank before their neighbours. Ranks of neighbours differ."""
    chosen = np.zeros(len(at), dtype=bool)
    left = np.arange(len(at))
    for _ in range(4):
        a, r = at[left], rank[left]
        touch = a[1:] == a[:-1] + 1
        best = np.ones(len(left), dtype=bool)
        best[1:] &= ~touch | (r[1:] > r[:-1])
        best[:-1] &= ~touch | (r[:-1] > r[1:])
        chosen[left[best]] = True
        free = ~best
        free[1:] &= ~(touch & best[:-1])
        free[:-1] &= ~(touch & best[1:])
        left = left[free]
        if not len(left):
            break
    return chosen


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the two parts of each rule, and which symbols end a document. Rule k makes the symbol terminals + k.

    In the end no pair within documents can be replaced ``least`` times. Once pairs are taken down to ``least``, only pairs with a
    symbol of the last round can be new, so rounds look at these alone until a look at all pairs finds none."""
    seq, end, made = ids.astype(np.uint32), ends.copy(), []
    floor, fresh, total = None, 0, 0
    while len(seq) > 1:
        inner = ~end[:-1]
        # each pair as one number, the second symbol in the upper half, seen in place
        code = np.ndarray(len(seq) - 1, "<u8", seq, 0, (4,))
        if fresh:
            new = seq >= fresh
            at = np.flatnonzero((new[:-1] | new[1:]) & inner)
        else:
            # pairs are counted by a hash first: those in a bin under the floor are out without sorting
            bins = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).view(np.int64)
            bins[~inner] = 1 << BITS
            counts = np.bincount(bins, minlength=(1 << BITS) + 1)
            counts[1 << BITS] = 0
            floor = max(least, min(int(counts.max()), floor or len(seq)) // FACTOR)
            at = np.flatnonzero((counts >= floor)[bins])
        code = code[at]
        pairs, place, n = np.unique(code, return_inverse=True, return_counts=True)
        often = n[place] >= floor
        at, place = at[often], place[often]
        alone = _without_own_overlap(at, place)
        at, place = at[alone], place[alone]
        uses = np.bincount(place, minlength=len(pairs))
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[np.argsort(uses, kind="stable")] = np.arange(len(pairs))
        stay = uses[place] >= least
        at, place = at[stay], place[stay]
        # the pair of the highest rank keeps all its places, so each round with a pair that pays makes a rule
        own = _chosen(at, rank[place])
        at, place = at[own], place[own]
        paid = np.bincount(place, minlength=len(pairs)) >= least
        at, place = at[paid[place]], place[paid[place]]
        if not len(at):
            if not fresh and floor == least:
                break
            fresh = 0
            continue
        first = terminals + total
        seq[at], end[at] = first + np.cumsum(paid)[place] - 1, end[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, end = seq[keep], end[keep]
        made.append(np.ascontiguousarray(pairs[paid]).view("<u4").reshape(-1, 2))
        total += len(made[-1])
        fresh = first if floor == least else 0
    return seq, np.concatenate([np.empty((0, 2), dtype=np.uint32), *made]), end


def stored(symbols: np.ndarray) -> bytes:
    """Symbols as their low sixteen bits, then one plane of bits for each higher bit that any of them has."""
    planes = [np.packbits((symbols >> b & 1).astype(np.uint8)).tobytes() for b in range(16, int(symbols.max(initial=0)).bit_length())]
    return b"".join([symbols.astype("<u2").tobytes(), *planes])


def symbols_of(shard) -> np.ndarray:
    n = shard.n_symbols
    out = np.frombuffer(shard.symbols, dtype="<u2", count=n).astype(np.uint32)
    size = (n + 7) // 8
    for k in range((len(shard.symbols) - 2 * n) // size if n else 0):
        bits = np.unpackbits(np.frombuffer(shard.symbols, dtype=np.uint8, count=size, offset=2 * n + k * size), count=n)
        out |= bits.astype(np.uint32) << np.uint32(16 + k)
    return out


def expansions(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.ones(len(rules), dtype=np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - terminals] if a >= terminals else 1) + (out[b - terminals] if b >= terminals else 1)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids of any stretch of symbols."""
    seq = symbols.astype(np.uint32)
    while len(rules) and (own := seq >= terminals).any():
        at = np.flatnonzero(own)
        parts = rules[seq[at] - terminals]
        to = at + np.arange(len(at))
        seq = np.repeat(seq, 1 + own.astype(np.int8))
        seq[to], seq[to + 1] = parts[:, 0], parts[:, 1]
    return seq


def _shard(bucket: int, number: int, first: int, docs: list[tuple[str | None, np.ndarray]], terminals: int) -> tuple:
    ids = np.concatenate([x for _, x in docs])
    lengths = np.array([len(x) for _, x in docs])
    ends = np.zeros(len(ids), dtype=bool)
    ends[np.cumsum(lengths) - 1] = True
    symbols, rules, end = compress(ids, ends, terminals)
    at = np.concatenate([[0], np.flatnonzero(end)[:-1] + 1]).astype(np.int32)
    return bucket, number, first, len(ids), terminals, [k for k, _ in docs], at, lengths.astype(np.int32), rules.tobytes(), expansions(rules, terminals).astype(np.uint32).tobytes(), stored(symbols), len(symbols)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The written shards, read back. One shuffle deals the texts by quantiles of the id; a task encodes its documents in order."""
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = bucket_bounds(base.select("id"), "id", 4 * n)
    ordered = base.withColumn("bucket", bucket_of(F.col("id"), bounds)).repartition(n, "bucket").sortWithinPartitions("bucket", "id", "text").select(F.col("id").cast("string").alias("id"), "text", "bucket")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("encoding")
        coder = encoder(tokenizer, "rank")
        names = [x.split()[0] for x in SHARD.split(", ")]
        now, number, first, size, held = None, 0, 0, 0, []
        tail = np.array([end_id], dtype=coder.kind).tobytes()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                for key, raw, bucket in zip(part["id"], coder.encode_batch(part["text"].tolist()), part["bucket"], strict=True):
                    ids = np.frombuffer(raw + tail, dtype=coder.kind)
                    if held and (bucket != now or size + len(ids) > shard_ids):
                        yield pd.DataFrame([_shard(now, number, first, held, coder.size)], columns=names)
                        number, first, size, held = number + 1, first + size, 0, []
                    if bucket != now:
                        now, number, first = bucket, 0, 0
                    held.append((key, ids))
                    size += len(ids)
        if held:
            yield pd.DataFrame([_shard(now, number, first, held, coder.size)], columns=names)

    return materialize(ordered.mapInPandas(rows, SHARD), "shards")


def documents_of(shard, pick: list[int] | None = None) -> Iterator[tuple[str | None, int, np.ndarray]]:
    """(id, ids before it in its bucket, ids) of a shard row's documents, or of those at the given places: each is decoded from its own symbols."""
    rules = np.frombuffer(shard.rules, dtype=np.uint32).reshape(-1, 2)
    symbols = symbols_of(shard)
    at, lengths = np.asarray(shard.symbol_at), np.asarray(shard.n_tokens).astype(np.int64)
    starts = shard.first_id + np.concatenate([[0], np.cumsum(lengths)[:-1]])
    to = np.append(at[1:], len(symbols))
    if pick is None:
        whole = expand(symbols, rules, shard.terminals)
        cuts = np.cumsum(lengths)
        for k, (key, n, c) in enumerate(zip(shard.doc_ids, lengths, cuts, strict=True)):
            yield key, int(starts[k]), whole[c - n : c]
    else:
        for k in pick:
            yield shard.doc_ids[k], int(starts[k]), expand(symbols[at[k] : to[k]], rules, shard.terminals)


def id_at(shard, place: int, position: int) -> int:
    """One id of a document by descent through the expansion lengths."""
    rules = np.frombuffer(shard.rules, dtype=np.uint32).reshape(-1, 2)
    expands = np.frombuffer(shard.expands, dtype=np.uint32)
    symbols = symbols_of(shard)[shard.symbol_at[place] :].astype(np.int64)
    t = shard.terminals
    sizes = np.ones(len(symbols), dtype=np.int64)
    own = symbols >= t
    sizes[own] = expands[symbols[own] - t]
    ends = np.cumsum(sizes)
    k = int(np.searchsorted(ends, position, side="right"))
    left, symbol = position - (int(ends[k - 1]) if k else 0), int(symbols[k])
    while symbol >= t:
        a, b = rules[symbol - t].tolist()
        n = int(expands[a - t]) if a >= t else 1
        symbol, left = (a, left) if left < n else (b, left - n)
    return symbol


def read_shards(shards: DataFrame, id_col: str = "doc_id", kind: str = "long") -> DataFrame:
    """A row for each document from the stored shards: ids before it in all shards, how many it has, and their checksum."""
    totals = {r["bucket"]: r["n"] for r in shards.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each bucket
    base, before = {}, 0
    for b in sorted(totals):
        base[b], before = before, before + totals[b]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples():
                out = [(key, base[shard.bucket] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, start, ids in documents_of(shard)]
                yield pd.DataFrame(out, columns=["id", "start", "n_tokens", "ids_crc32"])

    return unkeyed(shards.mapInPandas(rows, "id string, start long, n_tokens long, ids_crc32 long"), id_col, kind)
