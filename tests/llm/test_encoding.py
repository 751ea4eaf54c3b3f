"""Operators 4, 5, 6, 7 and 9 against plain versions, with odd texts, nulls, ties, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitrine.llm import fingerprints as fp
from vitrine.llm import shards as sh
from vitrine.llm.bpe import encoder
from vitrine.llm.encode import bpe_round_trip
from vitrine.llm.media import media_columns, peak_pairs, wav_samples
from vitrine.llm.packing import hilbert_key, pack

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  a  b ", "x<|endoftext|>y z", " <|endoftext|>", "ΑΣ é é İ", "a\x1cb c", "don't I'LL we've", "日本語 テスト 12345 ½ ²", "\n\n a\n", "aaaa" * 40, "tab\tb \t c", " x  y", "<|startoftext|> hi", "👩‍👩‍👧 emoji!!! ...,,, ", "a <| b |>", " ", "a b "]


@pytest.fixture(scope="module")
def docs(spark):
    real = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t) for i, t in enumerate(ODD + real[:60])] + [(500, None), (501, real[0]), (501, real[0]), (502, "word " * 30000), (None, "no id")]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, id int, n string").repartition(5)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "trie"), (BYTE, "rank"), (WORD, "word"), (WORD, "trie")])
def test_encoders_match_the_library(docs, path, kind):
    tok, coder, given = Tokenizer.from_file(path), encoder(path, kind), [t for _, t in texts(docs)]
    want = [e.ids for e in tok.encode_batch(given, add_special_tokens=False)]
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode_batch(given)] == want


def test_round_trip(docs):
    tok = Tokenizer.from_file(BYTE)
    want = []
    for i, t in texts(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe_round_trip(docs, BYTE).collect()), key=str) == sorted(want, key=str)
    assert bpe_round_trip(docs.limit(0), BYTE).count() == 0


def test_media(docs):
    got = media_columns(docs, keep_media=True).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        raw = wav_samples(r.media)
        assert len(raw) % 192 == 0 and len(raw) > 0 and raw[r.n_bytes :].strip(b" ") == b""
        assert hashlib.sha256(raw).hexdigest() == r.payload_sha256 and zlib.crc32(raw[-16:]) == r.tail_crc32
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        by.setdefault(raw[: r.n_bytes].decode(), set()).add((r.feature, r.media_sha256))
    assert sorted(by) == sorted({t for _, t in texts(docs)}) and all(len(v) == 1 for v in by.values())
    assert len({f for v in by.values() for f, _ in v}) > len(by) // 2
    assert media_columns(docs.limit(0)).count() == 0


def test_peaks_match_a_direct_transform():
    """Frames, window, transform, local maxima and pairs, each spelled out."""
    raw = bytes(np.random.default_rng(8).integers(32, 127, 192 * 5, dtype=np.uint8))
    n = np.arange(192)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / 191)
    tops = []
    for start in range(0, len(raw) - 191, 96):
        x = (np.frombuffer(raw[start : start + 192], dtype=np.uint8).astype(float) - 128) * window
        mag = [abs(sum(x * np.exp(-2j * np.pi * k * n / 192))) for k in range(97)]
        peaks = [k for k in range(1, 96) if mag[k] > mag[k - 1] and mag[k] >= mag[k + 1]]
        tops.append(sorted(peaks, key=lambda k: -mag[k])[:2])
    want = set()
    for i, (first, second) in enumerate(tops):
        for d in (1, 2, 3):
            if i + d < len(tops):
                want |= {(i, f, tops[i + d][0], d) for f in (first, second)}
    got = peak_pairs(raw)
    assert {(int(p) >> 32, int(p) >> 20 & 0xFFF, int(p) >> 8 & 0xFFF, int(p) & 0xFF) for p in got} == want
    assert (np.diff(got) > 0).all() and peak_pairs(raw).tolist() == got.tolist()


def test_prefix_hashes():
    a, b = fp.PrefixHash("the cat sat on the mat"), fp.PrefixHash("a cat sat on it")
    assert a.span(4, 14) == b.span(2, 12) and a.span(4, 14) != b.span(3, 13)
    assert fp.common_extension(a, 3, b, 1) == len(" cat sat on ") and fp.common_extension(a, 0, b, 0) == 0


def test_edited_fingerprints(docs):
    given = sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = {}
    for k, (i, t) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        half = len(t) // 2
        want.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    got = {}
    for r in fp.edited_fingerprints(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.n_chars < 64 or r.near_edited > 0.4
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert fp.edited_fingerprints(docs.limit(0)).count() == 0
    assert fp.likeness(fp.fingerprint("abc" * 50), fp.fingerprint("abc" * 50)) == 1


def test_hilbert_neighbours():
    cells = sorted(((x, y, z) for x in range(8) for y in range(8) for z in range(8)), key=lambda p: hilbert_key(list(p), 3))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one vocabulary come to lie together: the mean distance in line between two of a kind is far under that of a random order."""
    rng = np.random.default_rng(5)
    kinds = [[f"{a}{b}" for a in pair for b in "aeiou"] for pair in ("kl", "mn", "pr", "st", "vz", "bd")]
    rows = [(i, " ".join(rng.choice(kinds[i % 6], 60))) for i in range(240)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), WORD, capacity=512).collect()
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    order = [r.doc_id for r in line if r.start == 0]
    same = sum(a % 6 == b % 6 for a, b in zip(order, order[1:])) / len(order)
    assert same > 2.5 / 6


def test_packing(docs):
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    tok = Tokenizer.from_file(WORD)
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in texts(docs)}
    got = pack(docs, WORD, capacity=256).collect()
    pieces, room = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for i, parts in pieces.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[i])
    fill = {}
    for s, parts in room.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        fill[s] = at
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == 256 for s in list(sorted(fill))[:-1])
    assert pieces.keys() == ids.keys() and pack(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("least", [4, 6])
def test_grammar_is_complete(docs, least):
    """Rules are made until no pair pays; expansion is exact; symbols over sixteen bits are stored in planes."""
    coder = encoder(BYTE, "rank")
    real = [np.append(np.frombuffer(x, coder.kind), 2) for x in coder.encode_batch([t for _, t in texts(docs)])]
    toy = [np.array(x) for x in ([7] * 50, [1, 2, 3] * 30, [5], [1, 1, 2] * 9, list(range(40)) * 8)]
    for given, terminals in ((real, coder.size), (toy, 1 << 17)):
        ids, ends = np.concatenate(given), np.zeros(sum(map(len, given)), dtype=bool)
        ends[np.cumsum([len(x) for x in given]) - 1] = True
        symbols, rules, end = sh.compress(ids, ends, terminals, least)
        assert sh.expand(symbols, rules, terminals).tolist() == ids.tolist()
        assert len(symbols) < 0.8 * len(ids) and end.sum() == len(given)
        counts, last = {}, {}
        for k, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
            if not end[k] and last.get(pair) != k - 1:
                counts[pair], last[pair] = counts.get(pair, 0) + 1, k
        assert max(counts.values()) < least
        shard = type("Shard", (), {"symbols": sh.stored(symbols), "n_symbols": len(symbols)})
        assert sh.symbols_of(shard).tolist() == symbols.tolist()
        assert sh.expansions(rules, terminals).sum() == sum(len(sh.expand(np.array([terminals + k]), rules, terminals)) for k in range(len(rules)))


def test_shards(docs):
    tok = Tokenizer.from_file(BYTE)
    given = sorted(texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    stored = sh.write_shards(docs, BYTE, shard_ids=4000)
    want, at = [], 0
    for i, t in given:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, sh.read_shards(stored).collect()), key=str) == sorted(want, key=str)
    for shard in stored.toPandas().itertuples():
        whole = list(sh.documents_of(shard))
        for k in range(0, len(whole), 7):
            (key, start, ids), = sh.documents_of(shard, [k])
            assert (key, start) == whole[k][:2] and ids.tolist() == whole[k][2].tolist()
            for p in (0, len(ids) // 2, len(ids) - 1):
                assert sh.id_at(shard, k, p) == ids[p]
    assert sh.read_shards(sh.write_shards(docs.limit(0), BYTE)).count() == 0


def test_grammar_compresses():
    ids = np.array([1, 2, 3, 4] * 500 + [5], dtype=np.uint32)
    ends = np.zeros(len(ids), dtype=bool)
    ends[-1] = True
    symbols, rules, _ = sh.compress(ids, ends, 10)
    assert len(symbols) < len(ids) / 6 and (sh.expand(symbols, rules, 10) == ids).all()
    same = np.zeros(9, dtype=np.uint32)
    symbols, rules, _ = sh.compress(same, np.arange(9) == 8, 10)
    assert (sh.expand(symbols, rules, 10) == same).all()


def test_likeness_of_scattered_edits():
    words = [f"{chr(97 + i * 7 % 26)}{i * i % 977}" for i in range(1200)]
    text = " ".join(words)
    ends = "X" + text[1:-1] + "Y"
    scattered = " ".join("changed" if i % 120 == 60 else w for i, w in enumerate(words))
    moved = "A new head line\n" + text[:-200] + "another tail"
    for other, least in ((ends, 0.95), (scattered, 0.75), (moved, 0.9)):
        assert least < fp.likeness(fp.fingerprint(text), fp.fingerprint(other)) < 1
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(" ".join(w[::-1] for w in words))) < 0.1
    assert len(fp.fingerprint("a" * 100_000)) < 3000


def test_packing_of_missing_and_repeated_ids(spark):
    rows = [(None, "red fish"), (None, "red fish"), (None, None), (4, "blue " * 700), (4, "blue"), (4, "blue"), (9, "")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, start int, sequence_id string, length int")
    tok = Tokenizer.from_file(WORD)
    sizes = sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    got = pack(docs, WORD, capacity=256).collect()
    assert sum(r.length for r in got) == sum(n for _, n in sizes)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == sizes
    assert pack(docs.limit(0), WORD, capacity=256).count() == 0
