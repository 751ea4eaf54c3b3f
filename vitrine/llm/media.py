"""Media columns: texts stored as WAV files, with spectral-peak pair fingerprints in time-coded arrays.

``wav_bytes`` and ``wav_samples`` write and read 8-bit mono files with the ``wave`` module. The
short-time Fourier transform takes frames of one block with half a block between starts; each frame gives
its two strongest local maxima, and each peak is paired with the strongest peak of the next three frames.
A pair is one long: the frame in the upper 32 bits, then both frequencies and the distance in frames.

Null texts count as empty; an empty payload is padded to one block. Repeated rows give repeated rows, an
empty table gives an empty one, and columns other than id and text are not carried along.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vitrine.llm.common import keyed, unkeyed

BLOCK, RATE, FRAMES, AHEAD = 192, 8000, 4096, 3
#: Bytes of files that a task holds before it hands its rows on.
HELD = 8 << 20
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peak_pairs array<long>, feature string"


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    """Spaces fill the payload up to a positive multiple of the block."""
    return raw + b" " * (max(block, -(-len(raw) // block) * block) - len(raw))


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peak_pairs(samples: bytes, block: int = BLOCK) -> np.ndarray:
    """Time-coded pairs of spectral peaks, ascending."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128
    hop, window = block // 2, np.hanning(block).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, block)[::hop]
    tops = []
    for i in range(0, len(frames), FRAMES):
        mag = np.abs(np.fft.rfft(frames[i : i + FRAMES] * window, axis=1))
        mid = mag[:, 1:-1]
        mid = np.where((mid > mag[:, :-2]) & (mid >= mag[:, 2:]), mid, 0)
        first = mid.argmax(axis=1)
        mid[np.arange(len(mid)), first] = 0
        tops.append(np.stack([first, mid.argmax(axis=1)], axis=1) + 1)
    top = np.concatenate(tops).astype(np.int64)
    n, out = len(top), []
    for d in range(1, min(AHEAD, n - 1) + 1):
        at = np.arange(n - d, dtype=np.int64) << 32
        for k in (0, 1):
            out.append(at | top[: n - d, k] << 20 | top[d:, 0] << 8 | d)
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rate: int = RATE, keep_media: bool = False) -> DataFrame:
    """A row for each document: what was stored, digests of payload and file as read back, peak pairs and their digest.

    ``keep_media`` adds the file itself in ``media``."""
    given, kind = keyed(docs, id_col, text_col)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", *(x.split()[0] for x in SCHEMA.split(", ")), *["media"] * keep_media]
        for batch in batches:
            out, size = [], 0
            for key, text in zip(batch["id"], batch["text"], strict=True):
                raw = text.encode()
                stored = wav_bytes(padded(raw, block), rate)
                payload = wav_samples(stored)
                pairs = peak_pairs(payload, block)
                feature = f"{len(payload) // (block // 2) - 1}.{len(pairs)}.{hashlib.blake2b(pairs.tobytes(), digest_size=16).hexdigest()}"
                row = (key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), pairs, feature)
                out.append((*row, stored) if keep_media else row)
                size += len(stored)
                if size > HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    return unkeyed(given.mapInPandas(rows, f"id string, {SCHEMA}" + ", media binary" * keep_media), id_col, kind)
