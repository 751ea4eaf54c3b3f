"""Byte-pair encoding by a depth-first walk over a trie of distinct words.

The encoding of a word's prefix is fixed by its last token and the encoding of what stands before
that token: a token may follow another exactly if merging the two side by side gives them back. So
each trie node keeps one state, the last token of its prefix, and words that share a prefix share the
states along it. The files of the ``tokenizers`` library supply vocabulary, merges and rules.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import regex

from vitrine.llm.common import cached_for

#: Fixed values of byte-level BPE files: how they split text into words.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks kept per worker process.
CACHE = 800_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkCache:
    """Cuts texts at single spaces, where no word spans the cut, and encodes each distinct chunk once for a worker.

    A subclass says how chunks are encoded. ``kind`` is the type of an id; ``lowers`` tells vocabularies that drop white space."""

    lowers = False
    kind = np.dtype("<u2")

    def __init__(self):
        self.cache: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_spaced(self, chunks: list[str]) -> list[bytes]:
        """Chunks that begin with a space and hold no other; no white space at either end behind it, no special token."""
        return self.encode_chunks(chunks)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of ``kind``; about a megabyte of text at a time."""
        out, i = [], 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (n < 1 << 20 or j == i):
                n += len(texts[j])
                j += 1
            out += self._encode(texts[i:j])
            i = j
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) + len(self.heads) > CACHE:
            self.cache, self.heads, self.odd = {}, {}, set()
        cut, chunks = [], set()
        for t in texts:
            pieces = ([t] if re.search("[\x1c-\x1f]", t) else t.split()) if self.lowers else t.split(" ")
            chunks.update(pieces if self.lowers else pieces[1:])
            cut.append(pieces)
        new = list(chunks.difference(self.cache, self.odd))
        if not self.lowers:
            # a space next to other white space may belong to a longer run; a text with a special token is cut there first
            self.odd.update(c for c in new if not c or c[0].isspace() or c[-1].isspace() or "<|" in c)
            for i, p in enumerate(cut):
                if not self.odd.isdisjoint(p) or not p[0] or p[0][-1].isspace() or "<|" in p[0]:
                    cut[i] = [texts[i]]
            heads = list({p[0] for p in cut}.difference(self.heads))
            self.heads.update(zip(heads, self.encode_chunks(heads), strict=True))
            # texts with an odd chunk are encoded whole, so their chunks aren't looked up
            new = [c for c in new if c not in self.odd]
            self.cache.update(zip(new, self.encode_spaced([" " + c for c in new]), strict=True))
        else:
            self.cache.update(zip(new, self.encode_chunks(new), strict=True))
        get, heads = self.cache.__getitem__, self.heads
        if self.lowers:
            return [b"".join(map(get, p)) for p in cut]
        return [heads[p[0]] + b"".join(map(get, p[1:])) for p in cut]


class RankBpe(ChunkCache):
    """A byte-level file's chunks, merged by rank in tiktoken; special tokens as the ``tokenizers`` library reads them."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(self.size, dtype=bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.coder = tiktoken.Encoding("own", pat_str=BYTE_WORDS, mergeable_ranks=ranks, special_tokens=special)

    def encode_spaced(self, chunks: list[str]) -> list[bytes]:
        """All chunks as one text, whose words are those of the chunks; tokens that begin with a space tell where one begins."""
        if not chunks:
            return []
        ids = np.array(self.coder.encode_ordinary("".join(chunks)), dtype=self.kind)
        cuts = (np.flatnonzero(self.spaced[ids]) * self.kind.itemsize).tolist()
        if len(cuts) != len(chunks):
            raise ValueError("a chunk doesn't begin with a space")
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        plain, letter = self.coder.encode_ordinary, "H" if self.kind.itemsize == 2 else "I"
        return [pack(f"<{len(ids)}{letter}", *ids) for ids in (plain(c) if "<|" not in c else self.coder.encode(c, allowed_special="all") for c in chunks)]


class WordBpe(ChunkCache):
    """A lower-casing file with word ends: the ``tokenizers`` library encodes each distinct word once."""

    lowers = True

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"]["end_of_word_suffix"]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self.known: dict[str, bytes] = {}

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known = {}
        known, of = self.known, []
        for c in chunks:
            low = c.lower() if c.isascii() else c
            of.append(self.words.findall(low) if low.isascii() and "<|" not in c else None)
        new = list({w for p in of if p for w in p}.difference(known))
        if new:
            ids = np.array(self.coder.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            raw, step, at = ids.tobytes(), self.kind.itemsize, 0
            if len(cuts) != len(new):
                raise ValueError("a word has no end")
            for w, to in zip(new, cuts, strict=True):
                known[w] = raw[at * step : to * step]
                at = to
        whole = [c for c, p in zip(chunks, of, strict=True) if p is None]
        other = iter(np.array(e.ids, dtype=self.kind).tobytes() for e in self.coder.encode_batch_fast(whole, add_special_tokens=False)) if whole else iter(())
        return [next(other) if p is None else b"".join([known[w] for w in p]) for p in of]


class TrieBpe(ChunkCache):
    """Encodes and decodes as the ``tokenizers`` library does with the same file, no special tokens added."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t) - (len(self.end) if self.end and t.endswith(self.end) else 0) for t in self.vocab)
        self.lowers = bool(self.end)
        pre = spec["pre_tokenizer"]
        self.words = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"] if self.lowers else BYTE_WORDS)
        letters = byte_letters()
        self.letter_of = str.maketrans({chr(b): c for b, c in letters.items()})
        back = {ord(c): b for b, c in letters.items()}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.size, self.kind = size, np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in self.vocab.items():
            self.bytes_of[i] = bytes(back[ord(c)] for c in t.removesuffix(self.end)) if all(ord(c) in back for c in t.removesuffix(self.end)) else t.encode()
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self._table()

    # one word ------------------------------------------------------------------------------------

    def _table(self) -> None:
        """Tokens by merge order (letters first), how each splits, and which lengths of tokens end in which letters."""
        made: dict[str, tuple[int, str, str]] = {}
        for (a, b), r in self.rank.items():
            made.setdefault(a + b, (r, a, b))
        n = len(self.vocab)
        letters = [t for t in self.vocab if t not in made]
        self.order = {t: i for i, t in enumerate(letters)} | {t: len(letters) + r for t, (r, _, _) in made.items() if t in self.vocab}
        self.split = {self.order[t]: (self.order[a], self.order[b]) for t, (_, a, b) in made.items() if t in self.order and a in self.order and b in self.order}
        self.pair = {(self.order[a], self.order[b]): self.order[a + b] for a, b in self.rank if a in self.order and b in self.order and a + b in self.order}
        self.id_of = {o: self.vocab[t] for t, o in self.order.items()}
        assert len(self.id_of) == n
        self.lengths: dict[str, set[int]] = {}
        for t, o in self.order.items():
            body = t.removesuffix(self.end) if self.end and t != self.end else t
            if not self._stands(o):
                continue
            for k in range(1, min(4, len(body)) + 1):
                if k == 4 or k == len(body):
                    self.lengths.setdefault(body[-k:], set()).add(len(body))
        self.tries: dict[str, tuple[int, ...]] = {}

    def _stands(self, t: int) -> bool:
        """Whether merging the token's own letters gives the token: its two parts may stand side by side but for this merge."""
        return t not in self.split or self._apart(*self.split[t], below=t)

    def _apart(self, u: int, t: int, below: int = 1 << 40) -> bool:
        """Whether no merge made before ``below`` joins letters of u with letters of t, when either is built up merge by merge."""
        limit, split, pair = below, self.split, self.pair
        while True:
            joined = pair.get((u, t))
            if joined is not None and joined < limit:
                return False
            if u > t:
                limit = u
                u = split[u][1] if u in split else u
                if u == limit:
                    limit = t + 1
                    t = split[t][0] if t in split else t
                    if t + 1 == limit:
                        return True
            else:
                limit = t + 1
                t = split[t][0] if t in split else t
                if t + 1 == limit:
                    limit = u
                    u = split[u][1] if u in split else u
                    if u == limit:
                        return True

    def _tries(self, tail: str) -> tuple[int, ...]:
        """Lengths that a token may have before this point, the longest first, by the last four letters."""
        found = self.tries[tail] = tuple(sorted({n for k in range(1, len(tail) + 1) for n in self.lengths.get(tail[-k:], ())}, reverse=True))
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words (in byte letters). In sorted order each word is the next leaf of the trie's depth-first walk; the path keeps one (token, length) per node."""
        out, order, end, fits, tries, id_of, kind = {}, self.order, self.end, self.fits, self.tries, self.id_of, self.kind
        small = kind.itemsize == 2
        last, size, path = [-1], [0], ""
        for word in sorted(words):
            body = word[:-1] if end else word
            most = min(len(path), len(body))
            keep = most
            if path[:most] != body[:most]:
                keep = 0
                while path[keep] == body[keep]:
                    keep += 1
            del last[keep + 1 :], size[keep + 1 :]
            path = body
            for i in range(keep + 1, len(body) + 1):
                tail = body[i - 4 : i] if i > 4 else body[:i]
                for n in tries.get(tail) or self._tries(tail):
                    if n > i:
                        continue
                    t = order.get(body[i - n : i])
                    if t is None:
                        continue
                    u = last[i - n]
                    if u < 0:
                        break
                    key = u << 20 | t
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self._apart(u, t)
                    if ok:
                        break
                else:
                    raise ValueError(f"no encoding of {body[:i]!r}")
                last.append(t)
                size.append(n)
            ids, i = [], len(body)
            if end:
                m, closed = len(word), word + end
                for n in range(min(m, self.longest), 0, -1):
                    t = order.get(closed[m - n :])
                    if t is not None and self._stands(t):
                        u = last[m - n]
                        if u < 0:
                            break
                        key = u << 20 | t
                        ok = fits.get(key)
                        if ok is None:
                            ok = fits[key] = self._apart(u, t)
                        if ok:
                            break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                ids.append(id_of[t])
                i = m - n
            while i:
                ids.append(id_of[last[i]])
                i -= size[i]
            ids.reverse()
            out[word] = pack(f"<{len(ids)}{'H' if small else 'I'}", *ids)
        return out

    # whole texts ---------------------------------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        """The words of a text without special tokens, in byte letters."""
        if self.lowers:
            text = unicodedata.normalize("NFC", text)
            text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        return [w.encode().decode("latin-1").translate(self.letter_of) for w in self.words.findall(text)]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Encodes chunks of text that haven't been met yet; their distinct words go through the trie once."""
        one = {t: np.array([i], dtype=self.kind).tobytes() for t, i in self.special.items()}
        of: list[list] = []
        for c in chunks:
            if "<|" in c and self.special:
                of.append([w for p in self.special_at.split(c) if p for w in ([one[p]] if p in one else self._split(p))])
            else:
                of.append(self._split(c))
        known = self.known
        if len(known) > CACHE:
            known = self.known = {}
        known.update(self.encode_words({w for parts in of for w in parts if w.__class__ is str and w not in known}))
        return [known[p[0]] if len(p) == 1 and p[0].__class__ is str else b"".join([known[w] if w.__class__ is str else w for w in p]) for p in of]

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, kind: str = "trie") -> ChunkCache:
    """One encoder for each file and worker process, kept between the tasks of encoding operators."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return {"trie": TrieBpe, "rank": RankBpe, "word": WordBpe}[kind](path)


cached_for("encoding", encoder.cache_clear)
