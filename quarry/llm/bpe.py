"""Byte-level BPE encoding through the ``tokenizers`` library, batched by word.

A byte-level BPE vocabulary merges inside one pre-token at a time, so a text's
ids are the concatenation of its pre-tokens' ids.  ``FastEncoder`` finds the
pre-tokens of many texts at once with numpy, asks the library for each
*distinct* pre-token once, and gathers the ids.  Texts with anything outside
plain Latin letters, ASCII and ordinary blanks go to the library whole, so
every result is the library's own.
"""

from __future__ import annotations

import itertools
import os
import unicodedata

import numpy as np
import pandas as pd

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Primes and bases of the two hashes of a byte range.
_FIELDS = ((2_147_483_647, 1_299_709_931), (2_147_483_629, 886_513_027))
#: Bytes of a buffer whose sums need no reduction term by term.
_SHORT = 1 << 23
#: Bytes of text that are worked on at a time, unless one text is longer.
BATCH_BYTES = 2 << 20
#: Distinct pre-tokens a worker remembers before it starts afresh.
CACHE_WORDS = 600_000


def _class(cp: int) -> int:
    ch = chr(cp)
    if cp in (32, 0x85, 0xA0) or 9 <= cp <= 13:
        return SPACE
    kind = unicodedata.category(ch)[0]
    return LETTER if kind == "L" else DIGIT if kind == "N" else OTHER


_LATIN = np.array([_class(c) for c in range(0x250)], dtype=np.uint8)


def _byte_chars() -> dict[int, str]:
    """The character by which byte-level BPE shows each byte: printable bytes as they are, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(int(base), done, 1 << 64))
            done += step
    return out


def _powers_mod(n: int, base: int, prime: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo a prime below 2**31."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out.astype(np.uint32)


class RangeHash:
    """62-bit hashes of any byte ranges of a buffer, by prefix sums: two polynomials, each modulo a prime.

    Modulo a power of two some strings (those of Thue and Morse) collide for
    every base; modulo primes none do so by their structure.
    """

    def __init__(self) -> None:
        self._room = 0

    def load(self, buf: np.ndarray) -> None:
        n = len(buf) + 1
        if self._room < n:
            self._room = n + n // 4
            self._pow = [_powers_mod(self._room, base, prime) for prime, base in _FIELDS]
            self._inv = [_powers_mod(self._room, pow(base, -1, prime), prime) for prime, base in _FIELDS]
        self._sum = []
        plus = buf.astype(np.uint64) + np.uint64(1)
        for (prime, _), power in zip(_FIELDS, self._pow):
            term = plus * power[: n - 1]
            if n > _SHORT:
                term %= np.uint64(prime)
            total = np.zeros(n, dtype=np.uint64)
            np.cumsum(term, out=total[1:])
            self._sum.append(total)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), dtype=np.uint64)
        for (prime, _), total, inverse in zip(_FIELDS, self._sum, self._inv):
            m = np.uint64(prime)
            h = (h << np.uint64(31)) | ((total[end] - total[start]) % m * inverse[start] % m)
        h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA4BCAA75EC3F625)
    return h ^ (h >> np.uint64(32))


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] for every i, end to end."""
    total = int(length.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(length)
    index = np.arange(total) + np.repeat(start - (ends - length), length)
    return values[index]


def differs(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[start:end] is another string than b[other:other+length], range by range."""
    own = end - start
    bad = own != length
    size = np.where(bad, 0, own)
    wrong = np.flatnonzero(gather(a, start, size) != gather(b, other, size))
    if len(wrong):
        bad[np.searchsorted(np.cumsum(size), wrong, side="right")] = True
    return bad


def string_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Small numbers for byte ranges, equal for equal bytes only: ranges of equal key are compared with the first of them."""
    code, keys = pd.factorize(key)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else np.zeros(0, dtype=np.int64)
    like = first[code]
    bad = np.flatnonzero(differs(buf, start, end, buf, start[like], (end - start)[like]))
    if len(bad):
        names: dict[bytes, int] = {}
        code[bad] = [names.setdefault(buf[a:b].tobytes(), len(keys) + len(names)) for a, b in zip(start[bad].tolist(), end[bad].tolist())]
    return code


def pretokens(buf: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the GPT-2 pre-tokens of texts that lie end to end in buf; no text is empty."""
    n = len(buf)
    cls = _LATIN[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        wide = _LATIN[((buf[lead].astype(np.int64) & 31) << 6) | (buf[lead + 1] & 63)]
        cls[lead] = wide
        cls[lead + 1] = wide
    new = np.zeros(n + 1, dtype=bool)
    new[1:n] = cls[1:] != cls[:-1]
    new[doc_start] = True
    new[n] = True
    edges = np.flatnonzero(new)
    rs, re = edges[:-1], edges[1:]
    last = np.zeros(n + 1, dtype=bool)
    last[doc_end] = True
    blank = cls[rs] == SPACE
    final = last[re]
    tail_space = buf[re - 1] == 32
    mark = np.zeros(n + 1, dtype=bool)
    # A run of blanks gives its last one to the next token if that is a space.
    inner = blank & ~final
    mark[rs[blank & final]] = True
    mark[rs[inner & ((re - rs) > 1)]] = True
    mark[re[inner] - 1] = True  # the last blank starts a token, alone or with what follows
    words = ~blank
    prev = np.zeros(len(rs), dtype=bool)
    prev[1:] = inner[:-1] & tail_space[:-1]
    mark[rs[words & ~prev]] = True
    mark[n] = True
    edges = np.flatnonzero(mark)
    return edges[:-1], edges[1:]


class FastEncoder:
    """encode(texts) gives flat uint32 ids and each text's number of ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._lib.encode_special_tokens = True  # their strings in a text are ordinary text
        self._model = self._lib.model
        self._model._resize_cache(0)  # ours holds whole pre-tokens
        self._hash = RangeHash()
        self._forget()

    def _forget(self) -> None:
        self._index: dict[int, int] = {}
        self._ids = np.zeros(1 << 16, dtype=np.uint32)
        self._start = np.zeros(1 << 16, dtype=np.int64)
        self._len = np.zeros(1 << 16, dtype=np.int64)
        self._used = 0
        self._raw = np.zeros(1 << 20, dtype=np.uint8)  # the words themselves: a hash alone proves nothing
        self._raw_start = np.zeros(1 << 16, dtype=np.int64)
        self._raw_len = np.zeros(1 << 16, dtype=np.int64)
        self._raw_used = 0

    def _learn(self, keys: list[int], raw: bytes, start: np.ndarray, end: np.ndarray) -> None:
        """Ask the library's model for the ids of new pre-tokens, raw[start[i]:end[i]]."""
        letters = gather(np.frombuffer(raw, dtype=np.uint8), start, end - start)
        text = letters.tobytes().decode("latin-1").translate(BYTE_CHARS)
        cuts = np.concatenate([[0], np.cumsum(end - start)]).tolist()
        split = self._model.tokenize
        found = [[t.id for t in split(text[a:b])] for a, b in zip(cuts, cuts[1:])]
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32)
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        base, at = len(self._index), self._used
        while base + len(keys) > len(self._start):
            for name in ("_start", "_len", "_raw_start", "_raw_len"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self._raw_used + len(letters) > len(self._raw):
            self._raw = np.concatenate([self._raw, np.zeros_like(self._raw)])
        while at + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[at : at + len(ids)] = ids
        self._start[base : base + len(keys)] = at + np.cumsum(count) - count
        self._len[base : base + len(keys)] = count
        self._used = at + len(ids)
        self._raw[self._raw_used : self._raw_used + len(letters)] = letters
        self._raw_start[base : base + len(keys)] = self._raw_used + np.array(cuts[:-1], dtype=np.int64)
        self._raw_len[base : base + len(keys)] = end - start
        self._raw_used += len(letters)
        self._index.update(zip(keys, range(base, base + len(keys))))

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids of each text, and the texts for which they are wrong: those with a word that shares another's hash."""
        raw = b"".join(texts)
        buf = np.frombuffer(raw, dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        end = np.cumsum(size)
        start = end - size
        some = size > 0
        ts, te = pretokens(buf, start[some], end[some])
        self._hash.load(buf)
        code, keys = pd.factorize(self._hash.of(ts, te))
        if len(self._index) > CACHE_WORDS:
            self._forget()
        keys = keys.tolist()
        at = list(map(self._index.get, keys))
        if None in at:
            new = [i for i, x in enumerate(at) if x is None]
            first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))  # keys are in order of appearance
            spots = first[new]
            self._learn([keys[i] for i in new], raw, ts[spots], te[spots])
            at = list(map(self._index.get, keys))
        place = np.array(at, dtype=np.int64)[code]
        length = self._len[place]
        ids = gather(self._ids, self._start[place], length)
        upto = np.concatenate([[0], np.cumsum(length)])
        cut = np.searchsorted(ts, np.concatenate([start, [len(buf)]]))
        wrong = differs(buf, ts, te, self._raw, self._raw_start[place], self._raw_len[place])
        return ids, upto[cut[1:]] - upto[cut[:-1]], np.unique(np.searchsorted(end, ts[wrong], side="right"))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Null texts count as empty."""
        counts = np.zeros(len(texts), dtype=np.int64)
        parts: list[tuple[list[int], list[bytes]]] = []
        now, raws, size = [], [], 0
        odd: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            b = text.encode()
            if b"'" in b or not text.isascii() and (np.frombuffer(b, dtype=np.uint8).max() > 0xC9 or b"\xc2\x85" in b or b"\xc2\xa0" in b):
                odd.append(i)
                continue
            now.append(i)
            raws.append(b)
            size += len(b)
            if size >= BATCH_BYTES:
                parts.append((now, raws))
                now, raws, size = [], [], 0
        if now:
            parts.append((now, raws))
        ids_of: dict[int, np.ndarray] = {}
        whole: list[np.ndarray] = []
        order: list[int] = []
        for now, raws in parts:
            ids, n, wrong = self._plain(raws)
            if len(wrong):
                odd += [now[i] for i in wrong.tolist()]
                left = np.setdiff1d(np.arange(len(now)), wrong).tolist()
                now, raws = [now[i] for i in left], [raws[i] for i in left]
                if not now:
                    continue
                ids, n, _ = self._plain(raws)
            counts[now] = n
            whole.append(ids)
            order += now
        for i in odd:
            ids_of[i] = np.array(self._lib.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            counts[i] = len(ids_of[i])
        flat = np.concatenate(whole) if whole else np.zeros(0, dtype=np.uint32)
        if not odd:
            return flat, counts
        # Put the odd texts' ids where they belong.
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        ends = np.cumsum(counts)
        begins = ends - counts
        rows = np.array(order, dtype=np.int64)
        if len(rows):
            lens = counts[rows]
            to = np.arange(int(lens.sum())) + np.repeat(begins[rows] - (np.cumsum(lens) - lens), lens)
            out[to] = flat
        for i, ids in ids_of.items():
            out[begins[i] : ends[i]] = ids
        return out, counts
