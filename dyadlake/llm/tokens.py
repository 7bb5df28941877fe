"""Token ids of whole texts by the tokenizers library, fast enough for a corpus.

The library's BPE costs about a microsecond a byte, and words repeat. Both tokenizers used
here never join characters across the start of a run of white space, so a text is cut
there, each distinct piece goes to the library when a worker does not know it, and a text's
ids are the pieces' ids joined. Texts with white space other than blank, tab and the line
ends \n, \v, \f, \r could be cut differently by the library's patterns, so they go to it
whole.

Cutting works on the UTF-8 bytes of a run of texts at once, and Arrow finds a run's distinct
pieces, so Python looks at each of these only once a run.

Memory: texts are read in runs of about ``RUN_BYTES``, and what a worker knows is bounded by
``KNOWN_BYTES``: where a run's new pieces would exceed it, the worker forgets all but the
pieces that most runs used, half the bound at most, or all if these leave too little room.
"""

from __future__ import annotations

import re
from array import array
from itertools import compress

import numpy as np

END = 2
RUN_BYTES = 1 << 20
KNOWN_BYTES = 24 << 20
#: What a known piece costs besides its characters: dictionary entry, number and ids.
_ENTRY = 160

_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_PLAIN = re.compile(f"[ \\n]?{_LATIN}+")
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _bytes(some) -> np.ndarray:
    """Table of 256 flags, set for the given bytes."""
    out = np.zeros(256, bool)
    out[list(some)] = True
    return out


_IS_SPACE = _bytes(b" \t\n\x0b\f\r")
#: ASCII that is no letter, digit or white space, without the apostrophe, which may start a piece of its own ("'s").
_IS_MARK = _bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
#: First bytes of the characters of _ODD_SPACE in UTF-8.
_IS_ODD = _bytes(b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef")
#: Neither white space nor of a letter of _LATIN, whose first bytes are letters or C3; what may follow C3.
_IS_OTHER = ~_bytes([*b" \t\n\x0b\f\r", *range(65, 91), *range(97, 123), 0xC3])
_AFTER_C3 = _bytes([b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(where pieces start, and the end; how many each text has; the texts' UTF-8 bytes).

    A piece is a run of white space and what follows it up to the next; where that is Latin
    letters and then ASCII marks (no apostrophe), the marks are a piece of their own.
    """
    raw = [t.encode() for t in texts]
    joined, ends = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    begins, data = np.concatenate([[0], ends[:-1]]), np.frombuffer(joined, np.uint8)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    edge[n] = True
    space = _IS_SPACE[data]
    starts = edge.copy()
    starts[1:n] |= space[1:] & ~space[:-1]
    other = _IS_OTHER[data]
    other[1:] &= ~((data[:-1] == 0xC3) & _AFTER_C3[data[1:]])
    others, marks = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (other, _IS_MARK[data]))
    solid = ~space
    opens, closes = solid & edge[:n], solid & edge[1:]
    opens[1:] |= solid[1:] & space[:-1]
    closes[:-1] |= solid[:-1] & space[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    after = last + 1 - (others[last + 1] - others[first])  # where the marks start, if all that is no letter stands last
    starts[after[(after > first) & (after <= last) & (marks[last + 1] - marks[after] == last + 1 - after)]] = True
    odd = np.flatnonzero(_IS_ODD[data])
    for i in np.unique(np.searchsorted(ends, odd, side="right")).tolist():
        if _ODD_SPACE.search(texts[i]):
            starts[begins[i] + 1 : ends[i]] = False
    offsets = np.flatnonzero(starts)
    at = np.searchsorted(offsets, np.append(begins, n))
    return offsets, np.diff(at), joined


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of many texts at once, as one flat array and offsets."""

    _made: dict[str, Encoder] = {}

    def __init__(self, name: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.lower = self.tokenizer.normalizer is not None  # lower-cases and drops white space
        self.letters = self._byte_letters()
        self.clear()
        words = ["a", " The", "\nThe", "Straße", " élève", "\nzzxqj", " ÀÇÑ"]
        line = chr(self.letters[10])  # the library cuts after it; the model alone must not join it with letters
        self.direct = list(self._words(words)) == [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        self.direct &= self.lower or not any(re.search(line + "[A-Za-zÃ]", t) for t in self.tokenizer.get_vocab(False) if line in t)

    def _byte_letters(self) -> np.ndarray:
        """The character that byte-level BPE writes for each byte: printable ones stay."""
        stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        out = np.arange(256, dtype="<u2")
        others = np.setdiff1d(out, stay)
        out[others] = 256 + np.arange(len(others))
        return out

    def _words(self, pieces: list[str]):
        """ids of each plain piece, by the BPE model itself."""
        joined = "\t".join(pieces)
        if self.lower:
            joined = joined.replace(" ", "").replace("\n", "").lower()
        letters = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        tokenize = self.tokenizer.model.tokenize
        for word in letters.split(chr(self.letters[9])) if pieces else ():
            yield [t.id for t in tokenize(word)]

    @classmethod
    def of(cls, name: str) -> Encoder:
        """One encoder per worker process and vocabulary."""
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    @classmethod
    def release(cls) -> None:
        """Drops the worker's encoders: workers live on, and other stages need the memory."""
        cls._made.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = self.cost = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.price = np.zeros(1 << 16, np.int64)
        self.runs = np.zeros(1 << 16, np.int64)  # that used a piece

    def _forget(self) -> None:
        """Keeps the pieces that most runs used, half of KNOWN_BYTES at most, none that only one run used."""
        k = len(self.known)
        runs, price, length = self.runs[:k], self.price[:k], self.length[:k]
        order = np.argsort(-runs, kind="stable")
        order = np.sort(order[(np.cumsum(price[order]) <= KNOWN_BYTES // 2) & (runs[order] > 1)])
        keep = np.zeros(k, bool)
        keep[order] = True
        pieces = list(compress(self.known, keep.tolist()))
        n = length[order]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.start[order] - (ends - n), n) + np.arange(int(n.sum()))]
        runs, price = runs[order], price[order]
        self.clear()
        self._keep(pieces, n, flat, price)
        self.runs[: len(runs)] = runs

    def _learn(self, pieces: list[str]) -> None:
        plain, others = [], []
        for p in pieces:
            (plain if self.direct and _PLAIN.fullmatch(p) else others).append(p)
        self._keep_lists(plain, self._words(plain))
        for i in range(0, len(others), 5_000):
            some = others[i : i + 5_000]
            self._keep_lists(some, (e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)))

    def _keep_lists(self, pieces: list[str], ids) -> None:
        flat, length = array("I"), array("q")
        for x in ids:
            flat.extend(x)
            length.append(len(x))
        self._keep(pieces, np.frombuffer(length, np.int64), np.frombuffer(flat, np.uint32), _ENTRY + 4 * np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def _keep(self, pieces: list[str], length: np.ndarray, flat: np.ndarray, price: np.ndarray) -> None:
        k, n = len(self.known), len(pieces)
        while k + n > len(self.start):
            self.start, self.length, self.price, self.runs = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.price, self.runs))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[k : k + n] = self.used + np.cumsum(length) - length
        self.length[k : k + n] = length
        self.price[k : k + n] = price
        self.used += len(flat)
        self.cost += int(price.sum())
        self.known.update(zip(pieces, range(k, k + n), strict=True))

    def encode(self, texts, run_bytes: int = RUN_BYTES):
        """Yields (index of the first text, flat ids with the end id, offsets) for runs of texts."""
        first, run, size, i = 0, [], 0, -1
        for i, text in enumerate(texts):
            run.append(text or "")
            size += len(run[-1])
            if size >= run_bytes:
                yield first, *self._ids(run)
                first, run, size = i + 1, [], 0
        if run:
            yield first, *self._ids(run)

    def _new(self, pieces: list[str]) -> tuple[list[str], int]:
        """The pieces not known, and what they will cost."""
        known = self.known
        new = [p for p in pieces if p not in known]
        return new, 4 * sum(map(len, new)) + _ENTRY * len(new)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        starts, counts, joined = cut(texts)
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(joined)).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        new, cost = self._new(distinct)
        if self.cost + cost > KNOWN_BYTES and self.known:
            self._forget()
            new, cost = self._new(distinct)
            if self.cost + cost > KNOWN_BYTES and self.known:
                self.clear()
                new = distinct
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.runs[number] += 1
        at = number[pieces.indices.to_numpy()]
        length = self.length[at]
        ends = np.cumsum(length)
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        offsets = per_text + np.arange(len(counts) + 1)  # one end id per text
        ids = np.full(offsets[-1], END, np.uint32)
        body = np.ones(offsets[-1], bool)
        body[offsets[1:] - 1] = False
        total = int(ends[-1]) if len(ends) else 0
        ids[body] = self.flat[np.repeat(self.start[at] - (ends - length), length) + np.arange(total)]
        return ids, offsets
