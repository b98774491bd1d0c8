"""Hashes of words, their n-grams and their edges for many words at once, and rows of numbers kept by word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Characters taken at once, so that a word of any length needs bounded room beside itself.
SPAN = 1 << 18
_LOW_BITS = 16
#: What a worker keeps by word: an entry counts its characters and ENTRY_BYTES for its place in a dict and a table.
KEPT_BYTES = 40 << 20
ENTRY_BYTES = 220


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """_PRIME to the powers 0 to n - 1."""
    out = np.full(n, _PRIME, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOW = _powers(1 << _LOW_BITS)
_STEP = int(_LOW[-1]) * int(_PRIME) % (1 << 64)


class Words:
    """Words with < before and > behind them, as one array of characters."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def spans(self, more: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place, characters and their words, of SPAN characters and up to more of the next ones."""
        for a in range(0, len(self.codes), SPAN):
            b = min(a + SPAN + more, len(self.codes))
            first, last = int(np.searchsorted(self.starts, a, "right")) - 1, int(np.searchsorted(self.starts, b, "left"))
            ends = np.minimum(self.starts[first:last] + self.sizes[first:last], b)
            yield a, self.codes[a:b].astype(np.uint64), np.repeat(np.arange(first, last), ends - np.maximum(self.starts[first:last], a))

    def ngrams(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and words of all windows of n characters."""
        for _, codes, owner in self.spans(n - 1):
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = h * _PRIME + codes[k : k + m]
            at = np.flatnonzero(owner[:m] == owner[n - 1 :])
            yield mixed(h[at]), owner[at]

    def whole(self) -> np.ndarray:
        """A hash of each word."""
        total = self.sizes.astype(np.uint64)
        high = np.array([pow(_STEP, k, 1 << 64) for k in range((int(self.sizes.max(initial=1)) >> _LOW_BITS) + 1)], dtype=np.uint64)
        for a, codes, owner in self.spans():
            place = np.arange(a, a + len(codes)) - self.starts[owner]
            part = (codes + np.uint64(1)) * _LOW[place & ((1 << _LOW_BITS) - 1)] * high[place >> _LOW_BITS]
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[cuts]] += np.add.reduceat(part, cuts)
        return mixed(total)

    def edges(self, k: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and words of the first or last k characters, of words that have so many."""
        owner = np.flatnonzero(self.sizes - 2 >= k)
        at = self.starts[owner] + (self.sizes[owner] - 1 - k if end else 1)
        h = np.full(len(owner), 16 + 2 * k + end, dtype=np.uint64)
        for j in range(k):
            h = h * _PRIME + self.codes[at + j].astype(np.uint64)
        return mixed(h), owner


class _Memo(dict):
    """Numbers words in the order in which they come; new has those that have no row yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Kept:
    """Rows by word, of columns that rows_of makes for many words at once. Bounded by bytes: when they are more than most_bytes
    at the start of a block, all are forgotten and made again as words come, which gives the same rows."""

    def __init__(self, rows_of: Callable[[list[str]], list[np.ndarray]], most_bytes: int = KEPT_BYTES):
        self.rows_of, self.most_bytes = rows_of, most_bytes
        self.forget()

    def forget(self) -> None:
        self.memo, self.columns, self.held = _Memo(), [], 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' places in columns, valid until the next call."""
        if self.held > self.most_bytes:
            self.forget()
        at = np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))
        if self.memo.new:
            old, n = len(self.memo) - len(self.memo.new), len(self.memo)
            for k, rows in enumerate(self.rows_of(self.memo.new)):
                if k == len(self.columns):
                    self.columns.append(np.zeros((0, *rows.shape[1:]), dtype=rows.dtype))
                if len(self.columns[k]) < n:
                    room = np.zeros((max(n, min(2 * old, old + (1 << 16))) - len(self.columns[k]), *rows.shape[1:]), dtype=rows.dtype)
                    self.columns[k] = np.concatenate([self.columns[k], room])
                self.columns[k][old:n] = rows
            self.held += sum(map(len, self.memo.new)) + ENTRY_BYTES * len(self.memo.new)
            self.memo.new = []
        return at


def blocks(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Places of texts, those of alike size together, in blocks of about most characters (one text at least)."""
    block, held = [], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if block and held + sizes[k] > most:
            yield block
            block, held = [], 0
        block.append(k)
        held += sizes[k]
    if block:
        yield block
