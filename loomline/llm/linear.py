"""Hashed n-gram features, naive Bayes log-count ratios and the linear model built on them.

Everything here is plain numpy; `classify.py` moves the data. A *featuriser* takes
texts and gives two arrays, text index and bucket, with each pair once and sorted: which texts set which buckets. All
buckets are columns of the model. Texts are worked on in blocks of up to BLOCK bytes so that arrays stay in cache; a longer
text goes through in windows of that size, whose n-grams overlap, so that its features are those of the whole text while
memory is the text, a table over the buckets and, for word shapes, some 12 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from .common import parts

Pairs = tuple[np.ndarray, np.ndarray]
Featuriser = Callable[[Sequence[str]], Pairs]

BLOCK = 1 << 18
_MULT = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint32(32 - bits)).astype(np.int32)


def _by_block(texts: Sequence[str], encode: Callable[[str], bytes], block: Callable[[int, list[bytes]], Pairs], long: Callable[[str], np.ndarray]) -> Pairs:
    """Pairs of all texts: block(first, encoded) of each block of short ones in a row, long(text) of one that is longer."""
    pairs: list[Pairs] = []
    first, part, size = 0, [], 0

    def flush() -> None:
        if part:
            pairs.append(block(first, part))

    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            flush()
            bucket = long(t)
            pairs.append((np.full(len(bucket), i, np.int64), bucket))
            first, part, size = i + 1, [], 0
            continue
        raw = encode(t)
        if part and size + len(raw) > BLOCK:
            flush()
            first, part, size = i, [], 0
        part.append(raw)
        size += len(raw)
    flush()
    return _joined(pairs)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts, by sorting (faster here than numpy's hashing unique)."""
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _merged(lists: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the sums of their counts over several such lists."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    for key, count in lists:
        if total is None:
            total = key, count
            continue
        both, number = np.concatenate([total[0], key]), np.concatenate([total[1], count])
        order = np.argsort(both, kind="stable")
        both, number = both[order], number[order]
        starts = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        total = both[starts], np.add.reduceat(number, starts)
    return total or (np.empty(0, np.int64), np.empty(0, np.int64))


def _unique(of: list[np.ndarray], bucket: list[np.ndarray], bits: int) -> Pairs:
    if not of:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    key, _ = _runs((np.concatenate(of).astype(np.int64) << bits) | np.concatenate(bucket))
    return key >> bits, (key & ((1 << bits) - 1)).astype(np.int32)


def _joined(pairs: list[Pairs]) -> Pairs:
    return (np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])) if pairs else _unique([], [], 0)


def _normal(text: str) -> Iterator[bytes]:
    """The lower-cased text, runs of white space as one space, a space before and after it; in parts if it is long."""
    yield b" "
    for part in parts(text, BLOCK):
        if words := part.lower().split():
            yield f"{' '.join(words)} ".encode("utf-8", "replace")


def char_ngrams(sizes: Sequence[int] = (5, 8), bits: int = 20) -> Featuriser:
    """Hashed n-grams over the UTF-8 bytes of the lower-cased text, runs of white space as one space.

    The text is padded with a space on both sides so that word starts and ends show.
    """
    widest = max(sizes)

    def grams(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each size and the buckets of its n-grams by where they start."""
        h = b = b.astype(np.uint32) + np.uint32(1)
        for n in range(2, widest + 1):
            if len(b) < n:
                break
            h = h[:-1] * _MULT + b[n - 1 :]
            if n in sizes:
                yield n, _bucket(h + np.uint32(n), bits)

    def windows(text: str) -> np.ndarray:
        seen, before = np.zeros(1 << bits, bool), b""
        for part in _normal(text):
            for start in range(0, len(part), BLOCK):
                window = before + part[start : start + BLOCK]
                for _, bucket in grams(np.frombuffer(window, np.uint8)):
                    seen[bucket] = True
                before = window[-(widest - 1) :]
        return np.flatnonzero(seen).astype(np.int32)

    def block(first: int, raw: list[bytes]) -> Pairs:
        of = np.repeat(np.arange(first, first + len(raw)), [len(x) for x in raw])
        ofs, buckets = [], []
        for n, bucket in grams(np.frombuffer(b"".join(raw), np.uint8)):
            inside = of[: len(bucket)] == of[n - 1 :]
            ofs.append(of[: len(bucket)][inside])
            buckets.append(bucket[inside])
        return _unique(ofs, buckets, bits)

    def run(texts: Sequence[str]) -> Pairs:
        return _by_block(texts, lambda t: b"".join(_normal(t)), block, windows)

    return run


#: What a byte says of its word: 1 upper case, 2 lower case, 4 digit, 32 other symbol, 64 ordinary punctuation.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 4
for _c in ".,;:'\"?!-()":
    _CLASS[ord(_c)] = 64
_CLASS[0x80:0xA0] = 1
_CLASS[0xA0:0xC0] = 2
_CLASS[0xC0:] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(64, _MULT, np.uint32), dtype=np.uint32)


def shape_and_word_ngrams(bits: int = 20) -> Featuriser:
    """Indicators of shape_ngrams and, beside them, of the words and word pairs themselves, A-Z as a-z."""
    return shape_ngrams(bits=bits, word_sizes=(1, 2))


@dataclass
class _Words:
    """What is known of each word: its classes, its first byte's class, its length, the hash of its bytes and that of a-z for A-Z."""

    any: np.ndarray
    first: np.ndarray
    length: np.ndarray
    hash: np.ndarray
    low: np.ndarray


def _words(b: np.ndarray) -> tuple[_Words, np.ndarray]:
    """The words of some bytes and where each starts."""
    solid = ~_SPACE[b]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    at = np.flatnonzero(begin)
    starts, b = np.flatnonzero(begin[solid]), b[solid]
    if not len(b):
        none = np.empty(0, np.uint32)
        return _Words(none.astype(np.uint8), none.astype(np.uint8), none.astype(np.int64), none, none), at
    length = np.diff(np.append(starts, len(b)))
    cls = _CLASS[b]
    power = _POWERS[(np.arange(len(b)) - np.repeat(starts, length)) & 63]
    small = b + ((b >= ord("A")) & (b <= ord("Z"))).astype(np.uint8) * np.uint8(32)
    total = lambda x: np.add.reduceat((x.astype(np.uint32) + np.uint32(1)) * power, starts).astype(np.uint32)
    return _Words(np.bitwise_or.reduceat(cls, starts), cls[starts], length, total(b), total(small)), at


def _long_words(text: str) -> _Words:
    """The words of a long text, window after window; one of over BLOCK bytes is put together from parts of 64 bytes' multiples."""
    found: list[_Words] = []
    for part in parts(text, BLOCK):
        raw = np.frombuffer(part.encode("utf-8", "replace"), np.uint8)
        if len(raw) <= 8 * BLOCK:
            found.append(_words(raw)[0])
            continue
        head = int(np.argmin(_SPACE[raw])) if not _SPACE[raw].all() else len(raw)  # white space before the first word
        for a in range(head, len(raw), BLOCK):
            w, at = _words(raw[a : a + BLOCK])
            if a > head and len(at) and not at[0] and not _SPACE[raw[a - 1]] and found and len(found[-1].any):
                x = found[-1]  # the first word goes on from the last window
                shift = int(x.length[-1]) & 63  # bytes that stand in before its part, so that each has the power of its place in the word
                whole = _words(np.concatenate([np.full(shift, 1, np.uint8), raw[a : a + int(w.length[0])]]))[0]
                stand_in = 2 * int(_POWERS[:shift].sum(dtype=np.uint32))
                x.any[-1] |= w.any[0]
                x.length[-1] += w.length[0]
                x.hash[-1] = (int(x.hash[-1]) + int(whole.hash[0]) - stand_in) & 0xFFFFFFFF
                x.low[-1] = (int(x.low[-1]) + int(whole.low[0]) - stand_in) & 0xFFFFFFFF
                w = _Words(w.any[1:], w.first[1:], w.length[1:], w.hash[1:], w.low[1:])
            if len(w.any):
                found.append(w)
    return _Words(*(np.concatenate([getattr(w, k) for w in found] or [np.empty(0, np.uint32)]) for k in ("any", "first", "length", "hash", "low")))


def shape_ngrams(sizes: Sequence[int] = (1, 2, 3), bits: int = 18, word_sizes: Sequence[int] = ()) -> Featuriser:
    """Indicators of n-grams over word shapes, each with the power of two nearest below its share of the text.

    A word's shape is its character classes, its first character's class, its length class and whether it
    repeats one of the two words before it. `(n-gram, share)` is one indicator, so that a page that is junk
    throughout and one with a single odd line differ. A text without words sets one bucket of its own. N-grams of
    the words themselves, of the sizes `word_sizes`, are plain indicators.
    """

    def features(w: _Words, of: np.ndarray, first: int, texts: int, step: int) -> Pairs:
        """Pairs of the words of `texts` texts from number `first`; `step` words at a time."""
        words = np.bincount(of - first, minlength=texts) if len(of) else np.zeros(texts, np.int64)
        ofs, buckets = [np.arange(first, first + texts)], [_bucket((np.log2(words + 1).astype(np.uint32) + np.uint32(0x5EED)) * _MULT, bits)]
        again = np.zeros(len(of), np.uint32)
        again[1:] |= (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
        again[2:] |= (w.hash[2:] == w.hash[:-2]) & (of[2:] == of[:-2])
        shape = w.any.astype(np.uint32) | w.first.astype(np.uint32) << np.uint32(8) | np.searchsorted((2, 4, 7, 12, 25), w.length, "right").astype(np.uint32) << np.uint32(16) | again << np.uint32(20)

        def ngrams(values: np.ndarray, n: int, salt: int) -> Iterator[np.ndarray]:
            """Text and hash of each n-gram, as one number, part after part."""
            for a in range(0, max(0, len(values) - n + 1), step):
                b = min(a + step, len(values) - n + 1)
                h = np.zeros(b - a, np.uint32)
                for j in range(n):
                    h = h * _MULT + (values[a + j : b + j] * _MIX ^ np.uint32(j + 1 + salt))
                inside = of[a:b] == of[a + n - 1 : b + n - 1]
                yield of[a:b][inside].astype(np.int64) << 32 | h[inside]

        for n in sizes:
            key, count = _merged(_runs(k) for k in ngrams(shape, n, 0))
            doc, gram = key >> 32, (key & 0xFFFFFFFF).astype(np.uint32)
            share = np.floor(np.log2(count / (words[doc - first] - n + 1))).astype(np.int64).clip(-12, 0)
            ofs.append(doc)
            buckets.append(_bucket(gram * _MULT + (share + 13).astype(np.uint32) * np.uint32(0x85EBCA6B), bits))
        for n in word_sizes:
            for key in ngrams(w.low, n, 64):
                of_, bucket = _unique([key >> 32], [_bucket((key & 0xFFFFFFFF).astype(np.uint32), bits)], bits)
                ofs.append(of_)
                buckets.append(bucket)
        return _unique(ofs, buckets, bits)

    def block(first: int, raw: list[bytes]) -> Pairs:
        of = np.repeat(np.arange(first, first + len(raw)), [len(x) for x in raw])
        words, at = _words(np.frombuffer(b"".join(raw), np.uint8))
        return features(words, of[at], first, len(raw), max(1, len(at)))

    def long(text: str) -> np.ndarray:
        words = _long_words(text)
        return features(words, np.zeros(len(words.any), np.uint8), 0, 1, 1 << 18)[1]

    def run(texts: Sequence[str]) -> Pairs:
        return _by_block(texts, lambda t: t.encode("utf-8", "replace") + b" ", block, long)

    return run


def log_count_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, alpha: float = 1.0) -> np.ndarray:
    """ln of how much likelier a bucket is set in a text of class 1 than of class 0.

    Smoothed by `alpha` made-up texts that set the bucket, dealt to the classes as the texts are, so that a bucket which
    no text sets says nothing, however unlike in size the classes are.
    """
    share = n_pos / max(1, n_pos + n_neg)
    return np.log((pos + alpha * share) / (n_pos + 2 * alpha * share)) - np.log((neg + alpha * (1 - share)) / (n_neg + 2 * alpha * (1 - share)))


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = bias + the weights of the set buckets."""

    weight: np.ndarray  #: per bucket, log-count ratio times linear weight
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, texts: Sequence[str], features: Featuriser) -> np.ndarray:
        of, bucket = features(texts)
        margin = self.bias + np.bincount(of, self.weight[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def counts(rows: Sequence[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of class 1 and of class 0 set each bucket."""
    out = np.zeros((2, size))
    for r, c in zip(rows, y):
        out[c, r] += 1
    return out[1], out[0]


def fit_hinge(rows: Sequence[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 0.1, squared: bool = False, tolerance: float = 0.1, seed: int = 7) -> tuple[np.ndarray, float]:
    """Support vectors over ratio-scaled indicators by dual coordinate descent; classes weigh the same.

    Minimises half the squared weights and bias plus the hinge losses (squared ones if asked) times their costs. Goes on
    until no projected gradient of the dual in an epoch is beyond the tolerance. Returns, for each bucket, its weight times its
    ratio, and the bias, which is the weight of one more column that is always set.
    """
    sign = 2.0 * y - 1
    part = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y) * cost
    diag, most = (0.5 / part, np.full(len(y), np.inf)) if squared else (np.zeros(len(y)), part)
    square = (ratio**2).astype(np.float32)  # 4 bytes a bucket stay in cache
    q = np.array([square[r].sum(dtype=float) for r in rows]) + 1.0 + diag
    w, b, alpha, rng = np.zeros(len(ratio), np.float32), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    while True:
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            now = w.take(r)
            g = sign[i] * (float(now.sum(dtype=float)) + b) - 1 + diag[i] * alpha[i]
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= most[i] else g
            if projected:
                new = min(max(alpha[i] - g / q[i], 0.0), most[i])
                d = (new - alpha[i]) * sign[i]
                w[r] = now + np.float32(d) * square.take(r)
                b += d
                alpha[i], worst = new, max(worst, abs(projected))
        if worst <= tolerance:
            return w.astype(float), b


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps on smoothed targets; (1, 0) if only one class is there."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -60, 60)))
        s = p * (1 - p) + 1e-9
        ga, gc = ((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()
        haa, hac, hcc = (s * margin**2).sum() + 1e-3, (s * margin).sum(), s.sum() + 1e-9
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        size = max(1.0, abs(da) / 5, abs(dc) / 5)
        a, c = a - da / size, c - dc / size
        if abs(da) + abs(dc) < 1e-8:
            break
    return (float(a), float(c)) if np.isfinite(a) and a > 0 else (1.0, 0.0)


def fit(rows: Sequence[np.ndarray], y: np.ndarray, size: int, cost: float, squared: bool = False, alpha: float = 1.0) -> Model:
    """Trains on all rows; slope and shift come from margins of rows held back from two trial fits.

    With one class only, the score is a constant beside that class: 0 or 1 side of one half.
    """
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 1.0, 2.0 if len(y) and y[0] == 1 else -2.0)

    def trained(at: np.ndarray) -> tuple[np.ndarray, float]:
        some, of = [rows[i] for i in at], y[at]
        pos, neg = counts(some, of, size)
        return fit_hinge(some, of, log_count_ratio(pos, neg, int(of.sum()), int((1 - of).sum()), alpha), cost, squared)

    held, seen = np.arange(len(rows)) % 2, np.zeros(len(rows))
    for part in (0, 1):
        inside = np.flatnonzero(held != part)
        if len(set(y[inside].tolist())) == 2:
            w, b = trained(inside)
            seen[held == part] = [w[rows[i]].sum() + b for i in np.flatnonzero(held == part)]
    w, b = trained(np.arange(len(rows)))
    return Model(w, b, *calibrate(seen, y))
