"""BPE encoding and decoding by speculation: guess tokens greedily, check all neighbours, merge only where wrong.

For merges in order of rank, a row of tokens is what merging gives exactly if each token is what its own symbols
merge to and each two neighbours are what their joint symbols merge to. So a word's tokens are first guessed by
greedy longest match over such tokens; then all distinct neighbouring pairs of a batch are checked at once in
numpy, by walking back the merges on either side of the seam; only words with a pair that fails are merged in full.

The vocabulary is a `tokenizers` file with normaliser NFC, white space to one space, lower case; words by its
pattern; bytes as letters; a mark at the end of a word. Texts of letters up to U+024F are split here, any other
text by the library's own normaliser and splitter. Strings of special tokens inside a text become these tokens, as
is the library's default. Decoding joins the tokens' strings with spaces, as the library does without a decoder.

Cases: null counts as empty; empty text has no tokens and decodes to the empty string; words of any length (merging
takes n log n); repeated rows are encoded each. Memory: one text and caches of `CACHE` words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, per_worker

#: Words that a worker's caches hold before they start anew, and the characters of the longest that is kept.
CACHE, LONGEST = 500_000, 64
_NEVER = np.int64(1) << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letter:
            letter[b] = chr(256 + len(letter) - len(plain))
    return [letter[b] for b in range(256)]


LETTERS = byte_letters()
_TO_LETTER = dict(enumerate(LETTERS))
_TO_BYTE = {ord(c): b for b, c in enumerate(LETTERS)}

_SPACE = "\t-\r \x85\xa0"
_ODD = re.compile("[^\\x00-\x1b\x20-ɏ‐-‧]")  # beyond these the library splits
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w{_SPACE}]|_)+")


#: Put before a word that the library has split off: one word, whatever is in it. Texts that hold it are odd ones.
_WHOLE = "\x1c"


class Vocabulary:
    """Tokens by number, the merge that makes each, and the exact encoding of single words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("ignore_merges") or spec["decoder"]:
            raise ValueError(f"{path}: not a vocabulary of the kind that is encoded here")
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        self.id: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        n = max([*self.id.values(), *self.special.values()]) + 1
        self.token = [""] * n
        for t, i in [*self.id.items(), *self.special.items()]:
            self.token[i] = t
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        twice: set[int] = set()
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = self.id[a], self.id[b], self.id[a + b]
            if (x, y) in self.merges:
                continue
            self.merges[x, y] = (r, z)
            if self.rank[z] >= 0:
                twice.add(z)
            else:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([(x << 32) | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._greedy(twice)

    def _greedy(self, twice: set[int]) -> None:
        """Keeps for guessing only tokens that their own symbols merge to."""
        made = np.flatnonzero(self.rank >= 0)
        a, b, r = self.left[made], self.right[made], self.rank[made]
        fine = ~self.clash(a, b, r, below=True) & (self.rank[a] < r) & (self.rank[b] < r)
        sound = np.ones(len(self.token), bool)
        sound[list(twice)] = False
        for i, ok in zip(made[np.argsort(r)].tolist(), fine[np.argsort(r)].tolist()):
            sound[i] &= ok and sound[self.left[i]] and sound[self.right[i]]
        self.inner, self.last = {}, {}
        for t, i in self.id.items():
            if sound[i]:
                if self.end and t.endswith(self.end):
                    self.last[t[: -len(self.end)]] = i
                else:
                    self.inner[t] = i
        if not self.end:
            self.last = self.inner
        self.widest = max(map(len, self.last))
        self.reach: dict[str, int] = {}  # first three letters -> length of the longest inner token that starts so
        for t in self.inner:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 2), len(t))

    def clash(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None, below: bool = False) -> np.ndarray:
        """For each pair of tokens, whether merging their joint symbols crosses the seam.

        Walks back in time: x and y are what stands on either side of the seam, used up by their own merges at
        ranks x_until and y_until. With `below`, the pair itself merges at `limit` and only what comes before counts.
        """
        x, y = a.copy(), b.copy()
        x_until = np.full(len(x), _NEVER) if limit is None else limit.copy()
        y_until = x_until.copy()
        bad, live = np.zeros(len(x), bool), np.arange(len(x))
        first = below
        while len(live):
            if not first:
                key = (x[live] << 32) | y[live]
                at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
                when = np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER)
                # at equal rank the leftmost goes first: the left side's own merge is to the left of the seam, the right side's to the right
                bad[live] |= (when < x_until[live]) & (when <= y_until[live]) & (when < _NEVER)
            first = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            go_x, go_y = live[(rx > ry)], live[(rx <= ry) & (ry >= 0)]
            x_until[go_x], y_until[go_y] = self.rank[x[go_x]], self.rank[y[go_y]]
            x[go_x], y[go_y] = self.right[x[go_x]], self.left[y[go_y]]
            live = np.sort(np.concatenate([go_x, go_y]))
            live = live[~bad[live]]
        return bad

    def guess(self, word: str) -> list[int] | None:
        """Greedy longest match over the letters of a word; None where nothing matches."""
        out, i, n, inner, last, widest, reach = [], 0, len(word), self.inner, self.last, self.widest, self.reach
        while i < n:
            if n - i <= widest and (t := last.get(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + reach.get(word[i : i + 3], 2)), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank first and leftmost first; over a heap where the word is long."""
        ids = [self.id[c] for c in word[:-1]] + [self.id[word[-1] + self.end]]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.merges.get, (1 << 60, 0)
        steps = [get(p, none) for p in zip(ids, ids[1:])]
        while steps:
            least = min(steps)
            if least is none:
                break
            i = steps.index(least)
            ids[i : i + 2] = [least[1]]
            del steps[i]
            if i:
                steps[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(steps):
                steps[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        merges = self.merges
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Token numbers of each word: guess all, check all neighbours at once, merge those that fail."""
        letters = [w.encode("utf-8").decode("latin-1").translate(_TO_LETTER) for w in words]
        found = [self.guess(x) for x in letters]
        sizes = [len(f) if f else 0 for f in found]
        flat = np.fromiter((t for f in found for t in f or ()), np.int64, sum(sizes))
        of = np.repeat(np.arange(len(words)), sizes)
        inside = of[1:] == of[:-1]
        key, back = np.unique((flat[:-1][inside] << 32) | flat[1:][inside], return_inverse=True)
        wrong = self.clash(key >> 32, key & 0xFFFFFFFF)[back]
        self.failed = set(of[:-1][inside][wrong].tolist()) | {i for i, f in enumerate(found) if f is None}
        for i in self.failed:
            found[i] = self.merge(letters[i])
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text that holds no special token, after normalising."""
        if not _ODD.search(text):
            return _WORDS.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(_TO_BYTE[ord(c)] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.token[i] for i in ids])


class Encoder:
    """Texts to (ids and tokens, each joined by spaces), with caches by word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces between white space; their words are guessed, checked and merged together."""
        todo = list(pieces)
        split = [[p[1:]] if p[0] == _WHOLE else _WORDS.findall(p) for p in todo]
        words = list({w for ws in split for w in ws})
        known = dict(zip(words, self.v.encode_words(words)))
        token = self.v.token
        for p, ws in zip(todo, split):
            ids = known[ws[0]] if len(ws) == 1 else [i for w in ws for i in known[w]]
            self.ids[p], self.tokens[p] = " ".join(map(str, ids)), " ".join([token[i] for i in ids])

    def _plain(self, text: str) -> list[str]:
        """Pieces of a text that holds no special token, lower-cased as their cache keys are."""
        return [_WHOLE + w for w in self.v.words(text)] if _ODD.search(text) else text.lower().split()

    def encode(self, texts: Sequence[str]) -> list[tuple[str, str]]:
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.tokens.clear()
        special, split = self.v.special, []
        for text in texts:
            parts = self.v.cut.split(text) if self.v.cut and "<|" in text else [text]
            split.append([p if k % 2 else self._plain(p) for k, p in enumerate(parts)])  # a str is a special token
        new = set().union(*(ws for parts in split for ws in parts if type(ws) is list)) - self.ids.keys()
        self._learn(new)
        out = []
        for parts in split:
            if len(parts) == 1:
                out.append((" ".join(map(self.ids.__getitem__, parts[0])), " ".join(map(self.tokens.__getitem__, parts[0]))))
            else:
                ids = [str(special[x]) if type(x) is str else " ".join(map(self.ids.__getitem__, x)) for x in parts]
                tokens = [x if type(x) is str else " ".join(map(self.tokens.__getitem__, x)) for x in parts]
                out.append((" ".join(filter(None, ids)), " ".join(filter(None, tokens))))
        for w in [w for w in new if len(w) > LONGEST]:
            del self.ids[w], self.tokens[w]
        return out


def _encoder(path: str) -> Encoder:
    return per_worker(("bpe", path), lambda: Encoder(Vocabulary(path)))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """documents with the columns ids (array of int) and decoded (string)."""

    def make() -> Callable[[list[str]], list]:
        encoder = _encoder(path)

        def work(texts: list[str]) -> list:
            made = encoder.encode(texts)
            return [[np.array(i.split(), np.int32) for i, _ in made], [t for _, t in made]]

        return work

    return append_columns(documents, "text", [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with one more column, decoded: the text of an array of token numbers (null: empty)."""
    out = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    at = encoded.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        v = _encoder(path).v
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.decode(x or ()) for x in batch.column(at).to_pylist()], pa.string())], names=out.names)

    return encoded.mapInArrow(run, out)


def digests(documents: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, ids_sha256 and decoded_sha256 of every document; the long columns stay in the worker."""

    def make() -> Callable[[list[str]], list]:
        encoder = _encoder(path)

        def work(texts: list[str]) -> list:
            made = encoder.encode(texts)
            return [
                [ids.count(" ") + 1 if ids else 0 for ids, _ in made],
                [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in made],
                [hashlib.sha256(text.encode()).hexdigest() for _, text in made],
            ]

        return work

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(documents.select("doc_id", *keep, "text"), "text", fields, make, keep_text=False)
