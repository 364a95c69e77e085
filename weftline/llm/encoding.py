"""Encoding a corpus with a public byte-level BPE vocabulary, by traversal of a trie of its distinct words.

The last token of every prefix of a word settles its encoding: a prefix that
ends in token t is encoded as the prefix without t, then t, and exactly one
token that ends there may follow the last token of what precedes it. So words
are put in a trie, its nodes are visited depth first, and each node gets its
last token from its ancestors'; a prefix that many words share is worked out
once. The trie is held as the sorted list of words: the depth at which a word
leaves its predecessor is the node where the traversal turns.

Two tokens may stand side by side if no merge ever joins across their border.
Merges go by rank, so the border is followed back through the time when either
token was made: while two pieces touch there, a merge of both must come later
than the merges that took them up.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.stretches import stretches

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pattern that splits text before merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words, and characters of stretches of text, that a worker remembers before it forgets them all; characters of text it takes at a time.
REMEMBERED_WORDS, REMEMBERED_CHARACTERS, TEXT_AT_A_TIME = 300_000, 12_000_000, 4_000_000
NEVER = 1 << 62


class Vocabulary:
    """Tokens by id (their rank), and the two tokens each was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left, self.right = [-1] * len(self.tokens), [-1] * len(self.tokens)
        self.unreached: set[bytes] = set()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = (ranks[p] for p in parts)
                else:
                    self.unreached.add(token)
        self.usable = {t: r for t, r in ranks.items() if t not in self.unreached}
        lengths: dict[bytes, set[int]] = {}
        for t in self.usable:
            for k in (1, 2, 3):
                if len(t) >= k:
                    lengths.setdefault(t[-k:], set()).add(len(t))
        self.lengths = {tail: tuple(sorted(x, reverse=True)) for tail, x in lengths.items() if len(tail) == 3}
        self.odd_letters = unassigned_letters()

    def _merge(self, word: bytes, before: int) -> list[bytes]:
        """``word`` after all merges of a rank under ``before``, lowest rank first, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((self.ids.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best >= before:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def plain(self, word: bytes) -> list[int]:
        """The definition, merge by merge; for tests."""
        return [self.ids[p] for p in self._merge(word, NEVER)] if word else []

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def unassigned_letters() -> str:
    """A character class of code points that the pattern's library calls letters or digits, but that older Unicode (as of the public tokenizers) leaves unassigned."""
    free = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    runs: list[list[int]] = []
    for c in map(ord, regex.findall(r"[\p{L}\p{N}]", free)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class TrieEncoder:
    """Encodes words, remembering what it worked out."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, list[int]] = {}
        self._fits: dict[int, bool] = {}
        self._stretches: dict[str, list[int]] = {}
        self._held = 0
        self._pattern = regex.compile(WORD_PATTERN)
        self._odd = regex.compile(f"[{vocabulary.odd_letters}]") if vocabulary.odd_letters else None
        self._one = [vocabulary.usable[bytes([b])] for b in range(256)]

    def words(self, text: str) -> list[str]:
        """The words of a text, which together are the text."""
        if self._odd and not text.isascii() and self._odd.search(text):
            plain = self._odd.sub("�", text)
            return [text[m.start() : m.end()] for m in self._pattern.finditer(plain)]
        return self._pattern.findall(text)

    def fits(self, x: int, y: int) -> bool:
        """Whether token y may directly follow token x."""
        key = x << 20 | y
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._border(x, y)
        return known

    def _border(self, x: int, y: int) -> bool:
        v, ids = self.v, self.v.ids
        x_ends = y_ends = NEVER
        while True:
            joined = ids.get(v.tokens[x] + v.tokens[y], NEVER)
            if joined < x_ends and joined <= y_ends:
                return False
            made_x = x if v.left[x] >= 0 else -1
            made_y = y if v.left[y] >= 0 else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                x_ends, x = x, v.right[x]
            else:
                y_ends, y = y, v.left[y]

    def learn(self, words: set[str]) -> None:
        """Works out the encodings of new words in one traversal of their trie."""
        ids, lengths, tokens, fits = self.v.usable, self.v.lengths, self.v.tokens, self.fits
        pairs = sorted((w.encode(), w) for w in words)
        last: list[int] = []
        before = b""
        for data, word in pairs:
            n, same, most = len(data), 0, min(len(before), len(data))
            if data[:most] == before[:most]:
                same = most
            else:
                while data[same] == before[same]:
                    same += 1
            del last[same:]
            for end in range(same + 1, n + 1):
                state = -1
                if end >= 3:
                    for size in lengths.get(data[end - 3 : end], ()):
                        if size > end:
                            continue
                        t = ids.get(data[end - size : end])
                        if t is not None and (size == end or fits(last[end - size - 1], t)):
                            state = t
                            break
                if state < 0 and end >= 2:
                    t = ids.get(data[end - 2 : end])
                    if t is not None and (end == 2 or fits(last[end - 3], t)):
                        state = t
                last.append(state if state >= 0 else self._one[data[end - 1]])
            out, end = [], n
            while end:
                t = last[end - 1]
                out.append(t)
                end -= len(tokens[t])
            out.reverse()
            self.known[word] = out
            before = data

    def encode_all(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text, the ids of its stretches; a null or empty text has none.

        A text may be cut wherever a word ends and white space follows, as no
        word reaches across. Stretches (sentences and lines) that many texts
        share, such as revisions of a page, are split and encoded once.
        """
        if self._held > REMEMBERED_CHARACTERS:
            self._stretches.clear()
            self._held = 0
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
            self._fits.clear()
        cut = [stretches(t) for t in texts]
        done, known = self._stretches, self.known
        new = {x: self.words(x) for x in set(chain.from_iterable(cut)) if x not in done}
        if fresh := set(chain.from_iterable(new.values())) - known.keys():
            self.learn(fresh)
        for x, words in new.items():
            ids: list[int] = []
            for w in words:
                ids += known[w]
            done[x] = ids
            self._held += len(x)
        return [[done[x] for x in c] for c in cut]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_all([text])[0] for i in ids]


_ENCODERS: dict[str, TrieEncoder] = {}


def _encoder(key: str, packed: bytes) -> TrieEncoder:
    """One encoder a worker and vocabulary, kept from task to task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(pickle.loads(packed))
    return _ENCODERS[key]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts with a bounded number of characters, or of one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > TEXT_AT_A_TIME:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _map_texts(key: str, shared, results: Callable[[list[list[list[int]]]], pa.Array], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for i, j in _pieces(texts):
                done = results(encoder.encode_all(texts[i:j]))
                kept = [b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, done], [*b.schema.names[:-1], name])

    return run


def _as_ids(encoded: list[list[list[int]]]) -> pa.Array:
    flat, ends = [], [0]
    for parts in encoded:
        for ids in parts:
            flat += ids
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))


def _as_counts(encoded: list[list[list[int]]]) -> pa.Array:
    return pa.array([sum(map(len, parts)) for parts in encoded], pa.int64())


def _shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary, read on the driver and broadcast: some 5 MB, whatever the corpus."""
    packed = pickle.dumps(Vocabulary.read(path))
    return hashlib.sha1(packed).hexdigest(), spark.sparkContext.broadcast(packed)


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, results, name: str, kind: str) -> DataFrame:
    key, shared = _shared_vocabulary(df.sparkSession, path)
    rows = df.select(id_col, text_col)
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, {name} {kind}"
    return rows.mapInArrow(_map_texts(key, shared, results, name), schema)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens, whose strings are ordinary text.

    One pass and no shuffle; every row gives a row. A null or an empty text has
    an empty list. Texts of any length are taken whole.
    """
    return _encoded(df, id_col, text_col, vocabulary, _as_ids, "ids", "array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens): the lengths of what :func:`encode_texts` gives; 0 for null and empty texts."""
    return _encoded(df, id_col, text_col, vocabulary, _as_counts, "n_tokens", "long")
