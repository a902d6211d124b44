"""Byte-pair encoding and decoding by a trie over distinct words.

The encoding of a string is settled by its last token: take off the last token of a prefix, and what
is left is the encoding of the shorter prefix. A token may follow another only if merging the two
side by side never joins across the seam. So, for each prefix, the last token is the one suffix that is
a token, reaches itself by merging, and may follow the last token of the prefix before it.

Distinct words are put into a trie and walked depth first; each node gets the last token of its prefix
from the nodes above it. A prefix that many words share is worked out once. Words already met are kept
in a table of bounded size. Nothing is shuffled: each task works through its own texts, whole, in
slices of bounded size.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import free_name, ship

#: Words whose encodings a worker keeps; when it is full, it starts anew.
KEPT_WORDS = 150_000
#: Characters of text that are worked on together, and words of one text.
SLICE_CHARS = 1 << 20
SLICE_WORDS = 100_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _latin_splitter() -> tuple[re.Pattern, re.Pattern]:
    """The splitting pattern for characters below U+0250, and a pattern that finds any others."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for i in range(0x250):
        kind = unicodedata.category(chr(i))[0]
        if kind in kinds:
            kinds[kind].append(re.escape(chr(i)))
    letter, number = "".join(kinds["L"]), "".join(kinds["N"])
    space = "\t-\r \x85\xa0"
    split = (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )
    # \x1c to \x1f are left to the library's own splitter.
    return re.compile(split), re.compile("[^\x00-\x1b\x20-ɏ]")


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, as the ``tokenizers`` library writes it."""

    def __init__(self, text: str):
        data = json.loads(text)
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.added = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, number in vocab.items():
            self.bytes[number] = bytes(alphabet[c] for c in token)
        for token, number in self.added.items():
            self.bytes[number] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.merges: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            if pair not in self.merges:
                self.merges[pair] = rank
                parts.setdefault(made, pair)
        # Pieces of a token at its right and left edge, with the rank at which each is used up.
        self.right: dict[int, list[tuple[int, int, int]]] = {}
        self.left: dict[int, list[tuple[int, int, int]]] = {}
        single = {alphabet[t]: i for t, i in vocab.items() if len(t) == 1}
        for number in single.values():
            self.right[number] = self.left[number] = [(number, -1, NEVER)]
        for made, (a, b) in parts.items():  # in order of rank
            rank = self.merges[a, b]
            if a not in self.right or b not in self.right or self.joins(a, b, rank):
                continue  # merging never gets to this token
            self.right[made] = [(made, rank, NEVER), (b, self.right[b][0][1], rank), *self.right[b][1:]]
            self.left[made] = [(made, rank, NEVER), (a, self.left[a][0][1], rank), *self.left[a][1:]]
        self.follows: dict[int, bool] = {}
        # States of a suffix automaton, made as they are met: the longest suffix that begins a token.
        self.tokens = {self.bytes[number]: number for number in self.right}
        self.begins = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.states: dict[bytes, tuple] = {}
        self.size = size
        self.start = self.state(b"")
        self.words: dict[str, tuple[int, ...]] = {}
        self.splitter, self.other = _latin_splitter()
        self.specials = None
        if self.added:
            longest = sorted(self.added, key=len, reverse=True)
            self.specials = re.compile("(" + "|".join(map(re.escape, longest)) + ")")

    def joins(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether merging ``a`` next to ``b`` joins across the seam, by a merge of rank below ``before``."""
        for x, made_x, used_x in self.right[a]:
            for y, made_y, used_y in self.left[b]:
                rank = self.merges.get((x, y))
                if (
                    rank is not None
                    and rank < before
                    and rank > made_x
                    and rank > made_y
                    and rank < used_x  # at the same rank, the merge further left goes first
                    and rank <= used_y
                ):
                    return True
        return False

    def state(self, suffix: bytes) -> tuple:
        """(suffix, its tokens that end here as (token, length), longest first, known next states)."""
        found = self.states.get(suffix)
        if found is None:
            ends = (suffix[i:] for i in range(len(suffix)))
            tokens = [(self.tokens[e], len(e)) for e in ends if e in self.tokens]
            found = self.states[suffix] = (suffix, tokens, {})
        return found

    def step(self, state: tuple, byte: int) -> tuple:
        suffix = state[0] + bytes((byte,))
        while suffix not in self.begins:
            suffix = suffix[1:]
        found = state[2][byte] = self.state(suffix)
        return found

    def learn(self, words: set[str]) -> None:
        """Encode all the words by one walk over their trie."""
        root: dict = {}
        for word in words:
            node = root
            for byte in word.encode():
                below = node.get(byte)
                if below is None:
                    below = node[byte] = {}
                node = below
            node[-1] = word
        # Last token of each prefix of the path, how long it is, and the automaton's state.
        longest = max((4 * len(w) for w in words), default=0) + 1
        last, length = [0] * longest, [0] * longest
        stack = [(root, 0, self.start)]
        push, pop = stack.append, stack.pop
        follows, found, step, size = self.follows, self.words, self.step, self.size
        while stack:
            node, depth, state = pop()
            if depth:
                for token, n in state[1]:
                    if n == depth:
                        break
                    pair = last[depth - n] * size + token
                    good = follows.get(pair)
                    if good is None:
                        good = follows[pair] = not self.joins(last[depth - n], token)
                    if good:
                        break
                last[depth], length[depth] = token, n
            known = state[2]
            for key, below in node.items():
                if key >= 0:
                    push((below, depth + 1, known.get(key) or step(state, key)))
                else:
                    ids, at = [], depth
                    while at:
                        ids.append(last[at])
                        at -= length[at]
                    ids.reverse()
                    found[below] = tuple(ids)

    def split(self, text: str) -> Iterator[str]:
        """The words of a text that has no added token."""
        if self.other.search(text) is None:
            return (m[0] for m in self.splitter.finditer(text)) if len(text) > SLICE_CHARS else iter(
                self.splitter.findall(text)
            )
        from tokenizers.pre_tokenizers import ByteLevel

        parts = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
        return (text[a:b] for _, (a, b) in parts)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words of a whole text, in lists of bounded length. Added tokens come as words of their own."""
        if len(text) <= SLICE_WORDS and not (self.specials and self.specials.search(text)):
            if self.other.search(text) is None:
                yield self.splitter.findall(text)
                return
        parts = self.specials.split(text) if self.specials else [text]
        words = chain.from_iterable(
            [part] if i % 2 else self.split(part) for i, part in enumerate(parts) if part
        )
        while some := list(islice(words, SLICE_WORDS)):
            yield some

    def encode_pieces(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Yield (number of the text, ids of its next piece); a text without words yields nothing."""
        waiting: list[tuple[int, list[str]]] = []
        n = 0
        for i, text in enumerate(texts):
            for words in self.pieces(text):
                waiting.append((i, words))
                n += len(words)
                if n >= SLICE_WORDS:
                    yield from self._flush(waiting)
                    waiting, n = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[int]]]:
        if len(self.words) > KEPT_WORDS:
            self.words = {}
        if len(self.follows) > 2 * KEPT_WORDS:
            self.follows = {}
        if len(self.states) > KEPT_WORDS:  # more than any vocabulary of usual size has
            self.states = {}
            self.start = self.state(b"")
        for token, number in self.added.items():
            self.words[token] = (number,)
        new: set[str] = set()
        for _, words in waiting:
            new.update(words)
        collects = gc.isenabled()
        gc.disable()  # tries have no cycles; looking for them takes longer than the walk
        try:
            self.learn(new.difference(self.words))
        finally:
            if collects:
                gc.enable()
        get = self.words.__getitem__
        for i, words in waiting:
            yield i, list(chain.from_iterable(map(get, words)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.encode_pieces([text])))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    """The vocabulary of a file's content, made once per worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def content(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str | None = None, into: str = "ids") -> DataFrame:
    """All rows and columns of ``docs``, and ``into``: array<int>, the token ids of the whole ``text``.

    Null and empty texts have no ids. Equal texts have equal ids. Strings of added tokens in a text
    become those tokens. The vocabulary file is read on the driver and sent to the tasks.
    """
    ship(docs.sparkSession)
    source = content(path)

    @F.pandas_udf("array<int>")
    def ids_of(text: pd.Series) -> pd.Series:
        out: list[list[np.ndarray]] = [[] for _ in range(len(text))]
        for i, ids in loaded(source).encode_pieces([t or "" for t in text]):
            out[i].append(np.array(ids, np.int32))
        none = np.zeros(0, np.int32)
        return pd.Series([np.concatenate(o) if o else none for o in out], dtype=object)

    return docs.withColumn(into, ids_of(F.col("text")))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded"):
    """All rows and columns, and ``into``: the text of the token ids; no ids (or null) give an empty text."""
    ship(rows.sparkSession)
    source = content(path)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        vocabulary = loaded(source)
        return pd.Series([vocabulary.decode([] if x is None else x) for x in ids], dtype=object)

    return rows.withColumn(into, text_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, without sending ids out of the task."""
    ship(docs.sparkSession)
    source = content(path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(text: pd.Series) -> pd.DataFrame:
        vocabulary = loaded(source)
        new = codecs.getincrementaldecoder("utf-8")
        states = [[0, hashlib.sha256(), hashlib.sha256(), new("replace")] for _ in range(len(text))]
        for i, ids in vocabulary.encode_pieces([t or "" for t in text]):
            state = states[i]
            state[1].update(
                ("," * bool(state[0]) + ",".join(map(vocabulary.decimal.__getitem__, ids))).encode()
            )
            raw = b"".join(map(vocabulary.bytes.__getitem__, ids))
            state[2].update(state[3].decode(raw).encode())
            state[0] += len(ids)
        for state in states:
            state[2].update(state[3].decode(b"", True).encode())
        return pd.DataFrame(
            [(n, a.hexdigest(), b.hexdigest()) for n, a, b, _ in states],
            columns=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return rows.select("doc_id", "digest.*")


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pipeline stage: ``docs`` with columns ``ids`` and ``n_tokens`` (renamed if ``docs`` has such)."""
    ids, n = free_name(docs, "ids"), free_name(docs, "n_tokens")
    return encode(docs, path, ids).withColumn(n, F.size(ids).cast("long"))
