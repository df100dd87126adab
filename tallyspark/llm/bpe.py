"""Byte-pair encoding of whole texts with a published word-end vocabulary, and decoding.

Each task encodes the distinct words it meets. Sorted words are the depth-first order of their trie, so
the state of every prefix (the last token of its encoding) is kept on a stack that is cut back to what
two neighbours share: a shared prefix is encoded once. A prefix's last token is the one vocabulary entry
that ends there and may follow the last token of what is left of it; which tokens may follow one another
is decided by the merge ranks once per pair. No shuffle, no table that grows with the corpus: a task
forgets its words when they pass WORDS_KEPT and goes on.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import chunks

WORDS_KEPT = 300_000
PAIRS_KEPT = 1_000_000
CHUNK = 4 << 20
END = "</w>"


def _byte_letters() -> str:
    """The printable stand-in of each byte: visible bytes are themselves, the others follow from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in seen else chr(256 + extra))
        extra += b not in seen
    return "".join(out)


_LETTERS = {i: c for i, c in enumerate(_byte_letters())}


class WordEncoder:
    """Encodes words by last-token states along a trie; ids are those of the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(pair): i for i, pair in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        # Fixed value: the vocabulary's own word pattern, with white space by its Unicode property.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        # The same pattern for texts below U+0250, with the classes spelled out for the quicker matcher.
        low = [chr(i) for i in range(0x250)]
        word, digit, blank = ("".join(map(re.escape, (c for c in low if regex.fullmatch(p, c)))) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self.low_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{word}]+|[{digit}]|[^{blank}{word}{digit}]+")
        self.beyond = re.compile("[^\x00-\u024f]")
        self.may_follow: dict[int, bool] = {}
        self.inner, self.final = self.whole_tokens()
        self.inner_lengths, self.final_lengths = self.lengths(self.inner), self.lengths(self.final)
        self.known: dict[str, tuple[int, ...]] = {}

    def merged(self, symbols: list[str], stop: int = 1) -> list[str]:
        while len(symbols) > stop:
            best = min((self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if best[0] == len(self.rank):
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return [*token]

    def whole_tokens(self) -> tuple[dict[str, int], dict[str, int]]:
        """Vocabulary entries that the merges can produce: inner ones, and word-ending ones without the mark.

        ``made`` has the rank of the merge that completes a token (-1: a single symbol), ``halves`` its parts.
        """
        inner, final, ids = {}, {}, self.ids
        self.made, self.halves = [-1] * (max(ids.values()) + 1), [(-1, -1)] * (max(ids.values()) + 1)
        for token, i in ids.items():
            symbols = self.merged(self.symbols(token), stop=2)
            if len(symbols) == 2 and tuple(symbols) in self.rank:
                self.made[i] = self.rank[tuple(symbols)]
                self.halves[i] = ids[symbols[0]], ids[symbols[1]]
            elif len(symbols) > 1:
                continue
            if token.endswith(END) and len(token) > len(END):
                final[token[: -len(END)]] = i
            else:
                inner[token] = i
        self.joins = {ids[a] << 17 | ids[b]: k for (a, b), k in self.rank.items()}
        return inner, final

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they stand side by side.

        The merges on both sides of the border are undone from the last one; the pieces at the border must
        never have had an earlier chance to merge with each other. Of equal merges the left one goes first.
        """
        if len(self.may_follow) >= PAIRS_KEPT:
            self.may_follow.clear()
        key, limit, made, halves, joins = left << 17 | right, len(self.rank), self.made, self.halves, self.joins
        known = True
        while True:
            k = joins.get(left << 17 | right)
            if k is not None and k < limit:
                known = False
                break
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                break
            if a > b:
                limit, left = a, halves[left][1]
            else:
                limit, right = b + 1, halves[right][0]
        self.may_follow[key] = known
        return known

    @staticmethod
    def lengths(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """The lengths, longest first, that a token with these last three letters can have."""
        out: dict[str, set[int]] = {}
        for token in tokens:
            if len(token) > 3:
                out.setdefault(token[-3:], {1, 2, 3}).add(len(token))
        return {tail: tuple(sorted(found, reverse=True)) for tail, found in out.items()}

    def learn(self, words: set[str]) -> None:
        """Encode distinct words in trie order; ``known`` gets their ids.

        ``states[i]`` is the last token of the encoding of the path's first i letters and ``starts[i]`` where it begins.
        """
        known, pairs, follows = self.known, self.may_follow, self.follows
        inner, inner_lengths, final, final_lengths = self.inner.get, self.inner_lengths.get, self.final.get, self.final_lengths.get
        path, states, starts = "", [-1], [0]
        for letters, word in sorted((w.encode("utf-8").decode("latin-1").translate(_LETTERS), w) for w in words):
            end = len(letters)
            shared, most = 0, min(len(path), end - 1)
            while shared < most and path[shared] == letters[shared]:
                shared += 1
            del states[shared + 1 :], starts[shared + 1 :]
            tokens, lengths = inner, inner_lengths
            for stop in range(shared + 1, end + 1):
                if stop == end:
                    tokens, lengths = final, final_lengths
                for n in lengths(letters[stop - 3 : stop], (3, 2, 1)) if stop > 3 else (3, 2, 1)[3 - stop :]:
                    if n > stop:
                        continue
                    start = stop - n
                    token = tokens(letters[start:stop])
                    if token is not None:
                        if start == 0:
                            break
                        key = states[start] << 17 | token
                        fits = pairs.get(key)
                        if fits is None:
                            fits = follows(states[start], token)
                        if fits:
                            break
                states.append(token)
                starts.append(start)
            out, at = [states.pop()], starts.pop()
            path = letters[:-1]
            while at:
                out.append(states[at])
                at = starts[at]
            known[word] = tuple(out[::-1])

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        """The words of a text in order; special strings stay as they are."""
        if "<|" not in text or not self.cut.search(text):
            text = self.normal(text)
            return self.words.findall(text) if self.beyond.search(text) else self.low_words.findall(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += self.words.findall(self.normal(text[at : found.start()]))
            out.append(found.group())
            at = found.end()
        return out + self.words.findall(self.normal(text[at:]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        parts = [self.split(t) for t in texts]
        fresh = set(chain.from_iterable(parts))
        special = fresh & self.special.keys()
        fresh -= special
        missing = fresh.difference(self.known)
        if len(self.known) + len(missing) > WORDS_KEPT:
            self.known.clear()
            missing = fresh
        self.learn(missing)
        table = self.known | {s: (self.special[s],) for s in special} if special else self.known
        flat, ends = array("i"), []
        for words in parts:
            flat.extend(chain.from_iterable(map(table.__getitem__, words)))
            ends.append(len(flat))
        return np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, dtype=np.int32), np.array(ends, dtype=np.int32)

    def decode(self, ids) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text; null or empty texts have an empty list.

    ``vocabulary`` is a path that every executor can open (a file installed with the package set).
    Repeated rows give a row each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            sizes = [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(sizes, CHUNK):
                flat, ends = encoder.encode([v.decode("utf-8", "replace") for v in sizes[lo:hi]])
                offsets = pa.array(np.append(np.int32(0), ends))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(id, ids, decoded): what the vocabulary's own decoding makes of the ids: token names joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        names = np.array([encoder.names.get(i, "") for i in range(max(encoder.names) + 1)], dtype=object)
        for batch in batches:
            lists = batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                part = [" ".join(names[v.values.to_numpy()]) if v.is_valid else "" for v in lists.slice(lo, 256)]
                n = len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), lists.slice(lo, n), pa.array(part, pa.string())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, decoded string")
