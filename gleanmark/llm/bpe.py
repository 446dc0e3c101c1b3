"""Byte-level BPE encoding and decoding with a public vocabulary file.

Text is split by the vocabulary's word pattern. The symbols of a word form a doubly linked list; a priority queue
holds the merge ranks of neighbouring pairs, the lowest rank and leftmost place first. Entries whose pair has changed
since are skipped when they come up. Words met before come from a table of bounded size. Decoding concatenates the
vocabulary strings and maps them back to bytes.

Null texts have no ids and decode to the empty text, like empty ones. Special tokens written out in a text get their
own id, as in the public library. Repeated rows are coded each for itself.
"""
from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanmark.llm.frames import free_name

#: Fixed value: the pattern of byte-level vocabularies of this kind, with white space as Unicode defines it.
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
KNOWN_WORDS = 400_000


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes: printable latin ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in plain]
    return letters | {chr(0x100 + i): b for i, b in enumerate(others)}


class _Known(dict):
    """Ids of words met before; emptied when it holds ``KNOWN_WORDS``."""

    def __init__(self, coder: Coder) -> None:
        self.coder = coder

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = ids = tuple(self.coder.merge([self.coder.byte_id[b] for b in word.encode()]))
        return ids


class Coder:
    """Vocabulary and merges of one file (its JSON text)."""

    def __init__(self, spec: str) -> None:
        read = json.loads(spec)
        vocab = read["model"]["vocab"]
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.merges = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.words = regex.compile(WORD)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known = _Known(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the symbols of one word, always the pair with the lowest rank, the leftmost of equals."""
        n, merges = len(ids), self.merges
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _rank, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                found = merges.get((merged, ids[j]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, ids[j], found[1]))
            j = before[i]
            if j >= 0:
                found = merges.get((ids[j], merged))
                if found:
                    heapq.heappush(queue, (found[0], j, ids[j], merged, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        if self.special and any(s in text for s in self.special):
            out = []
            for part in self.specials.split(text):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.words.findall(text))))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")


_coders: dict[str, Coder] = {}


def coder(spec: str) -> Coder:
    """One coder per process and file."""
    if spec not in _coders:
        _coders.clear()
        _coders[spec] = Coder(spec)
    return _coders[spec]


def read_spec(path: str) -> str:
    """The vocabulary file, read once on the driver; it has a fixed size and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def coded(spark: SparkSession, path: str):
    """Column function of a text: struct of ``ids`` and of ``decoded``, the text that these ids give back."""
    spec = spark.sparkContext.broadcast(read_spec(path))

    @arrow_udf("struct<ids:array<int>,decoded:string>")
    def bpe_coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(spec.value)
        for column in columns:
            ids, decoded = [], []
            for text in column:
                found = c.encode(text.as_py() or "")
                ids.append(np.array(found, np.int32))
                decoded.append(c.decode(found))
            yield pa.StructArray.from_arrays([_lists(ids), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return bpe_coded


def encoder(spark: SparkSession, path: str):
    """Column function: text to array of ids."""
    spec = spark.sparkContext.broadcast(read_spec(path))

    @arrow_udf("array<int>")
    def bpe_ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(spec.value)
        for column in columns:
            yield _lists([np.array(c.encode(text.as_py() or ""), np.int32) for text in column])

    return bpe_ids


def decoder(spark: SparkSession, path: str):
    """Column function: array of ids to text; null is the empty text."""
    spec = spark.sparkContext.broadcast(read_spec(path))

    @arrow_udf("string")
    def bpe_text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(spec.value)
        for column in columns:
            yield pa.array([c.decode(ids.as_py() or ()) for ids in column], pa.string())

    return bpe_text


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def with_codes(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more struct column (its name is returned) of ids and decoded text."""
    name = free_name(docs, "bpe")
    return docs.withColumn(name, coded(docs.sparkSession, path)(text)), name
