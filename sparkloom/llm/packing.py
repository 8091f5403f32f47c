"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import byte_letters
from sparkloom.llm.common import small_batches

#: Words and parts that are remembered.
REMEMBERED = 200_000
#: Tokens that are packed together, which bounds memory.
TOGETHER = 1 << 20
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class WordIds:
    """Packed 32-bit ids of white-space words; the tokenizer treats each word by itself.

    Words not met before are cut into the parts that the tokenizer's own pattern gives, and parts
    not met before go to the library's model. Two generations of bounded size are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.find = regex.compile(PARTS).findall
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """The ids of a part; its letters are those of its bytes."""
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() and part.isprintable() else "".join(map(self.letter.__getitem__, part.encode()))
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found

    def word(self, data: bytes) -> bytes:
        """The ids of a word. Case of ASCII letters doesn't matter, and a comma or stop after one is a part of its own."""
        plain = data.lower()
        tail = plain[-1:]
        if (tail == b"," or tail == b".") and plain[-2:-1].isalpha():
            return self.ids(plain[:-1]) + self.part(tail.decode())
        if plain != data:
            return self.ids(plain)
        word = plain.decode()
        if "<|" in word or not (word.isascii() or max(word) < "\u0250"):  # may hold special tokens, or letters beyond Latin
            return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        if word.isalpha() and word.isascii():
            return self.part(word)
        return b"".join(map(self.part, self.find(unicodedata.normalize("NFC", word).lower())))

    def ids(self, word: bytes) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.word(word)
            self.known[word] = found
        return found

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Packed ids of each text."""
        for text in texts:
            words = text.split() if text else []
            if len(self.known) > REMEMBERED:
                self.old, self.known = self.known, {}
            if len(self.parts) > REMEMBERED:
                self.parts = {}
            found = list(map(self.known.get, words))
            if None in found:
                found = [self.ids(w) if x is None else x for w, x in zip(words, found, strict=True)]
            yield b"".join(found)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def assign(lengths: list[int], room: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """(sequences, rest): pieces (document, start, length) for full sequences of `room` tokens, and what is left over.

    Whole multiples of `room` fill sequences of their own. The remainders go by descending cost
    linear * n + quadratic * n * n, each to the sequence of the lowest cost so far that has room;
    there are as many sequences as the remainders fill. What finds no room is cut to fill the gaps,
    lowest cost first, so that each sequence is exactly full; under `room` tokens are left over.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    parts: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        full = n // room * room
        sequences += [[(i, at, room)] for at in range(0, full, room)]
        if n > full:
            parts.append((i, full, n - full))
    parts.sort(key=lambda p: (-p[2], p[0]))
    open_: list[list[tuple[int, int, int]]] = [[] for _ in range(sum(p[2] for p in parts) // room)]
    left = [room] * len(open_)
    heap = [(0.0, s) for s in range(len(open_))]
    over: list[tuple[int, int, int]] = []
    # Sequences too full for the part at hand wait by their room; parts get no longer, so each returns once they are short enough.
    full_ones: list[tuple[int, float, int]] = []
    for part in parts:
        while full_ones and -full_ones[0][0] >= part[2]:
            heapq.heappush(heap, heapq.heappop(full_ones)[1:])
        while heap and left[heap[0][1]] < part[2]:
            cost, s = heapq.heappop(heap)
            heapq.heappush(full_ones, (-left[s], cost, s))
        if heap:
            cost, s = heapq.heappop(heap)
            open_[s].append(part)
            left[s] -= part[2]
            if left[s]:
                heapq.heappush(heap, (cost + linear * part[2] + quadratic * part[2] ** 2, s))
        else:
            over.append(part)
    over.reverse()
    for _, s in sorted(heap + [x[1:] for x in full_ones]):
        while left[s]:
            i, at, n = over.pop()
            take = min(n, left[s])
            open_[s].append((i, at, take))
            left[s] -= take
            if n > take:
                over.append((i, at + take, n - take))
    return sequences + open_, over


def powers(n: int) -> Iterator[int]:
    """n as a sum of powers of two, the largest first."""
    while n:
        top = 1 << (n.bit_length() - 1)
        yield top
        n -= top


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, room: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each partition packs its own documents, so there is no shuffle; it does so for about a million
    tokens at a time and passes what is left over on. All sequences are exactly full but those of a
    partition's last tokens (fewer than `room`), which are cut into sequences of 2^k tokens; these
    need no padding either. sequence_id has the partition in its upper bits.

    Null and empty texts are the end id alone. An empty table gives an empty result; rows that repeat
    a doc_id are packed each; of documents of one length the one that is read first comes first. A
    very long text is encoded whole, with memory in proportion to its tokens, and cut into sequences.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = word_ids(path)
        base = TaskContext.get().partitionId() << 32
        made = 0
        held: list[tuple[int | None, int, int, bytes]] = []  # doc_id, tokens of the document, start of the rest, ids of the rest

        def rows(sequences):
            nonlocal made
            out = []
            for pieces in sequences:
                offset = 0
                for i, at, n in pieces:
                    doc, total, start, ids = held[i]
                    piece = ids[4 * at : 4 * (at + n)]
                    out.append((doc, start + at, n, zlib.crc32(piece), total, base + made, offset, piece))
                    offset += n
                made += 1
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(7)), pa.array([r[7] for r in out], pa.binary())], [*NAMES, "ids"])

        size, end = 0, end_id.to_bytes(4, "little")
        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = coded + end
                held.append((doc, len(ids) // 4, 0, ids))
                size += len(ids) // 4
                if size >= TOGETHER:
                    sequences, over = assign([len(x[3]) // 4 for x in held], room)
                    yield rows(sequences)
                    held = [(d, total, start + at, ids[4 * at : 4 * (at + n)]) for (d, total, start, ids), at, n in ((held[i], at, n) for i, at, n in over)]
                    size = sum(len(x[3]) // 4 for x in held)
        sequences, over = assign([len(x[3]) // 4 for x in held], room)
        over.reverse()
        for power in powers(sum(p[2] for p in over)):
            sequence = []
            while power:
                i, at, n = over.pop()
                take = min(n, power)
                sequence.append((i, at, take))
                power -= take
                if n > take:
                    over.append((i, at + take, n - take))
            sequences.append(sequence)
        yield rows(sequences)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, ", ".join(f"{n} long" for n in NAMES) + ", ids binary"
    )
