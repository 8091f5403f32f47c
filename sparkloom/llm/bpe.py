"""Byte-level BPE as a streaming transducer, and its decoder.

Encoding reads pieces of text and emits tokens once they are stable. Two things bound what must be
held back. Between pretokens: the pattern looks at most two pretokens ahead, so all but the last
three of a piece are final. Inside a pretoken: the tokens of a prefix are fixed by its last token
(two tokens may stand side by side if and only if merging their bytes gives the same two again), so
each prefix has one predecessor, at most the longest token before it. The merge list's sufficient
lookahead says how many bytes more can still move a boundary (see :func:`sufficient_lookahead`).
Whenever so many bytes are held, the chains of all prefixes that may still go on are followed back
to where they have met; what lies before is final and is emitted.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters that are read at once, and bytes of a pretoken above which its ids aren't remembered.
PIECE, LONG = 1 << 16, 192
#: Pretokens whose ids are remembered, in each of two generations.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple]) -> int:
    """Bytes (or letters) after a boundary that can have a say in it, from the merges in the order of their ranks.

    That u and v merge can only be prevented from the right by a merge of lower rank: of v with what
    follows it, or, before v is whole, of the right part of v. Each of these can in turn be prevented
    from its right by one of still lower rank only. So the longest such chain of falling ranks, in
    letters, is a bound; one pass over the merges finds it.
    """
    reach: dict = {}  # by left side: the longest chain of the merges so far that begin with it
    inside: dict = {}  # by result: the longest chain beyond its end that can keep it from forming
    longest = 0
    for u, v in merges:
        chain = len(v) + max(reach.get(v, 0), inside.get(v, 0))
        inside[u + v] = max(inside.get(u + v, 0), reach.get(v, 0), inside.get(v, 0))
        reach[u] = max(reach.get(u, 0), chain)
        longest = max(longest, chain)
    return longest


class Bpe:
    """A vocabulary with merges over the letters of byte strings (or over bytes); what is exact about it.

    ids: spelling to id; first: the smallest spellings (one byte, with the word end where there is one).
    """

    def __init__(self, ids: dict, merges: list[tuple]):
        self.ids = ids
        self.spelling = {i: t for t, i in ids.items()}
        self.rank: dict = {}
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), rank)
        self.longest = max(map(len, ids))
        self.lookahead = max(self.longest, sufficient_lookahead(merges))
        #: Each beginning of a spelling, with the id if it is one itself, else -1.
        self.prefix: dict = {t[:i]: -1 for t in ids for i in range(1, len(t))} | ids
        self.fits: dict[tuple[int, int], bool] = {}

    def first(self, data) -> list:
        return [data[i : i + 1] for i in range(len(data))]

    def merged(self, data) -> list[int]:
        """The ids by definition: the least-ranked pair merges first, the leftmost among equals."""
        parts, get, none = self.first(data), self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def side_by_side(self, a: int | None, b: int) -> bool:
        """Whether token b can follow a (None: begin a pretoken)."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            left = b"" if isinstance(self.spelling[b], bytes) else ""
            left = left if a is None else self.spelling[a]
            known = self.fits[a, b] = self.merged(left + self.spelling[b]) == ([b] if a is None else [a, b])
        return known

    def tokens(self, data) -> list[int]:
        """The ids of a whole short pretoken: what the transducer emits at its end, found by the longest tokens first, with a way back.

        A sequence of tokens is the one that merging gives if and only if each two neighbours are.
        """
        found = self.ids.get(data)
        if found is not None and self.side_by_side(None, found):
            return [found]
        fits, prefix, n = self.fits, self.prefix, len(data)
        out: list[int] = []
        ends: list[int] = []
        waiting: list[list[tuple[int, int]]] = []
        dead: set[int] = set()
        pos, last = 0, None
        while pos < n:
            begun = []
            for stop in range(pos + 1, n + 1):
                t = prefix.get(data[pos:stop])
                if t is None:
                    break
                if t >= 0:
                    begun.append((t, stop))
            while True:
                while begun:
                    t, stop = begun.pop()
                    known = fits.get((last, t))
                    if (self.side_by_side(last, t) if known is None else known) and stop not in dead:
                        break
                else:
                    dead.add(pos)
                    ends.pop()
                    out.pop()
                    pos, last, begun = (ends[-1] if ends else 0), (out[-1] if out else None), waiting.pop()
                    continue
                break
            waiting.append(begun)
            out.append(t)
            ends.append(stop)
            pos, last = stop, t
        return out


class Remembered(dict):
    """A memory of results in two generations of bounded size; `compute` makes what is in neither."""

    def __init__(self, compute, most: int = REMEMBERED):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBpe(Bpe):
    """Byte-level BPE of a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in self.special:
            ids.pop(t.encode(), None)
        merges = (pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"])
        super().__init__(ids, [tuple(bytes(letters[c] for c in x) for x in pair) for pair in merges])
        self.token: dict[int, bytes] = self.spelling | {i: t.encode() for t, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remembered = Remembered(self.packed)

    def packed(self, pretoken: str) -> bytes:
        return array("I", self.tokens(pretoken.encode())).tobytes()

    def streamed(self, data: Iterable[int]) -> Iterator[list[int]]:
        """Ids of a pretoken of any length, emitted as they become stable; what is held is about twice the lookahead."""
        window = bytearray()
        last: list[int] = []  # the last token of the prefix that ends after each byte of the window
        longest, ids, wait = self.longest, self.ids, 2 * self.lookahead

        def back(stop: int, start: int) -> list[int]:
            out = []
            while stop > start:
                out.append(last[stop - 1])
                stop -= len(self.token[last[stop - 1]])
            return out[::-1]

        before = None  # the last token that was emitted
        for byte in data:
            window.append(byte)
            n = len(window)
            for size in range(min(longest, n), 0, -1):
                t = ids.get(bytes(window[n - size :]))
                if t is None:
                    continue
                left = before if size == n else last[n - size - 1]
                if self.side_by_side(left, t):
                    last.append(t)
                    break
            if n >= wait:
                live = set(range(max(1, n - longest), n + 1))
                while len(live) > 1 and max(live) > 0:
                    at = max(live)
                    live.remove(at)
                    live.add(at - len(self.token[last[at - 1]]))
                meet = max(live)
                if meet > 0:
                    stable = back(meet, 0)
                    yield stable
                    before = stable[-1]
                    del window[:meet], last[:meet]
                wait = len(window) + self.lookahead
        if window:
            yield back(len(window), 0)

    def pretokens(self, pieces: Iterable[str]) -> Iterator[list[str]]:
        held, parts, size, least = "", [], 0, 0
        for piece in pieces:
            parts.append(piece)
            size += len(piece)
            if size < least:
                continue
            held, parts = "".join(parts), []
            found = self.find(held)
            if len(found) > 3:
                tail = sum(map(len, found[-3:]))
                yield found[:-3]
                held = held[len(held) - tail :]
            # A run that goes on through all of this is read again only when it has doubled.
            parts, size = [held], len(held)
            least = 2 * size
        yield self.find("".join(parts))

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of the text, piece by piece."""
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                pieces = [part] if len(part) <= PIECE else (part[i : i + PIECE] for i in range(0, len(part), PIECE))
                for found in self.pretokens(pieces):
                    if max(map(len, found), default=0) <= LONG:
                        yield b"".join(map(self.remembered.__getitem__, found))
                        continue
                    for pretoken in found:
                        if len(pretoken) <= LONG:
                            yield self.remembered[pretoken]
                        else:
                            yield from (array("I", x).tobytes() for x in self.streamed(pretoken.encode()))

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids; a state machine holds the bytes of an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.token.__getitem__
        for part in ids:
            yield machine.decode(b"".join(map(get, array("I", part))))
        yield machine.decode(b"", True)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as packed little-endian 32-bit integers (binary).

    One row for each row of docs; a null text counts as empty. Strings of special tokens in a text
    become the special token, as the library does it. A very long text is read in pieces, a very long
    run without boundary through the transducer. Equal rows are encoded each. An empty table gives an
    empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids = [b"".join(bpe.encode(text)) if text else b"" for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to what encode() gives; a null ids counts as empty."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = ["".join(bpe.decode([x[i : i + 4 * PIECE] for i in range(0, len(x), 4 * PIECE)])) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode each text piece by piece.

    Neither ids nor text of a whole document are held: each piece is hashed, decoded and dropped.
    Rows as in :func:`encode`.
    """
    small_batches(docs.sparkSession)

    def digest(bpe: ByteBpe, text: str | None) -> tuple[int, str, str]:
        ids, decoded, count = hashlib.sha256(), hashlib.sha256(), 0

        def watched():
            nonlocal count
            for part in bpe.encode(text or ""):
                count += len(part) // 4
                ids.update(part)
                yield part

        for part in bpe.decode(watched()):
            decoded.update(part.encode())
        return count, ids.hexdigest(), decoded.hexdigest()

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            rows = [digest(bpe, text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
