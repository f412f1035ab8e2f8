"""Token counts by heap-and-linked-list byte-pair merging.

Each merge shortens a piece by one symbol, so a piece has as many tokens as bytes minus
merges, and no identifier is ever made.  A text is cut where the vocabulary's own rule always
cuts it (special strings, then between two words parted by one blank), each such stretch is
cut by the vocabulary's pattern, and the pieces are merged once and remembered: the memory of
a worker is bounded, and its content never changes a count.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import arrow_column, broadcast_bytes, held

#: How byte-level vocabularies of this family cut a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches, and pieces, whose counts a worker remembers; others are counted each time.
REMEMBERED = 400_000
#: Longer stretches are counted each time and not remembered.
LONGEST_REMEMBERED = 64

# a blank between two characters that are no white space: every such place is a cut
_PLAIN_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Counter(dict):
    """Tokens by stretch of text; a missing one is cut and merged."""

    def __init__(self, model: bytes) -> None:
        spec = json.loads(model)
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level byte-pair vocabulary without normaliser is needed")
        # symbols are numbered: bytes first, then whatever merging makes
        number = {c: i for i, c in enumerate(byte_letters())}
        self.rank: dict[int, int] = {}
        self.first, self.second, self.made = [], [], []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = (number.setdefault(s, len(number)) for s in (a, b))
            self.rank[x << 32 | y] = rank
            self.first.append(x)
            self.second.append(y)
            self.made.append(number.setdefault(a + b, len(number)))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        special.sort(key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, int] = {}

    def __missing__(self, stretch: str) -> int:
        n, known = 0, self.pieces
        for piece in self.pattern.findall(stretch):
            k = known.get(piece)
            if k is None:
                k = self.merge(piece.encode())
                if len(piece) <= LONGEST_REMEMBERED and len(known) < REMEMBERED:
                    known[piece] = k
            n += k
        if len(stretch) <= LONGEST_REMEMBERED and len(self) < REMEMBERED:
            self[stretch] = n
        return n

    def merge(self, data: bytes) -> int:
        """Initial symbols minus merges: pop the lowest-ranked pair, leftmost first."""
        n = len(data)
        if n < 2:
            return n
        rank, symbol = self.rank.get, list(data)
        heap = []  # rank and place in one number
        for i in range(n - 1):
            r = rank(symbol[i] << 32 | symbol[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            r, i = divmod(pop(heap), 1 << 32)
            j = after[i]
            if j >= n or symbol[i] != self.first[r] or symbol[j] != self.second[r]:
                continue  # one of the two has been merged since
            made = symbol[i] = self.made[r]
            symbol[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank(made << 32 | symbol[k])
                if r is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank(symbol[h] << 32 | made)
                if r is not None:
                    push(heap, r << 32 | h)
        return left

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) // 2 + sum(map(self.plain, parts[::2]))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        first, *rest = _PLAIN_BLANK.split(text)
        return self[first] + sum([self[" " + w] for w in rest])


def counter(model: bytes) -> Counter:
    return held("counter", model, Counter)


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of ``text`` under the byte-level vocabulary (``.json``) at ``path``.

    Null and empty texts have 0.  Special strings inside a text count as one token each, no
    token is added, nothing is cut off.  The vocabulary is read by the driver and broadcast
    (its size is checked).
    """
    with open(path, "rb") as f:
        shared = broadcast_bytes(spark, f.read())

    def count(texts: pa.Array) -> pa.Array:
        own = counter(shared.value)
        return pa.array([own.count(x.as_py() or "") for x in texts], pa.int64())

    return F.coalesce(arrow_column(count, "long", text), F.lit(0))
