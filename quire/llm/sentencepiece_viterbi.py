"""SentencePiece encoding and decoding by a streaming Viterbi search.

Characters come in one after the other.  At every place the search keeps the best last piece of
the text so far (the backpointer), looking back no further than the longest piece.  All later
pieces start inside that window, so wherever all backpointer paths from the window meet, what
lies before is final: its ids are given out and forgotten.

What makes a path best depends on the model.  For a unigram model it is the largest sum of
scores.  For a byte-pair model a path must be what merging would make of it.  Merging gives
``[..., a, b]`` only if it gives ``[a, b]`` for the two alone, and a chain all of whose
neighbours pass is the merged text (the first merge across a border would also happen in the
two pieces around it).  So exactly one last piece per place passes the test with its
predecessor, and the search finds the ids that the library gives.

``Search`` does this for one text of any length and either kind of model.  ``Lanes`` does it for
the texts of a batch at once, for byte-pair models: texts are cut into lanes at blank marks, where
all paths meet because no piece has the mark after another character, and the lanes take a
character each per step, on arrays.  A lane keeps a ring of backpointers a little longer than the
window; one whose paths do not meet inside the ring is searched by ``Search``.  Nothing is
remembered from one text to the next but which pieces may follow each other, in a table of fixed size.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession

from quire.llm.common import arrow_column, broadcast_bytes, held

#: The mark that stands for a blank (fixed value).
MARK = "▁"
#: Answers to "may this piece follow that one" that a model remembers, a power of two.
PAIRS = 1 << 21
#: Rows that are decoded in one go.
ROWS = 256
#: Characters between two looks for a place where all paths meet.
STEP = 32
#: Backpointers that a lane keeps, a power of two.
RING = 128
#: Characters after which a lane is cut at the next mark; lanes that are longer than LONG all the
#: same are cut between neighbours that no piece has inside, else searched alone.
LANE, LONG = 128, 4096
#: Lanes that go in step, and characters that are made into lanes at once.
WIDTH, SLICE = 1 << 14, 1 << 20

_BORDER = re.compile(f"(?<!{MARK}){MARK}")


class Pieces:
    """Pieces of a model and the test or score that ranks paths.

    ``pieces`` are (surface, score), in the order of their ids in ``ids``; ``merging`` tells a
    byte-pair model from a unigram one.  A character that no piece has is a piece of its own,
    with id -1.
    """

    def __init__(self, pieces: list[tuple[str, float]], ids: list[int], merging: bool) -> None:
        self.merging = merging
        self.score = {s: x for s, x in pieces}
        self.unknown = min((x for _, x in pieces), default=0.0) - 10.0
        self.longest = max((len(s) for s, _ in pieces), default=1)
        self.pair: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.empty = True
        self.ids: dict[str, int] = {}  # of the pieces that are on some path
        for (s, x), i in zip(pieces, ids, strict=True):
            # a piece that merging would not make of its own characters is on no path
            if not merging or self.merged(s) == [s]:
                self.automaton.add_word(s, (i, len(s), s, x))
                self.ids[s] = i
                self.empty = False
        if not self.empty:
            self.automaton.make_automaton()

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """A short text merged: the best-scored neighbours first, the leftmost of equals; no
        further than to so many parts."""
        parts, score = list(text), self.score
        while len(parts) > down_to:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follow(self, a: tuple, b: tuple) -> bool:
        """Whether merging leaves the border between the two pieces."""
        if len(self.pair) >= PAIRS >> 5:
            self.pair.clear()
        known = self.merged(a[2] + b[2]) == [a[2], b[2]]
        if a[0] >= 0:
            self.pair[a[0] << 24 | b[0]] = known
        return known


class Search:
    """The search over one text, fed in parts of any length.

    ``last[i]`` is the best last piece of the text up to ``base + i``: id, length, surface and
    score.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.base = 0  # everything before is final
        self.text = ""  # characters from there on
        self.last: list[tuple | None] = [None]
        self.total: list[float] = [0.0]

    def feed(self, part: str) -> Iterator[tuple]:
        """Pieces that are final now."""
        for at in range(0, len(part), STEP):
            self.extend(part[at : at + STEP])
            yield from self.settled()

    def finish(self) -> list[tuple]:
        """The pieces that are left."""
        return self.path(len(self.text))

    def extend(self, part: str) -> None:
        known = len(self.text)
        self.text += part
        self.last += [None] * len(part)
        seen = max(0, known - self.pieces.longest + 1)
        found = () if self.pieces.empty else self.pieces.automaton.iter(self.text[seen:] if seen else self.text)
        if self.pieces.merging:
            self._chain(found, seen, known)
        else:
            self.total += [0.0] * len(part)
            self._weigh(found, seen, known)

    def _chain(self, found: Iterable, seen: int, known: int) -> None:
        """The one last piece that passes with its predecessor, for each place."""
        last, text, follow = self.last, self.text, self.pieces.follow
        passes, begun = self.pieces.pair.get, self.base == 0
        for end, piece in found:
            end += seen + 1
            if end <= known or last[end] is not None:
                continue
            start = end - piece[1]
            if start < 0:
                continue
            if start == 0 and begun:
                last[end] = piece
                continue
            before = last[start]
            if before is None:  # no piece ends there
                before = last[start] = (-1, 1, text[start - 1], 0.0)
            good = passes(before[0] << 24 | piece[0])
            if good or good is None and follow(before, piece):
                last[end] = piece
        for i in range(known + 1, len(last)):
            if last[i] is None:
                last[i] = (-1, 1, text[i - 1], 0.0)

    def _weigh(self, found: Iterable, seen: int, known: int) -> None:
        """The last piece of the path with the largest sum of scores, for each place."""
        last, total, text, unknown = self.last, self.total, self.text, self.pieces.unknown
        at = known + 1
        for end, piece in found:
            end += seen + 1
            if end <= known:
                continue
            while at < end:
                if last[at] is None:
                    last[at], total[at] = (-1, 1, text[at - 1], unknown), total[at - 1] + unknown
                at += 1
            start = end - piece[1]
            if start >= 0 and (last[end] is None or total[start] + piece[3] > total[end]):
                last[end], total[end] = piece, total[start] + piece[3]
        while at < len(last):
            if last[at] is None:
                last[at], total[at] = (-1, 1, text[at - 1], unknown), total[at - 1] + unknown
            at += 1

    def path(self, end: int) -> list[tuple]:
        out, last = [], self.last
        while end > 0:
            piece = last[end]
            out.append(piece)
            end -= piece[1]
        out.reverse()
        return out

    def settled(self) -> list[tuple]:
        """The pieces before the place where all paths from the window meet; they are forgotten."""
        n = len(self.text)
        ends = {i for i in range(max(0, n - self.pieces.longest + 1), n + 1)}
        while len(ends) > 1:  # the furthest path goes back one piece at a time
            end = max(ends)
            ends.discard(end)
            ends.add(end - self.last[end][1])
        meet = ends.pop()
        out = self.path(meet)
        if out:
            self.text, self.base = self.text[meet:], self.base + meet
            self.last = self.last[meet:]  # the first is the last final piece
            self.total = [x - self.total[meet] for x in self.total[meet:]]
        return out


class Lanes:
    """The search over many texts in step, for a byte-pair model.

    Pieces are numbered, characters that are no piece but in one after them; ``unknown`` is a
    character in no piece and ``start`` the beginning of a lane, which any piece may follow.
    """

    def __init__(self, pieces: Pieces, ids: dict[str, int]) -> None:
        inner = sorted({c for s in pieces.score for c in s} - set(ids))
        surfaces = [*ids, *inner]
        self.number = number = {s: i for i, s in enumerate(surfaces)}
        self.unknown, self.start = len(surfaces), len(surfaces) + 1
        self.ids = np.array([*ids.values(), *[-1] * (len(inner) + 2)], np.int32)
        self.size = np.array([*map(len, surfaces), 1, 0], np.int32)
        self.longest = int(self.size.max())
        self.count = np.int64(len(surfaces) + 2)
        self._merges(pieces, surfaces)
        self._tree(surfaces)
        self.known = np.full(PAIRS, -1, np.int64)  # twice the pair, plus one if it may be
        self.shift = np.uint64(64 - (PAIRS.bit_length() - 1))
        twos = {s[i : i + 2] for s in number for i in range(len(s) - 1)}
        self.twos = np.sort(np.array([self._two(ord(a), ord(b)) for a, b in twos], np.int64))

    def _two(self, a, b):
        return self.kind[a].astype(np.int64) << 32 | self.kind[b]

    def _merges(self, pieces: Pieces, surfaces: list[str]) -> None:
        """The rank of every piece, what its last merge joined, and the ranks of all joins."""
        ranked = sorted((s for s in pieces.score if len(s) > 1), key=lambda s: -pieces.score[s])
        rank = {s: i for i, s in enumerate(ranked)}
        self.rank = np.full(self.count, -1, np.int64)
        self.left, self.right = np.zeros(self.count, np.int64), np.zeros(self.count, np.int64)
        for i, s in enumerate(surfaces):
            if len(s) > 1:
                a, b = pieces.merged(s, 2)
                self.rank[i], self.left[i], self.right[i] = rank[s], self.number[a], self.number[b]
        joins = []
        for s, r in rank.items():
            for i in range(1, len(s)):
                a, b = self.number.get(s[:i]), self.number.get(s[i:])
                if a is not None and b is not None:
                    joins.append((a * int(self.count) + b, r))
        joins.sort()
        # pieces of one score are made from left to right, which ranks do not tell: pairs that have
        # two neighbours inside such a piece are merged
        times = Counter(pieces.score[s] for s in ranked)
        tied = {c for s in ranked if times[pieces.score[s]] > 1 for c in s}
        self.merge, self.surfaces = pieces.merged, surfaces
        self.first_tied, self.last_tied, self.two_tied = (np.zeros(self.count, bool) for _ in range(3))
        for i, s in enumerate(surfaces):
            self.first_tied[i], self.last_tied[i] = s[0] in tied, s[-1] in tied
            self.two_tied[i] = any(x in tied and y in tied for x, y in pairwise(s))
        self.join = np.array([j[0] for j in joins] or [-1], np.int64)
        self.join_rank = np.array([j[1] for j in joins] or [0], np.int64)

    def _tree(self, surfaces: list[str]) -> None:
        """The pieces as a tree: the child of ``node`` for a character of kind ``k`` is at
        ``base[node] + k`` if ``parent`` says so there."""
        often: dict[str, int] = {}
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        for i, s in enumerate(surfaces):
            at = 0
            for c in s:
                often[c] = often.get(c, 0) + 1
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = i
        kinds = {c: k for k, c in enumerate(sorted(often, key=lambda c: -often[c]), 1)}
        self.kind = np.zeros(0x110000, np.uint16 if len(kinds) < 1 << 16 else np.int32)  # 0: in no piece
        for c, k in kinds.items():
            self.kind[ord(c)] = k
        width = len(kinds) + 1
        room = len(children) + 2 * width + 16
        taken = bytearray(2 * room)
        taken[:2] = b"\1\1"
        place, base, parent, end = {0: 0}, np.zeros(2 * room, np.int32), np.full(2 * room, -1, np.int32), np.full(2 * room, -1, np.int32)
        free = 2
        todo = [0]
        for node in todo:
            below = sorted((kinds[c], child) for c, child in children[node].items())
            if node == 0:
                below.insert(0, (0, -1))
            if not below:
                continue
            first = below[0][0]
            slot = free = taken.index(0, free)
            while slot < first + 1 or any(taken[slot - first + k] for k, _ in below):
                slot = taken.index(0, slot + 1)
                if slot + width >= len(taken):
                    more = len(taken)
                    taken += bytearray(more)
                    base, parent, end = (np.concatenate([x, np.full(more, v, np.int32)]) for x, v in ((base, 0), (parent, -1), (end, -1)))
            at = place[node]
            base[at] = slot - first
            for k, child in below:
                taken[slot - first + k] = 1
                parent[slot - first + k] = at
                if child < 0:
                    end[slot - first + k] = self.unknown
                else:
                    place[child] = slot - first + k
                    end[slot - first + k] = ends[child]
                    todo.append(child)
        used = max((i for i, t in enumerate(taken) if t), default=0) + width + 1
        self.base, self.end = base[:used].copy(), end[:used].copy()
        self.parent = np.full(used + width, -1, np.int32)
        self.parent[: min(used, len(parent))] = parent[:used]

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between each two pieces."""
        pair = a.astype(np.int64) * self.count + b
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        found = self.known[slot]
        out = (found & 1).astype(bool)
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            answer = self.judged(asked // self.count, asked % self.count)
            out[new] = answer[back]
            self.known[slot[new]] = pair[new] << 1 | out[new]
        return out

    def judged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may`` worked out: the merges of the two pieces are taken back, the last one first, and
        at no time may the two parts at the border join before the merge that was taken back."""
        out = np.ones(len(a), bool)
        plain = (a < self.unknown) & (b < self.unknown)
        tied = plain & (self.two_tied[a] | self.two_tied[b] | (self.last_tied[a] & self.first_tied[b]))
        for i in np.flatnonzero(tied).tolist():
            two = [self.surfaces[a[i]], self.surfaces[b[i]]]
            out[i] = self.merge("".join(two)) == two
        todo = np.flatnonzero(plain & ~tied)
        a, b = a[todo], b[todo]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            pair = a * self.count + b
            at = np.minimum(np.searchsorted(self.join, pair), len(self.join) - 1)
            bad = (self.join[at] == pair) & (self.join_rank[at] < limit)
            out[todo[bad]] = False
            x, y = self.rank[a], self.rank[b]
            later = x > y
            go = ~bad & (later | (y >= 0))
            # of one piece twice the left one is made first, so a join of its rank comes before
            limit = np.where(later, x, y + 1)[go]
            a, b = np.where(later, self.right[a], a)[go], np.where(later, b, self.left[b])[go]
            todo = todo[go]
        return out

    def search(self, kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lane and number of all pieces, lane by lane, and the lanes whose paths do not meet.

        ``sizes`` fall.  ``last`` has the last piece up to each of the places held, one column a lane.
        """
        n, ring = len(starts), RING - 1
        last = np.full((RING, n), -1, np.int32)
        last[0] = self.start
        done = np.zeros(n, np.int64)  # what lies before is final
        apart = np.zeros(n, bool)
        lanes: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def commit(who: np.ndarray, ends: np.ndarray) -> None:
            back = []
            at, begun = ends.copy(), done[who]
            while len(who):
                go = at > begun
                who, at, begun = who[go], at[go], begun[go]
                piece = last[at & ring, who]
                back.append((who, piece))
                at = at - self.size[piece]
            lanes.extend(b[0] for b in reversed(back))
            numbers.extend(b[1] for b in reversed(back))

        for s in range(int(sizes[0])):
            alive = int(np.searchsorted(-sizes, -s, "left"))
            if s and s % STEP == 0:
                who = np.arange(alive)
                meet = self.meeting(last, done[:alive], s)
                commit(who, meet)
                done[:alive] = meet
                late = s + STEP + self.longest - done[:alive] >= RING
                if late.any():  # their rows go to waste, what they gave is taken back below
                    apart[:alive] |= late
                    done[:alive][late] = s
            last[(s + self.longest) & ring, :alive] = -1
            who = np.arange(alive)
            before, at = last[s & ring, :alive], starts[:alive] + s
            node, depth = self.base[0] + kinds[at], 1
            while True:
                piece, found = self.end[node], last[(s + depth) & ring]
                # a place whose last piece is known has no other
                some = np.flatnonzero((piece >= 0) & (found[who] < 0))
                if len(some):
                    ended = piece[some]
                    fits = self.may(before[some], ended)
                    found[who[some[fits]]] = ended[fits]
                below = self.base[node] + kinds[at + depth]
                more = np.flatnonzero(self.parent[below] == node)
                if not len(more):
                    break
                who, before, at, node = who[more], before[more], at[more], below[more]
                depth += 1
        whole = np.flatnonzero(~apart)
        commit(whole, sizes[whole])
        lane, number = np.concatenate(lanes), np.concatenate(numbers)
        if apart.any():
            stay = ~apart[lane]
            lane, number = lane[stay], number[stay]
        order = np.argsort(lane.astype(np.uint16) if n <= 1 << 16 else lane, kind="stable")
        return lane[order], number[order], np.flatnonzero(apart)

    def meeting(self, last: np.ndarray, done: np.ndarray, s: int) -> np.ndarray:
        """The place where all paths from the window before ``s`` meet, for each lane."""
        n, ring = len(done), RING - 1
        ends = np.maximum(s - np.arange(min(self.longest, s + 1))[:, None], done)
        lane = np.arange(n)
        while True:
            far = ends.max(axis=0)
            apart = far > ends.min(axis=0)
            if not apart.any():
                return far
            # the furthest path goes back one piece
            back = np.maximum(far - self.size[last[far & ring, lane]], done)
            ends = np.where((ends == far) & apart, back, ends)

    def cut(self, kinds: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the lanes of texts that lie one after the other."""
        mark = self.kind[ord(MARK)]
        marks = np.flatnonzero((kinds[1:] == mark) & (kinds[:-1] != mark)) + 1
        begins, ends = self.parted(begins, ends, marks)
        if (ends - begins > LONG).any():
            # neighbours that no piece has inside: all paths meet there as well
            two = kinds[:-1].astype(np.int64) << 32 | kinds[1:]
            at = np.minimum(np.searchsorted(self.twos, two), max(0, len(self.twos) - 1))
            begins, ends = self.parted(begins, ends, np.flatnonzero(self.twos[at] != two) + 1 if len(self.twos) else np.arange(1, len(kinds)))
        return begins, ends

    @staticmethod
    def parted(begins: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges cut at the first of the places in every ``LANE`` characters."""
        if len(places):
            places = places[np.concatenate([[True], np.diff(places // LANE) > 0])]
            inside = np.searchsorted(begins, places, "right") - 1
            places = places[(inside >= 0) & (places > begins[inside]) & (places < ends[inside])]
        all_begins = np.union1d(begins, places)
        all_ends = np.append(all_begins[1:], ends[-1] if len(ends) else 0)
        # the last part of a text ends where the text does
        return all_begins, np.minimum(all_ends, ends[np.searchsorted(begins, all_begins, "right") - 1])


class Codec:
    """A model that encodes and decodes batches of texts."""

    def __init__(self, model: bytes) -> None:
        self.library = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        plain = [
            i for i in range(n)
            if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        ]
        listed = [(p.id_to_piece(i), p.get_score(i)) for i in plain]
        self.pieces = Pieces(listed, plain, _merging(model))
        self.octet = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.octets = np.array([self.octet.get(b, 0) for b in range(256)], np.int32)
        self.unknown = p.unk_id()
        self.prefixed = p.normalize("a") == MARK + "a"
        # the model leaves a text as it is but for the marks
        self.plain = (
            self.prefixed and p.normalize("  ﬁ Ａ\t e\u0301 ") == MARK * 3 + f"ﬁ{MARK}Ａ\t{MARK}e\u0301{MARK}"
            and not _field(_field(model, 3, b""), 2, b"")
        )
        self.lanes = None
        if self.pieces.merging and self.octet and not any(MARK in s.lstrip(MARK) for s, _ in listed):
            self.lanes = Lanes(self.pieces, self.pieces.ids)
        # bytes of each id; the last is nothing, for ids that are not in the model
        self.bytes = pa.array([
            *(
                bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i)
                else b"" if p.is_control(i)
                else " ⁇ ".encode() if p.is_unknown(i)
                else p.id_to_piece(i).replace(MARK, " ").encode()
                for i in range(n)
            ),
            b"",
        ], pa.binary())

    def normal(self, text: str) -> str:
        if self.plain and text and MARK not in text:
            return MARK + text.replace(" ", MARK)
        return self.library.normalize(text)

    def search(self, text: str) -> np.ndarray:
        """Ids of one normal text, streamed."""
        one = Search(self.pieces)
        out = array("i")
        for i, _, surface, _ in (x for found in (one.feed(text), _later(one.finish)) for x in found):
            if i >= 0:
                out.append(i)
            elif self.octet:
                out.extend([self.octet[b] for b in surface.encode()])
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # unknown characters in a row are one
        return np.frombuffer(out, np.int32) if out else np.zeros(0, np.int32)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number for each text."""
        parts, counts = [np.zeros(0, np.int32)], []
        held: list[tuple[int, str]] = []  # number of the text, a part of it
        size = 0

        def search_held() -> None:
            if held:
                ids, n = self.stepped([s for _, s in held])
                parts.append(ids)
                for (i, _), m in zip(held, n.tolist(), strict=True):
                    counts[i] += m
                held.clear()

        for i, t in enumerate(texts):
            counts.append(0)
            normal = self.normal(t)
            if self.lanes is None:
                parts.append(self.search(normal))
                counts[i] = len(parts[-1])
                continue
            for part in sliced(normal):
                held.append((i, part))
                size += len(part)
                if size >= SLICE:
                    search_held()
                    size = 0
        search_held()
        return np.concatenate(parts), np.array(counts, np.int64)

    def stepped(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for normal texts of a bounded size, in lanes."""
        own = self.lanes
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("\0".join([*texts, "\0" * own.longest]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        kinds = own.kind[points]
        kinds[ends] = 0  # no piece goes over the end of a text
        kinds[ends[-1] :] = 0
        full = sizes > 0
        begins, stops = own.cut(kinds, (ends - sizes)[full], ends[full])
        long = stops - begins
        numbers = [np.zeros(0, np.int64)] * len(begins)
        alone: dict[int, np.ndarray] = {}
        order = np.argsort(-long, kind="stable")
        order = order[long[order] > 0]
        many = int((long[order] > LONG).sum())
        late = order[:many].tolist()
        for at in range(many, len(order), WIDTH):
            group = order[at : at + WIDTH]
            lane, number, apart = own.search(kinds, begins[group], long[group])
            late += group[apart].tolist()
            first = np.searchsorted(lane, np.arange(len(group) + 1))
            for j, g in enumerate(group.tolist()):
                numbers[g] = number[first[j] : first[j + 1]]
        for g in late:
            alone[g] = self.search(points[begins[g] : stops[g]].tobytes().decode("utf-32-le", "surrogatepass"))
            numbers[g] = np.full(len(alone[g]), -1)
        flat = np.concatenate([np.zeros(0, np.int64), *numbers])
        n = np.fromiter(map(len, numbers), np.int64, len(numbers))
        lane = np.repeat(np.arange(len(n)), n)
        ids = own.ids[flat]
        ids[flat < 0] = np.concatenate([np.zeros(0, np.int32), *(alone[g] for g in sorted(alone))])
        width = np.ones(len(ids), np.int64)
        odd = np.flatnonzero((ids < 0) & (flat >= 0))
        if len(odd):  # characters without an id: their bytes
            long_of = np.where(flat >= 0, own.size[flat], 0)
            at = np.cumsum(long_of) - long_of
            at += (begins - at[np.minimum(np.cumsum(n) - n, len(at) - 1)])[lane]
            spelled = [self.octets[list(chr(c).encode("utf-8", "surrogatepass"))] for c in points[at[odd]].tolist()]
            width[odd] = [len(x) for x in spelled]
            ids = np.repeat(ids, width)
            ids[np.repeat(np.isin(np.arange(len(width)), odd), width)] = np.concatenate(spelled)
        per_lane = np.bincount(lane, width, len(n)).astype(np.int64)
        text = np.searchsorted(ends, begins, "right")
        return ids, np.bincount(text, per_lane, len(texts)).astype(np.int64)

    def decode(self, ids: pa.ListArray) -> list[str]:
        flat = ids.flatten()
        known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.bytes))), False)
        pieces = self.bytes.take(pc.if_else(known, flat, len(self.bytes) - 1))
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        cut = 1 if self.prefixed else 0
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), b"").to_pylist()
        out = [t.decode("utf-8", "replace") for t in texts]
        return [t[cut:] if t.startswith(" ") else t for t in out]


def sliced(text: str) -> Iterator[str]:
    """A text in parts of about ``SLICE`` characters, cut before marks."""
    at = 0
    while len(text) - at > 2 * SLICE:
        border = _BORDER.search(text, at + SLICE)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def _later(fn: Callable[[], list]) -> Iterator:
    yield from fn()


def _merging(model: bytes) -> bool:
    """Whether the trainer's model type, field 3 of field 2 of the model, is byte-pair (2)."""
    return _field(_field(model, 2, b""), 3, 1) == 2


def _field(data: bytes, number: int, default):
    """First value of a numbered field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value, at = data[at : at + size], at + size
        if key >> 3 == number:
            return value
    return default


def codec(model: bytes) -> Codec:
    return held("pieces", model, Codec)


def load(spark: SparkSession, path: str) -> Broadcast:
    """The model at ``path``, read by the driver and broadcast; its size is checked."""
    with open(path, "rb") as f:
        return broadcast_bytes(spark, f.read())


def listed(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))


def encode(text: Column, model: Broadcast) -> Column:
    """Ids of a text, without begin or end; none for null and empty texts.

    Texts of any length are searched whole, in lanes or as a stream; rows that repeat are searched
    each time.
    """

    def run(texts: pa.Array) -> pa.Array:
        return listed(*codec(model.value).encode(t.as_py() or "" for t in texts))

    return arrow_column(run, "array<int>", text)


def transcode(text: Column, model: Broadcast) -> Column:
    """``ids`` as ``encode`` gives them and ``round_trip``, whether decoding them gives the text
    back (an empty one for null): one pass, while a plan with both functions would encode twice."""

    def run(texts: pa.Array) -> pa.Array:
        own = codec(model.value)
        ids = listed(*own.encode(t.as_py() or "" for t in texts))
        same = [
            back == (texts[i + j].as_py() or "")
            for i in range(0, len(ids), ROWS)
            for j, back in enumerate(own.decode(ids.slice(i, ROWS)))
        ]
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return arrow_column(run, "struct<ids: array<int>, round_trip: boolean>", text)


def decode(ids: Column, model: Broadcast) -> Column:
    """Text of ids; empty for null.  Ids that are null or not in the model give nothing, bytes
    that are no UTF-8 give the replacement character."""

    def run(lists: pa.Array) -> pa.Array:
        own = codec(model.value)
        some = [pa.array(own.decode(lists.slice(i, ROWS)), pa.string()) for i in range(0, len(lists), ROWS)]
        return pa.concat_arrays(some) if some else pa.array([], pa.string())

    return arrow_column(run, "string", ids)
