"""SentencePiece encoding with seeded merge-dropout, and decoding.

Pieces are merged as the model file says: an agenda holds candidate merges by score (ties: the
left one first). A candidate that comes up is skipped if a hash of (seed, document, place of the
unit, place in the unit) falls below ``dropout``; it comes up again only as part of another
candidate. ``dropout=0`` gives the model's own segmentation. No piece of a merge-type model holds a
blank after another character nor a line break, so a text is cut into units there without changing
any merge. Units are learnt from the model's own library; the merges that make a unit are those that make its
pieces. Every occurrence of a unit decides for itself. What is kept in a worker are outcomes: for a unit
and a set of its own merges that are skipped, the result and the merges that come up besides. An
occurrence hashes the unit's own merges and looks the outcome up, then hashes the merges that came up
besides; where none of those is skipped that is its result, the others are merged one by one.

Decoding gives the text back byte by byte. U+2581, which the model uses for a blank, is written
as byte pieces where a text holds it, as are characters without a piece.

Defined cases: a null text has null ids, 0 tokens and counts as restored; an empty text has no
tokens. Rows are kept as often as they occur and other columns pass through; a column named like
a result is replaced. A null id draws like an id of its own; very long texts are encoded whole, those units
of theirs that are long one by one.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import free_name, give_back, mixed_array, small_batches

BLANK = "▁"
UNITS = re.compile(f" *[^ \n{BLANK}]+| +|\n|{BLANK}")
MASK = (1 << 64) - 1
NEVER = np.int32(2**31 - 1)
#: Units of at most so many characters are merged many at a time.
SHORT = 40
#: Units that are merged together, and what stands where no piece starts.
TOGETHER, GONE = 8192, np.int32(-1)
#: Units that go to the library at once; its agenda is slower for long texts.
LINES = 128
#: Occurrences in a batch from which an outcome is worth keeping; rarer ones are merged anew.
OFTEN = 8


@dataclass(frozen=True)
class PieceParams:
    model: str = "/opt/tokenizers/piece_bpe_32k.model"
    dropout: float = 0.1
    seed: int = 17
    #: Units whose own segmentation is kept in a Python worker; beyond that all but those of several batches are forgotten and made again.
    kept: int = 200_000


def mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


class Lists:
    """Lists of numbers, one after the other."""

    def __init__(self, dtype, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.flat = np.zeros(0, dtype) if flat is None else flat
        self.counts = np.zeros(0, np.int64) if counts is None else counts
        self.starts = np.cumsum(self.counts) - self.counts

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i]:self.starts[i] + self.counts[i]]

    def add(self, other: Lists) -> None:
        self.starts = np.concatenate([self.starts, other.starts + len(self.flat)])
        self.counts = np.concatenate([self.counts, other.counts])
        self.flat = np.concatenate([self.flat, other.flat])

    def take(self, which: np.ndarray) -> Lists:
        """The lists ``which``, in that order."""
        counts = self.counts[which]
        return Lists(self.flat.dtype, self.flat[spread(self.starts[which], counts)], counts)

    def drawn(self, which: np.ndarray, draws: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places in the lists ``which`` of occurrences those whose hash skips them: the occurrence, and the number in the list."""
        counts = self.counts[which]
        owner = np.repeat(np.arange(len(which)), counts)
        skipped = np.flatnonzero(mixed_array(draws[owner] ^ self.flat[spread(self.starts[which], counts)]) < np.uint64(min(limit, MASK)))
        return owner[skipped], skipped - (np.cumsum(counts) - counts)[owner[skipped]]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers from each of ``starts`` on, ``counts`` each."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Collected:
    """Lists that come in any order."""

    def __init__(self, n: int, dtype):
        self.dtype, self.rows, self.parts, self.counts = dtype, [], [], np.zeros(n, np.int64)

    def put(self, rows: np.ndarray, flat: np.ndarray, counts: np.ndarray | int) -> None:
        self.rows.append(rows)
        self.parts.append(flat)
        self.counts[rows] = counts

    def lists(self) -> Lists:
        rows = np.concatenate([np.zeros(0, np.int64), *self.rows])
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        return Lists(self.dtype, np.concatenate([np.zeros(0, self.dtype), *self.parts]), self.counts[rows]).take(place)


class PieceModel:
    """The vocabulary of a merge-type model: merges, byte pieces, and what each id decodes to."""

    def __init__(self, serialized: bytes, params: PieceParams):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        self.params, self.merges, self.texts = params, {}, []
        self.bytes_of = [b""] * 256
        for i in range(model.vocab_size()):
            piece, code = model.id_to_piece(i), i.to_bytes(4, "little")
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[value] = code
                self.texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b"")
            else:
                self.merges[piece] = (-model.get_score(i), code)
                self.texts.append(piece.replace(BLANK, " ").encode())
        if not all(self.bytes_of):
            raise ValueError("the model has no byte pieces, so decoding would lose characters")
        self.limit = int(params.dropout * 2.0**64)
        #: What each id decodes to, and how many characters it starts; the places of the merges that make it, from its own start (-1: not known yet).
        self.decoded = Lists(np.uint8, np.frombuffer(b"".join(self.texts), np.uint8), np.array([len(t) for t in self.texts], np.int64))
        self.characters = np.add.reduceat(np.append((self.decoded.flat & 0xC0) != 0x80, False).astype(np.int64),
                                          np.append(self.decoded.starts, len(self.decoded.flat)))[:-1] * (self.decoded.counts > 0)
        self.tree_of, self.trees = np.full(len(self.texts), -1, np.int64), Lists(np.int64)
        self.forget()
        self._index_pairs(model)

    def forget(self) -> None:
        """Let go of all that was learnt about units."""
        #: Units by number: characters as pieces, ids without dropout (a draw of 0), and the places of the merges that make them.
        self.names: list[str] = []
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.codes, self.ids, self.merged = Lists(np.int32), Lists(np.int32), Lists(np.uint64)
        #: In how many batches each unit came up.
        self.met = np.zeros(0, np.int32)
        self._forget_outcomes()

    def _forget_rare(self) -> None:
        """Let go of units that came up in one batch only, and of as many others as leave half of the room."""
        stay = np.flatnonzero(self.met > 1)
        stay = np.sort(stay[np.argsort(-self.met[stay], kind="stable")[:self.params.kept // 2]])
        names, met, lists = [self.names[i] for i in stay.tolist()], self.met[stay] // 2, [kept.take(stay) for kept in (self.codes, self.ids, self.merged)]
        self.forget()
        self.names, self.met, (self.codes, self.ids, self.merged) = names, met, lists
        self.number = defaultdict(count(len(names)).__next__, zip(names, range(len(names))))

    def _forget_outcomes(self) -> None:
        #: By unit and skipped merges of its own (bits): the number of the ids, and of the places of merges that come up besides.
        self.outcomes: dict[tuple[int, int], int] = {}
        self.outcome_ids, self.besides = Lists(np.int32), Lists(np.uint64)

    @property
    def tables(self) -> list[dict[str, bytes]]:
        """Ids of the units learnt."""
        return [{u: self.ids[i].tobytes() for u, i in self.number.items()}]

    @property
    def places(self) -> dict[str, np.ndarray]:
        """Places of the merges of the units learnt."""
        return {u: self.merged[i] for u, i in self.number.items()}

    def _index_pairs(self, model) -> None:
        """Every pair of pieces that makes a piece: its key, its place in the order, and the id made.

        ``near`` finds a pair by a hash of its key; keys that share a slot are in ``far``, where
        the multiplier is chosen so that none do.
        """
        code = {piece: int.from_bytes(c, "little") for piece, (_, c) in self.merges.items()}
        order = {score: i for i, score in enumerate(sorted({score for score, _ in self.merges.values()}))}
        pairs = [(code[p[:i]] << 20 | code[p[i:]], order[self.merges[p][0]], made)
                 for p, made in code.items() for i in range(1, len(p)) if p[:i] in code and p[i:] in code]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.pair_key, self.pair_order, self.pair_made = table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.near, self.far, self.turn = np.full(1 << 21, -1, np.int32), np.full(1 << 20, -1, np.int32), 1
        slots = self._slot(self.pair_key, 0x9E3779B97F4A7C15, 21)
        self.near[slots[::-1]] = np.arange(len(slots))[::-1]
        rest = np.flatnonzero(self.near[slots] != np.arange(len(slots)))
        for self.turn in range(0xD1342543DE82EF95, 0xD1342543DE82EF95 + 20_000, 2):
            slots = self._slot(self.pair_key[rest], self.turn, 20)
            if len(np.unique(slots)) == len(rest):
                break
        else:
            raise ValueError("no arrangement of the pairs was found")
        self.far[slots] = rest
        self.code_of = np.full(0x110000, -1, np.int32)
        for piece, made in code.items():
            if len(piece) == 1:
                self.code_of[ord(piece)] = made

    @staticmethod
    def _slot(key: np.ndarray, turn: int, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(turn & MASK)) >> np.uint64(64 - bits)).astype(np.int64)

    def _candidates(self, a, b, key, skip, left, middle, stop) -> tuple[np.ndarray, np.ndarray]:
        """Place in the order (NEVER: no piece, or skipped) and id made of pairs of neighbours."""
        want = a.astype(np.int64) << 20 | b
        found = self.near[self._slot(want, 0x9E3779B97F4A7C15, 21)]
        miss = self.pair_key[found] != want
        if miss.any():
            other = self.far[self._slot(want[miss], self.turn, 20)]
            found[miss] = np.where(self.pair_key[other] == want[miss], other, -1)
        order = np.where(found >= 0, self.pair_order[found], NEVER)
        if key is not None:
            place = (left.astype(np.uint64) << np.uint64(32)) | ((middle.astype(np.uint64) << np.uint64(16)) ^ stop.astype(np.uint64))
            order[mixed_array(key ^ place) < np.uint64(min(self.limit, MASK))] = NEVER
        if skip is not None:
            place = (left.astype(np.uint64) << np.uint64(32)) | ((middle.astype(np.uint64) << np.uint64(16)) ^ stop.astype(np.uint64))
            order[(place[:, None] == skip).any(axis=1)] = NEVER
        return order, self.pair_made[found]

    def segment_many(self, units: list[str], draws: np.ndarray | None, skips: np.ndarray | None = None) -> tuple[list[bytes], list[np.ndarray]]:
        """The same as ``segment`` for many short units at once, one merge of each unit a step; without draws also the places of merges.

        ``skips`` may give the places of merges that a unit skips, a row each, filled up with MASK.
        """
        ids, merged = self._segments(units, self._characters(units), draws, skips)
        return [ids[i].tobytes() for i in range(len(units))], [merged[i] for i in range(len(units))]

    def _characters(self, units: list[str]) -> Lists:
        text = "".join(units).replace(" ", BLANK)
        return Lists(np.int32, self.code_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.fromiter(map(len, units), np.int64, len(units)))

    def _segments(self, units: list[str], codes: Lists, draws: np.ndarray | None, skips: np.ndarray | None = None) -> tuple[Lists, Lists]:
        """Ids of units and, without draws, places of merges; ``codes`` are their characters as pieces (-1: none)."""
        ids, merged = Collected(len(units), np.int32), Collected(len(units), np.uint64)
        known = np.ones(len(units), bool)
        known[np.repeat(np.arange(len(units)), codes.counts)[codes.flat < 0]] = False
        known &= (codes.counts > 0) & (codes.counts <= SHORT)
        for i in np.flatnonzero(~known | ((codes.counts == 1) & np.fromiter(map(BLANK.__eq__, units), bool, len(units)))).tolist():
            known[i] = False
            places: list[int] = []
            found = np.frombuffer(self.segment(units[i], int(draws[i]) if draws is not None else 0, places,
                                               None if skips is None else set(skips[i].tolist())), np.int32)
            ids.put(np.array([i]), found, len(found))
            merged.put(np.array([i]), np.array(places, np.uint64), len(places))
        # Units of nearly the same length go together.
        order = np.flatnonzero(known)
        order = order[np.argsort(codes.counts[order], kind="stable")]
        for at in range(0, len(order), TOGETHER):
            self._merge(order[at:at + TOGETHER], codes, draws, skips, ids, merged)
        return ids.lists(), merged.lists()

    def _merge(self, which: np.ndarray, codes: Lists, draws: np.ndarray | None, skips: np.ndarray | None, ids: Collected, merged: Collected) -> None:
        sizes = codes.counts[which]
        wide, own = int(sizes.max()) + 1, codes.take(which)
        # A piece stands in the column where it starts, with the columns where its neighbours start and its merge with the piece after it.
        columns = np.arange(wide, dtype=np.int32)
        symbols = np.full((len(which), wide), GONE, np.int32)
        symbols[columns < sizes[:, None]] = own.flat
        after, before = np.tile(columns + 1, len(which)), np.tile(columns - 1, len(which))
        order, made = np.full(symbols.shape, NEVER, np.int32), np.zeros(symbols.size, np.int32)
        flat, best_of = symbols.reshape(-1), order.reshape(-1)
        keys = draws[which] if draws is not None else None
        skip = skips[which] if skips is not None else None

        def consider(rows, at):
            start = rows * wide
            middle = after[at]
            right = start + middle
            best_of[at], made[at] = self._candidates(
                flat[at], flat[right], keys[rows] if keys is not None else None, skip[rows] if skip is not None else None, at - start, middle, after[right])

        pairs = np.flatnonzero(columns < sizes[:, None] - 1)
        consider(pairs // wide, pairs)
        rows, steps = np.arange(len(which)), []
        while True:
            at = rows * wide + (order if len(rows) == len(order) else order[rows]).argmin(axis=1)
            live = best_of[at] < NEVER
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            start = rows * wide
            left, middle = at - start, after[at]
            gone = start + middle
            stop = after[gone]
            if draws is None:
                steps.append((rows, (left.astype(np.uint64) << np.uint64(32)) | ((middle.astype(np.uint64) << np.uint64(16)) ^ stop.astype(np.uint64))))
            flat[at], flat[gone] = made[at], GONE
            after[at], before[start + stop] = stop, left
            best_of[at] = best_of[gone] = NEVER
            onward, back = stop < sizes[rows], left > 0
            consider(np.concatenate([rows[onward], rows[back]]), np.concatenate([at[onward], start[back] + before[at[back]]]))
        kept = symbols != GONE
        ids.put(which, symbols[kept], kept.sum(axis=1))
        owner = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in steps]])
        places = np.concatenate([np.zeros(0, np.uint64), *[p for _, p in steps]])
        merged.put(which, places[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(which)))

    def by_bytes(self, text: str) -> bytes:
        return b"".join([self.bytes_of[b] for b in text.encode()])

    def segment(self, unit: str, draw: int, places: list[int] | None = None, skip: set[int] | None = None) -> bytes:
        """Ids of one unit, four bytes each; merges are skipped by ``draw`` (0 skips none) or if in ``skip``. The places of others go to ``places``."""
        if unit == BLANK:
            return self.by_bytes(unit)
        text, merges, limit = unit.replace(" ", BLANK), self.merges, self.limit
        n = len(text)
        # Symbol i runs from i to end[i]; 0 where it went into another. before[i]: the symbol to its left.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = merges.get(text[i:i + 2])
            if found:
                agenda.append((found[0], i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, middle, stop = heapq.heappop(agenda)
            if end[left] != middle or end[middle] != stop:
                continue
            place = left << 32 | middle << 16 ^ stop
            if draw and limit and mixed(draw ^ place) < limit or skip and place & MASK in skip:
                continue
            if places is not None:
                places.append(place & MASK)
            end[left], end[middle] = stop, 0
            if stop < n:
                before[stop] = left
                found = merges.get(text[left:end[stop]])
                if found:
                    heapq.heappush(agenda, (found[0], left, stop, end[stop]))
            if left:
                start = before[left]
                found = merges.get(text[start:stop])
                if found:
                    heapq.heappush(agenda, (found[0], start, left, stop))
        out, at = [], 0
        while at < n:
            piece = text[at:end[at]]
            found = merges.get(piece)
            out.append(found[1] if found else self.by_bytes(piece))
            at = end[at]
        return b"".join(out)

    def encode_many(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of whole texts."""
        if len(self.number) > self.params.kept:
            self._forget_rare()
        cut = [UNITS.findall(" " + text) if text else [] for text in texts]
        sizes = np.array([len(one) for one in cut], np.int64)
        # A unit that is asked for gets the next number if it has none.
        known = len(self.number)
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        del cut
        self._learn_units(list(islice(self.number, known, None)))
        seen = np.zeros(len(self.names), np.int32)
        seen[which] = 1
        seen[:known] += self.met
        self.met = seen
        # The ids of an occurrence are a stretch of the units' ids, or of those that follow for occurrences with a skipped merge.
        starts, counts, pool = self.ids.starts[which], self.ids.counts[which], [self.ids.flat]
        if self.limit and len(which):
            keys = np.array([mixed(d ^ self.params.seed) for d in documents], np.uint64)
            draws = mixed_array(spread(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64) ^ np.repeat(keys, sizes))
            draws[draws == 0] = 1
            at = len(self.ids.flat)
            for first in range(0, len(which), 1 << 18):
                for rows, found in self._drop(which[first:first + (1 << 18)], draws[first:first + (1 << 18)]):
                    starts[first + rows], counts[first + rows] = found.starts + at, found.counts
                    pool.append(found.flat)
                    at += len(found.flat)
        pool = np.concatenate(pool)
        found = np.concatenate([pool[:0], *[pool[spread(starts[at:at + (1 << 18)], counts[at:at + (1 << 18)])] for at in range(0, len(which), 1 << 18)]])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return [found[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _learn_units(self, new: list[str]) -> None:
        """Ids and merges of the units numbered last, by the model's own library."""
        for at in range(0, len(new), 1 << 16):
            some = new[at:at + (1 << 16)]
            codes = self._characters(some)
            ids, merged = self._by_library(some) or self._segments(some, codes, None)
            self.names += some
            for kept, more in ((self.codes, codes), (self.ids, ids), (self.merged, merged)):
                kept.add(more)

    def _by_library(self, units: list[str]) -> tuple[Lists, Lists] | None:
        """The same as ``_segments`` without draws; None if the library changes a text.

        Units go to the library in lines, as nothing merges with a line break. No merge crosses the end of a piece, so the merges
        that make a unit are those that make its pieces.
        """
        if BLANK in units or "\n" in units:
            plain = [i for i, u in enumerate(units) if u not in (BLANK, "\n")]
            odd = [i for i, u in enumerate(units) if u in (BLANK, "\n")]
            found = self._by_library([units[i] for i in plain])
            if found is None:
                return None
            place = np.empty(len(units), np.int64)
            place[plain + odd] = np.arange(len(units))
            own = [units[i] for i in odd]
            for kept, more in zip(found, self._segments(own, self._characters(own), None)):
                kept.add(more)
            return found[0].take(place), found[1].take(place)
        if not units:
            return Lists(np.int32), Lists(np.uint64)
        stop, parts = np.frombuffer(self.segment("\n", 0), np.int32)[0], []
        for at in range(0, len(units), LINES):
            part = np.array(self.library.encode("\n" + "\n".join(units[at:at + LINES])), np.int32)
            # The library puts a blank in front.
            parts.append(part[(part == stop).argmax():])
        found = np.concatenate(parts)
        breaks = np.flatnonzero(found == stop)
        if len(breaks) != len(units) or self.decoded.take(found).flat.tobytes() != ("\n" + "\n".join(units)).encode():
            return None
        used = np.unique(found)
        self._learn_trees(used[self.tree_of[used] < 0])
        tree = self.tree_of[found]
        if (tree < 0).any():
            return None
        size = self.characters[found]
        before = np.cumsum(size) - size
        line = np.cumsum(found == found[0]) - 1
        # A line's first character is the break.
        trees = self.trees.take(tree)
        shift = np.repeat(before - before[breaks][line] - 1, trees.counts // 3)
        left, middle, stop = ((trees.flat[k::3] + shift).astype(np.uint64) for k in range(3))
        merges = np.bincount(line, trees.counts // 3, len(units)).astype(np.int64)
        inside = np.ones(len(found), bool)
        inside[breaks] = False
        return (Lists(np.int32, found[inside], np.diff(np.append(breaks, len(found))) - 1),
                Lists(np.uint64, (left << np.uint64(32)) | ((middle << np.uint64(16)) ^ stop), merges))

    def _learn_trees(self, ids: np.ndarray) -> None:
        """The merges that make pieces: left, middle and stop of each; what merges do not make stays unknown."""
        pieces = [self.texts[i].decode("utf-8", "replace") for i in ids.tolist()]
        short = self.characters[ids] < 2
        single = ids[short]
        self.tree_of[single] = np.arange(len(single)) + len(self.trees)
        self.trees.add(Lists(np.int64, None, np.zeros(len(single), np.int64)))
        for i, piece in ((i, p) for i, p, s in zip(ids.tolist(), pieces, short.tolist()) if not s):
            places: list[int] = []
            if len(piece) < 1 << 15 and self.segment(piece, 0, places) == i.to_bytes(4, "little"):
                # Below 65,536 characters the three numbers of a place stay apart.
                self.tree_of[i] = len(self.trees)
                self.trees.add(Lists(np.int64, np.array([[p >> 32, p >> 16 & 0xFFFF, p & 0xFFFF] for p in places], np.int64).ravel(),
                                     np.array([3 * len(places)])))

    def _drop(self, which: np.ndarray, draws: np.ndarray):
        """Occurrences that skip a merge, and the ids of each."""
        owner, bit = self.merged.drawn(which, draws, self.limit)
        # Merges of its own that an occurrence skips, as bits; a unit of more merges than bits is merged anew.
        bits = np.zeros(len(which), np.uint64)
        np.bitwise_or.at(bits, owner, np.uint64(1) << np.minimum(bit, 63).astype(np.uint64))
        rows = np.flatnonzero(bits)
        short = self.merged.counts[which[rows]] <= 63
        anew, rows = [rows[~short]], rows[short]
        order = np.lexsort((bits[rows], which[rows]))
        rows = rows[order]
        first = np.flatnonzero(np.append(True, (np.diff(which[rows]) != 0) | (np.diff(bits[rows]) != 0))) if len(rows) else np.zeros(0, np.int64)
        unit, state, often = which[rows[first]], bits[rows[first]], np.diff(np.append(first, len(rows)))
        self._learn(list(zip(unit[often >= OFTEN].tolist(), state[often >= OFTEN].tolist())))
        # Most states are rare, and of units without outcomes.
        asked = np.flatnonzero(np.isin(unit, np.array([u for u, _ in self.outcomes], np.int64)))
        known = np.full(len(first), -1, np.int64)
        known[asked] = [self.outcomes.get(s, -1) for s in zip(unit[asked].tolist(), state[asked].tolist())]
        outcome = np.repeat(known, often)
        anew.append(rows[outcome < 0])
        rows, outcome = rows[outcome >= 0], outcome[outcome >= 0]
        again, _ = self.besides.drawn(outcome, draws[rows], self.limit)
        other = np.zeros(len(rows), bool)
        other[again] = True
        yield rows[~other], self.outcome_ids.take(outcome[~other])
        rest = np.concatenate([*anew, rows[other]])
        units = which[rest]
        yield rest, self._segments([self.names[u] for u in units.tolist()], self.codes.take(units), draws[rest])[0]

    def _learn(self, states: list[tuple[int, int]]) -> None:
        """Outcomes of units with skipped merges that are not known yet."""
        if len(self.outcomes) > self.params.kept:
            self._forget_outcomes()
        new = [s for s in states if s not in self.outcomes]
        if not new:
            return
        units, bits = np.array([u for u, _ in new], np.int64), np.array([b for _, b in new], np.uint64)
        own = self.merged.take(units)
        owner = np.repeat(np.arange(len(new)), own.counts)
        number = np.arange(len(own.flat)) - own.starts[owner]
        skipped = (bits[owner] >> number.astype(np.uint64)) & np.uint64(1) != 0
        many = np.bincount(owner[skipped], minlength=len(new))
        skips = np.full((len(new), many.max()), MASK, np.uint64)
        skips[np.arange(many.max()) < many[:, None]] = own.flat[skipped]
        ids, merged = self._segments([self.names[u] for u in units.tolist()], self.codes.take(units), None, skips)
        # Of the merges made, those that are not the unit's own.
        state = np.repeat(np.arange(len(new)), merged.counts)
        both = np.stack([np.concatenate([owner, state]).astype(np.uint64), np.concatenate([own.flat, merged.flat])])
        order = np.lexsort((both[1], both[0]))
        same = np.zeros(both.shape[1], bool)
        same[order[1:]] = (both[:, order[1:]] == both[:, order[:-1]]).all(axis=0)
        besides = ~same[len(owner):]
        self.outcomes.update(zip(new, range(len(self.outcome_ids), len(self.outcome_ids) + len(new))))
        self.outcome_ids.add(ids)
        self.besides.add(Lists(np.uint64, merged.flat[besides], np.bincount(state[besides], minlength=len(new)).astype(np.int64)))

    def encode(self, text: str, document: int) -> np.ndarray:
        return self.encode_many([text], [document])[0]

    def restores(self, ids: list[np.ndarray], texts: list[str | None]) -> list[bool]:
        """Whether the ids of each text decode to it."""
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        joined = self.decoded.take(flat).flat.tobytes()
        ends = np.concatenate([[0], np.cumsum(self.decoded.counts[flat])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [joined[a + 1:b] == (text or "").encode() for a, b, text in zip(ends, ends[1:], texts)]

    def decode(self, ids: np.ndarray) -> str:
        joined = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return joined[1:].decode()


_models: dict[tuple[int, PieceParams], PieceModel] = {}


def loaded(serialized: bytes, params: PieceParams) -> PieceModel:
    """A Python worker reads a model once."""
    key = (xxhash.xxh64_intdigest(serialized), params)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(serialized, params)
    return _models[key]


def encode_texts(docs: DataFrame, params: PieceParams = PieceParams()) -> DataFrame:
    """Add ``ids``, ``n_tokens`` and ``restored`` (the ids decode to the very text)."""
    spark = docs.sparkSession
    # The file is the same size whatever the corpus.
    shared = spark.sparkContext.broadcast(Path(params.model).read_bytes())
    others, key = [f for f in docs.schema.fields if f.name not in ("ids", "n_tokens", "restored")], free_name(docs, "document")
    schema = T.StructType(others + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                                    T.StructField("n_tokens", T.LongType()),
                                    T.StructField("restored", T.BooleanType())])

    def run(batches):
        model = loaded(shared.value, params)
        try:
            yield from encoded(model, batches)
        finally:
            # The worker may go on with tasks of other stages, which need the room.
            model.forget()
            give_back()

    def encoded(model, batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, keys = batch.column("text").to_pylist(), batch.column(key).to_pylist()
            ids = model.encode_many(texts, [k & MASK for k in keys])
            restored = model.restores(ids, texts)
            offsets = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(np.concatenate(ids)),
                mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in others] + [lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(restored)],
                names=schema.names)

    small_batches(spark)
    return docs.select(*[f.name for f in others], F.xxhash64("doc_id").alias(key)).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, params: PieceParams = PieceParams()) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Path(params.model).read_bytes())

    def run(batches):
        model = loaded(shared.value, params)
        for batch in batches:
            texts = [None if x is None else model.decode(np.asarray(x, np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    small_batches(spark)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
