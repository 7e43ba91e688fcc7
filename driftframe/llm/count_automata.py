"""Weighted acyclic automata of word sequences of two to four words: built from sorted sequences, united, composed.

A path from the start spells a sequence of word ids, and each of its arcs from the second on carries the count of the sequence up to
there. Below the pairs, states with the same arcs, weights included, are one state (all states without arcs are one), as in a minimal
automaton; they are found from the last words up, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

LONGEST = 4
#: Pairs and triples whose states are found at once; a range with more comes alone.
SEQUENCES_AT_ONCE = 1 << 18


def _narrow(x: np.ndarray) -> bytes:
    most = int(x.max(initial=0))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def encode(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers from 0 on as bytes."""
    parts = [_narrow(x) for x in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.compress(head + b"".join(parts), 3)


def decode(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size in sizes:
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[raw[at]]
        out.append(np.frombuffer(raw[at + 1 : at + size], kind).astype(np.int64))
        at += int(size)
    return out


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all runs [start, start + length), one run after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) - np.repeat(before - start, length)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def share(length: np.ndarray, arcs: list[np.ndarray], owner: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """One state for all with the same arcs and owner: the state of each of the old ones, and the length and arcs of those that remain.

    length: arcs of each old state; arcs: equally long columns, state by state; owner: of each old state, from 0 on. A signature puts
    candidates together; each is compared with the first of its signature, and stays a state of its own if they differ.
    """
    start, owner = np.cumsum(length) - length, np.broadcast_to(owner, length.shape)
    place = runs(np.zeros(len(length), np.int64), length)
    value = _mix(place + 1)
    for column in arcs:
        value = _mix(value ^ _mix(column.astype(np.uint64)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    signature = total[start + length] - total[start] + _mix(length) + _mix(_mix(owner))
    _, first, group = np.unique(signature, return_index=True, return_inverse=True)
    other = first[group]
    same = (length == length[other]) & (owner == owner[other])
    which = np.flatnonzero(same)
    mine, theirs = runs(start[which], length[which]), runs(start[other[which]], length[which])
    differs = np.zeros(len(mine), dtype=bool)
    for column in arcs:
        differs |= column[mine] != column[theirs]
    same[np.repeat(which, length[which])[differs]] = False
    remain = np.flatnonzero(~same | (other == np.arange(len(length))))
    number = np.full(len(length), -1)
    number[remain] = np.arange(len(remain))
    state = np.where(same, number[other], number)
    kept = runs(start[remain], length[remain])
    return state, length[remain], [c[kept] for c in arcs]


class Levels:
    """Counts of sequences as a tree, level by level: parent, word and count of each sequence of 2, 3 and 4 words, in order of parent and word.

    A sequence of two words has its first word as parent. A count of 0 stands for a sequence that is only the beginning of others.
    """

    def __init__(self, parents: list[np.ndarray], words: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.parents, self.words, self.counts = parents, words, counts

    @classmethod
    def of_tokens(cls, token: np.ndarray, linked: np.ndarray, weight: np.ndarray) -> Levels:
        """All windows of 2 to 4 tokens without a break. token: a number, -1 for none; linked: it follows the one before; weight: of each token."""
        parents, words, counts = [], [], []
        upto, valid = token, token >= 0
        for n in range(2, LONGEST + 1):
            k = n - 1
            go = np.zeros(len(token), dtype=bool)
            if len(token) > k:
                go[:-k] = valid[:-k] & linked[k:] & (token[k:] >= 0)
            at = np.flatnonzero(go)
            key, inverse = np.unique((upto[at].astype(np.uint64) << np.uint64(32)) | token[at + k].astype(np.uint64), return_inverse=True)
            parents.append((key >> np.uint64(32)).astype(np.int64))
            words.append((key & np.uint64(0xFFFFFFFF)).astype(np.int64))
            counts.append(np.bincount(inverse, weights=weight[at], minlength=len(key)).astype(np.int64))  # exact below 2**53
            upto, valid = np.zeros(len(token), dtype=np.int64), go
            upto[at] = inverse
        return cls(parents, words, counts)

    def part(self, two: np.ndarray, own: np.ndarray, three: np.ndarray) -> Levels:
        """The tree of chosen sequences. own: pairs that count here; three: triples, whose fours go along; two: pairs, those and the triples' beginnings."""
        four = three[self.parents[2]]
        second, third = np.cumsum(two) - 1, np.cumsum(three) - 1
        parents = [self.parents[0][two], second[self.parents[1][three]], third[self.parents[2][four]]]
        return Levels(parents, [self.words[0][two], self.words[1][three], self.words[2][four]], [np.where(own, self.counts[0], 0)[two], self.counts[1][three], self.counts[2][four]])

    def automata(self, pair: np.ndarray, triple: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, minimal automaton in bytes of the sequences of that range), range by range.

        pair, triple: the range of each pair and triple, from 0 on; fours go along with their triple, as does its beginning, with a count
        of 0 where that is in another range. ids: the word id of each number, rising. All sequences are put in the order of their
        ranges once, and states are found for many ranges at once, so many ranges are little more work than few.
        """
        up, low = self.parents[1], np.int64(32)
        away = np.flatnonzero(triple != pair[up])
        key = np.concatenate([(pair << low) | np.arange(len(pair)), np.unique((triple[away] << low) | up[away])])
        order = np.argsort(key, kind="stable")
        key, counted = key[order], order < len(pair)
        order = np.argsort(triple, kind="stable")
        fours = np.bincount(self.parents[2], minlength=len(triple))
        start = np.cumsum(fours) - fours
        ranges, pairs = np.unique(key >> low, return_index=True)
        pairs, triples = np.append(pairs, len(key)), np.append(np.searchsorted(triple, ranges, sorter=order), len(order))
        size, a = pairs + triples, 0
        while a < len(ranges):
            b = max(a + 1, int(np.searchsorted(size, size[a] + SEQUENCES_AT_ONCE, side="right")) - 1)
            own, three = key[pairs[a] : pairs[b]], order[triples[a] : triples[b]]
            two, four = own & np.int64(0xFFFFFFFF), runs(start[three], fours[three])
            second = np.searchsorted(own, (triple[three] << low) | up[three])
            parents = [self.parents[0][two], second, np.repeat(np.arange(len(three)), fours[three])]
            counts = [np.where(counted[pairs[a] : pairs[b]], self.counts[0][two], 0), self.counts[1][three], self.counts[2][four]]
            yield from Levels(parents, [self.words[0][two], self.words[1][three], self.words[2][four]], counts)._in_order(own >> low, triple[three], ids)
            a = b

    def _in_order(self, pair: np.ndarray, triple: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """``automata`` where pairs and triples are in the order of their ranges and each triple's beginning is in its range."""
        first, second = self.parents[0], self.words[0]
        state4, length4, (word4, count4) = share(np.bincount(self.parents[2], minlength=len(triple)), [self.words[2], self.counts[2]], triple)
        state3, length3, (word3, count3, next3) = share(np.bincount(self.parents[1], minlength=len(pair)), [self.words[1], self.counts[1], state4], pair)
        ranges, pairs = np.unique(pair, return_index=True)
        # where each range begins: its pairs, states and arcs; a range's first state is that of its first sequence
        pairs = np.append(pairs, len(pair))
        states3, states4 = np.append(state3, len(length3))[pairs], np.append(state4, len(length4))[np.append(np.searchsorted(triple, ranges), len(triple))]
        arcs3, arcs4 = (np.concatenate([[0], np.cumsum(n)])[s] for n, s in ((length3, states3), (length4, states4)))
        number = np.zeros(len(ids), dtype=np.int64)
        for k, own in enumerate(ranges.tolist()):
            p, s3, s4, a3, a4 = (slice(c[k], c[k + 1]) for c in (pairs, states3, states4, arcs3, arcs4))
            used = np.sort(np.concatenate([first[p], second[p], word3[a3], word4[a4]]))
            used = used[np.concatenate([[True], used[1:] != used[:-1]])]
            number[used] = np.arange(len(used))
            arrays = [np.diff(ids[used], prepend=0), number[first[p]], number[second[p]], self.counts[0][p], state3[p] - states3[k], length3[s3]]
            arrays += [number[word3[a3]], count3[a3], next3[a3] - states4[k], length4[s4], number[word4[a4]], count4[a4]]
            yield own, encode(arrays)

    def automaton(self, ids: np.ndarray) -> bytes:
        """All as one automaton."""
        one = dict(self.automata(*(np.zeros(len(w), dtype=np.int64) for w in self.words[:2]), ids))
        return one[0] if one else encode([np.zeros(0, np.int64)] * 12)

    @classmethod
    def of_automaton(cls, data: bytes) -> tuple[Levels, np.ndarray]:
        """The tree of all paths, and the word ids."""
        gaps, first, second, count, state3, length3, word3, count3, state4, length4, word4, count4 = decode(data)
        own3 = length3[state3]
        arc3 = runs((np.cumsum(length3) - length3)[state3], own3)
        own4 = length4[state4[arc3]]
        arc4 = runs((np.cumsum(length4) - length4)[state4[arc3]], own4)
        parents = [first, np.repeat(np.arange(len(first)), own3), np.repeat(np.arange(len(arc3)), own4)]
        return cls(parents, [second, word3[arc3], word4[arc4]], [count, count3[arc3], count4[arc4]]), np.cumsum(gaps)


def union(automata: list[bytes]) -> tuple[Levels, np.ndarray]:
    """The tree of all sequences of the automata, with the sums of their counts, and the word ids."""
    trees = [Levels.of_automaton(data) for data in automata]
    ids = np.unique(np.concatenate([np.zeros(0, np.int64), *(own for _, own in trees)]))
    number = [np.searchsorted(ids, own) for _, own in trees]
    upto = number  # what the parents of each tree's level are in the union
    parents, words, counts = [], [], []
    for level in range(LONGEST - 1):
        parent = np.concatenate([np.zeros(0, np.int64), *(m[t.parents[level]] for m, (t, _) in zip(upto, trees, strict=True))])
        word = np.concatenate([np.zeros(0, np.int64), *(m[t.words[level]] for m, (t, _) in zip(number, trees, strict=True))])
        own = np.concatenate([np.zeros(0, np.int64), *(t.counts[level] for t, _ in trees)])
        key = (parent.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
        at = np.empty(len(key), dtype=np.int64)
        at[order] = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        kept = order[begin]
        parents.append(parent[kept])
        words.append(word[kept])
        counts.append(np.add.reduceat(own[order], begin) if len(begin) else own)
        cuts = np.cumsum([0, *(len(t.words[level]) for t, _ in trees)])
        upto = [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Levels(parents, words, counts), ids


class Lookup:
    """An automaton of sequences of one to three words that says where each of many sequences ends: the composition with their paths."""

    def __init__(self, sequences: np.ndarray) -> None:
        """sequences: distinct rows of three ids, -1 after the last."""
        self.ids = np.unique(sequences)  # -1 is the end
        self.levels: list[np.ndarray] = []
        state = np.zeros(len(sequences), dtype=np.int64)
        for k in range(sequences.shape[1]):
            key = (state << np.int64(32)) | np.searchsorted(self.ids, sequences[:, k])
            arcs, state = np.unique(key, return_inverse=True)
            self.levels.append(arcs)
        self.row = np.zeros(len(self.levels[-1]), dtype=np.int64)
        self.row[state] = np.arange(len(sequences))

    def compose(self, paths: np.ndarray) -> np.ndarray:
        """The row of the sequence that each path spells, -1 for none."""
        state, alive = np.zeros(len(paths), dtype=np.int64), np.ones(len(paths), dtype=bool)
        if not len(self.ids):
            return np.full(len(paths), -1)
        for k, arcs in enumerate(self.levels):
            word = np.minimum(np.searchsorted(self.ids, paths[:, k]), len(self.ids) - 1)
            alive &= self.ids[word] == paths[:, k]
            key = (state << np.int64(32)) | word
            state = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
            alive &= arcs[state] == key
        return np.where(alive, self.row[state], -1)
