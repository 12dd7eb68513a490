"""Problem 6: evaluation passages that leaked into documents.

Passages are cut into fragments of ``FRAGMENT`` letters (the text joined up: case, layout, entities and punctuation gone), and
all fragments are searched at once by Wu-Manber: a shift table over blocks of ``BLOCK`` letters skips positions where no
fragment can end, a hash of the last block selects the few fragments that can, and direct comparison confirms them. A batch of
documents is searched in many lanes side by side, each with its own position.

Fragments can't see pieces whose words are misspelt or changed here and there. For these, words of the text that are the same
as passage words (one edit apart at most) are found through shared deletions, and two of them at most two words apart, in
text and passage, make a *near pair*. A local alignment with more hits than changed, missing or added words has near pairs
in at least half of the gaps between its hits, and so has each beginning of it, being one itself. So a document with fewer
near pairs, or without a place where enough of them lie together, carries no third of a passage: nothing is lost by it.

What either way finds is checked exactly: a local alignment of words, twice (the best piece and the best other piece),
counts how many of the passage's words the text carries as running text. A piece lies within two passages' lengths of
its near pairs, so only these stretches are aligned, in texts of any length.

Only the passages travel: they are read in blocks of at most ``ITEMS_PER_BLOCK`` items and ``BLOCK_CHARS`` characters; the
tables of a block are built once and broadcast. Documents are never shuffled, and read once for each block.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAGMENT = 12
BLOCK = 4
TABLE_BITS = 18
LANE = 256
#: Documents are taken together until they have so many letters.
BATCH_CHARS = 1_500_000
ITEMS_PER_BLOCK = 50_000
BLOCK_CHARS = 16_000_000
#: Share of a passage's fragments from which a document is looked at closely.
LEAST_FRAGMENTS = 0.15
#: Share of a passage's words from which it has leaked, and the least share of a second piece that counts.
SHARE = 1 / 3
LEAST_PIECE = 0.08
#: A few words in common are no leak: at least so many words, or all where a passage has fewer.
LEAST_WORDS = 4
CACHE = 500_000
#: Cells of matrices that are aligned together.
SIDE_BY_SIDE = 1 << 20

_INVISIBLE = re.compile("[­᠎​-‏ -‮⁠-⁤﻿]")
#: Tags by their grammar: a name, then attributes with a value. Other text between < and > stays text.
_TAG = re.compile(r"<(?:/[A-Za-z][\w:-]*\s*|!--.*?--|[A-Za-z][\w:-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))*\s*/?)>", re.S)
_SAID = re.compile(r"=\s*(?:\"([^\"]*)\"|'([^']*)')|<!--(.*?)--", re.S)
_BROKEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_ACCENT = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+(?:[ऀ-෿]+[^\W_]*)*")


def _untagged(text: str) -> str:
    """``text`` without tags. What their quoted values and comments say comes after the text, so that it is searched too."""
    said = []

    def tag(m: re.Match) -> str:
        said.extend(x for found in _SAID.findall(m.group()) for x in found if x)
        return " "

    text = _TAG.sub(tag, text)
    return "\n".join([text, *said]) if said else text


def words(text: str | None) -> list[str]:
    """Words as they are compared: entities resolved, tags, invisible characters and accents gone, words broken at line ends
    joined, compatibility forms unified, lower case. Marks of Indic scripts stay part of their words. Null gives none.
    Only what has the form of a tag is taken for one; of its quoted values the words are kept, at the end."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "<" in t:
        t = _untagged(t)
    if not t.isascii():
        t = _ACCENT.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", t)))
    return _WORD.findall(_BROKEN.sub("", t).lower())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


class WuManber:
    """Search for many patterns of one length."""

    def __init__(self, patterns: list[str], length: int = FRAGMENT):
        """Patterns of another length than ``length`` are not allowed; repeats are found once."""
        self.m = length
        self.patterns = sorted(set(patterns))
        mat = np.stack([_codes(p) for p in self.patterns]) if self.patterns else np.zeros((0, length), np.uint32)
        self.matrix = mat.astype(np.uint32)
        self.shift = np.full(1 << TABLE_BITS, length - BLOCK + 1, dtype=np.uint8)
        for end in range(BLOCK, length + 1):
            h = self._hash([self.matrix[:, end - BLOCK + k] for k in range(BLOCK)])
            np.minimum.at(self.shift, h, np.uint8(length - end))
        tail = self._hash([self.matrix[:, length - BLOCK + k] for k in range(BLOCK)])
        self.order = np.argsort(tail, kind="stable")
        keys, first, count = np.unique(tail[self.order], return_index=True, return_counts=True) if len(tail) else (np.zeros(0, np.int64),) * 3
        self.first = np.zeros(1 << TABLE_BITS, dtype=np.int32)
        self.count = np.zeros(1 << TABLE_BITS, dtype=np.int32)
        self.first[keys], self.count[keys] = first, count

    @staticmethod
    def _hash(cols: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(cols[0]), dtype=np.uint64)
        for c in cols:
            h = h * np.uint64(1_000_003) + c.astype(np.uint64)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start positions, pattern numbers) of all occurrences in ``text`` (code points)."""
        n, m = len(text), self.m
        if n < m or not self.patterns:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.arange(m, n + 1, LANE, dtype=np.int64)  # a window ends before pos
        stop = np.minimum(pos + LANE, n + 1)
        starts, which = [], []
        while len(pos):
            h = self._hash([text[pos - BLOCK + k] for k in range(BLOCK)])
            step = self.shift[h].astype(np.int64)
            at = step == 0
            if at.any():
                hh, p = h[at], pos[at]
                c = self.count[hh]
                rep = np.repeat(np.arange(len(hh)), c)
                offset = np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c)
                cand, begin = self.order[self.first[hh][rep] + offset], p[rep] - m
                good = np.ones(len(cand), bool)
                for k in range(m):  # the first letters tell most apart
                    good[good] = text[begin[good] + k] == self.matrix[cand[good], k]
                    if not good.any():
                        break
                starts.append(begin[good])
                which.append(cand[good])
                step[at] = 1
            pos = pos + step
            keep = pos < stop
            pos, stop = pos[keep], stop[keep]
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def same_word(a: str, b: str) -> bool:
    """Equal, or one edit (Damerau) apart where both have four letters or more."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if n < 4 or m < 4 or abs(n - m) > 1:
        return False
    k = 0
    while k < min(n, m) and a[k] == b[k]:
        k += 1
    if n == m:
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if n > m else a[k:] == b[k + 1 :]


def _csr(lists: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(first, values) of lists laid one after the other; list k is values[first[k] : first[k + 1]]."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return first, np.fromiter((v for x in lists for v in x), np.int64, int(first[-1]))


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists ``rows``: (which row, index of value) of each of their values."""
    n = first[rows + 1] - first[rows]
    which = np.repeat(np.arange(len(rows)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[rows][which]


class Vocabulary(dict):
    """Word of a text -> number of its *reading*, the set of passage words that it is the same as; 0 for none. Each word is
    looked at once: passage words of four letters or more are found under themselves and all their deletions."""

    def __init__(self, passages: list[list[str]]):
        super().__init__()
        self.types = {w: k for k, w in enumerate(sorted({w for p in passages for w in p}))}
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.types:
            if len(w) >= 4:
                for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                    self.near[x].append(w)
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.readings: list[tuple[int, ...]] = [()]
        self.numbers: dict[tuple[int, ...], int] = {(): 0}

    def same(self, word: str) -> tuple[int, ...]:
        found = {self.types[word]} if word in self.types else set()
        if 4 <= len(word):
            for x in {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))} if len(word) <= 64 else {word}:
                found.update(self.types[w] for w in self.near.get(x, ()) if same_word(w, word))
        return tuple(sorted(found))

    def __missing__(self, word: str) -> int:
        types = self.same(word)
        k = self.numbers.get(types)
        if k is None:
            k = self.numbers[types] = len(self.readings)
            self.readings.append(types)
        self[word] = k
        return k

    def read(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Readings of the words of all texts, two empty ones after each text, and where each text starts."""
        if len(self) > CACHE:
            self._clear()
        sizes = np.array([len(w) + 2 for w in split], dtype=np.int64)
        get = self.__getitem__
        flat = np.fromiter((k for w in split for k in (*map(get, w), 0, 0)), np.int64, int(sizes.sum()))
        return flat, np.cumsum(sizes) - sizes


def pieces(matches: list[np.ndarray], free: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Of each match matrix, (first row, last row + 1, matched rows) of the best local alignment over the free rows; a mismatch
    or gap costs one match. Matrices of like size are aligned side by side."""
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(matches)
    order = sorted(range(len(matches)), key=lambda k: matches[k].shape[::-1])
    while order:
        k = len(order)
        while k > 1 and k * (matches[order[k - 1]].shape[1] + 1) * max(matches[x].shape[0] + 1 for x in order[:k]) > SIDE_BY_SIDE:
            k = (k + 1) // 2
        part, order = order[:k], order[k:]
        n, m = max(matches[x].shape[0] for x in part), matches[part[-1]].shape[1]
        kind = np.int16 if n + m < 1 << 14 else np.int32
        s, use = np.zeros((n, len(part), m), kind), np.zeros((n, len(part)), bool)
        for b, x in enumerate(part):
            rows, cols = matches[x].shape
            s[:rows, b, :cols][matches[x]] = 2
            use[:rows, b] = free[x]
        # scores are kept as score + column: going right then costs nothing, and going down or across adds 2 for a match
        ramp = np.arange(m + 1, dtype=kind)
        g, every = np.empty((n + 1, len(part), m + 1), kind), use.all(axis=1)
        g[0] = ramp
        for i in range(1, n + 1):
            t = g[i]
            np.subtract(g[i - 1], 1, out=t)
            np.maximum(t, ramp, out=t)
            np.maximum(t[:, 1:], g[i - 1, :, :-1] + s[i - 1], out=t[:, 1:])
            np.maximum.accumulate(t, axis=1, out=t)
            if not every[i - 1]:
                t[~use[i - 1]] = ramp
        for b, x in enumerate(part):
            rows, cols = matches[x].shape
            out[x] = _trace(g[: rows + 1, b, : cols + 1] - ramp[: cols + 1], s[:, b])
    return out


def _trace(h: np.ndarray, s: np.ndarray) -> tuple[int, int, int]:
    """The way back from the best score to where its alignment begins."""
    i, j = divmod(int(h.argmax()), h.shape[1])
    last, hits = i, 0
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + s[i - 1, j - 1] - 1:
            hits += bool(s[i - 1, j - 1])
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return i, last, hits


def dense(at: np.ndarray, place: np.ndarray, hits: int) -> bool:
    """Whether as many near pairs as ``hits`` hits have lie together: after one of them, at different words of the passage, in less
    than ``2 hits`` words of text and shifted by less than ``hits`` against it. ``at`` is ascending."""
    need = hits // 2
    if need <= 1:
        return len(at) >= need
    if len(at) < need:
        return False
    shift = at - place
    for k in range(len(at) - need + 1):
        end = int(np.searchsorted(at, at[k] + 2 * hits))
        if end - k >= need and len(set(place[k:end][np.abs(shift[k:end] - shift[k]) < hits].tolist())) >= need:
            return True
    return False


def carried(texts: list[list[np.ndarray]], near: list[tuple[np.ndarray, np.ndarray] | None]) -> list[tuple[int, int]]:
    """For each text: how many of a passage's words it carries as running text, and in how many pieces: the best one, or, where
    that alone is no leak, the two best. A text is given as match matrices of the passage's words (rows) and its stretches,
    and ``near`` has its near pairs (None, where a piece needs none): positions in text and passage."""
    free = [np.ones(x[0].shape[0], bool) for x in texts]
    best = _best(texts, free, range(len(texts)))
    out, again = {k: (hits, 1) for k, (_, _, hits) in best.items()}, []
    for k, (a, b, hits) in best.items():
        n = len(free[k])
        free[k][a:b] = False
        two = least_words(n) - hits  # what a second piece must bring; half of that it has near pairs
        left = None if near[k] is None else free[k][near[k][1]]
        if two > 0 and (near[k] is None or dense(near[k][0][left], near[k][1][left], two)):
            again.append(k)
    for k, (_, _, two) in _best(texts, free, again).items():
        if two >= LEAST_PIECE * len(free[k]):
            out[k] = (out[k][0] + two, 2)
    return [out[k] for k in range(len(texts))]


def _best(texts: list[list[np.ndarray]], free: list[np.ndarray], which) -> dict[int, tuple[int, int, int]]:
    """The piece of most words among those of all stretches of each text in ``which``."""
    owner = [k for k in which for _ in texts[k]]
    out: dict[int, tuple[int, int, int]] = {}
    for k, piece in zip(owner, pieces([m for k in which for m in texts[k]], [free[k] for k in owner])):
        if k not in out or piece[2] > out[k][2]:
            out[k] = piece
    return out


def least_words(n: int) -> int:
    """Words of a passage of ``n`` from which it has leaked."""
    return max(math.ceil(SHARE * n - 1e-9), min(n, LEAST_WORDS))


class Searcher:
    """The tables of all passages of a block of items; they can be pickled."""

    def __init__(self, items: list[tuple[int, str]]):
        """Items without words are skipped; passages shorter than a fragment are found by their words alone."""
        split = [(i, w) for i, t in items if (w := words(t))]
        self.items, self.passages = [i for i, _ in split], [w for _, w in split]
        self.vocabulary = Vocabulary(self.passages)
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        pairs: dict[int, list[int]] = defaultdict(list)
        self.longest = max((len(w) for w in self.passages), default=1)
        singles: dict[int, list[int]] = defaultdict(list)
        self.numbered = []
        for i, w in enumerate(self.passages):
            joined = "".join(w)
            for k in range(0, len(joined) - FRAGMENT + 1, FRAGMENT):
                owners[joined[k : k + FRAGMENT]].append((i, k))
            t = [self.vocabulary.types[x] for x in w]
            self.numbered.append(np.array(t))
            for gap in (1, 2):
                for k, (a, b) in enumerate(zip(t, t[gap:])):
                    pairs[a * len(self.vocabulary.types) + b].append(i * self.longest + k)
            if len(w) <= 3:  # so short that a leak need have no near pair
                for x in t:
                    singles[x].append(i)
        self.engine = WuManber(list(owners))
        self.fragments = [owners[p] for p in self.engine.patterns]
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.first, self.owner = _csr([tuple(pairs[k]) for k in self.keys])
        self.singles = dict(singles)
        self.least = np.array([max(1, math.ceil(LEAST_FRAGMENTS * (len("".join(w)) // FRAGMENT))) for w in self.passages], dtype=np.int64)
        need = np.array([least_words(len(w)) for w in self.passages], dtype=np.int64)
        self.need = np.maximum(1, (need - 1) // 2)  # (need - 2) / 2, rounded up: near pairs of two pieces
        self.start = (need + 1) // 2  # hits that the larger piece begins with at least

    def _fragments(self, split: list[list[str]]) -> set[tuple[int, int]]:
        """(document, passage) where enough of the passage's fragments occur."""
        joined = ["".join(w) for w in split]
        sizes = np.array([len(x) + 1 for x in joined], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        at, which = self.engine.find(_codes("\0".join(joined) + "\0"))
        hits: dict[tuple[int, int], set] = defaultdict(set)
        for doc, k in zip((np.searchsorted(starts, at, side="right") - 1).tolist(), which.tolist()):
            for item, offset in self.fragments[k]:
                hits[doc, item].add(offset)
        return {x for x, seen in hits.items() if len(seen) >= self.least[x[1]]}

    def _near_pairs(self, flat: np.ndarray, first: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the text, passage, position in it) of each near pair."""
        at, who, n = [], [], len(self.vocabulary.types)
        for gap in (1, 2):
            t = np.flatnonzero((flat[:-gap] > 0) & (flat[gap:] > 0)) if len(flat) > gap else np.zeros(0, np.int64)
            x, k = _spread(first, flat[t])
            t, a = t[x], types[k]
            x, k = _spread(first, flat[t + gap])
            key, t = a[x] * n + types[k], t[x]
            where = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            good = self.keys[where] == key if len(self.keys) else np.zeros(len(key), bool)
            x, k = _spread(self.first, where[good])
            at.append(t[good][x])
            who.append(self.owner[k])
        place = np.concatenate(who)
        return np.concatenate(at), place // self.longest, place % self.longest

    def _places(self, flat: np.ndarray, starts: np.ndarray, first: np.ndarray, types: np.ndarray, close: set) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(document, passage) -> positions of its near pairs in text (ascending) and passage, where there are enough of them or which is in ``close``.

        Enough: they begin at as many different words of the passage as two pieces have near pairs, and somewhere as many of
        them as the first ``start`` hits of a piece have lie together. These hits span less than ``2 start`` words of text, and
        text and passage shift by less than ``start`` against each other: both lie in one of two overlapping bins.
        """
        at, who, place = self._near_pairs(flat, first, types)
        n, m = len(self.passages), self.longest
        group = (np.searchsorted(starts, at, side="right") - 1) * n + who
        known = np.array(sorted(d * n + i for d, i in close), dtype=np.int64)
        seen, k = np.unique(np.unique(group * m + place) // m, return_counts=True)
        enough = seen[k >= self.need[seen % n]]
        some = np.isin(group, enough)
        a, g, p = at[some], group[some], place[some]
        start = np.maximum(1, self.start[g % n])
        cells = []
        for x in (0, 1):
            for y in (0, 1):
                t, shift = (a + x * 2 * start) // (4 * start), (a - p + y * start) // (2 * start)
                order = np.lexsort((p, shift, t, g))
                rows = np.stack([g[order], t[order], shift[order], p[order]])
                new = np.ones(len(order), bool)
                new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
                rows = rows[:3, new]
                head = np.ones(rows.shape[1], bool)
                head[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
                at_head = np.flatnonzero(head)
                size = np.diff(np.append(at_head, len(head)))
                owner = rows[0, at_head]
                cells.append(owner[size >= self.start[owner % n] // 2])
        wanted = np.unique(np.concatenate([known, *cells]))
        some = np.isin(group, wanted)
        a, g, p = at[some], group[some], place[some]
        order = np.lexsort((a, g))
        a, g, p = a[order], g[order], p[order]
        lo, hi = np.searchsorted(g, wanted, side="left"), np.searchsorted(g, wanted, side="right")
        return {divmod(int(w), n): (a[i:j], p[i:j]) for w, i, j in zip(wanted, lo, hi)}

    def search(self, ids: list, texts: list[str | None]) -> list[tuple]:
        """(doc_id, item_id, share, pieces) of the documents that carry enough of an item's passage."""
        if not self.passages:
            return []
        split = [words(t) for t in texts]
        flat, starts = self.vocabulary.read(split)
        first, types = _csr(self.vocabulary.readings)
        places = self._places(flat, starts, first, types, self._fragments(split))
        if self.singles:
            for d, w in enumerate(split):
                for i in {i for k in set(flat[starts[d] : starts[d] + len(w)].tolist()) for x in self.vocabulary.readings[k] for i in self.singles.get(x, ())}:
                    places.setdefault((d, i), (np.zeros(0, np.int64),) * 2)
        out, todo, cells = [], [], 0
        for (d, i), (near, place) in places.items():
            n = len(self.passages[i])
            texts_of = [self._matches(i, flat[a:b], first, types) for a, b in self._stretches(i, near, int(starts[d]), len(split[d]))]
            if texts_of and np.logical_or.reduce([m.any(axis=1) for m in texts_of]).sum() >= least_words(n):
                todo.append((d, i, texts_of, (near, place) if LEAST_PIECE * n > 1 else None))
                cells += sum(m.size for m in texts_of)
            if cells > 16 * SIDE_BY_SIDE:
                out += self._leaks(ids, todo)
                todo, cells = [], 0
        return out + self._leaks(ids, todo)

    def _leaks(self, ids: list, todo: list) -> list[tuple]:
        found = zip(todo, carried([m for _, _, m, _ in todo], [p for _, _, _, p in todo]))
        size = lambda i: len(self.passages[i])
        return [(ids[d], self.items[i], hits / size(i), n) for (d, i, _, _), (hits, n) in found if hits >= least_words(size(i))]

    def _stretches(self, item: int, near: np.ndarray, start: int, size: int) -> list[tuple[int, int]]:
        """Parts of a text (of ``size`` words, from ``start`` on) that can hold a piece: two passages' lengths around near pairs.
        All of it for passages of which a single word can be a piece."""
        n = len(self.passages[item])
        if LEAST_PIECE * n <= 1:
            return [(start, start + size)]
        out: list[tuple[int, int]] = []
        if len(near):
            breaks = np.flatnonzero(np.diff(near) > 4 * n + 2)
            heads, tails = near[np.append(0, breaks + 1)], near[np.append(breaks, len(near) - 1)]
            out = [(max(start, int(a) - 2 * n), min(start + size, int(b) + 2 * n + 2)) for a, b in zip(heads, tails)]
        return out

    def _matches(self, item: int, part: np.ndarray, first: np.ndarray, types: np.ndarray) -> np.ndarray:
        """Which of the passage's words (rows) the words of a part of a text (columns) are the same as."""
        x, k = _spread(first, part)
        passage = self.numbered[item]
        out = np.zeros((len(passage), len(part)), bool)
        row, col = np.nonzero(passage[:, None] == types[k][None, :])
        out[row, x[col]] = True
        return out


def blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The (item_id, passage) rows in blocks whose size is bounded. Null ids and passages are dropped; of a repeated id the
    smallest passage counts."""
    rows = items.where("item_id IS NOT NULL AND passage IS NOT NULL").groupBy("item_id").agg(F.min("passage").alias("passage")).orderBy("item_id")
    out, chars = [[]], 0
    for r in rows.toLocalIterator():
        if out[-1] and (len(out[-1]) >= ITEMS_PER_BLOCK or chars + len(r.passage) > BLOCK_CHARS):
            out.append([])
            chars = 0
        out[-1].append((r.item_id, r.passage))
        chars += len(r.passage)
    return [b for b in out if b]


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share, pieces) of each document and item where the document carries at least SHARE of the passage's
    words, and LEAST_WORDS of them or all.

    ``items``: (item_id, passage). Null and empty texts carry nothing; repeated texts are reported for each ``doc_id``;
    an empty table on either side gives an empty result. Texts are searched whole.
    """
    schema = "doc_id bigint, item_id bigint, share double, pieces int"
    spark, found = documents.sparkSession, None
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(Searcher(block))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            searcher = shared.value
            for f in frames:
                ids, texts, size = [], [], 0
                for d, t in zip(f["doc_id"], f["text"]):
                    ids.append(d)
                    texts.append(t)
                    size += len(t or "")
                    if size >= BATCH_CHARS:
                        yield pd.DataFrame(searcher.search(ids, texts), columns=["doc_id", "item_id", "share", "pieces"])
                        ids, texts, size = [], [], 0
                if ids:
                    yield pd.DataFrame(searcher.search(ids, texts), columns=["doc_id", "item_id", "share", "pieces"])

        part = documents.select("doc_id", "text").mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def passages(eval_items: DataFrame) -> DataFrame:
    """(item_id, passage): the second line of an item, its only line where there is one."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return eval_items.select("item_id", F.coalesce(F.get(lines, F.lit(1)), F.get(lines, F.lit(0))).alias("passage"))
