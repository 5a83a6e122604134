"""An inverted index of reference texts, which tasks hold in memory while texts pass by once.

Normalized texts have 36 characters and the space, so a gram of five without spaces is a number below 37 ** 5: grams are
counted exactly, without hashes. Texts of any length and pools of any size are compared whole: long texts by pieces, pools
by blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from ..functions import text as T

GRAM = 5
BITS = 27  # 37 ** 5 is below 2 ** 27
#: Characters of texts that are looked up at once; pieces of longer ones.
CHUNK = 2 << 20
#: Characters of references in one block.
BLOCK = 2 << 20
#: Counts and postings of a group of texts that are held at once.
GROUP = 2 << 20
KINDS = ("normalized_exact_match", "normalized_containment", "token_jaccard_threshold", "character_5gram_jaccard_threshold")
STOP = frozenset(w.encode() for w in T.STOPWORDS)
_KEPT = bytes(b | 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_SYMBOL = np.array([b - 47 if 48 <= b <= 57 else b - 86 if 97 <= b <= 122 else 0 for b in range(256)], np.int32)


def words_in(text: str | None, nfkc: bool = True) -> list[bytes]:
    """The words of the normalized text, in order; no text has none."""
    if text is None:
        return []
    if not text.isascii():
        text = (unicodedata.normalize("NFKC", text) if nfkc else text).lower()
    return text.encode().translate(_KEPT).split()


def normalized(text: str | None, nfkc: bool = True) -> bytes:
    """What functions.text.normalize gives; no text gives an empty one."""
    return b" ".join(words_in(text, nfkc))


def words_of(words: list[bytes], filtered: bool) -> set[bytes]:
    out = set(words)
    if filtered:
        out -= STOP
    return out


def joined(words: list[bytes], filtered: bool) -> bytes:
    """The text that grams are taken from."""
    return b"".join([w for w in words if w not in STOP] if filtered else words)


def _groups(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of ``most`` together, or of a single one."""
    at = whole = i = 0
    for i, n in enumerate(sizes, 1):
        if whole and whole + n > most:
            yield at, i - 1
            at, whole = i - 1, 0
        whole += n
    if i > at:
        yield at, i


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _keys(pieces: list[tuple[int, bytes]]) -> np.ndarray:
    # a shorter piece is one gram, filled up by what no text has
    filled = [t if len(t) >= GRAM or not t else t + b" " * (GRAM - len(t)) for _, t in pieces]
    size = np.array([len(t) for t in filled], np.int64)
    s = _SYMBOL[np.frombuffer(b"".join(filled), np.uint8)]
    if not len(s):
        return np.zeros(0, np.int64)
    code = s[: len(s) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code *= 37
        code += s[k : len(s) - GRAM + 1 + k]
    end = np.cumsum(size)[size > 0]
    between = (end[:-1, None] - np.arange(1, GRAM)).ravel()  # grams that begin in one piece and end in the next
    owner = np.repeat(np.array([i for i, _ in pieces], np.int64) << BITS, np.maximum(0, size - GRAM + 1))
    owner += np.delete(code, between)
    return _distinct(owner)


def gram_keys(texts: list[bytes]) -> np.ndarray:
    """Sorted numbers of the different grams of each text: its place in the list and the gram; a shorter text is one gram."""
    pieces = [(i, t[at : at + CHUNK + GRAM - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - GRAM + 1), CHUNK)]
    parts = [_keys(pieces[a:b]) for a, b in _groups((len(t) for _, t in pieces), CHUNK)]
    return parts[0] if len(parts) == 1 else _distinct(np.concatenate([np.zeros(0, np.int64), *parts]))


class Postings:
    """Which references have each of the elements 0, 1, 2 ...; by pairs of element and reference, sorted by element."""

    def __init__(self, element: np.ndarray, ref: np.ndarray, n_refs: int):
        self.ref = ref.astype(np.int32)
        self.start = np.searchsorted(element, np.arange((element[-1] if len(element) else -1) + 2))
        self.sizes = np.bincount(ref, minlength=n_refs)

    def met(self, element: np.ndarray) -> np.ndarray:
        return self.start[element + 1] - self.start[element]

    def counts(self, text: np.ndarray, element: np.ndarray, n_texts: int) -> np.ndarray:
        """How many of its elements each text shares with each reference."""
        n = self.met(element)
        at = np.repeat(self.start[element] - np.cumsum(n) + n, n) + np.arange(n.sum())
        refs = len(self.sizes)
        return np.bincount(np.repeat(text * refs, n) + self.ref[at], minlength=n_texts * refs).reshape(n_texts, refs)


class Words:
    def __init__(self, texts: list[list[bytes]], filtered: bool):
        self.filtered = filtered
        sets = [words_of(t, filtered) for t in texts]
        self.number = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
        pairs = sorted((self.number[w], i) for i, s in enumerate(sets) for w in s)
        self.postings = Postings(np.array([e for e, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64), len(texts))

    @cached_property
    def known(self) -> set[bytes]:
        return set(self.number)

    def found(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The size of each text's set; text and element of what the references have too, sorted by text."""
        size, shared, elements = [], [], []
        for t in texts:
            words = words_of(t, self.filtered)
            both = words & self.known
            size.append(len(words))
            shared.append(len(both))
            elements.extend(map(self.number.__getitem__, both))
        return np.array(size, np.int64), np.repeat(np.arange(len(texts)), shared), np.array(elements, np.int64)


class Grams:
    def __init__(self, texts: list[list[bytes]], filtered: bool):
        self.filtered = filtered
        keys = gram_keys([joined(t, filtered) for t in texts])
        code, ref = keys & ((1 << BITS) - 1), keys >> BITS
        order = np.argsort(code, kind="stable")
        self.codes, element = np.unique(code[order], return_inverse=True)
        self.postings = Postings(element, ref[order], len(texts))

    @cached_property
    def maybe(self) -> np.ndarray:
        out = np.zeros(37**GRAM, bool)
        out[self.codes] = True
        return out

    def found(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = gram_keys([joined(t, self.filtered) for t in texts])
        size = np.diff(np.searchsorted(keys, np.arange(len(texts) + 1) << BITS))
        keys = keys[self.maybe[keys & ((1 << BITS) - 1)]]
        return size, keys >> BITS, np.searchsorted(self.codes, keys & ((1 << BITS) - 1))


def scores(o: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities of each text with each reference, 0 for empty sets."""
    return o / np.maximum(1, na[:, None] + nb - o)


class References:
    """One block of references (id, text), in the order of their places in the whole pool, from ``first`` on."""

    def __init__(self, ids: pa.Array, texts: list[list[bytes]], first: int, variant: str, similar: bool):
        self.ids, self.norms, self.first = ids, [b" ".join(t) for t in texts], first
        norms = self.norms
        self.length = np.array([len(t) for t in norms], np.int64)
        self.equal: dict[bytes, list[int]] = {}
        for i, t in enumerate(norms):
            self.equal.setdefault(t, []).append(i)
        self.words = Words(texts, variant != "base") if similar else None
        self.grams = Grams(texts, similar and variant == "all_filtered")
        # what holds a text has all of its grams, if no words are left out, else all between its first and last word, which may begin or end within others
        inner = [joined(t[1:-1], True) for t in texts] if self.grams.filtered else []
        self.least = np.diff(np.searchsorted(gram_keys(inner), np.arange(len(texts) + 1) << BITS)) if inner else self.grams.postings.sizes
        self.least[[i for i, t in enumerate(inner) if len(t) < GRAM]] = 0

    def may_hold(self, length: np.ndarray, n: np.ndarray, o: np.ndarray, words: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Pairs (text, reference) one of which may hold the other, by the texts' lengths and numbers of grams, the grams shared, and the same of words."""
        long = (length[:, None] >= T.CONTAINMENT_MIN_CHARS) & (self.length >= T.CONTAINMENT_MIN_CHARS)
        if not self.grams.filtered:
            return np.argwhere(long & (length[:, None] != self.length) & ((o == n[:, None]) | (o == self.least)))
        size, shared = words
        held = (length[:, None] > self.length) & (o >= self.least) & (shared >= self.words.postings.sizes - 2)
        return np.argwhere(long & (held | (length[:, None] < self.length) & (shared >= size[:, None] - 2)))

    def meet(self, norms: list[bytes], texts: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """By groups of texts: the first one's place, pairs (text in the group, reference) that are equal, and held, and the scores of words and of grams."""
        if not norms or not self.norms:
            return
        metrics = [m for m in (self.words, self.grams) if m]
        found = {m: m.found(texts) for m in metrics}
        cost = np.full(len(norms), len(self.norms))
        for m, (_, text, element) in found.items():
            cost = np.maximum(cost, np.bincount(text, m.postings.met(element), len(norms)).astype(np.int64))
        length = np.array([len(t) for t in norms], np.int64)
        for a, b in _groups(cost.tolist(), GROUP):
            o = {}
            for m, (_, text, element) in found.items():
                lo, hi = np.searchsorted(text, (a, b))
                o[m] = m.postings.counts(text[lo:hi] - a, element[lo:hi], b - a)
            sizes = {m: found[m][0][a:b] for m in metrics}
            equal = [(i, j) for i in range(b - a) for j in self.equal.get(norms[a + i], ())]
            may = self.may_hold(length[a:b], sizes[self.grams], o[self.grams], (sizes[self.words], o[self.words]) if self.words else None)
            held = [(i, j) for i, j in may.tolist() if norms[a + i] in self.norms[j] or self.norms[j] in norms[a + i]]
            similar = [scores(o[m], sizes[m], m.postings.sizes) for m in metrics if self.words]
            yield a, np.array(equal, np.int64).reshape(-1, 2), np.array(held, np.int64).reshape(-1, 2), similar


def chunks(batches: Iterable[pa.RecordBatch], nfkc: bool) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """ids and words of rows (id, text), so many at once."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in _groups((len(t or "") + 64 for t in texts), CHUNK):
            yield batch.column(0).slice(a, b - a), [words_in(t, nfkc) for t in texts[a:b]]


def collisions(refs: References, batches: Iterable[pa.RecordBatch], nfkc: bool) -> Iterator[pa.RecordBatch]:
    """left_id, kind, right_id, score of texts that collide; equal and held ones alone without words and grams."""
    kinds = pa.array(KINDS)
    for ids, texts in chunks(batches, nfkc):
        some = [i for i, t in enumerate(texts) if t]
        texts = [texts[i] for i in some]
        for at, equal, held, similar in refs.meet([b" ".join(t) for t in texts], texts):
            pairs, kind, score = [equal, held], [np.full(len(equal), 0), np.full(len(held), 1)], [np.zeros(len(equal) + len(held))]
            for k, (s, least) in enumerate(zip(similar, (T.TOKEN_THRESHOLD, T.GRAM_THRESHOLD)), 2):
                pairs.append(near := np.argwhere(s >= least))
                kind.append(np.full(len(near), k))
                score.append(s[near[:, 0], near[:, 1]])
            both, kind = np.concatenate(pairs), np.concatenate(kind)
            if len(both):
                left = ids.take(pa.array(np.array(some)[both[:, 0] + at]))
                yield pa.RecordBatch.from_arrays([left, kinds.take(pa.array(kind)), refs.ids.take(pa.array(both[:, 1])), pa.array(np.concatenate(score), mask=kind < 2)], ["left_id", "kind", "right_id", "score"])


def best(refs: References, batches: Iterable[pa.RecordBatch], nfkc: bool, largest_label: bool) -> Iterator[pa.RecordBatch]:
    """Of every text left_id, fatal (any collision), and the score, place and right_id of the best reference by words and by grams, null without any."""
    for ids, texts in chunks(batches, nfkc):
        some = np.array([i for i, t in enumerate(texts) if t], np.int64)
        fatal, top = np.zeros(len(texts), bool), np.zeros((2, len(texts)))
        where = np.full((2, len(texts)), -1)
        texts = [texts[i] for i in some]
        for at, equal, held, similar in refs.meet([b" ".join(t) for t in texts], texts):
            rows = some[at : at + len(similar[0])]
            fatal[rows[equal[:, 0]]] = fatal[rows[held[:, 0]]] = True
            for k, (s, least) in enumerate(zip(similar, (T.TOKEN_THRESHOLD, T.GRAM_THRESHOLD))):
                j = s.shape[1] - 1 - s[:, ::-1].argmax(1) if largest_label else s.argmax(1)
                top[k, rows] = high = s[np.arange(len(s)), j]
                where[k, rows] = np.where(high > 0, j, -1)
                fatal[rows] |= high >= least
        out = [ids, pa.array(fatal)]
        for k in range(2):
            none = where[k] < 0
            at = pa.array(where[k], mask=none)
            out += [pa.array(top[k], mask=none), pa.array(where[k] + refs.first, mask=none), refs.ids.take(at)]
        yield pa.RecordBatch.from_arrays(out, ["left_id", "fatal", *(f"{m}{x}" for m in ("token", "gram") for x in ("", "_place", "_nearest"))])


def blocks(rows: Iterable[tuple], id_type: pa.DataType, nfkc: bool, variant: str = "base", similar: bool = True) -> Iterator[References]:
    """The pool (id, text) by blocks, one at least; texts that normalize to nothing are left out."""
    ids, texts, held, first = [], [], 0, 0
    for i, text in rows:
        if t := words_in(text, nfkc):
            ids.append(i)
            texts.append(t)
            held += sum(map(len, t)) + len(t) - 1
        if held >= BLOCK:
            yield References(pa.array(ids, id_type), texts, first, variant, similar)
            first, ids, texts, held = first + len(ids), [], [], 0
    if ids or not first:
        yield References(pa.array(ids, id_type), texts, first, variant, similar)
