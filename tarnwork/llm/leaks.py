"""Evaluation passages inside a training corpus.

Passages and documents are cut into windows of words. A CGK random walk embeds a window: reading it with a pointer that at
each step stays or moves on, as a random function of step and symbol says, turns a small edit distance of windows into a small
Hamming distance of their images. Bit-sampling LSH looks at a few random places of the image; windows that agree there in one
of the repetitions are candidates, and their exact edit distance decides. Repetitions follow from the recall wanted.

The search runs on two scales. Long windows with edits find what stands in a document whole or in part, altered or not. Windows
of one run (five words) without an edit come last: equal windows have equal images in every walk, so nothing that shares a run
can be missed, however scattered it stands. Of each pair of document and item found, the share of the item's distinct runs in
the document is then counted exactly.

The passages are the query set: their words go to every task in blocks of bounded size, and each worker process makes a
block's index once. The corpus is read in one pass, whatever the number of blocks; no row of it is shuffled, so hot sources and
repeated texts cost nothing extra.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tarnwork.llm.words import word_ids

_PAD = np.uint64(0x9E3779B97F4A7C15)
#: Words of a run, the unit in which a leak is measured.
RUN = 5
#: Windows worked on at a time (their arrays stay in the processor's cache), and pairs expanded at a time.
_CHUNK, _PAIRS = 1 << 15, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Embedding:
    """Random walks of 2 * ``width`` steps over windows of ``width`` words (32 at most), each sampled at ``places`` of them.
    Documents are looked at every ``stride`` words, items at every word, so no alignment is lost."""

    width: int = RUN
    max_edits: int = 0
    places: int = 5
    target_recall: float = 0.95
    stride: int = 1
    seed: int = 17

    def __post_init__(self) -> None:
        if not 1 <= self.width <= 32:
            raise ValueError("windows have 1 to 32 words")

    @property
    def repetitions(self) -> int:
        """So many that a window with ``max_edits`` edits is met with ``target_recall``. An edit shifts the walks against each
        other until they meet again, which spoils about 3 of the 2 * width places. (A rule of thumb; a test measures it.)"""
        if not self.max_edits:
            return 1
        hit = max(1 - 3 * self.max_edits / (2 * self.width), 0.05) ** self.places
        return max(1, math.ceil(math.log(1 - self.target_recall) / math.log(1 - hit)))

    def keys(self, tokens: np.ndarray, starts: np.ndarray, r: int) -> np.ndarray:
        """Bucket keys of the windows of ``tokens`` at ``starts`` in repetition ``r``."""
        rng = np.random.default_rng([self.seed, self.width, r])
        steps = 2 * self.width
        sampled = set(rng.choice(steps, min(self.places, steps), replace=False).tolist())
        salt = np.uint64(rng.integers(1 << 63))
        padded = np.append(tokens, _PAD)
        coins = _mix(padded ^ salt)
        out = np.empty(len(starts), np.uint64)
        last, end = len(tokens), max(sampled)
        for lo in range(0, len(starts), _CHUNK):
            own = starts[lo : lo + _CHUNK]
            at = own.copy()
            key = np.full(len(at), salt, np.uint64)
            for j in range(end + 1):
                # a walk cannot leave its window before step ``width``
                place = at if j < self.width else np.where(at < own + self.width, at, last)
                if j in sampled:
                    key = _mix(key ^ padded[place])
                at += ((coins[place] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
            out[lo : lo + _CHUNK] = key
        return out


#: Long windows with up to 3 edits in 16 words, then single runs.
SCALES = (Embedding(width=16, max_edits=3, places=4, target_recall=0.75, stride=4), Embedding())


def edit_distances(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Levenshtein distance of each row of ``a`` to the same row of ``b``, of the same width; exact up to ``most``, and more
    than that beyond (only the diagonals that matter are worked out)."""
    n, w = a.shape
    most = w if most is None else most
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(n, w + 1, np.int16)
    prev = [np.full(n, j, np.int16) if j <= most else far for j in range(w + 1)]
    for i in range(1, w + 1):
        cur = [far] * (w + 1)
        if i <= most:
            cur[0] = np.full(n, i, np.int16)
        for j in range(max(1, i - most), min(w, i + most) + 1):
            cur[j] = np.minimum(np.minimum(cur[j - 1], prev[j]) + np.int16(1), prev[j - 1] + (a[i - 1] != b[j - 1]))
        prev = cur
    return prev[w]


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two token arrays, a row at a time."""
    prev = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        cur = np.empty_like(prev)
        cur[0] = i + 1
        cur[1:] = np.minimum(prev[1:] + 1, prev[:-1] + (b != x))
        prev = np.minimum.accumulate(cur - np.arange(len(cur))) + np.arange(len(cur))
    return int(prev[-1])


def _windows(tokens: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(tokens, width) if len(tokens) >= width else np.zeros((0, width), np.uint64)


def _run_keys(tokens: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each run of ``tokens``."""
    n = max(len(tokens) - RUN + 1, 0)
    key = np.zeros(n, np.uint64)
    for j in range(RUN):
        key = _mix(key ^ tokens[j : j + n])
    return key


class _Scale:
    """The windows of a block of items, indexed by the embedding of one scale; equal windows once, with their items."""

    def __init__(self, tokens: list[np.ndarray], emb: Embedding, keep: list[np.ndarray] | None = None):
        self.emb = emb
        wins = [_windows(t, emb.width) for t in tokens]
        if keep is not None:
            wins = [w[k] for w, k in zip(wins, keep)]
        owner = np.repeat(np.arange(len(tokens)), [len(w) for w in wins])
        all_wins = np.concatenate(wins) if wins else np.zeros((0, emb.width), np.uint64)
        # distinct windows; owner pairs sorted by window
        self.wins, at = np.unique(all_wins, axis=0, return_inverse=True) if len(all_wins) else (all_wins, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([at.ravel(), owner]), axis=1) if len(all_wins) else np.zeros((2, 0), np.int64)
        self.items = pairs[1]
        self.first = np.searchsorted(pairs[0], np.arange(len(self.wins) + 1))
        flat = np.ascontiguousarray(self.wins).reshape(-1)
        starts = np.arange(len(self.wins)) * emb.width
        self.keys = []
        for r in range(emb.repetitions):
            k = emb.keys(flat, starts, r)
            order = np.argsort(k, kind="stable")
            self.keys.append((k[order], order))

    def hits(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, row of ``wins``), distinct, of all candidates that are within the edits allowed."""
        out = []
        for r, (keys, order) in enumerate(self.keys):
            if not len(keys) or not len(starts):
                continue
            k = self.emb.keys(tokens, starts, r)
            lo = np.searchsorted(keys, k, "left")
            near = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == k)
            if not len(near):
                continue
            lo, n = lo[near], np.searchsorted(keys, k[near], "right") - lo[near]
            for a, b in _slices(n, _PAIRS):
                m = n[a:b]
                at = np.repeat(starts[near[a:b]], m)
                row = order[np.repeat(lo[a:b] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())]
                mine = tokens[at[:, None] + np.arange(self.emb.width)]
                ok = edit_distances(mine, self.wins[row], self.emb.max_edits) <= self.emb.max_edits if self.emb.max_edits else (mine == self.wins[row]).all(axis=1)
                out.append(np.stack([at[ok], row[ok]]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, row = np.unique(np.concatenate(out, axis=1), axis=1)
        return at, row

    def pairs(self, tokens: np.ndarray, starts: np.ndarray, doc: np.ndarray, items: int) -> np.ndarray:
        """Codes doc * items + item, distinct, of what the windows at ``starts``, of documents ``doc``, are found in."""
        at, row = self.hits(tokens, starts)
        found = np.unique(np.stack([doc[np.searchsorted(starts, at)], row]), axis=1)
        n = self.first[found[1] + 1] - self.first[found[1]]
        out = [np.zeros(0, np.int64)]
        for a, b in _slices(n, _PAIRS):
            m = n[a:b]
            k = self.items[np.repeat(self.first[found[1][a:b]] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())]
            out.append(np.unique(np.repeat(found[0][a:b], m) * items + k))
        return np.unique(np.concatenate(out))


def _slices(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``n`` whose sums are about ``most`` at most."""
    if not len(n):
        return
    group = (np.cumsum(n) - n) // most
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(n))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


class Index:
    """A block of items (id, passage or its words), searched on every scale.

    Of an item's runs only the rarest are indexed for the last scale: a document with ``min_share`` of them all cannot have
    only runs from among the most frequent, so wording that all items share makes no pairs.
    """

    def __init__(self, items: list[tuple[int, str | np.ndarray | None]], scales: tuple[Embedding, ...] = SCALES, min_share: float = 0.3):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.tokens = [p if isinstance(p, np.ndarray) else word_ids(p) for _, p in items]
        self.min_share = min_share
        keys = [_run_keys(t) for t in self.tokens]
        self.runs = [np.unique(k) for k in keys]
        every, count = np.unique(np.concatenate(self.runs), return_counts=True) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        rare = []
        for k, own in zip(keys, self.runs):
            need = max(1, math.ceil(min_share * len(own) - 1e-9))
            order = own[np.argsort(count[np.searchsorted(every, own)], kind="stable")]
            rare.append(np.flatnonzero(np.isin(k, order[: len(own) - need + 1])))
        self.scales = [_Scale(self.tokens, e, rare if e.width == RUN and not e.max_edits else None) for e in scales]

    def find(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, bool, float]]:
        """(document, item, shared runs, runs, found with edits, edit similarity), by place, of the pairs that share enough."""
        sizes = np.array([len(t) for t in texts], np.int64)
        tokens = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint64)
        first = np.cumsum(sizes) - sizes
        found: list[np.ndarray] = []
        for s in self.scales:
            n = np.maximum(sizes - s.emb.width, -1) // s.emb.stride + 1
            doc = np.repeat(np.arange(len(texts)), n)
            starts = np.repeat(first - (np.cumsum(n) - n) * s.emb.stride, n) + np.arange(n.sum()) * s.emb.stride
            found.append(s.pairs(tokens, starts, doc, len(self.ids)))
        edited = np.unique(np.concatenate([x for s, x in zip(self.scales, found) if s.emb.max_edits] or [np.zeros(0, np.int64)]))
        out, at, keys, own = [], -1, None, None
        for code in np.unique(np.concatenate(found)).tolist():
            d, k = divmod(code, len(self.ids))
            if d != at:
                at, keys = d, _run_keys(texts[d])
                own = np.unique(keys)
            shared = int(np.isin(self.runs[k], own, assume_unique=True).sum())
            if not len(self.runs[k]) or shared / len(self.runs[k]) + 1e-12 < self.min_share:
                continue
            mine = _run_keys(self.tokens[k])
            order = np.argsort(mine, kind="stable")
            lo, hi = (np.searchsorted(mine[order], keys, side) for side in ("left", "right"))
            spot = np.flatnonzero(hi > lo)
            shifts = np.repeat(spot, hi[spot] - lo[spot]) - order[np.concatenate([np.arange(a, b) for a, b in zip(lo[spot], hi[spot])])]
            i = np.searchsorted(edited, code)
            by_edits = bool(i < len(edited) and edited[i] == code)
            out.append((d, k, shared, len(self.runs[k]), by_edits, _similarity(self.tokens[k], texts[d], shifts)))
        return out


_OUT = "doc_id long, item_id long, shared long, windows long, share double, found_with_edits boolean, edit_similarity double"


def _similarity(item: np.ndarray, text: np.ndarray, shifts: np.ndarray) -> float:
    """The greatest word-level edit similarity of ``item`` with a stretch of its length, at every place where a matching window
    says it may begin (and at their median). Equal stretches are compared once; one is skipped only if the words it has in
    common with the item cannot give more than what is found."""
    size, own, best, seen = len(item), Counter(item.tolist()), 0.0, set()
    places, n = np.unique(np.maximum(np.append(shifts, int(np.median(shifts))), 0), return_counts=True)
    for lo in places[np.argsort(-n, kind="stable")]:
        region = text[lo : lo + size]
        if region.tobytes() in seen:
            continue
        seen.add(region.tobytes())
        longest = max(size, len(region))
        if (own & Counter(region.tolist())).total() / longest > best:
            best = max(best, 1 - edit_distance(item, region) / longest)
    return best


def _matches(index: Index, doc_ids: list, texts: list[np.ndarray]) -> list[tuple]:
    return [(doc_ids[d], int(index.ids[k]), n, total, n / total, edits, float(sim)) for d, k, n, total, edits, sim in index.find(texts)]


#: Indexes of this worker process by block; the least recently used goes when there are more than ``_HELD``.
_INDEXES: OrderedDict[tuple, Index] = OrderedDict()
_HELD = 2


def _index(block, scales: tuple[Embedding, ...], min_share: float) -> Index:
    own = (block.id if hasattr(block, "id") else id(block), scales, min_share)
    if own not in _INDEXES:
        while len(_INDEXES) >= _HELD:
            _INDEXES.popitem(last=False)
        _INDEXES[own] = Index(block.value, scales, min_share)
    _INDEXES.move_to_end(own)
    return _INDEXES[own]


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' words in blocks of about ``block_words``, an item at a time from the cluster."""
    block, held = [], 0
    for r in items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", "passage").orderBy("item_id", "passage").toLocalIterator(prefetchPartitions=True):
        t = word_ids(r.passage)
        if len(t) < RUN:
            continue
        if block and held + len(t) > block_words:
            yield block
            block, held = [], 0
        block.append((r.item_id, t))
        held += len(t)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, scales: tuple[Embedding, ...] = SCALES, min_share: float = 0.3, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, shared, windows, share, found_with_edits, edit_similarity) of every document (doc_id, text) holding at
    least ``min_share`` of the distinct five-word runs of an item (item_id, passage).

    ``found_with_edits``: the long windows alone would have found the pair. ``edit_similarity`` compares the item, word by
    word, with the most similar stretch of its length among those where a run matches. Null or empty texts, null ids of items
    and passages shorter than a run match nothing; a repeated item gives its pairs once each time it stands in the table; a
    null doc_id is reported as such. Whole texts are read, in stretches of bounded memory. ``block_words``: words of items in
    one index (about 200 bytes a word); more items make more blocks, which every stretch of documents is held against.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(items, block_words)]
    # with more blocks than a process keeps, a longer stretch of documents pays for making an index anew
    most = 500_000 if len(blocks) <= _HELD else 8_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, held = [], [], 0

        def flush() -> pd.DataFrame:
            rows = [r for b in blocks for r in _matches(_index(b, scales, min_share), ids, texts)]
            ids.clear()
            texts.clear()
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64").astype(object).where(pdf["doc_id"].notna(), None), pdf["text"]):
                t = word_ids(text)
                if len(t) < RUN:
                    continue
                ids.append(doc_id)
                texts.append(t)
                held += len(t)
                if held > most:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInPandas(run, _OUT)
