"""Evaluation passages in a training corpus.

Method: q-gram lemma filtering. A passage of L bytes that occurs with at most e edits shares at least L - q + 1 - e*q of
its q-grams with the document, on diagonals (position in the item minus position in the document) that differ by at
most e. Shared q-grams are counted in overlapping bands of diagonals; bands that reach the bound are retained, and a
retained region is verified by banded alignment: a passage of ``min_words`` words of the item must align with the text
within e edits, on diagonals at most e from one on which it shares a q-gram. Without edits the alignment is the longest
exact run on one diagonal. For ``min_words`` consecutive words, L is the shortest passage of that many words that the
item has, so nothing is lost. A last exact check counts whole words.

A passage of twelve words has 25 bytes at least, so with no edits the bound is never below 10 shared grams of 16, and
with two edits never below 2 shared grams of 8. Texts are compared as their words (runs of letters and digits, case
ignored) with single spaces between and around.

Scale: the corpus is read in blocks without a shuffle of its texts; the q-grams of a whole batch are looked up at once,
and only documents with a shared q-gram are looked at further. The evaluation items are a fixed set, indexed and
broadcast. Their size is summed before they are fetched: a set above ``MAX_ITEM_BYTES`` is cut into blocks of items, each
indexed by itself against the whole corpus, with the same result. Long texts are cut into segments that overlap by the
longest item (with its edits), so every passage lies whole in one segment.

Defined cases: null, empty and short texts contain nothing; an item of fewer than ``min_words`` words cannot leak; a
passage that several items share counts for each; repeated rows of one document give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import ship_package

#: q without and with edits: a longer gram has fewer chance hits, but each edit costs q of them.
Q_EXACT, Q_EDITS = 16, 8
MIN_WORDS, BAND, SEGMENT, MAX_ITEM_BYTES, SIEVE_BITS = 12, 16, 1 << 16, 8_000_000, 22
_WORD = re.compile(r"[^\W_]+")
#: ASCII letters in lower case and digits as they are; all else is a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def flat(text: str | None) -> bytes:
    if not text:
        return b""
    if text.isascii():
        words = text.encode().translate(_TO_WORDS).split()
        return b" " + b" ".join(words) + b" " if words else b""
    words = _WORD.findall(text.casefold())
    return (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass") if words else b""


def grams(data: bytes, q: int) -> np.ndarray:
    """All runs of q bytes (8 or 16), each as one number; chance equals of 16 bytes are met by the verification."""
    if len(data) < q:
        return np.empty(0, dtype=np.uint64)
    g = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), 8).copy().view(np.uint64).reshape(-1)
    return g if q == 8 else (g[:-8] * np.uint64(0x9E3779B185EBCA87)) ^ (g[8:] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)


class ItemIndex:
    """Postings of the q-grams of all items, and for each item the bound that a band must reach."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int = MIN_WORDS, edits: int = 0):
        self.min_words, self.edits, self.q = min_words, edits, Q_EDITS if edits else Q_EXACT
        q = self.q
        self.ids, self.data, self.spaces, need = [], [], [], []
        for i, text in items:
            data = flat(text)
            at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
            if len(at) <= min_words:
                continue
            shortest = int((at[min_words:] - at[:-min_words]).min()) + 1
            self.ids.append(i)
            self.data.append(data)
            self.spaces.append(at)
            need.append(max(1, shortest - q + 1 - edits * q))
        self.need = np.array(need, dtype=np.int64)
        self.longest = max(map(len, self.data), default=0)
        parts = [grams(d, q) for d in self.data]
        g = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts]) if parts else np.empty(0, dtype=np.int64)
        pos = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, dtype=np.int64)
        order = np.argsort(g, kind="stable")
        self.item, self.pos = item[order].astype(np.int64), pos[order].astype(np.int64)
        self.keys, self.start = np.unique(g[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(g)))
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[_slot(self.keys)] = True

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of the q-grams of ``data`` that any item has: a sieve first, then the exact lookup."""
        g = grams(data, self.q)
        if not len(g) or not len(self.keys):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.sieve[_slot(g)])
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == g[at]
        return at[real], k[real]

    def bands(self, hit: np.ndarray, k: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, positions in the item, diagonals) of the q-grams shared in each band that reaches the bound, for a text of
        ``length`` bytes; with edits a band reaches ``edits`` diagonals further to both sides."""
        if not len(hit):
            return
        n = self.count[k]
        first = np.repeat(self.start[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, pos = self.item[first], self.pos[first]
        diagonal = pos - np.repeat(hit, n)
        width = max(BAND, self.edits + 1)
        offset = ((length // width) + 2) * width
        span = (offset + self.longest) // width + 3
        key, c = np.unique(item * span + (diagonal + offset) // width, return_counts=True)
        # a band is two rows wide and starts at every row, so each pair of neighbouring diagonals lies in one
        after = np.searchsorted(key, key + 1)
        joined = c + np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), c[np.minimum(after, len(c) - 1)], 0)
        kept = key[joined >= self.need[key // span]]
        if not len(kept):
            return
        wide = 2 * offset + self.longest + 3 * width
        place = item * wide + diagonal + offset
        order = np.argsort(place, kind="stable")
        place = place[order]
        for x in kept:
            i, low = int(x // span), int(x % span) * width - offset
            at, to = np.searchsorted(place, [i * wide + low + offset - self.edits, i * wide + low + offset + 2 * width + self.edits])
            yield i, pos[order[at:to]], diagonal[order[at:to]]

    def verify(self, data: bytes, item: int, pos: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """(words, start, end in the text) of the best region in the band, or None."""
        return (self._aligned if self.edits else self._exact)(data, item, pos, diagonals)

    def _exact(self, data: bytes, item: int, pos: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        own, best = self.data[item], None
        a, b = np.frombuffer(own, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)
        values, counts = np.unique(diagonals, return_counts=True)
        for diagonal in values[counts >= self.need[item]]:
            lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
            same = np.concatenate(([0], (a[lo:hi] == b[lo - diagonal : hi - diagonal]).view(np.int8), [0]))
            turn = np.flatnonzero(np.diff(same))
            for s, e in zip(turn[::2] + lo, turn[1::2] + lo, strict=True):
                words = own[s:e].count(b" ") - 1
                if best is None or words > best[0]:
                    best = (words, int(s - diagonal), int(e - diagonal))
        return best

    def _aligned(self, data: bytes, item: int, pos: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
        """Every passage of ``min_words`` words of the item that shares enough q-grams in the band is aligned; passages
        that follow each other make one region."""
        own, e, spaces = self.data[item], self.edits, self.spaces[item]
        order = np.argsort(pos, kind="stable")
        pos, diagonals = pos[order], diagonals[order]
        starts, ends = spaces[: -self.min_words], spaces[self.min_words :] + 1
        lo, hi = np.searchsorted(pos, starts), np.searchsorted(pos, ends - self.q, side="right")
        best, run, last = None, None, -2
        for k in np.flatnonzero(hi - lo >= np.maximum(1, ends - starts - self.q + 1 - e * self.q)):
            s, t, found = int(starts[k]), int(ends[k]), None
            values, counts = np.unique(diagonals[lo[k] : hi[k]], return_counts=True)
            tried: set[int] = set()
            for d in values[np.argsort(-counts, kind="stable")].tolist():
                for x in sorted(range(d - e, d + e + 1), key=lambda x, d=d: abs(x - d)):
                    if x not in tried and found is None and 0 <= s - x < len(data):
                        tried.add(x)
                        end = align(own[s:t], data, s - x, e)
                        found = None if end is None else (s - x, end)
            if found is not None:
                run = (run[0] + 1, min(run[1], found[0]), max(run[2], found[1])) if run and k == last + 1 else (self.min_words, *found)
                last = k
                best = run if best is None or run[0] > best[0] else best
        return best

    def _search(self, data: bytes, hit: np.ndarray, k: np.ndarray) -> dict[int, tuple[int, int, int]]:
        out: dict[int, tuple[int, int, int]] = {}
        for item, pos, diagonals in self.bands(hit, k, len(data)):
            region = self.verify(data, item, pos, diagonals)
            if region and region[0] >= self.min_words and (item not in out or region[0] > out[item][0]):
                out[item] = region
        return out

    def search(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """item index -> (words, start, end) with start and end in the flattened text."""
        return next(iter(self.search_all([flat(text)])), {})

    def search_all(self, flats: list[bytes]) -> list[dict[int, tuple[int, int, int]]]:
        """search() of many flattened texts, looked up together: no item has two spaces in a row, as stand where two
        texts meet, so no q-gram of an item spans two of them."""
        whole = b"".join(flats)
        ends = np.cumsum([len(f) for f in flats])
        # blocks keep the arrays of grams small
        parts = [(at, *self.hits(whole[at : at + (1 << 22) + self.q - 1])) for at in range(0, max(len(whole), 1), 1 << 22)]
        hit = np.concatenate([h + at for at, h, _ in parts])
        k = np.concatenate([x for _, _, x in parts])
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in flats]
        bounds = np.searchsorted(hit, np.concatenate(([0], ends)))
        overlap = self.longest + self.q + 2 * self.edits
        step = max(SEGMENT, 4 * overlap)
        for n in np.flatnonzero(np.diff(bounds)):
            own, own_k, data = hit[bounds[n] : bounds[n + 1]] - (ends[n] - len(flats[n])), k[bounds[n] : bounds[n + 1]], flats[n]
            for at in range(0, len(data), step):
                a, b = np.searchsorted(own, [at, at + step + overlap - self.q + 1])
                for item, (w, s, e) in self._search(data[at : at + step + overlap], own[a:b] - at, own_k[a:b]).items():
                    if item not in out[n] or w > out[n][item][0]:
                        out[n][item] = (w, s + at, e + at)
        return out


def align(a: bytes, b: bytes, start: int, edits: int) -> int | None:
    """Where ``a``, begun at ``start`` of b, ends with at most ``edits`` edits, or None: the furthest-reaching points of the
    2 * edits + 1 diagonals around the start, one edit after the other."""
    n, m = len(a), len(b)

    def slide(i: int, d: int) -> int:
        j = start + i + d
        while i < n and 0 <= j < m and a[i] == b[j]:
            step = 32
            while step > 1 and a[i : i + step] != b[j : j + step]:
                step >>= 1
            step = min(step, n - i, m - j)
            i, j = i + step, j + step
        return i

    reach = {0: slide(0, 0)}
    for k in range(edits + 1):
        for d, i in reach.items():
            if i >= n:
                return start + n + d
        if k == edits:
            return None
        nxt: dict[int, int] = {}
        for d, i in reach.items():
            for dd, ii in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):
                if ii <= n and 0 <= start + ii + dd <= m:
                    nxt[dd] = max(nxt.get(dd, -1), ii)
        reach = {d: slide(i, d) for d, i in nxt.items()}
    return None


def item_blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The items, in as many parts as keep each at about ``most`` bytes of text: their size is summed, not fetched."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-size // most) if size > most else 1
    return [items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def leaks(documents: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, edits: int = 0, most: int = MAX_ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words, matched): n_words of the longest region, matched the region itself."""
    ship_package(documents.sparkSession)
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    parts = [_leaks_of(texts, items, min_words, edits) for items in item_blocks(benchmark, most)]
    return reduce(DataFrame.unionByName, parts)


def _leaks_of(texts: DataFrame, items: DataFrame, min_words: int, edits: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in items.collect()], min_words, edits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            rows = []
            flats = [flat(t) for t in b.column(1).to_pylist()]
            for i, data, found in zip(b.column(0).to_pylist(), flats, index.search_all(flats), strict=True):
                rows += [(i, index.ids[k], w, data[s:e].decode("utf-8", "replace").strip()) for k, (w, s, e) in found.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["doc_id", "item_id", "n_words", "matched"])

    return texts.mapInArrow(run, "doc_id long, item_id long, n_words int, matched string")
