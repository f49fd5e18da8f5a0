"""Abusive, hateful and sexual language: restored, scored, and rated per source.

Method: noisy-channel deobfuscation. The lattice of a token's characters (look-alike digits and signs, masked letters,
letters spaced out or repeated, typing errors) is decoded by Viterbi under a language model of two parts: a character
n-gram model of all documents (``ORDER`` characters, Dirichlet back-off), which can spell any word, and the words of the
reviewed documents with their frequencies among all documents, as a trie. The token as it stands competes by its own
frequency or under the character model, so that a name or a common word stays what it is and a disguised word that no
lexicon holds is restored.
The search is exact: a state is dropped only if it can't become cheaper than the best reading found so far.

The restored text is scored: pairs of neighbouring words weigh as they tell toxic from clean documents among the reviewed
ones and from all documents, and a run of pairs typical for one category whose sum reaches ``HIT`` is a hit of that
category. A pair weighs ``PAIR_CAP`` at most, unless its odds alone reach ``HIT``: such a pair is a hit by itself. The
highest sum, hit or not, is the score.

Model: the lexicon holds every word of ``LEXICON_DOCS`` or more of the at most ``LABEL_LIMIT`` reviewed documents, and the
pairs come from the same documents; that bound is what bounds both. The character model is a table of CELLS
hashed counts. All three are broadcast, none grows with the corpus, and no threshold depends on its size. Counts cover
all documents. Scoring is one linear pass without a shuffle; the restored words are kept in a written table between the
passes.

Defined cases: null and empty texts score 0; texts and words of any length are read whole; reviewed rows without a text,
or stated twice, don't count twice; without reviewed rows nothing is found; ties of categories go to the first of
CATEGORIES; a token with more masks than letters is restored to a word of the lexicon or not at all.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import ship_package, write_stage

CATEGORIES = ("abuse", "hate", "sexual")
LABEL_LIMIT, LEXICON_DOCS = 20_000, 3
ORDER, SLOTS, BACK_OFF, FLOOR = 4, 1 << 16, 5.0, 1 / 200
#: Hashed counts of whole words: WORD_ROWS tables of WORD_SLOTS, of which the lowest count holds.
WORD_ROWS, WORD_SLOTS = 2, 1 << 18
PAIR_DOCS, PAIR_ODDS, PAIR_CAP, STEP, HIT = 3, 1.5, 3.0, -0.7, 6.0
#: The usual share of a pair is the USUAL_AT quantile; pairs below USUAL_SHARE of it are left out.
USUAL_AT, USUAL_SHARE = 0.75, 0.25
# Signs and digits that stand for letters.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "£": "l", "+": "t", "(": "c"}
#: Costs in nats; a word that is spelled out by the character model costs OPEN more.
SIGN, MASK, REPEAT, TYPO, MAX_TYPOS, OPEN = 0.3, 1.0, 0.2, 5.0, 2, 2.0
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_*]|[013457@$*])(?:([ .\-_])(?:[^\W\d_*]|[013457@$*]))(?:\1(?:[^\W\d_*]|[013457@$*])){1,}(?![^\W_])")
_TOKEN = re.compile(r"[^\W_]*[^\W\d_][\w@$*!|€£+]*[^\W_][@$]*|[\w@$*]*[^\W\d_][\w@$*]*|\d+")
_RUN, _RUNS = re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")


_PIECE = re.compile(r"[\w@$*!|€£+]+")


def tokens_of(low: str) -> list[str]:
    """All matches of _TOKEN; a piece of letters alone, as most are, is one token."""
    out: list[str] = []
    for p in _PIECE.findall(low):
        if p.isalpha():
            out.append(p)
        else:
            out += _TOKEN.findall(p)
    return out


def plain(text: str) -> str:
    """Lower case; letters of other widths and marks composed as usual."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


CELLS = ORDER * SLOTS + WORD_ROWS * WORD_SLOTS


class Characters:
    """Character n-gram model: hashed counts of 1 to ORDER characters, the start and end of a word included, and hashed
    counts of whole words."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts[: ORDER * SLOTS].reshape(ORDER, SLOTS)
        self.words = counts[ORDER * SLOTS :].reshape(WORD_ROWS, WORD_SLOTS)
        self.total, self.n_words = max(int(self.counts[0].sum()), 1), max(int(self.words[0].sum()), 1)
        self.cache: dict[str, float] = {}

    @staticmethod
    def places(word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return [crc32(raw, k) % WORD_SLOTS for k in range(WORD_ROWS)]

    def standing(self, word: str) -> float:
        """Cost of a word as it stands: by its own frequency, or spelled out if that is likelier."""
        n = min(int(t[k]) for t, k in zip(self.words, self.places(word), strict=True))
        spelled = self.word(word) + OPEN
        return min(spelled, -math.log(n / self.n_words)) if n else spelled

    @staticmethod
    def cells(word: str) -> Iterator[int]:
        """Cells of a word and its n-grams; n-grams of starts alone are the contexts of its first character."""
        padded = "^" * (ORDER - 1) + word + "$"
        for n in range(1, ORDER):
            yield (n - 1) * SLOTS + crc32(b"^" * n) % SLOTS
        for i in range(ORDER - 1, len(padded)):
            for n in range(1, ORDER + 1):
                yield (n - 1) * SLOTS + crc32(padded[i - n + 1 : i + 1].encode("utf-8", "surrogatepass")) % SLOTS
        for k, at in enumerate(Characters.places(word)):
            yield ORDER * SLOTS + k * WORD_SLOTS + at

    def count(self, gram: str) -> int:
        return int(self.counts[len(gram) - 1][crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS])

    def cost(self, gram: str) -> float:
        """-log P(last character | the ones before it) for ORDER characters."""
        known = self.cache.get(gram)
        if known is None:
            p = (self.count(gram[-1]) + FLOOR * BACK_OFF) / (self.total + BACK_OFF)
            for n in range(2, ORDER + 1):
                p = (self.count(gram[-n:]) + BACK_OFF * p) / (self.count(gram[-n:-1]) + BACK_OFF)
            if len(self.cache) > 500_000:
                self.cache.clear()
            known = self.cache[gram] = -math.log(min(p, 1.0))
        return known

    def word(self, word: str) -> float:
        """Cost of a whole word, spelled out."""
        padded = "^" * (ORDER - 1) + word + "$"
        return sum(self.cost(padded[i : i + ORDER]) for i in range(len(padded) - ORDER + 1))


class Node:
    """A trie node: its children, its word with the word's cost, and the least cost of a word at or below it."""

    __slots__ = ("cost", "least", "next", "word")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.word, self.cost, self.least = None, math.inf, math.inf


def one_less(word: str) -> list[str]:
    """The word and its forms with one letter left out, runs of a letter taken as one letter."""
    w = _RUNS.sub(r"\1", word)
    n = len(w)
    return [w, *(w[:i] + w[i + 2 if 0 < i < n - 1 and w[i - 1] == w[i + 1] else i + 1 :] for i in range(n))]


class Channel:
    """Viterbi decoder of one token, or of a spaced-out run of words, over the lexicon's trie and the character model."""

    def __init__(self, words: dict[str, int], characters: np.ndarray | None = None):
        total = sum(words.values()) or 1
        self.logp = {w: math.log(n / total) for w, n in words.items() if n}
        self.cheapest = min((-p for p in self.logp.values()), default=math.inf)
        self.trie = Node()
        for w, p in self.logp.items():
            node = self.trie
            for ch in w:
                node.least = min(node.least, -p)
                node = node.next.setdefault(ch, Node())
            node.least, node.word, node.cost = min(node.least, -p), w, -p
        if characters is None:
            characters = np.zeros(CELLS, dtype=np.int64)
            for w, n in words.items():
                np.add.at(characters, list(Characters.cells(w)), n)
        self.characters = Characters(characters)
        #: forms of the lexicon's words with one letter left out: a plain word that shares none of its own is no typing
        #: error of one of them
        self.near = frozenset(x for w in self.logp for x in one_less(w))
        self.alphabet = sorted({c for w in self.logp for c in w} | set("abcdefghijklmnopqrstuvwxyz"))
        self.cache: dict[str, str] = {w: w for w in self.logp}

    def options(self, ch: str) -> list[tuple[str, float]]:
        """Letters that an observed character may stand for, with costs."""
        if ch in LOOKALIKES:
            return [(x, SIGN) for x in LOOKALIKES[ch]]
        return [(ch, 0.0)]

    def decode(self, token: str) -> str:
        known = self.cache.get(token)
        if known is None:
            if len(self.cache) > 200_000 + len(self.logp):
                self.cache = {w: w for w in self.logp}
            known = self.cache[token] = self._decode(token)
        return known

    def _decode(self, token: str) -> str:
        if len(token) < 3 or token.isdigit():
            return token
        if token.startswith("*") or token.endswith("*"):
            bare = token.strip("*")
            # stars at the ends emphasise rather than mask, unless a word of the lexicon comes out of the mask
            masked, _ = self._lexicon(token, self.characters.standing(bare))
            return masked if masked is not None else self.decode(bare) if bare else token
        best, bound = token, self.characters.standing(token)
        if not token.isalpha() or _RUN.search(token):
            spelled, cost = self._spelled(token, bound)
            if spelled is not None:
                best, bound = spelled, cost
        word, _ = self._lexicon(token, bound)
        return best if word is None else word

    def _spelled(self, token: str, bound: float) -> tuple[str | None, float]:
        """The likeliest spelling under the character model alone, if it costs less than ``bound``."""
        masks = token.count("*")
        if 2 * masks > len(token):
            return None, bound
        # a state is the last ORDER - 1 letters; the way to it is a chain of letters
        states: dict[str, tuple[float, tuple | None]] = {"^" * (ORDER - 1): (OPEN, None)}
        for ch in token:
            nxt: dict[str, tuple[float, tuple | None]] = {}
            letters = [(x, MASK) for x in self.alphabet] if ch == "*" else self.options(ch)
            for context, (cost, way) in states.items():
                for x, c in letters:
                    if x == context[-1]:
                        again = cost + c + REPEAT
                        if again < bound and (context not in nxt or again < nxt[context][0]):
                            nxt[context] = (again, way)
                    to, s = context[1:] + x, cost + c + self.characters.cost(context + x)
                    if s < bound and (to not in nxt or s < nxt[to][0]):
                        nxt[to] = (s, (way, x))
            states = nxt
        best, end = bound, None
        for context, (cost, way) in states.items():
            s = cost + self.characters.cost(context + "$")
            if s < best:
                best, end = s, way
        if end is None:
            return None, bound
        letters = []
        while end is not None:
            end, x = end
            letters.append(x)
        return "".join(reversed(letters)), best

    def _lexicon(self, token: str, bound: float) -> tuple[str | None, float]:
        """The likeliest word of the lexicon, if it costs less than ``bound``."""
        typos = 1 if len(token) < 8 or bound - self.cheapest < 2 * TYPO else MAX_TYPOS
        if typos == 1 and token.isalpha() and self.near.isdisjoint(one_less(token)):
            return None, bound
        # state: (node id, last letter, typos) -> (cost, node)
        states: dict[tuple, tuple[float, Node]] = {(id(self.trie), "", 0): (0.0, self.trie)}
        previous: dict[tuple, tuple[float, Node]] = {}
        for i, ch in enumerate(token):
            nxt: dict[tuple, tuple[float, Node]] = {}

            def put(cost: float, node: Node, letter: str, used: int, nxt=nxt) -> None:
                if cost + node.least < bound:
                    key = (id(node), letter, used)
                    if key not in nxt or cost < nxt[key][0]:
                        nxt[key] = (cost, node)

            letters = self.options(ch)
            for (_, last, used), (cost, node) in states.items():
                if ch == "*":
                    for x, child in node.next.items():
                        put(cost + MASK, child, x, used)
                else:
                    for x, c in letters:
                        child = node.next.get(x)
                        if child is not None:
                            put(cost + c, child, x, used)
                        if x == last:
                            put(cost + c + REPEAT, node, last, used)
                if used < typos and cost + TYPO + node.least < bound:
                    put(cost + TYPO, node, last, used + 1)  # a letter too many
                    for x, child in node.next.items():
                        if cost + TYPO + child.least < bound:
                            put(cost + TYPO, child, x, used + 1)  # another letter
                            for y, c in letters:
                                grand = child.next.get(y)
                                if grand is not None:
                                    put(cost + TYPO + c, grand, y, used + 1)  # a letter missing
            if i and typos:
                a, b = token[i], token[i - 1]
                for (_, _, used), (cost, node) in previous.items():
                    if used < typos and a != b and (one := node.next.get(a)) is not None and (two := one.next.get(b)) is not None:
                        put(cost + TYPO, two, b, used + 1)  # neighbours swapped
            previous, states = states, nxt
            if not states and not previous:
                return None, bound
        best, word = bound, None
        for (_, _, used), (cost, node) in states.items():
            ends = [(cost, node)]
            if used < typos:
                ends += [(cost + TYPO, child) for child in node.next.values()]  # the last letter missing
            for c, end in ends:
                if c + end.cost < best:
                    best, word = c + end.cost, end.word
        return word, best

    def segment(self, letters: str) -> list[str]:
        """Words of a run whose letters were spaced out: the likeliest way to cut it."""
        n = len(letters)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(1e9, 0, "")] * n
        for i in range(n):
            if best[i][0] >= 1e9:
                continue
            front = {id(self.trie): (0.0, self.trie)}
            for j in range(i, n):
                nxt: dict[int, tuple[float, Node]] = {}
                for cost, node in front.values():
                    steps = [(x, MASK) for x in node.next] if letters[j] == "*" else self.options(letters[j])
                    for x, c in steps:
                        child = node.next.get(x)
                        if child is not None and (id(child) not in nxt or cost + c < nxt[id(child)][0]):
                            nxt[id(child)] = (cost + c, child)
                front = nxt
                if not front:
                    break
                for cost, node in front.values():
                    if node.word is not None and (s := best[i][0] + cost + node.cost + OPEN) < best[j + 1][0]:
                        best[j + 1] = (s, i, node.word)
            if best[i + 1][0] >= 1e9:
                best[i + 1] = (best[i][0] + 20.0, i, letters[i])
        out, j = [], n
        while j > 0:
            _, i, w = best[j]
            out.append(w)
            j = i
        return out[::-1]

    def restore(self, text: str) -> list[str]:
        out: list[str] = []
        low, last = plain(text), 0
        for m in _SPACED.finditer(low):
            out += map(self.decode, tokens_of(low[last : m.start()]))
            letters = m[0][::2]
            whole = self.decode(letters)
            if whole in self.logp:
                out.append(whole)
            else:
                # words run together, unless the character model finds one word likelier than the cut
                cut = self.segment(letters)
                out += cut if all(w in self.logp for w in cut) else [whole]
            last = m.end()
        known, decode = self.cache.get, self.decode
        out += [known(t) or decode(t) for t in tokens_of(low[last:] if last else low)]
        return out


_CHANNELS: dict[int, Channel] = {}


def channel(shared) -> Channel:
    """One decoder for each Python worker and model."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _CHANNELS:
        _CHANNELS.clear()
        _CHANNELS[key] = Channel(*shared.value)
    return _CHANNELS[key]


def some_labels(labels: DataFrame) -> DataFrame:
    """At most LABEL_LIMIT reviewed documents, one row each, with kind: a category, or 'none'."""
    kind = F.when(F.col("toxic") == 1, F.coalesce("category", F.lit("abuse"))).otherwise("none")
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("kind")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_LIMIT)


def _distinct(rows: DataFrame, column: str, of, also: tuple[str, ...] = ()) -> DataFrame:
    """(item, *also) for each distinct item that ``of`` finds in a text."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(of(t)) for t in b.column(column).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.string()), *(b.column(c).take(take) for c in also)], names=["item", *also])

    return rows.select(column, *also).mapInArrow(run, ", ".join(["item string", *(f"{c} {kinds[c]}" for c in also)]))


def letter_words(text: str) -> set[str]:
    return {w for w in tokens_of(plain(text)) if w.isalpha()}


def language_model(documents: DataFrame, labels: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """(words of the lexicon with the number of documents that have them, counts of the character model): one pass over
    the reviewed documents for the words, one over all documents for both kinds of counts."""
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = texts.join(F.broadcast(some_labels(labels).select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    lexicon = frozenset(r["item"] for r in _distinct(own, "text", letter_words).groupBy("item").count().where(F.col("count") >= LEXICON_DOCS).select("item").collect())
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, words, seen = np.zeros(CELLS, dtype=np.int64), Counter(), Counter()

        def spell() -> None:
            at, n = [], []
            for w, k in seen.items():
                own = list(Characters.cells(w))
                at += own
                n += [k] * len(own)
            np.add.at(cells, np.array(at, dtype=np.int64), np.array(n, dtype=np.int64))
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(letter_words(t))
            if len(seen) > 100_000:
                words.update({w: seen[w] for w in seen.keys() & shared.value})
                spell()
        words.update({w: seen[w] for w in seen.keys() & shared.value})
        spell()
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array([*([None] * len(used)), *words], pa.string()), pa.array([*used.tolist(), *([-1] * len(words))], pa.int32()), pa.array([*cells[used].tolist(), *words.values()], pa.int64())], names=["word", "cell", "n"])

    # at most CELLS cells and the words of the lexicon, however many documents there are
    rows = texts.select("text").mapInArrow(run, "word string, cell int, n long").groupBy("word", "cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[cell[cell >= 0]] = n[cell >= 0]
    known = rows.filter(pa.array(cell < 0))
    return dict(zip(known.column("word").to_pylist(), known.column("n").to_pylist(), strict=True)), counts


def neighbours(tokens: str) -> set[str]:
    w = tokens.split(" ")
    return {x + " " + y for x, y in zip(w, w[1:], strict=False)}


def by_first(pairs: Iterable[str]) -> dict[str, dict[str, str]]:
    """first word -> second word -> pair: a text is looked up word by word, and most words begin no pair."""
    out: dict[str, dict[str, str]] = {}
    for p in pairs:
        a, _, b = p.partition(" ")
        out.setdefault(a, {})[b] = p
    return out


def pairs_in(words: list[str], firsts: dict[str, dict[str, str]]) -> list[tuple[int, str]]:
    """(position, pair) of the listed pairs that stand in the words."""
    last = len(words) - 1
    return [(i, p) for i, w in enumerate(words) if w in firsts and i < last and (p := firsts[w].get(words[i + 1])) is not None]


def pair_weights(restored: DataFrame, labels: DataFrame) -> dict[str, tuple[float, int]]:
    """pair -> (weight, index of its category).

    A pair of words tells toxic documents if it is much more frequent among reviewed toxic documents than among clean
    ones, and if of all documents that have it the share reviewed as toxic is as usual for such pairs: the share's
    denominator is the whole corpus, so that a language or topic with few reviewed documents can't pass for toxic. The
    pairs fetched here are pairs of at least PAIR_DOCS of LABEL_LIMIT documents.
    """
    own = restored.where(F.col("tokens") != "").join(F.broadcast(some_labels(labels)), "doc_id").select("doc_id", "kind", "tokens").dropDuplicates(["doc_id"])
    own = write_stage(own, "abuse-reviewed").df
    docs = {r["kind"]: r["count"] for r in own.groupBy("kind").count().collect()}
    toxic, clean = sum(n for k, n in docs.items() if k != "none"), docs.get("none", 0)
    by = _distinct(own, "tokens", neighbours, ("kind",)).groupBy("item").agg(F.count_if(F.col("kind") != "none").alias("t"), F.count_if(F.col("kind") == "none").alias("c"), *(F.count_if(F.col("kind") == k).alias(k) for k in CATEGORIES))
    told = {r["item"]: r for r in by.where(F.col("t") >= PAIR_DOCS).collect() if math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1)) >= PAIR_ODDS}
    shared = restored.sparkSession.sparkContext.broadcast(by_first(told))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for t in b.column("tokens").to_pylist():
                total.update({p for _, p in pairs_in(t.split(" "), shared.value)})
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], names=["pair", "n"])

    everywhere = {r["pair"]: r["n"] for r in restored.select("tokens").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    shares = sorted((r["t"] / max(everywhere.get(p, 0), 1), r["t"]) for p, r in told.items())
    total, usual, seen = sum(t for _, t in shares), 0.0, 0
    for usual, t in shares:
        seen += t
        if seen >= USUAL_AT * total:
            break
    out = {}
    for p, r in told.items():
        if r["t"] / max(everywhere.get(p, 0), 1) >= USUAL_SHARE * usual:
            odds = math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1))
            share = [(r[k] + 0.5) / (docs.get(k, 0) + 5) for k in CATEGORIES]
            out[p] = (odds if odds >= HIT else min(odds, PAIR_CAP), share.index(max(share)))
    return out


def sums(tokens: list[str], weights: dict[str, tuple[float, int]], firsts: dict[str, dict[str, str]] | None = None) -> dict[str, float]:
    """category -> highest sum of a run of its pairs, for every category: each pair of the text that isn't one of the
    category's takes STEP off the run, which never falls below 0."""
    run, top, last = [0.0] * len(CATEGORIES), [0.0] * len(CATEGORIES), [-1] * len(CATEGORIES)
    for i, p in pairs_in(tokens, by_first(weights) if firsts is None else firsts):
        w, k = weights[p]
        run[k] = max(0.0, max(0.0, run[k] + STEP * (i - last[k] - 1)) + w)
        last[k] = i
        top[k] = max(top[k], run[k])
    return dict(zip(CATEGORIES, top, strict=True))


def restore_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, tokens): the restored words of every document, '' where there is no text."""
    spark = documents.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(language_model(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ch = channel(model)
        for b in batches:
            tokens = [" ".join(ch.restore(t)) if t else "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(tokens, pa.string())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(run, "doc_id long, source string, tokens string")


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, categories): score in [0, 1) of the highest sum, categories of the hits, for every document."""
    spark = documents.sparkSession
    restored = write_stage(restore_documents(documents, labels), "abuse-restored").df
    weights = pair_weights(restored, labels)
    shared = spark.sparkContext.broadcast((weights, by_first(weights)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sums(t.split(" "), *shared.value) if t else {} for t in b.column("tokens").to_pylist()]
            scores = [1 - math.exp(-max(h.values(), default=0.0) / HIT) for h in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(scores, pa.float64()), pa.array([[c for c, x in h.items() if x >= HIT] for h in found], pa.list_(pa.string()))], names=["doc_id", "source", "score", "categories"])

    return restored.mapInArrow(run, "doc_id long, source string, score double, categories array<string>")


def rates(scored: DataFrame) -> DataFrame:
    """Documents and toxic documents of each source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.size("categories") > 0).alias("n_toxic"), F.avg((F.size("categories") > 0).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
