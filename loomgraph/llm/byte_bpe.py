"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a backtracking encoder. All tokens that occur in a piece of text are found by one Aho-Corasick pass; the longest
at each position are taken greedily, and a token is accepted only if a compatibility test of the adjacent pair says that
merging in rank order would keep the two apart; otherwise the next shorter token, or one step back, is tried. That gives
exactly the result of the merges, in time linear in the text. The compatibility test undoes merges with a split table;
its answers are kept in a bounded pair table. Decoding slices one buffer by an offset table.

The vocabulary file is read once by the driver and broadcast (its size is fixed), so its path needn't exist elsewhere.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text; a text
of any length is encoded whole; pieces above ``MAX_CACHED`` characters are not cached; repeated rows are encoded alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MAX_CACHED, CACHE_SIZE = 64, 200_000
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_symbols() -> list[str]:
    """The symbol that stands for each byte: itself where it is printable Latin-1, else the next free one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in set(printable):
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class ByteBPE:
    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        back = {ord(s): chr(b) for b, s in enumerate(byte_symbols())}
        vocab: dict[str, int] = model["vocab"]
        plain = {t: t.translate(back) for t in vocab}  # one Latin-1 character for each byte
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of a token: bytes first, then the order of the merges; ids of this vocabulary need not follow it
        self.rank: dict[str, int] = {plain[s]: i for i, s in enumerate(x for x in vocab if len(plain[x]) == 1)}
        n = len(self.rank)
        self.left, self.right = list(range(n)), list(range(n))
        self.merged: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            x, y = self.rank[plain[a]], self.rank[plain[b]]
            r = self.rank.setdefault(plain[a] + plain[b], n + i)
            self.left.append(x)
            self.right.append(y)
            self.merged[x, y] = r
        self.id = [0] * (n + len(merges))
        self.text = [""] * len(self.id)
        for t, i in vocab.items():
            r = self.rank[plain[t]]
            self.id[r], self.text[r] = i, plain[t]
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        # the longest token that is a proper prefix of a token
        self.shorter = [-1] * len(self.id)
        for t, r in self.rank.items():
            for k in range(len(t) - 1, 0, -1):
                if t[:k] in self.rank:
                    self.shorter[r] = self.rank[t[:k]]
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN)

    def apart(self, a: int, b: int) -> bool:
        """Whether merging in rank order keeps tokens a and b, side by side, as they are.

        The merges that made a and b are undone from the latest on. Each step shows the pair of tokens that met at the
        border at that time; had they a merge of a lower rank than the one undone last, it would have come first.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        key, limit, answer = (a, b), len(self.id), None
        while answer is None:
            joint = self.merged.get((a, b))
            if joint is not None and joint < limit:
                answer = False
            elif self.left[a] == a and self.left[b] == b:
                answer = True
            elif a > b:
                limit, a = a, self.right[a]
            else:
                # at equal ranks the left one was merged first, so the right one is undone first
                limit, b = b + 1, self.left[b]
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def piece(self, data: str) -> list[int]:
        """Ranks of the tokens of one piece, given with one Latin-1 character for each byte."""
        whole = self.rank.get(data)
        if whole is not None and len(data) <= 2:
            return [whole]
        longest = [-1] * len(data)
        size = [0] * len(data)
        for end, r in self.automaton.iter(data):
            n = len(self.text[r])
            start = end - n + 1
            if n > size[start]:
                longest[start], size[start] = r, n
        out: list[int] = []
        dead = bytearray(len(data) + 1)  # positions from which no valid way leads on
        pos, token = 0, longest[0]
        while pos < len(data):
            while token >= 0:
                end = pos + len(self.text[token])
                if not dead[end] and (not out or self.apart(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                pos += len(self.text[token])
                token = longest[pos] if pos < len(data) else -1
            else:
                dead[pos] = 1
                last = out.pop()
                pos -= len(self.text[last])
                token = self.shorter[last]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for s in self.split.findall(text or ""):
            ids = cache.get(s)
            if ids is None:
                ids = tuple(self.id[r] for r in self.piece(s.encode("utf-8", "surrogatepass").decode("latin-1")))
                if len(s) <= MAX_CACHED:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[s] = ids
            out.extend(ids)
        return out

    def decoder(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(buffer, start, end): the bytes of token id i are buffer[start[i]:end[i]]."""
        by_id = [""] * (max(self.id) + 1)
        for r, i in enumerate(self.id):
            by_id[i] = self.text[r]
        ends = np.cumsum([len(t) for t in by_id])
        return "".join(by_id).encode("latin-1"), ends - np.array([len(t) for t in by_id]), ends


_LOADED: dict[int, ByteBPE] = {}


def loaded(file: bytes) -> ByteBPE:
    """One encoder for each Python worker and vocabulary."""
    key = hash(file)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(file)
    return _LOADED[key]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row for each row of ``documents``; no shuffle."""
    spark = documents.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for b in batches:
            ids = [np.asarray(bpe.encode(t), dtype=np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) back from (key, ids); null ids give null."""
    spark = encoded.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, start, end = loaded(file.value).decoder()
        for b in batches:
            texts = [None if ids is None else b"".join(buffer[start[i] : end[i]] for i in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")


def token_report(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents, tokens and documents that decode to themselves, by source."""
    ids = encode_corpus(documents, vocabulary=vocabulary)
    back = decode_corpus(ids, vocabulary=vocabulary).withColumnRenamed("text", "again")
    counted = documents.join(ids.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id").join(back, "doc_id")
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("again") == F.coalesce("text", F.lit(""))).alias("n_round_trip"))
