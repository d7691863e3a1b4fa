"""Encoding texts with a public byte-level BPE vocabulary (problem 6).

Texts are cut into pieces by the vocabulary's pattern. The distinct pieces of a batch are merged together: a piece is a row of a
matrix of token ids, and over its adjacent pairs stands a segment tree whose nodes hold the lowest rank below them (the left one
of equals). The root thus yields the leftmost lowest-rank merge; a merge changes two pairs, whose ranks are updated up their
paths, logarithmically; all pieces of about one length take their steps together as array operations, until no piece has a
mergeable pair left. Spark partitions the documents; a worker keeps the pieces it has already encoded in a bounded cache.

Defined results: a null text gives an empty list of ids, as an empty text does; blank texts give their tokens; a text that
spells a special token is ordinary text; a piece of any length is encoded whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies are; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that cuts a text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps between batches, and the longest piece (bytes) that it keeps.
CACHE_PIECES, CACHE_BYTES = 200_000, 64
NONE = np.int64(1) << 40  # the rank of a pair that can't be merged


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary's file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Byte ids and the table of merges: sorted keys ``left * size + right`` with rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int64), NONE)
        self.merged = np.append(np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order], -1)
        self.pieces = regex.compile(PATTERN)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent ids; rank NONE where there is no such merge or an id is -1."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_pieces(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Token ids of each piece."""
    out: list[list[int]] = [[]] * len(pieces)
    lengths = np.array([len(p) for p in pieces])
    width = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(lengths, 1)))).astype(int)
    for w in np.unique(width):
        of_width = np.flatnonzero((width == w) & (lengths > 0))
        rows = max(1, 4_000_000 // int(w))  # bounds the matrices
        for i in range(0, len(of_width), rows):
            at = of_width[i : i + rows]
            for k, ids in zip(at, _merge_matrix(v, [pieces[j] for j in at], int(w))):
                out[k] = ids
    return out


def _merge_matrix(v: Vocabulary, pieces: list[bytes], w: int) -> list[list[int]]:
    n, nodes = len(pieces), 2 * w
    raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), dtype=np.uint8).reshape(n, w)
    lengths = np.array([len(p) for p in pieces])
    place = np.arange(w)
    ids = np.where(place < lengths[:, None], v.byte_ids[raw], -1)
    following = np.broadcast_to(np.where(place + 1 < w, place + 1, -1), (n, w)).copy()
    following[np.arange(n), lengths - 1] = -1
    before = np.broadcast_to(place - 1, (n, w)).copy()
    # a node holds rank * w + place: the smallest is the lowest rank, and of equals the leftmost
    tree = np.full((n, nodes), NONE * w, dtype=np.int64)
    rank, _ = v.pair(ids[:, :-1], ids[:, 1:]) if w > 1 else (np.zeros((n, 0), dtype=np.int64), None)
    tree[:, w : w + w - 1] = rank * w + place[:-1]
    level = w
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    live = np.arange(n)
    while len(live):
        root = tree[live, 1]
        live, root = live[root < NONE * w], root[root < NONE * w]
        if not len(live):
            break
        i = root % w
        j = following[live, i]
        k = following[live, j]
        h = before[live, i]
        _, merged = v.pair(ids[live, i], ids[live, j])
        ids[live, i], ids[live, j] = merged, -1
        following[live, i] = k
        inner = k >= 0
        before[live[inner], k[inner]] = i[inner]
        right, _ = v.pair(merged, np.where(inner, ids[live, k], -1))
        left, _ = v.pair(np.where(h >= 0, ids[live, h], -1), merged)
        outer = h >= 0
        _update(tree, live, i + w, right * w + i)
        _update(tree, live, j + w, np.full(len(live), NONE * w))
        _update(tree, live[outer], h[outer] + w, left[outer] * w + h[outer])
    return [row[row >= 0].tolist() for row in ids]


def _update(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
    """Set one leaf of each row and renew the minima above it."""
    tree[rows, node] = value
    while len(node) and node[0] > 1:
        value = np.minimum(value, tree[rows, node ^ 1])
        node = node >> 1
        tree[rows, node] = value


def encode_batch(v: Vocabulary, texts: list[str | None], cache: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Ids of each text; new pieces of the batch are merged together and kept in ``cache`` up to its bounds."""
    empty = np.zeros(0, dtype=np.int32)
    cut = [v.pieces.findall(t) if t else [] for t in texts]
    unknown = list({p for c in cut for p in c if p not in cache})
    fresh = {}
    if unknown:
        if len(cache) > CACHE_PIECES:
            cache.clear()
            unknown = list({p for c in cut for p in c})
        coded = merge_pieces(v, [p.encode("utf-8", "surrogatepass") for p in unknown])
        for p, ids in zip(unknown, coded):
            (cache if len(p) <= CACHE_BYTES else fresh)[p] = ids
    get = cache.get
    out = []
    for c in cut:
        ids = [x for p in c for x in (get(p) or fresh[p])]
        out.append(np.array(ids, dtype=np.int32) if ids else empty)
    return out


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of each row; rows are encoded where they are, without a shuffle."""
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, cache = vocabulary(path), {}
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                texts = [t if isinstance(t, str) else None for t in part["_text"]]
                yield pd.DataFrame({key: part[key].to_numpy(), "ids": encode_batch(v, texts, cache)})

    src = docs.select(F.col(key), F.col(text).alias("_text"))
    return src.mapInPandas(run, f"{key} {dict(src.dtypes)[key]}, ids array<int>")
