"""Evaluation passages in a training corpus (problem 7).

Texts are brought to a stream of letters (case, accents, marks and spaces go), cut at line ends and column gaps, since lines of
one passage may stand in any order among columns and adverts. By the q-gram lemma a stretch of n letters that is printed with at
most e edits over k line ends shares at least n - q + 1 - (q - 1) * k - q * e of its q-grams with the page. This bound is computed
for every stretch of ``min_words`` words of every passage, with e = EDIT_BUDGET * n and k = n / NARROW; a page and a passage of
which some stretch meets it stay. All q-grams count, however many passages share them. Of the pairs that stay, the shared q-grams
are counted by line and band of diagonals; bands overlap by half, so none is cut. Lines with a filled band are aligned to the
passage within the band, and aligned parts that follow each other (over a line end, where the neighbouring line's edge is aligned
too) are chained. An item leaks if a chain holds ``min_words`` consecutive words.

Words are parted by spaces; in scripts without spaces two letters (Thai: four) count as a word.

The search is a stated query set (the items) against all pages: the items go out in blocks of at most BLOCK_CHARS characters, the
pages stay where they are, and nothing is shuffled but the found pairs.

Defined results: null and empty texts and passages give no pairs; passages of fewer than ``min_words`` words can't leak; items
with the same passage all count; a pair comes once however often the passage is printed; repeated rows change nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a q-gram, diagonals of a band, share of edits within an aligned line.
Q, BAND, EDITS = 5, 6, 0.12
#: The edit budget of a stretch of words: edits per letter, and letters of the narrowest column that it may run over.
EDIT_BUDGET, NARROW = 0.05, 20
#: Q-grams of a line in one band from which it is aligned. Shorter pieces at a line's edge are found from their neighbour: up to
#: EDGE letters have fewer q-grams than that at one edit.
HITS, EDGE = 3, 16
#: An alignment ends where it falls so far below its best.
DROP = 11
#: Characters of items that go out at once, and pairs of q-grams of pages and passages that are looked at together.
BLOCK_CHARS, HIT_PAIRS = 20_000_000, 1_000_000
BASE = np.uint64(1_000_003)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> letter code; 0 for what is no letter or digit. Digits that are misread letters become the letter."""
    table = np.zeros(0x10000, dtype=np.uint32)
    looks = {"0": "o", "1": "l", "5": "s"}
    for cp in range(0x10000):
        ch = unicodedata.normalize("NFKD", chr(cp).lower())[0] if not 0xD800 <= cp < 0xE000 else " "
        if ch.isalnum():
            table[cp] = ord(looks.get(ch, ch)) & 0xFFFF
    return table


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(raw < 0x10000, raw, 32)


def _grams(letters: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = len(letters) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        h = h * BASE + letters[k : k + n].astype(np.uint64)
    return h


#: Scripts without spaces, with the letters that count as a word.
UNSPACED = re.compile("([぀-ヿ㐀-鿿]{1,2}|[฀-๿]{1,4})")


def _words(text: str) -> list[str]:
    return UNSPACED.sub(r" \1 ", text).split()


class Passages:
    """Distinct passages: letters, word of each letter, a sorted index of all their q-grams, and the bound of each stretch of words."""

    def __init__(self, texts: list[str], min_words: int):
        table = _letters()
        self.letters, self.word, self.size = [], [], []
        gram, who, where, stretch = [], [], [], []
        at = 0
        for p, text in enumerate(texts):
            parts = [x for x in (table[_codes(w)] for w in _words(text)) for x in [x[x > 0]] if len(x)]
            letters = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
            size = np.array([len(x) for x in parts], dtype=np.int64)
            self.letters.append(letters)
            self.word.append(np.repeat(np.arange(len(parts)), size))
            self.size.append(size)
            if len(parts) >= min_words:
                g = _grams(letters)
                gram.append(g)
                who.append(np.full(len(g), p))
                where.append(np.arange(len(g)))
                end = np.cumsum(size)
                first, last = end[: len(size) - min_words + 1] - size[: len(size) - min_words + 1], end[min_words - 1 :]
                n = last - first
                lost = (Q - 1) * (n // NARROW) + Q * np.floor(EDIT_BUDGET * n).astype(np.int64)
                most = np.maximum(last - Q + 1, first)
                stretch.append(np.stack([np.full(len(n), p), at + first, at + most, np.maximum(most - first - lost, 1)]))
                at += len(g)
        gram = np.concatenate(gram) if gram else np.zeros(0, dtype=np.uint64)
        who = np.concatenate(who) if who else np.zeros(0, dtype=int)
        where = np.concatenate(where) if where else np.zeros(0, dtype=int)
        # distinct q-grams, the one at each place, and all places ordered by passage and q-gram
        self.key, self.at = np.unique(gram, return_inverse=True)
        order = np.argsort(who * np.int64(len(self.key) or 1) + self.at, kind="stable")
        self.pair_key, self.where = (who * np.int64(len(self.key) or 1) + self.at)[order], where[order]
        self.key = np.append(self.key, np.iinfo(np.uint64).max)
        self.stretch = np.concatenate(stretch, axis=1) if stretch else np.zeros((4, 0), dtype=np.int64)
        # words that are there to 0.7 have so many letters
        self.least = np.array([int(0.7 * np.convolve(z, np.ones(min_words, dtype=int), "valid").min()) if len(z) >= min_words else min_words for z in self.size], dtype=np.int64)
        most = max([min_words, *map(len, self.size)])
        self.word_size = np.zeros((len(texts), most), dtype=np.int64)
        for p, size in enumerate(self.size):
            self.word_size[p, : len(size)] = size
        self.word_end = np.cumsum(self.word_size, axis=1)
        self.length = np.array([len(x) for x in self.letters], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*self.letters, np.zeros(1, dtype=np.uint32)])

    def shared(self, keys: np.ndarray) -> np.ndarray:
        """Passages with a stretch of which the q-grams ``keys`` of a page hold as many as the bound demands."""
        there = np.zeros(len(self.key), dtype=bool)
        there[keys] = True
        count = np.zeros(len(self.at) + 1, dtype=np.int32)
        np.cumsum(there[self.at], out=count[1:])
        who, first, end, need = self.stretch
        return np.unique(who[count[end] - count[first] >= need])


def _regions(px: Passages, letters: np.ndarray, seg: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, passage, diagonal) of each band with enough q-grams, for pages and passages that meet the lemma's bound."""
    g = _grams(letters)
    if not len(g) or not px.stretch.shape[1]:
        return
    at = np.searchsorted(px.key, g)
    hit = np.flatnonzero((px.key[at] == g) & (seg[: len(g)] == seg[Q - 1 :]))
    n_keys = np.int64(len(px.key) - 1)
    places, entries, passages, pairs = [], [], [], 0
    edges = np.flatnonzero(np.diff(doc[hit], append=-1)) + 1
    begin = 0
    for end in edges:
        part, begin = hit[begin:end], end
        who = px.shared(at[part])
        if len(who):
            wanted = (who[:, None] * n_keys + at[part][None]).ravel()
            low = np.searchsorted(px.pair_key, wanted)
            n = np.searchsorted(px.pair_key, wanted, side="right") - low
            some = np.flatnonzero(n)
            low, n = low[some], n[some]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            places.append(np.repeat(part[some % len(part)], n))
            passages.append(np.repeat(who[some // len(part)], n))
            entries.append(np.repeat(low, n) + inner)
            pairs += len(inner)
        if places and (pairs >= HIT_PAIRS or end == edges[-1]):
            found = _bands(px, np.concatenate(places), px.where[np.concatenate(entries)], np.concatenate(passages), seg)
            places, entries, passages, pairs = [], [], [], 0
            if len(found[0]):
                yield found


def _bands(px: Passages, place: np.ndarray, where: np.ndarray, who: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of diagonals with HITS shared q-grams of a line and a passage. Each hit stands in two bands, so a region of BAND / 2
    diagonals lies whole in one of them."""
    half = BAND // 2
    band = (place - where) // half
    low = int(band.min())
    span = int(band.max()) - low + 3
    base = (seg[place].astype(np.int64) * len(px.letters) + who) * span - low
    region, count = np.unique(np.concatenate([base + band, base + band + 1]), return_counts=True)
    region, count = region[count >= HITS], count[count >= HITS]
    # a band beside a fuller one that is aligned lies whole in that alignment's width
    left, right = np.diff(region, prepend=-9) == 1, np.diff(region, append=np.iinfo(np.int64).max) == 1
    before, after = np.append(0, count[:-1]), np.append(count[1:], 0)
    top = ~(left & (before >= count)) & ~(right & (after > count))
    region = region[top | ~((left & np.append(False, top[:-1])) | (right & np.append(top[1:], False)))]
    line_who = region // span
    return line_who // len(px.letters), line_who % len(px.letters), (region % span + low) * half


def _align(px: Passages, letters: np.ndarray, start: np.ndarray, size: int, length: np.ndarray, who: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best local alignment of each line in its band: score, line start and end, passage start and end (ends are one past the last).

    ``start`` and ``length`` give each line's letters, at most ``size``; ``diagonal`` is the line's place less the passage's. A cell holds
    score, highest score on the way, line start and start in the band, packed in this order, so the greater cell has the better score.
    """
    width = 3 + max(BAND // 2, int(EDITS * size))
    wide, m = 2 * width + 1, len(who)
    # bits of the start in the band, the line start and a score; short lines fit 32 bits
    cb, ib, sb = wide.bit_length(), size.bit_length(), (2 * size).bit_length()
    kind = np.int32 if cb + ib + 2 * sb < 31 else np.int64
    hs, ss = cb + ib, cb + ib + sb
    one, low, mask = kind(1 << ss), kind((1 << hs) - 1), kind((1 << sb) - 1)
    k = np.arange(size)[:, None]
    line = np.where(k < length, letters[np.minimum(start + k, len(letters) - 1)], 0x7FFFFFFF).astype(np.int32)
    place = np.arange(size + wide)[:, None] - diagonal - width
    there = (place >= 0) & (place < px.length[who])
    text = np.where(there, px.flat[np.where(there, px.first[who] + place, 0)], 0).astype(np.int32)
    col = np.arange(wide, dtype=kind)[:, None]
    cell = np.zeros((wide, m), dtype=kind)
    best = np.zeros(m, dtype=kind)
    end, end_col = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    for i in range(size):
        down = cell - kind(3) * one
        now = np.where(text[i : i + wide] == line[i], np.maximum(cell, kind(i << cb) + col) + kind(2) * one, down)
        np.maximum(now[:-1], down[1:], out=now[:-1])
        # other words in a row end the alignment: three edits may follow each other, not more
        for _ in range(3):
            now[1:] = np.maximum(now[1:], now[:-1] - kind(3) * one)
        score = now >> kind(ss)
        high = np.maximum((now >> kind(hs)) & mask, score)
        alive = (score > 0) & (score > high - kind(DROP))
        cell = ((score << kind(ss)) | (high << kind(hs)) | (now & low)) * alive
        value = cell.max(axis=0)
        better = np.flatnonzero((value >> kind(ss)) > (best >> kind(ss)))
        best[better], end[better], end_col[better] = value[better], i, cell[:, better].argmax(axis=0)
    i0, col0 = ((best & low) >> kind(cb)).astype(np.int64), (best & kind((1 << cb) - 1)).astype(np.int64)
    return (best >> kind(ss)).astype(np.int64), i0, end + 1, i0 - diagonal + col0 - width, end + 1 - diagonal + end_col - width


def _edge(line: list[int], passage: list[int]) -> int:
    """Letters at the start of the line that go on as the passage does: three at least, or the whole line."""
    score, good = 0, 0
    for k, (a, b) in enumerate(zip(line, passage), 1):
        score += 2 if a == b else -3
        if score >= (2 - 5 * EDITS) * k:
            good = k
        elif score <= -DROP:
            break
    return good if good >= min(3, len(line)) else 0


def _verify(parts: list[tuple[int, int, int, bool, bool]], line_of: list[np.ndarray], letters: np.ndarray, word: np.ndarray, size: np.ndarray, min_words: int) -> bool:
    """Whether the lines hold ``min_words`` consecutive words of the passage. A part is (passage start, passage end, line, touches the
    line's start, touches its end)."""
    more = set(parts)
    text = letters.tolist()
    for j0, j1, k, head, tail in parts:
        if tail and k + 1 < len(line_of):
            n = _edge(line_of[k + 1][:EDGE].tolist(), text[j1 : j1 + EDGE])
            if n:
                more.add((j1, j1 + n, k + 1, True, n >= len(line_of[k + 1]) - 2))
        if head and k > 0:
            n = _edge(line_of[k - 1][: -EDGE - 1 : -1].tolist(), text[max(0, j0 - EDGE) : j0][::-1])
            if n:
                more.add((j0 - n, j0, k - 1, n >= len(line_of[k - 1]) - 2, True))
    parts = sorted(more)
    reach: list[int] = []  # first letter of the chain so far of each part
    best = 0
    for k, (j0, j1, _, head, _) in enumerate(parts):
        start = j0
        if head:
            for m in range(k):
                if parts[m][4] and -4 <= j0 - parts[m][1] <= 5:
                    start = min(start, reach[m])
        reach.append(start)
        if word[j1 - 1] - word[start] + 1 < min_words:
            continue
        inside = np.bincount(word[start:j1], minlength=len(size))
        run = 0
        for w in (inside >= np.maximum(1, 0.7 * size)).tolist():
            run = run + 1 if w else 0
            best = max(best, run)
    return best >= min_words


def _covered(px: Passages, pair: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int) -> np.ndarray:
    """Pairs whose parts together could hold the words in a row: no chain reaches beyond the union of its parts."""
    keys, first, back = np.unique(pair, return_index=True, return_inverse=True)
    back, whose = back.ravel(), who[first]
    good = np.bincount(back, high - low) >= px.least[whose]
    span = int(px.length.max()) + 1
    number = np.cumsum(good) - 1
    rows = np.flatnonzero(good)
    order = np.flatnonzero(good[back])
    order = order[np.argsort(number[back[order]], kind="stable")]
    at = number[back[order]]
    for a in range(0, len(rows), 2048):
        r = rows[a : a + 2048]
        mine = order[np.searchsorted(at, a) : np.searchsorted(at, a + len(r))]
        k = (number[back[mine]] - a) * span
        cover = np.bincount(k + low[mine], minlength=len(r) * span) - np.bincount(k + high[mine], minlength=len(r) * span)
        inside = np.cumsum(np.cumsum(cover.reshape(len(r), span), axis=1) > 0, axis=1)
        inside = np.concatenate([np.zeros((len(r), 1), dtype=inside.dtype), inside], axis=1)
        end, size = px.word_end[whose[r]], px.word_size[whose[r]]
        here = np.take_along_axis(inside, end, axis=1) - np.take_along_axis(inside, np.maximum(end - size, 0), axis=1)
        run = np.cumsum((size > 0) & (here >= np.maximum(1, 0.7 * size)), axis=1)
        run = np.concatenate([np.zeros((len(r), 1), dtype=run.dtype), run], axis=1)
        good[r] = (run[:, min_words:] - run[:, :-min_words] >= min_words).any(axis=1)
    return good[back]


def _search(px: Passages, texts: list[str], min_words: int) -> list[tuple[int, int]]:
    """(number of the text, number of the passage) of each verified pair."""
    table = _letters()
    joined = "\n".join(texts)
    raw = _codes(joined)
    lengths = np.array([len(t) for t in texts]) + 1
    doc_of = np.repeat(np.arange(len(texts)), lengths)[: len(raw)]
    space = raw == 32
    wide = np.zeros(len(raw), dtype=bool)
    if len(raw) > 2:
        wide[2:] = space[2:] & space[1:-1] & space[:-2]
    code = table[raw]
    keep = code > 0
    letters, doc = code[keep], doc_of[keep]
    if not len(letters):
        return []
    # lines by number, those without letters left out
    seg = np.cumsum(np.diff(np.cumsum((raw == 10) | wide)[keep], prepend=0) > 0)
    seg -= seg[0]
    start = np.flatnonzero(np.diff(seg, prepend=-1))
    length = np.diff(start, append=len(letters))
    found = []
    for line, who, diagonal in _regions(px, letters, seg, doc):
        out = []
        sizes = -(-length[line] // 8) * 8
        for size in np.unique(sizes).tolist():
            every = np.flatnonzero(sizes == size)
            step = max(64, 60_000 // (7 + size // 4))
            for a in range(0, len(every), step):
                r = every[a : a + step]
                score, i0, i1, j0, j1 = _align(px, letters, start[line[r]], size, length[line[r]], who[r], diagonal[r] - start[line[r]])
                fit = score >= np.maximum(8, (2 - 5 * EDITS) * (j1 - j0))
                out.append(np.stack([line[r], who[r], j0, j1, i0 <= 2, i1 >= length[line[r]] - 2])[:, fit])
        if not out:
            continue
        line, who, j0, j1, head, tail = np.concatenate(out, axis=1)
        pair = doc[start[line]].astype(np.int64) * len(px.letters) + who
        low = np.where(head > 0, np.maximum(j0 - EDGE, 0), j0)
        high = np.where(tail > 0, np.minimum(j1 + EDGE, px.length[who]), j1)
        sel = np.flatnonzero(_covered(px, pair, who, low, high, min_words))
        sel = sel[np.argsort(pair[sel], kind="stable")]
        for part in np.split(sel, np.flatnonzero(np.diff(pair[sel])) + 1) if len(sel) else ():
            d, p = divmod(int(pair[part[0]]), len(px.letters))
            a, b = np.searchsorted(doc[start], [d, d + 1])
            lines = [letters[start[k] : start[k] + length[k]] for k in range(a, b)]
            parts = [(int(j0[r]), int(j1[r]), int(line[r] - a), bool(head[r]), bool(tail[r])) for r in part]
            if _verify(parts, lines, px.letters[p], px.word[p], px.size[p], min_words):
                found.append((d, p))
    return found


def leaked(docs: DataFrame, items: DataFrame, min_words: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id of every pair of page and leaked item."""
    spark = docs.sparkSession
    usable = items.where(F.col("item_id").isNotNull() & (F.length(F.trim("passage")) > 0)).select("item_id", "passage").distinct()
    total = usable.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = -(-total // block_chars)
    src = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    out = None
    for k in range(int(blocks)):
        part = usable.where(F.pmod(F.xxhash64("passage"), F.lit(int(blocks))) == k).orderBy("passage", "item_id").collect()  # at most about block_chars
        texts = list(dict.fromkeys(r["passage"] for r in part))
        ids: list[list[int]] = [[] for _ in texts]
        number = {t: i for i, t in enumerate(texts)}
        for r in part:
            ids[number[r["passage"]]].append(r["item_id"])
        sent = spark.sparkContext.broadcast((texts, ids))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            texts, ids = sent.value
            px = Passages(texts, min_words)
            for b in batches:
                key, text = b["doc_id"].to_numpy(), b["text"].tolist()
                at = 0
                while at < len(text):
                    end, chars = at, 0
                    while end < len(text) and (end == at or chars + len(text[end]) < 200_000):
                        chars += len(text[end])
                        end += 1
                    pairs = [(key[at + d], i) for d, p in _search(px, text[at:end], min_words) for i in ids[p]]
                    yield pd.DataFrame(pairs, columns=["doc_id", "item_id"]).astype("int64")
                    at = end

        one = src.mapInPandas(run, "doc_id bigint, item_id bigint")
        out = one if out is None else out.unionByName(one)
    return (spark.createDataFrame([], "doc_id bigint, item_id bigint") if out is None else out).distinct()


def leak_report(found: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """Per item: suite, lang, pages that hold it and the first of them; items without a page have 0."""
    one = items.groupBy("item_id").agg(F.max("suite").alias("suite"), F.max("lang").alias("lang"))
    pages = found.groupBy("item_id").agg(F.count("*").alias("n_pages"), F.min("doc_id").alias("first_doc_id"))
    return one.join(pages, "item_id", "left").select("item_id", "suite", "lang", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "first_doc_id")
