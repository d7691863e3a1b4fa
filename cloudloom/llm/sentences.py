"""Sentence units of pages in many languages and layouts (problem 8).

Each stream of a page (see ``layout``) is read by a pushdown automaton: its stack holds the open quotations and brackets, and
nothing inside them ends a unit. A mark ends a unit unless the trie of abbreviations, read backwards from the mark, or the letter
behind it says otherwise. Scripts have their own end marks; in Thai, spaces that touch no number are the marks. A second stack holds
the levels of lists: a printed line that opens with the next number, letter or bullet of an open level closes the levels below it, and
each item of a level with two items or more starts a unit, whether or not a mark ends the text before it.

Defined results: null, empty and blank texts have no units; boxes that are missing or don't fit the lines are not used; the last
unit of a heading, an advert or an article ends at its last character, with or without a mark; a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import join, streams

# Abbreviations that never end a unit, by what follows them (names, numbers, the rest of the phrase).
ABBREVIATIONS = {
    "en": "capt prof rev mrs mr messrs dr st no approx e.g i.e viz col gen lt sgt hon jr vol pp fig p",
    "de": "z z.b b d d.h h nr s st hr fr hptm ing prof dr u bzw ca geb vgl abs",
    "fr": "p ex p.ex c.-à-d no st ste m mm mgr mme mlle dr me",
    "es": "p ej p.ej pág núm sta sto d gral sra dra dr sr dña cap",
    "ru": "т стр ул инж проф г гр см д-р им тов акад н",
    "ar": "د ص أ م ق ق.م",
    "hi": "डॉ पृ रु श्री",
    "th": "น พ พ.ศ",
}
# Month names that follow a German ordinal.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()
OPEN = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "《": "》", "‘": "’"}
CLOSERS = "”»)]」』）》"
END_MARKS = ".!?…。！？।؟॥．·"
EVENT = re.compile(r"[.!?…。！？।؟॥．·“”„«»()\[\]「」『』（）《》]")
#: The quotation marks and brackets among the events.
PAIRED = re.compile(r"[“”„«»()\[\]「」『』（）《》]")
WORD = re.compile(r"\w+")
NO_WORD = frozenset("“”„«»()[]¡¿—")
CYRILLIC = re.compile(r"[а-яё]")
# Words that tell German from the other Latin languages.
GERMAN = frozenset("der Der die Die und von das Das am zum".split())
OTHER = frozenset("the The of la La el El de at At was".split())
# the mark stands first, so that the search steps from mark to mark
OPENER = re.compile(r"[.!?](?<=[a-zà-ÿа-я].) (?=([A-ZÀ-ßА-Я]\w*))")
THAI_EVENT = re.compile(r"\s+|[“”„«»()\[\]「」『』（）《》]")
# Numbers of list items in Han characters, from one to ten.
HAN_NUMBERS = "一二三四五六七八九十"
ITEM = re.compile(rf"(?m)^[ \t\u3000]*((?P<bullet>[•‣◦▪])|[(（]?(?:(?P<number>\d{{1,3}})|(?P<letter>[A-Za-z])|(?P<roman>[ivx]{{1,5}}|[IVX]{{1,5}})|(?P<han>[{HAN_NUMBERS}]))[.)）．、])(?=\s|[^\x00-\x7f])")
ROMAN = {"i": 1, "v": 5, "x": 10}
SPACING = re.compile(r"[\s\d.,]")
HAN = re.compile(r"[぀-ヿ㐀-鿿]")
THAI = re.compile(r"[฀-๿]")
DEVANAGARI = re.compile(r"[ऀ-ॣ]")
ARABIC = re.compile(r"[؀-ۿ]")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node[""] = True
    return root


TRIES = {lang: _trie(words.split()) for lang, words in ABBREVIATIONS.items()}
ALL = _trie([w for words in ABBREVIATIONS.values() for w in words.split()])
LATIN = _trie([w for lang in ("en", "de", "fr", "es") for w in ABBREVIATIONS[lang].split()])


def _is_abbreviation(word: str, trie: dict) -> bool:
    node = trie
    for ch in reversed(word.lower()):
        node = node.get(ch)
        if node is None:
            return False
    return "" in node


#: Abbreviations long enough to be known with one letter misread, by their length.
LONG: dict[int, list[str]] = {}
for _w in (w for words in ABBREVIATIONS.values() for w in words.split() if len(w) > 3 and w.isalpha()):
    LONG.setdefault(len(_w), []).append(_w)


def _misread(word: str) -> bool:
    return any(sum(a != b for a, b in zip(w, word)) == 1 for w in LONG.get(len(word), ()))


def _word_before(s: str, i: int) -> str:
    """The word that ends at place i, of 24 letters at most."""
    k, low = i, max(0, i - 24)
    while k > low and s[k - 1] not in NO_WORD and not s[k - 1].isspace():
        k -= 1
    return s[k:i]


def script(text: str) -> str:
    """han, thai, hindi, arabic or cased, by the most frequent letters."""
    if text.isascii():
        return "cased"
    n = 0
    for name, kind in (("han", HAN), ("thai", THAI), ("hindi", DEVANAGARI), ("arabic", ARABIC)):
        if kind.search(text):
            n = n or max(1, len(text) - len(SPACING.findall(text)))
            if len(kind.findall(text)) > 0.4 * n:
                return name
    return "cased"


def _matched(s: str) -> set[int]:
    """Places of quotation marks and brackets that have their partner; others are taken as noise."""
    stack: list[tuple[str, int]] = []
    good: set[int] = set()
    for m in PAIRED.finditer(s):
        ch, i = m.group(), m.start()
        if ch == "“" and stack and stack[-1][0] == "„":
            good.update((stack.pop()[1], i))
        elif ch in OPEN:
            stack.append((ch, i))
        elif ch in CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if OPEN[stack[k][0]] == ch or (stack[k][0] == "„" and ch == "”"):
                    good.update((stack[k][1], i))
                    del stack[k:]
                    break
    return good


def _roman(word: str) -> int:
    values = [ROMAN[ch] for ch in word]
    return sum(-v if v < max(values[i:]) else v for i, v in enumerate(values))


def _item_marks(text: str) -> list[tuple[int, int, set[tuple[str, int]]]]:
    """Numbers, letters and bullets at the head of printed lines: first place, place behind, and each (style, number) it may be."""
    out = []
    for m in ITEM.finditer(text):
        mark, kinds = m.group(1), set()
        around = (mark[0] if mark[0] in "(（" else "") + "{}" + mark[-1]
        if m["bullet"]:
            kinds.add((mark, 0))
        elif m["number"]:
            month = re.match(r"\W*(\w+)", text[m.end() : m.end() + 30])
            if not (month and _is_month(month.group(1).lower())):
                kinds.add((around.format("1"), int(m["number"])))
        elif m["han"]:
            kinds.add((around.format("一"), HAN_NUMBERS.index(m["han"]) + 1))
        word = m["letter"] or m["roman"]
        if word:
            case = "A" if word.isupper() else "a"
            # a capital with a dot behind an open sentence is an initial
            if case == "A" and mark[-1] == "." and text[: m.start(1)].rstrip()[-1:] not in f"{END_MARKS}:;":
                continue
            if len(word) == 1:
                kinds.add((around.format(case), ord(word.lower()) - ord("a") + 1))
            if set(word.lower()) <= set(ROMAN):
                kinds.add((around.format(case + "i"), _roman(word.lower())))
        if kinds:
            out.append((m.start(1), m.end(1), kinds))
    return out


def _list_items(marks: list[tuple[int, int, set[tuple[str, int]]]]) -> list[tuple[int, int]]:
    """(first place, place behind) of the marks that are items, which come in reading order. The stack holds the open levels by style and last
    number; a level opens with its first number and counts once it has a second item."""
    stack: list[tuple[str, int, tuple[int, int]]] = []
    good: set[tuple[int, int]] = set()
    for at, behind, kinds in marks:
        for k in range(len(stack) - 1, -1, -1):
            style, last, opened = stack[k]
            n = last + 1 if last else 0
            if (style, n) in kinds:
                del stack[k:]
                stack.append((style, n, (at, behind)))
                good.update((opened, (at, behind)))
                break
        else:
            stack += [(style, n, (at, behind)) for style, n in sorted(kinds) if n <= 1]
    return list(good)


def _next_letter(s: str, i: int) -> str:
    """The first letter or digit behind place i, beyond openers and dashes; empty at the end."""
    while i < len(s) and not s[i].isalnum():
        i += 1
    return s[i] if i < len(s) else ""


def _break(s: str, unit: int, at: int, ends: list[int]) -> int:
    """Ends the open unit at its last character before ``at``; gives the start of the next unit."""
    text = s[unit:at].rstrip()
    if not text.strip():
        return unit
    ends.append(unit + len(text) - 1)
    return unit + len(text)


def _ends(s: str, kind: str, trie: dict, german: bool, starts: list[tuple[int, int]]) -> list[int]:
    """Places of the last characters of the units within one stream (the last unit left out). ``starts`` are places where a unit starts
    unless a quotation or bracket is open there, each with the place behind its mark; ascending."""
    good = _matched(s)
    depth, stack, opened_at, unit = 0, [], None, 0
    ends: list[int] = []
    n, skip, at = len(s), -1, 0
    for m in EVENT.finditer(s):
        i, ch = m.start(), m.group()
        while at < len(starts) and starts[at][0] <= i:
            if not depth:
                unit = _break(s, unit, starts[at][0], ends)
                skip = max(skip, starts[at][1] - 1)
            at += 1
        if i <= skip:
            continue
        if ch not in END_MARKS:
            if i in good:
                if ch in OPEN and not (ch == "“" and stack and stack[-1] == "„"):
                    if not depth:
                        opened_at = i
                    stack.append(ch)
                    depth += 1
                elif depth:
                    stack.pop()
                    depth -= 1
            continue
        j = i
        while j + 1 < n and s[j + 1] in END_MARKS:
            j += 1
        dots = s[i : j + 1]
        skip = j
        # closing marks behind the end mark; French sets a space before them
        e, d = j, depth
        k = j + 1
        closed = False
        while k < n:
            q = k + 1 if s[k] == " " and k + 1 < n and s[k + 1] == "»" and k + 1 in good else k
            if q < n and q in good and (s[q] in CLOSERS or (s[q] == "“" and stack and stack[-1] == "„")) and d:
                d -= 1
                stack.pop()
                closed = True
                e, k = q, q + 1
                while k < n and s[k] in END_MARKS:
                    e, k = k, k + 1
            else:
                break
        depth = d
        skip = e
        if depth:
            continue
        if kind == "han":
            if dots.strip("….·") == "":
                continue
            after = s[e + 1 : e + 2]
            if closed and (s[unit:opened_at].strip() == "" or after in ("と", "，", "、", ",")):
                continue
        else:
            if e + 1 < n and not s[e + 1].isspace() and not closed:
                continue
            nxt = _next_letter(s, e + 1)
            if nxt.islower():
                continue
            if kind == "hindi" and ch in ".·":
                continue
            if kind in ("hindi", "arabic") and closed and s[unit:opened_at].strip() == "":
                continue
            if dots in (".", "·") and not closed:
                word = _word_before(s, i).strip(",;:'·")
                core = word.replace("·", "").replace("'", "")
                if len(core) <= 3 and s[unit:i].strip() == core and (core.isdigit() or (len(core) == 1 and core.isalpha())):
                    continue  # the number of a list item opens the unit, at any level
                if len(core) > 3 and core[:1].isupper() and nxt.isupper() and _misread(core.lower()):
                    continue
                if _is_abbreviation(core, trie) and not (core.lower() in ("p", "no", "s", "nr", "pág", "núm", "стр") and not (nxt.isdigit() or nxt == "")):
                    continue
                if len(core) == 1 and core.isupper() and nxt.isupper():
                    continue
                if german and core.isdigit() and len(core) <= 2:
                    nextword = re.match(r"\W*(\w+)", s[e + 1 : e + 30])
                    if nextword and _is_month(nextword.group(1).lower()):
                        continue
            elif set(dots) <= {".", "…"} and len(dots) > 1 and not nxt.isupper():
                continue
        if s[unit : e + 1].strip():
            ends.append(e)
            unit = e + 1
    for k, _ in starts[at:]:
        if not depth:
            unit = _break(s, unit, k, ends)
    return ends


def _lost_marks(s: str) -> list[int]:
    """Places where a unit must have ended though its mark was misread or lost: before a capital word that opens units elsewhere in
    the stream and is an ordinary word, as it also stands there without capital; what is left in the mark's place is the end."""
    openers = {w for w in OPENER.findall(s) if (len(w) == 1 or not w.isupper()) and f" {w.lower()} " in s}
    if not openers:
        return []
    found = []
    for w in openers:
        i = s.find(f" {w} ")
        while i > 0:
            before = s[i - 1]
            if (before.isalpha() and not before.isupper()) or before in ",;'":
                found.append(i - 1)
            i = s.find(f" {w} ", i + 1)
    return found


def _is_month(word: str) -> bool:
    return any(abs(len(m) - len(word)) <= 1 and sum(a != b for a, b in zip(m, word)) <= (1 if len(m) < 5 else 2) for m in MONTHS)


def _thai_ends(s: str, starts: list[tuple[int, int]]) -> list[int]:
    good, stack, unit, at = _matched(s), [], 0, 0
    ends: list[int] = []
    for m in THAI_EVENT.finditer(s):
        i, ch = m.start(), m.group()
        while at < len(starts) and starts[at][0] <= i:
            unit = unit if stack else _break(s, unit, starts[at][0], ends)
            at += 1
        if i in good:
            if ch in OPEN and not (ch == "“" and stack and stack[-1] == "„"):
                stack.append(ch)
            elif stack:
                stack.pop()
        elif ch.isspace() and not stack and not any(k <= i <= e for k, e in starts[max(0, at - 1) : at]):
            a, b = s[i - 1 : i], s[m.end() : m.end() + 1]
            if a and b and not a.isdigit() and not b.isdigit() and a not in ".," and THAI.match(b):
                unit = _break(s, unit, i, ends)
    for k, _ in starts[at:]:
        unit = unit if stack else _break(s, unit, k, ends)
    return ends


def _stream_units(text: str, boxes, lang: str | None) -> Iterator[tuple[str, list[int], list[int]]]:
    """Per stream: its joined text, the place of each of its characters in ``text``, and the ends of its units in the joined text."""
    kind = script(text)
    lang = (lang or "").lower()
    if kind == "cased":
        cyrillic = bool(CYRILLIC.search(text)) and len(CYRILLIC.findall(text)) > 0.3 * len(text)
        words = [] if cyrillic else WORD.findall(text)
        german = sum(map(GERMAN.__contains__, words)) > sum(map(OTHER.__contains__, words))
        trie = TRIES["ru"] if cyrillic else TRIES["de"] if german else TRIES.get(lang if lang in ("en", "fr", "es") else "", LATIN)
    else:
        german, trie = False, {"arabic": TRIES["ar"], "hindi": TRIES["hi"]}.get(kind, ALL)
    read = [(st.kind, *join(text, st, spaced=kind not in ("han", "thai"))) for st in streams(text, boxes)]
    marks, items = _item_marks(text), set()
    if len(marks) > 1:
        # a list goes on over streams, in reading order
        order = {p: k for k, p in enumerate(p for _, _, places in read for p in places)}
        items = {m[:2] for m in _list_items(sorted((m for m in marks if m[0] in order), key=lambda m: order[m[0]]))}
    for part, s, places in read:
        last = len(s.rstrip()) - 1
        if last < 0:
            continue
        ends: list[int] = []
        if part != "heading":
            starts: list[tuple[int, int]] = []
            if items:
                here = {p: k for k, p in enumerate(places)}
                starts = sorted((here[a], here[a] + b - a) for a, b in items if a in here)
            if kind == "cased":
                starts = sorted([*starts, *((e + 1, e + 1) for e in _lost_marks(s))])
            ends = _thai_ends(s, starts) if kind == "thai" else _ends(s, kind, trie, german, starts)
        yield s, places, [*(e for e in ends if e < last), last]


def unit_ends(text: str | None, boxes=None, lang: str | None = None) -> list[int]:
    """Places in the text of the last character of each unit, ascending."""
    if not text or not text.strip():
        return []
    return sorted({places[e] for _, places, ends in _stream_units(text, boxes, lang) for e in ends})


def unit_pieces(text: str | None, boxes=None, lang: str | None = None) -> list[tuple[list[tuple[int, int]], str]]:
    """Each unit's pieces in the text, as (first place, last place) in reading order, and its text with line ends and hyphens undone.
    A unit that an advert or a column interrupts has several. Units stand in the order of their last place."""
    if not text or not text.strip():
        return []
    out: dict[int, tuple[list[tuple[int, int]], str]] = {}
    for s, places, ends in _stream_units(text, boxes, lang):
        start = 0
        for e in sorted(set(ends)):
            at = [k for k in range(start, e + 1) if not s[k].isspace()]
            pieces: list[tuple[int, int]] = []
            for k in at:
                # places between two characters of a piece hold only what joining took out
                if pieces and places[k] > pieces[-1][1] and not text[pieces[-1][1] + 1 : places[k]].strip(" \t\r\n-¬"):
                    pieces[-1] = (pieces[-1][0], places[k])
                else:
                    pieces.append((places[k], places[k]))
            if pieces:
                out[places[e]] = (pieces, s[start : e + 1].strip())
            start = e + 1
    return [out[k] for k in sorted(out)]


def _pages(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "lang", *[F.col(f"line_boxes.{c}").alias(c) for c in ("x0", "x1", "y0")])


def _read(batch: pd.DataFrame) -> Iterator[tuple[int, str | None, list | None, str | None]]:
    """doc_id, text, boxes and lang of the pages of a batch."""
    for doc_id, text, lang, x0, x1, y0 in zip(batch["doc_id"], batch["text"], batch["lang"], batch["x0"], batch["x1"], batch["y0"]):
        boxes = None
        if x0 is not None:
            places = zip(x0.tolist(), x1.tolist(), y0.tolist())  # a missing number is None or unequal to itself
            boxes = [{"x0": p, "x1": q, "y0": r} if p is not None and q is not None and r is not None and p == p and q == q and r == r else None for p, q, r in places]
        yield doc_id, text if isinstance(text, str) else None, boxes, lang if isinstance(lang, str) else None


def sentence_units(docs: DataFrame) -> DataFrame:
    """doc_id, end_pos of every unit of documents (doc_id, text, lang, line_boxes); rows stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids: list[int] = []
            ends: list[int] = []
            for doc_id, text, boxes, lang in _read(b):
                found = unit_ends(text, boxes, lang)
                ids += [doc_id] * len(found)
                ends += found
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "end_pos": pd.Series(ends, dtype="int32")})

    return _pages(docs).mapInPandas(run, "doc_id bigint, end_pos int")


def unit_table(docs: DataFrame) -> DataFrame:
    """Units with their number, pieces and text: doc_id, unit_no, start_pos, end_pos, pieces ARRAY<STRUCT<start, end>>, unit. ``start_pos`` is
    the first place of the first piece in reading order, ``end_pos`` the last place of the last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (doc_id, k, pieces[0][0], pieces[-1][1], [{"start": x, "end": y} for x, y in pieces], unit)
                for doc_id, text, boxes, lang in _read(b)
                for k, (pieces, unit) in enumerate(unit_pieces(text, boxes, lang))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "unit_no", "start_pos", "end_pos", "pieces", "unit"])

    return _pages(docs).mapInPandas(run, "doc_id bigint, unit_no int, start_pos int, end_pos int, pieces array<struct<start:int,end:int>>, unit string")
