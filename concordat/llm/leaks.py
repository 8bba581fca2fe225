"""Held-out passages inside training text.

Passages and texts are reduced to their letters and digits alone (compatibility form, full case folding, no accents, blanks, punctuation or invisible
characters), so spacing, hyphenation and line breaks cannot hide a copy. One Aho-Corasick automaton holds every run of SEED words of every
passage; each text is scanned once. Where a passage has enough seeds in a text, the two are compared word by word in two ways: at the fixed distance of every
seed, which is exact for words replaced one by one, and from a seed to both sides, passing over words that differ, are missing, added or written apart.
The longest stretch within the tolerance is kept, with its offsets in the original text.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Words of a seed. A stretch of 16 words or more of which one in ten differs holds a run of at least 6 unchanged words, and at least MIN_SEEDS seeds.
SEED, MIN_SEEDS = 6, 3
#: Passages of one automaton, about 0.5 kB of memory a character; more passages are done in further scans.
BLOCK = 5_000
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_SIGNS = regex.compile(r"[^\p{L}\p{N}]+")
_APART = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_HIDDEN = regex.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
#: Characters of a text within which the next words of the passage are looked for after a difference.
REACH = 40
#: Words that may differ one after another where the alignment resumes.
MOST_MISSES = 3


def letters(text: str) -> str:
    """The letters and digits of a text in their folded form, without accents."""
    if text.isascii():
        return _SIGNS.sub("", text.lower())
    return _SIGNS.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def words(text: str) -> list[str]:
    """The words of a text in that form; characters of scripts without blanks count one word each."""
    out = []
    for w in _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKD", text))):
        w = letters(w)
        if w:
            out.extend(w if _APART.match(w) else (w,))
    return out


class Passages:
    """The automaton of some passages (id, text)."""

    def __init__(self, items: tuple[tuple[int, str], ...], least: int):
        self.words = [(k, words(t)) for k, t in items]
        self.words = [(k, w) for k, w in self.words if len(w) >= least]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, w) in enumerate(self.words):
            for p in range(len(w) - SEED + 1):
                where["".join(w[p : p + SEED])].append((n, p))
        self.automaton = ahocorasick.Automaton()
        for seed, places in where.items():
            self.automaton.add_word(seed, (len(seed), tuple(places)))
        self.automaton.make_automaton()
        self.any = bool(where)


@lru_cache(maxsize=2)
def _passages(items: tuple[tuple[int, str], ...], least: int) -> Passages:
    return Passages(items, least)


class Borders:
    """For every letter kept its place in the original, and where words begin and end among the kept letters."""

    def __init__(self, original: str):
        self.place: list[int] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        inside = apart = False
        for n, c in enumerate(original):
            kept = _letters_of(c)
            if kept:
                if not inside:
                    self.begin.append(len(self.place))
                    apart = bool(_APART.match(kept))
                elif apart:  # as in words()
                    self.end.append(len(self.place))
                    self.begin.append(len(self.place))
                self.place.extend([n] * len(kept))
                inside = True
            elif inside and not regex.match(r"[\p{M}]", c) and not _HIDDEN.match(c):
                self.end.append(len(self.place))
                inside = False
        if inside:
            self.end.append(len(self.place))
        self.begins, self.ends = {b: n for n, b in enumerate(self.begin)}, set(self.end)


@lru_cache(maxsize=20_000)
def _letters_of(char: str) -> str:
    return letters(char)


def _single(passage: list[str], p: int, text: str, d: int, step: int, borders: Borders) -> tuple[int, int, int] | None:
    """(place in the passage, place in the text, words passed over) of the next passage word that stands whole in the text after as many other words."""
    n = bisect_left(borders.begin, d) if step > 0 else bisect_right(borders.end, d) - 1
    for skip in range(1, MOST_MISSES + 1):
        q, m = p + step * skip, n + step * skip
        if not (0 <= q < len(passage) and 0 <= m < len(borders.begin)):
            return None
        if text[borders.begin[m] : borders.end[m]] == passage[q]:
            return q, borders.begin[m] if step > 0 else borders.end[m], skip
    return None


def _onward(passage: list[str], p: int, text: str, d: int, step: int, borders: Borders) -> list[tuple[bool, int, int, int]]:
    """(same, place in the passage, start, end in the text) of the words from p on, towards the end (step 1) or the start (step -1)."""
    out = []
    misses = 0
    while 0 <= p < len(passage):
        w = passage[p]
        if (text.startswith(w, d)) if step > 0 else (d >= len(w) and text.startswith(w, d - len(w))):
            a, b = (d, d + len(w)) if step > 0 else (d - len(w), d)
            out.append((True, p, a, b))
            d = b if step > 0 else a
            p += step
            misses = 0
            continue
        found = None
        for skip in (1, 0, 2):  # another word, a word more, two other words
            q = p + step * skip
            ahead = passage[q : q + 2] if step > 0 else passage[max(0, q - 1) : q + 1]
            if q < 0 or not ahead or (len(ahead) < 2 and len(ahead[0]) < 4):
                continue
            probe = "".join(ahead)
            if step > 0:
                at = text.find(probe, d, d + REACH + len(probe))
            else:
                at = text.rfind(probe, max(0, d - REACH - len(probe)), d)
                at = at + len(probe) if at >= 0 else -1
            if at >= 0 and (found is None or abs(at - d) < abs(found[1] - d)):
                found = (q, at, max(1, skip))
        found = found or _single(passage, p, text, d, step, borders)
        if found is None or misses + found[2] > MOST_MISSES:
            break
        misses += found[2]
        out.extend((False, p, d, d) for _ in range(found[2]))
        p, d = found[0], found[1]
    return out


def _stretch(flow: list[tuple[bool, int, int, int]], least: int, one_in: int) -> tuple[int, int, int] | None:
    """(words, first, last place in flow) of the longest part that begins and ends alike and in which at most one word in `one_in` differs."""
    wrong = [0, *accumulate(not same for same, *_ in flow)]
    best = None
    for a in range(len(flow)):
        if flow[a][0]:
            for b in range(len(flow), a + max(least, best[0] + 1 if best else 0) - 1, -1):
                if flow[b - 1][0] and (wrong[b] - wrong[a]) * one_in <= b - a:
                    best = (b - a, a, b - 1)
                    break
    return best


def _abreast(passage: list[str], text: str, seeds: list[tuple[int, int]], borders: Borders) -> Iterator[list[tuple[bool, int, int, int]]]:
    """As `_onward`, the passage against the words of the text at the distance of each seed that begins with a word."""
    for shift in {borders.begins[d] - p for d, p in seeds if d in borders.begins}:
        yield [
            (text[borders.begin[p + shift] : borders.end[p + shift]] == passage[p], p, borders.begin[p + shift], borders.end[p + shift])
            for p in range(max(0, -shift), min(len(passage), len(borders.begin) - shift))
        ]


def leaks(original: str, passages: Passages, least: int, one_in: int) -> list[tuple[int, int, int, int]]:
    """(item id, words, start, end) for every passage of which the text holds a stretch of at least `least` words."""
    text = letters(original)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, (size, places) in passages.automaton.iter(text):
        for n, p in places:
            hits[n].append((at - size + 1, p))
    out = []
    borders = None
    for n, seeds in hits.items():
        if len(seeds) < MIN_SEEDS:
            continue
        item, passage = passages.words[n]
        borders = borders or Borders(original)
        flows = list(_abreast(passage, text, seeds, borders))
        covered: list[tuple[int, int]] = []
        for d, p in seeds:
            if any(a <= d < b for a, b in covered):
                continue
            forth = _onward(passage, p, text, d, 1, borders)
            flows.append(_onward(passage, p - 1, text, d, -1, borders)[::-1] + forth)
            covered.append((d, max((x[3] for x in forth), default=d)))
        best = None
        for flow in flows:
            if sum(x[0] for x in flow) * one_in < least * (one_in - 1):
                continue
            while flow and not (flow[0][0] and flow[0][2] in borders.begins):
                flow.pop(0)
            while flow and not (flow[-1][0] and flow[-1][3] in borders.ends):
                flow.pop()
            got = _stretch(flow, least, one_in)
            if got and (best is None or got[0] > best[0]):
                best = (got[0], borders.place[flow[got[1]][2]], borders.place[flow[got[2]][3] - 1] + 1)
        if best:
            out.append((item, *best))
    return out


def _scan(batches: Iterator[pa.RecordBatch], items: tuple[tuple[int, str], ...], least: int, one_in: int) -> Iterator[pa.RecordBatch]:
    passages = _passages(items, least)
    for batch in batches:
        rows, found = [], []
        if passages.any:
            for row, text in enumerate(batch.column(1).to_pylist()):
                got = leaks(text, passages, least, one_in) if text else ()
                rows.extend([row] * len(got))
                found.extend(got)
        cols = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["key", "item_id", "n_words", "start_pos", "end_pos"])


def find(df: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, least: int = 16, one_in: int = 10) -> DataFrame:
    """(key, item_id, n_words, start_pos, end_pos): the longest stretch of each held-out passage that a text reproduces in order.

    A stretch has at least `least` words of which at most one in `one_in` is another; it is cut at word borders of the text; positions count code points
    of the original from 0. Null and empty texts or passages give no row, so do passages of fewer words than `least`. Repeated rows give their
    rows again. Texts of any length are scanned whole. The held-out set is read by the driver, BLOCK passages at a time, and each block scans the texts once.
    """
    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")).filter(F.col("t").isNotNull())
    held = items.select(F.col(f"`{item}`").cast("bigint").alias("k"), F.col(f"`{passage}`").alias("p")).na.drop().distinct().orderBy("k", "p")
    schema = f"key {kind}, item_id bigint, n_words bigint, start_pos bigint, end_pos bigint"
    out, block = None, []

    def scan(block: tuple) -> DataFrame:
        return slim.mapInArrow(lambda b: _scan(b, block, least, one_in), schema)

    for row in held.toLocalIterator():
        block.append((row["k"], row["p"]))
        if len(block) == BLOCK:
            part = scan(tuple(block))
            out, block = (part if out is None else out.unionByName(part)), []
    if block or out is None:
        part = scan(tuple(block))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)
