"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text is cut into atoms: sentences, and where one is too long, words or at last single stretches of characters. Every boundary between atoms has a strength
(blank line, line break, sentence end, clause, blank, none). Adjacent pairs wait in a heap and the weakest boundary is merged
first, while the combined size plus the overlap fits; so the cuts that remain are the strongest ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

_CUTS = regex.compile(r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>\n\s*)|(?P<s>[.!?…。！？؟।;]+[\"'”’»)\]」』）]*(?P<sb>[^\S\n]+|(?<=[。！？।][”」』）]*)(?=\S)))")
_CLAUSES = regex.compile(r"(?P<c>[,;:、，；：](?:\s+|(?<=[、，；：])))|(?P<w>\s+)")
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, NONE = 5, 4, 3, 2, 1, 0


def _atoms(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at end); they cover the text, none is longer than most."""
    out: list[tuple[int, int, int]] = []

    def hard(start: int, end: int, strength: int) -> None:
        while end - start > most:
            cut = start + most
            while cut > start + most // 2 and regex.match(r"\p{M}", text[cut]):  # a mark stays with its letter
                cut -= 1
            out.append((start, cut, NONE))
            start = cut
        out.append((start, end, strength))

    def fine(start: int, end: int, strength: int) -> None:
        if end - start <= most:
            out.append((start, end, strength))
            return
        at = start
        for m in _CLAUSES.finditer(text, start, end):
            if m.end() < end:
                hard(at, m.end(), CLAUSE if m.lastgroup == "c" else BLANK)
                at = m.end()
        hard(at, end, strength)

    at = 0
    for m in _CUTS.finditer(text):
        if 0 < m.end() < len(text):
            fine(at, m.end(), PARAGRAPH if m["p"] is not None else LINE if m["l"] is not None else SENTENCE)
            at = m.end()
    if at < len(text):
        fine(at, len(text), NONE)
    return out


def pieces(text: str, limit: int = 2500, overlap: int = 200) -> list[tuple[int, int, int]]:
    """(start, core_start, end) of the pieces of a text: the cores cover it without gap, each piece is at most `limit` characters and begins about `overlap` characters before its core.

    A text within the limit is one piece. The overlap begins at a word where there is one, so it may be some characters shorter.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    most = limit - overlap
    atoms = _atoms(text, most)
    start, end, strength = [a[0] for a in atoms], [a[1] for a in atoms], [a[2] for a in atoms]
    n = len(atoms)
    after, before, version = [*range(1, n), -1], [-1, *range(n - 1)], [0] * n
    size = lambda a, b: end[b] - start[a] + (overlap if start[a] else 0)
    heap = [(strength[k], size(k, k + 1), k, 0, 0) for k in range(n - 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, _, a, va, vb = heapq.heappop(heap)
        b = after[a] if alive[a] else -1
        if b < 0 or version[a] != va or version[b] != vb or size(a, b) > limit:
            continue
        end[a], strength[a], after[a], alive[b] = end[b], strength[b], after[b], False
        version[a] += 1
        if after[a] >= 0:
            before[after[a]] = a
            heapq.heappush(heap, (strength[a], size(a, after[a]), a, version[a], version[after[a]]))
        if before[a] >= 0:
            heapq.heappush(heap, (strength[before[a]], size(before[a], a), before[a], version[before[a]], version[a]))
    out = []
    for k in range(n):
        if alive[k]:
            core = start[k]
            low = max(0, core - overlap)
            if out and low:
                m = regex.compile(r"\s\S").search(text, low - 1, core)
                low = m.start() + 1 if m and m.start() + 1 < core - overlap // 2 else low
            out.append((low if out else core, core, end[k]))
    return out


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += [(key, n, s, c, e, text[s:e]) for n, (s, c, e) in enumerate(pieces(text, limit, overlap))]
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.types[0], pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["rec_id", "piece_no", "start_pos", "core_start", "end_pos", "piece"])


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2500, overlap: int = 200) -> DataFrame:
    """(rec_id, piece_no, start_pos, core_start, end_pos, piece) of every text longer than `limit` characters; positions count code points from 0.

    Null, empty and short texts give no row. Rows that repeat whole under the same key count once. A null key is kept as it is. Two rows of one
    key with different texts are both split. Texts of any length are cut whole; where there is no natural boundary the cut is at a blank, else between characters.
    """
    kind = dict(df.dtypes)[key]
    long = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter(F.char_length("t") > limit).distinct()
    return long.mapInArrow(lambda b: _split(b, limit, overlap), f"rec_id {kind}, piece_no int, start_pos int, core_start int, end_pos int, piece string")
