"""Sentence units of texts in many languages and scripts.

Candidate boundaries (terminators, closing quotation marks, line breaks, blanks in Thai) are found in one pass. Every terminator that is followed by a blank or a
capital is classified by a maximum-entropy model over its neighbours: the tokens before and after it by name, length, case, digits and script, what is known
of the token before (a title, a reference, ...), kind of mark, the gap. The model is fitted on reliable candidates only, taken from a bounded sample of the corpus and
from a few built-in examples: what stands at the end of a paragraph or is followed by a capital after a plain word is a boundary; what is followed by a small
letter, or follows a title or a reference such as "Art.", is none. Structure is not left to the model: line breaks (headings, list lines, hard wraps), the end of a
paragraph or text, closing signs of a quotation that ends with a terminator, and blanks in Thai.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Documents of the sample on which the classifier is fitted, at most.
SAMPLE_DOCUMENTS = 1500

# Abbreviations by the way they stand in a sentence (lower case, without the last full stop).
TITLES = frozenset("mr mrs ms dr pr prof m mm mme mlle me sr sra srta dra dna hr fr frau st ste проф д-р г-н г-жа κ κα δρ डॉ श्री".split())
#: Before a number only; elsewhere such a token is an ordinary word.
NUMBERED = frozenset("no nos nr núm núms vol vols p pp pág págs art arts abs al apdo fig figs sec secs ann anh anl ch chap cap kap lit par para pt approx tit s άρθ παρ αρ чл ал т стр अनु पृ".split())
REFERENCES = frozenset("cf vgl nn ca z d b h e.g i.e ej ex π χ π.χ c vs напр вж гл сл βλ ff bzw vb सं".split())
PAUSES = frozenset("etc usw ltd inc co corp al. др г κ.λπ λπ a.m p.m jr sen u.a".split())
_DETERMINERS = frozenset("der die das den dem des zum zur am im vom beim ins jeder jede jedes diese dieser dieses ab bis seit".split())
_FUNCTION = frozenset(
    "the a an of and or to in on for with by from at as that this these its their any each no not both but if than via per le la les l un une des du de d et ou à au aux en sur pour par avec sans dans ce cette ces son sa ses leur der die das den dem des ein eine einer eines einem einen und oder zu zum zur im am von vom mit für durch ohne gegen bei nach aus el los las una uno unos y o del al con sin para por según su sus que se".split()
)
_HEADWORD = re.compile(r"(?:article|chapter|annex|section|title|part|recital|chapitre|annexe|titre|partie|artikel|kapitel|anhang|abschnitt|teil|artículo|capítulo|anexo|título|sección|глава|член|приложение|άρθρο|κεφάλαιο|παράρτημα)\s+[\divxlc]+(?:\s?(?:bis|ter|quater|[a-z]))?$", re.I)
TERMINATORS = ".!?…。！？؟।;;"
_CLOSERS = "»”\"’'」』)]）“›"
_MARK = re.compile(r"(?:\(?(?:\d{1,3}|[a-zα-ωа-я]|[ivx]{1,5})[.)]|\((?:\d{1,3}|[a-zα-ωа-я]|[ivx]{1,5})\)|[–—•*·‣▪-])[^\S\n]+(?=\S)", re.I)
_ONLY_MARK = re.compile(r"\(?(?:\d{1,3}|[^\W\d_]|[ivx]{1,5})[.)]*$", re.I)
_BRACKETS = re.compile("[«»“”„\"‘’「」『』()（）]")
_CANDIDATE = re.compile(r"[.!?…。！？؟।;;]+|[»”\"’」』)）“]|\n\s*|(?<=[฀-๿])[^\S\n]+(?=[฀-๿“\"«])")
_TOKEN_BREAK = re.compile(r"[\s(«“„\"'’‘—–/]")
_PAIRS = {"«": "»", "“": "”", "„": "“", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）"}
_TERMINAL_END = re.compile(r"[.!?…。！？؟।;](?:[^\S\n]?[»”\"’'」』)\]）“])*$")


def _spans(text: str) -> list[tuple[int, int]]:
    """The outermost paired quotations and brackets as (open, close); unpaired signs count as plain characters."""
    signs = [(m.start(), m.group()) for m in _BRACKETS.finditer(text)]
    if not signs:
        return []
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    straight = -1
    last = -1
    for at, sign in signs:
        if stack and "\n\n" in text[last:at]:
            stack, straight = [], -1
        last = at
        if sign == '"':
            if straight >= 0:
                out.append((straight, at))
                straight = -1
            else:
                straight = at
            continue
        if stack and sign == stack[-1][1]:
            if sign == "’" and at + 1 < len(text) and text[at + 1].isalpha() and text[at - 1].isalpha():
                continue
            out.append((stack.pop()[0], at))
        elif sign in _PAIRS and not (sign == "‘" and at and text[at - 1].isalpha()):
            stack.append((at, _PAIRS[sign]))
        elif sign in "»”」』)）" and any(sign == close for _, close in stack):
            while stack[-1][1] != sign:
                stack.pop()
            out.append((stack.pop()[0], at))
    out.sort()
    outer: list[tuple[int, int]] = []
    for a, b in out:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _script(char: str) -> str:
    c = ord(char)
    return "latin" if c < 0x370 else "greek" if c < 0x400 or 0x1F00 <= c < 0x2000 else "cyrillic" if c < 0x530 else "arabic" if 0x600 <= c < 0x780 else "indic" if 0x900 <= c < 0xE00 else "thai" if c < 0xE80 else "east" if c > 0x2E7F else "other"


def _follows(text: str, at: int) -> str:
    if at >= len(text):
        return "end"
    c = text[at]
    return "low" if c.islower() else "up" if c.isupper() else "digit" if c.isdigit() else "letter" if c.isalpha() else "open" if c in "«“„\"‘「『(¿¡（" else "dash" if c in "–—-•*" else "other"


def _shape(token: str) -> str:
    if not token:
        return "empty"
    last = token[-1]
    if last.isdigit():
        return "year" if len(token) > 2 else "number"
    if not last.isalpha() and not "ऀ" <= last <= "෿":
        return "closed"
    if "." in token:
        return "dotted"
    return "one" if len(token) == 1 else ("short_cap" if token[0].isupper() else "short") if len(token) <= 3 else "long"


_NEXT = re.compile(r"[^\w\s]*(\w*)")
#: Characters of a token at most that is told by name; longer ones count by shape and length.
NAMED = 12


def context(text: str, start: int, mark: int, end: int, after: int) -> tuple:
    """What is known of the terminator text[mark:end] (end: past closing signs) in the unit begun at start, followed by text[after:].

    (sign, kind, shape, follows, gap, script, token before, its length, token after, its length, script after)
    """
    cut = mark
    while cut > start and not _TOKEN_BREAK.match(text, cut - 1):
        cut -= 1
    token = text[cut:mark]
    small = token.lower().strip("([")
    follows = _follows(text, after)
    kind = "title" if small in TITLES else "reference" if small in REFERENCES or (small in NUMBERED and follows in ("digit", "low", "other")) else "pause" if small in PAUSES else "word"
    if small == "al" and text[max(start, cut - 3) : cut].strip().lower() == "et":
        kind = "pause"
    sign = text[mark]
    sign = "dots" if end - mark > 1 and text[mark : mark + 2] in ("..", "……") or sign == "…" else "stop" if sign == "." else "semi" if sign in ";;" else "strong"
    shape = _shape(token)
    if shape == "number" and text[max(start, cut - 24) : cut].rstrip().rpartition(" ")[2].rpartition("\n")[2].lower() in _DETERMINERS:
        shape = "ordinal"
    if kind != "word":
        shape = "abbreviation"  # what is known of these words says nothing of unknown ones of their shape
    gap = "none" if after == end else "line" if "\n" in text[end:after] else "blank"
    if gap == "line" and text.count("\n", end, after) > 1:
        gap = "paragraph"
    script = _script(token[-1]) if token else "other"
    if script in ("arabic", "indic", "east", "thai") and sign == "strong":
        shape = "long"
    then = _NEXT.match(text, after).group(1)
    named = lambda t: t.lower() if len(t) <= NAMED and not t.isdigit() else ""
    return sign, kind, shape, follows, gap, script, named(token), min(len(token), 9), named(then), min(len(then), 9), _script(then[0]) if then else "other"


def _features(key: tuple) -> list[str]:
    sign, kind, shape, follows, gap, script, token, size, then, then_size, then_script = key
    out = ["bias", f"sign={sign}", f"kind={kind}", f"shape={shape}", f"follows={follows}", f"gap={gap}", f"sign,follows={sign},{follows}", f"kind,follows={kind},{follows}", f"shape,gap={shape},{gap}", f"gap,follows={gap},{follows}"]
    out += [f"size={size}", f"then_size={then_size}", f"script={script}", f"scripts={script},{then_script}"]
    out += [f"token={token}"] * bool(token) + [f"then={then}"] * bool(then)
    return out + ([f"script,shape={script},{shape}"] if script in ("indic", "arabic") else [])


def reliable(key: tuple) -> int | None:
    """1 or 0 for candidates whose class is certain from their surroundings, else None."""
    sign, kind, shape, follows, gap, script = key[:6]
    if follows == "low" or (sign == "dots" and follows in ("letter", "low")) or kind in ("title", "reference") or shape == "ordinal":
        return 0
    if script == "indic" and sign == "stop":
        return 0
    if follows == "end" or gap == "paragraph" or (kind == "pause" and follows == "up") or (kind == "word" and shape in ("long", "short") and (follows in ("up", "open") or (sign == "strong" and follows == "letter") or (script == "arabic" and follows == "letter"))):
        return 1
    return None


@dataclass
class Classifier:
    """Logistic regression over `_features`, fitted on the contexts whose class is reliable and asked for every context; decisions are kept per distinct context."""

    weights: dict[str, float] = field(default_factory=dict)
    known: dict[tuple, bool] = field(default_factory=dict)

    def fit(self, counts: Counter, rounds: int = 30, ridge: float = 0.02, named: int = 5) -> "Classifier":
        """named: contexts in which a token must stand to have a weight of its own."""
        keys = sorted(k for k in counts if reliable(k) is not None)
        seen = Counter(f for k in keys for f in _features(k))
        names = sorted(f for f, n in seen.items() if n >= named or not f.startswith(("token=", "then=")))
        index = {f: n for n, f in enumerate(names)}
        own = [[index[f] for f in _features(k) if f in index] for k in keys]
        at = np.full((len(keys), max(map(len, own))), len(names))  # the last feature is none
        for row, f in enumerate(own):
            at[row, : len(f)] = f
        y = np.array([reliable(k) for k in keys], dtype=float)
        weight = 1 + np.log([counts[k] for k in keys])
        times = lambda w: np.append(w, 0.0)[at].sum(axis=1)
        back = lambda u: np.bincount(at.ravel(), np.repeat(u, at.shape[1]), len(names) + 1)[:-1]
        w = np.zeros(len(names))
        for _ in range(rounds):  # Newton's method, each step by conjugate gradients; it ends when nothing moves
            p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
            curve = weight * np.maximum(p * (1 - p), 1e-6)
            step = _solve(lambda v: back(curve * times(v)) + ridge * v, back(weight * (y - p)) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        self.weights = dict(zip(names, w.tolist()))
        return self

    def __call__(self, key: tuple) -> bool:
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = sum(self.weights.get(f, 0.0) for f in _features(key)) > 0
        return got


def _solve(matrix: Callable[[np.ndarray], np.ndarray], b: np.ndarray, most: int = 200) -> np.ndarray:
    """x with matrix(x) = b, by conjugate gradients."""
    x, r = np.zeros_like(b), b.copy()
    d, rr = r.copy(), r @ r
    for _ in range(most):
        if rr < 1e-12:
            break
        m = matrix(d)
        alpha = rr / (d @ m)
        x += alpha * d
        r -= alpha * m
        rr, old = r @ r, rr
        d = r + rr / old * d
    return x


#: Built-in reliable examples, so that a small or empty corpus has a classifier too.
EXAMPLES = (
    "The members decided. They agreed quickly. Everyone spoke. Nothing changed. Later they returned. Some objected! Others asked why? Finally they voted. Votes were counted. Results followed. People waited outside. Rain began falling.\n\nStill they waited.",
    "Les membres décident. Ensuite elles votent. Personne ne parle. Tout change. Die Mitglieder entscheiden. Danach stimmen alle. Niemand spricht. Alles endet. Los miembros deciden. Después votan. Nadie habla. Todo cambia.\n\nЧленовете решават. После гласуват. Τα μέλη αποφασίζουν. Μετά ψηφίζουν.",
    "The committee met in 2014. It adopted the report by Dr. Stone, etc. and left at 10.30 a.m. under protest.\n\nSee Art. 5 and p. 7. Mr. Reed agreed! Why? Nobody knows, i.e. no one asked.",
    "They took it all in a day.\n\nWe saw 5.\n\nAsk Bob.\n\nIt was in 2014.\n\nHe met her in May.\n\nShe counted 73.\n\nOne.\n\nIt is so.\n\nThe act is new.\n\nSee (a).\n\nIt grew by 5 %.\n\nThe rest of it is old, etc.\n\nAll end at 5 p.m.\n\nWho did it?\n\nNot us!\n\n",
    "Das gilt so.\n\nEs kam an.\n\nIch sah 12.\n\nC'est vu.\n\nOn a 25.\n\nYa fue.\n\nSon 7.\n\nИ ние.\n\nΝαι, το 5.\n\n",
    "Le comité a siégé en 2014. M. Blanc a cité l'art. 5, al. 3, p. ex. le rapport, etc. sans suite.\n\nVoir n° 4. Pourquoi ? Rien n'est dit... mais tout change.",
    "Der Ausschuss tagte 2014. Die Kommission nahm laut S. 10 ff. die 8. Fassung an, z. B. das Netz usw. ohne Frist.\n\nDr. Stein stimmte zu! Warum? Niemand weiß es.",
    "El comité se reunió en 2014. El Sr. Ruiz citó el art. 5, etc. sin más.\n\nVéase pág. 3. ¿Por qué? Nadie sabe.",
    "Комисията заседава през 2014 г. без доклад. Проф. Иванов цитира чл. 5 и др. без срок. Докладът има таблици, карти и др. Кой го чете? Има такси, срокове и др. Нищо ново.\n\nЗащо? Никой не знае.",
    "Η επιτροπή συνεδρίασε. Το άρθ. 5 παρ. 3 ισχύει, π.χ. το μητρώο, κ.λπ. χωρίς όριο.\n\nΓιατί; Κανείς δεν ξέρει.",
    "اجتمعت اللجنة. ثم أجلت القرار. لماذا؟ لا أحد يعلم.",
    "समिति मिली। डॉ. राव ने कहा। अनु. 5 लागू है। क्यों? कोई नहीं जानता।",
    "委员会开会。为什么？没有人知道！会议推迟了。",
)


def _heading(unit: str, following: str, wrapped: bool) -> bool:
    """Whether a unit so far that ends without a terminator at a line break is a heading on its own line."""
    first = following[:1]
    if not first or first.islower() or first in ",;:)»”" or unit[-1:] in ",;:(–—-«“„":
        return False
    words = unit.split()
    if not words[0][0].isupper() and not words[0][0].isdigit():
        return False
    if _HEADWORD.match(unit):
        return True
    if not (first.isupper() or first.isdigit() or first in "«“„\"‘(¿¡–—•-*"):
        return False
    if unit.isupper() and following.split(None, 1)[0].isupper() and len(unit) > 3 and wrapped:
        return False
    if words[-1].lower() in _FUNCTION or words[-1][-1] == "." or len(words) > (4 if wrapped else 12):
        return False
    if wrapped and (len(words) < 2 or any(c.isdigit() for c in unit)):
        return False
    if wrapped and words[0] in ("Der", "Die", "Das", "Den", "Dem", "Ein", "Eine") and not words[-1][0].isupper():
        return False
    return True


def units(text: str, decide: Callable[[tuple], bool], seen: Counter | None = None) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, without surrounding blanks. seen: counts the contexts met, for fitting."""
    n = len(text)
    spans = _spans(text)
    closing = {b: a for a, b in spans}
    out: list[tuple[int, int]] = []
    start = n - len(text.lstrip())
    wrapped = bool(_WRAP.search(text))
    listed = False  # the unit is a list item
    where = 0

    def cut(at: int) -> None:
        nonlocal start, listed
        end = at
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start:
            out.append((start, end))
        while at < n and text[at].isspace():
            at += 1
        start = at
        listed = False

    done = 0
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        if at < done or at <= start - 1:
            continue
        char = text[at]
        while where < len(spans) and spans[where][1] < at:
            where += 1
        inside = where < len(spans) and spans[where][0] < at < spans[where][1]
        if char == "\n":
            if end >= n:
                break
            following = text[end : end + 60].partition("\n")[0]
            if m.group().count("\n") > 1:
                cut(end)
                continue
            if inside:
                continue
            unit = text[start:at].rstrip()
            if not unit:
                continue
            mark = _MARK.match(text, end)
            ended = _TERMINAL_END.search(unit[-6:])
            if mark and (unit[-1] in ":;" or (unit[-1] == "," and _alike(mark, _MARK.match(text, start))) or ended or _heading(unit, following, wrapped)):
                if not (ended and not _ends(text, start, at, end, decide, seen)):
                    cut(end)
            elif unit[-1] in ";" and listed_item(text, start):
                cut(end)
            elif "฀" <= unit[-1] <= "๿" and not following[:1].isdigit():
                cut(end)
            elif not ended and _heading(unit, following, wrapped):
                cut(end)
            continue
        if char.isspace():  # a blank in Thai
            if not inside:
                cut(end)
            continue
        if char in "»”\"’」』)）“":
            if at not in closing or inside:
                continue
            before = at - 1
            while before > start and text[before] in "   »”\"’」』)）":
                before -= 1
            if text[before] not in TERMINATORS or (text[before] in ";;" and _script(text[before - 1]) != "greek"):
                continue
            after = end
            while after < n and text[after] in ")）":
                after += 1
            stop = after
            while after < n and text[after].isspace():
                after += 1
            follows = _follows(text, after)
            opened_first = closing[at] <= start
            if char in ")）" or follows in ("low", "other") and after < n and text[after] not in "¿¡":
                if not (char in ")）" and follows == "up" and closing[at] <= start):
                    continue
            if follows == "letter" and "\n" not in text[stop:after] and (opened_first or text[after] in "とはがをのに"):
                continue
            if follows == "letter" and opened_first:
                continue
            if follows == "digit" and after == stop:
                continue
            cut(stop)
            done = stop
            continue
        if inside:
            continue
        if char in ";;" and (at == 0 or _script(text[at - 1]) != "greek"):
            continue
        if char == "…" and at and _script(text[at - 1]) == "east" and end < n and not text[end].isspace():
            continue
        stop = end
        while stop < n:  # closing signs that stand after the mark without having been opened in this unit's spans
            if text[stop] in "»”\"’」』)]）" and stop not in closing and text[stop] != '"':
                stop += 1
            else:
                break
        after = stop
        while after < n and text[after].isspace():
            after += 1
        if after == stop and after < n:
            c = text[after]
            if char == "." and not (c.isupper() and _joined(text, at, after)):
                continue
            if char in "!?؟" and not (c.isupper() or c in "«“„\"¿¡" or c.isalpha() and not c.islower()):
                continue
            if char == "…" and not c.isupper():
                continue
            if char in ";;":
                continue
        if _ONLY_MARK.match(text[start:at]) and start < at <= start + 5 and char == ".":
            continue
        if _ends_at(text, start, at, end, stop, after, decide, seen):
            cut(stop)
            done = stop
    cut(n)
    return out


_WRAP = re.compile(r"[^\s.!?:;…。！？।؟฀-๿]\n(?=[a-zà-ÿα-ωά-ώа-я])")


def _alike(one: re.Match, other: re.Match | None) -> bool:
    """Whether two list marks are of one style."""
    style = lambda m: re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", m.group().strip()))
    return other is not None and style(one) == style(other)


def listed_item(text: str, start: int) -> bool:
    return bool(_MARK.match(text, start))


def _joined(text: str, at: int, after: int) -> bool:
    """A full stop without a blank after it, between a finished word and a capitalised one."""
    before = text[at - 1] if at else " "
    if not (before.islower() or before.isdigit() or before in "»”\"’)%"):
        return False
    if before.islower() and (at < 3 or not (text[at - 2].isalpha() or text[at - 2] in "-'’") or (text[at - 2].isupper() and not text[at - 3].isalpha())):
        return False
    return after + 1 >= len(text) or not text[after + 1] == "."


def _ends_at(text: str, start: int, at: int, end: int, stop: int, after: int, decide: Callable[[tuple], bool], seen: Counter | None) -> bool:
    if after >= len(text):
        return True
    key = context(text, start, at, end if stop == end else stop, after)
    if seen is not None:
        seen[key] += 1
    if key[4] in ("line", "paragraph") and _MARK.match(text, after) and key[1] == "word":
        return True
    return decide(key)


def _ends(text: str, start: int, at: int, end: int, decide: Callable[[tuple], bool], seen: Counter | None) -> bool:
    """For a line that ends with a terminator before a list mark: whether that really ends a unit (not so after "No." or "Art.")."""
    mark = at
    while mark > start and text[mark - 1] not in TERMINATORS:
        mark -= 1
    return decide(context(text, start, mark - 1, mark, end))


def contexts(texts: Iterable[str]) -> Counter:
    """How often each context of a terminator occurs; as nothing is fitted yet, reliable ones alone end a unit."""
    seen: Counter = Counter()
    for t in texts:
        units(t, lambda key: reliable(key) == 1, seen)
    return seen


def fit(texts: Iterable[str], counts: Counter | None = None) -> Classifier:
    """The classifier from the reliable candidates of these texts, of contexts counted elsewhere and of the built-in examples."""
    return Classifier().fit(contexts((*EXAMPLES, *texts)) + (counts or Counter()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = contexts(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(k) for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["context", "n"])


def sample(df: DataFrame, text: str, most: int = SAMPLE_DOCUMENTS) -> Counter:
    """The contexts in at most `most` whole texts, those of least hash, so any copy of the data gives the same; only distinct contexts come to the driver."""
    t = F.col(f"`{text}`")
    one_in = max(1, df.count() // max(1, most))  # so that about `most` rows pass the filter, whatever the table's size
    held = df.select(t.alias("t"), F.xxhash64(t).alias("h")).filter(F.col("t").isNotNull() & (F.pmod("h", F.lit(one_in)) == 0)).orderBy("h").limit(most)
    counted = held.select("t").repartition(8).mapInArrow(_count, "context string, n bigint").groupBy("context").agg(F.sum("n").alias("n"))
    return Counter({tuple(json.loads(r["context"])): r["n"] for r in counted.collect()})


def _split(batches: Iterator[pa.RecordBatch], decide: Callable[[tuple], bool]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, starts, ends, ids = batch.column(0), [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            got = units(text, decide) if text else ()
            ids.extend([row] * len(got))
            for s, e in got:
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["key", "start_pos", "end_pos"])


def sentences(df: DataFrame, key: str, text: str, decide: Classifier | None = None) -> DataFrame:
    """(key, start_pos, end_pos) of every unit of every text; positions count code points from 0, end_pos is just past the last character.

    Null, empty and blank texts give no row; texts of any length are split whole. Rows repeated whole give their units again. Ties do not occur: units
    of a text never overlap, and together they hold every character that is not blank. The key is kept as it is, null too.
    """
    decide = decide or fit((), sample(df, text))
    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    return slim.mapInArrow(lambda b: _split(b, decide), f"key {kind}, start_pos bigint, end_pos bigint").withColumnRenamed("key", key)
