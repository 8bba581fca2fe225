"""Normalisation, splitting, sentences, leaks: single texts."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from concordat.llm import leaks, mixture, neardup, normalize, sentences, split


@pytest.mark.parametrize("text", ["ａb", "é", "a​b", "a b", "a　b", "licеnce", "ρrior", "a\tb", "﻿x", "so­ft"])
def test_irregular(text):
    assert normalize.irregular(text)


@pytest.mark.parametrize("text", ["", "plain text\nnext", "é déjà vu", "50 m² ½ …", "“quoted” — «ασφάλεια»", "„сигурност“", "Łódź, Åbo and Győr", "委員会は小企業", "naïve n° 5"])
def test_regular(text):
    assert not normalize.irregular(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aéＡ ​ ́ｅсοΣσßİ½\n", max_size=30))
def test_canonical_is_stable(text):
    once = normalize.canonical(text)
    assert normalize.canonical(once) == once


def test_canonical_meets_its_source():
    assert normalize.canonical("Wе suррort the ｔｅｘｔ, café​.") == normalize.canonical("We support the text, café.")


DISTINCT = {"Latin": "gr", "Greek": "λθ", "Cyrillic": "жш"}


@pytest.mark.parametrize("row", normalize.LOOK_ALIKE)
def test_mixed_word_meets_its_clean_form_for_every_pair(row):
    for n, own in enumerate(normalize.MAPPED):
        for k, other in enumerate(row):
            if k != n and other and row[n]:
                for clean, mixed in ((DISTINCT[own] + row[n], DISTINCT[own] + other), (row[n] * 3, row[n] + other + row[n])):
                    assert normalize.irregular(mixed) and normalize.canonical(mixed) == normalize.canonical(clean), (clean, mixed)


@pytest.mark.parametrize("clean, mixed", [("карта", "кaрта"), ("ελλαδα", "ελλαδa"), ("Комисия", "Кoмисия"), ("paypal", "pаypаl"), ("Première", "Prеmièrе"), ("сосна", "cocнa"), ("ёлка", "ëлка"), ("Ελλάδα", "Ελλάδa"), ("комисия", "комиѕия".replace("ѕ", "c"))])
def test_mixed_word_goes_to_the_script_that_can_write_it(clean, mixed):
    assert normalize.canonical(mixed) == normalize.canonical(clean)
    assert normalize.canonical(clean) == clean.casefold()


def test_a_word_that_two_scripts_can_write_follows_its_text():
    assert normalize.canonical("Комисията решава оa") == normalize.canonical("Комисията решава оа")
    assert normalize.canonical("We decide аt once") == "we decide at once"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aкAКЛΛνvyуУYλжg éй", max_size=16))
def test_mixed_words_are_stable(text):
    once = normalize.canonical(text)
    assert normalize.canonical(once) == once


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .,!\ń", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in got) == text
    assert all(e - s <= limit and s <= c < e for s, c, e in got)
    assert all(c - s <= overlap for s, c, _ in got)


def test_pieces_cut_at_paragraphs_first():
    text = ("One sentence here. " * 20).strip() + "\n\n" + ("Another sentence there. " * 20).strip()
    cuts = [c for _, c, _ in split.pieces(text, 500, 50)]
    assert text.index("Another") in cuts
    assert split.pieces("") == [] and split.pieces("short") == [(0, 0, 5)]
    assert len(split.pieces("x" * 100_000)) > 40
    with pytest.raises(ValueError):
        split.pieces("x", 10, 10)


@pytest.fixture(scope="module")
def decide():
    return sentences.fit([])


@pytest.mark.parametrize("parts", [
    ["Mr. Reed met Dr. Stone at 10.30 a.m. under Art. 5.", "It went well!", "Did it?"],
    ["Article 12", "1. The board may act:", "(a) the first item;", "(b) the second.", "All ends."],
    ["“The board can act. It must not wait,” the note said.", "Then it ended."],
    ["Le texte cite l'art. 5, al. 3, p. ex. le rapport.", "« La présidence agit ! »", "Voir n° 4, p. 7."],
    ["Der Ausschuss nahm die 8. Fassung laut S. 10 ff. an.", "Im Jahr 2014 nahm er z. B. das Netz usw. an."],
    ["Γιατί απορρίπτει η Προεδρία το τέλος;", "Η Επιτροπή εξετάζει το μητρώο, π.χ. το όριο."],
    ["Проф. Иванов цитира чл. 5 и др.", "Защо?", "„Комисията действа. Тя чака“, се казва тук."],
    ["委员会开会。", "“为什么不开会吗？”秘书处问道。", "比例从90.77%升至17.34%！"],
    ["डॉ. रोवेन ने कहा।", "हिस्सा 58.3 % तक पहुँचा।"],
    ["لماذا ترفض اللجنة الرسم؟", "اللجنة تدرس الرسم السنوي."],
])
def test_units(decide, parts):
    east = "委" in parts[0]
    joined = "" if east else "\n" if parts[0].startswith("Article") else " "
    text = joined.join(parts)
    assert [text[a:b] for a, b in sentences.units(text, decide)] == parts


def test_thai_and_hard_breaks(decide):
    text = "คณะกรรมการเสนอ ผู้รายงานขอ 11.2 ข้อ ประธานเลื่อน"
    assert [text[a:b] for a, b in sentences.units(text, decide)] == ["คณะกรรมการเสนอ", "ผู้รายงานขอ 11.2 ข้อ", "ประธานเลื่อน"]
    text = "The board may\nact on the\nfirst day. It ends\nthen."
    assert [text[a:b] for a, b in sentences.units(text, decide)] == ["The board may\nact on the\nfirst day.", "It ends\nthen."]
    assert sentences.units("", decide) == [] and sentences.units(" \n ", decide) == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB .!?\n“”«»()1;:–", max_size=80))
def test_units_hold_every_character(text):
    got = sentences.units(text, sentences.fit([]) if not hasattr(test_units_hold_every_character, "d") else test_units_hold_every_character.d)
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in got)) == re.sub(r"\s", "", text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)


test_units_hold_every_character.d = sentences.fit([])

PASSAGE = "In 2028 the Calelifen office counted 4,447 requests, of which 73 came from Tradro and 8 from Vixfen, while the technical equipment of Marful covered 4,134 sites."


def test_leaks():
    held = leaks.Passages(((7, PASSAGE), (8, "too short to count")), 16)
    plain = lambda t: [(i, n) for i, n, _, _ in leaks.leaks(t, held, 16, 10)]
    assert plain("Before. " + PASSAGE + " After.") == [(7, len(leaks.words(PASSAGE)))]
    assert plain(PASSAGE.upper().replace(" ", "\n").replace("office", "of-\nfice"))[0][0] == 7
    assert plain(PASSAGE.replace("requests", "answers"))[0][0] == 7
    assert plain("Nothing of the kind.") == [] and plain("") == []
    assert plain(" ".join(PASSAGE.split()[:10])) == []
    wrong = PASSAGE.split()
    wrong[3::4] = ["other"] * len(wrong[3::4])
    assert plain(" ".join(wrong)) == []
    text = "é" * 5 + " " + PASSAGE
    (item, n, a, b) = leaks.leaks(text, held, 16, 10)[0]
    assert text[a:b] == PASSAGE.rstrip(".")


def test_leaks_with_one_and_two_other_words_against_brute_force():
    passage = [f"word{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(60)]
    held = leaks.Passages(((7, " ".join(passage)),), 16)
    for size in (16, 17, 20, 21, 26, 33):
        for first in range(1, size - 1):
            for second in range(first, size - 1):  # the same one twice: one other word
                part = passage[9 : 9 + size]
                part[first] = part[second] = "changed"
                same = [a == b for a, b in zip(part, passage[9:])]
                most = max((b - a for a in range(size) for b in range(a + 16, size + 1) if same[a] and same[b - 1] and 10 * same[a:b].count(False) <= b - a), default=0)
                text = " ".join(["Other", "words", "before", *part, "and", "others", "behind"])
                got = leaks.leaks(text, held, 16, 10)
                assert [n for _, n, _, _ in got] == [most] * bool(most), (size, first, second)


def test_leaks_with_other_words_and_a_word_written_apart():
    passage = [f"word{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(60)]
    held = leaks.Passages(((7, " ".join(passage)),), 16)
    part = passage[9:25]
    part[6], part[14] = part[6][:3] + "-\n" + part[6][3:], "changed"
    assert [n for _, n, _, _ in leaks.leaks(" ".join(["Before", *part, "behind"]), held, 16, 10)] == [16]
    part = passage[9:39]
    part[13:16] = ["three", "other", "ones"]
    assert [n for _, n, _, _ in leaks.leaks(" ".join(["Before", *part, "behind"]), held, 16, 10)] == [30]


def test_token_counts_are_the_tokenizers():
    path = f"{mixture.TOKENIZERS}/{mixture.TOKENIZER}"
    count, encoding = mixture.counter(path), mixture._encoding(path)
    for text in ["", "Hello world's  end\n\n x", "委员会 2024年 ", "é" * 50, "a b"]:
        assert count(text) == len(encoding.encode_ordinary(text))


def test_shingles_and_similarity_of_signatures():
    random.seed(3)
    words = [f"w{random.randrange(10**6)}" for _ in range(400)]
    one, two = " ".join(words), " ".join(words[:300] + [f"v{n}" for n in range(100)])
    sets = neardup.shingle_sets([one, two, "", None, "a b"], 3, 20)
    assert sets[2] is sets[3] is sets[4] is None and len(sets[0]) == 398
    j = len(set(sets[0].tolist()) & set(sets[1].tolist())) / len(set(sets[0].tolist()) | set(sets[1].tolist()))
    sig = neardup.signatures([sets[0], sets[1]])
    assert abs((sig[0] == sig[1]).mean() - j) < 0.2


def test_the_model_decides_and_agrees_with_reliable_boundaries_it_has_not_seen():
    import duckdb

    docs = [x for (x,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where trim(text) <> '' order by doc_id").fetchall()]
    decide, seen = sentences.fit(docs[::2]), sentences.contexts(docs[1::2])
    known = {k: n for k, n in seen.items() if sentences.reliable(k) is not None}
    assert sum(n for k, n in known.items() if decide(k) == bool(sentences.reliable(k))) >= 0.995 * sum(known.values())
    assert sum(known.values()) < sum(seen.values())
    assert not any(sentences.Classifier()(k) for k in known)  # without weights nothing is a boundary: no rule stands in for the model
