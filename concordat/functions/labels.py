"""Column functions on section identifiers, labels, references, versions and dates. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Places of sections outside the numbering.
PLACES = {"expose": -3_000_000, "preambule": -2_000_000, "preamble": -2_000_000, "general": -2_000_000, "generalites": -2_000_000, "annexe": 90_000_000, "annexes": 90_000_000}


def _number(digits: Column, default: int) -> Column:
    return F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(default).cast("bigint"))


def section_order(section_id: Column) -> Column:
    """The place of a section in its document: numbers in order, letters after their number, fragments after their article (at most 9 apart),
    explanatory and general parts first, annexes last. A null identifier counts as empty."""
    sid = F.lower(F.trim(F.coalesce(section_id, F.lit(""))))
    head, rest = F.substring_index(sid, "_", 1), F.regexp_extract(sid, r"^[^_]*_(.*)$", 1)
    body, fragment = F.substring_index(rest, "_", 1), F.regexp_extract(rest, r"^[^_]*_(\d+)$", 1)
    letter = F.regexp_extract(body, r"(\p{L})", 1)
    rank = F.when(letter == "", 0).otherwise(F.least(F.ascii(letter) - 96, F.lit(26)))
    base = _number(F.regexp_replace(body, r"\D", ""), 9900) * 1000 + rank * 10 + F.least(_number(fragment, 0), F.lit(9)) + F.when(head == "art", 0).otherwise(10_000_000)
    special = F.lit(None).cast("bigint")
    for name, place in PLACES.items():
        special = F.when(head == name, F.lit(place).cast("bigint")).otherwise(special)
    return F.coalesce(special + F.when(head == sid, 0).otherwise(_number(F.regexp_replace(rest, r"\D", ""), 0)), base)


# How a comment names the provision it is about.
ARTICLE_PARAGRAPH = r"(?i)\bart(?:icle)?s?\.?\s*(\d+\s*(?:bis|ter|quater)?)\s*[\(§]\s*(\d+[a-z]?)\s*\)?(?:\s*\(\s*([a-z])\s*\))?"
RECITAL = r"(?i)\b(?:recital|consid[ée]rant)s?\s*\(?(\d+[a-z]?)\)?"
PARAGRAPH = r"(?i)\bparagraph[e]?\s*\(?(\d+[a-z]?)\)?"
POINT = r"(?i)\bpoint\s*\(?([a-z])\)?\b"
OPENING = r"(?i)^(?:[-–•\s]*)(?:we\s+|our\s+delegation\s+|the\s+delegation\s+)?(?:would\s+like\s+to\s+)?"


def provision(text: Column) -> Column:
    """The provision a comment names in its first 220 characters: paragraph of an article, recital, paragraph, point; '' for none."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 220)
    found = lambda p, g: F.regexp_extract(head, p, g)
    letter = F.when(found(ARTICLE_PARAGRAPH, 3) != "", F.concat(F.lit(" ("), found(ARTICLE_PARAGRAPH, 3), F.lit(")"))).otherwise("")
    return (
        F.when(found(ARTICLE_PARAGRAPH, 2) != "", F.concat(F.lit("§ "), found(ARTICLE_PARAGRAPH, 2), letter))
        .when(found(RECITAL, 1) != "", F.concat(F.lit("considérant "), found(RECITAL, 1)))
        .when(found(PARAGRAPH, 1) != "", F.concat(F.lit("§ "), found(PARAGRAPH, 1)))
        .when(found(POINT, 1) != "", F.concat(F.lit("point ("), found(POINT, 1), F.lit(")")))
        .otherwise("")
    )


def preview(text: Column, words: int = 9) -> Column:
    """The first words of a text without its opening formula, with an ellipsis where it goes on."""
    body = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), OPENING, ""), r"\s+", " ")
    parts = F.split(body, " ")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "…").otherwise(""))


FRAGMENT = r"\s*\((\d+)\s*/\s*(\d+)\)\s*$"


def fragment_label(label: Column, text: Column) -> Column:
    """`Article 24 (2/12)` by what the fragment begins with: its provision, else its first words, else its number."""
    base = F.trim(F.coalesce(label, F.lit("")))
    root, rank, of = F.regexp_replace(base, FRAGMENT, ""), F.regexp_extract(base, FRAGMENT, 1), F.regexp_extract(base, FRAGMENT, 2)
    named, words = provision(text), preview(text, 7)
    part = F.concat(root, F.lit(" · extrait "), rank, F.lit("/"), of)
    return F.when(rank == "", base).when(named != "", F.concat(root, F.lit(", à partir du "), named)).when(words != "", F.concat(part, F.lit(" : « "), words, F.lit(" »"))).otherwise(part)


def full_label(label: Column, text: Column) -> Column:
    """A contribution's title: section, provision, first words. A recital takes the section's place."""
    base, named, words = fragment_label(label, text), provision(text), preview(text)
    titled = F.when(named.startswith("considérant"), F.concat(F.substring_index(base, " · ", 1), F.lit(" → "), named)).when((named != "") & ~base.contains(" à partir du "), F.concat(base, F.lit(" "), named)).otherwise(base)
    return F.when(base.contains(" : « "), base).when(words != "", F.concat(titled, F.lit(" · « "), words, F.lit(" »"))).otherwise(titled)


def match_key(label: Column) -> Column:
    """Kind and first number of a section's label, by which two documents' sections are matched; without a number the label itself."""
    text = F.coalesce(label, F.lit(""))
    kind = F.when(text.rlike(r"(?i)\b(?:consid[ée]rant|recital)\b"), "rec").when(text.rlike(r"(?i)\b(?:annexe|annex)\b"), "ann").otherwise("art")
    number = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(number == "", F.lower(F.trim(text))).otherwise(F.concat(kind, F.lit("_"), number))


# Words that a heading of a provision does not hold.
NO_HEADING = r"(?i)\b(?:shall|means|the commission|il est|le présent|for the purposes)\b"


def subject(text: Column, longest: int = 90) -> Column:
    """The heading of a provision: the first of its first three lines that reads like one; '' if none does."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
    fits = lambda x: ~x.rlike(r"(?i)^article\s+") & (F.char_length(x) <= longest) & ~x.endswith(".") & ~x.rlike(NO_HEADING) & (F.char_length(F.regexp_replace(x, r"\D", "")) <= F.char_length(x) / 3)
    return F.coalesce(F.try_element_at(F.filter(lines, fits), F.lit(1)), F.lit(""))


# Signs of a document's place in the procedure, first match in this order.
VERSION_SIGNS = [
    ("jo", r"journal officiel de l'union|official journal of the european|\boj l\b|\bjo l\b"),
    ("trilogue", r"provisional agreement|accord provisoire|\btrilogue\b|four[- ]column"),
    ("orientation", r"general approach|orientation g[ée]n[ée]rale"),
    ("mandat_pe", r"european parliament.{0,40}(?:mandate|position|report)|committee on industry|\bimco\b|\blibe\b|amendments adopted by the european parliament"),
    ("compromis", r"presidency compromise|compromise (?:text|proposal)|texte de compromis|revised compromise|compromis de la pr[ée]sidence"),
    ("com", r"proposal for a\s+(?:regulation|directive)|com\(\d{4}\)\s*\d+|proposition de r[èe]glement|explanatory memorandum"),
]
# Months in English and French.
MONTHS = {"january": 1, "janvier": 1, "february": 2, "février": 2, "fevrier": 2, "march": 3, "mars": 3, "april": 4, "avril": 4, "may": 5, "mai": 5, "june": 6, "juin": 6, "july": 7, "juillet": 7, "august": 8, "août": 8, "aout": 8, "september": 9, "septembre": 9, "october": 10, "octobre": 10, "november": 11, "novembre": 11, "december": 12, "décembre": 12, "decembre": 12}


def version_kind(head: Column) -> Column:
    """The kind of a version from the text of its first pages."""
    low, out = F.lower(F.coalesce(head, F.lit(""))), F.lit("autre")
    for name, signs in reversed(VERSION_SIGNS):
        out = F.when(low.rlike(signs), name).otherwise(out)
    return out


def version_date(page: Column) -> Column:
    """The date at the head of a first page: the first one written with a known month, else the first in numbers with a possible day and month, else null."""
    head = F.substring(F.coalesce(page, F.lit("")), 1, 1500)
    text = r"\b(\d{1,2})\s+([A-Za-zéûôà]+)\s+((?:19|20)\d{2})\b"
    known = F.create_map(*[x for m, n in MONTHS.items() for x in (F.lit(m), F.lit(n))])
    found = F.arrays_zip(F.regexp_extract_all(head, F.lit(text), F.lit(1)).alias("d"), F.regexp_extract_all(head, F.lit(text), F.lit(2)).alias("m"), F.regexp_extract_all(head, F.lit(text), F.lit(3)).alias("y"))
    dated = F.filter(F.transform(found, lambda x: F.struct(x["y"].cast("int").alias("y"), F.try_element_at(known, F.lower(x["m"])).alias("m"), x["d"].cast("int").alias("d"))), lambda x: x["m"].isNotNull() & x["d"].between(1, 31))
    first = F.try_element_at(dated, F.lit(1))
    number = r"\b(\d{1,2})[./](\d{1,2})[./]((?:19|20)\d{2})\b"
    part = lambda g: F.nullif(F.regexp_extract(head, number, g), F.lit("")).cast("int")
    iso = lambda y, m, d: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.coalesce(F.when(first.isNotNull(), iso(first["y"], first["m"], first["d"])), F.when(part(1).between(1, 31) & part(2).between(1, 12), iso(part(3), part(2), part(1))))


def celex(reference: Column) -> Column:
    """The identifier of an act from an identifier, an address or a reference with year first; '' if nothing is recognised."""
    text = F.trim(F.coalesce(reference, F.lit("")))
    direct = F.upper(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"(?i)(3\d{4}[A-Z]{1,2}\d{4})", 1))
    pattern = r"(?i)(?:(r[èe]glement|regulation|directive|d[ée]cision|decision)[^\d]{0,40})?\b((?:19|20)\d{2})/(\d{1,4})\b"
    nature, year, number = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
    letter = F.when(F.lower(nature).startswith("dir"), "L").when(F.lower(nature).rlike("^d[ée]c"), "D").otherwise("R")
    return F.when(direct != "", direct).when(number != "", F.concat(F.lit("3"), year, letter, F.lpad(number, 4, "0"))).otherwise("")


def celex_both(act: Column) -> Column:
    """The same for either writing, year/number or number/year: the part of four digits that begins 19 or 20 is the year."""
    pattern = r"(?i)(r[èe]glement|regulation|directive|d[ée]cision|decision)[^\d]{0,60}?(\d{1,4})/(\d{1,4})"
    nature, a, b = (F.regexp_extract(F.coalesce(act, F.lit("")), pattern, g) for g in (1, 2, 3))
    swap = ~a.rlike(r"^(?:19|20)\d\d$")
    letter = F.when(F.lower(nature).startswith("dir"), "L").when(F.lower(nature).rlike("^d[ée]c"), "D").otherwise("R")
    return F.when(a == "", "").otherwise(F.concat(F.lit("3"), F.when(swap, b).otherwise(a), letter, F.lpad(F.when(swap, a).otherwise(b), 4, "0")))


def citation(party: Column, document: Column, section: Column, first: Column, last: Column) -> Column:
    """party · document, section, p. a-b, without what is missing."""
    pages = F.when(first.isNull(), None).when(last.isNull() | (first == last), F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("p. "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat_ws(" · ", F.nullif(party, F.lit("")), F.concat_ws(", ", document, F.nullif(section, F.lit("")), pages))


def cut_at_word(text: Column, limit: int) -> Column:
    """The text within `limit` characters, cut back to the last blank, with an ellipsis where it was cut."""
    head = F.substring(text, 1, limit)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*\z", ""), F.lit("…")))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def duration(seconds: Column) -> Column:
    """A duration in words: seconds below 45, minutes below an hour, then hours, with minutes below ten hours."""
    s = seconds.cast("double")
    minutes = F.greatest(F.lit(1), F.round(s / 60).cast("int"))
    hours, rest = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    unit = lambda n, w: F.concat(n.cast("string"), F.lit(" " + w), F.when(n > 1, "s").otherwise(""))
    return F.when(s < 45, unit(F.round(s).cast("int"), "seconde")).when(minutes < 60, unit(minutes, "minute")).when((hours < 10) & (rest > 0), F.concat(hours.cast("string"), F.lit(" h "), F.lpad(rest.cast("string"), 2, "0"))).otherwise(unit(hours, "heure"))


def title_rank(title: Column) -> Column:
    """(0 title, 1 chapter, 9 neither; value of the Roman or plain number, 999 beyond XV)."""
    # Roman numbers.
    romans = dict(zip("I II III IV V VI VII VIII IX X XI XII XIII XIV XV".split(), range(1, 16)))
    pattern = r"(?i)\b(TITRE|CHAPITRE)\s+([IVXLC]+|\d+)"
    word, number = F.upper(F.regexp_extract(title, pattern, 1)), F.upper(F.regexp_extract(title, pattern, 2))
    known = F.create_map(*[x for r, n in romans.items() for x in (F.lit(r), F.lit(n))])
    value = F.coalesce(F.try_element_at(known, number), F.when(number.rlike(r"^\d+$"), number.cast("int")), F.lit(999))
    return F.struct(F.when(word == "", 9).when(word == "TITRE", 0).otherwise(1).alias("kind"), F.when(word == "", 999).otherwise(value).alias("value"), title.alias("title"))
