"""Words of a text: white space, per-word normal forms and spelling variants.

Every rule exists as a Catalyst expression (for plans) and, where a Python worker needs it, as a plain
function with the same result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import resources

#: The white-space class of texts (as a regular-expression class body).
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = f"[{SPACE}]+"
ARABIC = "[\u0600-\u06ff\u0750-\u077f]"

#: Marks and the lengthening stroke that a normal form does not have.
DROPPED = (
    "\u0640"
    + "".join(map(chr, range(0x064B, 0x0660)))
    + "".join(map(chr, range(0x0610, 0x061B)))
    + "".join(map(chr, range(0x06D6, 0x06EE)))
)
#: Letters that share a normal form.
FOLDED_FROM = "\u0670\u0622\u0623\u0625\u0671\u0672\u0673\u0675\u0626\u0624\u0629\u0649"
FOLDED_TO = "\u0627" * 8 + "\u0621\u0621\u0647\u064a"
HAMZA_ALEF, ALEF = "\u0621\u0627", "\u0627"
NOT_ARABIC_LETTER = "[^\u0621-\u064a]"

MIN_LENGTH = 2

#: Words that ask a question rather than name its topic.
STOPWORDS = resources.text("stopwords.txt").split()

#: What stands before a word (article, particles, preposition) and behind it (pronouns).
LEADS = ("وال", "فال", "بال", "كال", "لل", "ال")
PARTICLES, PREPOSITION = "وف", "ل"
ENDINGS, LAST_LETTERS, OWN_HEH = ("ها", "هم", "هن", "كم", "كن", "نا", "يه"), "كي", "ه"
#: The same as patterns, for expressions, workers and SQL alike: what may go, and what must be left of the word.
LEAD, PARTICLE, SINGLE = f"(?:{'|'.join(LEADS)})", f"[{PARTICLES}]", PREPOSITION
LEFT_OF_LEAD, LEFT_OF_PARTICLE, LEFT_OF_SINGLE = ".{2,}", ".{3,}", ".{4,}"
LONG_END = f"^.{{2,}}(?:{'|'.join(ENDINGS)})$"
SHORT_END = f"^.{{2,}}[^{ALEF}]{OWN_HEH}$|^.{{3,}}[{LAST_LETTERS}]$"


# ---- Catalyst expressions -------------------------------------------------------------------------


def split_words(text: Column) -> Column:
    """Pieces between white space, in order, without empty ones; null stays null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def trim(text: Column) -> Column:
    """Without white space (the whole class) at either end."""
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def strip_marks(word: Column) -> Column:
    """Superscript alef written out, vowel signs and the lengthening stroke dropped."""
    return F.translate(word, "\u0670" + DROPPED, ALEF)


def normalize_arabic(word: Column) -> Column:
    folded = F.translate(word, FOLDED_FROM[:-2] + DROPPED, FOLDED_TO[:-2])
    joined = F.replace(folded, F.lit(HAMZA_ALEF), F.lit(ALEF))
    return F.regexp_replace(F.translate(joined, FOLDED_FROM[-2:], FOLDED_TO[-2:]), NOT_ARABIC_LETTER, "")


def normalize_english(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def is_arabic(word: Column) -> Column:
    return word.rlike(ARABIC)


def normalize(word: Column) -> Column:
    return F.when(is_arabic(word), normalize_arabic(word)).otherwise(normalize_english(word))


def without_lead(term: Column) -> Column:
    return F.regexp_replace(term, f"^{LEAD}(?={LEFT_OF_LEAD})", "")


def _without_particle(term: Column) -> Column:
    return F.regexp_replace(term, f"^{PARTICLE}(?={LEFT_OF_PARTICLE})", "")


def _without_preposition(term: Column) -> Column:
    return F.regexp_replace(term, f"^{SINGLE}(?={LEFT_OF_SINGLE})", "")


def _without_ending(term: Column) -> Column:
    return F.when(term.rlike(LONG_END), F.regexp_replace(term, "..$", "")).when(term.rlike(SHORT_END), F.regexp_replace(term, ".$", "")).otherwise(term)


def arabic_variants(term: Column) -> Column:
    """The term and what remains after its article, particle, preposition and ending go, one after another."""
    lead = without_lead(term)
    particle = _without_particle(lead)
    single = _without_preposition(particle)
    return F.array_distinct(F.array(term, lead, particle, single, _without_ending(single)))


def english_variants(term: Column) -> Column:
    """The term and its singular spellings."""
    size = F.length(term)
    stem = (
        F.when(term.endswith("ies") & (size > 3), F.concat(F.substring(term, F.lit(1), size - 3), F.lit("y")))
        .when(term.endswith("es") & (size > 4), F.substring(term, F.lit(1), size - 2))
    )
    plain = F.when(term.endswith("s") & ~term.endswith("ss") & (size > 3), F.substring(term, F.lit(1), size - 1))
    return F.array_distinct(F.array_compact(F.array(term, stem, plain)))


def variants(raw: Column, word: Column) -> Column:
    return F.when(is_arabic(raw), arabic_variants(word)).otherwise(english_variants(word))


def terms(text: Column) -> Column:
    """All index terms of a text: each word's normal form and variants of two or more characters, repeats kept."""
    per_word = F.transform(
        split_words(text),
        lambda raw: F.when(F.length(normalize(raw)) >= MIN_LENGTH, F.filter(variants(raw, normalize(raw)), lambda v: F.length(v) >= MIN_LENGTH)).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return F.flatten(per_word)


def unique_terms(text: Column) -> Column:
    return F.array_distinct(terms(text))


def words(text: Column) -> Column:
    """Normal forms of two or more characters, in order; an empty array for null."""
    kept = F.filter(F.transform(split_words(text), normalize), lambda w: F.length(w) >= MIN_LENGTH)
    return F.coalesce(kept, F.array().cast("array<string>"))


def is_stopword(term: Column) -> Column:
    return term.isin(STOPWORDS)


# ---- the same rules in a Python worker -------------------------------------------------------------

_SPLIT = re.compile(SPACES)
_ARABIC = re.compile(ARABIC)
_FOLD = {ord(a): b for a, b in zip(FOLDED_FROM[:-2], FOLDED_TO[:-2])} | dict.fromkeys(map(ord, DROPPED))
_FOLD_LAST = str.maketrans(FOLDED_FROM[-2:], FOLDED_TO[-2:])
_NOT_ARABIC = re.compile(NOT_ARABIC_LETTER)
_NOT_LATIN = re.compile("[^a-z0-9]")


def py_split(text: str | None) -> list[str]:
    return [p for p in _SPLIT.split(text or "") if p]


def py_normalize(piece: str) -> str:
    if _ARABIC.search(piece):
        return _NOT_ARABIC.sub("", piece.translate(_FOLD).replace(HAMZA_ALEF, ALEF).translate(_FOLD_LAST))
    return _NOT_LATIN.sub("", piece.lower())


class WordReader:
    """Words of texts in a worker; the normal forms met are remembered up to a bound on entries, never on results."""

    def __init__(self, remember: int = 200_000) -> None:
        self.seen: dict[str, str] = {}
        self.remember = remember

    def word(self, piece: str) -> str:
        got = self.seen.get(piece)
        if got is None:
            got = py_normalize(piece)
            if len(got) < MIN_LENGTH:
                got = ""
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[piece] = got
        return got

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        word = self.word
        return [w for w in map(word, _SPLIT.split(text)) if w]


_LEAD = re.compile(f"^{LEAD}(?={LEFT_OF_LEAD})")
_PARTICLE, _PREPOSITION = re.compile(f"^{PARTICLE}(?={LEFT_OF_PARTICLE})"), re.compile(f"^{SINGLE}(?={LEFT_OF_SINGLE})")
_LONG_END, _SHORT_END = re.compile(LONG_END), re.compile(SHORT_END)


def py_without_lead(word: str) -> str:
    return _LEAD.sub("", word)


def py_variants(raw: str, word: str) -> list[str]:
    """variants() in a worker."""
    if _ARABIC.search(raw):
        lead = py_without_lead(word)
        particle = _PARTICLE.sub("", lead)
        single = _PREPOSITION.sub("", particle)
        end = single[:-2] if _LONG_END.search(single) else single[:-1] if _SHORT_END.search(single) else single
        spelt = [word, lead, particle, single, end]
    else:
        size, spelt = len(word), [word]
        if word.endswith("ies") and size > 3:
            spelt.append(word[:-3] + "y")
        elif word.endswith("es") and size > 4:
            spelt.append(word[:-2])
        if word.endswith("s") and not word.endswith("ss") and size > 3:
            spelt.append(word[:-1])
    return list(dict.fromkeys(spelt))


class TermReader:
    """Index terms of texts in a worker: a piece's terms are made once and remembered up to a bound on entries."""

    def __init__(self, remember: int = 200_000) -> None:
        self.seen: dict[str, tuple[str, ...]] = {}
        self.remember, self.stop = remember, frozenset(STOPWORDS)

    def made(self, piece: str) -> tuple[str, ...]:
        word = py_normalize(piece)
        got = tuple(v for v in py_variants(piece, word) if len(v) >= MIN_LENGTH and v not in self.stop) if len(word) >= MIN_LENGTH else ()
        if len(self.seen) >= self.remember:
            self.seen.clear()
        self.seen[piece] = got
        return got

    def counts(self, text: str | None) -> dict[str, int]:
        """Term -> occurrences, without stopwords."""
        out: dict[str, int] = {}
        seen = self.seen
        for piece in _SPLIT.split(text) if text else ():
            terms = seen.get(piece)
            for term in self.made(piece) if terms is None else terms:
                out[term] = out.get(term, 0) + 1
        return out
