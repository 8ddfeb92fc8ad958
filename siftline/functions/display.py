"""What a result shows: readable text, segments, highlighting, labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import words as W

QUOTE = r"\{[^{}]*\}"
RANGES = "array<struct<start:int,end:int>>"
#: Shortest term that is highlighted, and marks at most per text.
SHORTEST, MARKS = 3, 40


def readable(ar: Column) -> Column:
    """The text proper, else its chain, trimmed; empty without either."""
    return W.trim(F.coalesce(F.nullif(ar["matn"], F.lit("")), F.nullif(ar["sanad"], F.lit("")), F.lit("")))


def segments(ar: Column) -> Column:
    """array<struct<text, kind>>: the chain, then the text, with quotes in braces apart; trimmed, without empty ones."""

    def cut_up(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s){QUOTE}|(?:(?!{QUOTE}).)+"), F.lit(0))
        return F.transform(found, lambda s: F.struct(W.trim(s).alias("text"), F.when(s.rlike(f"^{QUOTE}$"), "quran").otherwise(kind).alias("kind")))

    return F.filter(F.concat(cut_up(ar["sanad"], "sanad"), cut_up(ar["matn"], "matn")), lambda s: s["text"] != "")


def merge_ranges(ranges: Column) -> Column:
    """Ranges by start, with touching and overlapping ones joined."""
    typed = F.array_sort(ranges)
    start = F.array().cast(RANGES)

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (r["start"] <= F.when(F.size(done) > 0, last["end"])),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(typed, start, add)


_RUN = r"[\p{L}\p{M}" + "\u0640]+"


def _hits(text: str | None, wanted: list[str], limit: int, find) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for run in find(text or ""):
        if len(out) >= limit:
            break
        word = W.py_normalize(run.group())
        if word and any(w in word for w in wanted):
            if out and run.start() <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], run.end()))
            else:
                out.append((run.start(), run.end()))
    return out


def _utf16(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Offsets in UTF-16 units: one more for every character before that lies outside the first plane."""
    wide = [i for i, c in enumerate(text or "") if ord(c) > 0xFFFF]
    at = lambda i: i + sum(w < i for w in wide)
    return [{"start": at(a), "end": at(b)} for a, b in ranges]


def highlight_ranges(text: Column, query: Column, limit: int = MARKS) -> Column:
    """Ranges (UTF-16 units) of letter runs that are or contain one of the query's terms; an Arrow UDF, for Catalyst
    has no match offsets. The query's terms are made by expressions."""
    wanted = F.filter(W.unique_terms(query), lambda t: F.length(t) >= SHORTEST)

    @F.pandas_udf(RANGES)
    def ranges(texts: pd.Series, terms: pd.Series) -> pd.Series:
        import regex

        find = regex.compile(_RUN).finditer
        return pd.Series([_utf16(t, _hits(t, list(w) if w is not None else [], limit, find)) for t, w in zip(texts, terms)])

    return ranges(text, wanted)


def escape(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def _marked(text: str, wanted: list[str], limit: int, find) -> str:
    from html import escape as esc

    plain = lambda s: esc(s, quote=False).replace('"', "&quot;")
    parts, at = [], 0
    for a, b in _hits(text, wanted, limit, find):
        parts += [plain(text[at:a]), "<mark>", plain(text[a:b]), "</mark>"]
        at = b
    return "".join(parts) + plain(text[at:])


def mark(text: Column, query: Column, limit: int = MARKS) -> Column:
    """Escaped text with the query's words in <mark>."""
    wanted = F.filter(W.unique_terms(query), lambda t: F.length(t) >= SHORTEST)

    @F.pandas_udf("string")
    def marked(texts: pd.Series, terms: pd.Series) -> pd.Series:
        import regex

        find = regex.compile(_RUN).finditer
        return pd.Series([_marked(text or "", list(own) if own is not None else [], limit, find) for text, own in zip(texts, terms)])

    return marked(text, wanted)


#: Classes of the segments' colours.
COLOURS = {"sanad": "ar-sanad", "quran": "ar-quran", "matn": "ar-matn"}


def coloured(ar: Column, query: Column, extra: str = "", limit: int = MARKS) -> Column:
    """The whole Arabic text as HTML: every segment a span of its colour with the query's words marked; empty without any."""
    wanted = F.filter(W.unique_terms(query), lambda t: F.length(t) >= SHORTEST)

    @F.pandas_udf("string")
    def spans(parts: pd.Series, terms: pd.Series) -> pd.Series:
        import regex

        find, out = regex.compile(_RUN).finditer, []
        for own, words in zip(parts, terms):
            words = list(words) if words is not None else []
            body = [f'<span class="{COLOURS[s["kind"]]}">{_marked(s["text"], words, limit, find)}</span>' for s in (own if own is not None else [])]
            out.append(f'<p class="arabic{" " + extra if extra else ""}" dir="rtl" lang="ar">{" ".join(body)}</p>' if body else "")
        return pd.Series(out)

    return spans(segments(ar), wanted)


def topic_key(text: Column) -> Column:
    """Words in their Arabic normal form, or the Latin one where that is empty, joined by single spaces."""
    each = lambda w: F.coalesce(F.nullif(W.normalize_arabic(w), F.lit("")), W.normalize_english(w))
    return F.array_join(F.filter(F.transform(W.split_words(F.lower(text)), each), lambda w: w != ""), " ")


def flat(text: Column) -> Column:
    """Marks stripped, alef forms as one, single spaces."""
    bare = F.translate(W.strip_marks(text), "\u0622\u0623\u0625\u0671", W.ALEF * 4)
    return F.trim(F.regexp_replace(bare, W.SPACES, " "))


def content_words(text: Column, shortest: int = 3) -> Column:
    return F.array_distinct(F.filter(F.transform(W.split_words(text), W.normalize), lambda w: F.length(w) >= shortest))


def pick(arabic: Column, english: Column, lang: str) -> Column:
    first, second = (arabic, english) if lang == "ar" else (english, arabic)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")), F.lit(""))


def passage(ar: Column, en: Column, chapter_ar: Column, chapter_en: Column) -> Column:
    """The text a vector stands for: one line, without the chain."""
    parts = F.filter(F.array(ar["matn"], en, chapter_ar, chapter_en), lambda p: p.isNotNull() & (p != ""))
    return F.trim(F.regexp_replace(F.array_join(parts, " "), W.SPACES, " "))


def chips(slug: Column, ref: Column, inbookref: Column, chapter: Column, grade: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.array_compact(F.array(F.coalesce(filled(ref), filled(slug)), filled(inbookref), filled(chapter), filled(grade)))


def why(lexical_rank: Column, vector_rank: Column, terms: Column, most: int = 6) -> Column:
    label = (
        F.when((lexical_rank > 0) & (vector_rank > 0), "both")
        .when(lexical_rank > 0, "words")
        .when(vector_rank > 0, "meaning")
        .otherwise("weak")
    )
    return F.when(F.size(terms) > 0, F.concat(label, F.lit(": "), F.array_join(F.slice(F.array_distinct(terms), 1, most), ", "))).otherwise(label)


def eastern_digits(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "".join(map(chr, range(0x0660, 0x066A))))


def num(value: Column, lang: str) -> Column:
    """A whole number with grouped thousands, in the digits and signs of the language."""
    text = F.format_number(value.cast("bigint"), 0)
    return F.translate(text, "0123456789,", "".join(map(chr, range(0x0660, 0x066A))) + "\u066c") if lang == "ar" else text


def size_text(size: Column, lang: str = "en") -> Column:
    """Millions of bytes, rounded half up."""
    amount = num(F.floor(F.coalesce(size, F.lit(0)) / 1e6 + 0.5), lang)
    return F.concat(amount, F.lit(" م.ب" if lang == "ar" else " MB"))


def percent_text(share: Column, lang: str = "en") -> Column:
    return F.concat(num(F.floor(share * 100 + 0.5), lang), F.lit("\u066a" if lang == "ar" else "%"))


def text_of(ar: Column, en: Column) -> Column:
    """Text, chain and translation as one, without empty parts."""
    return F.array_join(F.filter(F.array(ar["matn"], ar["sanad"], en), lambda p: p.isNotNull() & (p != "")), " ")


def snippet(ar: Column, en: Column, limit: int = 90) -> Column:
    """The beginning of text and translation on one line."""
    both = F.array_join(F.filter(F.array(ar["matn"], en), lambda p: p.isNotNull() & (p != "")), " | ")
    return F.substring(F.regexp_replace(both, W.SPACES, " "), 1, limit)


_PLACE = re.compile(r"\{(\w+)\}")


def fill(template: str, **values: Column) -> Column:
    """The template with its {name} places filled; unknown places stay."""
    parts, at = [], 0
    for place in _PLACE.finditer(template):
        parts += [F.lit(template[at : place.start()]), values[place[1]].cast("string") if place[1] in values else F.lit(place[0])]
        at = place.end()
    return F.concat(*parts, F.lit(template[at:]))
