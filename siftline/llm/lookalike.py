"""Problem 3: one consistent form for texts that look the same but are stored with different characters."""

from __future__ import annotations

import pkgutil
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut

#: Compatibility mappings of these kinds change a character's code, not its look.
SAME_LOOK = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
#: Format characters that do show.
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Characters that show nothing though they aren't format characters.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}
#: Letters of other scripts that are drawn like Latin ones, and digits that share a shape: data/look_alikes.txt.
_TABLE = (line.split() for line in pkgutil.get_data("siftline.llm", "data/look_alikes.txt").decode("utf-8").splitlines() if line.startswith("U+"))
LOOKS_LIKE = {chr(int(code[2:], 16)): like for code, _, like in _TABLE}
#: Arabic letters whose look depends on whether another letter follows: before a letter, at the end of a run.
KEHEH, KAF, FARSI_YEH, YEH, DOTLESS_YEH, AE, HEH = "\u06a9", "\u0643", "\u06cc", "\u064a", "\u0649", "\u06d5", "\u0647"
MARKS = "\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed"
JOINING = "\u0620\u0622-\u064a\u066e\u066f\u0671-\u0673\u0675-\u06d3\u06d5\u06fa-\u06fc\u06ff\u0750-\u077f"
#: Texts made of these, with no two marks in a row, already are in the consistent form.
PLAIN = " -~\\t\\n\\r\u00ab\u00bb\u060c\u061b\u061f\u0621-\u063a\u0640-\u064a\u0660-\u0669"
PLAIN_MARKS = "\u064b-\u0652"


@lru_cache(1)
def tables() -> tuple[list[tuple[str, str]], list[tuple[str, int, bool]], dict[str, str]]:
    """(character, what it decomposes to), (mark, class, whether it composes), (starter + mark -> composed): by rule
    from the Unicode data of Python, about 16,000, 900 and 950 entries whatever the input."""
    into, marks, pairs, composing = [], [], {}, set()

    def same(text: str, deep: int = 0) -> str:
        out = []
        for c in text:
            code, kind = ord(c), unicodedata.decomposition(c)
            if (unicodedata.category(c) == "Cf" and code not in VISIBLE_FORMAT) or code in INVISIBLE:
                continue
            if unicodedata.category(c) == "Zs":
                out.append(" ")
            elif kind and (kind[0] != "<" or kind.split()[0] in SAME_LOOK) and deep < 8:
                chars = "".join(chr(int(x, 16)) for x in kind.split() if x[0] != "<")
                out.append(same(chars, deep + 1))
            else:
                out.append(LOOKS_LIKE.get(c) or unicodedata.normalize("NFD", c))
        return "".join(out)

    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if (to := same(c)) != c:
            into.append((c, to))
        if kind := unicodedata.decomposition(c):
            parts = kind.split()
            if len(parts) == 2 and kind[0] != "<" and unicodedata.normalize("NFC", c) == c:
                a, b = (chr(int(x, 16)) for x in parts)
                if unicodedata.combining(b):
                    pairs[a + b] = c
                    composing.add(b)
        if unicodedata.combining(c):
            marks.append((c, unicodedata.combining(c)))
    return into, [(c, k, c in composing) for c, k in marks], pairs


#: The white space of texts, character by character.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _by_context(text: Column) -> Column:
    """Arabic letters that look like another one only before a letter, or only where no letter follows."""
    before_letter = f"(?=[{MARKS}]*[{JOINING}])"
    text = F.regexp_replace(text, KEHEH + before_letter, KAF)
    text = F.regexp_replace(text, FARSI_YEH + before_letter, YEH)
    text = F.replace(text, F.lit(FARSI_YEH), F.lit(DOTLESS_YEH))
    return F.regexp_replace(text, f"{AE}(?![{MARKS}]*[{JOINING}])", HEH)


def _rebuilt(texts: DataFrame) -> DataFrame:
    """(_key, _form) of (_key, _text): positioned code points, mapped, marks ordered by class, recomposed, joined."""
    spark = texts.sparkSession
    into, marks, pairs = tables()
    mapping = F.broadcast(spark.createDataFrame(into, "_char string, _to string"))
    classes = F.broadcast(spark.createDataFrame(marks, "_char string, _class int, _composes boolean"))
    points = texts.select("_key", F.posexplode(F.split("_text", "")).alias("_pos", "_char"))
    mapped = points.join(mapping, "_char", "left").select("_key", "_pos", F.coalesce("_to", "_char").alias("_to"))
    single = mapped.select("_key", "_pos", F.posexplode(F.split("_to", "")).alias("_sub", "_char")).where("_char <> ''")
    classed = single.join(classes, "_char", "left").select(
        "_key", "_pos", "_sub", "_char",
        F.coalesce("_class", F.lit(0)).alias("_class"), F.coalesce("_composes", F.lit(False)).alias("_composes"),
    )
    # a code point of class 0 opens a cluster; all that follows needs the one exchange by text
    along = Window.partitionBy("_key").orderBy("_pos", "_sub")
    clustered = classed.withColumn("_cluster", F.sum((F.col("_class") == 0).cast("int")).over(along))
    clusters = clustered.groupBy("_key", "_cluster").agg(
        F.array_sort(F.collect_list(F.struct("_class", "_pos", "_sub", "_char", "_composes"))).alias("_points")
    )
    table = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))

    def state(starter: Column, tail: Column, last: Column) -> Column:
        return F.struct(starter.alias("starter"), tail.alias("tail"), last.alias("last"))

    def compose(acc: Column, m: Column) -> Column:
        free = m["_composes"] & (acc["last"] < m["_class"])
        pair = F.when(free, F.element_at(table, F.concat(acc["starter"], m["_char"])))
        return (
            F.when(m["_class"] == 0, state(m["_char"], F.lit(""), F.lit(0)))
            .when(pair.isNotNull(), state(pair, acc["tail"], acc["last"]))
            .otherwise(state(acc["starter"], F.concat(acc["tail"], m["_char"]), m["_class"]))
        )

    start = state(F.lit(""), F.lit(""), F.lit(0))
    whole = F.aggregate("_points", start, compose, lambda a: F.concat(a["starter"], a["tail"]))
    plain = F.array_join(F.transform("_points", lambda m: m["_char"]), "")
    written = clusters.select(
        "_key", "_cluster", F.when(F.exists("_points", lambda m: m["_composes"]), whole).otherwise(plain).alias("_part")
    )
    parts = F.array_sort(F.collect_list(F.struct("_cluster", "_part")))
    rebuilt = written.groupBy("_key").agg(F.array_join(F.transform(parts, lambda p: p["_part"]), "").alias("_form"))
    return rebuilt.select("_key", _by_context(F.col("_form")).alias("_form"))


def consistent(texts: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys, stored, form) of every text that isn't null or blank: as stored without white space at its ends, and in
    the one form that all texts of the same look share.

    Canonical and width variants, presentation forms, all spaces of one character, invisible characters, the order of
    marks, look-alike letters of other scripts, and Arabic letters that share their shape in their place come out
    alike, and so do digits of one shape. Vowel signs, dots, hamzas, elongations, the shape of digits, punctuation and the
    number of spaces stay.

    Texts that contain nothing to change (no character outside the plain ones, no two marks in a row) keep their
    spelling without being exploded: the mapping is the identity on them. In other texts the pieces between plain
    spaces are positioned; no rule reaches over a plain space, so every distinct piece with something to change is
    exploded to its code points once, however often it occurs, and the texts are rebuilt from the pieces in order. A
    frequent piece joins as one row on its side. The two mapping tables come from the Unicode
    data, of fixed size, and are broadcast. keys must identify a text, as rec_id does after the reduction to records.
    """
    known = texts.select(*keys, F.col(field).alias("_text")).where(F.col("_text").isNotNull())
    known = known.select(*keys, trimmed(F.col("_text")).alias("_stored")).where("_stored <> ''")
    needs = f"[^{PLAIN}{PLAIN_MARKS}]|[{PLAIN_MARKS}]{{2}}"
    known = cut(known.withColumn("_odd", F.col("_stored").rlike(needs)))
    pieces = known.where("_odd").select(F.struct(*keys).alias("_key"), F.posexplode(F.split("_stored", " ")).alias("_at", "_piece"))
    pieces = cut(pieces.withColumn("_needs", F.col("_piece").rlike(needs)))
    met = pieces.where("_needs")
    forms = _rebuilt(met.select(F.col("_piece").alias("_key"), F.col("_piece").alias("_text")).distinct()).withColumnRenamed("_key", "_piece")
    mapped = met.join(forms, "_piece", "left").select("_key", "_at", F.coalesce("_form", F.lit("")).alias("_form"))
    plain = pieces.where("not _needs").select("_key", "_at", F.col("_piece").alias("_form"))
    parts = F.array_sort(F.collect_list(F.struct("_at", "_form")))
    whole = mapped.unionByName(plain).groupBy("_key").agg(F.array_join(F.transform(parts, lambda p: p["_form"]), " ").alias("_form"))
    done = known.where("_odd").withColumn("_key", F.struct(*keys)).join(whole, "_key")
    changed = done.select(*keys, F.col("_stored").alias("stored"), trimmed(F.col("_form")).alias("form"))
    same = known.where("not _odd").select(*keys, F.col("_stored").alias("stored"), F.col("_stored").alias("form"))
    return changed.unionByName(same)


def same_look(forms: DataFrame, group: str, key: str) -> DataFrame:
    """(group, id_a, id_b): keys whose stored texts differ but share a form; smaller key first, every pair once.

    Rows first become classes of equal stored texts, with only digests on the way; only classes of different texts
    within one form are paired, so a hot group of copies yields no candidate among its own members. Texts whose form is
    empty (nothing visible) are left out.
    """
    members = forms.where("form <> ''").select(
        group, F.col(key).alias("_id"), F.unhex(F.sha2("form", 256)).alias("_form"), F.unhex(F.sha2("stored", 256)).alias("_as")
    )
    several = members.groupBy(group, "_form").agg(F.min("_as").alias("_a"), F.max("_as").alias("_z")).where("_a < _z")
    members = members.join(several.select(group, "_form"), [group, "_form"], "left_semi").distinct()
    classes = members.select(group, "_form", "_as").distinct()
    other = classes.select(group, "_form", F.col("_as").alias("_as_b"))
    pairs = classes.join(other, [group, "_form"]).where("_as < _as_b")
    left = members.withColumnRenamed("_id", "_id_a")
    right = members.select(group, "_form", F.col("_as").alias("_as_b"), F.col("_id").alias("_id_b"))
    both = pairs.join(left, [group, "_form", "_as"]).join(right, [group, "_form", "_as_b"])
    return both.where("_id_a <> _id_b").select(
        group, F.least("_id_a", "_id_b").alias("id_a"), F.greatest("_id_a", "_id_b").alias("id_b")
    ).distinct()
