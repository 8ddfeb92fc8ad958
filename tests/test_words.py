import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import words as W


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("الصَّلَاةِ", "الصلاه"),
        ("قُرْءَان", "قران"),
        ("ﷺ", ""),
        ("word،", ""),
        ("für", "fr"),
        ("Don’t", "dont"),
        ("al-Salat", "alsalat"),
        ("رَحْمٰن", "رحمان"),
        ("مؤمن", "مءمن"),
    ],
)
def test_normal_forms(spark, raw, expected):
    assert value(spark, W.normalize(F.lit(raw))) == expected
    assert W.py_normalize(raw) == expected


@pytest.mark.parametrize(
    "term, expected",
    [
        ("لاخيه", ["لاخيه", "اخيه", "اخ"]),
        ("الصلاه", ["الصلاه", "صلاه"]),
        ("لبن", ["لبن"]),
        ("علي", ["علي"]),
        ("وبالصلاه", ["وبالصلاه", "بالصلاه"]),
        ("prayers", ["prayers", "prayer"]),
        ("duties", ["duties", "duty", "dutie"]),
        ("boxes", ["boxes", "box", "boxe"]),
        ("grass", ["grass"]),
    ],
)
def test_variants(spark, term, expected):
    assert value(spark, W.variants(F.lit(term), F.lit(term))) == expected == W.py_variants(term, term)


def restated(term):
    """The stripping rules, one step after another."""
    out, core = [term], term
    for prefix in ("وال", "فال", "بال", "كال", "لل", "ال"):
        if core.startswith(prefix) and len(core) - len(prefix) >= 2:
            core = core[len(prefix) :]
            out.append(core)
            break
    for letters, over in (("وف", 3), ("ل", 4)):
        if core[:1] in tuple(letters) and len(core) > over:
            core = core[1:]
            out.append(core)
    if re.search("^..+(?:ها|هم|هن|كم|كن|نا|يه)$", core):
        out.append(core[:-2])
    elif core[-1:] in ("ه", "ك", "ي") and len(core) >= 4 and not core.endswith("اه"):
        out.append(core[:-1])
    return list(dict.fromkeys(out))


def test_variants_agree_with_the_rules(spark):
    import random

    draw = random.Random(4)
    terms = {"".join(draw.choice("والفبكلهمنايتر") for _ in range(draw.randint(2, 9))) for _ in range(4000)}
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", W.arabic_variants(F.col("t")).alias("v")).collect()
    assert all(r.v == restated(r.t) == W.py_variants(r.t, r.t) for r in rows)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB \u00a0\u0627\u060c\ufeff \u0629\u0649'\u20191\u0670\u0640\u064f\t", max_size=30), min_size=1, max_size=20))
def test_worker_and_plan_agree(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", W.words(F.col("t")).alias("w")).collect()
    reader = W.WordReader()
    assert all(r.w == reader.words(r.t) for r in rows)


def test_white_space(spark):
    assert value(spark, W.split_words(F.lit("a\u00a0b\ufeffc\u2028d\u200fe\tf"))) == ["a", "b", "c", "d\u200fe", "f"]
    assert value(spark, W.words(F.lit(None).cast("string"))) == []
    assert value(spark, W.split_words(F.lit(None).cast("string"))) is None


def test_terms(spark):
    assert value(spark, W.unique_terms(F.lit("a I x"))) == []
    assert value(spark, W.terms(F.lit("prayers الصلاه"))) == ["prayers", "prayer", "الصلاه", "صلاه"]
