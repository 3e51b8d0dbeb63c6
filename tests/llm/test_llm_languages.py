"""Operator 11 against exact sets of n-grams, and its accuracy on held-out documents."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import languages, registered

WORDS = {
    "en": "the and river stone winter under above morning lantern quiet house forest".split(),
    "de": "der und fluss stein winter unter über morgen laterne stille häuser wald".split(),
    "ja": "これ は 川 石 冬 下 上 朝 提灯 静か 家 森".split(),
    "hi": "यह और नदी पत्थर सर्दी नीचे ऊपर सुबह लालटेन शांत घर जंगल".split(),
}


def prose(lang, seed, n=40):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join(rnd.choice(WORDS[lang]).capitalize() + rnd.choice([" ", ", ", ". 12 "]) for _ in range(n))


def rows():
    out = [(i, prose(lang, i), lang) for i, lang in enumerate(sorted(WORDS) * 15)]
    out += [(90, None, "en"), (91, "", "de"), (92, "12 34 !?\n", "en"), (93, "石", None), (94, "Q", None), (None, prose("de", 0), "de")]
    out += [(95, prose("en", 5, 60_000), None), (96, "́", "en"), (5, prose("de", 1), "de"), (5, prose("de", 1), "de"), (97, "x" * 70_000, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").repartition(3)
    clashes = ("gram", "n", "total", "rate", "best", "number", "slot", "word", "bit", "lang_pred", "score", "held_out")
    return df.withColumns({c: F.lit("clash") for c in clashes}).cache()


def grams(text, sizes=languages.SIZES):
    """N-grams the plain way."""
    import unicodedata

    kinds = [unicodedata.category(c)[0] for c in text]
    shown = "".join(c.lower()[0] if k == "L" else c if k == "M" else " " for c, k in zip(text, kinds, strict=True))
    out = []
    for word in shown.split():
        for size in sizes:
            padded = f" {word} "
            out += [padded[i : i + size] for i in range(len(padded) - size + 1)]
    return out


def test_n_grams_are_counted_whole(monkeypatch):
    texts = ["Über den\tFluss", "", "a", "日本語 ́ x1y", "  ", "Ab ab"]
    for window in (3, 1 << 20):
        monkeypatch.setattr(languages, "_WINDOW", window)
        for size in (2, 3, 4):
            got = [0] * len(texts)
            seen = {}
            for hashed, owner in languages.n_grams(texts, (size,)):
                for g, o in zip(hashed.tolist(), owner.tolist(), strict=True):
                    got[o] += 1
                    seen[g] = seen.get(g, 0) + 1
            want = [grams(t, (size,)) for t in texts]
            assert got == [len(w) for w in want]
            assert sorted(seen.values()) == sorted({g: sum(w.count(g) for w in want) for w in want for g in w}.values())


def test_filters_hold_what_the_rates_say(spark, docs):
    filters = languages.learn(docs)
    counts = {lang: {} for lang in WORDS}
    for _, text, lang in rows():
        if lang and text:
            for g in grams(text):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    assert filters.langs == sorted(totals, key=lambda lang: (-totals[lang], lang))
    rate = {g: {lang: c.get(g, 0) / totals[lang] for lang, c in counts.items()} for c in counts.values() for g in c}
    extra = asked = 0
    for word in ("fluss", "stone", "winter", "川", "सर्दी", "unknown"):
        for found, g in zip(filters.languages_of(word), [g for s in filters.sizes for g in grams(word, (s,))], strict=True):
            of = rate.get(g, {})
            want = {lang for lang, r in of.items() if r >= languages.LEAST_RATE and r >= 0.1 * max(of.values())}
            assert want <= set(found)  # never a language less
            extra, asked = extra + len(set(found) - want), asked + len(WORDS)
    assert extra <= 0.1 * asked and np.all(filters.chance < 0.1)
    assert set(filters.languages_of("winter")[0]) >= {"en", "de"}  # one look-up, several languages


def test_predictions(spark, docs):
    got = {}
    for r in languages.identify(docs).collect():
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert len(got[5]) == 3  # rows that repeat an id are answered each
    for doc_id, text, lang in rows():
        has_letter = any(c.isalpha() for c in text or "")
        assert all((p == "und") == (not has_letter) for p, _ in got[doc_id])
        if has_letter and lang and doc_id != 5:
            assert got[doc_id][0][0] == lang
    assert got[90] == got[91] == got[92] == got[96] == [("und", 0.0)]
    assert got[93][0][0] == "ja" and got[95][0][0] == "en" and got[95][0][1] > 0.9
    assert got[97][0] in [(lang, got[97][0][1]) for lang in WORDS]


def test_nothing_to_learn_from(spark, docs):
    assert languages.identify(docs.where("false")).collect() == []
    blind = languages.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in blind.collect()} == {("und", 0.0)}


def test_more_than_64_languages(spark):
    langs = [f"l{i:02d}" for i in range(70)]
    letters = [chr(0x4E00 + 10 * i) + chr(0x4E05 + 10 * i) for i in range(70)]
    df = spark.createDataFrame([(i, f"{w} {w}", n) for i, (n, w) in enumerate(zip(langs, letters, strict=True))], "doc_id long, text string, lang string")
    filters = languages.learn(df)
    assert filters.slots.shape[0] == 2
    assert [r.lang_pred for r in languages.predict(df, filters).orderBy("doc_id").collect()] == langs


def test_too_many_languages_are_refused(spark):
    df = spark.range(languages.MOST_LANGUAGES + 1).selectExpr("'abc' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError, match="languages"):
        languages.learn(df)


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    told = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang")
    got = registered.op11_language_id(spark, where).join(told, "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() >= 0.99
