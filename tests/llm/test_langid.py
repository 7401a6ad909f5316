"""Language filters: held-out accuracy, odd rows."""

from pyspark.sql import functions as F

from skimlode.llm import common, langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op4_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    filters = langid.fit(docs)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of ing " * 200000), (4, "the and of ing " * 200000), (None, "中文"), (6, "a")]
    odd = spark.createDataFrame([(i, t, "old", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    out = {(r.doc_id, r.text): r for r in langid.predict(odd, filters).collect()}
    assert [out[k].lang_pred for k in rows[:3]] == ["und"] * 3 and out[rows[3]].lang_pred == "en"
    assert out[(None, "中文")].score == 0 and langid.predict(odd.limit(0), filters).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_masks_name_all_languages_of_an_ngram():
    f = langid.fit_texts({"a": ["foo bar"] * 5, "b": ["foo baz"] * 5, "c": ["qux"] * 5})
    keys = lambda t, n: langid._grams(langid._codes(t), n)[0]
    assert all(int(m[0]) & 3 == 3 for m in f.masks(keys("foo", 3))) and f.predict(["foo baz", "bar", "qux"])[0] == ["b", "a", "c"]


def test_long_texts_are_counted_whole():
    f = langid.fit_texts({"a": ["foo bar"] * 5, "b": ["qux zap"] * 5})
    old, langid.PIECE_CHARS = langid.PIECE_CHARS, 50
    try:
        text = "foo bar " * 40 + "qux zap " * 60
        small = f.predict([text, "", "zap"])
    finally:
        langid.PIECE_CHARS = old
    assert small == f.predict([text, "", "zap"]) and common.HOT_SHARE == 1000


def test_copies_count_once_in_the_sample(spark):
    words = [f"{a}{b}{c}o" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(words[(i * 7 + j * (i + 1)) % len(words)] for j in range(9)) for i in range(60)]
    rows = [("x", t) for i, t in enumerate(texts) for _ in range(50 if i % 6 == 0 else 1)]
    fit = lambda r: langid.fit(spark.createDataFrame(r, "lang string, text string"), sample_docs=20)
    once, copied = fit([("x", t) for t in texts]), fit(rows)
    assert once.slots.any() and (once.slots == copied.slots).all()


def test_against_sets_of_ngrams():
    """The same rule with sets of strings: typical n-grams of each language, and how many of them a text has."""
    import random
    from collections import Counter

    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(30))
    kinds = {"a": "abcdeé", "b": "cdefgß", "c": "fghijñ"}
    samples = {name: [make(letters) for _ in range(20)] for name, letters in kinds.items()}

    def grams(text):
        out = []
        for word in text.lower().split():
            whole = f"\0{word}\0"
            out += [whole[i : i + n] for n in langid.SIZES for i in range(len(whole) - n + 1) if n > 2 or whole[i : i + 2].strip("\0")]
        return out

    counts = {name: Counter(g for t in texts for g in grams(t)) for name, texts in samples.items()}
    rate = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in counts.items()}
    typical = {name: {g for g, n in c.items() if n >= langid.LEAST and rate[name][g] >= langid.SHARE * max(r.get(g, 0) for r in rate.values())} for name, c in counts.items()}
    filters = langid.fit_texts(samples)
    for letters in [*kinds.values(), "abcdefgh", "ghij"]:
        for _ in range(20):
            text = make(letters)
            hits = {name: sum(g in typical[name] for g in grams(text)) for name in kinds}
            best = max(hits.values())
            found, score = filters.predict([text])
            assert hits[found[0]] >= best - 1 and abs(score[0] - best / max(1, sum(hits.values()))) < 0.05
