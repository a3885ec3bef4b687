import random
from math import log2

import numpy as np

from tessera.llm import langid


def brute_bits(counts, text, order=langid.ORDER):
    """counts: {context bytes: {byte: n}} of one language; the code length with escape and exclusion."""
    data = b"\n" * order + text

    def dist(ctx):
        if ctx is None:
            return [1 / 256] * 256
        lower = dist(ctx[1:] if ctx else None)
        own = counts.get(ctx)
        if not own:
            return lower
        n, q = sum(own.values()), len(own)
        left = sum(p for b, p in enumerate(lower) if b not in own)
        return [own[b] / (n + q) if b in own else q / (n + q) * p / left for b, p in enumerate(lower)]

    total = 0.0
    for i in range(order, len(data)):
        d = dist(data[i - order : i])
        assert abs(sum(d) - 1) < 1e-9
        total -= log2(d[data[i]])
    return total


def test_code_lengths_are_exact():
    texts = {"x": [b"abracadabra", b"aab aab"], "y": [b"banana bandana"]}
    langs = sorted(texts)
    table, counts = {}, {}
    for at, one in enumerate(langs):
        counts[one] = {}
        for t in texts[one]:
            for g in langid._grams(t).tolist():
                table.setdefault(g, [0, 0])[at] += 1
            data = b"\n" * 3 + t
            for i in range(3, len(data)):
                for k in range(4):
                    own = counts[one].setdefault(data[i - k : i], {})
                    own[data[i]] = own.get(data[i], 0) + 1
    grams = np.array(sorted(table), np.uint32)
    model = langid.Model.of_grams(tuple(langs), grams, np.array([table[g] for g in grams.tolist()]))
    tables = langid.Tables(model, langid.Contexts(model))
    queries = [b"abra banana", b"zzz", b"", bytes(range(256)), b"a" * 50]
    got = langid.code_lengths(tables, queries)
    for t, row in zip(queries, got, strict=True):
        for one, bits in zip(langs, row, strict=True):
            assert abs(bits - brute_bits(counts[one], t)) < 1e-3 * (1 + bits)


def test_slices_do_not_matter(monkeypatch):
    grams = np.unique(langid._grams(b"the cat sat on the mat " * 9))
    model = langid.Model.of_grams(("a", "b"), grams, np.ones((len(grams), 2), np.int64))
    tables = langid.Tables(model, langid.Contexts(model))
    texts = [b"the mat " * k for k in range(40)]
    whole = langid.code_lengths(tables, texts)
    monkeypatch.setattr(langid, "SLICE", 8 * 50)
    assert np.allclose(whole, langid.code_lengths(tables, texts))


def test_languages_in_parts(monkeypatch):
    dice = np.random.default_rng(1)
    grams = np.unique(langid._grams(b"the cat sat on the mat " * 3 + bytes(dice.integers(97, 110, 200, np.uint8))))
    counts = dice.integers(0, 3, (len(grams), 11))
    model = langid.Model.of_grams(tuple("abcdefghijk"), grams, counts, 40)
    texts = [b"the mat", b"zz", b"abcabc" * 9]
    whole = langid._all_lengths(model, texts)
    monkeypatch.setattr(langid, "CELLS", 3 * 40 * langid.Contexts(model).classes)
    assert langid.languages_at_once(model, langid.Contexts(model)) == 3
    assert whole.shape == (3, 11) and np.allclose(whole, langid._all_lengths(model, texts))


def test_more_than_256_languages(spark):
    letters = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i * 300 + j, letters[j] * 9 + " " + letters[j] * 5, f"l{j}") for j in range(300) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.langs) == 300
    assert df.count() == sum(r["lang"] == r["lang_pred"] for r in langid.predict(df, model).collect())


def test_existing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "abab", "x", 1, "u"), (2, "cdcd", "y", 2, "v")], "doc_id long, text string, Lang_Pred string, score int, _text string")
    out = langid.predict(df, langid.fit(df, lang="Lang_Pred"))
    assert out.columns == ["doc_id", "_text", "lang_pred", "score"]
    assert [r["lang_pred"] for r in out.orderBy("doc_id").collect()] == ["x", "y"]


def table(spark, n=300):
    dice = random.Random(4)
    parts = {"en": ["the", "ing", "ed", "th", "ou"], "fr": ["le", "ét", "eau", "que", "oi"], "de": ["sch", "ung", "ein", "ü", "ich"]}
    out = []
    for i in range(n):
        lang = dice.choice(sorted(parts))
        words = ["".join(dice.choices(parts[lang], k=dice.randint(1, 3))) for _ in range(60)]
        out.append((i, " ".join(words), lang if i % 5 else None, lang))
    out += [(n, None, "en", "und"), (n + 1, "", "fr", "und"), (n + 2, "123 !!", "en", "und"), (n + 3, "the " * 40_000, "en", "en"), (None, "thing the ed", "en", "en"), (1, out[1][1], None, out[1][3])]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy(spark):
    df = table(spark)
    got = langid.predict_held_out(df).collect()
    truth = {(r["doc_id"], r["text"] is None): r["truth"] for r in df.collect()}
    assert len(got) == df.count()
    truth = {r["doc_id"]: r["truth"] for r in df.collect()}
    import zlib

    for r in got:
        want = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == want and 0 <= r["score"] <= 1
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in got]
    assert sum(right) / len(right) > 0.98
    again = langid.predict_held_out(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.predict_held_out(df).collect()} == {("und", 0.0)}
    assert langid.predict_held_out(df.where("doc_id > 9")).count() == 0


def test_all_contexts_stay_without_a_number(spark):
    """A rare language in a script of its own keeps its contexts, which a bound over all languages takes away."""
    rows = [(i, "the cat sat on the mat with a hat " * 20, "en") for i in range(60)] + [(100 + i, "\u03b1\u03b2\u03b3 \u03b4\u03b5", "el") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, cut = langid.fit(docs, contexts=None), langid.fit(docs, contexts=20)
    own = {bytes(t.encode()[i - k : i]) for t in ("\n\n\n\u03b1\u03b2\u03b3 \u03b4\u03b5",) for i in range(3, len(t.encode())) for k in range(4)}
    kept = {int(c).to_bytes(4, "big")[4 - int(k) :] if k else b"" for k, c in zip(whole.order, whole.context, strict=True)}
    assert own <= kept and len(whole.order) > len(cut.order) == 20
