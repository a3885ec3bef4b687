import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if wins[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_report(docs):
    got = quality.quality_report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        n, chars, symbols, dup, rep = brute(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), r["doc_id"]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_filter_agrees_with_report(docs):
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in quality.quality_report(docs).where("kept").collect())
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == kept


def test_repeated_windows(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "a b c d e f", "a b", "x y z q x y z x y z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.quality_report(df).collect():
        assert r["n_repeat_words"] == brute(r["text"])[4]


def test_empty(empty):
    assert quality.quality_report(empty).count() == 0
    assert quality.quality_filter(empty).count() == 0


def test_order_is_by_rejection_per_cost(spark, monkeypatch):
    """With a clock that gives each rule its cost: two rules of equal rejection by cost, then by rejection, names on ties."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"t{i}",) for i in range(40)], "text string")
    n = F.substring("text", 2, 9).cast("int")
    rules = [quality.Rule("dear_half", n < 20), quality.Rule("cheap_half", n < 20), quality.Rule("cheap_none", n < 0), quality.Rule("cheap_all", n < 99), quality.Rule("again_all", n < 99)]
    costs = {"dear_half": 3.0, "cheap_half": 1.0, "cheap_none": 1.0, "cheap_all": 1.0, "again_all": 1.0}
    # two runs of the bare scan, then two of each rule
    steps, now = [0.5, 0.5] + [0.5 + costs[r.name] for r in rules for _ in range(2)], [0.0]
    ticks = iter([x for s in steps for x in (0.0, s)])

    def clock():
        now[0] += next(ticks)
        return now[0]

    monkeypatch.setattr(quality.time, "perf_counter", clock)
    assert [r.name for r in quality.ordered(df, rules)] == ["again_all", "cheap_all", "cheap_half", "dear_half", "cheap_none"]


def test_counted_rules_are_the_same(docs):
    from pyspark.sql import functions as F

    t = F.col("text")
    counts = {"n_words": quality.word_count(t), "word_chars": quality.word_chars(t), "n_symbols": quality.symbol_count(t), "n_dup_lines": quality.duplicate_lines(t)}
    plain, counted = quality.default_rules(t), quality.default_rules(t, counts)
    assert docs.where(F.exists(F.array(*[~a.reject.eqNullSafe(b.reject) for a, b in zip(plain, counted, strict=True)]), lambda x: x)).count() == 0


def test_sample_reads_some_files(spark, tmp_path):
    """Of many files a few are scanned for the sample; of a join, which has no files of its own, all rows are."""
    path = str(tmp_path / "many files")
    spark.range(0, 900, 1, 90).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.lit("some words here")).alias("text")).write.parquet(path)
    docs = spark.read.parquet(path).where("doc_id >= 0")
    few = quality.some_files(docs)
    assert few.columns == docs.columns
    assert 40 <= few.select(F.input_file_name()).distinct().count() < 90
    assert few.count() == 10 * few.select(F.input_file_name()).distinct().count()
    plan = few._jdf.queryExecution()
    plan.toRdd().count()
    assert 40 <= plan.executedPlan().collectLeaves().head().metrics().apply("numFiles").value() < 90  # files are left out, not rows
    assert quality.some_files(docs, 90).count() == 900
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")
    assert quality.some_files(joined).count() == 900
    assert quality.quality_report(docs).count() == 900
