"""Text router: n-gram features, multinomial naive Bayes or logistic regression, a probability threshold, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.sources.store import stored

THRESHOLD = 0.45
TEST_SHARE = 0.3
MAX_SHARE = 0.55
FEATURES = 1 << 15


def stratified_split(rows: DataFrame, label: str, key: str, test_share: float = TEST_SHARE, seed: int = 42) -> DataFrame:
    """Rows plus is_test: of each label exactly round(share * n) rows, in hash order.

    The share of a label is cut by an exact quantile of the hash, found from counts over hash ranges, so that no label is
    ranked in one task: the range that holds the border is the only one whose rows are numbered.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20))
    dealt = rows.withColumn("_h", h)
    cells = dealt.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("_n"))
    run = cells.withColumn("_upto", F.sum("_n").over(Window.partitionBy(label).orderBy("_h"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(label)))
    want = F.floor(F.col("_all") * F.lit(test_share) + 0.5)
    border = run.select(F.col(label).alias("_l"), F.col("_h").alias("_c"), (want - (F.col("_upto") - F.col("_n"))).alias("_take"))
    joined = dealt.join(border, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_h") == F.col("_c")))
    at = F.row_number().over(Window.partitionBy(label, "_h").orderBy(key))
    return joined.withColumn("is_test", at <= F.col("_take")).select(*rows.columns, "is_test")


def tfidf_logistic(text: str = "folded", label: str = "target", features: int = FEATURES) -> Pipeline:
    """1- and 2-grams, smoothed IDF on unit vectors, L2 logistic regression."""
    tokens = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False), NGram(n=2, inputCol="_w", outputCol="_b"), SQLTransformer(statement="SELECT *, concat(_w, _b) AS _g FROM __THIS__")]
    counted = [HashingTF(inputCol="_g", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")]
    return Pipeline(stages=[*tokens, *counted, LogisticRegression(featuresCol="features", labelCol=label, regParam=0.001, maxIter=100)])


def counts_bayes(text: str = "folded", label: str = "target", features: int = FEATURES) -> Pipeline:
    """1- and 2-gram counts, multinomial naive Bayes with add-one smoothing."""
    tokens = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False), NGram(n=2, inputCol="_w", outputCol="_b"), SQLTransformer(statement="SELECT *, concat(_w, _b) AS _g FROM __THIS__")]
    counted = [HashingTF(inputCol="_g", outputCol="_tf", numFeatures=features), VectorAssembler(inputCols=["_tf"], outputCol="features")]
    return Pipeline(stages=[*tokens, *counted, NaiveBayes(featuresCol="features", labelCol=label, modelType="multinomial", smoothing=1.0)])


def prepared(rows: DataFrame, text: str, target: Column | None = None) -> DataFrame:
    out = rows.withColumn("folded", fold(F.coalesce(F.col(text), F.lit(""))))
    return out if target is None else out.withColumn("target", target.cast("double"))


def route(model: PipelineModel, rows: DataFrame, text: str, threshold: float = THRESHOLD, positive: str = "rag", negative: str = "small_talk") -> DataFrame:
    """rows plus probability (of the positive label) and route: positive from the threshold on."""
    p = F.get(vector_to_array("probability"), F.lit(1))
    scored = model.transform(prepared(rows, text)).select(*rows.columns, p.alias("probability"))
    return scored.withColumn("route", F.when(F.col("probability") >= threshold, positive).otherwise(negative))


def confusion(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row for each true label, one column for each predicted one."""
    grid = rows.groupBy(F.col(truth).alias("truth")).agg(*[F.count_if(F.col(predicted) == x).alias(f"as_{x}") for x in labels])
    every = rows.sparkSession.createDataFrame([(str(x),) for x in labels], "truth string")
    grid = grid.withColumn("truth", F.col("truth").cast("string"))
    return every.join(grid, "truth", "left").fillna(0)


def metrics(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """(label, support, precision, recall, f1, accuracy); the row "macro" has the means over labels. 0 where a share has no rows."""
    t, p = F.col(truth).cast("string"), F.col(predicted).cast("string")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(t == p).alias("right"),
        *[x for i, v in enumerate(labels) for x in (F.count_if(t == str(v)).alias(f"t{i}"), F.count_if(p == str(v)).alias(f"p{i}"), F.count_if((t == str(v)) & (p == str(v))).alias(f"b{i}"))],
    )
    each = F.array(*[F.struct(F.lit(str(v)).alias("label"), F.col(f"t{i}").alias("support"), F.col(f"p{i}").alias("called"), F.col(f"b{i}").alias("hit")) for i, v in enumerate(labels)])
    rows_ = sums.select("n", "right", F.explode(each).alias("x")).select("x.*", F.coalesce(F.try_divide(F.col("right"), F.col("n")), F.lit(0.0)).alias("accuracy"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    scored = rows_.select("label", "support", share("hit", "called").alias("precision"), share("hit", "support").alias("recall"), "accuracy")
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    macro = scored.agg(F.lit("macro").alias("label"), F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in ("precision", "recall", "accuracy", "f1")])
    return scored.unionByName(macro).select("label", "support", "precision", "recall", "f1", "accuracy")


def select_model(a: dict[str, float], b: dict[str, float], test_size: int) -> str:
    """The higher macro F1; within one test row of each other the more even over classes; else the simpler, A.

    Keys: macro_f1 and gap (the difference between the classes' F1).
    """
    if abs(a["macro_f1"] - b["macro_f1"]) > 1 / test_size:
        return "A" if a["macro_f1"] > b["macro_f1"] else "B"
    if a["gap"] != b["gap"]:
        return "A" if a["gap"] < b["gap"] else "B"
    return "A"


EXPERIMENTS = {"A": lambda: counts_bayes(), "B": lambda: tfidf_logistic()}


def class_scores(scored: DataFrame, labels: Sequence[str]) -> dict[str, float]:
    """What select_model compares, from metrics()."""
    rows = {r["label"]: r for r in scored.collect()}  # one row a label
    f1 = [rows[str(x)]["f1"] for x in labels]
    return {"macro_f1": rows["macro"]["f1"], "gap": max(f1) - min(f1), "accuracy": rows["macro"]["accuracy"]}


def train_router(rows: DataFrame, text: str, label: str, key: str, labels: Sequence[int] = (0, 1)) -> tuple[str, PipelineModel, DataFrame, DataFrame]:
    """(name of the selected experiment, its model refitted on the same training rows, metrics of all experiments
    (experiment, label, ...), the split (label, train, test)). rows are labelled ones, checked by dataset_problems before."""
    split = stored(stratified_split(rows, label, key))
    train, test = (prepared(split.where(c), text, F.col(label)) for c in ("NOT is_test", "is_test"))
    found, told = {}, None
    for name, made in EXPERIMENTS.items():
        guess = made().fit(train).transform(test).select(F.col("target").cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
        scored = stored(metrics(guess, "t", "p", labels).withColumn("experiment", F.lit(name)))
        found[name], told = class_scores(scored, labels), scored if told is None else told.unionByName(scored)
    chosen = select_model(found["A"], found["B"], test.count())
    sizes = split.groupBy(F.col(label).alias("label")).agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"))
    return chosen, EXPERIMENTS[chosen]().fit(train), told, sizes


def dataset_problems(rows: DataFrame, text: str, label: str, line: str, labels: Sequence[str], max_share: float = MAX_SHARE) -> DataFrame:
    """(line, problem) in order of lines; line 0 stands for the whole set."""
    t = F.col(text)
    body = rows.select(F.col(line).alias("line"), t.alias("t"), F.col(label).alias("label"), fold(t).alias("key"))
    exact = F.min("line").over(Window.partitionBy("t"))
    alike = F.min("line").over(Window.partitionBy("key"))
    checks = body.withColumn("exact", exact).withColumn("alike", alike)
    found = F.array_compact(
        F.array(
            F.when(F.trim("t") == "", "empty text").when(F.col("t") != F.trim("t"), "leading or trailing white space"),
            F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "invalid label"),
            F.when(F.col("exact") < F.col("line"), F.concat(F.lit("exact duplicate of line "), "exact")).when(F.col("alike") < F.col("line"), F.concat(F.lit("duplicate of line "), "alike", F.lit(" after folding"))),
        )
    )
    lines = checks.select("line", F.explode(found).alias("problem"))
    share = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("s"), F.sum("n").alias("n"))
    whole = share.select(F.lit(0).cast(rows.schema[line].dataType).alias("line"), F.when(F.col("n").isNull(), "empty set").when(F.col("s") > max_share, "classes are not balanced").alias("problem")).where(F.col("problem").isNotNull())
    return whole.unionByName(lines)


def text_statistics(rows: DataFrame, text: str, terms: Sequence[str] = ()) -> DataFrame:
    """Texts, words a text, tokens, distinct tokens and type-token ratio, and texts that mention each term."""
    words = F.regexp_count(F.col(text), F.lit(r"\S+"))
    tokens = F.filter(F.split(fold(F.col(text)), " "), lambda w: w != "")
    body = rows.where(F.col(text).isNotNull()).select(words.alias("n"), tokens.alias("w"))
    flat = body.agg(F.count(F.lit(1)).alias("total"), F.min("n").alias("words_min"), F.max("n").alias("words_max"), F.bround(F.avg("n"), 2).alias("words_mean"), F.sum(F.size("w")).alias("tokens"), *[F.count_if(F.array_contains("w", x)).alias(f"mentions_{x}") for x in terms])
    distinct = body.select(F.explode("w").alias("w")).groupBy("w").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("distinct_tokens"))
    both = flat.withColumn("distinct_tokens", F.lit(distinct.first()[0]))
    return both.withColumn("type_token_ratio", F.bround(F.try_divide(F.col("distinct_tokens"), F.col("tokens")), 3))


def save(model: PipelineModel, path: str) -> None:
    """S14"""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """S14"""
    return PipelineModel.load(path)
