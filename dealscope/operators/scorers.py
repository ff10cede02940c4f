"""Lead scorers (I6-I10): balancing, linear, boosted, forest and neural models, search over time-ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import running_sums
from ..plans.roles import Book
from .halving import FOLDS, halving, with_parts
from .neighbour_join import neighbours
from .pipelines import labelled, lead_features
from .vectors import cut

book = Book()
_S = "s as (select doc_id as id, quality as y, toxic as x from labels)"


@book.on_tables("I6_undersampled", "with r as (select doc_id as id, quality as y, row_number() over (partition by quality order by md5(doc_id::varchar), doc_id) as r from labels), m as (select min(n) as m from (select count(*) as n from labels group by quality)) select id, y from r, m where r <= m")
def undersampled_labels(spark, sf_dir) -> DataFrame:
    return undersample(spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id", "y")


def undersample(df: DataFrame, key: str, label: str) -> DataFrame:
    """As many rows of each class as the smallest has, by the hash of the key."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_m"))
    r = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("_r", r).crossJoin(F.broadcast(least)).where("_r <= _m").drop("_r", "_m")


@book.on_tables("I6_scale_weights", "select y, case when y = 1 then round(neg * 1.0 / nullif(pos, 0), 6) else 1.0 end as weight from (select distinct quality as y, (select count(*) from labels where quality = 1) as pos, (select count(*) from labels where quality = 0) as neg from labels)")
def scale_weights(spark, sf_dir) -> DataFrame:
    """Negatives over positives for the positive class."""
    c = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("quality").alias("y")).agg(F.count("*").alias("n"))
    t = c.agg(F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("neg"), F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("pos"))
    return c.crossJoin(F.broadcast(t)).select("y", F.when(F.col("y") == 1, F.round(F.col("neg") / F.expr("nullif(pos, 0)"), 6)).otherwise(1.0).alias("weight"))


def oversample(df: DataFrame, key: str, label: str, features: str, k: int = 5) -> DataFrame:
    """(label, features, synthetic): all rows, and as many new points of the smaller class as it lacks, each between a point and one of its neighbours."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # two classes
    small = min(n, key=n.get)
    lacking = max(n.values()) - n[small]
    own = df.where(F.col(label) == small)
    times = -(-lacking // max(n[small], 1))
    near = neighbours(own, k, key, features).select("id", "other", "rank")
    have = near.groupBy("id").agg(F.max("rank").alias("have"))
    drawn = own.select(F.col(key).alias("id"), F.col(features).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(max(times, 1)))).alias("turn")).join(have, "id")
    drawn = drawn.withColumn("rank", (F.pmod(F.xxhash64("id", "turn"), F.col("have")) + 1).cast("int")).withColumn("u", F.pmod(F.xxhash64("id", "turn", F.lit(1)), F.lit(10_000)) / 10_000)
    pairs = drawn.join(near, ["id", "rank"]).join(own.select(F.col(key).alias("other"), F.col(features).alias("b")), "other")
    # every point in the whole turns, and of one more turn those with the least hashes
    full, rest = divmod(lacking, max(n[small], 1))
    drawn_last = running_sums(own.select(F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("id")).alias("o"), F.lit(1).alias("one")), "o", {"upto": "one"}).where(F.col("upto") <= rest).select("o.id")
    pairs = pairs.where(F.col("turn") <= full).union(pairs.where(F.col("turn") == full + 1).join(drawn_last, "id", "left_semi").select(*pairs.columns))
    new = pairs.select(F.lit(small).alias(label), F.zip_with(F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.transform("a", lambda _: F.col("u")), lambda p, u: p["x"] + u * (p["y"] - p["x"])).alias(features), F.lit(True).alias("synthetic"))
    return df.select(label, features, F.lit(False).alias("synthetic")).union(new)


@book.on_tables("I6_oversampled")
def oversampled(spark, sf_dir) -> DataFrame:
    """Classes of the embeddings (label 0 against the rest) brought to parity."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    return oversample(e, "vec_id", "y", "x").groupBy("y", "synthetic").agg(F.count("*").alias("n"))


NUMERIC, LEVELS = ["revenue", "budget", "cost", "duration", "month", "year"], ["entity", "category", "opp_type"]


def vectors(df: DataFrame) -> DataFrame:
    """(code, split, is_won, weight, v): features of the leads as vectors, levels one-hot, balanced weights from the train split."""
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler

    f = cut(lead_features(labelled(df))).withColumns({c: F.col(c).cast("double") + 1 for c in LEVELS})
    train = f.where("split = 'train'")
    f = OneHotEncoder(inputCols=LEVELS, outputCols=[f"{c}_v" for c in LEVELS], handleInvalid="keep").fit(train).transform(f)
    f = VectorAssembler(inputCols=[*NUMERIC, *(f"{c}_v" for c in LEVELS)], outputCol="raw").transform(f)
    f = StandardScaler(inputCol="raw", outputCol="v").fit(f.where("split = 'train'")).transform(f)
    share = train.agg(F.avg("is_won").alias("_won"))
    weight = F.when(F.col("is_won") == 1, 0.5 / F.greatest(F.col("_won"), F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("_won"), F.lit(1e-9)))
    return cut(f.crossJoin(F.broadcast(share)).select("code", "split", "year", "month", F.col("is_won").cast("double").alias("is_won"), weight.alias("weight"), "v"))


def _models() -> dict:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    own = {"featuresCol": "v", "labelCol": "is_won", "weightCol": "weight"}
    return {
        "I7_logistic": LogisticRegression(maxIter=50, regParam=0.01, **own),
        "I8_boosted": GBTClassifier(maxIter=20, maxDepth=4, seed=7, **own),
        "I8_forest": RandomForestClassifier(numTrees=40, maxDepth=8, seed=7, **own),
    }


def _scores(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("code", F.col("is_won").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def scored(df: DataFrame, name: str) -> DataFrame:
    """(code, y, p) of the test split by a model fitted on the train split."""
    v = vectors(df)
    return _scores(_models()[name].fit(v.where("split = 'train'")), v.where("split = 'test'"))


for _n in ("I7_logistic", "I8_boosted", "I8_forest"):
    book.on_view(_n)(lambda df, n=_n: scored(df, n).select("code", "y", F.round("p", 6).alias("p")))


@book.on_view("I9_neural")
def neural(df: DataFrame, layers=(256, 128), iterations: int = 40) -> DataFrame:
    """A perceptron with two hidden layers."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    v = vectors(df)
    train = v.where("split = 'train'")
    first = train.select("v").first()
    if first is None:
        raise ValueError("no train rows")
    net = MultilayerPerceptronClassifier(featuresCol="v", labelCol="is_won", layers=[len(first["v"]), *layers, 2], maxIter=iterations, seed=7)
    return _scores(net.fit(train), v.where("split = 'test'")).select("code", "y", F.round("p", 6).alias("p"))


CANDIDATES = [
    *(("logistic", {"penalty": p}) for p in (0.001, 0.01, 0.1, 1.0)),
    ("boosted", {"maxDepth": 3, "maxIter": 10}), ("boosted", {"maxDepth": 5, "maxIter": 10}),
    ("forest", {"maxDepth": 5, "numTrees": 20}), ("forest", {"maxDepth": 8, "numTrees": 20}),
]


def _trees(model: str, parameters: dict):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    return {"boosted": GBTClassifier, "forest": RandomForestClassifier}[model](featuresCol="v", labelCol="y", weightCol="weight", seed=7, **parameters)


def searchable(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(v, x, y, weight, part) of the train split, parts in the order of closing months."""
    from pyspark.ml.functions import vector_to_array

    v = with_parts(vectors(df).where("split = 'train'"), F.col("year") * 12 + F.col("month"), folds)
    return cut(v.select("v", vector_to_array("v").alias("x"), F.col("is_won").alias("y"), "weight", "part"))


@book.on_view("I10_search")
def search(df: DataFrame, candidates=tuple(CANDIDATES), folds: int = FOLDS) -> DataFrame:
    """Mean AUC over expanding folds of models and parameters by successive halving, and which is best among those that saw all folds."""
    v = searchable(df, folds)
    schema = "model string, parameters string, rung int, folds int, auc double, best boolean"
    if v.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], schema)
    rows = halving(v, list(candidates), _trees, folds)
    last = max(r[2] for r in rows)
    best = max((r[4] for r in rows if r[2] == last and r[4] is not None), default=None)
    told = [(m, ",".join(f"{k}={x}" for k, x in sorted(p.items())), rung, n, None if a is None else round(a, 6), rung == last and a is not None and a == best) for m, p, rung, n, a in rows]
    return df.sparkSession.createDataFrame(told, schema)
