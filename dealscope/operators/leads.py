"""Lead scoring (I): features, balancing, exact metrics, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import days, running_sums
from ..plans.roles import Book, read

book = Book()
_S = "s as (select doc_id as id, quality as y, ((doc_id * 37) % 101) / 100.0::double as p from labels)"


def scores(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100).alias("p"))


@book.on_view("I1_internal_features", "select code, coalesce(month(closing_at), 0)::int as month, coalesce(year(closing_at), 0)::int as year, coalesce(floor((epoch_us(real_end_at) - epoch_us(start_at)) / 86400000000), 0)::bigint as duration, len(list_filter(regexp_split_to_array(opp_type || ' > ' || status || ';' || category, '[>|;/]'), lambda t: trim(t) <> '')) - 1 as changes from opp")
def internal_features(df: DataFrame) -> DataFrame:
    history = F.concat("opp_type", F.lit(" > "), "status", F.lit(";"), "category")
    return df.select("code", F.coalesce(F.month("closing_at"), F.lit(0)).alias("month"), F.coalesce(F.year("closing_at"), F.lit(0)).alias("year"), F.coalesce(days("real_end_at", "start_at"), F.lit(0)).cast("long").alias("duration"), (F.size(F.filter(F.split(history, "[>|;/]"), lambda t: F.trim(t) != "")) - 1).cast("long").alias("changes"))


@book.on_tables("I2_enrichment", "select c_custkey, coalesce(n_name, 'inconnu') as sector, coalesce(r_name, 'nc') as region from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def enrichment(spark, sf_dir) -> DataFrame:
    """Lookup tables joined on the key; Spark broadcasts them where their size allows."""
    return enriched(read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"))


def enriched(customers: DataFrame, nations: DataFrame, regions: DataFrame) -> DataFrame:
    """Sector and region of every customer; keys without an entry get ``inconnu`` and ``nc``."""
    out = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("inconnu")).alias("sector"), F.coalesce("r_name", F.lit("nc")).alias("region"))


@book.on_tables("I6_class_weights", f"with {_S} select y, count(*) as n, round((select count(*) from s) / (2.0 * count(*)), 6) as balanced from s group by 1")
def class_weights(spark, sf_dir) -> DataFrame:
    c = scores(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("y", "n", F.round(F.col("t") / (2 * F.col("n")), 6).alias("balanced"))


@book.on_tables("I11_ensemble", f"with {_S} select id, round((p + (1 - p) * 0.5) / 2, 6) as p from s")
def ensemble(spark, sf_dir) -> DataFrame:
    s = scores(spark, sf_dir)
    return s.join(s.select("id", ((1 - F.col("p")) * 0.5).alias("q")), "id").select("id", F.round((F.col("p") + F.col("q")) / 2, 6).alias("p"))


_C = "count(*) filter (y = {y} and {op})"


@book.on_tables("I12_metrics", f"""with {_S}, r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk from s),
  m as (select count(*) as n, {_C.format(y=0, op='p <= 0.5')} as tn, {_C.format(y=0, op='p > 0.5')} as fp, {_C.format(y=1, op='p <= 0.5')} as fn, {_C.format(y=1, op='p > 0.5')} as tp, avg((p - y) ** 2) as brier,
    (sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc, -avg(ln(least(greatest(case when y = 1 then p else 1 - p end, 1e-15), 1 - 1e-15))) as log_loss from r)
  select tn, fp, fn, tp, round(brier, 6) as brier, round(auc, 6) as auc, round(log_loss, 6) as log_loss, round(tp * 1.0 / (tp + fp), 6) as precision, round(tp * 1.0 / (tp + fn), 6) as recall, round(tn * 1.0 / (tn + fp), 6) as lost_recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1 from m""")
def metrics(spark, sf_dir) -> DataFrame:
    """Exact AUC by average ranks: running sums by range over distinct scores."""
    s = scores(spark, sf_dir)
    by = s.groupBy("p").agg(F.sum(F.col("y")).alias("pos"), F.count("*").alias("n"))
    ranked = running_sums(by, "p", {"upto": "n"}).withColumn("rk", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    auc = ranked.agg(F.sum(F.col("rk") * F.col("pos")).alias("r"), F.sum("pos").alias("P"), F.sum("n").alias("N")).select(((F.col("r") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * (F.col("N") - F.col("P")))).alias("auc"))
    n = lambda y, hit, name: F.count(F.when((F.col("y") == y) & hit, 1)).alias(name)
    hit = F.col("p") > 0.5
    q = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    m = s.agg(n(0, ~hit, "tn"), n(0, hit, "fp"), n(1, ~hit, "fn"), n(1, hit, "tp"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), (-F.avg(F.ln(F.least(F.greatest(q, F.lit(1e-15)), F.lit(1 - 1e-15))))).alias("log_loss"))
    c = F.col
    return m.crossJoin(auc).select("tn", "fp", "fn", "tp", *(F.round(x, 6).alias(x) for x in ("brier", "auc", "log_loss")), F.round(c("tp") / (c("tp") + c("fp")), 6).alias("precision"), F.round(c("tp") / (c("tp") + c("fn")), 6).alias("recall"), F.round(c("tn") / (c("tn") + c("fp")), 6).alias("lost_recall"), F.round(2 * c("tp") / (2 * c("tp") + c("fp") + c("fn")), 6).alias("f1"))


@book.on_tables("I13_roc", f"with {_S}, b as (select p, sum(y) as pos, count(*) - sum(y) as neg from s group by 1) select round(p, 4) as threshold, round(sum(pos) over w / (select sum(pos) from b), 6) as tpr, round(sum(neg) over w / (select sum(neg) from b), 6) as fpr from b window w as (order by p desc)")
def roc(spark, sf_dir) -> DataFrame:
    b = scores(spark, sf_dir).groupBy("p").agg(F.sum("y").alias("pos"), (F.count("*") - F.sum("y")).alias("neg"))
    t = b.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running_sums(b, "p", {"a": "pos", "b": "neg"}, ascending=False).crossJoin(F.broadcast(t)).select(F.round("p", 4).alias("threshold"), F.round(F.col("a") / F.col("all_pos"), 6).alias("tpr"), F.round(F.col("b") / F.col("all_neg"), 6).alias("fpr"))


@book.on_tables("I14_calibration", f"with {_S} select least(floor(p * 10), 9)::bigint as bin, round(avg(p), 6) as mean_score, round(avg(y), 6) as observed, count(*) as n from s group by 1")
def calibration(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.round(F.avg("p"), 6).alias("mean_score"), F.round(F.avg("y"), 6).alias("observed"), F.count("*").alias("n"))


@book.on_tables("I15_score_histogram", f"with {_S}, b as (select min(p) as lo, max(p) as hi from s) select y, least(floor((p - lo) / (hi - lo) * 20), 19)::bigint as bin, count(*) as n from s, b group by 1, 2")
def score_histogram(spark, sf_dir, bins: int = 20) -> DataFrame:
    s = scores(spark, sf_dir)
    b = s.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return s.crossJoin(F.broadcast(b)).groupBy("y", F.least(F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@book.on_tables("I16_confusion", f"with {_S} select y, (p > 0.5)::int as pred, count(*) as n from s group by 1, 2")
def confusion(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).groupBy("y", (F.col("p") > 0.5).cast("int").alias("pred")).agg(F.count("*").alias("n"))


@book.on_tables("I3_geo", "select c_custkey, coalesce(n, 0)::bigint as population, coalesce(r_name, 'nc') as region from customer left join (select s_nationkey, count(*) as n from supplier group by 1) on c_nationkey = s_nationkey left join nation on n_nationkey = s_nationkey left join region on n_regionkey = r_regionkey")
def geo(spark, sf_dir) -> DataFrame:
    """Population (suppliers) and region by place; places without an entry get 0 and ``nc``."""
    places = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    places = places.join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("population"), F.coalesce("r_name", F.lit("nc")).alias("region"))


REPORT = ["auc", "log_loss", "brier", "f1", "mae"]


def report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Metrics in a fixed order; those that ``df`` lacks are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns or REPORT))


@book.on_tables("I18_report", f"with {_S} select cast(null as double) as auc, cast(null as double) as log_loss, round(avg((p - y) ** 2), 6) as brier, cast(null as double) as f1, round(avg(abs(p - y)), 6) as mae from s")
def fixed_report(spark, sf_dir) -> DataFrame:
    gap = F.col("p") - F.col("y")
    return report(scores(spark, sf_dir).agg(F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.avg(gap**2), 6).alias("brier")))


@book.on_tables("I12_balanced", f"with {_S}, m as (select {_C.format(y=0, op='p <= 0.5')} as tn, {_C.format(y=0, op='p > 0.5')} as fp, {_C.format(y=1, op='p <= 0.5')} as fn, {_C.format(y=1, op='p > 0.5')} as tp from s) select round((tp * 1.0 / nullif(tp + fn, 0) + tn * 1.0 / nullif(tn + fp, 0)) / 2, 6) as balanced_accuracy, round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6) as accuracy from m")
def balanced(spark, sf_dir) -> DataFrame:
    """Mean of the recalls of both classes, and plain accuracy."""
    hit, y = F.col("p") > 0.5, F.col("y")
    n = lambda c: F.count(F.when(c, 1))
    tp, tn = n((y == 1) & hit), n((y == 0) & ~hit)
    return scores(spark, sf_dir).agg(F.round((F.try_divide(tp, n(y == 1)) + F.try_divide(tn, n(y == 0))) / 2, 6).alias("balanced_accuracy"), F.round((tp + tn) / F.count("*"), 6).alias("accuracy"))
