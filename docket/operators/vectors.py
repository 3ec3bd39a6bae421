"""Vector metrics and cluster studies.

Searches of a stated query set and ranks among all rows are in
``vector_index``.  NT-Xent works within a contrastive batch, which is bounded
by its definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docket.functions import arrays as A
from docket.operators.vector_index import nearest
from docket.sources.files import stored


def centroids(vecs: DataFrame, cluster_col: str, vec_col: str, dim: int) -> DataFrame:
    """Mean vector per cluster (element-wise average)."""
    e = vecs.select(cluster_col, F.posexplode(vec_col).alias("i", "x"))
    per = e.groupBy(cluster_col, "i").agg(F.avg("x").alias("m"))
    return per.groupBy(cluster_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def medians(rows: DataFrame, group_col: str, value_col: str, bins: int = 1024, held: int = 4096) -> DataFrame:
    """(group, median): exact medians (interpolated on even sizes) without a sort of the rows.

    A histogram over a group's range tells the bin of the middle; the bin's own range is cut again until it has
    at most ``held`` rows or one value, so a group of any size is counted, never gathered."""
    v = F.col("__value")
    rows = rows.select(F.col(group_col).alias("__group"), F.col(value_col).cast("double").alias("__value")).filter(v.isNotNull())
    state = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).select(
        "*", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def inside(groups: DataFrame) -> DataFrame:
        g = groups.withColumnRenamed("__group", "__g")
        return rows.join(g, F.col("__group").eqNullSafe(F.col("__g"))).filter(v.between(F.col("lo"), F.col("hi"))).drop("__g")

    while True:
        state = stored(state, "medians")
        large = state.filter((F.col("size") > held) & (F.col("lo") < F.col("hi")))
        if large.isEmpty():
            break
        cell = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
        counts = inside(large).groupBy("__group", "n", "below", cell.alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min(v).alias("least"), F.max(v).alias("most"))
        before = Window.partitionBy("__group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a group's bins
        counts = counts.withColumn("start", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        middle = counts.filter((F.col("start") <= second) & (F.col("start") + F.col("c") > first))
        # two bins: the middle lies between the last value of one and the first of the other
        between = (F.min("most") + F.max("least")) / 2
        two = F.count(F.lit(1)) > 1
        cut = middle.groupBy("__group", "n").agg(
            F.when(two, between).otherwise(F.min("least")).alias("lo"), F.when(two, between).otherwise(F.max("most")).alias("hi"),
            F.min("start").alias("below"), F.sum("c").alias("size"))
        done = state.filter(~((F.col("size") > held) & (F.col("lo") < F.col("hi"))))
        state = done.unionByName(cut.select(*state.columns))
    exact = state.filter("lo = hi").select("__group", F.col("lo").alias("median"))
    some = inside(state.filter("lo < hi")).groupBy("__group", "n", "below").agg(F.array_sort(F.collect_list(v)).alias("values"))
    at = lambda k: F.element_at("values", (k - F.col("below") + 1).cast("int"))
    return exact.unionByName(some.select("__group", ((at(first) + at(second)) / 2).alias("median"))).withColumnRenamed("__group", group_col)


def cluster_cohesion(vecs: DataFrame, cluster_col: str, vec_col: str, dim: int) -> DataFrame:
    """Per cluster: size and mean / median / max cosine distance of members
    to the cluster centroid (median interpolates on even sizes).  Medians
    come from refined histograms, so a hot cluster is in no one task's
    memory and nothing is sorted."""
    c = centroids(vecs, cluster_col, vec_col, dim)
    dist = 1.0 - A.cosine(F.col(vec_col), F.col("centroid"))
    d = stored(vecs.join(c, cluster_col).select(F.col(cluster_col), dist.alias("d")), "centroid-distances")
    stats = d.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("d"), 6).alias("mean_cos_dist"),
                                       F.round(F.max("d"), 6).alias("max_cos_dist"))
    return stats.join(medians(d, cluster_col, "d"), cluster_col).select(
        cluster_col, "size", "mean_cos_dist", F.round("median", 6).alias("median_cos_dist"), "max_cos_dist")


def centroid_similarity(vecs: DataFrame, cluster_col: str, vec_col: str, dim: int, k: int = 5) -> DataFrame:
    """For every cluster the ``k`` clusters (itself included) with the most
    similar centroids, by cosine: an indexed search over the centroids."""
    c = centroids(vecs, cluster_col, vec_col, dim).select(F.col(cluster_col).alias("id"), A.l2_normalize(F.col("centroid")).alias("v"))
    best = nearest(c, c, "id", "v", k=k, with_itself=True)
    return best.select(F.col("qid").alias("cluster_a"), F.col("cid").alias("cluster_b"), F.round("sim", 6).alias("cos"))


def batch_arrays(pairs: DataFrame, batch_col: str, id_col: str, teacher_col: str) -> DataFrame:
    return pairs.groupBy(batch_col).agg(
        F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(teacher_col).alias("v"))).alias("members"))


def nt_xent(pairs: DataFrame, batch_col: str, id_col: str, student_col: str, teacher_col: str,
            temperature: float = 0.5, rho: float = 0.0) -> DataFrame:
    """Per-batch NT-Xent (unrounded): own pair over the in-batch negatives
    (diagonal masked); with ``rho`` > 0 negatives are scaled by 1−ρ and
    clamped."""
    members = batch_arrays(pairs, batch_col, id_col, teacher_col)
    j = pairs.join(members, batch_col)
    tau = F.lit(float(temperature))
    pos = A.dot(F.col(student_col), F.col(teacher_col)) / tau
    negs = F.filter("members", lambda m: m["id"] != F.col(id_col))
    neg_sum = F.aggregate(negs, F.lit(0.0).cast("double"),
                          lambda acc, m: acc + F.exp(A.dot(F.col(student_col), m["v"]) / tau))
    if rho > 0:
        denom = F.exp(pos) + F.greatest((1 - rho) * neg_sum, F.lit(1e-12))
    else:
        denom = F.exp(pos) + neg_sum
    loss = -(pos - F.log(denom))
    return j.groupBy(batch_col).agg(F.avg(loss).alias("nt_xent"), F.count(F.lit(1)).alias("n"))


def cosine_pair_loss(pairs: DataFrame, batch_col: str, student_col: str, teacher_col: str) -> DataFrame:
    """Per batch: 1 − mean cosine of (student, teacher)."""
    cos = A.cosine(F.col(student_col), F.col(teacher_col))
    return pairs.groupBy(batch_col).agg((1.0 - F.avg(cos)).alias("cos_loss"))


def contrastive_loss(pairs: DataFrame, batch_col: str, id_col: str, student_col: str, teacher_col: str,
                     temperature: float = 0.5, alpha: float = 0.5, rho: float = 0.0) -> DataFrame:
    """α·NT-Xent + (1−α)·cosine pair loss per batch."""
    nt = nt_xent(pairs, batch_col, id_col, student_col, teacher_col, temperature, rho)
    cl = cosine_pair_loss(pairs, batch_col, student_col, teacher_col)
    return nt.join(cl, batch_col).select(
        batch_col, F.round(alpha * F.col("nt_xent") + (1 - alpha) * F.col("cos_loss"), 6).alias("loss"))
