"""Mixture model of cell types over sparse counts (cell, gene_id, n); models are long tables (celltype, gene_id, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.sources.scratch import stored


def _attached(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """totals holds one row a model."""
    return df.join(F.broadcast(totals), keys) if keys else df.crossJoin(F.broadcast(totals))


def log_joint(counts: DataFrame, profiles: DataFrame, priors: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows (*keys, cell, celltype, joint): log prior + sum of n * log p. profiles has types x genes rows, priors one a type.
    keys name the columns of profiles and priors that tell several models apart; all of them meet the counts in one pass."""
    lp = F.broadcast(profiles.select(*keys, "gene_id", "celltype", F.log("prob").alias("lp")))
    summed = counts.join(lp, "gene_id").groupBy(*keys, "cell", "celltype").agg(F.sum(F.col("n") * F.col("lp")).alias("s"))
    return summed.join(F.broadcast(priors), [*keys, "celltype"]).select(*keys, "cell", "celltype", (F.col("s") + F.log("prior")).alias("joint"))


def posterior(counts: DataFrame, profiles: DataFrame, priors: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rows (*keys, cell, celltype, p)."""
    w = W.partitionBy(*keys, "cell")
    top = log_joint(counts, profiles, priors, keys).withColumn("e", F.exp(F.col("joint") - F.max("joint").over(w)))
    return top.select(*keys, "cell", "celltype", (F.col("e") / F.sum("e").over(w)).alias("p"))


def mstep(counts: DataFrame, post: DataFrame, genes: DataFrame, keys: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(profiles, priors) with one added to every count."""
    types = post.groupBy(*keys, "celltype").agg(F.sum("p").alias("cells"))
    grid = types.select(*keys, "celltype").crossJoin(F.broadcast(genes.select("gene_id")))
    seen = counts.join(post, "cell").groupBy(*keys, "celltype", "gene_id").agg(F.sum(F.col("p") * F.col("n")).alias("v"))
    raw = grid.join(seen, [*keys, "celltype", "gene_id"], "left").select(*keys, "celltype", "gene_id", (F.coalesce("v", F.lit(0.0)) + 1).alias("v"))
    profiles = raw.select(*keys, "celltype", "gene_id", (F.col("v") / F.sum("v").over(W.partitionBy(*keys, "celltype"))).alias("prob"))
    whole = types.groupBy(*keys).agg(F.sum("cells").alias("all"), F.count("*").alias("k"))
    priors = _attached(types, whole, keys).select(*keys, "celltype", ((F.col("cells") + 1) / (F.col("all") + F.col("k"))).alias("prior"))
    return profiles, priors


def initial(spark: SparkSession, genes: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Dirichlet(1) profiles: normalised exponential draws; equal priors."""
    draws = spark.range(k).select(F.col("id").cast("int").alias("celltype")).crossJoin(F.broadcast(genes.select("gene_id")))
    e = -F.log((F.pmod(F.xxhash64("celltype", "gene_id", F.lit(seed)), F.lit(1_000_003)) + 1) / F.lit(1_000_004.0))
    raw = draws.withColumn("e", e)
    profiles = raw.select("celltype", "gene_id", (F.col("e") / F.sum("e").over(W.partitionBy("celltype"))).alias("prob"))
    return profiles, spark.range(k).select(F.col("id").cast("int").alias("celltype"), F.lit(1.0 / k).alias("prior"))


def fit(counts: DataFrame, genes: DataFrame, profiles: DataFrame, priors: DataFrame, steps: int = 100, tolerance: float = 1e-4, keys: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """Expectation-maximisation from a start; the models (types x genes rows each) are written each step, which cuts lineage.

    With keys every model named by them takes its step in the same jobs. A model whose profiles move by no more than the
    tolerance (relative norm) keeps them and takes no further steps; only one number a model reaches the driver."""
    counts = stored(counts)
    ended = []
    for _ in range(steps):
        post = stored(posterior(counts, profiles, priors, keys))
        after, shares = (stored(m) for m in mstep(counts, post, genes, keys))
        still = F.lit(True)
        if tolerance:
            d = after.withColumnRenamed("prob", "q").join(profiles, [*keys, "celltype", "gene_id"])
            moved = d.groupBy(*keys).agg((F.sqrt(F.sum((F.col("q") - F.col("prob")) * (F.col("q") - F.col("prob")))) / F.sqrt(F.sum(F.col("prob") * F.col("prob")))).alias("moved"))
            rows = moved.collect()
            for r in rows:
                if r["moved"] is not None and r["moved"] <= tolerance:
                    same = F.lit(True)
                    for c in keys:
                        same = same & (F.col(c) == r[c])
                    ended.append((after.where(same), shares.where(same)))
                    still = still & ~same
            open_ = [r for r in rows if r["moved"] is None or r["moved"] > tolerance]
        profiles, priors = after.where(still), shares.where(still)
        if tolerance and not open_:
            break
    for p, q in ended:
        profiles, priors = profiles.unionByName(p), priors.unionByName(q)
    return profiles, priors


def model_scores(counts: DataFrame, profiles: DataFrame, priors: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row a model (*keys, loglik, aic, bic) with K(G-1)+K-1 degrees of freedom."""
    joint = log_joint(counts, profiles, priors, keys)
    per = joint.groupBy(*keys, "cell").agg(F.max("joint").alias("m"), F.collect_list("joint").alias("j"))  # one entry a type
    ll = per.select(*keys, (F.col("m") + F.log(F.aggregate(F.transform("j", lambda v: F.exp(v - F.col("m"))), F.lit(0.0), lambda a, v: a + v))).alias("ll"))
    size = profiles.groupBy(*keys).agg(F.count_distinct("celltype").alias("k"), F.count_distinct("gene_id").alias("g"))
    dof = F.col("k") * (F.col("g") - 1) + F.col("k") - 1
    found = _attached(ll.groupBy(*keys).agg(F.sum("ll").alias("loglik"), F.count("*").alias("n")), size, keys)
    return found.select(*keys, "loglik", (2 * dof - 2 * F.col("loglik")).alias("aic"), (dof * F.log("n") - 2 * F.col("loglik")).alias("bic"))


def hard_types(post: DataFrame) -> DataFrame:
    """Rows (cell, celltype, p) of the likeliest type, the least on ties."""
    best = F.row_number().over(W.partitionBy("cell").orderBy(F.desc(F.round("p", 9)), "celltype"))
    return post.withColumn("_r", best).where("_r = 1").drop("_r")


def relative_expression(counts: DataFrame, types: DataFrame, genes: DataFrame, floor: float = 0.01) -> DataFrame:
    """Mean count of a gene in a type's cells by its mean outside, the latter at least `floor`."""
    sizes = types.groupBy("celltype").agg(F.count("*").alias("cells"))
    whole = sizes.agg(F.sum("cells").alias("all"))
    seen = counts.join(types.select("cell", "celltype"), "cell").groupBy("celltype", "gene_id").agg(F.sum("n").alias("v"))
    total = seen.groupBy("gene_id").agg(F.sum("v").alias("total"))
    every = sizes.crossJoin(F.broadcast(genes.select("gene_id"))).crossJoin(F.broadcast(whole))
    met = every.join(seen, ["celltype", "gene_id"], "left").join(total, "gene_id", "left")
    v, t = F.coalesce("v", F.lit(0)), F.coalesce("total", F.lit(0))
    out = F.when(F.col("all") > F.col("cells"), (t - v) / (F.col("all") - F.col("cells"))).otherwise(F.lit(0.0))
    return met.select("celltype", "gene_id", (v / F.col("cells") / F.greatest(out, F.lit(floor))).alias("relative_expression"))


def top_markers(relative: DataFrame, n: int = 10) -> DataFrame:
    order = F.row_number().over(W.partitionBy("celltype").orderBy(F.desc(F.round("relative_expression", 9)), "gene_id"))
    return relative.withColumn("rank", order).where(F.col("rank") <= n)


def with_noise(profiles: DataFrame, priors: DataFrame, totals: DataFrame, genes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Adds type 0, of equal gene shares; its prior is the share of cells with fewer than `least` transcripts. Types move up by one."""
    g = genes.count()
    share = totals.agg(F.avg((F.col("total") < least).cast("double")).alias("share"))
    flat = genes.select(F.lit(0).alias("celltype"), "gene_id", F.lit(1.0 / g).alias("prob"))
    moved = profiles.select((F.col("celltype") + 1).cast("int").alias("celltype"), "gene_id", "prob")
    rest = priors.crossJoin(F.broadcast(share)).select((F.col("celltype") + 1).cast("int").alias("celltype"), (F.col("prior") * (1 - F.col("share"))).alias("prior"))
    return flat.unionByName(moved), share.select(F.lit(0).alias("celltype"), F.col("share").alias("prior")).unionByName(rest)


def confidence_trace(increments: DataFrame, profiles: DataFrame, priors: DataFrame, steps: int) -> DataFrame:
    """Rows (segment_id, step, gain): norm of the mean of a segment's type posteriors at step 0 and at a step, less the norm at step 0.

    increments: segment_id, step, gene_id, n, the transcripts that a step adds; step 0 holds those of the start. A window sums
    log likelihoods over steps, so no step counts its transcripts anew. There are types x steps rows a segment. The increments, which are read
    twice, are written first."""
    increments = stored(increments)
    lp = F.broadcast(profiles.select("gene_id", "celltype", F.log("prob").alias("lp")))
    added = increments.join(lp, "gene_id").groupBy("segment_id", "step", "celltype").agg(F.sum(F.col("n") * F.col("lp")).alias("s"))
    types = F.broadcast(priors.select("celltype", F.log("prior").alias("log_prior")))
    every = increments.select("segment_id").distinct().crossJoin(types).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    rows = every.join(added, ["segment_id", "step", "celltype"], "left")
    so_far = F.sum(F.coalesce("s", F.lit(0.0))).over(W.partitionBy("segment_id", "celltype").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    joint = rows.withColumn("joint", F.col("log_prior") + so_far)
    w = W.partitionBy("segment_id", "step")
    e = joint.withColumn("e", F.exp(F.col("joint") - F.max("joint").over(w)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w))
    first = F.first("p").over(W.partitionBy("segment_id", "celltype").orderBy("step").rowsBetween(W.unboundedPreceding, 0))
    both = p.withColumn("p0", first)
    mean = (F.col("p") + F.col("p0")) / 2
    return both.groupBy("segment_id", "step").agg((F.sqrt(F.sum(mean * mean)) - F.sqrt(F.sum(F.col("p0") * F.col("p0")))).alias("gain"))


def best_k(scores: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """One row (k, rule): the k that both criteria choose, else the knee of the BIC curve (convex, decreasing), else BIC's least.

    scores: k, aic, bic, one row a k: a handful of rows."""
    order = W.orderBy("k")
    whole = W.partitionBy()
    unit = lambda c: (F.col(c) - F.min(c).over(whole)) / F.nullif(F.max(c).over(whole) - F.min(c).over(whole), F.lit(0.0))
    rows = scores.select(F.col("k").cast("double").alias("kk"), "k", F.col("aic").cast("double").alias("aic"), F.col("bic").cast("double").alias("bic"))
    d = rows.withColumn("x", unit("kk")).withColumn("d", 1 - unit("bic") - F.col("x"))
    step = d.withColumn("gap", F.lit(1.0) / F.nullif(F.count("*").over(whole) - 1, F.lit(0)))
    top = step.withColumn("peak", (F.col("d") > F.lag("d").over(order)) & (F.col("d") >= F.lead("d").over(order)))
    run = top.withColumn("run", F.sum(F.coalesce(F.col("peak"), F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    knees = run.where("run > 0").groupBy("run").agg(F.max_by("k", F.col("peak").cast("int")).alias("k"), (F.max("d") - sensitivity * F.max("gap")).alias("line"), F.min("d").alias("low"))
    knee = knees.where("low < line").agg(F.min("k").alias("knee"))
    least = rows.agg(F.min_by("k", F.struct("aic", "k")).alias("a"), F.min_by("k", F.struct("bic", "k")).alias("b"))
    rule = F.when(F.col("a") == F.col("b"), "both").when(F.col("knee").isNotNull(), "knee").otherwise("bic")
    return least.crossJoin(F.broadcast(knee)).select(F.when(F.col("a") == F.col("b"), F.col("b")).otherwise(F.coalesce("knee", "b")).alias("k"), rule.alias("rule"))
