"""Rank tests, distribution distances and resampling. Everything works on distinct values with counts per group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echogrid.functions import scalars as fx
from echogrid.operators import ordered as o
from echogrid.operators import series as s
from echogrid.session import materialize

MIN_N = 3


# --- tails (asymptotic; effect sizes are the contract) ---------------------------------------------------

@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    import math

    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail by the regularised incomplete gamma function (series below, continued fraction above)."""
    import math

    def tail(v: float, k: float) -> float | None:
        if pd.isna(v) or pd.isna(k) or k <= 0:
            return None
        a, h = k / 2, max(v, 0.0) / 2
        if h == 0:
            return 1.0
        front = math.exp(-h + a * math.log(h) - math.lgamma(a))
        if h < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= h / n
                total += term
            return 1 - front * total
        b, c = h + 1 - a, 1e300
        d = 1 / b
        out = d
        for i in range(1, 1000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * out

    return pd.Series([tail(v, k) for v, k in zip(x, dof)], dtype="float64")


def ks_tail(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Kolmogorov series, native."""
    lam2 = d * d * n_a * n_b / (n_a + n_b)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


# --- pairwise distances ----------------------------------------------------------------------------------

def pair_statistics(df: DataFrame, strata: Sequence[str], group: str, value: str, groups: Sequence) -> DataFrame:
    """U, Cliff's delta, KS D and Wasserstein distance for every pair of the listed groups, per stratum.

    One ordered pass over distinct values carries a count per group; each pair is a sum or maximum over that table,
    so no pair of rows is ever formed.
    """
    strata = list(strata) or ["__all"]
    if strata == ["__all"]:
        df = df.withColumn("__all", F.lit(0))
    counts = {f"g{k}": (F.col(group) == F.lit(g)).cast("int") for k, g in enumerate(groups)}
    known = df.filter(F.col(group).isin(list(groups))).select(*strata, group, F.col(value).cast("double").alias("v"))
    table = o.ecdf(known, strata, "v", counts, with_next=True)
    pair = [F.struct(
        F.lit(groups[a]).alias("group_a"), F.lit(groups[b]).alias("group_b"),
        *[F.col(f"g{k}{suffix}").alias(f"{name}{side}") for k, side in ((a, "_a"), (b, "_b")) for suffix, name in (("", "n"), ("_below", "below"), ("_total", "total"))])
        for a, b in combinations(range(len(groups)), 2)]
    rows = table.select(*strata, "v", "next", "n", F.explode(F.array(*pair)).alias("p")).select(*strata, "v", "next", "p.*")
    gap = F.abs((F.col("below_a") + F.col("n_a")) / F.nullif(F.col("total_a"), F.lit(0)) - (F.col("below_b") + F.col("n_b")) / F.nullif(F.col("total_b"), F.lit(0)))
    tie = F.col("n_a") + F.col("n_b")
    agg = rows.groupBy(*strata, "group_a", "group_b").agg(
        F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"), F.sum(F.col("n_a") * (F.col("below_b") + F.col("n_b") / 2)).alias("u"),
        F.max(gap).alias("ks_d"), F.sum(gap * (F.col("next") - F.col("v"))).alias("w"), F.sum(F.pow(tie.cast("double"), 3) - tie).alias("ties"))
    ok = (F.col("n_a") >= MIN_N) & (F.col("n_b") >= MIN_N)
    spread = known.filter("v IS NOT NULL AND NOT isnan(v)").groupBy(*strata, group).agg(F.var_samp("v").alias("var"))
    side = lambda name, letter: spread.select(*strata, F.col(group).alias(f"group_{letter}"), F.col("var").alias(name))
    joined = agg.join(side("var_a", "a"), [*strata, "group_a"], "left").join(side("var_b", "b"), [*strata, "group_b"], "left")
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / F.greatest(na + nb - 2, F.lit(1)))
    total = na + nb
    sd_u = F.sqrt(na * nb / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    out = joined.withColumns({c: F.when(ok, F.col(c)) for c in ("u", "ks_d", "w")})
    out = out.withColumn("delta", 2 * F.col("u") / (na * nb) - 1)
    return out.withColumns({
        "magnitude": fx.cliff_magnitude(F.col("delta")), "w_std": F.when(pooled > 1e-12, F.col("w") / pooled),
        "u_z": F.when(sd_u > 0, (F.abs(F.col("u") - na * nb / 2) - 0.5) / sd_u)}).drop("ties", "var_a", "var_b", "__all")


def with_p_values(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"mw_p": normal_two_sided(F.greatest(F.col("u_z"), F.lit(0.0))), "ks_p": ks_tail(F.col("ks_d"), F.col("n_a"), F.col("n_b"))})


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return df.select(*keys, cells.alias("c")).select(*keys, "c.metric", "c.value")


def pairwise_divergence(df: DataFrame, metrics: Sequence[str], group: str, groups: Sequence) -> DataFrame:
    """metric x pair table with medians, effect sizes, KS p and its FDR column."""
    long = materialize(unpivot_metrics(df, [group], metrics))
    pairs = pair_statistics(long, ["metric"], group, "value", groups)
    med = o.percentiles(long, ["metric", group], "value", {"median": 0.5})
    side = lambda letter: med.select("metric", F.col(group).alias(f"group_{letter}"), F.col("median").alias(f"median_{letter}"))
    t = pairs.join(side("a"), ["metric", "group_a"], "left").join(side("b"), ["metric", "group_b"], "left")
    t = materialize(t.withColumn("ks_p", ks_tail(F.col("ks_d"), F.col("n_a"), F.col("n_b"))).withColumn("pair_id", F.concat_ws("|", "metric", F.col("group_a").cast("string"), F.col("group_b").cast("string"))))
    return s.bh_fdr(t, [], "ks_p", "pair_id", "ks_q").drop("pair_id")


def gap_comparison(df: DataFrame, metrics: Sequence[str], env: str, envs: Sequence, klass: str, classes: Sequence) -> DataFrame:
    """Largest |delta| between environments (overall and inside each class) against the class gap."""
    long = materialize(unpivot_metrics(df, [env, klass], metrics))
    top = lambda t, name, by=(): t.groupBy("metric", *by).agg(F.max(F.abs("delta")).alias(name))
    env_gap = top(pair_statistics(long, ["metric"], env, "value", envs), "env_gap")
    class_gap = top(pair_statistics(long, ["metric"], klass, "value", classes), "class_gap")
    within = top(pair_statistics(long, ["metric", klass], env, "value", envs), "g", [klass])
    inner = within.groupBy("metric").agg(*[F.max(F.when(F.col(klass) == F.lit(c), F.col("g"))).alias(f"env_gap_within_{k}") for k, c in enumerate(classes)])
    out = env_gap.join(class_gap, "metric").join(inner, "metric")
    return out.withColumns({"ratio": F.col("env_gap") / F.nullif(F.col("class_gap"), F.lit(0.0)), "env_exceeds_class": F.col("env_gap") > F.col("class_gap")})


# --- rank tests ------------------------------------------------------------------------------------------

def kruskal(df: DataFrame, strata: Sequence[str], group: str, value: str, groups: Sequence) -> DataFrame:
    """Kruskal-Wallis H with tie correction and clipped epsilon squared; groups under three values or not listed are left out."""
    strata = list(strata) or ["__all"]
    if strata == ["__all"]:
        df = df.withColumn("__all", F.lit(0))
    known = F.col(group).isin(list(groups)) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.filter(known).select(*strata, group, F.col(value).cast("double").alias("v"))
    big = rows.groupBy(*strata, group).agg(F.count("*").alias("k")).filter(F.col("k") >= MIN_N).drop("k")
    counts = {f"g{k}": (F.col(group) == F.lit(g)).cast("int") for k, g in enumerate(groups)}
    t = o.ecdf(rows.join(big, [*strata, group]), strata, "v", counts)
    rank = F.col("below") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = t.groupBy(*strata).agg(
        F.max("total").alias("n_rows"), F.sum(n * n * n - n).alias("ties"),
        *[F.sum(F.col(f"g{k}") * rank).alias(f"r{k}") for k in range(len(groups))], *[F.max(f"g{k}_total").alias(f"c{k}") for k in range(len(groups))])
    big_n = F.col("n_rows").cast("double")
    part = sum((F.coalesce(F.col(f"r{k}") * F.col(f"r{k}") / F.nullif(F.col(f"c{k}"), F.lit(0)), F.lit(0.0)) for k in range(len(groups))), F.lit(0.0))
    used = sum(((F.col(f"c{k}") > 0).cast("int") for k in range(len(groups))), F.lit(0))
    raw = 12.0 / (big_n * (big_n + 1)) * part - 3 * (big_n + 1)
    fix = 1 - F.col("ties") / (big_n * big_n * big_n - big_n)
    out = sums.withColumn("n_groups", used).withColumn("h", F.when((F.col("n_groups") >= 2) & (fix > 0), raw / F.nullif(fix, F.lit(0.0))))
    eps = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("h") - F.col("n_groups") + 1) / F.nullif(F.col("n_rows") - F.col("n_groups"), F.lit(0))))
    return out.select(*[c for c in strata if c != "__all"], "n_rows", "n_groups", "h", F.when(F.col("h").isNotNull(), eps).alias("eps_sq"))


def stratified_test(df: DataFrame, stratum: str, group: str, value: str, groups: Sequence) -> DataFrame:
    k = materialize(kruskal(df, [stratum], group, value, groups).withColumn("p_value", chi2_tail(F.col("h"), (F.col("n_groups") - 1).cast("double"))))
    return s.bh_fdr(k, [], "p_value", stratum, "p_adj")


def friedman(df: DataFrame, session: Sequence[str], mode: str, value: str, modes: Sequence[str]) -> DataFrame:
    """Repeated-measures rank test over sessions that have every mode."""
    per = df.groupBy(*session).pivot(mode, list(modes)).agg(F.avg(value)).dropna(subset=list(modes))
    x = F.array(*[F.col(f"`{m}`") for m in modes])
    k = len(modes)
    ranks = F.transform(x, lambda v: F.aggregate(x, F.lit(0.5), lambda acc, u: acc + F.when(u < v, 1.0).when(u == v, 0.5).otherwise(0.0)))
    same = F.transform(x, lambda v: F.size(F.filter(x, lambda u: u == v)).cast("double"))
    tie = F.aggregate(same, F.lit(0.0), lambda acc, t: acc + t * t - 1)
    r = per.select(ranks.alias("__ranks"), tie.alias("__ties"))
    sums = r.agg(F.count("*").alias("n_sessions"), F.sum("__ties").alias("ties"), *[F.sum(F.get("__ranks", F.lit(i))).alias(f"s{i}") for i in range(k)])
    n = F.col("n_sessions")
    ssq = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)), F.lit(0.0))
    stat = (12.0 / (n * k * (k + 1)) * ssq - 3 * n * (k + 1)) / (1 - F.col("ties") / (n * k * (k * k - 1)))
    return sums.select("n_sessions", F.when(n >= 2, stat).alias("statistic"))


def chisq(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test of two categorical columns: chi2 (Yates on 2x2), dof, Cramer's V."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("o"))
    cells = materialize(cells)
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    size = cells.agg(F.sum("o").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c")).withColumn("one", F.lit(1))
    # cells never observed count too: sum over all (row, column) of (o-e)^2/e = n * (sum o^2/(ra*cb) - 1)
    seen = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("q"),
                                                     F.sum(1.0 / F.col("ra") / F.col("cb")).alias("inv"), F.min(F.col("o")).alias("mo")).withColumn("one", F.lit(1))
    t = size.join(F.broadcast(seen), "one")
    plain = F.col("n") * (F.col("q") - 1)
    # on a 2x2 table every |o-e| is equal, so Yates' correction follows from the plain statistic
    four = (rows.agg((F.product("ra")).alias("pr")).withColumn("one", F.lit(1))).join(F.broadcast(cols.agg(F.product("cb").alias("pc")).withColumn("one", F.lit(1))), "one")
    t = t.join(F.broadcast(four), "one")
    small = (F.col("r") == 2) & (F.col("c") == 2)
    diff = F.sqrt(plain * F.col("pr") * F.col("pc") / F.pow(F.col("n"), 3))
    yates = F.pow(F.greatest(diff - F.least(F.lit(0.5), diff), F.lit(0.0)), 2) * F.pow(F.col("n"), 3) / (F.col("pr") * F.col("pc"))
    ok = (F.col("r") >= 2) & (F.col("c") >= 2)
    chi = F.when(ok, F.when(small, yates).otherwise(plain))
    return t.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "n", chi.alias("chi2"), F.when(ok, (F.col("r") - 1) * (F.col("c") - 1)).alias("dof"),
                    F.sqrt(chi / F.col("n") / F.nullif(F.least(F.col("r"), F.col("c")) - 1, F.lit(0))).alias("cramers_v"))


def cramers_v_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    upper = o.union_all([chisq(df, a, b).select("col_a", "col_b", "cramers_v") for a, b in combinations(columns, 2)])
    lower = upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "cramers_v")
    eye = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col_a string, col_b string, cramers_v double")
    return o.union_all([upper, lower, eye])


def js_divergence(df: DataFrame, group: str, category: str, groups: Sequence) -> DataFrame:
    """Base-2 Jensen-Shannon divergence of category histograms for all pairs of the listed groups."""
    counts = df.groupBy(category).agg(*[F.count_if(F.col(group) == F.lit(g)).alias(f"g{k}") for k, g in enumerate(groups)])
    totals = counts.agg(*[F.sum(f"g{k}").alias(f"t{k}") for k in range(len(groups))]).withColumn("one", F.lit(1))
    t = counts.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one")

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    pairs = []
    for a, b in combinations(range(len(groups)), 2):
        p, q = F.col(f"g{a}") / F.col(f"t{a}"), F.col(f"g{b}") / F.col(f"t{b}")
        pairs.append(F.struct(F.lit(groups[a]).alias("group_a"), F.lit(groups[b]).alias("group_b"), ((half(p, q) + half(q, p)) / 2).alias("j"), F.col(f"t{a}").alias("n_a"), F.col(f"t{b}").alias("n_b")))
    rows = t.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return rows.groupBy("group_a", "group_b").agg(F.sum("j").alias("jsd"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


# --- resampling ------------------------------------------------------------------------------------------

def sample_size_curve(df: DataFrame, group: str, value: str, row_id: str, pair: tuple, sizes: Sequence[int], replicates: int, seed: int = 0) -> DataFrame:
    """KS D of hash-ordered subsamples of each size: mean and 5 / 95 percentiles over replicates."""
    from echogrid.operators.topk import bounded_top, low_hashes

    both = df.filter(F.col(group).isin(list(pair))).select(group, value, row_id)
    reps = both.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    hashed = reps.withColumn("__h", fx.stable_order(seed, F.col("replicate"), F.col(row_id)))
    near = low_hashes(hashed, ["replicate", group], "__h", max(sizes))
    drawn = bounded_top(near, ["replicate", group], [F.col("__h"), F.col(row_id)], max(sizes))
    sized = drawn.withColumn("size", F.explode(F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: F.col("rn") <= k)))
    d = pair_statistics(sized, ["replicate", "size"], group, value, list(pair)).filter("ks_d IS NOT NULL AND n_a = size AND n_b = size")
    # one row per (replicate, size): bounded by the chosen replicate count
    return d.groupBy("size").agg(F.count("*").alias("replicates"), F.avg("ks_d").alias("ks_d_mean"), F.percentile("ks_d", F.lit(0.05)).alias("ks_d_lo"), F.percentile("ks_d", F.lit(0.95)).alias("ks_d_hi"))


def cluster_bootstrap(scores: DataFrame, subject: str, score: str, truth: str, replicates: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of AUROC under resampling of whole subjects; picks enter as multiplicities, rows are not copied."""
    slim = scores.groupBy(subject, score, truth).agg(F.count("*").alias("k"))
    subjects = o.number_rows(slim.select(subject).distinct(), [], [subject], "pos")
    n = subjects.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    picks = subjects.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    picks = picks.withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "replicate", "pos"), F.col("n"))).groupBy("replicate", "pick").agg(F.count("*").alias("times"))
    chosen = picks.join(subjects.select(subject, F.col("pos").alias("pick")), "pick")
    weighted = materialize(slim.join(chosen, subject).groupBy("replicate", score).agg(
        F.sum(F.col("k") * F.col("times") * F.col(truth)).alias("pos"), F.sum(F.col("k") * F.col("times") * (1 - F.col(truth))).alias("neg")))
    w = o.prefix_scan(o.sorted_chunks(weighted, ["replicate"], [score]), ["replicate"], [score], {"neg_below": ("sum_before", "neg")})
    auc = w.groupBy("replicate").agg((F.sum(F.col("pos") * (F.coalesce("neg_below", F.lit(0)) + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    done = auc.filter("auc IS NOT NULL")
    return done.agg(F.count("*").alias("replicates"), F.percentile("auc", F.lit(alpha / 2)).alias("lo"), F.percentile("auc", F.lit(1 - alpha / 2)).alias("hi"))


def permute_labels(df: DataFrame, file: str, subject: str, label: str, seed: int = 0) -> DataFrame:
    """Shuffle file labels inside each subject: the i-th file in id order gets the label of the i-th in hash order."""
    files = df.groupBy(file, subject).agg(F.min(label).alias("__y"))
    by_id = o.number_rows(files.select(file, subject), [subject], [file], "__i")
    hashed = files.withColumn("__h", fx.stable_order(seed, F.col(file)))
    by_hash = o.number_rows(hashed, [subject], ["__h", file], "__i").select(subject, "__i", F.col("__y").alias("permuted"))
    return by_id.join(by_hash, [subject, "__i"]).drop("__i")


def matched_arms(rows: DataFrame, target_env: int, row_id: str, n_test: int, n_train: int, replicates: int, cells: Sequence[str], seed: int = 0) -> DataFrame:
    """Arm table (arm, replicate, side, row id): IN, CROSS (round-robin over other environments), CROSS_E{e}, LOEO_full.

    Subjects are drawn in hash order per replicate; every cross arm copies the IN arm's cell counts, and a subject is
    never on both sides of an arm.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    people = rows.select("env", "subject").distinct().withColumn("replicate", reps).withColumn("__h", fx.stable_order(seed, F.col("replicate"), F.col("env"), F.col("subject")))
    ranked = materialize(o.number_rows(people, ["replicate", "env"], ["__h", "subject"], "rank").drop("__h"))
    home = ranked.filter(F.col("env") == target_env)
    test = home.filter(F.col("rank") < n_test).select("replicate", "env", "subject")
    pool = home.filter((F.col("rank") >= n_test) & (F.col("rank") < n_test + n_train)).select("replicate", "env", "subject")
    away = ranked.filter(F.col("env") != target_env)
    mixed = o.number_rows(away, ["replicate"], ["rank", "env"], "turn").filter(F.col("turn") < n_train).select("replicate", "env", "subject", F.lit("CROSS").alias("arm"))
    single = away.filter(F.col("rank") < n_train).select("replicate", "env", "subject", F.concat(F.lit("CROSS_E"), F.col("env").cast("string")).alias("arm"))
    take = lambda who: rows.join(who, ["env", "subject"])
    in_rows = take(pool)
    template = in_rows.groupBy("replicate", *cells).agg(F.count("*").alias("wanted"))
    candidates = take(o.union_all([mixed, single])).join(template, ["replicate", *cells]).withColumn("__h", fx.stable_order(seed, F.col("replicate"), F.col(row_id)))
    picked = o.number_rows(candidates, ["arm", "replicate", *cells], ["__h", row_id], "__k").filter(F.col("__k") < F.col("wanted"))
    out = lambda df, arm, side: df.select(arm.alias("arm"), "replicate", F.lit(side).alias("side"), row_id, "env", "subject")
    trains = o.union_all([out(in_rows, F.lit("IN"), "train"), out(picked, F.col("arm"), "train")])
    arms = trains.select("arm", "replicate").distinct()
    tests = take(test).join(arms, "replicate")
    full = rows.withColumn("replicate", F.lit(0)).withColumn("side_", F.when(F.col("env") == target_env, "test").otherwise("train"))
    loeo = full.select(F.lit("LOEO_full").alias("arm"), "replicate", F.col("side_").alias("side"), row_id, "env", "subject")
    return o.union_all([trains, out(tests, F.col("arm"), "test"), loeo])
