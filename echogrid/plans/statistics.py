"""Registered queries: statistics and evaluation."""

from pyspark.sql import functions as F

from echogrid.operators import evaluate as e
from echogrid.operators import sets
from echogrid.operators import stats as s
from echogrid.registry import query
from echogrid.session import materialize
from echogrid.sources import tables as t
from echogrid.sources.tables import r6, rnd, with_views

GROUPS = ["A", "N", "R"]


def _round(df, *cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


def _values(spark, sf):
    """Groups by return flag, strata by line number, two skewed metrics."""
    return t.table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS grp", "l_linenumber AS stratum", "l_linestatus AS klass", "l_quantity AS qty", "l_discount * l_quantity AS cost", "l_orderkey * 10 + l_linenumber AS row_id", "l_suppkey")


_V = "v AS (SELECT l_returnflag AS grp, l_linenumber AS stratum, l_linestatus AS klass, l_quantity AS qty, l_discount * l_quantity AS cost FROM lineitem)"
_PAIRS = """, pr(ga, gb) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')),
rk AS (SELECT ga, gb, grp, qty, rank() OVER (PARTITION BY ga, gb ORDER BY qty) + (count(*) OVER (PARTITION BY ga, gb, qty) - 1) / 2.0::DOUBLE AS r FROM v JOIN pr ON grp IN (ga, gb)),
u AS (SELECT ga, gb, sum(r) FILTER (grp = ga) - count(*) FILTER (grp = ga) * (count(*) FILTER (grp = ga) + 1) / 2.0::DOUBLE AS u, count(*) FILTER (grp = ga) AS na, count(*) FILTER (grp = gb) AS nb,
  var_samp(qty) FILTER (grp = ga) AS va, var_samp(qty) FILTER (grp = gb) AS vb FROM rk GROUP BY ALL),
cd AS (SELECT ga, gb, qty, count(*) FILTER (grp = ga) AS ca, count(*) FILTER (grp = gb) AS cb FROM v JOIN pr ON grp IN (ga, gb) GROUP BY ALL),
fd AS (SELECT ga, gb, qty, abs(sum(ca) OVER w / sum(ca) OVER (PARTITION BY ga, gb)::DOUBLE - sum(cb) OVER w / sum(cb) OVER (PARTITION BY ga, gb)::DOUBLE) AS d, lead(qty) OVER w - qty AS wd FROM cd WINDOW w AS (PARTITION BY ga, gb ORDER BY qty)),
ks AS (SELECT ga, gb, max(d) AS d, sum(d * wd) AS w FROM fd GROUP BY ALL)"""


@query("q1_cliffs_delta", f"WITH {_V}{_PAIRS} SELECT ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, {r6('u', 1)} AS u, {r6('2 * u / (na * nb) - 1')} AS delta, CASE WHEN abs(2 * u / (na * nb) - 1) < 0.147 THEN 'negligible' ELSE 'other' END AS magnitude FROM u")
def q1(spark, sf):
    p = s.pair_statistics(_values(spark, sf), [], "grp", "qty", GROUPS)
    return p.select("group_a", "group_b", "n_a", "n_b", rnd("u", 1).alias("u"), rnd("delta").alias("delta"), "magnitude")


@query("q2_ks_effect", f"WITH {_V}{_PAIRS} SELECT ga AS group_a, gb AS group_b, {r6('d')} AS ks_d FROM ks")
def q2(spark, sf):
    return s.pair_statistics(_values(spark, sf), [], "grp", "qty", GROUPS).select("group_a", "group_b", rnd("ks_d").alias("ks_d"))


@query("q3_wasserstein_std", f"WITH {_V}{_PAIRS} SELECT u.ga AS group_a, u.gb AS group_b, {r6('w')} AS w, {r6('w / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))')} AS w_std FROM u JOIN ks ON u.ga = ks.ga AND u.gb = ks.gb")
def q3(spark, sf):
    return s.pair_statistics(_values(spark, sf), [], "grp", "qty", GROUPS).select("group_a", "group_b", rnd("w").alias("w"), rnd("w_std").alias("w_std"))


def _kruskal_sql(by):
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    part2 = f"PARTITION BY {cols}qty"
    return f"""WITH {_V}, rk AS (SELECT *, rank() OVER ({part} ORDER BY qty) + (count(*) OVER ({part2}) - 1) / 2.0::DOUBLE AS r FROM v),
g AS (SELECT {cols}grp, sum(r) AS r, count(*) AS n FROM rk GROUP BY ALL), tt AS (SELECT {cols}sum(c * c * c - c)::DOUBLE AS t FROM (SELECT {cols}qty, count(*)::DOUBLE AS c FROM v GROUP BY ALL) {'GROUP BY ALL' if by else ''}),
h AS (SELECT {cols}sum(n) AS n, count(*) AS k, sum(r * r / n) AS s FROM g {'GROUP BY ALL' if by else ''}),
z AS (SELECT {'h.' + by + ',' if by else ''} n, k, (12 / (n::DOUBLE * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n::DOUBLE * n * n - n)) AS h FROM h {'JOIN tt ON tt.' + by + ' = h.' + by if by else ', tt'})"""


@query("q4_kruskal_eps", _kruskal_sql("") + f" SELECT n::BIGINT AS n_rows, k::INT AS n_groups, {r6('h', 5)} AS h, {r6('greatest(0, least(1, (h - k + 1) / (n - k)))', 8)} AS eps_sq FROM z")
def q4(spark, sf):
    k = s.kruskal(_values(spark, sf), [], "grp", "qty", GROUPS)
    return k.withColumns({"h": rnd("h", 5), "eps_sq": rnd("eps_sq", 8)})


@query("q5_friedman", f"""
WITH p AS (SELECT l_suppkey AS s, l_returnflag AS m, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), c AS (SELECT * FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) = 3)),
r AS (SELECT m, s, rank() OVER (PARTITION BY s ORDER BY v) + (count(*) OVER (PARTITION BY s, v) - 1) / 2.0::DOUBLE AS r FROM c), x AS (SELECT m, sum(r) AS rs, count(*) AS n FROM r GROUP BY m)
SELECT max(n) AS n_sessions, {r6("12.0 / (max(n) * 3 * 4) * sum(rs * rs) - 3 * max(n) * 4", 5)} AS statistic FROM x""")
def q5(spark, sf):
    f = s.friedman(t.table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity", GROUPS)
    return f.withColumn("statistic", rnd("statistic", 5))


@query("q6_chisq_cramers_v", f"""
WITH c AS (SELECT c_mktsegment AS a, CAST(c_nationkey % 4 AS VARCHAR) AS b, count(*) AS o FROM customer GROUP BY ALL), ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), n AS (SELECT sum(o)::DOUBLE AS n FROM c),
x AS (SELECT sum(pow(COALESCE(o, 0) - ra * cb / n, 2) / (ra * cb / n)) AS chi2, max(n)::BIGINT AS n, count(DISTINCT ra.a) AS r, count(DISTINCT cb.b) AS k FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = cb.b),
c2 AS (SELECT c_nationkey % 2 AS a, c_acctbal > 0 AS b, count(*) AS o FROM customer GROUP BY ALL), ra2 AS (SELECT a, sum(o) AS ra FROM c2 GROUP BY 1), cb2 AS (SELECT b, sum(o) AS cb FROM c2 GROUP BY 1),
y AS (SELECT sum(pow(greatest(abs(o - ra * cb / n) - 0.5, 0), 2) / (ra * cb / n)) AS chi2, max(n)::BIGINT AS n FROM c2 JOIN ra2 ON ra2.a = c2.a JOIN cb2 ON cb2.b = c2.b, n)
SELECT 'segment' AS col_a, 'nation4' AS col_b, n, {r6("chi2", 5)} AS chi2, (r - 1) * (k - 1) AS dof, {r6("sqrt(chi2 / n / (least(r, k) - 1))")} AS cramers_v FROM x
UNION ALL SELECT 'nation2', 'positive', n, {r6("chi2", 5)}, 1, {r6("sqrt(chi2 / n)")} FROM y""")
def q6(spark, sf):
    c = t.table(spark, sf, "customer").selectExpr("c_mktsegment AS segment", "c_nationkey % 4 AS nation4", "c_nationkey % 2 AS nation2", "c_acctbal > 0 AS positive")
    both = s.chisq(c, "segment", "nation4").unionByName(s.chisq(c, "nation2", "positive"))
    return both.withColumns({"chi2": rnd("chi2", 5), "cramers_v": rnd("cramers_v")})


@query("q6_cramers_matrix", f"""
WITH base AS (SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_nationkey % 4 AS VARCHAR) AS nation4, CAST(c_custkey % 3 AS VARCHAR) AS third FROM customer),
pr(a, b) AS (VALUES ('segment', 'nation4'), ('segment', 'third'), ('nation4', 'third')),
lng AS (SELECT id, 'segment' AS c, segment AS v FROM base UNION ALL SELECT id, 'nation4', nation4 FROM base UNION ALL SELECT id, 'third', third FROM base),
c AS (SELECT pr.a, pr.b, x.v AS va, y.v AS vb, count(*)::DOUBLE AS o FROM pr JOIN lng x ON x.c = pr.a JOIN lng y ON y.c = pr.b AND y.id = x.id GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY a, b, va) AS ra, sum(o) OVER (PARTITION BY a, b, vb) AS cb, sum(o) OVER (PARTITION BY a, b) AS n FROM c),
v AS (SELECT a, b, sqrt((sum(o * o / (ra * cb)) - 1) / (least(count(DISTINCT va), count(DISTINCT vb)) - 1)) AS v FROM m GROUP BY a, b)
SELECT a AS col_a, b AS col_b, {r6("v")} AS cramers_v FROM v UNION ALL SELECT b, a, {r6("v")} FROM v UNION ALL SELECT DISTINCT c, c, 1.0::DOUBLE FROM lng""")
def q6_matrix(spark, sf):
    c = t.table(spark, sf, "customer").selectExpr("c_mktsegment AS segment", "c_nationkey % 4 AS nation4", "c_custkey % 3 AS third")
    return s.cramers_v_matrix(c, ["segment", "nation4", "third"]).withColumn("cramers_v", rnd("cramers_v"))


@query("q7_js_divergence", f"""
WITH h AS (SELECT l_returnflag AS g, l_linenumber * 10 + CAST(l_quantity AS INT) % 5 AS c, count(*)::DOUBLE AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 7) GROUP BY ALL),
p AS (SELECT g, c, n / sum(n) OVER (PARTITION BY g) AS p, sum(n) OVER (PARTITION BY g)::BIGINT AS tot FROM h), cc AS (SELECT DISTINCT c FROM h), pr(a, b) AS (VALUES ('A','N'),('A','R'),('N','R')),
j AS (SELECT a, b, COALESCE(x.p, 0) AS x, COALESCE(y.p, 0) AS y FROM pr CROSS JOIN cc LEFT JOIN p x ON x.g = a AND x.c = cc.c LEFT JOIN p y ON y.g = b AND y.c = cc.c)
SELECT a AS group_a, b AS group_b, {r6("sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2)")} AS jsd,
  (SELECT max(tot) FROM p WHERE g = a) AS n_a, (SELECT max(tot) FROM p WHERE g = b) AS n_b FROM j GROUP BY a, b""")
def q7(spark, sf):
    l = t.table(spark, sf, "lineitem").filter("NOT (l_returnflag = 'A' AND l_linenumber = 7)").selectExpr("l_returnflag AS g", "l_linenumber * 10 + cast(l_quantity AS int) % 5 AS c")
    return _round(s.js_divergence(l, "g", "c", GROUPS), "jsd")


@query("q8_pairwise_divergence", f"""
WITH {_V}{_PAIRS}, med AS (SELECT grp, median(qty) AS m FROM v GROUP BY 1),
x AS (SELECT u.ga, u.gb, na, nb, 2 * u / (na * nb) - 1 AS delta, d, w / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS ws FROM u JOIN ks ON u.ga = ks.ga AND u.gb = ks.gb)
SELECT 'qty' AS metric, ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, {r6("delta")} AS delta, {r6("d")} AS ks_d, {r6("ws")} AS w_std, a.m AS median_a, b.m AS median_b FROM x JOIN med a ON a.grp = ga JOIN med b ON b.grp = gb""")
def q8(spark, sf):
    p = s.pairwise_divergence(_values(spark, sf), ["qty"], "grp", GROUPS)
    return p.select("metric", "group_a", "group_b", "n_a", "n_b", rnd("delta").alias("delta"), rnd("ks_d").alias("ks_d"), rnd("w_std").alias("w_std"), "median_a", "median_b")


def _ks_sql(metric):
    return f"SELECT '{metric}' AS metric, ga, gb, d, na, nb FROM (WITH {_V}{_PAIRS.replace('qty', metric)} SELECT ks.ga, ks.gb, d, na, nb FROM ks JOIN u ON u.ga = ks.ga AND u.gb = ks.gb)"


@query("q8_pairwise_divergence_p", f"""
WITH k AS ({_ks_sql("qty")} UNION ALL {_ks_sql("cost")}), l AS (SELECT metric, ga, gb, d * d * na * nb / (na + nb)::DOUBLE AS lam FROM k),
p AS (SELECT metric, ga, gb, greatest(0.0, least(1.0, 2 * sum(CASE WHEN n % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * n * n * lam)))) AS p FROM l, range(1, 101) r(n) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY p, metric || '|' || ga || '|' || gb) AS rank, count(*) OVER () AS m FROM p)
SELECT metric, ga AS group_a, gb AS group_b, {r6("p")} AS ks_p, {r6("least(1.0, min(p * m / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS ks_q FROM o""")
def q8p(spark, sf):
    p = s.pairwise_divergence(_values(spark, sf), ["qty", "cost"], "grp", GROUPS)
    return p.select("metric", "group_a", "group_b", rnd("ks_p").alias("ks_p"), rnd("ks_q").alias("ks_q"))


def _delta_sql(group, a, b, where="true"):
    return f"(SELECT abs(2 * (sum(r) FILTER (g = '{a}') - count(*) FILTER (g = '{a}') * (count(*) FILTER (g = '{a}') + 1) / 2.0::DOUBLE) / (count(*) FILTER (g = '{a}') * count(*) FILTER (g = '{b}'))::DOUBLE - 1) FROM (SELECT {group} AS g, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0::DOUBLE AS r FROM v WHERE {group} IN ('{a}', '{b}') AND {where}))"


def _env_gap(where="true"):
    return "greatest(" + ", ".join(_delta_sql("grp", a, b, where) for a, b in (("A", "N"), ("A", "R"), ("N", "R"))) + ")"


@query("q9_gap_comparison", f"""
WITH {_V}, x AS (SELECT {_env_gap()} AS eg, {_delta_sql("klass", "F", "O")} AS cg, {_env_gap("klass = 'F'")} AS w0, {_env_gap("klass = 'O'")} AS w1)
SELECT 'qty' AS metric, {r6("eg")} AS env_gap, {r6("cg")} AS class_gap, {r6("w0")} AS env_gap_within_0, {r6("w1")} AS env_gap_within_1, {r6("eg / cg", 4)} AS ratio, eg > cg AS env_exceeds_class FROM x""")
def q9(spark, sf):
    g = s.gap_comparison(_values(spark, sf), ["qty"], "grp", GROUPS, "klass", ["F", "O"])
    return _round(_round(g, "env_gap", "class_gap", "env_gap_within_0", "env_gap_within_1"), "ratio", digits=4)


@query("q10_stratified_test", _kruskal_sql("stratum") + f" SELECT stratum, n::BIGINT AS n_rows, k::INT AS n_groups, {r6('h', 5)} AS h, {r6('greatest(0, least(1, (h - k + 1) / (n - k)))', 8)} AS eps_sq, true AS adjusted FROM z")
def q10(spark, sf):
    k = s.stratified_test(_values(spark, sf), "stratum", "grp", "qty", GROUPS)
    return k.select("stratum", "n_rows", "n_groups", rnd("h", 5).alias("h"), rnd("eps_sq", 8).alias("eps_sq"), (F.col("p_adj") >= F.col("p_value") - 1e-12).alias("adjusted"))


@query("q11_sample_size_curve")
def q11(spark, sf):
    return _round(s.sample_size_curve(_values(spark, sf), "grp", "qty", "row_id", ("A", "R"), [20, 60, 180], 8), "ks_d_mean", "ks_d_lo", "ks_d_hi")


def _design(spark, sf):
    w = t.windows(spark, sf).selectExpr("vec_id AS row_id", "recording_id", "x", "slice(x, 1, 32) AS left", "slice(x, 33, 32) AS right", "cast(label IN (1, 4) AS int) AS y", "vec_id % 3 AS env", "cast(vec_id % 30 AS int) AS subject", "label + 1 AS activity")
    for src, out in (("x", "features"), ("left", "block_a"), ("right", "block_b")):
        w = e.as_vector(w, src, out)
    return materialize(w.drop("x", "left", "right"))  # read once per model iteration


@query("q12_group_probe")
def q12(spark, sf):
    p = e.group_probe(_design(spark, sf).withColumn("env", F.col("env").cast("int")), "features", "env", "subject")
    return p.select("env", "n", rnd("recall").alias("recall"), rnd("balanced_accuracy").alias("balanced_accuracy"))


def _arms(spark, sf):
    rows = t.file_index(spark, sf).select("recording_id", "env", F.expr("env * 100 + subject").alias("subject"), "activity", "is_fall")
    return rows, materialize(s.matched_arms(rows, 1, "recording_id", 3, 3, 2, ["activity", "is_fall"], 1))


@query("q13_matched_arms")
def q13(spark, sf):
    _, arms = _arms(spark, sf)
    key = F.concat_ws("#", "arm", F.col("replicate").cast("string"))
    keyed = arms.withColumn("unit", key)
    canary = sets.leakage_canary(keyed.filter("side = 'train'"), keyed.filter("side = 'test'"), "unit", ["subject", "recording_id"])
    sizes = keyed.groupBy("unit").agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"))
    return canary.join(sizes, "unit")


@query("q14_arm_scores")
def q14(spark, sf):
    _, arms = _arms(spark, sf)
    d = _design(spark, sf).select(F.col("row_id").alias("recording_id"), "features", "y")
    a = e.score_arms(d, arms, "recording_id", "features", "y")
    names = ("auroc", "ap", "balanced_accuracy", "best_balanced_accuracy")
    return a.select("arm", "replicate", "positives", "negatives", *[rnd(c).alias(c) for c in names], rnd("auc_granularity", 9).alias("auc_granularity"))


@query("q15_cluster_bootstrap")
def q15(spark, sf):
    sc = t.table(spark, sf, "lineitem").selectExpr("l_suppkey % 40 AS subject", "l_quantity AS score", "CASE WHEN (l_partkey * 7 + l_suppkey) % 100 < l_quantity THEN 1 ELSE 0 END AS y")
    return _round(s.cluster_bootstrap(sc, "subject", "score", "y", 40), "lo", "hi")


@query("q16_permute_labels", """
WITH f AS (SELECT o_orderkey AS file, o_custkey AS subject, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
a AS (SELECT file, subject, row_number() OVER (PARTITION BY subject ORDER BY file) AS i FROM f), b AS (SELECT subject, y, row_number() OVER (PARTITION BY subject ORDER BY md5('9:' || file), file) AS i FROM f)
SELECT a.file, a.subject, b.y AS permuted FROM a JOIN b ON a.subject = b.subject AND a.i = b.i""")
def q16(spark, sf):
    f = t.table(spark, sf, "orders").selectExpr("o_orderkey AS file", "o_custkey AS subject", "if(o_orderstatus = 'F', 1, 0) AS y")
    return s.permute_labels(f, "file", "subject", "y", 9)


@query("q17_pair_fusion")
def q17(spark, sf):
    return _round(e.pair_fusion(_design(spark, sf), "block_a", "block_b", "y", "subject"), "accuracy_a", "accuracy_b", "accuracy_avg", "accuracy_concat")


@query("q18_block_pca_design")
def q18(spark, sf):
    from pyspark.ml.functions import vector_to_array

    d = e.block_pca_design(_design(spark, sf), {"a": "block_a", "b": "block_b"}, 4).select("row_id", vector_to_array("design").alias("d"))
    return d.select("row_id", F.size("d").alias("width"), rnd(F.aggregate("d", F.lit(0.0), lambda acc, v: acc + v * v)).alias("norm"))


@query("q19_separability")
def q19(spark, sf):
    r = e.separability(_design(spark, sf), "features", "y", "recording_id")
    return r.withColumns({c: rnd(c) for c in r.columns})
