"""Expression-matrix queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doselake import registry
from doselake.operators import knn
from doselake.operators import matrix as M
from doselake.operators import select as P
from doselake.plans.catalog import cells, query, r
from doselake.plans.screening import prepare_training as prepare
from doselake.plans.standins import Tables
from doselake.registry import create_transform

# Per-gene statistics of the matrix with and without gaps, in SQL.
STATS = """s AS (SELECT pos, avg(x) AS mu, stddev_pop(x) AS sd, quantile_cont(x, 0.5) AS med,
  quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, var_pop(x) AS v, count(x) AS n FROM {src} GROUP BY pos)"""
OF_EXPR, OF_GAPS = STATS.format(src="expr"), STATS.format(src="gaps")


@query("SELECT sig_id, pos, round(x, 6) AS x FROM gaps")
def to_long(t: Tables) -> DataFrame:
    return M.to_long(t.gappy).select("sig_id", "pos", r("x"))


@query("SELECT sig_id, pos, round(x, 6) AS x FROM gaps")
def to_wide(t: Tables) -> DataFrame:
    return cells(M.to_wide(M.to_long(t.gappy)))


@query(f"""
WITH {OF_GAPS} SELECT pos, n AS n_present, round(mu, 6) AS mean, round(sd, 6) AS std, round(q1, 6) AS q25,
  round(med, 6) AS q50, round(q3, 6) AS q75 FROM s""")
def gene_stats(t: Tables) -> DataFrame:
    s = M.gene_stats(t.gappy, [0.25, 0.5, 0.75])
    q = F.col("q")
    return s.select("pos", "n_present", r("mean"), r("std"), r(q[0]).alias("q25"), r(q[1]).alias("q50"), r(q[2]).alias("q75"))


@query(f"WITH {OF_GAPS} SELECT g.sig_id, g.pos, round(coalesce(g.x, s.mu), 6) AS x FROM gaps g JOIN s USING (pos)")
def impute_mean(t: Tables) -> DataFrame:
    return cells(M.Imputer("mean").fit(t.gappy).transform(t.gappy))


@query(f"WITH {OF_GAPS} SELECT g.sig_id, g.pos, round(coalesce(g.x, s.med), 6) AS x FROM gaps g JOIN s USING (pos)")
def impute_median(t: Tables) -> DataFrame:
    return cells(M.Imputer("median").fit(t.gappy).transform(t.gappy))


@query("""
SELECT sig_id, round(coalesce(viability, (SELECT avg(viability) FROM rowmeta)), 6) AS viability,
  round(coalesce(pert_dose, (SELECT quantile_cont(pert_dose, 0.5) FROM rowmeta)), 6) AS pert_dose FROM rowmeta""")
def impute_metadata(t: Tables) -> DataFrame:
    return M.impute_metadata(t.rowmeta, "mean").select("sig_id", r("viability"), r("pert_dose"))


@query("""
WITH d AS (SELECT a.sig_id, b.sig_id AS other, sqrt(sum((a.x - b.x) ** 2) * max(w.n) / count(*)) AS dist
  FROM gaps a JOIN gaps b ON a.pos = b.pos AND a.sig_id <> b.sig_id,
       (SELECT count(DISTINCT pos) AS n FROM gaps) w
  WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY a.sig_id, b.sig_id),
c AS (SELECT m.sig_id, m.pos, b.x, row_number() OVER (PARTITION BY m.sig_id, m.pos ORDER BY d.dist, d.other) AS rn
  FROM (SELECT sig_id, pos FROM gaps WHERE x IS NULL) m JOIN d ON d.sig_id = m.sig_id
  JOIN gaps b ON b.sig_id = d.other AND b.pos = m.pos WHERE b.x IS NOT NULL),
f AS (SELECT sig_id, pos, avg(x) AS x FROM c WHERE rn <= 5 GROUP BY sig_id, pos)
SELECT g.sig_id, g.pos, round(coalesce(g.x, f.x), 6) AS x FROM gaps g LEFT JOIN f USING (sig_id, pos)""")
def impute_knn(t: Tables) -> DataFrame:
    return cells(knn.impute_knn(t.gappy, 5, block=256))


@query(f"""
WITH {OF_EXPR} SELECT e.sig_id, e.pos, round(greatest(mu - 1.5 * sd, least(mu + 1.5 * sd, x)), 6) AS x
FROM expr e JOIN s USING (pos)""")
def clip_outliers(t: Tables) -> DataFrame:
    return cells(M.clip_outliers(t.matrix, 1.5))


@query(f"""
WITH {OF_EXPR} SELECT e.sig_id, CAST(sum(CASE WHEN abs(x - mu) / (sd + 1e-8) > 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_clipped
FROM expr e JOIN s USING (pos) GROUP BY e.sig_id""")
def count_clipped(t: Tables) -> DataFrame:
    return M.clip_outliers(t.matrix, 1.5).select("sig_id", F.col("n_clipped").cast("bigint").alias("n_clipped"))


@query("""
WITH n AS (SELECT sig_id, sqrt(sum(x * x)) AS l FROM expr GROUP BY sig_id)
SELECT e.sig_id, e.pos, round(CASE WHEN l > 0 THEN x / l ELSE x END, 6) AS x FROM expr e JOIN n USING (sig_id)""")
def l2_normalize(t: Tables) -> DataFrame:
    return cells(create_transform("normalize").transform(t.matrix))


@query(f"WITH {OF_EXPR} SELECT e.sig_id, e.pos, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS x FROM expr e JOIN s USING (pos)")
def standard_scale(t: Tables) -> DataFrame:
    return cells(create_transform("scale").fit(t.matrix).transform(t.matrix), digits=5)


@query(f"WITH {OF_EXPR} SELECT e.sig_id, e.pos, round((x - med) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END, 5) AS x FROM expr e JOIN s USING (pos)")
def robust_scale(t: Tables) -> DataFrame:
    return cells(create_transform("robust").fit(t.matrix).transform(t.matrix), digits=5)


@query("""
WITH n AS (SELECT sig_id, sqrt(sum(x * x)) AS l FROM expr GROUP BY sig_id),
u AS (SELECT e.sig_id, e.pos, x / l AS x FROM expr e JOIN n USING (sig_id)),
s AS (SELECT pos, avg(x) AS mu, stddev_pop(x) AS sd FROM u GROUP BY pos)
SELECT u.sig_id, u.pos, round((x - mu) / sd, 5) AS x FROM u JOIN s USING (pos)""")
def chain_transforms(t: Tables) -> DataFrame:
    both = create_transform("compound", transforms=[{"type": "normalize"}, {"type": "scale"}])
    return cells(both.fit(t.matrix).transform(t.matrix), digits=5)


U = "(CAST('0x' || substr(md5('42:{}:' || sig_id || ':' || pos), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


@query(f"""
SELECT sig_id, pos, round(x + 0.01::DOUBLE * sqrt(-2 * ln({U.format(1)})) * cos(2 * pi() * {U.format(2)}), 6) AS x FROM expr""")
def gaussian_noise(t: Tables) -> DataFrame:
    noisy = M.NoisyRows(0.0, 0.01).transform(t.matrix)
    return cells(noisy)


@query("""
SELECT sig_id, pos, round(x * CASE WHEN CAST('0x' || substr(md5('42:' || pos), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2::DOUBLE
  THEN 0 ELSE 1 END, 6) AS x FROM expr""")
def feature_dropout(t: Tables) -> DataFrame:
    return cells(M.FeatureDropout(0.2).transform(t.matrix))


@query("""
SELECT sig_id, pos, round(x * CASE WHEN CAST('0x' || substr(md5('7:' || pos), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3::DOUBLE
  THEN 0 ELSE 1 END, 6) AS x FROM expr""")
def create_augmentation(t: Tables) -> DataFrame:
    return cells(registry.create_augmentation("dropout", drop_prob=0.3, seed=7).transform(t.matrix))


@query(f"""
WITH {OF_EXPR}, k AS (SELECT pos FROM s WHERE v > 0.015::DOUBLE)
SELECT e.sig_id, row_number() OVER (PARTITION BY e.sig_id ORDER BY e.pos) - 1 AS pos, round(e.x, 6) AS x
FROM expr e JOIN k USING (pos)""", ints=("pos",))
def variance_threshold(t: Tables) -> DataFrame:
    return cells(M.variance_threshold(t.matrix, 0.015)[0])


@query()
def pca(t: Tables) -> DataFrame:
    model = M.CenteredPCA(k=4).fit(t.matrix)
    return cells(model.transform(t.matrix), values="components")


# Two genes in closed form: the eigenvectors of a symmetric 2 x 2 matrix, the larger loading positive.
PAIR = """
WITH v AS (SELECT sig_id, max(x) FILTER (pos = 0) AS x, max(x) FILTER (pos = 1) AS y FROM expr GROUP BY sig_id),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM v),
l AS (SELECT *, unnest([0, 1]) AS component, (a + c) / 2 + (CASE component WHEN 0 THEN 1 ELSE -1 END) * sqrt(((a - c) / 2) ** 2 + b * b) AS l FROM m),
w AS (SELECT *, b / sqrt(b * b + (l - a) ** 2) AS p, (l - a) / sqrt(b * b + (l - a) ** 2) AS q FROM l),
e AS (SELECT mx, my, component, l / (a + c) AS ratio, p * s AS p, q * s AS q
  FROM (SELECT *, CASE WHEN (CASE WHEN abs(p) >= abs(q) THEN p ELSE q END) < 0 THEN -1 ELSE 1 END AS s FROM w))"""


def _pair(t: Tables) -> DataFrame:
    return t.matrix.withColumn("values", F.slice("values", 1, 2))


@query(PAIR + "SELECT sig_id, component AS pos, round((x - mx) * p + (y - my) * q, 6) AS x FROM v, e", ints=("pos",))
def pca_pair(t: Tables) -> DataFrame:
    return cells(M.CenteredPCA(k=2).fit(_pair(t)).transform(_pair(t)), values="components")


@query(PAIR + "SELECT component, round(ratio, 6) AS ratio FROM e", ints=("component",))
def pca_pair_variance(t: Tables) -> DataFrame:
    return M.CenteredPCA(variance=1.0).fit(_pair(t)).explained_variance(t.spark).select("component", r("ratio"))


@query(PAIR + "SELECT component, rank, pos, round(loading, 6) AS loading FROM (SELECT component, pos, loading, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, pos) AS rank FROM (SELECT component, 0 AS pos, p AS loading FROM e UNION ALL SELECT component, 1, q FROM e))", ints=("component", "rank", "pos"))
def pca_pair_loadings(t: Tables) -> DataFrame:
    model = M.CenteredPCA(k=2).fit(_pair(t))
    return model.top_loadings(t.spark, 2).select("component", "rank", "pos", r("loading"))


@query()
def pca_variance(t: Tables) -> DataFrame:
    return M.CenteredPCA(variance=0.9).fit(t.matrix).explained_variance(t.spark).select("component", r("ratio"))


@query()
def pca_loadings(t: Tables) -> DataFrame:
    return M.CenteredPCA(k=3).fit(t.matrix).top_loadings(t.spark, 5).select("component", "rank", "pos", r("loading"))


@query("""
SELECT sig_id, pos, round(x, 6) AS x FROM expr
UNION ALL SELECT sig_id, 64 + pos, round(x * 2, 6) FROM expr
UNION ALL SELECT sig_id, 128, pert_dose FROM rowmeta""")
def concat_features(t: Tables) -> DataFrame:
    extra = F.transform("values", lambda x: x.cast("double") * 2)
    rows = t.matrix.withColumn("molecular", extra).join(t.rowmeta, "sig_id")
    return cells(M.concat_features(rows, ["values", "molecular"], ["pert_dose"]), values="features")


@query("""
SELECT a.pos AS i, b.pos AS j, round(corr(a.x, b.x), 5) AS r FROM expr a JOIN expr b ON a.sig_id = b.sig_id AND a.pos < b.pos
GROUP BY 1, 2""")
def corr_matrix(t: Tables) -> DataFrame:
    return M.corr_matrix(t.matrix).select("i", "j", r("r", 5))


@query("""
SELECT i, j, round(r, 5) AS r FROM (
  SELECT a.pos AS i, b.pos AS j, corr(a.x, b.x) AS r FROM expr a JOIN expr b ON a.sig_id = b.sig_id AND a.pos < b.pos
  GROUP BY 1, 2) WHERE abs(r) > 0.1 AND r <> 1""")
def high_corr_pairs(t: Tables) -> DataFrame:
    return M.high_corr_pairs(M.corr_matrix(t.matrix), 0.1).select("i", "j", r("r", 5))


@query(f"""
WITH {OF_GAPS}, f AS (SELECT g.sig_id, g.pos, coalesce(g.x, s.mu) AS x FROM gaps g JOIN s USING (pos)),
b AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM f GROUP BY pos),
c AS (SELECT f.sig_id, f.pos, greatest(m - 2 * d, least(m + 2 * d, x)) AS x FROM f JOIN b USING (pos)),
g AS (SELECT cell_mfc_name, row_number() OVER (ORDER BY md5('42:' || cell_mfc_name)) AS rn, count(*) OVER () AS n
      FROM (SELECT DISTINCT cell_mfc_name FROM rowmeta)),
p AS (SELECT cell_mfc_name, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test'
      WHEN rn <= ceil(n * 0.2::DOUBLE) + ceil((n - ceil(n * 0.2::DOUBLE)) * (0.1::DOUBLE / 0.8::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM g),
j AS (SELECT c.*, p.split FROM c JOIN rowmeta m USING (sig_id) JOIN p USING (cell_mfc_name)),
k AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d FROM j WHERE split = 'train' GROUP BY pos)
SELECT j.sig_id, j.split, j.pos, round((j.x - k.m) / k.d, 5) AS x FROM j JOIN k USING (pos)""")
def prepare_training(t: Tables) -> DataFrame:
    rows = t.gappy.join(t.rowmeta, "sig_id")
    out, _ = prepare(rows, threshold=2.0)
    return out.select("sig_id", "split", F.posexplode("values").alias("pos", "x")).select("sig_id", "split", "pos", r("x", 5))


@query("""
SELECT sig_id, pos, round(x * x, 6) AS x FROM expr""")
def row_transform(t: Tables) -> DataFrame:
    from doselake.registry import row_transform as apply

    return cells(apply(t.matrix, "values", lambda c: F.transform(c, lambda x: x.cast("double") * x)))


@query("""
SELECT e.sig_id, e.pos, round(e.x, 6) AS x FROM expr e WHERE e.sig_id IN (SELECT sig_id FROM rowmeta WHERE pert_dose IS NOT NULL)""")
def fit_transform(t: Tables) -> DataFrame:
    from doselake.registry import fit_transform as apply

    return cells(apply(lambda d: P.drop_incomplete(d, ["pert_dose"]), t.matrix.join(t.rowmeta, "sig_id")))
