"""Queries on whole result jobs; stand-ins as in ``rank_queries``."""

from pyspark.sql import functions as F

from verisieve.operators import models, reports
from verisieve.plans.model_queries import cut, examples
from verisieve.plans.rank_queries import EX, PAIRWISE, auroc_sql, dim_sql, long_scores
from verisieve.plans.registry import query
from verisieve.plans.source_queries import scratch
from verisieve.sources.readers import read_csv

SOURCES = reports.ScoreSources()


def _methods(spark, root, names):
    return long_scores(spark, root).where(F.col("method").isin(names)).select("pair", "id", "method", "category", "score")


@SOURCES.register("shape")
def shape(spark, root):
    return _methods(spark, root, ["length", "spaces", "residue"])


@SOURCES.register("mended")
def mended(spark, root):
    """Other residues for one language, and only for documents with labels of good quality."""
    rows = long_scores(spark, root).where("method = 'residue' AND pair = 'fr' AND quality = 1")
    return rows.select("pair", "id", "method", "category", (F.col("id") % 89).cast("double").alias("score"))


TABLE = f"""{EX}, {dim_sql([r for r in PAIRWISE])}, told AS (SELECT pair, method, category, score FROM long WHERE NOT (pair = 'fr' AND method = 'residue')
  UNION ALL SELECT pair, 'residue', category, CAST(id % 89 AS DOUBLE) FROM example WHERE pair = 'fr' AND quality = 1),
s AS (SELECT l.pair, l.method, d.contrast, d.role AS y, l.score FROM told l JOIN dim d USING (category)), {auroc_sql('s', ['pair', 'method', 'contrast'])},
c AS (SELECT pair, method, count(*) AS n, count(*) FILTER (category = 'IH') AS n_IH, count(*) FILTER (category = 'CH') AS n_CH, count(*) FILTER (category = 'IL') AS n_IL, count(*) FILTER (category = 'CL') AS n_CL FROM told GROUP BY 1, 2),
t AS (SELECT c.*, {', '.join(f"(SELECT a.auroc FROM a WHERE a.pair = c.pair AND a.method = c.method AND a.contrast = '{x}') AS {x}" for x in reports.CONTRASTS)} FROM c)"""


@query("category_job", f"WITH {TABLE} SELECT pair, method, CAST(n AS VARCHAR) AS n, CAST(n_IH AS VARCHAR) AS n_IH, CAST(n_CH AS VARCHAR) AS n_CH, CAST(n_IL AS VARCHAR) AS n_IL, CAST(n_CL AS VARCHAR) AS n_CL, {', '.join(f'''printf('%.4f', {x}) AS {x}''' for x in reports.CONTRASTS)} FROM t")
def category_job(spark, root):
    """The job's table, read back from the CSV that it writes."""
    out = scratch(spark)
    reports.category_job(spark, SOURCES, root, out, ["fr", "de"])
    return read_csv(spark, f"{out}/table")


@query("category_means_report", f"WITH {TABLE} SELECT '| ' || method || {' || '.join(f''' ' | ' || coalesce(printf('%.4f', avg({x})), '—') ''' for x in reports.CONTRASTS)} || ' | ' || count(*) || ' |' AS line FROM t GROUP BY method")
def category_means_report(spark, root):
    """The lines of means in the report, read back from the text that the job writes."""
    out = scratch(spark)
    reports.category_job(spark, SOURCES, root, out, ["fr", "de"])
    lines = spark.read.text(f"{out}/report").where(F.col("value").rlike("^\\| (length|spaces|residue) \\|"))
    return lines.select(F.col("value").alias("line"))


@query("band_raw_table", f"""WITH {TABLE}, b AS (SELECT pair, method, CASE WHEN category IN ('IH', 'CH') THEN 'HI' ELSE 'LO' END AS band, CASE WHEN category IN ('IH', 'IL') THEN 1 ELSE 0 END AS y, score FROM told),
k AS (SELECT *, rank() OVER (PARTITION BY pair, method, band ORDER BY score) + (count(*) OVER (PARTITION BY pair, method, band, score) - 1) / 2.0 AS rk FROM b),
m AS (SELECT pair, method, band, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, sum(rk) FILTER (y = 1) AS w FROM k GROUP BY 1, 2, 3),
g AS (SELECT pair, method, 'HI' AS band, IHvCH AS general FROM t UNION ALL SELECT pair, method, 'LO', ILvCL FROM t),
res AS (SELECT m.*, CASE WHEN least(p, q) >= 5 THEN (w - p * (p + 1) / 2.0) / (p * q) END AS special, general FROM m LEFT JOIN g USING (pair, method, band))
SELECT pair, method, band, 0::BIGINT AS n_tr_pos, 0::BIGINT AS n_tr_neg, p AS n_te_pos, q AS n_te_neg, round(special, 6) AS auroc_specialist, round(general, 6) AS auroc_generalist, round(special - general, 6) + 0.0 AS delta FROM res""")
def band_raw_table(spark, root):
    """Scores that nothing is fitted for, by band; those of the mended source apart from the rest."""
    scores = SOURCES.gather(spark, root)
    rows = reports.with_generalist(reports.raw_band_rows(scores, 5), reports.category_table(scores))
    return rows.withColumns({c: F.round(c, 6) + 0.0 for c in ("auroc_specialist", "auroc_generalist", "delta")})


@query("band_specialist_job")
def band_specialist_job(spark, root):
    """Models of one band against the table of all, read back from the CSV that the job writes."""
    rows = examples(spark, root).withColumn("category", F.concat(F.when(F.col("y") == 1, "I").otherwise("C"), F.when(F.col("band") == "HI", "H").otherwise("L")))
    rows = rows.withColumn("pair", F.col("pair").cast("string"))
    train, test = cut(rows)
    general = models.predict(test, models.fit_logistic(train, ["pair"], "e"), ["pair"], "e")
    scores = [general.select("pair", F.lit(m).alias("method"), "category", F.col("p").alias("score")) for m in ("all", "head")]
    table = reports.category_table(scores[0].unionByName(scores[1]))
    special = reports.specialist_rows(train, test, {"all (best=64)": F.col("e"), "head": F.slice("e", 1, 16)})
    out = scratch(spark)
    reports.specialist_job(special, table, out)
    return read_csv(spark, f"{out}/specialists", line_breaks=False)
