"""The given tables read as screening tables, in Spark and in portable SQL.

``Tables`` derives every domain table lazily with DataFrame operations; ``VIEWS``
states the same derivations as SQL for the independent check.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doselake.functions.ranking import blocked_row_number


class Tables:
    """Domain tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def siginfo(self) -> DataFrame:
        lines = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.min("l_partkey").alias("p_partkey"), F.sum("l_quantity").alias("pert_dose")
        )
        cells = self.raw("customer").join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select("c_custkey", F.col("n_name").alias("cell_mfc_name"))
        return (
            lines.join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(cells, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("part"), "p_partkey")
            .select(
                F.col("o_orderkey").alias("sig_id"), "cell_mfc_name",
                F.col("p_partkey").cast("string").alias("pert_mfc_id"),
                F.concat_ws("|", "p_name", "p_brand").alias("cmap_name"), "pert_dose",
                F.when(F.col("o_orderstatus") != "P", 24.0).otherwise(6.0).alias("pert_time"),
            )
        )

    @cached_property
    def curves(self) -> DataFrame:
        pairs = self.raw("lineitem").select("l_suppkey", "l_partkey").distinct()
        return pairs.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("experiment_id"), F.col("l_partkey").alias("master_cpd_id"),
            (F.col("p_size") % 10 - 2).cast("double").alias("p1_center"),
            (F.col("l_suppkey") % 5 + 0.5).cast("double").alias("p2_slope"),
            (F.col("l_partkey") % 10 / 20.0).cast("double").alias("p4_baseline"),
        )

    @cached_property
    def per_experiment(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("experiment_id"), F.col("s_nationkey").alias("master_ccl_id")
        )

    @cached_property
    def per_cell_line(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("master_ccl_id"), F.col("n_name").alias("ccl_name")
        )

    @cached_property
    def per_compound(self) -> DataFrame:
        close = F.when(F.col("p_partkey") % 7 == 0, "(").otherwise("()")
        return self.raw("part").select(
            F.col("p_partkey").alias("master_cpd_id"), F.col("p_partkey").cast("string").alias("broad_cpd_id"),
            F.concat_ws("|", "p_name", "p_brand").alias("cpd_name"),
            F.concat(F.col("p_type"), close, F.col("p_name")).alias("cpd_smiles"),
        )

    @cached_property
    def concentrations(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("experiment_id"), F.col("l_partkey").alias("master_cpd_id"),
            F.col("l_quantity").alias("cpd_conc_umol"), F.col("l_discount").alias("cpd_pred_pv"),
        )

    @cached_property
    def matrix(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("sig_id"), F.col("vec_id").alias("row_no"),
            F.col("embedding").alias("values"),
        )

    @cached_property
    def gappy(self) -> DataFrame:
        gap = F.transform(
            "values", lambda x, i: F.when((F.col("sig_id") * 7 + i) % 41 != 0, x.cast("double"))
        )
        return self.matrix.withColumn("values", gap)

    @cached_property
    def rowmeta(self) -> DataFrame:
        v = F.col("vec_id")
        return self.raw("embeddings").select(
            v.alias("sig_id"), F.concat(F.lit("CELL"), F.col("label").cast("string")).alias("cell_mfc_name"),
            F.when(v % 19 != 5, 1 + (v * 37 % 50) / F.lit(10.0)).alias("pert_dose"),
            F.when(v % 17 != 3, (v * 53 % 101) / F.lit(100.0)).alias("viability"),
        )

    @cached_property
    def genes(self) -> DataFrame:
        p = F.col("pos")
        space = F.when(p % 3 == 0, "landmark").when(p % 3 == 1, "best inferred").otherwise("inferred")
        return self.matrix.select(F.posexplode("values").alias("pos", "x")).select("pos").distinct().select(
            "pos", (p + 1000).alias("gene_id"), F.concat(F.lit("P"), p.cast("string")).alias("gene_symbol"),
            F.concat(F.lit("G"), F.floor(p / 2).cast("string")).alias("dup_symbol"),
            space.alias("feature_space"),
        )

    @cached_property
    def network(self) -> DataFrame:
        cells = self.raw("embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).select(
            "label", "pos").distinct()
        return cells.where((F.col("label") * 3 + F.col("pos") * 5) % 7 < 2).select(
            F.concat(F.lit("TF"), F.col("label").cast("string")).alias("source"),
            F.concat(F.lit("P"), F.col("pos").cast("string")).alias("target"),
            F.when((F.col("label") + F.col("pos")) % 2 == 0, 1.0).otherwise(-1.0).alias("weight"),
            (F.col("label") * 1000 + F.col("pos")).alias("row_no"),
        )

    @cached_property
    def ontology(self) -> DataFrame:
        def named(letter: str, c: str):
            return F.concat(F.lit(letter), F.col(c).cast("string"))

        n, c = self.raw("nation"), self.raw("customer")
        main = n.select(named("R", "n_regionkey").alias("parent"), named("N", "n_nationkey").alias("child"))
        second = n.where("n_nationkey % 4 = 0").select(
            F.concat(F.lit("R"), ((F.col("n_regionkey") + 1) % 5).cast("string")).alias("parent"),
            named("N", "n_nationkey").alias("child"),
        )
        leaf = c.select(named("N", "c_nationkey").alias("parent"), named("C", "c_custkey").alias("child"))
        return main.unionByName(second).withColumn("relationship", F.lit("is_a")).unionByName(
            leaf.withColumn("relationship", F.lit("gene"))
        )

    @cached_property
    def known_genes(self) -> DataFrame:
        rich = self.raw("customer").where("c_acctbal > 0")
        return rich.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"))

    @cached_property
    def history(self) -> DataFrame:
        e = self.raw("events").select(
            F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "ts", "event_id", "value"
        )
        ranked = blocked_row_number(
            e, ["run", "metric"], [F.col("ts"), F.col("event_id")], F.to_date("ts"), "step"
        )
        return ranked.select("run", "metric", "step", "value")

    @cached_property
    def predictions(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("sig_id"), F.col("l_returnflag").alias("grp"),
            F.col("l_linenumber").alias("run"), F.col("l_linestatus").alias("dataset"),
            F.col("l_extendedprice").alias("target"),
            (F.col("l_quantity") * 1500.0 + F.col("l_tax") * 20000.0).alias("prediction"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        i = F.col("event_id")
        return self.raw("events").select(
            i.alias("sample_id"), F.concat(F.lit("PL"), F.col("user_id").cast("string")).alias("det_plate"),
            F.when(F.col("event_type") == "error", "ctl_vehicle").otherwise("trt_cp").alias("pert_type"),
            F.when(F.col("value") < 90, 1.0).otherwise(0.0).alias("qc_pass"), F.col("value").alias("pert_dose"),
            F.when(i % 7 == 0, None).when(i % 5 == 0, "ng").otherwise("uM").alias("pert_dose_unit"),
        )

    @cached_property
    def structures(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("sig_id"), F.col("text").alias("smiles"),
            F.col("n_chars").cast("double").alias("dosage"),
        )

    @cached_property
    def order_rows(self) -> DataFrame:
        """One feature and one target per order, with the cell as group."""
        sums = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.sum("l_quantity").alias("x"), (F.sum("l_extendedprice") / 1000.0).alias("y")
        )
        cell = self.raw("orders").join(
            self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).select("o_orderkey", F.col("c_nationkey").alias("cell"))
        return sums.join(cell, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("sig_id"), "cell", "x", "y", F.array("x").alias("values")
        )


# The same tables as SQL; a query's text names the ones it needs.
VIEWS: dict[str, str] = {
    "siginfo": """
        SELECT o.o_orderkey AS sig_id, n.n_name AS cell_mfc_name, CAST(l.pk AS VARCHAR) AS pert_mfc_id,
               p.p_name || '|' || p.p_brand AS cmap_name, l.dose AS pert_dose,
               CASE WHEN o.o_orderstatus <> 'P' THEN 24.0::DOUBLE ELSE 6.0::DOUBLE END AS pert_time
        FROM (SELECT l_orderkey, min(l_partkey) AS pk, sum(l_quantity) AS dose FROM lineitem GROUP BY 1) l
        JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN part p ON p.p_partkey = l.pk""",
    "curves": """
        SELECT d.l_suppkey AS experiment_id, d.l_partkey AS master_cpd_id,
               CAST(p.p_size % 10 - 2 AS DOUBLE) AS p1_center, CAST(d.l_suppkey % 5 AS DOUBLE) + 0.5 AS p2_slope,
               CAST(d.l_partkey % 10 AS DOUBLE) / 20 AS p4_baseline
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d JOIN part p ON p.p_partkey = d.l_partkey""",
    "per_experiment": "SELECT s_suppkey AS experiment_id, s_nationkey AS master_ccl_id FROM supplier",
    "per_cell_line": "SELECT n_nationkey AS master_ccl_id, n_name AS ccl_name FROM nation",
    "per_compound": """
        SELECT p_partkey AS master_cpd_id, CAST(p_partkey AS VARCHAR) AS broad_cpd_id,
               p_name || '|' || p_brand AS cpd_name,
               p_type || CASE WHEN p_partkey % 7 = 0 THEN '(' ELSE '()' END || p_name AS cpd_smiles FROM part""",
    "concentrations": """
        SELECT l_suppkey AS experiment_id, l_partkey AS master_cpd_id, l_quantity AS cpd_conc_umol,
               l_discount AS cpd_pred_pv FROM lineitem""",
    "named_curves": """
        SELECT c.*, l.ccl_name, p.broad_cpd_id, p.cpd_name FROM curves c
        JOIN per_experiment e USING (experiment_id) JOIN per_cell_line l USING (master_ccl_id)
        JOIN per_compound p USING (master_cpd_id)""",
    "eligible": "SELECT * FROM siginfo WHERE pert_time = 24 AND pert_dose IS NOT NULL",
    "match_a": """
        SELECT s.sig_id, 1 AS strategy, s.cell_mfc_name, s.pert_dose, c.experiment_id, c.master_cpd_id,
               c.p1_center, c.p2_slope, c.p4_baseline
        FROM eligible s JOIN named_curves c ON c.ccl_name = s.cell_mfc_name AND c.broad_cpd_id = s.pert_mfc_id""",
    "match_b": """
        SELECT s.sig_id, 2 AS strategy, s.cell_mfc_name, s.pert_dose, c.experiment_id, c.master_cpd_id,
               c.p1_center, c.p2_slope, c.p4_baseline
        FROM eligible s JOIN named_curves c ON c.ccl_name = s.cell_mfc_name AND c.cpd_name = s.cmap_name
        WHERE s.sig_id NOT IN (SELECT sig_id FROM match_a)""",
    "matched": "SELECT * FROM match_a UNION ALL SELECT * FROM match_b",
    "evaluated": """
        SELECT *, p4_baseline + (1 - p4_baseline) / (1 + exp(greatest(-100, least(100,
               -(log2(pert_dose) - p1_center) / p2_slope)))) AS v FROM matched""",
    "sig_viability": """
        SELECT sig_id, min(strategy) AS strategy, min(cell_mfc_name) AS cell_mfc_name, min(pert_dose) AS pert_dose,
               greatest(0, least(1, avg(v))) AS viability, count(*) AS n_curves FROM evaluated GROUP BY sig_id""",
    "expr": """
        SELECT sig_id, CAST(pos AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x FROM (
        SELECT vec_id AS sig_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)""",
    "gaps": "SELECT sig_id, pos, CASE WHEN (sig_id * 7 + pos) % 41 <> 0 THEN x END AS x FROM expr",
    "rowmeta": """
        SELECT vec_id AS sig_id, 'CELL' || label AS cell_mfc_name,
               CASE WHEN vec_id % 19 <> 5 THEN 1 + CAST(vec_id * 37 % 50 AS DOUBLE) / 10 END AS pert_dose,
               CASE WHEN vec_id % 17 <> 3 THEN CAST(vec_id * 53 % 101 AS DOUBLE) / 100 END AS viability
        FROM embeddings""",
    "genes": """
        SELECT pos, pos + 1000 AS gene_id, 'P' || pos AS gene_symbol, 'G' || (pos // 2) AS dup_symbol,
               CASE pos % 3 WHEN 0 THEN 'landmark' WHEN 1 THEN 'best inferred' ELSE 'inferred' END AS feature_space
        FROM (SELECT DISTINCT pos FROM expr)""",
    "network": """
        SELECT 'TF' || label AS source, 'P' || pos AS target,
               CASE WHEN (label + pos) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight,
               label * 1000 + pos AS row_no
        FROM (SELECT DISTINCT e.label, x.pos FROM embeddings e JOIN expr x ON x.sig_id = e.vec_id)
        WHERE (label * 3 + pos * 5) % 7 < 2""",
    "ontology": """
        SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child, 'is_a' AS relationship FROM nation
        UNION ALL SELECT 'R' || ((n_regionkey + 1) % 5), 'N' || n_nationkey, 'is_a' FROM nation WHERE n_nationkey % 4 = 0
        UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'gene' FROM customer""",
    "known_genes": "SELECT 'C' || c_custkey AS node FROM customer WHERE c_acctbal > 0",
    "history": """
        SELECT user_id AS run, event_type AS metric, row_number() OVER
               (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, value FROM events""",
    "predictions": """
        SELECT l_orderkey AS sig_id, l_returnflag AS grp, l_linenumber AS run, l_linestatus AS dataset,
               l_extendedprice AS target, l_quantity * 1500.0::DOUBLE + l_tax * 20000.0::DOUBLE AS prediction
        FROM lineitem""",
    "samples": """
        SELECT event_id AS sample_id, 'PL' || user_id AS det_plate,
               CASE WHEN event_type = 'error' THEN 'ctl_vehicle' ELSE 'trt_cp' END AS pert_type,
               CASE WHEN value < 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS qc_pass, value AS pert_dose,
               CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'ng' ELSE 'uM' END AS pert_dose_unit
        FROM events""",
    "structures": "SELECT doc_id AS sig_id, text AS smiles, CAST(n_chars AS DOUBLE) AS dosage FROM documents",
    "order_rows": """
        SELECT l.l_orderkey AS sig_id, c.c_nationkey AS cell, l.x, l.y
        FROM (SELECT l_orderkey, sum(l_quantity) AS x, sum(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1) l
        JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey""",
}


def _needs(text: str, names: list[str]) -> list[str]:
    words = set(re.findall(r"[a-z_]+", text))
    return [n for n in names if n in words]


def with_views(sql: str) -> str:
    """The query with the views it names put in front, dependencies first."""
    names, ordered, seen = list(VIEWS), [], set()

    def visit(text: str) -> None:
        for n in _needs(text, names):
            if n not in seen:
                seen.add(n)
                visit(VIEWS[n])
                ordered.append(n)

    visit(sql)
    if not ordered:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:].strip()}"
    return f"WITH {head}\n{body}"
