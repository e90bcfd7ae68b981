"""Filters, projections, column edits and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doselake import registry
from doselake.functions import chem, dose, text
from doselake.functions.ranking import global_row_number
from doselake.operators import select as P
from doselake.plans.catalog import cells, query, r
from doselake.plans.standins import Tables


@query("SELECT sig_id, cell_mfc_name, pert_dose FROM siginfo WHERE pert_time = 24 AND pert_dose IS NOT NULL")
def filter_signatures(t: Tables) -> DataFrame:
    return P.filter_signatures(t.siginfo).select("sig_id", "cell_mfc_name", "pert_dose")


@query("SELECT sample_id, det_plate, pert_dose FROM samples WHERE qc_pass = 1 AND pert_type = 'trt_cp'")
def filter_qc(t: Tables) -> DataFrame:
    return P.filter_qc(t.samples).select("sample_id", "det_plate", "pert_dose")


@query("""
SELECT e.sig_id, row_number() OVER (PARTITION BY e.sig_id ORDER BY e.pos) - 1 AS pos, round(e.x, 6) AS x
FROM expr e JOIN genes g USING (pos) WHERE g.feature_space = 'best inferred'""", ints=("pos",))
def select_genes(t: Tables) -> DataFrame:
    return cells(P.select_genes(t.matrix, t.genes, "best inferred"))


@query("""
SELECT e.sig_id, row_number() OVER (PARTITION BY e.sig_id ORDER BY e.pos) - 1 AS pos, round(e.x, 6) AS x
FROM expr e JOIN genes g USING (pos) WHERE g.feature_space IN ('landmark', 'best inferred')""", ints=("pos",))
def select_genes_cumulative(t: Tables) -> DataFrame:
    return cells(P.select_genes(t.matrix, t.genes, "best inferred", mode="cumulative"))


@query("SELECT e.sig_id, g.gene_symbol, round(e.x, 6) AS x FROM expr e JOIN genes g USING (pos) WHERE g.feature_space = 'landmark'")
def landmark_view(t: Tables) -> DataFrame:
    m, names = P.landmark_view(t.matrix, t.genes)
    return cells(m).join(names, "pos").select("sig_id", "gene_symbol", "x")


@query("SELECT sig_id, pos, round(x, 6) AS x FROM expr WHERE sig_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100)")
def take_rows(t: Tables) -> DataFrame:
    return cells(P.take_rows(t.matrix, 100))


@query("""
SELECT sig_id, m.cell_mfc_name, m.pert_dose FROM rowmeta m
WHERE m.pert_dose IS NOT NULL AND m.viability IS NOT NULL
  AND sig_id NOT IN (SELECT sig_id FROM expr WHERE (sig_id * 7 + pos) % 331 = 0)""")
def drop_incomplete(t: Tables) -> DataFrame:
    # sparser gaps than elsewhere, or no row would be complete
    gap = F.transform("values", lambda x, i: F.when((F.col("sig_id") * 7 + i) % 331 != 0, x))
    rows = t.matrix.withColumn("values", gap).join(t.rowmeta, "sig_id")
    return P.drop_incomplete(rows, ["pert_dose", "viability"]).select("sig_id", "cell_mfc_name", "pert_dose")


@query("SELECT sig_id, smiles FROM structures WHERE smiles IS NOT NULL AND len(smiles) > 0")
def drop_invalid_structure(t: Tables) -> DataFrame:
    return P.drop_invalid_structure(t.structures, "smiles").select("sig_id", "smiles")


@query("""
SELECT sample_id,
  CASE WHEN pert_type = 'ctl_vehicle' OR pert_dose_unit IS NULL OR pert_dose_unit <> 'uM' THEN 0 ELSE pert_dose END AS pert_dose,
  'uM' AS pert_dose_unit FROM samples""")
def normalise_dose_units(t: Tables) -> DataFrame:
    return P.normalise_dose_units(t.samples, F.col("pert_type") == "ctl_vehicle").select(
        "sample_id", "pert_dose", "pert_dose_unit"
    )


@query("SELECT experiment_id, cpd_conc_umol AS pert_dose, cpd_pred_pv AS viability_score FROM concentrations")
def rename_for_match(t: Tables) -> DataFrame:
    return P.rename_for_match(t.concentrations).select("experiment_id", "pert_dose", "viability_score")


@query("SELECT sig_id, cell_mfc_name, 1 AS viability FROM siginfo")
def add_constant(t: Tables) -> DataFrame:
    return P.add_constant(t.siginfo.select("sig_id", "cell_mfc_name"), "viability", 1)


@query("""
SELECT e.sig_id, e.pos, round(e.x, 6) AS x, m.viability, m.cell_mfc_name, m.pert_dose
FROM expr e JOIN rowmeta m USING (sig_id)""")
def merge_target(t: Tables) -> DataFrame:
    long = cells(P.merge_target(t.matrix, t.rowmeta))
    return long.join(t.rowmeta, "sig_id").select("sig_id", "pos", "x", "viability", "cell_mfc_name", "pert_dose")


@query("""
SELECT l_partkey AS gene_id, coalesce(g.gene_symbol, 'Gene_' || l_partkey) AS gene_symbol
FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN genes g ON g.gene_id = l_partkey""")
def gene_symbols(t: Tables) -> DataFrame:
    ids = t.raw("lineitem").select(F.col("l_partkey").alias("gene_id")).distinct()
    return P.gene_symbols(ids, t.genes).select("gene_id", "gene_symbol")


@query("SELECT g.sig_id, n.dup_symbol AS gene_symbol, round(avg(g.x), 6) AS x FROM gaps g JOIN genes n USING (pos) GROUP BY 1, 2")
def collapse_duplicate_genes(t: Tables) -> DataFrame:
    m, names = P.collapse_duplicate_genes(t.gappy, t.genes.drop("gene_symbol").withColumnRenamed("dup_symbol", "gene_symbol"))
    return cells(m).join(names, "pos").select("sig_id", "gene_symbol", "x")


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(1, l_extendedprice / 50000 - 0.2::DOUBLE)) AS viability FROM lineitem")
def clip_viability(t: Tables) -> DataFrame:
    v = F.col("l_extendedprice") / 50000 - F.lit(0.2)
    return P.clip_viability(t.raw("lineitem").select("l_orderkey", "l_linenumber", v.alias("viability")))


@query("SELECT sig_id, cmap_name, pert_time FROM siginfo")
def drop_columns(t: Tables) -> DataFrame:
    return P.drop_columns(t.siginfo, ["cell_mfc_name", "pert_dose", "pert_mfc_id"])


@query("SELECT sig_id, pos, round(coalesce(x, 0), 6) AS x FROM gaps")
def fill_zero(t: Tables) -> DataFrame:
    return cells(P.fill_zero(t.gappy, "values"))


def _count_sql(parts: list[str] | None) -> str:
    if parts is None:
        return "len(smiles)"
    return " + ".join(f"(len(smiles) - len(replace(smiles, '{p}', ''))) // {len(p)}" for p in parts)


def _array_sql(spec: list) -> str:
    return "[" + ", ".join(f"CAST({_count_sql(p)} AS DOUBLE)" for p in spec) + "]"


def _view_sql(values: str, columns: str) -> str:
    return f"""
WITH s AS (SELECT e.vec_id AS sig_id, CAST(e.embedding AS DOUBLE[]) AS genes, m.pert_dose AS dosage, m.viability,
  list_append({_array_sql(chem.BASIC_COUNTS)}, m.pert_dose) AS molecular
  FROM embeddings e JOIN rowmeta m ON m.sig_id = e.vec_id JOIN structures d ON d.sig_id = e.vec_id),
u AS (SELECT sig_id, unnest(range(len({values}))) AS pos, unnest({values}) AS x, dosage, viability FROM s)
SELECT sig_id, pos, round(x, 6) AS x, {columns} FROM u"""


def _view_cells(view: DataFrame, values: Column, *columns: str) -> DataFrame:
    """Every value a sample of the view holds."""
    long = view.select("sig_id", *columns, F.posexplode_outer(values.cast("array<double>")).alias("pos", "x"))
    return long.select("sig_id", "pos", r("x"), *[c.split(".")[-1] for c in columns])


def _samples(t: Tables) -> DataFrame:
    base = t.matrix.join(t.rowmeta, "sig_id").join(t.structures.select("sig_id", "smiles"), "sig_id")
    return base.select(
        "sig_id", F.col("values").alias("transcriptomics"),
        chem.basic_descriptors(F.col("smiles"), F.col("pert_dose")).alias("molecular"),
        F.col("pert_dose").alias("dosage"), "viability",
    )


@query(_view_sql("list_concat(genes, molecular)", "dosage, viability"), ints=("pos",))
def multimodal_view(t: Tables) -> DataFrame:
    both = F.concat(F.col("sample.transcriptomics").cast("array<double>"), F.col("sample.molecular"))
    return _view_cells(P.multimodal_view(_samples(t)), both, "sample.dosage", "sample.viability")


@query(_view_sql("genes", "viability"), ints=("pos",))
def transcriptomics_view(t: Tables) -> DataFrame:
    return _view_cells(P.transcriptomics_view(_samples(t)), F.col("sample.transcriptomics"), "sample.viability")


@query(_view_sql("molecular", "dosage, viability"), ints=("pos",))
def chemical_view(t: Tables) -> DataFrame:
    return _view_cells(P.chemical_view(_samples(t)), F.col("sample.molecular"), "sample.dosage", "sample.viability")


@query("""
SELECT experiment_id, master_cpd_id,
  round(p4_baseline + (1 - p4_baseline) / (1 + exp(greatest(-100, least(100, -(3.5::DOUBLE - p1_center) / p2_slope)))), 6) AS clipped,
  round(p4_baseline + (1 - p4_baseline) / (1 + exp(-(3.5::DOUBLE - p1_center) / p2_slope)), 6) AS plain FROM curves""")
def sig3upper(t: Tables) -> DataFrame:
    p = [F.col(c) for c in ("p1_center", "p2_slope", "p4_baseline")]
    return t.curves.select(
        "experiment_id", "master_cpd_id",
        r(dose.sig3upper(*p, F.lit(3.5))).alias("clipped"), r(dose.sig3upper(*p, F.lit(3.5), clip=False)).alias("plain"),
    )


@query("""
SELECT event_id, CASE WHEN value - 30 > 0 THEN round(log2(value - 30), 6) END AS dose_log2 FROM events""")
def log2_dose(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", r(dose.log2_dose(F.col("value") - 30)).alias("dose_log2"))


VALID_SQL = """len(smiles) >= 2 AND len(replace(smiles, '(', '')) = len(replace(smiles, ')', ''))
  AND len(replace(smiles, '[', '')) = len(replace(smiles, ']', '')) AND NOT contains(smiles, '1PS')"""


@query(f"""
SELECT sig_id, unnest(range(11)) AS pos, unnest(list_append({_array_sql(chem.BASIC_COUNTS)}, dosage)) AS x FROM structures""", ints=("pos",))
def basic_descriptors(t: Tables) -> DataFrame:
    f = chem.basic_descriptors(F.col("smiles"), F.col("dosage")).alias("values")
    return t.structures.select("sig_id", F.posexplode_outer(f).alias("pos", "x"))


@query(f"""
SELECT sig_id, unnest(range(64)) AS pos,
       unnest(list_concat({_array_sql(chem.ROBUST_COUNTS)}, [0.0::DOUBLE FOR i IN range(42)], [dosage])) AS x
FROM structures WHERE {VALID_SQL}""", ints=("pos",))
def robust_descriptors(t: Tables) -> DataFrame:
    d = chem.robust_descriptors(t.structures, "sig_id", "smiles", "dosage")
    return d.select("sig_id", F.posexplode_outer("features").alias("pos", "x"))


@query(f"SELECT sig_id, CAST({VALID_SQL} AS INTEGER) AS valid FROM structures")
def is_valid_structure(t: Tables) -> DataFrame:
    return t.structures.select("sig_id", chem.is_valid_structure(F.col("smiles")).cast("int").alias("valid"))


@query("""
WITH tok AS (SELECT p_partkey, regexp_extract_all(p_name || ' ' || p_brand, '[a-z]+|[A-Z]|#|[0-9]+') AS ts FROM part),
vocab AS (SELECT tk, row_number() OVER (ORDER BY tk) AS id FROM (SELECT DISTINCT unnest(ts) AS tk FROM tok)),
flat AS (SELECT p_partkey, unnest(ts) AS tk, unnest(range(len(ts))) AS pos FROM tok),
grid AS (SELECT p_partkey, unnest(range(8)) AS pos FROM part)
SELECT g.p_partkey, g.pos, coalesce(v.id, 0) AS token_id, CASE WHEN f.tk IS NULL THEN 0 ELSE 1 END AS mask
FROM grid g LEFT JOIN flat f ON f.p_partkey = g.p_partkey AND f.pos = g.pos LEFT JOIN vocab v ON v.tk = f.tk""", ints=("pos", "token_id"))
def tokenize_fixed(t: Tables) -> DataFrame:
    pattern = "[a-z]+|[A-Z]|#|[0-9]+"
    names = t.raw("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("s"))
    tokens = names.select(F.explode(F.regexp_extract_all("s", F.lit(pattern), F.lit(0))).alias("token")).distinct()
    vocabulary = global_row_number(tokens, ["token"], "id")
    out = chem.tokenize_fixed(names, "s", vocabulary, 8, pattern)
    both = F.arrays_zip("token_ids", "mask")
    return out.select("p_partkey", F.posexplode_outer(both).alias("pos", "_c")).select(
        "p_partkey", "pos", F.col("_c.token_ids").alias("token_id"), F.col("_c.mask").alias("mask")
    )


ALPHABET = " ?abcdefghijklmnopqrstuvwxyz0123456789:/.-_"


@query(f"""
WITH m AS (SELECT max(len(url)) AS n FROM pages),
g AS (SELECT page_id, url, unnest(range((SELECT n FROM m))) AS pos FROM pages)
SELECT page_id, pos, CASE WHEN pos >= len(url) THEN 0
  WHEN instr('{ALPHABET}', substr(url, CAST(pos AS INTEGER) + 1, 1)) > 0
  THEN instr('{ALPHABET}', substr(url, CAST(pos AS INTEGER) + 1, 1)) - 1 ELSE 1 END AS char_id FROM g""", ints=("pos", "char_id"))
def char_indices(t: Tables) -> DataFrame:
    out = chem.char_indices(t.raw("pages").select("page_id", "url"), "url", ALPHABET)
    return out.select("page_id", F.posexplode_outer("char_ids").alias("pos", "char_id"))


RUN_KEYS = """
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'broken_key' ELSE
    CASE WHEN user_id % 2 = 0 THEN 'Alpha' ELSE 'Beta' END || '_min_n_' || (user_id % 20) || '_' || upper(event_type)
  END AS k, value FROM events"""


def _run_keys(t: Tables) -> DataFrame:
    u = F.col("user_id")
    key = F.concat(
        F.when(u % 2 == 0, "Alpha").otherwise("Beta"), F.lit("_min_n_"),
        (u % 20).cast("string"), F.lit("_"), F.upper("event_type"),
    )
    return t.raw("events").select(
        "event_id", F.when(F.col("event_id") % 11 == 0, "broken_key").otherwise(key).alias("k"), "value"
    )


@query(f"""
SELECT event_id, lower(regexp_extract(k, '^(\\w+)_min_n_(\\d+)_(\\w+)$', 1)) AS network,
  CAST(regexp_extract(k, '^(\\w+)_min_n_(\\d+)_(\\w+)$', 2) AS INTEGER) AS min_n,
  lower(regexp_extract(k, '^(\\w+)_min_n_(\\d+)_(\\w+)$', 3)) AS algorithm
FROM ({RUN_KEYS}) WHERE regexp_matches(k, '^(\\w+)_min_n_(\\d+)_(\\w+)$')""")
def parse_run_key(t: Tables) -> DataFrame:
    return text.parse_run_key(_run_keys(t), "k").select("event_id", "network", "min_n", "algorithm")


@query(f"SELECT event_id, TRY_CAST(split_part(k, '_', 4) AS INTEGER) AS min_n FROM ({RUN_KEYS}) WHERE TRY_CAST(split_part(k, '_', 4) AS INTEGER) IS NOT NULL")
def parse_threshold(t: Tables) -> DataFrame:
    return text.parse_threshold(_run_keys(t), "k").select("event_id", "min_n")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x FROM events")
def to_numeric_or_null(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return t.raw("events").select("event_id", text.to_numeric_or_null(raw).alias("x"))


@query("""
SELECT event_id, 'train/loss' AS metric, value FROM events
UNION ALL SELECT event_id, 'props/k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def flatten_metrics(t: Tables) -> DataFrame:
    record = F.concat(
        F.lit('{"train":{"loss":'), F.col("value").cast("string"), F.lit(',"note":"'), F.col("event_type"),
        F.lit('"},"props":'), F.col("props"), F.lit("}"),
    )
    return text.flatten_metrics(t.raw("events").select("event_id", record.alias("j")), ["event_id"], "j")


@query("SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') AS name FROM pages")
def safe_name(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query("SELECT doc_id, text AS decoded FROM documents")
def decode_text(t: Tables) -> DataFrame:
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFE")))
    return t.raw("documents").select("doc_id", text.decode_text(broken).alias("decoded"))


GRAMS = """
SELECT sig_id, CAST({size} + 1 AS INTEGER) AS width, list_sort(list_distinct(list_transform(
    CASE WHEN len(smiles) >= {n} THEN range(1, len(smiles) - {n} + 2) ELSE [] END,
    lambda i: CAST(CAST('0x' || substr(md5(substr(smiles, CAST(i AS INTEGER), {n})), 1, 8) AS BIGINT) % {size} AS INTEGER)))) AS bits, dosage
FROM structures WHERE len(trim(smiles, ' ')) > 0"""


@query(GRAMS.format(size=256, n=4))
def create_features(t: Tables) -> DataFrame:
    return _bits(registry.create_features("fingerprint", size=256, n=4)(t.structures, "sig_id", "smiles", "dosage"))


@query(GRAMS.format(size=1024, n=3))
def fingerprint_ngrams(t: Tables) -> DataFrame:
    return _bits(chem.fingerprint_ngrams(t.structures, "smiles", "dosage"))


def _bits(f: DataFrame) -> DataFrame:
    bits = F.filter(F.sequence(F.lit(0), F.size("features") - 2), lambda i: F.get("features", i) == 1)
    return f.select("sig_id", F.size("features").alias("width"), bits.alias("bits"), F.element_at("features", -1).alias("dosage"))
