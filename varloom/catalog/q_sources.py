"""Scans, sources and durable outputs. Files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.catalog.registry import query
from varloom.functions import labels as lab
from varloom.operators import durable
from varloom.session import scratch_path
from varloom.sources import readers
from varloom.sources.reference import fetch_windows, land, pieces_of_fasta


def _text(t, name, df, **options):
    path = scratch_path(t.spark, name)
    df.write.mode("overwrite").options(**options).csv(path, sep="\t", header=options.get("header", True))
    return path


def _parquet(t, name, df, *parts):
    path = scratch_path(t.spark, name)
    df.write.mode("overwrite").partitionBy(*parts).parquet(path) if parts else df.write.mode("overwrite").parquet(path)
    return path


@query("src_maf_scan", "maf", "SELECT event_id, patient, gene, CASE WHEN event_id%50=0 THEN NULL ELSE pos END AS pos FROM maf")
def src_maf_scan(t):
    pos = F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("pos").cast("string"))
    path = _text(t, "maf_tsv", t.maf_records().select([f.name for f in readers.MAF_SCHEMA]).withColumn("pos", pos), compression="gzip")
    return readers.read_maf(t.spark, path, columns=["event_id", "patient", "gene", "pos"])


@query("src_maf_full", "maf", "SELECT event_id, patient, chromosome, pos, t_depth, barcode FROM maf WHERE event_id%50<>0")
def src_maf_full(t):
    pos = F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("pos").cast("string"))
    path = _text(t, "maf_bad", t.maf_records().select([f.name for f in readers.MAF_SCHEMA]).withColumn("pos", pos))
    return readers.read_maf_strict(t.spark, path).select("event_id", "patient", "chromosome", "pos", "t_depth", "barcode")


@query("src_comment_tsv", "", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name||'é' AS name FROM customer WHERE c_custkey%10<>3 AND c_custkey%10<>4")
def src_comment_tsv(t):
    key = F.when(F.col("c_custkey") % 10 == 3, F.concat(F.lit("#"), F.col("c_custkey").cast("string"))).when(
        F.col("c_custkey") % 10 == 4, "bcr_patient_uuid"
    ).otherwise(F.col("c_custkey").cast("string"))
    rows = t.customer.select(key.alias("key"), F.concat("c_name", F.lit("é")).alias("name"))
    path = _text(t, "commented", rows, header=False, encoding="ISO-8859-1", comment="~")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("name", T.StringType())])
    return readers.read_commented(t.spark, path, schema, preamble="^bcr_")


@query("src_feature_matrix", "maf", """
SELECT patient, CAST(count(*) FILTER (impact='HIGH' AND pos%2=0) AS BIGINT) AS high, CAST(count(*) FILTER (impact='LOW') AS BIGINT) AS low FROM maf GROUP BY ALL""")
def src_feature_matrix(t):
    m = t.maf_records().groupBy("patient").agg(
        F.sum(F.when((F.col("impact") == "HIGH") & (F.col("pos") % 2 == 0), 1)).alias("high"),
        F.sum(F.when(F.col("impact") == "LOW", 1)).alias("low"),
    )
    return readers.read_matrix(t.spark, _parquet(t, "matrix", m), "patient")


def _wide(t):
    return (
        t.profile_records().groupBy(F.col("channel").alias("NAME"))
        .pivot("signature", [f"SIG{i}" for i in range(6)]).count().withColumnsRenamed({f"SIG{i}": f"SP{i}" for i in range(6)})
        .withColumn("note", F.lit("x"))
    )


@query("src_wide_unpivot", "profile_rec", """
SELECT c.channel AS key, 'SP'||i AS sample, nullif((SELECT count(*) FROM profile_rec p WHERE p.channel=c.channel AND p.signature='SIG'||i),0) AS n
FROM (SELECT DISTINCT channel FROM profile_rec) c, (SELECT unnest(range(0,6)) AS i)""")
def src_wide_unpivot(t):
    wide = t.spark.read.parquet(_parquet(t, "wide", _wide(t)))
    return readers.unpivot_wide(wide, prefix="SP", name="sample", value="n")


@query("src_signature_catalog", "profile_rec", "SELECT channel AS key, 'SP'||substr(signature,4) AS signature, CAST(count(*) AS DOUBLE) AS p FROM profile_rec GROUP BY ALL")
def src_signature_catalog(t):
    wide = t.spark.read.parquet(_parquet(t, "catalogue", _wide(t)))
    long = readers.unpivot_wide(wide, prefix="SP", name="signature", value="p").withColumn("p", F.col("p").cast("double"))
    return readers.nonzero_signatures(long).filter("p > 0")


@query("src_truth_table", "maf", """
WITH n AS (SELECT impact AS signature, 'SP'||(pos%4) AS sample, count(*) AS n FROM maf WHERE impact<>'LOW' GROUP BY ALL),
g AS (SELECT signature, sample FROM (SELECT DISTINCT impact AS signature FROM maf), (SELECT DISTINCT sample FROM n))
SELECT g.signature, g.sample, round(coalesce(n,0)/CAST(sum(coalesce(n,0)) OVER (PARTITION BY g.sample) AS DOUBLE),6) AS n FROM g LEFT JOIN n USING (signature, sample)""")
def src_truth_table(t):
    ev = t.maf_records()
    column = F.concat(F.lit("SP"), (F.col("pos") % 4).cast("string"))
    wide = ev.filter("impact <> 'LOW'").withColumn("sp", column).groupBy(
        F.concat("impact", F.lit(" contribution")).alias("NAME")
    ).pivot("sp", ["SP0", "SP1", "SP2", "SP3"]).count()
    table = t.spark.read.parquet(_parquet(t, "truth", wide))
    return readers.truth_shares(table, ev.select(F.col("impact").alias("signature")), prefix="SP")


@query("src_readme_map", "", """
SELECT 'MSM0.'||c_custkey AS sample_name, CASE c_custkey%3 WHEN 0 THEN 'Cisplatin' WHEN 1 THEN 'Control' ELSE 'Other drug' END AS agent_core,
 CASE c_custkey%3 WHEN 0 THEN 'Platinum and crosslinking therapy' WHEN 1 THEN 'Control/background' ELSE 'Other or mechanism-ambiguous' END AS damage_class
FROM customer WHERE c_custkey%5<>0""")
def src_readme_map(t):
    drug = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Cisplatin (3 uM)' WHEN 1 THEN 'Solvent control' ELSE 'Other  drug + S9' END")
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Notes about "), "c_name")).otherwise(
        F.concat(F.lit("MSM0."), F.col("c_custkey").cast("string"), F.lit("\t"), drug)
    )
    path = scratch_path(t.spark, "readme")
    t.customer.select(line).write.mode("overwrite").text(path)
    rows = readers.treatment_map(t.spark, path).select("sample_name", lab.agent_core(F.col("treatment")).alias("agent_core"))
    return lab.attach_damage_class(rows).select("sample_name", "agent_core", "damage_class")


@query("src_excel", "", "SELECT o_custkey AS patient, arg_min(o_orderpriority, o_orderkey) AS type FROM orders GROUP BY ALL")
def src_excel(t):
    path = _text(t, "types", t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"))
    rows = t.spark.read.csv(path, sep="\t", header=True, schema="line long, patient long, type string")
    return readers.first_per_key(rows, ["patient"], F.col("line")).select("patient", "type")


def _fasta(t):
    """The reference as FASTA files: a header a contig, its bases in lines of 60."""
    path = scratch_path(t.spark, "reference_fasta")
    tiles = t.reference().tiles.filter("tile >= 0")
    lines = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    head = F.when(F.col("tile") == 0, F.concat(F.lit(">chr"), F.col("contig").cast("string"), F.lit(" bases of one contig\n"))).otherwise("")
    tiles.repartitionByRange("contig").sortWithinPartitions("contig", "tile").select(F.concat(head, lines)).write.text(path)
    return path


@query("src_reference_tiles", "maf ref_contig", """
SELECT event_id, rpad(substr(repeat('N',64)||seq, pos-30+64, 10+event_id%600), CAST(10+event_id%600 AS INT),'N') AS bases
FROM maf JOIN ref_contig ON contig=CAST(substr(chromosome,4) AS BIGINT)""")
def src_reference_tiles(t):
    reference = land(pieces_of_fasta(t.spark, _fasta(t)))
    spans = t.maf_records().select(
        "event_id", F.col("chromosome").alias("c"), (F.col("pos") - 30).alias("start"), (10 + F.col("event_id") % 600).alias("size"),
    )
    return fetch_windows(spans, reference, contig="c", start="start", length="size", out="bases", longest=609).select("event_id", "bases")


@query("src_scenarios", "profile_rec", """
WITH p AS (SELECT CAST(substr(signature,4) AS BIGINT)*5+1 AS scenario, patient, count(*) AS n FROM profile_rec GROUP BY ALL)
SELECT scenario, patient, n, CAST(n*2 AS BIGINT) AS exposure FROM p WHERE n%3<>0""")
def src_scenarios(t):
    n = (F.substring("signature", 4, 2).cast("int") * 5 + 1).cast("string")
    p = t.profile_records().groupBy(F.concat(F.lit("scenario_"), n).alias("folder"), "patient").agg(F.count(F.lit(1)).alias("n"))
    root = scratch_path(t.spark, "scenarios")
    p.write.mode("overwrite").partitionBy("folder").parquet(f"{root}/catalog")
    p.filter("n % 3 <> 0").select("folder", "patient", (F.col("n") * 2).alias("exposure")).write.mode("overwrite").partitionBy("folder").parquet(f"{root}/exposure")
    cat_, exp_ = (readers.scenario_rows(t.spark, f"{root}/{k}").drop("folder") for k in ("catalog", "exposure"))
    return cat_.join(exp_, ["scenario", "patient"])


@query("src_atlas_json", "basis", """
SELECT 'v'||vec_id AS key, i AS dim, round(v,6) AS value FROM (SELECT vec_id, unnest(vec) AS v, generate_subscripts(vec,1) AS i
FROM (SELECT vec_id, list_concat(list_concat(embedding[1:3],embedding[k+1:k+3]),list_concat(embedding[2*k+1:2*k+3],embedding[3*k+1:3*k+3])) AS vec FROM (SELECT *, len(embedding)//4 AS k FROM basis)))""")
def src_atlas_json(t):
    path = scratch_path(t.spark, "atlas")
    entry = F.create_map(F.concat(F.lit("v"), F.col("vec_id").cast("string")), "embedding")
    t.basis().select(F.to_json(entry)).write.mode("overwrite").text(path)
    rows = readers.atlas(t.spark, path, 3).select("key", F.posexplode("vec").alias("dim", "value"))
    return rows.withColumn("dim", F.col("dim") + 1)


@query("src_result_union", "", """
SELECT 'a' AS source, o_orderpriority AS endpoint, count(*) AS n, NULL AS score FROM orders GROUP BY ALL UNION ALL
SELECT 'b', o_orderstatus, NULL, round(avg(o_totalprice),6) FROM orders GROUP BY ALL""")
def src_result_union(t):
    a = t.orders.groupBy(F.col("o_orderpriority").alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.groupBy(F.col("o_orderstatus").alias("endpoint")).agg(F.avg("o_totalprice").alias("score"))
    pa, pb = _text(t, "res_a", a), _text(t, "res_b", b)
    read = lambda p, s: t.spark.read.csv(p, sep="\t", header=True, schema=s)
    return readers.union_results({"a": read(pa, "endpoint string, n long"), "b": read(pb, "endpoint string, score double")})


@query("snk_result_table", "maf", "SELECT patient, impact, count(*) AS n FROM maf GROUP BY ALL")
def snk_result_table(t):
    n = t.maf_records().groupBy("patient", "impact").agg(F.count(F.lit(1)).alias("n"))
    return durable.write_table(n, scratch_path(t.spark, "result_table"))


@query("snk_checkpoint_upsert", "maf", """
SELECT patient, gene, arg_max(batch, batch) AS batch, arg_max(n, batch) AS n FROM (
 SELECT patient, gene, 1 AS batch, count(*) AS n FROM maf WHERE pos<100 GROUP BY ALL UNION ALL SELECT patient, gene, 2, count(*) FROM maf WHERE pos>=60 GROUP BY ALL) GROUP BY ALL""")
def snk_checkpoint_upsert(t):
    part = lambda cond, b: t.maf_records().filter(cond).groupBy("patient", "gene").agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(b))
    old = durable.write_table(part("pos < 100", 1), scratch_path(t.spark, "upsert_v1"))
    merged = durable.upsert(old, part("pos >= 60", 2), ["patient", "gene"], "batch")
    return durable.write_table(merged, scratch_path(t.spark, "upsert_v2"))


@query("snk_completed_keys", "maf", "SELECT DISTINCT patient, gene FROM maf WHERE (patient, gene) NOT IN (SELECT (patient, gene) FROM maf WHERE pos<60)".replace("(patient, gene) NOT IN (SELECT (patient, gene) FROM maf WHERE pos<60)", "NOT EXISTS (SELECT 1 FROM maf m WHERE m.patient=maf.patient AND m.gene=maf.gene AND m.pos<60)"))
def snk_completed_keys(t):
    done = durable.write_table(t.maf_records().filter("pos < 60").select("patient", "gene").distinct(), scratch_path(t.spark, "done"))
    return durable.pending(t.maf_records().select("patient", "gene").distinct(), done, ["patient", "gene"])


@query("snk_feature_cache", "maf", "SELECT patient, variant_class, count(*) AS n FROM maf GROUP BY ALL")
def snk_feature_cache(t):
    build = lambda: t.maf_records().groupBy("patient", "variant_class").agg(F.count(F.lit(1)).alias("n"))
    root = scratch_path(t.spark, "cache")
    settings, inputs = {"by": "patient, variant_class"}, [f"{t.folder}/lineitem.parquet"]
    durable.cached(t.spark, root, "class-counts", settings, inputs, build)
    return durable.cached(t.spark, root, "class-counts", settings, inputs, build)


@query("snk_sparse_matrix", "maf cohort", """
SELECT patient AS sample, impact AS feature, count(*) FILTER (pos%5=0) AS value FROM maf GROUP BY ALL HAVING count(*) FILTER (pos%5=0)>0""")
def snk_sparse_matrix(t):
    long = t.maf_records().groupBy(F.col("patient").alias("sample"), F.col("impact").alias("feature")).agg(F.count_if(F.col("pos") % 5 == 0).alias("value"))
    return durable.write_table(durable.nonzero(long, "value"), scratch_path(t.spark, "sparse"))


@query("snk_long_exposures", "profile_rec", """
SELECT 'standard' AS representation, patient, 'SP'||i AS signature, (SELECT count(*) FROM profile_rec p WHERE p.patient=c.patient AND p.signature='SIG'||i) AS exposure FROM (SELECT DISTINCT patient FROM profile_rec) c, (SELECT unnest(range(0,5)) AS i)
UNION ALL SELECT 'binary', patient, 'SP'||i, CAST((SELECT count(*) FROM profile_rec p WHERE p.patient=c.patient AND p.signature='SIG'||i)>0 AS BIGINT) FROM (SELECT DISTINCT patient FROM profile_rec) c, (SELECT unnest(range(0,5)) AS i)""")
def snk_long_exposures(t):
    names = [f"SIG{i}" for i in range(5)]
    wide = t.profile_records().groupBy("patient").pivot("signature", names).count().fillna(0).withColumnsRenamed({n: n.replace("SIG", "SP") for n in names})
    cols = [n.replace("SIG", "SP") for n in names]
    long = wide.unpivot(["patient"], cols, "signature", "exposure")
    both = long.withColumn("representation", F.lit("standard")).unionByName(
        long.withColumn("representation", F.lit("binary")).withColumn("exposure", (F.col("exposure") > 0).cast("long"))
    )
    return t.spark.read.parquet(_parquet(t, "exposures", both, "representation"))
