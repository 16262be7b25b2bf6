"""Access to the given parquet tables and the event-shaped views built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.joins import hinted
from varloom.sources.reference import Reference, fetch_windows, land, pieces_of_text

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES26 = "ACGTACGTACGTACGTACGTACGTAC"
#: Longest allele of the event view.
ALLELE = 6


class Tables:
    """The parquet tables of one folder, plus views that stand in for mutation data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._reference: Reference | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- reference sequence ------------------------------------------------------------
    def reference(self) -> Reference:
        """The letters of all documents as bases, landed once as stored tiles for this object's queries."""
        if self._reference is None:
            bases = dict(zip(LETTERS + LETTERS.lower(), 2 * BASES26, strict=True))
            self._reference = land(pieces_of_text(self.documents, "doc_id", "text", bases), aligned=True)
        return self._reference

    def contig_sizes(self) -> DataFrame:
        """(contig, size): number of bases of every contig, where no sequence is needed."""
        return self.documents.select(F.col("doc_id").alias("contig"), F.length(F.regexp_replace("text", "[^A-Za-z]+", "")).cast("long").alias("size"))

    def on_contigs(self, rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
        """Add ``contig``: parts are dealt to all contigs by the remainder of their key. One broadcast row."""
        last = self.documents.agg(F.max("doc_id").alias("_contigs")) if sizes is None else sizes.agg(F.max("contig").alias("_contigs"))
        return rows.crossJoin(F.broadcast(last)).withColumn("contig", F.col("l_partkey") % (F.col("_contigs") + 1)).drop("_contigs")

    def located(self, sizes: DataFrame) -> DataFrame:
        """Line items with contig and position: anywhere on the contig, 15 bases from its ends if it has that many."""
        place = F.lit(15) + F.round(F.col("l_extendedprice") * 100).cast("long") % F.greatest(F.lit(1), F.col("size") - 30)
        return self.on_contigs(self.lineitem, sizes).join(sizes, "contig").withColumn("pos", place)

    def ref_tiles(self, tile: int = 64) -> DataFrame:
        return self.reference().cut(tile)

    # -- mutation events ---------------------------------------------------------------
    def located_events(self) -> DataFrame:
        """The line items that are events, with contig and position."""
        return self.located(self.reference().sizes())

    def event_places(self) -> DataFrame:
        """(patient, chromosome, pos) of ``events_maf`` without a lookup, where the reference has each tile once."""
        return self.located_events().select(
            F.concat(F.lit("TCGA-"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0")).alias("patient"),
            F.concat(F.lit("chr"), F.col("contig").cast("string")).alias("chromosome"), F.col("pos").cast("long").alias("pos"),
        )

    def events_maf(self) -> DataFrame:
        """Events with alleles of at most ``ALLELE`` bases. Nothing is stored: alleles are generated rows, so expressions over
        them do not repeat how they were made, and a filter on them stays above the lookup."""
        base = self.located_events().select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
            "l_suppkey",
            "contig",
            "pos",
            F.col("l_quantity").cast("int").alias("q"),
            F.col("l_partkey").alias("pk"),
            F.col("l_linenumber").alias("ln"),
            F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
            "l_returnflag",
            "l_linestatus",
            F.lit(ALLELE).alias("span"),
        )
        typed = fetch_windows(base, self.reference(), contig="contig", start="pos", length="span", longest=ALLELE)
        typed = typed.withColumns(
            {
                "patient": F.concat(F.lit("TCGA-"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0")),
                "variant_class": F.concat("l_returnflag", "l_linestatus"),
                "kind": F.expr(
                    "CASE q % 10 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DNP' ELSE 'SNP' END"
                ),
                "len": F.floor(F.col("q") / 10).cast("int") + 1,
                "seq": F.rtrim("window", F.lit("N")),
            }
        )
        alleles = F.struct(
            F.col("kind").alias("variant_type"),
            F.expr(
                "CASE WHEN ln = 7 THEN 'A' WHEN kind = 'INS' THEN '-' "
                "WHEN kind = 'DEL' THEN substr(seq, 1, len) "
                "WHEN kind = 'DNP' THEN substr(seq, 1, 2) ELSE substr(seq, 1, 1) END"
            ).alias("ref"),
            F.expr(
                "CASE WHEN kind = 'DEL' THEN '-' "
                "WHEN kind = 'INS' THEN substr('ACGTTGCA', cast(pk % 3 as int) + 1, len) "
                "WHEN kind = 'DNP' THEN translate(substr(seq, 1, 2), 'ACGT', 'CATG') "
                "WHEN pk % 3 = 0 THEN translate(substr(seq, 1, 1), 'ACGT', 'CGTA') "
                "WHEN pk % 3 = 1 THEN translate(substr(seq, 1, 1), 'ACGT', 'GTAC') "
                "ELSE translate(substr(seq, 1, 1), 'ACGT', 'TACG') END"
            ).alias("alt"),
        )
        typed = typed.select("event_id", "patient", "contig", "pos", "variant_class", "q", "ln", "disc", F.inline(F.array(alleles)))
        return typed.select(
            "event_id",
            "patient",
            F.concat("patient", F.when(F.col("ln") % 5 == 0, "-11A").otherwise("-01A")).alias("barcode"),
            F.concat(F.lit("chr"), F.col("contig").cast("string")).alias("chromosome"),
            F.col("pos").cast("long").alias("pos"),
            "variant_type",
            "ref",
            "alt",
            F.concat(F.lit("G"), F.col("contig").cast("string")).alias("gene"),
            "variant_class",
            F.expr(
                "CASE ln % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END"
            ).alias("impact"),
            (F.col("q") + 10 * (F.col("ln") % 3)).cast("long").alias("t_depth"),
            F.col("disc").cast("long").alias("t_alt_count"),
        )

    def maf_records(self) -> DataFrame:
        """The same events without sequence-derived columns: no reference join in the plan."""
        return self.located(hinted(self.contig_sizes())).select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
            F.concat(F.lit("TCGA-"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0")).alias("patient"),
            F.when(F.col("l_linenumber") % 5 == 0, "-11A").otherwise("-01A").alias("suffix"),
            F.concat(F.lit("chr"), F.col("contig").cast("string")).alias("chromosome"),
            "pos",
            F.expr(
                "CASE cast(l_quantity as int) % 10 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' "
                "WHEN 2 THEN 'DNP' ELSE 'SNP' END"
            ).alias("variant_type"),
            F.concat(F.lit("G"), F.col("contig").cast("string")).alias("gene"),
            F.concat("l_returnflag", "l_linestatus").alias("variant_class"),
            F.expr(
                "CASE l_linenumber % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' "
                "ELSE 'MODIFIER' END"
            ).alias("impact"),
            (F.col("l_quantity").cast("int") + 10 * (F.col("l_linenumber") % 3)).cast("long").alias("t_depth"),
            F.round(F.col("l_discount") * 100).cast("long").alias("t_alt_count"),
        ).withColumn("barcode", F.concat("patient", "suffix")).drop("suffix")

    # -- labels, predictions, dimensions ----------------------------------------------
    def cohort(self) -> DataFrame:
        return self.supplier.select(
            F.concat(F.lit("TCGA-"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("patient"),
            F.col("s_acctbal").alias("y_cont"),
            (F.col("s_acctbal") >= 5000).cast("int").alias("y_bin"),
            (F.col("s_nationkey") % 5).alias("y_class"),
            F.col("s_nationkey").alias("y_group"),
        )

    def preds(self) -> DataFrame:
        return self.labels.join(self.documents.select("doc_id", "n_chars", "lang", "source"), "doc_id").select(
            "doc_id",
            F.col("quality").cast("int").alias("y"),
            ((F.col("doc_id") * 37) % 101 / 100.0).alias("a"),
            ((F.col("n_chars") % 97) / 96.0).alias("b"),
            "lang",
            "source",
        )

    def basis(self) -> DataFrame:
        return self.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")

    def vector_orders(self) -> DataFrame:
        """Orders with ``vec_id``, dealt to all vectors of the basis. One broadcast row."""
        n = self.embeddings.agg(F.count("*").alias("_vectors"))
        return self.orders.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("o_orderkey") % F.col("_vectors")).drop("_vectors")

    def sets(self) -> DataFrame:
        """Overlapping gene sets over the genes that occur in the events."""
        k = F.substring("gene", 2, 10).cast("int")
        i = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")
        genes = self.on_contigs(self.lineitem).select(F.concat(F.lit("G"), F.col("contig").cast("string")).alias("gene"))
        return (
            genes.distinct().select("gene", k.alias("k"), i)
            .filter((F.col("k") % 7 == F.col("i")) | (F.col("k") % 5 == F.col("i")))
            .select(F.concat(F.lit("S"), F.col("i").cast("string")).alias("gene_set"), "gene")
        )

    # -- channel profiles: a small channel universe counted per patient and per signature ----
    def profile_records(self) -> DataFrame:
        return self.maf_records().select(
            "event_id", "patient", F.concat_ws("_", "variant_class", "variant_type").alias("channel"),
            F.concat(F.lit("SIG"), (F.substring("gene", 2, 9).cast("int") % 5).cast("string")).alias("signature"),
        )

    def sample_counts(self) -> DataFrame:
        return self.profile_records().groupBy("patient", "channel").agg(F.count(F.lit(1)).alias("n"))

    def signature_reference(self) -> DataFrame:
        n = self.profile_records().groupBy("signature", "channel").agg(F.count(F.lit(1)).alias("n"))
        total = n.groupBy("signature").agg(F.sum("n").alias("total"))
        return n.join(total, "signature").select("signature", "channel", (F.col("n") / F.col("total")).alias("p"))
