"""The test views as DuckDB SQL, so every registered query can be checked side by side."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def clean(c: str) -> str:
    up = f"upper(trim(coalesce({c},'')))"
    return f"CASE WHEN {up} IN ('','-','.','NAN','NONE') THEN '' ELSE regexp_replace({up},'[^ACGT]','','g') END"


def rc(c: str) -> str:
    return f"reverse(translate(upper({c}),'ACGTN','TGCAN'))"


def prefix_len(a: str, b: str) -> str:
    return f"list_max(list_filter(range(0, least(length({a}),length({b}))+1), lambda k: left({a},k)=left({b},k)))"


def flank(start: str, size: str) -> str:
    """Bases start..start+size-1 of ``seq`` with N outside; start may reach 64 below 1."""
    return f"rpad(substr(repeat('N',64)||seq, CAST({start}+64 AS BIGINT), CAST({size} AS BIGINT)), CAST({size} AS INT), 'N')"


VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (needs.split(), sql)


view("ref_contig", "", f"""
SELECT doc_id AS contig,
       translate(upper(regexp_replace(text,'[^A-Za-z]','','g')),'{_LETTERS}','{_BASES}') AS seq
FROM documents""")

view("contig_sizes", "", "SELECT doc_id AS contig, length(regexp_replace(text,'[^A-Za-z]','','g')) AS size FROM documents")

view("ref_tiles", "ref_contig", """
SELECT contig, t AS tile, substr(seq, t*64+1, 64) AS seq
FROM (SELECT contig, seq, unnest(range(0, CAST(ceil(length(seq)/64.0) AS BIGINT))) AS t FROM ref_contig)""")

view("events_maf", "ref_contig", """
SELECT event_id, patient, concat(patient,suffix) AS barcode, concat('chr',CAST(contig AS VARCHAR)) AS chromosome,
  pos, variant_type,
  CASE WHEN ln=7 THEN 'A' WHEN variant_type='INS' THEN '-' WHEN variant_type='DEL' THEN substr(seq,pos,len)
       WHEN variant_type='DNP' THEN substr(seq,pos,2) ELSE substr(seq,pos,1) END AS ref,
  CASE WHEN variant_type='DEL' THEN '-'
       WHEN variant_type='INS' THEN substr('ACGTTGCA',CAST(pk % 3 AS INT)+1,len)
       WHEN variant_type='DNP' THEN translate(substr(seq,pos,2),'ACGT','CATG')
       ELSE translate(substr(seq,pos,1),'ACGT', CASE pk % 3 WHEN 0 THEN 'CGTA' WHEN 1 THEN 'GTAC' ELSE 'TACG' END)
  END AS alt,
  concat('G',CAST(contig AS VARCHAR)) AS gene, vc AS variant_class,
  CASE ln % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END AS impact,
  CAST(q + 10*(ln % 3) AS BIGINT) AS t_depth, CAST(disc AS BIGINT) AS t_alt_count
FROM (
  SELECT b.*, r.seq, 15 + cents % greatest(1, length(r.seq) - 30) AS pos, CASE q % 10 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DNP' ELSE 'SNP' END AS variant_type,
         CAST(floor(q/10) AS INT)+1 AS len
  FROM (SELECT l_orderkey*10+l_linenumber AS event_id, concat('TCGA-',lpad(CAST(l_suppkey AS VARCHAR),7,'0')) AS patient,
          CASE WHEN l_linenumber % 5 = 0 THEN '-11A' ELSE '-01A' END AS suffix, l_partkey % (SELECT max(doc_id)+1 FROM documents) AS contig,
          CAST(ROUND(l_extendedprice*100) AS BIGINT) AS cents, CAST(l_quantity AS INT) AS q, l_partkey AS pk,
          l_linenumber AS ln, CAST(ROUND(l_discount*100) AS INT) AS disc, concat(l_returnflag,l_linestatus) AS vc
        FROM lineitem) b JOIN ref_contig r ON b.contig=r.contig)""")

view("maf", "contig_sizes", """
SELECT l_orderkey*10+l_linenumber AS event_id, concat('TCGA-',lpad(CAST(l_suppkey AS VARCHAR),7,'0')) AS patient,
  concat('TCGA-',lpad(CAST(l_suppkey AS VARCHAR),7,'0'), CASE WHEN l_linenumber % 5 = 0 THEN '-11A' ELSE '-01A' END) AS barcode,
  concat('chr',CAST(contig AS VARCHAR)) AS chromosome, 15 + CAST(ROUND(l_extendedprice*100) AS BIGINT) % greatest(1, size - 30) AS pos,
  CASE CAST(l_quantity AS INT) % 10 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DNP' ELSE 'SNP' END AS variant_type,
  concat('G',CAST(contig AS VARCHAR)) AS gene, concat(l_returnflag,l_linestatus) AS variant_class,
  CASE l_linenumber % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END AS impact,
  CAST(CAST(l_quantity AS INT) + 10*(l_linenumber % 3) AS BIGINT) AS t_depth, CAST(ROUND(l_discount*100) AS BIGINT) AS t_alt_count
FROM lineitem JOIN contig_sizes ON contig = l_partkey % (SELECT max(doc_id)+1 FROM documents)""")

view("cohort", "", """
SELECT concat('TCGA-',lpad(CAST(s_suppkey AS VARCHAR),7,'0')) AS patient, s_acctbal AS y_cont,
  CAST(s_acctbal>=5000 AS INT) AS y_bin, s_nationkey % 5 AS y_class, s_nationkey AS y_group FROM supplier""")

view("preds", "", """
SELECT l.doc_id, CAST(l.quality AS INT) AS y, ((l.doc_id*37)%101)/100.0::DOUBLE AS a, (d.n_chars%97)/96.0::DOUBLE AS b,
       d.lang, d.source
FROM labels l JOIN documents d ON l.doc_id=d.doc_id""")

view("basis", "", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings")

view("sets", "", """
SELECT concat('S',CAST(i AS VARCHAR)) AS gene_set, concat('G',CAST(k AS VARCHAR)) AS gene
FROM (SELECT DISTINCT l_partkey % (SELECT max(doc_id)+1 FROM documents) AS k FROM lineitem) g, (SELECT unnest(range(0,6)) AS i) s
WHERE k % 7 = i OR k % 5 = i""")

view("clean_ev", "events_maf ref_contig", f"""
SELECT e.*, CASE WHEN snp OR (length(ref_c)=1 AND length(alt_c)=1) THEN 'SBS'
  WHEN variant_type='DNP' OR (length(ref_c)=2 AND length(alt_c)=2) THEN 'DBS'
  WHEN variant_type IN ('INS','DEL') OR length(ref_c)<>length(alt_c) THEN 'ID' ELSE 'OTHER' END AS modality
FROM (SELECT m.*, c.seq, {clean('m.ref')} AS ref_c, {clean('m.alt')} AS alt_c, variant_type IN ('SNP','SNV') AS snp
      FROM events_maf m JOIN ref_contig c ON CAST(substr(m.chromosome,4) AS BIGINT)=c.contig) e""")

view("flanked", "clean_ev", f"""
SELECT *, CASE WHEN pure THEN {flank('pos-11','12')} ELSE {flank('pos-12','12')} END AS lf,
  CASE WHEN pure THEN {flank('pos+1','12')} ELSE {flank('pos+span','12')} END AS rf,
  CASE WHEN pure THEN '' ELSE {flank('pos','span')} END AS observed,
  pure OR (ref_c<>'' AND {flank('pos','span')}=ref_c) AS ref_ok
FROM (SELECT *, modality='ID' AND ref_c='' AS pure, greatest(1,length(ref_c)) AS span FROM clean_ev)""")

view("canon", "flanked", f"""
SELECT *, CASE WHEN flip THEN {rc('rf')} ELSE lf END AS cleft, CASE WHEN flip THEN {rc('lf')} ELSE rf END AS cright,
  CASE WHEN flip THEN {rc('ref_c')} ELSE ref_c END AS cref, CASE WHEN flip THEN {rc('alt_c')} ELSE alt_c END AS calt,
  CASE WHEN modality='OTHER' OR alt_c='' THEN 'invalid_or_other' WHEN pos IS NULL THEN 'invalid_position'
       WHEN NOT ref_ok THEN 'fasta_ref_mismatch' WHEN contains(lf,'N') OR contains(rf,'N') THEN 'unresolved_context'
       END AS reject_reason
FROM (SELECT *, (modality='SBS' AND ref_c IN ('A','G')) OR (modality='DBS' AND left(ref_c,1) IN ('A','G')) AS flip FROM flanked)""")


def _catalogue(items: list[str]) -> str:
    return ",".join(f"'{c}'" for c in items)


def _build_enc() -> None:
    from varloom.functions import catalogues as k

    view("enc", "canon", f"""
SELECT * EXCLUDE (seq), CASE WHEN reject_reason IS NOT NULL THEN NULL
  WHEN modality='SBS' THEN CASE WHEN length(cref)=1 AND length(calt)=1 AND cref<>calt
       THEN 'SBS96:'||right(cleft,1)||'['||cref||'>'||calt||']'||left(cright,1) END
  WHEN modality='DBS' THEN CASE WHEN cref||'>'||calt IN ({_catalogue(k.DBS78)}) THEN 'DBS78:'||cref||'>'||calt END
  ELSE CASE WHEN idc IN ({_catalogue(k.ID83)}) THEN 'ID83:'||idc END END AS channel
FROM (SELECT *, CASE WHEN length(tr)=length(ta) THEN NULL WHEN least(greatest(1,length(pay)),5)=1
        THEN '1:'||iev||':'||(CASE WHEN left(pay,1) IN ('C','T') THEN left(pay,1) WHEN left(pay,1)='A' THEN 'T' ELSE 'C' END)||':0'
        ELSE CAST(least(length(pay),5) AS VARCHAR)||':'||iev||':R:0' END AS idc
  FROM (SELECT *, CASE WHEN length(tr)>length(ta) THEN 'Del' ELSE 'Ins' END AS iev,
          CASE WHEN length(tr)>length(ta) THEN tr ELSE ta END AS pay
    FROM (SELECT *, left(r1,length(r1)-s) AS tr, left(a1,length(a1)-s) AS ta
      FROM (SELECT *, {prefix_len('reverse(r1)', 'reverse(a1)')} AS s
        FROM (SELECT *, substr(cref,p+1) AS r1, substr(calt,p+1) AS a1
          FROM (SELECT *, {prefix_len('cref', 'calt')} AS p FROM canon))))))""")
    rows = ",".join(f"('{m}','{c}','{p}')" for m, c, p in k.universe())
    view("universe", "", f"SELECT * FROM (VALUES {rows}) t(modality, channel_name, channel)")


_build_enc()

view("ok_ev", "enc", "SELECT * FROM enc WHERE reject_reason IS NULL")
view("chan", "ok_ev", "SELECT patient, channel, count(*) AS n FROM ok_ev WHERE channel IS NOT NULL GROUP BY ALL")


def with_views(needs: str, body: str) -> str:
    """A statement over the named views: their definitions (and what they need) as CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1].strip()})" for name in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


view("profile_rec", "maf", "SELECT event_id, patient, variant_class||'_'||variant_type AS channel, 'SIG'||(CAST(substr(gene,2) AS INT)%5) AS signature FROM maf")
view("sample_counts", "profile_rec", "SELECT patient, channel, count(*) AS n FROM profile_rec GROUP BY ALL")
view("sigref", "profile_rec", """
SELECT signature, channel, n/CAST(sum(n) OVER (PARTITION BY signature) AS DOUBLE) AS p
FROM (SELECT signature, channel, count(*) AS n FROM profile_rec GROUP BY ALL)""")
