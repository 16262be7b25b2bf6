"""Vectors, encodings, geometries, landmarks, kernel embeddings and transforms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varloom.catalog import q_projections as qp
from varloom.catalog.oracle_views import prefix_len, view
from varloom.catalog.q_aggregates import encoded, vec_counts
from varloom.catalog.registry import query
from varloom.evaluation import reduction
from varloom.functions import geometry as geo
from varloom.functions import labels as lab
from varloom.functions import vectors as vec
from varloom.operators import basis as bas
from varloom.operators import counts, encode, features as ft, joins, kernels, landmarks as lm, transforms as tr, windows as win
from varloom.session import scratch_path
from varloom.sources.tables import ALLELE

KEY = "event_id"


def xb(s: str, d: int) -> str:
    return f"rpad(translate(left({s},{d}),'ACGTN','{vec.X_BITS}'),{d},'0')"


def yb(s: str, d: int) -> str:
    return f"rpad(translate(left({s},{d}),'ACGTN','{vec.Y_BITS}'),{d},'0')"


def pay(s: str, d: int, kind: str) -> str:
    base = f"{xb(s, d)}||{yb(s, d)}"
    if kind == "masked":
        return f"{base}||rpad(repeat('1',CAST(least(length({s}),{d}) AS INT)),{d},'0')"
    if kind == "length":
        return f"{base}||lpad(bin(least(length({s}),{d + 1})),{vec.length_bits(d)},'0')"
    return base


@query("vec_bits", "ref_tiles", f"SELECT contig, tile, {xb('seq', 70)} AS x, {yb('seq', 70)} AS y FROM ref_tiles")
def vec_bits(t):
    return t.ref_tiles().select("contig", "tile", vec.x_bits(F.col("seq"), 70).alias("x"), vec.y_bits(F.col("seq"), 70).alias("y"))


def flanks(t):
    return encode.attach_flanks(encode.classify(t.events_maf()), t.reference(), 12, longest=ALLELE)


@query("vec_context", "flanked", f"SELECT event_id, {xb('reverse(lf)', 10)}||{yb('reverse(lf)', 10)}||{xb('rf', 10)}||{yb('rf', 10)} AS ctx FROM flanked")
def vec_context(t):
    left, right = vec.context_blocks(F.col("left"), F.col("right"), 10)
    return flanks(t).select(KEY, F.concat(left, right).alias("ctx"))


@query("vec_payload", "attrs", f"SELECT event_id, {pay('pay', 3, 'legacy')} AS legacy, {pay('pay', 3, 'masked')} AS masked, {pay('pay', 3, 'length')} AS length_coded FROM attrs")
def vec_payload(t):
    p = F.col("payload")
    return qp.attributes(t).select(
        KEY, vec.payload_block(p, 3, "bits").alias("legacy"), vec.payload_block(p, 3, "presence-mask").alias("masked"),
        vec.payload_block(p, 3, "length_code").alias("length_coded"),
    )


_EVENT_BITS = f"{xb('reverse(lf)', 10)}||{yb('reverse(lf)', 10)}||{pay('tr', 5, 'masked')}||{xb('rf', 10)}||{yb('rf', 10)}||{pay('ta', 5, 'masked')}"
view("event_bits", "attrs", f"SELECT event_id, {_EVENT_BITS} AS v FROM attrs")


def event_bits(t):
    v = vec.event_vector(F.col("left"), F.col("right"), F.col("ref_payload"), F.col("alt_payload"), 10, 5)
    return qp.attributes(t).select(KEY, v.alias("v"))


@query("vec_uga", "event_bits", "SELECT * FROM event_bits")
def vec_uga(t):
    return event_bits(t)


@query("vec_uga_slice", "event_bits", "SELECT event_id, substr(v,1,20)||substr(v,36,20) AS context_only FROM event_bits")
def vec_uga_slice(t):
    return event_bits(t).select(KEY, vec.context_slice(F.col("v"), 10, 5).alias("context_only"))


@query("vec_decode_check", "attrs", "SELECT count(*) AS n, 0 AS masked_mismatch, 0 AS length_mismatch, count(*) FILTER (length(pay)>2) AS overflow FROM attrs")
def vec_decode_check(t):
    p = F.col("payload")
    bases, over = vec.decode_length(vec.payload_block(p, 2, "length"), 2)
    want = F.substring(p, 1, 2)
    return qp.attributes(t).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(vec.decode_masked(vec.payload_block(p, 2), 2) != want).alias("masked_mismatch"),
        F.count_if(bases != want).alias("length_mismatch"), F.count_if(over).alias("overflow"),
    )


def _oh(s: str, codes: dict[str, str]) -> str:
    for base, code in codes.items():
        s = f"replace({s},'{base}','{code}')"
    return s


_LOAD = lambda c: f"rpad({_oh(f'left({c},8)', vec.ONE_HOT5)},40,'0')"
view("onehot", "ok_ev", f"""
SELECT event_id, patient, modality, rpad({_oh('cleft', vec.ONE_HOT4)},48,'0')||rpad({_oh('cright', vec.ONE_HOT4)},48,'0')||{_LOAD('cref')}||{_LOAD('calt')}
 ||(CASE WHEN length(cref)>8 THEN '1' ELSE '0' END)||(CASE WHEN length(calt)>8 THEN '1' ELSE '0' END) AS v FROM ok_ev""")


def onehot(t):
    v = vec.one_hot_event(F.col("cleft"), F.col("cright"), F.col("cref"), F.col("calt"))
    return encode.accepted(encoded(t)).select(KEY, "patient", "modality", v.alias("v"))


def coded(t):
    """The same events, their vectors in the short form in which they are counted and stored."""
    code = vec.event_code(F.col("cleft"), F.col("cright"), F.col("cref"), F.col("calt"))
    return encode.accepted(encoded(t)).select("patient", "modality", code.alias("code"))


@query("vec_one_hot", "onehot", "SELECT event_id, v, 178 AS width FROM onehot")
def vec_one_hot(t):
    return onehot(t).select(KEY, "v", F.size(vec.to_array(F.col("v"))).alias("width"))


def channels_seen(t):
    return counts.channel_counts(encoded(t)).select("channel").distinct()


view("census3", "ref_tiles", """
SELECT key, list_concat(list_concat(list(lx ORDER BY off),list(ly ORDER BY off)),list_concat(list(rx ORDER BY off),list(ry ORDER BY off))) AS ctx FROM (
SELECT key, off, sum(n*CAST(substr(w,4-off,1) IN ('C','T') AS INT))/CAST(sum(n) AS DOUBLE) AS lx, sum(n*CAST(substr(w,4-off,1) IN ('A','C') AS INT))/CAST(sum(n) AS DOUBLE) AS ly,
 sum(n*CAST(substr(w,4+off,1) IN ('C','T') AS INT))/CAST(sum(n) AS DOUBLE) AS rx, sum(n*CAST(substr(w,4+off,1) IN ('A','C') AS INT))/CAST(sum(n) AS DOUBLE) AS ry
FROM (SELECT substr(w,3,3) AS key, n, w, unnest(range(1,4)) AS off FROM (SELECT CASE WHEN substr(w,4,1) IN ('C','T') THEN w ELSE reverse(translate(w,'ACGT','TGCA')) END AS w, count(*) AS n
 FROM (SELECT substr(s,j,7) AS w FROM (SELECT s, unnest(range(1,length(s)-5)) AS j FROM (SELECT seq||coalesce(left(lead(seq) OVER (PARTITION BY contig ORDER BY tile),6),'') AS s FROM ref_tiles))) GROUP BY ALL)) GROUP BY key, off) GROUP BY key""")


@query("vec_channel_basis", "chan census3", f"""
WITH c AS (SELECT DISTINCT channel FROM chan), s AS (SELECT channel, ctx, substr(channel,9,1) AS r, substr(channel,11,1) AS a FROM c LEFT JOIN census3 ON key=substr(channel,7,1)||substr(channel,9,1)||substr(channel,13,1) WHERE starts_with(channel,'SBS96')),
d AS (SELECT channel, substr(channel,7,2) AS r, substr(channel,10,2) AS a FROM c WHERE starts_with(channel,'DBS78')),
dc AS (SELECT k.channel, list_transform(range(1,13), lambda i: m[i]/k.n) AS ctx FROM (SELECT channel, list(v ORDER BY i) AS m, max(n) AS n FROM (SELECT channel, i, sum(v) AS v, count(*) AS n FROM (SELECT channel, unnest(ctx) AS v, generate_subscripts(ctx,1) AS i FROM d JOIN census3 ON substr(key,2)=CASE WHEN left(r,1) IN ('C','T') THEN r ELSE reverse(translate(r,'ACGT','TGCA')) END) GROUP BY ALL) GROUP BY channel) k),
i AS (SELECT channel, CASE WHEN split_part(channel,':',4) IN ('C','T') THEN repeat(split_part(channel,':',4),CAST(least(CAST(split_part(channel,':',2) AS INT),2) AS INT)) ELSE left('ACGTAACGTA',CAST(least(CAST(split_part(channel,':',2) AS INT),2) AS INT)) END AS u, split_part(channel,':',3)='Del' AS del FROM c WHERE starts_with(channel,'ID83')),
u AS (SELECT channel, ctx, r, a FROM s UNION ALL SELECT d.channel, ctx, r, a FROM d LEFT JOIN dc USING (channel) UNION ALL SELECT channel, [0.0::DOUBLE for x in range(12)], CASE WHEN del THEN u ELSE '' END, CASE WHEN del THEN '' ELSE u END FROM i),
p AS (SELECT channel, ctx, left(r1,length(r1)-s) AS r, left(a1,length(a1)-s) AS a FROM (SELECT *, {prefix_len('reverse(r1)', 'reverse(a1)')} AS s FROM (SELECT *, substr(r,p+1) AS r1, substr(a,p+1) AS a1 FROM (SELECT *, {prefix_len('r', 'a')} AS p FROM u)))),
f AS (SELECT channel, ctx IS NOT NULL AS encoded, CASE WHEN ctx IS NULL THEN [0.0::DOUBLE for x in range(24)] ELSE list_concat(list_concat(ctx[1:6], list_transform(string_split({pay('r', 2, 'masked')},''), lambda b: CAST(b AS DOUBLE))), list_concat(ctx[7:12], list_transform(string_split({pay('a', 2, 'masked')},''), lambda b: CAST(b AS DOUBLE)))) END AS v FROM p)
SELECT channel, encoded, dim-1 AS dim, round(value,6) AS value FROM (SELECT channel, encoded, unnest(v) AS value, generate_subscripts(v,1) AS dim FROM f)""")
def vec_channel_basis(t):
    table = bas.channel_basis(channels_seen(t), ft.census(t.reference(), 3), d=3, dp=2)
    return table.select("channel", "encoded", F.posexplode("vec").alias("dim", "value"))


def _rep(u: str, d: int) -> str:
    need = f"greatest({d},length({u})*(greatest(1,aux)+2))"
    return f"left(repeat({u},CAST({need}//length({u})+2 AS INT)),CAST({need} AS INT))"


_IDL = "SELECT DISTINCT CASE WHEN variant_type='DEL' THEN 'Del' ELSE 'Ins' END AS ev, CASE event_id%4 WHEN 0 THEN 'C' WHEN 1 THEN 'T' WHEN 2 THEN 'R' ELSE 'M' END AS mo, CAST(1+t_depth%5 AS BIGINT) AS len, CAST(t_alt_count%6 AS BIGINT) AS aux FROM maf WHERE variant_type IN ('INS','DEL')"
_B4 = lambda v: f"(SELECT string_agg(substr('ACGT',CAST(({v}//CAST(pow(4,9-i) AS BIGINT))%4 AS INT)+1,1),'' ORDER BY i) FROM (SELECT unnest(range(0,10)) AS i))"


@query("vec_id83_proxy", "maf", f"""
WITH l AS ({_IDL}), u AS (SELECT *, CASE mo WHEN 'T' THEN repeat('T',CAST(len AS INT)) WHEN 'C' THEN repeat('C',CAST(len AS INT)) ELSE left('ACGTAACGTA',CAST(len AS INT)) END AS unit, upper(ev) AS e,
  ((CASE ev WHEN 'Ins' THEN 1 ELSE 0 END*4+CASE mo WHEN 'T' THEN 1 WHEN 'R' THEN 2 WHEN 'M' THEN 3 ELSE 0 END)*6+len)*6+least(aux,5) AS code FROM l)
SELECT len||':'||ev||':'||mo||':'||aux AS channel, right({_rep('unit', 10)},10) AS repeat_left, left({_rep('unit', 10)},10) AS repeat_right, {_B4('code')} AS proxy_right,
 {_B4("CAST(('0x'||right(sha1('left:'||e||':'||mo||':'||len||':'||aux),5)) AS BIGINT)")} AS token_left, {_B4("CAST(('0x'||right(sha1('right:'||e||':'||mo||':'||len||':'||aux),5)) AS BIGINT)")} AS token_right,
 CASE WHEN ev='Del' THEN unit ELSE '' END AS ref, CASE WHEN ev='Del' THEN '' ELSE unit END AS alt FROM u""")
def vec_id83_proxy(t):
    ev = t.maf_records().filter(F.col("variant_type").isin("INS", "DEL"))
    kind = F.when(F.col("variant_type") == "DEL", "Del").otherwise("Ins")
    mo = F.when(F.col(KEY) % 4 == 0, "C").when(F.col(KEY) % 4 == 1, "T").when(F.col(KEY) % 4 == 2, "R").otherwise("M")
    label = F.concat_ws(":", (1 + F.col("t_depth") % 5).cast("string"), kind, mo, (F.col("t_alt_count") % 6).cast("string"))
    parts = lab.id83_parts(F.col("channel"))
    get = lambda s: vec.id_proxy(parts, 10, 5, s)
    rep, tok, proxy, only = (get(s) for s in ("id83_repeat_context", "id83_token_pair", "id83_proxy", "id83_payload_only"))
    return ev.select(label.alias("channel")).distinct().select(
        "channel", rep["left"].alias("repeat_left"), rep["right"].alias("repeat_right"), proxy["right"].alias("proxy_right"),
        tok["left"].alias("token_left"), tok["right"].alias("token_right"), only["ref"].alias("ref"), only["alt"].alias("alt"),
    )


def _hu(text: str, part: int) -> str:
    return f"CAST(('0x'||substr(sha256({text}),{1 + 16 * part},16))::UBIGINT AS DOUBLE)/18446744073709551615.0::DOUBLE"


@query("vec_hash_pair", "maf", f"SELECT gene, round({_hu('gene', 0)},6) AS x, round({_hu('gene', 1)},6) AS y FROM (SELECT DISTINCT gene FROM maf)")
def vec_hash_pair(t):
    g = t.maf_records().select("gene").distinct()
    return g.select("gene", vec.hash_unit(F.col("gene"), 0).alias("x"), vec.hash_unit(F.col("gene"), 1).alias("y"))


def _cgr(s: str, bits: str) -> str:
    s = f"translate({s},'N','')"
    return f"coalesce(list_sum(list_transform(range(1,length({s})+1), lambda i: CAST(substr(translate({s},'ACGT','{bits[:4]}'),i,1) AS INT)*pow(2.0::DOUBLE,-i)))/list_sum(list_transform(range(1,length({s})+1), lambda i: pow(2.0::DOUBLE,-i))),0)"


@query("vec_cgr_xy", "attrs", f"SELECT event_id, round({_cgr('context_11', vec.X_BITS)},6) AS x, round({_cgr('context_11', vec.Y_BITS)},6) AS y FROM attrs")
def vec_cgr_xy(t):
    x, y = vec.cgr_xy(F.col("context_11"))
    return qp.attributes(t).select(KEY, x.alias("x"), y.alias("y"))


def stranded(t):
    return qp.attributes(t).withColumn("strand", F.when(F.col("pos") % 2 == 0, "+").otherwise("-"))


_M = "modality||'|'||motif_class"
view("geo_attrs", "attrs", "SELECT *, CASE WHEN pos%2=0 THEN '+' ELSE '-' END AS strand, CASE modality WHEN 'DBS' THEN 1/3::DOUBLE WHEN 'ID' THEN 2/3::DOUBLE ELSE 0::DOUBLE END AS off FROM attrs")
_TOK = "coalesce(nullif(sbs96,''),nullif(indel_class,''),nullif(motif_class,''),modality)"
_SELF = _M + "||'|'||context_5||'|'||indel_class||'|'||gene_region||'|'||clustered"
_GEO_SQL = {
    "exact_token_geometry_v1": (_hu(_TOK, 0), _hu(_TOK, 1), _TOK),
    **{f"sequence_cgr_k{k}_v1": (_cgr(f"context_{k}", vec.X_BITS), _cgr(f"context_{k}", vec.Y_BITS), f"modality||':sequence_k{k}'") for k in (5, 7, 11)},
    "indel_biology_geometry_v1": (
        f"CASE WHEN modality='ID' THEN 0.65::DOUBLE*CASE event_class WHEN 'del' THEN 0.15::DOUBLE WHEN 'ins' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END+0.35::DOUBLE*least(payload_len/12::DOUBLE,1) ELSE {_hu(_M, 0)} END",
        f"CASE WHEN modality='ID' THEN 0.55::DOUBLE*least(homopolymer_len/12::DOUBLE,1)+0.45::DOUBLE*least(microhomology_len/12::DOUBLE,1) ELSE {_hu(_M, 1)} END",
        "CASE WHEN modality='ID' THEN indel_class ELSE modality||':non_id' END"),
    "motif_factorized_geometry_v1": (_hu("'motif-x|'||motif_class", 0), _hu("'motif-y|'||modality||'|'||context_3||'|'||payload_len", 1), "motif_class"),
    "topography_aware_geometry_v1": (_hu(f"'topo|'||{_M}||'|'||context_5", 0),
        f"least(greatest(0.45::DOUBLE*local_gc+0.25::DOUBLE*clustered+0.2::DOUBLE*CASE gene_region WHEN 'coding' THEN 1 ELSE 0 END+0.1::DOUBLE*{_hu(chr(39) + 'strand|' + chr(39) + '||strand', 1)},0),1)", "modality||':topography'"),
    "learned_self_supervised_geometry_v1": (_hu(f"'selfsup|'||{_SELF}", 0), _hu(f"'selfsup|'||{_SELF}", 1), _SELF),
}
view("placed", "geo_attrs", " UNION ALL ".join(f"SELECT event_id, patient, '{n}' AS geometry, off+({x})/3 AS x, {y} AS y, {k} AS token FROM geo_attrs" for n, (x, y, k) in _GEO_SQL.items()))


@query("vec_geometry", "placed", "SELECT geometry, token, count(*) AS n, round(avg(x),6) AS x, round(avg(y),6) AS y FROM placed GROUP BY ALL")
def vec_geometry(t):
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c)
    return geo.place(stranded(t), list(geo.GEOMETRIES), keys=[]).groupBy("geometry", "token").agg(F.sum("n").alias("n"), mean("x"), mean("y"))


def _grid(v: str, l: int) -> str:
    return f"CAST(least(greatest(floor({v}*{2 ** l}),0),{2 ** l - 1}) AS BIGINT)"


def _morton(x: str, y: str, l: int) -> str:
    return "(" + "+".join(f"(({_grid(x, l)}>>{b})&1)*{2 ** (2 * b + 1)}+(({_grid(y, l)}>>{b})&1)*{2 ** (2 * b)}" for b in range(l)) + ")"


@query("vec_morton", "", f"SELECT vec_id, {_morton('x', 'y', 4)} AS m4, {_morton('x', 'y', 6)} AS m6 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE)*2+0.3::DOUBLE AS x, CAST(embedding[2] AS DOUBLE)*2+0.4::DOUBLE AS y FROM embeddings)")
def vec_morton(t):
    v = t.basis().select("vec_id", (F.col("embedding")[0] * 2 + 0.3).alias("x"), (F.col("embedding")[1] * 2 + 0.4).alias("y"))
    cell = lambda l: vec.morton(vec.grid_index(F.col("x"), l), vec.grid_index(F.col("y"), l), l)
    return v.select("vec_id", cell(4).alias("m4"), cell(6).alias("m6"))


_G3 = ["sequence_cgr_k5_v1", "motif_factorized_geometry_v1", "indel_biology_geometry_v1"]


@query("agg_geometry_bins", "placed", " UNION ALL ".join(f"SELECT patient, geometry||'__l{l}__m'||{_morton('x', 'y', l)} AS feature, count(*) AS n FROM placed WHERE geometry IN ({','.join(repr(g) for g in _G3)}) GROUP BY ALL" for l in (4, 6)))
def agg_geometry_bins(t):
    return geo.bin_features(geo.place(stranded(t), _G3))


def marks(t, k: int = 16):
    return t.basis().filter(f"vec_id < {k}")


view("marks", "basis", "SELECT * FROM basis WHERE vec_id<16")
view("sigma", "marks", "SELECT quantile_cont(d,0.5) AS sigma FROM (SELECT list_distance(a.embedding,b.embedding) AS d FROM marks a JOIN marks b ON a.vec_id<b.vec_id) WHERE d>1e-12")


@query("vec_distance", "basis marks", "SELECT a.vec_id, b.vec_id AS landmark, round(list_distance(a.embedding,b.embedding),6) AS d FROM basis a, marks b WHERE a.vec_id<>b.vec_id")
def vec_distance(t):
    d, names = kernels.distances(t.basis(), "embedding", marks(t), "vec_id", "embedding")
    labels = F.array(*[F.lit(n) for n in names])
    return d.select("vec_id", F.explode(F.arrays_zip(labels.alias("landmark"), "d")).alias("p")).select("vec_id", "p.landmark", "p.d").filter("vec_id <> landmark")


@query("vec_median_scale", "sigma", "SELECT round(sigma,6) AS sigma FROM sigma")
def vec_median_scale(t):
    return lm.median_scale(marks(t), "vec_id", "embedding")


_Z = "CASE WHEN {v}.vec_id%10=0 THEN list_transform({v}.embedding, lambda x: 0.0::DOUBLE) ELSE {v}.embedding END"


@query("vec_cosine", "basis", f"""
SELECT vec_id, round(CASE WHEN na*nb>1e-15 THEN dot/(na*nb) END,6) AS null_policy, round(CASE WHEN na*nb>1e-15 THEN dot/(na*nb) ELSE 0 END,6) AS zero_policy,
 round(CASE WHEN na<=1e-15 AND nb<=1e-15 THEN 1 WHEN na*nb>1e-15 THEN dot/(na*nb) ELSE 0 END,6) AS both_policy
FROM (SELECT vec_id, list_inner_product(a,b) AS dot, sqrt(list_inner_product(a,a)) AS na, sqrt(list_inner_product(b,b)) AS nb FROM (
 SELECT x.vec_id, {_Z.format(v='x')} AS a, {_Z.format(v='y')} AS b FROM basis x JOIN basis y ON y.vec_id=x.vec_id+10))""")
def vec_cosine(t):
    b = t.basis().select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.col("embedding")).alias("a"))
    pair = b.join(b.select((F.col("vec_id") - 10).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    c = lambda z: vec.cosine(F.col("a"), F.col("b"), zero=z)
    return pair.select("vec_id", c("null").alias("null_policy"), c("zero").alias("zero_policy"), c("both").alias("both_policy"))


def one_sigma(points, name, v) -> float:
    return lm.median_scale(points, name, v).first().sigma


@query("kme_channel", "vec_counts basis marks sigma", """
SELECT sample, m.vec_id AS landmark, round(sum(n*exp(-0.5*pow(list_distance(b.embedding,m.embedding),2)/(sigma*sigma)))/sum(n),6) AS value FROM vec_counts c JOIN basis b USING (vec_id) CROSS JOIN marks m CROSS JOIN sigma GROUP BY ALL""")
def kme_channel(t):
    names, y = kernels.landmark_matrix(marks(t), "vec_id", "embedding")
    rows = vec_counts(t).join(joins.hinted(t.basis()), "vec_id")
    return kernels.mean_embedding(rows, "sample", "embedding", "n", names, y, one_sigma(marks(t), "vec_id", "embedding"), bits=False)


def _far_sql(k: int) -> str:
    parts = ["far1 AS (SELECT vec_id, embedding FROM basis, (SELECT list(m ORDER BY dim) AS c FROM (SELECT dim, avg(v) AS m FROM basis_long GROUP BY dim)) ORDER BY list_distance(embedding,c), vec_id LIMIT 1)"]
    for i in range(2, k + 1):
        dist = ",".join(f"list_distance(b.embedding,(SELECT embedding FROM far{j}))" for j in range(1, i))
        seen = " UNION ALL ".join(f"SELECT vec_id FROM far{j}" for j in range(1, i))
        parts.append(f"far{i} AS (SELECT vec_id, embedding FROM basis b WHERE vec_id NOT IN ({seen}) ORDER BY least({dist}) DESC, vec_id LIMIT 1)")
    return "WITH " + ",\n".join(parts)


_FAR = " UNION ALL ".join(f"SELECT {i} AS step, vec_id, embedding FROM far{i}" for i in range(1, 7))


@query("lmk_farthest", "basis basis_long", f"{_far_sql(6)} SELECT step, vec_id FROM ({_FAR})")
def lmk_farthest(t):
    return lm.farthest_landmarks(t.basis(), "vec_id", "embedding", 6).select("step", "vec_id")


@query("kme_tuned", "vec_counts basis basis_long marks sigma", f"""
{_far_sql(6)}, f AS ({_FAR}) SELECT sample, f.vec_id AS landmark, round(sum(n*exp(-0.5*pow(list_distance(b.embedding,f.embedding),2)/(0.25*sigma*sigma)))/sum(n),6) AS value FROM vec_counts c JOIN basis b USING (vec_id) CROSS JOIN f CROSS JOIN sigma GROUP BY ALL""")
def kme_tuned(t):
    far = lm.farthest_landmarks(t.basis(), "vec_id", "embedding", 6)
    names, y = kernels.landmark_matrix(far, "vec_id", "embedding")
    rows = vec_counts(t).join(joins.hinted(t.basis()), "vec_id")
    return kernels.mean_embedding(rows, "sample", "embedding", "n", names, y, 0.5 * one_sigma(marks(t), "vec_id", "embedding"), bits=False)


@query("kme_row_normalised", "vec_counts basis marks sigma", """
WITH k AS (SELECT b.vec_id, m.vec_id AS landmark, exp(-0.5*pow(list_distance(b.embedding,m.embedding),2)/(4*sigma*sigma)) AS k FROM basis b, marks m, sigma),
r AS (SELECT vec_id, landmark, k/sum(k) OVER (PARTITION BY vec_id) AS k FROM k)
SELECT sample, landmark, round(sum(n*k)/sum(n),6) AS value FROM vec_counts JOIN r USING (vec_id) GROUP BY ALL""")
def kme_row_normalised(t):
    names, y = kernels.landmark_matrix(marks(t), "vec_id", "embedding")
    rows = vec_counts(t).join(joins.hinted(t.basis()), "vec_id")
    return kernels.mean_embedding(rows, "sample", "embedding", "n", names, y, 2 * one_sigma(marks(t), "vec_id", "embedding"), bits=False, normalise=True)


view("rand_lm", "onehot", "SELECT v FROM (SELECT DISTINCT v FROM onehot) ORDER BY sha256('seed|'||v), v LIMIT 12")
view("hsigma", "rand_lm", "SELECT quantile_cont(sqrt(hamming(a.v,b.v)),0.5) AS sigma FROM rand_lm a JOIN rand_lm b ON a.v<b.v")


@query("lmk_random", "rand_lm", "SELECT v FROM rand_lm")
def lmk_random(t):
    return lm.random_landmarks(onehot(t), "v", 12, "seed")


@query("lmk_frequency", "onehot", """
WITH n AS (SELECT v, count(*) AS n FROM onehot GROUP BY v), h AS (SELECT v FROM n ORDER BY n DESC, v LIMIT 6)
SELECT v, 'frequent' AS part FROM h UNION ALL (SELECT v, 'tail' FROM n WHERE v NOT IN (SELECT v FROM h) ORDER BY sha256('seed|'||v), v LIMIT 6)""")
def lmk_frequency(t):
    counted = ft.n_by(coded(t), "code").select(vec.one_hot_code(F.col("code")).alias("v"), "n")
    return lm.frequency_landmarks(onehot(t), "v", 12, "seed", counted)


@query("kme_event", "onehot rand_lm hsigma", """
WITH d AS (SELECT patient, v, count(*) AS n FROM onehot GROUP BY ALL), l AS (SELECT v, row_number() OVER (ORDER BY v) AS landmark FROM rand_lm)
SELECT patient, landmark, round(sum(n*exp(-0.5*hamming(d.v,l.v)/(sigma*sigma)))/sum(n),6) AS value FROM d, l, hsigma GROUP BY ALL""")
def kme_event(t):
    return bas.event_embedding(inventory(t), "patient", "v", k=12, seed="seed", width=178)


def inventory(t):
    """Event vectors of this query's folder, written below the shared folder in their short form."""
    path = scratch_path(t.spark, f"inventory-{uuid.uuid4().hex[:8]}")
    return bas.event_inventory(coded(t), "patient", "code", path).withColumn("v", vec.one_hot_code(F.col("code")))


_W = "[" + ",".join(f"{w * w!r}" for w in vec.one_hot_weights()) + "]"


@query("kme_stratified", "onehot", f"""
WITH s AS (SELECT modality, v, row_number() OVER (PARTITION BY modality ORDER BY sha256('seed|'||v), v) AS k FROM (SELECT DISTINCT modality, v FROM onehot)), l AS (SELECT modality, v, row_number() OVER (PARTITION BY modality ORDER BY v) AS landmark FROM s WHERE k<=4),
g AS (SELECT modality, coalesce(quantile_cont(d,0.5),1.0) AS sigma FROM (SELECT a.modality, sqrt(hamming(a.v,b.v)) AS d FROM l a JOIN l b ON a.modality=b.modality AND a.v<b.v) GROUP BY modality),
d AS (SELECT modality, patient, v, count(*) AS n FROM onehot GROUP BY ALL), u AS (SELECT modality, v, landmark, (SELECT 1) AS one FROM (SELECT DISTINCT d.modality, d.v, l.landmark FROM d JOIN l USING (modality))),
w AS (SELECT u.modality, u.v, u.landmark, list_sum(list_transform(range(1,179), lambda i: CASE WHEN substr(u.v,i,1)<>substr(l.v,i,1) THEN ({_W})[i] ELSE 0.0 END)) AS d2 FROM u JOIN l ON l.modality=u.modality AND l.landmark=u.landmark)
SELECT patient, d.modality, mult AS multiplier, landmark, round(sum(n*exp(-0.5*d2/(sigma*sigma*mult*mult)))/sum(n),6) AS value FROM d JOIN w USING (modality, v) JOIN g ON g.modality=d.modality CROSS JOIN (SELECT unnest([0.5::DOUBLE,1.0::DOUBLE,2.0::DOUBLE]) AS mult) GROUP BY ALL""")
def kme_stratified(t):
    return bas.stratified_embedding(inventory(t), "patient", "v", k=4, seed="seed", multipliers=[0.5, 1.0, 2.0], weights=vec.one_hot_weights())


@query("prj_random_directions")
def prj_random_directions(t):
    return reduction.random_direction_features(vec_counts(t), t.basis(), n_dirs=8, seed=7)


@query("mat_svd")
def mat_svd(t):
    n = ft.n_by(t.maf_records(), "patient", F.col("gene").alias("feature"))
    return reduction.truncated_svd(ft.keep_top(n, ft.top_variance(n, t.cohort().agg(F.count(F.lit(1)).alias("N")), 512)), "patient", [16, 32, 64])


@query("mat_pca2")
def mat_pca2(t):
    return reduction.two_dimensional_map(t.basis(), "vec_id", "embedding")


@query("mat_block_stack", "maf", """
WITH n AS (SELECT patient, CASE variant_type WHEN 'SNP' THEN 'SBS' WHEN 'DNP' THEN 'DBS' ELSE 'ID' END AS modality, impact AS channel, count(*) AS n FROM maf GROUP BY ALL)
SELECT patient, modality, channel, round((n/CAST(sum(n) OVER (PARTITION BY patient, modality) AS DOUBLE))*(sum(n) OVER (PARTITION BY patient, modality)/CAST(sum(n) OVER (PARTITION BY patient) AS DOUBLE)),6) AS value FROM n""")
def mat_block_stack(t):
    from varloom.functions.sequence import modality_of_type

    n = ft.n_by(t.maf_records(), "patient", modality_of_type(F.col("variant_type")).alias("modality"), F.col("impact").alias("channel"))
    return tr.block_stack(n)


@query("trf_counts", "sample_counts cohort", """
SELECT patient, channel, n AS raw, CAST(n>0 AS BIGINT) AS "binary", round(ln(1+n),6) AS log1p, round(sqrt(n),6) AS sqrt, round(p,6) AS fraction, round(ln(1+p),6) AS log_fraction,
 round(n*(ln((1.0+(SELECT count(*) FROM cohort))/(1.0+df))+1),6) AS tfidf, round((rk+(tie-1)/2.0)/k,6) AS rank FROM (SELECT *, n/CAST(sum(n) OVER (PARTITION BY patient) AS DOUBLE) AS p, count(*) OVER (PARTITION BY channel) AS df,
 rank() OVER (PARTITION BY patient ORDER BY n) AS rk, count(*) OVER (PARTITION BY patient, n) AS tie, count(*) OVER (PARTITION BY patient) AS k FROM sample_counts)""")
def trf_counts(t):
    return tr.count_transforms(t.sample_counts().withColumnRenamed("channel", "feature"), t.cohort()).withColumnRenamed("feature", "channel")


@query("trf_interactions", "maf sets", """
WITH p AS (SELECT DISTINCT patient, gene_set FROM maf JOIN sets USING (gene)), i AS (SELECT DISTINCT patient, impact FROM maf), g AS (SELECT DISTINCT patient, gene FROM maf), v AS (SELECT patient, avg(t_alt_count/CAST(t_depth AS DOUBLE)) AS m FROM maf WHERE t_depth<>0 GROUP BY ALL)
SELECT patient, 'pathway_x_impact__'||gene_set||'__'||impact AS feature, 1.0::DOUBLE AS value FROM p JOIN i USING (patient) UNION ALL SELECT patient, 'gene_presence_x_vaf_mean__'||gene, round(m,6) FROM g JOIN v USING (patient)""")
def trf_interactions(t):
    ev = t.maf_records()
    p = joins.expand_sets(ev, joins.hinted(t.sets())).select("patient", "gene_set").distinct()
    i = ev.select("patient", "impact").distinct()
    g = ev.select("patient", "gene").distinct()
    v = ev.groupBy("patient").agg(F.avg(lab.vaf(F.col("t_alt_count"), F.col("t_depth"))).alias("m"))
    return tr.presence_product(p, i, "gene_set", "impact", "pathway_x_impact").unionByName(tr.presence_times(g, v, "gene", "m", "gene_presence_x_vaf_mean"))


@query("trf_candidate_stack", "maf", """
WITH b AS (SELECT 'gene' AS block, patient, gene AS feature, count(*) AS n FROM maf GROUP BY ALL UNION ALL SELECT 'impact', patient, impact, count(*) FROM maf GROUP BY ALL UNION ALL SELECT 'identity', patient, variant_class||'_'||variant_type, count(*) FROM maf GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('id_plus_gene','identity'),('id_plus_gene','gene'),('id_plus_all','identity'),('id_plus_all','gene'),('id_plus_all','impact'),('maf_only_gene','gene')) x(model_id, block))
SELECT model_id, patient, block||'__'||feature AS feature, n AS value FROM b JOIN s USING (block)""")
def trf_candidate_stack(t):
    ev = t.maf_records()
    block = lambda name, c: ft.n_by(ev, "patient", c.alias("feature")).withColumn("block", F.lit(name))
    blocks = block("gene", F.col("gene")).unionByName(block("impact", F.col("impact"))).unionByName(block("identity", F.concat_ws("_", "variant_class", "variant_type")))
    return tr.candidate_stack(blocks, {"id_plus_gene": ["gene"], "id_plus_all": ["gene", "impact"], "maf_only_gene": ["gene"]})


@query("trf_feature_modes", "maf", """
WITH n AS (SELECT patient, CASE WHEN variant_type IN ('INS','DEL') THEN 'id' ELSE 'sbsdbs' END AS modality, impact AS feature, count(*) AS n FROM maf GROUP BY ALL), q AS (SELECT *, n/CAST(sum(n) OVER (PARTITION BY patient, modality) AS DOUBLE) AS p, sum(n) OVER (PARTITION BY patient, modality)/CAST(sum(n) OVER (PARTITION BY patient) AS DOUBLE) AS f FROM n)
SELECT 'weighted' AS mode, patient, modality||'__'||feature AS feature, round(p*f,6) AS value FROM q UNION ALL SELECT 'weighted_frac', patient, modality||'__'||feature, round(p*f,6) FROM q UNION ALL SELECT DISTINCT 'weighted_frac', patient, 'fraction_'||modality, round(f,6) FROM q
UNION ALL SELECT 'unweighted_frac', patient, modality||'__'||feature, round(p,6) FROM q UNION ALL SELECT DISTINCT 'unweighted_frac', patient, 'fraction_'||modality, round(f,6) FROM q""")
def trf_feature_modes(t):
    kind = F.when(F.col("variant_type").isin("INS", "DEL"), "id").otherwise("sbsdbs")
    return tr.feature_modes(ft.n_by(t.maf_records(), "patient", kind.alias("modality"), F.col("impact").alias("feature")))


@query("trf_standardise", "maf cohort", """
WITH n AS (SELECT c.patient, f.impact AS feature, coalesce(k.n,0) AS n FROM cohort c CROSS JOIN (SELECT DISTINCT impact FROM maf) f LEFT JOIN (SELECT patient, impact, count(*) AS n FROM maf GROUP BY ALL) k ON k.patient=c.patient AND k.impact=f.impact)
SELECT patient, feature, round((n-avg(n) OVER (PARTITION BY feature))/CASE WHEN stddev_pop(n) OVER (PARTITION BY feature)>1e-12 THEN stddev_pop(n) OVER (PARTITION BY feature) ELSE 1 END,6) AS z FROM n""")
def trf_standardise(t):
    n = ft.n_by(t.maf_records(), "patient", F.col("impact").alias("feature"))
    return tr.standardise(n, t.cohort())


@query("trf_downsample", "sample_counts", """
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY channel) AS nr, sum(n) OVER (PARTITION BY patient) AS t FROM sample_counts),
draws AS (
  SELECT patient, replicate, CAST(0 AS BIGINT) AS nr, '' AS channel, CAST(t AS BIGINT) AS total, CAST(100 AS BIGINT) AS budget, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT patient, t FROM c WHERE t>=100), (SELECT unnest([1,2]) AS replicate)
  UNION ALL
  SELECT patient, replicate, nr, channel, total-m, budget-x, x FROM (
    SELECT *, lo+len(list_filter(w, lambda v: v<u*w[-1])) AS x FROM (
      SELECT *, list_transform(range(1,len(p)+1), lambda i: list_sum(p[1:i])) AS w FROM (
        SELECT *, list_transform(range(lo,hi+1), lambda k: exp(lgamma(m+1)-lgamma(k+1)-lgamma(m-k+1)+lgamma(total-m+1)-lgamma(budget-k+1)-lgamma(total-m-budget+k+1)-(lgamma(total+1)-lgamma(budget+1)-lgamma(total-budget+1)))) AS p FROM (
          SELECT d.patient, d.replicate, c.nr, c.channel, c.n AS m, d.total, d.budget, greatest(0,d.budget-(d.total-c.n)) AS lo, least(c.n,d.budget) AS hi,
            CAST('0x'||substr(sha256('down|'||d.replicate||'|'||d.patient||'|'||c.channel),1,13) AS BIGINT)/CAST(pow(16,13) AS DOUBLE) AS u
          FROM draws AS d JOIN c ON c.patient=d.patient AND c.nr=d.nr+1)))))
SELECT patient, CAST(replicate AS BIGINT) AS replicate, channel, n FROM draws WHERE nr>0 AND n>0""")
def trf_downsample(t):
    return win.downsample(t.sample_counts(), 100, 2, "down")
