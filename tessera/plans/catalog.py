"""Registered queries: one per operator of the inventory, each with its oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
whole driver tables (or data Spark derives from them); ``ORACLES[name]`` is
the same result restated in DuckDB SQL over the same tables.  Queries whose
result depends on the chunker or on approximate search have no oracle; they
are checked against brute force in ``tests/``.

Floating results are rounded to 6 digits on both sides and ranks use
``(rounded distance, id)`` so that summation order cannot change them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.operators import chunking, embedding, expansion, ivf, search, transcripts
from tessera.operators.collections import KnowledgeBase, chunk_counts
from tessera.plans import oracle_sql as O
from tessera.plans import flows
from tessera.session import scratch_path
from tessera.sources import media, segments, tables, transcript_md, url_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
FIXED_TS = "20260101_000000"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c):
    return F.round(c, DIGITS)


# =========================================================================================
# Step 1: text functions F1-F10, F14
# =========================================================================================

@register("segment_clean", f"SELECT doc_id, {O.segment_clean('t')} AS t FROM {O.FULL_WIDTH}")
def q_segment_clean(spark, sf):
    return tables.full_width_runs(spark, sf).select("doc_id", T.segment_clean("t").alias("t"))


@register("doc_clean", f"SELECT doc_id, {O.doc_clean('text')} AS t FROM documents")
def q_doc_clean(spark, sf):
    return tables.documents(spark, sf).select("doc_id", T.doc_clean("text").alias("t"))


@register("filler_removal", f"SELECT doc_id, {O.fillers(O.collapse('t'))} AS t FROM {O.FILLERS}")
def q_filler_removal(spark, sf):
    return tables.fillers(spark, sf).select(
        "doc_id", T.remove_fillers(T.collapse_whitespace("t")).alias("t"))


@register("punct_normalize", f"SELECT doc_id, {O.punct('t')} AS t FROM {O.REPEATED}")
def q_punct_normalize(spark, sf):
    return tables.repeated_marks(spark, sf).select("doc_id", T.normalize_punctuation("t").alias("t"))


@register("punct_dedup", f"SELECT doc_id, {O.dedup(O.punct('t'))} AS t FROM {O.REPEATED}")
def q_punct_dedup(spark, sf):
    return tables.repeated_marks(spark, sf).select(
        "doc_id", T.dedup_punctuation(T.normalize_punctuation("t")).alias("t"))


@register("script_simplify", f"SELECT doc_id, {O.simplify('t')} AS t FROM {O.CJK}")
def q_script_simplify(spark, sf):
    return tables.cjk_text(spark, sf).select("doc_id", T.to_simplified("t").alias("t"))


@register("script_traditional", f"SELECT doc_id, {O.traditionalise(O.simplify('t'))} AS t FROM {O.CJK}")
def q_script_traditional(spark, sf):
    return tables.cjk_text(spark, sf).select("doc_id", T.to_traditional(T.to_simplified("t")).alias("t"))


_TARGET_SQL = "CASE WHEN lang IN ('en', 'fr') THEN 'traditional' ELSE 'simplified' END"


@register("script_convert", f"""SELECT doc_id, {_TARGET_SQL} AS target,
    CASE WHEN {_TARGET_SQL} = 'traditional' THEN {O.traditionalise(O.simplify('t'))} ELSE {O.simplify('t')} END AS t
    FROM {O.CJK}""")
def q_script_convert(spark, sf):
    c = tables.cjk_text(spark, sf)
    target = F.when(F.col("lang").isin("en", "fr"), F.lit("traditional")).otherwise(F.lit("simplified"))
    simp = T.to_simplified("t")
    return c.select("doc_id", target.alias("target"), T.convert_script(simp, target).alias("t"))


_CONF_SQL = "CASE lang WHEN 'en' THEN 'zh-CN' WHEN 'fr' THEN 'zh-TW' WHEN 'de' THEN 'zh' ELSE 'es-ES' END"


@register("script_by_lang", f"""SELECT doc_id, split_part({_CONF_SQL}, '-', 1) AS asr_language,
    CASE WHEN {_CONF_SQL} IN ('zh-CN', 'zh') THEN {O.simplify('t')}
         WHEN {_CONF_SQL} = 'zh-TW' THEN {O.traditionalise('t')} ELSE t END AS t
    FROM {O.CJK}""")
def q_script_by_lang(spark, sf):
    c = tables.cjk_text(spark, sf)
    conf = (F.when(F.col("lang") == "en", "zh-CN").when(F.col("lang") == "fr", "zh-TW")
            .when(F.col("lang") == "de", "zh").otherwise("es-ES"))
    return c.select("doc_id", T.language_prefix(conf).alias("asr_language"),
                    T.convert_by_language(F.col("t"), conf).alias("t"))


@register("text_key", "SELECT doc_id, md5(text) AS text_key FROM documents")
def q_text_key(spark, sf):
    return tables.documents(spark, sf).select("doc_id", T.text_key("text").alias("text_key"))


# =========================================================================================
# Step 2: vectors F16, F17, T2, T3
# =========================================================================================

@register("cosine_pairs", f"""
    WITH p AS (
      SELECT a.vec_id, a.embedding::DOUBLE[] AS v1,
             CASE a.label WHEN 0 THEN list_transform(b.embedding::DOUBLE[], lambda x: 0.0::DOUBLE)
                          WHEN 1 THEN (b.embedding::DOUBLE[])[1:32]
                          ELSE b.embedding::DOUBLE[] END AS v2
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    s AS (
      SELECT vec_id, v1, v2,
             list_sum(list_transform(range(1, len(v1) + 1), lambda i: v1[i] * v2[i])) AS d,
             sqrt(list_sum(list_transform(v1, lambda x: x * x))) * sqrt(list_sum(list_transform(v2, lambda x: x * x))) AS n
      FROM p)
    SELECT vec_id, round(CASE WHEN len(v1) <> len(v2) OR n = 0 THEN 0.0
                              ELSE greatest(0.0, least(1.0, d / n)) END, {DIGITS}) AS cosine
    FROM s""")
def q_cosine_pairs(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    v2 = (F.when(F.col("a.label") == 0, F.transform("b.embedding", lambda x: F.lit(0.0)))
          .when(F.col("a.label") == 1, F.slice(F.col("b.embedding").cast("array<double>"), 1, 32))
          .otherwise(F.col("b.embedding").cast("array<double>")))
    return j.select(F.col("a.vec_id").alias("vec_id"),
                    r6(V.cosine_similarity(F.col("a.embedding"), v2)).alias("cosine"))


@register("l2_normalize", f"""
    WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (label + 1)) AS v FROM embeddings),
    n AS (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS nrm FROM s)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / nrm, {DIGITS}) AS value
    FROM n, range(1, len(v) + 1) r(i)""")
def q_l2_normalize(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("label") + 1))
    out = e.select("vec_id", V.l2_normalize(scaled).alias("v"))
    return V.explode_array(out, "v", "pos", "value").select(
        "vec_id", F.col("pos").cast("int").alias("pos"), r6(F.col("value")).alias("value"))


def _centroid_queries_sql(group: str | None) -> str:
    g = f"{group}, " if group else ""
    gq = f"{group} AS query_id, " if group else ""
    return f"""
    u AS (SELECT {g}vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
    m AS (SELECT {g}i, avg(x) AS m FROM u GROUP BY ALL),
    n AS (SELECT {g}sqrt(sum(m * m)) AS nrm FROM m GROUP BY ALL),
    qv AS (SELECT {gq}i, m / greatest(nrm, 1e-12) AS q FROM m {'JOIN n USING (' + group + ')' if group else ', n'})"""


@register("knn_topk", f"""
    WITH {_centroid_queries_sql(None)},
    d AS (SELECT u.vec_id AS id, round(sum((u.x - qv.q) * (u.x - qv.q)), {DIGITS}) AS distance
          FROM u JOIN qv USING (i) GROUP BY u.vec_id)
    SELECT id, CAST(row_number() OVER (ORDER BY distance, id) AS INTEGER) AS rank, distance,
           round(greatest(0.0, 1.0 - distance), {DIGITS}) AS score
    FROM d ORDER BY distance, id LIMIT {fv.DEFAULT_TOP_K}""")
def q_knn_topk(spark, sf):
    e = tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = centroid(e).scalar()
    top = search.knn_topk(e, q, fv.DEFAULT_TOP_K, "l2", round_digits=DIGITS)
    return top.select("id", F.col("rank").cast("int").alias("rank"), "distance", r6(F.col("score")).alias("score"))


def centroid(vectors: DataFrame, vec_col: str = "embedding", group: str | None = None) -> DataFrame:
    """Normalised mean vector (per group): one partial aggregate, no explode."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>")))
    agg = vectors.groupBy(group).agg(mean.alias("m")) if group else vectors.agg(mean.alias("m"))
    out = agg.select(*([group] if group else []), V.l2_normalize(vector_to_array(F.col("m"))).alias("qv"))
    return out if group else out.select("qv")


@register("knn_batch", f"""
    WITH {_centroid_queries_sql('label')},
    d AS (SELECT qv.query_id, u.vec_id AS id, round(sum((u.x - qv.q) * (u.x - qv.q)), {DIGITS}) AS distance
          FROM u JOIN qv USING (i) GROUP BY qv.query_id, u.vec_id)
    SELECT query_id, id, distance, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d)
    WHERE rank <= {fv.DEFAULT_TOP_K}""")
def q_knn_batch(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    queries = centroid(e, group="label").select(F.col("label").alias("query_id"), "qv")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    out = search.knn_batch(vec, queries, fv.DEFAULT_TOP_K, "l2", round_digits=DIGITS)
    return out.select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank"))


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    e = tables.load(spark, sf, "embeddings")
    queries = centroid(e, group="label").select(F.col("label").alias("query_id"), "qv")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    out = search.knn_lsh(vec, queries, fv.DEFAULT_TOP_K, round_digits=DIGITS)
    return out.select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank"))


#: Lists of the inverted file, lists probed a query, and rows whose vectors are read.
IVF_LISTS, IVF_PROBE, IVF_RERANK = 64, 40, 50


def _ivf_sql(tail: str) -> str:
    """K-means, residual codes, the probe and the exact ranking, all restated per dimension."""
    steps = []
    for n in range(ivf.ITERATIONS + 1):
        steps.append(f"""
    a{n} AS MATERIALIZED (SELECT id, l FROM (
        SELECT id, l, row_number() OVER (PARTITION BY id ORDER BY d, l) AS r FROM (
            SELECT s.id, c.l, sum((s.x - c.x) * (s.x - c.x)) AS d FROM s JOIN c{n} c USING (i) GROUP BY ALL)) WHERE r = 1)""")
        if n < ivf.ITERATIONS:
            steps.append(f"""
    c{n + 1} AS MATERIALIZED (SELECT c.l, c.i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
        SELECT l, i, avg(x) AS x FROM s JOIN a{n} USING (id) GROUP BY ALL) m ON m.l = c.l AND m.i = c.i)""")
    c, a = f"c{ivf.ITERATIONS}", f"a{ivf.ITERATIONS}"
    return f"""
    WITH {_centroid_queries_sql('label')},
    v AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS rn FROM embeddings),
    e AS MATERIALIZED (SELECT vec_id AS id, x, i FROM u),
    s AS MATERIALIZED (SELECT e.* FROM e JOIN v USING (id) WHERE rn <= {ivf.SAMPLE_ROWS}),
    c0 AS MATERIALIZED (SELECT rn - 1 AS l, i, x FROM e JOIN v USING (id) WHERE rn <= {IVF_LISTS}),{",".join(steps)},
    scale AS (SELECT max(abs(s.x - c.x)) / {ivf.TOP_CODE} AS scale FROM s JOIN {a} USING (id) JOIN {c} c USING (l, i)),
    al AS MATERIALIZED (SELECT id, l FROM (
        SELECT id, l, row_number() OVER (PARTITION BY id ORDER BY d, l) AS r FROM (
            SELECT e.id, c.l, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN {c} c USING (i) GROUP BY ALL)) WHERE r = 1),
    coded AS MATERIALIZED (SELECT id, l, i, c.x + scale * greatest(-{ivf.TOP_CODE}, least({ivf.TOP_CODE}, round((e.x - c.x) / scale))) AS y
        FROM e JOIN al USING (id) JOIN {c} c USING (l, i), scale),
    probed AS MATERIALIZED (SELECT query_id, l FROM (
        SELECT query_id, l, row_number() OVER (PARTITION BY query_id ORDER BY d, l) AS r FROM (
            SELECT query_id, l, sum((q - c.x) * (q - c.x)) AS d FROM qv JOIN {c} c USING (i) GROUP BY ALL)) WHERE r <= {IVF_PROBE}),
    cand AS MATERIALIZED (SELECT query_id, id FROM (
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM (
            SELECT query_id, id, round(sum((q - y) * (q - y)), {DIGITS}) AS d
            FROM probed JOIN coded USING (l) JOIN qv USING (query_id, i) GROUP BY ALL)) WHERE r <= {IVF_RERANK}),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
        SELECT query_id, id, round(sum((q - x) * (q - x)), {DIGITS}) AS distance
        FROM cand JOIN e USING (id) JOIN qv USING (query_id, i) GROUP BY ALL)),
    work AS (SELECT query_id, count(*) AS codes_scanned FROM probed JOIN al USING (l) GROUP BY query_id),
    ranked AS (SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank, codes_scanned,
        (SELECT count(*) FROM cand WHERE cand.query_id = near.query_id) AS vectors_touched
        FROM near JOIN work USING (query_id) WHERE rank <= {fv.DEFAULT_TOP_K}){tail}"""


def _ivf_search(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = tables.load(spark, sf, "embeddings")
    queries = centroid(e, group="label").select(F.col("label").alias("query_id"), "qv")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    quantiser = ivf.train(vec, IVF_LISTS)
    index = ivf.build(vec, quantiser, scratch_path(spark, "ivf"))
    return vec, queries, ivf.probe(index, quantiser, queries, fv.DEFAULT_TOP_K, n_probe=IVF_PROBE, rerank=IVF_RERANK,
                                   digits=DIGITS)


@register("knn_ivf", _ivf_sql(" SELECT * FROM ranked"))
def q_knn_ivf(spark, sf):
    """T3 by an inverted file, with the codes scanned and vectors read for each query."""
    _, _, found = _ivf_search(spark, sf)
    return found.select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank"), "codes_scanned", "vectors_touched")


@register("knn_ivf_recall", _ivf_sql(f""",
    exact AS (SELECT query_id, id FROM (
        SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM (
            SELECT query_id, id, round(sum((q - x) * (q - x)), {DIGITS}) AS d FROM e JOIN qv USING (i) GROUP BY ALL))
        WHERE r <= {fv.DEFAULT_TOP_K})
    SELECT round(count(k.id) / count(*), {DIGITS}) AS recall,
           round(max(vectors_touched) / (SELECT count(*) FROM embeddings), {DIGITS}) AS touched_share,
           round(max(codes_scanned) / (SELECT count(*) FROM embeddings), {DIGITS}) AS scanned_share
    FROM exact LEFT JOIN ranked k USING (query_id, id)"""))
def q_knn_ivf_recall(spark, sf):
    """T3 held against T2: recall, and the largest share of vectors read and of codes scanned."""
    vec, queries, found = _ivf_search(spark, sf)
    exact = search.knn_batch(vec, queries, fv.DEFAULT_TOP_K, "l2", round_digits=DIGITS)
    total = vec.agg(F.count(F.lit(1))).scalar()
    both = exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return both.agg(r6(F.count("rank") / F.count(F.lit(1))).alias("recall"),
                    r6(F.max("vectors_touched") / total).alias("touched_share"),
                    r6(F.max("codes_scanned") / total).alias("scanned_share"))


# =========================================================================================
# Step 3: chunking G1, F19, F20, P7, P9, A2, A7
# =========================================================================================

def _chunk_cols(df: DataFrame) -> DataFrame:
    return df.select("transcript_id", "chunk_index", "text", r6(F.col("start_time")).alias("start_time"),
                     r6(F.col("end_time")).alias("end_time"), "chunk_length", "language", "source_file")


_DOC_SRC = f"""(SELECT doc_id AS id, {O.doc_clean('text')} AS cleaned, 0.0::DOUBLE AS s0,
    n_chars / 15.0::DOUBLE AS e1 FROM documents)"""
_DOC_CHUNKS = f"({O.chunk_sql(_DOC_SRC)})"


@register("chunk_documents", f"""SELECT c.id AS transcript_id, c.chunk_index, c.text,
    round(c.start_time, {DIGITS}) AS start_time, round(c.end_time, {DIGITS}) AS end_time,
    CAST(length(c.text) AS INTEGER) AS chunk_length, d.lang AS language,
    d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS source_file
    FROM {_DOC_CHUNKS} c JOIN documents d ON d.doc_id = c.id""")
def q_chunk_documents(spark, sf):
    return _chunk_cols(chunking.chunk_transcripts(tables.document_transcripts(spark, sf)))


def conversation_transcripts(spark, sf) -> DataFrame:
    seg = transcripts.clean_segments(tables.segments(spark, sf))
    t = transcripts.assemble(seg)
    return t.select("transcript_id", F.lit("en").alias("language"), "full_text", "n_segments",
                    "first_start", "last_end", F.lit("").alias("source_url"),
                    F.concat(F.lit("conversation/"), F.col("transcript_id").cast("string")).alias("source_file"),
                    F.col("last_end").alias("total_duration"),
                    F.lit(None).cast("double").alias("processing_time"), "segments")


_CONV_SRC = f"""(SELECT transcript_id AS id, {O.doc_clean('full_text')} AS cleaned, first_start AS s0,
    last_end AS e1 FROM @ASSEMBLED@)"""


def _conv_chunks_sql() -> str:
    return f"({O.chunk_sql(_CONV_SRC.replace('@ASSEMBLED@', _ASSEMBLED))})"


@register("chunk_conversations")
def q_chunk_conversations(spark, sf):
    return _chunk_cols(chunking.chunk_transcripts(conversation_transcripts(spark, sf)))


@register("chunk_counts", f"""SELECT id AS transcript_id, count(*) AS n_chunks FROM {_DOC_CHUNKS}
    GROUP BY ROLLUP (id)""")
def q_chunk_counts(spark, sf):
    return chunk_counts(chunking.chunk_transcripts(tables.document_transcripts(spark, sf), times=None))


def _windows_sql() -> str:
    clean = O.doc_clean("text")
    strip = f"regexp_replace(w, {O.q('^' + O.WS_CLASS + '+|' + O.WS_CLASS + '+$')}, '', 'g')"
    return f"""
    WITH c AS (SELECT doc_id, {clean} AS cleaned, 0.0::DOUBLE AS s0, n_chars / 15.0::DOUBLE AS e1 FROM documents),
    w AS (SELECT doc_id, cleaned, s0, e1, CAST(i AS INTEGER) AS i, substr(cleaned, 1 + 700 * i, 1000) AS w
          FROM c, range(0, CAST(ceil(length(cleaned) / 700.0) AS BIGINT)) r(i)),
    p AS (SELECT *, instr(cleaned, substr({strip}, 1, 50)) - 1 AS pos,
                 length(cleaned) / (e1 - s0) AS cps FROM w),
    t AS (SELECT *, s0 + pos / cps AS st FROM p),
    u AS (SELECT *, st + length(w) / cps AS en FROM t)
    SELECT doc_id, i, round(CASE WHEN pos >= 0 AND e1 <> s0 THEN greatest(s0, st) ELSE s0 END, {DIGITS}) AS start_time,
           round(CASE WHEN pos >= 0 AND e1 <> s0 THEN least(e1, en) ELSE e1 END, {DIGITS}) AS end_time
    FROM u"""


@register("chunk_timestamps", _windows_sql())
def q_chunk_timestamps(spark, sf):
    """F19 on every document: fixed 1000-character windows every 700 characters
    (covering the whole cleaned text) located and timed like chunks."""
    d = tables.document_transcripts(spark, sf).withColumn("cleaned", T.doc_clean("full_text"))
    n = F.ceil(F.length("cleaned") / F.lit(700.0)).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    wins = d.select("transcript_id", "cleaned", "first_start", "last_end",
                    F.when(n > 0, starts).otherwise(F.array().cast("array<int>")).alias("_w"))
    ex = V.explode_array(wins, "_w", "_p", "i")
    ex = ex.withColumn("w", F.substring("cleaned", F.col("i") * 700 + 1, 1000))
    t = chunking.estimate_times(F.col("w"), F.col("cleaned"), F.col("first_start"), F.col("last_end"))
    return ex.select(F.col("transcript_id").alias("doc_id"), F.col("i").cast("int").alias("i"),
                     r6(t["start_time"]).alias("start_time"), r6(t["end_time"]).alias("end_time"))


_ASSEMBLED = f"""(SELECT transcript_id, string_agg(t, ' ' ORDER BY seg_idx) AS full_text,
        count(*) AS n_segments, arg_min(start_time, seg_idx) AS first_start, arg_max(end_time, seg_idx) AS last_end
   FROM (SELECT *, {O.segment_clean('text')} AS t FROM {O.SEGMENTS}) WHERE t <> '' GROUP BY transcript_id)"""


ORACLES["chunk_conversations"] = f"""SELECT c.id AS transcript_id, c.chunk_index, c.text,
    round(c.start_time, {DIGITS}) AS start_time, round(c.end_time, {DIGITS}) AS end_time,
    CAST(length(c.text) AS INTEGER) AS chunk_length, 'en' AS language,
    'conversation/' || CAST(c.id AS VARCHAR) AS source_file
    FROM {_conv_chunks_sql()} c"""


@register("transcript_bounds", f"""SELECT transcript_id, n_segments, first_start, last_end FROM {_ASSEMBLED}""")
def q_transcript_bounds(spark, sf):
    t = transcripts.assemble(transcripts.clean_segments(tables.segments(spark, sf)))
    return t.select("transcript_id", F.col("n_segments").cast("bigint").alias("n_segments"),
                    "first_start", "last_end")


# =========================================================================================
# Step 4: embedding E1-E4, J2, J5, L3
# =========================================================================================

@register("embed_hash", f"""SELECT id AS doc_id, CAST(bucket AS INTEGER) AS bucket, round(weight, {DIGITS}) AS weight
    FROM {O.sparse_hash_embedding('documents', 'doc_id', 'text')}""")
def q_embed_hash(spark, sf):
    d = embedding.embed(tables.documents(spark, sf), "text", "e").select("doc_id", "e")
    return V.explode_array(d, "e", "bucket", "weight").where(F.col("weight") > 0).select(
        "doc_id", F.col("bucket").cast("int").alias("bucket"), r6(F.col("weight")).alias("weight"))


_CHUNK_KEYED = f"(SELECT id * 1000000 + chunk_index AS cid, text FROM {_DOC_CHUNKS})"


@register("chunk_embed", f"""SELECT c.id AS transcript_id, c.chunk_index, 'hashing-md5-64' AS model_name,
    64 AS dimension, round(coalesce(sqrt(sum(e.weight * e.weight)), 0.0), {DIGITS}) AS norm
    FROM {_DOC_CHUNKS} c
    LEFT JOIN {O.sparse_hash_embedding(_CHUNK_KEYED, 'cid', 'text')} e ON e.id = c.id * 1000000 + c.chunk_index
    GROUP BY c.id, c.chunk_index""")
def q_chunk_embed(spark, sf):
    chunks = chunking.chunk_transcripts(tables.document_transcripts(spark, sf), times=None)
    out = embedding.embed_chunks(chunks)
    return out.select("transcript_id", "chunk_index", "model_name", "dimension",
                      r6(V.norm("embedding")).alias("norm"))


def _seed_cache(spark, sf) -> DataFrame:
    """A cache filled by an earlier run over the English documents.

    A cache is a stored table: it is materialised (reliable checkpoint in the
    shared checkpoint folder) so that the lookups read it instead of
    recomputing it.
    """
    d = tables.documents(spark, sf).where(F.col("lang") == "en")
    emb = embedding.HashingEmbedder()
    seed = embedding.embed(d.select(T.text_key("text").alias("text_key"), "text"), "text", "embedding", emb) \
        .select(F.lit(emb.model_name).alias("model_name"), "text_key", "embedding").dropDuplicates(["text_key"])
    return seed.checkpoint(eager=True)


@register("cache_hits", """SELECT doc_id, md5(text) AS text_key FROM documents
    WHERE md5(text) IN (SELECT md5(text) FROM documents WHERE lang = 'en')""")
def q_cache_hits(spark, sf):
    hits = embedding.cache_hits(tables.documents(spark, sf), _seed_cache(spark, sf))
    return hits.select("doc_id", "text_key")


@register("cache_misses", """SELECT DISTINCT md5(text) AS text_key FROM documents
    WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')""")
def q_cache_misses(spark, sf):
    _, fresh = embedding.cache_lookup(tables.documents(spark, sf), _seed_cache(spark, sf))
    return fresh.select("text_key")


@register("cache_lookup", f"""SELECT d.doc_id, round(coalesce(sqrt(sum(e.weight * e.weight)), 0.0), {DIGITS}) AS norm,
        count(e.id) AS nonzero
    FROM documents d LEFT JOIN {O.sparse_hash_embedding('documents', 'doc_id', 'text')} e ON e.id = d.doc_id
    GROUP BY d.doc_id""")
def q_cache_lookup(spark, sf):
    res, _ = embedding.cache_lookup(tables.documents(spark, sf), _seed_cache(spark, sf))
    return res.select("doc_id", r6(V.norm("embedding")).alias("norm"),
                      F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nonzero"))


@register("cache_merge", f"""SELECT DISTINCT 'hashing-md5-64' AS model_name, md5(text) AS text_key FROM documents""")
def q_cache_merge(spark, sf):
    cache = _seed_cache(spark, sf)
    _, fresh = embedding.cache_lookup(tables.documents(spark, sf), cache)
    return embedding.cache_merge(cache, fresh).select("model_name", "text_key")


def _stored_cache(spark, sf) -> embedding.StoredCache:
    """A stored cache after two merges: the English documents, then all."""
    cache = embedding.StoredCache(spark, scratch_path(spark, "cache"))
    d = tables.documents(spark, sf)
    for part in (d.where(F.col("lang") == "en"), d):
        _, fresh = cache.lookup(part)
        cache.merge(fresh)
    return cache


@register("cache_stored", f"""SELECT 'hashing-md5-64' AS model_name, md5(d.text) AS text_key,
        round(coalesce(sqrt(sum(e.weight * e.weight)), 0.0), {DIGITS}) AS norm
    FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text) d
    LEFT JOIN {O.sparse_hash_embedding('documents', 'doc_id', 'text')} e ON e.id = d.doc_id GROUP BY d.doc_id, d.text""")
def q_cache_stored(spark, sf):
    return _stored_cache(spark, sf).read().select("model_name", "text_key", r6(V.norm("embedding")).alias("norm"))


@register("cache_clear", """SELECT * FROM (VALUES ('before', (SELECT count(DISTINCT text) FROM documents)), ('cleared', 0),
    ('read before', (SELECT count(DISTINCT text) FROM documents)),
    ('again', (SELECT count(DISTINCT text) FROM documents WHERE lang = 'en'))) t(state, cache_size)""")
def q_cache_clear(spark, sf):
    """Sizes of the stored cache before and after a clear and after it is filled again; and of a version read all along."""
    cache = _stored_cache(spark, sf)
    held = cache.read()
    sizes = [cache.size().select(F.lit("before").alias("state"), "cache_size")]
    cache.clear()
    sizes.append(cache.size().select(F.lit("cleared").alias("state"), "cache_size"))
    sizes.append(embedding.cache_size(held).select(F.lit("read before").alias("state"), "cache_size"))
    _, fresh = cache.lookup(tables.documents(spark, sf).where(F.col("lang") == "en"))
    cache.merge(fresh)
    sizes.append(cache.size().select(F.lit("again").alias("state"), "cache_size"))
    out = sizes[0]
    for size in sizes[1:]:
        out = out.unionByName(size)
    return out


def _text_search_sql() -> str:
    docs = O.sparse_hash_embedding("documents", "doc_id", "text")
    qs = O.sparse_hash_embedding("benchmark", "item_id", "text")
    return f"""
    WITH de AS {docs}, qe AS {qs},
    dn AS (SELECT doc_id AS id, coalesce((SELECT sum(weight * weight) FROM de WHERE de.id = documents.doc_id), 0.0) AS n2 FROM documents),
    qn AS (SELECT item_id AS query_id, coalesce((SELECT sum(weight * weight) FROM qe WHERE qe.id = benchmark.item_id), 0.0) AS n2 FROM benchmark),
    dots AS (SELECT qe.id AS query_id, de.id AS id, sum(qe.weight * de.weight) AS dot
             FROM qe JOIN de USING (bucket) GROUP BY ALL),
    d AS (SELECT qn.query_id, dn.id, round(greatest(qn.n2 + dn.n2 - 2 * coalesce(dots.dot, 0.0), 0.0), {DIGITS}) AS distance
          FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = dn.id)
    SELECT query_id, id, distance, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d)
    WHERE rank <= {fv.DEFAULT_TOP_K}"""


@register("knn_text_search", _text_search_sql())
def q_knn_text_search(spark, sf):
    docs = embedding.embed(tables.documents(spark, sf), "text", "embedding").select(
        F.col("doc_id").alias("id"), "embedding")
    bench = embedding.embed(tables.load(spark, sf, "benchmark"), "text", "qv").select(
        F.col("item_id").alias("query_id"), "qv")
    out = search.knn_batch(docs, bench, fv.DEFAULT_TOP_K, "l2", round_digits=DIGITS)
    return out.select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank"))


# =========================================================================================
# Step 5: URLs S1, P1-P4, F11-F13, G2-G4, T6, L4
# =========================================================================================

def _stage_url_list(spark, sf) -> str:
    """Write a URL list built from ``pages``: for each page, in order, a blank line, a comment and its
    URL, indented variously."""
    p = tables.load(spark, sf, "pages")
    pad = F.repeat(F.lit(" "), (F.col("page_id") % 3).cast("int"))
    lines = p.select("page_id", F.posexplode(F.array(
        F.concat(pad, F.lit("\t")), F.concat(pad, F.lit("# "), F.col("url")), F.concat(pad, F.col("url"), pad))).alias("n", "line"))
    path = scratch_path(spark, "urls")
    url_list.write_url_list(lines.orderBy("page_id", "n"), path)
    return path


@register("url_list_scan", "SELECT 3 * (row_number() OVER (ORDER BY page_id) - 1) + 2 AS url_ord, url FROM pages")
def q_url_list_scan(spark, sf):
    return url_list.read_url_list(spark, _stage_url_list(spark, sf)).select("url_ord", "url")


@register("url_allowed_domain", f"SELECT url_ord, url FROM {O.URLS} WHERE {O.allowed_domain('url')}")
def q_url_allowed_domain(spark, sf):
    return tables.urls(spark, sf).where(U.allowed_domain("url"))


@register("url_supported_host", f"SELECT url_ord, url, {O.supported_host('url')} AS supported FROM {O.URLS}")
def q_url_supported_host(spark, sf):
    return tables.urls(spark, sf).select("url_ord", "url", U.supported_host("url").alias("supported"))


@register("url_kind", f"""SELECT url_ord, {O.url_kind('url')} AS kind, {O.is_playlist('url')} AS is_playlist,
    {O.is_channel('url')} AS is_channel FROM {O.URLS}""")
def q_url_kind(spark, sf):
    return tables.urls(spark, sf).select("url_ord", U.url_kind("url").alias("kind"),
                                         U.is_playlist("url").alias("is_playlist"),
                                         U.is_channel("url").alias("is_channel"))


@register("playlist_canonical", f"""SELECT url_ord, CASE WHEN {O.playlist_id('url')} IS NOT NULL
    THEN '{fv.PLAYLIST_URL_PREFIX}' || {O.playlist_id('url')} ELSE url END AS canonical FROM {O.URLS}""")
def q_playlist_canonical(spark, sf):
    return tables.urls(spark, sf).select("url_ord", U.playlist_canonical("url").alias("canonical"))


@register("channel_listing_url", f"""SELECT url_ord, CASE WHEN {O.any_contains('url', fv.CHANNEL_LISTING_MARKERS)}
    THEN url || '/videos' ELSE url END AS listing_url FROM {O.URLS}""")
def q_channel_listing_url(spark, sf):
    return tables.urls(spark, sf).select("url_ord", U.channel_listing_url("url").alias("listing_url"))


def _expand_sql(kind: str, limit: int, drop_self: bool) -> str:
    key = f"coalesce({O.playlist_id('u.url')}, u.url)" if kind == "playlist" else O.last_segment("u.url")
    lim = f"AND c.pos <= {limit}" if limit > 0 else ""
    self_f = f"AND c.item_id <> {O.last_segment('u.url')}" if drop_self else ""
    return f"""SELECT u.url_ord, c.pos AS sub_ord, '{fv.ITEM_URL_PREFIX}' || c.item_id AS url
        FROM {O.URLS} u JOIN {O.CATALOGUE} c ON c.container_id = {key}
        WHERE {O.url_kind('u.url')} = '{kind}' AND c.item_id IS NOT NULL {lim} {self_f}"""


@register("channel_expand", _expand_sql("channel", fv.DEFAULT_CHANNEL_LIMIT, True))
def q_channel_expand(spark, sf):
    u = tables.urls(spark, sf).where(U.url_kind("url") == "channel")
    return expansion.channel_expand(u, tables.catalogue(spark, sf), fv.DEFAULT_CHANNEL_LIMIT).select(
        "url_ord", "sub_ord", "url")


@register("playlist_expand", _expand_sql("playlist", 0, False))
def q_playlist_expand(spark, sf):
    u = tables.urls(spark, sf).where(U.url_kind("url") == "playlist")
    return expansion.playlist_expand(u, tables.catalogue(spark, sf), 0).select("url_ord", "sub_ord", "url")


def _route_sql(limit: int) -> str:
    allowed = f"(SELECT * FROM {O.URLS} WHERE {O.allowed_domain('url')})"
    return f"""
    SELECT url_ord, 0 AS sub_ord, url, 'item' AS kind FROM {allowed} WHERE {O.url_kind('url')} = 'item'
    UNION ALL
    SELECT u.url_ord, c.pos AS sub_ord, '{fv.ITEM_URL_PREFIX}' || c.item_id AS url, {O.url_kind('u.url')} AS kind
    FROM {allowed} u JOIN {O.CATALOGUE} c
      ON c.container_id = CASE WHEN {O.url_kind('u.url')} = 'playlist' THEN coalesce({O.playlist_id('u.url')}, u.url)
                               WHEN {O.url_kind('u.url')} = 'channel' THEN {O.last_segment('u.url')} END
    WHERE c.item_id IS NOT NULL AND c.pos <= {limit}
      AND ({O.url_kind('u.url')} = 'playlist' OR c.item_id <> {O.last_segment('u.url')})"""


@register("url_route", _route_sql(fv.DEFAULT_CHANNEL_LIMIT))
def q_url_route(spark, sf):
    return expansion.route(tables.urls(spark, sf), tables.catalogue(spark, sf), fv.DEFAULT_CHANNEL_LIMIT)


@register("url_union", f"""SELECT 0 AS list_ord, url_ord, url FROM {O.URLS}
    UNION ALL SELECT 1 AS list_ord, page_id AS url_ord, url FROM pages""")
def q_url_union(spark, sf):
    raw = tables.load(spark, sf, "pages").select(F.col("page_id").alias("url_ord"), "url")
    return expansion.url_union(tables.urls(spark, sf), raw)


@register("url_work_list", f"""
    WITH lists AS (SELECT 0 AS list_ord, row_number() OVER (ORDER BY url_ord) - 1 AS line, url_ord FROM {O.URLS}
                   UNION ALL SELECT 1 AS list_ord, url_ord AS line, url_ord FROM {O.URLS})
    SELECT list_ord, line AS url_ord, sub_ord, url, kind,
        CASE WHEN {O.supported_host('url')} THEN 'valid' ELSE 'invalid' END AS status
    FROM ({_route_sql(fv.DEFAULT_CHANNEL_LIMIT)}) r JOIN lists USING (url_ord)""")
def q_url_work_list(spark, sf):
    """L4: a list file, then the same URLs from the command line, each with the order columns of the work."""
    path = scratch_path(spark, "urllist")
    u = tables.urls(spark, sf)
    url_list.write_url_list(u.orderBy("url_ord").select(F.col("url").alias("line")), path)
    out = flows.url_work_list(spark, [path], u, tables.catalogue(spark, sf), fv.DEFAULT_CHANNEL_LIMIT)
    return out.select(F.col("url_ord.list_ord").alias("list_ord"), F.col("url_ord.line").alias("url_ord"),
                      "sub_ord", "url", "kind", "status")


# =========================================================================================
# Step 6: transcripts S2-S6, A1-A4, P5, F15
# =========================================================================================

@register("transcript_assemble", f"SELECT transcript_id, full_text, n_segments FROM {_ASSEMBLED}")
def q_transcript_assemble(spark, sf):
    t = transcripts.assemble(transcripts.clean_segments(tables.segments(spark, sf)))
    return t.select("transcript_id", "full_text", F.col("n_segments").cast("bigint").alias("n_segments"))


@register("run_summary", f"""SELECT count(*) AS n_transcripts, coalesce(sum(coalesce(last_end, 0.0)), 0.0) AS total_duration,
    CAST(coalesce(sum(n_segments), 0) AS BIGINT) AS total_segments FROM {_ASSEMBLED}""")
def q_run_summary(spark, sf):
    t = transcripts.assemble(transcripts.clean_segments(tables.segments(spark, sf)))
    return transcripts.run_summary(t.withColumn("duration", F.col("last_end")))


@register("batch_outcomes", f"""SELECT CASE WHEN l.file_path IS NULL THEN 'missing'
        WHEN coalesce(m.size_bytes, 1) = 0 THEN 'empty' ELSE 'valid' END AS status, count(*) AS n
    FROM {O.MEDIA} m LEFT JOIN {O.LISTING} l USING (file_path) GROUP BY ALL""")
def q_batch_outcomes(spark, sf):
    st = transcripts.media_status(tables.media_manifest(spark, sf), tables.file_listing(spark, sf))
    return transcripts.batch_outcomes(st)


@register("run_outcomes", f"""
    WITH m AS (SELECT *, l.file_path IS NOT NULL AND coalesce(size_bytes, 1) <> 0 AS valid
               FROM {O.MEDIA} m LEFT JOIN {O.LISTING} l USING (file_path))
    SELECT 'invalid' AS status, count(*) AS n FROM m WHERE NOT valid
    UNION ALL SELECT 'success', count(*) FROM m WHERE valid AND CAST(file_path AS BIGINT) % 50 <> 1
    UNION ALL SELECT 'failed', count(*) FROM m WHERE valid AND CAST(file_path AS BIGINT) % 50 = 1""")
def q_run_outcomes(spark, sf):
    """A4 over a run: a document for every valid medium, of which some have names that can't be written."""
    m = tables.media_manifest(spark, sf)
    bad = F.col("file_path").cast("bigint") % 50 == 1
    docs = m.select("file_path", F.concat(F.when(bad, F.lit("no folder/")).otherwise(F.lit("")), F.col("file_path"),
                                          F.lit(".md")).alias("file_name"), F.col("source_url").alias("content"))
    return transcripts.run_batch(m, tables.file_listing(spark, sf), docs, scratch_path(spark, "run"))


@register("media_valid", f"""SELECT file_path, size_bytes FROM {O.MEDIA}
    WHERE file_path IN (SELECT file_path FROM {O.LISTING}) AND coalesce(size_bytes, 1) <> 0""")
def q_media_valid(spark, sf):
    v = transcripts.valid_media(tables.media_manifest(spark, sf), tables.file_listing(spark, sf))
    return v.select("file_path", "size_bytes")


@register("segment_source", f"""SELECT transcript_id, seg_idx, text, start_time, end_time, confidence FROM {O.SEGMENTS}""")
def q_segment_source(spark, sf):
    """The segments written as JSON lines (null scores absent) and read back."""
    path = scratch_path(spark, "segments")
    tables.segments(spark, sf).write.json(path)
    return segments.read_segments(spark, path)


@register("transcripts_sorted", f"""SELECT CAST(row_number() OVER (ORDER BY 'transcript_' || CAST(transcript_id AS VARCHAR) || '.md') - 1 AS BIGINT) AS place,
    transcript_id FROM {_ASSEMBLED}""")
def q_transcripts_sorted(spark, sf):
    """T4: documents loaded in the order of their paths; the place is the row's number in that order."""
    t = transcript_md.load_transcripts(spark, _written_docs(spark, sf), ordered=True)
    tid = F.regexp_extract("transcript_id", r"transcript_(\d+)\.md$", 1).cast("bigint")
    path = scratch_path(spark, "sorted")
    t.select(tid.alias("transcript_id"), F.monotonically_increasing_id().alias("_row"),
             F.spark_partition_id().alias("_part")).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = (rows.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    return rows.join(parts, "_part").select((F.col("_row") - F.col("_first") + F.col("_before")).alias("place"), "transcript_id")


def rendered_transcripts(spark, sf) -> DataFrame:
    t = transcripts.assemble(transcripts.clean_segments(tables.segments(spark, sf)))
    t = t.withColumn("language", F.lit("zh")).withColumn(
        "source_url", F.when(F.col("transcript_id") % 2 == 0,
                             F.concat(F.lit("https://b23.tv/"), F.col("transcript_id").cast("string"))))
    return transcript_md.render(t)


_RENDER_SQL = f"""
    WITH s AS (SELECT *, {O.segment_clean('text')} AS t FROM {O.SEGMENTS}),
    k AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seg_idx) AS i FROM s WHERE t <> ''),
    g AS (SELECT transcript_id, string_agg(t, ' ' ORDER BY seg_idx) AS full_text,
                 string_agg(printf('%3d. [%.1fs - %.1fs] %s', i, start_time, end_time, t) || chr(10), '' ORDER BY seg_idx) AS lines
          FROM k GROUP BY transcript_id)
    SELECT transcript_id,
           '{fv.MD_TITLE}' || chr(10) || '{fv.MD_LANGUAGE}: zh' || chr(10) ||
           CASE WHEN transcript_id % 2 = 0 THEN '{fv.MD_SOURCE}: https://b23.tv/' || CAST(transcript_id AS VARCHAR) || chr(10) ELSE '' END ||
           chr(10) || '{fv.MD_FULL_TEXT}' || chr(10) || full_text || chr(10) || chr(10) ||
           '{fv.MD_SEGMENTS}' || chr(10) || lines AS content
    FROM g"""


@register("transcript_md_render", _RENDER_SQL)
def q_transcript_md_render(spark, sf):
    return rendered_transcripts(spark, sf).select("transcript_id", "content")


@register("transcript_file_names", f"""SELECT transcript_id, 'transcript_{FIXED_TS}_' ||
    CASE WHEN transcript_id % 2 = 0 THEN substr(md5('https://b23.tv/' || CAST(transcript_id AS VARCHAR)), 1, 8)
         ELSE printf('%03d', transcript_id) END || '.md' AS file_name
    FROM {_ASSEMBLED}""")
def q_transcript_file_names(spark, sf):
    named = transcript_md.file_names(rendered_transcripts(spark, sf), F.lit(FIXED_TS))
    return named.select("transcript_id", "file_name")


def _written_docs(spark, sf) -> str:
    docs = rendered_transcripts(spark, sf).withColumn(
        "file_name", F.concat(F.lit("transcript_"), F.col("transcript_id").cast("string"), F.lit(".md")))
    path = scratch_path(spark, "md")
    status = transcript_md.write_documents(docs, path)
    failed = status.where(F.col("status") != "ok").count()
    if failed:
        raise RuntimeError(f"{failed} transcript documents could not be written")
    return path


@register("transcript_md_parse", f"""
    WITH s AS (SELECT *, {O.segment_clean('text')} AS t FROM {O.SEGMENTS} WHERE {O.segment_clean('text')} <> ''),
    g AS (SELECT transcript_id, string_agg(t, ' ' ORDER BY seg_idx) AS full_text, count(*) AS n_segments,
                 arg_min(start_time, seg_idx) AS first_start, arg_max(end_time, seg_idx) AS last_end
          FROM s GROUP BY transcript_id)
    SELECT transcript_id, 'zh' AS language,
           CASE WHEN transcript_id % 2 = 0 THEN 'https://b23.tv/' || CAST(transcript_id AS VARCHAR) END AS source_url,
           trim(regexp_replace(full_text, {O.q(O.WS_CLASS + '+')}, ' ', 'g'), ' ') AS full_text,
           n_segments, first_start, last_end
    FROM g""")
def q_transcript_md_parse(spark, sf):
    t = transcript_md.load_transcripts(spark, _written_docs(spark, sf))
    tid = F.regexp_extract("transcript_id", r"transcript_(\d+)\.md$", 1).cast("bigint")
    return t.select(tid.alias("transcript_id"), "language", "source_url", "full_text",
                    F.col("n_segments").cast("bigint").alias("n_segments"), "first_start", "last_end")


@register("md_segments", f"""
    WITH s AS (SELECT *, {O.segment_clean('text')} AS t FROM {O.SEGMENTS} WHERE {O.segment_clean('text')} <> '')
    SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY seg_idx) - 1 AS INTEGER) AS seg_idx,
           t AS text, round(start_time, 1) AS start_time, round(end_time, 1) AS end_time FROM s""")
def q_md_segments(spark, sf):
    docs = transcript_md.read_documents(spark, _written_docs(spark, sf))
    tid = F.regexp_extract("file_path", r"transcript_(\d+)\.md$", 1).cast("bigint")
    parsed = docs.select(tid.alias("transcript_id"), transcript_md.parse_segments(F.col("content")).alias("segs"))
    seg = V.explode_array(parsed, "segs", "_i", "s")
    return seg.select("transcript_id", "s.seg_idx", "s.text", "s.start_time", "s.end_time")


@register("media_manifest", f"""SELECT 'transcript_' || CAST(transcript_id AS VARCHAR) || '.md' AS file_name,
    CAST(strlen(content) AS BIGINT) AS size_bytes, 'md' AS format FROM ({_RENDER_SQL})""")
def q_media_manifest(spark, sf):
    listing = media.list_media(spark, _written_docs(spark, sf), "*.md")
    return listing.select(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file_name"),
                          "size_bytes", "format")


@register("media_info", f"""SELECT 'transcript_' || CAST(r.transcript_id AS VARCHAR) || '.md' AS file_name,
    CAST(strlen(content) AS BIGINT) AS size_bytes, 'md' AS format,
    CASE WHEN r.transcript_id % 3 <> 0 THEN last_end END AS duration,
    CASE WHEN r.transcript_id % 3 <> 0 THEN '{fv.ITEM_URL_PREFIX}' || CAST(r.transcript_id AS VARCHAR) END AS source_url
    FROM ({_RENDER_SQL}) r JOIN {_ASSEMBLED} a ON a.transcript_id = r.transcript_id""")
def q_media_info(spark, sf):
    """Files listed from storage, with duration and address from info files, which a third of them lack."""
    t = transcripts.assemble(transcripts.clean_segments(tables.segments(spark, sf)))
    key = F.col("transcript_id").cast("string")
    infos = scratch_path(spark, "infos")
    t.where(F.col("transcript_id") % 3 != 0).select(
        F.concat(F.lit("transcript_"), key).alias("id"), F.col("last_end").alias("duration"),
        F.concat(F.lit(fv.ITEM_URL_PREFIX), key).alias("webpage_url")).write.json(infos)
    listing = segments.with_info(media.list_media(spark, _written_docs(spark, sf), "*.md"), segments.read_media_info(spark, infos))
    return listing.select(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("file_name"), "size_bytes", "format",
                          "duration", "source_url")


# =========================================================================================
# Step 7: collections S7, C1, C2, A5, A6, F21, L1-L3
# =========================================================================================

def _doc_items(spark, sf) -> DataFrame:
    d = tables.documents(spark, sf)
    return d.select("text", F.col("doc_id").alias("transcript_id"), F.lit(0).alias("chunk_index"),
                    F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("source_file"),
                    F.col("lang").alias("language"), F.col("source").alias("collection"),
                    F.create_map(F.lit("source"), F.col("source"), F.lit("topic"), F.col("lang"),
                                 F.lit("chunk_index"), F.lit("0")).alias("extra"))


def _kb(spark) -> KnowledgeBase:
    return KnowledgeBase(spark, scratch_path(spark, "kb"))


@register("kb_append", """SELECT source AS collection, 2 * count(*) AS n FROM documents GROUP BY source""")
def q_kb_append(spark, sf):
    kb = _kb(spark)
    items = _doc_items(spark, sf)
    kb.append_by_column(items, "collection")
    kb.append_by_column(items, "collection")
    return kb.all_rows().groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@register("kb_dedupe", """SELECT source AS collection, count(DISTINCT text) AS n FROM documents GROUP BY source""")
def q_kb_dedupe(spark, sf):
    """S7 with ``dedupe_on``: half of the documents, then all of them twice; equal texts of a collection are stored once."""
    kb = _kb(spark)
    items = _doc_items(spark, sf)
    kb.append_by_column(items.where(F.col("transcript_id") % 2 == 0), "collection", dedupe_on=["text_key"])
    kb.append_by_column(items, "collection", dedupe_on=["text_key"])
    kb.append_by_column(items, "collection", dedupe_on=["text_key"])
    return kb.all_rows().groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@register("kb_compact", """SELECT source AS collection, text_key, count(*) AS n FROM (
      SELECT source, md5(text) AS text_key FROM documents
      UNION ALL SELECT source, md5(text) FROM documents WHERE doc_id % 2 = 1
      UNION ALL SELECT 'lang_' || lang, md5(text) FROM documents WHERE lang <> 'en') GROUP BY ALL""")
def q_kb_compact(spark, sf):
    """Three appends and a drop, rewritten as one clustered batch; the rows are the same."""
    kb = _kb(spark)
    items = _doc_items(spark, sf)
    kb.append_by_column(items, "collection")
    kb.append_by_column(items.where(F.col("transcript_id") % 2 == 1), "collection")
    kb.append_by_column(items.withColumn("collection", F.concat(F.lit("lang_"), F.col("language"))), "collection")
    kb.drop("lang_en")
    kb.compact()
    kb.vacuum()
    return kb.all_rows().groupBy("collection", "text_key").agg(F.count(F.lit(1)).alias("n"))


@register("kb_create", """SELECT DISTINCT source AS name, 'first ' || source AS description FROM documents""")
def q_kb_create(spark, sf):
    kb = _kb(spark)
    srcs = tables.documents(spark, sf).select(F.col("source").alias("name")).distinct()
    kb.create_many(srcs.select("name", F.concat(F.lit("first "), F.col("name")).alias("description")))
    kb.create_many(srcs.select("name", F.concat(F.lit("second "), F.col("name")).alias("description")))
    return kb.registry()


@register("kb_list", """SELECT name, description, document_count FROM (
      SELECT source AS name, 'Collection ' || source AS description, count(*) AS document_count FROM documents GROUP BY source
      UNION ALL
      SELECT DISTINCT 'lang_' || lang AS name, 'described ' || lang AS description, 0 AS document_count FROM documents)""")
def q_kb_list(spark, sf):
    kb = _kb(spark)
    d = tables.documents(spark, sf)
    kb.create_many(d.select(F.concat(F.lit("lang_"), F.col("lang")).alias("name"),
                            F.concat(F.lit("described "), F.col("lang")).alias("description")))
    kb.append_by_column(_doc_items(spark, sf), "collection")
    return kb.list()


@register("kb_drop", """SELECT source AS name, count(*) AS document_count FROM documents GROUP BY source""")
def q_kb_drop(spark, sf):
    kb = _kb(spark)
    d = tables.documents(spark, sf)
    items = _doc_items(spark, sf)
    kb.append_by_column(items, "collection")
    kb.append_by_column(items.withColumn("collection", F.concat(F.lit("lang_"), F.col("language"))), "collection")
    kb.drop_many(d.select(F.concat(F.lit("lang_"), F.col("lang")).alias("name")))
    return kb.list().select("name", "document_count")


@register("kb_stats", f"""SELECT '{fv.DEFAULT_COLLECTION}' AS name, count(*) AS document_count FROM documents""")
def q_kb_stats(spark, sf):
    kb = _kb(spark)
    kb.append(_doc_items(spark, sf))
    kb.append_by_column(_doc_items(spark, sf), "collection")
    return kb.stats().select("name", "document_count")


#: Words of the documents, in three of their languages.
STORED_QUERY = "the name of the people and la lumiere de le temps und der tag"
_STORED_QUERY = f"(SELECT 0 AS qid, '{STORED_QUERY}' AS q)"


@register("kb_search_stored", f"""
    WITH de AS {O.sparse_hash_embedding("documents", "doc_id", "text")},
    qe AS {O.sparse_hash_embedding(_STORED_QUERY, "qid", "q")},
    d AS (SELECT documents.doc_id, documents.text, source || '/' || CAST(doc_id AS VARCHAR) AS source_file,
                 round(coalesce((SELECT sum(weight * weight) FROM qe), 0.0)
                 + coalesce((SELECT sum(weight::FLOAT::DOUBLE * weight::FLOAT::DOUBLE) FROM de WHERE de.id = documents.doc_id), 0.0)
                 - 2 * coalesce((SELECT sum(qe.weight * de.weight::FLOAT::DOUBLE) FROM qe JOIN de USING (bucket)
                                 WHERE de.id = documents.doc_id), 0.0), {DIGITS}) AS distance FROM documents)
    SELECT CAST(row_number() OVER (ORDER BY distance, source_file) AS INTEGER) AS rank,
           round(greatest(0.0, 1.0 - distance), 4) AS score, distance, source_file, text FROM d
    ORDER BY distance, source_file LIMIT {fv.DEFAULT_TOP_K}""")
def q_kb_search_stored(spark, sf):
    """L3 over a stored collection: build it, embed the query, search, report."""
    kb = _kb(spark)
    kb.append(embedding.embed_chunks(_doc_items(spark, sf)))
    hits = flows.demo_search(kb, STORED_QUERY)
    return hits.select(F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score"), "distance",
                       "source_file", "text")


@register("metadata_strip", """SELECT doc_id, k AS key, v AS value FROM (
      SELECT doc_id, 'source' AS k, source AS v FROM documents
      UNION ALL SELECT doc_id, 'topic' AS k, lang AS v FROM documents)""")
def q_metadata_strip(spark, sf):
    d = tables.documents(spark, sf)
    extra = F.create_map(F.lit("source"), F.col("source"), F.lit("topic"), F.col("lang"),
                         F.lit("start_time"), F.lit("0.0"), F.lit("chunk_index"), F.lit("0"),
                         F.lit("model_name"), F.lit("m"), F.lit("dimension"), F.lit("64"))
    kept = d.select("doc_id", search.strip_metadata(extra).alias("m"))
    return kept.select("doc_id", F.explode("m").alias("key", "value"))


@register("kb_build", f"""SELECT d.source AS name, 'Collection ' || d.source AS description, count(*) AS document_count
    FROM {_DOC_CHUNKS} c JOIN documents d ON d.doc_id = c.id GROUP BY d.source""")
def q_kb_build(spark, sf):
    kb = _kb(spark)
    return flows.build_by_column(tables.document_transcripts(spark, sf), kb, "collection")


@register("kb_reindex")
def q_kb_reindex(spark, sf):
    """L2: render -> write -> read back -> chunk -> embed -> append; the stats
    without the (scratch) storage path."""
    kb = _kb(spark)
    return flows.reindex_transcripts(spark, _written_docs(spark, sf), kb).select("name", "document_count")


def _report_sql() -> str:
    return f"""
    WITH r AS ({_text_search_sql()})
    SELECT r.query_id, r.rank, round(greatest(0.0, 1.0 - r.distance), {DIGITS}) AS score,
      '{fv.REPORT_RESULT}' || CAST(r.rank AS VARCHAR) || '{fv.REPORT_SCORE}' || printf('%.3f', greatest(0.0, 1.0 - r.distance)) || '{fv.REPORT_END}' || chr(10) ||
      '{fv.REPORT_TEXT}' || substr(d.text, 1, 300) || '...' || chr(10) ||
      CASE WHEN d.n_chars % 4 <> 0 THEN '{fv.REPORT_TIME}' || printf('%.1f', d.n_chars / 7.0::DOUBLE) || 's - ' || printf('%.1f', d.n_chars / 5.0::DOUBLE) || 's' || chr(10) ELSE '' END ||
      '{fv.REPORT_SOURCE}' || d.source AS report
    FROM r JOIN documents d ON d.doc_id = r.id"""


@register("search_report", _report_sql())
def q_search_report(spark, sf):
    res = q_knn_text_search(spark, sf)
    d = tables.load(spark, sf, "documents")
    j = res.join(d.select(F.col("doc_id").alias("id"), "text", "n_chars", F.col("source").alias("source_file")), "id")
    j = j.withColumn("start_time", F.when(F.col("n_chars") % 4 != 0, F.col("n_chars") / 7.0).otherwise(0.0)) \
         .withColumn("end_time", F.col("n_chars") / 5.0) \
         .withColumn("score", V.distance_to_score("distance"))
    rep = search.report(j, 300)
    return rep.select("query_id", "rank", r6(F.col("score")).alias("score"), "report")


def _chunk_search_sql() -> str:
    chunks = O.sparse_hash_embedding("ck", "cid", "text")
    qs = O.sparse_hash_embedding("benchmark", "item_id", "text")
    return f"""
    WITH c AS {_DOC_CHUNKS},
    ck AS (SELECT c.id * 1000000 + c.chunk_index AS cid,
                  CAST(c.id AS VARCHAR) || ':' || CAST(c.chunk_index AS VARCHAR) AS sid,
                  c.text, c.start_time, c.end_time,
                  d.source || '/' || CAST(d.doc_id AS VARCHAR) || '.md' AS source_file
           FROM c JOIN documents d ON d.doc_id = c.id),
    ce AS {chunks}, qe AS {qs},
    cn AS (SELECT cid, sid, coalesce((SELECT sum(weight * weight) FROM ce WHERE ce.id = ck.cid), 0.0) AS n2 FROM ck),
    qn AS (SELECT item_id AS query_id, coalesce((SELECT sum(weight * weight) FROM qe WHERE qe.id = benchmark.item_id), 0.0) AS n2 FROM benchmark),
    dots AS (SELECT qe.id AS query_id, ce.id AS cid, sum(qe.weight * ce.weight) AS dot
             FROM qe JOIN ce USING (bucket) GROUP BY ALL),
    d AS (SELECT qn.query_id, cn.cid, cn.sid,
                 round(greatest(qn.n2 + cn.n2 - 2 * coalesce(dots.dot, 0.0), 0.0), {DIGITS}) AS distance
          FROM qn CROSS JOIN cn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.cid = cn.cid),
    r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, sid) AS INTEGER) AS rank
                         FROM d) WHERE rank <= {fv.DEFAULT_TOP_K})
    SELECT r.query_id, r.rank, r.sid AS id, r.distance, round(greatest(0.0, 1.0 - r.distance), {DIGITS}) AS score,
      '{fv.REPORT_RESULT}' || CAST(r.rank AS VARCHAR) || '{fv.REPORT_SCORE}' || printf('%.3f', greatest(0.0, 1.0 - r.distance)) || '{fv.REPORT_END}' || chr(10) ||
      '{fv.REPORT_TEXT}' || substr(ck.text, 1, 300) || '...' || chr(10) ||
      CASE WHEN ck.start_time <> 0 THEN '{fv.REPORT_TIME}' || printf('%.1f', ck.start_time) || 's - ' || printf('%.1f', ck.end_time) || 's' || chr(10) ELSE '' END ||
      '{fv.REPORT_SOURCE}' || ck.source_file AS report
    FROM r JOIN ck ON ck.cid = r.cid"""


@register("kb_search", _chunk_search_sql())
def q_kb_search(spark, sf):
    """L3 flagship: chunks of every document, nearest chunks to each benchmark passage."""
    chunks = chunking.chunk_transcripts(tables.document_transcripts(spark, sf))
    vec = embedding.embed_chunks(chunks).select(
        F.concat_ws(":", F.col("transcript_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"),
        "embedding", "text", "start_time", "end_time", "source_file")
    bench = embedding.embed(tables.load(spark, sf, "benchmark"), "text", "qv").select(
        F.col("item_id").alias("query_id"), "qv")
    hits = search.knn_batch(vec, bench, fv.DEFAULT_TOP_K, "l2", round_digits=DIGITS,
                            payload=["text", "start_time", "end_time", "source_file"])
    rep = search.report(search.with_scores(hits), 300)
    return rep.select("query_id", "rank", "id", "distance", r6(F.col("score")).alias("score"), "report")


# The re-indexed documents carry the conversation transcripts' text unchanged,
# so the collection holds exactly their chunks.
ORACLES["kb_reindex"] = f"""SELECT '{fv.DEFAULT_COLLECTION}' AS name, count(*) AS document_count
    FROM {_conv_chunks_sql()} c"""
