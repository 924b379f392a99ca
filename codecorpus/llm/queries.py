"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    align, crosspoly, lattice, licences, lm, matrices, middle, minhash, packing, pivots, quality, repeats, tokens, warc,
)
from .tables import read_table, stored

Query = Callable[[SparkSession, str], DataFrame]

WORDS_SQL = r"""
words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents)"""

OP8_SQL = f"""
WITH RECURSIVE {WORDS_SQL},
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
    FROM words),
sized AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM sets),
posts AS (SELECT doc_id, unnest(sh) AS s FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM posts a JOIN posts b
    ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN sized x ON x.doc_id = c.a JOIN sized y ON y.doc_id = c.b
    WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION
    SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sized s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.n"""


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s QUALIFY rank <= 20"""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.a AS vec_id, coalesce(n.n, 0) AS n_links, component_id, r.a = component_id AS kept
FROM roots r LEFT JOIN n ON n.a = r.a"""


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g
    FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
run AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
        SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh
        FROM hit)) GROUP BY doc_id, k),
part AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM run),
cut AS (SELECT p.doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS e,
        string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept
    FROM part p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


def op1_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tokens.pieces(read_table(spark, sf_dir, "documents"), 2048)
    return packing.pack(cut, 2048, ("doc_id", "piece"))


def op4_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                         read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    out = lm.scored(read_table(spark, sf_dir, "documents"), ~held)
    return out.withColumn("held_out", held)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, t, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS best FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100',
    '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][
    strpos('0123456789abcdef', substr(x, i, 1))]), '') AS b FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, 5 * k + j + 1, 1) AS INTEGER) * (16 >> j)))
        AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id < best THEN best END AS refers_to
FROM bits"""


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(read_table(spark, sf_dir, "pages"), with_payload=False)
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_segment_tree_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrices.written(read_table(spark, sf_dir, "documents"), capacity=2048)
    return rows.select("sequence_id", "n_tokens", F.crc32("input_ids").alias("matrix_crc32"), "cu_seqlens",
                       "position_resets", "doc_ids", "pieces", "starts")


def op10_n_best_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.segmented(read_table(spark, sf_dir, "documents"), n=3)


def op11_byte_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.aligned(read_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = stored(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"), "aligned")
    return align.with_counts(rows, align.pair_counts(rows))


OP12_SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''),
        '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, us, CAST(len(us) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3,
    CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid,
    array_to_string(us[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


def op12_swar_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scanned(read_table(spark, sf_dir, "documents"))
    starts, base = F.transform("phrases", lambda p: p["start"]), F.transform("phrases", lambda p: p["label"])
    own = F.transform("spans", lambda s: s["label"])
    return out.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, own)), ",").alias("labels"), "score")


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_pivot_table": op1_pivot_table,
    "op2_run_length_index": op2_run_length_index,
    "op3_dominance_packing": op3_dominance_packing,
    "op4_quadratic_discriminant": op4_quadratic_discriminant,
    "op5_segment_tree_matrices": op5_segment_tree_matrices,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_backoff_automaton": op7_backoff_automaton,
    "op8_superminhash": op8_superminhash,
    "op9_cross_polytope": op9_cross_polytope,
    "op10_n_best_lattice": op10_n_best_lattice,
    "op11_byte_incidence": op11_byte_incidence,
    "op12_swar_middle": op12_swar_middle,
    "op13_licence_automaton": op13_licence_automaton,
}
ORACLES: dict[str, str] = {
    "op1_pivot_table": OP1_SQL,
    "op2_run_length_index": OP2_SQL,
    "op6_arc_to_warc": OP6_SQL,
    "op8_superminhash": OP8_SQL,
    "op9_cross_polytope": OP9_SQL,
    "op12_swar_middle": OP12_SQL,
}
