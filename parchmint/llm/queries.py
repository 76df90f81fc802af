"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_by_source

    out = mix_by_source(_table(spark, sf_dir, "documents"))
    own = F.col("_targets")[0]
    return out.select("doc_id", F.col("_size").alias("size"), own["source_size"].alias("source_size"), own["target"].alias("target"), F.col("_taken").alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as own

    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), own.path("byte_bpe_50k.json"), own.path("byte_bpe_50k.tiktoken"), own.PATTERN)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import link_vectors

    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import dedup_windows

    out = dedup_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import even_tree, shard

    out = shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), even_tree(16), even_tree(17))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import dedup_exact

    return dedup_exact(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as own

    from .tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), own.path("word_bpe_49k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import collapse_runs, strongest, with_planted_periods

    docs = with_planted_periods(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    out = collapse_runs(docs).withColumn("best", strongest(F.col("runs")))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    out = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language": op6_language,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: The word and line rules as DuckDB's RE2 takes them.
_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
        low AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
        bad AS (SELECT DISTINCT win.doc_id, s FROM win JOIN low USING (h) WHERE d < win.doc_id),
        gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 50)) AS i FROM bad)),
        each AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
        kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (g.i IS NULL) AS t FROM each LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op4_vector_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op9_exact_dedup": """
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM docs WINDOW w AS (PARTITION BY text)
    """,
    "op10_line_dedup": rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
        keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), {_LOWER}) AS k FROM lines),
        often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN often o USING (k) GROUP BY r
    """,
    "op12_periodic_runs": r"""
        WITH given AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        bits AS (SELECT *, len(ws) AS n, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k) & 1))) AS bits FROM given),
        summed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM bits),
        drawn AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM summed),
        texts AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM drawn),
        each AS (SELECT r, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM texts),
        again AS (SELECT x.r, y.i - x.i AS q, x.i FROM each x JOIN each y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        rows_ AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM again),
        long AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM rows_ GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT r, start, length, min(q) AS period FROM long GROUP BY r, start, length),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs),
        told AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
            sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM texts LEFT JOIN told USING (r) LEFT JOIN kept USING (r) LEFT JOIN (FROM ranked WHERE k = 1) USING (r)
    """,
    "op13_fill_in_middle": r"""
        WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
        drawn AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2, ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM cut),
        formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts
    """,
}
