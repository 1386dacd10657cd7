"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman, iblt, kdtree, kernel, langid, mixing, neardup, pieces, rules, substring, toxicity, warc, whitening
from .shared import Scratch, documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("archives")
    warc.write_archives(documents(spark, sf_dir, "pages"), path)
    r = warc.read_archives(spark, path)
    return r.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    stats = Scratch(spark).table(rules.with_statistics(docs).drop("text"), "statistics")
    learned = rules.learn(rules.labelled_statistics(stats, documents(spark, sf_dir, "labels")))
    columns = [*rules.BASE, "base_failed", "kept", "rejected_by", *rules.MORE]
    return rules.judge(stats, learned).select("doc_id", *columns)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that no model decides."""
    stats = rules.with_statistics(documents(spark, sf_dir).select("doc_id", "text"))
    return stats.select("doc_id", *rules.BASE, rules.base_failed().alias("base_failed"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.severities(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_versions(documents(spark, sf_dir))


def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that no sketch decides."""
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    r = pieces.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return r.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "decoded_sha256", "round_trip", "viterbi_score", "viterbi_pieces", "ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark).path("ids")
    huffman.encode_corpus(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path, end=2)
    return huffman.read_files(spark, path)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix_sources(documents(spark, sf_dir))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    r = substring.remove_repeats(docs)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return r.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.cluster(documents(spark, sf_dir, "embeddings"))


def op12_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Scratch(spark).table(kernel.with_statistics(documents(spark, sf_dir)), "statistics")
    rows = Scratch(spark).table(kernel.labelled(stats, documents(spark, sf_dir, "labels")), "labelled")
    return kernel.scores(stats, kernel.fit(rows))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = whitening.whiten(documents(spark, sf_dir, "embeddings"))
    return r.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def whitening_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op13 that no eigen-solve decides."""
    return op13_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_neardup": op2_neardup,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_fingerprints": op6_fingerprints,
    "op7_pieces": op7_pieces,
    "op8_token_files": op8_token_files,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_clusters": op11_clusters,
    "op12_quality_score": op12_quality_score,
    "op13_whitening": op13_whitening,
    "quality_base": quality_base,
    "whitening_moments": whitening_moments,
    "fingerprint_texts": fingerprint_texts,
}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_WORDS = WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
VECTORS = """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0{more})"""


def _cluster_sql(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """Assignment and floored means, round after round; c is (number, component, value)."""
    assign = """a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.r, c.c, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{i} c USING (j) GROUP BY p.r, c.c) GROUP BY r)"""
    move = """c{n} AS MATERIALIZED (SELECT c.c, c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT a.c, p.j, CAST((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM p JOIN a{i} a USING (r) GROUP BY a.c, p.j) m ON m.c = c.c AND m.j = c.j)"""
    parts = [VECTORS.format(more=f" AND len(embedding) = {dims}")]
    parts.append(f"p AS MATERIALIZED (SELECT r, unnest(x) AS x, unnest(range(1, {dims + 1})) AS j FROM v)")
    parts.append(f"f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS c FROM v QUALIFY c < {k})")
    parts.append("c0 AS MATERIALIZED (SELECT f.c, p.j, p.x FROM f JOIN p USING (r))")
    for i in range(rounds):
        parts += [assign.format(i=i), move.format(i=i, n=i + 1)]
    parts.append(assign.format(i=rounds))
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS sha FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN h USING (c)"""


SQL: dict[str, str] = {
    "op11_clusters": _cluster_sql(),
    "whitening_moments": f"""WITH {VECTORS.format(more="")}, p AS (SELECT r, unnest(x) + 100000 AS x, unnest(range(1, len(x) + 1)) AS j FROM v),
 s AS (SELECT j, sum(x) AS s, count(*) AS n FROM p GROUP BY j), d AS (SELECT r, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation, max(n) AS n FROM p JOIN s USING (j) GROUP BY r)
 SELECT vec_id, CAST(n AS BIGINT) AS n, deviation FROM v JOIN d USING (r)""",
    "op1_warc": r"""WITH p AS (SELECT page_id, trim(regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g')) AS target_uri, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
 m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d), r AS (SELECT p.*, CASE WHEN n >= 1000 AND (page_id IS NULL OR page_id < top) THEN top END AS refers_to FROM p LEFT JOIN m USING (d))
 SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, target_uri FROM r""",
    # all pairs of documents that share a shingle, counted; components by the closure of the links
    "op2_neardup": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {LOWER_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS x
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
 l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
 c AS (SELECT reach.a AS r, min(d.doc_id) AS least FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
 SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(least, doc_id) AS kept
 FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)""",
    "op9_mixing": f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'none')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM d GROUP BY source),
 c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM s),
 f AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY k) - cap)) / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY k) - weight)) AS unit FROM c),
 u AS (SELECT coalesce(arg_min(unit, k), 0) AS level FROM f WHERE cap > unit * weight),
 g AS (SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN CAST(floor(least(cap, level * weight) / source_size) AS BIGINT) ELSE 0 END AS passes FROM f, u),
 b AS (SELECT *, target - passes * source_size AS budget FROM g),
 t AS (SELECT source, h, sum(size) AS t FROM d GROUP BY source, h),
 o AS (SELECT *, sum(t) OVER (PARTITION BY source ORDER BY h) AS upto FROM t),
 e AS (SELECT o.source, min(h) AS edge, arg_min(upto, h) AS upto, arg_min(t, h) AS t, any_value(budget) AS budget FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source WHERE upto > budget GROUP BY o.source),
 w AS (SELECT source, edge + CASE WHEN upto - budget <= budget - (upto - t) THEN 1 ELSE 0 END AS threshold FROM e),
 m AS (SELECT d.*, source_size, target, CAST(passes + CASE WHEN budget > 0 AND (threshold IS NULL OR h < threshold) THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN w ON d.source IS NOT DISTINCT FROM w.source)
 SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM m""",
    "op10_substring_dedup": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
 x AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
 y AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN y USING (h)),
 n AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
 v AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
 k AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM v ANTI JOIN gone USING (r, p) GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)""",
    "quality_base": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
 x AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS h FROM d, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
 y AS (SELECT r, h FROM x GROUP BY r, h HAVING count(*) > 1),
 n AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM x SEMI JOIN y USING (r, h)) GROUP BY r),
 l AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
 s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN l USING (r) LEFT JOIN n USING (r))
 SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s""",
    "fingerprint_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS n FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST))
 SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(n, length(t) // 2)) AS edited_sha256 FROM d""",
}
