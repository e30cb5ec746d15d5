"""The registered queries of this subpackage and the SQL that they equal, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .importance import importance_resample
from .kmeans import ROUNDS, centroid_clusters
from .langid import language_scores
from .licenses import licence_paragraphs
from .mixing import QUANTUM, mix_sources
from .ngram_join import ngram_components
from .piece_codec import encoded
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_count import token_counts

TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_paragraphs(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole shares of a fixed period, as the query's SQL has them
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), quantum=QUANTUM)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    # the bytes that the pieces' spans cover, by the first and the last bound of spans that lie edge to edge
    covered = (F.element_at("begins", -1) - F.element_at("begins", 1)).cast("long")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("n_covered"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_count": op2_token_count,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_importance": op11_importance,
    "op12_piece_codec": op12_piece_codec,
    "op13_centroids": op13_centroids,
}



def _centroid_sql() -> str:
    """Lloyd rounds as a chain of tables: a0 assigns to the first centroids, a1 to those after a round, and so on."""
    distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "s AS (SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8)",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, v AS c FROM s)",
    ]
    for r in range(ROUNDS + 1):
        steps += [
            f"d{r} AS (SELECT vec_id, v, k, {distance} AS d FROM v, c{r})",
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)",
        ]
        if r < ROUNDS:
            steps += [
                f"u{r} AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r})",
                f"f{r} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{r} GROUP BY k, i)",
                f"m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM f{r} GROUP BY k)",
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k)",
            ]
    end = ROUNDS
    return f"""
        WITH {", ".join(steps)},
        i AS (SELECT k, CAST(sum(d) AS BIGINT) AS own FROM a{end} GROUP BY k)
        SELECT vec_id, a{end}.k AS cluster, d AS distance, own AS cluster_inertia, CAST((SELECT sum(d) FROM a{end}) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{end} JOIN i ON i.k = a{end}.k JOIN c{end} ON c{end}.k = a{end}.k"""


ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM u),
        s AS (SELECT DISTINCT doc_id, md5(gram) AS gram FROM g WHERE i <= greatest(1, n - 4)),
        c AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.size + y.size - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
        SELECT d.doc_id, coalesce(c.size, 0) AS n_shingles, m.root AS component_id
        FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN (SELECT v, min(root) AS root FROM r GROUP BY v) m ON m.v = d.doc_id""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        g AS (SELECT doc_id, n, i, word, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS win FROM u),
        f AS (SELECT doc_id, i, word, i <= n - 49 AND min(doc_id) OVER (PARTITION BY win, i <= n - 49) < doc_id AS hit FROM g),
        k AS (SELECT doc_id, i, word, coalesce(max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM f),
        o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op7_suffix_dedup": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        u AS (SELECT doc_id, x, length(x) // 2 AS n, unnest(range(0, length(x) // 2)) AS i FROM h),
        g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, i <= n - 100 AS whole, md5(substr(x, 2 * i + 1, 200)) AS win FROM u),
        f AS (SELECT doc_id, i, byte, whole AND row_number() OVER (PARTITION BY win, whole ORDER BY doc_id, i) > 1 AS hit FROM g),
        k AS (SELECT doc_id, i, byte, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
        r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM k),
        o AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS sha FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op8_source_mixing": r"""
        WITH RECURSIVE c AS (SELECT source, sqrt(count(*)) AS w FROM documents GROUP BY source),
        x AS (SELECT source, (1000 - (SELECT count(*) FROM c)) * w / (SELECT sum(w) FROM c) AS e FROM c),
        h AS (SELECT source, CAST(1 + floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, source) <= 1000 - (SELECT sum(1 + floor(e)) FROM x) THEN 1 ELSE 0 END AS BIGINT) AS share FROM x),
        l AS (SELECT list(share ORDER BY source) AS a, list(source ORDER BY source) AS names FROM h),
        z AS (SELECT CAST(-1 AS BIGINT) AS slot, list_transform(a, lambda v: CAST(0 AS BIGINT)) AS m, CAST(0 AS BIGINT) AS best, CAST(0 AS BIGINT) AS j FROM l
            UNION ALL
            SELECT slot + 1, list_transform(m, lambda v, i: v + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, m[pick] FROM (
                SELECT slot, m, list_min(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN m[i] < a[i] AND m[i] * 1000 // a[i] <= slot + 1 THEN ((m[i] + 1) * 1000 + a[i] - 1) // a[i] * 10000 + i END)) % 10000 AS pick
                FROM z, l WHERE slot < 999)),
        t AS (SELECT names[best] AS source, a[best] AS share, j, slot FROM z, l WHERE slot >= 0),
        r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place FROM documents)
        SELECT doc_id, r.source, place // 16 AS block, place // 16 // share * 1000 + slot AS slot, (place // 16 // share * 1000 + slot) * 16 + place % 16 AS mix_position
        FROM r JOIN t ON t.source = r.source AND t.j = (place // 16) % share""",
    "op11_importance": r"""
        WITH t8 AS (SELECT list(list_reduce(list_prepend(CAST(k AS BIGINT), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY k) AS crc FROM range(256) r(k)),
        b AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
        w AS (SELECT doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM b),
        u AS (SELECT doc_id, side, unnest(ws) AS word FROM w),
        n AS (SELECT doc_id, side, word, count(*) AS n FROM u GROUP BY ALL),
        x AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)),
        y AS (SELECT word, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bytes FROM x),
        k AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, o: xor(crc[CAST(xor(c, o) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM y, t8),
        p AS (SELECT doc_id, side, bucket, sum(n) AS n FROM n JOIN k ON k.word = n.word GROUP BY ALL),
        z AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM p),
        g AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) + 1) * CAST((SELECT s FROM z) + 10000 AS DOUBLE)
              / ((CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) + 1) * CAST((SELECT t FROM z) + 10000 AS DOUBLE)))) AS gain FROM p GROUP BY bucket),
        c AS (SELECT p.doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * CAST(gain AS BIGINT)) AS BIGINT) AS total FROM p JOIN g ON g.bucket = p.bucket WHERE side = 0 GROUP BY p.doc_id),
        d AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
              CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id),
        e AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM r""",
    "op13_centroids": _centroid_sql(),
}
