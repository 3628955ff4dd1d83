"""The thin queries over whole tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm import ann, codes, decontam, html_text, jaccard, langid, lexical, licenses, mixing, neardup, pii, tokens, warc
from trailframe.llm.common import table

#: Key of the pseudonyms in the registered query; real uses pass their own.
PII_KEY = "trailframe-demonstration-key"


def op1_ann_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(index)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return made.selectExpr("doc_id", "pii_text as text", "cast(size(pii_found) as long) as n_found", "array_join(pii_found, ',') as kinds")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "source", "cast(copy as long) as copy", "mix_key", "text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    found = codes.with_label_errors(coded).withColumn("codebooks_sha256", F.lit(codes.digest(books)))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    "op1_ann_curves": op1_ann_curves,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_html_text": op5_html_text,
    "op6_warc": op6_warc,
    "op7_pii": op7_pii,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_mix": op10_mix,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_vector_codes": op13_vector_codes,
}

#: Components of an embedding in each of its 8 parts, in the SQL of the codes.
PART = 8


def codes_sql() -> str:
    """The rounds of codes.compress, one behind the other; sums, floors and ties are integers."""
    entry = "min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) * 16 + c.k)"
    steps = []
    for r in range(7):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, any_value(p.v) AS v, CAST({entry} AS BIGINT) AS m FROM p JOIN c{r} c ON p.part = c.part GROUP BY ALL)")
        if r < 6:
            means = ", ".join(f"CAST((sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, PART + 1))
            steps.append(f"u{r} AS MATERIALIZED (SELECT part, m % 16 AS k, [{means}] AS v FROM a{r} GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN u{r} u ON u.part = c.part AND u.k = c.k)")
    return f"""
        WITH e AS (
            SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (
            SELECT vec_id, label, part, list_transform(range(1, {PART + 1}), lambda i: CAST(floor(4096 * CAST(embedding[part * {PART} + i] AS DOUBLE)) AS BIGINT)) AS v
            FROM e, range(8) t(part)
        ), s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < 16),
        c0 AS MATERIALIZED (SELECT part, k, v FROM p JOIN s USING (vec_id)),
        {", ".join(steps)},
        h AS (SELECT sha256(string_agg(x, ',' ORDER BY part, k)) AS codebooks_sha256 FROM (SELECT part, k, array_to_string(v, ',') AS x FROM c6)),
        o AS (
            SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a6 GROUP BY vec_id
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"""


SQL = {
    "op11_ranked_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
        ), g AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
        t AS (SELECT r, doc_id, n, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM d) GROUP BY ALL),
        f AS (SELECT w, CAST(floor(1000 * ln((2 * g.n + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, g GROUP BY w, g.n),
        i AS (
            SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), s AS (
            SELECT q, item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * t.n * g.n) // g.l)))) AS BIGINT) AS score
            FROM (SELECT q, item_id, unnest(ws) AS w FROM i) JOIN f USING (w) JOIN t USING (w), g GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op12_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op13_vector_codes": codes_sql(),
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)
        ), l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id""",
    "op6_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST(('0x' || substr(hex, 5 * CAST(i // 4 AS INT) + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1)),
                'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN f USING (hex)""",
    "op10_mix": """
        WITH RECURSIVE s AS (
            SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source
        ), q AS (
            SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM s) * (SELECT sum(size) FROM s) / size ELSE 0 END AS whole FROM s
        ), r AS (
            SELECT source, CASE WHEN whole > 500 THEN CAST(ceil(whole / 500) AS INT) ELSE 1 END AS parts,
                CASE WHEN whole > 500 THEN whole / ceil(whole / 500) ELSE whole END AS rate FROM q
        ), c AS (
            SELECT source, rate, 0 AS n, exp(-rate) AS p, 0.0::DOUBLE AS low, exp(-rate) AS c FROM r
            UNION ALL
            SELECT source, rate, n + 1, p * rate / (n + 1), c, c + p * rate / (n + 1) FROM c WHERE n < rate + 12 * sqrt(rate) + 24
        ), d AS (
            SELECT row_number() OVER () AS row, doc_id, documents.source, text, parts, unnest(range(1, parts + 1)) AS j
            FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source
        ), u AS (
            SELECT *, (CAST(('0x' || substr(md5(CASE WHEN parts = 1 THEN '17|' || coalesce(CAST(doc_id AS VARCHAR), '~')
                ELSE '17|part|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || CAST(j AS VARCHAR) END), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
            FROM d
        ), t AS (
            SELECT row, u.doc_id, u.source, u.text, CAST(sum(c.n) AS INT) AS n FROM u
            JOIN c ON u.source IS NOT DISTINCT FROM c.source AND u.u > c.low AND u.u <= c.c GROUP BY ALL
        ), e AS (SELECT doc_id, source, text, CAST(unnest(range(0, n)) AS BIGINT) AS copy FROM t WHERE n > 0)
        SELECT doc_id, source, copy, (CAST(('0x' || substr(md5('17|order|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || CAST(copy AS VARCHAR)), 1, 12)) AS BIGINT)
            + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS mix_key, text FROM e""",
}
