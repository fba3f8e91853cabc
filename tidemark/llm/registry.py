"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, exact_topk, hard_negatives, html_extract, jaccard_join, license_scan, line_dedup, quality, token_counts, token_output, warc, whitening
from tidemark.llm.common import checkpointed, fresh_dir, short_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spread(files: DataFrame) -> DataFrame:
    """A list of files dealt one to a task: its rows are too small for their bytes to say how many tasks to make."""
    return files.repartitionByRange(max(1, files.count()), "file")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, "ids", path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.assess(docs, table(spark, sf_dir, "labels"), group="lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = checkpointed(warc.write(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc")))
    found = warc.captures(spread(files))
    body = warc.http_body("response.block")
    stated = F.regexp_extract(F.col("response.block").cast("string"), r"\r\nContent-Length: (\d+)", 1).cast("long")
    is_revisit = F.col("response.type") == "revisit"
    one = found.select(
        "capture_id",
        F.regexp_extract(F.col("metadata.block").cast("string"), r"captureKey: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.when(is_revisit, stated).otherwise(F.octet_length(body)).cast("long").alias("payload_bytes"),
        F.when(is_revisit, F.regexp_replace("response.payload_digest", "^sha256:", "")).otherwise(F.sha2(body, 256)).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
    )
    one = checkpointed(one)  # a few short columns
    return warc.resolve(one, "capture_id", "page_id", "refers_id", "refers_to").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, "text", token_counts.rank_scores, vocabulary("piece_bpe_32k.model")).drop("text")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = checkpointed(token_output.write(table(spark, sf_dir, "documents"), "doc_id", "text", fresh_dir(spark, "tokens"), vocabulary("word_bpe_49k.json"), 2))
    found = token_output.read(spread(token_output.with_starts(files)))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), repeated="n_repeated")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs)
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), moved)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_llr": op3_quality_llr,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_token_output": op8_token_output,
    "op9_html_extract": op9_html_extract,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_exact_topk": op12_exact_topk,
    "op13_whitening": op13_whitening,
}


def license_sql() -> str:
    """Op 10 in SQL: sentences, identifiers by the same patterns, then one step per rule over the sequence."""
    cases = " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '|{n}|'" for n, p in license_scan.SENTENCES)
    steps = "SELECT doc_id, n_sentences, sentences, rest AS r0 FROM q"
    for k, (_, seq) in enumerate(license_scan.RULES):
        key = "".join(f"|{i}|" for i in seq)
        steps = f"SELECT *, contains(r{k}, '{key}') AS f{k}, replace(r{k}, '{key}', '#') AS r{k + 1} FROM ({steps})"
    names = [n for n, _ in license_scan.RULES]
    found = ", ".join(f"CASE WHEN {' OR '.join(f'f{i}' for i, m in enumerate(names) if m == n)} THEN '{n}' END" for n in dict.fromkeys(names))
    return f"""
        WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS s,
                          unnest(range(len(string_split(regexp_replace(coalesce(text, ''), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))))) AS i FROM documents),
        n AS (SELECT doc_id, i, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(lower(s), '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g'), '.', ' '), chr(1), '.'), '[^\\p{{L}}\\p{{N}}.]+', ' ', 'g')) AS s FROM t
              WHERE regexp_matches(s, '(?i)licen|permission|warrant|redistribut|rights|public|creative|cc|free|gpl|mpl|version|advertising')),
        k AS (SELECT doc_id, i, CASE {cases} END AS id FROM n),
        g AS (SELECT doc_id, count(*) AS n_sentences, string_agg(replace(id, '|', ''), ',' ORDER BY i) AS sentences, string_agg(id, '' ORDER BY i) AS rest FROM k WHERE id IS NOT NULL GROUP BY 1),
        q AS (SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentences, '') AS sentences, coalesce(rest, '') AS rest FROM documents d LEFT JOIN g USING (doc_id))
        SELECT doc_id, n_sentences, sentences, concat_ws(',', {found}) AS licenses FROM ({steps})
    """


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Whole-number vectors of the rows that take part, told apart by r.
VECTORS_SQL = "WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"

ORACLE: dict[str, str] = {
    "op11_hard_negatives": f"""
        {VECTORS_SQL},
        m AS (SELECT r, vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
        s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score FROM m a JOIN m c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op12_exact_topk": f"""
        {VECTORS_SQL},
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
    """,
    "op5_decontaminate": f"""
        WITH it AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
        d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
        dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN (SELECT DISTINCT m FROM iw) ON len(w) >= m)),
        h AS (SELECT dw.doc_id, dw.i, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
        o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM h GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
    """,
    "op10_license_scan": license_sql(),
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f
    """,
}
