"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.llm import (ann, bpe, collocations, exact_dedup, line_quality, line_templates, minhash, packing, quality,
                          scratch, substring, token_counts, token_store, turn_repair)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(_docs(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digests(line_templates.drop_recurring_lines(
        _docs(spark, sf_dir).select("doc_id", "text")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_docs(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.perplexities(_docs(spark, sf_dir), labels)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_passages(_docs(spark, sf_dir).select("doc_id", "text")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), width=4)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode_documents(
        _docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "tokens")
    token_store.write(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), folder)
    return token_store.digests(token_store.read(spark, folder))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_docs(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = turn_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turn_repair.digests(turn_repair.repair(hurt, present_col="present"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(_docs(spark, sf_dir)).drop("text")


_ALL = (op1_packing, op2_exact_dedup, op3_line_dedup, op4_token_counts, op5_quality_classifier, op6_substring_dedup,
        op7_minhash_near_dedup, op8_bpe, op9_nearest_neighbours, op10_token_output, op11_phrase_mining,
        op12_turn_repair, op13_quality_rules)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_registry() -> dict[str, str]:
    return dict(ORACLE_SQL)


ORACLE_SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM MAX(doc_id) OVER same AS kept, SHA256(COALESCE(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY COALESCE(text, ''))""",
    "op6_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        runs AS (
            SELECT doc_id, i, ARRAY_TO_STRING(w[i : i + 19], ' ') AS run
            FROM words, LATERAL (SELECT UNNEST(RANGE(1, LEN(w) - 18)) AS i)),
        again AS (
            SELECT doc_id, i FROM runs
            QUALIFY ROW_NUMBER() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS place FROM again, (SELECT UNNEST(RANGE(0, 20)) AS j)),
        cut AS (SELECT doc_id, LIST(place) AS ats FROM gone GROUP BY doc_id)
        SELECT words.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(COALESCE(LEN(ats), 0) AS BIGINT) AS n_removed,
               SHA256(ARRAY_TO_STRING(CASE WHEN ats IS NULL THEN w ELSE
                   LIST_TRANSFORM(LIST_FILTER(LIST_ZIP(w, RANGE(1, LEN(w) + 1)), lambda z: NOT LIST_CONTAINS(ats, z[2])), lambda z: z[1])
                   END, ' ')) AS kept_sha256
        FROM words LEFT JOIN cut ON words.doc_id = cut.doc_id""",
    "op9_nearest_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0
                     AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, 
                     LIST_SUM(LIST_TRANSFORM(LIST_ZIP(q.e, c.e), lambda z: z[1] * z[2])) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_phrase_mining": r"""
        WITH pieces AS (SELECT row, lang, UNNEST(RANGE(1, LEN(p) + 1)) AS k, UNNEST(p) AS piece FROM (
            SELECT ROW_NUMBER() OVER () AS row, COALESCE(lang, 'und') AS lang,
                   REGEXP_SPLIT_TO_ARRAY(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
        lists AS (SELECT lang, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (SELECT lang, k, ARRAY_TO_STRING(w[i : i + k - 1], ' ') AS phrase
                  FROM lists, (SELECT UNNEST([1, 2, 3]) AS k), LATERAL (SELECT UNNEST(RANGE(1, LEN(w) - k + 2)) AS i)),
        f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM grams GROUP BY ALL),
        n AS (SELECT lang, SUM(f) AS n FROM f WHERE k = 1 GROUP BY lang),
        often AS (SELECT *, STRING_SPLIT(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
        cuts AS (SELECT o.lang, o.phrase, o.k, c, o.f AS a, l.f AS l, r.f AS r,
                        CAST(1000000::HUGEINT * o.f * o.f // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
                 FROM (SELECT *, UNNEST(RANGE(1, k)) AS c FROM often) o
                 JOIN f l ON l.lang = o.lang AND l.k = c AND l.phrase = ARRAY_TO_STRING(w[1 : c], ' ')
                 JOIN f r ON r.lang = o.lang AND r.k = o.k - c AND r.phrase = ARRAY_TO_STRING(w[c + 1 : o.k], ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase, k ORDER BY score, c) = 1),
        within AS (SELECT lang, ARRAY_TO_STRING(w[s : s + 1], ' ') AS phrase, MAX(f) AS f
                   FROM often, (SELECT UNNEST([1, 2]) AS s) WHERE k = 3 GROUP BY 1, 2),
        best AS (SELECT lowest.* FROM lowest LEFT JOIN within ON k = 2 AND lowest.lang = within.lang AND lowest.phrase = within.phrase
                 WHERE f IS NULL OR 100 * f < 50 * a)
        SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
               CAST(n AS BIGINT) AS n, score
        FROM best JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_turn_repair": r"""
        WITH RECURSIVE draw AS (
            SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
                   COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS mark FROM conversations),
        bits AS (SELECT DISTINCT mark, 4294967295::BIGINT AS crc, 0 AS pos FROM draw),
        crc AS (SELECT mark, crc, pos FROM bits
                UNION ALL
                SELECT mark, LIST_REDUCE([xor(crc, ASCII(mark[pos + 1])), 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))), pos + 1
                FROM crc WHERE pos < LENGTH(mark)),
        hash AS (SELECT mark, xor(crc, 4294967295::BIGINT) % 20 AS d FROM crc WHERE pos = LENGTH(mark)),
        hurt AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
                        CASE d WHEN 1 THEN '' WHEN 2 THEN REGEXP_REPLACE(text, '[.!?]', '', 'g') ELSE text END AS text
                 FROM draw JOIN hash USING (mark), LATERAL (SELECT UNNEST(RANGE(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
        numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        faults AS (
            SELECT *, LEFT(role, 1) AS c, LAG(LEFT(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
                   CASE WHEN NOT REGEXP_MATCHES(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT REGEXP_MATCHES(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
            FROM numbered),
        facts AS (
            SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
                   COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
                   COUNT(*) FILTER (fault = 'truncated') AS truncated,
                   COUNT(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal,
                   LIST(STRUCT_PACK(role, text, c, fault) ORDER BY i) AS turns
            FROM faults GROUP BY conv_id),
        moves(a, z, t) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
        after(a, z, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
        paths AS (
            SELECT conv_id, turns, 0 AS i, z AS state, 5 * n AS cost, REPEAT('I', n) AS audit FROM facts, after WHERE a = 0
            UNION ALL
            SELECT conv_id, turns, i, state, best.cost, best.audit FROM (
                SELECT conv_id, ANY_VALUE(turns) AS turns, i + 1 AS i, z AS state,
                       MIN(STRUCT_PACK(cost := cost + step + 5 * n, audit := audit || edit || REPEAT('I', n))) AS best
                FROM (SELECT paths.*, 2 AS step, 'D' AS edit, state AS mid FROM paths WHERE i < LEN(turns)
                      UNION ALL
                      SELECT paths.*, CASE WHEN turns[i + 1].c = t THEN 0 ELSE 1 END
                                 + CASE WHEN turns[i + 1].fault = 'truncated' THEN 5 ELSE 0 END,
                             CASE WHEN turns[i + 1].c = t THEN 'K' ELSE 'R' END, z
                      FROM paths JOIN moves ON moves.a = state
                      WHERE i < LEN(turns) AND turns[i + 1].fault NOT IN ('blank', 'duplicate') AND (turns[i + 1].c = t OR t <> 's')) x
                JOIN after ON after.a = mid
                GROUP BY conv_id, i, z)),
        ends AS (SELECT conv_id, ANY_VALUE(turns) AS turns, MIN(STRUCT_PACK(cost, audit)) AS best FROM paths
                 WHERE i = LEN(turns) AND state IN (0, 3) GROUP BY conv_id),
        edits AS (SELECT conv_id, turns, UNNEST(RANGE(1, LENGTH(best.audit) + 1)) AS pos, best.audit AS audit FROM ends),
        placed AS (
            SELECT conv_id, pos, audit[pos] AS edit, turns[LENGTH(REPLACE(audit[1 : pos], 'I', ''))] AS t,
                   LENGTH(REPLACE(audit[1 : pos], 'D', '')) AS j, LENGTH(REPLACE(audit, 'D', '')) AS m
            FROM edits),
        text AS (
            SELECT conv_id, STRING_AGG(CASE edit WHEN 'K' THEN t.role ELSE CASE (j - m) % 2 WHEN 0 THEN 'assistant' ELSE 'user' END END
                       || ':' || CASE edit WHEN 'I' THEN '' ELSE t.text END, chr(10) ORDER BY pos) AS text
            FROM placed WHERE edit <> 'D' GROUP BY conv_id)
        SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
               COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(COALESCE(best.cost, 0) AS BIGINT) AS cost,
               COALESCE(best.audit, '') AS audit, SHA256(COALESCE(text.text, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_quality_rules": r"""
        WITH d AS (SELECT ROW_NUMBER() OVER () AS row, doc_id, source, COALESCE(text, '') AS text FROM documents),
        w AS (SELECT row, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
        runs AS (SELECT row, i, ARRAY_TO_STRING(w[i : i + 7], ' ') AS run FROM w, LATERAL (SELECT UNNEST(RANGE(1, LEN(w) - 6)) AS i)),
        again AS (SELECT row, i FROM runs QUALIFY COUNT(*) OVER (PARTITION BY row, run) > 1),
        repeated AS (SELECT row, COUNT(DISTINCT i + j) AS n FROM again, (SELECT UNNEST(RANGE(0, 8)) AS j) GROUP BY row),
        raw AS (SELECT row, doc_id, source, UNNEST(STRING_SPLIT(text, chr(10))) AS line FROM d),
        dup AS (SELECT row, COUNT(*) - COUNT(DISTINCT line) AS n FROM raw WHERE REGEXP_MATCHES(line, '[^\x20\x09-\x0D]') GROUP BY row),
        norm AS (SELECT row, doc_id, source, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(
                     TRANSLATE(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'),
                     '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line FROM raw),
        hosts AS (SELECT source, COUNT(DISTINCT COALESCE(CAST(doc_id AS VARCHAR), '-')) AS host_docs FROM d GROUP BY source),
        seen AS (SELECT source, line, COUNT(DISTINCT COALESCE(CAST(doc_id AS VARCHAR), '-')) AS docs FROM norm WHERE line <> ''
                 GROUP BY source, line),
        above AS (SELECT seen.source, line FROM seen JOIN hosts ON seen.source IS NOT DISTINCT FROM hosts.source
                  WHERE docs > 10 AND docs * 1000 > host_docs),
        gone AS (SELECT row, SUM(LEN(STRING_SPLIT(line, ' '))) AS n FROM norm
                 WHERE EXISTS (SELECT 1 FROM above WHERE above.line = norm.line AND above.source IS NOT DISTINCT FROM norm.source)
                 GROUP BY row),
        f AS (SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(LENGTH(ARRAY_TO_STRING(w, '')) AS BIGINT) AS word_chars,
                     CAST(LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(COALESCE(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(repeated.n, 0) AS BIGINT) AS n_repeat_words,
                     CAST(COALESCE(gone.n, 0) AS BIGINT) AS n_line_words
              FROM d JOIN w USING (row) LEFT JOIN dup USING (row) LEFT JOIN repeated USING (row) LEFT JOIN gone USING (row))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
                   AND NOT (100 * n_line_words > 50 * n_words OR n_words - n_line_words < 20) AS kept
        FROM f""",
}
