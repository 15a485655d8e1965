"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, collocations, exact_dedup, fill_middle, fingerprints, group_packing, line_dedup, minhash_dedup, packing, quality, suffix_dedup, url_filter, warc
from larkspur.llm.workspace import bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> dict:
    """Where the byte-level vocabulary lies, and how its texts are split."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "specials": (("<|endoftext|>", 50256),), "library": public_tokenizers.path("byte_bpe_50k.json")}


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text is its end token; repeated and null ids are packed row by row; no rows for an empty table. See ``packing.pack``."""
    return packing.pack(table(spark, sf_dir, "documents"), **byte_bpe())


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has an empty fingerprint; rows of one id follow each other by a hash of the text; no rows for an empty table. See ``fingerprints.compare_neighbours``."""
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null or empty text has no ids; rows are independent, so ids may be null or repeat. See ``bpe.encode``."""
    return bpe.digests(table(spark, sf_dir, "documents"), word_bpe())


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null url, or one without ``://``, has an empty host and path; rows are independent. See ``url_filter.judge``."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null html is an empty payload; of equal payloads the smallest page_id responds, and one of rows that are alike. See ``warc``."""
    archive = warc.write(table(spark, sf_dir, "pages"), least=0)
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text, or one without words, is linked with nothing; a component is named by its smallest id. See ``minhash_dedup.near_duplicates``."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has no lines and null sources count as none; a line that goes, goes from every row. See ``line_dedup.remove_boilerplate``."""
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have weight 1; rows alike in id, text and language are drawn together, as are ties of the last key. See ``quality.judge``."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty; of equal texts the longest original stays, then the smallest id, and one of rows that are alike. See ``exact_dedup.deduplicate``."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op10_radix_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only doc_id and text are read, so other columns may have any names; ``clean_text`` has lost repeated passages of 51 words as well. See ``suffix_dedup.cut``."""
    rows = suffix_dedup.cut(table(spark, sf_dir, "documents").select("doc_id", "text"), beside=51)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.coalesce("cut.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut.spans")).cast("long").alias("n_spans"), F.sha2(F.coalesce("cut.rest", text.cast("binary")), 256).alias("kept_sha256"),
        F.coalesce(F.col("cut.clean").cast("string"), text).alias("text"), F.coalesce(F.col("cut.less").cast("string"), F.col("cut.clean").cast("string"), text).alias("clean_text"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and texts without units stay plain; see ``fill_middle.transform``."""
    rows = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_pattern_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words, a null lang is ``und``; see ``collocations.mine``."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is packed as its end token; see ``group_packing.pack``."""
    rows = group_packing.pack(table(spark, sf_dir, "documents"), word_bpe())
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline``, each of which states how it takes odd rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pattern_packing, op2_lz_fingerprint, op3_rank_array_bpe, op4_url_trees, op5_content_addressed_warc, op6_chosen_path_join,
        op7_line_spread, op8_importance_resampling, op9_golomb_exchange, op10_radix_suffixes, op11_fill_middle, op12_pattern_growth,
        op13_tournament_packing, pipeline,
    )
}

_DIGIT = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31), 1)" for s in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op5_content_addressed_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, html, sha1(html) AS d, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        five AS (SELECT page_id, i, CAST('0x' || substr(d, CAST(1 + 5 * i AS INT), 5) AS INT) AS v FROM h, range(8) t(i)),
        b AS (SELECT page_id, string_agg({_DIGIT}, '' ORDER BY i) AS digest FROM five GROUP BY page_id)
        SELECT h.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN h.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN h.page_id = first THEN NULL ELSE first END AS refers_to
        FROM h JOIN b ON h.page_id = b.page_id""",
    "op7_line_spread": f"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS none FROM documents),
        l AS (SELECT doc_id, source, none, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
        b AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.SITES}),
        m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line)
        SELECT doc_id, CAST(sum(CASE WHEN none THEN 0 ELSE 1 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op9_golomb_exchange": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, CAST(first_value(doc_id) OVER w AS BIGINT) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op11_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS unit,
                     CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                     CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(unit) AS n, least(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS p, greatest(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS q,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                          WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        t AS (SELECT doc_id, n, form, text, array_to_string(unit[1:p], '') AS prefix, array_to_string(unit[p + 1:q], '') AS middle, array_to_string(unit[q + 1:], '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM t""",
    "op12_pattern_growth": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                          unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        o AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM w),
        g AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM o WINDOW p AS (PARTITION BY id ORDER BY i)),
        f AS (SELECT lang, 1 AS s, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
              UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
              UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang),
        c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE s >= 2 AND f >= 10),
        k AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) t(k) WHERE k < s),
        x AS (SELECT k.*, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS score
              FROM k JOIN f l ON l.lang = k.lang AND l.phrase = lp JOIN f r ON r.lang = k.lang AND r.phrase = rp),
        y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, array_to_string(w[j:j + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) t(j) WHERE s = 3 GROUP BY ALL),
        z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank
              FROM y LEFT JOIN i ON i.lang = y.lang AND i.phrase = y.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT z.lang, rank, phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
}
