"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm import exact, hostpaths, parminhash, quality, rollup, sigtree, suffix, transcript, warc, wfst
from spindrel.llm.common import scratch, small_or_shuffled, staged

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level tokenizer splits a text before it merges, as its files prescribe.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_wfst(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token counts and id digests of every document's whole text, and whether the ids decode to it."""
    return wfst.tokenised(_table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model", with_ids=False)


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, items and longest match of every document with the whole benchmark."""
    return suffix.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_host_path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return hostpaths.main_texts(_table(spark, sf_dir, "pages"))


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near copies of every document."""
    return sigtree.similar_groups(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact.exact_groups(_table(spark, sf_dir, "documents")).drop("uid")


def op6_token_rollups(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Counts of all documents, after a history of four batches that are all delivered twice.

    All rows with an id come in under the source "intake"; a revision of all rows, those without an id included, gives
    them their own source; documents that are labelled toxic are withdrawn, and put back after review.
    """
    versions = {"byte_bpe_50k": ("ranks", rollup.rank_tokenizer(f"{tokenizers}/byte_bpe_50k.tiktoken"), BYTE_PATTERN), "words_v1": ("words", b"", "")}
    ledger = rollup.Ledger(spark, scratch(spark, "ledger"), versions)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    labels = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    toxic = docs.join(small_or_shuffled(labels), "doc_id", "left_semi")
    history = {
        "intake": docs.where("doc_id is not null").withColumns({"op": F.lit(rollup.INSERT), "source": F.lit("intake")}),
        "sources": docs.withColumn("op", F.lit(rollup.REVISE)),
        "withdrawn": toxic.withColumns({"op": F.lit(rollup.DELETE), "text": F.lit(None).cast("string")}),
        "put-back": toxic.withColumn("op", F.lit(rollup.INSERT)),
    }
    for name, events in history.items():
        for _ in range(2):
            ledger.commit(name, events)
    return ledger.totals()


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that repeat, and the copy that stays."""
    return parminhash.repeats(_table(spark, sf_dir, "documents"))


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labelled ones that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from rough transcripts of all conversations, by a model of those that aren't held out.

    The transcripts are the table's turns, a fifth of them without a marker, with misleading lines.
    """
    lines = staged(transcript.marked_lines(_table(spark, sf_dir, "conversations"), rough=True), "transcripts")
    model = transcript.train(lines.where(~transcript.held_out("conv_id")))
    turns = transcript.canonical_turns(transcript.recovered(lines.select("conv_id", "line_no", "line"), model))
    return turns.select("conv_id", transcript.held_out("conv_id").alias("held_out"), "turn_no", "role", "n_lines", F.length("rendered").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op10_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives, and its place among all captures by URL key and time."""
    return warc.capture_histories(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_wfst": op1_sentencepiece_wfst,
    "op2_suffix_decontamination": op2_suffix_decontamination,
    "op3_host_path_texts": op3_host_path_texts,
    "op4_signature_tree_join": op4_signature_tree_join,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_rollups": op6_token_rollups,
    "op7_paragraph_minhash": op7_paragraph_minhash,
    "op8_quality_scores": op8_quality_scores,
    "op9_transcript_turns": op9_transcript_turns,
    "op10_warc_histories": op10_warc_histories,
}

SQL: dict[str, str] = {
    "op2_suffix_decontamination": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        item_starts AS (SELECT item, item_id, w, least(len(w), 8) AS k, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS pos FROM (SELECT *, row_number() OVER () AS item FROM items) WHERE len(w) > 0),
        windows AS (SELECT item, item_id, k, pos, array_to_string(w[pos:pos + k - 1], ' ') AS s FROM item_starts),
        sizes AS (SELECT DISTINCT k FROM windows),
        doc_starts AS (SELECT row, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k),
        found AS (
            SELECT row, i, d.k, item, item_id, pos
            FROM (SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM doc_starts) d
            JOIN windows ON windows.s = d.s AND windows.k = d.k),
        hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT row, i, k FROM found)) GROUP BY row),
        named AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM found) GROUP BY row),
        -- a match goes on while the next words are the item's next ones
        runs AS (SELECT row, min(i) AS i, count(*) + k - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY row, item, i - pos ORDER BY i) AS run FROM found) GROUP BY row, item, k, i - pos, run),
        longest AS (SELECT row, n AS longest, min(i) - 1 AS longest_start FROM runs GROUP BY row, n QUALIFY row_number() OVER (PARTITION BY row ORDER BY n DESC) = 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(longest, 0) AS longest, longest_start
        FROM docs LEFT JOIN longest USING (row) LEFT JOIN hit USING (row) LEFT JOIN named USING (row)""",
    "op4_signature_tree_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        starts AS (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0),
        sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
            WHERE 100 * c >= 80 * (a.n + b.n - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT ways.x, reach.r FROM reach JOIN ways ON ways.y = reach.doc_id)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
        FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op5_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        ranked AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM rows)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""",
    "op10_warc_histories": r"""
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7F]', '', 'g') AS u,
                   strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 100000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
            FROM pages),
        keyed AS (
            SELECT *, array_to_string(list_reverse(string_split(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '.')), ',') || ')' ||
                   coalesce(nullif(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)', 1), ''), '/') AS url_key
            FROM payloads),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, row_number() OVER (ORDER BY url_key, captured, page_id, d) - 1 AS place FROM keyed)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to, url_key, captured, place
        FROM firsts""",
}
