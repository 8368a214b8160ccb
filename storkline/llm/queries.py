"""The operators of this package as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from storkline.llm import interpolation, kd_shards, perplexity, personal_data, pieces, rule_ensemble, token_counts, warc
from storkline.llm.alignment import align, read_vocabularies
from storkline.llm.decontaminate import find_leaks
from storkline.llm.fill_middle import rearrange, restored
from storkline.llm.near_dups import near_duplicates
from storkline.llm.repeats import remove_repeats
from storkline.session import cut, stage_path

#: a SentencePiece model file, a rank file and a tokenizer file; read by the driver, their contents go to the tasks
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_delta_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents. An older version, which counts characters, and its counts under the
    present name come first, in four batches of which one is sent twice; then all counts are revised, the
    older version is taken back, all is compacted, and one part is taken back and inserted again."""
    counts = cut(token_counts.count(_table(spark, sf_dir, "documents"), token_counts.read_ranks(RANKS), "byte_bpe_50k"))
    rollup = token_counts.Rollup(spark, stage_path(spark))
    known = counts.filter("doc_id is not null")
    drafts = known.withColumn("n_tokens", F.col("n_chars"))
    older = drafts.withColumn("tokenizer", F.lit("characters"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    rollup.commit("without id", counts.filter("doc_id is null"))  # no later change can name these
    for k in (0, 1, 2, 1, 3):
        rollup.commit(f"part {k}", drafts.unionByName(older).filter(part == k))
    rollup.commit("revised", rollup.revisions(known))
    rollup.commit("older version back", rollup.deletes(known, "characters"))
    rollup.compact()
    rollup.commit("part 2 back", rollup.deletes(known.filter(part == 2)))
    rollup.commit("part 2 again", known.filter(part == 2))
    return rollup.totals()


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of near equal size, copies together."""
    return kd_shards.shards(_table(spark, sf_dir, "documents"), 16)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every text by a mixed n-gram model, and by the add-one base."""
    return interpolation.score(_table(spark, sf_dir, "documents"))


def op5_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every text: spans of the patterns and those that the tagger adds."""
    return personal_data.report(_table(spark, sf_dir, "documents"))


def op6_sentencepiece_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding them gives the text back."""
    vocabulary = pieces.read_pieces(VOCABULARY)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return both.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to an archive and read back."""
    path = stage_path(spark)
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.report(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document, and whether it is the one that stays."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document by a rule ensemble."""
    scored = rule_ensemble.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_kneser_ney_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the fixed quality rules for every text, and the verdict of rules and perplexity bands."""
    return perplexity.rate(_table(spark, sf_dir, "documents"))


def op11_difference_cover_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the bytes of strings of 100 bytes that start earlier."""
    found = remove_repeats(_table(spark, sf_dir, "documents"), 100)
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and of a SentencePiece vocabulary lie over each other in every text."""
    return align(_table(spark, sf_dir, "documents"), read_vocabularies(TOKENIZER, VOCABULARY))[0]


def op13_skip_list_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two lines and put together anew, with digests of that and of the text rebuilt from it."""
    out = rearrange(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_delta_token_rollup, op2_simhash_decontamination, op3_kd_tree_shards, op4_deleted_interpolation, op5_bilstm_crf_pii, op6_sentencepiece_shared_prefix,
        op7_content_addressed_warc, op8_minhash_near_dedup, op9_rule_ensemble_quality, op10_kneser_ney_quality_rules,
        op11_difference_cover_repeats, op12_identity_map_alignment, op13_skip_list_fill_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_content_addressed_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
                     max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
        FROM h
    """,
    "op8_minhash_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
              FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
    """,
    "op11_difference_cover_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS string FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 99)) AS i FROM d WHERE strlen(h) >= 200)),
        f AS (SELECT string, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM s GROUP BY string HAVING count(*) > 1),
        r AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS before
              FROM s JOIN f ON s.string = f.string WHERE (s.doc_id, s.i) <> (f.first.doc_id, f.first.i)),
        g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
        p AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
        k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS begin FROM p),
        t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
                     string_agg(substr(h, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY a) AS kept
              FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)
    """,
    "op13_skip_list_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS lines,
                     list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS k FROM d),
        c AS (SELECT *, len(lines) AS n, least(k[1] % (len(lines) + 1), k[2] % (len(lines) + 1)) AS a,
                     greatest(k[1] % (len(lines) + 1), k[2] % (len(lines) + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain'
                          WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT doc_id, n, form, t, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
                     array_to_string(lines[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
}
