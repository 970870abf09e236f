"""The registered queries of this subpackage, with DuckDB SQL where SQL expresses the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import (ann, chat, fingerprint, jaccard, lm, packing, pii, sp_stream, spelling, token_counts,
                           toxicity, vector_codes, warc)
from evalspark.llm.common import table

def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "score").select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op2_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_ann(spark, sf_dir):
    """The 20 nearest vectors found for every query vector."""
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_chat(spark, sf_dir):
    """Every conversation, and one that is made of control strings, formatted and read back."""
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, :own AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)",
        args={"own": own}))
    return chat.digest(chat.format_turns(chat.table_turns(rows)))


def op5_jaccard(spark, sf_dir):
    """Every document's number of shingles and its component of similar documents."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark, sf_dir):
    """Every document's piece ids, decoded again: ids, and the hash of the text that they give back."""
    model = tokenizer_path("piece_bpe_32k.model")
    back = sp_stream.decode(sp_stream.encode(table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op7_fingerprint(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    """The number of tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_pack(spark, sf_dir):
    """Every document packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_warc(spark, sf_dir):
    """Every page written as a WARC record and read back from the archives."""
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, files, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lm(spark, sf_dir):
    """The log probability of every document by a model of the training documents."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    """Every vector's code by codebooks trained on all vectors, and its error."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark, sf_dir):
    """Every frequent word of the documents with the word that it is probably a variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_pii": op2_pii, "op3_ann": op3_ann, "op4_chat": op4_chat, "op5_jaccard": op5_jaccard, "op6_sentencepiece": op6_sentencepiece,
           "op7_fingerprint": op7_fingerprint, "op8_token_counts": op8_token_counts, "op9_pack": op9_pack, "op10_warc": op10_warc,
           "op11_lm": op11_lm, "op12_vector_codes": op12_vector_codes, "op13_spelling": op13_spelling}

ORACLE = {
    "op4_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(text,
             '<(\\*)(\|im_start\|>|\|im_end\|>|\|startoftext\|>|\|endoftext\|>|/?s>|</?SYS>>)', '<\1#\2', 'g'),
             '\[(\\*)(/?INST\])', '[\1#\2', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + n + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k""",
}
