"""The registered queries of this subpackage, one for each operator, and their oracle SQL."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, matrix, neardup, ordered, packing, pieces, secrets, spotsigs, tokencount, tokens, topk
from .common import bound_batches, bound_reads, shared_dir

CAPACITY = 4096


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    bound_reads(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    out = langid.identify(docs, model, keep=("doc_id",))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    # A row becomes a record of the layout that is usual for its role: a prompt, a response or a
    # system field, or a list of one message. The layout's fingerprint selects the mapping back.
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    flat = {"system": "system", "user": "prompt", "assistant": "response"}
    fields = [F.when(role == r, text).alias(name) for r, name in flat.items()]
    other = F.when(~role.isin(*flat), F.array(F.struct(role.alias("role"), text.alias("content")))).alias("messages")
    records = rows.unionByName(extra).select("conv_id", "turn", *fields, other)
    one = chat.turns_of_columns(records, [*flat.values(), "messages"]).select("conv_id", "turn", F.inline("turns"))
    return chat.digest(chat.read_back(chat.format_rows(one, "conv_id", "turn", "role", "text")))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own: the query counts every distinct text anew.
    cache = f"{shared_dir(spark)}/loomgraph/token_cache-{uuid.uuid4().hex}"
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), cache, limit=CAPACITY)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256."""
    path = tokenizer("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents"), path)
    back = pieces.decode(coded, path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses. Null texts are empty.
    Null ids come before all others, rows of one id in the order of their texts' hashes, and rows
    that repeat follow each other; an only row follows itself."""
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = table(spark, sf_dir, "documents")
    anchors = spotsigs.anchors_of(docs)
    rows = ordered.with_next(docs, "doc_id", "text", partitions)
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(kinds)

    def prints(texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        return spotsigs.signatures(np.frombuffer(b"".join(raw), np.uint8), offsets, anchors=anchors)

    def done(held: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, which only follows."""
        of = prints([t for _, t, _ in held])
        at = [i for i, row in enumerate(held[:-1]) if row[2]]
        edited = []
        for i in at:
            text, follows = held[i][1], held[i + 1][1]
            half = len(text) // 2
            edited.append(text[: len(text) - half] + follows[:half])
        of_edited = prints(edited)
        out = [
            (held[i][0], len(held[i][1]), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), spotsigs.text_form(of[i]), spotsigs.text_form(fe), spotsigs.likeness(of[i], fe), spotsigs.likeness(of[i], of[i + 1]))
            for i, e, fe in zip(at, edited, of_edited, strict=True)
        ]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k[1]) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(row)
                size += len(row[1])
                if size > 1 << 20 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(held[-1][1])
        if held:
            yield done(held)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("id", "text", "own").mapInArrow(run, ddl)


def op8_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id, n_tokens, n_segments, doc_ids, pieces, cu_seqlens, crc32 of ids and positions."""
    rows = matrix.token_matrix(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), CAPACITY)
    return rows.select("sequence_id", "n_tokens", F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def packed(docs: DataFrame) -> DataFrame:
    runs = tokens.pieces(docs, tokenizer("word_bpe_49k.json"), CAPACITY)
    return packing.pack(runs, CAPACITY)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_topk, op2_langid, op3_chat, op4_neardup, op5_token_counts, op6_sentencepiece, op7_fingerprints, op8_token_matrix, op9_packing, op10_secrets)}

_SQL1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
c AS (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS x FROM v),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM c q JOIN c d ON q.i = d.i AND q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
_SQL3 = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + 12 + 1 + 11 + (SELECT CAST(sum((length(s) - length(replace(s, c, ''))) / length(c)) AS BIGINT)
    FROM (VALUES (chr(92)), ('<|'), ('<s>'), ('</s>'), ('<<SYS>>'), ('<</SYS>>'), ('[INST]'), ('[/INST]')) AS k(c), (VALUES (role), (text)) AS t(s))
    + length(role) - length(replace(role, chr(10), '')) AS size FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
_SQL4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
k AS (SELECT min(doc_id) AS id, len(s) AS n, s FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s),
x AS (SELECT id, n, unnest(s) AS t FROM k),
p AS (
  SELECT a.id AS u, b.id AS v FROM x a JOIN x b ON a.t = b.t AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
c(id, root) AS (SELECT id, id FROM k UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.id),
r AS (SELECT id, min(root) AS root FROM c GROUP BY id)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE r.root END AS component_id,
  d.doc_id = CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE r.root END AS kept
FROM s d LEFT JOIN k ON list_sort(d.s) = k.s LEFT JOIN r ON r.id = k.id
"""
ORACLE_SQL = {"op1_topk": _SQL1, "op3_chat": _SQL3, "op4_neardup": _SQL4}
