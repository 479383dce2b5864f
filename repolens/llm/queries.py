"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, edit_fingerprint, hard_negatives, jaccard_join, langid, packing, prefix_trie, quality_cnn, risk_rules, shards, span_dedup, toxicity
from .scratch import Scratch, new_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """A fifth of the documents, by their id alone."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out()))
    return langid.predict(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "doc_id")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select cast(-1 as bigint) conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (cast(0 as bigint), 'user'), (cast(1 as bigint), 'assistant') as t(turn, role)")
    chats = chat.format_chat(rows.unionByName(own).withColumn("parts", chat.text_parts(F.col("text"))))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') as r, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') as t from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, t)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, t) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|turn|>' || r || '<|say|>' || t || '<|end|>' || chr(10))) as bigint) as formatted_chars
from marked group by conv_id
"""


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_cnn.fit(docs, labels.filter(~held_out()))
    return quality_cnn.score(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


ARRIVALS = 4


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in parts by a hash of their id, are compacted, and are read back from the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.Store(spark, new_path(spark, "shards"), shards.Policy(least=2 * shards.MB, target=64 * shards.MB))
    for staged in store.stage(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))):
        store.adopt(staged)
        store.compact(docs.schema)
        store.vacuum()
    version, listed = store.manifest()
    rows = store.read_with_shard(docs.schema)
    return rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "shard", F.lit(version).alias("version"), F.lit(len(listed)).alias("n_shards"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of each document that repeat an earlier passage; documents without one have no row."""
    return span_dedup.repeated_ranges(table(spark, sf_dir, "documents"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_id``: the least doc_id of the documents that are near by banding and verification."""
    scratch = Scratch(spark)
    rows = scratch.table(edit_fingerprint.with_edits(table(spark, sf_dir, "documents"), scratch=scratch), "edits")
    return rows.join(edit_fingerprint.near_groups(rows, scratch=scratch), "fingerprint", "left").withColumn("near_id", F.when(F.col("doc_id").isNotNull(), F.col("near_id")))


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Scratch(spark).table(risk_rules.text_counts(table(spark, sf_dir, "documents"), "doc_id", "lang"), "counts")
    cutoffs = risk_rules.calibrate(counts, table(spark, sf_dir, "labels"), "lang")
    return risk_rules.apply_rules(counts, cutoffs, "lang").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hard_negatives.quantized(F.col("embedding")).alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


#: By brute force over all pairs of an anchor and a row. Rows of equal vec_id don't occur in the tables.
OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
g as (
  select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as n
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(n as int) as rank, negative_id, positive_score, negative_score from g where n <= 10
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.filter(~held_out()))
    return toxicity.score(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(rows, "conv_id - conv_id % 5", "crc32(cast(conv_id as string)) % 9", 8)


#: Prefixes as joined hashes of their turns; a node's subtree by the nodes that its members' paths lead through.
OP13_SQL = """
with recursive step(i, k, v) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from step where k < 8),
crc as (select list(v order by i) as crcs from step where k = 8),
t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
own as (select conv_id, count(*) as n from t group by 1),
c as (
  select conv_id, n, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) % 9 as head
  from own, crc),
r as (
  select c.conv_id, pos + 1 as depth, role, text from c join t on t.conv_id = base and pos < head
  union all select conv_id, pos - head + least(head, coalesce(b.n, 0)) + 1, role, text from c join t using (conv_id) left join own b on b.conv_id = base where pos >= head),
p as (
  select conv_id, depth, strlen(text) as bytes, string_agg(sha256(role) || sha256(text), '') over (partition by conv_id order by depth) as prefix from r
  union all select conv_id, 0, 0, '' from own),
m as (select *, min(conv_id) over (partition by depth, prefix) as rep, max(depth) over (partition by conv_id) as size from p),
node as (
  select depth, rep, count(*) as n, max(bytes) as bytes, sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (depth = size), '')) as ends from m group by depth, rep),
up as (select node.*, m.rep as parent from node left join m on m.conv_id = node.rep and m.depth = node.depth - 1),
kids as (select depth - 1 as depth, parent as rep, count(*) as n_children from up where parent is not null group by 1, 2),
whole as (select up.*, coalesce(n_children, 0) as n_children from up left join kids using (depth, rep)),
below as (
  select m.depth, m.rep, count(*) filter (n_children = 0) as n_leaves, sum((n - 1) * z.bytes) as saved
  from whole z join m on m.conv_id = z.rep and m.depth <= z.depth group by 1, 2)
select rep as conv_id, cast(depth as bigint) as depth, parent as parent_conv_id, n as n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens, ends as ends_sha256 from whole join below using (depth, rep)
"""


def queries() -> dict[str, Query]:
    return {"op1_langid": op1_langid, "op2_jaccard_join": op2_jaccard_join, "op3_bpe": op3_bpe, "op4_chat": op4_chat, "op5_quality_cnn": op5_quality_cnn, "op6_shards": op6_shards, "op7_packing": op7_packing, "op8_span_dedup": op8_span_dedup, "op9_edit_fingerprint": op9_edit_fingerprint, "op10_risk_rules": op10_risk_rules, "op11_hard_negatives": op11_hard_negatives, "op12_toxicity": op12_toxicity, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL}
