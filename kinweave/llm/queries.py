"""One query opN_<name> for each operator, over whole tables with production parameters."""

from __future__ import annotations

from . import chat, mixing
from .common import table


def op3_minhash(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontamination(spark, sf_dir):
    from .tiling import tile

    return tile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark, sf_dir):
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html(spark, sf_dir):
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_chat(spark, sf_dir):
    from . import chat

    own = spark.sql(r"""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_events(chat.logged(turns)))


def op8_tokens(spark, sf_dir, tokenizer="/opt/tokenizers/byte_bpe_50k.tiktoken"):
    from .tokens import sample_edit, token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs.withColumn("edits", sample_edit(docs["text"])), tokenizer)


def op9_repeats(spark, sf_dir):
    from .repeats import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op10_vectors(spark, sf_dir):
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_minhash": op3_minhash,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_html": op6_html,
    "op7_chat": op7_chat,
    "op8_tokens": op8_tokens,
    "op9_repeats": op9_repeats,
    "op10_vectors": op10_vectors,
}
ORACLES: dict[str, str] = {"op1_mixing": mixing.ORACLE, "op7_chat": chat.ORACLE}
