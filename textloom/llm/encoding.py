"""Problem 6: the ids of a corpus under a public byte-level BPE, by a table of distinct words.

Spark splits the texts into the pieces between which the tokenizer never merges; each distinct piece is encoded once; the
ids are joined back by position. Texts with characters that Java's Unicode tables don't know go through the tokenizer
whole, so the split never depends on the versions of two tables.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage, partitions

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pieces and ids up to which the table of pieces is broadcast whole, and pieces of its frequent part beyond.
BROADCAST_BYTES = 24_000_000
FREQUENT_PIECES = 150_000


def _pieces(text: str) -> Column:
    known = F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))
    return F.when(F.col(text).rlike(r"[\p{Cn}\p{Cs}]"), F.array(F.col(text))).otherwise(known)


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def piece_table(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(piece, uses, ids) of each distinct piece of docs(row, id, text); uses counts the texts that hold it."""
    raw = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=_ranks(raw.value), special_tokens={})
        for batch in batches:
            ids = [bpe.encode_ordinary(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["piece", "uses", "ids"])

    used = docs.select(F.explode(F.array_distinct(_pieces("text"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    return used.mapInArrow(encode, "piece string, uses long, ids array<int>")


def encode_texts(df: DataFrame, ident: str, text: str, ranks_path: str = RANKS) -> DataFrame:
    """(ident, ids): one row per row of df, ids being an empty list where the text is null or empty.

    Rows repeated under one id each give a row. No rows give none.
    """
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.col(text).alias("text"))
    table = cut_lineage(piece_table(docs, ranks_path))
    size = table.agg(F.sum(F.octet_length("piece") + 4 * F.size("ids") + 40)).first()[0] or 0
    placed = docs.repartition(max(partitions(df.sparkSession), 1), "row").select("row", "id", F.posexplode_outer(_pieces("text")).alias("pos", "piece"))
    if size <= BROADCAST_BYTES:
        found = placed.join(F.broadcast(table.select("piece", "ids")), "piece", "left")
    else:  # frequent pieces by broadcast, so that the join by piece meets rare ones only
        frequent = table.orderBy(F.desc("uses"), "piece").limit(FREQUENT_PIECES).select("piece", "ids")
        frequent = cut_lineage(frequent)
        rare = table.join(F.broadcast(frequent.select("piece")), "piece", "left_anti").select("piece", "ids")
        seen = placed.join(F.broadcast(frequent), "piece", "left")
        missed = seen.where("ids is null and piece is not null").drop("ids").join(rare, "piece")
        found = seen.where("ids is not null or piece is null").unionByName(missed.select(seen.columns))
    joined = found.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "ids")))).alias("parts"))
    return joined.select(F.col("id").alias(ident), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def decode_ids(df: DataFrame, ident: str, ids: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """(ident, text) of lists of ids, by a join with the table of the vocabulary's pieces (about 50,000 rows).

    An empty or null list gives an empty text, an id out of the vocabulary nothing; bytes that are no text become U+FFFD.
    """
    vocabulary = [(i, b.hex()) for b, i in _ranks(Path(ranks_path).read_bytes()).items()]
    pieces = df.sparkSession.createDataFrame(vocabulary, "token int, hex string")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.col(ids).alias("ids"))
    rows = rows.repartition(max(partitions(df.sparkSession), 1), "row")
    tokens = rows.select("row", "id", F.posexplode_outer("ids").alias("pos", "token")).join(F.broadcast(pieces), "token", "left")
    parts = tokens.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.when(F.col("hex").isNotNull(), F.struct("pos", "hex")))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return parts.select(F.col("id").alias(ident), F.make_valid_utf8(joined.cast("string")).alias("text"))
