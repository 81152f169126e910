"""Token counts by a join of per-document pre-token frequencies with the pieces of each distinct pre-token.

Every distinct pre-token of the corpus is counted once by the library. The join with the
documents' frequencies has two branches: the pre-tokens above a count, whatever their length and
with a bounded number and bytes, are broadcast and joined where the document is read; the others,
rare by definition, are joined by a shuffle on the pre-token. The least count follows from a
histogram, so nothing is sorted or gathered to find it. Ids are never built per document.

Defined results: a null or empty text has no tokens. A special token's string is one token, as the
library's default has it. Rows that share an id, have none or are repeated are counted apart, a
row each. Long texts are counted whole; ties between counts fall on the same side of the least
one. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, least_count, rows, stored, table, utf8
from .tokenization import BYTE_BPE, encoder

LIMIT = 1024
#: Pre-tokens that go to every worker, and their bytes together: the bounds of what is broadcast.
MOST_FREQUENT, MOST_BYTES = 200_000, 8_000_000


def frequencies(texts: list[bytes], vocabulary: str) -> tuple[list[list[str]], list[int]]:
    """Pre-tokens of each text, and how many special tokens it holds."""
    e = encoder(vocabulary)
    split, special = [], []
    for text in texts:
        text = text.decode("utf-8", "replace")
        if any(s in text for s in e.specials):
            parts = e.special.split(text)
            split.append(list(chain.from_iterable(e.pre_tokens(x) for x in parts[::2] if x)))
            special.append(len(parts) // 2)
        else:
            split.append(e.pre_tokens(text))
            special.append(0)
    return split, special


def distinct_pre_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """piece, n (its occurrences in the corpus), pieces (tokens it gives)."""
    spark = docs.sparkSession

    def count(batches):
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])
        seen: Counter = Counter()
        for batch in in_blocks(batches, "text"):
            split, _ = frequencies(utf8(batch.column("text")), vocabulary)
            seen.update(chain.from_iterable(split))
            if len(seen) > 400_000:
                yield rows(schema, {"piece": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield rows(schema, {"piece": list(seen), "n": list(seen.values())})

    def tokens(batches):
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            order, _, lengths = encoder(vocabulary).encode_pieces(pieces)
            known = dict(zip(order, lengths.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(map(known.__getitem__, pieces), type=pa.int64())], schema=schema)

    grouped = docs.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return stored(grouped.mapInArrow(tokens, "piece string, n long, pieces long"), "pre-tokens")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """id, n_bytes and n_tokens of every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    distinct = distinct_pre_tokens(texts, vocabulary)
    distinct = distinct.withColumn("size", F.octet_length("piece"))
    least = max(least_count(distinct, "n", most_frequent), least_count(distinct, "n", MOST_BYTES, F.col("size")))
    frequent = distinct.filter(F.col("n") >= least).select("piece", "pieces").toArrow()
    known = dict(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist()))
    held = spark.sparkContext.broadcast(known)

    def join(batches):
        schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("rare", pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())])))])
        table = held.value
        for batch in in_blocks(batches, "text"):
            data = utf8(batch.column("text"))
            split, special = frequencies(data, vocabulary)
            n, rare, times, ends = [], [], [], [0]
            for x, s in zip(split, special):
                freq = Counter(x)
                left = [p for p in freq if p not in table]
                rare += left
                times += [freq.pop(p) for p in left]
                ends.append(len(rare))
                n.append(s + sum(map(mul, freq.values(), map(table.__getitem__, freq))))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], names=["piece", "n"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield rows(schema, {"id": batch.column("id"), "row": [0] * len(data), "n_bytes": list(map(len, data)), "n_tokens": n, "rare": lists})

    marked = texts.mapInArrow(join, "id long, row long, n_bytes long, n_tokens long, rare array<struct<piece:string,n:long>>")
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()), "token-joins")
    rare = marked.select("row", F.explode("rare").alias("x")).select("row", F.col("x.piece").alias("piece"), F.col("x.n").alias("n"))
    tail = rare.join(distinct.select("piece", "pieces"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    out = marked.select("id", "row", "n_bytes", "n_tokens").join(tail, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).cast("long").alias("n_tokens"))


def op4(spark, sf_dir):
    """Contract op4: bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
