"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then by a hash of a short prefix, then by a hash of the whole
text. Each step keeps only the groups that still have two rows or more, so that whole texts
are hashed for those alone (for all rows where a digest of each is asked for; it is taken in the
scan then, and no text is shuffled). Two texts are equal when they are identical after
lower-casing A-Z. Lower-casing ASCII keeps the byte length, so the first step needs no
normalised text.

Counts are aggregated before each shuffle, and the tables of groups are stored before rows are
joined to them, so a length, prefix or text that most rows share costs a row a task in the
aggregations, and its join can be split by adaptive execution. Texts meet the rows that survive
by id, length and prefix, never by the prefix alone.

Defined results: a null text counts as the empty text, and all empty texts are equal. The
row with the largest id stays; of repeated rows with that same id one stays in
drop_exact_duplicates(), while exact_duplicates() marks each of them as kept. Rows that share an
id are judged apart, by id and text. A null id is smaller than any other, and equal to other null
ids. An empty table gives an empty result. Columns other than the two named are not looked at, and
added ones get names that no column of the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, new_names, stored, table

PREFIX_CHARS = 64


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """A row per row of docs: the id, keep_id, group_size, kept and content_sha256.

    content_sha256 is there for the rows whose whole text had to be read, or for all with digest_all.
    """
    found = _marks(docs, id_col, text_col, prefix_chars, digest_all)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"), "content_sha256")


def _prefix(text: Column, prefix_chars: int) -> Column:
    return F.xxhash64(lower_ascii(F.substring(text, 1, prefix_chars)))


def _whole(text: Column) -> Column:
    return F.sha2(lower_ascii(text), 256)


def _marks(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool) -> DataFrame:
    """id, bytes, prefix, content_sha256, keep_id and group_size of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.octet_length(text).alias("bytes"), _prefix(text, prefix_chars).alias("prefix"), text.alias("text"))
    small = stored(keyed.select("id", "bytes", "prefix", *([_whole(F.col("text")).alias("content_sha256")] if digest_all else [])), "dedup-keys")
    lengths = small.groupBy("bytes").count().filter("count > 1").select("bytes")
    keys = stored(small.groupBy("bytes", "prefix").count().filter("count > 1").select("bytes", "prefix").join(lengths, "bytes", "left_semi"), "dedup-prefixes")
    survivors = small.join(keys, ["bytes", "prefix"], "left_semi")
    if digest_all:
        read = stored(survivors, "dedup-hashes")
    else:
        ids = survivors.select(F.col("id").alias("_id"), F.col("bytes").alias("_bytes"), F.col("prefix").alias("_prefix")).distinct()
        again = F.col("id").eqNullSafe(F.col("_id")) & (F.col("bytes") == F.col("_bytes")) & (F.col("prefix") == F.col("_prefix"))
        read = stored(keyed.join(ids, again, "left_semi").select("id", "bytes", "prefix", _whole(F.col("text")).alias("content_sha256")), "dedup-hashes")
    groups = stored(read.groupBy("bytes", "content_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"), "dedup-groups")
    one = F.lit(1).cast("long")
    alone = small.join(keys, ["bytes", "prefix"], "left_anti").withColumns({"keep_id": F.col("id"), "group_size": one})
    if not digest_all:
        alone = alone.withColumn("content_sha256", F.lit(None).cast("string"))
    met = read.join(groups, ["bytes", "content_sha256"], "left").withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", one)})
    return alone.unionByName(met.select(*alone.columns))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts. Of repeated rows with the same id one stays."""
    marks = _marks(docs, id_col, text_col, PREFIX_CHARS, False).filter("group_size > 1")
    kept = F.col("keep_id").eqNullSafe(F.col("id"))
    row_id, row_bytes, row_prefix, wholes, content = new_names(docs.columns, "id", "bytes", "prefix", "wholes", "content")
    # rows go by id and text: a row that may be meant, by its id, length and prefix, shows its whole text
    gone = marks.filter(~kept).groupBy(F.col("id").alias(row_id), F.col("bytes").alias(row_bytes), F.col("prefix").alias(row_prefix)).agg(F.collect_set("content_sha256").alias(wholes))
    again = stored(marks.filter(kept).groupBy("id", "content_sha256").count().filter("count > 1").select(F.col("id").alias(row_id)).distinct(), "dedup-again")
    text = F.coalesce(F.col(text_col), F.lit(""))
    same_id = F.col(id_col).eqNullSafe(F.col(row_id))
    met = docs.join(gone, same_id & (F.octet_length(text) == F.col(row_bytes)) & (_prefix(text, PREFIX_CHARS) == F.col(row_prefix)), "left")
    rest = met.filter(F.when(F.col(wholes).isNull(), True).otherwise(~F.array_contains(wholes, _whole(text)))).select(*docs.columns)
    if again.isEmpty():
        return rest
    one = rest.join(again, same_id, "left_semi").withColumn(content, lower_ascii(text)).dropDuplicates([id_col, content]).drop(content)
    return rest.join(again, same_id, "left_anti").unionByName(one)


def op6(spark, sf_dir):
    """Contract op6: a row per document with its group of equal texts and the digest of its normalised text."""
    found = exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("content_sha256").alias("text_sha256"))


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
