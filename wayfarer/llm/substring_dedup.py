"""Repeated passages by level-wise doubling.

Level one looks at windows of half the length. Not at all of them: of the half windows within
a full window, the one with the least hash stands for it (equal windows choose equal ones, so
none is missed). Only half windows that occur twice or more in the corpus are extended to full
windows; of those, the first occurrence of each, by document and start, is told to its
document, which removes the words of all others. At the full length no candidates survive.

Both exchanges carry packed arrays with at most one entry per distinct hash and block of texts,
so a passage that a third of the corpus shares costs an entry a block and not one an
occurrence. Documents meet their answers bucket by bucket in a sorted stream, so a task holds
the answers of one bucket and one batch of texts.

Windows are equal when 96 bits of hash are, over the words' own xxh3 hashes. Defined results: a
null or empty text has no words. Rows that are equal in id and text are one document and get equal
results; rows with one id and different texts are told apart by start alone. A null id sorts before
all others. Ties can't arise otherwise, since a place is a document and a start. Long texts are read
whole. An empty table gives no rows. Columns other than the two named are not looked at, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, partitions, rows, squeezed, stored, table, unsqueezed, utf8
from .shingles import mix, sliding, window_hashes, word_hashes

WINDOW = 20
NO_ID = -(2**63)
BLOCK_BYTES = 1_500_000
#: Answers that a task gathers before it sends them on.
MOST_HELD = 1_000_000
_ASK = np.dtype([("hash", "<u8"), ("doc", "<i8")])
#: As it is sent: the bucket that waits for the answer is all that is needed of the document.
_SENT = np.dtype([("hash", "<u8"), ("to", "<u4")])
#: A full window is known by 96 bits, hash and check.
_PLACE = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("start", "<u4")])
_FIRST = np.dtype([("doc", "<i8"), ("start", "<u4")])
_HASH = np.dtype("<u8")


def anchors(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-window hashes; the least one within each full window; which full windows lie in one text."""
    half = window // 2
    halves = window_hashes(words, half)
    if len(words) < window:
        return halves, np.zeros(0, np.uint64), np.zeros(0, bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least = sliding(halves, window - half + 1, np.minimum)
    return halves, least, text[: len(least)] == text[window - 1 :]


def planes(entries: np.ndarray) -> bytes:
    """Entries byte by byte: all first bytes, all second ones and so on, so the shuffle's codec takes out what is the same in most."""
    return np.ascontiguousarray(entries.view(np.uint8).reshape(len(entries), -1).T).tobytes()


def unplaned(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def packed_rows(entries: np.ndarray, bucket: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """A row per bucket with its entries packed."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    packed = [planes(entries[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([kind] * len(cuts), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "kind", "packed"])


def hash_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def grouped(batches, kind: np.dtype):
    """Entries of each bucket of a stream sorted by bucket; kind 0 alone, others pass as (bucket, packed)."""
    now, parts = None, []
    for batch in batches:
        for bucket, other, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "packed"))):
            if other:
                yield bucket, packed
                continue
            if bucket != now and parts:
                yield None, np.concatenate(parts)
                parts = []
            now = bucket
            parts.append(unplaned(packed, kind))
    if parts:
        yield None, np.concatenate(parts)


def first_places(places: np.ndarray) -> np.ndarray:
    """The first place of each window, by document and start."""
    if not len(places):
        return places
    places = places[np.lexsort((places["start"], places["doc"], places["check"], places["hash"]))]
    return places[np.insert((places["hash"][1:] != places["hash"][:-1]) | (places["check"][1:] != places["check"][:-1]), 0, True)]


def questions(words, bounds, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: an entry per half window that stands for a full one; entries of those that the block itself repeats, a row per document."""
    halves, least, valid = anchors(words, bounds, window)
    if not valid.any():
        return np.zeros(0, _ASK), np.zeros(0, _ASK)
    span = window - window // 2 + 1
    room = np.zeros(span - 1, np.uint64)
    # it stands for one if the greatest least hash of the full windows around it is its own
    at = np.flatnonzero((sliding(np.concatenate([room, np.where(valid, least, 0), room]), span, np.maximum)[: len(halves)] == halves) & (halves > 0))
    entries = np.empty(len(at), _ASK)
    entries["hash"], entries["doc"] = halves[at], docs[np.searchsorted(bounds, at, side="right") - 1]
    entries = entries[np.lexsort((entries["doc"], entries["hash"]))]
    same = entries["hash"][1:] == entries["hash"][:-1]
    known = entries[np.append(same, False) | np.insert(same, 0, False)]
    return entries[np.insert(~same, 0, True)], known


def answers_of(found: list) -> pa.RecordBatch:
    """Each hash once for each bucket it goes to."""
    hashes, to = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((hashes, to))
    hashes, to = hashes[order], to[order]
    once = np.insert((hashes[1:] != hashes[:-1]) | (to[1:] != to[:-1]), 0, True)[: len(hashes)]
    return packed_rows(hashes[once], to[once])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept of every row: the words that stay, joined by one space, or with digest their SHA-256."""
    spark = docs.sparkSession
    shuffle = partitions(spark)
    buckets = 2 * shuffle
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))

    def ask(batches):
        for batch in in_blocks(batches, "text", BLOCK_BYTES):
            words, bounds = word_hashes(utf8(batch.column("text")))
            asked, known = questions(words, bounds, batch.column("doc").to_numpy(), window)
            if len(asked):
                sent = np.empty(len(asked), _SENT)
                sent["hash"], sent["to"] = asked["hash"], doc_bucket(asked["doc"], buckets)
                yield packed_rows(sent, hash_bucket(sent["hash"], buckets))
            if len(known):
                yield packed_rows(known["hash"], doc_bucket(known["doc"], buckets), 1)

    def survive(batches):
        """Hashes that two blocks hold, for the bucket of each document that asked."""
        found: list = []  # (hashes, the buckets they go to), of several buckets, so that rows follow the tasks
        for bucket, entries in grouped(batches, _SENT):
            if bucket is not None:
                hashes = unplaned(entries, _HASH)
                found.append((hashes, np.full(len(hashes), bucket, np.int64)))
            else:
                entries = entries[np.argsort(entries["hash"], kind="stable")]
                same = entries["hash"][1:] == entries["hash"][:-1]
                kept = entries[np.append(same, False) | np.insert(same, 0, False)]
                found.append((kept["hash"], kept["to"].astype(np.int64)))
            if sum(len(x) for x, _ in found) > MOST_HELD:
                yield answers_of(found)
                found = []
        if found:
            yield answers_of(found)

    def meet(answers: DataFrame, wanted: DataFrame) -> DataFrame:
        """Answers (kind 0) and documents (kind 1) of each bucket together, answers first."""
        told = answers.select("bucket", F.lit(0).alias("kind"), "packed", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("text"))
        return told.unionByName(wanted.select("bucket", F.lit(1).alias("kind"), "packed", "doc", "text")).repartition(shuffle, "bucket").sortWithinPartitions("bucket", "kind")

    def met(batches, kind: np.dtype):
        """(bucket, its answers, a batch of its documents)"""
        now, parts, answers = None, [], None
        for batch in in_blocks(batches, "text", BLOCK_BYTES // 2):  # compressed texts
            bucket, kinds = batch.column("bucket").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(bucket.astype(np.int64) * 2 + kinds, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                if bucket[a] != now:
                    now, parts, answers = bucket[a], [], None
                part = batch.slice(a, b - a)
                if not kinds[a]:
                    parts += [unplaned(x, kind) for x in part.column("packed").to_pylist()]
                else:
                    answers = (np.concatenate(parts) if parts else np.zeros(0, kind)) if answers is None else answers
                    yield int(now), answers, part

    def finish(words: list[bytes]) -> str:
        kept = b" ".join(words)
        return hashlib.sha256(kept).hexdigest() if digest else kept.decode()

    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary()), ("doc", pa.int64()), ("text", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    ddl = "bucket int, kind int, packed binary, doc long, text binary, n_words long, n_removed long, kept string"

    def extend(batches):
        """Full windows whose half survived (kind 0), and documents: done (kind 2), or with the places of those windows (kind 1)."""
        for bucket, survivors, batch in met(batches, _HASH):
            small = batch.column("text").to_pylist()
            data, ids = unsqueezed(batch.column("text")), batch.column("doc").to_numpy()
            words, bounds = word_hashes(data)
            halves, least, valid = anchors(words, bounds, window)
            at = np.flatnonzero(valid & np.isin(least, survivors)) if len(survivors) else np.zeros(0, np.int64)
            text = np.searchsorted(bounds, at, side="right") - 1
            if len(at):
                places = np.empty(len(at), _PLACE)
                # twice the length, from two halves
                one, two = halves[at], halves[at + window // 2]
                places["hash"] = mix(one * np.uint64(0x9FB21C651E98DF25) + two)
                places["check"] = (mix(two * np.uint64(0xC2B2AE3D27D4EB4F) ^ one) >> np.uint64(32)).astype(np.uint32)
                places["doc"], places["start"] = ids[text], at - bounds[text]
                places = first_places(places)
                found = packed_rows(places, hash_bucket(places["hash"], buckets))
                yield rows(schema, {f.name: found.column(f.name) if f.name in found.schema.names else [None] * len(found) for f in schema})
            counts = np.bincount(text, minlength=len(data)).tolist()
            ends = np.cumsum(counts).tolist()
            runs = [None] * len(data)
            for i, n in enumerate(counts):
                if n:
                    starts = at[ends[i] - n : ends[i]] - bounds[i]
                    cut = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
                    runs[i] = np.stack([starts[cut], np.diff(np.append(cut, n))], axis=1).astype("<u4").tobytes()
            done = [r is None for r in runs]
            yield rows(schema, {"bucket": [bucket] * len(data), "kind": [2 if d else 1 for d in done], "packed": runs, "doc": ids, "text": [None if d else x for d, x in zip(done, small)], "n_words": np.diff(bounds), "n_removed": [0] * len(data), "kept": [finish(x.split()) if d else None for d, x in zip(done, data)]})

    def firsts(batches):
        held: list = []
        for _, places in grouped(batches, _PLACE):
            places = first_places(places)
            found = np.empty(len(places), _FIRST)
            found["doc"], found["start"] = places["doc"], places["start"]
            held.append(found)
            if sum(map(len, held)) > MOST_HELD:
                found, held = np.concatenate(held), []
                yield packed_rows(found, doc_bucket(found["doc"], buckets))
        if held:
            found = np.concatenate(held)
            yield packed_rows(found, doc_bucket(found["doc"], buckets))

    result = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(batches):
        last = None
        for _, first, batch in met(batches, _FIRST):
            if first is not last:
                last, first_sorted = first, first[np.argsort(first["doc"], kind="stable")]
            out = {f.name: [] for f in result}
            for doc, packed, text in zip(batch.column("doc").to_pylist(), batch.column("packed").to_pylist(), unsqueezed(batch.column("text"))):
                runs = np.frombuffer(packed, "<u4").reshape(-1, 2).astype(np.int64)
                starts = np.repeat(runs[:, 0] - np.cumsum(runs[:, 1]) + runs[:, 1], runs[:, 1]) + np.arange(runs[:, 1].sum())
                a, b = np.searchsorted(first_sorted["doc"], [doc, doc], side="left")[0], np.searchsorted(first_sorted["doc"], doc, side="right")
                starts = starts[~np.isin(starts, first_sorted["start"][a:b])]
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                for k, v in zip(out, (doc, len(words), len(words) - len(kept), finish(kept))):
                    out[k].append(v)
            yield rows(result, out)

    message = "bucket int, kind int, packed binary"
    deal = lambda df: df.select("bucket", "kind", "packed").repartition(shuffle, "bucket").sortWithinPartitions("bucket")
    answers = deal(texts.mapInArrow(ask, message)).mapInArrow(survive, message)
    bucketed = texts.mapInArrow(_with_bucket(buckets), "bucket int, packed binary, doc long, text binary")
    state = stored(meet(answers, bucketed).mapInArrow(extend, ddl), "passages")
    told = deal(state.filter("kind = 0")).mapInArrow(firsts, message)
    changed = meet(told, state.filter("kind = 1").select("bucket", "packed", "doc", "text")).mapInArrow(remove, "doc long, n_words long, n_removed long, kept string")
    out = state.filter("kind = 2").select("doc", "n_words", "n_removed", "kept").unionByName(changed)
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), "n_words", "n_removed", "kept")


def _with_bucket(buckets: int):
    def add(batches):
        for batch in in_blocks(batches, "text"):
            bucket = doc_bucket(batch.column("doc").to_numpy(), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(batch), pa.binary()), batch.column("doc"), pa.array(squeezed(utf8(batch.column("text"))), pa.binary())], names=["bucket", "packed", "doc", "text"])

    return add


def op10(spark, sf_dir):
    """Contract op10: what stays of every document."""
    found = repeated_passages(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
