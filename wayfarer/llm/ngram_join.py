"""Jaccard join of word shingles with token-combination prefixes, and the components of its links.

Tokens (shingle hashes) have two classes. Frequent ones are those that blocks of texts see again
and again; all others are rare. The order of tokens is rare before frequent, and by hash within
a class. A set of n tokens may miss t = n - ceil(0.85 n) of them in a partner. If it has t + 1
rare tokens, these are its prefix, each indexed by itself. Otherwise the prefix is extended
into the frequent tokens, which fall into sub-classes by hash: a token counts only if one of its
sub-class came before, until t + 1 count, and pairs of one sub-class are indexed. Whichever of
two linked sets has the shorter prefix shares one rare token or two of one sub-class with the
other's, so no link is lost. The number of sub-classes follows the size (sets near a power of
two are indexed for both sides), which keeps the pairs in proportion to the prefix.

Equal sets are one class from the start. Entries of the index with few classes give all pairs;
those with many give pairs with one class of theirs. Candidates are verified on whole sets in
three rounds: first one partner for each class, then the other pairs that still lie in
different components, then such pairs of the large entries, which are cut into blocks
and compared block by block in tasks of their own: of each two blocks first those that would connect
something new, then all that are left. Linking within a component
changes nothing, so the components are exact without the pairs of a large group of copies.
A sketch of parities as long as the set asks for, which bounds from below in how many tokens two sets differ, drops most
pairs that cannot link before any text is fetched.

Defined results: null and texts without words have an empty set and link with nothing. A text
of fewer than four words has one shingle, the whole of it. Rows that share an id are sets of
their own; component_id is the least id. A null id sorts first and is equal to other null ids.
Repeated rows are equal sets, so they link if they have a word. Ties don't matter: components
are the same in any order. Long texts are read whole. An empty table gives no rows.
Tokens are 64-bit hashes over the words' own xxh3 hashes. Columns other than the two named are
not looked at, and columns of the table with clashing names do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, least_count, new_names, partitions, rows, settled, squeezed, stored, table, unsqueezed, utf8
from .components import components
from .shingles import LOWER, mix, window_hashes, word_hashes

NO_ID = -(2**63)
#: Frequent tokens that go to every worker: the bound of what is broadcast. More would only lengthen the index.
MOST_FREQUENT, LEAST_COUNT = 500_000, 32
FEW = 8
#: Classes of a large entry that travel in one row, and that one block of it holds when pairs across are looked for.
RUN, TILE = 4096, 2048
#: Groups that go to every worker, those of the most members: the bound of what is broadcast. Smaller ones meet their members by a shuffle.
MOST_GROUPS = 100_000
BLOCK_BYTES = 1_500_000
LEAST_BITS, BITS_PER_TOKEN = 256, 4
_ENTRY = np.dtype([("sig", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("hot", "<u4")])
_COUNT = np.dtype([("token", "<u8"), ("n", "<i8")])


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, lower-cased A-Z."""
    words, bounds = word_hashes([t.translate(LOWER) for t in texts])
    grams, out = window_hashes(words, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - 2**63


def prefix_signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, bool]:
    """What a set is indexed under; whether frequent tokens are among it."""
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1
    at = np.searchsorted(frequent, tokens)
    hot = frequent[np.minimum(at, len(frequent) - 1)] == tokens if len(frequent) else np.zeros(n, bool)
    rare = tokens[~hot]
    if len(rare) >= need:
        return rare[:need], False
    often, need = tokens[hot], need - len(rare)
    out = [rare]
    for level in sorted({int(x).bit_length() for x in (-(-percent * n // 100), 100 * n // percent)}):
        kinds = max(1, 1 << level >> 3)
        kind = mix(often + np.uint64(level)) % np.uint64(kinds)
        order = np.argsort(kind, kind="stable")
        first = np.ones(len(often), bool)
        first[order[1:]] = kind[order[1:]] != kind[order[:-1]]
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        some, kind = often[:end], kind[:end]
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order].astype(np.int64), prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            x = some[order[a:b]]
            i, j = np.triu_indices(len(x), 1)
            out.append(mix(x[i] * np.uint64(0x9FB21C651E98DF25) + x[j] + np.uint64(level)))
    return np.unique(np.concatenate(out)), True


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parities of each set: every token flips one bit. Two sets differ in at least as many tokens as their sketches differ in bits.

    The bits are a power of two in proportion to the set, so long texts are told apart as well as short ones.
    """
    out = [b""] * len(sets)
    bits = [max(LEAST_BITS, 1 << (BITS_PER_TOKEN * len(s) - 1).bit_length()) if len(s) else 0 for s in sets]
    for size in sorted({*bits} - {0}):
        at = [i for i, x in enumerate(bits) if x == size]
        owner = np.repeat(np.arange(len(at)), [len(sets[i]) for i in at])
        bit = (np.concatenate([sets[i] for i in at]) >> np.uint64(30)).astype(np.int64) & (size - 1)
        odd = np.bincount(owner * size + bit, minlength=len(at) * size).reshape(len(at), size) & 1
        for i, x in zip(at, np.packbits(odd.astype(np.uint8), axis=1)):
            out[i] = x.tobytes()
    return out


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as sets have them that take fewer words: the parities of the halves add up."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def as_words(found: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    return np.frombuffer(b"".join(found), "<u8").reshape(len(found), -1)


def fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes of two sets allow a link."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def may_link(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m tokens with sketches a and b of one length can link: their sizes allow it, and their difference isn't shown to be too large."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1).astype(np.int64)
    return fits(n, m, percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def tiled(entries: DataFrame, percent: int) -> DataFrame:
    """id, cls, n, root, tile, side: entries (id, cls, n, root, size) dealt out to the tiles in which they are compared.

    An entry of up to TILE classes is one tile. A larger one is cut into bands of sizes, so that sets that can link are of one
    band or of two that follow each other, and bands into blocks by hash. Every two blocks of such bands have a tile, with a
    side each, and every block has one of its own (side 2): two classes that can link meet in one tile.
    """
    step = math.log(100 / percent) * (1 + 1e-9)
    keys = ["id", "cls", "n", "root"]
    many = entries.filter(F.col("size") > TILE).withColumn("band", F.floor(F.log("n") / step).cast("int"))
    bands = many.groupBy("id", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    for by, name in ((0, "own"), (1, "above"), (-1, "below")):
        many = many.join(bands.select("id", (F.col("band") - by).alias("band"), F.col("blocks").alias(name)), ["id", "band"], "left")
    band, block = F.col("band"), F.pmod(F.xxhash64("cls"), F.col("own")).cast("int")

    def meets(blocks: str, tile):
        n = F.coalesce(blocks, F.lit(0))
        return F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n), tile)

    def place(side, *tile):
        return F.struct(F.xxhash64(*tile).alias("tile"), F.lit(side).cast("int").alias("side"))

    own = meets("own", lambda t: place(F.when(t == block, 2).when(t < block, 1).otherwise(0), band, F.least(t, block), band, F.greatest(t, block)))
    above = meets("above", lambda t: place(0, band, block, band + 1, t))
    below = meets("below", lambda t: place(1, band - 1, t, band, block))
    many = many.select(*keys, F.inline(F.concat(own, above, below)))
    return entries.filter(F.col("size") <= TILE).select(*keys, F.lit(0).cast("long").alias("tile"), F.lit(2).alias("side")).unionByName(many)


def packed(entries: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([entries[a:b].tobytes() for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)])], pa.binary())], names=["bucket", "packed"])


def grouped(batches, kind: np.dtype):
    now, parts = None, []
    for batch in batches:
        for bucket, x in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
            if bucket != now and parts:
                yield np.concatenate(parts)
                parts = []
            now = bucket
            parts.append(np.frombuffer(x, dtype=kind))
    if parts:
        yield np.concatenate(parts)


def spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles and component_id of every row: sets link when 100 * intersection >= percent * union."""
    placed = _placed(docs, id_col, text_col, k, percent, [])
    least = placed.filter("root is not null").groupBy("root").agg(F.min("doc").alias("component"), F.count("*").alias("members"))
    some = _met(placed, stored(least, "groups"), "root", "members").select("doc", "n", "component")
    out = some.unionByName(placed.filter("root is null").select("doc", "n", F.col("doc").alias("component")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc").alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def _key(id_col: str, text_col: str) -> dict:
    """What tells the rows that share an id apart."""
    return {"doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "content": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


def _met(some: DataFrame, groups: DataFrame, key: str, members: str) -> DataFrame:
    """some with the columns of its groups; rows without a group go. The groups of the most members are broadcast, so that a group of a third of all rows isn't shuffled to one task."""
    least = least_count(groups, members, MOST_GROUPS)
    large = groups.filter(F.col(members) >= least)
    small = some.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.filter(F.col(members) < least), key)
    return some.join(F.broadcast(large), key).unionByName(small)


def _placed(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, more: list[str]) -> DataFrame:
    """doc, n, root and more (content or nothing) of every row; root is null for an empty set."""
    return settled(docs.sparkSession, lambda: _place(docs, id_col, text_col, k, percent, more), "placed")


def _place(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, more: list[str]) -> DataFrame:
    spark = docs.sparkSession
    shuffle = partitions(spark)
    buckets = 4 * shuffle
    texts = docs.select(*(c.alias(name) for name, c in _key(id_col, text_col).items() if name in ("doc", *more)), F.col(text_col).alias("text"))
    message = "bucket int, packed binary"
    deal = lambda df: df.repartition(shuffle, "bucket").sortWithinPartitions("bucket")
    first = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("doc", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()), *((c, pa.int64()) for c in more)])

    def describe(batches):
        """A row per document, and counts of the tokens that a block's classes share."""
        for batch in in_blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(utf8(batch.column("text")), k)
            names = [class_of(s) if len(s) else None for s in sets]
            yield rows(first, {"bucket": [None] * len(sets), "packed": [None] * len(sets), "doc": batch.column("doc").to_pylist(), "n": list(map(len, sets)), "cls": names, "sketch": sketches(sets), **{c: batch.column(c).to_pylist() for c in more}})
            tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *dict(zip(names, sets)).values()]), return_counts=True)
            if (n > 1).any():
                entries = np.empty(int((n > 1).sum()), _COUNT)
                entries["token"], entries["n"] = tokens[n > 1], n[n > 1]
                found = packed(entries, spread(entries["token"], buckets))
                yield rows(first, {f.name: found.column(f.name) if f.name in found.schema.names else [None] * len(found) for f in first})

    def total(batches):
        schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
        for entries in grouped(batches, _COUNT):
            tokens, at = np.unique(entries["token"], return_inverse=True)
            n = np.bincount(at, weights=entries["n"]).astype(np.int64)
            yield rows(schema, {"token": tokens[n >= LEAST_COUNT].view(np.int64), "n": n[n >= LEAST_COUNT]})

    described = stored(texts.mapInArrow(describe, ", ".join(["bucket int, packed binary, doc long, n long, cls long, sketch binary", *(f"{c} long" for c in more)])), "shingle-sets")
    members = described.filter("bucket is null").select("doc", "n", "cls", *more)
    classes = described.filter("cls is not null").select("cls", "n", "sketch")
    counts = stored(deal(described.filter("bucket is not null").select("bucket", "packed")).mapInArrow(total, "token long, n long"), "token-counts")
    least = least_count(counts, "n", MOST_FREQUENT)
    top = counts.filter(F.col("n") >= least).select("token").toArrow().column("token").to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(top.view(np.uint64)))  # at most 8 x MOST_FREQUENT bytes

    def index(batches):
        least = -(-100 // (100 - percent)) - 1  # sets of fewer tokens link only if they are equal
        for batch in in_blocks(batches, "text", BLOCK_BYTES):
            sets = {class_of(s): s for s in shingle_sets(utf8(batch.column("text")), k) if len(s) >= least}
            parts = []
            for name, s in sets.items():
                sigs, hot = prefix_signatures(s, frequent.value, percent)
                part = np.empty(len(sigs), _ENTRY)
                part["sig"], part["cls"], part["n"], part["hot"] = sigs, name, len(s), hot
                parts.append(part)
            if parts:
                entries = np.concatenate(parts)
                yield packed(entries, spread(entries["sig"], buckets))

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("part", pa.int64()), ("run", pa.binary())])

    def candidates(batches):
        """Pairs of classes with sizes that allow a link; large entries give pairs with one class, and their classes in runs."""
        for entries in grouped(batches, _ENTRY):
            entries = entries[np.lexsort((entries["cls"], entries["n"], entries["sig"]))]
            keep = np.insert((entries["sig"][1:] != entries["sig"][:-1]) | (entries["cls"][1:] != entries["cls"][:-1]), 0, True)
            entries = entries[keep]
            cuts = np.flatnonzero(np.insert(entries["sig"][1:] != entries["sig"][:-1], 0, True))
            sizes = np.diff(np.append(cuts, len(entries)))
            left, right, large = [], [], {}
            for size in np.unique(sizes[(sizes > 1) & (sizes <= FEW)]).tolist():
                i, j = np.triu_indices(size, 1)
                at = cuts[sizes == size][:, None]
                left.append((at + i).ravel())
                right.append((at + j).ravel())
            for a, size in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
                n = entries["n"][a : a + size].astype(np.int64)
                middle = a + int(np.argsort(n, kind="stable")[size // 2])
                others = np.setdiff1d(np.arange(a, a + size), [middle])
                left.append(np.full(len(others), middle))
                right.append(others)
                run = np.stack([entries["cls"][a : a + size], n], axis=1)
                large[xxhash.xxh3_64_intdigest(run.tobytes()) - 2**63] = (a, size)
            if not left:
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            x, y = entries["n"][i].astype(np.int64), entries["n"][j].astype(np.int64)
            fit = fits(x, y, percent)
            a, b = entries["cls"][i][fit], entries["cls"][j][fit]
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            once = np.insert((a[1:] != a[:-1]) | (b[1:] != b[:-1]), 0, True) if len(a) else np.zeros(0, bool)
            a, b = a[once], b[once]
            none = [None] * len(a)
            yield rows(pair, {"a": a, "b": b, "id": none, "part": none, "run": none})
            for name, (a, size) in large.items():
                runs = [np.stack([entries["cls"][x : min(x + RUN, a + size)], entries["n"][x : min(x + RUN, a + size)].astype(np.int64)], axis=1).tobytes() for x in range(a, a + size, RUN)]
                none = [None] * len(runs)
                yield rows(pair, {"a": none, "b": none, "id": [name] * len(runs), "part": range(len(runs)), "run": runs})

    found = stored(deal(texts.mapInArrow(index, message)).mapInArrow(candidates, "a long, b long, id long, part long, run binary"), "candidates")

    def plausible(batches):
        for batch in batches:
            n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            x, y = (np.array(batch.column(c).to_pylist(), object) for c in ("sa", "sb"))
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y)], np.int64).reshape(-1, 2)
            keep = np.zeros(len(batch), bool)
            for p, q in np.unique(sizes, axis=0).tolist():
                at = np.flatnonzero((sizes == (p, q)).all(axis=1))
                least = min(p, q) // 8
                keep[at] = may_link(n[at], m[at], folded(as_words(x[at].tolist()), least), folded(as_words(y[at].tolist()), least), percent)
            if keep.any():
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    runs = found.filter("run is not null").select("id", "part", "run").dropDuplicates(["id", "part"])

    def open_run(batches):
        schema = pa.schema([("id", pa.int64()), ("cls", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for name, run in zip(batch.column("id").to_pylist(), batch.column("run").to_pylist()):
                x = np.frombuffer(run, "<i8").reshape(-1, 2)
                yield rows(schema, {"id": [name] * len(x), "cls": x[:, 0], "n": x[:, 1]})

    opened = stored(runs.mapInArrow(open_run, "id long, cls long, n long"), "large-entries")
    wanted = found.filter("run is null").select("a", "b").distinct()
    touched = wanted.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(opened.select("cls")).distinct()
    sketched = stored(classes.dropDuplicates(["cls"]).join(touched, "cls", "left_semi"), "sketches")
    for c in "ab":
        wanted = wanted.join(sketched.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    pairs = stored(wanted.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(plausible, "a long, b long"), "pairs")
    # whole texts of the classes that have a candidate, one document each
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(opened.select("cls")).distinct()
    chosen = members.filter("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc")).join(wanted, "cls", "left_semi")

    def pick(batches):
        schema = pa.schema([("doc", pa.int64()), ("cls", pa.int64()), ("text", pa.binary())])
        for batch in in_blocks(batches, "text", BLOCK_BYTES):
            data = utf8(batch.column("text"))
            sets = shingle_sets(data, k)
            yield rows(schema, {"doc": batch.column("doc"), "cls": [class_of(s) if len(s) else None for s in sets], "text": squeezed(data)})

    whole = texts.mapInArrow(pick, "doc long, cls long, text binary").join(chosen, ["doc", "cls"], "left_semi").dropDuplicates(["cls"]).select("cls", "text")
    whole = stored(whole, "candidate-texts")

    def check(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        last, kept = None, None
        for batch in batches:
            for part in in_blocks([batch], "tb", 300_000):
                others = shingle_sets(unsqueezed(part.column("tb")), k)
                u, v = [], []
                for a, b, ta, tb in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("ta"), others):
                    if a != last:
                        last, kept = a, shingle_sets(unsqueezed(pa.array([ta.as_py()])), k)[0]
                    if linked(kept, tb, percent):
                        u.append(a)
                        v.append(b)
                yield rows(schema, {"u": u, "v": v})

    def verified(some: DataFrame) -> DataFrame:
        some = some.join(whole.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        return some.join(whole.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(check, "u long, v long")

    def edges(found: DataFrame) -> DataFrame:
        return found.select(F.col("node").alias("u"), F.col("root").alias("v"))

    def root(found: DataFrame, c: str) -> DataFrame:
        return found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))

    def apart(some: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
        """Pairs in different components that were not verified yet."""
        some = some.join(root(found, "a"), "a", "left").join(root(found, "b"), "b", "left")
        return some.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").distinct().join(seen, ["a", "b"], "left_anti")

    first_pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    one = components(verified(first_pairs))
    two = components(edges(one).unionByName(verified(stored(apart(pairs, one, first_pairs), "pairs-apart"))))

    def across(batches, forest):
        """Pairs of classes of one tile of a large entry that lie in different components; of the entries that two classes share, the least gives the pair. forest: each tile gives only pairs that would connect what none of its earlier pairs does."""
        schema = pa.schema([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

        def of(name, cls, n, group, side, sketch, before):
            order = np.argsort(n, kind="stable")
            cls, n, group, side, sketch, before = cls[order], n[order], group[order].copy(), side[order], sketch[order], before[order]
            length = np.fromiter(map(len, sketch), np.int64, len(sketch))
            for size in np.unique(length).tolist():
                # sets of this length of sketch against those of the same and of twice the length, which follow them
                start, middle, end = np.searchsorted(length, [size, size + 1, 2 * size + 1]).tolist()
                bits = as_words(sketch[start:middle].tolist())
                if end > middle:
                    bits = np.concatenate([bits, *(folded(as_words([x]), size // 8) for x in sketch[middle:end].tolist())])
                for i in range(start, middle):
                    j = np.flatnonzero((group[i + 1 : end] != group[i]) & ((side[i + 1 : end] != side[i]) | (side[i] == 2))) + i + 1
                    j = j[may_link(n[j], n[i], bits[j - start], bits[i - start], percent)] if len(j) else j
                    found = []
                    for x in j.tolist():
                        if forest and group[x] != group[i]:
                            found.append(x)
                            group[group == group[x]] = group[i]
                        elif not forest and before[i].isdisjoint(before[x]):
                            found.append(x)
                    if found:
                        j = np.array(found)
                        yield rows(schema, {"id": [name] * len(j), "a": np.minimum(cls[i], cls[j]), "b": np.maximum(cls[i], cls[j])})

        now, parts = None, []
        for batch in batches:
            if not len(batch):
                continue
            ids, tiles, entries = batch.column("id").to_numpy(), batch.column("tile").to_numpy(), batch.column("entries")
            ends, values = entries.offsets.to_numpy(), entries.values.to_numpy()
            before = np.empty(len(batch), object)
            before[:] = [{y for y in values[a:b].tolist() if y < x} for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.tolist())]
            x = [*(batch.column(c).to_numpy() for c in ("cls", "n", "root", "side")), np.array(batch.column("sketch").to_pylist(), object), before]
            cuts = np.flatnonzero(np.insert((ids[1:] != ids[:-1]) | (tiles[1:] != tiles[:-1]), 0, True)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                if (ids[a], tiles[a]) != now and parts:
                    yield from of(now[0], *(np.concatenate(y) for y in zip(*parts)))
                    parts = []
                now = ids[a], tiles[a]
                parts.append([y[a:b] for y in x])
        if parts:
            yield from of(now[0], *(np.concatenate(y) for y in zip(*parts)))

    def pairs_across(some: DataFrame, forest: bool) -> DataFrame:
        """some: entries (id, cls, n, root)."""
        torn = some.groupBy("id").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).filter("x <> y").select("id", "size")
        some = _met(some, stored(torn, "torn-entries"), "id", "size")
        if forest:
            more = sketched.select("cls", "sketch", F.expr("cast(array() as array<bigint>)").alias("entries"))
        else:  # a class has no more entries than signatures
            more = some.groupBy("cls").agg(F.collect_list("id").alias("entries")).join(sketched.select("cls", "sketch"), "cls")
        some = tiled(some, percent).join(more, "cls")
        some = some.select("id", "cls", "n", "root", "tile", "side", "sketch", "entries").repartition(shuffle, "id", "tile").sortWithinPartitions("id", "tile")
        return stored(some.mapInArrow(lambda x: across(x, forest), "id long, a long, b long"), "pairs-across")

    def rooted(some: DataFrame, found: DataFrame) -> DataFrame:
        return some.join(root(found, "cls"), "cls", "left").select("id", "cls", "n", F.coalesce("root_cls", "cls").alias("root"))

    trees = pairs_across(stored(rooted(opened, two), "named-entries"), True)
    tree_pairs = stored(apart(trees, two, pairs), "pairs-of-trees")
    three = components(edges(two).unionByName(verified(tree_pairs)))
    # an entry whose tree is empty has no pair left to look at
    left = pairs_across(stored(rooted(opened.join(trees.select("id").distinct(), "id", "left_semi"), three), "named-entries"), False)
    left = stored(apart(left, three, pairs.unionByName(tree_pairs)), "pairs-left")
    roots = components(edges(three).unionByName(verified(left)))
    placed = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return placed.select("doc", "n", "root", *more)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each component: one whose id is the component's."""
    key = new_names([*docs.columns, "doc", "content", "n", "root", "keep", "members", "stays"], "doc", "content")
    placed = _placed(docs, id_col, text_col, k, percent, ["content"]).filter("root is not null").withColumnsRenamed(dict(zip(("doc", "content"), key)))
    kept = stored(placed.groupBy("root").agg(F.min(F.struct(*key)).alias("keep"), F.count("*").alias("members")).filter("members > 1"), "near-groups")
    met = _met(placed, kept, "root", "members").withColumn("stays", F.struct(*key) == F.col("keep"))
    gone = met.filter("not stays").select(*key).distinct()
    again = stored(met.filter("stays").groupBy(*key).count().filter("count > 1").select(*key), "near-again")
    rest = docs.withColumns(dict(zip(key, _key(id_col, text_col).values()))).join(gone, key, "left_anti")
    if not again.isEmpty():
        rest = rest.join(again, key, "left_anti").unionByName(rest.join(again, key, "left_semi").dropDuplicates(key))
    return rest.select(*docs.columns)


def op9(spark, sf_dir):
    """Contract op9: the component of every document."""
    return similar_components(table(spark, sf_dir, "documents"))
