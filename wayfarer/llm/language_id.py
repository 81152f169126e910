"""Language identification with bit-sliced Bloom filters of character n-grams.

Each n-gram of a language's sample sets that language's bit in a few rows of one table of
bitmasks. The bitwise AND of an n-gram's rows gives, in one look, every language that may hold
it. Per language, the share of a text's n-grams that hit is corrected for the filter's
false-positive rate (fill to the power of probes); the greatest corrected share decides and is
the score.

The model learns from a bounded sample: about TRAIN_DOCS rows of each language, among rows with
a language whose crc32(id as text) mod 5 is not 0. The hash of a row's id and text decides, below
a threshold that follows from the language's count, so no ranking of all rows is needed. Every
language with a letter in its sample is learned, with every n-gram that enough of its documents
hold: 64 languages share a table of bitmasks, further ones take further tables. Prediction reads
whole texts and nothing else, a bounded run of characters at a time.

Defined results: a text that is null, empty or has no letter is `und` with score 0, and so is
every text if nothing could be learned. Ties go to the language with more labelled rows. Rows
that share an id are judged apart; repeated rows get equal results and count once in the sample.
A null id is held out. An empty table gives no rows. Columns of the table with the names of the
result's give way to it; keep_identified() looks at no column but the text and keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_blocks, new_names, rows, stored, table, utf8
from .shingles import mix

UNKNOWN = "und"
FOLDS = 5
TRAIN_DOCS, WORD_BITS = 1500, 64
#: Characters whose n-grams are in memory at a time.
RUN, BLOCK_BYTES = 1 << 16, 500_000
#: An n-gram must occur in so many documents of a language's sample, and in this share of them: more than wrong labels make.
LEAST_DOCS, LEAST_SHARE = 3, 0.005
SIZES, PROBES = (3, 4), 2
#: Documents that score less than this are rejected by the corpus filter.
LEAST_SCORE = 0.3

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points of all planes are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def runs_of_n_grams(texts: list[bytes]):
    """First which texts have a letter. Then, run by run, hashes of the n-grams of words (with a blank on either side) and the text each is of.

    Letters are lower-cased; all else is a blank, and runs of blanks count once.
    """
    text = "".join(" " + x.decode("utf-8", "replace").replace("\0", " ").lower() + "\0" for x in texts)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    del text
    ends = np.flatnonzero(code == 0)
    letter = letters()[code]
    code = np.where(letter, code, np.uint32(32))
    owner = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=-1))
    keep = letter | np.insert(letter[:-1], 0, True)  # the first blank of a run, or of a text
    keep[ends] = keep[np.insert(ends[:-1] + 1, 0, 0)] = True
    code, owner, letter = code[keep], owner[keep], letter[keep]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    yield has
    for n in SIZES:
        for first in range(0, len(code) - n + 1, RUN):
            count = min(RUN, len(code) - n + 1 - first)
            h = np.zeros(count, np.uint64)
            inner = letter[first + 1 : first + 1 + count].copy()
            for i in range(n):
                part = slice(first + i, first + i + count)
                h *= np.uint64(0x100000001B3)
                h += code[part]
                if 1 < i < n - 1:
                    inner &= letter[part]
            inner &= owner[first : first + count] == owner[first + n - 1 : first + n - 1 + count]
            yield mix(h[inner] + np.uint64(n)), owner[first : first + count][inner]


def n_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of the texts' n-grams, the text each is of, and which texts have a letter."""
    runs = runs_of_n_grams(texts)
    has, found = next(runs), list(runs)
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)]), np.concatenate([np.zeros(0, np.int32), *(o for _, o in found)]), has


def least_docs(sampled: int) -> int:
    """Documents that must hold an n-gram, in a language with so many in its sample; with fewer than twenty, wrong labels can't be told by counts."""
    return max(min(LEAST_DOCS, 1 + sampled // 10), int(LEAST_SHARE * sampled))


class Masks:
    """A row of language bits per slot, for at most WORD_BITS languages; an n-gram has PROBES slots."""

    def __init__(self, grams: dict[str, np.ndarray], slots_per_gram: int = 16):
        self.languages = list(grams)
        most = max((len(x) for x in grams.values()), default=1)
        self.bits = max(10, int(slots_per_gram * most - 1).bit_length())
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(self.languages) <= np.dtype(k).itemsize * 8)
        self.rows = np.zeros(1 << self.bits, dtype=kind)
        for i, language in enumerate(self.languages):
            for at in self.slots(grams[language]):
                self.rows[at] |= kind(1 << i)  # a slot twice in one array gets the same bit
        fill = np.array([np.count_nonzero(self.rows >> kind(i) & kind(1)) / len(self.rows) for i in range(len(self.languages))])
        self.false = np.minimum(fill**PROBES, 0.99)

    def slots(self, hashes: np.ndarray):
        for k in range(PROBES):
            yield (hashes >> np.uint64(k * 24) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def hits(self, hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """(texts, languages) n-grams that each language may hold."""
        mask = np.full(len(hashes), ~self.rows.dtype.type(0), dtype=self.rows.dtype)
        for at in self.slots(hashes):
            mask &= self.rows[at]
        kind = self.rows.dtype.type
        return np.stack([np.bincount(owner, weights=mask >> kind(i) & kind(1), minlength=texts) for i in range(len(self.languages))], axis=1)

    def shares(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Hits among so many n-grams of each text, corrected for what falls into a filter by chance."""
        return np.clip((hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false), 0, 1)


class Filters:
    """Masks for any number of languages; a table is as long as the largest of its own languages asks for."""

    def __init__(self, grams: dict[str, np.ndarray], slots_per_gram: int = 16):
        self.languages = list(grams)
        cuts = range(0, len(self.languages), WORD_BITS)
        self.masks = [Masks({x: grams[x] for x in self.languages[i : i + WORD_BITS]}, slots_per_gram) for i in cuts]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected shares; which texts have a letter."""
        runs = runs_of_n_grams(texts)
        has, total = next(runs), np.zeros(len(texts))
        hits = [np.zeros((len(texts), len(m.languages))) for m in self.masks]
        for hashes, owner in runs:
            total += np.bincount(owner, minlength=len(texts))
            for m, h in zip(self.masks, hits):
                h += m.hits(hashes, owner, len(texts))
        return np.concatenate([m.shares(h, total) for m, h in zip(self.masks, hits)], axis=1), has

    def decide(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        scores, has = self.scores(texts)
        best = scores.argmax(axis=1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], [float(scores[i, b]) if h else 0.0 for i, (b, h) in enumerate(zip(best, has))]


def fold(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from the sample of labelled rows. What comes to the driver is bounded by the languages and their samples."""
    spark = docs.sparkSession
    rows_ = docs.filter(F.col(lang_col).isNotNull() & (fold(id_col) != 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("pick"))
    common = {r["lang"]: r["count"] for r in rows_.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not common:
        return Filters({})
    # a row is in the sample if its hash is below the share that is asked for: no language's rows meet in one task
    shares = spark.createDataFrame([(x, min(1.0, train_docs / n)) for x, n in common.items()], "lang string, share double")
    place = (F.col("pick").cast("double") / 2.0**63 + 1) / 2
    chosen = stored(rows_.join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("lang", "pick", "text").dropDuplicates(["lang", "pick"]), "language-sample")
    sampled = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in in_blocks(batches, "text", BLOCK_BYTES):
            languages = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            hashes, owner, _ = n_grams(utf8(batch.column("text")))
            for language in sorted(set(languages.tolist())):
                mine = languages[owner] == language if len(owner) else np.zeros(0, bool)
                order = np.lexsort((owner[mine], hashes[mine]))
                h, o = hashes[mine][order], owner[mine][order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                gram, n = np.unique(h[once], return_counts=True)
                yield rows(schema, {"lang": [language] * len(gram), "gram": gram.view(np.int64), "n": n})

    counts = stored(chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")

    def grams(least: dict[str, int]) -> dict[str, np.ndarray]:
        """The n-grams of each of these languages that enough of its documents hold."""
        asked = F.broadcast(spark.createDataFrame(list(least.items()), "lang string, least long"))
        found = counts.join(asked, "lang").filter(F.col("n") >= F.col("least")).select("lang", "gram").toArrow().to_pandas()
        return {x: part["gram"].to_numpy().astype(np.int64).view(np.uint64) for x, part in found.groupby("lang")}

    parts = grams({x: least_docs(n) for x, n in sampled.items()}) if sampled else {}
    if rest := [x for x in sampled if x not in parts]:
        parts |= grams(dict.fromkeys(rest, 1))  # no n-gram is in enough documents: all count
    return Filters({x: parts[x] for x in common if x in parts})


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score; columns of docs with these names give way."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang_col.lower(), score_col.lower()) or c == text_col])
    held = docs.sparkSession.sparkContext.broadcast(filters)  # the languages' n-grams, of a bounded sample
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{lang_col}` string, `{score_col}` double").fields])
    at = docs.columns.index(text_col)

    def predict(batches):
        for batch in in_blocks(batches, text_col, BLOCK_BYTES):
            languages, scores = held.value.decide(utf8(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, filters: Filters, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """docs without those of no language, or of none with enough certainty."""
    lang, score = new_names(docs.columns, "lang_pred", "score")
    marked = identify(docs, filters, text_col, lang, score)
    return marked.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op7(spark, sf_dir):
    """Contract op7: the language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text"), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
