"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton reads a document word by word and holds the longest match that ends at each
word. Where it reaches a window's length (10 words, or a whole shorter item), the words of the
window are hit. Items go to the workers in blocks of a bounded number of words, a block at a
time: the driver holds one, and with more than one the documents are stored between two. An item
longer than a block is cut into pieces that overlap by a window less a word, so every window of
it lies in one piece.

Words are runs of digits, letters and characters beyond ASCII, after lower-casing A-Z.
Defined results: a null or empty text has no words and no hits, and stays as it is. An item
without words has no window. Repeated rows and rows that share an id, or have none, are judged
apart; items that share an id count once, and a null item id is the empty string. An empty table
gives no rows, an empty benchmark no hits. benchmark_hits() adds columns; columns of the documents
with their names give way. remove_benchmark() keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_blocks, kept, new_names, stored, table, utf8

WINDOW = 10
#: Words of items in one automaton: the bound of what is broadcast.
BLOCK_WORDS = 200_000
#: Share of a document's words above which all of it goes.
MOST_COVERED = 0.8
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
NORMAL = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))
_WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton over words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.next, self.link, self.long, self.items = [{}], [-1], [0], [set()]
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.window = window
        for name, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.items[last].add(name)
        for state in sorted(range(1, len(self.long)), key=self.long.__getitem__, reverse=True):
            self.items[self.link[state]] |= self.items[state]
        for name, words in items:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(words), name))
        self._found: dict[int, tuple[int, frozenset]] = {}

    def _state(self, long: int, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.long.append(long)
        self.items.append(set())
        return len(self.long) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the part of q that p and w reach: q itself, or a clone of it."""
        if self.long[q] == self.long[p] + 1:
            return q
        clone = self._state(self.long[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, w, q)
        new, p = self._state(self.long[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, w, self.next[p][w])
        return new

    def _windows(self, state: int) -> tuple[int, frozenset, list]:
        """For matches that end in state: items whose full window ends there, and short items that may."""
        if (found := self._found.get(state)) is None:
            short, s = [], state
            while s > 0:
                short += self.short.get(s, ())
                s = self.link[s]
            s = state
            while self.long[self.link[s]] >= self.window:
                s = self.link[s]
            found = self._found[state] = (frozenset(self.items[s]) if self.long[s] >= self.window else frozenset(), short)
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (start, end) that windows cover, apart and in order; the items they are of."""
        state, n, window, next_, link, long = 0, 0, self.window, self.next, self.link, self.long
        spans, items, root, least = [], set(), next_[0], min([self.window, *(k for x in self.short.values() for k, _ in x)])
        for at, w in enumerate(words):
            step = next_[state].get(w)
            if step is None:
                if w not in root:
                    state = n = 0
                    continue
                while (step := next_[state].get(w)) is None:
                    state = link[state]
                n = long[state]
            state, n = step, n + 1
            if n < least:
                continue
            full, short = self._windows(state)
            reach = 0
            if n >= window:
                items |= full
                reach = window
            for k, name in short:
                if n >= k:
                    items.add(name)
                    reach = max(reach, k)
            if reach:
                begin = at + 1 - reach
                while spans and begin <= spans[-1][1]:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        return spans, items


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of a bounded number of words, fetched a partition at a time."""
    block, size, most = [], 0, max(block_words, window)
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = normal_words((r["t"] or "").encode())
        pieces = [words] if len(words) <= most else [words[s : s + most] for s in range(0, len(words) - window + 1, most - window + 1)]
        for piece in pieces if words else ():
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((r["i"] or "", piece))
            size += len(piece)
    if block:
        yield block


FOUND = ("n_words", "hit_spans", "hit_items")


def _read(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, window: int, block_words: int, names: tuple[str, ...], last: Callable, last_schema: StructType) -> DataFrame:
    """docs read by the automaton of each block of items. last(batch of docs, words, spans, items) makes the rows of the result, of last_schema."""
    spark = docs.sparkSession
    own, at = len(docs.columns), docs.columns.index(text_col)
    between = StructType([*docs.schema.fields, *StructType.fromDDL("`{}` long, `{}` array<struct<a:bigint,b:bigint>>, `{}` array<string>".format(*names)).fields])
    types = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())]

    def told(own_columns: list, words: list, spans: list, items: list) -> pa.RecordBatch:
        more = (words, [[{"a": x, "b": y} for x, y in s] for s in spans], [sorted(x) for x in items])
        return pa.RecordBatch.from_arrays([*own_columns, *(pa.array(x, t) for x, t in zip(more, types))], names=between.names)

    def scanned(found: DataFrame, block: list, first: bool, final: bool) -> tuple[DataFrame, object]:
        held, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex  # at most block_words words

        def scan(batches):
            automaton = kept(("automaton", key), lambda: Automaton(held.value, window))
            for batch in in_blocks(batches, text_col):
                texts = [normal_words(x) for x in utf8(batch.column(at))]
                results = [automaton.scan(x) for x in texts]
                if not first:
                    before = zip(batch.column(own + 1).to_pylist(), batch.column(own + 2).to_pylist())
                    results = [(merged([*a, *((x["a"], x["b"]) for x in s)]), b | set(i)) for (a, b), (s, i) in zip(results, before)]
                columns = [batch.column(j) for j in range(own)]
                yield (last if final else told)(columns, list(map(len, texts)), [a for a, _ in results], [b for _, b in results])

        return found.mapInArrow(scan, last_schema if final else between), held

    blocks = item_blocks(benchmark, item_id, item_text, block_words, window)
    block, first, found = next(blocks, []), True, docs
    while True:
        following = next(blocks, None)
        found, held = scanned(found, block, first, following is None)
        if following is None:
            return found
        found = stored(found, "benchmark-hits")
        held.destroy()
        block, first = following, False


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (word positions, end exclusive) and hit_items, a list of item ids."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in FOUND])
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_words long, hit_spans array<struct<a:bigint,b:bigint>>, hit_items array<string>").fields])
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def last(columns: list, words: list, spans: list, items: list) -> pa.RecordBatch:
        told = [[{"a": x, "b": y} for x, y in s] for s in spans]
        return pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(told, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=schema.names)

    return _read(docs, benchmark, text_col, item_id, item_text, window, block_words, FOUND, last, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these words and what lies between those of a span."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw.translate(NORMAL))]
    parts, last = [], 0
    for a, b in spans:
        parts.append(raw[last : words[a][0]])
        last = words[b - 1][1]
    return b"".join([*parts, raw[last:]]).decode()


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", most_covered: float = MOST_COVERED, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the words that windows cover. A document of which more than most_covered is hit goes whole.

    chars_col, if docs has it, follows the text of the documents that are cut.
    """
    (cut,) = new_names(docs.columns, "cut")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"`{cut}` boolean").fields])
    at = docs.columns.index(text_col)

    def last(columns: list, words: list, spans: list, items: list) -> pa.RecordBatch:
        stays = [sum(b - a for a, b in s) <= n * most_covered for n, s in zip(words, spans)]
        changed = [without(t, s) if s and k else t for t, s, k in zip(columns[at].to_pylist(), spans, stays)]
        columns[at] = pa.array(changed, columns[at].type)
        return pa.RecordBatch.from_arrays([*columns, pa.array([bool(s) for s in spans])], names=schema.names).filter(pa.array(stays, pa.bool_()))

    out = _read(docs, benchmark, text_col, "item_id", "text", window, block_words, tuple(new_names(docs.columns, *FOUND)), last, schema)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col(cut), F.length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)


def op3(spark, sf_dir):
    """Contract op3: hits of every document against every item."""
    hits = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    items = F.array_sort("hit_items")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks)),
hit AS (SELECT doc_id, item_id, dw.k, s FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.list, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
