"""Personal data: plain patterns, and a skip-chain conditional random field that adds to them.

The patterns give the base spans: e-mail and IP addresses, card and phone numbers. The field
labels mentions: what the patterns found, other tokens that hold a digit (neighbouring numeric
ones together), and addresses that are spelled out. Neighbouring mentions share chain potentials;
equal or similar mentions anywhere in the document (the same last seven digits, the same four parts
of an IP address, the same address however its at and dots are written) share skip potentials, so
that a number found once is also found where it is written differently. Loopy sum-product message
passing runs over all documents of a block as one graph, until the messages settle. Repeated
mentions are linked in sequence, and each that isn't next to a mention which the patterns found is
also linked to the nearest such one before it, or else the first: an observed node, so that what
was found reaches the whole document in one step. The links stay in proportion to the mentions.

Trained piecewise on a bounded sample, about TRAIN_DOCS documents of at most TRAIN_CHARS with a
digit or an at sign, picked by the hash of id and text. The patterns' own labels would teach that
whatever they miss is nothing, so weak labels are added: each found span is written in forms that
the patterns don't take (other separators, no country code, spelled-out signs) into a copy of its
document, where the new mention has the found one's label. Unary weights are fitted by softmax
regression, chain and skip potentials by counts.

Defined results: a null or empty text has no spans. Base spans always stay; added spans never
overlap one, and only mentions with a link to others are added. Rows that share an id, have none or
are repeated are judged apart, by their text alone. Ties between labels go to the first, which is
none. Long texts are read whole, in linear time. An empty table gives no rows. personal_data() adds
two columns; columns of the table with their names give way.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_blocks, table, utf8

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
TRAIN_DOCS, TRAIN_CHARS = 2000, 20_000
MOST_ROUNDS, SETTLED, DAMPING, EVIDENCE, SURE = 60, 1e-3, 0.3, 8.0, 0.95
#: Bound of learned potentials, in natural log units.
STRONGEST = 6.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match always begins a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE = ".,;:!?{}<>\"'*%&$#|"
#: Characters of numeric tokens besides digits.
_NUMERIC = frozenset("0123456789+().-/_,[]")
#: An address with its signs spelled out, bracketed or set apart.
_AT, _DOT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s|\s?@\s?)", r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}}){_AT}([A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}})", re.IGNORECASE)
_HINT = re.compile(r"\b(?:at|dot)\b|\s@|@\s", re.IGNORECASE)
_SPELLED_DOT = re.compile(_DOT, re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches from each at sign: the run of name characters before it, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    if not _ANY.search(text):
        return []
    out = [(a, EMAIL, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def key_of(mention: str) -> str:
    """What equal and similar mentions share; empty if there is too little of it."""
    if "@" in mention:
        return mention.lower()
    parts = [x for x in _NOT_DIGIT.split(mention) if x]
    if len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts):
        return ".".join(str(int(p)) for p in parts)
    digits = "".join(parts)
    return digits[-7:] if len(digits) >= 7 and not any(c.isalpha() for c in mention) else ""


def _atoms(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, without the punctuation around them and apart from what is taken (in order)."""
    out, at, nth = [], 0, 0
    for m in _ANY.finditer(text):
        if m.start() < at:
            continue
        begin, end = m.start(), m.end()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        at = end
        while begin < end and text[begin] in _EDGE:
            begin += 1
        while end > begin and text[end - 1] in _EDGE:
            end -= 1
        while nth < len(taken) and taken[nth][1] <= begin:
            nth += 1
        if begin < end and not (nth < len(taken) and taken[nth][0] < end):
            out.append((begin, end))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label by the patterns, key) in order; labels are a kind plus one, or 0."""
    out, taken, known = [], [], {}
    for a, kind, b in base:
        if not taken or a >= taken[-1][1]:
            key = key_of(text[a:b])
            out.append((a, b, kind + 1, key))
            known[key] = max(known.get(key, 0), len(_NOT_DIGIT.sub("", text[a:b])))
        taken.append((a, max(b, taken[-1][1] if taken else 0)))
    if _HINT.search(text):
        for m in _SPELLED.finditer(text):
            a, b = m.span()
            if not any(s < b and a < e for s, e in taken):
                out.append((a, b, 0, (m[1] + "@" + _SPELLED_DOT.sub(".", m[2])).lower()))
        taken = sorted([*taken, *((a, b) for a, b, label, _ in out if not label)])
    run: list[tuple[int, int]] = []

    def close() -> None:
        """A run of neighbouring numeric tokens: what is like something known by itself, else the whole run."""
        last = len(run)
        while last:
            first, found = last - 1, None
            while first >= max(0, last - 5):
                piece = text[run[first][0] : run[last - 1][1]]
                key = key_of(piece)
                if key in known and len(_NOT_DIGIT.sub("", piece)) <= known[key]:
                    found = first  # the longest that is no longer than the known one
                first -= 1
            if found is None:
                break
            out.append((run[found][0], run[last - 1][1], 0, key_of(text[run[found][0] : run[last - 1][1]])))
            last = found
        if last:
            a, b = run[0][0], run[last - 1][1]
            out.append((a, b, 0, key_of(text[a:b])))
        run.clear()

    for a, b in _atoms(text, taken):
        numeric = _NUMERIC.issuperset(text[a:b])
        if run and not (numeric and a - run[-1][1] == 1 and text[run[-1][1]] == " " and len(run) < 8):
            close()
        if numeric:
            run.append((a, b))
        else:
            out.append((a, b, 0, key_of(text[a:b])))
    close()
    return sorted(out)


FEATURES = 22


def features(mention: str, before: str) -> list[int]:
    """Positions of the features that hold. before: the mention just before, if it is near."""
    digits = _NOT_DIGIT.sub("", mention)
    n, key, letters = len(digits), key_of(mention), any(c.isalpha() for c in mention)
    out = [0, 1 + (n > 0) + (n > 4) + (n > 6) + (n > 9) + (n > 11) + (n > 13) + (n > 19)]
    holds = ("@" in mention, bool(_SPELLED.fullmatch(mention)), mention.startswith("+"), "." in key and "@" not in key, "-" in mention, "(" in mention, "/" in mention or "_" in mention, "." in mention, " " in mention, letters and n > 0, n == len(mention), 14 <= n <= 19 and luhn(digits), bool(before))
    return out + [9 + i for i, x in enumerate(holds) if x]


class Field:
    """Weights (features, labels), chain and skip potentials (labels, labels); label 0 is none."""

    def __init__(self, weights, chain, skip):
        self.weights, self.chain, self.skip = weights, chain, skip

    @staticmethod
    def graph(texts: list[str], base: list[list[tuple[int, int, int]]]):
        """Nodes (text, start, end), their features and labels by the patterns; chain and skip edges; found mentions' edges (node, label)."""
        node, feats, label, chain, skip, far = [], [], [], [], [], []
        for i, (text, spans) in enumerate(zip(texts, base)):
            last, seen = None, {}  # seen: key -> its mentions
            for a, b, found, key in mentions(text, spans) if spans or _ANY.search(text) else ():
                here, near = len(node), last is not None and a - node[last][2] <= 2
                node.append((i, a, b))
                feats.append(features(text[a:b], text[node[last][1] : node[last][2]] if near else ""))
                label.append(found)
                if near:
                    chain.append((last, here))
                if key:
                    if key in seen:
                        skip.append((seen[key][-1], here))
                    seen.setdefault(key, []).append(here)
                last = here
            for same in seen.values():
                found = next((label[m] for m in same if label[m]), 0)
                for before_it, m, after_it in zip([None, *same], same, [*same[1:], None]) if found else ():
                    if label[m]:
                        found = label[m]
                    elif not any(x is not None and label[x] for x in (before_it, after_it)):
                        far.append((m, found))
        x = np.zeros((len(node), FEATURES))
        for i, f in enumerate(feats):
            x[i, f] = 1
        return node, x, np.asarray(label, np.int64), np.asarray(chain, np.int64).reshape(-1, 2), np.asarray(skip, np.int64).reshape(-1, 2), np.asarray(far, np.int64).reshape(-1, 2)

    @classmethod
    def train(cls, texts: list[str], steps: int = 300) -> Field:
        texts, more = list(texts), []
        for i, text in enumerate(texts):
            texts[i], written = with_other_forms(text)
            more.append(written)
        node, x, y, chain, skip, _ = cls.graph(texts, [base_spans(t) for t in texts])
        for at, (i, a, b) in enumerate(node):
            y[at] = y[at] or next((kind + 1 for s, kind, e in more[i] if s < b and a < e), 0)
        n = len(KINDS) + 1
        weights, goal = np.zeros((FEATURES, n)), np.eye(n)[y] if len(y) else np.zeros((0, n))
        for _ in range(steps if len(y) else 0):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights -= 1.0 * (x.T @ (p - goal) / len(y) + 1e-3 * weights)

        def potential(edges):
            counts = np.full((n, n), 0.5)
            np.add.at(counts, (y[edges[:, 0]], y[edges[:, 1]]), 1)
            counts = counts + counts.T
            share = counts.sum(axis=1) / counts.sum()
            return np.clip(np.log(counts / counts.sum() / np.outer(share, share)), -STRONGEST, STRONGEST)

        return cls(weights, potential(chain), potential(skip))

    def marginals(self, x, y, chain, skip, far) -> np.ndarray:
        """Loopy sum-product over all nodes; what the patterns found is evidence."""
        unary = x @ self.weights
        unary[np.arange(len(y)), y] += EVIDENCE * (y > 0)
        unary[far[:, 0]] += self.skip[far[:, 1]]  # a node has one such edge at most
        pairs = np.concatenate([chain, skip])
        if len(pairs):
            potential = np.concatenate([np.broadcast_to(self.chain, (len(chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(skip), *self.skip.shape))])
            source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
            potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(source)), len(pairs))
            message = np.zeros((len(source), unary.shape[1]))
            for _ in range(MOST_ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                z = (belief[source] - message[back])[:, :, None] + potential
                top = z.max(axis=1, keepdims=True)
                new = top[:, 0] + np.log(np.exp(z - top).sum(axis=1))
                new = DAMPING * message + (1 - DAMPING) * (new - new.max(axis=1, keepdims=True))
                moved, message = np.abs(new - message).max(), new
                if moved < SETTLED:
                    break
            unary = unary.copy()
            np.add.at(unary, target, message)
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text that the field adds to its base spans."""
        node, x, y, chain, skip, far = self.graph(texts, base)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(skip):
            return out
        p = self.marginals(x, y, chain, skip, far)
        best = p.argmax(axis=1)
        linked = np.zeros(len(node), bool)
        linked[skip.ravel()] = True  # a mention that nothing else supports is left to the patterns
        for at in np.flatnonzero((best > 0) & (p.max(axis=1) >= SURE) & (y == 0) & linked).tolist():
            i, a, b = node[at]
            if not any(s < b and a < e for s, _, e in base[i]):
                out[i].append((a, int(best[at]) - 1, b))
        return out


def other_form(found: str, kind: int, r: random.Random) -> str:
    """The same address or number as people also write it."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == EMAIL:
        name, domain = found.rsplit("@", 1)
        at, dot = r.choice([(" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), (" @ ", "."), ("[at]", " dot ")])
        return name + at + domain.replace(".", dot)
    if kind == IP:
        return r.choice(["-", ",", "[.]", "_", " "]).join(found.split("."))
    if kind == CARD:
        return r.choice([".", "/", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    a, b, c = local[:-7], local[-7:-4], local[-4:]
    return r.choice([digits, local, f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}/{b}-{c}", f"{digits[:-10]}-{a}-{b}-{c}".lstrip("-"), f"{a} {b} {c}", f"{b}-{c}"])


def with_other_forms(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some of its found spans written once more in another form; where those are."""
    base = base_spans(text)
    r = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    written = []
    for a, kind, b in r.sample(base, min(3, len(base))):
        form = other_form(text[a:b], kind, r)
        if not base_spans(form):
            text += " and "
            written.append((len(text), kind, len(text) + len(form)))
            text += form + " then"
    return text, written


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from a bounded sample: rows whose hash is below the share that is asked for."""
    some = docs.filter(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= TRAIN_CHARS)).select(F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("pick"))
    share = TRAIN_DOCS / max(1, some.count())
    sample = some.filter((F.col("pick").cast("double") / 2.0**63 + 1) / 2 < share).select("text").distinct()
    return Field.train(sorted(r[0] for r in sample.collect()))


ADDED = ("base_spans", "all_spans")


def personal_data(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with base_spans and all_spans, arrays of (kind, start, end) in code points, end exclusive."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in ADDED])
    held = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("base_spans array<struct<kind:string,a:bigint,b:bigint>>, all_spans array<struct<kind:string,a:bigint,b:bigint>>").fields])
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())]))

    def find(batches):
        told = lambda spans: [{"kind": KINDS[k], "a": a, "b": b} for a, k, b in spans]
        for batch in in_blocks(batches, text_col, 2_000_000):
            texts = [x.decode("utf-8", "replace") for x in utf8(batch.column(at))]
            base = [base_spans(t) for t in texts]
            more = held.value.added(texts, base)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([told(x) for x in base], span), pa.array([told(sorted(x + y)) for x, y in zip(base, more)], span)], names=schema.names)

    return docs.mapInArrow(find, schema)


def op1(spark, sf_dir):
    """Contract op1: base spans' counts and digest, and all spans, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, learn(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
