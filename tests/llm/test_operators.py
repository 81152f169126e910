"""Operators against brute force on a small table with nulls, empty, repeated, long and odd texts."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import components, decontamination, exact_dedup, language_id, ngram_join, packing, pii, substring_dedup, token_counts, token_files, tokenization, warc
from wayfarer.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i}" for i in range(400)] + ["über", "Été", "don't", "x.y", "Z"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kind int"


def make_texts() -> list:
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    passage, base = text(60), text(120).split()
    out = [None, "", " \n\t ", "A", "a", "hello  world\n", "<|endoftext|> a<|endoftext|>", "日本語 text ½ é́", text(4000), "one two three", "one TWO three"]
    out += [text(30) + " " + passage + " " + text(20) for _ in range(6)]
    for _ in range(25):  # near copies
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(50))
        out.append(" ".join(w))
    out += [out[20]] * 3 + [out[21].upper()] + [text(r.randint(1, 90)) for _ in range(40)]
    out += ["mail me: a.b@c-d.org, +1 (743) 555-3824 and 10.0.0.1 or 4111 1111 1111 1111", "call (743) 555-3824 or 999.1.2.3; x@y.zz%k@w.v 10.0.0.300", "a@b a@b.c@d.e +12 1-2-3"]
    return out


TEXTS = make_texts()
IDS = [1000 - 7 * i if i % 3 else 7 * i for i in range(len(TEXTS))]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(set(IDS)) == len(IDS)
    return spark.createDataFrame([(i, t, "en" if n % 2 else None, None, 0, "clash", n) for n, (i, t) in enumerate(zip(IDS, TEXTS))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact(docs, empty):
    groups: dict[str, list[int]] = {}
    for i, t in zip(IDS, TEXTS):
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup.exact_duplicates(docs, digest_all=True).collect()} == want
    kept = exact_dedup.drop_exact_duplicates(docs.unionByName(docs.filter("doc_id = 0")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_passages(docs, empty):
    seen, want = set(), {}
    for i, t in sorted(zip(IDS, TEXTS)):
        w, gone = words(t), set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeated_passages(docs).collect()} == want
    assert sum(x[1] for x in want.values()) > 300 and substring_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("k", "percent", "least"), [(4, 85, 32), (5, 80, 2)])
def test_jaccard(docs, empty, monkeypatch, k, percent, least):
    monkeypatch.setattr(ngram_join, "LEAST_COUNT", least)
    monkeypatch.setattr(components, "ONE_TASK", 0 if least == 2 else components.ONE_TASK)
    if least == 2:  # large entries are cut into blocks
        for name, x in {"FEW": 2, "RUN": 3, "TILE": 4, "MOST_GROUPS": 3}.items():
            monkeypatch.setattr(ngram_join, name, x)
    sets = {}
    for i, t in zip(IDS, TEXTS):
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in IDS}
    for a in IDS:
        for b in IDS:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if g == y else g for i, g in root.items()}
    want = {i: (len(sets[i]), root[i]) for i in IDS}
    assert {r.doc_id: tuple(r)[1:] for r in ngram_join.similar_components(docs, k=k, percent=percent).collect()} == want
    if least == 32:
        assert ngram_join.similar_components(empty).count() == 0


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 5)
    sizes = [1 + i % 40 for i in range(90)]
    sizes = {1: sizes, 2: [7] * 23, 3: [4, 9, 4]}
    entries = spark.createDataFrame([(e, e * 1000 + i, n, i, len(x)) for e, x in sizes.items() for i, n in enumerate(x)], "id long, cls long, n long, root long, size long")
    tiles = {}
    for r in ngram_join.tiled(entries, 85).collect():
        tiles.setdefault((r.id, r.tile), []).append((r.root, r.side))
    met = {}
    for (entry, _), members in tiles.items():
        assert len(members) <= 4 * 5  # two blocks, as evenly filled as a hash does it
        for x, side in members:
            for y, other in members:
                if x < y and (side == 2 or side != other):
                    met[entry, x, y] = met.get((entry, x, y), 0) + 1
    want = {(e, i, j) for e, x in sizes.items() for i in range(len(x)) for j in range(i + 1, len(x)) if 100 * min(x[i], x[j]) >= 85 * max(x[i], x[j])}
    assert want <= set(met) and set(met.values()) == {1}


def test_large_entries(spark, monkeypatch):
    for name, x in {"LEAST_COUNT": 2, "FEW": 2, "RUN": 7, "TILE": 6}.items():
        monkeypatch.setattr(ngram_join, name, x)
    r = random.Random(8)
    template, groups, texts = [f"t{i}" for i in range(70)], 20, []
    for g in range(groups):  # all share most of their words, and few link
        own = [f"g{g}x{i}" for i in range(25 + g % 3)]
        for _ in range(4):
            w = template + own
            w[r.randrange(len(w))] = f"e{r.random()}"
            texts.append(" ".join(w[: len(w) - r.randrange(3)]))
    r.shuffle(texts)
    sets = [{tuple(t.split()[a : a + 4]) for a in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if g == y else g for g in root]
    assert 10 < len(set(root)) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in ngram_join.similar_components(docs).collect()} == dict(enumerate(root))


def test_benchmark(spark, docs, empty):
    long = TEXTS[8].split()
    items = [(1, " ".join(long[100:130])), (2, TEXTS[12].upper()), (3, "one two THREE"), (4, None), (5, "..."), (12, "hello world")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = {}
    for i, t in zip(IDS, TEXTS):
        w, hit, found = norm(t), set(), set()
        for name, item in items:
            q = norm(item)
            n = min(10, len(q))
            windows = {tuple(q[s : s + n]) for s in range(len(q) - n + 1)} if q else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.add(str(name))
        want[i] = (len(w), len(hit), sorted(found))
    plain = docs.withColumns({"Hit_Spans": F.lit(1), "cut": F.lit("c")})  # n_words is there too
    for block_words in (10_000, 20):  # one automaton, and several
        got = {r.doc_id: (r.n_words, sum(s.b - s.a for s in r.hit_spans), sorted(r.hit_items)) for r in decontamination.benchmark_hits(plain, bench, block_words=block_words).collect()}
        assert got == want
    clean = decontamination.remove_benchmark(plain, bench)
    assert clean.columns == plain.columns and {x.n_words for x in clean.collect()} == {"clash"} and all(not x.hit_spans for x in decontamination.benchmark_hits(clean, bench).collect() if len(norm(x.text)) > 200)
    assert decontamination.benchmark_hits(empty, bench).count() == 0 and decontamination.benchmark_hits(plain, bench.limit(0)).filter("size(hit_spans) > 0").count() == 0


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenization.vocabulary_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_counts(docs, empty):
    encode = library(tokenization.BYTE_BPE)
    want = {i: (len((t or "").encode()), len(encode(t))) for i, t in zip(IDS, TEXTS)}
    for frequent in (200_000, 20):
        assert {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(docs, most_frequent=frequent).collect()} == want
    assert token_counts.token_counts(empty).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    encode, start, want = library(tokenization.BYTE_BPE), 0, {}
    for i, t in sorted(zip(IDS, TEXTS)):
        ids = [*encode(t), 2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    token_files.write_tokens(docs, str(tmp_path / "a"), shards=5)
    assert {r.doc_id: tuple(r)[1:] for r in token_files.read_tokens(spark, str(tmp_path / "a")).collect()} == want
    token_files.write_tokens(empty, str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_blocks(n):
    r = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**32):
        ids = np.where(r.random(n) < 0.05, r.integers(0, top, n), r.integers(0, min(top, 300), n)).astype("<u4")
        raw, blocks = token_files.encode_blocks(ids)
        assert (token_files.decode_blocks(memoryview(raw), blocks, n) == ids).all()


def test_packing(docs, empty):
    encode = library(tokenization.WORD_BPE)
    got = packing.pack(docs, window=256).collect()
    spans: dict[int, list] = {}
    for r in got:
        ids = [*encode(dict(zip(IDS, TEXTS))[r.doc_id]), 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(spans) == set(IDS)
    for i, x in spans.items():
        ends = np.cumsum([n for _, n in sorted(x)]).tolist()
        assert [s for s, _ in sorted(x)] == [0, *ends[:-1]]
    rows: dict[int, list] = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in rows.values():
        ends = np.cumsum([n for _, n in sorted(x)]).tolist()
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 256
    # one by one, the same number of windows
    room: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        fits = [c for c in room if c >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 256) - n)
    assert len(rows) == len(room) and packing.pack(empty).count() == 0


def test_personal_data(docs, empty):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda x: re.sub("[^0-9]", "", x)
    fine = [lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 14 <= len(digits(x)) <= 19 and pii.luhn(digits(x)), lambda x: 10 <= len(digits(x)) <= 15]
    field, seen = pii.learn(docs), Counter()
    found = pii.personal_data(docs.withColumn("base_spans", F.lit(1)), field).collect()
    for r in found:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, r.text or "") if fine[k](m[0]))
        assert [(s.a, pii.KINDS.index(s.kind), s.b) for s in r.base_spans] == want
        assert all(s in r.all_spans for s in r.base_spans)
        seen.update(pii.KINDS[k] for _, k, _ in want)
    assert set(seen) == set(pii.KINDS) and pii.personal_data(empty, field).count() == 0


def test_a_number_written_otherwise_is_found():
    weights = np.zeros((pii.FEATURES, 5))
    weights[0, 0] = 1.0
    agree = np.full((5, 5), -3.0) + 6.0 * np.eye(5)
    text = "ring +17435553824 today . later 743-555-3824 or 17435553824 perhaps"
    base = [pii.base_spans(text)]
    assert [text[a:b] for a, _, b in pii.Field(weights, agree, agree).added([text], base)[0]] == ["743-555-3824", "17435553824"]


def test_messages_against_exact_inference():
    """On graphs without loops the beliefs are the exact marginals; on a loop the best labels agree."""
    r = np.random.default_rng(4)
    for edges, far, loop in (([(0, 1), (1, 2), (1, 3), (3, 4)], [], False), ([(0, 1), (2, 3)], [(4, 2)], False), ([(0, 1), (1, 2), (2, 0), (3, 4)], [], True)):
        sym = lambda a: a + a.T
        field = pii.Field(r.normal(size=(pii.FEATURES, 5)), sym(r.normal(size=(5, 5)) * 0.5), sym(r.normal(size=(5, 5)) * 0.5))
        x, y = (r.random((5, pii.FEATURES)) < 0.2).astype(float), np.array([0, 0, 3, 0, 0])
        chain, skip = np.array(edges[:1]), np.array(edges[1:])
        score = x @ field.weights
        score[2, 3] += pii.EVIDENCE
        for node, label in far:
            score[node] += field.skip[label]
        exact = np.zeros((5, 5))
        for labels in itertools.product(range(5), repeat=5):
            total = sum(score[i, v] for i, v in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in chain) + sum(field.skip[labels[a], labels[b]] for a, b in skip)
            for i, v in enumerate(labels):
                exact[i, v] += np.exp(total)
        exact /= exact.sum(axis=1, keepdims=True)
        got = field.marginals(x, y, chain, skip, np.array(far, np.int64).reshape(-1, 2))
        assert (got.argmax(axis=1) == exact.argmax(axis=1)).all() if loop else np.abs(got - exact).max() < 0.01


def planted(r, kind: int) -> str:
    if kind == pii.EMAIL:
        return f"{r.choice(['ann', 'joe.b', 'm_k'])}{r.randrange(1000)}@{r.choice(['x-y', 'mail'])}{r.randrange(99)}.{r.choice(['org', 'co.uk'])}"
    if kind == pii.IP:
        return ".".join(str(r.randrange(256)) for _ in range(4))
    if kind == pii.PHONE:
        return f"+{r.randrange(1, 99)} ({r.randrange(100, 1000)}) {r.randrange(100, 1000)}-{r.randrange(1000, 10000)}"
    while not pii.luhn(d := "".join(r.choice("0123456789") for _ in range(16))):
        pass
    return " ".join(d[i : i + 4] for i in range(0, 16, 4))


def test_other_forms_of_what_was_found(spark):
    """Planted mentions that the patterns miss, beside numbers that are nothing: recall and precision of the added spans."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    field, r = pii.learn(docs), random.Random(3)
    clean = [x.text for x in docs.filter("not text rlike '[0-9@]' and length(text) between 300 and 5000").select("text").collect()]
    found, wanted, added = 0, 0, 0
    for n in range(800):
        kind, w = n % 4, r.choice(clean).split(" ")
        value = planted(r, kind)
        form = pii.other_form(value, kind, r)
        if pii.base_spans(form):
            continue
        w.insert(r.randrange(len(w)), value)
        w.insert(r.randrange(len(w)), form)
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["12:30", "2024-01-05", "9807915762804490", "555 1234", "3.14", "4.0.", "v1.2.3", "(1)", "1234567", "$1,234,567.00"]))
        text = " ".join(w)
        more = field.added([text], [pii.base_spans(text)])[0]
        wanted, added = wanted + 1, added + len(more)
        found += any((text[a:b] in form or form in text[a:b]) and k == kind for a, k, b in more)
    assert wanted > 600 and found >= 0.9 * wanted and added <= 1.05 * found, (wanted, found, added)


def test_long_and_repetitive_texts_take_linear_time():
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), np.zeros((5, 5)))
    for part in ("1", "1.", "a@", "+1((((", "1 ", "a", "1.2.3 ", " at ", "a dot ", "user7x@mail7.org "):
        text = part * (200_000 // len(part)) + " 1@"
        began = time.time()
        field.added([text], [pii.base_spans(text)])
        assert time.time() - began < 10, part


@pytest.mark.parametrize("found_at", [0, 20, 39])
def test_a_number_found_once_reaches_its_furthest_mention(found_at):
    weights = np.zeros((pii.FEATURES, 5))
    weights[0, 0] = 2.0  # without support a token is none
    agree = np.full((5, 5), -2.0) + 4 * np.eye(5)
    text = " and then again ".join("+1-743-555-3824" if i == found_at else "17435553824" for i in range(40))
    base = [pii.base_spans(text)]
    assert len(base[0]) == 1
    added = pii.Field(weights, agree, agree).added([text], base)[0]
    assert [(text[a:b], k) for a, k, b in added] == [("17435553824", 3)] * 39


def test_language(spark, empty):
    r, rows = random.Random(1), []
    for i in range(300):
        syllables = {"aa": ["ba", "lo", "ke"], "bb": ["stru", "icht", "ung"]}[lang := "aa" if i % 3 else "bb"]
        rows.append((i, " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(40)), lang, None, 0, "", 0))
    rows += [(900, None, "aa", None, 0, "", 0), (901, "12 34 !", None, None, 0, "", 0), (902, "", None, None, 0, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    filters = language_id.learn(docs)
    got = language_id.identify(docs, filters).collect()
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 for x in got if x.doc_id < 900) and all(x.lang_pred == "und" for x in got if x.doc_id >= 900)
    kept = language_id.keep_identified(docs, filters)
    assert kept.columns == docs.columns and kept.count() == 300
    assert language_id.learn(empty).decide([b"abc"]) == (["und"], [0.0]) and language_id.identify(empty, filters).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    told = [lang[r.doc_id] == r.lang_pred for r in language_id.op7(spark, sf).collect() if r.held_out and lang[r.doc_id]]
    assert len(told) > 150 and sum(told) >= 0.98 * len(told)


def test_languages_with_few_rows_and_more_than_64_languages(spark):
    r, rows = random.Random(2), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(r.choice(letters) for _ in range(5)) for _ in range(12)] for i in range(70)}
    ids = iter(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5)
    for lang, own in words.items():  # the last has one row, the one before it two, then 5, 15 and 25
        for _ in range({"l69": 1, "l68": 2, "l67": 5, "l66": 15, "l65": 25}.get(lang, 4)):
            rows.append((next(ids), " ".join(r.choice(own) for _ in range(60)), lang, None, 0, "", 0))
    rows.append((next(ids), "12 34 !", "no letters", None, 0, "", 0))
    filters = language_id.learn(spark.createDataFrame(rows, SCHEMA))
    assert sorted(filters.languages) == sorted(words) and [len(m.languages) for m in filters.masks] == [64, 6]
    got, scores = filters.decide([" ".join(own).encode() for own in words.values()])
    assert got == list(words) and min(scores) > 0.3
    assert [language_id.least_docs(n) for n in (1, 9, 10, 20, 50, 1500)] == [1, 1, 2, 3, 3, 7]


def test_letters_of_all_planes():
    adlam, gothic, marks = "\U0001e900\U0001e901\U0001e902 \U0001e903\U0001e904", "\U00010330\U00010331\U00010332", "\U000e0041\U000f0000 \U0001f600"
    texts = [x.encode() for x in (adlam, gothic, marks, "\U00020000")]
    assert language_id.n_grams(texts)[2].tolist() == [True, True, False, True]
    filters = language_id.Filters({"ff": language_id.n_grams(texts[:1])[0], "got": language_id.n_grams(texts[1:2])[0]})
    assert filters.decide(texts[:3])[0] == ["ff", "got", "und"]


def test_archives(spark, tmp_path):
    big = "x" * 50_000 + "é\r\n0\r\n\r\n"
    pages = [(5, "http://a/ b", "hi"), (3, None, "hi"), (9, "u", None), (2, "u", ""), (7, "u", big), (8, "u", big), (1, "u", "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for least in (0, 3):
        warc.write_archives(df, str(tmp_path / f"a{least}"), least_revisit=least, segment_bytes=1000)
        first: dict[bytes, int] = {}
        want = {}
        for page, _, html in sorted(pages):
            data = (html or "").encode()
            origin = first.setdefault(data, page) if len(data) >= least else page
            want[page] = (len(data), warc.digest_of(data), "response" if origin == page else "revisit", None if origin == page else origin)
        assert {r.page_id: tuple(r)[1:] for r in warc.read_archives(spark, str(tmp_path / f"a{least}")).collect()} == want
    with pytest.raises(ValueError, match="another length"):
        list(warc.parse(warc.record(b"response", "x", b"abc") + b"x"))
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"")) == b"" and warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_archives_of_repeated_rows(spark, tmp_path):
    """Below and above the segment size, alone and after an earlier page."""
    big = "x" * 50_000
    twice = [(5, "u", "hi"), (5, "v", "hi"), (7, "u", big), (7, "u", big), (7, "u", big), (8, "u", big), (8, "u", big), (7, "u", "hi"), (9, "u", "x" * 3000), (9, "u", "y" * 3000), (10, "u", "z")]
    for least in (0, 10**6):
        warc.write_archives(spark.createDataFrame(twice, "page_id long, url string, html string").repartition(3), str(tmp_path / f"twice{least}"), least_revisit=least, segment_bytes=1000)
        origin = lambda page, html: min(p for p, _, h in twice if h == html) if not least else page  # noqa: B023, E731
        want = Counter((p, len(h.encode()), warc.digest_of(h.encode()), "response" if origin(p, h) == p else "revisit", None if origin(p, h) == p else origin(p, h)) for p, _, h in twice)
        assert Counter(map(tuple, warc.read_archives(spark, str(tmp_path / f"twice{least}")).collect())) == want
        packed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / f"twice{least}")).collect()
        fields = [f for x in packed for f, _ in warc.parse(warc.unpacked(x.content))]
        names = [f[b"warc-record-id"] for f in fields]
        assert len(set(names)) == len(names) and {f[b"warc-refers-to"] for f in fields if b"warc-refers-to" in f} <= set(names)


def test_archives_of_others(spark, tmp_path):
    """A member for each record, records without a page, loose header fields, segments in any order over files; and plain files."""

    def made(kind: str, name: str, block: bytes, *more: str) -> bytes:
        return "\r\n".join(["WARC/1.0", f"WARC-Type:{kind}", f"warc-record-id:   <urn:uuid:{name}>", "WARC-Date: 2020-02-02T02:02:02Z", *more, f"content-length:{len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    payload = "ünü".encode() * 4000
    http = b"HTTP/1.1 200 OK\r\nX: chunked\r\ntransfer-encoding:  CHUNKED\r\n\r\n" + warc.chunked(payload, 700)
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; x=chunked\r\n\r\nplain body"
    parts = [http[i : i + 5000] for i in range(0, len(http), 5000)]
    segments = [made("response" if not i else "continuation", f"s{i}", p, f"WARC-Segment-Number: {i + 1}", *(["X-Page: 7", f"WARC-Payload-Digest: sha1:{warc.digest_of(payload)}"] if not i else ["WARC-Segment-Origin-ID: <urn:uuid:s0>"]), *([f"WARC-Segment-Total-Length: {len(http)}"] if i == len(parts) - 1 else [])) for i, p in enumerate(parts)]
    others = [made("warcinfo", "w", b"software: x\r\n"), made("request", "q", b"GET / HTTP/1.1\r\n\r\n"), made("response", "r", plain, "X-Page: 3", "WARC-Target-URI: http://a/", " continued"), made("response", "n", plain), made("metadata", "m", b"")]
    folder = tmp_path / "others"
    folder.mkdir()
    member = lambda x: gzip.compress(x)
    (folder / "part-0.gz").write_bytes(b"".join(map(member, [*others[:3], *segments[::-1][:2]])))
    (folder / "part-1.gz").write_bytes(b"\r\n".join(map(member, [*segments[::-1][2:], *others[4:]])))
    (folder / "part-2").write_bytes(others[3])
    (folder / "part-3").write_bytes(b"")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(folder)).collect()}
    body = warc.digest_of(b"plain body")
    assert got == {(7, len(payload), warc.digest_of(payload), "response", None), (3, 10, body, "response", None), (None, 10, body, "response", None)}
    (folder / "part-1.gz").write_bytes(member(segments[0])[:-30])
    with pytest.raises(Exception, match="within a gzip member"):
        warc.read_archives(spark, str(folder)).collect()


def test_files_stay_bounded(spark, tmp_path, monkeypatch):
    """More records and segments than one file may hold."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 2)
    monkeypatch.setattr(token_files, "SEGMENT_BYTES", 300)
    pages = spark.range(100).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 50) as html").coalesce(2)
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=60)
    files = lambda x: list((tmp_path / x).glob("part-*"))
    assert len(files("w")) > 20 and max(sum(1 for _ in warc.parse(warc.unpacked(f.read_bytes()))) for f in files("w")) <= 7
    assert {(r.page_id, r.payload_bytes) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {(i, 50 * len(str(i))) for i in range(100)}
    docs = spark.range(200).selectExpr("cast(200 - id as long) as doc_id", "concat('text ', repeat('ab ', 20), id) as text")
    token_files.write_tokens(docs, str(tmp_path / "t"), shards=2)
    assert len(files("t")) > 10 and max(sum(1 for _ in token_files.segments(f.read_bytes())) for f in files("t")) <= 2
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    assert [x[0] for x in got] == list(range(1, 201)) and [x[1] for x in got] == [0, *np.cumsum([x[2] for x in got])[:-1].tolist()]
