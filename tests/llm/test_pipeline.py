from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from wayfarer.llm import common, exact_dedup, ngram_join, packing, tokenization
from wayfarer.llm.common import stored, table

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use for their own.
CLASH = ["n_words", "hit_spans", "hit_items", "base_spans", "lang_pred", "score", "_score", "id", "bytes", "prefix", "_content", "content", "doc", "root", "keep", "members", "stays", "cls", "keep_id"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = stored(out, "test-stage")
        assert docs.select("doc_id").distinct().count() == docs.count() <= len(before)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) > 0.8 * len(before) and len({t.lower() for t in kept.values()}) == len(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def fixture() -> tuple[list[tuple], list[tuple]]:
    """(doc_id, text, lang) with planted copies, passages and odd rows; (item_id, text)."""
    r = random.Random(11)
    sounds = {"aa": ["ba", "lo", "ke", "mi", "ta", "no"], "bb": ["stru", "icht", "ung", "kra", "welz", "opf"], "cc": ["žij", "ćun", "đeo", "šaš", "vič", "gro"]}
    words = {x: ["".join(r.choice(s) for _ in range(r.randint(2, 4))) for _ in range(900)] for x, s in sounds.items()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    items = [(1, text("aa", 14)), (2, text("bb", 30)), (3, text("cc", 4)), (4, None), (5, "...")]
    rows: list[tuple] = []
    for i in range(160):
        lang = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        rows.append((10 * i, text(lang, r.randint(3, 120)), lang))
    base = text("aa", 150).split()
    for i in range(30):  # near copies, a chain among them
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(words["aa"])
        rows.append((5001 + i, " ".join(w), "aa"))
    for i in range(12):  # exact copies but for case
        rows.append((6001 + i, rows[7][1].upper() if i % 2 else rows[7][1], "bb" if i else None))
    for i, (_, item) in enumerate(items[:3]):  # passages, amid a text and as nearly the whole of one
        lang = "aabbcc"[2 * i : 2 * i + 2]
        rows += [(7001 + i, text(lang, 40) + " " + item.upper() + ", " + text(lang, 40), lang), (7011 + i, text(lang, 1) + " " + item, lang)]
    rows += [(8001, None, "aa"), (8002, "", "bb"), (8003, "12 34 !", None), (8004, "\U0001f600 ...", "cc"), (8005, "xqxqx zzqzz wqwq qqjq " * 20, None)]
    rows += [(None, text("aa", 60), "aa"), (None, rows[40][1], "bb"), (None, None, None), (9001, text("cc", 6000), "cc")]
    rows += [(9002, text("bb", 50), "bb")] * 3 + [(9003, text("bb", 50), "bb"), (9003, text("bb", 50), "bb"), (9003, rows[20][1], "cc")]
    return rows, items


def shingles(t: str, k: int = 5) -> frozenset:
    w = t.translate(LOWER).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def by_brute_force(rows: list[tuple], items: list[tuple]) -> Counter:
    """(doc_id, text) of the documents that the four filters keep."""
    grams = lambda t: Counter(w[i : i + n] for x in re.findall(r"[^\W\d_]+", t.lower()) for w in [f" {x} "] for n in (3, 4) for i in range(len(w) - n + 1))
    learned: dict[str, Counter] = {}
    sampled: Counter = Counter()
    for i, t, lang in {x for x in rows if x[2] and x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5}:
        learned.setdefault(lang, Counter()).update(set(grams(t or "")))
        sampled[lang] += 1
    known = {lang: {g for g, n in c.items() if n >= max(min(3, 1 + sampled[lang] // 10), int(0.005 * sampled[lang]))} for lang, c in learned.items()}

    def share(t) -> float:
        mine = grams(t or "")
        return max(sum(n for g, n in mine.items() if g in k) for k in known.values()) / max(1, sum(mine.values()))

    for _, t, _ in rows:
        assert not 0.2 < share(t) < 0.4, "not clear enough for a test"
    left = [(i, t) for i, t, _ in rows if share(t) >= 0.3]
    order = lambda i: -1 if i is None else i
    best: dict[str, tuple] = {}
    for i, t in left:
        key = t.translate(LOWER)
        if key not in best or order(i) > order(best[key][0]):
            best[key] = (i, t)
    left = sorted(best.values(), key=lambda x: (order(x[0]), x[1]))
    sets, root = [shingles(t) for _, t in left], list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if g == y else g for g in root]
    left = [left[i] for i in range(len(left)) if root[i] == i]
    word = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t))
    windows = set()
    for _, item in items:
        w = [m[0].translate(LOWER) for m in word(item or "")]
        windows |= {tuple(w[s : s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    out: Counter = Counter()
    for i, t in left:
        found = word(t)
        w, hit = [m[0].translate(LOWER) for m in found], set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit.update(range(s, s + size))
        if len(hit) > 0.8 * len(w):
            continue
        gone, s = [], 0
        while s < len(w):  # runs of words that windows cover go with what lies between
            e = s
            while e in hit:
                e += 1
            gone += [(found[s].start(), found[e - 1].end())] if e > s else []
            s = max(e, s + 1)
        for a, b in reversed(gone):
            t = t[:a] + t[b:]
        out[(i, t)] += 1
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows, items = fixture()
    folder = tmp_path_factory.mktemp("corpus")
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
    full = [(i, t, lang, None, len(t or ""), *[f"{c}{n}" for c in CLASH]) for n, (i, t, lang) in enumerate(rows)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(full, ddl).repartition(5)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert docs.columns == names
    return str(folder), rows, items


def test_run_against_brute_force(spark, small):
    folder, rows, items = small
    want = by_brute_force(rows, items)
    assert 100 < sum(want.values()) < len(rows) - 40 and (9003, rows[20][1]) in want and rows[20][:2] not in want and max(want.values()) == 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns, name
    got = docs.collect()
    assert Counter((r.doc_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) and r.n_words[:7] == "n_words" and r["_content"][:8] == "_content" for r in got)
    # the last stage, in run() itself
    shared = common.shared_dir(spark).removeprefix("file:")
    before = len(os.listdir(shared))
    pieces = corpus_pipeline.run(spark, folder).collect()
    library = tokenization.Encoder(tokenization.WORD_BPE).library
    ids = sorted((i is not None, i or 0, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in want)
    assert sorted({(p.doc_id is not None, p.doc_id or 0, p.doc_tokens) for p in pieces}) == sorted(set(ids))
    assert sum(p.length for p in pieces) == sum(n for _, _, n in ids)
    room: list[int] = []
    for n in sorted((p.length for p in pieces), reverse=True):
        fits = [c for c in room if c >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else packing.WINDOW) - n)
    assert len({p.sequence_id for p in pieces}) == len(room)
    assert len(os.listdir(shared)) - before <= 4  # the last stage's table and what packing reads


def test_empty_tables(spark, small, tmp_path):
    folder, _, _ = small
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    near = lambda t: t + " more"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    exact = frame([(5, x), (5, y), (9, y), (None, z), (7, z), (None, x + "!"), (None, x + "!"), (None, x + "?")])
    assert told(exact_dedup.drop_exact_duplicates(exact)) == sorted([(5, x), (9, y), (7, z), (None, x + "!"), (None, x + "?")], key=str)
    # x stays though its id goes with y's copy; of copies that share the least id, or a null one, one stays
    got = told(ngram_join.keep_one_of_each(frame([(5, x), (5, near(y)), (3, y), (None, z), (7, near(z)), (8, near(z)), (None, "a b"), (None, None), (None, None)]), k=5, percent=80))
    assert got == sorted([(5, x), (3, y), (None, z), (None, "a b"), (None, None), (None, None)], key=str)
    got = told(ngram_join.keep_one_of_each(frame([(3, y), (3, near(y)), (4, y), (2, x), (2, x), (6, z)]), k=5, percent=80))
    assert [i for i, _ in got] == [2, 3, 6] and got[1][1] in (y, near(y))
