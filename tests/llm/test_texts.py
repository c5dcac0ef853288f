"""Language, lines, near copies and language-model scores against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelight.llm import langid, line_dedup, lm, ngram_join, words
from sitelight.llm.common import Scratch, noting

LAYOUT = "doc_id long, text string, lang string, score string, n long, node string, uid int"
ODD = ["", " \t\r\n\x0b\x0c ", "One", "two words here", "a\x1cb c\x85d", "É È É", "x " * 4000, "\x00 \x00", "..."]


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "xx", "s", 9, "n", 1) for i, t in rows], LAYOUT)


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        lower = lower.replace(gap, " ")
    return [w for w in lower.split(" ") if w]


def test_word_hashes_follow_the_words():
    texts = [*ODD, "THE the The", "é É"]
    hashes, offsets = words.word_hashes(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        own = plain_words(text)
        assert b - a == len(own)
        assert len(set(hashes[a:b].tolist())) == len(set(own))


# --- language ---------------------------------------------------------------------
def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "a", "b", "ab", "ba", "▁", "c"]
    vocabulary = langid.Vocabulary.of(pieces)
    draw = np.random.default_rng(1)
    table = np.vstack([draw.random((len(pieces), 2)), np.zeros((1, 2))])
    ordered = langid._ordered(vocabulary, pieces, table)
    worth = {p: table[i] for i, p in enumerate(pieces)}

    def brute(word):
        marked, total = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            parts, start = [], 0
            for i, cut in enumerate([*cuts, 1]):
                if cut:
                    parts.append(marked[start : i + 1])
                    start = i + 1
            chance = np.ones(2)
            for part in parts:
                value = worth.get(part, np.zeros(2))
                chance = chance * (np.maximum(value, langid.STRANGE) if len(part) == 1 else value)
            total += chance
        return total

    names = ["a", "ab", "abab", "cab", "zz", "bazab"]
    assert np.allclose(np.exp(langid.log_words(vocabulary, ordered, names)), [brute(w) for w in names])
    uses = langid.expected(vocabulary, ordered, ["ab"], np.ones((1, 2)))
    size = np.array([len(p) for p in sorted(pieces, key=langid._key)] + [0])
    strange = 0  # "ab" has no lone character outside the vocabulary
    assert np.allclose((uses * size[:, None]).sum(axis=0) + strange, 3)


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held_out", F.col("doc_id") % 4 == 2)
    model = langid.fit(docs.where("NOT held_out"), langid.vocabulary_path(), sample=40)
    got = langid.identify(docs.where("held_out"), model).toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all()
    odd = frame(spark, [(i, t) for i, t in enumerate([None, *ODD, "123 %%% ²", "l" * 90])]).withColumn("lang_pred", F.lit("old"))
    rows = langid.identify(odd, model).orderBy("doc_id").collect()
    no_letter = {0, 1, 2, 8, 9, 10}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == no_letter and all(r.score == 0 for r in rows if r.doc_id in no_letter)
    assert all(r.node == "n" and r.lang == "xx" for r in rows)


def test_nothing_learned(spark):
    empty = frame(spark, [])
    model = langid.fit(empty, langid.vocabulary_path())
    assert langid.identify(empty, model).count() == 0
    assert [(r.lang_pred, r.score) for r in langid.identify(frame(spark, [(1, "text")]), model).collect()] == [("und", 0.0)]
    unlabelled = frame(spark, [(1, None), (2, "a")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    assert langid.fit(unlabelled, langid.vocabulary_path()).languages == []


# --- lines -------------------------------------------------------------------------
def shared_runs(rows):
    """By a plain loop over all earlier texts, in order of id and row: of each row
    the longest run from every visible line on that an earlier text or an earlier
    place of the same one holds, and that an earlier text holds. Whole repeats are
    told apart."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, places, out = set(), {}, {}
    for k in order:
        text = rows[k][1]
        if not (text or "").strip():
            continue
        lines = text.split("\n")
        longest, elsewhere = [0] * len(lines), [0] * len(lines)
        for i, line in enumerate(lines):
            for other, at in places.get(line, []) if line.strip() else []:
                n = 0
                while i + n < len(lines) and at + n < len(other) and lines[i + n] == other[at + n]:
                    n += 1
                longest[i] = max(longest[i], n)
                if other is not lines:
                    elsewhere[i] = max(elsewhere[i], n)
            places.setdefault(line, []).append((lines, i))
        out[k] = (lines, longest, elsewhere, text in seen)
        seen.add(text)
    return out


def check_lines(rows, kept):
    """(lines of repeated multi-line runs of 50 words or more, those of them that
    were removed). ``kept`` holds the text and the removed lines of every row."""
    wanted = removed = 0
    left = {line for text, _ in kept for line in (text or "").split("\n")}
    for k, (lines, longest, elsewhere, repeat) in shared_runs(rows).items():
        text, n = kept[k]
        if repeat:
            assert (text, n) == ("", len(lines)), rows[k]
            continue
        rest, gone, at = text.split("\n") if n < len(lines) else [], [], 0
        assert n == len(lines) - len(rest)
        for i, line in enumerate(lines):  # which lines are gone; of equal neighbours any may be meant
            if at < len(rest) and line == rest[at]:
                at += 1
            else:
                gone.append(i)
        assert at == len(rest)
        assert all(lines[i] in left or not lines[i].strip() for i in gone), rows[k][0]
        may = set()
        for i, m in enumerate(longest):
            run = [j for j in range(i, i + m) if lines[j].strip()]
            if len(run) > 1 or (run and len(lines[i].split()) >= 50):
                may.update(range(i, i + m))
        assert all(lines[i] in {lines[j] for j in may} or not lines[i].strip() for i in gone), rows[k][0]
        i = 0
        while i < len(lines):
            m = elsewhere[i]
            if sum(bool(line.strip()) for line in lines[i : i + m]) > 1 and sum(len(line.split()) for line in lines[i : i + m]) >= 50:
                wanted += m
                removed += sum(j in gone for j in range(i, i + m))
                i += m
            else:
                i += 1
    return wanted, removed


def test_lines_against_brute_force(spark):
    draw = random.Random(8)
    block = "\n".join(f"shared line {i} of the block" for i in range(12))
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "\n".join(f"own {i} {j}" for j in range(draw.randint(0, 9))) + "\n" + block + f"\ntail {i}") for i in range(30)]
    rows += [(40 + i, f"before {i}\n{passage}\nafter {i}") for i in range(5)] + [(50, None), (51, ""), (52, "\n\n\n"), (53, "\n\n\n"), (54, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    rows += [(60, "x"), (61, "x"), (62, "a b\nc d\na b\nc d\na b\nc d"), (63, "same\n" * 1000), (64, "y\nx\nz")]
    layout = "doc_id long, text string, node string"
    numbered = spark.createDataFrame([(d, t, str(k)) for k, (d, t) in enumerate(rows)], layout).withColumn("n_removed", F.lit("old")).coalesce(1)
    got = {int(r.node): (r.text, r.n_removed) for r in line_dedup.dedup(numbered).collect()}
    assert len(got) == len(rows) and got[35] == (None, 0) and got[36] == ("", 0) and got[37] == got[38] == ("\n\n\n", 0)
    wanted, removed = check_lines(rows, [got[k] for k in range(len(rows))])
    assert wanted == removed == 29 * 12 and got[rows.index((61, "x"))] == ("", 1) and got[rows.index((64, "y\nx\nz"))] == ("y\nx\nz", 0)
    assert sum(passage in (t or "") for t, _ in got.values()) == 1


def test_repeated_passages_are_found_in_given_documents(spark):
    """Passages of two to six lines and 50 words or more, put into texts at random places."""
    draw = random.Random(21)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    vocabulary = [f"word{i}" for i in range(500)]
    passages = []
    for i in range(60):
        n = 2 + i % 5
        passages.append("\n".join(" ".join(draw.choice(vocabulary) for _ in range(60 // n + draw.randint(0, 9))) for _ in range(n)))
    rows = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        if text and draw.random() < 0.5:
            lines.insert(draw.randint(0, len(lines)), draw.choice(passages))
        rows.append((doc, None if text is None else "\n".join(lines)))
    rows += rows[:20]
    numbered = spark.createDataFrame([(d, t, str(k)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, node string").coalesce(1)
    got = {int(r.node): (r.text, r.n_removed) for r in line_dedup.dedup(numbered).collect()}
    wanted, removed = check_lines(rows, [got[k] for k in range(len(rows))])
    assert wanted > 800 and removed >= 0.95 * wanted


def test_chunks_resist_shifts():
    lines = [f"line {i}".encode() for i in range(200)]
    changed = [b"new", *lines[:100], b"", b"inserted", *lines[100:]]
    texts = {b"\n".join(lines[a:b]) for a, b in line_dedup.chunks_of(lines, 2)}
    moved = {b"\n".join(changed[a:b]) for a, b in line_dedup.chunks_of(changed, 2)}
    assert len(texts - moved) <= 8 and len(texts) > 100
    # two shared lines hold a chunk, whatever stands around them
    for i in range(0, 198, 2):
        around = [[f"a{i}".encode(), *lines[i : i + 2], f"b{i}".encode()], [f"c{i}".encode(), *lines[i : i + 2], f"d{i}".encode()]]
        one, other = ({b"\n".join(t[a:b]) for a, b in line_dedup.chunks_of(t, 2) if a >= 1 and b <= 3} for t in around)
        assert one & other
    assert line_dedup.chunks_of([b"", b" "], 1) == [] and line_dedup.chunks_of([b"", b"one line"], 2) == [(1, 2)]


def test_matches_are_extended_while_digests_agree():
    text, first = [b"p", b"q", b"r", b"s"], [b"o", b"q", b"r", b"s", b"t"]
    assert line_dedup.extended(text, 2, 3, line_dedup.digests(first[:2]), line_dedup.digests(first[3:])) == (1, 4)
    assert line_dedup.extended(text, 2, 3, b"", b"") == (2, 3)


def test_no_lines(spark):
    assert line_dedup.dedup(frame(spark, [])).count() == 0


# --- near copies -----------------------------------------------------------------------
def grouped(rows, width, percent):
    sets = []
    for doc, text in rows:
        w = plain_words(text)
        n = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    known = sorted({(d, s) for (d, _), s in zip(rows, sets, strict=True) if d is not None}, key=lambda x: x[0])
    parent = {d: d for d, _ in known}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, x), (b, y) in itertools.combinations(known, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return sorted((str(d), len(s), "None" if d is None else str(find(d))) for (d, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 50)])
def test_groups_against_all_pairs(spark, width, percent):
    draw = random.Random(width + percent)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([8, 30, 80, 150]))] for _ in range(12)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(120):  # a third of them near copies of the first text
        text = list(bases[0] if i % 3 == 0 else draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((i, " ".join(text + (passage if i % 5 == 0 else []))))
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(300, None), (None, rows[0][1]), (301, rows[0][1]), (5, rows[5][1]), (302, "One"), (303, "ONE")]
    got = ngram_join.groups(frame(spark, rows), width, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == grouped(rows, width, percent)


def test_links_that_leaders_miss(spark):
    """A chain: each text is a near copy of the next one only."""
    draw = random.Random(2)
    text, rows = [f"v{i}" for i in range(200)], []
    for i in range(25):
        rows.append((100 - i, " ".join(text)))
        for _ in range(2):
            text[draw.randrange(200)] = f"n{i}{draw.random()}"
    got = ngram_join.groups(frame(spark, rows), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == grouped(rows, 3, 90)


def test_no_texts(spark):
    assert ngram_join.groups(frame(spark, []), 3, 90).count() == 0
    assert [tuple(r) for r in ngram_join.groups(frame(spark, [(4, None)]), 3, 90).collect()] == [(4, 0, 4)]


# --- language model ----------------------------------------------------------------------
def test_filter_holds_levels(spark):
    draw = np.random.default_rng(3)
    items, levels = np.unique(draw.integers(-(2**62), 2**62, 4000)), None
    levels = draw.integers(3, 12, len(items))
    table = spark.createDataFrame([(1, int(i), int(v)) for i, v in zip(items, levels, strict=True)], "kind int, item long, level int")
    built = lm.build_filter(table, 3, int((levels - 2).sum()))
    found = built.levels(lm.word_keys(items.view(np.uint64)))
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    absent = lm.word_keys(draw.integers(2**62, 2**63 - 1, 4000).view(np.uint64))
    assert (built.levels(absent) > 0).mean() < 0.02
    assert lm.build_filter(table, 3, 0).levels(absent).max() == 0


def test_levels_and_counts():
    assert [float(c) for c in lm.count_of(np.array([0, 1, 3, 4]))] == [0, 1, 2, 3]
    for count in [1, 2, 3, 4, 5, 7, 8, 100, 10**6]:
        level = math.floor(2 * math.log2(count) + 1e-9) + 1
        assert 0.7 <= float(lm.count_of(level)) / count <= 1.5


def base(rows, trained):
    texts = [[*plain_words(t), None] for _, t in rows]
    counts = Counter(w for text, t in zip(texts, trained, strict=True) if t for w in text)
    n, scale = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    return [(len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 0.5) / scale) for w in t)) for t in texts]


@pytest.mark.parametrize(("frequent", "entries"), [(2**19, 2**24), (40, 3000), (0, 10)])
def test_scores(spark, frequent, entries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no id"), (3, rows[3][1])]
    fold = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    docs = frame(spark, rows).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1)
    got = lm.score(docs, docs.where("NOT held_out"), frequent=frequent, entries=entries).toPandas()
    want = base(rows, [not f for f in fold])
    key = lambda d, n: (str(d), n)
    left = sorted((key("None" if math.isnan(r.doc_id) else int(r.doc_id), r.n_tokens), r.n_known, r.train_tokens, r.base_score) for r in got.itertuples())
    right = sorted((key(d, w[0]), w[1], w[2], w[3]) for (d, _), w in zip(rows, want, strict=True))
    assert [x[:3] for x in left] == [x[:3] for x in right]
    assert np.allclose([x[3] for x in left], [x[3] for x in right], rtol=1e-9)
    assert np.isfinite(got.score).all() and (got.score <= 0).all()
    if entries == 2**24:
        held = got[got.held_out]
        assert held.score.sum() > held.base_score.sum()


def test_probabilities_of_a_context_add_up(spark):
    """Over all words, the model spends at most about all of its mass on the next word."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    model, _ = lm.fit(frame(spark, rows), Scratch(spark))
    vocabulary, _ = words.word_hashes(pa.array([" ".join({w for _, t in rows for w in plain_words(t)})], pa.string()))
    context, _ = words.word_hashes(pa.array(["the"], pa.string()))
    pairs = np.empty(2 * (len(vocabulary) + 1), dtype=np.uint64)
    pairs[::2], pairs[1::2] = context[0], np.append(vocabulary, lm.END)
    logs, _, _ = lm.log_probabilities(model, pairs, np.zeros(1, dtype=np.int64))
    assert 0.9 < (10 ** logs[1::2]).sum() < 1.15


def test_slices_hold_every_ngram(spark):
    """Many small slices give the scores of one filter, in which pairs seen once are held."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(40)]
    docs = frame(spark, rows)
    one, many = (lm.score(docs, docs, frequent=0, entries=n).orderBy("doc_id").toPandas() for n in (2**24, 500))
    assert np.allclose(one.score, many.score, rtol=0.01)
    assert (many.score > 0.6 * many.base_score).all()  # a quarter of every word's mass is on the pair that was seen


def test_untrained(spark):
    empty = frame(spark, [])
    assert lm.score(empty, empty).count() == 0
    got = lm.score(frame(spark, [(1, "a b"), (2, None)]), empty).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert all(abs(r.score - r.base_score) < 1e-9 for r in got)


def test_counts_go_before_texts_are_written(spark, monkeypatch):
    """What the model was counted from does not lie on disk beside texts and their keys."""
    beside, write = {}, Scratch.write

    def noted(self, df, name, **options):
        beside[name] = set(self.paths)
        return write(self, df, name, **options)

    monkeypatch.setattr(Scratch, "write", noted)
    docs = frame(spark, [(1, "a b"), (2, "b c a")])
    assert lm.score(docs, docs).count() == 2
    assert "lm-counts" not in beside["lm-asked"] and "lm-dealt" not in beside["lm-scored"]


def test_answers_are_made_in_parts(spark):
    """What n-grams and questions shuffle lies on disk for one part at a time."""
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(40))) for i in range(40)]
    paths = []
    with noting(paths):
        scored = lm.score(frame(spark, rows), frame(spark, rows[:30]), frequent=0, entries=300)
    assert sum("lm-answers" in path for path in paths) == 2
    assert scored.where("score < 0").count() == 40


def test_keys_of_many_batches_are_looked_up_together(monkeypatch):
    calls = []
    plain = lm.LogFrequencyFilter.levels
    monkeypatch.setattr(lm.LogFrequencyFilter, "levels", lambda self, keys: calls.append(len(keys)) or plain(self, keys))
    low = [np.random.default_rng(i).integers(0, 2**40, 5 + i).astype(np.uint64) for i in range(30)]
    packs = [lm.packed(x, 5, np.array([0, len(x)]))[0].as_py() for x in low]
    counts = pa.table({"keys": packs[:10], "levels": [bytes([1 + i] * len(x)) for i, x in enumerate(low[:10])]})
    asked = pa.table({"batch": list(range(30)), "slice": pa.array([0] * 30, pa.int32()), "keys": packs})
    got = lm._answered(counts, asked)["levels"].to_pylist()
    assert len(calls) == 1
    assert [len(x) for x in got] == [len(x) for x in low]
    assert all(min(x) >= 1 + i for i, x in enumerate(got[:10]))
    monkeypatch.setattr(lm, "LOOKED_UP", 20)
    assert lm._answered(counts, asked)["levels"].to_pylist() == got
    assert lm._answered(counts, asked.slice(0, 0)).num_rows == 0
