"""Spelling variants, phrases and languages against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import corpus
from voxelcohort.llm import language_id, phrases, spelling, textgrid

ODD = "doc_id long, text string, lang string, word string, n long, tile string, c long, lang_pred string"


def frame(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(k, t, g, "w", 1, "t", 2, "p") for k, (t, g) in enumerate(zip(texts, langs))], ODD).repartition(5)


def misspelt(seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeélnorstÀ") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    words = []
    for word in base:
        words += [word] * rng.choice((3, 7, 20, 50))
        for _ in range(3):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            changed = word[:at] + rng.choice(("", rng.choice("abexyz") + word[at], rng.choice("abexyz"))) + word[at + 1:]
            words += [changed] * rng.choice((2, 3, 4, 9))
    rng.shuffle(words)
    texts = [rng.choice((" ", ", ", "\n", "9", "×-", " ы")).join(words[k:k + 25]) for k in range(0, len(words), 25)]
    return texts + [None, "", "  \n", "Ébène " * 4, texts[0], texts[0], texts[1].upper(), "q" * 3_000 + " " + "q" * 3_000 + "_" + "q" * 3_000 + " " + "q" * 2_999 + "x"]


def spelling_by_hand(texts, every):
    n = Counter()
    for doc, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{low}".encode())
            n[low[:h % len(low)] + low[h % len(low) + 1:] if h % every == 0 else low] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, out = {}, []
    for w, c in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = (len(around), best if best and words[best] >= 2 * c else None)
    for w, (k, f) in form.items():
        root = w
        while form[root][1]:
            root = form[root][1]
        out.append((w, f, root, words[w], k, words[f] if f else None))
    return sorted(out)


@pytest.mark.parametrize("tile, groups, every", [(2048, None, 97), (3, 2, 5), (1, 5, 5)])
def test_spelling_equals_all_pairs(spark, monkeypatch, tile, groups, every):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "PART_BYTES", 40)
    monkeypatch.setattr(spelling, "HELD_WORDS", 30)
    if groups:
        monkeypatch.setattr(spelling, "FEWEST_GROUPS", groups)
    texts = misspelt()
    got = spelling.variants(spelling.word_counts(frame(spark, texts), every=every)).collect()
    want = spelling_by_hand(texts, every)
    assert sorted(tuple(r) for r in got) == want
    assert sum(r[1] is not None for r in want) > 10


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.word_counts(corpus.empty(spark))).count() == 0
    assert spelling.variants(spelling.word_counts(frame(spark, [None, "", "1 2", "abcde abcde abcde"]))).collect()[0]["word"] == "abcde"


def test_forms_lead_to_one_root(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(21)]
    got = spelling.roots(spark.createDataFrame(chain + [("x", "w20"), ("y", "z")], "word string, form string")).collect()
    assert dict(map(tuple, got)) == {**{f"w{k}": "w21" for k in range(21)}, "x": "w21", "y": "z"}


def phrases_by_hand(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    inside = {}
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, words[i:i + k]
                inside[key] = max(inside.get(key, 0), a)
    found = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * inside.get((lang, words), 0) < 100 * a:
            score, k = min(((1000 * a * n[lang]) // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            found[lang].append((-score, -a, " ".join(words), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, k + 1, p, -a, left, right, n[lang], -s) for lang, own in found.items() for k, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def worded(seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        words = [f"w{min(int(rng.paretovariate(0.9)), 12)}" for _ in range(rng.randint(0, 60))]
        if k % 2:
            at = rng.randint(0, len(words))
            words[at:at] = "A hot Passage of more words Été".split()
        rows.append(("".join(w + rng.choice((" ", " ", " ", "\t ", ". ", "\n", ";")) for w in words), rng.choice(("en", "fr", None))))
    return rows + [(None, "en"), ("", "fr"), (" \n,", None), rows[1], rows[1], ("w1 " * 700, "en"), ("w1, w2 w3\x0bw2 w3. " * 90, "fr")]


@pytest.mark.parametrize("hot, rows_at_once", [(10**6, 10**6), (4, 10**6), (4, 40), (10**6, 40)])
def test_phrases_equal_counting_all(spark, monkeypatch, hot, rows_at_once):
    for name, value in (("HOT_PAIR", hot), ("SORTED_ROWS", rows_at_once), ("HELD_ROWS", rows_at_once), ("BLOCK_BYTES", 200)):
        monkeypatch.setattr(phrases, name, value)
    rows = worded()
    got = phrases.collocations(frame(spark, *map(list, zip(*rows))), least=4, top=25).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, 4, 25)


def test_phrases_move_no_rare_phrase(spark, monkeypatch):
    """All pairs are frequent and nearly all phrases of three words rare: only the frequent ones become pointers."""
    rng = random.Random(2)
    rows = [(" ".join(f"w{rng.randrange(12)}" for _ in range(100)) + ". w1 w2 w3 w4", "en") for _ in range(60)]
    moved, sort = [], phrases._sorted_counts
    monkeypatch.setattr(phrases, "_sorted_counts", lambda pointers, least: moved.append(pointers.agg(F.sum("c")).first()[0]) or sort(pointers, least))
    got = phrases.collocations(frame(spark, *map(list, zip(*rows))), least=20, top=50).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, 20, 50)
    assert 120 <= moved[0] < 300  # 5,880 before


@pytest.mark.parametrize("held", [50, 10**6])
def test_phrase_buckets_add_up_over_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD_PHRASES", held)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 200)
    rows = worded(7)
    docs = frame(spark, *map(list, zip(*rows))).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").repartition(5)
    often = phrases._filter(phrases._often(docs, 300))
    names, hashes, _ = phrases._languages(pa.array(["en", "und", "en"]))
    data = np.frombuffer(b"w1 w1 w3 rare", dtype=np.uint8)
    h, _, _, _, left = phrases.words_of(data, np.array([0, len(data)]))
    levels = [at.tolist() for at, _ in phrases.growing(h, np.full(len(h), hashes[0]), left, often)]
    assert levels[0][:2] == [0, 1] and levels[1][:1] == [0] and 3 not in levels[0]


def test_phrases_do_not_depend_on_the_filter(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)  # full: everything passes and is counted
    rows = worded(6)
    got = phrases.collocations(frame(spark, *map(list, zip(*rows))), least=5).collect()
    assert sorted(tuple(r) for r in got) == phrases_by_hand(rows, 5, 2000)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(corpus.empty(spark)).count() == 0
    assert phrases.collocations(frame(spark, [None, "", "one two"])).count() == 0


def test_quicksort_counts_beginnings():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 4, (3000, 5)).astype(np.uint64)
    for row, width in zip(keys, rng.integers(1, 6, 3000)):
        row[width:] = 0
    weights = rng.integers(1, 4, 3000)
    want = Counter()
    for row, w in zip(keys.tolist(), weights.tolist()):
        for k in range(1, 6):
            if row[k - 1]:
                want[tuple(row[:k])] += w
    for least in (1, 40):
        got = {tuple(keys[p, :d].tolist()): c for p, d, c in phrases.quicksorted(keys, weights, least)}
        assert got == {k: c for k, c in want.items() if c >= least}
    got = {tuple(keys[a, :b].tolist()): c for p, d, n in phrases.beginnings(keys, weights) for a, b, c in zip(p, d, n.tolist())}
    assert got == want


SYLLABLES = {"en": "the ing tion and er of wh", "de": "der sch ung ch ein üß keit", "fr": "eau é tion ou le re çê"}


def spoken(seed=2, n=240):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        parts = SYLLABLES[lang].split()
        rows.append((" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))).title(), lang))
    return rows


def test_languages_of_rows_not_learned_from(spark):
    rows = spoken()
    odd = [(None, "en"), ("", "de"), ("12 34 !?", "fr"), (rows[0][0], None), (rows[0][0], None)]
    docs = frame(spark, *map(list, zip(*rows, *odd)))
    model = language_id.fit(docs, F.col("doc_id") % 4 != 2)
    assert model.languages == ("de", "en", "fr")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model, keep=("doc_id", "lang", "c")).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [k for k in range(len(rows)) if k % 4 == 2]
    assert sum(got[k]["lang_pred"] == rows[k][1] for k in held) >= 0.97 * len(held)
    assert [got[len(rows) + k]["lang_pred"] for k in range(5)] == ["und"] * 3 + [got[0]["lang_pred"]] * 2
    assert [got[len(rows) + k]["score"] for k in range(3)] == [0.0] * 3


def test_languages_without_anything_to_learn(spark):
    docs = frame(spark, ["some words", None], [None, "en"])
    model = language_id.fit(docs, F.lit(False))
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()] == [("und", 0.0)] * 2
    assert language_id.predict(corpus.empty(spark), model).count() == 0


def test_long_texts_are_summed_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(language_id.FEATURES, 3)).astype(np.float32)
    texts = ["Un été " * 300, "", "a", "\U0001d4d0bc 中文! " * 40]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    fold = language_id._fold()
    whole, lettered = language_id.sums(data, offsets, weights, fold)
    monkeypatch.setattr(language_id, "SLICE", 7)
    parts, _ = language_id.sums(data, offsets, weights, fold)
    assert np.allclose(whole, parts, rtol=1e-5) and lettered.tolist() == [True, False, True, True]
    for k, text in enumerate(texts):
        low = re.sub(r"[^\w]+|[\d_]+", " ", text).strip().lower()
        low = low + " " if low else ""
        grams = [low[i:i + n] for n in range(1, 5) for i in range(len(low) - n + 1) if low[i:i + n] != " "]
        alone = np.frombuffer(text.encode(), dtype=np.uint8)
        points, begin = language_id._letters(alone, np.array([0, len(alone)]), fold)
        assert "".join(map(chr, points)) == low
        assert sum(len(s) for s, _ in language_id._slots(points, begin)) == len(grams)


def test_words_split_at_ascii_space_only():
    data = np.frombuffer("a b é".encode(), dtype=np.uint8)
    assert len(textgrid.words(data, np.array([0, len(data)]))[0]) == 2
