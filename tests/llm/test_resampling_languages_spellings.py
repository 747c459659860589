"""Operators 11 to 13 against plain versions, and their awkward rows."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest

from slatewise.llm import languages, resampling, spellings

CLASHING = "doc_id long, text string, lang string, source string, n long, word string, score double, rank int, part int, first double, least int, bucket long"


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, "s", 9, "w", 0.5, 3, 1, 2.0, 7, 5) for i, t, lang in rows], CLASHING)


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta-x", "éclair", "naïve", "x1", "2nd", "straße", "日本", "omega"]
    out = [" ".join(r.choice(words) + r.choice(["", ",", ".", "\n", "\x00"]) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return out + ["", None, " \t\n", "!!!", out[3], out[3]]


def plain_features(text, longest):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("longest, slice_size", [(1, 1 << 20), (1, 7), (2, 1 << 20), (3, 11)])
def test_resampling_equals_plain_version(spark, monkeypatch, longest, slice_size):
    docs = [(i, t, "en") for i, t in enumerate(texts(150))]
    docs += [(4, "alpha beta " * 30, "en"), (4, "alpha beta " * 30, "en")]
    target = ["Beta gamma éclair", None, "日本 2nd 2nd"] * 4
    monkeypatch.setattr(resampling, "SLICE", slice_size)
    monkeypatch.setattr(resampling, "GROUP_ROWS", 10)
    s, t = Counter(), Counter()
    for texts_, held in (([x for _, x, _ in docs], s), (target, t)):
        for x in texts_:
            held.update(zlib.crc32(f) % 97 for f in plain_features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, x, _ in docs:
        n, features = plain_features(x, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 97) / ((s[b] + 1) * (T + 97)))) for b in (zlib.crc32(f) % 97 for f in features))
        h = int(hashlib.sha256(f"5:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    drawn = {k: r for k, r in enumerate(able[: 30 * len(able) // 100], 1)}
    got = resampling.importance_resample(frame(spark, docs), frame(spark, [(0, x, "en") for x in target]), percent=30, buckets=97, longest=longest, seed=5).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(r[:4] for r in rows)
    assert {r["rank"]: (r["doc_id"], r["score"]) for r in got if r["rank"]} == {k: (r[0], r[3]) for k, r in drawn.items()}
    assert sum(r["rank"] is not None for r in got) == len(drawn) > 10


def test_resampling_of_awkward_tables(spark):
    none = resampling.importance_resample(frame(spark, []), frame(spark, []))
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = resampling.importance_resample(frame(spark, [(None, "a b " * 20, "en"), (None, None, None)]), frame(spark, []), percent=100).collect()
    assert sorted((r["n_features"], r["rank"] or 0) for r in got) == [(0, 0), (40, 1)]


SAMPLES = {
    "en": "the cat and the dog went with their friend to the house of the old man and then they were there for the night",
    "de": "der hund und die katze gingen mit ihrem freund zum haus des alten mannes und dann waren sie dort für die nacht",
    "es": "el perro y el gato fueron con su amigo a la casa del hombre viejo y luego estuvieron allí por la noche entera",
}


def plain_grams(text, longest=3):
    runs, found = [], Counter()
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            runs.append(c)
        elif not runs or runs[-1] != " ":
            runs.append(" ")
    line = " " + "".join(runs).strip() + " "
    for word in line.split():
        word = f" {word} "
        for n in range(1, longest + 1):
            found.update(g for g in (word[i : i + n] for i in range(len(word) - n + 1)) if g.strip())
    # a border after one word and one before the next are one border, and no n-gram holds both
    return found


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (1 if c == " " else ord(c))
    return out


def test_languages_equal_plain_version(spark, monkeypatch):
    r = random.Random(3)
    docs = []
    for i in range(240):
        lang = r.choice(list(SAMPLES))
        docs.append((i, " ".join(r.choice(SAMPLES[lang].split()) for _ in range(r.randint(1, 40))).capitalize() + "!?", lang))
    docs += [(500, None, "en"), (501, "", "en"), (502, "12 34 %%", "de"), (503, "日本", None), (504, SAMPLES["en"], None), (504, SAMPLES["en"], None)]
    size = 60
    counts: dict[str, Counter] = {}
    for i, t, lang in docs:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {lang: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:size])} for lang, c in counts.items()}

    def told(text):
        own = sorted(plain_grams(text or "").items(), key=lambda x: (-x[1], code(x[0])))[:size]
        if not own:
            return "und", 0.0
        distance = []
        for lang, ranks in sorted(profiles.items()):
            off = 0
            for g, n in own:
                tied = [k for k, (_, m) in enumerate(own) if m == n]
                off += abs(ranks[g] - sum(tied) / len(tied)) if g in ranks else size
            distance.append((off / len(own) / size, lang))
        distance.sort()
        first, second = distance[0][0], distance[1][0]
        return distance[0][1], (second - first) / second if second else 0.0

    for block, slice_size in ((256, 1 << 19), (1, 9)):  # also language by language, and in many slices
        monkeypatch.setattr(languages, "BLOCK", block)
        monkeypatch.setattr(languages, "SLICE", slice_size)
        got = languages.language_ids(frame(spark, docs), size=size).collect()
        assert len(got) == len(docs)
        by_id = dict((i, t) for i, t, _ in docs)
        for row in got:
            want = told(by_id[row["doc_id"]])
            assert row["lang_pred"] == want[0] and row["score"] == pytest.approx(want[1], abs=1e-9), row
            assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
    long = [t for _, t, _ in docs[:240]]
    assert sum(p == lang for (p, _), (_, _, lang) in zip(map(told, long), docs, strict=False)) > 225


def test_languages_of_slices_and_awkward_tables(spark):
    text = "Straße, ΟΔΟΣ 12 İstanbul  naïve\n" * 50
    whole, sliced = languages.gram_counts(text), languages.gram_counts(text, slice_size=13)
    assert all((a == b).all() for a, b in zip(whole, sliced, strict=True))
    assert languages.language_ids(frame(spark, [])).count() == 0
    got = languages.language_ids(frame(spark, [(None, "abc", None), (1, None, None)])).collect()
    assert {(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got} == {(None, False, "und", 0.0), (1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)}
    one = languages.language_ids(frame(spark, [(1, "abc abc", "en"), (3, "abc", "en")])).collect()
    assert {r["lang_pred"] for r in one} == {"en"} and all(0 < r["score"] <= 1 for r in one)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs, least=7, every=31, times=10):
    n = Counter()
    for i, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    forms, rows = {}, {}
    for w in n:
        close = sorted((-n[v], v) for v in n if near(w, v))
        form = close[0][1] if close and -close[0][0] >= times * n[w] else None
        forms[w] = form
        rows[w] = (form, n[w], len(close), n[form] if form else None)
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows[w] = (rows[w][0], root, *rows[w][1:])
    return rows


@pytest.mark.parametrize("most, letters", [(256, "abcÉé"), (2, "abÿ"), (3, "ab")])
def test_spellings_equal_plain_version(spark, monkeypatch, most, letters):
    r = random.Random(most)
    words = ["".join(r.choice(letters) for _ in range(r.randint(5, 11))) for _ in range(120)]
    words += ["a" * k for k in range(5, 30)] + ["a" * 9 + "b" + "a" * k for k in range(4)]
    docs = [(i, " ".join(r.choice(words) + r.choice([" ", "-", "日", "\n", "×"]) for _ in range(40)), "en") for i in range(80)]
    docs += [(900, "Abaabbab " * 400 + "abaabbabb " * 30 + "abaabbabba " * 2, "en"), (901, None, "en"), (902, "", "en"), (903, "日本 x", "en"), (None, "abaabbab abaabbab", "en")]
    docs += docs[:1] * 2
    monkeypatch.setattr(spellings, "SLICE", 50)
    kept = spellings.near_words
    monkeypatch.setattr(spellings, "near_words", lambda words, least: kept(words, least=least, most=most))
    got = spellings.spelling_variants(frame(spark, docs)).collect()
    want = plain_variants(docs)
    assert len(got) == len(want) > 50
    assert {row["word"]: (row["form"], row["root"], row["n"], row["n_near"], row["form_n"]) for row in got} == want
    assert any(v[0] for v in want.values())


def test_spellings_of_awkward_tables(spark):
    assert spellings.spelling_variants(frame(spark, [])).count() == 0
    assert spellings.spelling_variants(frame(spark, [(1, None, "en"), (2, "ab cd", "en")])).count() == 0


def test_near_pairs_scan():
    r = random.Random(1)
    for _ in range(400):
        words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(0, 6))) for _ in range(r.randint(2, 25))})
        got = sorted((i, j) for i, j, _ in spellings.near_pairs(words))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]
