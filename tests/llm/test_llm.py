"""The training-data operators against brute force on small and awkward inputs."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from slatewise.llm.loser_tree import decode, front_code, merge  # noqa: E402
from slatewise.llm.neighbours import nearest  # noqa: E402
from slatewise.llm.ngram_join import similar_documents  # noqa: E402
from slatewise.llm.packing import Schedule, packed_sequences  # noqa: E402
from slatewise.llm.quality import RuleEnsemble, fit_rules, keep_quality, quality_scores  # noqa: E402
from slatewise.llm.sharding import interleaved_shards  # noqa: E402
from slatewise.llm.suffix_dedup import repeat_report, without_repeats  # noqa: E402
from slatewise.llm.token_counts import token_counts  # noqa: E402
from slatewise.llm.top_k import exact_top_k, quantised  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long"


def _awkward():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    base = [" ".join(word() for _ in range(r.randint(30, 160))) for _ in range(24)]
    passage = " ".join(word() for _ in range(70))
    texts = [None, "", " ", "one", "two words", "x" * 30_000, "é" * 400, "don't  stop\t<|endoftext|> İ ﬁ", "\x1ca b\x00c", "12 345,6", "The " * 300, "the " * 299 + "end"]
    texts += base + base[:3] + [base[0]] * 6 + [b + " " + passage for b in base[4:9]] + [passage]
    for b in base[9:15]:
        w = b.split()
        w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
        texts.append(" ".join(w[3:]))
    rows = [(i * 3 % 1009, t, "en", "hot" if i % 3 else ("s%d" % (i % 5) if i % 7 else None), len(t or ""), 1.5, 9) for i, t in enumerate(texts)]
    return rows + [rows[14], (None, base[0], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6) / 4]) for i in range(160)] + [(7, [0.5] * 6), (900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6), (903, [0.25, 1.0]), (904, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = quantised(df)
    got = {}
    for x in exact_top_k(q.filter("vec_id % 50 = 0 or vec_id = 903"), q, k=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    for qi, qv in good:
        if qi % 50 == 0:
            want = sorted(((-int(qv @ v), i) for i, v in good if i != qi and len(v) == len(qv)))[:5]
            assert sorted(got[qi]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert 903 not in got
    assert exact_top_k(q.filter("false"), q).count() == 0


def test_nearest_recall(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((8, 24))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.3 * r.standard_normal(24)]) for i in range(700)] + [(900, [0.0] * 24), (901, None), (902, [float("nan")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df.filter("vec_id % 100 = 0"), df, k=10).collect()
    m = np.array([v for _, v in rows[:700]])
    hits = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = {x["vec_id"]: x["score"] for x in got if x["query_id"] == q}
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(mine))
        assert all(abs(d[i] - s) < 1e-9 for i, s in mine.items())
    assert hits >= 0.9 * 70 and not any(x["query_id"] >= 900 for x in got)


def _brute_repeats(rows, window=50):
    rows = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in rows:
        if i is not None:
            for s in range(len(b) - window + 1):
                w = b[s : s + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1 if i is not None else 0):
            if first[b[s : s + window]] < i:
                gone[s : s + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, nothing):
    got = sorted((tuple(r) for r in repeat_report(docs).collect()), key=str)
    assert got == _brute_repeats(_awkward())
    assert any(r[2] for r in got)
    cut = without_repeats(docs)
    assert cut.columns == [*docs.columns, "n_removed"]
    kept = cut.collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in kept if r["doc_id"] is not None) == sorted((i, n) for i, _, n, *_ in got if i is not None)
    assert {r["doc_id"]: r["text"] for r in kept}[0] is None and len(kept) == len(_awkward())
    assert repeat_report(nothing).count() == 0


def _unrelated():
    r = random.Random(12)
    return [(i, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(80))) for i in range(6)]


@pytest.mark.parametrize("parts", ["3", "200", "2000"])
def test_tables_that_share_nothing(spark, parts):
    rows = _unrelated()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for some in ([rows, rows[:1], [rows[0], (9, rows[0][1]), rows[1]]] if parts == "3" else [rows]):
            df = spark.createDataFrame(some, "doc_id long, text string")
            assert sorted((tuple(r) for r in similar_documents(df).select("doc_id", "n_shingles", "component_id").collect()), key=str) == _brute_classes(some)
            assert sorted((tuple(r) for r in repeat_report(df).collect()), key=str) == _brute_repeats(some)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_equal_rows_and_clashing_names(spark):
    text = _unrelated()[0][1]
    rows = [(5, text)] * 40 + [(3, text)] * 40 + [(7, text + " and more of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as row_key", "2L as n_removed", "'y' as spans", "'z' as copy", "9 as v", "8 as cluster")
    assert sorted((tuple(r) for r in repeat_report(df).collect()), key=str) == _brute_repeats(rows)
    assert sorted((tuple(r) for r in similar_documents(df).select("doc_id", "n_shingles", "component_id").collect()), key=str) == _brute_classes(rows)
    cut = without_repeats(df)
    assert set(cut.columns) == set(df.columns) and cut.filter("row = 'x' and row_key = 1 and spans = 'y' and copy = 'z'").count() == 81


def test_loser_tree_merges_in_order():
    r = random.Random(5)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 9))) for _ in range(40)}) for _ in range(5)] + [[]]
    coded = [front_code(x) for x in runs]
    out = list(merge([decode(*c) for c in coded]))
    assert [k for k, _, _ in out] == sorted(k for x in runs for k in x)
    last = b""
    for k, common, _ in out:
        assert common == len(os.path.commonprefix([last, k]))
        last = k


def _brute_classes(rows):
    sets = []
    for i, t, *_ in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def test_ngram_join(docs, nothing):
    got = sorted((tuple(r) for r in similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == _brute_classes(_awkward())
    assert any(i is not None and i != c for i, _, c in got)
    assert similar_documents(nothing).count() == 0


def test_ngram_join_of_a_large_group_in_cut_blocks(spark, monkeypatch):
    from slatewise.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(8)
    base = ["w%d" % r.randrange(10**6) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(120)] = "e%d" % r.randrange(10**6)
        rows.append((i, " ".join(w)))
    got = sorted((tuple(x) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == _brute_classes(rows)


def test_ngram_join_over_blocks_and_borderline_pairs(spark, monkeypatch):
    from slatewise.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    r = random.Random(21)
    rows = []
    for g in range(6):
        base = ["w%d" % r.randrange(10**6) for _ in range(r.choice([30, 60, 150]))]
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 12)):
                w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
            a = r.randint(0, len(w) // 8)
            rows.append((len(rows), " ".join(w[a:])))
    passage = ["p%d" % i for i in range(60)]
    rows += [(len(rows) + i, " ".join(passage + ["q%d" % r.randrange(10**6) for _ in range(40)])) for i in range(30)]
    got = sorted((tuple(x) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == _brute_classes(rows)


def test_frequency_classes_hold_one_order(spark):
    import pyarrow as pa
    from slatewise.llm.shared_hashes import frequency_class, with_classes

    r = random.Random(2)
    sets = {i - 4: sorted({r.choice([r.getrandbits(63), r.randrange(1 << 40, (1 << 40) + 60)]) for _ in range(30)}) for i in range(9)}
    df = {h: sum(h in s for s in sets.values()) for s in sets.values() for h in s}

    def use(v, size, hashes, classes):
        ends = np.append(0, np.cumsum(size))
        return pa.table({"v": v, "h": [hashes[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)], "c": [classes[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    frame = spark.createDataFrame([(v, np.array(s, np.uint64).tobytes()) for v, s in sets.items()] * 2, "v long, hashes binary").repartition(3)
    got = {x["v"]: dict(zip(x["h"], x["c"], strict=True)) for x in with_classes(frame, 8, use, "v long, h array<long>, c array<long>").collect()}
    # keys are 32 bits of a hash and its range: small neighbours share theirs, and count together
    key = lambda h: (h >> 20 & 0xFFFFFFFF, h & 7)
    seen = {}
    for v, s in sets.items():
        for h in s:
            seen.setdefault(key(h), set()).add(v)
    assert got == {v: {h: int(frequency_class(np.array([len(seen[key(h)])]))[0]) for h in s} for v, s in sets.items()}
    assert all(df[h] <= len(seen[key(h)]) for h in df)


def test_token_counts(docs, nothing):
    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((i, len((t or "").encode()), n := len(k.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in _awkward()), key=str)
    assert sorted((tuple(r) for r in token_counts(docs).collect()), key=str) == want
    assert token_counts(nothing).count() == 0


def test_token_counts_of_runs_without_white_space(spark, monkeypatch):
    from slatewise.llm import token_counts as T
    from slatewise.llm.tokenization import Counts

    k = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" * 5000, "ab1" * 3000, "日本語" * 900, "-=" * 2000, "x" * 700 + "<|endoftext|>" + "don't" * 600, "é" * 3000 + " b", "12" * 4000 + "'s", "the" * 2000 + "\n" + "q" * 3]
    counts = Counts(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=100)
    want = [len(k.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [n for _, n in sorted(counts.count_batch(list(enumerate(texts))))] == want
    monkeypatch.setattr(T, "PIECE", 50)
    rows = [(n, t) for n, t in enumerate(texts)]
    assert [r["n_tokens"] for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == want
    a, b = Counts.of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), Counts.of(public_tokenizers.path("byte_bpe_50k.json"), r"\S+|\s+")
    assert a is not b


def test_sharding(docs, nothing):
    got = interleaved_shards(docs, shards=5).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in _awkward()), key=str)
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(5)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert interleaved_shards(nothing).count() == 0
    # every shard has each source's share, to one row of its own at each cut and what the other sources' cuts shift
    source, total = {}, {}
    for i, t, _, s, *_ in _awkward():
        source[i, len((t or "").encode()) + 1] = s or ""
        total[s or ""] = total.get(s or "", 0) + 1
    by = {}
    for r in got:
        key = r["shard"], source[r["doc_id"], r["size"]]
        by[key] = by.get(key, 0) + 1
    assert all(abs(by.get((k, s), 0) - n / 5) <= 1 + len(total) * n / len(got) for s, n in total.items() for k in range(5))
    text = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t or "" for i, t, *_ in _awkward()}
    named = {}
    for r in got:
        named.setdefault(r["group_id"], set()).add(text[r["doc_id"], r["size"], r["text_crc32"]])
    assert all(len(x) == 1 for x in named.values()) and len(named) == len(set(text.values()))


def test_packing(docs, nothing):
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((np.array(k.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t, *_ in _awkward()))
    got = packed_sequences(docs, window=64).collect()
    assert sum(r["length"] for r in got) == sum(len(x) // 4 for x in want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for s, rows in by.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 64 or s == max(by)
    texts = {}
    for i, t, *_ in _awkward():
        texts.setdefault(i, set()).add(t or "")
    for i, own in texts.items():
        if len(own) == 1:
            a = np.array(k.encode(next(iter(own)), add_special_tokens=False).ids + [1], "<u4")
            for r in got:
                if r["doc_id"] == i:
                    assert r["ids_crc32"] == zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(a)
    assert packed_sequences(nothing).count() == 0


@pytest.mark.parametrize("quantum", [1, 16])
def test_packing_is_deficit_round_robin(spark, docs, monkeypatch, quantum):
    """Every window holds what a plain simulation of the queues' accounts sends in it."""
    from slatewise.llm import packing

    monkeypatch.setattr(packing, "GROUP_ROWS", 4)
    weights = {"hot": 5.0, "s0": 1.0, "": 2.0, "s3": 0.25}
    got = packed_sequences(docs, window=64, quantum=quantum, weights=weights).collect()
    totals, sent_in = {}, {}
    for r in got:
        totals[r["source"]] = totals.get(r["source"], 0) + r["length"]
        sent_in[r["sequence_id"], r["source"]] = sent_in.get((r["sequence_id"], r["source"]), 0) + r["length"]
    names = sorted(totals)
    w = np.array([weights.get(s, 0.0) for s in names])
    w = np.maximum(w, w.sum() * 1e-6)
    left = {s: totals[s] // quantum for s in names}
    sent, want, places = dict.fromkeys(names, 0), {}, 0
    while any(left.values()):
        # each account earns until one is owed half a quantum
        s = min((s for s in names if left[s]), key=lambda s: ((sent[s] + 0.5) / w[names.index(s)], names.index(s)))
        left[s] -= 1
        sent[s] += 1
        want[places // 64, s] = want.get((places // 64, s), 0) + quantum
        places += quantum
    for s in names:
        for _ in range(totals[s] % quantum):
            want[places // 64, s] = want.get((places // 64, s), 0) + 1
            places += 1
    assert sent_in == want
    share = w / w.sum()
    for r in got:
        before = sum(n for (k, s), n in want.items() if s == r["source"] and k < r["sequence_id"])
        assert abs(r["deficit"] - (share[names.index(r["source"])] * 64 * r["sequence_id"] - before)) < 1e-6 or before == totals[r["source"]] // quantum * quantum


def test_packing_with_more_sources_than_queues(spark, docs, monkeypatch):
    from slatewise.llm import packing

    want = {(r["doc_id"], r["doc_tokens"]): 0 for r in packed_sequences(docs, window=64).collect()}
    monkeypatch.setattr(packing, "CHUNK", 50)
    got = packed_sequences(docs, window=64, most_queues=3).collect()
    every = packed_sequences(docs, window=64, most_queues=None).collect()
    plain = lambda rows: sorted(map(str, rows))
    assert {r["sequence_id"] for r in got} == {r["sequence_id"] for r in every} and plain(every) == plain(packed_sequences(docs, window=64).collect())
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == set(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, own in by.items():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and (ends[-1] == 64 or k == max(by))


@pytest.mark.parametrize("window", [27, 140, 150, 200, 300])
def test_repeats_of_any_window(spark, window):
    r = random.Random(window)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 60, 90, 150, 300)] + ["ab" * 400, "x" * 500]
    texts = ["".join(r.choice([r.choice(passages), " ".join(word() for _ in range(r.randint(1, 40)))])[r.randint(0, 9) :] + " " for _ in range(r.randint(0, 5))) for _ in range(60)] + [None, passages[4], passages[4]]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=window).collect()}
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            first[b[p : p + window]] = min(i, first.get(b[p : p + window], i))
    removed = 0
    for i, t in rows:
        b = (t or "").encode()
        out = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < i:
                out[p : p + window] = True
        removed += int(out.sum())
        assert got[i]["n_removed"] == out.sum() and got[i]["kept_sha256"] == hashlib.sha256(bytes(x for x, gone in zip(b, out, strict=True) if not gone)).hexdigest()
        assert got[i]["n_spans"] == (np.diff(np.append(0, out.astype(int))) == 1).sum()
    assert removed > 1000


def test_keys_beyond_a_byte_are_front_coded():
    keys = sorted([b"a" * 300, b"a" * 256 + b"b" * 300, b"a" * 255, b"", b"b" * 65_535])
    assert [k for k, _ in decode(*front_code(keys))] == keys
    with pytest.raises(ValueError):
        front_code([b"a" * 65_536])


@pytest.mark.parametrize("queues", [100, 1000, 4096])
def test_packing_of_many_queues(queues):
    """Places and deficits equal a merged order of all quanta; cost follows the quanta of the documents, not windows x queues."""
    import time
    import tracemalloc

    from slatewise.llm.packing import _pieces

    r = np.random.default_rng(queues)
    totals = r.integers(0, 60_000, queues)
    totals[:3] = [3_000_000, 256, 255]
    weights = np.maximum(totals, 1).astype(float)
    plan = Schedule(totals // 256, weights)
    queue = np.concatenate([np.zeros(60, np.int64), r.integers(0, queues, 140)])
    at = (totals[queue] * r.random(200) * 0.9).astype(np.int64)
    n = np.minimum(2000, totals[queue] - at)
    queue, at, n = queue[n > 0], at[n > 0], n[n > 0]
    tracemalloc.start()
    began = time.process_time()
    doc, start, length, seq, offset, deficit = _pieces(plan, totals, queue, n, at, 2048, 256)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 10 and peak < 500 << 20
    assert np.bincount(doc, length).astype(int).tolist() == n.tolist()
    times = np.concatenate([(np.arange(t // 256) + 0.5) / w for t, w in zip(totals, weights, strict=True)])
    owner, number = np.repeat(np.arange(queues), totals // 256), np.concatenate([np.arange(t // 256) for t in totals])
    order = np.lexsort((owner, times))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin = np.cumsum(totals // 256) - totals // 256
    whole = totals // 256 * 256
    window_of, sent = place // 8, {}
    for d, a, m, s, o, x in zip(doc, start, length, seq, offset, deficit, strict=True):
        q = queue[d]
        for token in (at[d] + a, at[d] + a + m - 1):
            if token < whole[q]:
                p = place[begin[q] + token // 256]
                assert p // 8 == s and p % 8 * 256 + token % 256 == o + token - at[d] - a
        if at[d] + a < whole[q]:
            own = window_of[begin[q] : begin[q] + totals[q] // 256]
            assert abs(x - (weights[q] / weights.sum() * 2048 * s - np.searchsorted(own, s) * 256)) < 1e-6
    assert len(number) == len(times)


def test_schedule_holds_the_mixture():
    plan = Schedule(np.array([1000, 300, 7, 40_000]), np.array([5.0, 1.0, 0.01, 3.0]))
    places = np.arange(0, 41_308, 64)
    sent = plan.sent(places)
    assert (sent.sum(1) == places).all() and (np.diff(sent, axis=0) >= 0).all() and (sent[-1] <= plan.totals).all()
    assert abs(sent[5, 0] - 320 * 5 / 9.01) < 3


def test_quality(spark, docs, nothing):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + ("%%%" if bad else "") for w in words)))
        labels.append((i, int(not bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit_rules(d, lab)
    got = {x["doc_id"]: x for x in quality_scores(d, model).collect()}
    assert all(got[i]["predicted"] == q for i, q in labels) and all(0 <= x["score"] <= 1 for x in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert quality_scores(docs, model).count() == len(_awkward()) and quality_scores(nothing, model).count() == 0
    assert keep_quality(docs, RuleEnsemble(5.0)).columns == docs.columns and keep_quality(docs, RuleEnsemble(-5.0)).count() == 0
    assert fit_rules(d, lab.filter("false")).score() is not None


def test_compiled_rules_equal_rules_by_hand(spark, docs):
    import math
    import re

    from slatewise.llm.quality import Rule

    def by_hand(t):
        n = max(len(t), 1)
        words, lines = re.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
        share = lambda p: (len(t) - len(re.sub(p, "", t))) / n
        return {"log_length": math.log1p(n), "digits": share("[0-9]+"), "stops": t.count(".") / n, "commas": t.count(",") / n, "word_length": n / len(words), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines), "breaks": t.count("\n") / n}

    rules = {Rule((("word_length", True, 6.2),)): 1.25, Rule((("distinct_words", False, 0.5), ("log_length", True, 6.0))): -2.0, Rule((("digits", False, 0.05), ("commas", False, 0.01))): 0.75, Rule((("log_length", False, 5.5), ("log_length", True, 7.0))): 0.5}
    model = RuleEnsemble(-0.3, rules)
    got = sorted(((str(r["doc_id"]), round(r["score"], 9)) for r in quality_scores(docs, model).collect()))
    want = []
    for i, t, *_ in _awkward():
        x = by_hand(t or "")
        z = -0.3 + sum(w for r, w in rules.items() if all(x[n] <= v if upper else x[n] > v for n, upper, v in r.bounds))
        want.append((str(i), round(1 / (1 + math.exp(-z)), 9)))
    assert got == sorted(want)
    kept = sorted(str(r["doc_id"]) for r in keep_quality(docs, model, threshold=0.5).collect())
    assert kept == sorted(i for i, s in want if s >= 0.5)


def test_tree_paths_become_rules():
    from slatewise.llm.quality import Rule, tree_rules

    told = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 1 <= 2.0)\n      Predict: 0.0\n     Else (feature 1 > 2.0)\n      Predict: 1.0\n    Else (feature 0 > 0.5)\n     Predict: 1.0\n"
    a, b, c, d = (("x", True, 0.5),), (("x", True, 0.5), ("y", True, 2.0)), (("x", True, 0.5), ("y", False, 2.0)), (("x", False, 0.5),)
    assert tree_rules(told, ["x", "y"]) == [Rule(a), Rule(b), Rule(c), Rule(d)]


def test_sentencepiece_round_trip(docs, nothing):
    import sentencepiece

    from slatewise.llm.sentences import decoded, encoded

    k = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((i, len((t or "").encode()), len(ids := k.encode(t or "")), zlib.crc32(np.array(ids, "<u4").tobytes()), k.decode(ids)) for i, t, *_ in _awkward()), key=str)
    assert sorted((tuple(r) for r in decoded(encoded(docs)).collect()), key=str) == want
    assert encoded(nothing).count() == 0


def test_streams_of_merges_equal_the_library():
    from slatewise.llm.sentences import Codec

    c = Codec.of(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(7)
    words = [c.library.id_to_piece(r.randrange(300, 32000)).replace("▁", " ") for _ in range(500)]
    texts = ["a" * 9000, "日本語のテキスト" * 300, " " * 37, "x" + " " * 19 + "y", "  a  b   c ", "\t\t\n\n x", "▁a▁ b", "-" * 100, "\x00a\x00", "<s>hi</s> <0x41>", "1234567890" * 90]
    texts += ["".join(r.choice("abcdest n  ▁\n.é日-=0") for _ in range(r.randint(1, 60))) for _ in range(600)]
    texts += ["".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(400)]
    for t in texts:
        assert c.encode(t) == c.library.encode(t), t[:80]
    # the window: what is held never grows with the text
    most = 0
    for n, _ in enumerate(c.paths.segments("ab日" * 5000 for _ in range(3))):
        most = max(most, len(c.paths.links))
    assert n > 1000 and most <= 8 * c.paths.longest


def test_streaming_viterbi_is_the_best_path():
    from slatewise.llm.sentences import StreamingViterbi

    r = random.Random(1)
    pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))): -r.random() * 5 for _ in range(60)}
    v = StreamingViterbi(pieces)
    for _ in range(50):
        s = "".join(r.choice("abcd") for _ in range(r.randint(0, 120)))
        out = list(v.segments([s[i : i + 7] for i in range(0, len(s), 7)]))
        best = [0.0]
        for a in range(1, len(s) + 1):
            best.append(max(best[b] + pieces.get(s[b:a], -100.0 if a - b == 1 else -1e18) for b in range(max(0, a - 5), a)))
        assert "".join(out) == s and abs(sum(pieces.get(o, -100.0) for o in out) - best[-1]) < 1e-6


def test_licences(spark, docs, nothing):
    from slatewise.llm.licences import licence_scan

    rows = [(1, "Copyright 2020 Somebody\nlicensed under the mit licence"), (2, "text\nAll rights reserved.\nLICENSED UNDER CC BY-NC 4.0\n"), (3, None), (4, ""), (2, "text\nAll rights reserved.\nLICENSED UNDER CC BY-NC 4.0\n"), (None, "All rights reserved")]
    got = sorted((tuple(r) for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, "MIT", 1, "MIT"), (2, None, 2, "CC-BY-NC-4.0,Proprietary"), (2, None, 2, "CC-BY-NC-4.0,Proprietary"), (3, None, 0, ""), (4, None, 0, ""), (None, "Proprietary", 1, "Proprietary")], key=str)
    assert licence_scan(docs).count() == len(_awkward()) and licence_scan(nothing).count() == 0


def test_licences_of_every_given_wording_and_whole_text(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    from slatewise.llm import licences as L

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    lines = {line for t in texts for line in (t or "").split("\n") if "licensed under" in line.lower() or "released under" in line.lower() or "rights reserved" in line.lower()}
    want = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    assert lines == set(want)
    wordings = [*want.items(), ("Licensed under the GNU GPL v3.0", "GPL-3.0"), ("this work is released under the MIT licence", "MIT"), ("Licensed under the GNU General Public License v2.0", None), ("Licensed under Creative  Commons\nAttribution 4.0", "CC-BY-4.0"), ("licensed under the apache license, version\t2.0", "Apache-2.0"), ("SPDX-License-Identifier: MIT", "MIT"), ("all conversion 3 rights reserved", None)]
    got = {r["doc_id"]: r for r in L.licence_scan(spark.createDataFrame([(n, w) for n, (w, _) in enumerate(wordings)], "doc_id long, text string")).collect()}
    assert [got[n]["text_licence"] for n in range(len(wordings))] == [x for _, x in wordings]
    assert [got[n]["n_lines"] for n in range(len(wordings))] == [int(x is not None and "\n" not in w) for w, x in wordings]
    assert all(L.canonical_text(w) == r["c"] for w, r in zip([w for w, _ in wordings] + ["a Licence\n(c) me\nlicence"], spark.createDataFrame([(n, w) for n, w in enumerate([w for w, _ in wordings] + ["a Licence\n(c) me\nlicence"])], "n long, t string").select("n", L.canonical(F.col("t"))[0].alias("c")).orderBy("n").collect(), strict=True))

    whole = {p.name.split(".txt")[0].removesuffix(".university"): p.read_text() for p in sorted((Path(L.__file__).parent / "licence_texts").glob("*.txt"))}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"} <= set(whole)
    copies = [(k, t) for k, t in whole.items()] + [("MIT", "Copyright 2021 A. Person\n\n" + whole["MIT"].split("\n\n", 2)[2]), ("Apache-2.0", whole["Apache-2.0"].split("   APPENDIX")[0]), (None, whole["MIT"] + "but not for you")]
    found = {r["doc_id"]: r["text_licence"] for r in L.licence_scan(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(copies)], "doc_id long, text string")).collect()}
    assert [found[n] for n in range(len(copies))] == [k for k, _ in copies]
