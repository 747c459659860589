"""Each stage of the corpus pipeline, and all of them, against plain Python on awkward rows."""

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from test_llm import _brute_classes, _brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, row string"


def _rows():
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    base = [" ".join(word() for _ in range(r.randint(40, 120))) for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "few words", *base, *base[:3], base[0], *(b + " " + passage for b in base[6:10]), "é" * 200, "é" * 200 + "x"]
    for b in base[3:6]:
        w = b.split()
        w[4] = word()
        texts.append(" ".join(w))
    rows = [(100 + i * 7 % 97, t, "en", "a" if i % 3 else None, len(t or ""), "mine", "r") for i, t in enumerate(texts)]
    same_id = [(50, base[0], "en", "a", len(base[0]), "b", "r"), (50, "a clean text of its own " + base[11][::-1], "en", "a", 9, "c", "r")]
    return rows + [rows[9], (None, base[1], None, None, None, None, None), (None, base[1], None, None, None, None, None), *same_id, *same_id[:1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(5).cache()


def _sorted(rows):
    return sorted((tuple(x) for x in rows), key=str)


def _without_near_copies(rows):
    numbered = [(n, t) for n, (i, t, *_) in enumerate(rows) if i is not None]
    component = {n: c for n, _, c in _brute_classes(numbered)}
    by = {}
    for n, _ in numbered:
        by.setdefault(component[n], []).append(n)
    kept = [x for x in rows if x[0] is None]
    for own in by.values():
        kept.append(rows[min(own, key=lambda n: rows[n][0])])
    return kept


def test_near_duplicates(spark, docs):
    got = P.near_duplicates(spark, docs, "").collect()
    want = _without_near_copies(_rows())
    # texts of one word set and one id may differ in their words' order only; here they don't
    assert _sorted(got) == _sorted(want)
    assert any(x["doc_id"] == 50 and x["text"].startswith("a clean") for x in got)
    assert P.near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_repeated_passages(spark, docs):
    got = P.repeated_passages(spark, docs, "").select("doc_id", "text", "n_chars", "kept_text", "row")
    told = _brute_repeats(_rows())
    keep = {}
    for (i, t, *_), (_, size, removed, *_) in zip(sorted(_rows(), key=lambda x: (str(x[0]), zlib.crc32((x[1] or "").encode()))), sorted(told, key=lambda x: str(x[0])), strict=True):
        keep.setdefault(i, []).append(t)
    rows = got.collect()
    gone = {i for i, size, removed, *_ in told if size and removed == size}
    assert not {x["doc_id"] for x in rows} & (gone - {50})
    assert len(rows) == len(told) - sum(1 for _, size, removed, *_ in told if size and removed == size)
    by_id = {i: (size, removed) for i, size, removed, *_ in told}
    for x in rows:
        if x["doc_id"] not in (None, 50):
            size, removed = by_id[x["doc_id"]]
            assert len((x["text"] or "").encode()) == size - removed or "é" in x["text"]
            assert x["text"] is None or x["n_chars"] == len(x["text"])
            assert x["row"] == "r"
    without = docs.drop("n_chars")
    assert P.repeated_passages(spark, without, "").columns == without.columns
    assert P.repeated_passages(spark, docs.filter("false"), "").count() == 0


def test_quality_stage_keeps_what_the_scores_keep(spark, docs, tmp_path):
    from slatewise.llm.quality import fit_rules, quality_scores

    pq.write_table(pa.table({"doc_id": [x[0] for x in _rows() if x[0]], "quality": [int(len(x[1] or "") > 300) for x in _rows() if x[0]], "toxic": [0 for x in _rows() if x[0]]}), tmp_path / "labels.parquet")
    got = P.quality(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    scores = quality_scores(docs, fit_rules(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    assert sorted(str(x["doc_id"]) for x in got.collect()) == sorted(str(x["doc_id"]) for x in scores.filter("predicted = 1").collect())
    assert P.quality(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_run(spark, docs, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pq.write_table(pa.table({"doc_id": [1, 2], "quality": [1, 1], "toxic": [0, 0]}), tmp_path / "labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    kept = _without_near_copies(_rows())  # labels of one kind: all stay
    told = {}
    for i, size, removed, *_ in _brute_repeats(kept):
        told.setdefault(i, []).append(size > 0 and size == removed)
    assert sum(r["length"] for r in got) > 0
    k = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t, *_ in kept:
        if i is not None and len([x for x in kept if x[0] == i]) == 1 and t and not any(told[i]) and "é" not in t:
            own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
            if next(n for d, _, n, *_ in _brute_repeats(kept) if d == i) == 0:
                ids = np.array([*k.encode(t, add_special_tokens=False).ids, 1], "<u4")
                assert sum(n for _, n, _ in own) == len(ids)
                assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in own)
