"""Operator 11: importance resampling towards a target distribution of hashed word n-grams."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import workers_see, written

#: Bytes of a text that are split at once in a task.
SLICE = 1 << 20
#: Words a task remembers with their bucket or gain; it forgets them all where there are more.
REMEMBERED = 1 << 17
#: Rows of one group of the final order, on average.
GROUP_ROWS = 1 << 12
MOST_GROUPS = 1 << 12
#: A-Z in lower case; every other byte below 128 that is no letter or digit becomes a blank; the rest stays.
BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_slices(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text, some SLICE bytes at a time; no word is cut."""
    data = text.encode("utf-8", "surrogatepass").translate(BLANKED)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + SLICE) if at + SLICE < len(data) else -1
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


class _Memory(dict):
    """What a function gives for a word, remembered up to REMEMBERED words."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = self.of(word)
        return value


def _features(text: str, longest: int, seeds: _Memory) -> Iterator[list[int]]:
    """crc32 of every run of 1 to `longest` words joined by one space: each longer run starts from the crc of the one before it."""
    before: list[bytes] = []  # the last words of the slice before
    for words in word_slices(text):
        yield list(map(seeds.__getitem__, words))
        if longest > 1:
            joined = before + words
            crcs = list(map(seeds.__getitem__, joined))
            for n in range(1, longest):
                crcs = list(map(zlib.crc32, (b" " + w for w in joined[n:]), crcs))
                yield crcs[max(0, len(before) - n) :]  # runs that end before this slice have been given
            before = joined[-(longest - 1) :]


def bucket_counts(texts: DataFrame, *, buckets: int = 10_000, longest: int = 1, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall in each bucket that any does.

    Each task holds one count per bucket and sends them at its end. Null texts have none.
    """
    workers_see(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, total = _Memory(zlib.crc32), np.zeros(buckets, np.int64)
        held: Counter[bytes] | Counter[int] = Counter()

        def poured() -> None:
            crcs = np.fromiter(map(seeds.__getitem__, held) if longest == 1 else held, np.int64, len(held))
            np.add.at(total, crcs % buckets, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                for part in word_slices(text.as_py() or "") if longest == 1 else _features(text.as_py() or "", longest, seeds):
                    held.update(part)
                    if len(held) >= REMEMBERED:
                        poured()
        poured()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket, from the bucket counts of the corpus and of the target: floor(1000 ln of the smoothed ratio)."""
    s, t = [0] * buckets, [0] * buckets
    for counts, held in ((raw, s), (target, t)):
        for r in counts.collect():  # one row a bucket
            held[r["bucket"]] = r["n"]
    all_s, all_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(((b + 1.0) * (all_s + buckets)) / ((a + 1.0) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)]


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a row's id, in thousandths."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(told, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of `docs`; `rank` (from 1) is set for the rows that are drawn.

    Words are runs of letters and digits of ASCII and of all bytes beyond it, A-Z lower-cased. Features are all runs of 1 to
    `longest` words, hashed into `buckets` by crc32. `weight` sums the gains of a text's features, how much likelier each bucket is in `target`
    than in `docs`, and `score` adds seeded Gumbel noise, so that the highest scores are a draw without replacement by
    importance. Of the rows with at least `least_words` words `percent` in 100 are drawn (rounded down), ties to smaller ids.

    A null or empty text has no features and weight 0; a null id draws the noise of the empty id and stands first among ties.
    Repeated rows are counted, and drawn, row by row; rows alike in id and score are interchangeable. Further columns of
    `docs` and `target` are ignored. Empty tables give gains of an empty count; an empty `docs` gives an empty table.

    Texts are read twice and never shuffled: what is counted is one number a bucket and task, and what goes to the tasks again
    is one gain a bucket. The final order is cut at quantiles of the score, so that no task sorts more than a group of rows.
    """
    spark = docs.sparkSession
    workers_see(spark)
    kind = dict(docs.dtypes)[id_col]
    raw, wanted = (bucket_counts(df, buckets=buckets, longest=longest, text_col=text_col) for df in (docs, target))
    gains = bucket_gains(raw, wanted, buckets)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _Memory(zlib.crc32)
        worth = _Memory(lambda w: gains[zlib.crc32(w) % buckets])
        for batch in batches:
            n, words, weight = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                if longest == 1:
                    parts = [(len(p), sum(map(worth.__getitem__, p))) for p in word_slices(text)]
                    n.append(sum(k for k, _ in parts))
                    words.append(n[-1])
                else:
                    parts = [(len(p), sum(gains[c % buckets] for c in p)) for p in _features(text, longest, seeds)]
                    n.append(sum(k for k, _ in parts))
                    words.append(sum(k for k, _ in parts[::longest]))
                weight.append(sum(w for _, w in parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, words, weight))], ["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(weighed, f"doc_id {kind}, n_features long, n_words long, weight long")
    rows = written(rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "importance-scores")
    fit = rows.filter(F.col("n_words") >= least_words)
    n = fit.count()
    drawn = percent * n // 100
    found = _ranked(fit, drawn, n).unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(rows: DataFrame, drawn: int, n: int) -> DataFrame:
    """Set `rank` of the `drawn` first of `n` rows by falling score, ties to smaller ids.

    Rows fall in groups between quantiles of the score; the counts of the groups before give each group's start, and only
    groups that begin before the last drawn row are put in order.
    """
    groups = max(1, min(MOST_GROUPS, n // GROUP_ROWS))
    if drawn == 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    cuts = -np.array(sorted(set(rows.approxQuantile("score", [i / groups for i in range(1, groups)], 0.25 / groups)), reverse=True) if groups > 1 else [])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cuts, -batch.column("score").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "part"])

    rows = rows.mapInArrow(grouped, rows.schema.simpleString()[len("struct<") : -1] + ",part:int")
    sizes = rows.groupBy("part").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # MOST_GROUPS rows at most
    start = sizes.select("part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    rows = rows.join(F.broadcast(start), "part")
    place = F.col("_start") + F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    first = rows.filter(F.col("_start") < drawn).withColumn("rank", F.when(place <= drawn, place))
    return first.unionByName(rows.filter(F.col("_start") >= drawn).withColumn("rank", F.lit(None).cast("long"))).drop("part", "_start")
