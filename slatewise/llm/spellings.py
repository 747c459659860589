"""Operator 13: words grouped with their spelling variants at one edit, by dynamic programming over sorted lists."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.session import workers_see, written

#: Bytes of a text that are split at once in a task.
SLICE = 1 << 20
#: Words a task counts before it sends their counts on.
HELD = 1 << 17
#: A list of more words is cut further, until its words agree in all but one place (some 8,200 words at most).
LIST = 256
#: Latin-1 bytes: A-Z in lower case, other letters of the runs as they are, everything else blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
KEY = ("least", "low", "high", "prefix", "suffix")


def runs(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of letters up to U+00FF, A-Z lower-cased, one byte a code point, some SLICE bytes at a time; no run is cut."""
    data, at = text.encode("latin-1", "replace").translate(LETTERS), 0
    while at < len(data):
        to = data.find(b" ", at + SLICE) if at + SLICE < len(data) else -1
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def word_counts(docs: DataFrame, *, least: int = 7, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least `least` code points in all texts.

    Words are runs of letters; where crc32 of `<id>:<run>` is a multiple of `every`, a word lacks the code point at that
    number modulo its length, as a slip of the pen would leave it (`every` = 0: none does). A null text has no words, a null id counts as an empty one.
    """
    workers_see(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for part in runs(text.as_py() or ""):
                    for word, n in Counter(w for w in part if len(w) >= least).items():
                        h = zlib.crc32(_utf8(word), own) if every else 1
                        if every and h % every == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                    if len(held) >= HELD:
                        yield sent()
        yield sent()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(i, j, common prefix) of all i < j of a sorted list of distinct words that differ by exactly one inserted, deleted or replaced byte.

    Each word scans the list behind it with the band of three of its edit matrix. Rows are kept by depth, and a word reuses those of the prefix
    it shares with the word before. Where a row holds nothing below two edits, all words with that prefix are passed over.
    """
    n = len(words)
    common = [0] * n
    for j in range(1, n):
        a, b = words[j - 1], words[j]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        common[j] = k
    for i in range(n - 1):
        q = words[i]
        size = len(q)
        shared = size  # of q with the word at j, as the least of the prefixes between
        rows = [(2, 0, 1)]
        dead = 1 << 30
        j = i + 1
        while j < n:
            c = common[j]
            if c < shared:
                shared = c
            if c >= dead:
                j += 1
                continue
            dead = 1 << 30
            del rows[c + 1 :]
            v = words[j]
            m = len(v)
            d = len(rows) - 1
            a, b, e = rows[-1]
            while d < m:
                x = v[d]
                # a, b, e: edits between v[:d] and q[:d-1], q[:d], q[:d+1]
                a = min(a + (q[d - 1] != x) if 0 < d <= size else 2, b + 1) if d <= size else 2
                b = min(b + (q[d] != x), e + 1, a + 1) if d < size else 2
                e = min(e + (q[d + 1] != x), b + 1) if d + 1 < size else 2
                d += 1
                if a > 1 and b > 1 and e > 1:
                    dead = d
                    break
                rows.append((a, b, e))
            else:
                off = size - m
                if -2 < off < 2 and (a, b, e)[off + 1] == 1:
                    yield i, j, shared
            j += 1


def _lists(words: DataFrame) -> DataFrame:
    """Add what the words of one list share: the places outside [low, high) of the shorter word of a pair."""
    after = F.col("least") - F.col("high")
    return words.withColumn("prefix", F.substring("word", F.lit(1), F.col("low"))).withColumn("suffix", F.when(after > 0, F.substring("word", -after, after)).otherwise(F.lit("")))


def near_words(words: DataFrame, *, least: int = 7, most: int = LIST) -> DataFrame:
    """(word, n_near, form, form_n): how many near words each word of `words` (word, n; distinct) has, and the one of largest n, ties
    to the smaller; words without one are left out.

    A pair's shorter word has `least` places, and the first place where the two differ falls in one span of them; outside it
    they agree. So each word goes to the list of each span (two halves at first) under what stands outside, as the shorter
    and as the longer one. A list of more than `most` words is cut by halving its span again, down to one place, where lists are
    bounded by the alphabet: no list grows with the vocabulary, and no pair is found twice or lost.
    """
    spark = words.sparkSession
    length = F.length("word")
    sides = F.explode(F.when(length > least, F.array(length, length - 1)).otherwise(F.array(length)))
    spans = words.select("word", "n", sides.alias("least"))

    def halves(df: DataFrame, low: Column, high: Column) -> DataFrame:
        mid = F.floor((low + high) / 2).cast("int")
        return df.select("word", "n", "least", F.explode(F.array(F.struct(low.alias("low"), mid.alias("high")), F.struct(mid.alias("low"), high.alias("high")))).alias("span")).select("word", "n", "least", "span.*")

    todo, found = halves(spans, F.lit(0), F.col("least")), []
    while True:
        todo = _lists(todo)
        sizes = todo.groupBy(*KEY).agg(F.count("*").alias("size")).filter("size > 1")
        sized = written(todo.join(sizes, list(KEY)).select("word", "n", *KEY, "size"), "spelling-lists")
        large = (F.col("size") > most) & (F.col("high") - F.col("low") > 1)
        found.append(sized.filter(~large))
        todo = halves(sized.filter(large), F.col("low"), F.col("high"))
        if todo.isEmpty():
            break
    lists = found[0]
    for more in found[1:]:
        lists = lists.unionByName(more)
    lists = lists.repartition(*KEY).sortWithinPartitions(*KEY)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        key = None

        def near() -> tuple[list, list, list, list]:
            told: dict[int, list] = {}
            shorter, low, high = key[:3]
            own = [(w[low : len(w) - (shorter - high)].encode("latin-1"), w, n) for w, n in held]
            own.sort()  # by the places that may differ
            inner = [x for x, _, _ in own]
            held[:] = [x[1:] for x in own]
            for i, j, same in near_pairs(inner):
                (a, n_a), (b, n_b) = held[i], held[j]
                at = low + same
                if min(len(a), len(b)) != shorter or (at >= high and high < shorter):
                    continue  # a pair of another length, or one that the list of a later span finds
                for one, other, n in ((i, b, n_b), (j, a, n_a)):
                    best = told.get(one)
                    if best is None:
                        told[one] = [1, n, other]
                    else:
                        best[0] += 1
                        if n > best[1] or (n == best[1] and other < best[2]):
                            best[1:] = n, other
            return [held[i][0] for i in told], [b[0] for b in told.values()], [b[1] for b in told.values()], [b[2] for b in told.values()]

        out: tuple[list, list, list, list] = ([], [], [], [])

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "k", "n", "near"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for word, n, *own in zip(*columns, strict=True):
                if own != key:
                    if len(held) > 1:
                        for column, more in zip(out, near(), strict=True):
                            column.extend(more)
                        if len(out[0]) > 10_000:
                            yield sent()
                    held, key = [], own
                held.append((word, n))
        if len(held) > 1:
            for column, more in zip(out, near(), strict=True):
                column.extend(more)
        yield sent()

    near = lists.select("word", "n", *KEY).mapInArrow(scanned, "word string, k long, n long, near string")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("word")))
    near = near.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("best"))
    workers_see(spark)
    return near.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def spelling_variants(docs: DataFrame, *, least: int = 7, least_n: int = 2, every: int = 31, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `docs` with at least `least` code points and `least_n` occurrences.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. `form` is the near word of largest
    n, ties to the smaller in code-point order, if its n is at least `times` the word's (`times` > 1); `root` is where the chain of forms ends.

    Null and empty texts have no words; repeated rows count as often as they stand; a null id counts as an empty one. Further
    columns of `docs` are ignored. An empty table, or one without such words, gives an empty table.

    Texts are read once; only counts of words are shuffled. n grows `times`-fold along a chain, so few rounds of
    doubling reach its end.
    """
    words = written(word_counts(docs, least=least, every=every, id_col=id_col, text_col=text_col).filter(F.col("n") >= least_n), "spelling-words")
    near = near_words(words, least=least)
    rows = words.join(near.withColumnRenamed("form", "_form").withColumnRenamed("form_n", "_form_n"), "word", "left")
    good = F.col("_form_n") >= F.lit(times) * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("_form")).alias("form"), F.when(good, F.col("_form_n")).alias("form_n"))
    rows = written(rows, "spelling-forms")
    ends = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = written(ends.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "spelling-roots")
        ends = longer.select("word", "root")
        if longer.filter("_moved").isEmpty():
            break
    out = rows.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
