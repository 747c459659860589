"""Operator 4: removal of byte strings repeated across documents, by merging sorted suffix runs."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.anchors import Anchors, anchors
from slatewise.llm.arrays import prefix_hash, ranges, span_hash, text_bytes
from slatewise.llm.loser_tree import decode, front_code, merge
from slatewise.llm.rows import row_key
from slatewise.llm.shared_hashes import range_count, shared_tokens, tokens_of
from slatewise.session import workers_see, written

#: Bytes of text looked at together in a task.
SLICE = 1 << 20
#: Suffixes that a task sorts as one run.
RUN = 200_000
#: Bytes of text sampled for the borders of the key ranges.
SAMPLED = 16 << 20
#: Windows compared byte by byte at once where runs of one anchor differ.
WINDOWS = 1 << 16
#: Merged entries held before their spans are told.
HELD = 1 << 14
#: Column of a carried row that tells whether its text is null.
_NULL = "_text_is_null"
#: Ends the right part of a key; UTF-8 never holds it.
MARK = b"\xff"


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of parts of a text column."""
    data, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE)) - 1), len(offsets) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _keys(raw: bytes, a: Anchors, window: int) -> list[bytes]:
    """Suffixes from the anchors up to the end of their run, then what lies left of the anchor, backwards."""
    return [raw[p : h + window] + MARK + raw[lo:p][::-1] for p, h, lo in zip(a.place.tolist(), a.high.tolist(), a.low.tolist(), strict=True)]


def repeated_spans(docs: DataFrame, *, window: int = 50, gram: int = 26) -> DataFrame:
    """(doc_id, row_key, text, row, copy, spans): for each row of (doc_id, row_key, text, row) what repeats an earlier document.

    `spans` are start << 24 | length of byte spans covered by `window`-byte strings that also start in a
    document with a smaller id; `copy` marks rows whose whole text does. `row` is carried along. See `without_repeats`.
    """
    spark = docs.sparkSession
    workers_see(spark)
    parts = range_count(spark)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _slices(batch.column(1)):
                a = anchors(data, offsets, window, gram)
                cut = np.searchsorted(a.row, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), pa.array([a.hash[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["v", "prefix"])

    known = docs.filter("doc_id is not null").withColumn("v", F.xxhash64("text"))
    shared = shared_tokens(known.select("v", "text").mapInArrow(hashes, "v long, prefix binary"), parts)
    # equal texts: one of the smallest id stands for all
    each = known.select("doc_id", "row_key", "v", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))
    # written, so that a hot text's rows are a plain join's, which Spark can split
    firsts = written(each.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-copies")
    marked = each.join(firsts, "sha", "left").select("doc_id", "row_key", "v", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy"))
    info = marked.filter("not copy").dropDuplicates(["doc_id", "row_key"]).join(shared.select("v", "tokens"), "v").select("doc_id", "row_key", "tokens")
    borders = _borders(known, each.agg(F.sum("size")).first()[0] or 0, parts, window, gram)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            wanted = batch.column(3)  # null: nothing of this row is shared, or it is a copy
            for at, data, offsets in _slices(batch.column(2)):
                a = anchors(data, offsets, window, gram)
                token = tokens_of(a.hash, parts)
                cut = np.searchsorted(a.row, np.arange(len(offsets)))
                keep = np.zeros(len(token), bool)
                for i in range(len(offsets) - 1):
                    if (own := wanted[at + i].as_py()) is not None:
                        keep[cut[i] : cut[i + 1]] = np.isin(token[cut[i] : cut[i + 1]], np.frombuffer(own, np.int64))
                a = a.pick(keep)
                keys += _keys(data.tobytes(), a, window)
                held.append((ids[at + a.row], rows[at + a.row], a.low - offsets[a.row]))
                if len(keys) >= RUN:
                    yield _coded(keys, held, borders, gram)
                    keys, held = [], []
        if keys:
            yield _coded(keys, held, borders, gram)

    texts = docs.select("doc_id", "row_key", "text", "row")
    # a left join of all columns here and below: both then read one and the same shuffle of the texts
    both = texts.join(info.hint("shuffle_hash"), ["doc_id", "row_key"], "left").select("doc_id", "row_key", "text", "tokens", "row")
    coded = both.mapInArrow(sorted_runs, "part int, common binary, sizes binary, rest binary, counts binary, ids binary, rows binary, lows binary")

    def merge_part(table: pa.Table) -> pa.Table:
        return _merged(table, window, gram)

    spans = coded.groupBy("part").applyInArrow(merge_part, "doc_id long, row_key long, span long")
    spans = spans.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("spans"))
    out = texts.join(marked.select("doc_id", "row_key", "copy").distinct().hint("shuffle_hash"), ["doc_id", "row_key"], "left")
    return out.join(spans.hint("shuffle_hash"), ["doc_id", "row_key"], "left")


def _borders(docs: DataFrame, size: int, parts: int, window: int, gram: int) -> list[bytes]:
    """Borders of key ranges from the grams of a hash sample of about SAMPLED bytes of text; they only balance."""
    share = min(1_000_000, int(1e6 * SAMPLED / max(size, 1)) + 1)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _slices(batch.column(0)):
                raw = data.tobytes()
                places = anchors(data, offsets, window, gram).place[::16]
                yield pa.RecordBatch.from_arrays([pa.array([raw[p : p + gram] for p in places.tolist()], pa.binary())], ["gram"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < share).select("text")
    found = sorted(bytes(r["gram"]) for r in chosen.mapInArrow(some, "gram binary").collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _coded(keys: list[bytes], held: list[tuple[np.ndarray, ...]], borders: list[bytes], gram: int) -> pa.RecordBatch:
    """One sorted run as front-coded blocks, a block per key range; equal keys are one entry with all their places."""
    ids, rows, lows = (np.concatenate(x) for x in zip(*held, strict=True))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    ids, rows, lows = ids[order], rows[order], lows[order]
    distinct, counts = [], []
    last = None
    for i in order:
        key = keys[i]
        if key == last:
            counts[-1] += 1
        else:
            distinct.append(key)
            counts.append(1)
            last = key
    cuts = [0, *(bisect.bisect_left(distinct, b) for b in borders), len(distinct)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    out: dict[str, list] = {c: [] for c in ("part", "common", "sizes", "rest", "counts", "ids", "rows", "lows")}
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            x, y = ends[a], ends[b]
            blocks = (*front_code(distinct[a:b]), np.array(counts[a:b], np.uint32), ids[x:y].astype(np.int64), rows[x:y].astype(np.int32), lows[x:y].astype(np.int32))
            for c, v in zip(out, (part, *(zstandard.compress(bytes(z), 1) for z in blocks)), strict=True):
                out[c].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(x, pa.binary()) for c, x in out.items() if c != "part")], list(out))


def _merged(table: pa.Table, window: int, gram: int) -> pa.Table:
    """Merge the runs of one key range and tell the spans that repeat a smaller document."""
    cols = {c: [zstandard.decompress(x) for x in table.column(c).to_pylist()] for c in ("common", "sizes", "rest", "counts", "ids", "rows", "lows")}
    ids, rows, lows = ([np.frombuffer(x, kind).astype(np.int64) for x in cols[c]] for c, kind in (("ids", np.int64), ("rows", np.int32), ("lows", np.int32)))
    ends = [np.concatenate([[0], np.cumsum(np.frombuffer(x, np.uint32))]).tolist() for x in cols["counts"]]
    base = np.cumsum([0, *(len(x) for x in ids)])
    ids, rows, lows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, rows, lows))
    seen = [0] * len(ends)
    out: list[tuple[np.ndarray, ...]] = []
    keys: list[bytes] = []  # distinct, in order
    groups: list[int] = []  # of each key: keys of one anchor gram
    starts: list[int] = []  # entries: first place, places, key
    sizes: list[int] = []
    owners: list[int] = []
    group, pending = -1, 0

    def flush() -> None:
        if keys:
            out.append(_covered(keys, np.array(groups), ranges(np.array(starts), np.array(sizes)), np.repeat(np.array(owners), sizes), ids, rows, lows, window))
        for x in (keys, groups, starts, sizes, owners):
            x.clear()

    last = b""
    for key, common, run in merge([decode(*x) for x in zip(cols["common"], cols["sizes"], cols["rest"], strict=True)]):
        if common < gram or not keys:
            if pending >= HELD:
                flush()
                pending = 0
            group += 1
            keys.append(key)
            groups.append(group)
        elif common < len(key) or len(key) != len(last):
            keys.append(key)
            groups.append(group)
        last = key
        at = seen[run]
        seen[run] = at + 1
        first = ends[run][at]
        starts.append(int(base[run]) + first)
        sizes.append(ends[run][at + 1] - first)
        owners.append(len(keys) - 1)
        pending += 1
    flush()
    names = ("doc_id", "row_key", "span")
    return pa.table({n: np.concatenate(x) for n, x in zip(names, zip(*out, strict=True), strict=True)} if out else {n: pa.array([], pa.int64()) for n in names})


def _covered(keys: list[bytes], groups: np.ndarray, place: np.ndarray, owner: np.ndarray, ids: np.ndarray, rows: np.ndarray, lows: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Spans (doc_id, row_key, start << 24 | length) of the places whose windows a smaller document has."""
    who, row, low = ids[place], rows[place], lows[place]
    order = np.argsort(owner, kind="stable")
    at = np.flatnonzero(np.diff(owner[order], prepend=-1))
    least = np.minimum.reduceat(who[order], at)  # of each key
    length = np.fromiter(map(len, keys), np.int64, len(keys)) - 1
    crowded = np.bincount(groups - groups[0])[groups - groups[0]] > 1
    # runs that are alike wherever their anchor is: a run is covered or not
    plain = ~crowded[owner] & (who > least[owner])
    done = (who[plain], row[plain], low[plain] << 24 | length[owner[plain]])
    if not crowded.any():
        return done
    # elsewhere each window of the differing runs is looked up
    some = np.flatnonzero(crowded)
    texts = [keys[i][m + 1 :][::-1] + keys[i][:m] for i in some.tolist() for m in (keys[i].rindex(MARK),)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(length[some]) - length[some]
    count = length[some] - window + 1
    first = ranges(begin, count)
    _, which, back = np.unique(span_hash(prefix_hash(data), first, first + window), return_index=True, return_inverse=True)
    for x in range(0, len(first), WINDOWS):
        step = np.arange(window)
        a, b = first[x : x + WINDOWS], first[which[back[x : x + WINDOWS]]]
        if not np.array_equal(data[a[:, None] + step], data[b[:, None] + step]):  # two windows of one hash: by their bytes
            grid = np.ascontiguousarray(data[first[:, None] + step]).view(f"V{window}").ravel()
            _, back = np.unique(grid, return_inverse=True)
            break
    smallest = np.full(int(back.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, back, np.repeat(least[some], count))
    smallest = smallest[back]
    number = np.full(len(keys), -1)
    number[some] = np.arange(len(some))
    mine = np.flatnonzero(crowded[owner])
    n = number[owner[mine]]
    window_at = np.cumsum(count) - count
    index = ranges(window_at[n], count[n])
    entry = np.repeat(np.arange(len(mine)), count[n])
    hit = np.append(smallest[index] < np.repeat(who[mine], count[n]), False)
    new = np.append(True, entry[1:] != entry[:-1]) if len(entry) else np.zeros(0, bool)
    start = np.flatnonzero(hit[:-1] & (new | ~np.append(False, hit[:-2])))
    stop = np.flatnonzero(hit[:-1] & (np.append(new[1:], True) | ~hit[1:]))
    e = entry[start]
    from_ = low[mine[e]] + index[start] - window_at[n[e]]
    spans = from_ << 24 | (stop - start + window)
    return tuple(np.concatenate(x) for x in zip(done, (who[mine[e]], row[mine[e]], spans), strict=True))


def _removed(size: int, copy: bool, spans: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) of one text."""
    if copy:
        return [(0, size)] if size >= window else []
    runs: list[tuple[int, int]] = []
    for s in sorted(spans or []):
        a, b = s >> 24, (s >> 24) + (s & 0xFFFFFF)
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _prepared(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    row = F.struct(*carry) if carry else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row"))
    return rows.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))


def repeat_report(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; see `without_repeats`."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                raw = text.encode()
                runs = _removed(len(raw), bool(copy), spans, window)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for c, x in zip(out, (len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()), strict=True):
                    out[c].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string() if c == "kept_sha256" else pa.int64()) for c, x in out.items())], ["doc_id", *out])

    found = repeated_spans(_prepared(docs, id_col, text_col, []), window=window)
    return found.select("doc_id", "text", "copy", "spans").mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, each text without what it repeats of smaller ids; and n_removed, the bytes that went.

    A byte goes if a `window`-byte string of UTF-8 that covers it also starts in a document with a
    smaller id; strings never cross documents and are judged on the input. Where a removed run begins or ends inside
    a character, that character stays whole, so the text stays valid. A null text has nothing to lose and stays null. Rows
    with a null id keep their text and take nothing from others; rows repeated under one id take
    nothing from each other. Further columns come along, whatever their names; one named n_removed is replaced.
    An empty table gives an empty table.

    1. Of each window one gram is chosen by its bytes alone (an anchor); windows whose anchor no other
       text has are unique and need no sorting (lossless). Equal texts are sorted once.
    2. Tasks sort the suffixes at the anchors left into runs, collapse equal ones, and send the runs as front-coded
       blocks by key range.
    3. A loser tree merges each range, comparing only beyond known common prefixes. Equal suffixes tell
       the smallest document directly; where suffixes part inside a run of windows, its windows are compared.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, copy, spans in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                raw = text.encode()
                kept, at = [], 0
                for a, b in _removed(len(raw), bool(copy), spans, window):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                texts.append(b"".join(kept).decode())
                removed.append(len(raw) - sum(map(len, kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["row", "kept", "n_removed"])

    names = [c for c in docs.columns if c != "n_removed"]
    others = [c for c in names if c != text_col]
    carried = _prepared(docs.withColumn(_NULL, F.col(text_col).isNull()), id_col, text_col, [*others, _NULL])
    kind = carried.schema["row"].dataType.simpleString()
    found = repeated_spans(carried, window=window).select("row", "text", "copy", "spans").mapInArrow(cut, f"row {kind}, kept string, n_removed long")
    text = F.when(~F.col("row")[_NULL], F.col("kept"))
    return found.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in names], "n_removed")
