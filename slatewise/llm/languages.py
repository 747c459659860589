"""Operator 12: language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import workers_see, written

#: Code points whose n-grams are counted at once in a task.
SLICE = 1 << 19
#: Languages compared in one pass over the texts; further ones take further passes.
BLOCK = 256
#: A word's border. It is no letter, so no text holds it as one.
BORDER = 1
UNKNOWN = "und"
_letters = np.full(0x110000, -1, np.int8)


def _points(text: str) -> np.ndarray:
    """Lower-cased letters as code points, each run of others as one border, with a border at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kinds = _letters[points]
    if (kinds < 0).any():
        for p in np.unique(points[kinds < 0]).tolist():
            _letters[p] = chr(p).isalpha()
        kinds = _letters[points]
    letter = kinds > 0
    if not letter.any():
        return np.zeros(0, np.int64)
    out = np.concatenate([[BORDER], np.where(letter, points, BORDER), [BORDER]])
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != BORDER) | (out[:-1] != BORDER)
    return out[keep]


def _grams(points: np.ndarray, longest: int) -> np.ndarray:
    """Codes of all n-grams of 1 to `longest` (3 at most) points that lie in one word with its borders, and aren't a border alone."""
    border = points == BORDER
    found, code = [points[~border]], points
    for n in range(2, longest + 1):
        code = (code[:-1] << 21) | points[n - 1 :]
        inner = np.zeros(len(code), bool)
        for k in range(1, n - 1):
            inner |= border[k : k + len(code)]
        found.append(code[~inner] if n > 2 else code)
    return np.concatenate(found)


def gram_counts(text: str, longest: int = 3, slice_size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of a whole text's n-grams; slices overlap so that none is lost or counted twice."""
    if len(text) <= slice_size:
        return np.unique(_grams(_points(text), longest), return_counts=True)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for piece in _slices(text, slice_size):
        held.append(np.unique(_grams(_points(piece), longest), return_counts=True))
        if len(held) > 16:
            held = [_merged(held)]
    return _merged(held)


def _slices(text: str, size: int) -> Iterator[str]:
    """The text cut where a letter run ends; a run longer than `size` is cut only at its own end."""
    at = 0
    while at < len(text):
        to = min(at + size, len(text))
        while to < len(text) and text[to].isalpha():
            to += 1
        # lower() looks at a letter's neighbours in one case only (a final sigma), and marks belong to their letter's word
        yield text[at:to]
        at = to


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, inverse = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)


def held_out(doc_id, part: int = 2, parts: int = 4):
    """Rows that are never learned from: crc32 of the id as text, modulo `parts`, is `part`; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def language_profiles(docs: DataFrame, *, size: int = 400, longest: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, rank): the `size` most frequent n-grams of each language in `docs`, ranks from 0, ties to smaller codes.

    Counts cover every row with a text and a language. Tasks send counts, not texts; the sum is combined before it is
    shuffled, and each task keeps its own `size` best before a language's are put in order, so a hot language meets no
    one task whole. Rows without a text or language teach nothing; repeated rows count as often as they stand.
    """
    workers_see(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        room = SLICE * 2

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for piece in _slices(text.as_py(), SLICE):
                    grams = _grams(_points(piece), longest)
                    held.setdefault(lang.as_py(), []).append(grams)
                    room -= len(piece)
                    if room <= 0:
                        yield from sent()
                        room = SLICE * 2
        yield from sent()

    taught = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = taught.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", F.col("rank").cast("int").alias("rank"))


class Profiles:
    """Ranks of a block of languages: row g of `ranks` holds those of `grams[g]`, `size` where a language lacks it."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, int]], size: int, longest: int):
        self.langs, self.size, self.longest = langs, size, longest
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(langs)), size, np.int32)  # the last row: a gram that none has
        place = {lang: i for i, lang in enumerate(langs)}
        if rows:
            self.ranks[np.searchsorted(self.grams, [g for _, g, _ in rows]), [place[lang] for lang, _, _ in rows]] = [r for _, _, r in rows]

    def distances(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language, 0 to 1; n-grams that are equally frequent share their mean rank."""
        if len(codes) > self.size:  # whole groups of ties stay in order, codes settle the last place
            best = np.lexsort((codes, -counts))[: self.size]
            codes, counts = codes[best], counts[best]
        _, group, sizes = np.unique(-counts, return_inverse=True, return_counts=True)
        own = (np.cumsum(sizes) - (sizes + 1) / 2)[group]
        at = np.minimum(np.searchsorted(self.grams, codes), max(len(self.grams) - 1, 0))
        known = self.grams[at] == codes if len(self.grams) else np.zeros(len(codes), bool)
        ranks = self.ranks[np.where(known, at, len(self.grams))]
        off = np.where(ranks == self.size, self.size, np.abs(ranks - own[:, None]))
        return off.mean(0) / self.size


def language_ids(docs: DataFrame, *, size: int = 400, longest: int = 3, taught: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs`.

    Profiles are learned from `taught` (by default the rows of `docs` that aren't `held_out`), each language's `size` most
    frequent n-grams of 1 to `longest` letters and word borders. A text's own most frequent n-grams are ranked alike, and the
    language whose ranks are least out of place is told, ties to the smaller name; n-grams that the profile lacks
    count `size`. `score` is the margin over the second language, (second - first) / second, or 1 - distance where only
    one is known. The prediction reads the text alone.

    A null text, or one without a letter, is `und` with score 0, and so is every text where nothing was learned. Repeated
    rows and null ids are told row by row. Further columns of `docs` are ignored. An empty table gives an empty table.

    Texts are read once to learn and once to tell, never shuffled. Profiles are at most `size` rows a language; BLOCK languages
    go to the tasks at a time, and where there are more, the best and second of one block go on to the next.
    """
    spark = docs.sparkSession
    workers_see(spark)
    kind = dict(docs.dtypes)[id_col]
    if taught is None:
        taught = docs.filter(~held_out(F.col(id_col)))
    profiles = written(language_profiles(taught, size=size, longest=longest, text_col=text_col, lang_col=lang_col), "language-profiles")
    langs = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").toLocalIterator()]  # names only
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("second"), F.col(text_col).alias("text"))
    fields = f"doc_id {kind}, held_out boolean, lang_pred string, first double, second double"
    blocks = [langs[i : i + BLOCK] for i in range(0, len(langs), BLOCK)]
    for i, block in enumerate(blocks):
        held = profiles.filter(F.col("lang").isin(block) if len(blocks) > 1 else F.lit(True)).collect()  # BLOCK * size rows at most
        last = i == len(blocks) - 1
        rows = rows.mapInArrow(_told(Profiles(block, [tuple(r) for r in held], size, longest), last), fields + ("" if last else ", text string"))
    single = len(langs) == 1
    margin = F.lit(1.0) - F.col("first") if single else F.when(F.col("second") > 0, (F.col("second") - F.col("first")) / F.col("second")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(F.when(F.col("lang_pred").isNotNull(), margin), F.lit(0.0)).alias("score"))


def _told(profiles: Profiles, last: bool):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, firsts, seconds = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for row, text in enumerate(batch.column(5)):
                codes, counts = gram_counts(text.as_py() or "", profiles.longest)
                if not len(codes):
                    continue
                d = profiles.distances(codes, counts)
                best = int(np.argmin(d))
                two = np.sort(np.concatenate([[x for x in (firsts[row], seconds[row]) if x is not None], np.partition(d, 1)[:2] if len(d) > 1 else d]))
                if firsts[row] is None or d[best] < firsts[row]:
                    langs[row] = profiles.langs[best]
                firsts[row], seconds[row] = float(two[0]), float(two[1]) if len(two) > 1 else None
            told = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(firsts, pa.float64()), pa.array(seconds, pa.float64())]
            yield pa.RecordBatch.from_arrays(told + ([] if last else [batch.column(5)]), ["doc_id", "held_out", "lang_pred", "first", "second"] + ([] if last else ["text"]))

    return tell
