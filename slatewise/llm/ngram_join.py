"""Operator 5: documents whose word-shingle sets have a high Jaccard similarity, by signature trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.arrays import U64, text_bytes
from slatewise.llm.components import components
from slatewise.llm.rows import row_key
from slatewise.llm.shared_hashes import range_count, shared_counts, with_classes
from slatewise.llm.shingles import set_name, shingle_sets
from slatewise.llm.signature_tree import SignatureTree, bitmap, wide_enough
from slatewise.session import discard, workers_see, written

#: Bytes of text looked at together in a task.
SLICE = 1 << 20
#: Most sets that one tree of the first round holds; larger blocks are cut and their parts linked by leaders.
BLOCK = 1024
#: Share of a set (percent) that its prefix holds beyond the least prefix, so that chance meetings can be told.
EXTRA = 10


def _ceil_share(n, percent: int):
    return (n * percent + 99) // 100


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Shingle sets of a text column, a slice of rows at a time."""
    data, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE)) - 1), len(offsets) - 1)
        yield shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def signatures(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, n, v, prefix) of each row: its id, what tells it from others of the id, size of its set, the set's name, and its smallest hashes.

    Two sets of at least `percent` similarity share a percent of the larger one; taken in one order of
    all hashes, each one's first n - ceil(percent of n) + m hashes then hold m common ones. A null or empty text
    has an empty set (n 0, no prefix); repeated rows and null ids are told row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name, prefix = [], [], []
            for part in _sets(batch.column(1)):
                for s in part:
                    n.append(len(s))
                    name.append(set_name(s))
                    prefix.append(s[: len(s) - _ceil_share(len(s), percent) + 1 + len(s) * EXTRA // 100].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "row_key", "n", "v", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, n long, v long, prefix binary")


def join_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, token, keys, hashes): the sets (v, hashes) that may be similar to another, with the hashes that tell of it.

    All hashes are ordered from those that fewest sets hold. Of two similar sets the first common hash is
    among each one's first n - ceil(percent of n) + 1, so these, without what no other set holds, are
    a set's keys, and two similar sets have one in common. A set with more hashes of its own than
    may differ has no key and is absent. `token` is the key that most sets hold.
    """

    def use(v: np.ndarray, size: np.ndarray, hashes: np.ndarray, classes: np.ndarray) -> pa.Table:
        owner = np.repeat(np.arange(len(v)), size)
        order = np.lexsort((hashes, classes, owner))
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        chosen = order[(rank < np.repeat(size - _ceil_share(size, percent) + 1, size)) & (classes[order] > 0)]
        who, at = np.unique(owner[chosen], return_index=True)
        ends = np.append(at, len(chosen))[1:]
        begin = np.append(0, np.cumsum(size))
        keys = hashes[chosen].view(np.int64)
        return pa.table(
            {
                "v": v[who],
                "n": size[who],
                "token": keys[ends - 1],
                "keys": pa.array([keys[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()),
                "hashes": pa.array([hashes[begin[i] : begin[i + 1]].tobytes() for i in who.tolist()], pa.binary()),
            }
        )

    return with_classes(sets, range_count(sets.sparkSession), use, "v long, n long, token long, keys binary, hashes binary")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= percent * (len(a) + len(b) - inter)


def _tree_links(table: pa.Table, percent: int, visits: bool = False) -> pa.Table:
    """Links that join the similar sets of one block: one fewer than sets in each component.

    visits: only pairs with a guest are compared, and sets of one component `c` count as linked.
    """
    v = table.column("v").to_numpy()
    sets = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
    order = sorted(range(len(v)), key=lambda i: (int(sets[i][0]), len(sets[i])))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    width = min(1 << 15, 4 * wide_enough(int(sizes.max())))
    tree = SignatureTree(sizes, np.stack([bitmap(sets[i], width) for i in order]), percent)
    labels = np.arange(len(v))
    guest = np.ones(len(v), bool)
    if visits:
        labels = np.unique(table.column("c").to_numpy(), return_inverse=True)[1][order]
        guest = table.column("guest").to_numpy(zero_copy_only=False)[order]
    links: dict[str, list[int]] = {"a": [], "b": []}
    for i, j in tree.pairs(lambda: labels):
        one = guest[i] | guest[j]
        i, j = i[one], j[one]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if labels[x] != labels[y] and _similar(sets[order[x]], sets[order[y]], percent):
                labels[labels == labels[y]] = labels[x]
                links["a"].append(int(v[order[x]]))
                links["b"].append(int(v[order[y]]))
    return pa.table({c: pa.array(x, pa.int64()) for c, x in links.items()})


def similar_documents(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, cluster): every row with the smallest doc_id of its linked component.

    Texts are whole; a set is that of the distinct 5-word shingles (see `shingle_sets`); two documents link
    when 100 * intersection >= percent * union. A row without words is linked with nothing and is its own
    component. Equal sets are one vertex, whatever their number. Repeated rows and ids are vertices by
    their sets; a row with a null id has a null component_id and links nothing. `cluster` names the component also
    where one id has several texts (null for rows in none), and `row_key` tells these apart. Further columns of `docs` are
    ignored. An empty table gives an empty table, and so it is where nothing is shared.

    1. Sets of which too few of the smallest hashes are found in other sets are set aside (lossless).
    2. The rest are ordered by how many sets hold each hash, and get their keys (`join_keys`).
    3. Sets meet in blocks by the key that most sets hold. A block's signature tree is joined with
       itself by dual traversal, passing by what is already linked; similar pairs link. Large
       blocks are cut, and the leaders of the parts meet again.
    4. Sets of different blocks and components that have a key in common meet: the one of the lesser component
       visits the other's block, whose tree is joined with its visitors.
    """
    spark = docs.sparkSession
    workers_see(spark)
    told = written(signatures(docs, percent, id_col, text_col), "signatures")
    named = told.filter("n > 0 and doc_id is not null")
    need = F.expr(f"1 + int((n * {percent} + 99) div 100 * {EXTRA} div 100)")
    hits = shared_counts(named.select("v", "prefix"), range_count(spark))
    vertices = written(named.groupBy("v", "n").agg(F.min("doc_id").alias("rep")), "vertices")
    wanted = hits.join(vertices, "v").filter(F.col("hits") >= need).select("rep", "v", "n")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = 0, batch.column(0).to_pylist()
            for part in _sets(batch.column(1)):
                rows = [i for i, s in enumerate(part) if set_name(s) == v[at + i]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at + i for i in rows], pa.int64())), pa.array([part[i].tobytes() for i in rows], pa.binary())], ["v", "hashes"])
                at += len(part)

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    some = written(texts.join(wanted, "rep").select("v", "text").mapInArrow(whole, "v long, hashes binary"), "shingle-sets")
    brief = written(told.select("doc_id", "row_key", "n", "v"), "rows")
    discard(told)
    sets = written(join_keys(some, percent), "keyed-sets")
    discard(some)
    met = sets.groupBy("token").agg(F.count("*").alias("met"))
    blocks = sets.join(met.filter("met > 1"), "token", "left").withColumn("met", F.coalesce("met", F.lit(1)))
    blocks = blocks.withColumn("chunk", F.pmod(F.xxhash64("v"), F.ceil(F.col("met") / BLOCK)))

    def tree(key: tuple, table: pa.Table) -> pa.Table:
        return _tree_links(table, percent)

    placed = written(blocks, "blocks")
    discard(sets)
    crowded = placed.filter("met > 1")
    links = written(crowded.groupBy("token", "chunk").applyInArrow(tree, "a long, b long"), "links")
    linked = written(components(links), "components")
    cut = crowded.filter(F.col("met") > BLOCK)
    before = cut.count()
    while before:
        # the leaders of cut blocks meet; it saves visits later, so it ends where it no longer halves them
        leaders = cut.join(linked.filter("v <> c").select("v"), "v", "left_anti")
        now = leaders.count()
        if 2 * now > before:
            break
        met = leaders.groupBy("token").agg(F.count("*").alias("met"))
        again = leaders.drop("met").join(met, "token").withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(now)), F.ceil(F.col("met") / BLOCK)))
        again = written(again, "leaders")
        links = written(links.unionByName(again.groupBy("token", "chunk").applyInArrow(tree, "a long, b long")), "links")
        linked = written(components(links), "components")
        cut = again.filter(F.col("met") > BLOCK)
        before = cut.count()
    links = links.unionByName(_cross_links(placed, linked, percent))
    final = written(components(links), "components")
    discard(placed)
    named_by = vertices.join(final, "v", "left").select("v", F.coalesce("c", "v").alias("cluster"), "rep")
    least = named_by.groupBy("cluster").agg(F.min("rep").alias("component_id"))
    answer = written(named_by.join(least, "cluster").groupBy("v").agg(F.min("cluster").alias("cluster"), F.min("component_id").alias("component_id")), "answer")
    discard(vertices, final)
    v = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("v"))
    out = brief.select("doc_id", "row_key", F.col("n").alias("n_shingles"), v.alias("v")).join(answer, "v", "left")
    return out.select("doc_id", "row_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "cluster")


def _cross_links(sets: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different blocks and components.

    Of two such sets that have a key in common the one of the lesser component visits the block of the
    other, unless that holds no set of a size near its own.
    """
    step = math.log(100 / percent) * (1 + 1e-9)
    block = F.xxhash64("token", "chunk").alias("block")
    own = sets.select("v", "n", block, "keys").join(linked, "v", "left").withColumn("c", F.coalesce("c", "v"))
    weight = own.groupBy("c").agg(F.count("*").alias("size"))
    own = own.join(weight, "c").withColumn("band", F.floor(F.log("n") / step).cast("int"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *(batch.column(c).take(take) for c in (2, 3, 4, 5))], ["v", "key", "block", "band", "size", "c"])

    rows = own.select("v", "keys", "block", "band", "size", "c").mapInArrow(spread, "v long, key long, block long, band int, size long, c long")
    rows = written(rows.withColumn("rank", F.struct("size", "c")).drop("size", "c"), "keys")
    seen = rows.groupBy("key").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).filter("low < high")
    open_ = written(rows.join(seen, "key").drop("low"), "open-keys")
    homes = open_.groupBy("key", "band", "block").agg(F.max("rank").alias("top"))
    going = open_.filter("rank < high").select("v", "key", F.col("block").alias("_home"), "rank", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"))
    visits = written(going.join(homes, ["key", "band"]).filter("block <> _home and rank < top").select("v", "block").distinct(), "visits")

    whole = sets.select("v", block, "hashes").join(own.select("v", "c"), "v")
    guests = visits.join(whole.drop("block"), "v").withColumn("guest", F.lit(True))
    hosts = whole.join(visits.select("block").distinct(), "block", "left_semi").withColumn("guest", F.lit(False))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        return _tree_links(table, percent, visits=True)

    cols = ["v", "c", "guest", "block", "hashes"]
    return guests.select(*cols).unionByName(hosts.select(*cols)).groupBy("block").applyInArrow(meet, "a long, b long")
