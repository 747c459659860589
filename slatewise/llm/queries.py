"""The operators' registered queries: each over its whole table, with the digest columns asked for."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.languages import language_ids
from slatewise.llm.licences import COPYRIGHT, LEADS, LOWER, SPELLINGS, UPPER, VERSIONS, canonical_text, known_texts, licence_scan
from slatewise.llm.neighbours import nearest
from slatewise.llm.ngram_join import similar_documents
from slatewise.llm.packing import packed_sequences
from slatewise.llm.quality import fit_rules, quality_scores
from slatewise.llm.resampling import importance_resample
from slatewise.llm.sentences import round_trip
from slatewise.llm.sharding import interleaved_shards
from slatewise.llm.spellings import spelling_variants
from slatewise.llm.suffix_dedup import repeat_report
from slatewise.llm.token_counts import token_counts
from slatewise.llm.top_k import exact_top_k, quantised
from slatewise.session import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), window=50)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), percent=80).select("doc_id", "n_shingles", "component_id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=512)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir, "documents"), shards=16)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(table(spark, sf_dir, "documents"), window=2048)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, longest=1, seed=2024)


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


def op13_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), least=7, least_n=2, every=31, times=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_top_k, op3_licences, op4_suffix_dedup, op5_ngram_join, op6_nearest, op7_quality, op8_token_counts, op9_sharding, op10_packing, op11_resampling, op12_languages, op13_spellings)}


OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _canonical(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '', 'g')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', '  ', 'g') || ' '"
    for old, new in SPELLINGS + LEADS:
        a, b = ("  ".join(x.split()) for x in (old, new))
        out = f"replace({out}, ' {a} ', ' {b} ')"
    for pattern, new in VERSIONS:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _known() -> str:
    forms = {f: n for f, n in sorted(((canonical_text(t), n) for n, t in known_texts()), reverse=True) if f}
    return ", ".join(f"('{n}', '{hashlib.sha256(f.encode()).hexdigest()}')" for f, n in sorted(forms.items()))


OP3 = f"""
WITH k AS (SELECT * FROM (VALUES {_known()}) t(licence, d)),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
h AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS s FROM l JOIN k ON k.d = sha256({_canonical("line")}) GROUP BY 1)
SELECT documents.doc_id, k.licence AS text_licence, coalesce(h.n, 0) AS n_lines, coalesce(h.s, '') AS licences
FROM documents LEFT JOIN k ON k.d = sha256({_canonical("coalesce(text, '')")}) LEFT JOIN h ON h.doc_id = documents.doc_id
"""
OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id
GROUP BY d.doc_id
"""


#: crc32 without a table of the engine's own: the table by eight shifts of each byte, then a fold over the bytes of a string.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc32(text: str) -> str:
    byte = f"CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS11 = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"
OP11 = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, {_WORDS11} AS w FROM d), b AS (SELECT {_WORDS11} AS w FROM benchmark),
h AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM w UNION SELECT w FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM w JOIN h USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY 1),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
f AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (
  SELECT d.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight,
    coalesce(f.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (r)
),
o AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT x.doc_id, x.n_features, x.weight, x.score, o.rank FROM x LEFT JOIN o ON o.doc_id = x.doc_id AND o.rank <= 10 * o.n // 100
"""
OP13 = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
o AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM o WHERE length(w) >= 7 GROUP BY 1, 2),
h AS (SELECT w, n, {_crc32("(doc_id || ':' || w)")} AS h FROM c, crc),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.less
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.less
),
q AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS k, row_number() OVER (PARTITION BY word ORDER BY n DESC, near COLLATE "binary") AS r FROM p),
f AS (SELECT v.word, v.n, coalesce(k, 0) AS n_near, CASE WHEN q.n >= 10 * v.n THEN near END AS form, CASE WHEN q.n >= 10 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND q.r = 1),
z AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(z.root, z.step) AS root, any_value(f.n) AS n, any_value(f.n_near) AS n_near, any_value(f.form_n) AS form_n
FROM f JOIN z ON z.word = f.word GROUP BY f.word, f.form
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2, "op3_licences": OP3, "op5_ngram_join": OP5, "op11_resampling": OP11, "op13_spellings": OP13}
