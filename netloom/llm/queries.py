"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import changes, chat, crossentropy, decontaminate, fingerprint, language, minhash, negatives, packing, personal, pieces, sharding, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), e AS (SELECT doc_id, md5_number_lower(x) AS h FROM (SELECT doc_id, unnest(s) AS x FROM s)
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossentropy.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = language.identified(docs.select("doc_id", "text"), language.fit(docs))
    return made.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    made = chat.parsed(rows.select("conv_id", "turn", "text"), chat.fit(rows))
    return made.withColumn("held_out", chat.held_out("conv_id"))


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.searched(docs, decontaminate.fit(docs, table(spark, sf_dir, "benchmark"))).drop("text")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.found(table(spark, sf_dir, "documents")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


#: CRC-32 by its table, a byte at a time.
OP8_SQL = r"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT doc_id, size, list_transform(range(0, size - 8), lambda i: CAST((strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS x FROM d
), c AS (
  SELECT doc_id, size, xor(list_reduce(x, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM b, t
), p AS (
  SELECT *, CAST(least(23, ((2 * sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size) * 24) // (2 * sum(size) OVER ())) AS INTEGER) AS shard FROM c
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.shop_applied(spark, sf_dir)


def _op12_sql() -> str:
    """Unrolled over the batches: a client's next number after each start's jumps (j) and after the batch (k).

    ``e``: where a run of arrived numbers ends, as of each batch. A first arrival not below the jumps of its own batch is applied in the first batch
    whose next number is beyond it.
    """
    steps = ["k0 AS (SELECT client_id, CAST(0 AS BIGINT) AS k FROM (SELECT DISTINCT client_id FROM u))"]
    for b in range(1, 10):
        late = "TRUE" if b == 9 else f"day + 5 <= (SELECT max(day) FROM d WHERE batch < {b})"
        steps.append(
            f"x{b} AS (SELECT p.client_id, p.k, max(u.n) AS x FROM k{b - 1} p LEFT JOIN u ON u.client_id = p.client_id AND u.batch < {b} AND u.n > p.k AND {late} GROUP BY ALL), "
            f"j{b} AS (SELECT x.client_id, coalesce(e.upto, x.k) AS k FROM x{b} x LEFT JOIN e ON e.b = {b - 1} AND e.client_id = x.client_id AND e.n = x.x), "
            f"k{b} AS (SELECT j.client_id, coalesce(e.upto, j.k) AS k FROM j{b} j LEFT JOIN e ON e.b = {min(b, 8)} AND e.client_id = j.client_id AND e.n = j.k + 1)"
        )
    marks = " UNION ALL ".join(f"SELECT client_id, {b} AS batch, (SELECT k FROM j{b} j WHERE j.client_id = k{b}.client_id) AS j, k FROM k{b}" for b in range(1, 10))
    return rf"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), h AS (
  SELECT change_id, xor(list_reduce(list_transform(range(1, len(CAST(change_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(change_id AS VARCHAR)[i]) AS BIGINT)),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) AS h FROM (SELECT DISTINCT change_id FROM client_changes), t
), r AS (
  SELECT *, dense_rank() OVER (PARTITION BY client_id ORDER BY seq NULLS FIRST) AS n FROM (SELECT DISTINCT * FROM client_changes)
), d AS (
  SELECT *, CAST(least(8, 1 + floor((day - 19723) * 8 / 160)) AS INTEGER) AS batch
  FROM (SELECT r.*, date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + 2 * (h % 4) AS day FROM r JOIN h USING (change_id) WHERE valid_at IS NOT NULL AND h % 11 <> 0)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY client_id, n ORDER BY day, change_id) AS arrival FROM d
), u AS MATERIALIZED (SELECT * FROM f WHERE arrival = 1
), e AS MATERIALIZED (
  SELECT b, client_id, n, max(n) OVER (PARTITION BY b, client_id, n - place) AS upto
  FROM (SELECT b, client_id, n, row_number() OVER (PARTITION BY b, client_id ORDER BY n) AS place FROM u, range(0, 9) g(b) WHERE u.batch <= b)
), {", ".join(x.replace(" AS (", " AS MATERIALIZED (") for x in steps)}
, m AS MATERIALIZED ({marks}
), o AS (
  SELECT u.*, (SELECT min(m.batch) FROM m WHERE m.client_id = u.client_id AND m.batch >= u.batch AND m.k >= u.n) AS since, own.j AS passed
  FROM u JOIN m own ON own.client_id = u.client_id AND own.batch = u.batch
), a AS (
  SELECT *, count(CASE WHEN op IN ('I', 'D') THEN 1 END) OVER w AS part, n - 1 - coalesce(lag(n) OVER w, 0) AS gap, lead(n) OVER w IS NULL AS final
  FROM o WHERE n > passed WINDOW w AS (PARTITION BY client_id ORDER BY n)
), v AS (
  SELECT *, last_value(CASE WHEN op <> 'D' THEN city END IGNORE NULLS) OVER p AS c, last_value(CASE WHEN op <> 'D' THEN balance END IGNORE NULLS) OVER p AS m
  FROM a WINDOW p AS (PARTITION BY client_id, part ORDER BY n ROWS UNBOUNDED PRECEDING)
)
SELECT change_id, client_id, 'applied' AS status, CAST(since AS INTEGER) AS batch, CAST(gap AS BIGINT) AS missed, c AS city, CAST(floor(100 * m + 0.5) AS BIGINT) AS cents, final AND op <> 'D' AS current FROM v
UNION ALL
SELECT change_id, client_id, 'rejected', batch, 0, NULL, NULL, FALSE FROM f WHERE arrival > 1
UNION ALL
SELECT change_id, client_id, 'rejected', batch, 0, NULL, NULL, FALSE FROM o WHERE n <= passed
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.table_negatives(spark, sf_dir)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
  SELECT p.a, p.p, p.ps, s.b, s.score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.ps <= 100 * s.score AND 100 * s.score <= 90 * p.ps
)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 10
"""


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_chat_format": op6_chat_format,
    "op7_packed_ids": op7_packed_ids,
    "op8_byte_shards": op8_byte_shards,
    "op9_decontamination": op9_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_change_applier": op12_change_applier,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op1_minhash_near_dedup": OP1_SQL, "op8_byte_shards": OP8_SQL, "op12_change_applier": _op12_sql(), "op13_hard_negatives": OP13_SQL}
