"""Consistent weighted sampling fingerprints (operator 3), DataFrame functions only.

A document is a weighted set: its words, weighted by their counts. For sample k every word has
r and c drawn from Gamma(2, 1) and b from U(0, 1), all from hashes of (word, k). With
t = floor(ln(weight) / r + b), the word with the least ln(c) - r * (t - b + 1) is the sample, and (word, t)
its code: two documents have the same code with a probability equal to their generalised Jaccard similarity.

One exchange carries texts: documents are dealt into contiguous ranges of ids, so that a document and the next one
stand side by side, and word counts and the samples' minima are aggregated in the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
#: Characters to a range of ids, and ranges at most.
RANGE_CHARS, MOST_RANGES = 1 << 20, 16_384
SPACES = r"[\x20\x09-\x0D]+"


def _uniform(bits: Column, shift: int) -> Column:
    """(0, 1) from 16 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(65535)) + F.lit(0.5)) / F.lit(65536.0)


def sample_key(word: Column, log_weight: Column, k: int) -> Column:
    """A long whose minimum over a document's words is sample k: the order of the draw above, the code below."""
    bits = F.xxhash64(word, F.lit(k))
    r = -F.log(_uniform(bits, 0) * _uniform(bits, 16))
    log_c = F.log(-F.log(_uniform(bits, 32) * _uniform(bits, 48)))
    b = _uniform(F.xxhash64(word, F.lit(k + 100_003)), 8)
    t = F.floor(log_weight / r + b)
    rank = log_c - r * (t - b + 1)  # between -1e5 and 4 for weights up to 2**63
    code = F.xxhash64(word, t, F.lit(k)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft((rank * F.lit(16384.0)).cast("long"), 32).bitwiseOR(code)


def _ranges(docs: DataFrame) -> DataFrame:
    """Adds ``part``: contiguous ranges of descending id; null ids come after them, dealt by text."""
    stats = docs.agg(F.sum("n_chars").alias("c"), F.count("doc_id").alias("n")).first()
    many = int(min(MOST_RANGES, max(1, (stats.c or 0) // RANGE_CHARS), max(1, stats.n)))
    cuts: list[int] = []
    if many > 1:
        at = [i / many for i in range(1, many)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 4 * many)).first()[0] or []))
    step = max(1, int(len(cuts) ** 0.5))
    fine, coarse = F.array(*map(F.lit, cuts)) if cuts else None, cuts[::step]
    if fine is None:
        place = F.lit(0)
    else:
        # two short scans of the cuts instead of one long one
        block = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda c: c < F.col("doc_id")))
        start = F.greatest(F.lit(0), (block - 1) * step)
        place = start + F.size(F.filter(F.slice(fine, start + 1, F.lit(step)), lambda c: c < F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + F.pmod(F.col("h"), F.lit(max(1, many))).cast("int")).otherwise(F.lit(len(cuts)) - place)
    return docs.withColumn("part", F.coalesce(part, F.lit(0)))  # never null: no filter is inferred that would part the plans below


def _with_next(docs: DataFrame) -> DataFrame:
    """Adds ``row`` and, in descending order of ids, the next document's text (after the last: the first)."""
    order = [F.col("doc_id").desc_nulls_last(), "h", "n_chars"]
    firsts = docs.groupBy("part").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), -F.col("h").cast("decimal(20,0)"), -F.col("n_chars"))).alias("top"))
    firsts = firsts.select("part", F.col("top.col1").alias("k"), (-F.col("top.col2")).cast("long").alias("h"), F.col("top.col3").alias("m"))
    ring = Window.orderBy("part")  # one row for each range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("k", "h", "part", F.coalesce(F.lag("part").over(ring), F.last("part").over(whole)).alias("for_part"))
    heads = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    heads = heads.join(F.broadcast(firsts), ["k", "h", "part"]).select("for_part", F.col("text").alias("head"))
    heads = heads.dropDuplicates(["for_part"]).withColumnRenamed("for_part", "part")
    inside = Window.partitionBy("part").orderBy(*order)
    docs = docs.withColumn("row", F.row_number().over(inside)).withColumn("after", F.lead("text").over(inside))
    return docs.join(heads.hint("merge"), "part", "left").withColumn("after", F.coalesce("after", "head")).drop("head")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many (or all) of the next document,
    in descending order of ids; after the last comes the first. A fingerprint has four hexadecimal digits a sample, "0000" in a text without words.
    Likeness is the share of equal samples; two texts without words are alike. Null texts count as empty. Null ids come last, in
    an order of their texts' hashes; rows that repeat an id follow each other in that order, and each is a document of its own. Ties of equal rows are alike.
    An empty table gives no row. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    source = source.withColumn("n_chars", F.length("text").cast("long")).withColumn("h", F.xxhash64("text"))
    paired = _with_next(_ranges(source))
    half = F.expr("CAST(n_chars div 2 AS INT)")
    edited = F.concat(F.expr("left(text, CAST(n_chars - n_chars div 2 AS INT))"), F.substring(F.col("after"), F.lit(1), half))
    paired = paired.withColumn("edited", edited)
    key = ["part", "row"]
    words = (
        paired.select(*key, F.explode_outer(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("v"))
        .select(*key, "v.side", F.explode_outer(F.split("v.text", SPACES)).alias("w")).where("w <> ''")
        .select(*key, "side", F.xxhash64("w").alias("w"))
    )
    counts = words.groupBy(*key, "side", "w").agg(F.count("*").alias("c")).withColumn("lw", F.log(F.col("c").cast("double")))
    minima = counts.groupBy(*key, "side").agg(*[F.min(sample_key(F.col("w"), F.col("lw"), k)).alias(f"s{k}") for k in range(samples)])
    codes = minima.select(*key, "side", F.array(*[(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) % 65535 + 1).cast("int") for k in range(samples)]).alias("codes"))
    codes = codes.groupBy(*key).agg(*[F.max(F.when(F.col("side") == i, F.col("codes"))).alias(n) for i, n in enumerate(("own", "other"))])
    none = F.array_repeat(F.lit(0), samples)
    meta = paired.select(*key, "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    made = meta.join(codes.hint("merge"), key, "left").withColumn("own", F.coalesce("own", none)).withColumn("other", F.coalesce("other", none))
    made = made.withColumn("next", F.lead("own").over(Window.partitionBy("part").orderBy("row")))
    heads = made.where("row = 1").select("part", F.col("own").alias("head"))
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.coalesce(F.lag("part").over(ring), F.last("part").over(whole)).alias("part"), "head")
    made = made.join(F.broadcast(heads), "part", "left").withColumn("next", F.coalesce("next", "head"))

    def like(x: str, y: str) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e)) / F.lit(float(samples))

    def shown(x: str) -> Column:
        return F.array_join(F.transform(x, lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), "")

    return made.select(
        "doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("other").alias("edited_fingerprint"),
        like("own", "other").alias("near_edited"), like("own", "next").alias("near_next"),
    )
