"""Personal data by bootstrapped contextual extraction (operator 10).

Fixed patterns find the seed entities of every text. Their contexts induce lexical patterns (words around an entity);
Spark scores the graph of patterns and instances in rounds, from the seeds outwards; patterns of high confidence
then discover identifiers that the fixed patterns don't know, among tokens that hold digits or an at sign.
One scan of the texts finds seeds, candidates and contexts; the rounds run on these only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import saved, small_batches

# The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
# An address starts a run of digits: inside a run no match can start that doesn't start before. So long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: What discovered spans are called.
FOUND = "identifier"
ORDER = {k: i for i, k in enumerate((*KINDS, FOUND))}
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@]")
EDGES = "()[]{}<>\"'.,;:!?"

#: A pattern counts from this many distinct seeds on, and from this confidence on; so do instances.
LEAST_SEEDS, SURE = 3, 0.8
ROUNDS = 3


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k & 1:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at signs: the run of local characters before one is
    part of a match only if it starts behind the match before."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            spans.append((start, last))
            at = text.find("@", last)
        else:
            # a run that an at sign ends can't be part of another match
            at = text.find("@", at + 1)
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    digit = re.search(r"[0-9]", text)
    if digit:
        at = max(0, digit.start() - 1)
        for m in IP.finditer(text, at):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text, at):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text, at):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


class Words:
    """The words of a text, found when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: list[tuple[int, int]] | None = None

    def near(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """Two words before and one behind, in lower case, digits as 0; of a word that the span cuts, the rest."""
        if self.spans is None:
            self.spans = [m.span() for m in TOKEN.finditer(self.text)]
        k = bisect_left(self.spans, (start, -1))
        left = [self.text[a : min(b, start)] for a, b in self.spans[max(0, k - 2) : k]]
        k = bisect_right(self.spans, end, key=lambda s: s[1])
        right = [self.text[max(a, end) : b] for a, b in self.spans[k : k + 1]]
        plain = lambda w: re.sub(r"[0-9]+", "0", w.lower())
        return [plain(w) for w in left], [plain(w) for w in right]


def contexts(words: Words, start: int, end: int) -> list[str]:
    """The lexical patterns that an occurrence supports."""
    left, right = words.near(start, end)
    out = []
    if len(left) == 2:
        out.append("2|" + " ".join(left))
    if left and right:
        out.append("1|" + left[-1] + " _ " + right[0])
    return out


def candidate_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Tokens with four digits, or with an at sign, that no fixed pattern overlaps; surrounding punctuation is left off."""
    out, k, done = [], 0, -1
    for mark in MARK.finditer(text):
        if mark.start() < done:
            continue
        start = mark.start()
        while start > max(0, done) and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        end = TOKEN.match(text, mark.start()).end()
        done = end
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        word = text[start:end]
        if start < end and ("@" in word or sum("0" <= c <= "9" for c in word) >= 4):
            out.append((start, end))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, uses) for each row of (doc_id, text).

    ``uses`` are occurrences: span, kind or null for candidates, hash of the instance's text, hashes of its patterns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        for batch in batches:
            base, uses = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                found = [(a, b, k) for a, b, k in spans] + [(a, b, None) for a, b in candidate_spans(text, spans)]
                words = Words(text)
                uses.append(
                    [{"start": a, "end": b, "kind": k, "instance": code(text[a:b]), "patterns": [code(p) for p in contexts(words, a, b)]} for a, b, k in found]
                )
            span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
            use = pa.struct([*span, pa.field("instance", pa.int64()), pa.field("patterns", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(span)), pa.array(uses, pa.list_(use))], ["doc_id", "base", "uses"]
            )

    return docs.mapInArrow(
        run,
        "doc_id long, base array<struct<start:int,end:int,kind:string>>, "
        "uses array<struct<start:int,end:int,kind:string,instance:long,patterns:array<long>>>",
    )


def trusted(uses: DataFrame, least_seeds: int = LEAST_SEEDS, sure: float = SURE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern): patterns of high confidence, from the graph of (pattern, instance, seed).

    Seeds have a score of 1, other instances 0 at first. In each round a pattern with ``least_seeds`` instances of a score of ``sure`` or more
    gets a confidence, the mean score of its distinct instances, shrunk by one unknown instance; an instance that is no seed then gets the best confidence
    among its patterns. So what a round discovers supports further patterns in the next. Each round is two aggregations.
    """
    graph = saved(uses.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")

    def confident(scores: DataFrame | None) -> DataFrame:
        score = F.col("seed").cast("double")
        rows = graph.withColumn("score", score) if scores is None else graph.join(scores, "instance", "left").withColumn("score", F.greatest(score, F.coalesce("best", F.lit(0.0))))
        made = rows.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count_if(F.col("score") >= sure).alias("support"))
        return made.where(f"support >= {least_seeds}").select("pattern", "confidence")

    scores = None
    for _ in range(rounds):
        scores = graph.where("seed = 0").join(confident(scores), "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        scores = saved(scores, "scores")
    return confident(scores).where(f"confidence >= {sure}").select("pattern")


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra) for every row: base spans and discovered ones, as arrays of (start, end, kind).

    Null and empty texts have no spans. Offsets are code points, ends exclusive. Base spans of different kinds may overlap;
    discovered ones (kind ``identifier``) overlap no base span. Rows that repeat an id are told apart; a null id is an id like others. An empty table gives no row. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = saved(scanned(source), "scanned")
    uses = made.select(F.explode("uses").alias("u")).select(
        F.explode("u.patterns").alias("pattern"), F.col("u.instance").alias("instance"), F.col("u.kind").isNotNull().cast("int").alias("seed")
    )
    rules = saved(trusted(uses), "patterns")
    open_ = made.select("doc_id", F.explode("uses").alias("u")).where("u.kind IS NULL")
    hits = open_.select("doc_id", "u.start", "u.end", "u.instance", F.explode("u.patterns").alias("pattern")).join(rules, "pattern")
    hits = hits.select("doc_id", "instance", "start", "end").distinct()
    # a row takes the hits of its id that are among its own candidates
    gathered = hits.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set(F.struct("start", "end", "instance")).alias("hits"))
    at = F.expr("filter(uses, u -> u.kind IS NULL AND array_contains(hits, named_struct('start', u.start, 'end', u.end, 'instance', u.instance)))")
    extra = F.transform(at, lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), F.lit(FOUND).alias("kind")))
    return made.join(gathered, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "base", F.coalesce(extra, F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("extra")
    )


def digest(spans: DataFrame) -> DataFrame:
    """The query's columns from those of ``found``."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])

    def text(column: str) -> Column:
        ranked = F.array_sort(F.transform(column, lambda s: F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("k"), s["end"], s["kind"])))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    spans = spans.withColumn("every", F.concat("base", "extra"))
    return spans.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("every").alias("spans"), (F.size("every") > 0).alias("personal"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span, base or discovered, replaced by its kind in angle brackets; other columns as they were.

    Overlapping spans become one, named by the first. Null texts stay null. Rows that repeat an id with different texts are each
    masked by their own spans. An empty table stays empty; columns may have any name.
    """
    small_batches(docs.sparkSession)
    spans = found(docs, id_col, text_col)
    extra = spans.where("size(extra) > 0").groupBy("doc_id").agg(F.collect_set("extra").alias("__spans_found")).withColumnRenamed("doc_id", "__spans_of")
    names = docs.columns
    where = names.index(text_col)
    both = docs.join(extra, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__spans_of")), "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("__spans_found", F.array()).alias("__spans_found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, more in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                if text is None:
                    out.append(None)
                    continue
                spans = base_spans(text)
                mine = set(candidate_spans(text, spans))
                spans += [(s["start"], s["end"], FOUND) for group in more for s in group if (s["start"], s["end"]) in mine]
                spans.sort(key=lambda s: (s[0], ORDER[s[2]]))
                parts, at = [], 0
                for a, b, kind in spans:
                    if a >= at:
                        parts += [text[at:a], f"<{kind}>"]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]))
            columns = list(batch.columns[: len(names)])
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(run, docs.schema)
