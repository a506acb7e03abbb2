"""Source text as classed tokens, and identifiers laid over them; expressions only, no Python.

One pattern reads a whole text from left to right, so a block comment carries over lines by itself. A text without a language is
SystemVerilog; a language without rules of its own has comments, strings, numbers and operators only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words by class, forms of numbers, operator characters and language names.
SV_TYPES = "logic wire reg bit byte int integer shortint longint time real shortreal genvar signed unsigned void string chandle event"
SV_KEYWORDS = (
    "module endmodule begin end if else case casez casex endcase default for while repeat generate endgenerate assign always always_ff always_comb always_latch initial "
    "posedge negedge input output inout parameter localparam function endfunction task endtask return typedef enum struct union packed interface endinterface modport import "
    "export package endpackage automatic static const unique priority break continue"
)
C_TYPES = (
    "void char short int long float double signed unsigned bool size_t ssize_t wchar_t char16_t char32_t auto int8_t int16_t int32_t int64_t "
    "uint8_t uint16_t uint32_t uint64_t intptr_t uintptr_t ptrdiff_t nullptr_t"
)
C_KEYWORDS = (
    "if else for while do switch case default break continue return goto sizeof typedef struct union enum static extern register volatile const inline restrict "
    "class public private protected virtual override final namespace using template typename new delete this operator friend explicit mutable constexpr consteval "
    "noexcept throw try catch nullptr true false static_cast dynamic_cast const_cast reinterpret_cast decltype"
)
SV_NUMBER = r"(?:\d[\d_]*)?'[sS]?[bBoOdDhH][0-9a-fA-FxXzZ_]+|\d[\d_]*(?:\.\d[\d_]*)?"
C_NUMBER = r"0[xX][0-9a-fA-F]+[uUlL]*|0[bB][01]+[uUlL]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[uUlLfF]*"
OPERATORS = r"=+\-*/%<>!&|^~?:"
SV_NAMES = ("systemverilog", "verilog", "sv", "v")
C_NAMES = ("c", "cpp", "cc", "cxx", "h", "hpp")


@dataclass(frozen=True)
class Grammar:
    types: str
    keywords: str
    number: str
    directive: str = ""
    systask: bool = False
    char: bool = False

    def parts(self) -> list[tuple[str, str]]:
        """(class, pattern) in the order in which they are tried at a place; every pattern takes at least one character."""
        word = lambda words: rf"(?:{'|'.join(sorted(words.split(), key=len, reverse=True))})(?!\w)"
        quoted = lambda q: rf"{q}(?:\\[^\n]?|[^{q}\\\n]++)*+{q}?"
        out = [("comment", r"//[^\n]*+"), ("comment", r"/\*[\s\S]*?(?:\*/|\z)"), ("string", quoted('"'))]
        if self.directive:
            out.append(("directive", rf"{self.directive}[A-Za-z_]\w*+"))
        if self.systask:
            out.append(("systask", r"\$[A-Za-z_]\w*+"))
        if self.char:
            out.append(("string", quoted("'")))
        out.append(("number", self.number))
        if self.types:
            out += [("type", word(self.types)), ("keyword", word(self.keywords))]
        return out + [("operator", f"[{OPERATORS}]++")]

    def pattern(self) -> str:
        """All classes, the line feed, and plain text: whatever lies between, names included."""
        known = "|".join(p for _, p in self.parts())
        return rf"(?:{known}|\n|(?:(?!{known}|\n)(?:[A-Za-z_]\w*+|[\s\S]))++)"


SV = Grammar(SV_TYPES, SV_KEYWORDS, SV_NUMBER, directive="`", systask=True)
C = Grammar(C_TYPES, C_KEYWORDS, C_NUMBER, directive="#", char=True)
PLAIN = Grammar("", "", C_NUMBER)


def _classed(token: Column, grammar: Grammar) -> Column:
    out = F.when(token == "\n", "line")
    for name, pattern in grammar.parts():
        out = out.when(token.rlike(rf"\A(?:{pattern})\z"), name)
    return out.otherwise("plain")


def tokenize(files: DataFrame) -> DataFrame:
    """(file, line, token, text, cls) of (file, text, language): tokens of each line from 0, which joined again give the line.

    Lines end with a line feed, a carriage return or both. Comments over several lines have a token in each line that isn't empty; an
    open string ends with its line. A null text has no tokens. A file that repeats gives its tokens once more under the same numbers.
    """
    lang = F.lower("language")
    kinds = ((SV, F.col("language").isNull() | lang.isin(*SV_NAMES)), (C, lang.isin(*C_NAMES)), (PLAIN, ~lang.isin(*SV_NAMES, *C_NAMES)))
    text = F.regexp_replace("text", "\r\n|\r", "\n")
    out = None
    for grammar, chosen in kinds:
        found = F.regexp_extract_all(text, F.lit(grammar.pattern()), F.lit(0))
        rows = files.where(chosen & F.col("text").isNotNull()).select("file", "text", F.monotonically_increasing_id().alias("row"))
        rows = rows.select("file", "row", F.posexplode(found).alias("nth", "t"))
        rows = rows.withColumn("cls", _classed(F.col("t"), grammar))
        out = rows if out is None else out.unionAll(rows)
    before = Window.partitionBy("file", "row").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("t") - F.length(F.regexp_replace("t", "\n", ""))
    rows = out.withColumn("first", F.coalesce(F.sum(feeds).over(before), F.lit(0)))
    rows = rows.where("cls <> 'line'").select("file", "row", "nth", "cls", "first", F.posexplode(F.split("t", "\n")).alias("down", "text")).where("text <> ''")
    rows = rows.withColumn("line", (F.col("first") + F.col("down")).cast("int"))
    order = Window.partitionBy("file", "row", "line").orderBy("nth", "down")
    return rows.select("file", "line", (F.row_number().over(order) - 1).alias("token"), "text", "cls")


def overlay(tokens: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, line, piece, text, cls): plain tokens (file, line, token, text, cls) split at names (file, line, col from 1, len, name).

    A name counts if it lies in one plain token; of names that overlap the first stays, by column and then length. Pieces joined give the
    line. Lines without names keep their tokens.
    """
    before = Window.partitionBy("file", "line").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    at = tokens.withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    spans = refs.groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct((F.col("col") - 1).cast("int").alias("s"), F.col("len").cast("int").alias("n"), "name"))).alias("spans"))
    rows = at.join(spans, ["file", "line"], "left")
    inside = F.filter(F.coalesce("spans", F.array()), lambda r: (F.col("cls") == "plain") & (r["s"] >= F.col("start")) & (r["s"] + r["n"] <= F.col("start") + F.length("text")))
    piece = lambda a, n, cls: F.struct(F.substring(F.col("text"), a - F.col("start") + 1, n).alias("text"), cls.alias("cls"))
    empty = F.struct(F.col("start").alias("pos"), F.expr("CAST(array() AS ARRAY<STRUCT<text: STRING, cls: STRING>>)").alias("out"))

    def step(state: Column, r: Column) -> Column:
        gap = piece(state["pos"], r["s"] - state["pos"], F.lit("plain"))
        named = piece(r["s"], r["n"], F.concat(F.lit("name-"), r["name"]))
        return F.when(r["s"] < state["pos"], state).otherwise(F.struct((r["s"] + r["n"]).alias("pos"), F.concat(state["out"], F.array(gap, named)).alias("out")))

    done = F.aggregate(inside, empty, step)
    rows = rows.select("file", "line", "token", "text", "cls", "start", done.alias("done"))
    rest = piece(F.col("done.pos"), F.col("start") + F.length("text") - F.col("done.pos"), F.col("cls"))
    pieces = rows.select("file", "line", "token", F.posexplode(F.concat("done.out", F.array(rest))).alias("k", "p")).where("p.text <> ''")
    order = Window.partitionBy("file", "line").orderBy("token", "k")
    return pieces.select("file", "line", (F.row_number().over(order) - 1).alias("piece"), F.col("p.text").alias("text"), F.col("p.cls").alias("cls"))
